from pyspark.sql import functions as F

from callweave.operators import turns as t
from conftest import tuples

SEGMENTS = "new_name string, file_name string, rt_role string, seg_no int, rt_text string"
RAW = "file_name string, rt_role string, file_date string, rt_text string, rt_speed double"


def test_segments_join_in_order(spark):
    seg = spark.createDataFrame(
        [("c_1_1", "1", "AGENT", i, x) for i, x in [(2, "c"), (0, "a"), (1, "b")]], SEGMENTS
    )
    assert tuples(t.merge_segments(seg), "callid", "channel", "content") == [
        ("1", "AGENT", "a, b, c")
    ]


def test_turns_follow_the_number_in_the_name(spark):
    seg = spark.createDataFrame(
        [("x_y_10", "1", "USER", 0, "late"), ("x_y_9", "1", "AGENT", 0, "early"),
         ("x_y_no", "1", "USER", 0, "unnumbered")],
        SEGMENTS,
    )
    raw = spark.createDataFrame(
        [("1", "USER", "2024-01-01", "abc", 4.0), ("1", "USER", "2024-01-01", "abcdefghi", 8.0)],
        RAW,
    )
    out = t.build_turns(seg, raw)
    assert out.columns == ["file_date", "callid", "channel", "content", "seq_id", "speed"]
    assert tuples(out, "seq_id", "content", "speed") == [
        (1, "unnumbered", 7.0), (2, "early", None), (3, "late", 7.0)
    ]


def test_speed_of_empty_text_is_null(spark):
    raw = spark.createDataFrame([("1", "USER", "2024-01-01", "", 4.0)], RAW)
    assert tuples(t.weighted_speed(raw), "speed") == [(None,)]


def test_long_call_is_numbered_across_slots(spark):
    names = [(f"c_1_{i}", "1", "AGENT", 0, str(i)) for i in range(300)]
    merged = t.merge_segments(spark.createDataFrame(names, SEGMENTS)).withColumn(
        "file_date", F.lit("2024-01-01")
    )
    numbered = t.number_turns(merged, slot_width=16)
    assert numbered.filter(F.col("seq_id") != F.col("content").cast("int") + 1).count() == 0


def test_call_of_two_dates_repeats_its_turns(spark):
    seg = spark.createDataFrame([("c_1_1", "1", "USER", 0, "a")], SEGMENTS)
    raw = spark.createDataFrame(
        [("1", "USER", d, "abc", 4.0) for d in ("2024-01-01", "2024-01-02")], RAW
    )
    assert tuples(t.build_turns(seg, raw), "file_date", "seq_id") == [
        ("2024-01-01", 1), ("2024-01-02", 2)
    ]


TURNS = "file_date string, callid string, channel string, content string, seq_id int"


def test_call_texts(spark):
    turns = spark.createDataFrame(
        [("2024-01-01", "1", "AGENT", "b", 3), ("2024-01-01", "1", "AGENT", "a", 1),
         ("2024-01-01", "1", "USER", "u", 2), ("2024-02-01", "2", "AGENT", "z", 1)],
        TURNS,
    )
    assert tuples(t.call_text(turns, "2024-01"), "callid", "channel", "content") == [
        ("1", "AGENT", "a, b"), ("1", "USER", "u")
    ]
    assert tuples(t.call_text(turns, channel="AGENT"), "callid", "content") == [
        ("1", "a, b"), ("2", "z")
    ]
    calls = spark.createDataFrame([("1", 7), ("1", 7), ("1", 8)], "callid string, owner_id long")
    texts = t.call_text_all(turns, calls, channel="AGENT")
    assert tuples(texts, "owner_id", "callid", "content") == [
        (7, "1", "a, a, b, b"), (8, "1", "a, b"), (None, "2", "z")
    ]
