import random
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from callweave.operators import flags as f, metrics as m, rollup as r
from callweave.plans.features import features_from_turns
from conftest import tuples
from test_rules import AGENT_GOLDEN, USER_GOLDEN

TURNS = ("file_date string, callid string, channel string, content string, seq_id int, "
         "speed double")
CALLS = ("callid string, file_date string, phone string, ringtime timestamp, duration int, "
         "user_id long, owner_id long, owner_name string, group_name string, dun_case_id long, "
         "time_mark date, phone_type string, is_first_yes_call string, yes_call_num int, day_num int")


def call(callid, owner=1, user=1, kind="others"):
    return (callid, "2024-01-05", "p", datetime(2024, 1, 5, 9), 20, user, owner, "n", "g", 3,
            date(2024, 1, 5), kind, "新案", 1, 0)


def sample(spark):
    """Random calls of rule sentences; some with two records, none, or one speaker."""
    rng = random.Random(2)
    texts = [t for pair in (*AGENT_GOLDEN.values(), *USER_GOLDEN.values()) for t in pair]
    texts += ["您放心。", "不行", "好的，再见。"]
    turns, calls = [], []
    for n in range(40):
        speakers = ["AGENT"] if n == 7 else ["USER"] if n == 8 else ["AGENT", "USER"]
        for seq in range(1, 13):
            turns.append(("2024-01-05", str(n), rng.choice(speakers), rng.choice(texts), seq,
                          rng.choice([None, 90.0, 120.5])))
        kind = rng.choice(["self", "close_contact", "others"])
        if n != 9:
            calls.append(call(str(n), owner=n % 4, kind=kind))
        if n in (10, 11):
            calls.append(call(str(n), owner=9 if n == 10 else n % 4, user=2, kind=kind))
    return spark.createDataFrame(turns, TURNS), spark.createDataFrame(calls, CALLS)


def test_fused_features_equal_the_separate_tables(spark):
    turns, calls = sample(spark)
    turns, calls = turns.cache(), calls.cache()
    flags = r.call_flags(f.agent_flags(turns, calls), f.user_flags(turns, calls))
    separate = m.call_features(m.call_metrics(turns, calls), flags)
    fused = features_from_turns(turns, calls)
    assert fused.columns == separate.columns
    assert len(fused.columns) == 54
    doubles = [x.name for x in fused.schema if x.dataType.typeName() == "double"]
    rounded = lambda df: df.withColumns({n: F.round(n, 9) for n in doubles})
    left = tuples(rounded(separate), *fused.columns)
    assert left == tuples(rounded(fused), *fused.columns)
    assert {row[4] for row in left} == {str(n) for n in range(40) if n not in (7, 8, 10, 11)}


def test_boolean_flags_roll_up_like_text(spark):
    turns, calls = sample(spark)
    text = r.call_flags(f.agent_flags(turns, calls), f.user_flags(turns, calls))
    booleans = r.call_flags(
        f.agent_flags(turns, calls, codes=False), f.user_flags(turns, calls, codes=False)
    )
    assert tuples(text, *text.columns) == tuples(booleans, *text.columns)


def test_rollup_and_blanking(spark):
    rows = [("a", "A"), ("a", "false"), ("a", None), ("b", "false"), ("b", None)]
    flags = spark.createDataFrame(rows, "callid string, x string")
    rolled = r.rollup_flags(flags, ["x"], ["callid"])
    assert tuples(rolled, "callid", "x") == [("a", "true"), ("b", "false")]
    shown = spark.createDataFrame([("true", "true"), ("true", "false"), ("true", None)],
                                  "x string, y string")
    assert tuples(r.blank_unless(shown, {"x": "y"}), "x") == [("true",), (None,), (None,)]


def test_null_by_contact(spark):
    turns, calls = sample(spark)
    flags = r.call_flags(
        f.agent_flags(turns, calls), f.user_flags(turns, calls), null_by_contact=True
    )
    of_self = flags.filter("contact_type = 'self'")
    assert of_self.filter("is_knowing is not null or is_detail is not null").count() == 0
    others = flags.filter("contact_type = 'others'")
    assert others.filter("time_bargain is not null or is_knowing is null").count() == 0


def test_metrics(spark):
    turns = spark.createDataFrame(
        [("d", "1", "AGENT", "你好吗", 1, 5.0), ("d", "1", "AGENT", "a", 2, 7.0),
         ("d", "1", "USER", "好", 3, None), ("d", "2", "USER", "", 1, 3.0)],
        TURNS,
    )
    out = m.call_metrics(turns, spark.createDataFrame([call("1")], CALLS))
    assert tuples(out, "callid", *m.TEXT_METRICS) == [
        ("1", 3, 7.0, None, 0.75, 1.5, 3, 1.0, 1),
        ("2", 1, None, 3.0, None, None, None, 0.0, 0),
    ]
    chars = m.call_metrics(turns, spark.createDataFrame([call("1")], CALLS), bytes_per_char=None)
    assert tuples(chars.filter("callid = '1'"), "ratio_collector_char") == [(0.8,)]


def test_calls_repeated_on_either_side_are_dropped(spark):
    metrics = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",)], "callid string")
    flags = spark.createDataFrame(
        [("a", 1, "d", "self"), ("b", 1, "d", "self"), ("c", 1, "d", "self"),
         ("c", 2, "d", "self")],
        "callid string, owner_id int, dt string, contact_type string",
    )
    assert tuples(m.drop_ambiguous(metrics, flags), "callid") == [("a",)]


def test_turn_text_is_not_shuffled_by_the_fused_plan(spark, tmp_path, capsys):
    turns, calls = sample(spark)
    turns.write.parquet(str(tmp_path / "turns"))
    stored = spark.read.parquet(str(tmp_path / "turns"))
    features_from_turns(stored, calls).explain("formatted")
    text = capsys.readouterr().out
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", text)
    assert text.count(") Scan parquet") == 1
    assert len(inputs) == 3
    assert not any("content#" in columns for columns in inputs)
