import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from callweave.functions import columns as c
from callweave.operators import calls as k, quality
from callweave.plans.calls import Era, build_calls
from conftest import tuples

ALLOC = "borrow_user_id long, time_mark timestamp, dun_case_id long, overdue_max_days int"
CALL = "callid string, user_id long, ringtime timestamp"


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def asof(spark, call_rows, alloc_rows, **kw):
    return k.asof_allocation(
        spark.createDataFrame(call_rows, CALL),
        spark.createDataFrame(alloc_rows, ALLOC),
        "2024-01-01", "2024-02-01", **kw,
    )


def test_same_day_allocation_counts_even_when_later(spark):
    out = asof(
        spark,
        [("c", 1, at(5, 9))],
        [(1, at(1), 10, 40), (1, at(5, 18), 11, 40), (1, at(9), 12, 40)],
    )
    assert tuples(out, "time_mark", "allocated_case") == [(at(5, 18), 11)]


def test_overdue_range_and_window(spark):
    rows = [(1, at(2), 30, 30), (2, at(2), 31, 31), (3, at(2), 60, 60), (4, at(2), 61, 61),
            (5, datetime(2023, 12, 31, 23), 5, 40), (6, datetime(2024, 2, 1), 6, 40)]
    late = datetime(2024, 2, 3)
    out = asof(spark, [(str(u), u, late) for u in range(1, 7)], rows)
    assert tuples(out, "allocated_case") == [(31,), (60,)]


def test_ties_go_to_the_larger_case_and_no_match_drops(spark):
    out = asof(
        spark,
        [("c", 1, at(5)), ("early", 1, at(1)), ("stranger", 2, at(5))],
        [(1, at(3), 8, 40), (1, at(3), 9, 40)],
    )
    assert tuples(out, "callid", "allocated_case") == [("c", 9)]


def test_asof_equals_brute_force_with_a_hot_user(spark):
    rng = random.Random(5)
    stamp = lambda: at(1) + timedelta(minutes=rng.randrange(29 * 24 * 60))
    user = lambda: 1 if rng.random() < 0.4 else rng.randint(2, 9)
    call_rows = [(str(i), user(), stamp()) for i in range(400)]
    alloc_rows = [(user(), stamp(), i, rng.randint(25, 65)) for i in range(150)]
    expected = []
    for callid, u, ring in call_rows:
        fit = [(m, case) for w, m, case, d in alloc_rows
               if w == u and 31 <= d <= 60 and m.date() <= ring.date()]
        if fit:
            expected.append((callid, *max(fit)))
    out = asof(spark, call_rows, alloc_rows)
    assert tuples(out, "callid", "time_mark", "allocated_case") == sorted(
        expected, key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def test_relation_class(spark):
    ranks = spark.createDataFrame([(1,), (2,), (3,), (5,), (6,), (7,), (8,), (None,)], "r int")
    got = [r[0] for r in ranks.select(c.relation_class(F.col("r"))).collect()]
    assert got == ["self", "self", "close_contact", "close_contact", "top_contact",
                   "top_contact", "others", "others"]


def test_enrich_calls(spark):
    schema = ("callid string, file_date string, phone string, ringtime timestamp, duration int, "
              "user_id long, owner_id long, owner_name string, group_name string, "
              "dun_case_id long, time_mark date")
    row = lambda callid, ring, mark: (
        callid, "2024-01-05", "p", ring, 20, 1, 2, "n", "g", 3, mark)
    calls = spark.createDataFrame(
        [row("a", at(5, 9), date(2024, 1, 5)), row("b", at(5, 8), date(2024, 1, 5)),
         row("c", at(8), date(2024, 1, 5)), row("d", at(8), date(2024, 1, 7))],
        schema,
    )
    directory = spark.createDataFrame(
        [(1, "p", date(2024, 1, 5), 6), (1, "p", date(2024, 1, 5), 2)],
        "user_id long, phone string, dt date, order_id int",
    )
    out = k.enrich_calls(calls, directory)
    assert tuples(out, "callid", "phone_type", "is_first_yes_call", "yes_call_num", "day_num") == [
        ("a", "self", "新案", 2, 0), ("b", "self", "新案", 1, 0),
        ("c", "others", "老案", 3, 3), ("d", "others", "老案", 1, 1),
    ]


def test_build_calls_of_two_systems(spark):
    turns = spark.createDataFrame(
        [("2024-01-03", "early", 1), ("2024-01-03", "early", 2), ("2024-01-20", "late", 1),
         ("2024-01-20", "bad", 1), ("2024-01-03", "nobody", 1)],
        "file_date string, callid string, seq_id int",
    )
    records = spark.createDataFrame(
        [("early", "p", at(3), 30, 1, 7, "Ann", "g"), ("early", "p", at(3), 30, 1, 7, "Ann", "g"),
         ("early", "p", at(3), 30, 2, 7, "Ann", "g"), ("nobody", "p", at(3), 30, None, 7, "Ann", "g"),
         ("late", "p", at(20), 30, 1, 7, "Ann", "g")],
        "calluuid string, dnis string, ringtime timestamp, t_durtion int, user_id long, "
        "owner_id long, owner_name string, group_name string",
    )
    sip = spark.createDataFrame(
        [("late", at(20, 9), at(20, 9), "1", "77", "x1", "q", 40),
         ("bad", at(20, 9), at(20, 9), "1", "no case", "x1", "q", 40),
         ("early", at(3), at(3), "1", "78", "x1", "q", 40)],
        "calluuid string, createtime timestamp, ringtime timestamp, ud_1 string, ud_2 string, "
        "dn string, dnis string, t_durtion int",
    )
    extensions = spark.createDataFrame([("x1", 8)], "extensionnumber string, user_id long")
    roster = spark.createDataFrame(
        [(8, "Bob", "team large", date(2024, 1, 20)), (8, "Bob", "team large", date(2024, 1, 20)),
         (8, "Bob", "other", date(2024, 1, 20))],
        "owner_id long, owner_name string, group_name string, dt date",
    )
    alloc = spark.createDataFrame([(1, at(2), 5, 40), (2, at(1), 6, 40)], ALLOC)
    window = Era("2024-01-01", "2024-02-01")
    out = build_calls(turns, records, sip, extensions, roster, alloc, "2024-01-15",
                      window, window, "2024-02-01", "large")
    assert tuples(out, "callid", "user_id", "owner_name", "dun_case_id", "time_mark") == [
        ("early", 1, "Ann", 5, date(2024, 1, 2)), ("early", 2, "Ann", 6, date(2024, 1, 1)),
        ("late", 1, "Bob", 77, date(2024, 1, 2)),
    ]
    assert out.columns == k.CALL_COLUMNS


def test_quality_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, v int")
    assert tuples(quality.duplicate_keys(df, ["key"]), "key", "copies") == [("a", 2)]
    other = spark.createDataFrame([("b",)], "key string")
    assert tuples(quality.unmatched(df, other, ["key"]), "v") == [(1,), (2,)]


def test_a_call_of_both_systems_is_numbered_the_same_way(spark, tmp_path):
    """Two rows alike in user, time and number, in either order of the input."""
    rows = [("7", at(9, 8), "2024-01-15", 2, 11), ("7", at(9, 8), "2024-01-16", 1, 12),
            ("8", at(9, 9), "2024-01-15", 1, 13)]
    schema = "callid string, ringtime timestamp, file_date string, owner_id long, dun_case_id long"
    for n, given in enumerate((rows, rows[::-1])):
        calls = spark.createDataFrame(given, schema).coalesce(1).withColumns(
            {"user_id": F.lit(1), "time_mark": F.lit("2024-01-02").cast("date")}
        )
        for target in (None, str(tmp_path / f"ordinal-{n}")):
            out = k.call_ordinal(calls, target=target)
            assert tuples(out, "dun_case_id", "yes_call_num") == [(11, 2), (12, 1), (13, 3)]
