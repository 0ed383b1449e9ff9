import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from callweave.functions import predicates as p
from callweave.functions.rules_zh import MANDARIN
from callweave.operators import agents as a, lifecycle as l, reports as r
from conftest import tuples

CUT = "2024-01-31"


def features(spark, n=600, seed=4):
    """Random feature rows; a third of them belong to one owner."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ring = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 60))
        mark = ring.date() - timedelta(days=rng.choice([0, 0, 1, 5]))
        rows.append((
            ring.date().isoformat(), 1 if i % 3 == 0 else rng.randint(2, 5), rng.randint(1, 9),
            rng.randint(1, 25), f"c{i:04d}", rng.choice(["self", "others", None]), ring,
            rng.randint(5, 60), mark, "新案" if mark == ring.date() else "老案",
            rng.randint(1, 3), (ring.date() - mark).days,
        ))
    df = spark.createDataFrame(rows, (
        "dt string, owner_id long, user_id long, dun_case_id long, callid string, "
        "contact_type string, ringtime timestamp, duration int, time_mark date, "
        "is_first_yes_call string, yes_call_num int, day_num int"))
    number = F.substring("callid", 2, 4).cast("int")
    numeric = [m for m in r.NUMERIC if m not in ("day_num", "duration")]
    return df.withColumns({
        **{m: ((number * (j + 3)) % 17).cast("double") for j, m in enumerate(numeric)},
        **{n: F.when(number % (j + 2) == 0, "true").when(number % 5 != 0, "false")
           for j, n in enumerate(MANDARIN.names)},
    })


def test_complete_calls(spark):
    df = features(spark)
    rows = df.collect()
    base = {}
    for x in rows:
        if x.dt <= CUT and x.day_num == 0 and x.yes_call_num == 1:
            base[x.dun_case_id] = min(x.ringtime, base.get(x.dun_case_id, x.ringtime))

    def kept(early_any):
        return sorted(
            (x.callid,) for x in rows
            if (x.dt <= CUT and x.dun_case_id in base and x.ringtime >= base[x.dun_case_id]
                and (early_any or x.duration > 10))
            or (x.dt > CUT and x.duration > 10)
        )

    assert tuples(l.complete_calls(df, CUT), "callid") == kept(False)
    assert tuples(l.complete_calls(df, CUT, early_min_seconds=None), "callid") == kept(True)
    assert tuples(l.complete_calls(df.union(df), CUT, distinct=True), "callid") == kept(False)


def test_first_only_equals_order_one(spark):
    df = features(spark)
    full = l.lifecycle_base(df, CUT).filter("order_num = 1")
    first = l.lifecycle_base(df, CUT, first_only=True)
    assert tuples(full, "callid") == tuples(first, "callid")
    assert {x.new_contact_type for x in full.collect()} == {"逾期本人", "联系人"}


def test_histogram(spark):
    df = spark.createDataFrame(
        [("2024-02-01", 1, 1, date(2024, 2, 1), d, 20, "self", datetime(2024, 2, 2), 1)
         for d in (0, 2)]
        + [("2024-02-01", 1, 2, date(2024, 2, 1), 2, 20, "others", datetime(2024, 2, 2), 1)] * 2
        + [("2024-02-01", 1, 3, date(2024, 3, 1), 2, 20, "self", datetime(2024, 2, 2), 1)],
        "dt string, owner_id int, dun_case_id int, time_mark date, day_num int, duration int, "
        "contact_type string, ringtime timestamp, yes_call_num int",
    )
    out = l.lifecycle_histogram(df, CUT, "2024-03-01")
    assert tuples(out, "day_num", "num", "num_num") == [(2, 2, 2)]
    assert tuples(l.lifecycle_histogram_self(df, CUT, "2024-03-01"), "num_num") == [(1,)]


def test_report_equals_plain_aggregates(spark):
    base = l.lifecycle_base(features(spark), CUT).cache()
    report = r.first_contact_report(base, min_rows=5)
    calls = base.filter("new_contact_type = '联系人' and order_num = 1")
    calls = calls.withColumns({
        m: F.coalesce(F.col(m) == "true", F.lit(False)).cast("int")
        for m in r.CONTACT_METRICS if m not in r.NUMERIC
    })
    plain = calls.groupBy("owner_id", F.month(F.to_date("dt")).alias("month")).agg(
        F.count("*").alias("num"),
        *[F.avg(m).alias(f"{m}_mean") for m in r.CONTACT_METRICS],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in r.CONTACT_METRICS],
    ).filter("num > 5")
    assert report.columns == plain.columns
    tidy = lambda df: tuples(df.select(*[F.round(c, 9).alias(c) for c in df.columns]), *df.columns)
    assert tidy(report) == tidy(plain)


def test_report_metric_lists():
    assert [len(x) for x in (r.CONTACT_METRICS, r.SELF_METRICS, r.ALL_SELF_METRICS)] == [41, 34, 34]
    assert set(r.SELF_METRICS) == set(r.ALL_SELF_METRICS)


def test_report_group_size(spark):
    one = features(spark, 101).withColumns({
        "owner_id": F.when(F.substring("callid", 2, 4).cast("int") < 50, 1).otherwise(2),
        "dt": F.lit("2024-02-01"), "contact_type": F.lit("self"), "duration": F.lit(30),
        "dun_case_id": F.substring("callid", 2, 4).cast("long"),
    })
    base = l.lifecycle_base(one, CUT)
    assert tuples(r.all_self_report(base), "owner_id", "num") == [(2, 51)]
    assert not [c for c in r.all_self_report(base).columns if c.endswith("_std")]


def test_durations(spark):
    df = spark.createDataFrame(
        [(d, t) for d in (9, 10, 11) for t in ("self", "others", None)],
        "duration int, phone_type string",
    )
    assert tuples(p.not_self_min_duration(df), "duration", "phone_type") == [
        (10, "others"), (10, None), (11, "others"), (11, None)
    ]
    assert {x.duration for x in p.min_duration(df).collect()} == {11}


def test_first_contact_calls(spark):
    row = lambda dt, age, n, day, s: (dt, age, n, day, s)
    df = spark.createDataFrame(
        [row("2024-01-05", "新案", 1, 0, 10), row("2024-01-05", "老案", 1, 0, 10),
         row("2024-01-05", "新案", 1, 1, 10), row("2024-02-05", "老案", 1, 4, 10),
         row("2024-02-05", "老案", 2, 4, 10), row("2024-02-05", "老案", 1, 4, 9)],
        "dt string, is_first_yes_call string, yes_call_num int, day_num int, duration int",
    )
    assert p.first_contact_calls(df, CUT).count() == 2


def test_predicates_reach_the_files(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    path = str(tmp_path / "t")
    spark.sql("select '2024-01-02' as file_date, timestamp'2024-01-02 03:00:00' as ts").write.parquet(path)
    df = p.in_window(p.in_month(spark.read.parquet(path), "file_date", "2024-01"), "ts",
                     "2024-01-01", "2024-01-03")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for part in ("StringStartsWith(file_date,2024-01)", "GreaterThanOrEqual(ts", "LessThan(ts"):
        assert part in plan
    assert df.count() == 1


def test_split_era_compares_text(spark):
    df = spark.createDataFrame([("2018-06-30",), ("2018-07-01",)], "file_date string")
    early, late = p.split_era(df, "2018-06-31")
    assert (tuples(early, "file_date"), tuples(late, "file_date")) == (
        [("2018-06-30",)], [("2018-07-01",)])


def agent_rates(spark, n, missing=()):
    return spark.createDataFrame(
        [(i, 1, None if i in missing else (i // 2) / 10) for i in range(n)],
        "owner_id long, tot_case_num long, repay_rate double",
    )


def test_top_bottom(spark):
    assert a.top_bottom(agent_rates(spark, 25)).count() == 20
    assert a.top_bottom(agent_rates(spark, 15)).count() == 15
    rows = a.top_bottom(agent_rates(spark, 25), 2).collect()
    assert [x.owner_id for x in rows] == [24, 22, 0, 1]
    assert a.top_bottom(agent_rates(spark, 25, missing=[0]), 2).count() == 4


def test_rank_agents(spark):
    ranked = a.rank_agents(agent_rates(spark, 7, missing=[0]))
    assert tuples(ranked, "jx_rank", "owner_id", "repay_rate_2") == [
        (1, 6, "30.00%"), (2, 4, "20.00%"), (3, 5, "20.00%"), (4, 2, "10.00%"),
        (5, 3, "10.00%"), (6, 1, "0.00%"), (7, 0, None),
    ]


def test_agent_performance(spark):
    df = spark.createDataFrame(
        [(1, 5, 1.0, 4.0, "x M2 y"), (1, 5, 1.0, 4.0, "M2"), (1, 6, 0.0, 0.0, "M3"),
         (2, 7, 1.0, 0.0, "M2")],
        "owner_id long, dun_case_id long, dun_repay_amount double, start_owing_amount double, "
        "model string",
    )
    out = a.agent_performance(df, "M2")
    assert tuples(out, "owner_id", "tot_case_num", "repay_rate") == [(1, 1, 0.25), (2, 1, None)]


def test_first_agent(spark):
    df = spark.createDataFrame([(2, "a"), (1, "b"), (1, "c")], "owner_id int, v string")
    assert tuples(a.first_agent(df), "v") == [("b",), ("c",)]
    assert a.first_agent(df, 1).count() == 1
