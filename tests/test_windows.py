import pytest
import random

from pyspark.sql import Window, functions as F

from callweave.operators.windows import (
    balanced_row_number, first_of_group, mark_copies, only_unique, previous_turn, spread_row_number,
)
from conftest import tuples


def hot_rows(spark, n=3000):
    """A third of the rows under one key; some NULL keys and NULL orders."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, f"k{i % 50}"])
        rows.append((i, key, rng.choice([None, *range(500)])))
    return spark.createDataFrame(rows, "id int, key string, pos int")


def test_spread_row_number_equals_plain_window(spark):
    df = hot_rows(spark)
    order = [F.col("pos"), F.col("id")]
    spread = spread_row_number(df, ["key"], order, F.floor(F.col("pos") / 16), "n")
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    assert tuples(spread, "id", "n") == tuples(plain, "id", "n")
    assert spread.columns == ["id", "key", "pos", "n"]


def test_spread_row_number_descending_without_keys(spark):
    df = hot_rows(spark)
    order = [F.col("pos").desc_nulls_last(), F.col("id")]
    spread = spread_row_number(
        df, [], order, F.floor(F.col("pos") / 10), "n", slot_descending=True
    )
    plain = df.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    assert tuples(spread, "id", "n") == tuples(plain, "id", "n")


def test_balanced_row_number_equals_plain_window(spark, tmp_path):
    df = hot_rows(spark)
    order = [F.col("pos").desc_nulls_last(), F.col("id")]
    got = balanced_row_number(df, ["key"], order, "n", str(tmp_path / "rows"), partitions=7)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    assert tuples(got, "id", "n") == tuples(plain, "id", "n")
    assert got.columns == ["id", "key", "pos", "n"]
    alone = balanced_row_number(df, [], order, "n", str(tmp_path / "alone"))
    assert tuples(alone, "id", "n") == tuples(
        df.withColumn("n", F.row_number().over(Window.orderBy(*order))), "id", "n"
    )
    none = balanced_row_number(df.filter("false"), ["key"], order, "n", str(tmp_path / "none"))
    assert none.collect() == []


def test_balanced_tasks_hold_few_rows_of_one_hour(spark, tmp_path):
    """All rows under one key, at one time: only the tie-breaker tells them apart."""
    df = spark.range(8000).select(F.lit("k").alias("key"), F.lit(5).alias("hour"), F.col("id").cast("string").alias("id"))
    order = [F.col("hour"), F.col("id")]
    got = balanced_row_number(df, ["key"], order, "n", str(tmp_path / "rows"), partitions=16)
    placed = spark.read.parquet(str(tmp_path / "rows"))
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("__place", 33).alias("p")).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 2 * 8000 / 16
    ids = sorted(str(k) for k in range(8000))
    assert [r.id for r in got.orderBy("n").collect()] == ids


def test_spread_row_number_shuffles_rows_once(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("key"), F.col("id").alias("pos"), F.lit("x").alias("wide")
    )
    spread = spread_row_number(df, ["key"], [F.col("pos")], F.floor(F.col("pos") / 16), "n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spread._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4  # rows, counts, offsets twice


def test_group_limit_reaches_both_sides_of_the_exchange(spark):
    df = first_of_group(hot_rows(spark), ["key"], [F.col("pos"), F.col("id")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    plan = only_unique(hot_rows(spark), "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_only_unique(spark):
    rows = [("a",), ("b",), ("b",), ("c",), ("c",), ("c",), (None,)]
    df = spark.createDataFrame(rows, "key string")
    assert tuples(only_unique(df, "key"), "key") == [("a",)]
    assert tuples(mark_copies(df, "key", "n"), "key", "n") == [("a", 1), ("b", 2), ("c", 2)]


def test_previous_turn_equals_self_join(spark):
    rng = random.Random(3)
    rows = []
    for call in range(12):
        length = 97 if call == 0 else rng.randint(1, 9)
        for seq in range(1, length + 1):
            if rng.random() < 0.9:  # gaps: the number before may be missing
                rows.append((str(call), seq, rng.random() < 0.4))
    df = spark.createDataFrame(rows, "callid string, seq_id int, hit boolean")
    shifted = previous_turn(df, {"before": F.col("hit")}, block=8)
    a, b = df.alias("a"), df.alias("b")
    joined = b.join(
        a,
        (F.col("a.callid") == F.col("b.callid"))
        & (F.col("a.seq_id") == F.col("b.seq_id") - 1),
        "left",
    ).select("b.callid", "b.seq_id", F.col("a.hit").alias("before"))
    assert tuples(shifted, "callid", "seq_id", "before") == tuples(
        joined, "callid", "seq_id", "before"
    )


def partition_sizes(df):
    return [n for n in df.rdd.glom().map(len).collect() if n]


def test_hot_call_is_many_tasks_even_when_hashed_by_call(spark):
    from callweave.operators.windows import previous_turn

    n = 20_000
    turns = spark.range(n).select(F.lit("hot").alias("callid"), F.col("id").alias("seq_id"))
    hashed = turns.repartition(4, "callid")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = previous_turn(hashed, {"even": F.col("seq_id") % 2 == 0})
        sizes = partition_sizes(marked)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == n and len(sizes) > 1 and max(sizes) < n / 2
    assert marked.filter("even").count() == n // 2


def test_numbering_with_a_target_reads_its_input_once(spark, tmp_path):
    from callweave.operators.agents import agent_performance, rank_agents

    spark.range(50).selectExpr(
        "id % 7 as owner_id", "id as dun_case_id", "cast(id % 5 as double) as dun_repay_amount",
        "cast(10 as double) as start_owing_amount", "'PRO' as model",
    ).write.parquet(str(tmp_path / "in"))
    performance = agent_performance(spark.read.parquet(str(tmp_path / "in")), "PRO")
    ranked = rank_agents(performance, target=str(tmp_path / "out"))
    assert str(tmp_path / "in") not in ranked._jdf.queryExecution().toString()
    plain = rank_agents(performance)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, plain.collect()))


def test_equal_rates_are_ranked_by_owner_in_runs(spark):
    from callweave.operators.agents import rank_agents

    rows = [(k, 1, [None, 0.0, 0.0, 0.5][k % 4]) for k in range(400)]
    df = spark.createDataFrame(rows, "owner_id long, tot_case_num long, repay_rate double")
    got = {r.owner_id: r.jx_rank for r in rank_agents(df, steps=16).collect()}
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, start=1)}


@pytest.mark.parametrize("query", ["c4_agent_flags", "c6_call_metrics", "c7_call_features"])
def test_conversation_queries_deal_nothing_by_call(spark, query):
    import __spark_entry__ as entry

    df = entry.queries()[query](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" not in df._jdf.queryExecution().toString()
