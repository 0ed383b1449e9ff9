from datetime import date

from pyspark.sql import functions as F

import pytest

from callweave.operators import calls as calls_, metrics
from callweave.sources import rebuild, sinks, tables
from conftest import tuples

ROW = (1, 3, "2024-01-05", "c1", "AGENT", 'He said "no",\nthen left', 20, "self",
       date(2024, 1, 5), "g", "新案", 1, 0)


def sample(spark):
    rows = [ROW, (2, None, *ROW[2:]), (3, 1, *ROW[2:5], None, *ROW[6:])]
    return spark.createDataFrame(rows, tables.AGENT_CALLS)


def test_export_and_read_back(spark, tmp_path):
    path = str(tmp_path / "export")
    sinks.export_by_owner(sample(spark), path)
    assert sorted(f.name for f in (tmp_path / "export").glob("owner_id=*")) == [
        "owner_id=1", "owner_id=2", "owner_id=3"]
    names = tables.AGENT_CALLS.fieldNames()
    back = tables.read_agent_calls(spark, path)
    assert back.schema == tables.AGENT_CALLS
    assert tuples(back, *names) == tuples(sample(spark), *names)
    assert tuples(tables.read_agent_calls(spark, path, [1, 3]), "owner_id") == [(1,), (3,)]
    wanted = spark.createDataFrame([(2,)], "owner_id long")
    assert tuples(tables.read_agent_calls(spark, path, wanted), "owner_id") == [(2,)]


def files_read(df):
    """Files that a plan's scans have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "QueryStageExec" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        metrics_ = node.metrics()
        if metrics_.contains("numFiles"):
            found += metrics_.apply("numFiles").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_owners_of_a_table_choose_the_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "export")
    sinks.export_by_owner(sample(spark), path)
    wanted = spark.createDataFrame([(2,), (2,), (None,), (9,)], "owner_id long")
    got = tables.read_agent_calls(spark, path, wanted)
    assert tuples(got, "owner_id") == [(2,)] and files_read(got) == 1
    assert files_read(tables.read_agent_calls(spark, path)) == 3
    monkeypatch.setattr(tables, "MAX_LISTED", 1)
    assert tuples(tables.read_agent_calls(spark, path, wanted), "owner_id") == [(2,)]
    assert tables.read_agent_calls(spark, path, wanted.filter("false")).collect() == []


def test_days_of_the_calls_choose_the_folders(spark, tmp_path):
    rows = [(u, 1, u % 3, date(2024, 1, d)) for u in range(6) for d in range(1, 21)]
    whole = spark.createDataFrame(rows, "user_id int, phone int, order_id int, dt date")
    whole.write.partitionBy("dt").parquet(str(tmp_path / "directory"))
    directory = spark.read.parquet(str(tmp_path / "directory"))
    called = [(k, 1, f"2024-01-0{1 + k % 3} 10:00:00") for k in range(6)] + [(0, 1, None)]
    calls = spark.createDataFrame(called, "user_id int, phone int, ringtime string").withColumn(
        "ringtime", F.col("ringtime").cast("timestamp")
    )
    plain = calls_.attach_relation(calls, directory)
    pruned = calls_.attach_relation(calls, directory, by_day=True)
    assert tuples(pruned, *plain.columns) == tuples(plain, *plain.columns)
    in_directory = len(list((tmp_path / "directory").glob("dt=*/*.parquet")))
    assert files_read(plain) >= in_directory
    assert files_read(pruned) <= len(list((tmp_path / "directory").glob("dt=2024-01-0[123]/*.parquet")))
    none = tables.only_days(directory, "dt", calls.filter("false"), F.to_date("ringtime"))
    assert none.collect() == [] and tables.only_days(directory, "dt", calls, F.to_date("ringtime"), 1) is directory


def test_bucketed_tables_join_without_exchange(spark):
    turns = spark.range(4000).select(
        (F.col("id") % 97).cast("string").alias("callid"), (F.col("id") % 7).alias("seq_id"),
        F.lit("x").alias("content"),
    )
    calls = spark.range(97).select(F.col("id").cast("string").alias("callid"), (F.col("id") % 5).alias("owner_id"))
    one = sinks.materialize(turns, "bucketed_turns", key="callid", buckets=8)
    two = sinks.materialize(calls, "bucketed_calls", key="callid", buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = one.groupBy("callid").agg(F.count("*").alias("n")).join(two, "callid", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        rows = joined.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    assert len(rows) == 97 and sum(r.n for r in rows) == 4000 and all(r.owner_id == int(r.callid) % 5 for r in rows)
    # A hot call: the table is read as plain files, which adaptive execution may split.
    hot = turns.withColumn("callid", F.when(F.col("seq_id") > 1, "hot").otherwise(F.col("callid"))).union(
        spark.range(20000).select(F.lit("hot").alias("callid"), "id", F.lit("y"))
    )
    plain = sinks.materialize(hot, "bucketed_hot", key="callid", buckets=32)
    assert plain.count() == 24000
    assert "Exchange" in plain.groupBy("callid").count()._jdf.queryExecution().executedPlan().toString()
    for name in ("bucketed_turns", "bucketed_calls", "bucketed_hot"):
        spark.sql(f"drop table {name}")


def test_only_changed_dates_are_rebuilt(spark, tmp_path):
    target = str(tmp_path / "table")

    def source(*rows):
        return spark.createDataFrame(list(rows), "file_date string, callid int, x string")

    def build(df):
        return df.groupBy("file_date", "callid").agg(F.count("*").alias("n"), F.max("x").alias("x"))

    first = source(("2024-01-01", 1, "a"), ("2024-01-01", 1, "b"), ("2024-01-02", 2, "c"), (None, 3, "d"), ("x/y", 4, "e"))
    names = ["file_date", "callid", "n", "x"]
    got = rebuild.rebuild_dates(first, build, target, "file_date")
    assert tuples(got, *names) == tuples(build(first), *names)
    folders = {r.date: r.folder for r in rebuild.manifest(spark, target).collect()}
    runs = len(list((tmp_path / "table" / "runs").iterdir()))
    again = rebuild.rebuild_dates(first, build, target, "file_date")  # nothing to do
    assert len(list((tmp_path / "table" / "runs").iterdir())) == runs and again.count() == 4
    # One date changes, one is new, one is gone.
    second = source(("2024-01-01", 1, "a"), ("2024-01-01", 1, "z"), ("2024-01-03", 5, "f"), (None, 3, "d"), ("x/y", 4, "e"))
    got = rebuild.rebuild_dates(second, build, target, "file_date")
    assert tuples(got, *names) == tuples(build(second), *names)
    now = {r.date: r.folder for r in rebuild.manifest(spark, target).collect()}
    assert set(now) == {"2024-01-01", "2024-01-03", None, "x/y"}
    assert now[None] == folders[None] and now["x/y"] == folders["x/y"] and now["2024-01-01"] != folders["2024-01-01"]
    newest = max((tmp_path / "table" / "runs").iterdir(), key=lambda f: f.stat().st_mtime)
    assert len(list(newest.glob("__part=*"))) == 2
    # A run that fails, and a manifest that was not finished, change nothing.
    def broken(df):
        return build(df).withColumn("n", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception):
        rebuild.rebuild_dates(first, broken, target, "file_date").collect()
    (tmp_path / "table" / "manifest-000000099").mkdir()
    assert tuples(rebuild.read_dates(spark, target), *names) == tuples(build(second), *names)
    gone = rebuild.rebuild_dates(second.filter("false"), build, target, "file_date")
    assert gone.collect() == [] and gone.columns == names


def test_export_bounds_the_rows_of_a_file(spark, tmp_path):
    path = tmp_path / "export"
    many = spark.range(100).select(F.lit(1).alias("owner_id"), "id")
    sinks.export_by_owner(many, str(path), rows_per_file=30)
    assert len(list(path.glob("owner_id=1/*.csv"))) >= 4


def test_flat_files_with_header(spark, tmp_path):
    names = tables.AGENT_CALLS.fieldNames()
    (tmp_path / "7.csv").write_text(
        ",".join(names) + "\n7,,2024-01-05,c9,AGENT,hi,12,others,2024-01-04,g,老案,2,1\n",
        encoding="utf8")
    assert tuples(tables.read_agent_calls(spark, str(tmp_path)), "owner_id", "callid", "jx_rank") == [
        (7, "c9", None)]


def test_words_and_documents(spark, tmp_path):
    (tmp_path / "stop.txt").write_text(" the \nof\n", encoding="utf8")
    assert tuples(tables.read_words(spark, str(tmp_path / "stop.txt")), "word") == [("of",), ("the",)]
    assert tuples(tables.docs_from_list(spark, ["x", "y"]), "doc_id", "text") == [(1, "x"), (2, "y")]


def test_materialize(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        assert sinks.materialize(df, str(tmp_path / "t")).count() == 3
        assert sinks.materialize(df, "callweave_numbers", stats=True).count() == 3
    assert tables.read_table(spark, None, "callweave_numbers").count() == 3
    stats = spark.sql("describe extended callweave_numbers id").collect()
    assert ("max", "2") in [(r.info_name, r.info_value) for r in stats]
    spark.sql("drop table callweave_numbers")


def test_reports(spark, tmp_path):
    df = spark.range(5)
    sinks.write_report(df, str(tmp_path / "r"), single_file=True)
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    sinks.write_report(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_shared_folder(spark, monkeypatch):
    from callweave import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Session.conf = Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y"})
    assert session.shared_dir(Session()) == "hdfs://x/y"
    with session.scratch(spark, "tried") as folder:
        spark.range(3).write.parquet(folder)
        assert spark.read.parquet(folder).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(folder)
