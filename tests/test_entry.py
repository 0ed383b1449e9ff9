"""Registered queries against their check SQL on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from workload import check

SMALL = "/root/testdata/sf0.001"
#: Values of fitted models: their sums and one-topic forms have SQL. The map is scaled by an
#: eigenvalue problem, its distances have SQL; so has the best path over shorter texts.
NO_SQL = {"l1_fit_topics", "l1_online_topics", "l2_fit_topics_by_agent", "l3_topic_distribution",
          "l4_describe_topics", "l6_topic_map", "l6_model_map", "t1_best_path_documents"}

needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


def test_every_query_has_check_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    own = {name for name in queries if not name.startswith("op") and name != "pipeline"}
    assert own - set(sql) == NO_SQL
    assert set(sql) <= set(queries)


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 54 and df.count() > 0


@needs_data
@pytest.mark.parametrize(
    "name",
    ["c1_build_turns", "c4_agent_flags", "c7_call_features", "j3_asof_allocation",
     "a13_first_self_report", "w4_contact_order", "c9_extract_transcripts",
     "t6_doc_term_counts", "l6_topic_term_relevance"],
)
def test_query_equals_sql(spark, name):
    frame = entry.queries()[name](spark, SMALL).toPandas()
    expected = check.connect(SMALL).execute(entry.oracle_sql()[name]).df()
    assert check.compare(frame, expected) is None
