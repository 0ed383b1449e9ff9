"""Registered queries: operators over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from callweave.functions import columns as c, predicates as p, segmentation, text as t
from callweave.functions.rules import Rule, Trigger, occurs, trigger_hit
from callweave.functions.rules_zh import (
    AGENT_RULES, AGENT_SEQUENCE, SHOWN_ONLY_WITH, SPOKEN_WORDS, TIME_ASKED, USER_RULES,
    USER_SEQUENCE,
)
from callweave.operators import (
    agents, calls, flags, group_topics, lifecycle, metrics, quality, reports, rollup, topics,
    turns, vocabulary, windows,
)
from callweave.plans.calls import Era, build_calls
from callweave.plans.features import features_from_turns
from callweave.plans.topics import agent_topics
from callweave.session import shared_dir
from callweave.sources import rebuild, sinks, tables
from workload import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODEL_LIKE = "PRO"
ROUND = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles: sums of doubles depend on their order in the last digits."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({n: F.round(n, ROUND) for n in doubles})


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder: computed once, read as often as needed."""
    return sinks.materialize(df, new_folder(df.sparkSession, name))


def conversation_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The turn table and the enriched call table, both stored."""
    all_turns = stored(b.turns(spark, sf), "turns")
    plus = stored(enriched_calls(spark, sf, all_turns), "calls-plus")
    return all_turns, plus


def call_table(spark: SparkSession, sf: str, all_turns: DataFrame) -> DataFrame:
    """Calls of both record systems."""
    window = Era(b.SINCE, b.BEFORE)
    return build_calls(
        all_turns, b.call_records(spark, sf), b.sip_records(spark, sf),
        b.extensions(spark, sf), b.roster(spark, sf), b.allocations(spark, sf),
        b.CUTOFF, window, window, b.BEFORE, "group",
    )


def enriched_calls(spark: SparkSession, sf: str, all_turns: DataFrame) -> DataFrame:
    known = stored(call_table(spark, sf, all_turns), "calls")
    return calls.enrich_calls(known, b.directory(spark, sf))


def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table over the event calls, stored."""
    return stored(b.event_features(spark, sf), "features")


# --- scans and sinks ---------------------------------------------------------


@query
def s1_read_table(spark, sf):
    return tables.read_table(spark, sf, "events").select("event_id", "user_id", "event_type")


@query
def s2_read_agent_calls(spark, sf):
    path = new_folder(spark, "agent-calls")
    sinks.export_by_owner(_transcripts(spark, sf), path)
    return tables.read_agent_calls(spark, path, owners=[1, 3, 5, 7])


@query
def s2_owners_of_a_table(spark, sf):
    """The agents come from a table; their folders are chosen before the scan."""
    path = new_folder(spark, "agent-calls")
    sinks.export_by_owner(_transcripts(spark, sf), path)
    owners = tables.read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("owner_id")
    ).filter("owner_id < 8 and owner_id % 2 = 1")
    return tables.read_agent_calls(spark, path, owners=owners)


@query
def s3_read_words(spark, sf):
    path = new_folder(spark, "words")
    names = tables.read_table(spark, sf, "part").select(
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("value")
    )
    names.write.text(path)
    return tables.read_words(spark, path)


@query
def s5_materialize(spark, sf):
    return sinks.materialize(b.event_calls_allocated(spark, sf), new_folder(spark, "calls"))


@query
def s5_bucketed_metrics(spark, sf):
    """Call metrics over bucketed tables: joined and grouped by call without an exchange."""
    run = uuid.uuid4().hex
    kept = [
        sinks.materialize(df, f"{name}_{run}", key="callid", buckets=16)
        for name, df in zip(("turns", "calls_plus"), conversation_tables(spark, sf))
    ]
    result = stored(metrics.call_metrics(*kept), "metrics")
    for name in ("turns", "calls_plus"):
        spark.sql(f"drop table {name}_{run}")
    return rounded(result)


@query
def s5_changed_dates(spark, sf):
    """Calls per date and agent, built once without the calls of every third date's odd
    agents, then brought up to date: only those dates are written again."""
    target = new_folder(spark, "by-date")
    whole = b.event_calls(spark, sf).select("file_date", "owner_id", "duration")

    def per_agent(df):
        return df.groupBy("file_date", "owner_id").agg(
            F.count("*").alias("n_calls"), F.sum("duration").alias("seconds")
        )

    late = (F.dayofmonth(F.to_date("file_date")) % 3 == 0) & (F.col("owner_id") % 2 == 1)
    rebuild.rebuild_dates(whole.filter(~late), per_agent, target, "file_date")
    return rebuild.rebuild_dates(whole, per_agent, target, "file_date")


@query
def s6_export_by_owner(spark, sf):
    path = new_folder(spark, "export")
    sinks.export_by_owner(_transcripts(spark, sf), path)
    return tables.read_agent_calls(spark, path)


@query
def s7_write_report(spark, sf):
    path = new_folder(spark, "report")
    report = rounded(agents.agent_performance(b.performance(spark, sf), MODEL_LIKE))
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


# --- projections and predicates ----------------------------------------------


@query
def p1_projection(spark, sf):
    return b.event_features(spark, sf).select(*metrics.FEATURE_HEAD).withColumnRenamed(
        "dt", "call_date"
    )


@query
def p2_in_month(spark, sf):
    return p.in_month(b.event_calls(spark, sf), "file_date", "2024-01").select("callid", "file_date")


@query
def p3_in_window(spark, sf):
    inside = p.in_window(b.allocations(spark, sf), "time_mark", "2024-01-08", "2024-01-20")
    return inside.select("dun_case_id", "time_mark")


@query
def p4_number_between(spark, sf):
    return p.number_between(b.allocations(spark, sf), "overdue_max_days", 31, 60)


@query
def p5_text_contains(spark, sf):
    return p.text_contains(tables.read_table(spark, sf, "part"), "p_type", MODEL_LIKE).select(
        "p_partkey", "p_type"
    )


@query
def p6_not_null(spark, sf):
    records = b.sip_records(spark, sf).withColumn("case", F.col("ud_2").try_cast("int"))
    return p.not_null(records, "case").select("calluuid", "case")


@query
def p7_split_era(spark, sf):
    early, late = p.split_era(b.event_calls(spark, sf), "2024-01-31")
    first, second = p.split_era(early, b.CUTOFF)
    return (
        first.select("callid", F.lit("early").alias("era"))
        .unionByName(second.select("callid", F.lit("late").alias("era")))
        .unionByName(late.select("callid", F.lit("beyond").alias("era")))
    )


@query
def p8_by_channel(spark, sf):
    return p.by_channel(b.turns(spark, sf), c.USER).select("callid", "seq_id")


@query
def p9_not_self_min_duration(spark, sf):
    return p.not_self_min_duration(b.event_calls_plus(spark, sf), 10).select(
        "callid", "phone_type", "duration"
    )


@query
def p10_min_duration(spark, sf):
    return p.min_duration(b.event_calls(spark, sf), 10).select("callid", "duration")


@query
def p11_first_contact_calls(spark, sf):
    return p.first_contact_calls(b.event_features(spark, sf), b.CUTOFF).select(
        "callid", "dt", "yes_call_num", "day_num"
    )


# --- joins -------------------------------------------------------------------


@query
def j1_attach_speed(spark, sf):
    return rounded(
        turns.attach_speed(
            turns.merge_segments(b.segments(spark, sf)),
            turns.weighted_speed(b.raw_segments(spark, sf)),
        )
    )


@query
def j2_attach_call(spark, sf):
    return calls.attach_call(b.turns(spark, sf), b.call_records(spark, sf))


@query
def j3_asof_allocation(spark, sf):
    return calls.asof_allocation(
        b.event_calls(spark, sf), b.allocations(spark, sf), b.SINCE, b.BEFORE
    )


@query
def j4_resolve_agent(spark, sf):
    return calls.resolve_agent(
        b.sip_records(spark, sf), b.extensions(spark, sf), b.roster(spark, sf),
        b.SINCE, b.BEFORE, "group",
    )


@query
def j5_attach_relation(spark, sf):
    return calls.attach_relation(b.event_calls(spark, sf), b.directory(spark, sf)).select(
        "callid", "order_id"
    )


@query
def j5_relation_by_day(spark, sf):
    """The directory in folders by day, of which only the calls' days are read."""
    path = new_folder(spark, "directory")
    b.directory(spark, sf).write.partitionBy("dt").parquet(path)
    early = b.event_calls(spark, sf).filter(F.col("file_date") < "2024-01-11")
    return calls.attach_relation(early, spark.read.parquet(path), by_day=True).select(
        "callid", "order_id"
    )


@query
def j6_attach_call_attributes(spark, sf):
    return calls.attach_call_attributes(*conversation_tables(spark, sf)).select(
        "callid", "seq_id", "dt", "owner_id", "contact_type"
    )


@query
def j7_after_turn(spark, sf):
    all_turns = b.turns(spark, sf)
    asked = trigger_hit(TIME_ASKED, F.col("content"), F.col("channel"))
    marked = flags.after_turn(all_turns, asked, "asked_before")
    return marked.filter("asked_before").select("callid", "seq_id", "channel")


@query
def j8_merge_call_flags(spark, sf):
    all_turns, plus = conversation_tables(spark, sf)
    agent = rollup.rollup_flags(
        flags.agent_flags(all_turns, plus), ["mention_address", "is_knowing"]
    )
    user = rollup.rollup_flags(flags.user_flags(all_turns, plus), ["is_helping", "is_detail"])
    return rollup.merge_call_flags(agent, user)


@query
def j10_from_first_contact(spark, sf):
    features = stored_features(spark, sf)
    early = features.filter(F.col("dt") <= b.CUTOFF)
    return lifecycle.from_first_contact(early, lifecycle.case_base(features, b.CUTOFF)).select(
        "callid", "dun_case_id", "ringtime"
    )


@query
def j11_only_unique(spark, sf):
    return windows.only_unique(b.call_records(spark, sf), "calluuid").select(
        "calluuid", "user_id", "owner_id"
    )


@query
def j13_calls_with_rank(spark, sf):
    ranks = agents.rank_agents(agents.agent_performance(b.performance(spark, sf), MODEL_LIKE))
    return agents.calls_with_rank(b.event_calls(spark, sf), ranks).select(
        "callid", "owner_id", "jx_rank"
    )


@query
def j14_only_agents(spark, sf):
    best = agents.top_bottom(agents.agent_performance(b.performance(spark, sf), MODEL_LIKE))
    return agents.only_agents(b.performance(spark, sf), best).select("owner_id", "dun_case_id")


# --- aggregations ------------------------------------------------------------


@query
def a1_merge_segments(spark, sf):
    return turns.merge_segments(b.segments(spark, sf))


@query
def a2_call_text(spark, sf):
    return turns.call_text(b.turns(spark, sf), b.MONTH)


@query
def a3_call_text_all(spark, sf):
    all_turns = stored(b.turns(spark, sf), "turns")
    return turns.call_text_all(all_turns, call_table(spark, sf, all_turns), b.MONTH)


@query
def a4_weighted_speed(spark, sf):
    return rounded(turns.weighted_speed(b.raw_segments(spark, sf)))


@query
def a5_closest_relation(spark, sf):
    return calls.closest_relation(b.directory(spark, sf))


@query
def a6_case_base(spark, sf):
    return lifecycle.case_base(b.event_features(spark, sf), b.CUTOFF)


@query
def a7_rollup_flags(spark, sf):
    return rollup.rollup_flags(
        flags.user_flags(*conversation_tables(spark, sf)),
        [r.name for r in USER_RULES],
    )


@query
def a8_blank_unless(spark, sf):
    features = b.event_features(spark, sf)
    return rollup.blank_unless(features, SHOWN_ONLY_WITH).select("callid", *SHOWN_ONLY_WITH)


@query
def a11_agent_performance(spark, sf):
    return rounded(agents.agent_performance(b.performance(spark, sf), MODEL_LIKE))


@query
def a12_lifecycle_histogram(spark, sf):
    return lifecycle.lifecycle_histogram(stored_features(spark, sf), b.CUTOFF, "2024-01-28")


@query
def a12_lifecycle_histogram_self(spark, sf):
    return lifecycle.lifecycle_histogram_self(
        stored_features(spark, sf), b.CUTOFF, "2024-01-28"
    )


@query
def a13_first_contact_report(spark, sf):
    base = lifecycle.lifecycle_base(stored_features(spark, sf), b.CUTOFF, first_only=True)
    return rounded(reports.first_contact_report(base))


@query
def a13_first_self_report(spark, sf):
    base = lifecycle.lifecycle_base(stored_features(spark, sf), b.CUTOFF)
    return rounded(reports.first_self_report(base, min_rows=5))


@query
def a13_all_self_report(spark, sf):
    base = lifecycle.lifecycle_base(stored_features(spark, sf), b.CUTOFF)
    return rounded(reports.all_self_report(base, min_rows=5))


@query
def a14_documents_per_agent(spark, sf):
    documents = tables.read_table(spark, sf, "documents")
    return documents.groupBy(F.col("source").alias("owner_id")).agg(F.count("*").alias("num"))


# --- windows, top-k, set operations ------------------------------------------


@query
def w1_number_turns(spark, sf):
    merged = turns.merge_segments(b.segments(spark, sf)).withColumn(
        "file_date", F.lit(None).cast("string")
    )
    return turns.number_turns(merged, target=new_folder(spark, "numbered")).select("new_name", "callid", "channel", "seq_id")


@query
def w2_latest_per_call(spark, sf):
    return b.event_calls_allocated(spark, sf)


@query
def w3_call_ordinal(spark, sf):
    return calls.call_ordinal(b.event_calls_allocated(spark, sf)).select(
        "callid", "user_id", "time_mark", "yes_call_num"
    )


@query
def w3_balanced_ordinal(spark, sf):
    """The same numbers from ranges of equal numbers of rows."""
    calls_ = stored(b.event_calls_allocated(spark, sf), "allocated")
    return calls.call_ordinal(calls_, target=f"{new_folder(spark, 'ordinal')}/rows").select(
        "callid", "user_id", "time_mark", "yes_call_num"
    )


@query
def w4_balanced_order(spark, sf):
    """Contact order by ranges of equal numbers of rows."""
    base = lifecycle.lifecycle_base(stored_features(spark, sf), b.CUTOFF).drop("order_num")
    ordered = lifecycle.contact_order(stored(base, "base"), f"{new_folder(spark, 'order')}/rows")
    return ordered.select("callid", "new_contact_type", "order_num")


@query
def w4_contact_order(spark, sf):
    return lifecycle.lifecycle_base(stored_features(spark, sf), b.CUTOFF).select(
        "callid", "new_contact_type", "order_num"
    )


@query
def w5_rank_agents(spark, sf):
    performance = agents.agent_performance(b.performance(spark, sf), MODEL_LIKE)
    return rounded(agents.rank_agents(performance, target=new_folder(spark, "agents")))


@query
def k1_top_bottom(spark, sf):
    return rounded(
        agents.top_bottom(agents.agent_performance(b.performance(spark, sf), MODEL_LIKE))
    )


@query
def k2_sorted_extract(spark, sf):
    all_turns = stored(b.turns(spark, sf), "turns")
    return turns.call_text_all(all_turns, call_table(spark, sf, all_turns)).orderBy(
        "owner_id", "file_date", "callid", "channel"
    )


@query
def k3_top_words(spark, sf):
    """Top words per language, counts standing in for topic weights."""
    weights = _language_weights(spark, sf)
    return topics.top_words(weights, 10).select("topic", "term", "weight", "rank")


@query
def k4_first_agent(spark, sf):
    return agents.first_agent(b.event_calls(spark, sf)).select("owner_id", "callid")


@query
def u1_union_eras(spark, sf):
    early, late = p.split_era(b.event_calls_allocated(spark, sf), "2024-01-20")
    _, again = p.split_era(b.event_calls_allocated(spark, sf), b.CUTOFF)
    return calls.union_eras(early.select(*calls.CALL_COLUMNS), again.select(*calls.CALL_COLUMNS))


@query
def u2_complete_calls(spark, sf):
    return rounded(lifecycle.complete_calls(stored_features(spark, sf), b.CUTOFF, distinct=True))


@query
def u3_append(spark, sf):
    first = agents.first_agent(b.event_calls(spark, sf)).select("owner_id", "callid")
    return first.unionByName(b.event_calls(spark, sf).select("callid", "owner_id"))


# --- scalar functions --------------------------------------------------------


@query
def f_scalars(spark, sf):
    """Every scalar function over the conversation lines."""
    rows = b.segments(spark, sf)
    return rows.select(
        "new_name",
        "seg_no",
        c.name_part(F.col("new_name")).alias("turn_number"),
        c.name_part(F.col("rt_text"), 1).alias("no_number"),
        c.byte_length(F.col("rt_text")).alias("bytes"),
        c.sentence_length(F.col("rt_text")).alias("chars_of_three"),
        c.sentence_length(F.col("rt_text"), None).alias("chars"),
        F.substring("rt_text", 1, 7).alias("head"),
        F.col("rt_text").contains("电话").alias("has_phone"),
        F.col("rt_text").rlike("[0-9]|你").alias("has_you"),
        t.without_punctuation(F.col("rt_text")).alias("bare"),
    )


@query
def f_case_columns(spark, sf):
    """Relation, case age, contact class, dates and percentages over the calls."""
    plus = b.event_calls_plus(spark, sf)
    return plus.select(
        "callid",
        c.relation_class(F.col("owner_id")).alias("relation"),
        c.case_age(F.col("time_mark"), F.col("ringtime")).alias("age"),
        c.contact_class(F.col("phone_type")).alias("contact"),
        F.month("ringtime").alias("ring_month"),
        F.date_diff(F.to_date("ringtime"), F.col("time_mark")).alias("days"),
        c.percent_text(F.col("duration") / 128.0).alias("percent"),
        c.flag_number(F.when(F.col("duration") > 50, "true").when(F.col("duration") > 20, "false"))
        .alias("long_call"),
    )


@query
def f13_topic_bin(spark, sf):
    return _probabilities(spark, sf).select(
        "doc_id", "topic0_prob", c.topic_bin(F.col("topic0_prob")).alias("belong")
    )


@query
def f15_agent_sequences(spark, sf):
    tagged = flags.agent_flags(*conversation_tables(spark, sf))
    return flags.flag_sequences(tagged, AGENT_SEQUENCE, "jingban_pattern")


@query
def f15_user_sequences(spark, sf):
    tagged = flags.user_flags(*conversation_tables(spark, sf))
    return flags.flag_sequences(tagged, USER_SEQUENCE, "yonghu_pattern")


# --- rules -------------------------------------------------------------------

#: A small Latin rule table: one rule of each shape.
LATIN_RULES = (
    Rule("has_article", "A", any_of=("(^|[ ,.])(the|les?|der|die|das|el|los)([ ,.]|$)",)),
    Rule(
        "scored", "B",
        cues=(("0.1", "tion"), ("0.2", "en"), ("0.1", "qu"), ("0.3", "sch")),
        gate="[aeiou]r", above="0.3", speaker=c.AGENT,
    ),
    Rule("two_sided", all_of=("and|und|et", "[.].*[.]")),
    Rule(
        "echo", "D", any_of=("on", "er"),
        after=Trigger("asked_long", c.USER, (".{80,}",)),
    ),
)


@query
def r0_tag_turns(spark, sf):
    tagged = flags.tag_turns(b.turns(spark, sf), LATIN_RULES)
    return tagged.select("callid", "seq_id", *[r.name for r in LATIN_RULES])


@query
def r0_rule_counts(spark, sf):
    """How many turns carry each of the 34 flags."""
    all_turns, plus = conversation_tables(spark, sf)
    agent = flags.agent_flags(all_turns, plus)
    user = flags.user_flags(all_turns, plus)

    def counted(df, rules):
        pairs = F.explode(
            F.array(*[F.struct(F.lit(r.name).alias("flag"), F.col(r.name).alias("value")) for r in rules])
        ).alias("p")
        return df.select(pairs).groupBy("p.flag", "p.value").agg(F.count("*").alias("num"))

    return counted(agent, AGENT_RULES).unionByName(counted(user, USER_RULES)).select(
        "flag", F.coalesce("value", F.lit("none")).alias("value"), "num"
    )


#: Patterns outside the Mandarin set, in the syntax that both engines share.
OTHER_PATTERNS = (
    "(?i)THE|and", "(?i)quoi|NON", "tion\\.*", "en.*|an\\.*", "(?:un|in)[a-z]+ed", "a{2,3}",
    "[^a-z ]{3}", "(re|de)(en|an)", "^[A-Z][a-z]+ ", "[.]$", "(?s)on.*er.*[.]", "x|",
    "e(?:r|s)+ ", "[a-c][d-f]|[x-z]", "th(?:at|is|e)", "\\d+|[é-ü]+n", "(?:sch|ung)+", "\\.\\.",
)


@query
def r0_other_patterns(spark, sf):
    turns_ = tables.read_table(spark, sf, "conversations")
    found = {f"p{i}": occurs(F.col("text"), p) for i, p in enumerate(OTHER_PATTERNS)}
    pair = {"any_of": occurs(F.col("text"), *OTHER_PATTERNS[1:4])}
    return turns_.withColumns({**found, **pair}).drop("text", "role")


# --- composed chains ---------------------------------------------------------


def _transcripts(spark, sf):
    all_turns, plus = conversation_tables(spark, sf)
    return agents.extract_transcripts(
        all_turns, plus, b.performance(spark, sf), b.MONTH, MODEL_LIKE
    )


@query
def c1_build_turns(spark, sf):
    return rounded(b.turns(spark, sf, new_folder(spark, "numbered")))


@query
def c2_build_calls(spark, sf):
    return call_table(spark, sf, stored(b.turns(spark, sf), "turns"))


@query
def c3_enrich_calls(spark, sf):
    return enriched_calls(spark, sf, stored(b.turns(spark, sf), "turns"))


@query
def c3_enrich_event_calls(spark, sf):
    return b.event_calls_plus(spark, sf)


@query
def c4_agent_flags(spark, sf):
    return rounded(flags.agent_flags(*conversation_tables(spark, sf)))


@query
def c4_user_flags(spark, sf):
    return rounded(flags.user_flags(*conversation_tables(spark, sf)))


@query
def c5_call_flags(spark, sf):
    all_turns, plus = conversation_tables(spark, sf)
    return rollup.call_flags(
        flags.agent_flags(all_turns, plus), flags.user_flags(all_turns, plus)
    )


@query
def c6_call_metrics(spark, sf):
    return rounded(metrics.call_metrics(*conversation_tables(spark, sf)))


@query
def c7_call_features(spark, sf):
    """Features by the fused plan: one pass over the turns."""
    return rounded(features_from_turns(*conversation_tables(spark, sf)))


@query
def c7_call_features_stepwise(spark, sf):
    """Features from separately built metrics and flags."""
    all_turns, plus = conversation_tables(spark, sf)
    call_flags = rollup.call_flags(
        flags.agent_flags(all_turns, plus), flags.user_flags(all_turns, plus)
    )
    return rounded(metrics.call_features(metrics.call_metrics(all_turns, plus), call_flags))


@query
def c8_lifecycle_base(spark, sf):
    return rounded(lifecycle.lifecycle_base(stored_features(spark, sf), b.CUTOFF))


@query
def c9_extract_transcripts(spark, sf):
    return _transcripts(spark, sf)


@query
def c10_duplicate_keys(spark, sf):
    return quality.duplicate_keys(b.call_records(spark, sf), ["calluuid"])


@query
def c10_duplicate_directory(spark, sf):
    return quality.duplicate_keys(b.directory(spark, sf), ["user_id", "phone", "dt"])


@query
def c10_unmatched(spark, sf):
    return quality.unmatched(
        b.event_calls(spark, sf), b.event_calls_allocated(spark, sf), ["callid", "user_id"]
    ).select("callid", "user_id")


# --- text --------------------------------------------------------------------

STOPWORDS = ("the", "of", "and", "de", "la", "le", "un", "und", "die", "der", "el", "en")
LEMMAS = {"an": "a", "les": "le", "reds": "red"}


@query
def t1_tokenize(spark, sf):
    cut = t.tokenize(b.turns(spark, sf), "content", [*SPOKEN_WORDS, "征信", "紧急联系人"])
    return cut.select(
        "callid", "seq_id", F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", " ").alias("cut_words"),
    )


@query
def t1_tokenize_documents(spark, sf):
    cut = t.tokenize(b.documents(spark, sf), "text", SPOKEN_WORDS)
    return cut.select("doc_id", F.size("tokens").alias("n_tokens"))


#: A forced word that no lexicon has: it cuts across the ends of words.
FORCED_WORD = "coldg"


def _lexicon(spark, sf):
    """Short words of the documents that are frequent."""
    words = tables.read_table(spark, sf, "documents").select(
        F.explode(F.split(F.lower("text"), " ")).alias("word")
    )
    return (
        words.filter("length(word) between 2 and 4 and word rlike '^[a-z]+$'")
        .groupBy("word").count().filter("count >= 20").select("word")
    )


@query
def t1_tokenize_lexicon(spark, sf):
    """Greedy longest match with a word table."""
    texts = b.documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    cut = t.tokenize(texts, "text", ["oredthe"], dictionary=_lexicon(spark, sf))
    return cut.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("cut_words")
    )


@query
def t1_best_path(spark, sf):
    """Part names without their spaces, cut by the counts of words and of parts of words."""
    names = tables.read_table(spark, sf, "part").select(
        "p_partkey", F.regexp_replace("p_name", " ", "").alias("text"), "p_name"
    )
    whole = names.select(F.explode(F.split("p_name", " ")).alias("word"))
    forms = F.array(F.col("word"), F.substring("word", 1, 3), F.expr("right(word, 4)"))
    lexicon = (
        whole.select(F.explode(forms).alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    )
    cut = segmentation.segment(names.drop("p_name"), "text", lexicon, [FORCED_WORD])
    return cut.select(
        "p_partkey", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("cut_words")
    )


@query
def t1_best_path_documents(spark, sf):
    """Documents by the counts of their own frequent words; the words of a text without
    spaces are found again."""
    texts = b.documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    lexicon = words.groupBy("word").agg(F.count("*").alias("total")).filter("total >= 20")
    cut = segmentation.segment(texts, "text", lexicon)
    return cut.select("doc_id", F.size("tokens").alias("n_tokens"))


@query
def t2_clean_english(spark, sf):
    cleaned = t.clean_english(
        b.documents(spark, sf).filter(F.col("lang") == "en"),
        "text", STOPWORDS, LEMMAS,
    )
    return cleaned.select("doc_id", F.array_join("tokens", " ").alias("clean"))


@query
def t2_lemmatize(spark, sf):
    """Base forms from a table: plural part names to their singular."""
    names = tables.read_table(spark, sf, "part").select(
        "p_partkey", F.explode(F.split("p_name", " ")).alias("term")
    )
    forms = names.select(
        F.col("term").alias("form"), F.regexp_replace("term", "(er|et|ng)$", "").alias("lemma")
    ).filter(F.col("form") != F.col("lemma"))
    return t.lemmatize(names, forms).groupBy("term").agg(F.count("*").alias("num"))


@query
def t3_remove_stopwords(spark, sf):
    documents = b.documents(spark, sf)
    kept = t.remove_stopwords(F.split(F.lower("text"), " "), STOPWORDS)
    return documents.select("doc_id", F.array_join(kept, " ").alias("kept"))


@query
def t4_strip_accents(spark, sf):
    return b.documents(spark, sf).select(
        "doc_id", t.strip_accents(F.col("text")).alias("plain")
    )


@query
def t4_strip_accents_full(spark, sf):
    return b.documents(spark, sf).select(
        "doc_id", t.strip_accents_full(F.col("text")).alias("plain")
    )


#: Characters that become several, or that lie outside the alphabets, and their bases.
DECOMPOSED = (("①", "1"), ("ﬁ", "fi"), ("½", "1⁄2"), ("㎡", "m2"), ("豈", "豈"), ("ｶﾞ", "カ"), ("é̂", "e"), ("𝔘", "U"))


@query
def t4_other_characters(spark, sf):
    marks = F.array(*[F.lit(char) for char, _ in DECOMPOSED])
    pick = (F.col("p_partkey") % len(DECOMPOSED) + 1).cast("int")
    texts = tables.read_table(spark, sf, "part").withColumn(
        "text", F.concat("p_name", F.element_at(marks, pick), F.lit(" É"))
    )
    return texts.select("p_partkey", t.strip_accents(F.col("text")).alias("plain"))


def _terms(spark, sf):
    documents = b.documents(spark, sf).withColumnRenamed("source", "owner_id")
    return vocabulary.term_rows(
        documents, ["owner_id", "lang", "doc_id"], t.matrix_terms(F.col("text")), STOPWORDS
    )


@query
def t5_vocabulary(spark, sf):
    return vocabulary.vocabulary(_terms(spark, sf), 1000)


@query
def t5_vocabulary_by_agent(spark, sf):
    return vocabulary.vocabulary_by(_terms(spark, sf), "owner_id", 1000)


@query
def t5_frequent_terms(spark, sf):
    """The vocabulary from summaries of the tasks, then exact counts of what may be in it."""
    documents = b.documents(spark, sf)
    return vocabulary.frequent_terms(
        documents, t.matrix_terms(F.col("text")), 200, STOPWORDS, size=1024
    )


@query
def t6_doc_term_counts(spark, sf):
    return vocabulary.term_matrix(_terms(spark, sf), ["doc_id"], 1000)


@query
def t6_doc_term_counts_by_agent(spark, sf):
    return vocabulary.term_matrix(
        _terms(spark, sf), ["owner_id", "doc_id"], 1000, group="owner_id"
    )


# --- topics ------------------------------------------------------------------


def _probabilities(spark, sf):
    """Documents with a topic probability derived from their length."""
    return b.documents(spark, sf).select(
        "doc_id",
        F.col("source").alias("owner_id"),
        F.when(F.col("n_chars") % 19 != 0, F.col("n_chars") % 101 / 100.0).alias("topic0_prob"),
    )


def _language_weights(spark, sf):
    """Term weights with languages as topics."""
    return (
        _terms(spark, sf)
        .groupBy(F.col("lang").alias("topic"), "term")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def _lengths(spark, sf):
    """Terms of every document that has any, counted where its text is read."""
    listed = t.remove_stopwords(t.matrix_terms(F.col("text")), STOPWORDS)
    counted = b.documents(spark, sf).select("doc_id", F.size(listed).cast("long").alias("length"))
    return counted.filter("length > 0").groupBy("doc_id").agg(F.sum("length").alias("length"))


def _documents(spark, sf):
    return b.documents(spark, sf).select(F.col("source").alias("owner_id"), "doc_id")


def _text_terms(spark, sf):
    """The terms of every document as one array."""
    listed = t.remove_stopwords(t.matrix_terms(F.col("text")), STOPWORDS)
    return b.documents(spark, sf).select(F.col("source").alias("owner_id"), "doc_id", listed.alias("terms"))


def _corpus_model(spark, sf, k, **options):
    return group_topics.fit_topics(
        _text_terms(spark, sf), "doc_id", k, documents=_documents(spark, sf), **options
    )


def _agent_models(spark, sf):
    return group_topics.fit_topics_by_group(
        _text_terms(spark, sf), "owner_id", "doc_id", k=2, documents=_documents(spark, sf)
    )


def _weight_sums(topics_: DataFrame, *group: str) -> DataFrame:
    """Terms and weights: with the prior 1/k a model's weights add up to the size of its
    vocabulary plus the occurrences of its terms."""
    return topics_.groupBy(*group).agg(
        F.count("*").alias("n_weights"), F.round(F.sum("weight"), 3).alias("total_weight")
    )


@query
def l1_fit_topics(spark, sf):
    return _corpus_model(spark, sf, 5).topics.drop(group_topics.CORPUS)


@query
def l1_weight_sums(spark, sf):
    return _weight_sums(_corpus_model(spark, sf, 5).topics)


@query
def l1_one_topic(spark, sf):
    """With one topic a term weighs its occurrences and the prior."""
    fitted = _corpus_model(spark, sf, 1, max_iter=2)
    return fitted.topics.select("topic", "term", F.round("weight", 6).alias("weight"))


@query
def l1_english_topics(spark, sf):
    """Cleaned English documents, three topics, 50 passes."""
    terms, _ = _english_terms(spark, sf)
    return _weight_sums(group_topics.fit_topics(terms, "doc_id", 3, max_iter=50).topics)


def _english_terms(spark, sf):
    english = b.documents(spark, sf).filter(F.col("lang") == "en")
    cleaned = t.clean_english(english, "text", STOPWORDS, LEMMAS)
    return cleaned.select("doc_id", F.col("tokens").alias("terms")), english


@query
def l1_online_topics(spark, sf):
    """The English documents in mini-batches, three topics, ten passes."""
    terms, english = _english_terms(spark, sf)
    fitted = group_topics.fit_topics_online(
        terms, "doc_id", 3, passes=10, batch_docs=1000, documents=english.select("doc_id")
    )
    return fitted.topics.drop(group_topics.CORPUS)


@query
def l1_online_one_topic(spark, sf):
    """One topic, all documents in one batch: after the first step a term weighs its
    occurrences and the prior."""
    terms, english = _english_terms(spark, sf)
    fitted = group_topics.fit_topics_online(
        terms, "doc_id", 1, passes=2, batch_docs=english.count() + 1, offset=0.0,
        documents=english.select("doc_id"),
    )
    return fitted.topics.select("topic", "term", F.round("weight", 6).alias("weight"))


@query
def l1_bound_rises(spark, sf):
    """The bound of the corpus model before every pass but the first is above the last one."""
    bounds = _corpus_model(spark, sf, 3, max_iter=6, tolerance=0.0).bounds
    steps = bounds.groupBy(group_topics.CORPUS).agg(
        F.sort_array(F.collect_list(F.struct("step", "bound"))).alias("s")
    )
    rises = F.zip_with(
        F.slice("s", 2, 5), F.slice("s", 1, 5), lambda now, last: now["bound"] > last["bound"]
    )
    return steps.select(F.size("s").alias("n_steps"), F.forall(rises, lambda r: r).alias("rises"))


@query
def l2_settled_weight_sums(spark, sf):
    """A model per agent, each fitted until its own bound has settled."""
    fitted = group_topics.fit_topics_by_group(
        _text_terms(spark, sf), "owner_id", "doc_id", k=2, documents=_documents(spark, sf),
        max_iter=12, tolerance=2e-3,
    )
    return _weight_sums(fitted.topics, "owner_id")


@query
def l2_fit_topics_by_agent(spark, sf):
    documents = _documents(spark, sf)
    return group_topics.attach_topics(documents, _agent_models(spark, sf), "owner_id", "doc_id")


@query
def l2_weight_sums(spark, sf):
    return _weight_sums(_agent_models(spark, sf).topics, "owner_id")


@query
def l3_topic_distribution(spark, sf):
    return _corpus_model(spark, sf, 2).documents.drop(group_topics.CORPUS)


@query
def l3_probability_sums(spark, sf):
    fitted = _corpus_model(spark, sf, 2)
    return fitted.documents.select(
        "doc_id", F.round(F.col("topic0_prob") + F.col("topic1_prob"), 6).alias("total")
    )


@query
def l4_describe_topics(spark, sf):
    terms = _corpus_model(spark, sf, 3).topics.drop(group_topics.CORPUS)
    return topics.describe_topics(terms, 3).join(
        topics.describe_topics(terms, 10, "words").withColumnRenamed("description", "words"),
        "topic",
    )


@query
def l4_describe_one_topic(spark, sf):
    """The weighted style on a fitted model, whose one topic has known weights."""
    return topics.describe_topics(l1_one_topic(spark, sf), 12)


@query
def l2_topic_plan(spark, sf):
    """Transcripts to topic shares: what every agent's model is made of."""
    transcripts = stored(_transcripts(spark, sf), "transcripts")
    made = agent_topics(transcripts, [*SPOKEN_WORDS, "征信"], stopwords=STOPWORDS)
    calls_ = made.calls.groupBy("owner_id").agg(F.count("*").alias("n_calls"))
    terms = made.terms.groupBy("owner_id").agg(F.count("*").alias("n_terms"))
    known = made.fitted.vocabulary.groupBy("owner_id").agg(F.count("*").alias("n_known"))
    binned = made.shares.groupBy("owner_id").agg(F.sum("num").alias("n_binned"))
    return (
        calls_.join(terms, "owner_id", "left").join(known, "owner_id", "left")
        .join(binned, "owner_id", "left").fillna(0)
    )


@query
def l4_describe_given_topics(spark, sf):
    return topics.describe_topics(_language_weights(spark, sf), 10, "words")


@query
def l5_topic_share(spark, sf):
    return rounded(topics.topic_share(_probabilities(spark, sf)))


@query
def l6_topic_term_relevance(spark, sf):
    """Topic explorer figures with the languages as topics."""
    weights = stored(_language_weights(spark, sf), "weights")
    in_topics = tables.read_table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("topic"), F.lit(1.0).alias("probability")
    )
    sizes = stored(topics.topic_sizes(in_topics, _lengths(spark, sf), "doc_id"), "sizes")
    totals = stored(vocabulary.vocabulary(weights, None, "weight"), "totals")
    totals = totals.withColumn("total", F.col("total").cast("long"))
    return rounded(topics.topic_term_relevance(weights, totals, sizes))


@query
def l6_topic_distances(spark, sf):
    """Divergence of the word distributions of every two languages."""
    found = topics.topic_distances(stored(_language_weights(spark, sf), "weights"))
    return found.withColumn("distance", F.round("distance", 6))


@query
def l6_topic_map(spark, sf):
    """Where the languages stand to each other, and how much of the corpus they are."""
    weights = stored(_language_weights(spark, sf), "weights")
    whole = weights.select(F.sum("weight")).scalar()
    sizes = weights.groupBy("topic").agg((F.sum("weight") / whole).alias("size"))
    return rounded(topics.topic_map(weights, sizes))


@query
def l6_model_map(spark, sf):
    """The explorer's view of a fitted model: a topic's place, size and three heaviest words."""
    k = 5
    fitted = _corpus_model(spark, sf, k)
    listed = F.array(*[
        F.struct(F.lit(i).alias("topic"), F.col(f"topic{i}_prob").alias("probability")) for i in range(k)
    ])
    in_topics = fitted.documents.select("doc_id", F.explode(listed).alias("t")).select("doc_id", "t.*")
    sizes = stored(topics.topic_sizes(in_topics, _lengths(spark, sf), "doc_id"), "sizes")
    weights = fitted.topics.select("topic", "term", "weight")
    words = topics.describe_topics(weights, 3, "words")
    return topics.topic_map(weights, sizes).join(words, "topic")


@query
def l6_model_relevance(spark, sf):
    """Topic explorer figures from a fitted model of one topic, whose weights are known."""
    fitted = _corpus_model(spark, sf, 1, max_iter=2)
    in_topics = fitted.documents.select(
        "doc_id", F.lit(0).alias("topic"), F.col("topic0_prob").alias("probability")
    )
    sizes = stored(topics.topic_sizes(in_topics, _lengths(spark, sf), "doc_id"), "sizes")
    totals = stored(vocabulary.vocabulary(_terms(spark, sf), None), "totals")
    return rounded(
        topics.topic_term_relevance(fitted.topics.select("topic", "term", "weight"), totals, sizes)
    )
