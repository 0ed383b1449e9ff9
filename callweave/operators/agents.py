"""Agent performance and the calls of selected agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callweave.functions.columns import AGENT, percent_text
from callweave.functions.predicates import in_month, text_contains
from callweave.operators.turns import call_text
from callweave.operators.windows import spread_row_number

TRANSCRIPT_COLUMNS = [
    "owner_id", "jx_rank", "file_date", "callid", "channel", "content", "duration",
    "phone_type", "time_mark", "group_name", "is_first_yes_call", "yes_call_num", "day_num",
]


def agent_performance(performance: DataFrame, model_like: str) -> DataFrame:
    """Distinct cases and repayment rate per agent, for models containing a text."""
    return (
        text_contains(performance, "model", model_like)
        .groupBy("owner_id")
        .agg(
            F.count_distinct("dun_case_id").alias("tot_case_num"),
            F.try_divide(F.sum("dun_repay_amount"), F.sum("start_owing_amount")).alias(
                "repay_rate"
            ),
        )
    )


def rank_agents(agents: DataFrame, steps: int = 4096, target: str | None = None) -> DataFrame:
    """Rank agents by repayment rate, best first, and show the rate as text.

    Ties go to the smaller owner number; agents without a rate come last. The
    rate cut into ``steps`` per unit serves as slot, and among agents with rate 0 or
    none the owner number in runs of ``steps``, so the ranking is not one task's work.
    With ``target`` the agents are written there once and computed only once.
    """
    rate = F.col("repay_rate")
    even = F.coalesce(rate == 0, F.lit(True))
    slot = F.struct(
        rate.isNull(), -F.floor(rate * steps), even,
        F.when(even, F.floor(F.col("owner_id") / steps)),
    )
    ranked = spread_row_number(
        agents,
        [],
        [rate.desc_nulls_last(), F.col("owner_id")],
        slot,
        "jx_rank",
        target=target,
    )
    return ranked.select(
        "owner_id", "tot_case_num", "repay_rate",
        percent_text(rate).alias("repay_rate_2"), "jx_rank",
    )


def top_bottom(agents: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best and ``n`` worst agents, best first, each once."""
    rate = F.col("repay_rate")
    best = agents.orderBy(rate.desc_nulls_last(), "owner_id").limit(n)
    worst = agents.orderBy(rate.asc_nulls_last(), F.col("owner_id").desc()).limit(n)
    return best.union(worst).distinct().orderBy(rate.desc_nulls_last(), "owner_id")


def calls_with_rank(calls: DataFrame, ranks: DataFrame) -> DataFrame:
    """Calls with the rank of their agent, NULL for agents without one."""
    return calls.join(ranks.select("owner_id", "jx_rank"), "owner_id", "left")


def only_agents(df: DataFrame, agents: DataFrame) -> DataFrame:
    """Rows of the listed agents."""
    return df.join(agents.select("owner_id").distinct(), "owner_id", "left_semi")


def first_agent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of the agent with the smallest number, all or the first ``rows``."""
    smallest = df.select(F.min("owner_id")).scalar()
    own = df.filter(F.col("owner_id") == smallest)
    return own if rows is None else own.limit(rows)


def extract_transcripts(
    turns: DataFrame,
    calls_plus: DataFrame,
    performance: DataFrame,
    month: str,
    model_like: str,
    channel: str = AGENT,
) -> DataFrame:
    """One speaker's text of every call of a month, with call attributes and rank.

    Agents are those with a call in that month. One query for all agents.
    """
    owners = in_month(calls_plus, "file_date", month)
    attributes = only_agents(calls_plus, owners).drop("file_date")
    texts = call_text(turns, month, channel).join(attributes, "callid")
    ranks = rank_agents(agent_performance(performance, model_like))
    return calls_with_rank(texts, ranks).select(*TRANSCRIPT_COLUMNS)
