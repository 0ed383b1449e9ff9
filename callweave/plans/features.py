"""From turns and calls to call features in one pass over the turns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from callweave.functions.columns import AGENT, TRUE, USER, flag_text, sentence_length
from callweave.functions.rules import Rule, RuleSet, raw_hit, trigger_hit
from callweave.functions.rules_zh import MANDARIN, SHOWN_ONLY_WITH
from callweave.operators.metrics import FEATURE_HEAD, call_attributes, text_metric_columns
from callweave.operators.rollup import applies, blank_unless
from callweave.operators.windows import mark_copies, previous_turn


def _spoken_by(rules: RuleSet) -> list[tuple[Rule, str]]:
    return [(r, AGENT) for r in rules.agent] + [(r, USER) for r in rules.user]


def turn_hits(
    turns: DataFrame, rules: RuleSet, bytes_per_char: int | None = 3
) -> DataFrame:
    """Turns without their text: length, rule hits and trigger of the turn before.

    All regular expressions are evaluated in the task that reads the turn, and
    only those for its speaker. What is shuffled for the look-back is a row of
    booleans.
    """
    content, channel = F.col("content"), F.col("channel")
    marks = {t.name: trigger_hit(t, content, channel) for t in rules.triggers}
    hits = [
        F.coalesce((channel == speaker) & raw_hit(rule, content, channel), F.lit(False))
        .alias(rule.name)
        for rule, speaker in _spoken_by(rules)
    ]
    narrow = turns.select(
        "callid", "seq_id", "channel", "speed",
        sentence_length(content, bytes_per_char).alias("turn_length"),
        *hits,
        *[mark.alias(name) for name, mark in marks.items()],
    )
    return previous_turn(narrow, {name: F.col(name) for name in marks}) if marks else narrow


def _call_hit(rule: Rule) -> Column:
    hit = F.col(rule.name)
    if rule.after:
        hit = hit & F.coalesce(F.col(rule.after.name), F.lit(False))
    return F.bool_or(hit).alias(rule.name)


def features_from_turns(
    turns: DataFrame,
    calls_plus: DataFrame,
    rules: RuleSet = MANDARIN,
    shown_only_with: Mapping[str, str] = SHOWN_ONLY_WITH,
    bytes_per_char: int | None = 3,
) -> DataFrame:
    """The call feature table, equal to building metrics and flags separately.

    Owner, date and contact type belong to the call, so turns are aggregated per
    call first, flags and metrics together, and meet the call table as one row
    per call. Flags that do not apply to the contact are cleared then. Calls
    with several call records are left out, as are calls in which only one side
    speaks.
    """
    spoken = _spoken_by(rules)
    tagged = turn_hits(turns, rules, bytes_per_char)
    per_call = tagged.groupBy("callid").agg(
        *text_metric_columns(F.col("turn_length")),
        F.bool_or(F.col("channel") == AGENT).alias("__agent"),
        F.bool_or(F.col("channel") == USER).alias("__user"),
        *[_call_hit(rule) for rule, _ in spoken],
    )
    both = per_call.filter(F.col("__agent") & F.col("__user"))
    one_record = mark_copies(call_attributes(calls_plus), "callid", "__copies")
    joined = both.join(one_record, "callid", "left").filter(
        F.coalesce(F.col("__copies"), F.lit(1)) == 1
    )
    contact = F.col("contact_type")
    settled = {}
    for rule, _ in spoken:
        meant = applies(rule, contact)
        hit = F.col(rule.name)
        settled[rule.name] = hit if meant is None else hit & meant
    text = joined.withColumns({n: flag_text(c, TRUE) for n, c in settled.items()})
    return blank_unless(text, shown_only_with).select(*FEATURE_HEAD, *rules.names)
