"""Rule flags of turns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from callweave.functions.columns import (
    AGENT, USER, flag_hit, flag_number, flag_sequence, flag_text,
)
from callweave.functions.predicates import by_channel
from callweave.functions.rules import Rule, RuleSet, Trigger, raw_hit, settle, trigger_hit
from callweave.functions.rules_zh import MANDARIN
from callweave.operators.calls import attach_call_attributes
from callweave.operators.windows import previous_turn


def _triggers(rules: Iterable[Rule]) -> dict[str, Trigger]:
    return {r.after.name: r.after for r in rules if r.after}


def after_turn(turns: DataFrame, condition: Column, out: str) -> DataFrame:
    """Turns that follow, in their call, a turn meeting ``condition``.

    ``out`` is true there, false after a turn that does not meet it, and NULL
    at the first turn.
    """
    return previous_turn(turns, {out: condition})


def tag_turns(
    turns: DataFrame,
    rules: Iterable[Rule],
    contact_type: str | None = None,
    codes: bool = True,
) -> DataFrame:
    """Add one column per rule: code, ``'false'`` or NULL.

    ``turns`` needs ``content`` and ``channel``, and for rules that look back
    ``callid`` and ``seq_id`` of *all* turns of a call. ``contact_type`` names
    the column that rules with ``null_for`` depend on; without it the contact
    counts as unknown. ``codes=False`` gives nullable booleans.
    """
    rules = list(rules)
    content, channel = F.col("content"), F.col("channel")
    triggers = _triggers(rules)
    if triggers:
        marks = {n: trigger_hit(t, content, channel) for n, t in triggers.items()}
        turns = previous_turn(turns, marks)
    contact = F.col(contact_type) if contact_type else F.lit(None).cast("string")
    flags = {}
    for rule in rules:
        flag = settle(rule, raw_hit(rule, content, channel), contact)
        flags[rule.name] = flag_text(flag, rule.code) if codes else flag
    return turns.withColumns(flags).drop(*triggers)


def _speaker_flags(
    turns: DataFrame, calls_plus: DataFrame, rules: Iterable[Rule], speaker: str, codes: bool
) -> DataFrame:
    """Flags of one speaker's turns with the attributes of their call.

    The look-back runs over all turns on the (call, block) key; the speaker is
    selected after it and before the call attributes are attached.
    """
    rules = list(rules)
    content, channel = F.col("content"), F.col("channel")
    triggers = _triggers(rules)
    if triggers:
        turns = previous_turn(
            turns, {n: trigger_hit(t, content, channel) for n, t in triggers.items()}
        )
    # Before the join: a call of two users then pays once for its texts.
    hits = {f"__hit_{r.name}": raw_hit(r, content, channel) for r in rules}
    tagged = by_channel(turns, speaker).withColumns(hits)
    with_call = attach_call_attributes(tagged, calls_plus)
    contact = F.col("contact_type")
    flags = {}
    for rule in rules:
        flag = settle(rule, F.col(f"__hit_{rule.name}"), contact)
        flags[rule.name] = flag_text(flag, rule.code) if codes else flag
    return with_call.withColumns(flags).select(
        "dt", "owner_id", "file_date", "callid", "channel", "content", "seq_id", "speed",
        "contact_type", *[r.name for r in rules],
    )


def agent_flags(
    turns: DataFrame, calls_plus: DataFrame, rules: RuleSet = MANDARIN, codes: bool = True
) -> DataFrame:
    """Agent turns with call attributes and one column per agent rule."""
    return _speaker_flags(turns, calls_plus, rules.agent, AGENT, codes)


def user_flags(
    turns: DataFrame, calls_plus: DataFrame, rules: RuleSet = MANDARIN, codes: bool = True
) -> DataFrame:
    """Customer turns with call attributes and one column per customer rule."""
    return _speaker_flags(turns, calls_plus, rules.user, USER, codes)


def flag_sequences(flags: DataFrame, names: Iterable[str], out: str) -> DataFrame:
    """Turns with the codes of their set flags as one text."""
    return flags.select(
        "callid", "contact_type", "channel", "seq_id", "content",
        flag_sequence([F.col(n) for n in names]).alias(out),
    )


def flag_numbers(flags: DataFrame, names: Iterable[str]) -> DataFrame:
    """Replace text flags by 0/1."""
    return flags.withColumns({n: flag_number(F.col(n)) for n in names})


def hit_column(df: DataFrame, name: str) -> Column:
    """A flag column, text or boolean, as boolean without NULL."""
    if df.schema[name].dataType.typeName() == "boolean":
        return F.coalesce(F.col(name), F.lit(False))
    return flag_hit(F.col(name))
