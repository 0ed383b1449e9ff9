"""Turn flags rolled up to calls."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from callweave.functions.columns import SELF, TRUE, flag_text
from callweave.functions.rules import Rule, RuleSet
from callweave.functions.rules_zh import MANDARIN, SHOWN_ONLY_WITH
from callweave.operators.flags import hit_column

CALL_KEYS = ["owner_id", "dt", "callid", "contact_type"]


def applies(rule: Rule, contact_type: Column) -> Column | None:
    """Contacts a rule is meant for; ``None`` when for all."""
    if rule.null_for == "self":
        return ~contact_type.eqNullSafe(F.lit(SELF))
    if rule.null_for == "contact":
        return contact_type.isNull() | (contact_type == SELF)
    return None


def rollup_flags(
    flags: DataFrame, names: Iterable[str], keys: Iterable[str] = CALL_KEYS
) -> DataFrame:
    """``'true'`` where any turn of the group carries the flag, else ``'false'``."""
    names = list(names)
    any_turn = flags.groupBy(*keys).agg(
        *[F.bool_or(hit_column(flags, n)).alias(n) for n in names]
    )
    return any_turn.withColumns({n: flag_text(F.col(n), TRUE) for n in names})


def blank_unless(df: DataFrame, shown_only_with: Mapping[str, str]) -> DataFrame:
    """NULL in a flag wherever the flag it depends on is not set."""
    return df.withColumns(
        {n: F.when(F.col(w) == TRUE, F.col(n)) for n, w in shown_only_with.items()}
    )


def merge_call_flags(agent: DataFrame, user: DataFrame) -> DataFrame:
    """Calls with both an agent and a customer roll-up, keys from the customer's."""
    return user.join(agent.drop("owner_id", "dt", "contact_type"), "callid")


def call_flags(
    agent: DataFrame,
    user: DataFrame,
    rules: RuleSet = MANDARIN,
    shown_only_with: Mapping[str, str] = SHOWN_ONLY_WITH,
    null_by_contact: bool = False,
) -> DataFrame:
    """Flags per call from the two turn-flag tables.

    Flags not meant for the contact are ``'false'`` after the roll-up;
    ``null_by_contact`` makes them NULL.
    """
    agent_calls = rollup_flags(agent, [r.name for r in rules.agent])
    user_calls = rollup_flags(user, [r.name for r in rules.user])
    if null_by_contact:
        agent_calls = _null_by_contact(agent_calls, rules.agent)
        user_calls = _null_by_contact(user_calls, rules.user)
    merged = blank_unless(merge_call_flags(agent_calls, user_calls), shown_only_with)
    return merged.select(*CALL_KEYS, *rules.names)


def _null_by_contact(calls: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    shown = {r.name: applies(r, F.col("contact_type")) for r in rules}
    return calls.withColumns(
        {n: F.when(c, F.col(n)) for n, c in shown.items() if c is not None}
    )
