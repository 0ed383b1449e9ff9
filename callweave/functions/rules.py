"""Rule flags: a table of regular-expression rules compiled to expressions.

A :class:`Rule` states what makes a turn carry a flag; :func:`raw_hit` turns it
into one boolean column. All matches are find-anywhere matches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from callweave.functions.columns import SELF, TRUE
from callweave.functions.patterns import needed_words, one_scan, plain_words, understood

@dataclass(frozen=True)
class Trigger:
    """Condition on the preceding turn of the call."""

    name: str
    channel: str
    any_of: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """One flag.

    ``any_of``      at least one pattern occurs
    ``all_of``      every pattern occurs
    ``cues``        (weight, pattern) pairs; with ``gate`` and ``above``: the gate
                    occurs and the weights that occur add up to more than ``above``
    ``speaker``     only turns of this speaker can carry the flag
    ``after``       the preceding turn meets the trigger, else the flag is NULL
    ``null_for``    ``"self"``: NULL when the contact is the debtor;
                    ``"contact"``: NULL when known not to be the debtor
    ``code``        text of a set flag
    """

    name: str
    code: str = TRUE
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    cues: tuple[tuple[str, str], ...] = ()
    gate: str | None = None
    above: str | None = None
    speaker: str | None = None
    after: Trigger | None = None
    null_for: str | None = None


@dataclass(frozen=True)
class RuleSet:
    """Rules for agent turns and rules for customer turns."""

    agent: tuple[Rule, ...] = ()
    user: tuple[Rule, ...] = ()

    @property
    def triggers(self) -> tuple[Trigger, ...]:
        found = {r.after.name: r.after for r in (*self.agent, *self.user) if r.after}
        return tuple(found.values())

    @property
    def names(self) -> list[str]:
        return [r.name for r in (*self.agent, *self.user)]


def with_trigger_speaker(rules: Iterable[Rule], name: str, speaker: str) -> tuple[Rule, ...]:
    """Copy of ``rules`` where flag ``name`` waits for a turn of ``speaker``."""
    return tuple(
        replace(r, after=replace(r.after, channel=speaker, name=f"{r.after.name}_{speaker.lower()}"))
        if r.name == name and r.after
        else r
        for r in rules
    )


def _contains_any(content: Column, words: Iterable[str]) -> Column:
    return reduce(or_, [content.contains(w) for w in words])


def occurs(content: Column, *patterns: str) -> Column:
    """Whether any of ``patterns`` is found anywhere in ``content``.

    Plain words are searched for as such. The pattern matcher runs only on texts
    with one of the words that every match contains, and once for all patterns.
    Patterns that cannot surely be rewritten are matched as they are.
    """
    words, others = plain_words([p for p in patterns if understood(p)])
    tests = [_contains_any(content, words)] if words else []
    tests.extend(content.rlike(p) for p in dict.fromkeys(patterns) if not understood(p))
    if others:
        scan = content.rlike(one_scan(others))
        needed = needed_words(others)
        tests.append(_contains_any(content, needed) & scan if needed else scan)
    return reduce(or_, tests)


def _score(rule: Rule, content: Column) -> Column:
    """Gate and weighted cues. Weights are scaled to whole numbers: 0.1 + 0.2
    is then exactly 0.3 and not above it."""
    weights = [Decimal(w) for w, _ in rule.cues] + [Decimal(rule.above)]
    scale = 10 ** max(-w.as_tuple().exponent for w in weights)
    total = F.lit(0)
    for weight, pattern in rule.cues:
        points = int(Decimal(weight) * scale)
        total = total + F.when(occurs(content, pattern), points).otherwise(0)
    return occurs(content, rule.gate) & (total > int(Decimal(rule.above) * scale))


def raw_hit(rule: Rule, content: Column, channel: Column) -> Column:
    """The text condition of a rule, never NULL.

    Depends on the turn alone, so it is evaluated where the turn is read and
    the text need not travel further.
    """
    tests = []
    if rule.speaker:
        tests.append(channel == rule.speaker)
    if rule.any_of:
        tests.append(occurs(content, *rule.any_of))
    tests.extend(occurs(content, p) for p in rule.all_of)
    if rule.cues:
        tests.append(_score(rule, content))
    result = tests[0]
    for test in tests[1:]:
        result = result & test
    return F.coalesce(result, F.lit(False))


def trigger_hit(trigger: Trigger, content: Column, channel: Column) -> Column:
    """Whether a turn sets off the rules that look at the turn before them."""
    return F.coalesce(
        (channel == trigger.channel) & occurs(content, *trigger.any_of), F.lit(False)
    )


def settle(rule: Rule, hit: Column, contact_type: Column) -> Column:
    """Flag as nullable boolean: the hit plus what depends on turn order and contact.

    The trigger column of the rule must be present under the trigger's name.
    """
    result = hit
    if rule.after:
        result = F.when(F.col(rule.after.name), result)
    if rule.null_for == "self":
        result = F.when(~contact_type.eqNullSafe(F.lit(SELF)), result)
    elif rule.null_for == "contact":
        result = F.when(contact_type.isNull() | (contact_type == SELF), result)
    return result
