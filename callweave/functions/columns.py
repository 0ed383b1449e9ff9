"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels and codes that appear in result tables.
AGENT = "AGENT"
USER = "USER"
SELF = "self"
CLOSE_CONTACT = "close_contact"
TOP_CONTACT = "top_contact"
OTHERS = "others"
NEW_CASE = "新案"
OLD_CASE = "老案"
DEBTOR_CLASS = "逾期本人"
CONTACT_CLASS = "联系人"
TRUE = "true"
FALSE = "false"

#: Separator of aggregated strings.
SEPARATOR = ", "


def name_part(name: Column, part: int = 3, separator: str = "_") -> Column:
    """Numeric part of a composed name; NULL where it is not a number."""
    return F.split_part(name, F.lit(separator), F.lit(part)).try_cast("int")


def byte_length(text: Column) -> Column:
    """Length in bytes, the weight of a speech-speed mean."""
    return F.octet_length(text)


def sentence_length(text: Column, bytes_per_char: int | None = 3) -> Column:
    """Whole characters of a text, taking ``bytes_per_char`` bytes for one.

    ``bytes_per_char=None`` counts real characters instead.
    """
    if bytes_per_char is None:
        return F.char_length(text)
    return F.floor(F.octet_length(text) / F.lit(bytes_per_char))


def percent_text(rate: Column) -> Column:
    """A ratio as text with two decimals and a percent sign."""
    return F.concat((rate * 100).cast("decimal(38,2)").cast("string"), F.lit("%"))


def relation_class(order_id: Column) -> Column:
    """Relation of the phone's holder to the debtor, from its rank."""
    return (
        F.when(order_id.isin(1, 2), SELF)
        .when(order_id.isin(3, 4, 5), CLOSE_CONTACT)
        .when(order_id.isin(6, 7), TOP_CONTACT)
        .otherwise(OTHERS)
    )


def case_age(allocated_on: Column, rang_at: Column) -> Column:
    """New case when it was allocated on the day of the call, old otherwise."""
    return F.when(allocated_on == F.to_date(rang_at), NEW_CASE).otherwise(OLD_CASE)


def contact_class(contact_type: Column) -> Column:
    """Debtor or contact; an unknown contact counts as a contact."""
    return F.when(contact_type == SELF, DEBTOR_CLASS).otherwise(CONTACT_CLASS)


def flag_number(flag: Column) -> Column:
    """Text flag to 0/1: only ``'true'`` is 1."""
    return F.coalesce(flag == TRUE, F.lit(False)).cast("int")


def flag_hit(flag: Column) -> Column:
    """Turn flag (code, ``'false'`` or NULL) to a boolean without NULL."""
    return F.coalesce(flag != FALSE, F.lit(False))


def flag_text(hit: Column, code: str) -> Column:
    """Boolean to the text form: code, ``'false'``, and NULL stays NULL."""
    return F.when(hit, code).when(~hit, FALSE)


def flag_sequence(flags: list[Column]) -> Column:
    """Codes of the flags that are set, one after the other."""
    return F.concat(*[F.when(flag_hit(flag), flag).otherwise("") for flag in flags])


def topic_bin(probability: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """1 = not in the topic, 0 = in the topic, 2 = in both."""
    return (
        F.when(probability <= low, 1).when(probability >= high, 0).otherwise(2)
    )
