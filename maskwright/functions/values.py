"""Per-value functions: masks, calendar shifts, canonical integers and their ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a masked long field reads; the second where the original is the first.
MASK, MASK_OTHER = "[MASKED-MEMO]", "[MASKED-MEMO-ALT]"
#: Ordinal of the last day of year 9999 (day 1 is 0001-01-01), and of 1970-01-01.
LAST_DAY, UNIX_DAY = 3_652_059, 719_163
CANONICAL = r"^(0|-?[1-9][0-9]*)$"
WIDEST = 20


def mask(value: Column, kind: str = "string") -> Column:
    """The mask of a long field; null stays null, binary stays binary."""
    first, other = F.lit(MASK), F.lit(MASK_OTHER)
    if kind == "binary":
        first, other = F.encode(first, "US-ASCII"), F.encode(other, "US-ASCII")
    return F.when(value.isNull(), F.lit(None).cast(kind)).when(value == first, other).otherwise(first)


def ordinal(value: Column) -> Column:
    return F.unix_date(value.cast("date")) + UNIX_DAY


def shift(value: Column, kind: str, days: int | Column) -> Column:
    """value moved by days; the time of day stays. Days outside years 1 to 9999 fail."""
    days = F.lit(days) if isinstance(days, int) else days
    day = ordinal(value) + days
    moved = F.date_add(value, days.cast("int")) if kind == "date" else value + F.make_dt_interval(days.cast("int"))
    bad = F.raise_error(F.lit("TEMPORAL_RANGE")).cast(kind)
    return F.when(value.isNull(), F.lit(None).cast(kind)).when((day >= 1) & (day <= LAST_DAY), moved).otherwise(bad)


def shift_interval(least: int | None, most: int | None) -> tuple[int, int] | None:
    """The offsets that keep all days between least and most on the calendar."""
    return None if least is None or most is None else (1 - least, LAST_DAY - most)


def canonical_text(value: Column) -> Column:
    """The integer as text; a fraction is refused, never rounded into a key."""
    whole = value.cast("decimal(38,0)")
    return F.when(value.isNull(), None).when(whole == value, whole.cast("string")).otherwise(F.raise_error(F.lit("NUMERIC_KEY_NOT_INTEGRAL")).cast("string"))


def parse_canonical(text: Column) -> Column:
    """The integer, or null where text isn't canonical (`+5`, `007`, `-0`, blanks)."""
    return F.when(text.rlike(CANONICAL), text.cast("decimal(38,0)"))


def canonical_integer(value: object) -> str:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError("not an integer")
    return str(value)


def parse_canonical_integer(text: str) -> int:
    if not re.fullmatch(CANONICAL[1:-1], text):
        raise ValueError("not a canonical integer")
    return int(text)


def member_range(kind: str, width: int) -> tuple[int, int]:
    """Values that can be written back: four-byte integers without both extremes, or digits with a place for the sign."""
    if kind == "I":
        return -(2**31) + 1, 2**31 - 2
    if kind == "N" and 1 <= width <= WIDEST:
        return -(10 ** (width - 1) - 1), 10**width - 1
    raise ValueError("not an integral member")


def intersect(ranges: list[tuple[int, int]]) -> tuple[int, int] | None:
    low, high = max(r[0] for r in ranges), min(r[1] for r in ranges)
    return (low, high) if low <= high else None


def member_verdict(value: Column, kind: str, width: int) -> Column:
    """REVERSIBLE, RECOVERY_UNWRITABLE (readable, but can't be written back) or OUT_OF_MEMBER_RANGE, as is a fraction. The names are fixed values."""
    low, high = member_range(kind, width)
    whole = value.cast("decimal(38,0)")
    verdict = F.when(whole.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), "REVERSIBLE")
    if kind == "I":
        verdict = verdict.when(whole.isin(-(2**31), 2**31 - 1), "RECOVERY_UNWRITABLE")
    return F.when(value.isNull(), None).when(whole != value, "OUT_OF_MEMBER_RANGE").otherwise(verdict.otherwise("OUT_OF_MEMBER_RANGE"))
