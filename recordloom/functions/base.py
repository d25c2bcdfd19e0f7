"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, so that composed expressions stay linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all white space, not blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def quiet_double(c: Column) -> Column:
    """Number or NULL. Guarded by a pattern: the cast alone would read '5d' as 5."""
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def quiet_int(c: Column) -> Column:
    """Whole number of digits only, as a bigint, else NULL. The pattern goes first: a failing cast is slow."""
    return F.when(c.rlike(r"^-?\d{1,19}$"), c.try_cast("bigint"))


def capped(c: Column, characters: int | None) -> Column:
    """The first so many characters; the whole text without a limit."""
    return c if characters is None else F.substring(c, 1, characters)


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_contains(c: Column, needles) -> Column:
    """Does the text contain one of the words? A chain of native ``contains``."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def first_rule(rules: list[tuple[Column, object]], default=None) -> Column:
    """Ordered rules, first match wins."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def nonblank(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)
