"""Is a line a heading?  One ordered CASE over a stripped line and its neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T


def _matches(c: Column, k: int) -> Column:
    pattern, any_case = K.EXPLICIT[k]
    return c.rlike(("(?idU)" if any_case else "(?dU)") + pattern)


def explicit_index(c: Column) -> Column:
    """Index of the first explicit pattern that a stripped line matches, or null."""
    return F.coalesce(*[F.when(_matches(c, k), F.lit(k)) for k in range(len(K.EXPLICIT))])


def is_explicit(c: Column) -> Column:
    """Does a stripped line match any of them?  One pattern for each kind of letters."""
    both = ("|".join(p for p, any_case in K.EXPLICIT if any_case == kind) for kind in (True, False))
    return reduce(lambda a, b: a | b, [c.rlike(flags + p) for flags, p in zip(("(?idU)", "(?dU)"), both, strict=True)])


def short_words_only(c: Column) -> Column:
    """Some letters A-Z, but nowhere three together."""
    return c.rlike("[A-Za-z]") & ~c.rlike("[A-Za-z]{3}")


def is_heading(s: Column, prev_blank: Column, next_blank: Column) -> Column:
    """For a stripped line ``s``; the edges of a text count as blank neighbours."""
    small = "|".join(K.TITLE_WORDS)
    word = rf"([\p{{Lu}}\p{{Nd}}]\S*|(?i:{small}))"
    upper = T.is_upper(s)
    return (
        F.when((s == "") | (F.length(s) > 100) | ~(prev_blank & next_blank), False)
        .when(is_explicit(s), True)
        .when(short_words_only(s), False)
        .when(s.rlike("^[\"“'‘’\\[(]"), False)
        .when(s.rlike(r"[?!;:]\z"), False)
        .when(s.rlike(r"(?U)\s{3}"), False)
        .when(s.rlike(r"(?U)(^|\s)\p{Nd}+\z"), False)
        .when(s.rlike(r"(?iU)^(re-)?(enter|exit|exeunt)\b"), False)
        .when(s.rlike(r"(?U)^[^\s\p{Ll}]{2,}\.(\s|\z)") & s.rlike(r"(?U)^\S*\p{Lu}"), False)
        .when(upper & s.endswith(".") & s.rlike(r"(?U)^\S+(\s+\S+){0,2}\z"), False)
        .when(upper & (F.length(s) >= 3) & s.rlike("[A-Z]"), ~s.contains(","))
        .when(s.rlike(r"(?U):\s"), False)
        .when(s.rlike(r"(?U)^\S+(\s+\S+){1,7}\z") & ~s.contains(",") & ~s.endswith(".") & s.rlike(r"(?U)^(\p{Lu}|\p{Nd}+(\s|\z))") & s.rlike(rf"(?U)^{word}(\s+{word})*\z"), True)
        .otherwise(False)
    )
