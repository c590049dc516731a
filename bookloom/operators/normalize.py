"""Text normalisation: boilerplate, newlines, control characters, dashes, illustrations.

Row-local Column functions over the whole text of a book; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T


def strip_boilerplate(c: Column) -> Column:
    """Without what stands up to a start mark in the first half, and from the last end mark in the second half."""
    return T.let(_after_start(c), _before_end)


def _after_start(c: Column) -> Column:
    start = F.lit("(?imdU)" + K.START_MARK)
    at = F.regexp_instr(c, start)
    past = at + F.length(F.regexp_substr(c, start))
    return F.when((at > 0) & (at - 1 < F.floor(F.length(c) / 2)), F.substr(c, past.cast("int"))).otherwise(c)


def _before_end(body: Column) -> Column:
    end = F.lit("(?imdU)" + K.END_MARK)
    rest = F.length(F.element_at(F.split(body, "(?imdU)" + K.END_MARK, -1), -1))
    last = F.try_element_at(F.regexp_extract_all(body, end, F.lit(0)), F.lit(-1))
    cut = F.length(body) - rest - F.length(last)
    return F.when(last.isNotNull() & (cut > F.floor(F.length(body) / 2)), F.substr(body, F.lit(1), cut.cast("int"))).otherwise(body)


def canon_newlines(c: Column) -> Column:
    for a in ("\r\r\n", "\r\n", "\r"):
        c = F.replace(c, F.lit(a), F.lit("\n"))
    return c


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def empty_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?md)^[ \t]+$", "")


def fold_dashes(c: Column) -> Column:
    return F.regexp_replace(c, "--+", "—")


def canonical(c: Column) -> Column:
    return fold_dashes(empty_blank_lines(strip_control(canon_newlines(c))))


def wrap_width(c: Column) -> Column:
    """Length at nine tenths of the lines of over 30 characters; null below 40."""
    long = F.filter(T.lines(c), lambda x: F.length(T.strip(x)) > 30)
    return T.let(T.at_share(F.sort_array(F.transform(long, lambda x: F.length(x))), 9), lambda w: F.when(w >= 40, w))


def strip_illustrations(c: Column) -> Column:
    """Marks of illustrations replaced by the chapter lines inside them."""
    kept = lambda m: F.array_join(F.transform(F.filter(T.lines(m), lambda x: x.rlike(r"(?iU)^\s*chapter\b")), lambda x: F.regexp_replace(x, r"^[ \t\]]+|[ \t\]]+\z", "")), "\n\n")
    between = F.split(c, K.ILLUSTRATION, -1)
    marks = F.transform(F.regexp_extract_all(c, F.lit(K.ILLUSTRATION), F.lit(0)), kept)
    return F.array_join(F.zip_with(between, marks, lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")
