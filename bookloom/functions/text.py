"""String semantics of the engine as Column expressions: Unicode white space, case and word rules.

All take and give Columns, stay in the JVM and give null for null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, with the four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
#: The same as characters, for trimming: a pattern would look for an end at every white space of a text.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it.

    What a lambda captures is an expression and would be computed anew for
    every element; a lambda's own variable isn't.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def indent(c: Column) -> Column:
    """Characters of white space at the left."""
    return F.length(F.regexp_extract(c, rf"(?U)^{SPACE}*", 0))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def is_upper(c: Column) -> Column:
    """Some letter, and none in lower case."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def fold(c: Column) -> Column:
    """Case folding; of letters that lower-casing leaves apart only the sharp s is covered."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(strip(c), rf"(?U){SPACE}+", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def nonspace(c: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.length(F.regexp_replace(c, rf"(?U){SPACE}+", ""))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title_case(c: Column) -> Column:
    """Each run of letters begins with a capital and goes on in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def at_share(sorted_array: Column, tenths: int, of: int = 10) -> Column:
    """The element at index n * tenths / of (rounded down) of a sorted array of n, null if there is none."""
    return let(sorted_array, lambda a: F.try_element_at(a, (F.floor(F.size(a) * tenths / of) + 1).cast("int")))
