"""Blocks and paragraphs: what a hard-wrapped text meant.

A book stays one row: its blocks are an array and each step maps over it, so
cleaning shuffles nothing.  ``block_features`` and ``paragraphs`` give the same
as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T
from . import normalize


def block_lines(c: Column) -> Column:
    """Array of blocks, each the array of its lines that aren't blank; blocks of blank lines are left out."""
    return F.filter(F.transform(F.split(c, "\n\n"), lambda b: F.filter(T.lines(b), lambda x: ~T.is_blank(x))), lambda b: F.size(b) > 0)


def is_page_mode(blocks: Column) -> Column:
    """Do blocks have over 25 lines in the median?"""
    sizes = F.sort_array(F.transform(blocks, lambda b: F.size(b)))
    return F.coalesce(T.at_share(sizes, 1, 2) > K.PAGE_LINES, F.lit(False))


def features(b: Column, wrap: Column) -> Column:
    """What decides the kind of a block of lines ``b``."""
    return T.let(F.transform(b, T.strip), lambda s: _features(b, s, wrap))


def _features(b: Column, s: Column, wrap: Column) -> Column:
    size = F.size(b)
    before = F.slice(s, F.lit(1), F.greatest(size - 1, F.lit(0)))
    filled = F.transform(before, lambda x: F.length(x))
    return F.struct(
        size.alias("n_lines"),
        F.size(F.filter(b, lambda x: x.startswith("  ") | x.startswith("\t"))).alias("indented"),
        T.at_share(F.sort_array(F.transform(s, lambda x: F.length(x))), 1, 2).alias("median"),
        ((size == 2) & (F.length(s[0]) <= 12)).alias("two_line_heading"),
        F.coalesce((F.size(F.array_distinct(F.transform(b, T.indent))) == 1) & (size >= 3) & (F.array_max(filled) - F.array_min(filled) <= 8) & (F.array_min(filled) >= wrap - 20), F.lit(False)).alias("uniform"),
        (F.size(F.filter(before, lambda x: x.endswith("-"))) >= K.HYPHENS).alias("hyphenated"),
    )


def kind(f: Column, page_mode: Column) -> Column:
    """single, verse, wrapped (to be split by the width) or prose (to be joined)."""
    verse = (f["n_lines"] <= K.VERSE_LINES) & (f["median"] <= K.VERSE_MEDIAN) & ~f["two_line_heading"] & (f["indented"] * 3 >= f["n_lines"] * 2) & ~f["uniform"]
    wrapped = page_mode | (f["n_lines"] > K.LONG_BLOCK) | ((f["n_lines"] > K.PAGE_LINES) & f["hyphenated"])
    return F.when(f["n_lines"] == 1, "single").when(verse, "verse").when(wrapped, "wrapped").otherwise("prose")


def breaks(before: Column, line: Column, wrap: Column) -> Column:
    """Does a paragraph end between two stripped lines?  The first rule that holds decides."""
    n = F.length(before)
    last = F.regexp_replace(F.lower(F.element_at(F.split(before, rf"(?U){T.SPACE}+"), -1)), r"""[.,;:'"]+\z""", "")
    near = lambda d: F.coalesce(n >= wrap - d, F.lit(False))
    return (
        F.when(near(3), False)
        .when(before.rlike(f"[{K.SENTENCE_ENDS}]\\z"), True)
        .when(line.rlike(r"^[\p{Ll}\p{Nd}]"), False)
        .when(last.isin(K.CONTINUING_WORDS), False)
        .when(near(12), False)
        .otherwise(True)
    )


def split_wrapped(b: Column, wrap: Column) -> Column:
    """Stripped lines as paragraphs set apart by blank lines."""
    return T.let(F.transform(b, T.strip), lambda s: _split_wrapped(s, wrap))


def _split_wrapped(s: Column, wrap: Column) -> Column:
    first = F.slice(s, F.lit(1), F.lit(1))
    rest = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, x: F.concat(F.when(breaks(a, x, wrap), F.lit("\n\n")).otherwise(F.lit(" ")), x))
    return F.array_join(F.concat(first, rest), "")


def joined(b: Column, sep: str = " ") -> Column:
    """Stripped lines as one text."""
    return F.array_join(F.transform(b, T.strip), sep)


def rendered(b: Column, what: Column, wrap: Column) -> Column:
    return F.when(what == "single", T.rstrip(b[0])).when(what == "verse", joined(b, "\n")).when(what == "wrapped", split_wrapped(b, wrap)).otherwise(joined(b))


def known(c: Column) -> Column:
    """Array of a raw text's blocks: lines, wrap, page_mode, the features ``f`` and kind of each.

    One expression, in which all that holds for a whole book is bound before
    its blocks are gone through: as columns of their own the optimizer would
    move them into the steps for each block, or into a filter, and so compute
    them again and again.
    """
    text = normalize.canonical(normalize.strip_boilerplate(F.coalesce(c, F.lit(""))))
    return T.let(text, lambda t: T.let(normalize.wrap_width(t), lambda w: T.let(block_lines(normalize.strip_illustrations(t)), lambda b: T.let(is_page_mode(b), lambda p: _known(b, w, p)))))


def _known(blocks: Column, wrap: Column, page_mode: Column) -> Column:
    one = lambda b, f: F.struct(b.alias("lines"), wrap.alias("wrap"), page_mode.alias("page_mode"), f.alias("f"), kind(f, page_mode).alias("kind"))
    return F.transform(blocks, lambda b: T.let(features(b, wrap), lambda f: one(b, f)))


def with_blocks(books: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``wrap``, ``blocks`` (array of arrays of lines) and ``page_mode`` to books of raw text."""
    books = books.withColumn("__c", normalize.canonical(normalize.strip_boilerplate(F.coalesce(F.col(text), F.lit("")))))
    books = books.withColumn("wrap", normalize.wrap_width(F.col("__c"))).withColumn("blocks", block_lines(normalize.strip_illustrations(F.col("__c")))).drop("__c")
    return books.withColumn("page_mode", is_page_mode(F.col("blocks")))


def _exploded(books: DataFrame, text: str) -> DataFrame:
    return books.select("book_id", F.posexplode(known(F.col(text))).alias("block_no", "x"))


def block_features(books: DataFrame, text: str = "text") -> DataFrame:
    """A row per block: book_id, block_no, the features, kind and the lines."""
    return _exploded(books, text).select("book_id", "block_no", "x.wrap", "x.page_mode", "x.f.*", "x.kind", "x.lines")


def paragraphs(books: DataFrame, text: str = "text") -> DataFrame:
    """(book_id, block_no, para_no, kind, text)."""
    rows = _exploded(books, text).select("book_id", "block_no", "x.kind", F.posexplode(F.split(_rendered("x"), "\n\n")).alias("para_no", "text"))
    return rows.select("book_id", "block_no", "kind", "para_no", "text")


def _rendered(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return rendered(x["lines"], x["kind"], x["wrap"])


def clean_text(books: DataFrame, text: str = "text", to: str = "cleaned") -> DataFrame:
    """``books`` with ``to``: blocks set apart by two blank lines."""
    return books.withColumn(to, F.array_join(F.transform(known(F.col(text)), _rendered), "\n\n\n"))


def paragraph_units(books: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    """(book_id, unit): paragraphs and verse lines of cleaned texts, each as often as it is."""
    return books.select("book_id", F.explode(F.split(cleaned, "\n+")).alias("unit"))
