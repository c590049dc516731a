"""Chapters: candidates, their suppression, and the split.

A book stays one row, so detection shuffles nothing; the arrays hold
candidates, not lines, wherever a step is more than linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T
from . import headings

CHAPTERS = "array<struct<title:string,body:string>>"


def candidates(lines: Column) -> Column:
    """Array of (pos, title, explicit, decor, key) of the lines that may be headings, in order; pos from 0."""
    return T.let(lines, _candidates)


def _candidates(lines: Column) -> Column:
    """Costly tests are for the few lines that stand alone between blank ones."""

    def alone(blank: Column) -> Column:
        edge = lambda i: F.coalesce(F.get(blank, i), F.lit(True))
        return F.filter(F.sequence(F.lit(0), F.size(blank) - 1), lambda i: ~F.get(blank, i) & edge(i - 1) & edge(i + 1))

    spots = T.let(F.transform(lines, T.is_blank), alone)
    titled = F.transform(spots, lambda i: F.struct(i.alias("pos"), F.get(lines, i).alias("line"), T.strip(F.get(lines, i)).alias("title")))
    found = F.filter(titled, lambda c: F.length(c["title"]).between(1, 100) & headings.is_heading(c["title"], F.lit(True), F.lit(True)))
    decor = lambda x: (T.indent(x) >= K.DECOR_INDENT) & T.is_upper(x)
    return F.transform(found, lambda c: F.struct(c["pos"].alias("pos"), c["title"].alias("title"), headings.is_explicit(c["title"]).alias("explicit"), decor(c["line"]).alias("decor"), T.fold(T.collapse(c["title"])).alias("key")))


def suppress_repeated(c: Column, times: int = K.REPEATED) -> Column:
    """Without titles that occur ``times`` or more and aren't explicit."""
    def kept(c: Column) -> Column:
        often = T.let(F.sort_array(F.transform(c, lambda x: x["key"])), lambda keys: F.array_distinct(F.filter(keys, lambda k, i: F.coalesce(F.get(keys, i + (times - 1)) == k, F.lit(False)))))
        return T.let(often, lambda o: F.filter(c, lambda x: x["explicit"] | ~F.array_contains(o, x["key"])))

    return T.let(c, kept)


def suppress_nondominant(c: Column) -> Column:
    """Only the explicit ones, where they are many and prevail among all but centred capitals."""
    def kept(c: Column) -> Column:
        n = F.size(F.filter(c, lambda x: x["explicit"]))
        voters = F.size(F.filter(c, lambda x: x["explicit"] | ~x["decor"]))
        return F.when((n >= K.DOMINANT_COUNT) & (n >= voters * K.DOMINANT_SHARE), F.filter(c, lambda x: x["explicit"])).otherwise(c)

    return T.let(c, kept)


def drop_contents(c: Column, lines: Column) -> Column:
    """Without headings that have no text: all of a run of three or more, else those that aren't explicit."""
    return T.let(lines, lambda own: T.let(c, lambda known: _drop_contents(known, own)))


def _drop_contents(c: Column, lines: Column) -> Column:
    end = lambda i: F.coalesce(F.get(c, i + 1)["pos"], F.size(lines))
    empty = F.transform(c, lambda x, i: ~F.exists(F.slice(lines, x["pos"] + 2, end(i) - x["pos"] - 1), lambda y: ~T.is_blank(y)))
    flags = F.array_join(F.transform(empty, lambda e: F.when(e, "e").otherwise("f")), "")
    runs = F.regexp_extract_all(flags, F.lit("(e+|f)"), F.lit(0))
    run_of = F.flatten(F.transform(runs, lambda r: F.array_repeat(F.length(r) * F.when(r.startswith("e"), 1).otherwise(0), F.length(r).cast("int"))))
    return T.let(run_of, lambda run: F.filter(c, lambda x, i: (F.get(run, i) == 0) | ((F.get(run, i) < K.TOC_RUN) & x["explicit"])))


def split_at(c: Column, lines: Column, text: Column) -> Column:
    """Array of (title, body); what stands before the first heading is an introduction."""
    return T.let(lines, lambda own: T.let(c, lambda known: _split_at(known, own, text)))


def _split_at(c: Column, lines: Column, text: Column) -> Column:
    body = lambda a, n: T.strip(F.array_join(F.slice(lines, a + 1, n), "\n"))
    own = F.transform(c, lambda x, i: F.struct(x["title"].alias("title"), body(x["pos"] + 1, F.coalesce(F.get(c, i + 1)["pos"], F.size(lines)) - x["pos"] - 1).alias("body")))
    before = T.let(body(F.lit(0), F.coalesce(F.get(c, F.lit(0))["pos"], F.lit(0))), lambda b: F.when(b != "", F.array(F.struct(F.lit(K.INTRODUCTION).alias("title"), b.alias("body")))).otherwise(F.array().cast(CHAPTERS)))
    whole = F.array(F.struct(F.lit(K.CONTENT).alias("title"), T.strip(text).alias("body")))
    return F.when(F.size(c) == 0, whole).otherwise(F.concat(before, own)).cast(CHAPTERS)


def detect_chapters(books: DataFrame, text: str = "cleaned", to: str = "chapters") -> DataFrame:
    """``books`` with ``to``, an array of (title, body) in order; one of the whole text if nothing is found."""
    rows = books.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__l", T.lines(F.col("__t")))
    rows = rows.withColumn("__c", candidates(F.col("__l"))).withColumn("__c", suppress_repeated(F.col("__c"))).withColumn("__c", suppress_nondominant(F.col("__c")))
    rows = rows.withColumn("__c", drop_contents(F.col("__c"), F.col("__l")))
    return rows.withColumn(to, split_at(F.col("__c"), F.col("__l"), F.col("__t"))).drop("__t", "__l", "__c")


def whole_text(books: DataFrame, text: str = "cleaned", to: str = "chapters") -> DataFrame:
    """As ``detect_chapters`` with detection off."""
    return books.withColumn(to, F.array(F.struct(F.lit(K.CONTENT).alias("title"), T.strip(F.coalesce(F.col(text), F.lit(""))).alias("body"))).cast(CHAPTERS))


def chapter_rows(books: DataFrame, chapters: str = "chapters") -> DataFrame:
    """(book_id, chap_no from 1, title, body)."""
    return books.select("book_id", F.posexplode(chapters).alias("k", "c")).select("book_id", (F.col("k") + 1).alias("chap_no"), "c.title", "c.body")


def merge_reviewed(rows: DataFrame, by: str = "book_id", order: str = "chap_no", title: str = "title", body: str = "body", kept: str = "kept") -> DataFrame:
    """(by, chap_no, title, body): chapters that aren't ``kept`` join the kept one before, or the first."""
    w = Window.partitionBy(by).orderBy(order)
    g = rows.withColumn("grp", F.greatest(F.sum(F.col(kept).cast("int")).over(w), F.lit(1)))
    piece = F.when(F.col(kept), F.col(body)).otherwise(F.concat_ws("\n\n", F.when(F.col(title) != "", F.col(title)), F.when(F.col(body) != "", F.col(body))))
    parts = g.select(by, "grp", F.struct(F.col(order).alias("o"), F.when(piece != "", piece).alias("p"), F.when(F.col(kept), F.col(title)).alias("t")).alias("s"))
    out = parts.groupBy(by, "grp").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return out.select(by, F.col("grp").alias("chap_no"), F.coalesce(F.array_max(F.transform("s", lambda x: x["t"])), F.lit(K.CONTENT)).alias("title"), F.array_join(F.transform("s", lambda x: x["p"]), "\n\n").alias("body"))


def dominant_pattern(rows: DataFrame, by: str = "book_id", title: str = "title") -> DataFrame:
    """(by, dominant): the explicit pattern that most titles match, the first of equals, null if under 3 do."""
    i = headings.explicit_index(T.strip(F.col(title)))
    counts = rows.groupBy(by, i.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("i").isNotNull() & (F.col("n") >= 3), F.struct(F.col("n"), (-F.col("i")).alias("m"))))
    return counts.groupBy(by).agg(best.alias("b")).select(by, (-F.col("b.m")).alias("dominant"))


def structure_warning(text: Column, n_chapters: Column) -> Column:
    """A warning for a large raw text of one chapter, else null."""
    long = F.sort_array(F.transform(F.filter(T.lines(text), lambda x: ~T.is_blank(x)), lambda x: F.length(x)))
    p90 = T.at_share(long, 9)
    a, b = K.WARNING_LINES.split("{}")
    why = F.when(p90 > K.STRUCTURE_P90, F.concat(F.lit(a), p90.cast("string"), F.lit(b))).otherwise(K.WARNING_PATTERN)
    return F.when((n_chapters <= 1) & (F.length(text) >= K.STRUCTURE_CHARS) & p90.isNotNull(), F.concat(F.lit(K.WARNING_HEAD), why, F.lit(K.WARNING_TAIL)))
