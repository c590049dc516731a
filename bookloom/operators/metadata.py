"""Author, title, file names and other metadata of a book; row-local, but for unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T


def _head_lines(text: Column) -> Column:
    """Stripped lines that aren't blank among the first 80; the rest of a long text isn't split."""
    first = F.slice(F.split(text, "\n", 81), F.lit(1), F.lit(80))
    return F.filter(F.transform(first, T.strip), lambda x: x != "")


def author_line(text: Column) -> Column:
    """The name after "by", on its line or the next, among the first 25 lines; else null."""
    return T.let(_head_lines(text), _author_line)


def _author_line(head: Column) -> Column:
    few = lambda c, least: F.size(T.words(c)).between(least, 6)

    def one(x: Column, i: Column) -> Column:
        name = T.strip(F.regexp_extract(x, "(?idU)" + K.AUTHOR_LINE, 1))
        after = F.get(head, i + 1)
        return F.when((name != "") & few(name, 0), name).when((F.lower(x) == "by") & after.isNotNull() & few(after, 1) & (F.length(after) >= 3), after)

    return F.get(F.filter(F.transform(F.slice(head, F.lit(1), F.lit(25)), one), lambda a: a.isNotNull()), F.lit(0))


def author_title_line(text: Column) -> Column:
    """The name in a first line like "First Last. Title"; else null."""
    return T.let(_head_lines(text), _author_title_line)


def _author_title_line(head: Column) -> Column:
    name = T.strip(F.regexp_extract(F.get(head, F.lit(0)), "(?U)" + K.AUTHOR_TITLE, 1))
    return T.let(name, lambda n: F.when(F.size(T.words(n)).between(2, 5), n))


def suggest_author(text: Column) -> Column:
    return T.let(_head_lines(text), lambda head: F.coalesce(_author_line(head), _author_title_line(head), F.lit("")))


def author_or_default(author: Column) -> Column:
    return T.let(author, lambda a: F.when(F.coalesce(a, F.lit("")) == "", K.UNKNOWN_AUTHOR).otherwise(a))


def stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")


def guess_title(path: Column) -> Column:
    return T.title_case(T.strip(F.regexp_replace(stem(path), r"[_\-]+", " ")))


def safe_name(title: Column) -> Column:
    kept = F.replace(T.strip(F.regexp_replace(title, r"(?U)[^\w\s\-]", "")), F.lit(" "), F.lit("_"))
    return F.when(kept == "", K.DEFAULT_NAME).otherwise(kept)


#: Ranges of the order in which equal names are numbered by themselves.
RANGES = 64


def _ranges(rows: DataFrame, order: str) -> Column:
    """Number of a row's range of ``order``: between the values of a few rows, those first by hash."""
    some = rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(RANGES - 1).collect()
    edges = [F.lit(x) for x in sorted({r[0] for r in some})]
    return F.size(F.filter(F.array(*edges), lambda e: e <= F.col(order))) if edges else F.lit(0)


def unique_names(rows: DataFrame, name: str, order: str, to: str = "unique_name", folder: str | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Adds ``to``: names that are unique, by ``folder`` if given, and not among ``taken`` (rows of folder and name).

    The first of equal names, by ``order``, stays as it is unless it is taken;
    further ones get _2, _3 and so on, but no number whose name is a row's own
    or taken.  So a result doesn't depend on the order of different names.

    Equal names are numbered in ranges of the order with the counts of those
    before, so that no task sees all rows of a name that many have.
    """
    key = ["__f", "__n"]
    own = rows.withColumns({"__f": F.coalesce(F.col(folder), F.lit("")) if folder else F.lit(""), "__n": F.col(name), "__r": _ranges(rows, order)})
    counts = own.groupBy(*key, "__r").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).drop("c")

    used = counts.select(*key, F.lit(0).alias("__x"))
    if taken is not None:
        there = taken.select((F.coalesce(F.col(folder), F.lit("")) if folder else F.lit("")).alias("__f"), F.col(name).alias("__n"), F.lit(1).alias("__x"))
        used = used.unionByName(there)
    used = used.groupBy(*key).agg(F.max("__x").alias("__x"))
    # numbers that can't be given to a name: those at the end of names in use
    base, number = (F.regexp_extract("__n", r"(?s)^(.*)_([1-9][0-9]{0,17})\z", k) for k in (1, 2))
    busy = used.select("__f", base.alias("__n"), F.nullif(number, F.lit("")).cast("long").alias("k")).where("k > 1").groupBy(*key).agg(F.sort_array(F.collect_set("k")).alias("__busy"))
    info = used.join(busy, key, "left").where("__x > 0 or __busy is not null").withColumnsRenamed({"__f": "__g", "__n": "__m"})

    nth = F.col("__before") + F.row_number().over(Window.partitionBy(*key, "__r").orderBy(order)) - 1
    numbered = own.join(counts, [*key, "__r"]).withColumn("__k", nth)
    numbered = numbered.join(info, (F.col("__f") == F.col("__g")) & (F.col("__n") == F.col("__m")), "left")
    k = F.col("__k") + F.coalesce("__x", F.lit(0)) + 1
    free = F.aggregate(F.coalesce("__busy", F.array().cast("array<bigint>")), k.cast("long"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    named = F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), free.cast("string")))
    return numbered.withColumn(to, named).drop(*key, "__r", "__k", "__before", "__g", "__m", "__x", "__busy")
