"""Removal of repeated passages of lines, by overlapping windows of three lines.

Every three consecutive lines of a text are a window, known by two 64-bit
hashes.  A window found more than once anywhere keeps its first occurrence (by
document, then by line); the lines that later occurrences cover are merged and
removed, but for lines that a first occurrence of a repeated window covers too.
So of every repeated passage of three lines or more one whole copy stays.

Scale: only hashes and line numbers are shuffled, pre-aggregated by window;
texts are shuffled only for documents that may lose lines (a bit set of fixed
size picks them).  Only DataFrame functions are used.

Defined cases: null text stays null and empty text empty; texts of fewer than
three lines have no window; windows of blank lines only don't count; rows with
equal id and equal text count as one and the same document and are treated
alike; a null id is an id before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ._common import repeats, saved, split_by_keys

WINDOW = 3


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, __bl_t, pos, h1, h2) for each window that isn't blank."""
    lines = docs.where("text is not null").select("doc_id", "__bl_t", F.split("text", "\n").alias("l"))
    lines = lines.where(F.size("l") >= window).select("doc_id", "__bl_t", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), (F.trim(x) == "").alias("e"))).alias("l"))
    at = [lambda i, k=k: F.element_at("l", (i + k).cast("int")) for k in range(window)]
    spots = F.transform(
        F.sequence(F.lit(1), F.size("l") - (window - 1)),
        lambda i: F.struct(
            (i - 1).alias("pos"),
            F.xxhash64(*[f(i)["a"] for f in at]).alias("h1"),
            F.xxhash64(*[f(i)["b"] for f in at]).alias("h2"),
            F.forall(F.array(*[f(i)["e"] for f in at]), lambda e: e).alias("blank"),
        ),
    )
    return lines.select("doc_id", "__bl_t", F.inline(spots)).where("not blank").drop("blank")


def removed_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, __bl_t, gone: sorted line numbers to remove) for documents that lose lines; ``__bl_t`` is the text's hash."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("__bl_t"))
    found = repeats(_windows(own, window).distinct(), ["h1", "h2"], ["doc_id", "__bl_t", "pos"])
    found = found.select("doc_id", "__bl_t", "__bl_first", F.explode(F.sequence(F.col("pos"), F.col("pos") + (window - 1))).alias("line"))
    by_line = found.groupBy("doc_id", "__bl_t", "line").agg(F.bool_or("__bl_first").alias("kept"))
    return by_line.where("not kept").groupBy("doc_id", "__bl_t").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the text cut, and ``__bl_lines``, ``__bl_gone``: numbers of lines before and removed."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = saved(removed_lines(own, window), "gone_lines").withColumnsRenamed({"doc_id": "__bl_id"})
    rows = docs.withColumn("__bl_id", F.col(doc_id)).withColumn("__bl_t", F.xxhash64(F.col(text)))
    maybe, clean = split_by_keys(rows, gone, ["__bl_id", "__bl_t"])
    lines = F.split(F.col(text), "\n")
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    g = gone.withColumnsRenamed({"__bl_id": "__bl_gid", "__bl_t": "__bl_gt"})
    cut = maybe.join(g, maybe["__bl_id"].eqNullSafe(g["__bl_gid"]) & (maybe["__bl_t"] == g["__bl_gt"]), "left").drop("__bl_gid", "__bl_gt")
    cut = cut.withColumn("__bl_lines", count).withColumn("__bl_gone", F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)))

    def left(own: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.element_at(own, i + 1)), "\n")

    cut = cut.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(let(lines, left))).drop("gone")
    clean = clean.withColumn("__bl_lines", count).withColumn("__bl_gone", F.lit(0))
    return cut.unionByName(clean).drop("__bl_id", "__bl_t")
