"""Mixing sources to target weights by entropy balancing.

Of all document rates r, between 0 and ``cap``, whose tokens add up to each
source's target, the one nearest to the prior rates q in relative entropy (sum
of r * log(r / q) - r + q over documents) is exponentially tilted:
r = min(cap, q * exp(lambda * size)), with one lambda for each source's token
constraint.  So rates differ between documents: a source that must shrink gives
up its long documents first, one that must grow repeats them first.

The convex dual in lambda is solved by Newton steps, for all sources at once;
each is one distributed aggregate over cells, the counts of documents by source,
size and prior, with the step kept inside a bracket of the root.  The driver
sees one truth value per step.

Rates then become whole copies.  Down the sizes of a source, each cell takes the
nearest whole number of copies of its own words and of what larger ones left
over, so the error that remains at the end is about half the smallest document.
A cell's copies are dealt evenly to its documents in order of a hash of the id,
so that a rerun takes the same.

Scale: texts are counted once, into a table of a few numbers a row.  A cell's
documents are numbered in runs of about ``RUN`` rows, by hash, with the counts of
the runs before; so no task sees a whole source, nor a whole cell of a hot size.
One task rounds the cells of a source; there are at most as many as different
sizes (words of the longest text) times prior levels.

Defined cases: null text has size 0, and size 0 takes 0 words; a null source is
a source of its own, the last; a null prior counts as 1, and a document with one
of 0 or less isn't taken; equal rows are interchangeable; no rows, no mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Rows that are numbered by one task at a time, about.
RUN = 100_000
#: Priors are held to so many levels an octave.
LEVELS = 16
#: Newton steps at most, and the relative error at which a source is done.
STEPS, CLOSE = 200, 1e-12
#: Rates below exp(-LOWEST) are as good as 0; and exponents above HIGHEST as infinity.
LOWEST, HIGHEST = 40.0, 700.0
#: Rates are rounded to so many parts of one.
PARTS = 10**7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights by code point order, capped, the excess reshared.

    What filling sources up to their caps ends at is one level: sorted by cap
    over weight, the full ones come first, and the rest share what is left.
    One row per source, so the two windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("rank", F.row_number().over(by_name))
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = listed.select("*", (F.sum("source_size").over(everything) * F.lit(share) - before * F.lit(cap)).alias("left"), F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    over = F.col("left") * F.col("weight") / F.col("open") > F.col("source_size") * F.lit(cap)
    level = F.min(F.when(~over, F.struct(F.col("source_size") / F.col("weight"), "rank", "left", "open"))).over(everything)
    filled = filled.withColumn("level", level)
    share_of = F.col("level.left") * F.col("weight") / F.col("level.open")
    full = F.col("source_size") * F.lit(cap)
    return filled.withColumn("target", F.when(F.col("level").isNull(), full).otherwise(F.least(share_of, full)).cast("double")).select("source", "source_size", "target")


def _tilted() -> Column:
    """q * exp(lambda * size), before the cap."""
    return F.col("q") * F.exp(F.least(F.lit(HIGHEST), F.col("lam") * F.col("size")))


def tilts(cells: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """(skey, target, lam) by Newton on the dual, from cells (skey, size, q, n) and (skey, target).

    The dual's slope is the words taken less the target, its curvature the sum
    of rate * size ** 2 over documents below the cap.  At the bracket's upper
    end all documents are at the cap, at its lower end they are as good as gone;
    where a step would leave the bracket, it is halved instead.
    """
    n, size, q = F.col("n"), F.col("size"), F.col("q")
    ends = (
        cells.where("size > 0 and q > 0")
        .groupBy("skey")
        .agg(F.min("size").alias("least"), F.min("q").alias("q0"), F.max("q").alias("q1"), F.sum(n * size).cast("double").alias("words"), (F.sum(n * size * size) / F.sum(n * size)).alias("mean"))
    )
    lo, hi = -(F.lit(LOWEST) + F.greatest(F.log("q1"), F.lit(0.0))) / F.col("least"), (F.log(F.lit(cap)) - F.log("q0")) / F.col("least")
    state = wanted.join(ends, "skey", "left").select("skey", "target", lo.alias("lo"), hi.alias("hi"), "words", "mean")
    full = F.col("words").isNull() | (F.col("target") >= F.col("words") * F.lit(cap) * (1 - CLOSE))
    first = F.greatest("lo", F.least("hi", F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("words")) / F.col("mean")))
    state = saved(state.select("skey", "target", "lo", "hi", F.when(full, F.coalesce("hi", F.lit(0.0))).otherwise(first).alias("lam"), full.alias("done")), "mix_dual")
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        rate = _tilted()
        sums = cells.join(state.select("skey", "lam"), "skey").groupBy("skey").agg(F.sum(n * size * F.least(F.lit(cap), rate)).alias("taken"), F.sum(F.when(rate < cap, n * size * size * rate).otherwise(0.0)).alias("free"))
        over = F.col("taken") - F.col("target")
        s = state.join(sums, "skey").withColumn("over", over)
        s = s.withColumn("lo", F.when(F.col("over") > 0, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("hi")))
        near = (F.abs("over") <= F.col("target") * CLOSE) | (F.col("hi") - F.col("lo") <= F.greatest(F.abs("lo"), F.abs("hi")) * 1e-15)
        newton = F.col("lam") - F.try_divide(F.col("over"), F.col("free"))
        step = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        stay = F.col("done") | near
        state = saved(s.select("skey", "target", "lo", "hi", F.when(stay, F.col("lam")).otherwise(step).alias("lam"), stay.alias("done")), "mix_dual")
    return state.select("skey", "target", "lam")


def whole_copies(sizes: list, numbers: list, parts: list, cap: float = CAP) -> list:
    """Copies of each cell of a source, cells by falling size: rounded with what the ones before left over."""
    out, left = [], 0.0
    for size, n, part in zip(sizes, numbers, parts, strict=True):
        if size:
            left += float(n) * float(part) * float(size) / PARTS
            k = min(max(int((left / size + 0.5) // 1), 0), int(cap * n))
            left -= float(k) * float(size)
        else:
            k = int((float(n) * float(part) / PARTS + 0.5) // 1)
        out.append(k)
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", prior: str | None = None, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, run: int = RUN) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), a row per row of ``docs``."""
    ship(docs.sparkSession)
    p = F.lit(1.0) if prior is None else F.coalesce(F.col(prior).cast("double"), F.lit(1.0))
    level = F.when(p > 0, F.round(F.log2(p) * LEVELS).cast("int"))
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), level.alias("level"), spread.alias("hash"))
    rows = saved(rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("lkey", F.coalesce("level", F.lit(1 << 30))), "mix_rows")
    runs_a_cell = 1 + rows.count() // run
    rows = rows.withColumn("run", F.shiftright(F.col("hash") * runs_a_cell, 32))

    cell, part = ["skey", "lkey", "size"], ["skey", "lkey", "size", "run"]
    runs = saved(rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"), F.first("level").alias("level")), "mix_runs")
    q = F.coalesce(F.pow(F.lit(2.0), F.col("level") / LEVELS), F.lit(0.0))
    cells = saved(runs.groupBy(*cell).agg(F.sum("n").alias("n"), F.first("source").alias("source"), F.first("level").alias("level")).withColumn("q", q), "mix_cells")
    sums = cells.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = saved(targets(sums, share, cap, weights).withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "mix_targets")
    tilted = tilts(cells, wanted.select("skey", "target"), cap)

    parts = F.floor(F.least(F.lit(cap), _tilted()) * PARTS + 0.5).cast("long")
    rated = cells.join(tilted, "skey").select(*cell, "n", parts.alias("parts"))

    def rounded(of):
        of = of.sort_values(["size", "lkey"], ascending=[False, True])
        of["k"] = whole_copies(of["size"].tolist(), of["n"].tolist(), of["parts"].tolist(), cap)
        return of

    dealt = rated.groupBy("skey").applyInPandas(rounded, "skey string, lkey int, size long, n long, parts long, k long").withColumnRenamed("n", "cell_n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.select(*part, before.alias("place")).join(dealt, cell).join(wanted, "skey")
    nth = F.row_number().over(Window.partitionBy(*part).orderBy("hash", "doc_id"))
    found = rows.select("doc_id", "source", *part, "hash", nth.alias("nth")).join(placed, part)
    found = found.withColumn("rank", F.col("place") + F.col("nth"))
    copies = F.expr("k * rank div cell_n - k * (rank - 1) div cell_n")
    found = found.withColumn("copies", copies)
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("parts") / PARTS).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
