"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import Series, saved

#: Edges that a task contracts at once; these bound its memory (some 100 bytes each).
CHUNK = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the least of their component of these edges, and that least node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, n = [], 0

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in kept]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], names=["u", "v"])

    for batch in batches:
        kept, n = [*kept, batch], n + batch.num_rows
        if n >= CHUNK:
            yield flush()
            kept, n = [], 0
    if n:
        yield flush()


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, root) for all nodes with an edge; root is the least node that is reachable.

    ``edges`` are read twice, so they should be a written table.  At most
    ``CHUNK`` edges are contracted by one task, and that is all.  More of them
    take alternating large-star and small-star steps, each a pre-aggregated
    minimum by node and a join back that Spark can split at a hot node; after
    each step tasks contract the edges that they have, a chunk at a time, which
    leaves fewer steps and fewer edges to shuffle.  Every step is written to the
    shared folder, and all of them are emptied at the end; the driver sees two
    numbers per step, observed while it is written.
    """
    ship(edges.sparkSession)
    spark = edges.sparkSession
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    if e.count() <= CHUNK:
        return saved(_rooted(e.coalesce(1).mapInArrow(_contract, "u long, v long")), "roots")
    steps = Series(spark, "edges")

    def step(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = e.where("u <> v").distinct().mapInArrow(_contract, "u long, v long").distinct()
        e = steps.put(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return e, (seen.get["n"], seen.get["h"])

    e, before = step(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e, now = step(small)
        if now == before:
            break
        before = now
    found = saved(_rooted(e), "roots")
    steps.clear(spark)
    return found


def _rooted(stars: DataFrame) -> DataFrame:
    """(node, root) of stars, with the roots themselves."""
    pairs = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return stars.select(F.inline(pairs)).distinct()
