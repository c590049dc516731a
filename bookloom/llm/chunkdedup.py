"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts every text where its upper bits
are zero, so cuts depend on nearby bytes only and come back into step within a
chunk after an insertion.  A cut too near the one before is dropped, a chunk
beyond the largest size is split, and cuts never fall inside a character.
Chunks are known by a digest of 128 bits, two rolling hashes of their bytes.  A chunk that occurs elsewhere is
repeated; of each run of repeated chunks of at least ``min_run`` bytes, those
that have an earlier occurrence (by document, then offset) are removed.  Short
runs, common phrases of a few words, are left alone, also inside a first copy.

Scale: texts are chunked twice.  The first pass counts half digests, 16 bytes a
chunk and pre-aggregated; the second keeps places of chunks whose half digest
occurs again, picked out by a bit set of bounded size, and only those are
shuffled further.  Counts are pre-aggregated by digest and the join back is one
that Spark can split, so a passage that a third of all documents share is no
hot spot.  Texts are shuffled only for documents that lose something.

Defined cases: null text stays null and has no chunks; empty text has none
either; rows with equal id and text count as one document; of equal chunks in a
text the first is the earlier one; a null id comes before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import _bytes
from ._common import repeats, saved, split_by_keys

#: Cuts fall at one byte in 2 ** CUT_BITS; sizes in bytes.
CUT_BITS, SMALLEST, LARGEST = 4, 8, 512
#: Bytes that a run of repeated chunks must have (some 10 words).
MIN_RUN = 60

#: Byte values of the two hashes that make a digest.
_HALVES = (_bytes._splitmix(256, 505), _bytes._splitmix(256, 606))

_GEAR = (_bytes._splitmix(256, 404) >> np.uint64(32)).astype(np.uint32)
#: Of a 32-bit sum of the last 16 bytes, bits that all 16 have a part in.
_MASK = np.uint32(((1 << CUT_BITS) - 1) << 16)


def cuts(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks of all texts in order, and the starts' offsets by text."""
    n = len(b)
    h = _GEAR[b]
    for step in (1, 2, 4, 8):  # the sum over 2, 4, 8, 16 bytes
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step)
        h = g
    at = np.flatnonzero((h & _MASK) == 0) + 1
    # the window must lie inside its text
    text = np.searchsorted(offsets, at - 1, "right") - 1
    at = at[(at - offsets[text] >= 16) & (at < offsets[text + 1])]
    for _ in range(3):  # on to the next character's first byte
        inside = (at < n) & ((b[np.minimum(at, n - 1)] & 0xC0) == 0x80)  # the end is no place inside, whatever byte is last
        at = at + inside
    text = np.searchsorted(offsets, at - 1, "right") - 1
    at = np.unique(at[at < offsets[text + 1]])
    edges = offsets[:-1][np.diff(offsets) > 0]
    # by the distance to the cut before as found, kept or not: nothing farther away matters
    all_before = np.concatenate((at, edges))
    all_before.sort()
    before = all_before[np.maximum(np.searchsorted(all_before, at, "left") - 1, 0)]
    at = at[at - before >= SMALLEST]
    starts = np.unique(np.concatenate((at, edges)))
    length = np.diff(np.append(starts, n))
    long = length > LARGEST
    if long.any():
        more = [np.arange(s + LARGEST, s + k, LARGEST) for s, k in zip(starts[long], length[long], strict=True)]
        more = np.concatenate(more)
        for _ in range(3):
            more = more + ((b[np.minimum(more, n - 1)] & 0xC0) == 0x80)
        starts = np.unique(np.concatenate((starts, more[more < n])))
    return starts, np.searchsorted(starts, offsets)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, t, h1, h2, start, size) of every chunk, in bytes; ``t`` is the text's hash, h1 and h2 the digest."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = _bytes.text_bytes(batch.column(2))
            for i, j in _bytes.blocks(offsets):
                o = offsets[i : j + 1] - offsets[i]
                own = b[offsets[i] : offsets[j]]
                if not len(own):
                    continue
                starts, by_text = cuts(own, o)
                ends = np.append(starts[1:], len(own))
                n = np.diff(by_text)
                row = pa.array(np.repeat(np.arange(i, j), n))
                halves = [pa.array(_bytes.span_hash(_bytes.prefix(own, False, h), starts, ends).view(np.int64)) for h in _HALVES]
                place = [pa.array(starts - np.repeat(o[:-1], n)), pa.array((ends - starts).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *halves, *place], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, h1 long, h2 long, start long, size int")


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, t, repeated, spans) of documents with a repeated passage.

    ``repeated`` counts bytes in runs of repeated chunks, first occurrences
    too; ``spans`` (start, end) in bytes are to be removed, merged and sorted.
    """
    own = docs.select("doc_id", "text").where("text is not null")
    counted = chunks(own).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
    twice = saved(counted.where("n > 1").select("h1"), "chunk_digests")
    # only rows of an id that occurs again can be equal
    again = saved(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "chunk_ids")
    maybe, single = split_by_keys(own, again, ["doc_id"])
    spots = [split_by_keys(chunks(x), twice, ["h1"])[0] for x in (maybe, single)]
    found = repeats(saved(spots[0].distinct().unionByName(spots[1]), "chunks"), ["h1", "h2"], ["doc_id", "t", "start"])
    doc = Window.partitionBy("doc_id", "t").orderBy("start")
    # a run goes on as long as each chunk starts where the one before ends
    new = F.coalesce(F.lag(F.col("start") + F.col("size")).over(doc) != F.col("start"), F.lit(True))
    runs = found.select("doc_id", "t", "start", "size", "__bl_first", new.cast("int").alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    # a common phrase inside a first copy isn't removed: what goes must be as long by itself
    turn = F.coalesce(F.lag("__bl_first").over(doc) != F.col("__bl_first"), F.lit(True)) | (F.col("new") == 1)
    runs = runs.withColumn("part", F.sum(turn.cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("part_size", F.sum("size").over(Window.partitionBy("doc_id", "t", "part")))
    whole = runs.withColumn("run_size", F.sum("size").over(Window.partitionBy("doc_id", "t", "run"))).where(F.col("run_size") >= min_run)
    gone = F.when(~F.col("__bl_first") & (F.col("part_size") >= min_run), F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    by_doc = whole.groupBy("doc_id", "t").agg(F.sum("size").alias("repeated"), F.sort_array(F.collect_list(gone)).alias("spans"))
    return by_doc


def _left(text, spans):
    """The text without the byte spans."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    piece = lambda raw: lambda a, z: F.decode(F.substr(raw, (a + 1).cast("int"), (z - a).cast("int")), "UTF-8")
    # the bytes are bound once, not made anew for each piece
    return F.transform(F.array(F.encode(text, "UTF-8")), lambda raw: F.array_join(F.zip_with(ends, starts, piece(raw)), ""))[0]


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_repeated, n_removed, spans, text), a row per row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    spans = saved(repeated_spans(rows, min_run), "chunk_spans")
    maybe, clean = split_by_keys(rows, spans, ["doc_id", "t"])
    s = spans.withColumnsRenamed({"doc_id": "sid", "t": "st"})
    maybe = maybe.join(s, maybe["doc_id"].eqNullSafe(s["sid"]) & (maybe["t"] == s["st"]), "left").drop("sid", "st")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    both = maybe.unionByName(clean.withColumns({"repeated": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<struct<start:bigint,end:bigint>>")}))
    both = both.withColumn("spans", F.coalesce("spans", none))
    return both.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce("repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        "spans",
        F.when(F.size("spans") == 0, F.col("text")).otherwise(_left(F.col("text"), F.col("spans"))).alias("text"),
    )
