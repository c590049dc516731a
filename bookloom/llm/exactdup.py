"""Exact deduplication as a stateful stream.

A stream over the document files keeps, in RocksDB state without expiry, one
entry per digest of a normalised text (A-Z lower-cased): the largest id, the
number of texts and the locator (file and row) of the text that stays.  The
state is then read as a table.  Digests seen more than once are hits: the full
bytes of all their texts are compared, and if any differ, the groups of that
digest are formed anew by their full texts.

Scale: the stream pre-aggregates before its shuffle, so a group that holds a
third of all rows arrives as a few partial counts; the shuffle and the state
hold digests, not texts.  One further pass writes the digest of each row, and the
text where it may be a hit's (a bit set of bounded size tells).  Of these texts
each task sends the least and the greatest by digest, so a hot digest is no hot
spot; Spark may split the last join where a digest is hot.  The stream goes on
from its checkpoint with files that arrive later.
Only DataFrame functions are used.

Defined cases: null text counts as empty; null ids are never preferred, and a
group of null ids only has a null ``keep_id`` and keeps all its rows; rows with
the id that stays and its text are all kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, marked_by_keys, saved, scratch, settings

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores needn't reserve disk
}


#: A file is streamed however much older than the newest it is.
_NEVER = "36500d"


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _norm(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def run_stream(spark: SparkSession, path: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> None:
    """Bring the state under ``checkpoint`` up to date with the Parquet files at ``path``."""
    with settings(spark, _STATE):
        # as a glob, for a stream's plain path must be a folder
        rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFileAge", _NEVER).parquet(f"{path[:-1]}[{path[-1]}]")
        seen = rows.select(
            F.col(doc_id).cast("long").alias("id"),
            digest(_norm(text)).alias("digest"),
            F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("locator"),
        )
        kept = seen.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.max_by("locator", "id").alias("locator"))
        kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep_id, n, locator), as the stream's state holds them."""
    rows = spark.read.format("statestore").load(checkpoint)
    names = [f.name for f in rows.schema["value"].dataType.fields][:3]  # in the order of the aggregates
    return rows.select("key.digest", *[F.col("value")[a].alias(b) for a, b in zip(names, ("keep_id", "n", "locator"), strict=True)])


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    With the ``checkpoint`` of an earlier call only new files are streamed,
    however old; rows that the state lacks are an error.  A
    weaker ``digest`` changes nothing in the result; it makes more hits.
    """
    checkpoint = checkpoint or scratch(spark, "dedup_state")
    run_stream(spark, path, checkpoint, doc_id, text, digest)
    known = saved(state(spark, checkpoint), "dedup_known")
    docs = spark.read.parquet(path).select(F.col(doc_id).cast("long").alias("doc_id"), _norm(text).alias("norm"))
    docs = docs.withColumn("digest", digest(F.col("norm")))
    hits = saved(known.where("n > 1").select("digest"), "dedup_hits")
    # one pass: digests of all rows, and the texts of those that may be hits
    sha = [] if digest is sha256 else [F.sha2(F.col("norm").cast("binary"), 256).alias("sha")]
    docs = marked_by_keys(docs, hits, ["digest"], "hit").select("doc_id", "digest", *sha, F.when(F.col("hit"), F.col("norm")).alias("norm"))
    docs = saved(docs, "dedup_rows")
    streamed = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if streamed < (there := docs.count()):
        raise ValueError(f"the state under {checkpoint} has {streamed} of {there} rows of {path}")
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.col("sha")

    # a digest's texts are all equal if the least and the greatest of them are
    ends = docs.where("norm is not null").groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    collided = saved(ends.where("least <> greatest").select("digest"), "dedup_collisions")

    names = ["doc_id", "keep_id", "group_size", "text_sha256"]
    by_digest, apart = docs, None
    if not collided.isEmpty():
        by_digest, apart = docs.join(collided, "digest", "left_anti"), docs.join(collided, "digest", "left_semi")
    size = F.coalesce("n", F.raise_error(F.lit("a text of the table is missing from the state")).cast("long"))
    out = by_digest.select("doc_id", "digest", sha.alias("text_sha256")).join(known, "digest", "left").withColumn("group_size", size).select(names)
    if apart is not None:
        groups = apart.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(apart.select("doc_id", "norm", sha.alias("text_sha256")).join(groups, "norm").select(names))
    return out.select(*names[:3], F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
