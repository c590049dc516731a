"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case letters, for folding that leaves other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, read by Spark whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster executors would not see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bookloom-"))
            kept = spark.sparkContext.getCheckpointDir()
        found = kept
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under ``bookloom/`` and the application's id: that folder may be dropped when the application has ended."""
    return f"{shared_dir(spark)}/bookloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


@contextmanager
def settings(spark: SparkSession, of: dict[str, str]) -> Iterator[None]:
    """The session with these settings, for a while."""
    before = {k: spark.conf.get(k, None) for k in of}
    try:
        for k, v in of.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A written table needs its shuffles no more: Spark drops their files when the write has ended.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: a lost executor costs at most the reading of this table,
    and every later use sees the same rows.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    with settings(spark, _TIDY):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Series:
    """Tables that replace one another; ``clear`` takes all of them from the disk."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.path, self.number = scratch(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.number += 1
        return saved(df, "", f"{self.path}/{self.number}")

    def clear(self, spark: SparkSession) -> None:
        spark.range(0).write.mode("overwrite").parquet(self.path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of ``doc_id`` modulo ``n`` (null stays null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


#: Bits of the set that ``split_by_keys`` broadcasts, by key, and their least and greatest number (32 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def filter_bits(n: int) -> int | None:
    """Bits for a set of n keys, a power of two; None if it would be so full that it isn't worth its broadcast."""
    bits = LEAST_BITS
    while bits < min(n * BITS_A_KEY, MOST_BITS):
        bits *= 2
    return bits if n < bits else None


def marked_by_keys(rows: DataFrame, keys: DataFrame, on: list[str], to: str, bits: int | None = None) -> DataFrame:
    """``rows`` with ``to``: may the row match ``keys``?  False is sure, true is not; no shuffle of ``rows``.

    A Bloom-like bit set is broadcast as blocks of 4096 bytes joined by block
    number.  Its size follows from the counted keys, up to ``MOST_BITS``; with
    more keys than that all rows may match.  A join on the keys afterwards stays
    exact in any case.  ``keys`` are read twice, so they should be a written
    table.  ``on`` columns compare null-safely, as xxhash64 skips nulls on both
    sides.
    """
    bits = bits or filter_bits(keys.count())
    if bits is None:
        return rows.withColumn(to, F.lit(True))
    place = F.pmod(F.xxhash64(F.lit("bit"), *[F.col(c) for c in on]), F.lit(bits))
    sets = (
        keys.select(place.alias("__bl_p"))
        .groupBy(F.expr("__bl_p div 32768").alias("__bl_block"))
        .agg(F.expr("bitmap_construct_agg(__bl_p % 32768)").alias("__bl_bits"))
    )
    own = rows.withColumn("__bl_p", place).withColumn("__bl_block", F.expr("__bl_p div 32768"))
    byte = "cast(conv(hex(substring(__bl_bits, cast((__bl_p % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    tested = own.join(F.broadcast(sets), "__bl_block", "left").withColumn(
        to, F.expr(f"__bl_bits is not null and ((shiftright({byte}, cast(__bl_p % 8 as int)) & 1) = 1)")
    )
    return tested.drop("__bl_p", "__bl_block", "__bl_bits")


def split_by_keys(rows: DataFrame, keys: DataFrame, on: list[str], bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may match ``keys``, rows that surely don't); see ``marked_by_keys``."""
    tested = marked_by_keys(rows, keys, on, "__bl_in", bits)
    return tested.where("__bl_in").drop("__bl_in"), tested.where("not __bl_in").drop("__bl_in")


def repeats(spots: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """Rows of ``spots`` whose key occurs more than once, with ``__bl_first``: is it the least place?

    The counts are pre-aggregated before the shuffle, and the join back is one
    that Spark can split when a key is hot, so a key that a third of all rows
    share costs no more than any other.
    """
    least = F.min(F.struct(*place))
    known = spots.groupBy(*key).agg(least.alias("__bl_least"), F.count(F.lit(1)).alias("__bl_n")).where("__bl_n > 1")
    return spots.join(known, key).withColumn("__bl_first", F.struct(*place).eqNullSafe(F.col("__bl_least"))).drop("__bl_least")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` isn't among the keys in ``gone`` (one column); rows of a null key stay.

    Only rows that may go are shuffled.
    """
    g = saved(gone.toDF("__bl_gone").where("__bl_gone is not null").distinct(), "gone_keys")
    maybe, clean = split_by_keys(rows.withColumn("__bl_gone", F.col(key)), g, ["__bl_gone"])
    left = maybe.drop("__bl_gone").join(g, F.col(key) == F.col("__bl_gone"), "left_anti")
    return left.unionByName(clean.drop("__bl_gone"))
