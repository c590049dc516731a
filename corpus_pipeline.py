"""The corpus pipeline: five stages, each a table written and read again.

Each stage takes all documents that the one before kept and returns them with
the columns of ``documents``; the last returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm import decontaminate, linededup, mixing, neardup, quality
from bookloom.llm._common import crc_mod, saved, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (score 0.5 or more)."""
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(docs, model, to="__bl_score").where("__bl_score >= 0.5").drop("__bl_score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages of lines; ``n_chars`` follows the text."""
    cut = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__bl_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows, written with a number each: decisions are by row, whatever the ids are."""
    return saved(docs.withColumn("__bl_row", F.monotonically_increasing_id()), name)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, that with the least id.

    Documents are linked from a similarity of 0.80 of their word shingles on.
    Null ids come last and ties go to the first row.  Rows that share an id but
    are no near duplicates don't touch each other, and rows without words stay.
    """
    rows = _numbered(docs, "near_input")
    found = neardup.near_duplicates(rows, percent=80, scheme=neardup.AT_80, row="__bl_row")
    return without(rows, found.where("not first").select("__bl_row"), "__bl_row").drop("__bl_row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any passage of the benchmark, by row: ids may be null or shared.

    One whole window of a benchmark item is enough for a row to go, however
    long its text is.  Rows of null or empty text stay; without items, all do.
    """
    rows = _numbered(docs, "decontamination_input")
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), doc_id="__bl_row")
    return without(rows, found.where("n_hit > 0").select("doc_id"), "__bl_row").drop("__bl_row")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, how often, and their words."""
    return mixing.mix(docs).where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mix", mix_stage),
]

#: The trees of the first stage aren't SQL, so neither are the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; all but the last are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
