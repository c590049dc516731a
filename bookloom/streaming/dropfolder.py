"""A drop folder: text files that arrive are structured as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chapters
from ..plans import convert
from ..sources import files


def chapter_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (book_id, chap_no, title, body); structuring is row-local and so needs no state."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    books = found.where(files.big_enough(F.col("length"))).select(F.col("path").alias("book_id"), files.decode(F.col("content")).alias("text"))
    return chapters.chapter_rows(convert.structure(books))


def run(spark: SparkSession, folder: str, to: str, checkpoint: str) -> StreamingQuery:
    """Structure all files that are new since the last run into Parquet at ``to``."""
    out = chapter_stream(spark, folder).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()
