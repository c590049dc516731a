"""Writers of EPUB files, reports and heading drafts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def write_epubs(books: DataFrame, folder: str | None = None) -> DataFrame:
    """Write each ``epub`` as FOLDER/NAME.epub; gives (book_id, path, status, message).

    The folder is the row's own where none is given; all executors must share
    it.  A status and message that ``books`` has stay, but for what can't be
    written.  A file is written beside its place and then moved, so a task that
    runs again leaves whole files.
    """
    ship(books.sparkSession)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    if r.epub is None:
                        raise ValueError(r.error)
                    to = re.sub(r"^file:/*", "/", folder or r.folder)
                    os.makedirs(to, exist_ok=True)
                    path = os.path.join(to, f"{r.name}.epub")
                    with open(f"{path}.{os.getpid()}.part", "wb") as part:
                        part.write(r.epub)
                    os.replace(f"{path}.{os.getpid()}.part", path)
                    out.append((r.book_id, r.path, r.status, f"{r.n_chapters} chapters to {path}" + (f"; {r.message}" if r.message else "")))
                except Exception as e:  # a book that can't be written is a failed row
                    out.append((r.book_id, r.path, "failed", str(e)))
            yield pd.DataFrame(out, columns=["book_id", "path", "status", "message"])

    rows = books
    for c, x in (("path", F.col("book_id")), ("folder", F.lit(None)), ("status", F.lit("done")), ("message", F.lit(None)), ("n_chapters", F.lit(0))):
        rows = rows if c in rows.columns else rows.withColumn(c, x)
    text = [F.col(c).cast("string").alias(c) for c in ("book_id", "path", "folder", "name", "error", "status", "message")]
    return rows.select(*text, F.col("n_chapters").cast("int"), "epub").mapInPandas(run, "book_id string, path string, status string, message string")


def write_report(rows: DataFrame, path: str) -> None:
    """The corpus report as CSV with a header."""
    rows.select("file", "kb", "chapters", "coverage", "sec", "error").write.mode("overwrite").option("header", True).csv(path)


def write_heading_draft(items: DataFrame, path: str, key: str = "path") -> None:
    """Headings as lines of tag and text, a folder for each document."""
    heads = items.where("tag <> 'p'").select(F.col(key).alias("doc"), "ord", F.concat_ws("\t", "tag", "text").alias("value"))
    heads.repartition("doc").sortWithinPartitions("doc", "ord").select("doc", "value").write.mode("overwrite").partitionBy("doc").text(path)
