"""From raw texts to EPUB: the top-level plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..operators import blocks, chapters, metadata, render


def structure(books: DataFrame, clean: bool = True, detect: bool = True) -> DataFrame:
    """Adds ``cleaned``, ``chapters`` and ``warning`` to books of ``text``."""
    rows = blocks.clean_text(books) if clean else books.withColumn("cleaned", F.coalesce(F.col("text"), F.lit("")))
    rows = chapters.detect_chapters(rows) if detect else chapters.whole_text(rows)
    warning = chapters.structure_warning(F.col("text"), F.size("chapters")) if detect else F.lit(None).cast("string")
    return rows.withColumn("warning", warning)


def described(books: DataFrame, title: str | None = None, author: str | None = None, lang: str = K.LANGUAGE, taken: DataFrame | None = None) -> DataFrame:
    """Adds title, author, lang and a file ``name``, from ``path`` and ``text`` where not given.

    Names are unique by ``folder``, if there is such a column, and not among
    ``taken`` (folder, name).
    """
    head = F.substring("text", 1, K.HEADER_CHARS)
    rows = books.withColumn("title", F.lit(title) if title else metadata.guess_title(F.col("path")))
    rows = rows.withColumn("author", F.lit(author) if author else metadata.author_or_default(metadata.suggest_author(head))).withColumn("lang", F.lit(lang))
    folder = [c for c in ("folder",) if c in books.columns]
    safe = metadata.safe_name(F.lit(title) if title else metadata.guess_title(F.col("path")))
    names = metadata.unique_names(books.select("book_id", *folder, safe.alias("n")), "n", "book_id", "name", *folder, taken=taken.withColumnRenamed("name", "n") if taken is not None else None)
    return rows.join(names.select("book_id", "name"), "book_id")


def status(error: Column, warning: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(warning.isNotNull(), "warned").otherwise("done")


def convert(books: DataFrame, clean: bool = True, detect: bool = True, title: str | None = None, author: str | None = None, lang: str = K.LANGUAGE, taken: DataFrame | None = None) -> DataFrame:
    """(book_id, path, folder, name, n_chapters, epub, error, status, message): done, warned or failed, a row per book of (book_id, path, text) and, if there, folder, cover and cover_type."""
    rows = structure(described(books, title, author, lang, taken), clean, detect)
    rows = rows.withColumn("n_chapters", F.size("chapters"))
    rows = rows if "folder" in rows.columns else rows.withColumn("folder", F.lit(None).cast("string"))
    made = render.build_epub(rows, ("path", "folder", "name", "n_chapters", "warning"))
    return made.select("book_id", "path", "folder", "name", "n_chapters", "epub", "error", status(F.col("error"), F.col("warning")).alias("status"), F.coalesce("error", "warning").alias("message"))


def skipped(files: DataFrame) -> DataFrame:
    """(path, status, message) of files too small for a book."""
    return files.select("path", F.lit("skipped").alias("status"), F.lit(f"smaller than {K.TINY_BYTES} bytes").alias("message"))


def summary(results: DataFrame) -> DataFrame:
    """(status, n) of all books."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
