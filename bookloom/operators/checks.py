"""Quality checks of a converted book, each pass, warn or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T
from . import headings, metrics, normalize

RANK = ["pass", "warn", "fail"]


def worst(*status: Column) -> Column:
    return F.get(F.array(*map(F.lit, RANK)), F.greatest(*[F.array_position(F.array(*map(F.lit, RANK)), s) for s in status]) - 1)


def _status(ok: Column, bad: str) -> Column:
    return F.when(ok, "pass").otherwise(bad)


def built(error: Column) -> Column:
    """The status of a book's EPUB file from its error."""
    return _status(error.isNull(), "fail")


def own() -> list[Column]:
    """The number of chapters and the checks of a book by itself, from its columns ``text``, ``cleaned`` and ``chapters``."""

    def share(stripped: Column) -> Column:
        saved = F.aggregate(F.regexp_extract_all(stripped, F.lit("--+"), F.lit(0)), F.lit(0), lambda n, m: n + F.length(m) - 1)
        return F.coalesce(F.try_divide(T.nonspace(F.col("cleaned")).cast("double"), (T.nonspace(stripped) - saved).cast("double")), F.lit(1.0))

    kept = T.let(normalize.strip_boilerplate(F.coalesce(F.col("text"), F.lit(""))), share)
    n = F.size("chapters")
    odd = F.exists("chapters", lambda c: headings.short_words_only(T.strip(c["title"])) & ~headings.is_explicit(T.strip(c["title"])))
    return [
        n.alias("n_chapters"),
        _status(kept >= K.KEPT_CHARS, "fail").alias("preserved"),
        _status(~F.col("cleaned").contains("--"), "fail").alias("dashes"),
        _status(~F.col("cleaned").contains("\n\n\n\n"), "warn").alias("newlines"),
        _status(n >= 1, "fail").alias("has_chapters"),
        _status(~odd, "warn").alias("titles"),
        _status(metrics.coverage(F.col("chapters"), F.col("cleaned")) >= K.COVERAGE, "warn").alias("coverage"),
    ]


def check(books: DataFrame, expected: DataFrame | None = None, epubs: DataFrame | None = None) -> DataFrame:
    """A row per book of raw text, cleaned text and chapters, with the status of each check.

    ``expected`` (book_id, lo, hi) holds known ranges of chapter counts, and
    ``epubs`` (book_id, error) what became of the books' EPUB files; a book that
    isn't among them has no file and fails.
    """
    rows = books.select("book_id", *own())
    if epubs is None:
        rows = rows.withColumn("epub", F.lit("pass"))
    else:
        files = epubs.select(F.col("book_id").alias("__b"), F.col("error").isNull().alias("__ok"))
        rows = rows.join(files, F.col("book_id").cast("string") == F.col("__b").cast("string"), "left").withColumn("epub", _status(F.coalesce("__ok", F.lit(False)), "fail")).drop("__b", "__ok")
    return judged(rows, expected)


def judged(rows: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(book_id, n_chapters, the status of each check, the worst) from rows of book_id, what ``own`` gives, and ``epub``."""
    if expected is None:
        rows = rows.withColumn("expected", F.lit("pass"))
    else:
        rows = rows.join(expected.select("book_id", "lo", "hi"), "book_id", "left").withColumn("expected", _status(F.coalesce(F.col("n_chapters").between(F.col("lo"), F.col("hi")), F.lit(True)), "warn")).drop("lo", "hi")
    names = ["preserved", "dashes", "newlines", "has_chapters", "titles", "coverage", "expected", "epub"]
    return rows.select("book_id", "n_chapters", *names, worst(*[F.col(c) for c in names]).alias("worst"))
