"""Command line: text files and folders to EPUB files.

python -m bookloom.cli PATH... [-o DIR] [--title T] [--author A] [--language L]
                       [--cover FILE] [--no-clean] [--no-chapters] [-q]

An EPUB goes beside its text unless -o names a folder.  With several files,
those too small for a book are skipped, and title, author and cover are found
rather than given.
Exit status: 0 all done, 1 some book failed, 2 wrong usage or no text file.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as K
from .plans import convert
from .sources import files, sinks


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="bookloom")
    p.add_argument("paths", nargs="+")
    p.add_argument("-o", "--output-dir")
    p.add_argument("--title")
    p.add_argument("--author")
    p.add_argument("--cover")
    p.add_argument("--language", default=K.LANGUAGE)
    p.add_argument("--no-clean", action="store_true")
    p.add_argument("--no-chapters", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p.parse_args(argv)


def _say(line: str, status: str = "failed", quiet: bool = False) -> None:
    if status in ("warned", "failed"):
        print(line, file=sys.stderr)
    elif not quiet:
        print(line)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    folders = [p for p in a.paths if os.path.isdir(p)]
    texts = [p for p in a.paths if p not in folders and p.lower().endswith(".txt")]
    for p in a.paths:
        if p not in folders and p not in texts and "://" not in p:
            _say(f"{p}: no text file")
    far = [p for p in a.paths if "://" in p and p not in texts]
    missing = [p for p in dict.fromkeys(texts) if "://" not in p and not os.path.exists(p)]
    found = [*folders, *far, *(p for p in texts if p not in missing)]

    spark = spark or SparkSession.builder.appName("bookloom").getOrCreate()
    listing = files.list_texts(spark, found) if found else None
    n = (listing.count() if found else 0) + len(missing)
    if not n:
        _say("no text files")
        return 2
    batch = n > 1
    if batch and (a.title or a.author or a.cover):
        _say("--title, --author and --cover are for a single file")
        return 2

    counts: Counter[str] = Counter()
    for p in missing:
        counts["failed"] += 1
        _say(f"{p}: no such file")
    if found:
        books = files.read_texts(spark, found, skip_tiny=batch)
        books = books.withColumn("folder", F.lit(a.output_dir) if a.output_dir else files.folder_of(F.col("path")))
        beside = sorted({os.path.dirname(p) or "." for p in found if p not in [*folders, *far]})
        if a.cover:
            with open(a.cover, "rb") as f:
                books = books.withColumn("cover", F.lit(f.read())).withColumn("cover_type", F.lit(a.cover.rpartition(".")[2].lower()))
        else:
            books = files.with_covers(books, [*folders, *far], beside)
        taken = None
        if a.output_dir:
            os.makedirs(a.output_dir, exist_ok=True)
            taken = files.list_epubs(spark, [], [a.output_dir]).withColumn("folder", F.lit(a.output_dir))
        elif not far:
            taken = files.list_epubs(spark, folders, beside)
        made = convert.convert(books, not a.no_clean, not a.no_chapters, a.title, a.author, a.language, taken)
        done = sinks.write_epubs(made).select("path", "status", "message")
        if batch:
            done = done.unionByName(convert.skipped(listing.where(~files.big_enough(F.col("length")))))
        done = done.withColumn("file", F.element_at(F.split("path", "/"), -1)).persist()
        counts.update({r.status: r.n for r in convert.summary(done).collect()})  # all books are written here, in parallel
        for r in done.toLocalIterator():
            _say(f"{r.file}: {r.message}", r.status, a.quiet)
        done.unpersist()
    if batch and not a.quiet:
        print(", ".join(f"{counts[s]} {s}" for s in ("done", "warned", "skipped", "failed")))
    return int(counts["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
