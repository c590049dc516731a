"""Text files, covers, EPUB files and ground truth, read by Spark from any store it reaches."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as K
from ..operators import metadata
from ..shipping import HELD, ship, small_batches

#: Bytes that windows-1252 leaves undefined.
_UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"
#: Characters of windows-1252 at 80-9F, in order; a blank where it has none.
_HIGH = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def list_paths(paths: Column) -> Column:
    """Is a path one of a text file?  Letters of the extension in either case."""
    return paths.rlike(r"(?i)\.txt\z")


def expand(rows: DataFrame, path: str = "path") -> DataFrame:
    """Distinct text files in order of their paths."""
    return rows.where(list_paths(F.col(path))).select(path).distinct().orderBy(path)


def expand_in_order(rows: DataFrame, path: str = "path", order: str = "arg") -> DataFrame:
    """As ``expand`` but by the argument that named a file first, then by path."""
    return rows.where(list_paths(F.col(path))).groupBy(path).agg(F.min(order).alias(order)).orderBy(order, path)


def parse_drop(data: Column) -> Column:
    """Array of paths in a string of blank-separated paths; braces hold paths with blanks, an open one takes the rest."""
    found = F.regexp_extract_all(data, F.lit(r"(\{[^}]*\}?|[^ {][^ ]*)"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.when(x.startswith("{"), F.regexp_replace(x, r"^\{|\}\z", "")).otherwise(x)), lambda x: x != "")


def _cp1252(content: Column) -> Column:
    latin = F.decode(content, "ISO-8859-1")
    return F.translate(latin, "".join(chr(c) for c, x in zip(range(0x80, 0xA0), _HIGH, strict=True) if x != " "), _HIGH.replace(" ", ""))


def decode(content: Column) -> Column:
    """Text of bytes: by their mark UTF-8 or UTF-16, else UTF-8 if valid, else windows-1252 if defined, else UTF-8 with replacements.

    Broken UTF-16 gives replacements.  Null gives null.
    """
    as_text = content.cast("string")
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", F.make_valid_utf8(F.substr(content, F.lit(4)).cast("string")))
        .when(head.startswith("FFFE"), F.decode(F.substr(content, F.lit(3)), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substr(content, F.lit(3)), "UTF-16BE"))
        .when(F.is_valid_utf8(as_text), as_text)
        .when(~F.decode(content, "ISO-8859-1").rlike(_UNDEFINED), _cp1252(content))
        .otherwise(F.make_valid_utf8(as_text))
    )


def big_enough(length: Column) -> Column:
    return length >= K.TINY_BYTES


def _listed(spark: SparkSession, paths: list[str] | str, glob: str, below: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", below).option("pathGlobFilter", glob).load(paths)


def _both(spark: SparkSession, trees: list[str], folders: list[str], glob: str) -> DataFrame:
    """Files in ``folders`` and anywhere under ``trees``, each once."""
    parts = [_listed(spark, p, glob, below) for p, below in ((trees, True), (folders, False)) if p]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).dropDuplicates(["path"])


def list_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, length) of the text files under ``paths``, each once; contents aren't read."""
    return _listed(spark, paths, "*.[tT][xX][tT]").select("path", "length").dropDuplicates(["path"])


def read_texts(spark: SparkSession, paths: list[str] | str, skip_tiny: bool = True) -> DataFrame:
    """(book_id, path, length, text) of the text files under ``paths``; the size filter reaches the scan."""
    files = _listed(spark, paths, "*.[tT][xX][tT]")
    if skip_tiny:
        files = files.where(big_enough(F.col("length")))
    return files.dropDuplicates(["path"]).select(F.col("path").alias("book_id"), "path", "length", decode(F.col("content")).alias("text"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def list_epubs(spark: SparkSession, trees: list[str], folders: list[str]) -> DataFrame:
    """(folder, name) of the EPUB files in ``folders`` and anywhere under ``trees``."""
    path = _both(spark, trees, folders, "*.[eE][pP][uU][bB]").select("path")
    return path.select(folder_of(F.col("path")).alias("folder"), metadata.stem(F.col("path")).alias("name"))


def with_covers(books: DataFrame, trees: list[str], folders: list[str]) -> DataFrame:
    """``books`` with ``cover`` and ``cover_type``: the image beside each text with its stem, or null; images are sought in ``folders`` and anywhere under ``trees``."""
    kinds = ",".join("".join(f"[{c}{c.upper()}]" for c in kind) for kind in K.COVER_TYPES)
    images = _both(books.sparkSession, trees, folders, f"*.{{{kinds}}}")
    found = find_covers(books.select("path"), images.select("path")).where("cover_path is not null").withColumnRenamed("path", "p")
    content = found.join(images.select(F.col("path").alias("cover_path"), F.col("content").alias("cover")), "cover_path")
    kind = F.lower(F.regexp_extract("cover_path", r"\.([^./]+)\z", 1)).alias("cover_type")
    return books.join(content.select("p", "cover", kind), books["path"] == F.col("p"), "left").drop("p")


def find_covers(texts: DataFrame, images: DataFrame) -> DataFrame:
    """(path, cover_path): of images in the same folder with the same stem, the first by type; null if there is none."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*\z", "")
    kind = F.lower(F.regexp_extract("image", r"\.([^./]+)\z", 1))
    own = images.select(F.col("path").alias("image")).withColumn("rank", F.array_position(F.array(*map(F.lit, K.COVER_TYPES)), kind)).where("rank > 0")
    own = own.select("image", "rank", folder(F.col("image")).alias("d"), F.lower(metadata.stem(F.col("image"))).alias("s"), metadata.stem(F.col("image")).alias("exact"))
    t = texts.select("path", folder(F.col("path")).alias("td"), F.lower(metadata.stem(F.col("path"))).alias("ts"), metadata.stem(F.col("path")).alias("te"))
    both = t.join(own, (F.col("td") == F.col("d")) & (F.col("ts") == F.col("s")), "left")
    best = F.min(F.when(F.col("image").isNotNull(), F.struct((F.col("te") != F.col("exact")).alias("o"), "rank", "image")))
    return both.groupBy("path").agg(best.alias("b")).select("path", F.col("b.image").alias("cover_path"))


def read_ground_truth(spark: SparkSession, paths: list[str] | str, suffix: str = ".headings.txt") -> DataFrame:
    """(stem, ord, title): the lines that aren't blank of files named STEM + suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.substr(name, F.lit(1), F.length(name) - len(suffix)).alias("stem"), F.posexplode(F.split(decode(F.col("content")), "\n")).alias("pos", "line"))
    rows = rows.withColumn("title", F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+\z", ""))).where("title <> ''")
    return rows.select("stem", (F.row_number().over(Window.partitionBy("stem").orderBy("pos")) - 1).alias("ord"), "title")


def with_truth(texts: DataFrame, truth: DataFrame) -> DataFrame:
    """Texts that have ground truth, with it: an inner join on the stem, titles in order as ``truth``."""
    titles = truth.groupBy("stem").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("truth"))
    return texts.withColumn("stem", metadata.stem(F.col("path"))).join(titles, "stem")


def spine(z: zipfile.ZipFile) -> list[str]:
    """Documents of an EPUB in reading order."""
    local = lambda e: e.tag.rpartition("}")[2]
    root = ElementTree.fromstring(z.read("META-INF/container.xml"))
    package = next(e.get("full-path") for e in root.iter() if local(e) == "rootfile")
    opf = list(ElementTree.fromstring(z.read(package)).iter())
    by_id = {e.get("id"): e.get("href") for e in opf if local(e) == "item"}
    refs = [by_id.get(e.get("idref")) for e in opf if local(e) == "itemref"]
    return [posixpath.normpath(posixpath.join(posixpath.dirname(package), h)) for h in refs if h]


def epub_documents(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, spine_no, href, html, error): a row per document of each EPUB, or one with the error."""
    ship(files.sparkSession)
    small_batches(files.sparkSession)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        whole = lambda out: pd.DataFrame(out, columns=["k", "spine_no", "href", "html", "error"]).astype({"spine_no": "Int32"})
        for f in frames:
            out, held = [], 0
            for k, c in zip(f["k"], f["c"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(c)) as z:
                        found = [(k, n, h, z.read(h).decode("utf-8", "replace"), None) for n, h in enumerate(spine(z))]
                except Exception as e:  # a broken file is a failed row
                    found = [(k, None, None, None, f"{type(e).__name__}: {e}")]
                out += found
                held += sum(len(x[3] or "") for x in found)
                if held > HELD:
                    yield whole(out)
                    out, held = [], 0
            yield whole(out)

    return files.select(F.col(key).cast("string").alias("k"), F.col(content).alias("c")).mapInPandas(run, "k string, spine_no int, href string, html string, error string").withColumnRenamed("k", key)
