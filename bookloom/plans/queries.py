"""The registered queries over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as K
from ..functions import text as T
from ..operators import blocks, chapters, checks, headings, htmlscan, metadata, metrics, normalize, render
from ..sources import files
from . import convert
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(c, name: str = "text"):
    return F.md5(c.cast("binary")).alias(f"{name}_md5"), F.length(c).cast("long").alias(f"{name}_chars")


def _normal(expression: str, f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: X.documents(spark, d, expression).select("doc_id", *_digest(f(F.col("text"))))


QUERIES["boilerplate_strip"] = _normal(X.MARKED, normalize.strip_boilerplate)
QUERIES["newline_canon"] = _normal(X.ROUGH, normalize.canon_newlines)
QUERIES["control_strip"] = _normal(X.ROUGH, normalize.strip_control)
QUERIES["blank_line_norm"] = _normal(X.ROUGH_LINES, normalize.empty_blank_lines)
QUERIES["dash_fold"] = _normal(X.ROUGH, normalize.fold_dashes)
QUERIES["canonical_text"] = _normal(X.ROUGH, normalize.canonical)
QUERIES["illustration_strip"] = _normal(X.ILLUSTRATED, normalize.strip_illustrations)
QUERIES["html_render"] = _normal(X.SPACED, render.text_to_html)


@query
def nonws_count(spark, d):
    return X.documents(spark, d, "coalesce(text, '')").select("doc_id", T.nonspace(F.col("text")).cast("long").alias("n"))


@query
def wrap_width(spark, d):
    return X.books(spark, d, X.INDENTED).select("book_id", normalize.wrap_width(F.col("text")).cast("long").alias("wrap"))


@query
def page_mode(spark, d):
    return blocks.with_blocks(X.books(spark, d, X.INDENTED)).select("book_id", F.size("blocks").cast("long").alias("n_blocks"), "page_mode")


@query
def block_features(spark, d):
    b = blocks.block_features(X.books(spark, d, X.INDENTED))
    return b.select("book_id", *[F.col(c).cast("long").alias(c) for c in ("block_no", "n_lines", "indented", "median", "wrap")], "two_line_heading", "uniform", "hyphenated", "page_mode", "kind")


@query
def paragraphs(spark, d):
    p = blocks.paragraphs(X.books(spark, d, X.INDENTED))
    return p.select("book_id", F.col("block_no").cast("long").alias("block_no"), F.col("para_no").cast("long").alias("para_no"), "kind", *_digest(F.col("text")))


@query
def verse_blocks(spark, d):
    return paragraphs(spark, d).where("kind = 'verse'").drop("kind")


@query
def clean_text(spark, d):
    return blocks.clean_text(X.books(spark, d, X.INDENTED)).select("book_id", *_digest(F.col("cleaned")))


@query
def prose_join(spark, d):
    b = F.filter(T.lines(F.col("text")), lambda x: ~T.is_blank(x))
    return X.documents(spark, d, "coalesce(text, '')").select("doc_id", *_digest(blocks.joined(b)))


@query
def wrapped_split(spark, d):
    """Each document, cut after full stops and commas, as one block; the width is its own."""
    docs = X.documents(spark, d, "replace(replace(coalesce(text, ''), '. ', concat('.', {nl})), ', ', concat(',', {nl}))")
    rows = docs.select("doc_id", F.filter(T.lines(F.col("text")), lambda x: ~T.is_blank(x)).alias("b"), normalize.wrap_width(F.col("text")).alias("wrap"))
    return rows.select("doc_id", F.posexplode(F.split(blocks.split_wrapped(F.col("b"), F.col("wrap")), "\n\n")).alias("para_no", "p")).select("doc_id", F.col("para_no").cast("long").alias("para_no"), *_digest(F.col("p")))


@query
def heading_rules(spark, d):
    rows = spark.createDataFrame(list(enumerate(X.LINES)), "i long, line string")
    s = T.strip(F.col("line"))
    return rows.select("i", "line", headings.explicit_index(s).cast("long").alias("explicit_index"), headings.is_heading(s, F.lit(True), F.lit(True)).alias("heading"))


def _structured(spark, d) -> DataFrame:
    return X.books(spark, d, X.STRUCTURED)


def _candidates(spark, d) -> DataFrame:
    rows = _structured(spark, d).withColumn("l", T.lines(F.col("text")))
    return rows.withColumn("c", chapters.candidates(F.col("l")))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("book_id", F.inline("c")).select("book_id", F.col("pos").cast("long").alias("pos"), "title", "explicit", "decor")


@query
def heading_predicate(spark, d):
    return _listed(_candidates(spark, d))


@query
def suppress_repeated(spark, d):
    return _listed(_candidates(spark, d).withColumn("c", chapters.suppress_repeated(F.col("c"))))


@query
def suppress_nondominant(spark, d):
    return _listed(_candidates(spark, d).withColumn("c", chapters.suppress_nondominant(F.col("c"))))


@query
def toc_run(spark, d):
    return _listed(_candidates(spark, d).withColumn("c", chapters.drop_contents(F.col("c"), F.col("l"))))


@query
def chapter_split(spark, d):
    rows = chapters.chapter_rows(chapters.detect_chapters(_structured(spark, d), "text"))
    return rows.select("book_id", F.col("chap_no").cast("long").alias("chap_no"), "title", F.size(T.words(F.col("body"))).cast("long").alias("n_words"), *_digest(F.col("body"), "body"))


@query
def chapter_fallback(spark, d):
    """Each document as a book of its own."""
    docs = X.documents(spark, d, "coalesce(text, '')").withColumn("book_id", F.col("doc_id"))
    rows = chapters.chapter_rows(chapters.detect_chapters(docs, "text"))
    return rows.select(F.col("book_id").alias("doc_id"), F.col("chap_no").cast("long").alias("chap_no"), "title", *_digest(F.col("body"), "body"))


@query
def review_merge(spark, d):
    """Conversations as books whose chapters are turns, of which users' were kept."""
    c = _table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body")).withColumn("kept", F.col("title") == "user")
    out = chapters.merge_reviewed(c, "conv_id", "turn")
    return out.select("conv_id", F.col("chap_no").cast("long").alias("chap_no"), "title", *_digest(F.col("body"), "body"))


@query
def dominant_pattern(spark, d):
    rows = chapters.chapter_rows(chapters.detect_chapters(_structured(spark, d), "text"))
    return chapters.dominant_pattern(rows).select("book_id", F.col("dominant").cast("long").alias("dominant"))


@query
def structure_warning(spark, d):
    """Documents, some made long, some of these with chapters, as books."""
    docs = X.documents(spark, d, X.LONG).withColumn("book_id", F.col("doc_id"))
    found = chapters.detect_chapters(docs, "text")
    return found.select("doc_id", chapters.structure_warning(F.col("text"), F.size("chapters")).alias("warning"))


@query
def author_guess(spark, d):
    docs = X.documents(spark, d, X.AUTHORED).withColumn("head", F.substring("text", 1, K.HEADER_CHARS))
    return docs.select("doc_id", metadata.author_line(F.col("head")).alias("by_line"), metadata.author_title_line(F.col("head")).alias("title_line"), metadata.author_or_default(metadata.suggest_author(F.col("head"))).alias("author"))


@query
def title_guess(spark, d):
    return _table(spark, d, "pages").select("page_id", metadata.stem(F.col("url")).alias("stem"), metadata.guess_title(F.col("url")).alias("title"), metadata.safe_name(F.col("url")).alias("safe"))


@query
def unique_name(spark, d):
    """Names of books of a source, some of which end like numbered ones, some taken."""
    t = _table(spark, d, "documents").withColumn("base", metadata.safe_name(F.concat(F.lit("Book: "), F.coalesce("source", F.lit("")))))
    tail = F.when(F.col("doc_id") % 7 == 3, "_2").when(F.col("doc_id") % 11 == 5, "_4").when(F.col("doc_id") % 13 == 1, "_2_3").otherwise("")
    rows = t.select("doc_id", F.concat("base", tail).alias("name"))
    taken = t.where("doc_id % 50 = 0").select(F.concat("base", F.when(F.col("doc_id") % 100 == 0, "_3").otherwise("")).alias("name"))
    return metadata.unique_names(rows, "name", "doc_id", taken=taken)


@query
def xhtml_chapters(spark, d):
    rows = chapters.chapter_rows(chapters.detect_chapters(_structured(spark, d), "text"))
    return rows.select("book_id", render.chapter_file(F.col("chap_no")).alias("file"), *_digest(render.xhtml(F.col("title"), F.col("body"), F.lit("en")), "page"))


@query
def toc_links(spark, d):
    t = render.toc(chapters.chapter_rows(chapters.detect_chapters(_structured(spark, d), "text")))
    return t.select("book_id", F.array_join(F.transform("toc", lambda x: F.concat(x["file"], F.lit("\t"), x["title"])), "\n").alias("toc"))


def _epubs(rows, keep: tuple[str, ...] = ()) -> DataFrame:
    return render.build_epub(rows.withColumns({"title": F.col("book_id"), "author": F.lit(K.UNKNOWN_AUTHOR), "lang": F.lit("en")}), keep)


@query
def epub_build(spark, d):
    rows = _epubs(convert.structure(_structured(spark, d)))
    return rows.select("book_id", F.octet_length("epub").cast("long").alias("n_bytes"), F.md5("epub").alias("epub_md5"), "error")


@query
def epub_items(spark, d):
    """Headings and paragraphs read back from the built files, in reading order."""
    made = _epubs(convert.structure(_structured(spark, d)))
    docs = files.epub_documents(made.select(F.col("book_id").alias("path"), F.col("epub").alias("content"))).where("href like '%chap_%'")
    found = htmlscan.items(docs.withColumn("key", F.concat_ws("#", "path", F.format_string("%06d", "spine_no"))), "key")
    found = found.select(F.regexp_replace("key", r"#\d+\z", "").alias("book_id"), "key", "ord", "tag", *_digest(F.regexp_replace("text", r"\s+", "")))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("key", "ord")).cast("long")
    return found.select("book_id", n.alias("n"), "tag", "text_md5", "text_chars")


@query
def status_report(spark, d):
    """Documents as files of a batch: skipped if tiny, failed without a source, warned if long and without chapters, else done."""
    rows = X.documents(spark, d, "repeat(coalesce(text, ''), case when doc_id % 5 = 0 then 20 else 1 end)")
    warning = chapters.structure_warning(F.col("text"), F.lit(1))
    error = F.when(F.col("doc_id") % 9 == 0, "broken")
    return convert.summary(rows.select(F.when(files.big_enough(F.octet_length("text")), convert.status(error, warning)).otherwise("skipped").alias("status")))


@query
def converted(spark, d):
    """Documents as text files through the whole plan: names and outcomes."""
    rows = X.documents(spark, d, "coalesce(text, '')").withColumn("source", F.coalesce("source", F.lit("none")))
    books = rows.select(F.col("doc_id").alias("book_id"), F.concat(F.lit("/in/"), "source", F.lit("/my_"), "source", F.lit(".txt")).alias("path"), F.concat(F.lit("/in/"), "source").alias("folder"), "text")
    made = convert.convert(books)
    return made.select(F.col("book_id").cast("long").alias("doc_id"), "folder", "name", (F.col("epub").isNotNull() & (F.col("n_chapters") > 0)).alias("built"))


@query
def page_items(spark, d):
    return htmlscan.strip_boilerplate_items(htmlscan.items(_table(spark, d, "pages"), "page_id"), "page_id")


@query
def norm_para(spark, d):
    return X.documents(spark, d, "coalesce(text, '')").select("doc_id", *_digest(htmlscan.norm_key(htmlscan.fold_key(F.col("text")))))


@query
def title_tokens(spark, d):
    t = htmlscan.title_tokens(htmlscan.fold_key(F.col("text")))
    return X.documents(spark, d, "coalesce(text, '')").select("doc_id", F.size(t).cast("long").alias("n_tokens"), *_digest(F.array_join(t, " ")))


@query
def paragraph_units(spark, d):
    """Paragraphs and verse lines of the cleaned texts as comparison keys, with their counts by book."""
    p = blocks.paragraph_units(blocks.clean_text(X.books(spark, d, X.INDENTED)))
    key = htmlscan.norm_key(htmlscan.fold_key(F.col("unit")))
    counts = p.select("book_id", F.md5(key.cast("binary")).alias("key"), (key != "").alias("some")).groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("some").alias("some"))
    return counts.where("some").drop("some")  # a filter before would have Python fold every unit twice


@query
def prf_labels(spark, d):
    """The toxic mark as a prediction of the quality mark, by source and in total."""
    docs = _table(spark, d, "documents").select("doc_id", "source")
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = _table(spark, d, "labels").join(docs, "doc_id").select("source", one((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("hits"), one(F.col("toxic") == 1).alias("predicted"), one(F.col("quality") == 1).alias("truth"))
    return metrics.scores(rows, "source")


def _two_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = X.documents(spark, d, "coalesce(text, '')").select("doc_id", "source", F.explode(T.lines(F.col("text"))).alias("line"))
    return rows.where("doc_id % 2 = 0").select("source", "line"), rows.where("doc_id % 2 <> 0").select("source", "line")


@query
def multiset_overlap(spark, d):
    """Lines of even documents as predictions of those of odd ones."""
    return metrics.scores(metrics.overlap(*_two_sides(spark, d), "source", "line"), "source")


@query
def multiset_diff(spark, d):
    return metrics.difference(*_two_sides(spark, d), ["source", "line"]).groupBy("source", "side").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


def _titles(spark, d) -> DataFrame:
    """(book_id, truth, predicted): planted and found titles of all books as tokens; books without planted ones have none that is true."""
    found = chapters.detect_chapters(_structured(spark, d), "text")
    planted = _table(spark, d, "documents").where("doc_id % 5 = 0").selectExpr("doc_id", f"{X.sql(X.BOOK, 'spark')} AS book_id")
    planted = planted.groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: F.array(F.lit("chapter"), (F.floor(x / 5) % 40 + 1).cast("string"))).alias("truth"))
    own = F.transform(F.filter("chapters", lambda c: metrics.is_predicted(c["title"])), lambda c: htmlscan.title_tokens(F.lower(c["title"])))
    none = F.array().cast("array<array<string>>")
    both = found.select("book_id", own.alias("predicted")).join(planted, "book_id", "left")
    return both.select("book_id", F.coalesce("truth", none).alias("truth"), "predicted")


@query
def lcs_titles(spark, d):
    """Planted chapters against those found, in order."""
    both = _titles(spark, d)
    hits = metrics.aligned(both, keep=("truth", "predicted"))
    return metrics.scores(hits.select("book_id", "hits", *[F.size(c).cast("long").alias(c) for c in ("truth", "predicted")]), "book_id")


@query
def title_misses(spark, d):
    """The first 15 planted titles missed and found titles false, by book."""
    both = _titles(spark, d)
    return metrics.unmatched(metrics.aligned(both, keep=("truth", "predicted"))).select("book_id", "side", "n", F.concat_ws(" ", "title").alias("title"))


@query
def title_hits(spark, d):
    """Planted titles that some found title begins, without regard to order."""
    both = _titles(spark, d)
    hit = F.filter("truth", lambda t: F.exists("predicted", lambda p: metrics.title_match(t, p)))
    return both.select("book_id", F.size(hit).cast("long").alias("n_hit"), F.size("truth").cast("long").alias("n_truth"))


def _converted(spark, d) -> DataFrame:
    return convert.structure(_structured(spark, d))


@query
def corpus_report(spark, d):
    """Chapters, coverage and the grade of the text kept, by book."""
    pct = metrics.coverage(F.col("chapters"), F.col("text")) * 100
    return _converted(spark, d).select("book_id", F.size("chapters").cast("long").alias("n_chapters"), metrics.coverage(F.col("chapters"), F.col("cleaned")).alias("coverage"), metrics.kept_grade(pct).alias("grade"))


@query
def corpus_quantiles(spark, d):
    return metrics.quantiles(corpus_report(spark, d), "n_chapters")


@query
def corpus_topk(spark, d):
    """The 15 books of most chapters, ties by name."""
    return metrics.top(corpus_report(spark, d), "n_chapters", 15, True).select("book_id", "n_chapters", "n")


@query
def corpus_lowest(spark, d):
    """The 10 documents of least coverage, of those below the threshold, had lines with an x or q been lost."""
    docs = X.documents(spark, d, "coalesce(text, '')")
    left = F.array_join(F.filter(T.lines(F.col("text")), lambda x: ~x.rlike("[xq]")), "\n")
    shares = docs.select("doc_id", metrics.coverage(F.array(F.struct(F.lit("").alias("title"), left.alias("body"))), F.col("text")).alias("coverage"))
    return metrics.top(shares.where(F.col("coverage") < K.COVERAGE), "coverage", 10, False, "doc_id")


@query
def corpus_single(spark, d):
    """The first 10 documents, as books, of a single chapter."""
    return metrics.top(_singles(spark, d).where("n_chapters = 1"), "doc_id", 10, False, "doc_id").select("doc_id", "n")


@query
def corpus_slowest(spark, d):
    """The 5 events of the greatest value, as books of the longest time."""
    e = _table(spark, d, "events").where("value is not null").select("event_id", F.col("value").alias("sec"))
    return metrics.top(e, "sec", 5, True, "event_id")


def _singles(spark, d) -> DataFrame:
    docs = X.documents(spark, d, "case when doc_id % 3 = 0 then concat(coalesce(text, ''), {nl}, {nl}, 'Chapter 2', {nl}, {nl}, 'more') else coalesce(text, '') end").withColumn("book_id", F.col("doc_id"))
    found = chapters.detect_chapters(docs, "text")
    return found.select(F.col("book_id").alias("doc_id"), F.size("chapters").cast("long").alias("n_chapters"), metrics.coverage(F.col("chapters"), F.col("text")).alias("coverage"))


@query
def corpus_flags(spark, d):
    """Documents, as books, of one chapter, of low coverage, or failed."""
    return metrics.flagged(_singles(spark, d).select("n_chapters", "coverage", F.when(F.col("doc_id") % 9 == 0, "broken").alias("error")))


@query
def stress_titles(spark, d):
    """Of the first book: its number of chapters and their first 25 titles."""
    rows = chapters.chapter_rows(chapters.detect_chapters(_structured(spark, d).where(F.col("book_id") == _structured(spark, d).agg(F.min("book_id")).first()[0]), "text"))
    return rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("chap_no", "title"))), 1, 25), lambda c: c["title"]), "\n").alias("titles"))


@query
def common_titles(spark, d):
    """The five commonest repeated titles of each book, ties by first place."""
    rows = chapters.chapter_rows(chapters.detect_chapters(_structured(spark, d), "text"))
    n = rows.groupBy("book_id", "title").agg(F.count(F.lit(1)).alias("n"), F.min("chap_no").alias("first")).where("n > 1")
    k = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("k", k).where("k <= 5").select("book_id", F.col("k").cast("long").alias("k"), "title", "n")


@query
def first_lines(spark, d):
    return metrics.first_lines(X.lines(_structured(spark, d))).select("book_id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "line")


@query
def heading_probe(spark, d):
    return metrics.probe_headings(X.lines(_structured(spark, d))).select("book_id", F.col("pos").cast("long").alias("pos"), "s", "prev_blank", "next_blank")


@query
def quality_checks(spark, d):
    books = _converted(spark, d)
    expected = books.select("book_id", F.lit(5).alias("lo"), F.when(F.col("book_id").endswith("0"), 6).otherwise(500).alias("hi"))
    made = _epubs(books.select("book_id", "chapters", F.struct(*checks.own()).alias("own")), ("own",))  # so books are structured once
    rows = made.select("book_id", "own.*", checks.built(F.col("error")).alias("epub"))
    return checks.judged(rows, expected).withColumn("n_chapters", F.col("n_chapters").cast("long"))


@query
def encoding_sniff(spark, d):
    """Texts written in five encodings and read back."""
    docs = X.documents(spark, d, "coalesce(text, '')")
    raw = """case doc_id % 5 when 0 then encode(text, 'UTF-8') when 1 then concat(x'EFBBBF', encode(text, 'UTF-8')) when 2 then concat(x'FFFE', encode(text, 'UTF-16LE'))
      when 3 then concat(x'FEFF', encode(text, 'UTF-16BE')) else encode(text, 'ISO-8859-1') end"""
    return docs.select("doc_id", *_digest(files.decode(F.expr(raw))))


@query
def tiny_filter(spark, d):
    return X.documents(spark, d, "coalesce(text, '')").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).where(files.big_enough(F.col("n_bytes")))


def _paths(spark, d, form: str) -> DataFrame:
    return _table(spark, d, "pages").selectExpr("page_id", f"{form} AS path")


@query
def expand_paths(spark, d):
    """Paths made of page ids, some repeated, some not of text files."""
    p = _paths(spark, d, "concat('/books/', cast(cast(floor(page_id / 2) as bigint) as string), case page_id % 3 when 0 then '.txt' when 1 then '.TXT' else '.md' end)")
    return files.expand(p.unionByName(p))


@query
def expand_in_order(spark, d):
    """As ``expand_paths``, by the argument that named a file first."""
    p = _paths(spark, d, "concat('/books/', cast(cast(floor(page_id / 2) as bigint) as string), case page_id % 3 when 0 then '.txt' when 1 then '.TXT' else '.md' end)")
    p = p.select("path", ((F.col("page_id") * 7) % 5).alias("arg"))
    found = files.expand_in_order(p.unionByName(p.withColumn("arg", F.col("arg") + 1)))
    return found.withColumn("n", F.row_number().over(Window.orderBy("arg", "path")).cast("long")).select("path", "arg", "n")


@query
def cover_join(spark, d):
    t = _paths(spark, d, "concat('/b/Book', cast(page_id as string), '.txt')")
    i = _paths(spark, d, "concat('/b/', case when page_id % 2 = 0 then 'Book' else 'BOOK' end, cast(page_id as string), '.png')")
    j = _paths(spark, d, "concat('/b/Book', cast(page_id * 3 as string), case when page_id % 5 = 0 then '.bmp' else '.JPG' end)")
    return files.find_covers(t, i.where("page_id % 4 <> 3").unionByName(j))


@query
def drop_paths(spark, d):
    p = _paths(spark, d, "concat('{/a b/', cast(page_id as string), '.txt} c', cast(page_id as string), '.txt  {the rest ', url)")
    return p.select("page_id", F.array_join(files.parse_drop(F.col("path")), "|").alias("paths"))
