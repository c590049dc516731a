"""Cases whose results are written out, so that a wrong constant fails: rules of headings, blocks, names and metadata."""

import pytest
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators import blocks, chapters, headings, htmlscan, metadata, metrics, normalize, render
from bookloom.sources import files

#: line, index of the explicit pattern, is it a heading
HEADINGS = [
    ("Chapter 1", 0, True), ("CHAPTER XIV. The Storm", 0, True), ("chapter iv", 0, True), ("chapter one", None, False), ("Part II", 1, True), ("BOOK 3: Rome", 2, True),
    ("Prologue", 3, True), ("Epilogue - After", 3, True), ("Appendix", 3, True), ("Conclusion.", 3, True), ("Prefaces", None, False),
    ("1. The Start", 4, True), ("123. Étoile", 4, True), ("1234. The Start", None, False), ("12. lower case", None, False), ("iv. The Fourth of Them", 5, True), ("Act II", 6, True), ("scene 3", 6, True),
    ("1 - The Slow Fuse", 7, True), ("12— x", 7, True), ("XIV", 8, True), ("XIV.", 8, True), ("MMMMMMMM", None, True), ("XIVA", None, True),
    ("I am", None, False), ("To be", None, False), ("“Quoted Title Here”", None, False), ("[Bracketed Words]", None, False), ("(Round Words)", None, False),
    ("Is This It?", None, False), ("Stop That Now!", None, False), ("Some Words;", None, False), ("Other Words:", None, False), ("THE   GAP", None, False), ("THE  GAP", None, True), ("The Road 12", None, False),
    ("Enter Hamlet", None, False), ("Re-enter Ghost", None, False), ("Exeunt All", None, False), ("CORNELIUS. Your Highness", None, False), ("S. VERNON.", None, False), ("THE LONG AND WINDING ROAD.", None, True),
    ("THE CALL", None, True), ("SUNNYVALE, CALIFORNIA", None, False), ("Smith: Yes Sir", None, False), ("The Sentence Ends Here.", None, False), ("The, Comma Title", None, False), ("Single", None, False),
    ("One Two Three Four Five Six Seven Eight", None, True), ("One Two Three Four Five Six Seven Eight Nine", None, False), ("The Fall of the House", None, True), ("The Fall beyond the House", None, False), ("O'er the Hill", None, True),
    ("", None, False), ("A" * 100, None, True), ("A" * 101, None, False),
]


def test_headings(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(HEADINGS)], "i int, s string")
    got = rows.select("i", headings.explicit_index(F.col("s")).alias("k"), headings.is_explicit(F.col("s")).alias("e"), headings.is_heading(F.col("s"), F.lit(True), F.lit(True)).alias("h"), headings.is_heading(F.col("s"), F.lit(True), F.lit(False)).alias("n")).orderBy("i").collect()
    assert [(w, r.k, r.h) for w, r in zip(HEADINGS, got, strict=True) if w[1:] != (r.k, r.h)] == []
    assert all(r.e == (r.k is not None) and not r.n for r in got)


def value(spark, x, f):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]


START, END = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THIS PROJECT GUTENBERG EBOOK X ***"
BODY = "line of text\n" * 20


@pytest.mark.parametrize(
    "f, x, want",
    [
        (normalize.canon_newlines, "a\r\r\nb\r\nc\rd", "a\nb\nc\nd"),
        (normalize.strip_control, "a\x00\x07\tb\x1f\x7f\n", "a\tb\n"),
        (normalize.empty_blank_lines, "a\n \t\nb \n", "a\n\nb \n"),
        (normalize.fold_dashes, "a-b--c-----d", "a-b—c—d"),
        (normalize.strip_illustrations, "x [Illustration: a\nChapter 3 \nb] y [Illustration]", "x Chapter 3 y "),
        (normalize.strip_boilerplate, f"head\n{START}\n{BODY}{END}\ntail", f"\n{BODY}"),
        (normalize.strip_boilerplate, f"head\n{BODY}**End of Project Gutenberg's Etext\ntail", f"head\n{BODY}"),
        (lambda c: normalize.wrap_width(c).cast("string"), "\n".join("x" * n for n in (30, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50)), "50"),
        (lambda c: normalize.wrap_width(c).cast("string"), "x" * 39, None),
        (T.title_case, "o'brien's x2y", "O'Brien'S X2Y"),
        (metadata.guess_title, "/a/my_book--two.v1.txt", "My Book Two.V1"),
        (metadata.safe_name, " It's: a “Tale” of-two ", "Its_a_Tale_of-two"),
        (metadata.safe_name, "?!", "book"),
        (metadata.suggest_author, "Title\n\nBy  Ann B. Author\n", "Ann B. Author"),
        (metadata.suggest_author, "Title\nby\n\nAnn Author\n", "Ann Author"),
        (metadata.suggest_author, "Robert A. Heinlein. Starship Troopers\n", "Robert A. Heinlein"),
        (metadata.suggest_author, "by one two three four five six seven\n", ""),
        (lambda c: metadata.author_or_default(metadata.suggest_author(c)), "x", "Unknown Author"),
        (render.text_to_html, "a & b\nc\n\n\n\n\nd \"q\" 'r'\n\ne", "<p>a &amp; b<br/>c</p>\n<p>&nbsp;</p>\n<p>d &quot;q&quot; &#x27;r&#x27;</p>\n<p>e</p>"),
        (lambda c: htmlscan.norm_key(htmlscan.fold_key(c)), "The ﬁrst—Straße, No. ２", "thefirststrasseno2"),
    ],
)
def test_strings(spark, f, x, want):
    got = value(spark, x, f)
    assert (got.replace("\xa0", "&nbsp;") if isinstance(got, str) else got) == want


def test_clean_text(spark):
    """Joined lines, verse, a hyphenated block and a wrapped one."""
    wrap = "x" * 59 + "."
    text = "Two lines\nof prose here\n\n  verse one\n  verse two\n  verse three\n\n" + "\n".join(["CHAPTER"]) + "\n\n" + "a b\n" * 2
    assert blocks.clean_text(spark.createDataFrame([(1, text)], "book_id int, text string")).first().cleaned == "Two lines of prose here\n\n\nverse one\nverse two\nverse three\n\n\nCHAPTER\n\n\na b a b"
    lines = spark.createDataFrame([([wrap, "Next one begins", "goes on and", "Then ends here", "New start of it"],)], "b array<string>")
    got = lines.select(blocks.split_wrapped(F.col("b"), F.lit(60))).first()[0]
    # full line joins; short line before a capital breaks, but not after a function word or before a small letter
    assert got == f"{wrap} Next one begins goes on and Then ends here\n\nNew start of it"


def detect(spark, text):
    r = chapters.detect_chapters(spark.createDataFrame([(1, text)], "book_id int, cleaned string")).first()
    return [(c.title, c.body) for c in r.chapters]


def test_chapters(spark):
    block = lambda *xs: "\n\n".join(xs)
    assert detect(spark, block("Before", "Chapter 1", "a", "Chapter 2", "b")) == [("Introduction", "Before"), ("Chapter 1", "a"), ("Chapter 2", "b")]
    # a title that occurs three times and isn't explicit is none
    assert detect(spark, block("The Long Road", "a", "The Long Road", "b", "THE LONG ROAD", "c"))[0][0] == "Content"
    assert [t for t, _ in detect(spark, block(*["Chapter 1", "a"] * 3))] == ["Chapter 1"] * 3
    # a list of contents: three headings or more without text; of shorter runs explicit ones stay
    assert [t for t, _ in detect(spark, block("Chapter 1", "Chapter 2", "Chapter 3", "Chapter 1", "a", "Chapter 2", "b"))] == ["Introduction", "Chapter 1", "Chapter 2"]
    assert [t for t, _ in detect(spark, block("The Old House", "Chapter 1", "a"))] == ["Introduction", "Chapter 1"]
    # ten explicit ones, with at least 55 percent of the voters, prevail
    ten = [x for k in range(10) for x in (f"Chapter {k}", "a")]
    others = [x for k in range(8) for x in (f"The Name {'ABCDEFGHI'[k]}x", "b")]
    assert len(detect(spark, block(*ten, *others))) == 10
    assert len(detect(spark, block(*ten, *others, "Another Name", "b"))) == 19
    assert len(detect(spark, block(*ten[:18], *others[:6]))) == 12


def test_scores_and_grades(spark):
    r = spark.createDataFrame([("a", 2, 4, 8), ("b", 0, 0, 0)], "k string, hits int, predicted int, truth int")
    got = {x.k: (x.p, x.r, round(x.f1, 4)) for x in metrics.scores(r, "k").collect()}
    assert got == {"a": (0.5, 0.25, 0.3333), "b": (0.0, 0.0, 0.0), None: (0.5, 0.25, 0.3333)}
    assert [x[0] for x in spark.createDataFrame([(98.0,), (97.9,), (90.0,), (89.9,)], "p double").select(metrics.kept_grade(F.col("p"))).collect()] == ["ok", "warning", "warning", "loss"]
    q = metrics.quantiles(spark.range(10).withColumn("v", F.col("id")), "v").first()
    assert (q.lo, q.p25, q.p50, q.p75, q.p95, q.hi) == (0, 2, 5, 7, 9, 9)
    warn = spark.createDataFrame([("x" * 50_000,), ("\n".join(["x" * 99] * 500 + ["y"]),), ("x" * 49_999,), (" \n" * 30_000,)], "t string").select(chapters.structure_warning(F.col("t"), F.lit(1)).alias("w")).collect()
    assert "50000 chars" in warn[0].w and "No line matched" in warn[1].w and warn[2].w is warn[3].w is None


def test_unique_names(spark):
    rows = [(1, "a"), (2, "a"), (3, "a_2"), (4, "a"), (5, "b"), (6, "b"), (7, "a_2"), (8, "c_02"), (9, "c"), (10, "c")]
    df = spark.createDataFrame(rows, "id long, n string").repartition(5)
    taken = spark.createDataFrame([("b",), ("b_3",), ("a_2_2",)], "n string")
    free = {r.id: r.unique_name for r in metadata.unique_names(df, "n", "id").collect()}
    assert free == {1: "a", 2: "a_3", 3: "a_2", 4: "a_4", 5: "b", 6: "b_2", 7: "a_2_2", 8: "c_02", 9: "c", 10: "c_2"}
    held = {r.id: r.unique_name for r in metadata.unique_names(df, "n", "id", taken=taken).collect()}
    assert held == {**free, 5: "b_2", 6: "b_4", 7: "a_2_3"}
    assert metadata.unique_names(df.where("false"), "n", "id").count() == 0
    many = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit("x_"), (F.col("id") % 40).cast("string"))).alias("n"))
    got = metadata.unique_names(many, "n", "id").collect()
    assert len({r.unique_name for r in got}) == 5000 and {r.unique_name for r in got if r.id == 0} == {"x"}
    apart = spark.createDataFrame([(1, "f", "a"), (2, "g", "a"), (3, "g", "a")], "id long, d string, n string")
    assert {r.id: r.unique_name for r in metadata.unique_names(apart, "n", "id", folder="d").collect()} == {1: "a", 2: "a", 3: "a_2"}


def test_decoding_of_every_high_byte(spark):
    """Single bytes 80 to FF, as windows-1252 where it defines them, else replaced."""
    cases = [b"a" + bytes([k]) for k in range(0x80, 0x100)]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c binary").orderBy("i").select(files.decode(F.col("c"))).collect()]
    want = [c.decode("utf-8", "replace") if c[1] in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else c.decode("cp1252") for c in cases]
    assert got == want
