"""Operators that SQL can't express, against brute force and round trips; sources, sinks, command line and stream."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bookloom import cli
from bookloom.functions import text as T
from bookloom.operators import blocks, chapters, checks, htmlscan, metadata, metrics, normalize, render
from bookloom.plans import convert
from bookloom.sources import files, sinks
from bookloom.streaming import dropfolder

BOOK = "The Title\nby Ann Author\n\n" + "\n\n".join(f"Chapter {k}\n\n" + "\n".join(f"word{k} line {i} goes on and on until its end is near enough" for i in range(30)) for k in range(1, 6))


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_white_space_is_unicode(spark):
    assert one(spark, " \t\x1c a b \n\x85", T.strip) == "a b"
    assert one(spark, "  \x1f", T.is_blank) and one(spark, "a b", T.nonspace) == 2
    assert one(spark, "o'brien's x2y", T.title_case) == "O'Brien'S X2Y"
    assert one(spark, None, T.strip) is None


def test_awkward_books(spark):
    texts = [None, "", "\n\n\n", " ", "\r\r\n", "one", "Chapter 1", "Chapter 1\n\nChapter 2", "\x00\x07", "x" * 100_000, "\n".join(["a"] * 70), "--", "*** START OF THE PROJECT GUTENBERG EBOOK X ***"]
    rows = convert.structure(spark.createDataFrame(list(enumerate(texts)), "book_id long, text string")).collect()
    assert len(rows) == len(texts) and all(r.cleaned is not None and len(r.chapters) >= 1 for r in rows)
    got = {r.book_id: [(c.title, c.body) for c in r.chapters] for r in rows}
    assert got[0] == got[1] == [("Content", "")] and got[5] == [("Content", "one")] and got[6] == [("Chapter 1", "")]
    empty = spark.createDataFrame([], "book_id long, text string")
    assert convert.structure(empty).count() == 0 and blocks.paragraphs(empty).count() == 0


def test_book(spark):
    r = convert.structure(spark.createDataFrame([("b", BOOK)], "book_id string, text string")).first()
    assert [c.title for c in r.chapters] == ["Introduction"] + [f"Chapter {k}" for k in range(1, 6)]
    assert r.chapters[1].body.startswith("word1 line 0") and "\n" not in r.chapters[1].body


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            hit = bool(b[j]) and a[i][: len(b[j])] == b[j]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + hit)
    return best[-1][-1]


def test_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([[rng.choice("abc") for _ in range(rng.randint(0, 2))] for _ in range(rng.randint(0, 9))] for _ in range(2))
        t, p = metrics.align(a, b)
        assert len(t) == len(p) == lcs(a, b) and t == sorted(set(t)) and p == sorted(set(p))
        assert all(b[j] and a[i][: len(b[j])] == b[j] for i, j in zip(t, p, strict=True))


def test_review_merge(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for book in range(40):
        kept = [rng.random() < 0.4 for _ in range(rng.randint(1, 6))]
        own = [(book, i, f"t{i}", rng.choice(["", f"b{i}"]), k) for i, k in enumerate(kept)]
        rows += own
        done, before = [], []
        for _, _, t, b, k in own:
            pieces = [b] if k else [t, b]
            if k:
                done.append([t, before + pieces])
                before = []
            elif done:
                done[-1][1] += pieces
            else:
                before += pieces
        want |= {(book, n, t, "\n\n".join(x for x in p if x)) for n, (t, p) in enumerate(done or [["Content", before]], 1)}
    df = spark.createDataFrame(rows, "book_id long, chap_no long, title string, body string, kept boolean")
    assert {tuple(r) for r in chapters.merge_reviewed(df).collect()} == want


def test_items_and_their_boilerplate(spark):
    page = "<h1>The Project Gutenberg eBook of X</h1><p>head</p><h2>One <b>&amp;</b> two</h2><p>a<br>b<p>c</p></p><script>no</script><div class='pgmonospaced'>x<br>y<br><br> z</div><p>*** END OF THE PROJECT GUTENBERG EBOOK</p><h2>The Full Project Gutenberg License</h2><p>licence</p>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    found = htmlscan.items(df, "id")
    assert [(r.tag, r.text) for r in found.orderBy("ord").collect()][2:7] == [("h2", "One & two"), ("p", "c"), ("p", "a b"), ("p", "x y"), ("p", "z")]
    assert [r.text for r in htmlscan.strip_boilerplate_items(found, "id").orderBy("ord").collect()] == ["One & two", "c", "a b", "x y", "z"]
    assert one(spark, "ﬁne Straße", lambda c: htmlscan.norm_key(htmlscan.fold_key(c))) == "finestrasse"


def test_epub_round_trip(spark):
    books = convert.structure(spark.createDataFrame([("b", BOOK)], "book_id string, text string")).withColumns({"title": F.lit("A & B"), "author": F.lit("<x>"), "lang": F.lit("en"), "cover": F.lit(b"img"), "cover_type": F.lit("png")})
    made = render.build_epub(books)
    again, r = made.first(), made.first()
    assert r.error is None and again.epub == r.epub
    with zipfile.ZipFile(io.BytesIO(r.epub)) as z:
        assert z.namelist()[0] == "mimetype" and z.read("EPUB/cover.png") == b"img"
    docs = files.epub_documents(made.select(F.col("book_id").alias("path"), F.col("epub").alias("content")).unionByName(spark.createDataFrame([("bad", b"no zip")], "path string, content binary")))
    assert docs.where("path = 'bad'").first().error
    heads = htmlscan.items(docs.where("href like '%chap_%'"), "href").where("tag = 'h1'").orderBy("href")
    assert [x.text for x in heads.collect()] == ["Introduction"] + [f"Chapter {k}" for k in range(1, 6)]
    assert render.build_epub(books.withColumn("title", F.lit(None).cast("string"))).first().error


@pytest.mark.parametrize("n", [1, 999, 1000])
def test_chapter_files(spark, n):
    assert spark.range(1).select(render.chapter_file(F.lit(n))).first()[0] == f"chap_{n:03d}.xhtml"


def test_decoding(spark):
    text = "naïve “quotes” €5 – ok"
    cases = [text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16"), text.encode("cp1252"), b"", b"caf\xe9 \x81"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c binary").orderBy("i").select(files.decode(F.col("c"))).collect()]
    assert got[:4] == [text] * 4 and got[4] == "" and got[5] == b"caf\xe9 \x81".decode("utf-8", "replace")


def test_command_line_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my_book.TXT").write_text(BOOK)
    (tmp_path / "in" / "tiny.txt").write_text("tiny")
    (tmp_path / "in" / "my_book.JPG").write_bytes(b"x")
    (tmp_path / "in" / "s.headings.txt").write_text("One\n\n Two \n")
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "in"), "-o", str(out), "-q"], spark) == 0
    assert [p.name for p in out.iterdir()] == ["My_Book.epub"]
    with zipfile.ZipFile(out / "My_Book.epub") as z:
        assert z.read("EPUB/cover.jpg") == b"x"
    assert cli.main([str(tmp_path / "in"), "--title", "x"], spark) == 2
    assert [tuple(r) for r in files.read_ground_truth(spark, str(tmp_path / "in")).orderBy("ord").collect()] == [("s", 0, "One"), ("s", 1, "Two")]
    books = files.read_texts(spark, str(tmp_path / "in"))
    covers = files.find_covers(books, spark.read.format("binaryFile").load(str(tmp_path / "in" / "*.JPG"))).first()
    assert covers.cover_path.endswith("my_book.JPG")
    assert books.select(metadata.suggest_author(F.col("text"))).first()[0] == "Ann Author"
    assert {r.status: r.n for r in convert.summary(convert.convert(books)).collect()} == {"done": 1}
    sinks.write_report(spark.createDataFrame([("f", 1, 2, 1.0, 0.1, None)], "file string, kb int, chapters int, coverage double, sec double, error string"), str(tmp_path / "r.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).first().chapters == "2"


def test_outcomes_of_the_command_line(spark, tmp_path, capsys):
    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    long = "\n".join(["x" * 200] * 300)
    for name, text in (("my_book.txt", BOOK), ("my-book.txt", BOOK), ("deep/my_book.txt", BOOK), ("flat.txt", long), ("tiny.txt", "tiny")):
        (src / name).write_text(text)
    (src / "My_Book_2.epub").write_bytes(b"there")
    assert cli.main([str(src), str(src / "notes.md"), str(src / "gone.txt")], spark) == 1
    said = capsys.readouterr()
    # beside each text, no name taken
    assert sorted(p.name for p in src.glob("*.epub")) == ["Flat.epub", "My_Book.epub", "My_Book_2.epub", "My_Book_3.epub"] and (src / "My_Book_2.epub").read_bytes() == b"there"
    assert [p.name for p in (src / "deep").glob("*.epub")] == ["My_Book.epub"]
    assert "tiny.txt: smaller than 5120 bytes" in said.out and "3 done, 1 warned, 1 skipped, 1 failed" in said.out
    assert "flat.txt: 1 chapters to" in said.err and "No chapter structure" in said.err and "gone.txt: no such file" in said.err and "notes.md: no text file" in said.err
    assert cli.main([str(src / "notes.md")], spark) == 2
    assert cli.main([str(src / "deep" / "none")], spark) == 2
    # a folder of one file is no batch: a title may be given, and no file is too small
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "t.txt").write_text("tiny")
    (tmp_path / "c.png").write_bytes(b"img")
    assert cli.main([str(tmp_path / "one"), "--title", "Given: One", "--cover", str(tmp_path / "c.png"), "-o", str(tmp_path / "out" / "new")], spark) == 0
    with zipfile.ZipFile(tmp_path / "out" / "new" / "Given_One.epub") as z:
        assert z.read("EPUB/cover.png") == b"img" and b"Given: One" in z.read("EPUB/content.opf")


def test_truth_and_text_by_stem(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.txt").write_text("text")
    (tmp_path / "a.headings.txt").write_text("One\n\n Two \n")
    (tmp_path / "c.headings.txt").write_text("Three")
    got = files.with_truth(files.read_texts(spark, str(tmp_path), False), files.read_ground_truth(spark, str(tmp_path))).collect()
    assert [(r.stem, r.truth) for r in got] == [("a", ["One", "Two"])]


def test_arguments_in_order(spark):
    rows = spark.createDataFrame([("b.txt", 2), ("a.TXT", 2), ("c.txt", 1), ("b.txt", 3), ("d.md", 0)], "path string, arg int")
    assert [r.path for r in files.expand_in_order(rows).collect()] == ["c.txt", "a.TXT", "b.txt"]


def test_heading_draft(spark, tmp_path):
    items = spark.createDataFrame([("x", 0, "h1", "One"), ("x", 1, "p", "text"), ("x", 2, "h2", "Two"), ("y", 0, "h3", "Three")], "path string, ord int, tag string, text string")
    sinks.write_heading_draft(items, str(tmp_path / "draft"))
    got = {d: "".join(p.read_text() for p in sorted((tmp_path / "draft" / f"doc={d}").glob("*.txt"))) for d in "xy"}
    assert got == {"x": "h1\tOne\nh2\tTwo\n", "y": "h3\tThree\n"}


def test_unmatched_titles(spark):
    books = spark.createDataFrame([("b", [["one"], ["two"], ["three", "x"]], [["one"], ["new"], ["three"]]), ("c", [], [["x"]])], "book_id string, truth array<array<string>>, predicted array<array<string>>")
    got = metrics.unmatched(metrics.aligned(books), books, k=1)
    assert sorted((r.book_id, r.side, r.n, r.title[0]) for r in got.collect()) == [("b", "false", 1, "new"), ("b", "missed", 1, "two"), ("c", "false", 1, "x")]


def test_books_without_a_file_fail(spark):
    books = convert.structure(spark.createDataFrame([("b", BOOK), ("c", BOOK), ("d", BOOK)], "book_id string, text string"))
    epubs = spark.createDataFrame([("b", None), ("c", "ValueError")], "book_id string, error string")
    got = {r.book_id: (r.epub, r.worst) for r in checks.check(books, None, epubs).collect()}
    assert got == {"b": ("pass", "pass"), "c": ("fail", "fail"), "d": ("fail", "fail")}


def test_drop_folder_goes_on(spark, tmp_path):
    src, to, cp = (str(tmp_path / x) for x in ("src", "to", "cp"))
    (tmp_path / "src").mkdir()
    for k in range(2):
        (tmp_path / "src" / f"{k}.txt").write_text(BOOK)
        dropfolder.run(spark, src, to, cp).awaitTermination()
        assert spark.read.parquet(to).count() == 6 * (k + 1)


def test_marks_in_the_wrong_half_stay(spark):
    t = "x " * 50 + "\n*** START OF THE PROJECT GUTENBERG EBOOK Q ***\n"
    assert one(spark, t, normalize.strip_boilerplate) == t
