"""Cases in which operators once returned less than the whole."""

import os
import random
import time

import pytest

from bookloom.llm import chunkdedup, exactdup, htmltext, linededup
from bookloom.operators import htmlscan

from .helpers import docs, sentence


@pytest.mark.parametrize("odd", ["<![foo]>", "<![ foo ]>", "<![>", "<![]]>", "<![1 x>"])
def test_text_after_an_unknown_declaration_stays(odd):
    page = f"<p>a</p>{odd}b<p>c</p>"
    text = htmltext.render(page)
    assert text.startswith("a\n\n") and text.endswith("b\n\nc")
    assert htmlscan.items_of(page) == [("p", "a"), ("p", "c")]


def test_exact_dedup_streams_late_files_of_any_age(spark, tmp_path):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    docs(spark, [(1, "A", "en", "a"), (2, "b", "en", "a")]).write.parquet(path)
    exactdup.exact_dedup(spark, path, state).collect()
    before = set(os.listdir(path))
    docs(spark, [(9, "a", "en", "a"), (10, "c", "en", "a")]).write.mode("append").parquet(path)
    old = time.time() - 20 * 86400
    for name in set(os.listdir(path)) - before:
        os.utime(os.path.join(path, name), (old, old))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exactdup.exact_dedup(spark, path, state).collect()}
    assert got == {1: (9, 2), 2: (2, 1), 9: (9, 2), 10: (10, 1)}


def test_exact_dedup_fails_if_rows_are_missing_from_the_state(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    docs(spark, [(1, "A", "en", "a")]).write.parquet(path)
    exactdup.exact_dedup(spark, path, state).collect()
    docs(spark, [(2, "b", "en", "a")]).write.mode("append").parquet(path)
    monkeypatch.setattr(exactdup, "run_stream", lambda *a: None)
    with pytest.raises(ValueError, match="1 of 2 rows"):
        exactdup.exact_dedup(spark, path, state)


def test_substring_dedup_finds_passages_of_just_over_50_words(spark):
    """200 passages of 51 to 60 words, each in two texts that have nothing else in common."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, size = [], {}
    for k in range(200):
        passage = sentence(rng, rng.randint(51, 60), words)
        size[2 * k + 1] = len(passage)
        rows += [(2 * k + d, f"{sentence(rng, 40, words)} {passage} {sentence(rng, 40, words)}", "en", "a") for d in (0, 1)]
    removed = {r.doc_id: r.n_removed for r in chunkdedup.dedup_substrings(docs(spark, rows)).collect()}
    assert not any(removed[i] for i in removed if i % 2 == 0)
    shares = [removed[i] / n for i, n in size.items()]
    print("missed", sum(s == 0 for s in shares), "under half", sum(s < 0.5 for s in shares), "stays", 1 - sum(shares) / len(shares))
    assert sum(s == 0 for s in shares) <= 2 and sum(s < 0.5 for s in shares) <= 4
    assert sum(shares) > 0.8 * len(shares)


def test_line_dedup_splits_a_long_text_once(spark):
    """Once split anew for each line that stays: 16 times the work for 4 times the lines."""
    passage, n = "p one\np two\np three\n", 40_000
    texts = ["".join(f"{word} line {i}\n" for i in range(n)) for word in ("first", "second")]
    cut = linededup.dedup_lines(docs(spark, [(k, passage + t, "en", "a") for k, t in enumerate(texts)]))
    began = time.time()
    got = {r.doc_id: (r.text, r["__bl_lines"], r["__bl_gone"]) for r in cut.collect()}
    took = time.time() - began
    assert got == {0: (passage + texts[0], n + 4, 0), 1: (texts[1], n + 4, 3)}
    assert took < 20
