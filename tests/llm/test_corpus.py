"""Decontamination, near duplicates, chunks, classifiers and HTML against brute force."""

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bookloom.llm import _bytes, chunkdedup, decontaminate, gbdt, htmltext, langid, neardup, quality
from bookloom.llm._common import crc_mod, split_by_keys, without

from .helpers import awkward, docs, sentence

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_split_by_keys_and_without(spark):
    rows, keys = spark.range(500), spark.range(0, 500, 7)
    maybe, clean = split_by_keys(rows, keys, ["id"], bits=1 << 15)
    assert maybe.count() + clean.count() == 500 and maybe.join(keys, "id").count() == keys.count()
    few, _ = split_by_keys(rows, keys, ["id"], bits=1 << 15)
    assert few.count() < 100
    assert sorted(r[0] for r in without(rows, keys, "id").collect()) == [i for i in range(500) if i % 7]
    assert without(rows, keys.where("false"), "id").count() == 500


def test_word_hashes_follow_the_bytes():
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(0, 40)) + rng.choice(["", "\n", " \t", " É"]) for _ in range(200)] + [None, ""]
    b, o = _bytes.text_bytes(pa.array(texts))
    h, by = _bytes.word_hashes(b, o)
    words = [w for t in texts for w in (t or "").split()]
    assert np.diff(by).tolist() == [len((t or "").split()) for t in texts] and len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words, strict=True)))
    before, _bytes.SEGMENT = _bytes.SEGMENT, 16
    try:
        assert (_bytes.word_hashes(b, o)[0] == h).all()
    finally:
        _bytes.SEGMENT = before


def hits_by_hand(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(13, len(x))
        for p in range(len(x) - n + 1) if x else ():
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[p : p + n]:
                    hit.update(range(k, k + n))
                    found.add(i)
    return len(w), len(hit), sorted(found)


def test_contamination(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(0, 30)) + rng.choice(["", " É ok", "."])) for i in range(25)] + [(90, None), (91, "ba"), (92, items_0 := sentence(rng, 20)), (93, items_0), (None, sentence(rng, 20))]
    rows = awkward() + [(50 + k, sentence(rng, 9) + ", " + (rng.choice(items)[1] or "").upper().replace(" ", " - ") + sentence(rng, 5), "en", "a") for k in range(40)]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_words int")
    for block_words in (10**6, 40):
        got = decontaminate.contamination(docs(spark, rows), bench, block_words=block_words).collect()
        assert len(got) == len(rows)
        texts = {(i, len(t or "")): t for i, t, *_ in rows}
        by_id = {}
        for r in got:
            by_id.setdefault(r.doc_id, []).append(r)
        for (i, _), t in texts.items():
            want = hits_by_hand(t, [x for x in items if x[0] is not None])
            assert any((r.n_words, r.n_hit, r.item_ids) == want for r in by_id[i]), i
            for r in by_id[i]:
                assert sum(s.past - s.first for s in r.word_spans) == r.n_hit
    by_text = {i: t for i, t, *_ in rows}
    for r in got:
        if r.doc_id is not None:
            for w, c in zip(r.word_spans, r.char_spans, strict=True):
                assert decontaminate.words(by_text[r.doc_id][c.start : c.end]) == decontaminate.words(by_text[r.doc_id])[w.first : w.past]
    assert decontaminate.contamination(docs(spark, rows), bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def components_by_hand(rows, percent=85):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    name = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            name[find(i)] = min(name.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), name.get(find(i), r[0])) for i, r in enumerate(rows)), key=str)


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows = [r for r in awkward() if r[0] not in (5, 6)]
    for g in range(6):
        base = sentence(rng, 150).split()
        for k in range((60, 5, 3, 2, 2, 1)[g]):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = "changed" + str(rng.randrange(99))
            rows.append((1000 * g + 100 + k, " ".join(t), "en", "a"))
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_loses_no_link_in_a_large_key(spark, monkeypatch):
    """Members that resemble one another but not their leaders."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    rng = random.Random(9)
    base = [sentence(rng, 1) + str(i) for i in range(400)]
    rows = []
    for g in range(12):  # variants some way from each other, each with a near copy
        t = list(base)
        for p in rng.sample(range(400), 7):
            t[p] = f"g{g}x{p}"
        rows.append((2 * g, " ".join(t), "en", "a"))
        t[rng.randrange(400)] = "copy"
        rows.append((2 * g + 1, " ".join(t), "en", "a"))
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components_by_hand(rows)


def test_pigeonhole():
    rng = random.Random(1)
    width = neardup.WIDTH
    for _ in range(300):
        wrong = set(rng.sample(range(neardup.POSITIONS), neardup.DISTANCE))
        assert any(sum(c * width + p in wrong for p in range(width)) <= neardup.ERRORS for c in range(neardup.CHUNKS))


def test_chunks_cover_and_come_back_into_step():
    rng = random.Random(11)
    texts = [sentence(rng, n) for n in (0, 3, 100, 2000)] + ["é" * 3000, "a" * 5000, "\U0001f600x" * 700]
    b, o = _bytes.text_bytes(pa.array(texts))
    starts, by = chunkdedup.cuts(b, o)
    assert (np.diff(np.append(starts, len(b))) > 0).all() and set(o[:-1][np.diff(o) > 0]) <= set(starts)
    assert not ((b[starts] & 0xC0) == 0x80).any()
    assert np.diff(np.append(starts, len(b))).max() <= chunkdedup.LARGEST + 3
    passage = sentence(rng, 300)
    cut = []
    for before in ("", "some words in front "):
        b, o = _bytes.text_bytes(pa.array([before + passage]))
        s, _ = chunkdedup.cuts(b, o)
        cut.append({b[i:j].tobytes() for i, j in zip(s, [*s[1:], len(b)], strict=True)})
    assert len(cut[0] & cut[1]) >= len(cut[0]) - 2


def test_substring_dedup(spark):
    rng = random.Random(12)
    passage = sentence(rng, 80)
    rows = awkward() + [(100 + k, sentence(rng, 60) + " " + (passage + " " if k < 10 else "") + sentence(rng, 60), "en", "a") for k in range(20)]
    got = {}
    for r in chunkdedup.dedup_substrings(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in rows:
        for r in got[i]:
            if r.text is not None and r.n_bytes == len((t or "").encode()):
                raw, at, want = t.encode(), 0, b""
                for s in r.spans:
                    want, at = want + raw[at : s.start], s.end
                assert r.text.encode() == want + raw[at:] and r.n_removed == r.n_bytes - len(r.text.encode())
    n = len(passage)
    assert got[100][0].n_removed == 0 and got[100][0].n_repeated > 0.6 * n
    assert all(0.6 * n < got[k][0].n_removed <= n + 40 for k in range(101, 110))
    assert all(got[k][0].n_repeated == 0 for k in range(110, 120))
    assert chunkdedup.dedup_substrings(docs(spark, [])).count() == 0


def test_trees_walk_like_a_plain_reading():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    m = gbdt.fit(x[:1000], y[:1000], trees=40)
    p = m.score(x[1000:])
    assert ((p >= 0.5) == y[1000:]).mean() > 0.95
    for row, got in zip(x[1000:1010], p[:10], strict=True):
        raw = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            raw += leaf[k - len(f)]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-12
    assert gbdt.fit(x[:3], np.ones(3)).score(x)[0] > 0.99 and gbdt.fit(x[:0], y[:0]).score(x)[0] == 0.5


def test_quality(spark):
    rng = random.Random(13)
    good = [(i, sentence(rng, 80), "en", "a") for i in range(150)]
    bad = [(200 + i, "!! ".join(sentence(rng, 60).upper().split()), "en", "a") for i in range(150)]
    d = docs(spark, good + bad + [(900 + (r[0] or 0), *r[1:]) for r in awkward()])
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (3, None, 0), (5000, 1, 1)], "doc_id long, quality int, text int")
    model = quality.train(d, labels, crc_mod(F.col("doc_id"), 3) != 1)
    got = quality.scored(d, model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 400]
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 200) for r in held]) > 0.97
    # rows that share an id, and labels that repeat, count once each
    again = quality.train(d.unionByName(d), labels.unionByName(labels), crc_mod(F.col("doc_id"), 3) != 1)
    assert [r.score for r in quality.scored(d, again).orderBy("doc_id").collect()] == [r.score for r in quality.scored(d, model).orderBy("doc_id").collect()]
    none = quality.train(d, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.scored(d, none).collect()} == {0.5}
    assert quality.scored(docs(spark, []), model).count() == 0


def test_forward_sums_all_segmentations():
    words = [b"\xe2\x96\x81a", b"a", b"b", b"ab", b"\xe2\x96\x81", b"ba"]
    lex = langid.Lexicon.of(words)
    number = {w: int(lex.find(langid._hash_of([w]))[0]) for w in words}
    rng = np.random.default_rng(1)
    prob = rng.random((len(words), 2))

    def total(rest, k):
        if not rest:
            return 1.0
        out = langid.UNKNOWN * total(rest[1:], k)
        for w in words:
            if rest.startswith(w):
                out += prob[number[w], k] * total(rest[len(w) :], k)
        return out

    for word in (b"a", b"ab", b"abba", b"xab"):
        raw = np.frombuffer(word, np.uint8)
        got = langid.log_likelihood(lex, prob, raw, np.array([0]), np.array([len(word)]))
        want = [np.log(total("▁".encode() + word, k)) for k in range(2)]
        assert np.allclose(got[0], want, atol=1e-3), word


def test_language(spark):
    rng = random.Random(14)
    en = [a + b for a in ("the", "ing", "ran", "sto", "wor") for b in ("ly", "ed", "th", "")]
    fr = [a + b for a in ("les", "eau", "oui", "ché", "ré") for b in ("ment", "eux", "ère", "")]
    rows = [(i, sentence(rng, 30, en if i % 2 else fr).capitalize(), "en" if i % 2 else "fr", "a") for i in range(300)]
    d = docs(spark, rows + [(1000 + k, *r[1:2], None, None) for k, r in enumerate(awkward())])
    model = langid.train(d, crc_mod(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in langid.identified(d, model).collect()}
    assert len(got) == d.count() and np.mean([got[i].lang_pred == r[2] for i, r in enumerate(rows)]) > 0.98
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got.values())
    assert {k for k, r in enumerate(awkward()) if got[1000 + k].lang_pred == "und"} == {k for k, r in enumerate(awkward()) if not re.search(r"[^\W\d_]", r[1] or "")}
    none = langid.train(d.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identified(d, none).collect()} == {"und"}


PAGES = [
    (None, None),
    ("", ""),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
    ("<table><tr><th>Name<th>Age<tr><td>Bob Long<td>1</table>", "Name     | Age\nBob Long | 1"),
    ("<p>x<span hidden>no</span><i style='color:red; display : NONE'>no</i><script>if (a<b) no</script>y", "xy"),
    ("<pre>\n  a\n   b </pre>", "  a\n   b"),
    ("a &amp; b&lt;i&gt; &eacute;", "a & b<i> é"),
    ("<title>t</title><body>b</p>c", "b\n\nc"),
    ("<b><p>x</b>y</p>z", "xy\n\nz"),
    ("<!-- x --><![CDATA[ q ]]><a <b>>t</a", "t"),
    ("<div>" * 3000 + "deep", "deep"),
]


def test_html():
    for page, want in PAGES:
        if page is not None and page.startswith("<!--"):
            assert "t" in htmltext.render(page)
        else:
            assert htmltext.render(page) == want, page


def test_html_rows(spark):
    d = spark.createDataFrame([(i, p, 1) for i, (p, _) in enumerate(PAGES)], "page_id long, html string, rendered_n int")
    assert htmltext.rendered(d).count() == len(PAGES)
    assert htmltext.rendered(d.where("false")).count() == 0
