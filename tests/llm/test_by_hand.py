"""Chunk dedup, classifier statistics, language model and page layout against plain readings of their definitions."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bookloom.llm import _bytes, chunkdedup, htmltext, langid, quality

from .helpers import awkward, docs, sentence


def cuts_by_hand(raw):
    """Starts of the chunks of one text, byte by byte."""
    gear, mask = [int(x) for x in chunkdedup._GEAR], int(chunkdedup._MASK)
    found = set()
    for i in range(15, len(raw)):
        h = sum(gear[raw[i - d]] << d for d in range(16)) & 0xFFFFFFFF
        if not h & mask:
            at = i + 1
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            if at < len(raw):
                found.add(at)
    before, starts = 0, [0]
    for at in sorted(found):
        if at - before >= chunkdedup.SMALLEST:
            starts.append(at)
        before = at
    out = []
    for s, e in zip(starts, [*starts[1:], len(raw)], strict=True):
        out.append(s)
        for k in range(s + chunkdedup.LARGEST, e, chunkdedup.LARGEST):
            while k < len(raw) and raw[k] & 0xC0 == 0x80:
                k += 1
            if k < len(raw) and k not in out:
                out.append(k)
    return sorted(set(out))


def substrings_by_hand(rows, min_run=chunkdedup.MIN_RUN):
    texts = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    spots, cut = {}, {}
    for i, t in texts:
        raw = t.encode()
        starts = cuts_by_hand(raw)
        cut[i, t] = [(s, e, raw[s:e]) for s, e in zip(starts, [*starts[1:], len(raw)], strict=True)]
        for s, _, c in cut[i, t]:
            spots.setdefault(c, []).append((i, t, s))
    out = {}
    for key, chunks in cut.items():
        runs = []
        for s, e, c in chunks:
            if len(spots[c]) > 1:
                first = spots[c][0] == (*key, s)
                if runs and runs[-1][-1][1] == s:
                    runs[-1].append((s, e, first))
                else:
                    runs.append([(s, e, first)])
        repeated, gone = 0, []
        for run in runs:
            if run[-1][1] - run[0][0] < min_run:
                continue
            repeated += run[-1][1] - run[0][0]
            part = []
            for x in [*run, None]:
                if part and (x is None or x[2] != part[-1][2]):
                    if not part[0][2] and part[-1][1] - part[0][0] >= min_run:
                        gone += [(s, e) for s, e, _ in part]
                    part = []
                part.append(x)
        raw, left, at = key[1].encode(), b"", 0
        for s, e in gone:
            left, at = left + raw[at:s], e
        out[key] = repeated, sum(e - s for s, e in gone), (left + raw[at:]).decode()
    return out


def test_substring_dedup_by_hand(spark):
    rng = random.Random(51)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    shared = [sentence(rng, rng.randint(8, 60), words) for _ in range(12)]
    rows = []
    for k in range(90):
        pieces = [sentence(rng, rng.randint(0, 30), words)]
        for _ in range(rng.randint(0, 4)):
            pieces += [rng.choice(shared), sentence(rng, rng.randint(0, 12), words)]
        rows.append((1000 + k % 80, " ".join(pieces), "en", "a"))
    # texts that are the same in whole but for the places of ties have no order of their own: ids are distinct here but for equal rows
    rows = [(r[0] if k < 80 else 2000 + k, *r[1:]) for k, r in enumerate(rows)] + [rows[3], rows[3]] + [(r[0], *r[1:]) for r in awkward() if r[0] is not None]
    want = substrings_by_hand([r[:2] for r in rows])
    got = chunkdedup.dedup_substrings(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, []).append((len((t or "").encode()), *want.get((i, t), (0, 0, t))))
    for r in got:
        assert (r.n_bytes, r.n_repeated, r.n_removed, r.text) in by[r.doc_id], r.doc_id
    assert sum(r.n_removed > 0 for r in got) > 20
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_cuts_inside_the_last_character_of_all():
    """No step beyond the bytes where the last text ends in a character of several bytes and a cut falls into it."""
    rng = random.Random(53)
    inside = 0
    for k in range(400):
        texts = [sentence(rng, 3) + "é", "", sentence(rng, rng.randint(3, 12)) + "éñ€\U0001f600"[k % 4], *[""] * (k % 3)]
        raw = texts[2].encode()
        b, o = _bytes.text_bytes(pa.array(texts))
        starts, by = chunkdedup.cuts(b, o)
        for i, t in enumerate(texts):
            assert [int(x) - o[i] for x in starts[by[i] : by[i + 1]]] == (cuts_by_hand(t.encode()) if t else [])
        last = len(raw) - len(texts[2][-1].encode())
        gear, mask = [int(x) for x in chunkdedup._GEAR], int(chunkdedup._MASK)
        inside += any(not sum(gear[raw[i - d]] << d for d in range(16)) & mask for i in range(max(15, last), len(raw) - 1))
    assert inside > 20


def test_statistics_by_hand():
    rng = random.Random(52)
    texts = [None, "", " ", "A", "Aa\n\n bB  1!", "É ß \U0001f600", *[sentence(rng, rng.randint(1, 60)).capitalize() + rng.choice(["!", "\n" * 3, " 12 12 12", "#$%"]) for _ in range(40)]]
    got = quality.statistics(pa.array(texts))
    names = quality.NAMES
    for t, row in zip(texts, got, strict=True):
        raw = (t or "").encode()
        n = len(raw)
        share = lambda f: sum(map(f, raw)) / max(n, 1)
        words = "".join(chr(c) for c in raw).split(" ")
        words = [w for x in words for w in x.replace("\n", " ").split(" ") if w]
        lines = [x for x in raw.split(b"\n") if x]
        folded = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
        length = [len(w) for w in words]
        mean = sum(length) / max(len(words), 1)
        ll = [len(x) for x in lines]
        lm = sum(ll) / max(len(ll), 1)
        std = lambda xs, m: math.sqrt(sum((x - m) ** 2 for x in xs) / max(len(xs), 1))
        upper, lower = share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122)
        want = {
            "log_bytes": math.log1p(n),
            "log_words": math.log1p(len(words)),
            "log_lines": math.log1p(len(lines)),
            "upper": upper,
            "lower": lower,
            "digit": share(lambda c: 48 <= c <= 57),
            "white": share(lambda c: c == 32 or 9 <= c <= 13),
            "mark": share(lambda c: 33 <= c < 127 and not chr(c).isalnum()),
            "high": share(lambda c: c >= 128),
            "upper_of_letters": upper * n / max((upper + lower) * n, 1),
            "mark_!": share(lambda c: c == 33),
            "word_mean": mean,
            "word_std": std(length, mean),
            "word_max": math.log1p(max(length, default=0)),
            "distinct_words": len(set(folded)) / len(words) if words else 1,
            "top_word": max(Counter(folded).values(), default=0) / max(len(words), 1),
            "distinct_lines": len(set(lines)) / len(lines) if lines else 1,
            "words_by_line": len(words) / max(len(lines), 1),
            "line_std": std(ll, lm) / max(lm, 1),
            "byte_entropy": -sum(v / n * math.log2(v / n) for v in Counter(raw).values()),
        }
        for name, x in want.items():
            assert row[names.index(name)] == pytest.approx(x, abs=1e-6), (t, name)


def test_long_words_are_summed_over_all_segmentations():
    """Pieces that cross the segments in which long words are taken."""
    words = [b"\xe2\x96\x81a", b"a", b"b", b"ab", "éa".encode(), "é".encode(), b"abbaabba", b"\xe2\x96\x81"]
    lex = langid.Lexicon.of(words)
    number = {w: int(lex.find(langid._hash_of([w]))[0]) for w in words}
    prob = np.random.default_rng(2).random((len(words), 3))
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabbé") for _ in range(n)).encode() for n in (29, 31, 32, 33, 34, 61, 64, 65, 130, 700)]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    got = langid.log_likelihood(lex, prob, raw, np.concatenate(([0], ends[:-1])), ends)
    for t, row in zip(texts, got, strict=True):
        whole = "▁".encode() + t
        for k in range(3):
            log = [0.0]
            for z in range(1, len(whole) + 1):
                terms = [log[z - 1] + math.log(langid.UNKNOWN)]
                terms += [log[z - len(w)] + math.log(prob[number[w], k]) for w in words if z >= len(w) and whole[z - len(w) : z] == w]
                most = max(terms)
                log.append(most + math.log(sum(math.exp(x - most) for x in terms)))
            assert row[k] == pytest.approx(log[-1], rel=1e-9), len(t)


def test_fit_counts_pieces_by_their_share_of_segmentations():
    """Two rounds of expectation maximisation against sums over listed segmentations."""
    words = [b"\xe2\x96\x81a", b"a", b"b", b"ab", b"\xe2\x96\x81", b"ba"]
    lex = langid.Lexicon.of(words)
    number = {w: int(lex.find(langid._hash_of([w]))[0]) for w in words}
    texts, counts = [b"ab", b"abba", b"bab", b"a"], np.array([[3.0, 0], [1, 2], [0, 5], [4, 1]])

    def ways(rest):
        if not rest:
            yield []
            return
        for w in [*words, None]:
            size = 1 if w is None else len(w)
            if w is None or rest.startswith(w):
                for more in ways(rest[size:]):
                    yield [w, *more]

    prob = np.full((len(words), 2), 1 / len(words))
    for _ in range(2):
        seen = np.zeros_like(prob)
        for t, n in zip(texts, counts, strict=True):
            listed = list(ways("▁".encode() + t))
            for k in range(2):
                weight = [math.prod(langid.UNKNOWN if w is None else prob[number[w], k] for w in way) for way in listed]
                for way, x in zip(listed, weight, strict=True):
                    for w in way:
                        if w is not None:
                            seen[number[w], k] += n[k] * x / sum(weight)
        prob = (seen + langid.SMOOTH) / (seen.sum(0) + langid.SMOOTH * len(words))
    assert np.allclose(langid.fit(lex, texts, counts, rounds=2), prob, rtol=1e-9)


def test_words_are_cut_for_fitting_between_characters():
    text = "aé" * 60 + " " + "b" * 10 + "的" * 40 + " short"
    b = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = _bytes.runs(b, np.array([0, len(b)]), langid._GAP)
    parts = [bytes(b[i:j]).decode() for i, j in zip(*langid._cut(b, s, e), strict=True)]
    assert "".join(parts) == text.replace(" ", "") and max(len(p.encode()) for p in parts) <= langid.LONGEST and parts[-1] == "short"


TABLES = [
    ("<tr><td rowspan=2>a<td>b<tr><td>c", ["a | b", "  | c"]),
    ("<tr><td>x<td rowspan=3>yy<td>z<tr><td>1<td>2<tr><td>3<td>4<tr><td>5<td>6<td>7", ["x | yy | z", "1 |    | 2", "3 |    | 4", "5 | 6  | 7"]),
    ("<tr><td colspan=2>wide cell<td>k<tr><td>a<td>b<td>c", ["wide cell | k", "a | b     | c"]),
    ("<tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d", ["a | b", "  | c", "  | d"]),
    ("<tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d", ["a | b", "c | d"]),
    ("<tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d<tr><td>1<td>2<td>3", ["ab    | c", "  |   | d", "1 | 2 | 3"]),
    ("<tr><th>Name<th>Text<tr><td>k<td>" + "w" * 200 + "<tr><td>kk<td>v", ["Name | Text", "k    | " + "w" * 200, "kk   | v"]),
    ("<tr><td>" + "w" * 100 + "<td>b<tr><td>c<td>d", ["w" * 100 + " | b", "c" + " " * 99 + " | d"]),
    ("<tr><td style='visibility:hidden'>a<td>b<tr><td>c<td>d", ["  | b", "c | d"]),
    ("<tr style='visibility:collapse'><td>a<tr><td>c", ["c"]),
]


@pytest.mark.parametrize("html, lines", TABLES)
def test_cells_stand_under_one_another(html, lines):
    assert htmltext.render(f"<table>{html}</table>").split("\n") == lines


def test_grids_by_hand():
    """Random tables of cells with spans: each row's text starts at the column that a plain reading of the grid gives it."""
    rng = random.Random(53)
    for _ in range(300):
        rows, n = [], 0
        for _ in range(rng.randint(1, 6)):
            row = []
            for _ in range(rng.randint(0, 4)):
                row.append((f"c{n}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])))
                n += 1
            rows.append(row)
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for t, w, h in row) for row in rows) + "</table>"
        place, busy = {}, set()
        for y, row in enumerate(rows):
            x = 0
            for t, w, h in row:
                while (y, x) in busy:
                    x += 1
                place[t] = (y, x)
                busy |= {(y + dy, x + dx) for dy in range(h) for dx in range(w) if dy or y + dy == y}
                x += w
        at = {}  # offset of each column's text, by the lines
        for line in htmltext.render(html).split("\n"):
            for t in line.replace("|", " ").split():
                at.setdefault(place[t][1], set()).add(line.index(t))
        overlaps = any(place[t][1] == place[u][1] for t in place for u in place if t < u and place[t][0] == place[u][0])
        if not overlaps:
            assert all(len(x) == 1 for x in at.values()), html
            assert [min(at[c]) for c in sorted(at)] == sorted(min(x) for x in at.values())


SEEN = [
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d", "b\nd"),
    ("<div style='display:none'>a<b style='visibility:visible;display:block'>b</b></div>d", "d"),
    ("<p style='display:none;display:block'>x</p>", "x"),
    ("<p style='visibility:hidden'><span style='visibility:inherit'>x</span></p>y", "y"),
    ("<p style='DISPLAY:NONE !important'>x</p>y", "y"),
    ("<p a=1 hidden hidden>x</p>y", "y"),
    ("<ul><li style='visibility:hidden'>a<li>b</ul>", "- b"),
    ("<input value=x style='visibility:hidden'><input value=y>", "y"),
    ("<b>" * 5000 + "deep" + "</b>" * 4000 + " more", "deep more"),
    ("<blockquote>" * 50 + "x", "> " * 50 + "x"),
    ("<div>" * 20_000 + "<p>deep", "deep"),
]


@pytest.mark.parametrize("html, text", SEEN)
def test_what_is_seen(html, text):
    assert htmltext.render(html) == text


def test_padding_is_bounded_by_the_table():
    """A cell of 200,000 characters over 5,000 short ones would need a gigabyte of blanks."""
    html = "<table><tr><td>" + "w" * 200_000 + "<td>x" + "".join(f"<tr><td>{k}<td>y" for k in range(5000)) + "</table>"
    text = htmltext.render(html)
    assert len(text) < 40 * len(html) and text.count(" | ") == 5001 and text.startswith("w" * 200_000 + " | x")
    assert {line.index("|") for line in text.split("\n")[1:]} == {5}


def test_nothing_visible_is_lost():
    """Words of random markup that hides nothing are all there, in order but for rows of cells."""
    rng = random.Random(54)
    tags = "p div span b ul ol li table tr td th pre h1 h2 blockquote dl dt dd a i section thead tbody br hr <![x> <!y>".split()
    for _ in range(400):
        words = [f"w{k}" for k in range(rng.randint(1, 25))]
        page = ""
        for w in words:
            for _ in range(rng.randint(0, 3)):
                t = rng.choice(tags)
                page += t if t.startswith("<") else f"<{rng.choice(['', '/'])}{t}>"
            page += f" {w} "
        got = htmltext.render(page).replace(">", " ").replace("|", " ").split()
        assert sorted(x for x in got if x.startswith("w")) == sorted(words), page


def test_rendered_keeps_columns(spark):
    d = spark.createDataFrame([(1, "<p>a", 5), (None, None, None)], "page_id long, html string, tag int")
    assert sorted(map(tuple, htmltext.rendered(d).collect()), key=str) == [(1, "<p>a", 5, "a"), (None, None, None, None)]
