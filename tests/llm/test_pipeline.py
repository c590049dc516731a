"""Stages of the corpus pipeline on rows whose ids are null or shared."""

import random
import re
import string
from collections import Counter

import corpus_pipeline
import pytest

from bookloom.llm import neardup

from .helpers import docs, sentence
from .test_native import lines_by_hand, targets_by_hand

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ids_and_texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_stage_decides_by_row(spark):
    rng = random.Random(21)
    a, b, c, alone, other = (sentence(rng, 150) for _ in range(5))
    near = lambda t: t + " end"
    stay = [(1, a), (7, b), (None, c), (7, alone), (None, other), (None, None), (None, ""), (3, ""), (3, "")]
    gone = [(None, near(a)), (7, near(a)), (7, b), (None, b), (None, near(c)), (None, c)]
    rows = [(i, t, "en", "a") for i, t in [*stay, *gone]]
    left = ids_and_texts(corpus_pipeline.near_stage(spark, docs(spark, rows), ""))
    # of (None, c) and (None, near(c)) the first row stays
    assert left == sorted(stay, key=str)


def test_decontamination_stage_decides_by_row(spark, tmp_path):
    rng = random.Random(22)
    item, clean, other = sentence(rng, 30), sentence(rng, 60), sentence(rng, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stay = [(5, clean), (5, clean), (None, other), (None, None), (2, "")]
    # a whole passage is enough, however long the text around it
    long = " ".join(sentence(rng, 4000).split()[:2000] + item.upper().split() + sentence(rng, 2000).split())
    rows = [(i, t, "en", "a") for i, t in [*stay, (5, clean + " " + item), (None, item), (None, other + " " + item), (6, long)]]
    left = corpus_pipeline.decontamination_stage(spark, docs(spark, rows), str(tmp_path))
    assert ids_and_texts(left) == sorted(stay, key=str)
    assert left.columns == docs(spark, rows).columns


def test_near_stage_links_from_80_percent(spark):
    """Pairs of 104 words: 100 shingles, of which 10 change on either side give 90 / 110; 11 give 89 / 111; 12 give 88 / 112."""
    rng = random.Random(23)
    rows, stay = [], []
    for k in range(60):
        own = [f"w{k}x{i}" for i in range(104)]
        changed = 10 + k % 3
        other = [*own[: 104 - changed], *[f"v{k}x{i}" for i in range(changed)]]
        rows += [(2 * k, " ".join(own), "en", "a"), (2 * k + 1, " ".join(other), "en", "a")]
        stay += [2 * k] + [2 * k + 1] * (changed > 11)
    rng.shuffle(rows)
    left = [i for i, _ in ids_and_texts(corpus_pipeline.near_stage(spark, docs(spark, rows), ""))]
    assert sorted(left) == sorted(stay)


def test_chance_of_a_miss():
    assert neardup.miss(0.85) == pytest.approx(1.82e-4, rel=0.01)
    assert neardup.miss(0.80, neardup.AT_80) < 2e-4 < 3e-3 < neardup.miss(0.80)


def corpus(rng):
    """Good and bad texts, repeated passages of lines, near copies, benchmark passages, and awkward rows."""
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: "\n".join(sentence(rng, 12, words).capitalize() + "." for _ in range(n))
    passage = text(4)
    items = [(k, sentence(rng, 30, words)) for k in range(5)] + [(None, sentence(rng, 20, words)), (9, None)]
    rows = []
    for k in range(120):
        t = text(rng.randint(8, 14))
        if k % 10 == 1:
            t = t + "\n" + passage + "\n" + text(3)
        if k % 10 == 2:
            t = t + "\n" + items[k % 5][1] + "\n" + text(30)
        rows.append((k, t, "en", ["a", "a", "b", None][k % 4]))
        if k % 10 == 3:
            rows.append((500 + k, t + " indeed", "en", "b"))
            rows.append((k, t, "en", "a"))
    bad = [(1000 + k, "!!! ".join(sentence(rng, 60, words).upper().split()), "en", "a") for k in range(80)]
    odd = [(None, None, None, None), (700, "", "en", None), (701, None, "en", "b"), (None, "", "en", "a"), (702, "One line.", "fr", "z")]
    return rows, bad, odd, items


def written(spark, tmp_path, rows, labels, items):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def shingles(t, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(FOLD)) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages_and_run_by_hand(spark, tmp_path):
    """Each stage on what the one before kept, against a plain reading; the scores of the first are the classifier's."""
    rng = random.Random(24)
    good, bad, odd, items = corpus(rng)
    labels = [(r[0], 1, 0) for r in good if r[0] < 500] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (5, None, 1)]
    sf = written(spark, tmp_path, [*good, *bad, *odd], labels, items)
    read = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    frames, before = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, before, sf))
        assert frames[-1].columns == before.columns and frames[-1].schema.simpleString() == before.schema.simpleString(), name
        frames[-1].write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
    kept, lines, near, clean = ([*map(tuple, read(spark.read.parquet(str(tmp_path / n))))] for n, _ in corpus_pipeline.STAGES[:-1])

    # quality: rows that the model scores below one half go, and no others
    assert not {r[0] for r in kept} & {r[0] for r in bad} and {r[0] for r in good} <= {r[0] for r in kept}
    # lines: passages of three lines or more stay once
    cut = lines_by_hand([r[:2] for r in kept])
    assert Counter(r[:2] for r in lines) == Counter((i, cut.get((i, t), t)) for i, t, *_ in kept)
    assert any(len(cut.get(r[:2], r[1]) or "") < len(r[1] or "") for r in kept)
    # near duplicates: one row of each component stays
    sets = [shingles(t, 5) for _, t, *_ in lines]
    group = list(range(len(lines)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = Counter()
    for g in set(group):
        own = [lines[i] for i in range(len(lines)) if group[i] == g]
        want[min((i for i, *_ in own if i is not None), default=None)] += 1
    assert Counter(r[0] for r in near) == want and len(near) < len(lines)
    # benchmark: no row with a whole window of an item stays, and all others do
    windows = set().union(*(shingles(t, 13) for i, t in items if i is not None and t))
    hit = lambda t: bool(shingles(re.sub("[^a-z]+", " ", (t or "").translate(FOLD)), 13) & windows)
    assert Counter(clean) == Counter(r for r in near if not hit(r[1])) and len(clean) < len(near)
    # the mix
    mixed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in mixed} <= {r[0] for r in clean}
    sizes, taken = Counter(), Counter()
    for _, t, _, s in clean:
        sizes[s] += len((t or "").split())
    for r in mixed:
        taken[r.source] += r.taken
        assert r.copies in (1, 2) and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
    for s, t in targets_by_hand(sizes).items():
        own = sorted(len((x or "").split()) for _, x, _, z in clean if z == s)
        assert abs(taken[s] - t) <= max(own[len(own) // 2], 1), s


def test_run_on_empty_tables(spark, tmp_path):
    sf = written(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
