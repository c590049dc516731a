"""Small tables with awkward rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, h1 long, digest string, key string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the further columns clash with names used inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, 7, "x", "y") for r in rows], DOCS)


def sentence(rng, n, words=None):
    words = words or [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("", "n", "st", "ng")]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward(seed=1):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    long = sentence(rng, 30_000)
    base = "\n".join(sentence(rng, 12) for _ in range(6))
    return [
        (1, base, "en", "a"),
        (2, base.upper(), "en", "a"),
        (2, base.upper(), "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, long, "fr", "b"),
        (6, long + " und so", "fr", None),
        (None, base, None, "b"),
        (None, None, None, None),
        (7, "one", "en", "b"),
        (8, "one", "en", "b"),
        (9, "\n\n\n\n", "en", "b"),
        (10, "É ß \U0001f600 " * 40, "fr", "c"),
        (11, "1 2 3 !!", "en", "c"),
    ]
