"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (``window`` consecutive words, or the whole
of a shorter item) become the patterns of one automaton over normalised text:
words in lower case (A-Z only) between single blanks.  Every text is scanned
once; the end of each match leads to a word number, and words lead back to
offsets in the original text.

Scale: texts are never shuffled and never leave their task.  What is broadcast
are the benchmark's texts; workers make the windows of them.  The size is
checked: beyond ``block_words`` words the items are dealt to several automata,
each broadcast by itself, and the driver reads one block at a time.  A task then
holds ``BUFFER`` bytes of texts and one automaton, and takes one automaton after
another over them; with a single automaton, it is built once for a partition.

Defined cases: null and empty texts have no words and are never contaminated;
null items have no windows; equal windows of several items count for each of
them; repeated rows give repeated results; rows with a null id are scanned like
any other and, in the benchmark, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

WINDOW = 13
#: Words of the benchmark in one automaton (a few hundred bytes each).
BLOCK_WORDS = 1_000_000

#: Bytes of texts that are scanned with one automaton before the next is built.
BUFFER = 64 << 20

#: Byte tables: A-Z to a-z, bytes outside words to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("word_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))),
        T.StructField("char_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(text: str | None, window: int = WINDOW) -> list[list[bytes]]:
    w = words(text)
    return [w[i : i + window] for i in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []


def _pattern(ws: list[bytes]) -> str:
    return (b" " + b" ".join(ws) + b" ").decode("latin-1")


def automaton(patterns: list[tuple[str, int, tuple[int, ...]]]):
    """patterns: text, number of words, items."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, n, items in patterns:
        a.add_word(p, (n, items))
    a.make_automaton()
    return a


def _char_spans(raw: bytes, folded: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Offsets in code points of the original text for spans of words."""
    b = np.frombuffer(folded, np.uint8)
    solid = b != 32
    starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    ends = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False]))) + 1
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(points[starts[i]]), "end": int(points[ends[j - 1]])} for i, j in spans]


def scan(text: str | None, automata) -> tuple[int, np.ndarray | None, set[int], list[tuple[int, int]], bytes, bytes]:
    """Number of words, hit flags by word (None if nothing hit), items, merged word spans, and the bytes scanned."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    ws = folded.split()
    if not ws:
        return 0, None, set(), [], raw, folded
    norm = _pattern(ws)
    items: set[int] = set()
    edge = blanks = None
    for a in automata:
        for end, (n, of) in a.iter(norm):
            if edge is None:
                blanks = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
                edge = np.zeros(len(ws) + 1, np.int64)
            past = int(np.searchsorted(blanks, end))
            edge[past - n] += 1
            edge[past] -= 1
            items.update(of)
    if edge is None:
        return len(ws), None, items, [], raw, folded
    hit = np.cumsum(edge[:-1]) > 0
    step = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return len(ws), hit, items, list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True)), raw, folded


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[DataFrame]:
    """The benchmark's items, dealt to blocks of bounded size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // (5 * block_words)))  # five bytes a word
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _automata(texts: list[tuple[int, str]], window: int) -> list:
    """The automaton of a block's windows, or none for no windows."""
    found: dict[str, tuple[int, set[int]]] = {}
    for item, text in texts:
        for w in windows(text, window):
            found.setdefault(_pattern(w), (len(w), set()))[1].add(item)
    return [automaton([(p, n, tuple(sorted(items))) for p, (n, items) in found.items()])] if found else []


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: word counts, items found, and where.

    ``word_spans`` are half-open ranges of word numbers, merged; ``char_spans``
    the same in code points of the original text.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast([(r.item, r.text) for r in b.toLocalIterator()]) for b in _blocks(benchmark, item_id, item_text, window, block_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _automata(parts[0].value, window) if len(parts) == 1 else []
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64()))]
            + [(c, pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))) for c, a, b in (("word_spans", "first", "past"), ("char_spans", "start", "end"))]
        )
        for ids, texts in batches_of(batches, len(parts) > 1):
            if len(parts) == 1:
                found = ((d, scan(t.as_py(), one)) for d, t in zip(ids.to_pylist(), texts, strict=True))
            else:
                found = zip(ids.to_pylist(), _in_blocks(texts, parts, window), strict=True)
            out = []
            for d, (n, hit, items, spans, raw, folded) in found:
                out.append(
                    {
                        "doc_id": d,
                        "n_words": n,
                        "n_hit": 0 if hit is None else int(hit.sum()),
                        "item_ids": sorted(items),
                        "word_spans": [{"first": i, "past": j} for i, j in spans],
                        "char_spans": _char_spans(raw, folded, spans) if spans else [],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    def batches_of(batches: Iterator[pa.RecordBatch], together: bool) -> Iterator[tuple]:
        kept, size = [], 0
        for batch in batches:
            kept, size = [*kept, batch], size + batch.nbytes
            if not together or size >= BUFFER:
                yield tuple(pa.chunked_array([b.column(k) for b in kept]) for k in (0, 1))
                kept, size = [], 0
        if kept:
            yield tuple(pa.chunked_array([b.column(k) for b in kept]) for k in (0, 1))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SPANS)


def _in_blocks(texts: pa.ChunkedArray, parts: list, window: int) -> list[tuple]:
    """scan() of texts with one automaton in memory at a time; what they scan to is kept for texts with hits only."""
    merged: list[list] = []
    for part in parts:
        a = _automata(part.value, window)
        for k, t in enumerate(texts):
            n, hit, items, _, raw, folded = scan(t.as_py(), a)
            if k == len(merged):
                merged.append([n, None, set(), [], b"", b""])
            if hit is not None:
                m = merged[k]
                m[1] = hit if m[1] is None else m[1] | hit
                m[2] |= items
                m[4:] = raw, folded
    for m in merged:
        if m[1] is not None:
            step = np.flatnonzero(np.diff(np.concatenate(([0], m[1].astype(np.int8), [0]))))
            m[3] = list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))
    return [tuple(m) for m in merged]


def is_contaminated() -> Column:
    """At least one word hit, and a twentieth of all words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
