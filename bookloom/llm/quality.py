"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the bytes of a text alone (shares of kinds of
characters, words and lines, their lengths and how often they repeat), all by
numpy over a batch.  Trees are fitted on the driver from a sample of at most
``SAMPLE`` labelled rows, taken by a hash of the id, and broadcast as arrays of
fixed size; scoring is one pass over all texts without a shuffle.

Defined cases: null and empty texts have the statistics of an empty text and
get a score too; labelled rows of null id or null label don't count; equal
labels of an id count once, and of several texts of an id one is taken, by hash;
without labels every score is 0.5, with one class only it is near that class;
repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import _bytes
from .gbdt import Trees, fit

#: The most labelled rows that the trees are fitted on.
SAMPLE = 20_000

_MARKS = b"!#$%&*|.,;:?-_=/\\@<>{}[]()\"'+~^`"
_LINE_GAP = np.zeros(256, bool)
_LINE_GAP[10] = True
NAMES = (
    ["log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "white", "mark", "high", "upper_of_letters"]
    + [f"mark_{chr(c)}" for c in _MARKS]
    + ["word_mean", "word_std", "word_max", "distinct_words", "top_word", "distinct_lines", "words_by_line", "line_std", "byte_entropy"]
)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    b, offsets = _bytes.text_bytes(texts)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for i, j in _bytes.blocks(offsets):
        o = offsets[i : j + 1] - offsets[i]
        out[i:j] = _block(b[offsets[i] : offsets[j]], o)
    return out


def _histogram(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    n = len(o) - 1
    out = np.zeros(n * 256, np.int64)
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(o))
    for at in range(0, len(b), _bytes.SEGMENT):
        s = slice(at, at + _bytes.SEGMENT)
        out += np.bincount(text[s].astype(np.int64) * 256 + b[s], minlength=n * 256)
    return out.reshape(n, 256)


def _spread(values: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, standard deviation and maximum by text; 0 where there are none."""
    n = np.diff(by_text)
    sums = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v, dtype=np.float64)))[by_text])
    mean = sums(values) / np.maximum(n, 1)
    std = np.sqrt(np.maximum(sums(values.astype(np.float64) ** 2) / np.maximum(n, 1) - mean**2, 0))
    most = np.zeros(len(n))
    if len(values):
        most[n > 0] = np.maximum.reduceat(values, by_text[:-1][n > 0])
    return mean, std, most


def _repeats(h: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct hashes, and the commonest one's share, by text."""
    distinct, top = np.ones(len(by_text) - 1), np.zeros(len(by_text) - 1)
    for k, (i, j) in enumerate(zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True)):
        if j > i:
            s = np.sort(h[i:j])
            edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            distinct[k], top[k] = (len(edge) - 1) / (j - i), np.diff(edge).max() / (j - i)
    return distinct, top


def _block(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    c = _histogram(b, o)
    size = np.diff(o)
    part = lambda v: v / np.maximum(size, 1)
    upper, lower, digit = c[:, 65:91].sum(1), c[:, 97:123].sum(1), c[:, 48:58].sum(1)
    white, high = c[:, _bytes.WHITE].sum(1), c[:, 128:].sum(1)
    ascii_marks = c[:, 33:127].sum(1) - upper - lower - digit
    starts, ends, by_word = _bytes.runs(b, o, _bytes.WHITE)
    words, _ = _bytes.word_hashes(b, o, fold=True)
    word_mean, word_std, word_max = _spread(ends - starts, by_word)
    distinct_words, top_word = _repeats(words, by_word)
    ls, le, by_line = _bytes.runs(b, o, _LINE_GAP)
    lines, _ = _bytes.word_hashes(b, o, fold=False, gap=_LINE_GAP)
    line_mean, line_std, _ = _spread(le - ls, by_line)
    distinct_lines, _ = _repeats(lines, by_line)
    n_words, n_lines = np.diff(by_word), np.diff(by_line)
    p = c / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    columns = [np.log1p(size), np.log1p(n_words), np.log1p(n_lines), part(upper), part(lower), part(digit), part(white), part(ascii_marks), part(high), upper / np.maximum(upper + lower, 1)]
    columns += [part(c[:, m]) for m in _MARKS]
    columns += [word_mean, word_std, np.log1p(word_max), distinct_words, top_word, distinct_lines, n_words / np.maximum(n_lines, 1), line_std / np.maximum(line_mean, 1), entropy]
    return np.stack(columns, 1)


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Trees fitted on labelled documents for whose ``doc_id`` ``use`` holds."""
    ship(docs.sparkSession)
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & use)
    rows = rows.select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("int").alias("y")).distinct().orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    known = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("text")).join(F.broadcast(rows), F.col("d") == F.col("id"))
    known = known.select("id", "y", "text", F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(2))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), flat], names=["id", "y", "h", "x"])

    # one row for each id and label, so at most ``sample`` reach the driver
    found = known.mapInArrow(run, "id long, y int, h long, x array<double>").groupBy("id", "y").agg(F.min_by("x", "h").alias("x"))
    got = found.toPandas().sort_values(["id", "y"])
    if not len(got):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Trees, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``to``, the score of each text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(statistics(texts)), pa.float64())

    return docs.withColumn(to, of(F.col(text).cast("string")))
