"""Language identification by unigram pieces, all segmentations summed.

The pieces of a fixed public vocabulary have a probability in each language.
The probability of a word is the sum over all its segmentations into pieces,
which a forward pass over its bytes gives; a text's is the product over its
words.  Probabilities are fitted by expectation maximisation (forward and
backward) on the words of a sample of labelled texts.

Words are runs of letters (and any bytes beyond ASCII) of the lower-cased
text, each begun by the mark for a word start.  A single byte outside every
piece costs the same in all languages.  Words are scored once per batch,
whatever their number of occurrences; so the work grows with distinct words.

The words may be of any length.  Beyond ``LONGEST`` bytes the forward pass is
taken as what it is, a linear map: a word's segments of that many bytes each give
the map from the sums before them to the sums after them, all at once, and the
maps are then applied one after another.  So pieces cross segments, and the sum
is over all segmentations of the whole word.

Scale: one pass over all texts without a shuffle.  The model that is broadcast
is a few numbers per piece of the vocabulary and language.  It is fitted on
about ``SAMPLE`` labelled texts of each language, taken by a hash of the id, and
of their words on the ``WORDS`` commonest, by language; for fitting only, words
of more than ``LONGEST`` bytes are cut, between characters.

Defined cases: null text, and text without a letter, is ``und`` with score 0,
as is every text if nothing is labelled; equal likelihoods go to the first
language by code point; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import _bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled texts for each language, about, and distinct words of all together.
SAMPLE, WORDS = 1_000, 2_000_000
#: Bytes of a word that are taken in one go.
LONGEST = 32
#: Bytes of text scored at once, and words in one forward pass: these bound a worker's memory.
BLOCK, PASS = 4 << 20, 10_000
#: Segments of a long word whose maps are made at once.
SEGMENTS = 256
UNKNOWN, ROUNDS, SMOOTH = 1e-7, 3, 0.05
#: Probabilities are multiplied by this at each byte, so that products keep in range.
_LIFT = 40.0
_START = "▁".encode()

_GAP = np.ones(256, bool)
_GAP[97:123] = _GAP[128:] = False


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a sentencepiece vocabulary, without controls, capitals and what no word has: a mark or a byte of a gap inside."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    return sorted(p.encode() for p in found if p == p.lower() and "▁" not in p[1:] and not _GAP[list(p.encode())].any())


def _hash_of(words: list[bytes]) -> np.ndarray:
    o = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    return _bytes.span_hash(_bytes.prefix(np.frombuffer(b"".join(words), np.uint8), False), o[:-1], o[1:])


@dataclass
class Lexicon:
    """Pieces as sorted hashes, with a quick test that most other strings fail; ``longest`` is the longest piece's bytes."""

    hashes: np.ndarray
    quick: np.ndarray
    longest: int

    @staticmethod
    def of(words: list[bytes]) -> Lexicon:
        h = np.unique(_hash_of(words)) if words else np.zeros(0, np.uint64)
        quick = np.zeros(1 << 20, bool)
        quick[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return Lexicon(h, quick, max(map(len, words), default=1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, or their count where there is none."""
        out = np.full(len(h), len(self.hashes), np.int32)
        some = np.flatnonzero(self.quick[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(some):
            at = np.searchsorted(self.hashes, h[some])
            at[at == len(self.hashes)] = 0
            hit = self.hashes[at] == h[some]
            out[some[hit]] = at[hit]
        return out


def _arcs(lexicon: Lexicon, b: np.ndarray, starts: Iterator[int] | list[int]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces in equally long strings, rows of ``b``: (i, d, rows, piece) for the rows that have a piece of d bytes after i bytes."""
    m = b.shape[1]
    sums = np.zeros((len(b), m + 1), np.uint64)
    np.cumsum(_bytes._BYTE[b] * _bytes._power(_bytes._BASE, m), axis=1, out=sums[:, 1:])
    inverse = _bytes._power(_bytes._INVERSE, m)
    head = (b & 0xC0) != 0x80
    arcs = []
    for i in starts:
        for d in range(1, min(lexicon.longest, m - i) + 1):
            h = _bytes.mix((sums[:, i + d] - sums[:, i]) * inverse[i] + np.uint64(d * 0xD6E8FEB86659FD93 % 2**64))
            p = lexicon.find(h)
            rows = np.flatnonzero((p < len(lexicon.hashes)) & head[:, i])
            if len(rows):
                arcs.append((i, d, rows, p[rows]))
    return arcs


def lattices(lexicon: Lexicon, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """Words by length: (their numbers, the length, arcs as of ``_arcs``); lengths count the word's start mark."""
    mark = np.frombuffer(_START, np.uint8)
    length = ends - starts
    for n in np.unique(length):
        words = np.flatnonzero(length == n)
        for k in range(0, len(words), PASS):
            own = words[k : k + PASS]
            m = int(n) + len(mark)
            b = np.empty((len(own), m), np.uint8)
            b[:, : len(mark)] = mark
            b[:, len(mark) :] = raw[starts[own][:, None] + np.arange(n)]
            yield own, m, _arcs(lexicon, b, [0, *range(len(mark), m)])


def _steps(arcs: list, m: int) -> list[list]:
    """Arcs by the place where they end."""
    out: list[list] = [[] for _ in range(m + 1)]
    for arc in arcs:
        out[arc[0] + arc[1]].append(arc)
    return out


def forward(arcs: list, n: int, m: int, prob: np.ndarray) -> np.ndarray:
    """Lifted probability of each prefix: m + 1 x words x languages."""
    a = np.zeros((m + 1, n, prob.shape[1]))
    a[0] = 1
    lift = _LIFT ** np.arange(m + 1)
    for z, ending in enumerate(_steps(arcs, m)):
        if z:
            a[z] = a[z - 1] * (UNKNOWN * _LIFT)
            for i, d, rows, p in ending:
                a[z, rows] += a[i, rows] * prob[p] * lift[d]
    return a


def _maps(lexicon: Lexicon, prob: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of ``longest`` bytes and a segment each: the maps, rows x longest x longest x languages, from the sums at the last ``longest`` places before a segment to those at its end."""
    p, m = lexicon.longest, b.shape[1]
    a = np.zeros((m + 1, len(b), p, prob.shape[1]))
    a[np.arange(1, p + 1), :, np.arange(p)] = 1  # the state before: places 1 to p
    lift = _LIFT ** np.arange(m + 1)
    for z, ending in enumerate(_steps(_arcs(lexicon, b, range(1, m)), m)):
        if z > p:
            a[z] = a[z - 1] * (UNKNOWN * _LIFT)
            for i, d, rows, piece in ending:
                a[z, rows] += a[i, rows] * (prob[piece] * lift[d])[:, None, :]
    return np.moveaxis(a[m + 1 - p :], 0, 1)


def _long_words(lexicon: Lexicon, prob: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log P of words of any length in each language."""
    p, mark = lexicon.longest, np.frombuffer(_START, np.uint8)
    out = np.zeros((len(starts), prob.shape[1]))
    state = np.zeros((p, prob.shape[1]))

    def segments() -> Iterator[tuple[int, bool, np.ndarray]]:
        for w in range(len(starts)):
            # bytes of value 0 are in no piece: they stand before the word, and make its first segment a whole one
            fill = -(len(mark) + int(ends[w] - starts[w])) % LONGEST
            b = np.concatenate((np.zeros(p + fill, np.uint8), mark, raw[starts[w] : ends[w]]))
            out[w] = -fill * np.log(UNKNOWN * _LIFT) - (len(b) - p - fill) * np.log(_LIFT)
            for at in range(0, len(b) - p, LONGEST):
                yield w, at == 0, b[at : at + p + LONGEST]

    some = segments()
    while batch := list(islice(some, SEGMENTS)):
        for (w, first, _), one in zip(batch, _maps(lexicon, prob, np.stack([b for *_, b in batch])), strict=True):
            if first:
                state[:] = 0
                state[-1] = 1
            state[:] = np.einsum("zsl,sl->zl", one, state)
            most = state[-1].copy()  # the sum at the end is never 0
            state /= most
            out[w] += np.log(most)
    return out


def log_likelihood(lexicon: Lexicon, prob: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log P of each word (a span of ``raw``) in each language."""
    out = np.zeros((len(starts), prob.shape[1]))
    short = np.flatnonzero(ends - starts <= LONGEST)
    for own, m, arcs in lattices(lexicon, raw, starts[short], ends[short]):
        out[short[own]] = np.log(forward(arcs, len(own), m, prob)[m]) - m * np.log(_LIFT)
    long = np.flatnonzero(ends - starts > LONGEST)
    out[long] = _long_words(lexicon, prob, raw, starts[long], ends[long])
    return out


def fit(lexicon: Lexicon, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by language, from counts (words x languages)."""
    v, n_lang = len(lexicon.hashes), counts.shape[1]
    o = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    kept = list(lattices(lexicon, raw, o[:-1], o[1:]))
    prob = np.full((v, n_lang), 1.0 / max(v, 1))
    for _ in range(rounds):
        seen = np.zeros((v, n_lang))
        for own, m, arcs in kept:
            a = forward(arcs, len(own), m, prob)
            z = np.zeros_like(a)
            z[m] = counts[own] / a[m]
            by_start: list[list] = [[] for _ in range(m + 1)]
            for arc in arcs:
                by_start[arc[0]].append(arc)
            for i in range(m - 1, -1, -1):
                z[i] = z[i + 1] * (UNKNOWN * _LIFT)
                for _, d, rows, p in by_start[i]:
                    out = prob[p] * _LIFT**d * z[i + d, rows]
                    z[i, rows] += out
                    out *= a[i, rows]
                    for k in range(n_lang):
                        seen[:, k] += np.bincount(p, out[:, k], v)
        prob = (seen + SMOOTH) / (seen.sum(0) + SMOOTH * v)
    return prob


@dataclass
class Model:
    languages: list[str]
    lexicon: Lexicon
    prob: np.ndarray


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts, and the words' starts, ends and offsets by text."""
    b, offsets = _bytes.text_bytes(texts)
    return b, *_bytes.runs(b, offsets, _GAP)


def _cut(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words, those of more than LONGEST bytes in parts, cut between characters."""
    n = -(-(ends - starts) // (LONGEST - 3))
    n[ends - starts <= LONGEST] = 1
    first = np.concatenate(([0], np.cumsum(n)))
    nth = np.arange(first[-1]) - np.repeat(first[:-1], n)
    at, last = np.repeat(starts, n) + nth * (LONGEST - 3), np.repeat(ends, n)
    for _ in range(3):  # on to a character's first byte
        at = at + ((nth > 0) & (at < last) & ((b[np.minimum(at, len(b) - 1)] & 0xC0) == 0x80))
    past = np.append(at[1:], 0)
    past[first[1:] - 1] = ends
    return at[past > at], past[past > at]


def _distinct(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word number for each distinct word, and for each word which of them it is."""
    h = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _bytes.SEGMENT, "right")))
        lo = starts[i]
        h[i:j] = _bytes.span_hash(_bytes.prefix(b[lo : ends[j - 1]], False), starts[i:j] - lo, ends[i:j] - lo)
        i = j
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    return one, which


def train(docs: DataFrame, use: Column, vocabulary: str = VOCABULARY, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows for which ``use`` holds and lang and text aren't null."""
    ship(docs.sparkSession)
    own = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.lower(F.col(text)).alias("text"))
    sizes = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    lexicon = Lexicon.of(pieces(vocabulary))
    if not sizes:
        return Model([], lexicon, np.zeros((len(lexicon.hashes), 0)))
    languages = sorted(sizes, key=lambda s: s.encode())
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(sample / sizes[k]))])
    some = own.where(F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lg in batch.column(0).unique():
                b, starts, ends, _ = words_of(batch.column(1).filter(pa.compute.equal(batch.column(0), lg)))
                starts, ends = _cut(b, starts, ends)
                one, which = _distinct(b, starts, ends)
                raw = b.tobytes()
                w = [raw[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lg.as_py()] * len(w), pa.string()), pa.array(w, pa.binary()), pa.array(np.bincount(which, minlength=len(w)).astype(np.int64))], names=["lang", "word", "n"])

    counted = some.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counted = counted.orderBy(F.desc("n"), "word", "lang").limit(WORDS).toPandas()
    words = sorted({bytes(w) for w in counted["word"]})
    if not words:
        return Model([], lexicon, np.zeros((len(lexicon.hashes), 0)))
    number, column = {w: i for i, w in enumerate(words)}, {s: i for i, s in enumerate(languages)}
    counts = np.zeros((len(words), len(languages)))
    counts[[number[bytes(w)] for w in counted["word"]], [column[s] for s in counted["lang"]]] = counted["n"]
    return Model(languages, lexicon, fit(lexicon, words, counts))


def predict(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each (lower-cased) text, and its posterior probability."""
    _, offsets = _bytes.text_bytes(texts)
    found = [_predict(texts.slice(i, j - i), model) for i, j in _bytes.blocks(offsets, BLOCK)]
    return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0)])


def _predict(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    b, starts, ends, by_text = words_of(texts)
    one, which = _distinct(b, starts, ends)
    by_word = log_likelihood(model.lexicon, model.prob, b, starts[one], ends[one])
    total = np.zeros((len(by_text) - 1, len(model.languages)))
    for k in range(len(model.languages)):
        total[:, k] = np.diff(np.concatenate(([0.0], np.cumsum(by_word[which, k])))[by_text])
    best = total.argmax(1)
    return best, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with all its columns, ``lang_pred`` and ``score``."""
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def of(texts: pa.Array) -> pa.Array:
        best, score = predict(texts, held.value)
        return pa.StructArray.from_arrays([pa.array(held.value.languages, pa.string()).take(pa.array(best)), pa.array(score, pa.float64())], ["lang", "score"])

    found = docs.withColumn("__bl_lang", of(F.lower(F.col(text).cast("string"))))
    found = found.withColumns({"lang_pred": F.when(has_letter, F.col("__bl_lang.lang")).otherwise("und"), "score": F.when(has_letter, F.col("__bl_lang.score")).otherwise(0.0)})
    return found.drop("__bl_lang")
