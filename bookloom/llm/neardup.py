"""MinHash near-duplicates by a multi-index join under a Hamming distance.

A document's set holds 64-bit hashes of its distinct shingles of five words
(A-Z lower-cased).  Equal sets form one class, and all further work is between
classes.  A class has a signature of ``POSITIONS`` minima, ``BITS`` bits each.

Signatures are cut into ``CHUNKS`` chunks.  Two that differ in at most
``DISTANCE`` positions have, by the pigeonhole principle, a chunk with at most
``ERRORS`` errors, since otherwise there would be more than DISTANCE of them.
All ways to place the errors in a chunk are enumerated as keys that leave those
positions out, so every such pair shares a key.  Pairs that share a key but
differ in up to ``FARTHEST`` positions are candidates too.  A pair that shares
several keys is taken up at the first of them only.

Pairs that can't be links stay inside the joins, by bounds that lose none: the
sizes of the sets, and a sketch of parities.  A set's elements are dealt to
buckets by hash and each bucket keeps whether it got an odd number; where the
parities of two sets differ, there is an element of one that the other lacks.
So the number of differing buckets is never above the number of elements in one
set only, and pairs with too many are no links.  There are ``QUICK`` buckets,
and for larger sets besides at least two for each element, up to ``WIDEST``.

A key's members are not paired with each other at once.  In rounds, members
are compared with a few leaders of their key; links are confirmed on the full
sets; components are formed; and a key is done when all its members that have
not been leaders are in one component, as then no link could join anything
more.  A key that isn't done has its open pairs listed if it is small, and more
leaders, twice as many each round, if it is large.  So a group of n copies that
resemble each other costs about n comparisons, yet no link between components
is lost.

Chance of a miss: ``miss`` computes it.  With the scheme for 85 percent a pair at
similarity 0.85 is missed in at most 1.8e-4 of cases, with ``AT_80`` one at 0.80
in at most 1.9e-4; less the nearer the pair.

Scale: classes, keys, pairs, sets and components are tables in the shared
folder; nothing of corpus size reaches the driver or a broadcast (full sets are
recomputed for candidates only, picked out by a bit set of bounded size).  A
group of near, unlinked texts has its pairs tested within the joins, but only
links and a few pairs just below the threshold leave them.

Defined cases: null or empty text has an empty set and is linked with nothing;
texts of fewer than five words have one shingle, the whole sequence; equal rows
and ties belong to one class; a null id never names a component unless all its
ids are null (then null, and such rows are kept); an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import _bytes
from ._common import Series, saved, split_by_keys
from .graph import components

SHINGLE = 5
WIDTH, CHUNKS, ERRORS = 7, 7, 1
#: A chunk is a number of WIDTH bytes, one for each position.
POSITIONS, BITS = WIDTH * CHUNKS, 8
#: The largest distance for which the pigeonhole principle holds, and that of a candidate.
DISTANCE, FARTHEST = CHUNKS * (ERRORS + 1) - 1, 18


class Scheme(NamedTuple):
    """How signatures are cut: ``chunks`` of ``width`` positions with at most one error; candidates differ in up to ``farthest``."""

    width: int = WIDTH
    chunks: int = CHUNKS
    farthest: int = FARTHEST

    @property
    def positions(self) -> int:
        return self.width * self.chunks


AT_85 = Scheme()
#: For links from 0.80 on: shorter chunks and more of them.
AT_80 = Scheme(6, 9, 22)

#: Buckets of the sketch of a set, for all sets and at most; sets of more than ``WIDE`` elements have both.
QUICK, WIDEST, WIDE = 512, 1 << 16, 256

#: Members of a key up to which its open pairs are listed.
SMALL = 1024

#: The first numbers are the same however many positions there are.
_MOST = max(AT_85.positions, AT_80.positions)
_XOR, _MUL = _bytes._splitmix(_MOST, 101), _bytes._splitmix(_MOST, 202) | np.uint64(1)
_ROLE = _bytes._splitmix(SHINGLE, 303) | np.uint64(1)


def miss(similarity: float, scheme: Scheme = AT_85) -> float:
    """Chance, at most, that two sets of that similarity never become a candidate pair."""
    p, n = similarity + (1 - similarity) / (1 << BITS), scheme.positions
    chunk = p**scheme.width + scheme.width * p ** (scheme.width - 1) * (1 - p)
    return (1 - chunk) ** scheme.chunks + sum(comb(n, k) * (1 - p) ** k * p ** (n - k) for k in range(scheme.farthest + 1, n + 1))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, a list per block of texts."""
    b, offsets = _bytes.text_bytes(texts)
    role = _ROLE if k == SHINGLE else _bytes._splitmix(k, 303) | np.uint64(1)
    for i, j in _bytes.blocks(offsets):
        o = offsets[i : j + 1]
        w, by_text = _bytes.word_hashes(b[o[0] : o[-1]], o - o[0])
        n = max(0, len(w) - k + 1)
        s = np.zeros(n, np.uint64)
        for p in range(k):
            s += w[p : p + n] * role[p]
        s = _bytes.mix(s)
        out = []
        for first, past in zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True):
            m = past - first
            if m >= k:
                out.append(np.unique(s[first : past - k + 1]))
            elif m:
                whole = (w[first:past] * role[:m]).sum(dtype=np.uint64) + np.uint64(m)
                out.append(_bytes.mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def signatures(sets: list[np.ndarray], scheme: Scheme = AT_85) -> np.ndarray:
    """A number for each chunk of each set that isn't empty, in order."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), scheme.chunks), np.uint64)
    if not full:
        return out.view(np.int64)
    at = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
    flat = np.concatenate(full)
    for p in range(scheme.positions):
        least = np.minimum.reduceat((flat ^ _XOR[p]) * _MUL[p], at)
        out[:, p // scheme.width] |= (least >> np.uint64(24) & np.uint64(0xFF)) << np.uint64(BITS * (p % scheme.width))
    return out.view(np.int64)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parities(s: np.ndarray, m: int) -> np.ndarray:
    """m bits as numbers: has a bucket an odd number of elements?  m is a power of two, so folding m bits in half gives those of m / 2."""
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Parities of a set in QUICK buckets, and in more where it is large."""
    if len(s) <= WIDE:
        return _parities(s, QUICK), None
    wide = _parities(s, min(WIDEST, 2 << (len(s) - 1).bit_length()))
    quick = wide.reshape(-1, QUICK // 64)
    return np.bitwise_xor.reduce(quick, axis=0), wide


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, scheme: Scheme = AT_85) -> DataFrame:
    """(doc_id, rid, n, digest, sig, quick, wide) of each row; ``rid`` is the column ``row``, null without one."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", longs), ("quick", longs), ("wide", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets in shingle_sets(batch.column(2)):
                n = np.array([len(s) for s in sets], np.int64)
                at = pa.array(np.concatenate(([0], np.cumsum(scheme.chunks * (n > 0)))).astype(np.int32))
                sig = pa.ListArray.from_arrays(at, pa.array(signatures(sets, scheme).ravel()))
                digests = pa.array([digest(s) if len(s) else b"" for s in sets], pa.binary())
                sketches = [sketch(s) for s in sets]
                at = np.arange(len(sets) + 1, dtype=np.int32) * (QUICK // 64)
                quick = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([q for q, _ in sketches])))
                wide = pa.array([w for _, w in sketches], longs)
                own = [batch.column(k).slice(done, len(sets)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), digests, sig, quick, wide], schema=schema)
                done += len(sets)

    rid = F.col(row) if row else F.lit(None)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), rid.cast("long").alias("rid"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, rid long, n long, digest binary, sig array<long>, quick array<long>, wide array<long>")


#: The top bits of the bytes of a chunk, up to seven, and the others.
_TOP = sum(0x80 << BITS * p for p in range(7))
_REST = sum(0x7F << BITS * p for p in range(7))


def _errors(x: str, y: str, c: int) -> str:
    """SQL: in how many bytes do two chunks differ?  A byte that isn't 0 carries into its top bit or has it."""
    v = f"({x}.sig[{c}] ^ {y}.sig[{c}])"
    return f"bit_count(((({v} & {_REST}L) + {_REST}L) | {v}) & {_TOP}L)"


def _resemble(x: str, y: str, scheme: Scheme) -> str:
    """SQL: do the signatures of x and y differ in at most ``scheme.farthest`` positions?"""
    return " + ".join(_errors(x, y, c) for c in range(scheme.chunks)) + f" <= {scheme.farthest}"


def _first_key(x: str, y: str, scheme: Scheme) -> str:
    """SQL: is this key, ``x.key``, the first that x and y share?

    With one error in a chunk its position is what the key leaves out; with
    none, all keys of the chunk are shared.
    """
    n, w = f"shiftright({x}.key, 56)", scheme.width
    cases = " ".join(f"when {_errors(x, y, c)} <= 1 then {n} = {c * w} or ({n} between {c * w} and {c * w + w - 1} and {_errors(x, y, c)} = 1)" for c in range(scheme.chunks))
    return f"case {cases} else false end"


def _differing(x: str, y: str) -> str:
    """SQL: buckets in which the wide sketches of x and y differ, the larger folded to the size of the other."""
    folded = lambda z: f"zip_with(slice({z}, 1, size({z}) div 2), slice({z}, size({z}) div 2 + 1, size({z}) div 2), (s, t) -> s ^ t)"
    count = lambda a, b: f"aggregate(zip_with({a}, {b}, (s, t) -> bit_count(s ^ t)), 0, (n, d) -> n + d)"
    a, b = f"{x}.wide", f"{y}.wide"
    return f"case when size({a}) > size({b}) then {count(folded(a), b)} when size({a}) < size({b}) then {count(a, folded(b))} else {count(a, b)} end"


def _may_link(x: str, y: str, percent: int) -> str:
    """SQL: true of all links, by their sizes and sketches.

    100 * i >= percent * (m + n - i) leaves at most (m + n) * (100 - percent) /
    (100 + percent) elements that are in one set only.
    """
    few = lambda d: f"({d}) * {100 + percent} <= ({x}.size + {y}.size) * {100 - percent}"
    quick = " + ".join(f"bit_count({x}.quick[{k}] ^ {y}.quick[{k}])" for k in range(QUICK // 64))
    sizes = f"least({x}.size, {y}.size) * 100 >= greatest({x}.size, {y}.size) * {percent}"
    return f"{sizes} and {few(quick)} and ({x}.wide is null or {y}.wide is null or {few(_differing(x, y))})"


#: What a class is compared by.
_BY = ["size", "sig", "quick", "wide"]


def _keys(scheme: Scheme, sig: str = "sig"):
    """One number for each chunk and each position to leave out: which they are, then the chunk without it."""
    out = [F.col(sig)[c].bitwiseAND(F.lit(~(0xFF << BITS * g))).bitwiseOR(F.lit((c * scheme.width + g) << 56)) for c in range(scheme.chunks) for g in range(scheme.width)]
    return F.array(*out)


def _open_keys(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members, with their components, of the keys that aren't done."""
    m = members.join(comp, members["cid"] == comp["node"], "left").drop("node").withColumn("root", F.coalesce("root", "cid"))
    rest = m.where("cid <> lead1 and cid <> lead2").groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    return m.join(rest.where("r1 <> r2").select("key"), "key", "left_semi")


def _open_pairs(live: DataFrame, small: int, slots: int, scheme: Scheme, percent: int) -> DataFrame:
    """Pairs of different components that may be links: all of keys of up to ``small`` members, and those with ``slots`` leaders of the others.

    Sketches and signatures are compared inside the joins, so only near pairs leave them.
    """
    few = live.where(F.col("n") <= small)
    near = F.expr(_may_link("x", "y", percent)) & F.expr(_resemble("x", "y", scheme)) & F.expr(_first_key("x", "y", scheme))
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.root") != F.col("y.root")) & near).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    many = live.where(F.col("n") > small)
    slot = F.pmod(F.xxhash64(F.lit(slots), "cid"), F.lit(slots))
    leads = many.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64(F.lit("lead"), "cid").alias("o"), "cid", "root", *_BY)).alias("l")).select("key", "l.cid", "l.root", *[f"l.{c}" for c in _BY])
    led = many.alias("x").join(leads.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    return pairs.unionByName(led).distinct()


def _near(pairs: DataFrame, classes: DataFrame, scheme: Scheme, percent: int) -> DataFrame:
    """Pairs whose signatures differ in at most ``scheme.farthest`` positions and that may be links."""
    x, y = classes.select("cid", *_BY).alias("x"), classes.select("cid", *_BY).alias("y")
    near = F.expr(_may_link("x", "y", percent)) & F.expr(_resemble("x", "y", scheme))
    return pairs.join(x, F.col("a") == F.col("x.cid")).join(y, (F.col("b") == F.col("y.cid")) & near).select("a", "b")


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, s) with the whole sets of the classes in ``wanted``."""
    own = saved(classes.join(wanted, "cid", "left_semi").select("cid", "digest", F.col("doc_id").alias("rep")), "near_wanted")
    schema = pa.schema([("r", pa.int64()), ("d", pa.binary()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for found in shingle_sets(batch.column(1)):
                at = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(found)), pa.array([digest(s) for s in found], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], schema=schema
                )
                done += len(found)

    maybe, _ = split_by_keys(docs.select(F.col("doc_id").alias("rep"), "text"), own, ["rep"])
    sets = maybe.select("rep", "text").mapInArrow(run, "r long, d binary, s array<long>")
    return sets.join(own, (sets["d"] == own["digest"]) & sets["r"].eqNullSafe(own["rep"])).select("cid", "s").dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("y")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85, scheme: Scheme = AT_85, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Links are pairs of sets with 100 * intersection >= percent * union.  With
    ``row``, a column that numbers the rows, there are also that number and
    ``first``: is this the one row of its component with the least id (null
    ids last, ties by number)?  It is true of rows without shingles.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(row).cast("long").alias("rid")] if row else []))
    numbered = features(docs, row="rid" if row else None, scheme=scheme)
    rows = saved(numbered if row else numbered.withColumn("rid", F.monotonically_increasing_id()), "near_rows")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid"))
    by = F.first(F.struct(F.col("n").alias("size"), "sig", "quick", "wide"))
    classes = rows.where("n > 0").groupBy("digest").agg(rep.alias("rep"), by.alias("by"))
    classes = saved(classes.select(F.col("rep.rid").alias("cid"), F.col("rep.doc_id").alias("doc_id"), "digest", "by.*"), "near_classes")

    keys = classes.select("cid", F.explode(_keys(scheme)).alias("key"))
    order = F.xxhash64(F.lit("lead"), "cid")
    leads = keys.groupBy("key").agg(F.min(F.struct(order, "cid")).alias("l1"), F.max(F.struct(order, "cid")).alias("l2"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rounds = Series(docs.sparkSession, "near_members")
    members = rounds.put(keys.join(leads.select("key", F.col("l1.cid").alias("lead1"), F.col("l2.cid").alias("lead2"), "n"), "key"))

    lead_pairs = members.select("cid", F.explode(F.array("lead1", "lead2")).alias("l")).where("cid <> l")
    pairs = lead_pairs.select(F.least("cid", "l").alias("a"), F.greatest("cid", "l").alias("b")).distinct()
    fresh = saved(_near(pairs, classes, scheme, percent), "near_pairs")
    comp, sets, slots = None, None, 64
    while True:
        wanted = fresh.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        more = saved(_full_sets(docs, classes, wanted if sets is None else wanted.join(sets, "cid", "left_anti")), "near_sets")
        sets = more if sets is None else sets.unionByName(more)
        links = saved(_confirmed(fresh, sets, percent), "near_links")
        # what earlier links joined is known by its root
        comp = components(links if comp is None else links.unionByName(comp.select(F.col("node").alias("a"), F.col("root").alias("b"))))  # both written
        members = rounds.put(_open_keys(members, comp).drop("root"))
        if members.isEmpty():
            break
        live = members.join(comp, members["cid"] == comp["node"], "left").withColumn("root", F.coalesce("root", "cid")).join(classes.select("cid", *_BY), "cid")
        small = max(SMALL, slots)
        fresh = saved(_open_pairs(live, small, slots, scheme, percent), "near_pairs")
        members = members.where(F.col("n") > small)  # all pairs of the others have now been listed
        slots *= 8
    rounds.clear(docs.sparkSession)
    named = classes.join(comp, classes["cid"] == comp["node"], "left").select("digest", F.coalesce("root", "cid").alias("root"), "doc_id", "cid")
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "cid"))["cid"].alias("lead"))
    label = named.join(names, "root").select("digest", "component_id", "lead", F.lit(True).alias("known"))
    out = rows.join(label, "digest", "left").withColumn("component_id", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")))
    more = [F.col("rid").alias(row), F.coalesce(F.col("rid") == F.col("lead"), F.lit(True)).alias("first")] if row else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *more)
