"""Document fingerprints by closed syncmers.

A k-mer of k UTF-8 bytes is a closed syncmer if, of its s-byte substrings, the one of
least hash is its first or its last (any of them, if several tie). Whether it is one
depends on its own bytes alone, so an edit leaves the anchors elsewhere as they were
and the same passage has the same anchors at the same distances in any document. Two
successive ones are at most k - s + 1 bytes apart.

A fingerprint holds every anchor of a text, in order: the distance from the one before
(a byte) and 24 bits of its hash, in base64. Likeness matches two of them by place:

* an anchor that occurs once in each text fixes a shift between their places;
* an anchor that repeats takes the shift of the nearest such one before it (else behind
  it, else none) and matches if the other text has it there;
* a match counts if a neighbour in the first text matches with the same shift, or if it
  has no neighbour.

The likeness is the number of matches, by that of the anchors of both texts less the
matches. `anchors` lists anchors as rows, `alignment` gives the shifts of two lists.

Null text is empty; an empty text's fingerprint is empty, like itself alone (1.0) and
nothing else. A text without a syncmer, shorter than k for one, has one anchor: the
hash of the whole text. Equal texts have equal fingerprints, and likeness 1.0. Very long
texts are taken whole, with a batch of their own. The next document is the one with the
next lower doc_id (null is the lowest; rows of one doc_id by text); after the last comes
the first, so the only row of a table is its own next. An empty table gives none.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    k: int = 24
    s: int = 8
    chunk: int = 1 << 19


def syncmers(b: np.ndarray, off: np.ndarray, p: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and 24-bit hash of each anchor, by document and place."""
    n, gap = len(off) - 1, p.k - p.s
    h = K.window_hash(b, p.s)
    least, w = h, 1
    while 2 * w <= gap + 1:
        least = np.minimum(least[: max(0, len(least) - w)], least[w:])
        w *= 2
    if gap + 1 > w:
        r = gap + 1 - w
        least = np.minimum(least[: max(0, len(least) - r)], least[r:])
    m = max(0, len(b) - p.k + 1)
    at = np.flatnonzero((h[:m] == least[:m]) | (h[gap : gap + m] == least[:m]))
    doc = np.searchsorted(off, at, side="right") - 1
    ok = at + p.k <= off[doc + 1]
    at, doc = at[ok], doc[ok]
    x = h[at]
    for i in range(p.s, p.k, p.s):
        j = min(i, gap)
        x = K.mix64(x * U64(0x9E3779B97F4A7C15) + h[at + j])
    none = np.ones(n, bool)
    none[doc] = False
    none = np.flatnonzero(none & (np.diff(off) > 0))
    if len(none):
        whole = K.span_hash(b, off[none], off[none + 1])
        doc, at, x = np.r_[doc, none], np.r_[at, off[none]], np.r_[x, whole]
        by = np.argsort(doc, kind="stable")
        doc, at, x = doc[by], at[by], x[by]
    return doc, at - off[doc], (x >> U64(40)).astype(np.int64)


Anchors = tuple[np.ndarray, np.ndarray, np.ndarray]  # document, place, hash; by document and place


def of_texts(texts: list[bytes], p: Settings) -> Anchors:
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return syncmers(np.frombuffer(b"".join(texts), np.uint8), off, p)


def to_text(a: Anchors, n: int) -> list[str]:
    """Fingerprints of documents 0 to n - 1."""
    doc, at, x = a
    same = np.r_[False, doc[1:] == doc[:-1]]
    gap = at - np.where(same, np.r_[0, at[:-1]], 0)
    raw = np.stack([gap, x >> 16, x >> 8, x], 1).astype(np.uint8).tobytes()
    cut = (4 * np.searchsorted(doc, np.arange(n + 1))).tolist()
    return [binascii.b2a_base64(raw[i:j], newline=False).decode() for i, j in zip(cut, cut[1:])]


def of_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes."""
    raw = np.frombuffer(binascii.a2b_base64(fingerprint), np.uint8).reshape(-1, 4).astype(np.int64)
    return np.cumsum(raw[:, 0]), (raw[:, 1] << 16) | (raw[:, 2] << 8) | raw[:, 3]


def _single(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur once, ascending, and where."""
    by = np.argsort(key, kind="stable")
    s = key[by]
    other = np.r_[True, s[1:] != s[:-1], True]
    one = other[1:] & other[:-1]
    return s[one], by[one]


def matches(a: Anchors, b: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors of a match which of b: of document i in a with document i in b."""
    (da, pa_, xa), (db, pb, xb) = a, b
    none = np.zeros(0, np.int64)
    if not len(da) or not len(db):
        return none, none
    ka, ia = _single((da << 24) | xa)
    kb, ib = _single((db << 24) | xb)
    _, u, v = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    mate = np.full(len(da), -1)
    mate[ia[u]] = ib[v]
    fixed = mate >= 0
    n = np.arange(len(da))
    left = np.maximum.accumulate(np.where(fixed, n, -1))
    right = np.minimum.accumulate(np.where(fixed, n, len(da))[::-1])[::-1]
    shift = np.zeros(len(da), np.int64)
    for near, ok in ((right, right < len(da)), (left, left >= 0)):  # the left one goes first
        ok = ok & (da[np.where(ok, near, 0)] == da)
        shift[ok] = (pb[mate[near[ok]]] - pa_[near[ok]])
    rest = np.flatnonzero(~fixed)
    place = (db << 40) + pb
    want = (da[rest] << 40) + pa_[rest] + shift[rest]
    hit = np.minimum(np.searchsorted(place, want), len(db) - 1)
    ok = (place[hit] == want) & (xb[hit] == xa[rest]) & (pa_[rest] + shift[rest] >= 0)
    rest, hit = rest[ok], hit[ok]
    _, first = np.unique(hit, return_index=True)  # shifts that differ may lead to one place
    mate[rest[first]] = hit[first]
    on = mate >= 0
    shift = np.where(on, pb[mate] - pa_, 0)
    pair = (da[1:] == da[:-1]) & on[1:] & on[:-1] & (shift[1:] == shift[:-1])
    alone = np.r_[True, da[1:] != da[:-1]] & np.r_[da[1:] != da[:-1], True]
    counts = np.flatnonzero(on & (np.r_[False, pair] | np.r_[pair, False] | alone))
    return counts, mate[counts]


def likenesses(a: Anchors, b: Anchors, n: int) -> np.ndarray:
    """Likeness of document i of a to document i of b, for i below n."""
    both = np.bincount(a[0][matches(a, b)[0]], minlength=n)
    total = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    return np.where(total > 0, both / np.maximum(total - both, 1), 1.0)


def _lists(fingerprint: str) -> Anchors:
    at, x = of_text(fingerprint)
    return np.zeros(len(at), np.int64), at, x


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return float(likenesses(_lists(a), _lists(b), 1)[0])


def anchors(docs: DataFrame, p: Settings = Settings()) -> DataFrame:
    """doc_id, place (UTF-8 bytes before it) and hash of every anchor of every text."""

    def run(batches):
        for batch in batches:
            for i, j in K.slices(batch.column(1), p.chunk):
                b, off = K.utf8(batch.column(1).slice(i, j - i))
                doc, at, x = syncmers(b, off, p)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), pa.array(at), pa.array(x)], names=["doc_id", "place", "anchor"])

    return C.doc_columns(docs, "doc_id", "text").mapInArrow(C.lean(run), "doc_id bigint, place bigint, anchor bigint")


def alignment(a: str, b: str) -> dict[int, int]:
    """The shifts of places (b's less a's) of the matches of two fingerprints, and the
    number of matches of each."""
    x, y = _lists(a), _lists(b)
    i, j = matches(x, y)
    shifts, n = np.unique(y[1][j] - x[1][i], return_counts=True)
    return dict(zip(shifts.tolist(), n.tolist()))


def with_next(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs (doc_id, text) in descending order within partitions of a range each, with
    `lead` rows behind each range that repeat the row which follows it."""
    keyed = C.doc_columns(docs, "doc_id", "text")
    cuts = C.splits(keyed, "doc_id", C.partitions(docs.sparkSession))
    rows = C.ranged(keyed, "doc_id", cuts)
    tops = C.ranged(keyed.select("doc_id"), "doc_id", cuts).groupBy("_range").agg(F.max("doc_id").alias("top")).orderBy("_range").collect()  # one row a range
    if not tops:
        return rows.withColumn("lead", F.lit(False)), "_range"
    after = [(r["_range"], r["top"], tops[(i + 1) % len(tops)]["_range"]) for i, r in enumerate(tops)]
    names = docs.sparkSession.createDataFrame(after, "_range int, _top bigint, _up int")
    own = F.struct(F.col("_range").alias("to"), F.lit(False).alias("lead"))
    also = F.struct(F.col("_up").alias("to"), F.lit(True).alias("lead"))
    rows = rows.join(F.broadcast(names), "_range").select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_top")), F.array(own, also)).otherwise(F.array(own))).alias("p"))
    rows = rows.select("doc_id", "text", F.col("p.lead").alias("lead"), F.col("p.to").alias("_range"))
    return C.by_range(rows, "_range", len(cuts) + 1).sortWithinPartitions("_range", "lead", F.desc_nulls_last("doc_id"), "text"), "_range"


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, p: Settings = Settings()) -> DataFrame:
    """Each row's fingerprint, that of its text with the latter half replaced by the
    next document's beginning, and its likeness to this and to the next document."""

    def results(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [following]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:])]
        raw, n = [t.encode() for t in edited], len(rows)
        own, new = of_texts([t.encode() for t in texts], p), of_texts(raw, p)
        behind = tuple(c[own[0] > 0] for c in own)
        behind = (behind[0] - 1, *behind[1:])
        first = tuple(c[own[0] < n] for c in own)
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array(to_text(own, n), pa.string()), pa.array(to_text(new, n), pa.string()),
            pa.array(likenesses(first, new, n)), pa.array(likenesses(first, behind, n)),
        ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows that wait for the one behind them
        size = 0
        for b in batches:
            for d, t, lead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = t or ""
                if lead or size > p.chunk:
                    if held:
                        yield results(held, t)
                    held, size = [], 0
                if not lead:
                    held.append((d, t))
                    size += len(t)

    rows, number = with_next(docs)
    return rows.select("doc_id", "text", "lead").mapInArrow(C.lean(run), SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.table(spark, sf_dir, "documents"))
