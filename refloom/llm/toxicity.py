"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over a text's distinct terms:
its words in lower case, their first four and five letters, and a reading of words
with digits or signs as letters. The pair term learns what an additive weight can't:
an insult together with the mention of a group.

The model is fitted by AdaGrad on at most `max_docs` labelled rows of each class (a
documented bound: the lowest hashes of doc_id; one task selects terms, and the driver
fits on the numbers of those). Of a class's sampled rows that share their four lowest
term hashes (near copies; all terms, if fewer) the first teaches. Terms with a weight are
those of at least `min_docs` sampled rows

* whose rates in the two classes differ by at least `min_z` standard errors, or
* that tell together: of the pairs of terms of at least `pair_rate` of the rows, where
  neither nearly always comes with the other, the `pairs` pairs whose covariance differs
  most between the classes, by at least `pair_z` standard errors. So two words that are
  alone as common in both classes have a weight and factors, too.

Classes are drawn evenly and w0 then moved to the rate of all labelled rows. Scoring
reads every whole text, however long.

Null and empty texts have no terms and score sigmoid(w0). Equal texts score the same,
repeated rows each have a row. Terms whose hashes are equal are one term. Labels that
are null, contradict each other or belong to no document: null is ignored, any 1 makes
the id 1, and ids without documents are ignored. Without rows of both classes, every
score is the rate of label 1 (0.0 without labels). An empty table of documents gives no
rows. Columns other than doc_id and text are not read; keep_clean carries them along.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .kernels import mix64, slices

LEET = str.maketrans("01345789@$!|", "oieastbgasil")
EDGES = ".,;:!?|%$#*&\"'()[]{}<>«»„“”…-_+=/\\"
CACHE = 300_000
CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    factors: int = 8
    max_docs: int = 4000
    min_docs: int = 3
    min_z: float = 3.5
    pair_rate: float = 0.02
    pair_z: float = 8.0
    pairs: int = 100
    epochs: int = 30
    steps: int = 2000
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  # 2^bits
    factors: np.ndarray  # 2^bits x k
    bits: int


class Terms:
    """Distinct term numbers of texts; keeps those of words seen before."""

    def __init__(self, bits: int):
        self.mask, self.known = (1 << bits) - 1, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        core = word.strip(EDGES)
        forms = []
        if core:
            forms.append("w" + core)
            if len(core) > 4:
                forms.append("4" + core[:4])
            if len(core) > 5:
                forms.append("5" + core[:5])
        if not core.isalpha():
            plain = "".join(c for c in word.translate(LEET) if c.isalpha())
            if plain and plain != core:
                forms.append("w" + plain)
        return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) & self.mask for f in forms)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        known, found = self.known, set()
        for w in set(text.lower().split()):
            t = known.get(w)
            if t is None:
                t = self.of_word(w)
                if len(known) >= CACHE:
                    known.clear()
                if len(w) <= 64:
                    known[w] = t
            found.update(t)
        return np.sort(np.fromiter(found, np.int64, len(found)))


def fit(rows: list[np.ndarray], y: np.ndarray, rate: float, s: Settings) -> Model:
    """rows: each text's telling terms, in a fixed order; rate: of label 1 in all
    labels."""
    n = 1 << s.bits
    w, v = np.zeros(n, np.float32), np.zeros((n, s.factors), np.float32)
    y = np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        p = min(max(rate, 0.0), 1.0)
        return Model(float(np.log(p / (1 - p))) if 0 < p < 1 else (50.0 if p == 1 else -50.0), w, v, s.bits)
    used = np.unique(np.concatenate(rows))
    rng = np.random.default_rng(7)
    v[used] = rng.normal(0, 0.01, (len(used), s.factors)).astype(np.float32)
    gw, gv, gb, b = np.full(n, 1e-2, np.float32), np.full((n, s.factors), 1e-2, np.float32), 1e-2, 0.0
    for _ in range(max(s.epochs, -(-s.steps * s.batch // len(y)))):  # small samples are gone over more often
        order = rng.permutation(len(y))
        for at in range(0, len(y), s.batch):
            own = [rows[i] for i in order[at : at + s.batch]]
            t = y[order[at : at + s.batch]]
            lens = np.array([len(r) for r in own])
            idx = np.concatenate(own)
            doc = np.repeat(np.arange(len(own)), lens)
            off = np.r_[0, np.cumsum(lens)]
            vi = v[idx]
            total = _by_row(vi, off)
            z = b + _by_row(w[idx][:, None], off)[:, 0] + 0.5 * ((total**2).sum(1) - _by_row(vi**2, off).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) / len(t)
            db = float(g.sum())
            gb += db * db
            b -= s.rate * db / np.sqrt(gb)
            if not len(idx):
                continue
            by = np.argsort(idx, kind="stable")
            terms, first = np.unique(idx[by], return_index=True)
            gd = g[doc][by].astype(np.float32)
            dw = np.add.reduceat(gd, first) + s.decay * w[terms] / len(rows)
            dv = np.add.reduceat(gd[:, None] * (total[doc[by]] - vi[by]), first, axis=0) + s.decay * v[terms]
            gw[terms] += dw * dw
            gv[terms] += dv * dv
            w[terms] -= s.rate * dw / np.sqrt(gw[terms])
            v[terms] -= 0.2 * s.rate * dv / np.sqrt(gv[terms])
    share = float(y.mean())
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    b += np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    return Model(float(b), w, v, s.bits)


def _once(rows: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Near copies teach nothing new: of the rows of a class that share their four
    lowest term hashes (or all, if fewer), the first stays."""
    seen, keep = set(), []
    for i, r in enumerate(rows):
        key = (float(y[i]), np.sort(mix64(r.astype(np.uint64) + np.uint64(1)))[:4].tobytes())
        if key not in seen:
            keep.append(i)
        seen.add(key)
    return [rows[i] for i in keep], y[keep]


def selected(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows without near copies, and of their terms the telling ones."""
    if not len(y) or y.min() == y.max():
        return [r[:0] for r in rows], y
    rows, y = _once(rows, y)
    used = telling(rows, y, 1 << s.bits, s) | coupled(rows, y, 1 << s.bits, s)
    return [r[used[r]] for r in rows], y


def telling(rows: list[np.ndarray], y: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """The terms whose rates in the two classes differ by min_z standard errors."""
    all_ = [np.concatenate([r for r, t in zip(rows, y) if t == c] or [np.zeros(0, int)]) for c in (0, 1)]
    c0, c1 = (np.bincount(x, minlength=n) for x in all_)
    n1 = float(y.sum())
    n0 = len(y) - n1
    p = (c0 + c1) / len(y)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return (c0 + c1 >= s.min_docs) & (np.abs(z) >= s.min_z)


def coupled(rows: list[np.ndarray], y: np.ndarray, n: int, s: Settings, chunk: int = 128) -> np.ndarray:
    """The terms of the pairs that tell together: counted as matrix products of the
    sampled rows, some columns at a time."""
    out = np.zeros(n, bool)
    count = np.bincount(np.concatenate(rows), minlength=n)
    terms = np.flatnonzero((count >= max(s.min_docs, s.pair_rate * len(rows))) & (count < len(rows)))
    if len(terms) < 2 or not s.pairs:
        return out
    place = np.full(n, -1)
    place[terms] = np.arange(len(terms))
    has = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        own = place[r]
        has[i, own[own >= 0]] = 1
    classes = [has[y > 0.5], has[y <= 0.5]]
    del has
    rates = [c.mean(0) for c in classes]
    best, found = np.zeros(0), np.zeros((0, 2), np.int64)
    for at in range(0, len(terms), chunk):
        part = slice(at, at + chunk)
        gap, error, both = 0.0, 0.0, 0.0
        for own, p, sign in zip(classes, rates, (1, -1)):
            joint = own.T @ own[:, part]
            cov = joint / len(own) - np.outer(p, p[part])
            spread = np.outer(p * (1 - p), (p * (1 - p))[part]) + cov * np.outer(1 - 2 * p, 1 - 2 * p[part]) - cov**2
            gap, error, both = gap + sign * cov, error + np.maximum(spread, 1 / len(own)) / len(own), both + joint
        z = np.abs(gap) / np.sqrt(error)
        z[both > 0.9 * np.minimum.outer(count[terms], count[terms[part]])] = 0  # one comes with the other
        z[np.arange(len(terms))[:, None] >= np.arange(at, at + z.shape[1])] = 0
        a, b = np.nonzero(z >= s.pair_z)
        best, found = np.r_[best, z[a, b]], np.concatenate([found, np.stack([terms[a], terms[b + at]], 1)])
        by = np.lexsort((found[:, 1], found[:, 0], -best))[: s.pairs]
        best, found = best[by], found[by]
    out[found.ravel()] = True
    return out


def _by_row(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros((len(x) + 1, x.shape[1]), np.float64)
    np.cumsum(x, axis=0, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def score(model: Model, terms: np.ndarray) -> float:
    vi = model.factors[terms].astype(np.float64)
    z = model.bias + float(model.weights[terms].astype(np.float64).sum()) + 0.5 * float((vi.sum(0) ** 2).sum() - (vi**2).sum())
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _labelled(labels: DataFrame, label: str, held_out: F.Column) -> DataFrame:
    return labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("doc_id is not null and _y in (0, 1)").where(~held_out).groupBy("doc_id").agg(F.max("_y").alias("_y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", s: Settings = Settings(), folds: int = 5) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    known = _labelled(labels, label, C.crc32_text(F.col("doc_id")) % folds == 0)
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("_y = 1").orderBy(*order).limit(s.max_docs).union(known.where("_y = 0").orderBy(*order).limit(s.max_docs))
    ids = spark.createDataFrame([tuple(r) for r in chosen.collect()], "_id bigint, _y int")  # at most 2 * max_docs
    sample = C.doc_columns(docs, "doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = Terms(s.bits)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([terms(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "y", "terms"])

    def choose(batches):
        """The whole sample in one task: at most 2 * max_docs rows."""
        got = sorted((d, t, y) for b in batches for d, t, y in zip(*(b.column(i).to_pylist() for i in range(3))))
        terms, y = selected([np.frombuffer(t, np.int32).astype(np.int64) for _, t, _ in got], np.array([y for _, _, y in got], np.float32), s)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(y)), pa.int32()), pa.array(y.astype(np.int32)), pa.array([t.astype(np.int32).tobytes() for t in terms], pa.binary())], names=["at", "y", "terms"])

    # rows with one id may repeat: the lowest terms stand for them, so that the bound holds
    own = C.arrow_map(sample, extract, "doc_id bigint, y int, terms binary").groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("y").alias("y"))
    rows = sorted(own.repartition(1).mapInArrow(C.lean(choose), "at int, y int, terms binary").collect())
    return fit([np.frombuffer(r["terms"], np.int32).astype(np.int64) for r in rows], np.array([r["y"] for r in rows]), rate, s)


def _scores(model: Model, terms: Terms, arr: pa.Array) -> np.ndarray:
    out = np.zeros(len(arr))
    for i, j in slices(arr, CHUNK):  # so that a batch's texts are never all Python strings
        out[i:j] = [score(model, terms(t)) for t in arr.slice(i, j - i).to_pylist()]
    return out


def toxicity(docs: DataFrame, model: Model, s: Settings = Settings(), folds: int = 5) -> DataFrame:
    """One row per row of docs (doc_id, text): held_out, score and predicted."""

    def run(batches):
        terms = Terms(model.bits)
        for b in batches:
            x = _scores(model, terms, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x), pa.array((x >= s.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(C.crc32_text(F.col("doc_id")) % folds == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(C.lean(run), "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """The rows of docs that score below the threshold, all columns unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        terms = Terms(model.bits)
        for b in batches:
            yield b.filter(pa.array(_scores(model, terms, b.column(at)) < s.threshold))

    return docs.mapInArrow(C.lean(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, C.table(spark, sf_dir, "labels")))
