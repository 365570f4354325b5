"""Near duplicates by ProbMinHash, banding and exact verification.

Shingles are three successive words in lower case (letters, digits and every
character beyond ASCII make words), weighted by how often they occur. Each shingle
has a Poisson process of arrivals whose rate is its weight; an arrival falls into one
of the signature's slots and the earliest one in a slot names it. All arrivals up to
a time are made at once, and a text ends as soon as its slots are full. Two texts
agree in a slot with the probability Jaccard of their shingles,

    sum_i 1 / sum_j max(x_j / x_i, y_j / y_i),

which is also what verification computes, exactly but for 32-bit shingle names.

Texts with the same words form one node. Texts agreeing in all rows of a band are
candidates. For the classes a bucket is not expanded into its pairs: each of its
members is held against one leader, then, where a bucket still has members of several
classes, against another leader. What is then left of a bucket is dealt in blocks, and
each two of its blocks meet in a task's memory, which compares members of different
classes, joins classes as it goes and emits only the pairs that joined two. So every
candidate pair above the threshold ends in one class, and no task holds a bucket.

A pair of similarity j agrees in a band with probability j^rows and is a candidate with
probability 1 - (1 - j^rows)^bands: 0.986 at the threshold of 0.5, 0.997 at 0.55.

Links are then counted in the classes: every two nodes of a class are compared,
candidates or not. A large class is dealt in blocks, and each two of its blocks meet
in a task's memory, which emits sums by node; so no pair is ever a row.

Results for one row of docs each: class_id (the least doc_id that links lead to),
rep_id (the least doc_id with the same words), n_copies (rows with the same words),
n_links (other texts with the same words, and all texts of the class whose
similarity to these reaches the threshold). Null text is empty; texts without words are
alike if equal. Repeated rows are copies. The rows of one doc_id are texts of one
document. Rows with null doc_id are linked like others, each words' sequence as a node of
its own; their class_id is null if their class has no doc_id, and rep_id if no row with
the same words has one. Very long texts are shingled whole, as a batch of their own. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
CHUNK, CHUNK_DOCS = 1 << 19, 4000
HOT = 10_000
BLOCK, BLOCK_NODES, CELLS = 1 << 20, 1024, 1 << 20
#: Equal similarities differ by less, in whatever order they are summed.
SLACK = 1e-9
U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    width: int = 3
    bands: int = 32
    rows: int = 3
    threshold: float = 0.5
    leaders: int = 2


def shingles(arr: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of up to CHUNK_DOCS texts as doc, 52-bit name and count, by
    doc and name; and two 64-bit names of each text's word sequence (0: no words).
    A text of fewer words than width is one shingle."""
    b, off = K.utf8(pc.utf8_lower(arr.fill_null("")))
    n = len(off) - 1
    letter = LETTER[b]
    start = np.zeros(len(b) + 1, bool)
    start[off[:-1]] = True
    start = start[: len(b)]
    first = letter.copy()
    first[1:] &= ~letter[:-1] | start[1:]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | start[1:]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = K.span_hash(b, ws, we)
    counts = K.sums(first, off)
    woff = np.r_[0, np.cumsum(counts)]
    doc = np.repeat(np.arange(n), counts)
    place = np.arange(len(ws)) - woff[doc]
    seq = []
    for salt in (1, 2):
        x = K.mix64((h ^ U64(salt)) + place.astype(U64) * U64(0x9E3779B97F4A7C15))
        c = np.zeros(len(x) + 1, U64)
        np.cumsum(x, out=c[1:])
        s = K.mix64(c[woff[1:]] - c[woff[:-1]] + counts.astype(U64))
        seq.append(np.where(counts > 0, s, U64(0)))
    full = np.flatnonzero(place + width <= counts[doc]) if len(doc) else np.zeros(0, np.int64)
    sh = h[full]
    for i in range(1, width):
        sh = K.join_hash(sh, h[full + i], 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    key = np.r_[(doc[full].astype(U64) << U64(52)) | (sh >> U64(12)), (short.astype(U64) << U64(52)) | (seq[0][short] >> U64(12))]
    key.sort()
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z, np.stack(seq, 1)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key[at] >> U64(52)).astype(np.int64), key[at] & U64((1 << 52) - 1), np.diff(np.r_[at, len(key)]), np.stack(seq, 1)


def signatures(doc: np.ndarray, names: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, n x m names. Texts without shingles keep zeros."""
    q, sig = np.full(n * m, np.inf), np.zeros(n * m, U64)
    rate = np.bincount(doc, weights=weights, minlength=n)
    until = np.where(rate > 0, (np.log(m) + 5) * m / np.maximum(rate, 1), 0.0)
    w = weights.astype(np.float64)

    def gap(at: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        u = K.mix64(names[at] * U64(2 * i + 1) + U64((i * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))
        return u, -np.log(((u >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w[at]

    todo = np.arange(len(doc))
    while len(todo):
        at, t, i = todo, np.zeros(len(todo)), 1
        while len(at):  # the i-th arrivals of the shingles whose (i-1)-th came in time
            u, g = gap(at, i)
            t = t + g
            on = t < until[doc[at]]
            at, t, u = at[on], t[on], u[on]
            slot = doc[at] * m + (K.mix64(u + U64(0x51ED27)) % U64(m)).astype(np.int64)
            np.minimum.at(q, slot, t)
            won = q[slot] == t
            sig[slot[won]] = names[at[won]]
            i += 1
        short = np.isinf(q.reshape(n, m)).any(1) & (rate > 0)
        if not short.any():
            break
        until[short] *= 2  # all is repeated up to the later time, which changes no earlier arrival
        todo = np.flatnonzero(short[doc])
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.zeros((len(sig), bands), U64)
    for r in range(rows):
        x = K.mix64(x * U64(0x9E3779B97F4A7C15) + sig[:, r * bands : (r + 1) * bands] + U64(1))
    return K.mix64(x + np.arange(bands, dtype=U64) * U64(0xD6E8FEB86659FD93)).astype(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Probability Jaccard of two packed shingle lists."""
    (x, p), (y, r) = unpack(a), unpack(b)
    if not len(x) or not len(y):
        return 0.0
    names = np.union1d(x, y)
    wx, wy = np.zeros(len(names)), np.zeros(len(names))
    np.add.at(wx, np.searchsorted(names, x), p)
    np.add.at(wy, np.searchsorted(names, y), r)
    both = (wx > 0) & (wy > 0)
    if not both.any():
        return 0.0
    ratios, n = np.unique(np.stack([wx[both], wy[both]], 1), axis=0, return_counts=True)
    return float(sum(k / np.maximum(wx / i, wy / j).sum() for (i, j), k in zip(ratios, n)))


class Block:
    """Packed shingle lists, none empty, each comparable with all."""

    def __init__(self, blobs: list[bytes]):
        lists = [unpack(b) for b in blobs]
        self.len = np.array([len(x) for x, _ in lists])
        names, self.id = np.unique(np.concatenate([x for x, _ in lists]), return_inverse=True)
        self.w = np.concatenate([w for _, w in lists])
        self.off = np.r_[0, np.cumsum(self.len)]
        for i in np.flatnonzero([len(np.unique(x)) < len(x) for x, _ in lists]).tolist():  # names equal in 32 bits: the first has all
            at = slice(self.off[i], self.off[i + 1])
            _, first, inv = np.unique(self.id[at], return_index=True, return_inverse=True)
            total = np.bincount(inv, self.w[at])
            self.w[at] = 0
            self.w[self.off[i] + first] = total
        if not self.w.all():
            row = np.repeat(np.arange(len(lists)), self.len)[self.w > 0]
            self.id, self.w = self.id[self.w > 0], self.w[self.w > 0]
            self.len = np.bincount(row, minlength=len(lists))
            self.off = np.r_[0, np.cumsum(self.len)]
        self.unit = np.logical_and.reduceat(self.w == 1, self.off[:-1])
        self.weight = np.zeros(len(names))

    def similarities(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Probability Jaccard of list i and each of the lists lo to hi - 1."""
        a = slice(self.off[i], self.off[i + 1])
        part = slice(self.off[lo], self.off[hi])
        self.weight[self.id[a]] = self.w[a]
        own = self.weight[self.id[part]]
        self.weight[self.id[a]] = 0
        both = np.add.reduceat((own > 0).astype(np.int64), self.off[lo:hi] - self.off[lo])
        sim = both / (self.len[i] + self.len[lo:hi] - both)
        rest = np.flatnonzero((both > 0) & ~(self.unit[lo:hi] & self.unit[i]))
        if not len(rest):
            return sim
        x, n = np.unique(self.w[a], return_counts=True)
        step = max(1, CELLS // (len(x) + 1) // len(np.unique(self.w[part])))
        for k in range(0, len(rest), step):
            rows = rest[k : k + step]
            at = np.concatenate([np.arange(self.off[lo + r], self.off[lo + r + 1]) for r in rows.tolist()])
            y, code = np.unique(self.w[at], return_inverse=True)
            shape = (len(rows), len(x) + 1, len(y) + 1)
            xcode = np.where(own[at - part.start] > 0, np.searchsorted(x, own[at - part.start]) + 1, 0)
            cell = (np.repeat(np.arange(len(rows)), self.len[lo + rows]) * shape[1] + xcode) * shape[2] + code + 1
            count = np.bincount(cell, minlength=shape[0] * shape[1] * shape[2]).reshape(shape)  # names by their two weights
            count[:, 1:, 0] = n - count[:, 1:, 1:].sum(2)
            sim[rows] = 0
            for p, r in np.argwhere(count[:, 1:, 1:].any(0)).tolist():
                some = np.flatnonzero(count[:, p + 1, r + 1])
                most = np.maximum.outer(np.r_[0, x] / x[p], np.r_[0, y] / y[r])
                sim[rows[some]] += count[some, p + 1, r + 1] / (count[some].reshape(len(some), -1) @ most.ravel())
        return sim


def pack(names: np.ndarray, weights: np.ndarray) -> bytes:
    x = (names >> U64(20)).astype("<u4").tobytes()
    if (weights == 1).all():
        return x
    return x + (weights.astype("<u2").tobytes() + b"\x01" if weights.max() < 1 << 16 else weights.astype("<u4").tobytes() + b"\x02")


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(b) % 2:
        kind, n = ("<u2", (len(b) - 1) // 6) if b[-1] == 1 else ("<u4", (len(b) - 1) // 8)
        return np.frombuffer(b, "<u4", n), np.frombuffer(b, kind, n, 4 * n).astype(np.float64)
    x = np.frombuffer(b, "<u4")
    return x, np.ones(len(x))


SKETCH = "doc_id bigint, text_key binary, words_key binary, bands array<bigint>, shingles binary"


def sketches(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    def chunk(ids: pa.Array, arr: pa.Array) -> pa.RecordBatch:
        n = len(arr)
        doc, names, weights, seq = shingles(arr, s.width)
        keys = band_keys(signatures(doc, names, weights, n, s.bands * s.rows), s.bands, s.rows)
        off = np.searchsorted(doc, np.arange(n + 1))
        raw = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()[:16] for t in arr.to_pylist()]
        words = [raw[i] if not seq[i, 0] else seq[i].tobytes() + b"w" for i in range(n)]
        flat = [keys[i].tolist() if off[i + 1] > off[i] else [] for i in range(n)]
        blobs = [pack(names[off[i] : off[i + 1]], weights[off[i] : off[i + 1]]) for i in range(n)]
        return pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(words, pa.binary()), pa.array(flat, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names=["doc_id", "text_key", "words_key", "bands", "shingles"])

    def run(batches):
        for b in batches:
            for i, j in K.slices(b.column(1), CHUNK):
                for k in range(i, j, CHUNK_DOCS):
                    n = min(CHUNK_DOCS, j - k)
                    yield chunk(b.column(0).slice(k, n), b.column(1).slice(k, n))

    return C.doc_columns(docs, "doc_id", "text").mapInArrow(C.lean(run), SKETCH)


def verify(pairs: DataFrame, blobs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity reaches the threshold. A node b of
    many pairs, the leader of a large bucket, is dealt to a task for every HOT of them;
    a node a has no more pairs than bands."""

    def run(batches):
        for t in batches:
            sim = np.array([similarity(x, y) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist())], np.float64)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(sim)], names=["a", "b", "sim"])

    hot = pairs.groupBy("b").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    salted = lambda df: df.join(hot, "b", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = blobs.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = salted(blobs.select(F.col("node").alias("b"), F.col("shingles").alias("y"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = salted(pairs).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    both = dealt.join(y.drop("parts"), ["b", "part"]).join(x, "a").select("a", "b", "x", "y")
    return both.mapInArrow(C.lean(run), "a bigint, b bigint, sim double").where(F.col("sim") >= threshold - SLACK).select("a", "b")


def blocks(rows: DataFrame, group: str, *more: str) -> DataFrame:
    """rows (group, node, shingles, more) once for each pair (i, j) of blocks of their
    group that they belong to, by task and sorted by group, i, j, block and node. A block
    has about BLOCK_NODES nodes and BLOCK bytes; a group of one row is left out."""
    sizes = rows.groupBy(group).agg(F.ceil(F.greatest(F.sum(F.length("shingles")) / BLOCK, F.count("*") / BLOCK_NODES)).cast("int").alias("blocks"), F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(sizes.drop("_n"), group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(group, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", *more, "shingles")
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "block", "node")


def by_block(batches, solve, sides: bool = False):
    """What solve(rows, two) yields for the rows of each pair of blocks; two: whether
    they are two blocks, or sides, of which only pairs between them are wanted."""
    key, rows = None, []

    def done():
        two = sides or key is not None and key[1] != key[2]
        if len(rows) < 2 or two and rows[0][0] == rows[-1][0]:
            return None
        return solve(rows, two)

    for t in batches:
        for group, i, j, *row in zip(*(c.to_pylist() for c in t.columns)):
            if (group, i, j) != key:
                if (out := done()) is not None:
                    yield out
                key, rows = (group, i, j), []
            rows.append(tuple(row))
    if (out := done()) is not None:
        yield out


def joined(rows: DataFrame, blobs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of similar nodes that join the classes of each bucket's members, rows
    (node, key, label), as far as their similarity does. The members outside a bucket's
    largest class are one side, in blocks, and all its members the other; so a few strays
    of a large class are held against it once."""

    def solve(own: list[tuple], two: bool) -> pa.RecordBatch:
        """own: (side, node, label, shingles) by side and node."""
        block, node, label = Block([r[3] for r in own]), [r[1] for r in own], [r[2] for r in own]
        parent = {x: x for x in label}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        lo = sum(r[0] == 0 for r in own)
        others = sorted(set(label[lo:]))
        a, b = [], []
        for i in range(lo):
            if all(root(x) == root(label[i]) for x in others):
                continue
            for j in (lo + np.flatnonzero(block.similarities(i, lo, len(own)) >= threshold - SLACK)).tolist():
                x, y = root(label[i]), root(label[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[j])
        return pa.RecordBatch.from_arrays([C.int_col(a), C.int_col(b)], names=["a", "b"])

    def run(batches):
        yield from by_block(batches, solve, sides=True)

    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    rows = C.written(rows.join(most, "key").join(blobs, "node").withColumn("few", (F.col("label") != F.col("most")).cast("int")))
    number = lambda size, n: F.ceil(F.greatest(F.sum(size) / BLOCK, F.sum(n) / BLOCK_NODES)).cast("int")
    bytes_ = F.length("shingles")
    parts = rows.groupBy("key").agg(number(bytes_, F.lit(1)).alias("n_all"), number(bytes_ * F.col("few"), F.col("few")).alias("n_few"))
    rows = rows.join(parts, "key")
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "i", "j", "side", "node", "label", "shingles"]
    left = rows.where("few = 1").withColumns({"i": own("n_few", 1), "side": F.lit(0)}).withColumn("j", each("n_all")).select(columns)
    right = rows.withColumns({"j": own("n_all", 2), "side": F.lit(1)}).withColumn("i", each("n_few")).select(columns)
    dealt = left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    return dealt.mapInArrow(C.lean(run), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge: the least node reached. Labels spread
    to neighbours and along labels, so that long chains halve each time."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    labels = C.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    both = C.written(both)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = C.written(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def classes_of(nodes: DataFrame, blobs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Classes (node, label) of nodes (node, bands) that have links, and the blobs
    (node, shingles) that may have some."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    member = C.written(keys.join(shared, "key").select("node", "key"))
    blobs = C.written(blobs.join(member.select("node").distinct(), "node", "left_semi"))
    found: DataFrame | None = None
    classes: DataFrame | None = None
    for turn in range(s.leaders + 1):
        rows = member.withColumn("label", F.col("node"))
        if classes is not None:
            rows = member.join(classes, "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"))
            mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
            rows = rows.join(mixed, "key")
        if turn < s.leaders:
            first = F.struct(F.xxhash64("node", F.lit(turn)).alias("h") if turn else F.lit(0).alias("h"), F.col("node"), F.col("label"))
            lead = rows.groupBy("key").agg(F.min(first).alias("l")).select("key", F.col("l.node").alias("b"), F.col("l.label").alias("other"))
            pairs = rows.join(lead, "key").where("label <> other").select(F.col("node").alias("a"), "b").distinct()
            new = C.written(verify(pairs, blobs, s.threshold))
        else:
            new = C.written(joined(rows.select("node", "key", "label"), blobs, s.threshold))
        if turn and new.isEmpty():
            continue
        found = new if found is None else found.unionByName(new)
        classes = components(found)
    return classes, blobs


def linked(classes: DataFrame, blobs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): the texts of all other nodes of a node's class (node, label) that
    are similar to it. texts: (node, n), their number for each node. Several blobs
    (node, shingles) of a node count as one that is similar if one of them is."""

    def sums(rows: list[tuple[int, int, int, bytes]], two: bool) -> dict[int, int]:
        """rows: (block, node, n, shingles) by block and node."""
        block = Block([r[3] for r in rows])
        nodes, node = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)
        n = np.zeros(len(nodes), np.int64)
        n[node] = [r[2] for r in rows]
        half = sum(r[0] == rows[0][0] for r in rows) if two else 0
        several = len(nodes) < len(rows)
        total, seen = np.zeros(len(nodes), np.int64), set()
        for i in range(half or len(rows) - 1):
            lo = half or i + 1
            near = node[lo + np.flatnonzero(block.similarities(i, lo, len(rows)) >= threshold - SLACK)]
            if several:
                near = np.array([b for b in np.unique(near).tolist() if b != node[i] and (node[i], b) not in seen], np.int64)
                seen.update(x for b in near.tolist() for x in ((node[i], b), (b, node[i])))
            total[node[i]] += n[near].sum()
            total[near] += n[node[i]]
        return dict(zip(nodes.tolist(), total.tolist()))

    def solve(rows: list[tuple], two: bool) -> pa.RecordBatch:
        got = sums(rows, two)
        return pa.RecordBatch.from_arrays([C.int_col(list(got)), C.int_col(list(got.values()))], names=["node", "linked"])

    def run(batches):
        yield from by_block(batches, solve)

    rows = classes.join(blobs.distinct(), "node").join(texts, "node")
    return blocks(rows, "label", "n").mapInArrow(C.lean(run), "node bigint, linked bigint").groupBy("node").agg(F.sum("linked").alias("linked"))


#: A node of rows without doc_id is its words' hash beyond this, above any doc_id below it.
UNNAMED = 1 << 62


def grouped(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows' sketches, groups of rows with the same words, and classes_of the groups'
    nodes: the least doc_id or, without one, a number of their words."""
    rows = C.written(sketches(docs, s))
    unnamed = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("words_key"), 2)
    groups = rows.groupBy("words_key").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n_copies"), F.countDistinct("text_key").alias("n_texts"))
    groups = C.written(groups.withColumn("node", F.coalesce("rep_id", unnamed)))
    own = rows.where(F.size("bands") > 0).select(F.coalesce("doc_id", unnamed).alias("node"), "doc_id", "words_key", "bands", "shingles")
    own = own.where("doc_id is not null").union(own.where("doc_id is null").dropDuplicates(["words_key"]))  # copies without doc_id are one node
    nodes = own.select("node", "words_key", "bands").join(groups.select("node").distinct(), "node", "left_semi")
    nodes = nodes.dropDuplicates(["node", "words_key"]).select("node", "bands")
    return rows, groups, *classes_of(nodes, own.select("node", "shingles"), s)


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, rep_id, n_copies and n_links of each row of docs."""
    rows, groups, classes, blobs = grouped(docs, s)
    texts = groups.groupBy("node").agg(F.sum("n_texts").alias("n"))
    info = groups.join(classes, "node", "left").join(linked(classes, blobs, texts, s.threshold), "node", "left")
    # a class with a doc_id has it as its label, as these are below the others' nodes
    label = F.coalesce("label", "node")
    named = F.when(F.col("label").isNull(), F.col("rep_id")).when(F.col("rep_id").isNotNull() | (label < UNNAMED), label)
    info = info.select("words_key", named.alias("class_id"), "rep_id", "n_copies", (F.col("n_texts") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "words_key").join(info, "words_key").select("doc_id", "class_id", "rep_id", "n_copies", "n_links")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one document of each class: that of its least doc_id or, if it has
    none, of the least number of its words. Of equal rows one stays."""
    rows, groups, classes, _ = grouped(docs, s)
    first = groups.join(classes, "node", "left").where("label is null or label = node").select("words_key", "node")
    found = rows.select("doc_id", "words_key", "text_key").join(first, "words_key").where("doc_id is null and node >= %d or doc_id = node" % UNNAMED)
    (own, text) = C.fresh(docs.columns, "_id", "_text")
    none = F.lit(-(1 << 63)).cast("bigint")
    # a row without doc_id is known by its text; of several with the same words the least stays
    named = found.where("doc_id is not null").select(F.col("doc_id").alias(own), F.lit(None).cast("binary").alias(text)).distinct()
    unnamed = found.where("doc_id is null").groupBy("words_key").agg(F.min("text_key").alias(text)).select(none.alias(own), text)
    keep = named.union(unnamed)
    key = F.when(F.col("doc_id").isNull(), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16))
    kept = docs.withColumns({own: F.coalesce("doc_id", none), text: key})
    kept = kept.join(keep.withColumnsRenamed({own: "_k1", text: "_k2"}), (F.col(own) == F.col("_k1")) & F.col(text).eqNullSafe(F.col("_k2")), "left_semi")
    return kept.dropDuplicates([own, "text"]).select([F.col(f"`{c}`") for c in docs.columns])


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
