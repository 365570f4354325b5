"""Exact removal of repeated byte strings across documents.

Every byte covered by a `length`-byte string that also starts earlier goes: in a
smaller doc_id, or earlier in the same document. Strings lie within one document and
are judged on the input.

A merged transform of all text at once costs depth / step rounds over every byte, each
of them a shuffle of 8 bytes for each byte of text. So what can't repeat is set aside
first, and the rest is partitioned so that equal windows meet:

1. The anchor of a window of `length` bytes is its leftmost least 24-byte hash. It
   depends on the window's bytes alone, so equal windows have equal anchors. Windows
   in a row with one anchor form a run.
2. Runs meet by anchor. A run whose anchor no other run has is set aside: none of its
   windows repeats. Nothing else is decided here.
3. The bytes of all other runs meet by anchor, too, and go through the transforms. A
   task's strings are taken a batch of whole anchors at a time, cut into shards, whose
   Burrows-Wheeler transforms are merged by interleave refinement (bwt.py). The intervals
   of suffixes with `length` bytes in common are the repeated windows, and all but the
   earliest of an interval go.

Candidates are taken in `rounds` by their anchors, so that only a share of their bytes is
on the shuffle's disk at a time. Shards are cut behind the exchange by anchor and not before it, since a shard of each
pair of partitions would hold less than a string at scale.

Anchors of more than 1/5000 of all runs in a sample of documents (at most 5000, which
serves only to plan) are dealt to many tasks; the earliest windows of their intervals are
compared between tasks by a grouped minimum. Hashes name anchors, symbols and, of dealt
anchors, windows, by 64, 64 and 128 bits.

Null text is empty. Rows of one doc_id: equal rows get the same result, and of two
different texts the one with the lower SHA-256 is earlier. A null doc_id is before
all others. Very long texts are taken whole, with a batch of their own. An empty table
gives no rows. Columns other than doc_id and text are not read; without_repeats carries
them along.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bwt
from . import common as C
from . import kernels as K

CHUNK = 1 << 19
U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    length: int = 100
    anchor: int = 24
    step: int = 25
    sample: int = 64
    hot_rows: int = 1_000_000
    salts: int = 64
    batch_bytes: int = 1 << 20
    rounds: int = 2


def window_runs(b: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first window, number of windows and
    anchor's hash."""
    n = len(b)
    h = K.window_hash(b, s.anchor)
    if n < s.length:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    bits = U64(max(1, int(n).bit_length()))
    low = (U64(1) << bits) - U64(1)
    m = (h & ~low) | np.arange(len(h), dtype=U64)
    width, k = s.length - s.anchor + 1, 1
    while 2 * k <= width:
        m = np.minimum(m[: len(m) - k], m[k:])
        k *= 2
    rest = width - k
    if rest:
        m = np.minimum(m[: len(m) - rest], m[rest:])
    place = (m & low).astype(np.int64)  # of each window's anchor
    doc_end = np.repeat(off[1:], np.diff(off))[: len(place)]
    ok = np.arange(len(place)) + s.length <= doc_end
    new = np.r_[True, (place[1:] != place[:-1]) | (doc_end[1:] != doc_end[:-1])] & ok
    start = np.flatnonzero(new)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    bound = np.flatnonzero(new | ~ok)
    after = np.searchsorted(bound, start, side="right")
    end = np.where(after < len(bound), bound[np.minimum(after, len(bound) - 1)], len(place))
    doc = np.searchsorted(off, start, side="right") - 1
    return doc, start - off[doc], end - start, h[place[start]].astype(np.int64)


RUN = "doc bigint, tie int, start int, n int, anchor bigint"
PART = 1 << 17


def runs_of(docs: DataFrame, s: Settings) -> DataFrame:
    """RUN rows of docs (doc, tie, text)."""

    def run(batches):
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1)
            for i, j in K.slices(batch.column(2), CHUNK):
                b, off = K.utf8(batch.column(2).slice(i, j - i))
                doc, start, n, anchor = window_runs(b, off, s)
                if len(doc):
                    at = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays([ids.take(at), ties.take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor)], names=["doc", "tie", "start", "n", "anchor"])

    return docs.select("doc", "tie", "text").mapInArrow(C.lean(run), RUN)


def _several(batches):
    """Of rows (RUN, hot) sorted by anchor those whose anchor another row has, and all
    hot ones. Holds one batch and the last row."""
    last, waiting = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        same = np.r_[last is not None and anchor[0] == last, anchor[1:] == anchor[:-1]]
        keep = same | np.r_[same[1:], False] | hot
        if waiting is not None and same[0]:
            yield waiting
        at = np.flatnonzero(keep)
        if len(at):
            yield batch.take(pa.array(at))
        waiting = None if keep[-1] else batch.slice(batch.num_rows - 1)
        last = anchor[-1]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null: the least bigint) and tie: 0 but where rows of one doc_id differ."""
    base = C.doc_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")).alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    twice = base.groupBy("doc").count().where("count > 1").select("doc")
    if twice.isEmpty():
        return base.withColumn("tie", F.lit(0))
    named = base.withColumn("_d", F.sha2("text", 256))
    kinds = named.join(twice, "doc", "left_semi").select("doc", "_d").distinct()
    ties = kinds.withColumn("tie", (F.row_number().over(Window.partitionBy("doc").orderBy("_d")) - 1).cast("int"))
    return named.join(ties, ["doc", "_d"], "left").select("doc", "doc_id", "text", F.coalesce("tie", F.lit(0)).alias("tie"))


def _hot(docs: DataFrame, s: Settings) -> list[int]:
    """Anchors that many runs have, judged on the documents whose hash is 0 modulo
    s.sample: at most 5000."""
    seen = runs_of(docs.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(s.sample)) == 0), s).groupBy("anchor").count()
    seen = seen.where(F.col("count") >= max(1, s.hot_rows // s.sample))
    top = seen.agg(F.sum("count").alias("all")).first()["all"]
    if not top:
        return []
    rows = seen.where(F.col("count") > top / 5000).select("anchor").collect()
    return [r["anchor"] for r in rows]


def _by_document(rows: DataFrame):
    """Grouped by document, and shuffled as rows: lists made before the shuffle hold
    one or two runs each and only add to it."""
    return rows.repartition(C.partitions(rows.sparkSession), "doc", "tie").groupBy("doc", "tie")


def _extract(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """The bytes of wanted runs."""
    lists = _by_document(wanted).agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("runs"))

    def cut(batches):
        for batch in batches:
            for i, j in K.slices(batch.column(2), CHUNK):
                ids, ties, texts, runs = (batch.column(k).slice(i, j - i) for k in range(4))
                b, off = K.utf8(texts)
                owner = np.repeat(np.arange(j - i), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                flat = runs.flatten()
                for k in range(0, len(flat), PART):
                    doc = owner[k : k + PART]
                    start, n, anchor, hot = (pc.struct_field(flat.slice(k, PART), f) for f in range(4))
                    size = n.to_numpy(zero_copy_only=False).astype(np.int64) + s.length - 1
                    ends = np.cumsum(size)
                    at = np.repeat(off[doc] + start.to_numpy(zero_copy_only=False) - (ends - size), size) + np.arange(ends[-1])
                    raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(b[at])])
                    own = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([ids.take(own), ties.take(own), start, anchor, hot, raw], names=["doc", "tie", "start", "anchor", "hot", "bytes"])

    return docs.join(lists, ["doc", "tie"]).select("doc", "tie", "text", "runs").mapInArrow(C.lean(cut), "doc bigint, tie int, start int, anchor bigint, hot boolean, bytes binary")


WINDOWS = "doc bigint, tie int, start int, n int, w1 bigint, w2 bigint"


def _merged(s: Settings):
    """Streams strings sorted by hot, anchor, doc, tie and start through merged
    transforms. Yields repeated windows as runs (w1 null); and the earliest of each
    interval as windows with their hashes, where other tasks or batches hold the same
    anchor."""

    def solve(rows: pa.RecordBatch, spread: bool) -> pa.RecordBatch:
        doc, tie, start = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        text, off = K.utf8(rows.column(5))
        place, lead = bwt.repeated_windows(text, off, s.length, s.step)
        owner = np.searchsorted(off, place, side="right") - 1
        first = np.maximum.accumulate(np.where(lead, np.arange(len(place)), 0))
        of, at = owner[first], start[owner] + place - off[owner]
        again = ~lead & ((doc[owner] != doc[of]) | (tie[owner] != tie[of]) | (at != at[first]))  # else a repeated row
        mask = np.zeros(len(text), bool)
        mask[place[again]] = True
        lo, hi = K.runs(mask)
        own = np.searchsorted(off, lo, side="right") - 1
        cols = [doc[own], tie[own], start[own] + lo - off[own], hi - lo]
        w = [pa.nulls(len(lo), pa.int64())] * 2
        if spread:
            y = np.flatnonzero(lead)
            raw = text.tobytes()
            dig = np.frombuffer(b"".join(hashlib.blake2b(raw[q : q + s.length], digest_size=16).digest() for q in place[y].tolist()), np.int64).reshape(-1, 2)
            cols = [np.r_[c, e] for c, e in zip(cols, (doc[owner[y]], tie[owner[y]], at[y], np.ones(len(y), np.int64)))]
            w = [pa.concat_arrays([w[0], pa.array(dig[:, i])]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), *[pa.array(c.astype(np.int32)) for c in cols[1:]], *w], names=["doc", "tie", "start", "n", "w1", "w2"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, split = 0, None  # split: the anchor of which a part has gone

        def parts(more: bool):
            """Solves what is held but, if more is to come, for the last anchor's strings."""
            nonlocal held, size, split
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchor, hot = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True]).tolist()
            end = new[-2] if more else new[-1]
            if not end and size < 4 * s.batch_bytes:
                held = [rows]
                return
            cut = not end  # one anchor fills a batch: its windows meet again by hash
            end = end or new[-1]
            own = new[1] if anchor[0] == split else 0
            edges = sorted({0, own, min(int(np.searchsorted(hot, True)), end), end})
            for i, j in zip(edges, edges[1:]):
                yield solve(rows.slice(i, j - i), bool(hot[i]) or cut or i < own)
            split = anchor[0] if cut else None
            held = [rows.slice(end)] if end < rows.num_rows else []
            size = sum(len(K.utf8(h.column(5))[0]) for h in held)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(K.utf8(batch.column(5))[0])
                if size >= s.batch_bytes:
                    yield from parts(True)
        if held:
            yield from parts(False)

    return run


def repeated_runs(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc, tie, start, n): windows of docs (doc, tie, text) that start earlier too."""
    parts = C.partitions(docs.sparkSession)
    hot = _hot(docs, s)
    rows = runs_of(docs, s)
    if hot:
        names = docs.sparkSession.createDataFrame([(h,) for h in hot], "anchor bigint")
        rows = rows.join(F.broadcast(names.withColumn("hot", F.lit(True))), "anchor", "left").select("doc", "tie", "start", "n", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    else:
        rows = rows.withColumn("hot", F.lit(False))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "start"), F.lit(s.salts))).otherwise(F.lit(0))
    found = C.written(rows.repartition(parts, "anchor", salt).sortWithinPartitions("anchor").mapInArrow(C.lean(_several), RUN + ", hot boolean"))
    windows: DataFrame | None = None
    for r in range(s.rounds):
        some = found.where(F.pmod("anchor", F.lit(s.rounds)) == r)
        new = C.written(_extract(docs, some, s).repartition(parts, "anchor", salt).sortWithinPartitions("hot", "anchor", "doc", "tie", "start").mapInArrow(C.lean(_merged(s)), WINDOWS))
        windows = new if windows is None else windows.union(new)
    C.dropped(found)
    out = windows.where("w1 is null").select("doc", "tie", "start", "n")
    spread = windows.where("w1 is not null")
    if not spread.isEmpty():
        least = spread.groupBy("w1", "w2").agg(F.min(F.struct("doc", "tie", "start")).alias("f"))
        late = spread.join(least, ["w1", "w2"]).where(F.struct("doc", "tie", "start") > F.col("f"))
        # where an earlier task's window is the same, the windows of this block after its first are gone already
        out = out.union(late.select("doc", "tie", "start", "n"))
    return out


def _cut(docs: DataFrame, s: Settings) -> DataFrame:
    """docs (doc, tie, ...) with gone: arrays of the starts and ends of removed runs."""
    found = repeated_runs(docs.select("doc", "tie", "text"), s)
    lists = _by_document(found).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return docs.join(lists, ["doc", "tie"], "left")


def removed(n: int, start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of a text of n bytes, from repeated
    windows that start at `start` and the count - 1 places behind it."""
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z
    return K.runs(K.union_mask(start, start + count + length - 1, n))


def _keep(text: bytes, start: np.ndarray, count: np.ndarray, length: int) -> tuple[bytes, int, int]:
    lo, hi = removed(len(text), start, count, length)
    if not len(lo):
        return text, 0, 0
    edges = np.r_[0, np.stack([lo, hi], 1).ravel(), len(text)].tolist()
    return b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])), int((hi - lo).sum()), len(lo)


def _kept(texts: pa.Array, runs: pa.Array, length: int):
    """(first row, behind the last row, sizes, results of _keep) for a part of the rows
    at a time, so that neither texts nor runs of a batch are all Python objects."""
    for i, j in K.slices(texts, CHUNK):
        own = runs.slice(i, j - i)
        at = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))]
        flat = own.flatten()
        start, count = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        b, off = K.utf8(texts.slice(i, j - i))
        yield i, j, np.diff(off), [_keep(b[off[k] : off[k + 1]].tobytes(), start[at[k] : at[k + 1]], count[at[k] : at[k + 1]], length) for k in range(j - i)]


def suffix_dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""

    def run(batches):
        for b in batches:
            for i, j, size, rows in _kept(b.column(1), b.column(2), s.length):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _cut(_keyed(docs), s).select("doc_id", "text", "runs").mapInArrow(C.lean(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with repeated bytes taken out of text and n_chars (if there) set anew. A
    character that loses a byte goes; a text that loses all is empty and stays."""
    columns = docs.columns
    key = C.doc_columns(docs, "doc_id", "text")
    keyed = _keyed(key)
    found = repeated_runs(keyed.select("doc", "tie", "text"), s)
    key, tie, digest, runs = C.fresh(columns, "_doc", "_tie", "_digest", "_runs")
    lists = _by_document(found).agg(F.collect_list(F.struct("start", "n")).alias(runs)).withColumnsRenamed({"doc": key, "tie": tie})
    whole = docs.withColumn(key, F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")))
    if not keyed.where("tie > 0").isEmpty():
        ties = keyed.select(F.col("doc").alias(key), F.sha2("text", 256).alias(digest), F.col("tie").alias(tie)).distinct()
        whole = whole.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256)).join(ties, [key, digest], "left")
    else:
        whole = whole.withColumn(tie, F.lit(0))
    joined = whole.join(lists, [key, tie], "left").select(*[F.col(f"`{c}`") for c in columns], F.col(runs))
    at = columns.index("text")

    def run(batches):
        for b in batches:
            for i, j, _, rows in _kept(b.column(at), b.column(len(columns)), s.length):
                cols = [b.column(k).slice(i, j - i) for k in range(len(columns))]
                texts = [r[0].decode("utf-8", "ignore") if v else None for r, v in zip(rows, cols[at].is_valid().to_pylist())]
                cols[at] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    k = columns.index("n_chars")
                    cols[k] = pa.array([None if t is None else len(t) for t in texts], cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return joined.mapInArrow(C.lean(run), T.StructType(docs.schema.fields))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(C.table(spark, sf_dir, "documents"))


#: The query's rows for DuckDB, whose strings are cut as hexadecimal bytes. Windows are
#: compared by MD5.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) k FROM (SELECT doc_id, h, unnest(range(n - 99)) p FROM d WHERE n >= 100)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 again FROM w),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END jump FROM f WHERE again),
i AS (SELECT doc_id, p, sum(jump) OVER (PARTITION BY doc_id ORDER BY p) run FROM g),
s AS (SELECT doc_id, min(p) lo, max(p) + 100 hi FROM i GROUP BY doc_id, run),
t AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) prev FROM s),
r AS (SELECT t.doc_id, count(*) spans, sum(hi - lo)::BIGINT gone, string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
