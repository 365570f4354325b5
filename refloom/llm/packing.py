"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its pieces best-fit, longest first, and emits the bins that are
nearly full (at most `slack` tokens free). Underfull bins become items: they meet in
fewer partitions, are packed best-fit again, and so on up a tree until one task holds
what is left or a round saves less than a twentieth of the bins. A round deals underfull
bins at random, so each of its tasks sees the same mix of fills as any other; what best
fit can't pair among `fan_in` of them it could not among all. No task holds more than
`window` pieces or about `fan_in` bins; a bin has at most `capacity` pieces.

Only documents longer than the capacity are cut. Null text is empty, and an empty
document is its end token alone. Every row of docs is packed, repeated ones as often
as they occur; of equal lengths the earlier piece goes first. Very long texts give as many
pieces as they need. An empty table gives no sequences. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K

BIN = "full boolean, fill int, doc_id array<bigint>, piece array<int>, start array<bigint>, length array<int>, ids_crc32 array<bigint>"
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
LISTS = ["doc_id", "piece", "start", "length", "ids_crc32"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]


@dataclass(frozen=True)
class Settings:
    capacity: int = 4096
    slack: int = 16
    window: int = 200_000
    fan_in: int = 20_000
    end_id: int = 1
    vocabulary: str = K.WORD_BPE
    folder: str | None = None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room. Of
    equal lengths the earlier item goes first."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    some = 0  # bit r: room[r] isn't empty
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= n
        if r:
            if not room[r]:
                some |= 1 << r
            room[r].append(b)
    return bins


def _bins(items: list[tuple[int, list[tuple]]], s: Settings, last: bool = False) -> pa.RecordBatch:
    """Packs items (length, pieces) into BIN rows."""
    packed = [[p for i in b for p in items[i][1]] for b in best_fit([n for n, _ in items], s.capacity)]
    fill = [sum(p[3] for p in b) for b in packed]
    cols = [pa.array([last or n >= s.capacity - s.slack for n in fill], pa.bool_()), pa.array(fill, pa.int32())]
    cols += [pa.array([[p[i] for p in b] for b in packed], pa.list_(t)) for i, t in enumerate(TYPES)]
    return pa.RecordBatch.from_arrays(cols, names=["full", "fill", *LISTS])


def pieces(doc_id: int | None, ids: bytes, capacity: int) -> list[tuple]:
    """(doc_id, piece, start, length, crc32) of a document's ids, four bytes each."""
    step = 4 * capacity
    return [(doc_id, i // step, i // 4, (min(i + step, len(ids)) - i) // 4, zlib.crc32(ids[i : i + step])) for i in range(0, len(ids), step)]


def _local(s: Settings):
    end = s.end_id.to_bytes(4, "little")

    def run(batches):
        encoder, held = K.Encoder(s.vocabulary, s.folder), []
        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), K.encode_column(encoder, b.column(1))):
                held += [(p[3], [p]) for p in pieces(d, ids + end, s.capacity)]
                if len(held) >= s.window:
                    yield _bins(held, s)
                    held = []
        if held:
            yield _bins(held, s)

    return run


def _again(s: Settings, last: bool):
    def run(batches):
        held = []
        for b in batches:
            lists = [b.column(i).to_pylist() for i in range(6)]
            held += [(fill, list(zip(*rest))) for fill, *rest in zip(*lists)]
        if held:
            yield _bins(held, s, last)

    return run


def packed_bins(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """BIN rows, each a sequence; kept in the shared folder."""
    rows = C.written(C.doc_columns(docs, "doc_id", "text").mapInArrow(C.lean(_local(s)), BIN))
    done, rest = rows.where("full"), rows.where("not full")
    n = rest.count()
    while n:
        parts = -(-n // s.fan_in)
        rest = rest.withColumn("_n", F.monotonically_increasing_id()).repartition(parts, "_n").select("fill", *LISTS)
        rows = C.written(rest.mapInArrow(C.lean(_again(s, parts == 1)), BIN))
        left = rows.where("not full").count()
        if left and (left > 0.95 * n):
            return done.union(rows)
        done, rest, n = done.union(rows.where("full")), rows.where("not full"), left
    return done


def _laid_out(batches):
    for b in batches:
        lists = [b.column(i).to_pylist() for i in range(6)]
        out = [[] for _ in range(7)]
        for seq, *rest in zip(*lists):
            at = 0
            for p in zip(*rest):
                for o, v in zip(out, (*p, seq, at)):
                    o.append(v)
                at += p[3]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=[*LISTS, "sequence_id", "offset"])


def best_fit_packing(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each piece: where it lies and in which sequence."""
    bins = packed_bins(docs, s).select(F.monotonically_increasing_id().alias("sequence_id"), *LISTS)
    return bins.mapInArrow(C.lean(_laid_out), PIECE)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(C.table(spark, sf_dir, "documents"))
