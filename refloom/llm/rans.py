"""Token-ID files coded by a static range asymmetric numeral system.

The ids of all documents in ascending doc_id order (null first, ties by text) lie in
files of one range of ids each. A file has one frequency table, counted over all its
tokens and scaled to 2^20, which its blocks share. A block holds up to 2^19 tokens in
2048 interleaved 64-bit states that give off 32-bit words, and needs nothing but the
table to be decoded. Its checkpoint tells where it lies, its first token and document,
and the CRC-32 of its bytes, so that blocks can be read and checked in parallel: a task
takes a run of blocks and decodes the documents that begin in them, the last of which
may need the beginning of later blocks.

    magic "RFRANS01", u32 length and u32 CRC of the head, head (zlib of: arrays named
    below, each with type and length), blocks

Null text is empty; every document has at least its end token. Rows of one doc_id
are documents of their own, equal ones too. A text longer than a block lies in several
and is decoded by the task of the block it begins in. An empty table gives no file and
no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K

MAGIC = b"RFRANS01"
SCALE = 20
LOW = np.uint64(1 << 31)
W32 = np.uint64(32)


@dataclass(frozen=True)
class Settings:
    end_id: int = 2
    vocabulary: str = K.BYTE_BPE
    folder: str | None = None
    lanes: int = 2048
    block: int = 1 << 19
    file_tokens: int = 1 << 22
    blocks: int = 4  # of a reading task's run


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2^SCALE, at least 1 for each counted symbol."""
    total = 1 << SCALE
    f = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    over = int(f.sum()) - total
    while over > 0:  # take from the most frequent
        i = np.argsort(-f, kind="stable")[: min(over, len(f))]
        i = i[f[i] > 1]
        f[i] -= 1
        over = int(f.sum()) - total
    f[np.argmax(f)] -= over
    return f


class Table:
    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.r_[0, np.cumsum(freqs)[:-1]].astype(np.uint64)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        place = np.zeros(int(self.symbols.max()) + 1, np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        return place[tokens].astype(np.int32)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freqs.astype(np.int64))


def encode_block(codes: np.ndarray, t: Table, lanes: int) -> bytes:
    """A block of symbol numbers: token count, states, words."""
    n = len(codes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        i = slice(at, min(at + lanes, n))
        s = x[: i.stop - at]
        f, c = t.freqs[codes[i]], t.starts[codes[i]]
        out = s >= f << np.uint64(63 - SCALE)
        if out.any():
            words.append(s[out].astype(np.uint32))
            s = np.where(out, s >> W32, s)
        else:
            words.append(np.zeros(0, np.uint32))
        q = s // f
        x[: i.stop - at] = (q << np.uint64(SCALE)) + (s - q * f) + c
    body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return struct.pack("<II", n, len(body)) + x.astype("<u8").tobytes() + body.astype("<u4").tobytes()


def decode_block(data: bytes, t: Table, slots: np.ndarray, lanes: int, limit: int | None = None) -> np.ndarray:
    """The ids of a block, or its first ones: at least `limit`, if it has so many."""
    n, m = struct.unpack_from("<II", data)
    x = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    words = np.frombuffer(data, "<u4", m, 8 + 8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    if limit is not None and limit < n:
        n = min(n, -(-limit // lanes) * lanes)
        out = out[:n]
    mask, at = np.uint64((1 << SCALE) - 1), 0
    for i in range(0, n, lanes):
        k = min(lanes, n - i)
        s = x[:k]
        slot = s & mask
        sym = slots[slot]
        out[i : i + k] = sym
        s = t.freqs[sym] * (s >> np.uint64(SCALE)) + slot - t.starts[sym]
        low = np.flatnonzero(s < LOW)
        s[low] = (s[low] << W32) | words[at : at + len(low)]
        at += len(low)
        x[:k] = s
    return t.symbols[out]


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    names = [[k, v.dtype.str, len(v)] for k, v in arrays.items()]
    head = json.dumps(names).encode()
    return zlib.compress(struct.pack("<I", len(head)) + head + b"".join(v.tobytes() for v in arrays.values()), 1)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    raw = zlib.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + n, {}
    for name, dtype, length in json.loads(raw[4 : 4 + n]):
        out[name] = np.frombuffer(raw, dtype, length, at)
        at += out[name].nbytes
    return out


def encode_file(doc_ids: list[int | None], ids: list[bytes], s: Settings) -> bytes:
    """A whole file from documents' ids (four bytes each, with the end id)."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    lens = np.array([len(b) // 4 for b in ids], np.int64)
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    table = Table(symbols, scaled(counts[symbols]))
    codes = table.codes(tokens)
    del tokens
    blocks = [encode_block(codes[i : i + s.block], table, s.lanes) for i in range(0, len(codes), s.block)]
    size = np.array([len(b) for b in blocks], np.int64)
    first = np.arange(len(blocks), dtype=np.int64) * s.block
    ends = np.cumsum(lens)
    head = _packed({
        "symbols": table.symbols, "freqs": table.freqs.astype(np.uint32), "lanes": np.array([s.lanes], np.uint32),
        "block_at": np.r_[0, np.cumsum(size)[:-1]], "block_size": size, "block_token": first, "block_doc": np.searchsorted(ends, first, side="right"),
        "block_crc": np.array([zlib.crc32(b) for b in blocks], np.uint32),
        "doc_id": np.array([d or 0 for d in doc_ids], np.int64), "no_id": np.array([d is None for d in doc_ids], np.uint8), "n_tokens": lens,
    })
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(blocks)


class Reader:
    """A file's head and, one by one or all, its blocks."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        start = self.file.read_at(16, 0)
        n, crc = struct.unpack_from("<II", start, 8)
        head = self.file.read_at(n, 16)
        if start[:8] != MAGIC or zlib.crc32(head) != crc:
            raise ValueError(f"{path}: not a token file, or its head is damaged")
        self.head, self.base, self.path = _unpacked(head), 16 + n, path
        self.table = Table(self.head["symbols"], self.head["freqs"])
        self.slots, self.lanes = self.table.slots(), int(self.head["lanes"][0])

    def block(self, i: int, limit: int | None = None) -> np.ndarray:
        data = self.file.read_at(int(self.head["block_size"][i]), self.base + int(self.head["block_at"][i]))
        if zlib.crc32(data) != self.head["block_crc"][i]:
            raise ValueError(f"{self.path}: block {i} is damaged")
        return decode_block(data, self.table, self.slots, self.lanes, limit)

    def documents(self, lo: int = 0, hi: int | None = None):
        """(doc_id, first token in the file, ids as bytes) of each document that begins
        in the blocks lo to hi - 1 (None: the last); holds one block and one document."""
        head = self.head
        starts = np.r_[0, np.cumsum(head["n_tokens"])]
        edges = np.r_[head["block_token"], starts[-1]].astype(np.int64)
        end = len(edges) - 1 if hi is None else min(hi, len(edges) - 1)
        d0 = int(head["block_doc"][lo])
        d0 += int(starts[d0] < edges[lo])  # one that began in an earlier block
        d1 = int(np.searchsorted(starts[:-1], edges[end]))
        if d0 >= d1:
            return
        i, last = int(np.searchsorted(edges, starts[d0], side="right")) - 1, int(starts[d1])

        def taken() -> bytes:
            return self.block(i, None if edges[i + 1] <= last else last - int(edges[i])).tobytes()

        have = memoryview(taken())[4 * int(starts[d0] - edges[i]) :]
        for d in range(d0, d1):
            n = 4 * int(starts[d + 1] - starts[d])
            parts, size = [have], len(have)
            while size < n:
                i += 1
                parts.append(taken())
                size += len(parts[-1])
            have = memoryview(b"".join(parts)) if len(parts) > 1 else have
            yield None if head["no_id"][d] else int(head["doc_id"][d]), int(starts[d]), have[:n]
            have = have[n:]


META = "shard int, part int, path string, n_docs bigint, n_tokens bigint"


def write_files(docs: DataFrame, folder: str, s: Settings = Settings()) -> DataFrame:
    """Writes the files and returns their list (META), kept in the shared folder. A
    file appears under its name only when it is whole, so a task may be repeated."""
    spark = docs.sparkSession
    keyed = C.doc_columns(docs, "doc_id", "text")
    parts = -(-C.partitions(spark) // 2)  # larger ones meet fewer new words each
    cuts = C.splits(keyed, "doc_id", parts)
    rows = C.by_range(C.ranged(keyed, "doc_id", cuts), "_range", len(cuts) + 1).sortWithinPartitions("_range", "doc_id", "text")
    end = s.end_id.to_bytes(4, "little")

    def run(batches):
        encoder = K.Encoder(s.vocabulary, s.folder)
        fs, base = C.filesystem(folder)
        fs.create_dir(base, recursive=True)
        ids, held, size, part, shard = [], [], 0, 0, 0

        for b in batches:
            for d, n, got in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), K.encode_column(encoder, b.column(1))):
                shard = n
                ids.append(d)
                held.append(got + end)
                size += len(held[-1])
                if size >= 4 * s.file_tokens:
                    yield _save(fs, base, shard, part, ids, held, s)
                    ids, held, size, part = [], [], 0, part + 1
        if held:
            yield _save(fs, base, shard, part, ids, held, s)

    return C.written(rows.mapInArrow(C.lean(run), META))


def _save(fs, base: str, shard: int, part: int, ids: list, held: list[bytes], s: Settings) -> pa.RecordBatch:
    path = f"{base}/shard-{shard:06d}-{part:04d}.rans"
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(encode_file(ids, held, s))
    fs.move(own, path)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([sum(map(len, held)) // 4], pa.int64())], names=["shard", "part", "path", "n_docs", "n_tokens"])


def runs_of_blocks(files: DataFrame, s: Settings) -> DataFrame:
    """(path, first, lo): each run of s.blocks blocks of the listed files, and the number
    of ids before the file. Ids are summed by shard, of which there are no more than
    partitions; only these totals reach the driver."""
    spark = files.sparkSession
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, at = [], 0
    for r in totals:
        before.append((r["shard"], at))
        at += r["n"]
    shards = spark.createDataFrame(before, "shard int, _before bigint")
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("_in", F.coalesce(within, F.lit(0))).join(F.broadcast(shards), "shard")
    each = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {s.block} as int)"), F.lit(s.blocks)))
    return placed.select("path", (F.col("_before") + F.col("_in")).alias("first"), each.alias("lo"))


def read_files(files: DataFrame, folder: str, digest: bool = False, s: Settings = Settings()) -> DataFrame:
    """Documents of the listed files (META): doc_id, start (ids of all documents
    before it), n_tokens, and ids (array<int>) or, for digest, their CRC-32. s: as the
    files were written."""

    def run(batches):
        fs, _ = C.filesystem(folder)
        reader = None
        for b in batches:
            for path, base, lo in zip(*(b.column(i).to_pylist() for i in range(3))):
                if reader is None or reader.path != path:
                    reader = Reader(fs, path)
                rows, size = [], 0
                for d, start, ids in reader.documents(lo, lo + s.blocks):
                    rows.append((d, base + start, len(ids) // 4, zlib.crc32(ids) if digest else np.frombuffer(ids, "<u4").astype(np.int32)))
                    size += 1 if digest else len(ids)
                    if len(rows) >= 10_000 or size >= 1 << 24:
                        yield _rows(rows, digest)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, digest)

    runs = runs_of_blocks(files, s).repartition(C.partitions(files.sparkSession), "path", "lo").sortWithinPartitions("path", "lo")
    return runs.mapInArrow(C.lean(run), "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<int>"))


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.shared_dir(spark)
    return read_files(write_files(C.table(spark, sf_dir, "documents"), folder), folder, digest=True)
