import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refloom.llm import rans as R
from refloom.llm import tokens as K


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50256), max_size=40), min_size=1, max_size=12), st.integers(1, 7), st.integers(1, 30))
def test_round_trip(tmp_path_factory, docs, lanes, block):
    from pyarrow import fs

    s = R.Settings(lanes=lanes, block=block)
    ids = [np.array([*d, 2], "<u4").tobytes() for d in docs]
    path = str(tmp_path_factory.mktemp("r") / "f")
    open(path, "wb").write(R.encode_file(list(range(len(ids))), ids, s))
    r = R.Reader(fs.LocalFileSystem(), path)
    assert [bytes(b) for _, _, b in r.documents()] == ids
    whole = np.frombuffer(b"".join(ids), "<u4")
    i = len(r.head["block_at"]) - 1  # the last block alone
    at = int(r.head["block_token"][i])
    assert (r.block(i) == whole[at:]).all()
    assert (r.block(0, lanes)[:lanes] == whole[: min(lanes, block)]).all()
    for step in (1, 2, 3):  # blocks as tasks: each document once, from the run of blocks it begins in
        parts = [[bytes(b) for _, _, b in r.documents(lo, lo + step)] for lo in range(0, i + 1, step)]
        assert sum(parts, []) == ids


def test_close_to_entropy_and_damage(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(1)
    t = np.minimum(rng.zipf(1.3, 1 << 20), 50000).astype("<u4")
    data = R.encode_file([1], [t.tobytes()], R.Settings())
    p = np.bincount(t) / len(t)
    p = p[p > 0]
    assert len(data) * 8 < 1.06 * len(t) * -(p * np.log2(p)).sum() + 1e6
    bad = bytearray(data)
    bad[-5] ^= 1
    (tmp_path / "x").write_bytes(bad)
    r = R.Reader(fs.LocalFileSystem(), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="damaged"):
        list(r.documents())


def test_scaled():
    for counts in ([1], [10**9, 1, 1], [1] * 50257, [5] * 50000 + [10**8]):
        f = R.scaled(np.array(counts))
        assert f.sum() == 1 << R.SCALE and f.min() >= 1


def test_table(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-(10**6), 10**6), " ".join(rng.choice(["the", "cat", "Zürich", "x1"]) for _ in range(rng.randint(0, 90))), 7) for _ in range(300)]
    rows += [(900, None, 7), (901, "", 7), (902, "long " * 20000, 7), (None, "no id", 7), rows[5], rows[5], (rows[6][0], "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(5)
    for s in (R.Settings(), R.Settings(file_tokens=500, lanes=8, block=64), R.Settings(file_tokens=5000, lanes=8, block=64, blocks=1)):
        folder = R.C.shared_dir(spark)
        files = R.write_files(docs, folder, s)
        got = [tuple(r) for r in R.read_files(files, folder, digest=True, s=s).collect()]
        want, at = [], 0
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        for (d, _, _), ids in zip(order, K.Encoder(K.BYTE_BPE).batch([r[1] for r in order])):
            ids += b"\x02\0\0\0"
            want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
            at += len(ids) // 4
        key = lambda r: r[1]
        assert sorted(got, key=key) == want
        ids = R.read_files(files, folder, s=s).collect()
        assert sorted((r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in ids) == [(r[1], r[3]) for r in want]
    folder = R.C.shared_dir(spark)
    assert R.read_files(R.write_files(docs.limit(0), folder), folder).count() == 0
