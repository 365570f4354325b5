import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from refloom.llm import bwt
from refloom.llm import suffix_dedup as S


def brute(rows, length):
    """rows: (doc_id, text) -> (n_bytes, n_removed, n_spans, kept) by row."""
    low = -(1 << 63)
    order = {}
    for d, t in rows:
        order.setdefault(low if d is None else d, set()).add((t or "").encode())
    seen, gone = set(), {}
    for d in sorted(order):
        for t in sorted(order[d], key=lambda t: hashlib.sha256(t).hexdigest()):
            mask = bytearray(len(t))
            for i in range(len(t) - length + 1):
                w = t[i : i + length]
                if w in seen:
                    mask[i : i + length] = b"\x01" * length
                seen.add(w)
            gone[d, t] = mask
    out = []
    for d, t in rows:
        t = (t or "").encode()
        m = gone[low if d is None else d, t]
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((len(t), sum(m), spans, bytes(c for c, g in zip(t, m) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(40) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [say(rng.randint(0, 40)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        if rng.random() < 0.2:
            parts = parts * 2
        rows.append((rng.randint(0, 10**6), " ".join(parts)))
    rows += [(10**6 + i, rows[i][1]) for i in range(10)]
    rows += [(2 * 10**6, None), (2 * 10**6 + 1, ""), (3 * 10**6, "a" * 300), (None, shared[0]), (5, rows[0][1] + "x"), (5, rows[1][1] + "y"), rows[3], rows[3], (4 * 10**6, say(20000))]
    return rows


@pytest.mark.parametrize("seed,hot,batch", [(1, 16000, 1 << 20), (2, 64, 300), (3, 16000, 300), (4, 64, 1 << 20)])
def test_against_brute_force(spark, seed, hot, batch):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, n_removed string").repartition(3)
    s = S.Settings(hot_rows=hot, sample=1, batch_bytes=batch)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(docs, s).collect())
    want = sorted((-1 if d is None else d, a, b, c, hashlib.sha256(k).hexdigest()) for (d, _), (a, b, c, k) in zip(rows, brute(rows, 100)))
    assert got == want


def test_pipeline_form(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(t, len(t or ""), d, 1) for d, t in rows], "text string, n_chars bigint, doc_id bigint, runs int")
    out = S.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    want = sorted((-1 if d is None else d, None if t is None else k.decode("utf-8", "ignore")) for (d, t), (_, _, _, k) in zip(rows, brute(rows, 100)) if t is not None)
    got = out.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got if r.text is not None) == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert S.suffix_dedup(docs.limit(0)).count() == 0


def test_what_is_set_aside_in_small_batches():
    rng = random.Random(4)
    for _ in range(200):
        rows = sorted((rng.randint(0, 9), rng.random() < 0.2 and 1) for _ in range(rng.randint(1, 25)))
        n = len(rows)
        whole = pa.RecordBatch.from_pydict({"doc": list(range(n)), "tie": [0] * n, "start": [0] * n, "n": [1] * n, "anchor": [r[0] for r in rows], "hot": [bool(r[1]) for r in rows]})
        step = rng.randint(1, 5)
        got = [x["doc"] for b in S._several(whole.slice(i, step) for i in range(0, n, step)) for x in b.to_pylist()]
        assert sorted(got) == [i for i, r in enumerate(rows) if r[1] or sum(q[0] == r[0] for q in rows) > 1]


def test_merged_transforms():
    rng = random.Random(0)
    for _ in range(300):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 8))]
        text, off = np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum([len(x) for x in strings])].astype(np.int64)
        place, lead = bwt.repeated_windows(text, off, 8, 2, 3)
        want = [(off[i] + j, s[j : j + 8]) for i, s in enumerate(strings) for j in range(len(s) - 7)]
        assert sorted(place.tolist()) == [p for p, _ in want]
        name, seen, last = dict(want), set(), None
        for p, new in zip(place.tolist(), lead.tolist()):  # one interval after the other, each in the strings' order
            assert new == (name[p] not in seen) and (new or name[p] == name[last] and p > last)
            seen.add(name[p])
            last = p


def test_common_prefixes_and_dealing():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    off = np.array([0, 150, 290, 400])
    shards = [bwt.build(text[i:j], np.array([0, j - i]), 8, 2) for i, j in zip(off[:-1], off[1:])]
    order, common = bwt.merge(shards, 8, 2)
    for i in range(1, len(order)):
        a, b = (text[p : p + 8].tobytes() for p in order[i - 1 : i + 1])
        assert common[i] == next((k for k in range(4) if a[2 * k : 2 * k + 2] != b[2 * k : 2 * k + 2]), 4)
    x = rng.integers(0, 1 << 20, 5000).astype(np.int32)
    assert (bwt.dealt(x, 1 << 20) == np.argsort(x, kind="stable")).all()
    assert len(bwt.merge([bwt.build(text[:0], np.array([0]), 8, 2)], 8, 2)[0]) == 0
