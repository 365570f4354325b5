import random

import numpy as np
import pyarrow as pa

from refloom.llm import minhash as M


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def near(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = "edit" + str(rng.random())
    return " ".join(w)


def exact(a, b, s=M.Settings()):
    d, names, wt, _ = M.shingles(pa.array([a, b]), s.width)
    x, y = ({int(n): int(w) for n, w in zip(names[d == i], wt[d == i])} for i in (0, 1))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)


def test_signature_estimates_probability_jaccard():
    rng = random.Random(1)
    a = text(rng, 200) + " of the same of the same of the same"
    b = near(rng, a, 8)
    m = 2048
    doc, names, w, _ = M.shingles(pa.array([a, b]), 3)
    sig = M.signatures(doc, names, w, 2, m)
    p = exact(a, b)
    assert abs((sig[0] == sig[1]).mean() - p) < 4 * (p * (1 - p) / m) ** 0.5
    blobs = [M.pack(names[doc == i], w[doc == i]) for i in (0, 1)]
    assert abs(M.similarity(*blobs) - p) < 1e-3 and abs(M.similarity(blobs[0], blobs[0]) - 1) < 1e-9
    alone = M.signatures(doc[doc == 1] * 0, names[doc == 1], w[doc == 1], 1, m)
    assert (alone[0] == sig[1]).all()
    assert (M.signatures(np.zeros(1, int), names[:1], w[:1], 1, 16) == names[0]).all()


def test_classes_against_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(12):
        base = text(rng, rng.choice([8, 60, 300]))
        for k in [0, 0, 1, 2, 40][: 1 + g % 5]:
            n += 1
            rows.append((n, near(rng, base, k) if k else base, "s"))
    hot = text(rng, 80)
    rows += [(1000 + i, near(rng, hot, i % 4), "s") for i in range(60)]
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "...", "s"), (2003, "!?!", "s"), (2000, None, "s"), (None, hot, "s"), (None, text(rng, 30), "s"), (None, text(rng, 30), "s"), (3000, "Ein, Wort", "s"), (3001, "ein wort", "s"), (3002, text(rng, 20000), "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    s = M.Settings(threshold=0.6)
    got = M.near_duplicates(docs, s).collect()
    assert len(got) == len(rows)
    ids = [r for r in rows if r[0] is not None and r[1]]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if a[1] == b[1] or exact(a[1], b[1]) >= 0.75:
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    parent[2001] = 2000
    parent[3001] = 3000
    cls = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    for i in parent:
        assert cls[i] == cls[find(i)]
    assert cls[2001] == cls[2000] == 2000 and cls[2002] != cls[2003] and cls[3001] == 3000
    by = {r.doc_id: r for r in got}
    assert by[3000].n_links == 1 and by[3001].n_links == 1 and by[2000].n_copies == 3
    firsts = {i for i in parent if cls[i] == i}
    kept = M.keep_one(docs, s)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(firsts)
    assert sum(r.doc_id is None for r in out) == 2  # the third is a copy of 1000
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_links_are_all_pairs_of_a_class(spark, monkeypatch):
    rng = random.Random(7)
    base, other = text(rng, 60), text(rng, 40) + " a b c d a b c d a b c"
    rows = [(i, near(rng, base, 1 + i % 5)) for i in range(40)] + [(100 + i, near(rng, other, 1 + i % 4)) for i in range(30)]
    rows += [(200, text(rng, 50)), (201, rows[3][1].upper()), (300, near(rng, base, 1)), (300, near(rng, other, 1))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    like = {(a, b) for a, x in enumerate(rows) for b, y in enumerate(rows) if exact(x[1], y[1]) >= 0.5}
    for nodes in (M.BLOCK_NODES, 7):  # 7: a class in several blocks
        monkeypatch.setattr(M, "BLOCK_NODES", nodes)
        got = {r.doc_id: r for r in M.near_duplicates(docs).collect()}
        for a, (i, _) in enumerate(rows[:-2]):  # each text of 300 counts if one of them is similar
            want = sum((a, b) in like for b in range(len(rows) - 2) if a != b) + 2 * any((a, len(rows) - k) in like for k in (1, 2))
            assert got[i].n_links == want, (i, nodes)
        assert max(r.n_links for r in got.values()) > 25
    unit = [M.shingles(pa.array([t]), 3) for _, t in rows]
    block = M.Block([M.pack(n, w) for _, n, w, _ in unit])
    for i in range(0, len(rows), 9):
        for a, b in zip(block.similarities(i, 0, len(rows)), rows):
            assert abs(a - exact(rows[i][1], b[1])) < 1e-9


def test_large_counts_are_kept():
    names = np.array([1 << 20, 2 << 20], np.uint64)
    a, b = (M.pack(names, np.array([n, 100_000])) for n in (100_000, 1_000_000))
    assert M.unpack(b)[1].tolist() == [1_000_000, 100_000]
    want = 1 / (1 + 1) + 1 / (10 + 1)  # 1 / sum of the largest ratios, for each name
    assert abs(M.similarity(a, b) - want) < 1e-9 and abs(M.Block([a, b]).similarities(0, 1, 2)[0] - want) < 1e-9


def pair_at(rng, like, n=60):
    """Two texts of n words, the second with words changed to about that similarity."""
    a = text(rng, n)
    k = 0
    while True:
        k += 1
        w = a.split()
        for i in rng.sample(range(n), k):
            w[i] = f"edit{rng.random()}"
        if (p := exact(a, " ".join(w))) < like + 0.05:
            return (a, " ".join(w)) if p >= like else None


def test_recall_at_the_production_threshold(spark):
    """Of pairs just above the threshold at least 0.95 are linked, and none below it."""
    rng = random.Random(11)
    s = M.Settings()
    near_, far = [], []
    while len(near_) < 400 or len(far) < 400:
        for kind, low in ((near_, s.threshold), (far, s.threshold - 0.05)):
            if len(kind) < 400 and (got := pair_at(rng, low)):
                kind.append(got)
    rows = [(2 * i + j, t) for i, pair in enumerate(near_ + far) for j, t in enumerate(pair)]
    got = {r.doc_id: r for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), s).collect()}
    linked = [got[2 * i + 1].class_id == 2 * i for i in range(800)]
    assert np.mean(linked[:400]) >= 0.95
    assert not any(linked[400:]) and all(got[i].n_links == 0 for i in range(800, 1600))


def test_null_ids_are_linked(spark):
    rng = random.Random(12)
    base, other = text(rng, 80), text(rng, 80)
    rows = [(None, near(rng, base, 2)), (7, base), (None, near(rng, other, 1)), (None, other), (None, other), (3, text(rng, 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.class_id is not None, r.doc_id or 0, r.n_links, r.n_copies) for r in M.near_duplicates(docs).collect())
    assert got == sorted([(True, 0, 1, 1), (True, 7, 1, 1), (False, 0, 1, 1), (False, 0, 1, 2), (False, 0, 1, 2), (True, 3, 0, 1)])
    out = M.keep_one(docs).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 3, 7] and next(r.text for r in out if r.doc_id is None) in {rows[2][1], other}


def test_strays_of_a_large_class(spark, monkeypatch):
    """A bucket of one class and some strays, in many blocks: one stray belongs to it."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(1, 1 << 32, 30)).astype("<u4")
    lists = [np.r_[base[:24], np.unique(rng.integers(1, 1 << 32, 6)).astype("<u4")] for _ in range(40)]
    lists += [np.unique(rng.integers(1, 1 << 32, 20)).astype("<u4") for _ in range(9)]
    lists[45] = lists[44].copy()
    lists[45][0] += 1
    blobs = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(lists)], "node bigint, shingles binary")
    rows = spark.createDataFrame([(i, 7, 0 if i < 39 else i) for i in range(49)], "node bigint, key bigint, label bigint")
    for size in (1024, 3):
        monkeypatch.setattr(M, "BLOCK_NODES", size)
        got = {tuple(sorted(r)) for r in M.joined(rows, blobs, 0.5).collect()}
        assert {x for x in got if x[1] >= 40} == {(44, 45)} and {x[1] for x in got if x[1] < 40} == {39}


def test_a_large_bucket_without_a_common_class(spark):
    """10,000 members of one bucket that are not alike, with one pair that is."""
    rng = np.random.default_rng(1)
    n = 10_000
    lists = [np.unique(rng.integers(1, 1 << 32, 20)).astype("<u4") for _ in range(n)]
    lists[9000] = lists[17].copy()
    lists[9000][3] += 1
    blobs = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(lists)], "node bigint, shingles binary")
    nodes = blobs.selectExpr("node", "array(5L) bands")
    classes, _ = M.classes_of(nodes, blobs)
    assert sorted(map(tuple, classes.collect())) == [(17, 17), (9000, 17)]
