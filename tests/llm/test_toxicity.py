import random

import numpy as np

from refloom.llm import toxicity as X

DATA = "/root/testdata/sf0.1"


def test_terms():
    t = X.Terms(18)
    assert list(t("Idiot!")) == list(t("idiot")) and len(t(None)) == len(t("")) == len(t(" \n")) == 0
    assert set(t("idiot")) & set(t("1d10t")) and list(t("a b a")) == sorted({*t("a"), *t("b")})


def test_factors_learn_a_pair():
    """Label 1 needs both words; either alone is as common in label 0."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, y = [], []
    for i in range(3000):
        own = rng.sample(words, 5) + (["insult", "group"] if i % 3 == 0 else [["insult"], ["group"]][i % 2])
        rows.append(" ".join(own))
        y.append(int(i % 3 == 0))
    t, s = X.Terms(14), X.Settings(bits=14, epochs=40, min_z=3.0)
    terms, labels = X.selected([t(r) for r in rows[:2400]], np.array(y[:2400], np.float32), s)
    m = X.fit(terms, labels, 1 / 3, s)
    got = [X.score(m, t(r)) >= 0.5 for r in rows[2400:]]
    assert np.mean([g == bool(v) for g, v in zip(got, y[2400:])]) > 0.97
    additive = X.Model(m.bias, m.weights, m.factors * 0, m.bits)
    assert abs(X.score(m, t("insult group")) - X.score(additive, t("insult group"))) > 1e-3


def balanced(rng, n):
    """Label 1 if insult and group come together or neither does: each alone is as common
    in both classes."""
    words, rows, y = [f"w{i}" for i in range(300)], [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = rng.sample(words, 8) + ["insult"] * a + ["group"] * b
        rng.shuffle(own)
        rows.append(" ".join(own))
        y.append(int(a == b))
    return rows, np.array(y, np.float32)


def test_interactions_beat_an_additive_model():
    rng = random.Random(1)
    s, t = X.Settings(bits=16), X.Terms(16)
    (rows, y), (others, truth) = balanced(rng, 4000), balanced(rng, 1000)
    kept, labels = X.selected([t(r) for r in rows], y, s)
    right = {}
    for k in (8, 0):  # 0: no factors, refitted
        m = X.fit(kept, labels, 0.5, X.Settings(bits=16, factors=k))
        right[k] = np.mean([(X.score(m, t(r)) >= 0.5) == bool(v) for r, v in zip(others, truth)])
    assert right[8] > 0.9 and right[0] < 0.6
    none, _ = X.selected([t(r) for r in rows], y, X.Settings(bits=16, pairs=0))  # marginal rates alone keep nothing that tells
    assert not any(set(t("insult group")) & set(r.tolist()) for r in none)


def test_score_is_the_double_sum():
    rng = np.random.default_rng(2)
    m = X.Model(-0.3, rng.normal(0, 0.5, 64).astype(np.float32), rng.normal(0, 0.3, (64, 5)).astype(np.float32), 6)
    for n in (0, 1, 2, 17):
        terms = np.sort(rng.choice(64, n, replace=False))
        z = m.bias + sum(float(m.weights[i]) for i in terms) + sum(float(m.factors[i].astype(float) @ m.factors[j].astype(float)) for a, i in enumerate(terms) for j in terms[a + 1 :])
        assert abs(X.score(m, terms) - 1 / (1 + np.exp(-z))) < 1e-9


def test_pairs_by_definition():
    """The pair screen against covariances counted pair by pair; ties go by number."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(300)]
    rows = [np.union1d(r, [10]) if 3 in r and i % 2 else r for i, r in enumerate(rows)]
    y = np.array([i % 2 for i in range(300)], np.float32)
    z = {}
    for i in range(12):
        for j in range(i + 1, 12):
            gap, err, joint = 0.0, 0.0, 0
            for c, sign in ((1, 1), (0, -1)):
                own = [r for r, v in zip(rows, y) if v == c]
                x, w = (np.array([k in r for r in own], float) for k in (i, j))
                cov = np.mean(x * w) - x.mean() * w.mean()
                spread = np.mean(((x - x.mean()) * (w - w.mean())) ** 2) - cov**2
                gap, err, joint = gap + sign * cov, err + max(spread, 1 / len(own)) / len(own), joint + (x * w).sum()
            least = min(sum(k in r for r in rows) for k in (i, j))
            z[i, j] = 0 if joint > 0.9 * least else abs(gap) / err**0.5
    for pairs in (1, 3, 8):
        want = sorted((p for p in z if z[p] >= 0.5), key=lambda p: (-z[p], p))[:pairs]
        got = X.coupled(rows, y, 16, X.Settings(pairs=pairs, pair_z=0.5), chunk=5)
        assert set(np.flatnonzero(got)) == {k for p in want for k in p}


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = X.toxicity(docs, X.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    found = sum(r.predicted for r in got if r.toxic)
    wrong = sum(r.predicted for r in got if not r.toxic)
    assert len(got) > 700 and found >= 0.85 * sum(r.toxic for r in got) and wrong <= 0.005 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    again = X.toxicity(docs.repartition(7), X.train(docs.repartition(3), labels)).join(labels, "doc_id").where("held_out").collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_table(spark):
    rows = [(i, ("idiot " if i % 4 == 0 else "") + f"some words here {i} of it", "s") for i in range(80)]
    docs = spark.createDataFrame([*rows, (500, None, "s"), (501, "", "s"), (None, "idiot", "s"), (3, "idiot", "s"), (502, "idiot " * 100000, "s")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(80)] + [(None, 1, None), (4, 0, None), (5, None, None), (9999, 1, None)], "doc_id bigint, toxic int, quality int")
    model = X.train(docs, labels, s=X.Settings(min_z=2.0))
    out = X.toxicity(docs, model)
    got = [(r.doc_id, r.held_out, r.score, r.predicted) for r in out.collect()]
    assert len(got) == 85 and all(0 <= s <= 1 for _, _, s, _ in got)
    assert {p for d, _, _, p in got if d in (500, 501)} == {0} and {p for d, _, _, p in got if d in (None, 502)} == {1}
    kept = X.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 502").isEmpty() and kept.where("doc_id = 500").count() == 1
    for none in (labels.limit(0), labels.where("toxic = 1")):
        scores = {r.predicted for r in X.toxicity(docs, X.train(docs, none)).collect()}
        assert scores == ({0} if none.isEmpty() else {1})
    assert X.toxicity(docs.limit(0), model).count() == 0
    assert X.toxicity(docs.limit(0), X.train(docs.limit(0), labels)).count() == 0
    twice = X.toxicity(docs.union(docs), model).groupBy("doc_id", "score").count()
    assert {r["count"] % 2 for r in twice.collect()} == {0}
