import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refloom.llm import fingerprints as P
from refloom.llm import kernels as K


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=4), st.sampled_from([(8, 3), (6, 4), (24, 8), (7, 1)]))
def test_syncmers_by_definition(texts, ks):
    p = P.Settings(k=ks[0], s=ks[1])
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    doc, at, _ = P.syncmers(np.frombuffer(b"".join(texts), np.uint8), off, p)
    want = []
    for i, t in enumerate(texts):
        h = K.window_hash(np.frombuffer(t, np.uint8), p.s).tolist()
        w = p.k - p.s
        own = [(i, j) for j in range(len(t) - p.k + 1) if min(h[j : j + w + 1]) in (h[j], h[j + w])]
        want += own or ([(i, 0)] if t else [])
    assert list(zip(doc.tolist(), at.tolist())) == want


def print_of(text, p=P.Settings()):
    return P.to_text(P.of_texts([text], p), 1)[0]


def by_rule(a, b):
    """Likeness from the rule, anchor by anchor."""
    (pa, xa), (pb, xb) = ([v.tolist() for v in P.of_text(f)] for f in (a, b))
    if not pa or not pb:
        return float(len(pa) == len(pb))
    once = {h for h in xa if xa.count(h) == 1 == xb.count(h)}
    mate = {i: xb.index(h) for i, h in enumerate(xa) if h in once}
    fixed = sorted(mate)
    there = {(p, h): j for j, (p, h) in enumerate(zip(pb, xb))}
    taken = {}
    for i, (p, h) in enumerate(zip(pa, xa)):
        if i not in fixed:
            near = max((k for k in fixed if k < i), default=min((k for k in fixed if k > i), default=None))
            shift = 0 if near is None else pb[mate[near]] - pa[near]
            j = there.get((p + shift, h))
            if j is not None and j not in taken:
                taken[j] = i
    mate |= {i: j for j, i in taken.items()}
    shifts = {i: pb[j] - pa[i] for i, j in mate.items()}
    n = sum(len(pa) == 1 or shifts.get(i - 1) == s or shifts.get(i + 1) == s for i, s in shifts.items())
    return n / (len(pa) + len(pb) - n)


def test_anchors_are_context_free():
    rng = random.Random(1)
    t = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    a, b = print_of(t), print_of(b"inserted " + t[:1500] + b"XX" + t[1500:])
    n = len(P.of_text(a)[0])
    shifts = P.alignment(a, b)
    assert n > 128 and {9, 11} <= set(shifts) and shifts[9] + shifts[11] > 0.95 * n
    assert P.likeness(a, b) > 0.9 and P.likeness(a, a) == 1
    places, x = P.of_text(a)
    doc, at, h = P.of_texts([t], P.Settings())
    assert (places == at).all() and (x == h).all() and np.diff(at).max() <= P.Settings().k - P.Settings().s + 1


def test_every_anchor_counts():
    """An edit behind thousands of anchors shows."""
    rng = random.Random(3)
    t = bytes(rng.choice(b"abcdefgh ") for _ in range(50000))
    full = P.likeness(print_of(t), print_of(t[:-200] + b"x" * 200))
    assert 0.95 < full < 1 and P.likeness(print_of(t), print_of(t[:25000])) == pytest.approx(0.5, abs=0.01)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"abcdefghijklmnopqrs", b"repeated over and over, ", b"0123456789", b"x", b"something else that is long enough to count"]), max_size=14), st.lists(st.integers(0, 13), max_size=14))
def test_likeness_by_rule(parts, order):
    p = P.Settings(k=10, s=4)
    a, b = b"".join(parts), b"".join(parts[i % len(parts)] for i in order) if parts else b""
    x, y = print_of(a, p), print_of(b, p)
    assert P.likeness(x, y) == pytest.approx(by_rule(x, y)) and P.likeness(x, x) == 1
    many = P.likenesses(P.of_texts([a, b, a, b""], p), P.of_texts([b, b, b"", b""], p), 4)
    assert many.tolist() == [P.likeness(x, y), 1.0, P.likeness(x, ""), 1.0]


@pytest.mark.parametrize("n", [1, 2, 200])
def test_table(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(-(10**6), 10**6), "".join(rng.choice("abé d") for _ in range(rng.choice([0, 5, 300]))), 7) for _ in range(n)]
    if n > 2:
        rows += [(7 * 10**6, None, 7), (None, "null id", 7), (None, "also", 7), rows[5], rows[5], (rows[6][0], "other", 7), (8 * 10**6, "long" * 50000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int").repartition(5)
    got = P.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    want = []
    for i, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        edited = (t[: len(t) - k] + nxt[:k]).encode()
        a, b, c = map(print_of, (t.encode(), edited, nxt.encode()))
        want.append((-1 if d is None else d, len(t), hashlib.sha256(edited).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)
    assert P.fingerprints(docs.limit(0)).count() == 0
    if n > 2:
        assert P.anchors(docs).where("doc_id = 8000000").count() > 10000
