import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from refloom.llm import quality as Q

TEXT = st.one_of(st.text(alphabet="ab \n#é", max_size=120), st.text(max_size=40), st.lists(st.sampled_from(["the cat ", "sat\n", "on a mat, ", "x" * 30, "dö ", "\n"]), max_size=40).map("".join))


def brute(text, rules):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w = rules.window
    grams = [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(w)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    b, L = text.encode(), rules.min_bytes
    longest, bytes_ = 0, set()
    for i in range(len(b)):
        for j in range(i + 1, len(b)):
            k = 0
            while j + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            if k >= L:
                longest = max(longest, k)
                bytes_ |= {*range(i, i + k), *range(j, j + k)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(bytes_), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_against_brute_force(texts):
    rules = Q.Rules(min_bytes=6, window=3)
    got = Q.measure(pa.array(texts), rules)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_bytes", "longest_repeat"]
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in cols) == brute(t, rules), t


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text(alphabet="ab", max_size=200).map(str.encode)))
def test_suffix_array(data):
    order, lcp = Q.suffix_array(np.frombuffer(data, np.uint8))
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    for i in range(1, len(data)):
        a, c = data[want[i - 1] :], data[want[i] :]
        k = 0
        while k < min(len(a), len(c)) and a[k] == c[k]:
            k += 1
        assert lcp[i] == k


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f g h i j k", "x"), (3, "spam and eggs for you " * 400, "y"), (3, "spam and eggs for you " * 400, "y"), (4, " ".join(f"w{i}" for i in range(30000)), "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert Q.quality_rules(docs).count() == 6
    assert not got[1].kept and got[1].base_failed and got[2].n_words == 0
    assert got[None].kept and got[4].kept and got[4].longest_repeat == 0
    assert got[3].base_failed and got[3].n_repeat_words == 2000
    good = Q.keep_good(docs)
    assert good.columns == docs.columns and sorted(r.doc_id or 0 for r in good.collect()) == [0, 4]
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_repeats_that_the_base_rules_cannot_see():
    """A long passage without white space, twice: no five words repeat, most bytes do."""
    import random

    rng = random.Random(1)
    words = " ".join(f"w{i}" for i in range(40))
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(600))
    longer = "".join(rng.choice("abcdefghij") for _ in range(2100))
    texts = [f"{words} {blob} and {blob}", f"{words} {blob} and", f"{words} {longer} and {longer} {' '.join(f'v{i}' for i in range(4000))}"]
    got = Q.measure(pa.array(texts), Q.Rules())
    assert not got["base_failed"].any() and got["kept"].tolist() == [False, True, False]
    assert got["repeat_bytes"][0] > 0.3 * len(texts[0]) and got["repeat_bytes"][2] < 0.3 * len(texts[2]) and got["longest_repeat"][2] > 2000
