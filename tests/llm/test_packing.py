import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from refloom.llm import packing as P
from refloom.llm import tokens as K
from refloom.llm.common import tokenizer_path

ODD = ["  a  b", "a \n b\t\tc", " x", " ", "", "\n\n a", "it's  we'LL'VE", "İstanbul ΣΑΣ ǅ ½ ²", "a b c\x1cd\x85e­", "é ｆｕｌｌ ﬁ <|endoftext|> <|startoftext|>x", "hello <|endoftext|> world", "a<|endoftext|>  <|ENDOFTEXT|>b <| x |> <|endoftext", "<|endoftext|>", "日本語 テスト 123 4567", None, "a " * 5 + " ", "x\r\ny \r z", "'s's 'S", "end., .,a ,", "é ́x"]


def by_library(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", [K.BYTE_BPE, K.WORD_BPE])
def test_ids_are_the_librarys(name):
    got = [np.frombuffer(b, "<u4").tolist() for b in K.encode_column(K.Encoder(name), pa.array(ODD), 10)]
    assert got == by_library(name, ODD)


@pytest.mark.parametrize("name", [K.BYTE_BPE, K.WORD_BPE])
def test_ids_of_any_text(name):
    encoder = K.Encoder(name)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aB .,'s\n\té5İßſ", max_size=30), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "a", "B\n"]), max_size=6).map("".join)), max_size=4))
    def check(texts):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.batch(texts)] == by_library(name, texts)

    check()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(lengths):
    bins = P.best_fit(lengths, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    free = []
    for n in sorted(lengths, reverse=True):  # the rule, bin by bin
        at = min((j for j, r in enumerate(free) if r >= n), key=lambda j: free[j], default=None)
        if at is None:
            free.append(20 - n)
        else:
            free[at] -= n
    assert sorted(sum(lengths[i] for i in b) for b in bins) == sorted(20 - r for r in free)


def test_table(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Zürich", "x1"]) for _ in range(rng.randint(0, 90))), 7) for i in range(300)]
    rows += [(900, None, 7), (901, "", 7), (902, "long " * 1000, 7), (None, "no id", 7), (5, rows[5][1], 7), (5, rows[5][1], 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset int").repartition(5)
    for s in (P.Settings(capacity=64, slack=2, fan_in=20, window=40), P.Settings(capacity=64, slack=0, fan_in=3)):
        got = P.best_fit_packing(docs, s).collect()
        want = sorted((d is None, d or 0, p[1], p[2], p[3], p[4]) for (d, t, _), ids in zip(rows, by_library(K.WORD_BPE, [r[1] for r in rows])) for p in P.pieces(d, np.array([*ids, 1], "<u4").tobytes(), 64))
        assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        seqs = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in seqs.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        assert len(seqs) <= 1.05 * sum(r.length for r in got) / 64 + 2
    assert P.best_fit_packing(docs.limit(0)).count() == 0
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {r.ids_crc32 for r in got if r.doc_id == 901}
