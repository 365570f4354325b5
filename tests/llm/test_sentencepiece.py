import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from refloom.llm import sentencepiece as S
from refloom.llm.common import tokenizer_path

PATH = tokenizer_path(S.PIECES)
ODD = ["", "  a  b ", " ", "a\n\tb", "Ｆｕｌｌ ﬁ é 日本語テスト 😀", "▁x ▁▁y", "   lead", "trail   ", "<s> </s> <unk> <0x0A>", "a" * 50, " x", "a" * 300 + " " * 40 + "b", "the then there they're the", "\n\n\n"]


def test_ids_and_text_are_the_librarys():
    lib, m = sentencepiece.SentencePieceProcessor(model_file=PATH), S.load(PATH)
    encoder, decoder = S.Encoder(m), S.Decoder(m)

    def check(texts):
        for t, got in zip(texts, encoder.batch(texts)):
            ids = np.frombuffer(got, "<u4").tolist()
            assert ids == lib.encode(t), t
            assert decoder(got) == lib.decode(ids), t

    check(ODD)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=25), st.text(alphabet="abetnr s.,é▁\n", max_size=40)), max_size=5))
    def any_text(texts):
        check(texts)

    any_text()


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(alphabet="▁ab", min_size=1, max_size=4), st.floats(-9, -1), max_size=8), st.lists(st.text(alphabet="ab c", max_size=8), max_size=4))
def test_unigram_viterbi(vocabulary, texts):
    m = S.Model(["<unk>", *vocabulary], [0.0, *vocabulary.values()], [S.UNKNOWN] + [S.NORMAL] * len(vocabulary), False, False, True)
    encoder = S.Encoder(m)

    def best(t):
        if not t:
            return 0.0
        own = [m.scores[i] + best(t[len(p) :]) for i, p in enumerate(m.pieces) if i and t.startswith(p)]
        return max(own if t[0] in vocabulary else [*own, encoder.low + best(t[1:])])

    words = sorted({w for t in texts for w in encoder.words(t)})
    for word, parts, same in encoder._forward(words):
        assert parts == same
        assert "".join(word[i:j] for _, i, j in parts) == word
        assert abs(sum(encoder.low if p == S.UNK else m.scores[p] for p, _, _ in parts) - best(word)) < 1e-9


def unigram_library():
    """The library with the public vocabulary read as a unigram model: its trainer's kind
    is changed from 2 to 1."""
    data = open(PATH, "rb").read()

    def varint(n):
        got = b""
        while True:
            got += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return got

    def message(data, change):
        out, at = b"", 0

        def read():
            nonlocal at
            v = shift = 0
            while True:
                b = data[at]
                at += 1
                v |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return v

        while at < len(data):
            key = read()
            if key & 7 == 0:
                v = read()
                v = change(key >> 3, v)
                out += varint(key) + varint(v)
            elif key & 7 == 2:
                n = read()
                out += varint(key) + (lambda x: varint(len(x)) + x)(change(key >> 3, data[at : at + n]))
                at += n
            else:
                n = 4 if key & 7 == 5 else 8
                out += varint(key) + data[at : at + n]
                at += n
        return out

    kind = lambda f, v: 1 if f == 3 and isinstance(v, int) else v
    return sentencepiece.SentencePieceProcessor(model_proto=message(data, lambda f, v: message(v, kind) if f == 2 else v))


def test_viterbi_is_the_best_the_library_lists():
    """Its first of several segmentations has the same sum of scores. (Its plain encode
    sums in single precision, where the mark's score of -10^9 hides small ones.)"""
    lib, encoder = unigram_library(), S.Encoder(S.load(PATH))

    def check(t):
        got, total = encoder.viterbi(t), lambda ids: sum(map(lib.get_score, ids))
        assert "".join(map(lib.id_to_piece, got)) == "▁" + t.replace(" ", "▁") and encoder.both([t])[0][1] == len(got)
        assert total(got) == total(lib.nbest_encode_as_ids(t, 3)[0]), t

    for t in ("the then there they're the", "Some words, as one finds them; shared prefix, prefixes and prefixing.", "other towers"):
        check(t)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="abetnrs", min_size=2, max_size=9), min_size=1, max_size=5).map(" ".join))
    def any_words(t):
        check(t)

    any_words()
    assert encoder.viterbi("") == [] and len(encoder.viterbi("東")) in (2, 4)


def test_whole_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = S.encode(docs, ids=False).collect()
    for r in got:
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.lossless) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = S.decode(S.encode(docs)).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_table(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x " * 50000, 5), (3, "x " * 50000, 5), (4, "▁", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = S.encode(docs, ids=False).collect()
    assert len(got) == 6 and {r.doc_id: r.n_tokens for r in got}[1] == 0
    assert {r.doc_id: r.lossless for r in got} == {1: True, 2: True, None: True, 3: True, 4: False}
    assert S.encode(docs.limit(0)).count() == 0


def learnt(monkeypatch, model, words, many):
    monkeypatch.setattr(S, "MANY", many)
    encoder = S.Encoder(model)
    encoder.learn(set(words))
    assert (encoder.levels is None) == (many > len(words))
    return encoder.known, encoder.best


def test_levels_are_the_pass_by_word(spark, monkeypatch):
    """Many words at once, against the pass word by word and the library."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    m = S.load(PATH)
    cut = S.Encoder(m).words
    words = {w for t in texts if t for w in cut(t)}
    assert learnt(monkeypatch, m, words, 1) == learnt(monkeypatch, m, words, 10**9)
    lib, encoder = sentencepiece.SentencePieceProcessor(model_file=PATH), S.Encoder(m)
    monkeypatch.setattr(S, "MANY", 1)
    for t, got in zip(texts, encoder.batch(texts)):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcd", min_size=1, max_size=5), st.floats(-9, -1), max_size=25), st.sets(st.text(alphabet="abcdé", min_size=1, max_size=12), min_size=1, max_size=12), st.booleans())
def test_levels_of_any_vocabulary(vocabulary, words, bpe):
    """Pieces that merging never makes, characters that are no piece, runs of them."""
    m = S.Model(["<unk>", *vocabulary], [0.0, *vocabulary.values()], [S.UNKNOWN] + [S.NORMAL] * len(vocabulary), bpe, False, True)
    with pytest.MonkeyPatch.context() as patch:
        assert learnt(patch, m, words, 1) == learnt(patch, m, words, 10**9)


def test_new_words_take_less_than_a_pass_word_by_word():
    """A task spends most of its time on words it hasn't met: CPU seconds of learning
    them, against those of the pass word by word alone."""
    draw = random.Random(4)
    syllables = ["er", "an", "tion", "che", "ing", "th", "au", "ó", "ne", "re", "bla", "um", "ver", "is", "la"]
    sets = [{"▁" + "".join(draw.choices(syllables, k=draw.randint(2, 5))) + draw.choice(["", ",", ".", "\nThe"]) for _ in range(30_000)} for _ in range(3)]
    encoder = S.Encoder(S.load(PATH))
    encoder.learn({w + "x" for w in sets[0]})  # makes the tables

    def seconds(run):
        at = time.process_time()
        run()
        return time.process_time() - at

    learning, by_word = [], []
    for words in sets:
        by_itself = lambda: all(word for word, _, _ in encoder._forward(sorted(words)))  # noqa: B023, E731
        by_itself()  # which pairs stay apart is known then
        by_word.append(seconds(by_itself))
        encoder.known.clear()
        learning.append(seconds(lambda: encoder.learn(words)))
    assert min(learning) < min(by_word)
