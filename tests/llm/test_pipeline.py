import os
import random

import corpus_pipeline
from refloom.llm import common as C
from refloom.llm import quality, tokens, toxicity

DATA = "/root/testdata/sf0.001"


def without_repeats(texts, length=100):
    seen, out = set(), {}
    for d in sorted(texts):
        t = texts[d].encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"x" * length
            seen.add(w)
        out[d] = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    docs = C.table(spark, DATA, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.written(stage(spark, docs, DATA))
        now = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(now) <= set(before) and len(now) > 0.5 * len(before), name
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.quality_rules(C.table(spark, DATA, "documents")).where("kept").collect()}
            assert set(now) == kept
        if name == "toxicity":
            model = toxicity.train(spark.createDataFrame([(d, t) for d, t in before.items()], "doc_id bigint, text string"), C.table(spark, DATA, "labels"))
            toxic = {d for d, t in before.items() if toxicity.score(model, toxicity.Terms(model.bits)(t)) >= 0.5}
            labelled = {r.doc_id for r in C.table(spark, DATA, "labels").where("toxic = 1").collect()} & set(before)
            assert set(now) == set(before) - toxic and toxic and len(toxic & labelled) >= 0.7 * len(labelled)
        if name == "minhash_near_dedup":
            assert len({r.text for r in now.values()}) == len(now)
        if name == "suffix_array_dedup":
            assert {d: r.text for d, r in now.items()} == without_repeats(before) and all(r.n_chars == len(r.text) for r in now.values())
        else:
            assert all(r.text == before[d] for d, r in now.items())
        before = {d: r.text for d, r in now.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    encoder = tokens.Encoder(tokens.WORD_BPE)
    assert sum(r.length for r in pieces) == sum(len(i) // 4 + 1 for i in encoder.batch(list(before.values())))
    assert {r.doc_id for r in pieces} == set(before)
    folder = os.path.dirname(C.shared_dir(spark)).removeprefix("file://")
    there = set(os.listdir(folder))
    run = corpus_pipeline.run(spark, DATA).collect()
    assert len(set(os.listdir(folder)) - there) == 1  # the result alone
    place = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(place, run)) == sorted(map(place, pieces))


def test_odd_tables(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    long = say(30000)
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (None, say(40), None, None, None, "x"), (None, None, None, None, None, None), (3, long, "en", "s", 9, "x"), (4, long + " end", "en", "s", 9, "x"), (5, say(50), "en", "s", 9, "x")]
    rows += [(6, rows[6][1], "en", "s", 9, "x"), rows[6], (7, say(20) + " " + say(60), "en", "s", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _runs string")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = C.written(stage(spark, docs, DATA)), C.written(stage(spark, empty, DATA))
        assert empty.isEmpty()
    assert {r.doc_id for r in docs.collect()} == {None, 3, 5, 7}
