"""Commands, answers, scorers and versions on a small corpus; inputs that once failed."""

import json

import pytest
from pyspark.sql import functions as F

from refloom import cli
from refloom.functions import classify as K
from refloom.functions import text as T
from refloom.operators import graph, link, reconcile, render, resolve, score, scoring
from refloom.operators.answers import Answers
from refloom.sources import corpus, versions, xmlflat

from test_engine import DOCS, HARBOUR, TIDES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tools")
    (d / "xml").mkdir()
    acts = {}
    for slug, title, year in (("harbour", "Harbour Works Act 1990", 1990), ("tides", "Tides and Currents Act 1991", 1991)):
        (d / "xml" / f"{slug}.xml").write_text(DOCS[slug])
        acts[slug] = {"name": title, "year": year, "number": 1, "effective_date": "", "xml_path": f"xml/{slug}.xml", "title_id": None}
    (d / "index.json").write_text(json.dumps({"acts": acts}))
    return d


def test_commands(spark, folder, tmp_path, capsys):
    g = str(tmp_path / "graph")
    run = lambda *a: cli.main([*a, "--graph", g], spark)
    assert run("stats") == 1 and "build" in capsys.readouterr().err
    assert run("build", "--corpus", str(folder)) == 0
    assert "untagged: 2 citations, 1 of the act itself, 1 resolved, 1 unresolved" in capsys.readouterr().out
    assert run("stats") == 0 and json.loads(capsys.readouterr().out)["node"]["act"] == 2
    assert run("complexity") == 1  # needs centrality
    assert run("complexity-of", "--act", HARBOUR) == 0 and "no complexity table" in capsys.readouterr().out
    assert run("codifiability-of", "--eid", "x", "--act", HARBOUR) == 0 and "no codifiability table" in capsys.readouterr().out
    assert run("centrality") == run("complexity") == 0
    (tmp_path / "seen.json").write_text(json.dumps({"act_frbr_uri": HARBOUR, "status": "spot_checked"}))
    ids = {r.node_id: r.custom_id for r in scoring.signal_requests(corpus.load(spark, cli._version(spark, g))["sections"]).where("signal = 'signal1'").collect()}
    (tmp_path / "replies.json").write_text("\n".join(json.dumps(r) for r in ({"custom_id": ids[f"{HARBOUR}#part-I__sec-13"], "reply": '```json\n{"tag": "high", "reasoning": "clear"}\n```'}, {"custom_id": "signal1_unknown", "reply": "{}"}, {"custom_id": ids[f"{HARBOUR}#part-I__sec-6"], "reply": None})))
    assert run("codifiability", "--verification", str(tmp_path / "seen.json"), "--replies", str(tmp_path / "replies.json")) == 0
    capsys.readouterr()
    for args, want in [
        (("complexity-of", "--act", HARBOUR), "- Word count: "), (("complexity-of", "--act", "zz"), "zz has no complexity record."), (("codifiability-of", "--eid", "part-I__sec-13", "--act", HARBOUR), "high (clear)"),
        (("codifiability-of", "--eid", "part-I__sec-6", "--act", HARBOUR), render.NOT_COMPUTED), (("codifiability-of", "--eid", "zz", "--act", HARBOUR), "has no codifiability record"), (("codifiability-summary", "--act", HARBOUR), "high: 100.0%"),
        (("codifiability-summary", "--act", "zz"), "zz has no codifiability records."), (("resolve", "--term", "Levy", "--act", TIDES, "--section", "part-I__dvs-2__sec-3"), "second"), (("resolve", "--term", "q", "--act", TIDES), "'q' has no definition"),
        (("definitions", "--term", "levy"), "\n\n---\n\n"), (("definitions", "--term", "q"), "'q' has no definition."), (("terms", "--act", TIDES), "2 defined terms in Tides and Currents Act 1991"), (("terms", "--act", "zz"), "zz defines no terms."),
        (("references", "--eid", "part-I__sec-13", "--act", HARBOUR), "cross-act"), (("references", "--eid", "zz", "--act", HARBOUR), "refers to nothing"), (("impact", "--eid", "part-I__sec-6", "--act", HARBOUR, "--max-hops", "1"), "centrality: "),
        (("impact", "--eid", "zz", "--act", HARBOUR), "within 3 hops"), (("entities", "--eid", "part-I__sec-13", "--act", HARBOUR), "- Harbour Registrar (registrar, 1 mention(s))"), (("entities", "--eid", "zz", "--act", HARBOUR), "mentions no entity"),
        (("find-entity", "--term", "Harbour Registrar"), "in Harbour Works Act 1990"), (("find-entity", "--term", "harbour registrar"), "No entity is called"), (("multi-act", "--min-acts", "1"), "levy: 1 acts".replace("levy", "Levy") if False else "1 acts"),
    ]:
        assert run(*args) == 0 and want in capsys.readouterr().out, args
    reply = {"act_frbr_uri": TIDES, "section_eid": "part-II__sec-9", "chunk": 0, "batch": 0, "reply": json.dumps([{"term": "low water mark", "definition_text": "the lowest line"}, {"term": "no", "definition_text": "not there"}])}
    (tmp_path / "defs.json").write_text(json.dumps(reply) + "\n" + json.dumps(reply | {"chunk": 1}))
    first = versions.latest(spark, g)
    assert run("extract-untagged", "--replies", str(tmp_path / "defs.json"), "--dry-run") == 0
    assert "1 definitions" in capsys.readouterr().out and versions.latest(spark, g) == first
    assert run("extract-untagged", "--replies", str(tmp_path / "defs.json")) == 0
    capsys.readouterr()
    assert versions.latest(spark, g) != first and corpus.load(spark, f"{g}/{first}")["terms"].count() == 4
    assert run("resolve", "--term", "low water mark", "--act", TIDES) == 0 and "the lowest line" in capsys.readouterr().out


def test_pointer(spark, tmp_path):
    g = str(tmp_path / "p")
    assert versions.latest(spark, g) is None and versions.next_version(spark, g) == "batch-000000000"
    for name in ("batch-000000000", "batch-000000007"):
        versions.point_to(spark, g, name)
        assert versions.latest(spark, g) == name
    assert versions.next_version(spark, f"file://{g}") == "batch-000000008"
    versions.point_to(spark, f"file://{g}", "x")
    assert versions.latest(spark, g) == "x"


def test_scorers(spark):
    rows = spark.createDataFrame([("1", "The Sea Act 1900", "amend or repeal The Sea Act 1900"), ("2", "The Sea Act 1900", "see The Sea Act 1900"), ("3", "A Act 1900", "repealed, amended: A Act 1900"), ("4", "B Act 1900", "amends, repeals B Act 1900")], "id string, ref_text string, text string")

    def scorer(prompts):
        if len(prompts) > 1:
            raise OSError("only one at a time")
        if "A Act" in prompts[0]:
            raise OSError("never")
        return ['```json\n{"relation": "repeals"}\n```' if "Sea" in prompts[0] else '{"relation": "likes"}']

    got = {r.id: (r.relation, r.relation_confidence) for r in scoring.settled_citations(rows, scorer).collect()}
    assert got == {"1": ("repeals", 0.6), "2": ("cites", 0.75), "3": ("cites", 0.3), "4": ("cites", 0.3)}
    assert {r.relation_confidence for r in scoring.settled_citations(rows).collect()} == {0.75, 0.3}
    sections = spark.createDataFrame([("n1", "must pay"), ("n2", "fair")], "node_id string, text string")
    said = {r.node_id: r for r in scoring.scored_sections(sections, lambda ps: ['{"tag": "low", "reasoning": "x"}' if "must" in p else "no" for p in ps]).collect()}
    assert said["n1"].signal1.tag == said["n1"].signal2.tag == "low" and said["n2"].signal1 is None
    states = iter(["running", "ended"])
    assert scoring.batch_answers(lambda r: "b", lambda n: next(states), lambda n: [("c", None)], [1], wait=0) == [("c", None)]
    tried = []
    with pytest.raises(KeyError):
        scoring.with_retries(lambda: tried.append(1) or {}["x"], wait=0)()
    assert len(tried) == 3

    def fetch(fragment):
        if fragment == "bad":
            raise OSError("down")
        return [{"name": fragment.title(), "id": "C1"}]

    hits = scoring.title_hits(spark.createDataFrame([("t", 0, "bad"), ("t", 1, "sea act")], "title string, pos int, fragment string"), fetch, wait=0)
    assert [tuple(r) for r in hits.collect()] == [("t", 1, "Sea Act", "C1")]


@pytest.mark.parametrize("reply, want", [
    ('[{"term": "a", "definition_text": "tide"}, "x", 5, null, {"term": 3, "definition_text": "tide"}, {"term": "b", "definition_text": "the tide"}]', {"a", "b"}),
    ('```json\n[{"term": "a", "definition_text": "tide"}]\n```', {"a"}), ('{"term": "a", "definition_text": "tide"}', set()), ("no JSON", set()), (None, set()),
    ('[{"term": "a"}, {"definition_text": "tide"}, {"term": "c", "definition_text": ""}, {"term": "d", "definition_text": "Tide"}]', set()),
])
def test_replies_with_definitions(spark, reply, want):
    rows = spark.createDataFrame([("n", "what the tide is", reply)], "node_id string, section_text string, reply string")
    assert {r.term for r in resolve.verified_definitions(rows).collect()} == want


def test_titles_without_words(spark):
    have = spark.createDataFrame([("Deep — Sea Act 1900", 2), ("North Sea Act 1900", 1)], "title string, file_pos bigint")
    cand = spark.createDataFrame([("",), ("—",), ("...",), ("sea",), (None,)], "title string")
    assert {r.title: r.match for r in reconcile.contained_in(cand, have).collect()} == {"": "North Sea Act 1900", "—": "Deep — Sea Act 1900", "sea": "North Sea Act 1900"}
    assert reconcile.contained_in(cand, have.where("false")).count() == 0


def test_names_with_quoting_signs(spark):
    s = spark.createDataFrame([("a#1", "a", r"the x\E(y office and the Q", 1)], "node_id string, act_frbr_uri string, text string, doc_pos bigint")
    t = spark.createDataFrame([("a", "x\\E(y office", "n1", "office", 1), ("a", "Q", "n2", "office", 2)], "act_frbr_uri string, display_term string, node_id string, entity_type string, doc_pos bigint")
    assert {(r.dst, r["count"]) for r in link.mentions(s, t).collect()} == {("n1", 1), ("n2", 1)}
    assert spark.range(1).select(T.recurrences(F.lit(r"a x\Ey b"), F.lit(r"x\Ey"))).first()[0] == 1


def test_nodes_without_a_score(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", 2.0)], "node_id string, score double")
    assert {r.node_id: r.percentile for r in graph.percentiles(rows).collect()} == {"a": 0.0, "b": None, "c": 50.0, "d": 50.0}


def test_repeated_statuses_and_signals(spark):
    s = spark.createDataFrame([("a#1", "1", "a", "must")], "node_id string, eid string, act_frbr_uri string, text string")
    seen = spark.createDataFrame([("a", "checked"), ("a", "spot_checked")], "act_frbr_uri string, status string")
    sig = spark.createDataFrame([("a#1", ("low", "x"), None), ("a#1", ("low", "y"), ("high", "z"))], "node_id string, signal1 struct<tag:string,reasoning:string>, signal2 struct<tag:string,reasoning:string>")
    got = score.codifiability(s, seen, sig).collect()
    assert len(got) == 1 and got[0].parse_verification_status == "spot_checked" and got[0].llm_reasoning == "y" and got[0].vagueness_tag == "high" and got[0].agreement == "full"


def test_citation_places_do_not_meet(spark):
    many = ", ".join(str(i) for i in range(1, 1203))
    s = spark.createDataFrame([("n", "a", "x", f"sections {many} and then section 7", [])], "node_id string, act_frbr_uri string, text string, prose_text string, refs array<struct<href:string,ref_text:string>>")
    got = corpus.citations(s).collect()
    assert len(got) == 1203 and len({r.cite_pos for r in got}) == 1203


def test_documents_in_batches(spark, monkeypatch):
    files = spark.createDataFrame([(str(i), bytearray(DOCS["tides"].encode()) if i % 3 else None) for i in range(25)], "path string, content binary").repartition(2)
    monkeypatch.setattr(xmlflat, "BATCH_ROWS", 4)
    got = xmlflat.flat_documents(files).collect()
    assert sorted(int(r.path) for r in got) == list(range(25)) and sum(r.error is not None for r in got) == 9


def test_impact_is_ordered(spark):
    rows = spark.createDataFrame([("b", 1, 0.5, ["x"]), ("a", 2, 2.0, ["y"]), ("c", 1, 0.5, ["z"])], "node_id string, hop int, path_weight double, ref_texts array<string>")
    assert [r.line[2] for r in render.impact(rows).collect()] == ["a", "b", "c"]


def test_requests(spark):
    s = spark.createDataFrame([("n", "the text")], "node_id string, text string")
    r = s.select(K.batch_request("signal1", F.col("node_id"), K.signal_prompt(F.col("text"), "Q?")).alias("r"), K.definition_prompt(F.col("text"), F.array(F.lit("a"), F.lit("b"))).alias("d")).first()
    assert r.r.custom_id.startswith("signal1_") and len(r.r.custom_id) == 24 and r.r.prompt.startswith("Q?") and r.r.prompt.endswith("the text") and "a; b" in r.d
    assert Answers({"acts": s}).complexity_of("x") == render.not_available("complexity")


def test_relation_samples(spark):
    e = spark.createDataFrame([("a", "b", [("r1", "cites"), ("r2", "amends")]), ("a", "c", [("r3", "cites")] * 12)], "src string, dst string, citations array<struct<ref_text:string,relation:string>>")
    got = [(r.relation, r.dst, r.pos) for r in score.relation_samples(e, 10).collect()]
    assert sorted(got) == sorted([("amends", "b", 1), ("cites", "b", 0), *[("cites", "c", i) for i in range(9)]])


def test_titles_dealt_to_several_tasks(spark, folder):
    t = corpus.read_corpus(spark, str(folder))
    args = [t[n] for n in ("citations", "acts", "sections", "terms")]
    one, many = ({(r.source_id, r.cite_pos, r.kind, r.status, r.target) for r in link.resolve_citations(*args, title_parts=n).collect()} for n in (1, 5))
    assert one == many and any(r[3] == "resolved" for r in one)
