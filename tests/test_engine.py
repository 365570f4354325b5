"""Semantics on small documents of our own, from files to answers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from refloom.functions import classify as K
from refloom.functions import text as T
from refloom.operators import graph, link, reconcile, render, resolve, score
from refloom.sources import corpus, xmlflat
from refloom.streaming import incremental

NS = "http://docs.oasis-open.org" + "/legaldocml/ns/akn/3.0"


def el(tag, inner, **attributes):
    return f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attributes.items())}>{inner}</{tag}>"


def act(uri, body, date="2020-05-01"):
    names = el("FRBRWork", el("FRBRuri", "", value=uri + "/")) + el("FRBRExpression", el("FRBRdate", "", name="Generation", date=date))
    return el("akomaNtoso", el("act", el("meta", el("identification", names)) + el("body", body)), xmlns=NS)


def sec(eid, inner, heading="Heading"):
    return el("section", el("num", "1") + el("heading", heading) + el("content", inner), eId=eid)


def p(text):
    return f"<p>{text}</p>"


def define(term, text):
    return f"<p><term>{term}</term> means <def>{text}</def></p>"


HARBOUR, TIDES = "/akn/au/act/1990/1", "/akn/au/act/1991/2"
DOCS = {
    "harbour": act(HARBOUR, '<part eId="part-I">' + sec("part-I__sec-6", define("Harbour Registrar", "the holder of that office") + define("mooring", "a place to tie a boat")) + sec("part-I__sec-13",
        p("See " + el("ref", "section 6", href="#part-I__sec-6") + " and " + el("ref", "the Tides and Currents Act 1991", href="") + ".") + p("The Tides and Currents Act 1991 applies. Sections 6 and 13 and s 6(2) apply; subsection (2) does not. The Harbour Registrar must act if a reasonable person may not."))
        + "</part>" + sec("schedule-1", p("Self: Harbour Works Act 1990. Gone: the Lost Lighthouse Act 1888, amended. Harbour Registrar-General."))),
    "tides": act(TIDES, el("part", el("division", sec("part-I__dvs-1__sec-1", define("levy", "first")) + sec("part-I__dvs-1__sec-2", p("x")), eId="part-I__dvs-1") + el("division", sec("part-I__dvs-2__sec-3", define("Levy", "second")), eId="part-I__dvs-2"), eId="part-I")
        + el("part", sec("part-II__sec-9", p("low water mark means the lowest line. The low water mark moves; a low water mark and Low Water Mark.") + p("This repeals " + el("ref", "the Harbour Works Act 1990", href="x") + " now.")), eId="part-II")),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    acts = {}
    for i, (slug, title, year) in enumerate([("harbour", "Harbour Works Act 1990", 1990), ("tides", "Tides and Currents Act 1991", 1991), ("missing", "Missing Act 1992", 1992), ("broken", "Broken Act 1993", 1993), ("nouri", "No Address Act 1994", 1994)]):
        acts[slug] = {"name": title, "year": year, "number": i, "effective_date": "" if slug == "harbour" else "2021-01-01", "xml_path": f"xml/{slug}.xml", "title_id": "C1" if slug == "harbour" else None}
    (d / "xml").mkdir()
    for slug, text in DOCS.items():
        (d / "xml" / f"{slug}.xml").write_text(text)
    (d / "xml/broken.xml").write_text("<a><b></a>")
    (d / "xml/nouri.xml").write_text("<a/>")
    (d / "index.json").write_text(json.dumps({"acts": acts}))
    return str(d)


@pytest.fixture(scope="module")
def g(spark, folder):
    return {k: v.cache() for k, v in corpus.build(spark, folder).items()}


def test_corpus(spark, g, folder, tmp_path):
    acts = {r.frbr_uri: r for r in g["acts"].collect()}
    assert set(acts) == {HARBOUR, TIDES}
    assert acts[HARBOUR].compilation_date == "2020-05-01" and acts[TIDES].compilation_date == "2021-01-01"
    assert {(r.slug, r.error.split(":")[0]) for r in g["rejects"].collect()} == {("missing", "missing file"), ("broken", "ParseError"), ("nouri", "ValueError")}
    s = {r.eid: r for r in g["sections"].collect()}
    assert s["schedule-1"].provision_type == "schedule" and s["part-I__sec-6"].heading == "Heading"
    assert "section 6 and" in s["part-I__sec-13"].text and s["part-I__sec-13"].prose_text.startswith("1See and .The Tides")
    (tmp_path / "index.json").write_text("{}")
    with pytest.raises(ValueError):
        corpus.corpus_index(spark, str(tmp_path))


def test_prose_keeps_what_follows_inside_a_skipped_element():
    import xml.etree.ElementTree as ET

    el = ET.fromstring("<section><heading>Out<i>side</i> kept</heading><p>a <ref>no<b>pe</b> yes</ref> b</p></section>")
    assert xmlflat.prose(el) == "kepta yes b"


def test_terms_and_candidates(g):
    terms = {r.node_id: r for r in g["terms"].collect()}
    assert terms[f"{HARBOUR}#term-harbour_registrar"].entity_type == "registrar"
    assert terms[f"{TIDES}#term-levy"].occurrence == 1 and terms[f"{TIDES}#term-levy__2"].definition_text == "second"
    assert [(r.term, r.section_eid) for r in g["candidates"].collect()] == [("low water mark", "part-II__sec-9")]


def test_edges(g):
    edges = {(r.src.split("#")[-1], r.dst.split("#")[-1]): r for r in g["ref_edges"].collect()}
    six = edges["part-I__sec-13", "part-I__sec-6"]
    assert six.weight == 3 and six.ref_texts == ["section 6", "Sections 6 and 13", "s 6(2)"] and not six.is_cross_act
    assert edges["part-I__sec-13", "part-I__sec-13"].weight == 1  # an edge to itself
    tides = edges["part-I__sec-13", TIDES]
    assert tides.weight == 2 and tides.is_cross_act and tides.citations[0].extraction_confidence == 0.95
    back = edges["part-II__sec-9", HARBOUR]
    assert back.citations[0].relation == "repeals" and back.citations[0].relation_confidence == 0.85
    stats = {r.bucket: r.asDict() for r in link.citation_stats(g["resolved"]).collect()}
    assert stats["untagged"] == {"bucket": "untagged", "total": 2, "self_citation_filtered": 1, "resolved": 1, "unresolved": 1}
    assert stats["tagged"]["resolved"] == 2
    ledger = link.candidate_report(g["resolved"]).collect()
    assert [(r.title, r.year, r.mention_count, r.cited_by) for r in ledger] == [("lost lighthouse act 1888", 1888, 1, {HARBOUR: 1})]


def test_mentions(g):
    assert {(r.src.split("#")[1], r["count"]) for r in g["mentions"].collect()} == {("part-I__sec-13", 1)}  # in section 6 the heading runs into the name


@pytest.mark.parametrize("term, eid, want", [(" Levy ", "part-I__dvs-1__sec-2", "first"), ("levy", "part-I__dvs-2__sec-3", "second"), ("levy", None, "first"), ("levy", "part-II__sec-9", None), ("mooring", "anywhere", None), ("nothing", None, None)])
def test_scopes(g, term, eid, want):
    rows = resolve.resolve_definition(g["terms"], g["acts"], term, TIDES, eid).collect()
    assert [r.definition_text for r in rows] == ([want] if want else [])
    if want:
        assert rows[0].term == term and rows[0].act_title == "Tides and Currents Act 1991"


def test_single_candidate_needs_no_scope(g):
    assert resolve.resolve_definition(g["terms"], g["acts"], "mooring", HARBOUR, "part-IX__sec-1").count() == 1


def edges_of(spark, *rows):
    return spark.createDataFrame([(a, b, w, [f"{a}>{b}"]) for a, b, w in rows], "src string, dst string, weight bigint, ref_texts array<string>")


def test_impact(spark):
    e = edges_of(spark, ("b", "a", 2), ("c", "b", 3), ("d", "c", 1), ("e", "d", 1), ("x", "a", 5), ("c", "x", 1), ("a", "c", 1), ("a", "a", 9))
    start = spark.createDataFrame([("a",)], "node_id string")
    got = {r.node_id: (r.hop, r.path_weight, r.ref_texts) for r in graph.impacted_by(e, start).collect()}
    assert got == {"b": (1, 2.0, ["b>a"]), "x": (1, 5.0, ["x>a"]), "c": (2, 3.0, ["c>b"]), "d": (3, 1.5, ["d>c"])}
    assert {r.node_id for r in graph.impacted_by(e, start, max_hops=9).collect()} == {"b", "x", "c", "d", "e"}
    assert graph.impacted_by(e, spark.createDataFrame([("zz",)], "node_id string")).count() == 0


def test_pagerank(spark):
    rows = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 4), ("c", "e", 1)]  # e has no way out
    nodes = sorted({x for r in rows for x in r[:2]})
    n = len(nodes)
    out = {v: sum(w for a, _, w in rows if a == v) for v in nodes}
    x = dict.fromkeys(nodes, 1 / n)
    for _ in range(100):
        stuck = sum(x[v] for v in nodes if not out[v])
        y = {v: 0.15 / n + 0.85 * (stuck / n + sum(x[a] * w / out[a] for a, b, w in rows if b == v)) for v in nodes}
        done = sum(abs(y[v] - x[v]) for v in nodes) < n * 1e-6
        x = y
        if done:
            break
    got = {r.node_id: r.score for r in graph.pagerank(edges_of(spark, *rows)).collect()}
    assert got.keys() == x.keys() and all(math.isclose(got[v], x[v], rel_tol=1e-9) for v in x)
    assert graph.pagerank(edges_of(spark, ("q", "q", 1)).where("false")).count() == 0
    pct = {r.node_id: r.percentile for r in graph.percentiles(graph.pagerank(edges_of(spark, *rows))).collect()}
    assert min(pct.values()) == 0.0 and max(pct.values()) == 100.0
    one = spark.createDataFrame([("z", 0.5)], "node_id string, score double")
    assert graph.percentiles(one).first().percentile == 100.0 and graph.percentiles(one.where("false")).count() == 0


def test_complexity_and_answers(spark, g):
    rank = graph.pagerank(link.edge_weights(g["resolved"]))
    rows = {r.act_frbr_uri: r for r in score.act_complexity(g["acts"], g["sections"], g["terms"], g["ref_edges"], rank).collect()}
    assert rows[HARBOUR].raw_citation_count == 4 and rows[HARBOUR].defined_term_count == 2
    assert rows[HARBOUR].conditional_statement_count == 1 and rows[HARBOUR].indeterminate_concept_count == 1
    records = score.codifiability(g["sections"], spark.createDataFrame([(HARBOUR, "spot_checked")], "act_frbr_uri string, status string"))
    by = {r.eid: r for r in records.collect()}
    assert by["part-I__sec-13"].prescriptive_density_count == 2 and by["part-I__sec-13"].prescriptive_density_tag == "medium"
    assert by["part-I__sec-13"].agreement == "not_computed" and by["part-I__sec-13"].parse_verification_status == "spot_checked"
    assert "not computed" in render.answer(render.codifiability(records.where("eid = 'schedule-1'")), "none")
    assert render.answer(render.codifiability(records.where("false")), "none") == "none"
    refs = render.answer(render.references(graph.fan_out(g["ref_edges"]).where("target like '%sec-6'")), "none").split("\n")
    assert len(refs) == 3 and all("same-act" in r for r in refs)
    hits = graph.ranked_impact(graph.impacted_by(g["ref_edges"], spark.createDataFrame([(f"{HARBOUR}#part-I__sec-6",)], "node_id string")), rank)
    assert render.answer(render.impact(hits), "none").startswith(f"- {HARBOUR}#part-I__sec-13 (hop 1, weight 3.00, centrality: ")


def test_saved_graph(spark, g, tmp_path):
    d = str(tmp_path / "graph")
    with pytest.raises(FileNotFoundError):
        corpus.load(spark, d)
    corpus.save(g, d)
    again = corpus.load(spark, d)
    assert again["ref_edges"].count() == g["ref_edges"].count()
    spark.createDataFrame([('{"format": 0}',)], "value string").write.mode("overwrite").text(f"{d}/_meta")
    with pytest.raises(ValueError, match="Rebuild"):
        corpus.load(spark, d)
    assert corpus.load_sidecar(spark, d, "centrality") is None
    nodes, links = corpus.node_link(g)
    assert nodes.count() == 2 + g["sections"].count() + g["terms"].count() and "ref" in {json.loads(r.value)["key"] for r in links.collect()}


def test_acts_in_any_order(spark, g):
    def part(uri):
        keys = {"acts": "frbr_uri", "sections": "act_frbr_uri", "terms": "act_frbr_uri", "citations": "act_frbr_uri"}
        return {n: g[n].where(F.col(k) == uri) for n, k in keys.items()}

    want = {(r.src, r.dst, r.weight) for r in g["ref_edges"].collect()}
    mentions = {tuple(r) for r in g["mentions"].collect()}
    for a, b in ((HARBOUR, TIDES), (TIDES, HARBOUR)):
        t = incremental.absorbed(incremental.absorbed(None, part(a)), part(b))
        t = incremental.absorbed(t, part(b))  # once more changes nothing
        assert {(r.src, r.dst, r.weight) for r in t["ref_edges"].collect()} == want
        assert {tuple(r) for r in t["mentions"].collect()} == mentions


def test_stream(spark, g, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    index = spark.createDataFrame([(f"{s}.xml", t, 1990, "", None, i) for i, (s, t) in enumerate([("harbour", "Harbour Works Act 1990"), ("tides", "Tides and Currents Act 1991")])], "file string, name string, year int, effective_date string, title_id string, act_pos int")
    for slug in DOCS:
        (landing / f"{slug}.xml").write_text(DOCS[slug])
        q = incremental.watch(spark, str(landing), str(tmp_path / "graph"), str(tmp_path / "cp"), index)
        q.awaitTermination(120)
        assert q.exception() is None
    got = corpus.load(spark, f"{tmp_path}/graph/{incremental.latest(spark, str(tmp_path / "graph"))}")
    assert {(r.src, r.dst, r.weight) for r in got["ref_edges"].collect()} == {(r.src, r.dst, r.weight) for r in g["ref_edges"].collect()}


@pytest.fixture
def one(spark):
    def value(column, **row):
        names = ", ".join(f"{k} string" for k in row)
        return spark.createDataFrame([tuple(row.values())], names).select(column.alias("v")).first().v

    return value


@pytest.mark.parametrize("raw, want", [("the Corporations  Act 2001", ("corporations act 2001", 2001)), ("Act 2001", None), ("This Veterans’ Pay Act 1986", ("veterans' pay act 1986", 1986)), ("Fair Work Act", None), (None, None)])
def test_titles(one, raw, want):
    got = one(T.normalized_title(F.col("x")), x=raw)
    assert (tuple(got) if got else None) == want


def test_text_functions(one):
    assert one(T.prose_citations(F.col("x")), x="Nothing in the Fair Work Act 2009 or Freedom of Information Act 1982; the Veterans’ Entitlements Act 1986") == ["Fair Work Act 2009", "Freedom of Information Act 1982", "Veterans’ Entitlements Act 1986"]
    assert one(T.section_numbers(F.col("x")), x="s 7(14) and 8(2)") == ["7", "8"]
    assert one(T.section_numbers(F.col("x")), x="sections 6 to 9") == ["6", "9"]
    assert one(T.first_section_number(F.col("x")), x="none") is None
    assert one(T.number_lists(F.col("x")), x="Subsection (2) and section 26WD") == ["section 26WD"]
    assert one(T.untagged_term(F.col("x")), x="income support means a payment") == "income support"
    assert one(K.vague_terms(F.col("x")), x="reasonably in good faith and unfairly") == 4
    assert one(T.words(F.col("x")), x="") == 0


@pytest.mark.parametrize("term, want", [("the Registrar", "registrar"), ("Regulatory Powers Act", None), ("Departmental employee", None), ("Department Authority", "department"), ("Authority Regulator", "regulator")])
def test_entities(one, term, want):
    assert one(K.entity_type(F.col("x")), x=term) == want


@pytest.mark.parametrize("text, want", [("It was amended by the Sea Amendment Act 1988.", ("amends", 0.85)), ("amend or repeal the Sea Amendment Act 1988", ("cites", 0.3)), ("see the Sea Amendment Act 1988", ("cites", 0.75)), ("not here", ("cites", 0.75)), ("term as defined in the Sea Amendment Act 1988", ("references_definition", 0.85))])
def test_relations(one, text, want):
    got = one(K.settled(K.relation(F.lit("the Sea Amendment Act 1988"), F.col("x"))), x=text)
    assert tuple(got) == want


@pytest.mark.parametrize("a, b, c, want", [("high", "low", "high", "full"), ("high", "low", "low", "partial"), ("high", "medium", "low", "none"), (None, "low", "low", "not_computed")])
def test_agreement(one, a, b, c, want):
    assert one(K.agreement(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c) == want


def test_chunks(one):
    text = " ".join(f"Sentence {i}." for i in range(50))
    got = one(T.chunks(F.col("x"), 20), x=text)
    want, cur = [], None
    for seg in [f"Sentence {i}." for i in range(50)]:
        if cur is not None and len(cur) + 1 + len(seg) > 80:
            want.append(cur)
            cur = seg
        else:
            cur = seg if cur is None else f"{cur} {seg}"
    assert got == [*want, cur] and " ".join(got) == text
    assert one(T.chunks(F.col("x"), 2), x="one long sentence of many words") == ["one long sentence of many words"]


def test_junk_terms(one):
    assert all(one(K.is_junk_term(F.col("x")), x=t) for t in ("abc", "includes", "the thing", "Does not apply", "of it"))
    assert not any(one(K.is_junk_term(F.col("x")), x=t) for t in ("ofterm", "theory", "levy"))


def test_samples(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "id bigint, label string")
    want = sorted(tuple(r) for lab in "ab" for r in rows.where(F.col("label") == lab).orderBy(F.md5(F.col("id").cast("string")), "id").limit(5).collect())
    assert sorted(tuple(r) for r in score.samples(rows, "label", "id", 5).collect()) == want


def test_reconcile_parts(spark):
    cand = spark.createDataFrame([("sea act 1900", 9), ("of the sea bed act 1900", 9)], "title string, mention_count bigint")
    have = spark.createDataFrame([("Deep Sea Act 1900", 2), ("North Sea Act 1900 Notes", 1), ("Law of the Sea Bed Act 1900", 3)], "title string, file_pos bigint")
    assert {r.title: r.match for r in reconcile.contained_in(cand, have).collect()} == {"sea act 1900": "North Sea Act 1900 Notes", "of the sea bed act 1900": "Law of the Sea Bed Act 1900"}
    hits = spark.createDataFrame([("t", 1, "b"), ("t", 0, "c"), ("t", 0, "a")], "title string, pos int, name string")
    assert [tuple(r) for r in reconcile.first_confirmed(hits).collect()] == [("t", 0, "a")]
