"""What must hold however large the tables are: how plans work, and odd inputs of the steps
that were made for it."""

import io
import json

import pytest

from pyspark.sql import functions as F

from refloom.operators import graph, keep, link, reconcile
from refloom.plans import corpora, registry
from refloom.sources import corpus, files

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["corpus_kinds", "corpus_citations", "corpus_rejects", "xml_citations"])
def test_documents_are_flattened_once(spark, query):
    p = plan(registry.QUERIES[query](spark, DATA))
    assert p.count("MapInArrow") == 1 and "binaryFile" not in p and "Join" not in p


class Slow(io.StringIO):
    def read(self, n=-1):
        return super().read(3)


def test_index_in_pieces():
    acts = {"a": {"name": 'x "{}" \\ é', "year": 5}, "b": {}, "c": None, 'd"': 12}
    doc = {"made": {"acts": [1, {"acts": 2}]}, "acts": acts, "n": 123}
    for text in (json.dumps(doc), json.dumps(doc, indent=3), json.dumps(doc, ensure_ascii=False)):
        got = list(files.map_entries(Slow(text), "acts"))
        assert [(k, json.loads(v)) for k, v in got] == list(acts.items())
    assert list(files.map_entries(Slow('{"acts": {}}'), "acts")) == []
    for bad in ("", "{}", '{"acts": null}', '{"acts": {"a": 1}', '{"acts": {"a" 1}}', '{"acts": {}} x', "[]"):
        with pytest.raises(ValueError):
            list(files.map_entries(Slow(bad), "acts"))


def test_a_file_of_the_same_name_elsewhere_is_not_meant(spark, tmp_path):
    text = f'<a xmlns="{registry.NAMESPACE}"><FRBRWork><FRBRuri value="/akn/x"/></FRBRWork></a>'
    for place in ("xml", "old/xml"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "x.xml").write_text(text)
    entry = {"name": "X", "year": 1, "xml_path": "xml/x.xml"}
    (tmp_path / "index.json").write_text(json.dumps({"acts": {"x": entry, "none": entry | {"xml_path": None}, "far": entry | {"xml_path": f"{tmp_path}/old/xml/x.xml"}}}))
    t = corpus.read_corpus(spark, str(tmp_path))
    assert sorted((r.frbr_uri, r.act_pos) for r in t["acts"].collect()) == [("/akn/x", 0), ("/akn/x", 2)]
    assert [(r.slug, r.error) for r in t["rejects"].collect()] == [("none", "missing file")]
    with pytest.raises(FileNotFoundError):
        corpus.corpus_index(spark, str(tmp_path / "nowhere"))


def test_written_index_is_one_object_in_order(spark):
    acts = json.load(open(corpora.write_corpus(spark, DATA).removeprefix("file:").replace("//", "/") + "/index.json"))["acts"]
    n = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert list(acts) == sorted(f"p{i}" for i in range(n)) and all(e["xml_path"].startswith("xml/") for e in acts.values())


def test_pairs_of_hot_keys_are_dealt_to_tasks(spark):
    left = spark.range(120).selectExpr("id l", "cast(if(id < 90, 0, if(id < 100, null, id % 7)) as int) k", "'x' t")
    right = spark.range(80).selectExpr("id r", "cast(if(id < 50, 0, id % 9) as int) k")
    want = left.join(right, ["k"])
    got = keep.paired(left, right, ["k"], pairs=100)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    most = max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert most < want.count() / 4
    none = keep.paired(left.where("false"), right, ["k"])
    assert none.columns == want.columns and none.count() == 0


@pytest.mark.parametrize("query", ["matched_acts", "rule_texts"])
def test_rows_of_equal_titles_meet_in_as_many_tasks_as_pairs_ask_for(spark, query, monkeypatch):
    monkeypatch.setattr(reconcile, "paired", lambda a, b, keys: keep.paired(a, b, keys, pairs=10))
    df = registry.QUERIES[query](spark, DATA)
    assert df.rdd.getNumPartitions() >= df.count() / 10



@pytest.mark.parametrize("query", ["resolve_refs", "citation_stats", "ref_edges"])
def test_citations_are_looked_up_by_one_join(spark, query):
    p = plan(registry.QUERIES[query](spark, DATA))
    assert p.count("Join LeftOuter") == 3  # the fixture's titles, the own title, the lookup


def test_each_way_of_citing_finds_its_own_key(spark):
    """An address, a number and a title that read alike lead to different things."""
    acts = spark.createDataFrame([("/akn/au/1", "Old Mill Act 1990", 0), ("/akn/au/2", "Old Mill Act 1990", 1), ("/akn/au/3", None, 2)], "frbr_uri string, title string, act_pos int")
    sections = spark.createDataFrame([("/akn/au/1#sec-1", "sec-1", "/akn/au/1", 1), ("/akn/au/1#x", "part-1__sec-1", "/akn/au/1", 2), ("old mill act 1990", "sec-old mill act 1990", "/akn/au/3", 1)], "node_id string, eid string, act_frbr_uri string, doc_pos long")
    terms = spark.createDataFrame([("/akn/au/1#t",)], "node_id string")
    rows = [("#sec-1", None, None), ("#t", None, None), ("#sec-1", None, "1"), (None, None, "1"), (None, None, "old mill act 1990"), (None, "Old Mill Act 1990", None), ("/akn/au/2", "Old Mill Act 1990", "7"), ("/akn/au/old mill act 1990", None, None), (None, "", None), ("http://x", "Lost Mill Act 1990", None)]
    cites = [(f"{a}#s", a, "tagged", "Old Mill Act 1990" if t == "" else "see", h, t, n, i) for a in ("/akn/au/1", "/akn/au/3") for i, (h, t, n) in enumerate(rows)]
    c = spark.createDataFrame(cites, "source_id string, act_frbr_uri string, kind string, ref_text string, target_href string, matched_title string, matched_section string, cite_pos int")
    for parts in (1, 3):
        got = {(r.act_frbr_uri[-1], r.cite_pos): (r.status, r.target) for r in link.resolve_citations(c, acts, sections, terms, title_parts=parts).collect()}
        assert len(got) == 20
        assert [got["1", i] for i in range(10)] == [("linked", "/akn/au/1#sec-1"), ("linked", "/akn/au/1#t"), ("linked", "/akn/au/1#sec-1"), ("linked", "/akn/au/1#x"), ("missing", None), ("self", None), ("linked", "/akn/au/2"), ("missing", None), ("self", None), ("unresolved", None)]
        assert [got["3", i] for i in range(10)] == [("missing", None), ("missing", None), ("missing", None), ("missing", None), ("linked", "old mill act 1990"), ("resolved", "/akn/au/2"), ("linked", "/akn/au/2"), ("missing", None), ("resolved", "/akn/au/2"), ("unresolved", None)]


@pytest.mark.parametrize("query, rows", [("xml_citations", 500), ("xml_flatten", 500), ("xml_terms", 500)])
def test_documents_of_few_files_are_dealt_to_tasks(spark, tmp_path, query, rows):
    spark.range(4 * rows).selectExpr("id p_partkey", "'a' p_name", "'b' p_brand", "'c d' p_type").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    p = registry.QUERIES[query](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in p and p.count("MapInArrow") == 1
    assert p.index("MapInArrow") < p.index("RepartitionByExpression")  # the plan's top comes first


def test_equal_titles_are_looked_through_once(spark):
    have = spark.range(1000).selectExpr("if(id % 2 = 0, 'the old mill act', 'old mill rules') title", "1000 - id file_pos")
    got = reconcile.contained_in(spark.createDataFrame([("old mill",), ("mill rules",), ("",)], "title string"), have)
    assert {(r.title, r.match) for r in got.collect()} == {("old mill", "old mill rules"), ("mill rules", "old mill rules"), ("", "old mill rules")}
    index = plan(got)
    assert index.count("Generate") and all("Aggregate [title" in index[i:] for i in [index.index("Generate")])


def test_mentions_stay_with_their_act(spark, monkeypatch):
    monkeypatch.setattr(link, "SECTIONS", 20)
    acts = 50
    sections = spark.range(acts * 4).selectExpr("concat('a', id % 50) act_frbr_uri", "concat('a', id % 50, '#', id % 3) node_id", "'the Old Mill, Mill and Old Mill' text", "id doc_pos")
    names = spark.createDataFrame([("Mill",), ("Old Mill",), ("",)], "display_term string")
    terms = spark.range(acts).crossJoin(names).selectExpr("concat('a', id) act_frbr_uri", "display_term", "concat('a', id, '#same') node_id", "'x' entity_type", "id doc_pos")
    got = link.mentions(sections, terms)
    assert got.rdd.getNumPartitions() >= acts * 4 / 20
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, (act_frbr_uri") == 1  # names and what they mean come in one row
    want = sections.select("act_frbr_uri", "node_id").distinct().count()
    assert sorted(r["count"] for r in got.collect()) == [1] * want + [2] * want


def test_pagerank_turns_go_over_numbers(spark, monkeypatch):
    seen, keep_it = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: seen.append(dict(df.dtypes)) or keep_it(df))
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("c", "lone", 3), ("z", "a", 0)], "src string, dst string, weight int")
    got = {r.node_id: r.score for r in graph.pagerank(edges).collect()}
    assert set(got) == {"a", "b", "c", "lone", "z"} and abs(sum(got.values()) - 1) < 1e-9
    turns = [t for t in seen if "change" in t]
    assert turns and all("string" not in t.values() for t in turns)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
