"""Queries by name, and the SQL each is held against.

Every query reads its whole tables. SQL counts words as runs of letters, digits and
underscores, since DuckDB's word boundary knows ASCII alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from ..operators import graph, link, reconcile, render, resolve, score
from ..operators.keep import spread
from ..sources import corpus, xmlflat
from . import inputs
from .inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NAMESPACE = "http://docs.oasis-open.org" + "/legaldocml/ns/akn/3.0"
DENSE, COND = ("the", "is", "with"), ("by", "of")
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _uses(words: tuple[str, ...]) -> str:
    return f"len(list_filter({_TOKENS}, lambda w: w IN ({', '.join(repr(w) for w in words)})))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _tag(n: str) -> str:
    return f"CASE WHEN {n} >= 5 THEN 'high' WHEN {n} >= 2 THEN 'medium' ELSE 'low' END"


@query(f"SELECT doc_id, n_dense, n_cond, {_tag('n_dense')} AS tag FROM (SELECT doc_id, {_uses(DENSE)} AS n_dense, {_uses(COND)} AS n_cond FROM documents)")
def lexicon_density(spark, d):
    c = F.col("text")
    n = K.obligations(c, DENSE)
    return _docs(spark, d).select("doc_id", n.alias("n_dense"), K.conditions(c, COND).alias("n_cond"), K.density_tag(n).alias("tag"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, length(text) // 4 AS tokens FROM documents")
def word_count(spark, d):
    return _docs(spark, d).select("doc_id", T.words(F.col("text")).alias("words"), T.estimated_tokens(F.col("text")).alias("tokens"))


@query(rf"""SELECT source, sum(w)::BIGINT AS words, sum(c)::BIGINT AS cond, sum(v)::BIGINT AS vague, round(sum(c) / sum(w), 9) AS cond_density, round(sum(v) / sum(w), 9) AS vague_density
FROM (SELECT source, len(regexp_extract_all(text, '\S+')) w, {_uses(COND)} c, len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'the[\p{{L}}\p{{N}}_]*')) v FROM documents) GROUP BY source""")
def act_complexity(spark, d):
    c = F.col("text")
    rows = _docs(spark, d).select("source", T.words(c).alias("w"), K.conditions(c, COND).alias("c"), K.vague_terms(c, (r"(?iU)the", r"(?iU)the\w*")).alias("v"))
    rows = rows.groupBy("source").agg(F.sum("w").alias("words"), F.sum("c").alias("cond"), F.sum("v").alias("vague"))
    return rows.select("*", F.round(score.per_word(F.col("cond"), F.col("words")), 9).alias("cond_density"), F.round(score.per_word(F.col("vague"), F.col("words")), 9).alias("vague_density"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'the[\p{L}\p{N}_]*')) AS n FROM documents")
def indeterminate_overlap(spark, d):
    return _docs(spark, d).select("doc_id", K.vague_terms(F.col("text"), (r"(?iU)the", r"(?iU)the\w*")).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE lower(p_name) || ' act ' || (1900 + p_partkey % 100) END AS title, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(1900 + p_partkey % 100 AS INT) END AS year FROM part")
def normalize_title(spark, d):
    raw = F.expr("concat(case p_partkey % 4 when 0 then 'The  ' when 1 then 'this ' when 2 then '' else ' ' end, case p_partkey % 4 when 3 then 'Act' else concat(initcap(p_name), '  Act') end, ' ', 1900 + p_partkey % 100)")
    t = T.normalized_title(raw)
    return table(spark, d, "part").select("p_partkey", t["title"].alias("title"), t["year"].alias("year"))


_SENTENCE = "concat('Under the ', initcap(p_name), ' Act ', 1900 + p_size, ', as the ', initcap(p_name), ' and ', initcap(split(p_type, ' ')[0]), ' Rules ', 1950 + p_size, ' say; act 1999')"


@query("""SELECT p_partkey, pos - 1 AS pos, raw, lower(raw) AS title FROM (SELECT p_partkey, unnest(m) raw, generate_subscripts(m, 1) pos FROM (SELECT p_partkey, regexp_extract_all('Under the ' || n || ' Act ' || (1900 + p_size) || ', as the ' || n || ' and ' || t || ' Rules ' || (1950 + p_size) || ' say; act 1999', '\\b[A-Z(][\\w''&()\\-]*(?:\\s+(?:[A-Z(][\\w''&()\\-]*|of|and)){0,9}\\s+(?:Rules?|Regulations?|Act)\\s+\\d{4}\\b') m
FROM (SELECT *, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') n, upper(p_type[1]) || lower(split_part(p_type, ' ', 1)[2:]) t FROM part)))""".replace("\\\\", "\\"))
def prose_citations(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(T.prose_citations(F.expr(_SENTENCE))).alias("pos", "raw"))
    return rows.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "raw", T.normalized_title(F.col("raw"))["title"].alias("title")).where("title is not null")


@query("""SELECT l_orderkey, l_linenumber, unnest([1, 1, 2, 2]) AS list_pos, unnest([(l_orderkey % 300) || 'A', CAST(l_linenumber AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)]) AS number FROM lineitem""")
def intra_citations(spark, d):
    text = F.expr("concat('See sections ', l_orderkey % 300, 'A and ', l_linenumber, '(2)(b), or s ', l_suppkey, ' to ', l_partkey, '; subsection (4) is not meant')")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(T.number_lists(text)).alias("p", "raw"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("p") + 1).alias("list_pos"), F.explode(T.section_numbers(F.col("raw"))).alias("number"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_suppkey || 'A' ELSE CAST(s_suppkey AS VARCHAR) END AS number, CASE WHEN s_suppkey % 3 = 1 THEN 'part-' || s_nationkey || '__dvs-1' WHEN s_suppkey % 3 = 2 THEN '' ELSE 'Schedule-1' END AS part, CASE WHEN s_suppkey % 3 = 0 THEN 'schedule' ELSE 'section' END AS kind FROM supplier""")
def eid_parts(spark, d):
    eid = F.expr("case s_suppkey % 3 when 0 then concat('Schedule-1__item-', s_suppkey) when 1 then concat('part-', s_nationkey, '__dvs-1__sec-', s_suppkey, 'A') else concat('sec-', s_suppkey) end")
    return table(spark, d, "supplier").select("s_suppkey", T.section_number_of(eid).alias("number"), T.enclosing_part(eid).alias("part"), T.provision_type(eid).alias("kind"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'amends' WHEN 1 THEN 'repeals' ELSE 'cites' END AS relation, CASE p_partkey % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.85 WHEN 2 THEN 0.3 ELSE 0.75 END::DOUBLE AS confidence, CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS label FROM part""")
def relation_window(spark, d):
    text = F.expr("concat(case p_partkey % 5 when 0 then 'This amends ' when 1 then 'Here ' when 2 then 'amended by ' when 3 then concat('repeal', repeat(' x', 60)) else '' end, ' the ', p_brand, ' Amendment Act ', case p_partkey % 5 when 1 then 'is repealed' when 2 then 'repealing' else '' end)")
    ref = F.expr("case when p_partkey % 5 = 4 then 'nowhere' else concat('the ', p_brand, ' Amendment Act') end")
    r = K.settled(K.relation(ref, text))
    return table(spark, d, "part").select("p_partkey", r["relation"].alias("relation"), r["confidence"].alias("confidence"), K.confidence_label(r["confidence"]).alias("label"))


@query(r"""SELECT p_partkey, list_sort(list_transform(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda w: w IN ('blue', 'anvil', 'green', 'red', 'bolt', 'gear', 'steel')), lambda w: lpad(CAST(length(w) AS VARCHAR), 3, '0') || w))[-1][4:] AS kind FROM part""")
def entity_type(spark, d):
    return table(spark, d, "part").select("p_partkey", K.entity_type(F.col("p_name"), ("blue", "anvil", "green", "red", "bolt", "gear", "steel")).alias("kind"))


_HREFS = r"""hrefs AS (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href FROM pages), lost AS (SELECT h.* FROM hrefs h ANTI JOIN (SELECT DISTINCT '/' || split_part(split_part(url, '//', 2), '/', 2) path FROM pages) p ON h.href = p.path)"""


def _hrefs(spark, d):
    pages = table(spark, d, "pages")
    host = F.regexp_extract("url", "//([^/]*)", 1)
    rows = pages.select(host.alias("act_frbr_uri"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("norm_title"))
    paths = pages.select(F.concat(F.lit("/"), F.regexp_extract("url", "//[^/]*/([^/]*)", 1)).alias("norm_title")).distinct()
    return rows.join(paths, "norm_title", "left_anti").withColumn("status", F.lit("unresolved"))


@query(f"WITH {_HREFS} SELECT href AS title, count(*) AS mention_count FROM lost GROUP BY 1")
def citation_candidates(spark, d):
    return link.candidates(_hrefs(spark, d)).select("title", "mention_count")


@query(f"WITH {_HREFS} SELECT href AS title, host AS act_frbr_uri, count(*) AS n FROM lost GROUP BY 1, 2")
def candidate_sources(spark, d):
    return link.candidate_sources(_hrefs(spark, d))


@query(f"WITH {_HREFS} SELECT href AS title, count(*) AS mention_count, count(DISTINCT host) AS sources FROM lost GROUP BY 1")
def candidate_report(spark, d):
    return link.candidate_report(_hrefs(spark, d)).select("title", "mention_count", F.size("cited_by").cast("bigint").alias("sources"))


def _resolved(spark, d):
    return link.resolve_citations(inputs.citations(spark, d), inputs.acts(spark, d), inputs.sections(spark, d), inputs.terms(spark, d))


@query(f"WITH {inputs.SQL} SELECT source_id, cite_pos, bucket, status, target FROM resolved")
def resolve_refs(spark, d):
    return _resolved(spark, d).select("source_id", F.col("cite_pos").cast("bigint").alias("cite_pos"), "bucket", "status", "target")


@query(f"WITH {inputs.SQL} SELECT bucket, count_if(status <> 'self') AS total, count_if(status = 'self') AS self_citation_filtered, count_if(status = 'resolved') AS resolved, count_if(status = 'unresolved') AS unresolved FROM resolved WHERE status IN ('self', 'resolved', 'unresolved') GROUP BY 1")
def citation_stats(spark, d):
    return link.citation_stats(_resolved(spark, d))


@query(f"WITH {inputs.SQL} SELECT source_id AS src, target AS dst, count(*) AS weight, arg_min(is_cross_act, kind * 1000000000000 + cite_pos) AS is_cross_act, string_agg(ref_text, ';' ORDER BY kind, cite_pos) AS texts FROM (SELECT * REPLACE (CASE WHEN v = 3 THEN 'section ' || number || '.0' WHEN v = 4 THEN 'title' ELSE ref_text END AS ref_text) FROM resolved) WHERE target IS NOT NULL GROUP BY 1, 2")
def ref_edges(spark, d):
    rows = _resolved(spark, d).withColumn("ref_text", F.expr("case when kind = 'prose' then 'title' else ref_text end"))
    return link.ref_edges(rows).select("src", "dst", "weight", "is_cross_act", F.array_join("ref_texts", ";").alias("texts"))


@query(f"WITH {inputs.SQL} SELECT src, dst, weight FROM edges")
def edge_weights(spark, d):
    return link.edge_weights(_resolved(spark, d))


@query(f"WITH {inputs.SQL} SELECT src, target, relation_confidence_label, extraction_confidence_label, count(*) AS n FROM (SELECT source_id src, target, 'medium' relation_confidence_label, 'medium' extraction_confidence_label FROM resolved WHERE target IS NOT NULL) GROUP BY ALL")
def fan_out(spark, d):
    return graph.fan_out(link.ref_edges(_resolved(spark, d))).groupBy("src", "target", "relation_confidence_label", "extraction_confidence_label").agg(F.count("*").alias("n"))


_RELATED = "CASE v WHEN 0 THEN 'amends' WHEN 1 THEN 'repeals' WHEN 2 THEN 'references_definition' ELSE 'cites' END"


def _related(spark, d):
    """Edges whose citations have all kinds of relation."""
    v = F.expr("case when kind = 'tagged' and ref_text = 'section 2' then 'amends' when kind = 'tagged' and ref_text = 'section 9' then 'repeals' when kind = 'tagged' then 'references_definition' else 'cites' end")
    return link.ref_edges(_resolved(spark, d).withColumn("relation", v))


@query(f"WITH {inputs.SQL} SELECT {_RELATED} AS relation, count(*) AS n FROM resolved WHERE target IS NOT NULL GROUP BY 1")
def relation_distribution(spark, d):
    return score.relation_distribution(_related(spark, d))


@query(f"WITH {inputs.SQL} SELECT relation, src, dst, n AS pos FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY src, dst, n) k FROM (SELECT {_RELATED} relation, source_id src, target dst, (row_number() OVER (PARTITION BY source_id, target ORDER BY kind, cite_pos) - 1)::INT n FROM resolved WHERE target IS NOT NULL)) WHERE k <= 10")
def relation_samples(spark, d):
    return score.relation_samples(_related(spark, d), 10).select("relation", "src", "dst", "pos")


@query(f"WITH {inputs.SQL} SELECT count(*) AS edges, count_if(weight > 1) AS repeated, sum(weight)::BIGINT AS weight FROM (SELECT source_id, target, count(*) weight, arg_min(is_cross_act, kind * 1000000000000 + cite_pos) x FROM resolved WHERE target IS NOT NULL GROUP BY 1, 2) WHERE NOT x AND split_part(source_id, '#', 1) = split_part(target, '#', 1)")
def intra_act_edges(spark, d):
    return score.intra_act_edges(link.ref_edges(_resolved(spark, d))).agg(F.count("*").alias("edges"), F.count_if(F.col("weight") > 1).alias("repeated"), F.sum("weight").alias("weight"))


@query(f"WITH {inputs.SQL} SELECT src, dst, weight FROM edges ORDER BY weight DESC, src, dst LIMIT 10")
def heaviest_edges(spark, d):
    return score.heaviest(link.edge_weights(_resolved(spark, d)), 10)


@query(f"""WITH {inputs.SQL}, m AS (SELECT s.node_id src, t.node_id dst FROM sections s JOIN (SELECT act_frbr_uri, display_term, arg_max(node_id, doc_pos) node_id FROM terms WHERE entity_type IS NOT NULL GROUP BY 1, 2) t USING (act_frbr_uri) WHERE contains(s.text, t.display_term)),
e AS (SELECT src, dst, 'ref' AS type FROM edges UNION ALL SELECT DISTINCT act_frbr_uri, node_id, 'contains' FROM sections UNION ALL SELECT DISTINCT t.act_frbr_uri || '#' || t.section_eid, t.node_id, 'defines' FROM terms t SEMI JOIN sections s ON s.node_id = t.act_frbr_uri || '#' || t.section_eid UNION ALL SELECT DISTINCT src, dst, 'mentions' FROM m),
n AS (SELECT frbr_uri id, 'act' AS type FROM acts UNION SELECT node_id, 'section' FROM sections UNION SELECT node_id, 'defined_term' FROM terms),
a AS (SELECT 'node' AS what, type FROM n UNION ALL SELECT 'edge', type FROM e) SELECT what, type, count(*) AS n FROM a GROUP BY 1, 2 UNION ALL SELECT what, 'total', count(*) FROM a GROUP BY 1""")
def graph_stats(spark, d):
    s, t = inputs.sections(spark, d), inputs.terms(spark, d)
    edges = link.all_edges(s, t, link.edge_weights(_resolved(spark, d)), link.mentions(s, t))
    return link.graph_stats(inputs.acts(spark, d), s, t, edges)


@query(f"""WITH {inputs.LAYERED}, h1 AS (SELECT r.dst AS start, r.src node_id, r.w FROM flow r WHERE r.dst LIKE 'r%'), h2 AS (SELECT start, f.src node_id, max(h.w * f.w) w FROM h1 h JOIN flow f ON f.dst = h.node_id GROUP BY 1, 2), h3 AS (SELECT start, f.src node_id, max(h.w * f.w) w FROM h2 h JOIN flow f ON f.dst = h.node_id GROUP BY 1, 2)
SELECT start, node_id, 1 AS hop, w AS path_weight FROM h1 UNION ALL SELECT start, node_id, 2, w * 0.5 FROM h2 UNION ALL SELECT start, node_id, 3, w * 0.25 FROM h3""")
def impact_3hop(spark, d):
    starts = table(spark, d, "region").selectExpr("concat('r', r_regionkey) node_id")
    return graph.impacted_by(inputs.layered(spark, d), starts).select("start", "node_id", "hop", "path_weight")


@query(f"""WITH {inputs.LAYERED}, h1 AS (SELECT src node_id, w FROM flow WHERE dst = 'n1'), h2 AS (SELECT f.src node_id, h.w * f.w w, f.dst, f.src || '-' || f.dst t FROM h1 h JOIN flow f ON f.dst = h.node_id)
SELECT node_id, 1 AS hop, node_id || '-n1' AS texts FROM h1 UNION ALL SELECT node_id, 2, first(t ORDER BY w DESC, dst) FROM h2 GROUP BY 1""")
def impact_diamond_ties(spark, d):
    starts = spark.createDataFrame([("n1",)], "node_id string")
    return graph.impacted_by(inputs.layered(spark, d), starts).select("node_id", "hop", F.array_join("ref_texts", ";").alias("texts"))


def _pagerank_sql(turns: int) -> str:
    """Turns one by one; once the change has fallen below the tolerance, no more."""
    out = f"WITH {inputs.LAYERED}, nodes AS MATERIALIZED (SELECT src id FROM flow UNION SELECT dst FROM flow), k AS (SELECT count(*)::DOUBLE n FROM nodes), o AS MATERIALIZED (SELECT src, sum(w) total FROM flow GROUP BY 1), s AS MATERIALIZED (SELECT f.src, f.dst, f.w / o.total p FROM flow f JOIN o USING (src)), r0 AS MATERIALIZED (SELECT id, 1 / n AS x FROM nodes, k), f0 AS MATERIALIZED (SELECT false AS done)"
    for i in range(turns):
        out += f", d{i} AS (SELECT coalesce(sum(x), 0) stuck FROM r{i} r ANTI JOIN o ON o.src = r.id), g{i} AS (SELECT s.dst, sum(r.x * s.p) g FROM r{i} r JOIN s ON s.src = r.id GROUP BY 1), t{i} AS MATERIALIZED (SELECT r.id, x, 0.15 / n + 0.85 * stuck / n + 0.85 * coalesce(g, 0) y FROM r{i} r CROSS JOIN k CROSS JOIN d{i} LEFT JOIN g{i} ON g{i}.dst = r.id), r{i + 1} AS MATERIALIZED (SELECT id, CASE WHEN done THEN x ELSE y END x FROM t{i}, f{i}), f{i + 1} AS MATERIALIZED (SELECT done OR (SELECT sum(abs(y - x)) FROM t{i}) < 1e-6 * n AS done FROM f{i}, k)"
    return out + f" SELECT id AS node_id, round(x, 9) AS score FROM r{turns}"


@query(_pagerank_sql(60))
def pagerank(spark, d):
    return graph.pagerank(inputs.layered(spark, d)).select("node_id", F.round("score", 9).alias("score"))


_BY_SUPPLIER = "SELECT l_suppkey, count(*) AS score FROM lineitem GROUP BY 1"


@query(f"SELECT l_suppkey, score, round_even(percent_rank() OVER (ORDER BY score) * 100, 1) AS percentile FROM ({_BY_SUPPLIER}) UNION ALL SELECT -n_nationkey - 1, NULL, NULL FROM nation")
def centrality_percentile(spark, d):
    """Suppliers by their line items, and nations, which have no score."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("score"))
    return graph.percentiles(rows.union(table(spark, d, "nation").selectExpr("cast(-n_nationkey - 1 as bigint)", "cast(null as bigint)"))).select("l_suppkey", "score", "percentile")


@query(f"""WITH {inputs.SQL}, r AS (SELECT p_partkey, '/akn/au/act/' || p_partkey act, lower(p_type) term, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'part-I__sec-' || (1 + p_partkey % 4) ELSE 'part-II__sec-1' END place FROM part),
c AS (SELECT r.*, t.definition_text, t.section_eid, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN place IS NULL THEN 0 WHEN t.section_eid = place THEN 0 ELSE 1 END, t.doc_pos) k FROM r JOIN terms t ON t.act_frbr_uri = r.act AND t.term = r.term WHERE t.definition_text <> '')
SELECT c.act AS act_frbr_uri, c.section_eid, c.definition_text, a.title AS act_title FROM c JOIN acts a ON a.frbr_uri = c.act WHERE k = 1 AND (place IS NULL OR place LIKE 'part-I\\_\\_%' ESCAPE '\\')""")
def resolve_definition(spark, d):
    asked = table(spark, d, "part").selectExpr("concat(' ', upper(p_type), ' ') term", "concat('/akn/au/act/', p_partkey) act_frbr_uri", "case p_partkey % 3 when 0 then null when 1 then concat('part-I__sec-', 1 + p_partkey % 4) else 'part-II__sec-1' end section_eid")
    return resolve.resolve_definitions(asked, inputs.terms(spark, d), inputs.acts(spark, d)).select("act_frbr_uri", "section_eid", "definition_text", "act_title")


@query(f"WITH {inputs.SQL} SELECT t.act_frbr_uri, section_eid, definition_text, title AS act_title FROM terms t JOIN acts ON frbr_uri = act_frbr_uri WHERE term = (SELECT min(lower(p_type)) FROM part) AND definition_text <> ''")
def find_all_definitions(spark, d):
    first = table(spark, d, "part").agg(F.min(F.lower("p_type")).alias("t")).first()["t"]
    return resolve.find_all_definitions(inputs.terms(spark, d), inputs.acts(spark, d), f" {first.upper()} ").select("act_frbr_uri", "section_eid", "definition_text", "act_title")


@query(f"WITH {inputs.SQL} SELECT term, display_term, section_eid, definition_text FROM terms WHERE act_frbr_uri = '/akn/au/act/1'")
def act_terms(spark, d):
    return resolve.act_terms(inputs.terms(spark, d), "/akn/au/act/1").select("term", "display_term", "section_eid", "definition_text")


@query(f"WITH {inputs.SQL} SELECT node_id, entity_type, section_eid, title AS act_title FROM terms JOIN acts ON frbr_uri = act_frbr_uri WHERE entity_type IS NOT NULL AND display_term = (SELECT max(p_type) FROM part)")
def find_entity(spark, d):
    last = table(spark, d, "part").agg(F.max("p_type").alias("t")).first()["t"]
    return resolve.find_entity(inputs.terms(spark, d), inputs.acts(spark, d), last).select("node_id", "entity_type", "section_eid", "act_title")


@query(f"WITH {inputs.SQL} SELECT term, first(display_term ORDER BY act_frbr_uri, doc_pos) AS display_term, count(DISTINCT act_frbr_uri) AS act_count FROM terms WHERE definition_text <> '' AND length(term) >= 4 GROUP BY 1 HAVING count(DISTINCT act_frbr_uri) >= 3")
def multi_act_terms(spark, d):
    return resolve.multi_act_terms(inputs.terms(spark, d))


@query(f"WITH {inputs.SQL} SELECT (SELECT count(*) FROM acts) AS acts, count_if(definition_text <> '') AS valid_terms FROM terms")
def counts(spark, d):
    return resolve.counts(inputs.acts(spark, d), inputs.terms(spark, d))


@query(f"WITH {inputs.SQL} SELECT act_frbr_uri, term, count(*) AS n FROM terms GROUP BY 1, 2 HAVING count(*) > 1")
def collisions(spark, d):
    return resolve.collisions(inputs.terms(spark, d))


@query(f"WITH {inputs.SQL} SELECT t.act_frbr_uri || '#' || t.section_eid AS src, t.node_id AS dst FROM terms t SEMI JOIN sections s ON s.node_id = t.act_frbr_uri || '#' || t.section_eid")
def defines(spark, d):
    return link.defines(inputs.terms(spark, d), inputs.sections(spark, d))


@query(f"WITH {inputs.SQL} SELECT node_id, row_number() OVER (PARTITION BY act_frbr_uri, term ORDER BY doc_pos)::INT AS occurrence FROM terms")
def numbered_terms(spark, d):
    return link.numbered_terms(inputs.terms(spark, d).drop("node_id", "occurrence")).select("node_id", "occurrence")


_NAMES = "(VALUES ('The', 1), ('the', 2), ('with', 3), ('worthless', 4), ('de', 5)) n(name, pos)"


@query(rf"""SELECT CAST(doc_id AS VARCHAR) AS src, source || '#' || name AS dst, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+'), lambda w: w = name)) AS count FROM documents, {_NAMES} WHERE len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+'), lambda w: w = name)) > 0""")
def entity_mentions(spark, d):
    docs = _docs(spark, d)
    sections = docs.selectExpr("cast(doc_id as string) node_id", "source act_frbr_uri", "text", "doc_id doc_pos")
    names = docs.select("source").distinct().selectExpr("source act_frbr_uri", r"explode(array('The', 'the', 'with', 'worthless', 'de', '\\E(')) display_term")
    terms = names.selectExpr("act_frbr_uri", "display_term", "concat(act_frbr_uri, '#', display_term) node_id", "'x' entity_type", "1 doc_pos")
    return link.mentions(sections, terms)


@query(f"WITH {inputs.SQL}, o AS (SELECT act_frbr_uri, display_term, arg_max(node_id, doc_pos) dst, arg_max(entity_type, doc_pos) entity_type FROM terms WHERE entity_type IS NOT NULL GROUP BY 1, 2) SELECT s.node_id AS src, o.dst AS node_id, display_term, entity_type, 1::BIGINT AS count FROM sections s JOIN o USING (act_frbr_uri)")
def entities_in_sections(spark, d):
    s, t = inputs.sections(spark, d), inputs.terms(spark, d)
    return graph.entities_in_sections(link.mentions(s, t), t)


_LAB = "CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS tag, CASE WHEN toxic = 1 THEN 'high' WHEN doc_id % 7 = 0 THEN NULL ELSE 'low' END AS vague"
_REC = f"r AS (SELECT doc_id, source, l.tag, l.vague, {_uses(DENSE)} n FROM documents LEFT JOIN (SELECT doc_id, {_LAB} FROM labels) l USING (doc_id)), c AS (SELECT *, {_tag('n')} density FROM r)"
_AGREE = "CASE WHEN tag IS NULL OR vague IS NULL THEN 'not_computed' ELSE CASE len(list_distinct([tag, CASE vague WHEN 'high' THEN 'low' WHEN 'low' THEN 'high' ELSE vague END, density])) WHEN 1 THEN 'full' WHEN 2 THEN 'partial' ELSE 'none' END END"


def _records(spark, d):
    lab = table(spark, d, "labels").selectExpr("doc_id", "case when quality = 1 then 'high' else 'low' end tag", "case when toxic = 1 then 'high' when doc_id % 7 = 0 then null else 'low' end vague")
    n = K.obligations(F.col("text"), DENSE)
    rows = _docs(spark, d).join(lab, "doc_id", "left").select("doc_id", "source", "tag", "vague", K.density_tag(n).alias("density"))
    return rows.withColumn("agreement", K.agreement(F.col("tag"), F.col("vague"), F.col("density")))


@query(f"WITH {_REC} SELECT doc_id, tag, density, {_AGREE} AS agreement FROM c")
def agreement(spark, d):
    return _records(spark, d).select("doc_id", "tag", "density", "agreement")


@query(f"WITH {_REC} SELECT source AS act_frbr_uri, count(*) AS records, count(tag) AS scored, round_even(count_if(tag = 'low') * 100.0 / count(tag), 1) AS low, round_even(count_if(tag = 'high') * 100.0 / count(tag), 1) AS high FROM c GROUP BY 1")
def act_summary(spark, d):
    rows = _records(spark, d).selectExpr("source act_frbr_uri", "tag llm_tag", "'x' parse_verification_status", "cast(doc_id as string) eid")
    return score.codifiability_summary(rows).select("act_frbr_uri", "records", "scored", "low", "high")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS eid, source AS act_frbr_uri, {_uses(('must', 'shall', 'required', 'prohibited'))} AS n, 'low' AS tag, CASE WHEN source = 'src1' THEN 'spot_checked' ELSE 'not_yet_checked' END AS status FROM documents")
def codifiability(spark, d):
    s = _docs(spark, d).selectExpr("cast(doc_id as string) node_id", "cast(doc_id as string) eid", "source act_frbr_uri", "text")
    checked = spark.createDataFrame([("src1", "checked"), ("src1", "spot_checked"), ("src1", "checked")], "act_frbr_uri string, status string")
    return score.codifiability(s, checked).selectExpr("eid", "act_frbr_uri", "prescriptive_density_count n", "prescriptive_density_tag tag", "parse_verification_status status")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, d):
    return score.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT lang, count(*) AS n, round(avg((quality = toxic)::INT), 9) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def agreement_rate(spark, d):
    rows = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return score.agreement_rate(rows, "quality", "toxic", "lang").select("lang", "n", F.round("rate", 9).alias("rate"))


@query("SELECT count(*) AS n, round(corr(s_acctbal, n), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM (SELECT *, rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2 rx, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 ry FROM (SELECT s_suppkey, s_acctbal, count(*) n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2))")
def correlation(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    rows = table(spark, d, "supplier").join(n, "s_suppkey")
    return score.correlation(rows, "s_acctbal", "n_lines").select("n", F.round("pearson", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def group_means(spark, d):
    return score.group_means(_docs(spark, d), "lang", "n_chars").select("lang", "n", F.round("mean", 6).alias("mean"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) k FROM documents) WHERE k <= 5")
def sample_per_group(spark, d):
    return score.samples(_docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", 5)


@query("WITH c AS (SELECT DISTINCT substr(p_name, 2, length(p_name) - 2) t FROM part UNION SELECT unnest(['', ' ', '—', '.'])), e AS (SELECT p_name || ' of ' || p_type n, p_partkey k FROM part) SELECT t AS title, arg_min(n, k) AS match FROM c JOIN e ON contains(lower(n), lower(t)) GROUP BY 1")
def theta_contains(spark, d):
    """Some titles have no word: the empty one is in every title, a dash in none."""
    part = table(spark, d, "part")
    bare = spark.createDataFrame([("",), (" ",), ("—",), (".",)], "title string")
    return reconcile.contained_in(part.selectExpr("substr(p_name, 2, length(p_name) - 2) title").union(bare), part.selectExpr("concat(p_name, ' of ', p_type) title", "p_partkey file_pos")).select("title", "match")


@query("SELECT lower(p_name) AS old, arg_max(lower(p_brand), p_partkey) AS current FROM part GROUP BY 1")
def rename_map(spark, d):
    return reconcile.rename_map(table(spark, d, "part").selectExpr("p_brand name", "p_partkey pos", "array(upper(p_name), p_brand) name_history"))


_LEDGER = "led AS (SELECT CASE WHEN p_size = 7 THEN 'repeal of ' ELSE '' END || lower(p_name || ' ' || p_brand) title, count(*) mention_count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)"
_TITLES = "lower(p_name || ' ' || p_brand)"


@query(f"""WITH {_LEDGER}, ex AS (SELECT DISTINCT lower(CASE WHEN p_size > 40 THEN 'the ' || p_name || ' ' || p_brand || ' act' ELSE p_type || ' act' END) n FROM part), ren AS (SELECT CASE WHEN p_size > 30 THEN {_TITLES} ELSE lower(p_type) END t FROM part), kn AS (SELECT CASE WHEN p_size > 20 THEN {_TITLES} ELSE lower(p_type) END t FROM part)
SELECT title, mention_count, CASE WHEN mention_count < 25 THEN 'below_threshold' WHEN title = (SELECT min({_TITLES}) FROM part) THEN 'excluded' WHEN contains(title, 'repeal') THEN 'amendment_or_repeal' WHEN EXISTS (SELECT 1 FROM ex WHERE contains(n, title)) THEN 'present'
WHEN title IN (SELECT t FROM ren) THEN 'renamed' WHEN title IN (SELECT t FROM kn) THEN 'known_title' ELSE 'genuine' END AS status FROM led""")
def reconcile_status(spark, d):
    """Every part gives a title to each list; size decides which kind of title."""
    part = table(spark, d, "part")
    title = F.expr("concat(p_name, ' ', p_brand)")
    of = lambda least: F.when(F.col("p_size") > least, title).otherwise(F.col("p_type"))
    own = part.withColumn("title", F.expr("concat(if(p_size = 7, 'repeal of ', ''), lower(concat(p_name, ' ', p_brand)))"))
    ledger = own.join(table(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey")).groupBy("title").agg(F.count("*").alias("mention_count"))
    have = part.select(F.when(F.col("p_size") > 40, F.concat(F.lit("the "), title, F.lit(" act"))).otherwise(F.concat("p_type", F.lit(" act"))).alias("title"), F.col("p_partkey").alias("file_pos"))
    renames = part.groupBy(F.lower(of(30)).alias("old")).agg(F.max("p_brand").alias("current"))
    known = part.select(of(20).alias("name"))
    return reconcile.status_report(ledger, have, renames, known, part.agg(F.min(F.lower(title)).alias("title")), threshold=25).select("title", "mention_count", "status")


@query("SELECT o_orderkey, 'signal1_' || substr(sha256('signal1:' || o_orderkey), 1, 16) AS custom_id FROM orders")
def custom_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", K.request_id("signal1", F.col("o_orderkey").cast("string")).alias("custom_id"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS tag, CASE WHEN o_orderkey % 4 < 2 THEN o_orderpriority END AS reasoning FROM orders")
def parse_signal(spark, d):
    reply = F.expr("""case o_orderkey % 4 when 0 then concat('{"tag": "high", "reasoning": "', o_orderpriority, '"}') when 1 then concat('```json\n{"tag":"low","reasoning":"', o_orderpriority, '"}\n```') when 2 then '{"tag": "high", "reasoning": 5}' else 'no JSON' end""")
    r = K.parsed_signal(reply)
    return table(spark, d, "orders").select("o_orderkey", r["tag"].alias("tag"), r["reasoning"].alias("reasoning"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'https://www.legislation.gov.au/C' || p_partkey || '/latest/text' END AS url FROM part")
def deep_links(spark, d):
    return inputs.acts(spark, d).select(F.col("act_pos").alias("p_partkey"), K.deep_link(F.col("title_id")).alias("url"))


@query(r"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN length(text) // 4 <= 100 THEN [text] ELSE (SELECT list_append(r.done, r.open) FROM (SELECT list_reduce(list_transform(p, lambda x: {'done': []::VARCHAR[], 'open': x}), lambda a, b: CASE WHEN length(a.open) + 1 + length(b.open) <= 400 THEN {'done': a.done, 'open': a.open || ' ' || b.open} ELSE {'done': list_append(a.done, a.open), 'open': b.open} END) r)) END l FROM s)
SELECT doc_id, (i - 1)::INT AS pos, length(l[i])::INT AS n_chars, md5(l[i]) AS chunk FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) i FROM c)""")
def chunk_text(spark, d):
    """Chunks of at most 100 tokens: a fold over sentences."""
    return _docs(spark, d).select("doc_id", F.posexplode(T.chunks(F.col("text"), 100)).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' means a ' || lower(p_type) END AS term, 2::BIGINT + CASE WHEN p_partkey % 3 = 1 THEN -1 ELSE 0 END AS n FROM part WHERE p_partkey % 3 < 2")
def untagged_terms(spark, d):
    text = F.expr("case p_partkey % 3 when 0 then concat(p_name, ' means this, a ', p_name) when 1 then concat(p_name, ' means a ', lower(p_type), ' means x') else concat('9', p_name, ' means') end")
    rows = table(spark, d, "part").select("p_partkey", text.alias("t"), T.untagged_term(text).alias("term")).where("term is not null")
    return rows.select("p_partkey", "term", T.recurrences(F.col("t"), F.col("term")).alias("n"))


def _el(name: str, inner: str, attributes: str = "") -> str:
    return f"<{name}{attributes}>{inner}</{name}>"


def _xml(spark, d):
    """A document for each part, its columns between the marks of a SQL concat."""
    part = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    col = lambda c: f"', {c}, '"
    names = _el("identification", _el("FRBRWork", f'<FRBRuri value="/akn/{col("p_partkey")}/"/>') + _el("FRBRExpression", '<FRBRdate name="Generation" date="2020-01-01"/>'))
    ref = _el("ref", f" the {_el('i', 'one')} ", ' href="#part-I__sec-1"')
    text = _el("p", f"{col('p_name')} {ref}&amp; more") + _el("p", f"{_el('term', col('p_type'))} means {_el('def', 'a  thing')}")
    section = _el("section", _el("num", "1") + _el("heading", col("p_brand")) + _el("content", text), f' eId="part-I__sec-{col("p_partkey")}"')
    xml = _el("akomaNtoso", _el("act", _el("meta", names) + _el("body", section)), f' xmlns="{NAMESPACE}"')
    return part.selectExpr("p_partkey", "p_name", "p_brand", "p_type", f"encode(concat('{xml}'), 'UTF-8') content", "cast(p_partkey as string) path")


@query("SELECT '/akn/' || p_partkey AS frbr_uri, 'part-I__sec-' || p_partkey AS eid, p_brand AS heading, '1' || p_brand || p_name || '  the one & more' || p_type || ' means a thing' AS text, '1' || p_name || ' & more' || p_type || ' means a thing' AS prose_text, 'the one' AS ref_text, '#part-I__sec-1' AS href FROM part".replace("'  the one & more'", "' the one & more'"))
def xml_flatten(spark, d):
    flat = xmlflat.flat_documents(_xml(spark, d))
    rows = flat.select("frbr_uri", F.explode("sections").alias("s")).select("frbr_uri", "s.*")
    return rows.select("frbr_uri", "eid", "heading", "text", "prose_text", F.explode("refs").alias("r")).select("frbr_uri", "eid", "heading", "text", "prose_text", "r.ref_text", "r.href")


@query("SELECT '/akn/' || p_partkey || '#term-' || lower(replace(replace(p_type, ' ', '_'), '-', '_')) AS node_id, p_type AS display_term, 'part-I__sec-' || p_partkey AS section_eid, 'a  thing' AS definition_text FROM part")
def xml_terms(spark, d):
    rows = xmlflat.flat_documents(_xml(spark, d)).selectExpr("*", "'x' name", "2000 year", "'' effective_date", "'' title_id", "1 act_pos")
    return corpus.tables(rows)["terms"].select("node_id", "display_term", "section_eid", "definition_text")


@query("SELECT '/akn/' || p_partkey AS act_frbr_uri, '/akn/' || p_partkey || '#part-I__sec-' || p_partkey AS source_id, 'tagged' AS kind, 'the one' AS ref_text, 0.95::DOUBLE AS extraction_confidence FROM part")
def xml_citations(spark, d):
    rows = xmlflat.flat_documents(_xml(spark, d)).selectExpr("*", "'x' name", "2000 year", "'' effective_date", "'' title_id", "1 act_pos")
    return corpus.tables(rows)["citations"].select("act_frbr_uri", "source_id", "kind", "ref_text", "extraction_confidence")


@query("SELECT '**' || p_type || '** (' || p_name || ' - sec-' || p_partkey || ')' || chr(10) || chr(10) || p_brand AS line FROM part")
def rendered_definitions(spark, d):
    return render.definitions(table(spark, d, "part").selectExpr("p_type display_term", "p_name act_title", "concat('sec-', p_partkey) section_eid", "p_brand definition_text"))


@query(f"""SELECT '- s' || l_suppkey || ' (hop ' || (1 + score % 3) || ', weight ' || printf('%.2f', score::DOUBLE) || CASE WHEN p IS NULL THEN '' ELSE ', centrality: ' || p || 'th percentile' END || ') cites via "a; b"' AS line FROM (SELECT l_suppkey, score, CASE WHEN s_acctbal > 3000 THEN round_even(percent_rank() OVER (PARTITION BY s_acctbal > 3000 ORDER BY score) * 100, 1) END p FROM ({_BY_SUPPLIER}) JOIN supplier ON s_suppkey = l_suppkey)""")
def rendered_impact(spark, d):
    """Percentiles among suppliers of some wealth; the others have none."""
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("score")).withColumn("node_id", F.format_string("s%d", "l_suppkey"))
    rank = n.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).where("s_acctbal > 3000").select("node_id", "score")
    return render.impact(graph.ranked_impact(n.selectExpr("node_id", "cast(1 + score % 3 as int) hop", "cast(score as double) path_weight", "array('a', 'b') ref_texts"), rank))


@query("SELECT p_partkey, floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 15)::INT AS batch FROM part")
def term_batches(spark, d):
    rows = resolve.term_batches(table(spark, d, "part").selectExpr("p_brand node_id", "p_partkey pos", "cast(p_partkey as string) term"))
    return rows.select(F.explode("terms").alias("p_partkey"), "batch").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "batch")


@query("SELECT p_brand AS node_id, arg_min(p_name, p_partkey) AS definition_text, lower(p_type) AS term FROM part GROUP BY p_brand, lower(p_type)")
def first_definitions(spark, d):
    rows = resolve.first_definitions(table(spark, d, "part").selectExpr("p_brand node_id", "p_type term", "p_name definition_text", "p_partkey pos"), "pos")
    return rows.select("node_id", "definition_text", F.lower("term").alias("term"))


@query("SELECT p_partkey, p_type AS term, p_name AS definition_text FROM part WHERE p_partkey % 4 < 2 UNION ALL SELECT p_partkey, 'second', 'stands' FROM part WHERE p_partkey % 4 < 3")
def verified_definitions(spark, d):
    """Replies with and without a fence, with items that are no object or have a number
    for a term, with what does not stand in the section, and replies that are no list."""
    items = """concat('[{"term": "', p_type, '", "definition_text": "', p_name, if(p_partkey % 4 = 2, ' not', ''), '"}, "x", 7, {"term": 5, "definition_text": "here"}, {"term": "", "definition_text": "here"}, {"term": "second", "definition_text": "stands"}]')"""
    reply = f"case p_partkey % 4 when 1 then concat('```json\\n', {items}, '\\n```') when 3 then concat('{{', {items}, '}}') else {items} end reply"
    rows = table(spark, d, "part").selectExpr("p_partkey", "concat('here ', p_name, ' stands') section_text", reply)
    return resolve.verified_definitions(rows).select("p_partkey", "term", "definition_text")


@query(f"WITH {inputs.SQL} SELECT p_partkey, t.node_id AS act FROM part JOIN (SELECT frbr_uri node_id, lower(title) k FROM acts) t ON t.k = lower(p_name) || ' act ' || (1900 + p_partkey % 20)")
def matched_acts(spark, d):
    other = table(spark, d, "part").selectExpr("p_partkey", "concat('the ', upper(p_name), ' ACT ', 1900 + p_partkey % 20) title")
    return reconcile.matched_acts(inputs.acts(spark, d), other).select("p_partkey", F.col("frbr_uri").alias("act"))


@query(f"WITH {inputs.SQL} SELECT p_partkey, s.text FROM part JOIN acts a ON a.title = (SELECT b.title FROM acts b WHERE b.act_pos = p_partkey) JOIN sections s ON s.act_frbr_uri = a.frbr_uri AND s.number = CAST(1 + p_partkey % 4 AS VARCHAR)")
def rule_texts(spark, d):
    a = inputs.acts(spark, d)
    rules = a.selectExpr("act_pos p_partkey", "title act_title", "cast(1 + act_pos % 4 as string) section_number")
    return reconcile.rule_texts(rules, a, inputs.sections(spark, d)).select("p_partkey", "text")


@query(f"WITH {inputs.SQL} SELECT act_frbr_uri AS src, node_id AS dst FROM sections")
def contains(spark, d):
    return link.contains(inputs.sections(spark, d))


@query(f"WITH {inputs.SQL} SELECT node_id, doc_pos FROM sections WHERE act_frbr_uri = '/akn/au/act/2'")
def act_sections(spark, d):
    return graph.sections_of(inputs.sections(spark, d), "/akn/au/act/2").select("node_id", "doc_pos")


@query(f"WITH {inputs.SQL} SELECT title FROM acts WHERE frbr_uri = '/akn/au/act/2'")
def act_title(spark, d):
    return resolve.act_title(inputs.acts(spark, d), "/akn/au/act/2")


@query(f"WITH {inputs.LAYERED}, r AS (SELECT dst, sum(w)::BIGINT score FROM flow GROUP BY 1), p AS (SELECT *, round_even(percent_rank() OVER (ORDER BY score) * 100, 1) pct FROM r) SELECT f.src AS node_id, pct AS centrality_percentile FROM flow f LEFT JOIN p ON p.dst = f.src WHERE f.dst = 'r1' UNION ALL SELECT g.src, pct FROM flow f JOIN flow g ON g.dst = f.src LEFT JOIN p ON p.dst = g.src WHERE f.dst = 'r1'")
def ranked_impact(spark, d):
    edges = inputs.layered(spark, d)
    scores = edges.groupBy(F.col("dst").alias("node_id")).agg(F.sum("weight").alias("score"))
    return graph.ranked_impact(graph.impacted_by(edges, spark.createDataFrame([("r1",)], "node_id string"), max_hops=2), scores).select("node_id", "centrality_percentile")


@query(f"WITH {inputs.SQL} SELECT node_id, CASE WHEN occurrence = 1 AND p % 2 = 0 THEN 'new' ELSE definition_text END AS definition_text FROM (SELECT t.*, CASE WHEN node_id LIKE '%\\_\\_2' ESCAPE '\\' THEN 2 ELSE 1 END occurrence, CAST(split_part(split_part(act_frbr_uri, '/', 5), '#', 1) AS INT) p FROM terms t)")
def added_terms(spark, d):
    t = inputs.terms(spark, d)
    new = table(spark, d, "part").where("p_partkey % 2 = 0").selectExpr("p_type display_term", "concat('/akn/au/act/', p_partkey) act_frbr_uri", "'part-I__sec-1' section_eid", "'new' definition_text", "p_partkey * 10 doc_pos")
    return resolve.added_terms(t, new).select("node_id", "definition_text")


@query("SELECT p_partkey AS node_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS v FROM part")
def upserted(spark, d):
    part = table(spark, d, "part")
    return link.upserted(part.selectExpr("p_partkey node_id", "p_brand v"), part.where("p_partkey % 3 = 0").selectExpr("p_partkey node_id", "p_name v"))


@query(f"""WITH {inputs.SQL}, o AS (SELECT act_frbr_uri, display_term, arg_max(node_id, doc_pos) dst FROM terms WHERE entity_type IS NOT NULL GROUP BY 1, 2)
SELECT s.node_id AS src, o.dst, CASE WHEN p_size > 25 THEN 2 ELSE 1 END::BIGINT AS count FROM sections s JOIN o USING (act_frbr_uri) JOIN part ON act_frbr_uri = '/akn/au/act/' || p_partkey""")
def rebuilt_mentions(spark, d):
    """Mentions of some acts made afresh, from texts that now name their entity twice."""
    s, t = inputs.sections(spark, d), inputs.terms(spark, d)
    some = table(spark, d, "part").where("p_size > 25").selectExpr("concat('/akn/au/act/', p_partkey) frbr_uri", "p_type")
    again = s.join(some.withColumnRenamed("frbr_uri", "act_frbr_uri"), "act_frbr_uri").withColumn("text", F.concat_ws(" ", "text", "p_type")).select(*s.columns)
    return link.rebuilt(link.mentions(s, t), link.mentions(again, t, some), s, some)


@query("SELECT p_partkey, unnest([p_name || ' of ' || p_brand, 'of ' || p_brand]) AS fragment FROM (SELECT *, row_number() OVER () FROM part WHERE NOT contains(p_name, ' ')) UNION ALL SELECT p_partkey, unnest([p_name || ' of ' || p_brand, split_part(p_name, ' ', 2) || ' of ' || p_brand, 'of ' || p_brand]) FROM part WHERE contains(p_name, ' ')")
def search_fragments(spark, d):
    title = F.expr("concat(p_name, ' of ', p_brand, ' 1999')")
    return table(spark, d, "part").select("p_partkey", F.explode(T.search_fragments(title)).alias("fragment"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'act' WHEN 1 THEN 'regulation' END AS doc_type FROM part WHERE p_partkey % 5 < 2 AND p_size > 10")
def in_force_titles(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 5 when 0 then 'C2004A1' when 1 then 'F2010L2' when 2 then 'C2004A1' else 'F2010L2' end id", "concat(p_name, case p_partkey % 5 when 1 then ' Rules 2010' when 2 then ' Amendment Act 2001' else ' Act 2001' end) name", "p_size > 10 is_in_force")
    return reconcile.in_force_titles(rows).select(F.col("p_partkey").alias("id"), "doc_type")


@query(f"WITH {inputs.SQL} SELECT source_id, cite_pos FROM citations WHERE title IS NOT NULL OR (address IS NULL AND number IS NULL) ORDER BY len(string_split(trim(title), ' ')) + CASE v WHEN 4 THEN 1 ELSE 0 END, source_id, cite_pos LIMIT 20")
def low_confidence_sample(spark, d):
    return link.low_confidence_sample(inputs.citations(spark, d), 20).select("source_id", F.col("cite_pos").cast("bigint").alias("cite_pos"))


@query("SELECT src, dst, t AS ref_text FROM (SELECT l_partkey src, l_suppkey dst, unnest(list_distinct(list(l_returnflag || l_linestatus || l_linenumber))) t FROM lineitem GROUP BY 1, 2) ORDER BY length(t), t, src, dst LIMIT 10")
def shortest_texts(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))).alias("ref_texts"))
    return score.shortest_texts(rows, 10)


@query("SELECT arg_min(p_name, p_partkey) AS name, lower(p_brand) AS title, count(*) AS hits FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand".replace("arg_min(p_name, p_partkey) AS name", "arg_min('The ' || p_brand, p_partkey) AS name"))
def confirmed_by_suffix(spark, d):
    hits = table(spark, d, "part").selectExpr("lower(p_brand) title", "case when p_partkey % 2 = 0 then concat('The ', p_brand) else concat(p_brand, ' x') end name", "p_partkey pos")
    return reconcile.confirmed_by_suffix(hits)


@query("SELECT '- [' || p_name || '](' || p_brand || ') (' || CASE WHEN p_size % 2 = 0 THEN 'cross-act' ELSE 'same-act' END || ') [cites, relation confidence: high, extraction confidence: low]' AS line FROM part")
def rendered_references(spark, d):
    return render.references(table(spark, d, "part").selectExpr("p_name ref_text", "p_brand target", "p_size % 2 = 0 is_cross_act", "'cites' relation", "'high' relation_confidence_label", "'low' extraction_confidence_label"))


@query("SELECT '**' || p_name || '** (' || p_brand || ')' || chr(10) || chr(10) || '- Cross-reference: PageRank centrality ' || printf('%.6f', p_size / 64.0) || ', raw citation count ' || p_size || chr(10) || '- Defined-term density: 1 terms (0.5000 per word)' || chr(10) || '- Indeterminate-concept frequency: 2 matches (0.2500 per word)' || chr(10) || '- Conditional-statement frequency: 3 matches (0.1250 per word)' || chr(10) || '- Word count: ' || p_partkey AS line FROM part")
def rendered_complexity(spark, d):
    return render.complexity(table(spark, d, "part").selectExpr("p_name title", "p_brand act_frbr_uri", "p_size / 64D pagerank_centrality", "p_size raw_citation_count", "1 defined_term_count", "0.5D defined_term_density", "2 indeterminate_concept_count", "0.25D indeterminate_concept_density", "3 conditional_statement_count", "0.125D conditional_statement_density", "p_partkey word_count"))


@query(f"WITH {inputs.SQL}, w AS (SELECT act_frbr_uri, sum(len(regexp_extract_all(text, '\\S+'))) words FROM sections GROUP BY 1), t AS (SELECT act_frbr_uri, count(*) n FROM terms GROUP BY 1), c AS (SELECT a, count(*) n FROM (SELECT src, dst, unnest(list_distinct([split_part(src, '#', 1), split_part(dst, '#', 1)])) a FROM edges) GROUP BY 1) SELECT frbr_uri AS act_frbr_uri, coalesce(c.n, 0) AS cited, t.n AS terms, words::BIGINT AS words, round(t.n / words, 9) AS density FROM acts JOIN w ON w.act_frbr_uri = frbr_uri JOIN t ON t.act_frbr_uri = frbr_uri LEFT JOIN c ON c.a = frbr_uri")
def act_rollup(spark, d):
    edges = link.edge_weights(_resolved(spark, d))
    rank = edges.select(F.col("dst").alias("node_id")).distinct().withColumn("score", F.lit(0.5))
    rows = score.act_complexity(inputs.acts(spark, d), inputs.sections(spark, d), inputs.terms(spark, d), edges, rank)
    return rows.select("act_frbr_uri", F.col("raw_citation_count").alias("cited"), F.col("defined_term_count").alias("terms"), F.col("word_count").alias("words"), F.round("defined_term_density", 9).alias("density"))


from . import corpora  # noqa: E402,F401  adds its queries
