"""Queries on a corpus folder that is written from the test tables, and read back.

Every part is a document of its own, named in one index. Parts of size over 45 are in the
index but have no file, and those of size under 3 have one that is no XML. Sections cite
their own act by anchor and number, an act by title and an act by title that is nowhere.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import render, resolve, score, scoring
from ..operators.keep import shared_folder, spread
from ..sources import corpus, versions
from ..sources.files import storage
from ..streaming import incremental
from . import inputs
from .inputs import table
from .registry import NAMESPACE, _el, query


def _save(folder: str):
    def run(batches):
        where, base = storage(folder)
        made = set()
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                full = f"{base}/{path}"
                under = full.rsplit("/", 1)[0]
                if under not in made:
                    os.makedirs(under, exist_ok=True) if where is None else where.create_dir(under, recursive=True)
                    made.add(under)
                with open(full, "wb") if where is None else where.open_output_stream(full) as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    return run


_folders: dict[tuple[str, str], str] = {}


def write_corpus(spark: SparkSession, d: str) -> str:
    """The folder, written once an application: documents where their rows are, a
    thousand folders of them, and the index (one JSON object, as the format asks for) from
    what tasks wrote of it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _folders:
        _folders[key] = _written(spark, d, shared_folder(spark))
    return _folders[key]


def _written(spark: SparkSession, d: str, folder: str) -> str:
    part = spread(table(spark, d, "part"), "p_partkey")
    col = lambda c: f"', {c}, '"
    names = _el("identification", _el("FRBRWork", f'<FRBRuri value="/akn/{col("p_partkey")}/"/>') + _el("FRBRExpression", '<FRBRdate name="Generation" date="2020-01-01"/>'))
    cites = _el("p", f"See {_el('ref', 'section one', ' href="#sec-1"')} and sections 1, 2(3) and 9 of this, which is long enough to keep what follows apart from it; the Lost {col('p_type')} Act 1901 and {col('title')} amend it.")
    one = _el("section", _el("num", "1") + _el("heading", col("p_brand")) + _el("content", cites), ' eId="sec-1"')
    two = _el("section", _el("content", _el("p", f"{_el('term', col('p_type'))} means {_el('def', col('p_name'))}")), ' eId="Schedule-1__sec-2"')
    xml = _el("akomaNtoso", _el("act", _el("meta", names) + _el("body", one + two)), f' xmlns="{NAMESPACE}"')
    rows = part.withColumn("title", F.expr("concat(initcap(p_name), ' Act ', 1900 + p_size)"))
    path = "concat('xml/', p_partkey % 1000, '/p', p_partkey, '.xml')"
    files = rows.where("p_size <= 45").selectExpr(f"{path} path", f"case when p_size < 3 then '<broken>' else concat('{xml}') end text")
    files.mapInArrow(_save(folder), "path string").count()
    entry = F.expr(f"named_struct('name', title, 'year', 1900 + p_size, 'number', p_size, 'effective_date', case when p_size % 2 = 0 then '2021-02-03' else '' end, 'xml_path', {path}, 'title_id', concat('C', p_partkey))")
    slug = F.format_string("p%d", "p_partkey")
    lines = rows.select(slug.alias("slug"), F.to_json(F.create_map(slug, entry)).alias("j")).orderBy("slug").selectExpr("substr(j, 2, length(j) - 2) j")
    versions.write_joined(spark, lines, f"{folder}/index.json", '{"acts":{', "}}")
    return folder


#: Acts that can be read, with the number of the act that a title leads to.
ACTS = """acts AS (SELECT p_partkey k, '/akn/' || p_partkey uri, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || CASE WHEN contains(p_name, ' ') THEN ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) ELSE '' END || ' Act ' || (1900 + p_size) title, p_size, p_brand, p_type, p_name FROM part WHERE p_size BETWEEN 3 AND 45),
own AS (SELECT *, '1' || p_brand || 'See section one and sections 1, 2(3) and 9 of this, which is long enough to keep what follows apart from it; the Lost ' || p_type || ' Act 1901 and ' || title || ' amend it.' AS text FROM acts)"""


def _built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return corpus.build(spark, write_corpus(spark, d))


@query(f"WITH {ACTS} SELECT uri AS frbr_uri, title, 1900 + p_size AS year, CASE WHEN p_size % 2 = 0 THEN '2021-02-03' ELSE '2020-01-01' END AS compilation_date, 'C' || k AS title_id, text || p_type || ' means ' || p_name AS full_text FROM own")
def corpus_acts(spark, d):
    return corpus.read_corpus(spark, write_corpus(spark, d))["acts"].drop("act_pos")


@query("SELECT 'p' || p_partkey AS slug, CASE WHEN p_size > 45 THEN 'missing file' ELSE 'ParseError' END AS error FROM part WHERE p_size > 45 OR p_size < 3")
def corpus_rejects(spark, d):
    return corpus.read_corpus(spark, write_corpus(spark, d))["rejects"].select("slug", F.substring_index("error", ":", 1).alias("error"))


@query(f"""WITH {ACTS} SELECT uri || '#sec-1' AS source_id, kind, ref_text, matched_title, matched_section, target_href, pos AS cite_pos, extraction_confidence FROM (
SELECT uri, 'tagged' kind, 'section one' ref_text, NULL matched_title, NULL matched_section, '#sec-1' target_href, 0 pos, 0.95::DOUBLE extraction_confidence FROM own
UNION ALL SELECT uri, 'prose', unnest(['Lost ' || p_type || ' Act 1901', title]), unnest(['lost ' || lower(p_type) || ' act 1901', lower(title)]), NULL, NULL, unnest([0, 1]), 0.7 FROM own
UNION ALL SELECT uri, 'intra', 'sections 1, 2(3) and 9', NULL, unnest(['1', '2', '9']), NULL, unnest([0, 1, 2]), 0.6 FROM own)""")
def corpus_citations(spark, d):
    t = corpus.read_corpus(spark, write_corpus(spark, d))
    return t["citations"].select("source_id", "kind", "ref_text", "matched_title", "matched_section", "target_href", "cite_pos", "extraction_confidence")


@query(f"WITH {ACTS} SELECT uri AS act_frbr_uri, unnest(['amends', 'amends', 'cites', 'cites', 'cites', 'cites']) AS relation, unnest(['prose', 'prose', 'intra', 'intra', 'intra', 'tagged']) AS kind, unnest([0.85, 0.85, 0.75, 0.75, 0.75, 0.75])::DOUBLE AS relation_confidence FROM own")
def corpus_kinds(spark, d):
    """The union of the three kinds, each with the relation of the words near it."""
    t = corpus.read_corpus(spark, write_corpus(spark, d))
    return t["citations"].select("act_frbr_uri", "relation", "kind", "relation_confidence")


@query(f"""WITH {ACTS} SELECT uri || '#sec-1' AS src, uri || '#sec-1' AS dst, 2::BIGINT AS weight FROM own UNION ALL SELECT uri || '#sec-1', uri || '#Schedule-1__sec-2', 1 FROM own""")
def graph_roundtrip(spark, d):
    """A built graph, saved and loaded again: its edges."""
    folder = shared_folder(spark)
    corpus.save(_built(spark, d), folder)
    return corpus.load(spark, folder)["ref_edges"].select("src", "dst", "weight")


@query(f"WITH {ACTS} SELECT uri AS act_frbr_uri, title, 1::BIGINT AS defined_term_count FROM own")
def sidecar_roundtrip(spark, d):
    """A side table that is missing, then made and read."""
    t, folder = _built(spark, d), shared_folder(spark)
    if corpus.load_sidecar(spark, folder, "complexity") is not None:
        raise RuntimeError("the table can't be there yet")
    rank = t["sections"].select("node_id").withColumn("score", F.lit(0.5))
    corpus.save_sidecar(score.act_complexity(t["acts"], t["sections"], t["terms"], t["ref_edges"], rank), folder, "complexity")
    return corpus.load_sidecar(spark, folder, "complexity").select("act_frbr_uri", "title", "defined_term_count")


@query(f"WITH {ACTS} SELECT uri || '#sec-1' AS src, uri || '#sec-1' AS dst, 2::BIGINT AS weight FROM own UNION ALL SELECT uri || '#sec-1', uri || '#Schedule-1__sec-2', 1 FROM own")
def acts_one_after_another(spark, d):
    """Acts that come in two lots: their links are those of a graph built at once."""
    t = corpus.read_corpus(spark, write_corpus(spark, d), once=True)
    key = {"acts": "frbr_uri", "sections": "act_frbr_uri", "terms": "act_frbr_uri", "citations": "act_frbr_uri"}
    lot = lambda first: {n: t[n].where((F.crc32(F.col(k).cast("binary")) % 2 == 0) == F.lit(first)) for n, k in key.items()}
    return incremental.absorbed(incremental.absorbed(None, lot(False)), lot(True))["ref_edges"].select("src", "dst", "weight")


@query(f"WITH {ACTS} SELECT uri || '#term-' || lower(replace(replace(p_type, ' ', '_'), '-', '_')) AS node_id, p_name AS definition_text FROM own UNION ALL SELECT uri || '#term-lost_' || lower(replace(replace(p_brand, ' ', '_'), '-', '_')), 'of this' FROM own")
def merged_terms(spark, d):
    """New terms put into a graph folder as a version of their own."""
    graph = shared_folder(spark)
    corpus.save(_built(spark, d), f"{graph}/batch-000000000")
    versions.point_to(spark, graph, "batch-000000000")
    old = corpus.load(spark, f"{graph}/batch-000000000")
    new = old["sections"].where("eid = 'sec-1'").select(F.concat(F.lit("Lost "), "heading").alias("display_term"), "act_frbr_uri", F.col("eid").alias("section_eid"), F.lit("of this").alias("definition_text"), "doc_pos")
    if incremental.merged_terms(spark, graph, new, dry_run=True) is not None or versions.latest(spark, graph) != "batch-000000000":
        raise RuntimeError("a dry run changes nothing")
    name = incremental.merged_terms(spark, graph, new)
    return corpus.load(spark, f"{graph}/{name}")["terms"].select("node_id", "definition_text")


@query("""SELECT doc_id, CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' END AS llm_tag, CASE WHEN l.quality IS NOT NULL THEN source END AS llm_reasoning, CASE WHEN l.toxic = 1 THEN 'high' END AS vagueness_tag
FROM documents LEFT JOIN (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY 1) l USING (doc_id)""")
def codifiability_scored(spark, d):
    """Scorer replies attached by request; replies that fail to parse are none."""
    docs = table(spark, d, "documents")
    sections = docs.selectExpr("cast(doc_id as string) node_id", "cast(doc_id as string) eid", "source act_frbr_uri", "text")
    requests = scoring.signal_requests(sections)
    lab = table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("node_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    said = requests.join(lab, "node_id").join(sections.select("node_id", "act_frbr_uri"), "node_id")
    one = F.expr("""concat('```json\n{"tag": "', if(quality = 1, 'high', 'low'), '", "reasoning": "', act_frbr_uri, '"}\n```')""")
    two = F.expr("""if(toxic = 1, '{"tag": "high", "reasoning": ""}', '{"tag": "none of these", "reasoning": ""}')""")
    replies = said.select("custom_id", F.when(F.col("signal") == "signal1", one).otherwise(two).alias("reply"))
    replies = replies.union(spark.createDataFrame([("signal1_nobody", "{}")], "custom_id string, reply string"))
    rows = score.codifiability(sections, spark.createDataFrame([], "act_frbr_uri string, status string"), scoring.signals(requests, replies))
    return rows.select(F.col("eid").cast("bigint").alias("doc_id"), "llm_tag", "llm_reasoning", "vagueness_tag")


@query("""SELECT p_partkey, 'signal2_' || substr(sha256('signal2:' || p_partkey), 1, 16) AS custom_id, 'How?' || chr(10) || 'Reply with JSON: {"tag": "high|medium|low", "reasoning": "..."}' || chr(10) || 'Provision: ' || p_name AS prompt, position(p_brand || '; ' || p_type IN 'Terms: ' || p_brand || '; ' || p_type) > 0 AS listed FROM part""")
def batch_requests(spark, d):
    part = table(spark, d, "part").withColumn("node", F.col("p_partkey").cast("string"))
    r = K.batch_request("signal2", F.col("node"), K.signal_prompt(F.col("p_name"), "How?"))
    asks = K.definition_prompt(F.col("p_name"), F.array("p_brand", "p_type"))
    return part.select("p_partkey", r["custom_id"].alias("custom_id"), r["prompt"].alias("prompt"), asks.contains(F.concat("p_brand", F.lit("; "), "p_type")).alias("listed"))


@query("SELECT '- ' || p_name || ' (' || p_brand || ', ' || n || ' mention(s))' AS line FROM part JOIN (SELECT l_partkey, count(*) n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def rendered_entities(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("count"))
    return render.entities(table(spark, d, "part").join(n, "p_partkey").selectExpr("p_name display_term", "p_brand entity_type", "count"))


@query(f"WITH {inputs.SQL} SELECT '- ' || display_term || ' (' || entity_type || ') in ' || title || ' (' || section_eid || ')' AS line FROM terms JOIN acts ON frbr_uri = act_frbr_uri WHERE entity_type IS NOT NULL AND display_term = (SELECT max(p_type) FROM part)")
def rendered_homonyms(spark, d):
    last = table(spark, d, "part").agg(F.max("p_type").alias("t")).first()["t"]
    return render.homonyms(resolve.find_entity(inputs.terms(spark, d), inputs.acts(spark, d), last))


@query(f"WITH {inputs.SQL} SELECT '- ' || first(display_term ORDER BY act_frbr_uri, doc_pos) || ': ' || count(DISTINCT act_frbr_uri) || ' acts' AS line FROM terms WHERE definition_text <> '' AND length(term) >= 4 GROUP BY term HAVING count(DISTINCT act_frbr_uri) >= 3")
def rendered_multi_act(spark, d):
    return render.multi_act(resolve.multi_act_terms(inputs.terms(spark, d)))


@query("""SELECT '**' || p_name || '** (' || p_brand || ')' || chr(10) || chr(10) || '- LLM codifiability tag: ' || CASE WHEN p_size < 20 THEN 'high (' || p_type || ')' ELSE 'not computed (run with --llm-signals)' END || chr(10) || '- Vagueness tag: not computed (run with --llm-signals)' || chr(10)
|| '- Prescriptive density: ' || p_size || ' matches (7-word), 1 matches (RegData 5-word subset), tag: ' || CASE WHEN p_size >= 5 THEN 'high' WHEN p_size >= 2 THEN 'medium' ELSE 'low' END || chr(10) || '- Agreement: not_computed' || chr(10) || '- Parse verification: checked' AS line FROM part""")
def rendered_codifiability(spark, d):
    rows = table(spark, d, "part").withColumn("llm_tag", F.when(F.col("p_size") < 20, "high")).withColumn("prescriptive_density_tag", K.density_tag(F.col("p_size")))
    return render.codifiability(rows.selectExpr("p_name eid", "p_brand act_frbr_uri", "llm_tag", "p_type llm_reasoning", "cast(null as string) vagueness_tag", "cast(null as string) vagueness_reasoning", "p_size prescriptive_density_count", "1 prescriptive_density_regdata_subset_count", "prescriptive_density_tag", "'not_computed' agreement", "'checked' parse_verification_status"))


@query("""SELECT '**' || source || '** -- ' || n || ' scored provisions' || chr(10) || chr(10) || '- LLM codifiability breakdown: ' || CASE WHEN scored = 0 THEN 'not computed (run with --llm-signals)' ELSE 'low: ' || printf('%.1f', low) || '%, medium: 0.0%, high: ' || printf('%.1f', high) || '%' END || chr(10) || '- Parse verification status: seen' AS line
FROM (SELECT source, count(*) n, count(quality) scored, round_even(count_if(quality = 0) * 100.0 / nullif(count(quality), 0), 1) low, round_even(count_if(quality = 1) * 100.0 / nullif(count(quality), 0), 1) high FROM documents LEFT JOIN (SELECT doc_id, max(quality) quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1)""")
def rendered_act_summary(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = table(spark, d, "documents").join(lab, "doc_id", "left").selectExpr("source act_frbr_uri", "case q when 1 then 'high' when 0 then 'low' end llm_tag", "'seen' parse_verification_status", "cast(doc_id as string) eid")
    return render.act_summary(score.codifiability_summary(rows))


@query("SELECT 'complexity' AS what, p_partkey, CASE WHEN p_size > 25 THEN 'The graph has no complexity table. Make it with the command complexity.' ELSE p_brand || ' has no complexity record.' END AS said FROM part")
def missing_records(spark, d):
    """A lookup without the table, and one that finds no row, are told apart."""
    return table(spark, d, "part").select(F.lit("complexity").alias("what"), "p_partkey", F.when(F.col("p_size") > 25, render.not_available("complexity")).otherwise(F.concat("p_brand", F.lit(" has no complexity record."))).alias("said"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN 'A' ELSE '' END END AS number FROM supplier")
def first_section_numbers(spark, d):
    from ..functions import text as T

    raw = F.expr("case s_suppkey % 3 when 0 then concat('sections ', s_suppkey, 'A(1) and 7') when 1 then concat('s ', s_suppkey) else 'none here' end")
    return table(spark, d, "supplier").select("s_suppkey", T.first_section_number(raw).alias("number"))


@query("SELECT p_partkey, p_size % 5 < 3 AS junk FROM part")
def junk_terms(spark, d):
    term = F.expr("case p_size % 5 when 0 then concat('Does not ', p_name) when 1 then substr(p_name, 1, 3) when 2 then concat('the ', p_name) when 3 then concat('then ', p_name) else concat('of', p_name) end")
    return table(spark, d, "part").select("p_partkey", K.is_junk_term(term).alias("junk"))


@query("SELECT 'region' || r_regionkey AS domain, n_name AS name, n_nationkey AS number FROM nation JOIN region ON r_regionkey = n_regionkey")
def label_rules(spark, d):
    """Rules from JSON files, one for each region, with a rule for each nation."""
    folder = shared_folder(spark)
    rule = F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("number"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(rule).alias("rules"))).alias("j"))
    for r in rows.collect():  # one row a region
        versions.write_text(spark, f"{folder}/region{r.n_regionkey}.json", r.j)
    out = corpus.label_rules(spark, folder)
    return out.select("domain", F.get_json_object("rule", "$.name").alias("name"), F.get_json_object("rule", "$.number").cast("int").alias("number"))
