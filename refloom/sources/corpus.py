"""Corpus folders in, tables out; graph folders in and out.

A corpus folder has index.json, whose acts map names each act's file, and the files.
A graph folder has one Parquet table each and _meta.json with the format's version.
"""

from __future__ import annotations

import codecs
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from ..operators import link
from ..operators.keep import kept, spread
from . import versions
from .files import map_entries, storage
from .xmlflat import flat_files

FORMAT = 1
TABLES = ("acts", "sections", "terms", "citations", "resolved", "ref_edges", "mentions")
SIDECARS = ("centrality", "complexity", "codifiability")
ENTRY = "name string, year int, number int, effective_date string, xml_path string, title_id string"
INDEX_ROWS = 5000
TAGGED, PROSE, INTRA = 0.95, 0.7, 0.6


def _entries(folder: str):
    """Tasks' function: (act_pos, slug, entry) of the index; act_pos -1 and the reason
    where it can't be read."""
    schema = pa.schema([("act_pos", pa.int32()), ("slug", pa.string()), ("entry", pa.string())])

    def run(batches):
        where, base = storage(folder)
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            with open(f"{base}/index.json", "rb") if where is None else where.open_input_stream(f"{base}/index.json") as f:
                try:
                    for pos, (slug, entry) in enumerate(map_entries(codecs.getreader("utf-8-sig")(f), "acts")):
                        rows.append({"act_pos": pos, "slug": slug, "entry": entry})
                        if len(rows) == INDEX_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except ValueError as e:
                    rows.append({"act_pos": -1, "slug": None, "entry": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def corpus_index(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, name, year, effective_date, title_id, path, act_pos) in the order of the
    index. ValueError if it has no acts map, FileNotFoundError if there is none.

    The index is one JSON object, however many acts it has: one task passes over it, holds
    an entry at a time and writes entries as rows; what follows reads them in many."""
    if not versions.exists(spark, f"{folder}/index.json"):
        raise FileNotFoundError(f"{folder}/index.json")
    raw = kept(spark.range(0, 1, 1, 1).mapInArrow(_entries(folder), "act_pos int, slug string, entry string"))
    if not raw.where("act_pos < 0").isEmpty():
        raise ValueError("index.json has no acts")
    rows = spread(raw, "act_pos").select("act_pos", "slug", F.from_json("entry", ENTRY).alias("v")).select("act_pos", "slug", "v.*")
    return rows.select("slug", "name", "year", "effective_date", "title_id", F.col("xml_path").alias("path"), "act_pos")


def read_corpus(spark: SparkSession, folder: str, once: bool = False) -> dict[str, DataFrame]:
    """The tables of a corpus folder, and rejects (slug, path, error): missing files
    and documents that can't be read, which are left out of the tables. An entry's xml_path
    is relative to the folder. once: documents are flattened once and kept in the shared
    folder, for those who use several tables."""
    rows = flat_files(corpus_index(spark, folder), folder)
    rows = kept(rows) if once else rows
    rejects = rows.where("error is not null").select("slug", "path", "error")
    return tables(rows.where("error is null")) | {"rejects": rejects}


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """acts, sections, terms, citations and candidates of flattened documents."""
    acts = rows.select("frbr_uri", F.col("name").alias("title"), "year", F.coalesce(F.nullif(F.col("effective_date"), F.lit("")), F.col("expr_date")).alias("compilation_date"), "title_id", "act_pos", "full_text")
    own = rows.select(F.col("frbr_uri").alias("act_frbr_uri"), "act_pos", F.explode("sections").alias("s")).select("act_frbr_uri", "act_pos", "s.*")
    pos = (F.col("act_pos").cast("bigint") * (1 << 32) + F.col("doc_pos")).alias("doc_pos")
    node = K.section_node(F.col("act_frbr_uri"), F.col("eid"))
    sections = own.select(node.alias("node_id"), "eid", "act_frbr_uri", "heading", "text", "prose_text", T.provision_type(F.col("eid")).alias("provision_type"), pos, "refs")
    raw = rows.select(F.col("frbr_uri").alias("act_frbr_uri"), "act_pos", F.explode("terms").alias("t")).select("act_frbr_uri", "act_pos", "t.*")
    terms = link.numbered_terms(raw.withColumn("doc_pos", pos).withColumn("entity_type", K.entity_type(F.col("display_term"))).drop("act_pos"))
    cand = rows.select(F.col("frbr_uri").alias("act_frbr_uri"), "full_text", "act_pos", F.explode("candidates").alias("c")).select("act_frbr_uri", "full_text", "act_pos", "c.*")
    term = T.untagged_term(F.col("text"))
    cand = cand.select("act_frbr_uri", "section_eid", pos, term.alias("term"), "full_text").where("term is not null")
    candidates = cand.where(T.recurrences(F.col("full_text"), F.col("term")) > 2).drop("full_text")
    return {"acts": acts, "sections": sections.drop("refs"), "terms": terms, "citations": citations(sections), "candidates": candidates}


def citations(sections: DataFrame) -> DataFrame:
    """Tagged, prose and intra-act citations of sections (with refs: href, ref_text)."""
    kinds = F.create_map(*[F.lit(x) for pair in (("tagged", TAGGED), ("prose", PROSE), ("intra", INTRA)) for x in pair])

    def found(kind: str, texts, href=lambda c: F.lit(None).cast("string"), raw=lambda c: c):
        return F.transform(F.coalesce(texts, F.array()), lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), raw(c).alias("raw"), href(c).alias("href")))

    # one pass over the sections: a union of kinds would flatten every document for each
    every = F.concat(found("tagged", F.col("refs"), lambda c: c["href"], lambda c: c["ref_text"]), found("prose", T.prose_citations(F.col("prose_text"))), found("intra", T.number_lists(F.col("prose_text"))))
    raw, kind, pos = F.col("raw"), F.col("kind"), F.col("pos").cast("bigint")
    rows = sections.select("node_id", "act_frbr_uri", "text", F.explode(every).alias("c")).select("node_id", "act_frbr_uri", "text", "c.*")
    rows = rows.withColumn("title", F.when(kind == "prose", T.normalized_title(raw)["title"])).where((kind != "prose") | F.col("title").isNotNull())
    rows = rows.withColumn("r", K.settled(K.relation(raw, F.col("text")))).drop("text")
    numbers = F.when(kind == "intra", T.section_numbers(raw)).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("*", F.posexplode(numbers).alias("k", "number"))
    return rows.select(
        F.col("node_id").alias("source_id"), "act_frbr_uri", "kind", raw.alias("ref_text"), F.when(kind == "tagged", ~F.col("href").startswith("#")).otherwise(kind == "prose").alias("is_cross_act"), F.col("href").alias("target_href"), F.col("title").alias("matched_title"), F.col("number").alias("matched_section"),
        F.col("r.relation").alias("relation"), F.col("r.confidence").alias("relation_confidence"), kinds[kind].alias("extraction_confidence"), F.when(kind == "intra", pos * (1 << 32) + F.col("k")).otherwise(pos).alias("cite_pos"),
    )


def build(spark: SparkSession, folder: str, normalize_index: bool = False) -> dict[str, DataFrame]:
    """All tables of a corpus folder, resolved and collapsed."""
    t = read_corpus(spark, folder, once=True)
    t["resolved"] = kept(link.resolve_citations(t["citations"], t["acts"], t["sections"], t["terms"], normalize_index))
    t["citations"] = t["resolved"].select(*t["citations"].columns)  # the same rows, found once
    t["ref_edges"] = link.ref_edges(t["resolved"])
    t["mentions"] = link.mentions(t["sections"], t["terms"])
    return t


def save(t: dict[str, DataFrame], folder: str) -> None:
    """Writes a graph folder; its marker last, so that a broken-off write is no graph."""
    for name in TABLES:
        t[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = t["acts"].sparkSession
    spark.createDataFrame([(json.dumps({"format": FORMAT, "multigraph": True}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_meta")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A graph folder's tables. FileNotFoundError without one, ValueError for another
    format."""
    if not versions.exists(spark, f"{folder}/_meta"):
        raise FileNotFoundError(folder)
    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/_meta").collect()))
    if not meta.get("multigraph") or meta.get("format") != FORMAT:
        raise ValueError("The graph is of another format. Rebuild it.")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def save_sidecar(df: DataFrame, folder: str, name: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def load_sidecar(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The derived table, or None where it hasn't been made."""
    path = f"{folder}/{name}"
    if not versions.exists(spark, path):
        return None
    return spark.read.parquet(path)


def node_link(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) as JSON strings of a node-link document, one a row."""
    nodes = t["acts"].select(F.to_json(F.struct(F.col("frbr_uri").alias("id"), F.lit("act").alias("type"), "title", "year", "compilation_date", "title_id")).alias("value"))
    nodes = nodes.union(t["sections"].select(F.to_json(F.struct(F.col("node_id").alias("id"), F.lit("section").alias("type"), "eid", "act_frbr_uri", "heading", "text", "provision_type"))))
    nodes = nodes.union(t["terms"].select(F.to_json(F.struct(F.col("node_id").alias("id"), F.lit("defined_term").alias("type"), "term", "display_term", "act_frbr_uri", "section_eid", "definition_text", "occurrence", "entity_type"))))
    pair = lambda df, kind, *more: df.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(kind).alias("key"), F.lit(kind).alias("type"), *more)).alias("value"))
    links = pair(t["ref_edges"], "ref", "is_cross_act", "weight", "ref_texts", "citations").union(pair(t["mentions"], "mentions", "count"))
    return nodes, links.union(pair(link.contains(t["sections"]), "contains")).union(pair(link.defines(t["terms"], t["sections"]), "defines"))


def label_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON files {"rules": [...]}: (domain, rule as JSON)."""
    rows = spark.read.option("multiLine", True).schema("rules array<string>").json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.select(stem.alias("domain"), F.explode("rules").alias("rule"))
