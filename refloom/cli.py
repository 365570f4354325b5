"""Commands on corpus and graph folders: python -m refloom.cli COMMAND --help.

A graph folder holds versions and the pointer `latest`; side tables lie in the version
that they were made from. Scores come from a table of replies (custom_id, reply) in a
folder; nothing here calls a network.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import link, resolve, score, scoring
from .operators.answers import Answers
from .sources import corpus, versions
from .streaming import incremental


def _version(spark: SparkSession, folder: str) -> str:
    name = versions.latest(spark, folder)
    if name is None:
        raise FileNotFoundError(f"{folder} holds no graph; build one first")
    return f"{folder}/{name}"


def build(spark: SparkSession, folder: str, graph: str) -> None:
    t = corpus.build(spark, folder)
    name = versions.next_version(spark, graph)
    corpus.save(t, f"{graph}/{name}")
    versions.point_to(spark, graph, name)
    kept = corpus.load(spark, f"{graph}/{name}")
    corpus.save_sidecar(link.candidate_sources(kept["resolved"]), f"{graph}/{name}", "candidates")
    print(f"Version {name}: {kept['acts'].count()} acts, {t['rejects'].count()} rejected")
    for r in link.citation_stats(kept["resolved"]).orderBy("bucket").collect():
        print(f"{r.bucket}: {r.total} citations, {r.self_citation_filtered} of the act itself, {r.resolved} resolved, {r.unresolved} unresolved")
    for r in link.low_confidence_sample(kept["citations"], 10).collect():
        print(f"look at: {r.ref_text}")


def stats(spark: SparkSession, graph: str) -> None:
    t = corpus.load(spark, _version(spark, graph))
    edges = link.all_edges(t["sections"], t["terms"], t["ref_edges"], t["mentions"])
    out: dict = {}
    for r in link.graph_stats(t["acts"], t["sections"], t["terms"], edges).collect():
        out.setdefault(r.what, {})[r.type] = r.n
    print(json.dumps(out, indent=2, sort_keys=True))


def centrality(spark: SparkSession, graph: str) -> None:
    at = _version(spark, graph)
    corpus.save_sidecar(G.pagerank(link.edge_weights(corpus.load(spark, at)["resolved"])), at, "centrality")


def complexity(spark: SparkSession, graph: str) -> None:
    at = _version(spark, graph)
    rank = corpus.load_sidecar(spark, at, "centrality")
    if rank is None:
        raise FileNotFoundError("complexity needs centrality; make it first")
    t = corpus.load(spark, at)
    corpus.save_sidecar(score.act_complexity(t["acts"], t["sections"], t["terms"], t["ref_edges"], rank), at, "complexity")


def codifiability(spark: SparkSession, graph: str, verification: str | None = None, replies: str | None = None) -> None:
    at = _version(spark, graph)
    sections = corpus.load(spark, at)["sections"]
    checked = spark.read.json(verification, schema="act_frbr_uri string, status string") if verification else spark.createDataFrame([], "act_frbr_uri string, status string")
    scores = scoring.signals(scoring.signal_requests(sections), spark.read.json(replies, schema="custom_id string, reply string")) if replies else None
    corpus.save_sidecar(score.codifiability(sections, checked, scores), at, "codifiability")


def extract_untagged(spark: SparkSession, graph: str, replies: str, dry_run: bool = False) -> None:
    """replies: JSON lines (act_frbr_uri, section_eid, chunk, batch, reply)."""
    t = corpus.load(spark, _version(spark, graph))
    said = spark.read.json(replies, schema="act_frbr_uri string, section_eid string, chunk int, batch int, reply string")
    texts = t["sections"].select("node_id", "act_frbr_uri", F.col("eid").alias("section_eid"), F.col("text").alias("section_text"), "doc_pos").dropDuplicates(["node_id"])
    rows = resolve.verified_definitions(said.join(texts, ["act_frbr_uri", "section_eid"]))
    found = resolve.first_definitions(rows, "chunk", "batch", "term")
    lines = [f"{r.term} ({r.section_eid})" for r in found.select("term", "section_eid").orderBy("section_eid", "term").collect()]
    print(f"{len(lines)} definitions stand word for word in their sections", *lines, sep="\n- ")
    new = found.select(F.col("term").alias("display_term"), "act_frbr_uri", "section_eid", "definition_text", "doc_pos")
    name = incremental.merged_terms(spark, graph, new, dry_run)
    print(f"Version {name}" if name else "Dry run: the graph is as it was")


def answers(spark: SparkSession, graph: str) -> Answers:
    at = _version(spark, graph)
    side: dict[str, DataFrame | None] = {n: corpus.load_sidecar(spark, at, n) for n in corpus.SIDECARS}
    return Answers(corpus.load(spark, at), **side)


LOOKUPS = {
    "resolve": ("resolve_definition", "term", "act", "?section"), "definitions": ("find_all_definitions", "term"), "terms": ("act_terms", "act"), "references": ("cross_references", "eid", "act"),
    "impact": ("impact", "eid", "act", "?max_hops"), "entities": ("entities", "eid", "act"), "find-entity": ("find_entity", "term"), "multi-act": ("multi_act_terms", "?min_acts"),
    "complexity-of": ("complexity_of", "act"), "codifiability-of": ("codifiability_of", "eid", "act"), "codifiability-summary": ("codifiability_summary", "act"),
}
JOBS = {"build": (build, "corpus", "graph"), "stats": (stats, "graph"), "centrality": (centrality, "graph"), "complexity": (complexity, "graph"), "codifiability": (codifiability, "graph", "?verification", "?replies"), "extract-untagged": (extract_untagged, "graph", "replies", "?!dry_run")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="refloom", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, *fields) in {**JOBS, **{k: (v[0], "graph", *v[1:]) for k, v in LOOKUPS.items()}}.items():
        c = sub.add_parser(name)
        for f in fields:
            flag = "--" + f.strip("?!").replace("_", "-")
            if "!" in f:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, required=not f.startswith("?"), type=int if f.strip("?") in ("max_hops", "min_acts") else str)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = vars(parser().parse_args(args))
    spark = spark or SparkSession.builder.appName("refloom").getOrCreate()
    command = a.pop("command")
    given = [v for v in a.values() if v is not None]
    try:
        if command in JOBS:
            JOBS[command][0](spark, *a.values())
        else:
            print(getattr(answers(spark, given[0]), LOOKUPS[command][0])(*given[1:]))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
