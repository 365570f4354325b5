"""New acts on a running graph: a stream of flattened documents, taken in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import link, resolve
from ..sources import corpus, versions
from ..sources.xmlflat import flat_documents

INPUT = ("acts", "sections", "terms", "citations")


def absorbed(old: dict[str, DataFrame] | None, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the acts of new put in or replaced, and links made afresh:
    citations that waited for one of these acts now find it. The result doesn't depend
    on the order in which acts come."""
    t = {name: new[name] for name in INPUT}
    if old:
        acts = new["acts"].select("frbr_uri").distinct()
        own = acts.withColumnRenamed("frbr_uri", "act_frbr_uri")
        for name in INPUT:
            gone = acts if name == "acts" else own
            t[name] = old[name].join(gone, gone.columns[0], "left_anti").unionByName(new[name])
    t["resolved"] = link.resolve_citations(t["citations"], t["acts"], t["sections"], t["terms"])
    t["ref_edges"] = link.ref_edges(t["resolved"])
    fresh = link.mentions(new["sections"], new["terms"])
    t["mentions"] = link.rebuilt(old["mentions"], fresh, new["sections"], new["acts"]) if old else fresh
    return t


def watch(spark: SparkSession, landing: str, graph: str, checkpoint: str, index: DataFrame) -> StreamingQuery:
    """Takes documents that land in a folder into the graph folder `graph`, in a new
    version for each batch of files; `latest` in it names the one to read. index: (path
    end `file`, name, year, effective_date, title_id, act_pos)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xml").load(landing)

    def take(batch: DataFrame, number: int) -> None:
        rows = flat_documents(batch.select("path", "content")).where("error is null").withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path")
        new = corpus.tables(rows.join(index, "file"))
        name = versions.latest(spark, graph)
        target = f"batch-{number:09d}"
        if name == target:  # taken before the stream could note it
            return
        old = corpus.load(spark, f"{graph}/{name}") if name else None
        corpus.save(absorbed(old, new), f"{graph}/{target}")
        versions.point_to(spark, graph, target)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, graph: str) -> str | None:
    return versions.latest(spark, graph)


def merged_terms(spark: SparkSession, graph: str, new: DataFrame, dry_run: bool = False) -> str | None:
    """New terms (display_term, act_frbr_uri, section_eid, definition_text, doc_pos) put
    into the graph as a version of their own; the one before stays as the backup. Only
    the acts of the new terms have their mentions made afresh. Returns the version's name,
    or None for a dry run, which only checks that the graph can be read."""
    old = corpus.load(spark, f"{graph}/{versions.latest(spark, graph)}")
    if dry_run:
        return None
    terms = resolve.added_terms(old["terms"], new)
    acts = new.select(F.col("act_frbr_uri").alias("frbr_uri")).distinct()
    t = old | {"terms": terms, "mentions": link.rebuilt(old["mentions"], link.mentions(old["sections"], terms, acts), old["sections"], acts)}
    name = versions.next_version(spark, graph)
    corpus.save(t, f"{graph}/{name}")
    versions.point_to(spark, graph, name)
    return name
