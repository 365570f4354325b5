"""Lookups: definitions, terms and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T

RESULT = ["display_term", "definition_text", "act_frbr_uri", "section_eid", "act_title"]


def valid_terms(terms: DataFrame) -> DataFrame:
    """Terms with a definition and a section."""
    return terms.where("length(definition_text) > 0 and length(section_eid) > 0")


def with_title(rows: DataFrame, acts: DataFrame) -> DataFrame:
    """rows with act_title: the act's, or its address where it is unknown."""
    titles = acts.select("frbr_uri", "title").dropDuplicates(["frbr_uri"])
    return rows.join(titles, F.col("act_frbr_uri") == F.col("frbr_uri"), "left").withColumn("act_title", F.coalesce("title", "act_frbr_uri")).drop("frbr_uri", "title")


def resolve_definitions(requests: DataFrame, terms: DataFrame, acts: DataFrame) -> DataFrame:
    """One definition for each request (term, act_frbr_uri, section_eid) that has one.

    A single candidate, or the first of several if the request has no section; else
    the candidate of that very section, else the one of the longest enclosing part,
    else none. All requests are answered by one join and one window per request, which
    holds the few definitions of a term within an act."""
    asked = requests.select(F.monotonically_increasing_id().alias("_r"), F.col("term").alias("asked"), "act_frbr_uri", F.col("section_eid").alias("_at"), F.lower(F.trim("term")).alias("term"))
    cand = valid_terms(terms).select("term", "act_frbr_uri", "display_term", "definition_text", "section_eid", "doc_pos")
    part, own = T.enclosing_part(F.col("section_eid")), T.enclosing_part(F.col("_at"))
    encloses = (part != "") & ((own == part) | own.startswith(F.concat(part, F.lit("__"))))
    rows = asked.join(cand, ["term", "act_frbr_uri"]).withColumn("_exact", F.coalesce(F.col("section_eid") == F.col("_at"), F.lit(False)))
    rows = rows.withColumn("_depth", F.when(encloses, F.length(part)).otherwise(0))
    n = F.count("*").over(Window.partitionBy("_r"))
    free = F.col("_at").isNull()
    order = [F.when(free, 0).otherwise(-F.col("_exact").cast("int")), F.when(free | F.col("_exact"), 0).otherwise(-F.col("_depth")), F.col("doc_pos")]
    rows = rows.withColumn("_n", n).withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy(*order)))
    rows = rows.where("_k = 1 and (_n = 1 or _at is null or _exact or _depth > 0)")
    return with_title(rows, acts).select(F.col("asked").alias("term"), F.col("_at").alias("asked_section"), *RESULT)


def resolve_definition(terms: DataFrame, acts: DataFrame, term: str, act: str, section_eid: str | None = None) -> DataFrame:
    one = terms.sparkSession.createDataFrame([(term, act, section_eid)], "term string, act_frbr_uri string, section_eid string")
    return resolve_definitions(one, terms.where(F.col("act_frbr_uri") == act), acts)


def find_all_definitions(terms: DataFrame, acts: DataFrame, term: str) -> DataFrame:
    rows = valid_terms(terms).where(F.col("term") == F.lower(F.trim(F.lit(term))))
    return with_title(rows, acts).select("term", *RESULT).orderBy("act_frbr_uri", "section_eid")


def act_terms(terms: DataFrame, act: str) -> DataFrame:
    return terms.where(F.col("act_frbr_uri") == act).select("term", "display_term", "section_eid", "definition_text", "entity_type", "doc_pos").orderBy("term", "doc_pos")


def find_entity(terms: DataFrame, acts: DataFrame, display_term: str) -> DataFrame:
    rows = terms.where(F.col("entity_type").isNotNull() & (F.col("display_term") == display_term))
    return with_title(rows, acts).select("node_id", "display_term", "entity_type", "act_frbr_uri", "section_eid", "act_title")


def multi_act_terms(terms: DataFrame, min_acts: int = 3) -> DataFrame:
    """(term, display_term, act_count) of terms that several acts define; display_term
    of the first seen, fragments and terms under four characters left out. Distinct
    acts are found by a grouping on (term, act), so a term that most acts share is
    counted in many tasks."""
    rows = valid_terms(terms).where(~K.is_junk_term(F.col("term")))
    by_act = rows.groupBy("term", "act_frbr_uri").agg(F.min(F.struct("act_frbr_uri", "doc_pos", "display_term")).alias("f"))
    out = by_act.groupBy("term").agg(F.min("f").alias("f"), F.count("*").alias("act_count")).where(F.col("act_count") >= min_acts)
    return out.select("term", F.col("f.display_term").alias("display_term"), "act_count").orderBy(F.desc("act_count"), "term")


def counts(acts: DataFrame, terms: DataFrame) -> DataFrame:
    """(acts, valid_terms)."""
    rows = acts.select(F.lit(1).alias("a"), F.lit(0).alias("t")).union(valid_terms(terms).select(F.lit(0), F.lit(1)))
    return rows.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("acts"), F.coalesce(F.sum("t"), F.lit(0)).alias("valid_terms"))


def act_title(acts: DataFrame, act: str) -> DataFrame:
    return acts.where(F.col("frbr_uri") == act).select("title")


def collisions(terms: DataFrame) -> DataFrame:
    """(act_frbr_uri, term, n) of terms that an act defines more than once."""
    return terms.groupBy("act_frbr_uri", "term").agg(F.count("*").alias("n")).where("n > 1")


def added_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """terms with new ones put in: entity types found, occurrence 1; a term whose act
    and slug exist replaces that first occurrence."""
    rows = new.withColumn("term", F.lower("display_term")).withColumn("entity_type", K.entity_type(F.col("display_term"))).withColumn("occurrence", F.lit(1))
    rows = rows.withColumn("node_id", K.term_node(F.col("act_frbr_uri"), F.col("term"), F.col("occurrence"))).select(*terms.columns)
    return terms.join(rows.select("node_id"), "node_id", "left_anti").select(*terms.columns).unionByName(rows)


def verified_definitions(replies: DataFrame) -> DataFrame:
    """Items of JSON replies (section_text, reply and what else the rows carry) whose
    definition stands word for word in the section. A fence around a reply is taken off;
    a reply that is no JSON list gives nothing, and of a list items that are no object or
    whose term or definition is no string are skipped."""
    items = F.try_variant_get(F.try_parse_json(K.unfenced(F.col("reply"))), "$", "array<variant>")
    rows = replies.select("*", F.explode(items).alias("_i")).drop("reply")
    rows = rows.select("*", K.variant_string(F.col("_i"), "term").alias("term"), K.variant_string(F.col("_i"), "definition_text").alias("definition_text")).drop("_i")
    return rows.where((F.length("term") > 0) & (F.length("definition_text") > 0) & F.col("section_text").contains(F.col("definition_text")))


def first_definitions(rows: DataFrame, *order: str) -> DataFrame:
    """Of each (node_id, lower term) the first by the given columns."""
    w = Window.partitionBy("node_id", F.lower("term")).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def term_batches(candidates: DataFrame, size: int = 15) -> DataFrame:
    """Candidate terms of each section in batches: (node_id, batch, terms)."""
    k = F.row_number().over(Window.partitionBy("node_id").orderBy("pos")) - 1
    return candidates.withColumn("batch", F.floor(k / size).cast("int")).groupBy("node_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
