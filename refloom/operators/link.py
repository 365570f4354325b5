"""Citations to edges: resolution, collapse, ledgers and mentions.

Tables (DataFrames; extra columns are ignored):

acts       frbr_uri, title, year, compilation_date, title_id, act_pos
sections   node_id, eid, act_frbr_uri, heading, text, prose_text, provision_type, doc_pos
terms      node_id, term, display_term, act_frbr_uri, section_eid, definition_text,
           occurrence, entity_type, doc_pos
citations  source_id, act_frbr_uri, kind, ref_text, is_cross_act, target_href,
           matched_title, matched_section, relation, relation_confidence,
           extraction_confidence, cite_pos

Order is data: act_pos, doc_pos and cite_pos decide first and last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from .keep import spread, tasks_of

#: Sections of one task that looks for mentions.
SECTIONS = 100_000


def _title_key(normalize_index: bool) -> Column:
    """An act's title in lower case, or in the citations' own normal form."""
    return T.normalized_title(F.col("title"))["title"] if normalize_index else F.lower("title")


def bucket(matched_title: Column) -> Column:
    return F.when(F.length(F.coalesce(matched_title, F.lit(""))) > 0, "untagged").otherwise("tagged")


def _targets(acts: DataFrame, sections: DataFrame, terms: DataFrame, normalize_index: bool) -> DataFrame:
    """(_how, _k1, _k2, _target): what addresses (0), an act's section numbers (1) and
    titles (2) lead to, each once: of equal numbers the last in the document, of equal
    titles the last loaded. One grouping for all, whose keys are those of the join."""
    none, one = F.lit(""), F.lit(0).cast("bigint")
    ids = acts.select(F.col("frbr_uri").alias("id")).union(sections.select("node_id")).union(terms.select("node_id"))
    rows = ids.select(F.lit(0).alias("_how"), F.col("id").alias("_k1"), none.alias("_k2"), F.col("id").alias("t"), one.alias("p"))
    rows = rows.union(sections.select(F.lit(1), "act_frbr_uri", T.section_number_of(F.col("eid")).alias("n"), "node_id", F.col("doc_pos").cast("bigint")).where("n is not null"))
    rows = rows.union(acts.select(F.lit(2), _title_key(normalize_index).alias("k"), none, "frbr_uri", F.col("act_pos").cast("bigint")).where("k is not null"))
    return rows.groupBy("_how", "_k1", "_k2").agg(F.max_by("t", "p").alias("_target"))


def resolve_citations(citations: DataFrame, acts: DataFrame, sections: DataFrame, terms: DataFrame, normalize_index: bool = False, title_parts: int = 1) -> DataFrame:
    """citations with target (null if there is none), norm_title, bucket and status:
    resolved, unresolved, self, dropped (no normal form) by title; linked or missing
    by address or number, which statistics leave out.

    Addresses that begin with # or /akn/ must name an existing act, section or term.
    A citation is looked up in one way only, so all ways are one table of keys and one
    equi-join; before it, a join by act tells citations of the own title. Citations are
    moved twice, with the columns that are asked for; which side is broadcast is left to
    the planner, which knows the sizes. A title that a large share of all citations names
    is split by Spark's own handling of skewed joins (citations are the outer side, which
    may be split); title_parts deals each title to so many tasks where that is switched
    off, at the price of as many copies of the titles."""
    href = F.coalesce("target_href", F.lit(""))
    number, norm = F.col("matched_section"), F.col("norm_title")
    address = F.when(href.startswith("#"), F.concat("act_frbr_uri", href)).when(href.startswith("/akn/au"), href)
    title = T.normalized_title(F.coalesce(F.when(F.length("matched_title") > 0, F.col("matched_title")), F.col("ref_text")))["title"]
    how = F.when(address.isNotNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    rows = citations.select("*", how.alias("_how"), F.when(address.isNull() & number.isNull(), title).alias("norm_title"), bucket(F.col("matched_title")).alias("bucket"))
    # titles without a normal form, which may be many, don't meet in one task: they get one of many values that nothing has
    lost = F.concat(F.lit("\x01"), F.pmod(F.xxhash64("source_id", "cite_pos"), F.lit(4096)).cast("string"))
    k1 = F.when(F.col("_how") == 0, address).when(F.col("_how") == 1, F.col("act_frbr_uri")).otherwise(F.coalesce(norm, lost))
    own = acts.select(F.col("frbr_uri").alias("act_frbr_uri"), T.normalized_title(F.col("title"))["title"].alias("_own")).dropDuplicates(["act_frbr_uri"])
    rows = rows.withColumns({"_k1": k1, "_k2": F.when(F.col("_how") == 1, number).otherwise("")}).join(own, "act_frbr_uri", "left")
    known = F.when(F.col("_how") < 2, "direct").when(norm.isNull(), "dropped").when(norm.eqNullSafe(F.col("_own")), "self")
    rows = rows.withColumn("_known", known).drop("_own")
    targets, keys = _targets(acts, sections, terms, normalize_index), ["_how", "_k1", "_k2"]
    if title_parts > 1:
        deal = F.when(F.col("_how") == 2, F.lit(title_parts)).otherwise(1)
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("source_id", "cite_pos"), deal).cast("int"))
        targets = targets.withColumn("_part", F.explode(F.sequence(F.lit(0), deal - 1)))
        keys = [*keys, "_part"]
    found = F.col("_target").isNotNull()
    status = F.when(F.col("_known") == "direct", F.when(found, "linked").otherwise("missing")).when(F.col("_known").isNotNull(), F.col("_known")).when(found, "resolved").otherwise("unresolved")
    out = rows.join(targets, keys, "left").withColumn("status", status)
    target = F.when(F.col("status").isin("linked", "resolved"), F.col("_target"))
    return out.withColumn("target", target).select(*citations.columns, "norm_title", "bucket", "status", "target")


def ref_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each (src, dst): its citations in order, their number as weight,
    and is_cross_act of the first. Kinds come tagged, prose, intra within a section. An
    edge's list is no longer than its source section's citations; what needs no lists
    uses edge_weights."""
    kind = F.when(F.col("kind") == "tagged", 0).when(F.col("kind") == "prose", 1).otherwise(2)
    row = F.struct(kind.alias("k"), F.col("cite_pos"), "ref_text", "relation", "relation_confidence", "extraction_confidence", "is_cross_act")
    edges = resolved.where("target is not null").groupBy(F.col("source_id").alias("src"), F.col("target").alias("dst")).agg(F.array_sort(F.collect_list(row)).alias("c"))
    fields = F.transform("c", lambda x: F.struct(x["ref_text"].alias("ref_text"), x["relation"].alias("relation"), x["relation_confidence"].alias("relation_confidence"), x["extraction_confidence"].alias("extraction_confidence")))
    return edges.select("src", "dst", F.element_at("c", 1)["is_cross_act"].alias("is_cross_act"), F.size("c").cast("bigint").alias("weight"), F.transform("c", lambda x: x["ref_text"]).alias("ref_texts"), fields.alias("citations"))


def edge_weights(resolved: DataFrame) -> DataFrame:
    """(src, dst, weight) alone: a plain count, which map tasks combine. What ranking
    and counting need of edges that a third of all citations may share."""
    return resolved.where("target is not null").groupBy(F.col("source_id").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("weight"))


def candidates(resolved: DataFrame) -> DataFrame:
    """Ledger of titles that no act has: (title, year, mention_count), most first."""
    rows = resolved.where("status = 'unresolved'")
    return rows.groupBy(F.col("norm_title").alias("title")).agg(F.substring_index(F.first("norm_title"), " ", -1).cast("int").alias("year"), F.count("*").alias("mention_count")).orderBy(F.desc("mention_count"), "title")


def candidate_sources(resolved: DataFrame) -> DataFrame:
    """(title, act_frbr_uri, n): the ledger's cited_by in rows."""
    return resolved.where("status = 'unresolved'").groupBy(F.col("norm_title").alias("title"), "act_frbr_uri").agg(F.count("*").alias("n"))


def candidate_report(resolved: DataFrame) -> DataFrame:
    """The ledger with cited_by as a map from act to mentions, for a reader: a map has at
    most an entry for each act. In rows it is candidate_sources."""
    by = candidate_sources(resolved).groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("act_frbr_uri", "n"))).alias("cited_by"))
    return candidates(resolved).join(by, "title").orderBy(F.desc("mention_count"), "title")


def citation_stats(resolved: DataFrame) -> DataFrame:
    """total, self_citation_filtered, resolved and unresolved of each bucket."""
    s = F.col("status")
    return resolved.where(s.isin("resolved", "unresolved", "self")).groupBy("bucket").agg(
        F.count_if(s != "self").alias("total"), F.count_if(s == "self").alias("self_citation_filtered"),
        F.count_if(s == "resolved").alias("resolved"), F.count_if(s == "unresolved").alias("unresolved"),
    )


def numbered_terms(terms: DataFrame) -> DataFrame:
    """terms with occurrence (by act and slug, in document order) and node_id."""
    w = Window.partitionBy("act_frbr_uri", K.slug(F.col("term"))).orderBy("doc_pos")
    rows = terms.withColumn("occurrence", F.row_number().over(w))
    return rows.withColumn("node_id", K.term_node(F.col("act_frbr_uri"), F.col("term"), F.col("occurrence")))


def contains(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("act_frbr_uri").alias("src"), F.col("node_id").alias("dst"))


def defines(terms: DataFrame, sections: DataFrame) -> DataFrame:
    """(src, dst): section to term, where the section exists."""
    src = K.section_node(F.col("act_frbr_uri"), F.col("section_eid"))
    return terms.select(src.alias("src"), F.col("node_id").alias("dst")).join(sections.select(F.col("node_id").alias("src")), "src", "left_semi")


def mentions(sections: DataFrame, terms: DataFrame, acts: DataFrame | None = None) -> DataFrame:
    """(src, dst, count): how often a section's text names an entity of its own act,
    case and all, longest name first, not inside a hyphened word. Of a section id that
    occurs twice the last text with a mention counts; of a name that several terms have
    the last term is meant. acts restricts the work to some acts (a rebuild)."""
    names = terms.where("entity_type is not null and display_term <> ''").select("act_frbr_uri", "display_term", "node_id", "doc_pos")
    rows = sections.select("act_frbr_uri", F.col("node_id").alias("src"), "doc_pos", "text")
    if acts is not None:
        names = names.join(acts.select(F.col("frbr_uri").alias("act_frbr_uri")).distinct(), "act_frbr_uri", "left_semi")
    rows = spread(rows, "act_frbr_uri", rows=SECTIONS, least=SECTIONS // 20)
    names = names.repartition(tasks_of(rows), "act_frbr_uri")  # from here on all stays with its act
    own = names.groupBy("act_frbr_uri", "display_term").agg(F.max_by("node_id", "doc_pos").alias("dst"))
    longest = F.array_sort(F.collect_list(F.struct((-F.length("display_term")).alias("n"), F.col("display_term").alias("t"), "dst")))
    own = own.groupBy("act_frbr_uri").agg(longest.alias("names"))
    quoted = F.transform("names", lambda x: T.quoted_column(x["t"]))
    pattern = F.concat(F.lit(r"(?U)(?<![\w-])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\w-])"))
    meant = F.map_from_arrays(F.transform("names", lambda x: x["t"]), F.transform("names", lambda x: x["dst"]))
    own = own.select("act_frbr_uri", pattern.alias("pattern"), meant.alias("meant"))
    each = F.transform(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), lambda n: F.struct(n.alias("t"), F.element_at("meant", n).alias("dst")))
    found = rows.join(own, "act_frbr_uri").select("act_frbr_uri", "src", "doc_pos", F.explode(each).alias("m")).select("act_frbr_uri", "src", "doc_pos", "m.*")
    counts = found.groupBy("act_frbr_uri", "src", "doc_pos", "t", "dst").agg(F.count("*").alias("n"))
    return counts.groupBy("act_frbr_uri", "src", "t", "dst").agg(F.max_by("n", "doc_pos").alias("count")).select("src", "dst", "count")


def rebuilt(old: DataFrame, new: DataFrame, sections: DataFrame, acts: DataFrame) -> DataFrame:
    """old mentions without those of the given acts' sections, and new ones."""
    gone = sections.join(acts.select(F.col("frbr_uri").alias("act_frbr_uri")), "act_frbr_uri", "left_semi").select(F.col("node_id").alias("src")).distinct()
    return old.join(gone, "src", "left_anti").unionByName(new)


def all_edges(sections: DataFrame, terms: DataFrame, refs: DataFrame, mention: DataFrame) -> DataFrame:
    """(src, dst, type) of every edge."""
    parts = [(contains(sections), "contains"), (defines(terms, sections), "defines"), (refs, "ref"), (mention, "mentions")]
    out = [df.select("src", "dst", F.lit(name).alias("type")) for df, name in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3]).distinct()


def graph_stats(acts: DataFrame, sections: DataFrame, terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, type, n): nodes and edges by type and in all."""
    nodes = acts.select(F.col("frbr_uri").alias("id"), F.lit("act").alias("type")).union(sections.select("node_id", F.lit("section"))).union(terms.select("node_id", F.lit("defined_term"))).distinct()
    both = nodes.select(F.lit("node").alias("what"), "type").union(edges.select(F.lit("edge"), "type"))
    return both.rollup("what", "type").agg(F.count("*").alias("n")).where("what is not null").select("what", F.coalesce("type", F.lit("total")).alias("type"), "n")


def upserted(old: DataFrame, new: DataFrame, key: str = "node_id") -> DataFrame:
    """Rows of new, and those of old whose key new has not."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def low_confidence_sample(citations: DataFrame, n: int = 20) -> DataFrame:
    """The n title citations of fewest words, in order: a report to look through."""
    rows = citations.where("target_href is null and matched_section is null or matched_title is not null")
    return rows.withColumn("_n", T.words(F.col("ref_text"))).orderBy("_n", "source_id", "cite_pos").limit(n).drop("_n")
