"""Scores: complexity of acts, rule-readiness of sections, validation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from .graph import lower_counts


def per_word(n: Column, words: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), words), F.lit(0.0))


def text_measures(sections: DataFrame) -> DataFrame:
    """sections with word_count, conditional_statement_count and
    indeterminate_concept_count."""
    c = F.col("text")
    return sections.withColumns({"word_count": T.words(c), "conditional_statement_count": K.conditions(c), "indeterminate_concept_count": K.vague_terms(c)})


def act_complexity(acts: DataFrame, sections: DataFrame, terms: DataFrame, edges: DataFrame, centrality: DataFrame) -> DataFrame:
    """One row for each act: summed centrality of the act and its sections, distinct
    ref edges that touch it (one within it counts once), terms, vague and conditional
    words, and these by the word (0.0 without words). Four grouped passes that map tasks
    combine, and joins of one row an act."""
    uri = F.col("act_frbr_uri")
    text = text_measures(sections.select("act_frbr_uri", "text")).groupBy("act_frbr_uri").agg(*[F.sum(c).alias(c) for c in ("word_count", "conditional_statement_count", "indeterminate_concept_count")])
    n_terms = terms.groupBy("act_frbr_uri").agg(F.count("*").alias("defined_term_count"))
    ends = F.array_distinct(F.array(F.substring_index("src", "#", 1), F.substring_index("dst", "#", 1)))
    touched = edges.select("src", "dst").distinct().select(F.explode(ends).alias("act_frbr_uri")).groupBy("act_frbr_uri").agg(F.count("*").alias("raw_citation_count"))
    own = sections.select(F.col("node_id"), uri).union(acts.select("frbr_uri", "frbr_uri")).distinct()
    rank = centrality.join(own, "node_id").groupBy("act_frbr_uri").agg(F.sum("score").alias("pagerank_centrality"))
    rows = acts.select(F.col("frbr_uri").alias("act_frbr_uri"), "title")
    for part in (rank, touched, n_terms, text):
        rows = rows.join(part, "act_frbr_uri", "left")
    rows = rows.fillna(0, ["raw_citation_count", "defined_term_count", "word_count", "conditional_statement_count", "indeterminate_concept_count"]).fillna(0.0, ["pagerank_centrality"])
    w = F.col("word_count")
    return rows.select(
        "act_frbr_uri", "title", "pagerank_centrality", "raw_citation_count", "defined_term_count", per_word(F.col("defined_term_count"), w).alias("defined_term_density"),
        "indeterminate_concept_count", per_word(F.col("indeterminate_concept_count"), w).alias("indeterminate_concept_density"),
        "conditional_statement_count", per_word(F.col("conditional_statement_count"), w).alias("conditional_statement_density"), "word_count",
    )


def codifiability(sections: DataFrame, verification: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row for each section: obligation words (long and short list) and their tag,
    both scorer signals (node_id, signal1, signal2), agreement, and the act's
    verification status (act_frbr_uri, status). Of several statuses of an act or signals
    of a node the greatest counts, so that no row is repeated."""
    c = F.col("text")
    rows = sections.select("node_id", "eid", "act_frbr_uri", K.obligations(c).alias("prescriptive_density_count"), K.obligations(c, K.OBLIGATIONS_SHORT).alias("prescriptive_density_regdata_subset_count"))
    rows = rows.withColumn("prescriptive_density_tag", K.density_tag(F.col("prescriptive_density_count")))
    if scores is None:
        signal = F.lit(None).cast("struct<tag:string,reasoning:string>")
        rows = rows.withColumns({"signal1": signal, "signal2": signal})
    else:
        rows = rows.join(scores.groupBy("node_id").agg(F.max("signal1").alias("signal1"), F.max("signal2").alias("signal2")), "node_id", "left")
    rows = rows.join(verification.groupBy("act_frbr_uri").agg(F.max("status").alias("status")), "act_frbr_uri", "left")
    return rows.select(
        "eid", "act_frbr_uri", F.col("signal1.tag").alias("llm_tag"), F.col("signal1.reasoning").alias("llm_reasoning"), F.col("signal2.tag").alias("vagueness_tag"), F.col("signal2.reasoning").alias("vagueness_reasoning"),
        "prescriptive_density_count", "prescriptive_density_regdata_subset_count", "prescriptive_density_tag",
        K.agreement(F.col("signal1.tag"), F.col("signal2.tag"), F.col("prescriptive_density_tag")).alias("agreement"), F.coalesce("status", F.lit("not_yet_checked")).alias("parse_verification_status"),
    )


def codifiability_summary(records: DataFrame) -> DataFrame:
    """(act_frbr_uri, records, scored, low, medium, high, status): shares in per cent
    of the scored ones, one decimal; null where none is scored."""
    scored = F.count_if(F.col("llm_tag").isNotNull())
    share = lambda t: F.bround(F.try_divide(F.count_if(F.col("llm_tag") == t) * 100.0, scored), 1).alias(t)
    return records.groupBy("act_frbr_uri").agg(F.count("*").alias("records"), scored.alias("scored"), share("low"), share("medium"), share("high"), F.min_by("parse_verification_status", "eid").alias("status"))


def confusion(rows: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, actual, predicted).agg(F.count("*").alias("n"))


def agreement_rate(rows: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("rate"))


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the mean rank of each value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    places = lower_counts(counts, column).select(column, (F.col("_lower") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(places, column)


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman); null with fewer than two rows."""
    rows = rows.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = average_ranks(average_ranks(rows, x, "_rx"), y, "_ry")
    n = F.count("*")
    return rows.agg(n.alias("n"), F.when(n > 1, F.corr(x, y)).alias("pearson"), F.when(n > 1, F.corr("_rx", "_ry")).alias("spearman"))


def relation_distribution(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode("citations").alias("c")).groupBy("c.relation").agg(F.count("*").alias("n"))


def relation_samples(edges: DataFrame, n: int = 10) -> DataFrame:
    """(relation, src, dst, pos, ref_text): the first n citations of each relation, by
    edge and place."""
    rows = edges.select("src", "dst", F.posexplode("citations").alias("pos", "c")).select("c.relation", "src", "dst", "pos", "c.ref_text")
    part = Window.partitionBy("relation", "_p").orderBy("src", "dst", "pos")
    whole = Window.partitionBy("relation").orderBy("src", "dst", "pos")
    few = rows.withColumn("_p", F.pmod(F.xxhash64("src", "dst"), F.lit(64))).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= n)  # each part's own first
    return few.withColumn("_k", F.row_number().over(whole)).where(F.col("_k") <= n).drop("_k", "_p")


def samples(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """The n rows of each label with the lowest MD5 of key: the sample is the same in any
    run, any order of rows and any engine. Each task keeps its own n lowest first."""
    rows = rows.withColumn("_h", F.md5(F.col(key).cast("string")))
    part = Window.partitionBy("_p", label).orderBy("_h", key)
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("_h"), F.lit(64))).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= n)
    whole = Window.partitionBy(label).orderBy("_h", key)
    return rows.withColumn("_k", F.row_number().over(whole)).where(F.col("_k") <= n).drop("_h", "_p", "_k")


def group_means(rows: DataFrame, label: str, value: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def intra_act_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in one act."""
    return edges.where((F.substring_index("src", "#", 1) == F.substring_index("dst", "#", 1)) & ~F.col("is_cross_act"))


def heaviest(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(n)


def shortest_texts(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.select("src", "dst", F.explode("ref_texts").alias("ref_text")).orderBy(F.length("ref_text"), "ref_text", "src", "dst").limit(n)
