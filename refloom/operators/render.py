"""Answers as text: one string column for each result row, and messages for misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def definition(display_term: Column, act_title: Column, eid: Column, text: Column) -> Column:
    return F.format_string("**%s** (%s - %s)\n\n%s", display_term, act_title, eid, text)


def definitions(rows: DataFrame) -> DataFrame:
    return rows.select(definition(*map(F.col, ("display_term", "act_title", "section_eid", "definition_text"))).alias("line"))


def references(rows: DataFrame) -> DataFrame:
    where = F.when(F.col("is_cross_act"), "cross-act").otherwise("same-act")
    line = F.format_string("- [%s](%s) (%s) [%s, relation confidence: %s, extraction confidence: %s]", "ref_text", "target", where, "relation", "relation_confidence_label", "extraction_confidence_label")
    return rows.select(line.alias("line"))


def impact(rows: DataFrame) -> DataFrame:
    pct = F.col("centrality_percentile") if "centrality_percentile" in rows.columns else F.lit(None).cast("double")
    note = F.coalesce(F.concat(F.lit(", centrality: "), pct.cast("string"), F.lit("th percentile")), F.lit(""))
    line = F.format_string('- %s (hop %d, weight %.2f%s) cites via "%s"', F.col("node_id"), F.col("hop"), F.col("path_weight"), note, F.array_join("ref_texts", "; "))
    return rows.orderBy(F.desc("path_weight"), "node_id").select(line.alias("line"))


def entities(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("- %s (%s, %d mention(s))", "display_term", "entity_type", "count").alias("line"))


def homonyms(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("- %s (%s) in %s (%s)", "display_term", "entity_type", "act_title", "section_eid").alias("line"))


def terms(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("- %s (%s)", "display_term", "section_eid").alias("line"))


def multi_act(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("- %s: %d acts", "display_term", "act_count").alias("line"))


def complexity(rows: DataFrame) -> DataFrame:
    def counted(label: str, what: str, name: str) -> Column:
        return F.format_string("- " + label + ": %d " + what + " (%.4f per word)", F.col(f"{name}_count"), F.col(f"{name}_density"))

    lines = [
        F.format_string("**%s** (%s)\n", "title", "act_frbr_uri"), F.format_string("- Cross-reference: PageRank centrality %.6f, raw citation count %d", "pagerank_centrality", "raw_citation_count"),
        counted("Defined-term density", "terms", "defined_term"), counted("Indeterminate-concept frequency", "matches", "indeterminate_concept"), counted("Conditional-statement frequency", "matches", "conditional_statement"),
        F.format_string("- Word count: %d", "word_count"),
    ]
    return rows.select(F.concat_ws("\n", *lines).alias("line"))


NOT_COMPUTED = "not computed (run with --llm-signals)"


def codifiability(rows: DataFrame) -> DataFrame:
    def signal(name: str) -> Column:
        tag = F.col(f"{name}_tag")
        return F.when(tag.isNotNull(), F.format_string("%s (%s)", tag, F.col(f"{name}_reasoning"))).otherwise(NOT_COMPUTED)

    lines = [
        F.format_string("**%s** (%s)\n", "eid", "act_frbr_uri"), F.concat(F.lit("- LLM codifiability tag: "), signal("llm")), F.concat(F.lit("- Vagueness tag: "), signal("vagueness")),
        F.format_string("- Prescriptive density: %d matches (7-word), %d matches (RegData 5-word subset), tag: %s", "prescriptive_density_count", "prescriptive_density_regdata_subset_count", "prescriptive_density_tag"),
        F.concat(F.lit("- Agreement: "), F.col("agreement")), F.concat(F.lit("- Parse verification: "), F.col("parse_verification_status")),
    ]
    return rows.select(F.concat_ws("\n", *lines).alias("line"))


def act_summary(rows: DataFrame) -> DataFrame:
    shares = F.format_string("low: %.1f%%, medium: %.1f%%, high: %.1f%%", "low", "medium", "high")
    return rows.select(F.format_string("**%s** -- %d scored provisions\n\n- LLM codifiability breakdown: %s\n- Parse verification status: %s", F.col("act_frbr_uri"), F.col("records"), F.when(F.col("scored") > 0, shares).otherwise(NOT_COMPUTED), F.col("status")).alias("line"))


def not_available(table: str) -> str:
    """What is said where a side table has not been made."""
    return f"The graph has no {table} table. Make it with the command {table}."


def answer(rows: DataFrame, miss: str, separator: str = "\n") -> str:
    """The lines of one lookup as a string; an answer is meant for a reader."""
    lines = [r["line"] for r in rows.collect()]
    return separator.join(lines) if lines else miss
