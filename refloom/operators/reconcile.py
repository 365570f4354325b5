"""Reconciling unresolved titles with a list of existing ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .keep import paired

STATUSES = ("below_threshold", "excluded", "amendment_or_repeal", "present", "renamed", "known_title", "genuine")


def word_index(titles: DataFrame, column: str) -> DataFrame:
    return titles.withColumn("_w", F.explode(F.array_distinct(T.matches(F.lower(column), r"(?U)[\w']+"))))


def _grams(word):
    """The substrings of one to three letters of a word."""
    at = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(at(1), at(2), at(3)))


def contained_in(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(title, match): the first existing title, by file_pos, that contains a
    candidate. Titles meet by the candidate's rarest word of those in the middle, which
    a containing title has whole, or, for one or two words, by the first three letters
    within any of the titles' words; without a word, by their first sign. Never as every
    pair. An empty candidate is in every title, so the first one is its match."""
    cand = candidates.select("title").distinct().withColumn("_words", T.matches(F.lower("title"), r"(?U)[\w']+"))
    inner = F.slice("_words", 2, F.greatest(F.lit(0), F.size("_words") - 2))
    have = existing.groupBy(F.col("title").alias("match")).agg(F.min("file_pos").alias("file_pos"))  # of equal titles only the first can be it
    index = word_index(have, "match")
    uses = index.groupBy("_w").agg(F.count("*").alias("_uses"))
    long = cand.where(F.size("_words") > 2).select("title", F.explode(F.array_distinct(inner)).alias("_w")).join(uses, "_w")
    rare = long.groupBy("title").agg(F.min_by("_w", F.struct("_uses", "_w")).alias("_w"))
    hits = rare.join(index, "_w").select("title", "match", "file_pos")
    short = cand.where(F.size("_words").between(1, 2)).select("title", F.try_element_at("_words", F.lit(1)).alias("_part")).withColumn("_g", F.substring("_part", 1, 3))
    letters = index.select("_w").distinct().select("_w", F.explode(_grams(F.col("_w"))).alias("_g"))
    parts = short.join(letters, "_g").where(F.col("_w").contains(F.col("_part"))).select("title", "_w").distinct().join(index, "_w").select("title", "match", "file_pos")
    bare = cand.where((F.size("_words") == 0) & (F.length("title") > 0)).select("title", F.substring("title", 1, 1).alias("_sign"))
    signs = have.select("match", "file_pos", F.explode(F.array_distinct(F.split(F.regexp_replace("match", r"(?U)[\w']", ""), ""))).alias("_sign"))
    first = have.agg(F.min_by("match", "file_pos").alias("match"), F.min("file_pos").alias("file_pos"))
    empty = cand.where("title = ''").select("title").join(first.withColumn("title", F.lit("")), "title").select("title", "match", "file_pos")
    found = hits.union(parts).union(bare.join(signs, "_sign").select("title", "match", "file_pos")).union(empty).where(F.lower("match").contains(F.lower("title")))
    return found.groupBy("title").agg(F.min_by("match", "file_pos").alias("match"))


def rename_map(titles: DataFrame) -> DataFrame:
    """(old, current) from titles (name, name_history array, pos): earlier names in
    lower case, those equal to the current one left out; of several the last wins."""
    rows = titles.select(F.lower("name").alias("current"), "pos", F.explode("name_history").alias("h")).select(F.lower("h").alias("old"), "current", "pos")
    return rows.where("old <> current").groupBy("old").agg(F.max_by("current", "pos").alias("current"))


def confirmed_by_suffix(hits: DataFrame) -> DataFrame:
    """Search hits (title, name, pos) whose name ends a title or is ended by it, the
    first of each title, with the number of such hits."""
    low, name = F.lower("title"), F.lower("name")
    return hits.where(low.endswith(name) | name.endswith(low)).groupBy("title").agg(F.min_by("name", "pos").alias("name"), F.count("*").alias("hits"))


def search_requests(candidates: DataFrame) -> DataFrame:
    """(title, pos, fragment) to look titles up elsewhere by."""
    return candidates.select("title", F.posexplode(T.search_fragments(F.col("title"))).alias("pos", "fragment"))


def first_confirmed(fragment_hits: DataFrame) -> DataFrame:
    """Of each title the hit of its first fragment that was confirmed."""
    w = Window.partitionBy("title").orderBy("pos", "name")
    return fragment_hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def in_force_titles(titles: DataFrame) -> DataFrame:
    """Titles (id, name, is_in_force) of principal acts and regulations with doc_type;
    amending and repealing ones left out."""
    kind = F.when(F.col("id").rlike(r"^C\d{4}[AR]"), "act").when(F.col("id").rlike(r"^F\d{4}") & F.col("name").rlike(r"(?:Regulations|Rules) \d{4}$"), "regulation")
    return titles.where("is_in_force").withColumn("doc_type", kind).where(F.col("doc_type").isNotNull() & ~is_amending("name"))


def is_amending(column: str):
    return F.col(column).rlike(r"(?i)\b(?:amendment|repeal)")


def status_report(ledger: DataFrame, existing: DataFrame, renames: DataFrame, known: DataFrame, excluded: DataFrame, threshold: int = 5) -> DataFrame:
    """ledger (title, mention_count) with status, the first that holds of STATUSES.
    existing: (title, file_pos); renames: (old, current); known: (name); excluded:
    (title)."""
    rows = ledger.join(contained_in(ledger, existing), "title", "left")
    rows = rows.join(renames.select(F.col("old").alias("title"), "current"), "title", "left")
    rows = rows.join(known.select(F.lower("name").alias("title"), F.lit(True).alias("_k")).distinct(), "title", "left")
    rows = rows.join(excluded.select(F.lower("title").alias("title"), F.lit(True).alias("_x")).distinct(), "title", "left")
    status = (
        F.when(F.col("mention_count") < threshold, "below_threshold").when(F.col("_x"), "excluded").when(is_amending("title"), "amendment_or_repeal")
        .when(F.col("match").isNotNull(), "present").when(F.col("current").isNotNull(), "renamed").when(F.col("_k"), "known_title").otherwise("genuine")
    )
    return rows.select("title", "mention_count", status.alias("status"), "match", "current")


def top_genuine(report: DataFrame, n: int = 50) -> DataFrame:
    return report.where("status = 'genuine'").orderBy(F.desc("mention_count"), "title").limit(n)


def matched_acts(acts: DataFrame, external: DataFrame) -> DataFrame:
    """Acts joined with an external table (title, ...) by normal form of title: every pair
    of equal titles, so the result grows with the square of their number."""
    key = lambda df: df.withColumn("_key", T.normalized_title(F.col("title"))["title"])
    return paired(key(acts), key(external).drop("title"), ["_key"]).drop("_key")


def rule_texts(rules: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """rules (act_title, section_number, ...) with the section's text: by exact title
    and number, the last section of a number. Acts of one title each give a row."""
    own = acts.select(F.col("title").alias("act_title"), F.col("frbr_uri").alias("act_frbr_uri"))
    numbered = sections.select("act_frbr_uri", T.section_number_of(F.col("eid")).alias("section_number"), "text", "doc_pos").where("section_number is not null")
    texts = numbered.groupBy("act_frbr_uri", "section_number").agg(F.max_by("text", "doc_pos").alias("text"))
    found = own.join(texts, "act_frbr_uri")  # first, so that rules meet texts once
    return paired(rules, found, ["act_title", "section_number"])
