"""The engine's tables, made from the star-schema test tables.

Acts are parts, each with three sections; line items cite them in every way there is.
Terms are what suppliers carry. Each maker has its SQL twin, a chain of WITH parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keep import spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts, which come in few files, dealt to tasks by rows: each makes several."""
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey", rows=100_000, least=5000)


def acts(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).selectExpr("concat('/akn/au/act/', p_partkey) frbr_uri", "concat(initcap(p_name), ' Act ', 1900 + p_partkey % 20) title", "cast(1900 + p_partkey % 20 as int) year", "cast(null as string) compilation_date", "case when p_partkey % 7 = 0 then '' else concat('C', p_partkey) end title_id", "p_partkey act_pos")


def sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).selectExpr("p_partkey", "p_name", "p_type", "explode(array(1, 2, 3)) k")
    return rows.selectExpr("concat('/akn/au/act/', p_partkey, '#part-I__sec-', k) node_id", "concat('part-I__sec-', k) eid", "concat('/akn/au/act/', p_partkey) act_frbr_uri", "cast(null as string) heading", "concat(p_name, ' ', p_type, ' ', k) text", "concat(p_name, ' ', p_type) prose_text", "'section' provision_type", "p_partkey * 10 + k doc_pos")


def terms(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).selectExpr("p_partkey", "p_name", "p_type", "p_brand", "explode(array(0, 1)) k")
    return rows.selectExpr("concat('/akn/au/act/', p_partkey, '#term-', lower(replace(p_type, ' ', '_')), case when k = 1 then '__2' else '' end) node_id", "lower(p_type) term", "p_type display_term", "concat('/akn/au/act/', p_partkey) act_frbr_uri", "concat('part-I__sec-', 1 + (p_partkey + k) % 4) section_eid", "case when p_partkey % 11 = 0 then '' else concat(p_name, ' ', k) end definition_text", "k + 1 occurrence", "case when p_partkey % 3 = 0 then p_brand end entity_type", "p_partkey * 10 + k doc_pos")


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Six kinds by order number: anchors there and not there, addresses, section
    numbers, titles (own ones among them) and titles of nothing."""
    li = table(spark, d, "lineitem").selectExpr("*", "cast(l_orderkey % 6 as int) v", "case when l_suppkey % 5 = 0 then l_partkey else l_suppkey end l_target")
    parts = table(spark, d, "part").selectExpr("p_partkey l_target", "p_name")
    titled = li.where("v <=> 4").join(parts, "l_target", "left")  # the others need no part, so they don't move
    rows = titled.unionByName(li.where("not v <=> 4").withColumn("p_name", F.lit(None).cast("string")))
    title = "concat('The ', initcap(p_name), '  Act ', 1900 + l_target % 20)"
    return rows.selectExpr(
        "concat('/akn/au/act/', l_partkey, '#part-I__sec-', 1 + l_linenumber % 3) source_id", "concat('/akn/au/act/', l_partkey) act_frbr_uri",
        "case when v < 3 then 'tagged' when v = 3 then 'intra' else 'prose' end kind",
        f"case v when 0 then 'section 2' when 1 then 'section 9' when 2 then 'that Act' when 3 then concat('section ', 1 + l_quantity % 5) when 4 then {title} else concat('Lost Things Act ', 1900 + l_suppkey % 30) end ref_text",
        "v in (2, 4, 5) is_cross_act",
        "case v when 0 then '#part-I__sec-2' when 1 then '#part-I__sec-9' when 2 then concat('/akn/au/act/', l_suppkey) end target_href",
        f"case v when 4 then {title} when 5 then concat('Lost Things Act ', 1900 + l_suppkey % 30) end matched_title",
        "case v when 3 then cast(cast(1 + l_quantity % 5 as int) as string) end matched_section",
        "'cites' relation", "0.75D relation_confidence", "0.6D extraction_confidence", "cast(l_orderkey * 10 + l_linenumber as int) cite_pos",
    )


SQL = """
acts AS (SELECT '/akn/au/act/' || p_partkey frbr_uri, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || CASE WHEN contains(p_name, ' ') THEN ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) ELSE '' END || ' Act ' || (1900 + p_partkey % 20) title, p_partkey act_pos FROM part),
sections AS (SELECT '/akn/au/act/' || p_partkey || '#part-I__sec-' || k node_id, '/akn/au/act/' || p_partkey act_frbr_uri, CAST(k AS VARCHAR) number, p_name || ' ' || p_type || ' ' || k AS text, p_partkey * 10 + k doc_pos FROM part, (VALUES (1), (2), (3)) t(k)),
terms AS (SELECT '/akn/au/act/' || p_partkey || '#term-' || lower(replace(p_type, ' ', '_')) || CASE WHEN k = 1 THEN '__2' ELSE '' END node_id, lower(p_type) term, p_type display_term, '/akn/au/act/' || p_partkey act_frbr_uri, 'part-I__sec-' || (1 + (p_partkey + k) % 4) section_eid, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' ' || k END definition_text, CASE WHEN p_partkey % 3 = 0 THEN p_brand END entity_type, p_partkey * 10 + k doc_pos FROM part, (VALUES (0), (1)) t(k)),
cited AS (SELECT l.*, l_orderkey % 6 v, CASE WHEN l_suppkey % 5 = 0 THEN l_partkey ELSE l_suppkey END l_target FROM lineitem l),
citations AS (SELECT '/akn/au/act/' || l_partkey || '#part-I__sec-' || (1 + l_linenumber % 3) source_id, '/akn/au/act/' || l_partkey act_frbr_uri, v, CASE WHEN v < 3 THEN 0 WHEN v = 3 THEN 2 ELSE 1 END kind, v IN (2, 4, 5) is_cross_act,
  CASE v WHEN 0 THEN '/akn/au/act/' || l_partkey || '#part-I__sec-2' WHEN 1 THEN '/akn/au/act/' || l_partkey || '#part-I__sec-9' WHEN 2 THEN '/akn/au/act/' || l_suppkey END address,
  CASE v WHEN 4 THEN lower(p_name) || ' act ' || (1900 + l_target % 20) WHEN 5 THEN 'lost things act ' || (1900 + l_suppkey % 30) END title,
  CASE v WHEN 0 THEN 'section 2' WHEN 1 THEN 'section 9' WHEN 2 THEN 'that Act' ELSE 'x' END ref_text,
  CASE v WHEN 3 THEN CAST(CAST(1 + l_quantity % 5 AS INT) AS VARCHAR) END number, l_orderkey * 10 + l_linenumber cite_pos FROM cited LEFT JOIN part ON p_partkey = l_target),
titles AS (SELECT lower(title) title_key, arg_max(frbr_uri, act_pos) target FROM acts GROUP BY 1),
nodes AS (SELECT frbr_uri id FROM acts UNION SELECT node_id FROM sections UNION SELECT node_id FROM terms),
resolved AS (SELECT c.*, CASE WHEN c.title IS NULL THEN 'tagged' ELSE 'untagged' END bucket,
  CASE WHEN c.address IS NOT NULL OR c.number IS NOT NULL THEN CASE WHEN coalesce(n.id, s.node_id) IS NULL THEN 'missing' ELSE 'linked' END
       WHEN c.title IS NULL THEN 'dropped' WHEN c.title = lower(a.title) THEN 'self' WHEN t.target IS NOT NULL THEN 'resolved' ELSE 'unresolved' END status,
  CASE WHEN c.address IS NOT NULL OR c.number IS NOT NULL THEN coalesce(n.id, s.node_id) WHEN c.title = lower(a.title) THEN NULL ELSE t.target END target
  FROM citations c LEFT JOIN nodes n ON n.id = c.address LEFT JOIN sections s ON s.act_frbr_uri = c.act_frbr_uri AND s.number = c.number AND c.address IS NULL
  LEFT JOIN acts a ON a.frbr_uri = c.act_frbr_uri LEFT JOIN titles t ON t.title_key = c.title),
edges AS (SELECT source_id src, target dst, count(*) weight FROM resolved WHERE target IS NOT NULL GROUP BY 1, 2)
"""


def layered(spark: SparkSession, d: str) -> DataFrame:
    """Parts lead to suppliers by line items, suppliers to nations, these to regions."""
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight"))
    a = li.selectExpr("concat('p', l_partkey) src", "concat('s', l_suppkey) dst", "weight")
    b = table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) src", "concat('n', s_nationkey) dst", "s_suppkey % 3 + 1 weight")
    c = table(spark, d, "nation").selectExpr("concat('n', n_nationkey) src", "concat('r', n_regionkey) dst", "cast(n_nationkey % 4 + 1 as bigint) weight")
    return a.union(b).union(c).selectExpr("src", "dst", "weight", "array(concat(src, '-', dst)) ref_texts")


LAYERED = """
flow AS (SELECT 'p' || l_partkey src, 's' || l_suppkey dst, CAST(count(*) AS DOUBLE) w FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey % 3 + 1 FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 4 + 1 FROM nation)
"""
