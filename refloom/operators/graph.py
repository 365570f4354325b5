"""Graph operators over edge tables (src, dst, weight, ref_texts)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from .keep import dropped, kept


def fan_out(edges: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """One row for each citation that leaves the given nodes (all, if none given)."""
    rows = edges if node_ids is None else edges.join(node_ids.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")
    rows = rows.select("src", F.col("dst").alias("target"), "is_cross_act", F.posexplode("citations").alias("pos", "c"))
    return rows.select("src", "target", "is_cross_act", "pos", "c.ref_text", "c.relation", K.confidence_label(F.col("c.relation_confidence")).alias("relation_confidence_label"), K.confidence_label(F.col("c.extraction_confidence")).alias("extraction_confidence_label"))


def impacted_by(edges: DataFrame, starts: DataFrame, decay: float = 0.5, max_hops: int = 3) -> DataFrame:
    """Everything that cites the starts within max_hops: (start, node_id, hop,
    path_weight, ref_texts).

    Level by level against the edges: a node counts at its least hop, with the greatest
    product of weights over the shortest paths, times decay for each hop beyond the
    first, and the ref_texts of the last edge of that path (of equal ones, of the least
    node it leads to). A start is no result of its own. All starts go at once; each hop
    is a join on dst, an anti-join with what has been seen and a grouped maximum, and
    the loop ends with an empty frontier."""
    into = kept(edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("w"), "ref_texts"))
    ids = starts.select(F.col("node_id").alias("start")).distinct()
    frontier = ids.select("start", F.col("start").alias("dst"), F.lit(1.0).alias("raw"))
    seen = kept(ids.select("start", F.col("start").alias("node_id"), F.lit(0).alias("hop"), F.lit(None).cast("double").alias("raw"), F.lit(None).cast("array<string>").alias("ref_texts")))
    for hop in range(1, max_hops + 1):
        step = frontier.join(into, "dst").select("start", F.col("src").alias("node_id"), "dst", (F.col("raw") * F.col("w")).alias("raw"), "ref_texts")
        step = step.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
        best = step.groupBy("start", "node_id").agg(F.min(F.struct((-F.col("raw")).alias("r"), "dst", "ref_texts")).alias("b"))
        new = kept(best.select("start", "node_id", F.lit(hop).alias("hop"), (-F.col("b.r")).alias("raw"), F.col("b.ref_texts").alias("ref_texts")))
        if new.isEmpty():
            break
        seen = seen.union(new)
        frontier = new.select("start", F.col("node_id").alias("dst"), "raw")
    return seen.where("hop > 0").select("start", "node_id", "hop", (F.col("raw") * F.pow(F.lit(decay), F.col("hop") - 1)).alias("path_weight"), "ref_texts")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100, exact_iterations: int | None = None) -> DataFrame:
    """Weighted PageRank of the nodes that edges touch: (node_id, score), sum 1.

    Power iteration from 1/N; nodes without outgoing weight give their rank to all
    evenly; it ends when the ranks change by less than tolerance * N in all, or after
    max_iterations (exact_iterations: after just so many). Edges of a hot target meet
    in a sum that map tasks combine."""
    flow = kept(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w")))
    out = flow.groupBy("src").agg(F.sum("w").alias("out")).where("out > 0")
    ids = flow.select(F.col("src").alias("node_id")).union(flow.select("dst")).distinct()
    names = kept(ids.join(out.select(F.col("src").alias("node_id"), "out"), "node_id", "left").withColumn("id", F.monotonically_increasing_id()))
    # turns go over numbers for names, which are short and of one length
    share = flow.join(names.select(F.col("node_id").alias("src"), F.col("id").alias("s"), "out").where("out > 0"), "src").join(names.select(F.col("node_id").alias("dst"), F.col("id").alias("d")), "dst")
    share = kept(share.select("s", "d", (F.col("w") / F.col("out")).alias("p")))
    dropped(flow)
    # dealt and sorted once for all turns, held by the executors; made again from the table where one is lost
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-share.count() // 1_000_000))
    dealt = share.repartition(tasks, "s").sortWithinPartitions("s").persist(StorageLevel.DISK_ONLY)
    nodes = names.select("id", F.col("out").isNotNull().alias("flows"))
    n = names.count()
    if not n:
        dealt.unpersist()
        return names.select("node_id", F.lit(0.0).alias("score"))
    ranks = nodes.select("id", "flows", F.lit(1.0 / n).alias("score"))
    old = None
    stuck = nodes.where("not flows").count() / n
    for _ in range(exact_iterations if exact_iterations is not None else max_iterations):
        gain = ranks.where("flows").join(dealt, F.col("id") == F.col("s")).groupBy("d").agg(F.sum(F.col("score") * F.col("p")).alias("gain"))
        score = F.lit((1 - damping) / n + damping * stuck / n) + damping * F.coalesce("gain", F.lit(0.0))
        new = kept(ranks.join(gain, F.col("id") == F.col("d"), "left").select("id", "flows", score.alias("score"), F.abs(score - F.col("score")).alias("change")))
        totals = new.agg(F.sum("change").alias("change"), F.sum(F.when(~F.col("flows"), F.col("score"))).alias("stuck")).first()
        ranks, stuck = new.select("id", "flows", "score"), totals["stuck"] or 0.0
        if old is not None:
            dropped(old)
        old = new
        if exact_iterations is None and totals["change"] < tolerance * n:
            break
    dealt.unpersist()
    dropped(share)
    return names.join(ranks, "id").select("node_id", "score")


def lower_counts(counts: DataFrame, column: str) -> DataFrame:
    """counts (column's distinct values, _n) with _lower, the sum of _n of lower
    values, and _all. Values are ranged over partitions and summed within them; only
    one total a partition meets elsewhere, so no task sees all of them."""
    spark = counts.sparkSession
    ranged = kept(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), column).withColumn("_p", F.spark_partition_id()))
    totals = sorted((r["_p"], r["t"]) for r in ranged.groupBy("_p").agg(F.sum("_n").alias("t")).collect())  # one row a partition
    before, at = [], 0
    for p, t in totals:
        before.append((p, at))
        at += t
    offsets = spark.createDataFrame(before, "_p int, _before bigint")
    lower = F.sum("_n").over(Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(offsets), "_p").select(column, "_n", (F.col("_before") + F.coalesce(lower, F.lit(0))).alias("_lower"), F.lit(at).cast("bigint").alias("_all"))


def percentiles(scores: DataFrame, column: str = "score") -> DataFrame:
    """scores with percentile: the share of other nodes with a lower score, 0 to 100,
    one decimal (halves to even); 100 for a single node. Rows without a score have none,
    and count for nothing."""
    ranks = lower_counts(scores.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), column).drop("_n")
    value = F.when(F.col("_all") > 1, F.bround(F.col("_lower") / F.nullif(F.col("_all") - 1, F.lit(0)) * 100, 1)).otherwise(100.0)
    return scores.join(ranks, column, "left").withColumn("percentile", F.when(F.col(column).isNotNull(), value)).drop("_lower", "_all")


def ranked_impact(impact: DataFrame, centrality: DataFrame) -> DataFrame:
    """impact with each node's centrality percentile, null where it has no score."""
    return impact.join(percentiles(centrality).select("node_id", F.col("percentile").alias("centrality_percentile")), "node_id", "left")


def sections_of(sections: DataFrame, act: str) -> DataFrame:
    return sections.where(F.col("act_frbr_uri") == act).orderBy("doc_pos")


def entities_in_sections(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, node_id, display_term, entity_type, count) for each mention."""
    names = terms.select(F.col("node_id").alias("dst"), "display_term", "entity_type")
    return mentions.join(names, "dst").select("src", F.col("dst").alias("node_id"), "display_term", "entity_type", "count")
