"""Cutting lineage in iterative jobs, on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: With this set, Spark deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only on one machine (a local master) a
    temporary one stands in where that is unset; a cluster without a shared folder is an
    error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="refloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/refloom-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str, rows: int = 5000, least: int = 500) -> DataFrame:
    """df dealt by its keys to tasks of about so many rows: for dear work on rows that
    come in few files. The number is given, so that adaptive execution, which knows bytes
    alone, leaves it; every core gets a task as long as there are `least` rows for each.
    Counts df, so df should be a table or cheap."""
    n = df.count()
    tasks = max(-(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // least)), 1)
    out = df.repartition(tasks, *keys)
    out.tasks = tasks
    return out


def tasks_of(df: DataFrame) -> int:
    """The number of tasks that `spread` gave."""
    return df.tasks


def paired(left: DataFrame, right: DataFrame, keys: list[str], pairs: int = 4_000_000) -> DataFrame:
    """The inner join of two tables whose equal keys may be many on both sides: tasks are
    cut by the pairs they make, counted before, since adaptive execution goes by the bytes
    that go in. Left rows of a key with more than `pairs` are dealt to several tasks, which
    each get the right rows of that key. Both sides are read twice, so they should be cheap."""
    n = left.groupBy(*keys).agg(F.count("*").alias("_l")).join(right.groupBy(*keys).agg(F.count("*").alias("_r")), keys)
    each = F.col("_l").cast("double") * F.col("_r")
    total = n.agg(F.sum(each).alias("t")).first().t or 0.0
    tasks = int(min(max(-(-total // pairs), left.sparkSession.sparkContext.defaultParallelism), 100_000))
    hot = n.where(each > pairs).select(*keys, F.least(F.ceil(each / pairs), F.col("_l")).cast("int").alias("_n"))
    deal = F.coalesce("_n", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*[left[c] for c in left.columns]), deal).cast("int")).drop("_n")
    b = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), deal - 1))).drop("_n")
    keys = [*keys, "_part"]
    return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys).drop("_part")


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and read from there by all that
    follows, whatever executors are lost; the shuffle files behind it go."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what `kept` wrote, once all that reads it has been kept."""
    place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
