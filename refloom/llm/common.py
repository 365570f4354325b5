"""Reading, moving and keeping tables: what the operators share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only on one machine (a local master),
    as in tests, a temporary folder stands in where that is unset; a cluster without a
    shared folder is an error."""
    if _scratch:
        return f"{_scratch[-1]}/refloom-{uuid.uuid4().hex}"
    jsc = spark.sparkContext._jsc.sc()
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and jsc.getCheckpointDir().isDefined():
        base = jsc.getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="refloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/refloom-{uuid.uuid4().hex}"


#: With this set, Spark deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later reads neither compute it again nor
    depend on an executor's disk, and the shuffle files behind it go."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    spark.sparkContext._jvm.System.gc()  # plans of queries that have ended needn't fill the driver
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


_scratch: list[str] = []  # folders in which the tables of a running stage lie


def finished(spark: SparkSession, stage: Callable[[], DataFrame]) -> DataFrame:
    """What the stage returns, written; the tables that it wrote on its way are deleted.
    Run one stage at a time in a process."""
    folder = shared_dir(spark)
    _scratch.append(folder)
    try:
        made = stage()
    finally:
        _scratch.pop()
    out = written(made)
    _delete(spark, folder)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `written` made, once all that reads it has been written."""
    _delete(df.sparkSession, df.written_at)


def lean(run: Callable) -> Callable:
    """run, after which its worker, which serves later tasks and stages too, gives
    memory back that it no longer uses."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return whole


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], list | pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(lean(run), schema)


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra ones can't clash with results."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as no column of that name needs."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def splits(df: DataFrame, column: str, parts: int) -> list[int]:
    """About parts - 1 increasing values that cut the column's rows into even
    ranges. Reads only that column; at most `parts` values reach the driver."""
    if parts < 2:
        return []
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    got = df.agg(F.percentile_approx(column, at, F.lit(max(10_000, 20 * parts))).alias("q")).first()["q"]
    return sorted(set(got or []))


def ranged(df: DataFrame, column: str, cuts: list[int], name: str = "_range") -> DataFrame:
    """Adds the number of the range: rows of range i are all below those of range
    i + 1. Null is below every value."""
    edges = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        least = v.isna().to_numpy()
        at = np.searchsorted(edges, v.fillna(0).astype("int64").to_numpy(), side="right")
        return pd.Series(np.where(least, 0, at).astype("int32"))

    return df.withColumn(name, place(F.col(column)) if cuts else F.lit(0))


def by_range(df: DataFrame, number: str, parts: int) -> DataFrame:
    """One task for each range number below parts, without the sampling run of
    repartitionByRange."""
    return df.repartitionById(parts, F.col(number).cast("int"))


def filesystem(uri: str):
    """(filesystem, path) of a folder that executors share."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; folder overrides where it is looked for."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32_text(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary"))


def int_col(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))
