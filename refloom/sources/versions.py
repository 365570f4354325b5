"""Versions of a graph folder, and the pointer that names the one to read.

A version is never written over: a new one is written beside it and the pointer then
moved, so readers see one or the other and the one before is the backup. Pointers are
small files that are written and renamed through the Hadoop filesystem, so they work on
whatever storage the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

POINTER = "latest"


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    _, fs, p = _place(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    jvm, fs, p = _place(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole or not at all."""
    _, fs, p = _place(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_joined(spark: SparkSession, lines, target: str, head: str, tail: str, between: str = ",") -> None:
    """A file of head, the rows of lines (one string column, in its order) with one sign
    between them, and tail. Tasks write the rows; the driver copies bytes on, and holds
    none of them."""
    jvm, fs, p = _place(spark, target)
    parts = jvm.org.apache.hadoop.fs.Path(f"{target}.parts")
    lines.selectExpr(f"concat('{between}', {lines.columns[0]})").write.mode("overwrite").text(f"{target}.parts")
    out, first = fs.create(p, True), True
    try:
        out.write(bytearray(head.encode()))
        for name in sorted(f.getPath().toString() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-") and f.getLen()):
            source = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                if first:
                    source.read()
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
            first = False
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(parts, True)


def latest(spark: SparkSession, graph: str) -> str | None:
    """The version that the pointer names, or None before the first."""
    text = read_text(spark, f"{graph}/{POINTER}")
    return text.strip() or None if text is not None else None


def point_to(spark: SparkSession, graph: str, version: str) -> None:
    """Moves the pointer by renaming a whole file over it."""
    jvm, fs, new = _place(spark, f"{graph}/{POINTER}.new")
    write_text(spark, f"{graph}/{POINTER}.new", version)
    mode = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.isAbsolute() and new.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = mode
    context.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{graph}/{POINTER}")), modes)


def next_version(spark: SparkSession, graph: str) -> str:
    """A name that no version of the graph has."""
    now = latest(spark, graph)
    n = int(now.rsplit("-", 1)[-1]) + 1 if now and now.rsplit("-", 1)[-1].isdigit() else 0
    while exists(spark, f"{graph}/batch-{n:09d}"):
        n += 1
    return f"batch-{n:09d}"
