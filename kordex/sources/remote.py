"""Files in any store that Hadoop's file systems reach (local, HDFS, object stores): list, copy, prune."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and sizes of the files of a folder."""
    _, where, fs = _open(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(where) if s.isFile()} if fs.exists(where) else {}


def copy(spark: SparkSession, source: str, target: str) -> None:
    """One file to another place, under a passing name until it is whole."""
    jvm, a, from_fs = _open(spark, source)
    _, b, to_fs = _open(spark, target)
    part = jvm.org.apache.hadoop.fs.Path(target + ".part")
    jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, part, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    to_fs.delete(b, False)
    to_fs.rename(part, b)


def sync(spark: SparkSession, source: str, target: str, suffix: str = ".csv", prune: bool = True) -> tuple[list[str], list[str]]:
    """Makes the target's files those of the source (by name and size); returns the names copied and removed."""
    want = {n: size for n, size in listing(spark, source).items() if n.endswith(suffix)}
    have = {n: size for n, size in listing(spark, target).items() if n.endswith(suffix)}
    fresh = sorted(n for n, size in want.items() if have.get(n) != size)
    for n in fresh:
        copy(spark, f"{source}/{n}", f"{target}/{n}")
    gone = sorted(set(have) - set(want)) if prune else []
    jvm, _, fs = _open(spark, target)
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}"), False)
    return fresh, gone
