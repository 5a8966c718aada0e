"""A catalogue that is fed continuously: each batch is merged into the current table by the rules of the batch merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.merge import best_per_key


def merging_sink(path: str, key: Column, order: list[Column], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: writes version n + 1 of the table from version n and the batch, only for buckets that the batch touches.

    The table is folders bucket=k/version=n. A batch that runs again writes the same folders again, so the result is the same.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        old = current(spark, path, before=batch_id)
        touched = new if old is None else new.unionByName(old.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi"), allowMissingColumns=True)
        best = best_per_key(touched, key, order)
        best.withColumn("version", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)

    return merge


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table as of its newest versions (older than a batch, if one is given); None if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("version") < before)
    newest = rows.select("bucket", "version").distinct().groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("version")


def start_merge(stream: DataFrame, path: str, checkpoint: str, key: Column, order: list[Column], buckets: int = 64) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(merging_sink(path, key, order, buckets)).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, stamp: str, by: str, width: str, lateness: str) -> DataFrame:
    """Counts by window and key with a watermark: late rows up to `lateness` count, state older than that goes."""
    windowed = stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, lateness).groupBy(F.window(stamp, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("w.start").alias("window_start"), by, "n")
