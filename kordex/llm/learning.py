"""A bounded, reproducible sample of labelled documents, and training in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import buffers
from .common import crc_mod, trimmed

FOLDS, HELD = 5, 0


def labelled(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(text, label, ord) of at most `bound` labelled ids outside the held-out fold, in the order of a hash of the id.

    Null labels are no labels; an id labelled twice counts as 1 if one of its labels is 1. The ids are at
    most `bound` rows, so they are broadcast; documents are not shuffled.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD))
    ids = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("label")).withColumn("ord", F.xxhash64("doc_id")).orderBy("ord", "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label", "ord")


def trained(features: DataFrame, fit: Callable[[list[tuple]], bytes], kind: np.dtype, bound: int) -> bytes:
    """fit(rows) run in one task, which gets the bounded sample in order; b"" if there are no rows.

    Equal rows are one. Texts that share an id are all in the sample; if that makes more than `bound` rows, the first of
    them in the order of the ids' hashes (of one id: by a hash of the features) stay.

    features (ord, label, packed numbers) -> rows (ord, label, array of `kind`); the arrays are views of what Spark sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in trimmed(batches):
            data, offs = buffers(b.column(2))
            packed = data.view(kind)
            ends = (offs // np.dtype(kind).itemsize).tolist()
            rows += [(o, y, packed[i:j]) for o, y, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows) if rows else b""], pa.binary())], ["model"])

    ord_, label, packed = features.columns
    one = features.distinct().orderBy(ord_, label, F.xxhash64(packed), packed).limit(bound)  # one partition, in this order
    models = [r[0] for r in one.mapInArrow(run, T.StructType([T.StructField("model", T.BinaryType())])).collect()]
    return max(models, default=b"", key=len)


def with_held_out(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
