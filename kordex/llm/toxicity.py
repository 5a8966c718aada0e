"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours and pairs with one word between of a text, hashed
into 2**DIM_BITS coordinates. Each coordinate has its own learning rate; L1 leaves few weights, which
are broadcast (2**DIM_BITS of them at most). Training sees a bounded, hash-ordered sample of labelled
documents; scoring sees every whole text.

Defined results: a null or empty text scores as the intercept alone; without labels every score is 0;
repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bytewords import ALNUM, FOLD, buffers, first_rows, mix, words
from .common import slices, table
from .learning import labelled, trained, with_held_out

DIM_BITS, SAMPLE, EPOCHS = 20, 16_000, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
THRESHOLD = 0.5


def features(data: np.ndarray, offs: np.ndarray, bits: int = DIM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every word, pair of neighbours and pair with a gap; repeats are still in it."""
    _, _, h, of = words(data, offs, ALNUM, FOLD)
    row = first_rows(of, np.arange(len(h)))
    rows, found = [row], [h]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[:-gap][same])
            found.append(mix(h[:-gap] * np.uint64(3) + mix(h[gap:] + np.uint64(salt)))[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(rows: np.ndarray, at: np.ndarray, bits: int = DIM_BITS) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << bits) | at)
    return both >> bits, both & ((1 << bits) - 1)


def fit(samples: list[tuple]) -> bytes:
    """samples: (ord, label, coordinates) -> pickled (intercept, coordinates, weights)."""
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
    z0 = n0 = 0.0
    data = [(label, at) for _, label, at in samples]
    bias = 0.0
    for _ in range(EPOCHS):
        for label, at in data:
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            bias = -z0 / ((BETA + np.sqrt(n0)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[at] = grown
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * bias
            n0 += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
    return pickle.dumps((float(bias), at.astype(np.int32), w))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> bytes:
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            data, offs = buffers(part.column(0))
            rows, at = distinct(*features(data, offs))
            of = np.searchsorted(rows, np.arange(part.num_rows + 1))
            packed = [at[a:b].astype(np.int32).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(packed, pa.binary())], ["ord", "label", "at"])

    schema = T.StructType([T.StructField("ord", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("at", T.BinaryType())])
    return trained(labelled(docs, labels, target, sample).mapInArrow(featurise, schema), fit, np.int32, sample)


def probabilities(model: bytes, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with their scores."""
    weights, bias = np.zeros(1 << DIM_BITS), -35.0
    if model:
        bias, at, w = pickle.loads(model)
        weights[at] = w
    used = weights != 0
    for part in slices(batches, text):
        rows, at = features(*buffers(part.column(text)))
        hit = used[at]
        rows, at = distinct(rows[hit], at[hit])
        total = np.bincount(rows, weights[at], part.num_rows) + bias
        yield part, 1 / (1 + np.exp(-np.clip(total, -35, 35))) if model else np.zeros(part.num_rows)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (its first two columns: an id and a text) -> the id, score."""
    kept = docs.schema.fields[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p in probabilities(shared.value, batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], [kept.name, "score"])

    return docs.mapInArrow(run, T.StructType([kept, T.StructField("score", T.DoubleType())]))


def accepted(docs: DataFrame, model: bytes, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p in probabilities(shared.value, batches, at):
            yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_held_out(score(docs, train(docs, table(spark, sf_dir, "labels"))), THRESHOLD)
