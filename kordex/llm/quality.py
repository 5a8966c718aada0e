"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has shares of character classes, word statistics and repeats, its own and its neighbours'
lines'. The field has two labels, good and bad; training maximises the likelihood of labelled
documents' lines (a line takes its document's label) on a bounded, hash-ordered sample. A document's
quality is the mean of its lines' forward-backward marginals for good, weighted by their lengths; a
logistic curve fitted on the training documents turns it into the probability of label 1.

Defined results: a text without a line (null, empty, only line feeds) scores as the share of good
training documents (0.5 without labels); repeated rows score alike; extra columns are ignored; an empty
table gives an empty result. Training cuts documents into pieces of at most TRAIN_LINES lines; scoring
never does.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bytewords import SAME, SPACED, buffers, hashes, spans
from .common import slices, table
from .learning import labelled, trained, with_held_out

SAMPLE, STEPS, RATE, DECAY, TRAIN_LINES = 6000, 150, 0.1, 1e-3, 64
THRESHOLD = 0.3

_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def _is(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[list(chars.encode())] = True
    return m


_UPPER, _DIGIT = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("0123456789")
_CLASSES = (_UPPER, _DIGIT, _is("#*$%&|<>@^~_=+{}[]/\\"), _is("!?"), _is(".,;:'\"()-"), ~SPACED)
#: Features of a line itself: classes, then those listed in line_features, then one that is always 1.
OWN, LOG_SIZE = len(_CLASSES) + 10, len(_CLASSES)


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths in bytes, and for each text the number of its first line (and the end)."""
    start, end = spans(data, offs, _LINE)
    of = np.searchsorted(start, offs)
    size = (end - start).astype(np.float64)

    def within(m: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(m[data], dtype=np.int64)))
        return total[end] - total[start]

    cols = [within(m) / size for m in _CLASSES]
    wstart, wend = spans(data, offs, SPACED)
    line = np.searchsorted(start, wstart, "right") - 1
    n = np.bincount(line, minlength=len(start)).astype(np.float64) if len(wstart) else np.zeros(len(start))
    some = np.maximum(n, 1)
    per = lambda x: np.bincount(line, x, len(start)) / some if len(wstart) else np.zeros(len(start))
    h = hashes(data, wstart, wend, SAME)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    pairs = np.unique(np.stack([line.astype(np.uint64), h]), axis=1)[0].astype(np.int64) if len(h) else line
    distinct = np.bincount(pairs, minlength=len(start)) if len(h) else np.zeros(len(start))
    shout = (_UPPER[data[wstart]] & _UPPER[data[wend - 2]] & (wend - wstart > 2)) if len(h) else again
    whole = hashes(data, start, end, SAME)
    order = np.lexsort((np.arange(len(whole)), whole))
    row = np.searchsorted(of, np.arange(len(start)), "right") - 1
    seen = np.zeros(len(start))
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        seen[b] = (whole[a] == whole[b]) & (row[a] == row[b])
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    cols += [
        np.log1p(size) / 10, per(again), 1 - distinct / some, per(shout.astype(np.float64)), np.minimum(per((wend - wstart).astype(np.float64)) / 10, 3), np.log1p(n) / 5,
        seen, _is(".!?")[last].astype(np.float64), (n == 0).astype(np.float64), np.ones(len(start)),
    ]
    return np.stack(cols, axis=1) if len(start) else np.zeros((0, OWN)), size, of


def with_neighbours(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """x with the features of the line before and after; zeros at the ends of a text."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        first = of[:-1][of[:-1] < of[1:]]
        before[first] = 0
        after[of[1:][of[:-1] < of[1:]] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def forward_backward(unary: np.ndarray, of: np.ndarray, pair: np.ndarray, counts: bool = False):
    """Marginals of good for each line; with counts also the expected transitions.

    unary: log odds of good a line; pair: 2 x 2 log weights of (label, next label). Step t handles line t
    of all texts that have one, so the loop is as long as the longest text.
    """
    n = len(unary)
    node = np.stack([np.zeros(n), unary], axis=1)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    size = np.diff(of)
    by = np.argsort(-size, kind="stable")
    first, size = of[:-1][by], size[by]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")

    def over(m: np.ndarray, axis: int) -> np.ndarray:
        top = m.max(axis=axis, keepdims=True)
        return np.log(np.exp(m - top).sum(axis=axis)) + np.squeeze(top, axis)

    for t in range(longest):
        at = first[: alive[t]] + t
        fwd[at] = node[at] + (over(fwd[at - 1][:, :, None] + pair[None], 1) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        bwd[at] = over(pair[None] + (node[at + 1] + bwd[at + 1])[:, None, :], 2)
    both = fwd + bwd
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    if not counts:
        return good
    expected = np.zeros((2, 2))
    inner = np.ones(n, dtype=bool)
    inner[of[1:][of[:-1] < of[1:]] - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        m = fwd[at][:, :, None] + pair[None] + (node[at + 1] + bwd[at + 1])[:, None, :]
        expected = np.exp(m - over(m.reshape(len(at), 4), 1)[:, None, None]).sum(axis=0)
    return good, expected


def fit(samples: list[tuple]) -> bytes:
    """samples: (ord, label, lines) -> pickled (weights, 2 x 2 transitions, share of good, curve)."""
    parts = [(label, x.reshape(-1, OWN).astype(np.float64)) for _, label, x in samples]
    share = float(np.mean([label for label, _ in parts]))
    cut = [(label, x[i : i + TRAIN_LINES]) for label, x in parts for i in range(0, len(x), TRAIN_LINES)]
    if not cut:
        return pickle.dumps(unfitted(share))
    of = np.concatenate(([0], np.cumsum([len(x) for _, x in cut])))
    x = with_neighbours(np.concatenate([x for _, x in cut]), of)
    y = np.repeat([float(label) for label, _ in cut], np.diff(of))
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = sum(len(p) - 1 for label, p in cut if label == k)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for t in range(1, STEPS + 1):
        good, expected = forward_backward(x @ theta[:-4], of, theta[-4:].reshape(2, 2), counts=True)
        g = np.concatenate([x.T @ (good - y), (expected - seen).ravel()]) / len(x) + DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = (theta[:-4], theta[-4:].reshape(2, 2), share)
    return pickle.dumps((*model, curve(*document_means(parts, model))))


def unfitted(share: float) -> tuple:
    return np.zeros(3 * OWN), np.zeros((2, 2)), share, (1.0, 0.0)


def document_means(parts: list[tuple], model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The weighted mean marginal of each training document with a line, and its label."""
    whole = [(label, x) for label, x in parts if len(x)]
    of = np.concatenate(([0], np.cumsum([len(x) for _, x in whole])))
    x = np.concatenate([x for _, x in whole])
    good = forward_backward(with_neighbours(x, of) @ model[0], of, model[1])
    size = np.expm1(x[:, LOG_SIZE] * 10)
    row = np.repeat(np.arange(len(whole)), np.diff(of))
    return np.bincount(row, good * size) / np.maximum(np.bincount(row, size), 1e-9), np.array([float(label) for label, _ in whole])


def logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def curve(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over logit(q): Newton's method with a small ridge."""
    x = np.stack([logit(q), np.ones(len(q))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) + 0.5 * (w - (1.0, 0.0))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), g)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> bytes:
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            x, _, of = line_features(*buffers(part.column(0)))
            packed = [x[a:b].astype(np.float32).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(packed, pa.binary())], ["ord", "label", "x"])

    schema = T.StructType([T.StructField("ord", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])
    return trained(labelled(docs, labels, target, sample).mapInArrow(featurise, schema), fit, np.float32, sample)


def label_lines(data: np.ndarray, offs: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marginal of good, the length, and the first line's number, for the lines of texts."""
    weights, pair = model[:2]
    x, size, of = line_features(data, offs)
    return forward_backward(with_neighbours(x, of) @ weights, of, pair), size, of


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (its first two columns: an id and a text) -> the id, score."""
    kept = docs.schema.fields[0]
    shared = docs.sparkSession.sparkContext.broadcast(model or pickle.dumps(unfitted(0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for part in slices(batches, 1):
            good, size, of = label_lines(*buffers(part.column(1)), known)
            row = np.searchsorted(of, np.arange(len(good)), "right") - 1
            total = np.bincount(row, size, part.num_rows)
            slope, offset = known[3]
            mean = np.bincount(row, size * good, part.num_rows) / np.maximum(total, 1)
            mean = np.where(total > 0, 1 / (1 + np.exp(-np.clip(slope * logit(mean) + offset, -35, 35))), known[2])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(mean, 0, 1), pa.float64())], [kept.name, "score"])

    return docs.mapInArrow(run, T.StructType([kept, T.StructField("score", T.DoubleType())]))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_held_out(score(docs, train(docs, table(spark, sf_dir, "labels"))), THRESHOLD)
