"""LM scoring by context-tree weighting.

The next byte is eight binary decisions. A node of the tree is a context (the last 0 to DEPTH bytes) with
the bits of the byte decided so far; it counts zeros and ones over all training texts and estimates by
Krichevsky-Trofimov. A node's weighted probability is half its own estimate plus half the product of its
children's; from the leaves to the root that is one aggregation a depth. Predicting mixes the estimates of
all depths by the posterior weights that follow; a context not met in training is predicted by its
longest suffix that was. Texts are folded to lower case (A-Z), begin in the context of zero bytes and end
with a zero byte, whose probability counts too.

Only counts are gathered, one row a distinct (DEPTH + 1)-gram and a distinct word for each task, so what
moves grows with the input but not as fast. Scoring needs the whole tree: up to BROADCAST_NODES counted nodes
are broadcast as sorted arrays; beyond that, the distinct grams of the documents are joined with the written
nodes, and documents with their grams. Word counts of the unigram base are broadcast up to BROADCAST_WORDS
counted rows; beyond that, documents' words are joined with them.

Defined results: a null or empty text is its end alone; an id that is null splits as an empty text; if
no training text exists every bit has probability 1/2; repeated rows count and score each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import FOLD, SPACED, buffers, mix, words
from .common import crc_mod, give_back, slices, table, written

DEPTH, BROADCAST_NODES, BROADCAST_WORDS = 4, 6_000_000, 6_000_000
FOLDS, HELD = 7, 2
WORD, GRAM, TOTAL = 0, 1, 2
_STEP = 1500.0  # of a logit in the published tables


def grams_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (DEPTH + 1)-gram that ends at each byte and at the end of each text, and where each text's grams begin."""
    n, gap = len(offs) - 1, DEPTH + 1
    begin = offs[:-1] + gap * np.arange(n) + DEPTH
    padded = np.zeros(len(data) + gap * n + DEPTH, np.int64)
    at = np.ones(len(padded), bool)
    for k in range(DEPTH):
        at[begin - DEPTH + k] = False
    at[len(data) + gap * n :] = False
    inside = at.copy()
    inside[begin + np.diff(offs)] = False
    padded[inside] = FOLD[data]
    code = padded.copy()
    for k in range(1, gap):
        code[k:] |= padded[:-k] << (8 * k)
    return code[at], offs + np.arange(n + 1)


class Tally:
    """Counts of 64-bit keys, merged when they have grown."""

    def __init__(self) -> None:
        self.keys, self.counts, self.new, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            keys = np.sort(keys)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.new.append((keys[first], np.diff(np.append(first, len(keys)))))
            self.waiting += len(first)
            if self.waiting > max(1 << 19, len(self.keys)):
                self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c for _, c in self.new)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.waiting = [], 0


_COUNTED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def counted(texts: DataFrame) -> DataFrame:
    """One column of texts -> (kind, key, n): words, grams, and the number of texts, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, total = {WORD: Tally(), GRAM: Tally()}, 0
        for part in slices(batches, 0):
            data, offs = buffers(part.column(0))
            tallies[WORD].add(words(data, offs, SPACED, FOLD)[2].view(np.int64))
            tallies[GRAM].add(grams_of(data, offs)[0])
            total += part.num_rows
        for kind, tally in tallies.items():
            tally.merge()
            for k in range(0, len(tally.keys), 100_000):
                keys, counts = tally.keys[k : k + 100_000], tally.counts[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], _COUNTED.names)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TOTAL], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], _COUNTED.names)

    return texts.mapInArrow(run, _COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: Stirling's series after eight steps of the recurrence."""
    y = x + 8
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


_NODE = "key long, zeros long, ones long, weighted double, own short, prior short"


def _noded(sums: DataFrame, depth: int) -> DataFrame:
    """(key, zeros, ones, below) -> nodes of a depth. below: the children's summed log probability, null at leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, zeros, ones = (b.column(k).to_numpy() for k in range(3))
            own = log_kt(zeros.astype(float), ones.astype(float))
            below = b.column(3).to_numpy(zero_copy_only=False).astype(float) if depth < DEPTH else own
            weighted = np.logaddexp(own, below) - np.log(2) if depth < DEPTH else own
            logit = np.log((ones + 0.5) / (zeros + 0.5))
            packed = [np.clip(np.rint(v * _STEP), -32767, 32767).astype(np.int16) for v in (logit, own - below)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, zeros, ones, weighted, *packed)], ["key", "zeros", "ones", "weighted", "own", "prior"])

    return sums.select("key", "zeros", "ones", "below").mapInArrow(run, _NODE)


def levels(grams: DataFrame) -> list[DataFrame]:
    """(key, n) of grams -> the nodes of each depth, from DEPTH to 0; each a written table."""
    bits = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"shiftright(key, {7 - k}) & 1").alias("bit"), F.expr(f"(shiftright(key, 8) << 8) | {1 << k} | shiftright(key & 255, {8 - k})").alias("node")) for k in range(8)]))
    split = grams.select("n", bits.alias("b")).groupBy(F.col("b.node").alias("key"))
    sums = split.agg(F.sum(F.when(F.col("b.bit") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("b.bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    sums = sums.withColumn("below", F.lit(None).cast("double"))
    out = []
    for depth in range(DEPTH, -1, -1):
        nodes = written(_noded(sums, depth), f"ctw{depth}")
        out.append(nodes)
        if depth:
            sums = nodes.groupBy(F.expr(f"key & {(1 << 8 * depth) - 1}L").alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    return out


def published(nodes: list[DataFrame]) -> list[tuple]:
    """Every node, from depth 0 up: keys in order, with their estimates and priors."""
    made = []
    for level in nodes:
        got = level.select("key", "own", "prior").toArrow()
        key, own, prior = (got.column(c).to_numpy() for c in ("key", "own", "prior"))
        order = np.argsort(key)
        made.append((key[order], own[order], prior[order]))
        del got, key, own, prior, order
        give_back()
    return made[::-1]


class Tree:
    """Published tables with a memory of grams already scored."""

    REMEMBERED = 20

    def __init__(self, tables: list[tuple]):
        self.levels = tables
        self.keys = np.full(1 << self.REMEMBERED, -1, np.int64)
        self.values = np.zeros(1 << self.REMEMBERED)

    def bit(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one."""
        p, met = np.full(len(node), 0.5), np.zeros(len(node), bool)
        for depth in range(DEPTH, -1, -1):
            keys, own, prior = self.levels[depth]
            if not len(keys):
                continue
            want = (context & ((1 << 8 * depth) - 1)) << 8 | node
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            seen = keys[at] == want
            kt = 1 / (1 + np.exp(-own[at] / _STEP))
            w = np.where(met, 1 / (1 + np.exp(-prior[at] / _STEP)), 1.0)
            p = np.where(seen, w * kt + (1 - w) * p, p)
            met |= seen
        return p

    def computed(self, code: np.ndarray) -> np.ndarray:
        context, byte, total = code >> 8, code & 255, np.zeros(len(code))
        for k in range(8):
            p = self.bit(context, (1 << k) | (byte >> (8 - k)))
            total += np.log10(np.where((byte >> (7 - k)) & 1 == 1, p, 1 - p))
        return total

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        slot = (mix(code.astype(np.uint64)) >> np.uint64(64 - self.REMEMBERED)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != code)
        out = self.values[slot]
        if len(miss):
            new, back = np.unique(code[miss], return_inverse=True)
            value = self.computed(new)
            out[miss] = value[back]
            at = (mix(new.astype(np.uint64)) >> np.uint64(64 - self.REMEMBERED)).astype(np.int64)
            self.keys[at] = new
            self.values[at] = value
        return out


def tallied(keys: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    """For each row its distinct keys, and how often it has each."""
    each = [np.unique(keys[a:b], return_counts=True) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return [pa.array([k for k, _ in each], pa.list_(pa.int64())), pa.array([n for _, n in each], pa.list_(pa.int64()))]


def joined_logs(grams: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(key) of distinct grams -> (key, log): what Tree.logs gives, by joins with the nodes of each depth."""
    bits = F.explode(F.array(*[F.struct(F.expr(f"shiftright(key, {7 - k}) & 1").alias("bit"), F.expr(f"(shiftright(key, 8) << 8) | {1 << k} | shiftright(key & 255, {8 - k})").alias("node")) for k in range(8)]))
    split = grams.select("key", bits.alias("b")).select("key", "b.bit", "b.node")
    p, met = F.lit(0.5), F.lit(False)
    asked = split.select("node").distinct()
    logistic = lambda c: 1 / (1 + F.exp(-F.col(c) / F.lit(_STEP)))
    for depth, level in zip(range(DEPTH, -1, -1), nodes, strict=True):
        have = level.select(F.col("key").alias("at"), F.col("own").alias(f"own{depth}"), F.col("prior").alias(f"prior{depth}"))
        asked = asked.join(have, F.expr(f"node & {(1 << 8 * depth + 8) - 1}L") == F.col("at"), "left").drop("at")
        seen, w = F.col(f"own{depth}").isNotNull(), F.when(met, logistic(f"prior{depth}")).otherwise(1.0)
        asked = asked.withColumn("p", F.when(seen, w * logistic(f"own{depth}") + (1 - w) * p).otherwise(p)).withColumn("met", met | seen).drop(f"own{depth}", f"prior{depth}")
        p, met = F.col("p"), F.col("met")
    one = F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return split.join(asked.select("node", "p"), "node").groupBy("key").agg(F.sum(one).alias("log"))


def score(docs: DataFrame, counts: DataFrame, *, broadcast_words: int = BROADCAST_WORDS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """docs (its first two columns: an id and a text) -> the id, n_tokens, n_known, train_tokens, n_bytes, base_score, score.

    counts: counted() of the training texts, as a written table.
    """
    spark, kept = docs.sparkSession, docs.schema.fields[0]
    told = {r["kind"]: (r["rows"], r["n"]) for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    ends = told.get(TOTAL, (0, 0))[1]
    distinct = told.get(WORD, (0, 0))[0] + (ends > 0)
    total = told.get(WORD, (0, 0))[1] + ends
    nodes = levels(counts.where(F.col("kind") == GRAM).select("key", "n"))
    held = sum(level.count() for level in nodes) <= broadcast_nodes
    tree = spark.sparkContext.broadcast(published(nodes)) if held else None
    vocabulary = counts.where(F.col("kind") == WORD).select("key", "n")
    near = told.get(WORD, (0, 0))[0] <= broadcast_words
    shared = None
    if near:
        got = vocabulary.toArrow()
        key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
        order = np.argsort(key)
        shared = spark.sparkContext.broadcast((key[order], n[order].astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64)))
        del got, key, n, order
        give_back()
    below = float(total + distinct + 1)
    end_log = float(np.log10((ends + 1) / below))
    number = T.LongType()
    fields = [kept, T.StructField("n_tokens", number), T.StructField("n_known", number), T.StructField("train_tokens", number), T.StructField("n_bytes", number), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    listed = [T.StructField(c, T.ArrayType(number)) for c in (() if near else ("words", "times")) + (() if held else ("grams", "often"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tree(tree.value) if held else None
        known = shared.value if near else None
        for part in slices(batches, 1):
            data, offs = buffers(part.column(1))
            code, begin = grams_of(data, offs)
            scored = np.add.reduceat(model.logs(code), begin[:-1]) if held else np.zeros(part.num_rows)
            _, _, h, of = words(data, offs, SPACED, FOLD)
            h, rows = h.view(np.int64), part.num_rows
            row = np.repeat(np.arange(rows), np.diff(of))
            cols = [part.column(0), pa.array(np.diff(of) + 1)]
            hits, base, lists = np.full(rows, int(ends > 0)), np.full(rows, end_log), []
            if near:
                order = np.argsort(h)
                c = np.zeros(len(h), np.int64)
                if len(known[0]):
                    at = np.minimum(np.searchsorted(known[0], h[order]), len(known[0]) - 1)
                    c[order] = np.where(known[0][at] == h[order], known[1][at], 0)
                hits = hits + np.bincount(row, c > 0, rows).astype(np.int64)
                base = base + np.bincount(row, np.log10((c + 1.0) / below), rows)
            else:
                lists += tallied(h, of)
            if not held:
                lists += tallied(code, begin)
            cols += [pa.array(hits, pa.int64()), pa.array(np.full(rows, total, np.int64)), pa.array(np.diff(offs)), pa.array(base), pa.array(scored)]
            yield pa.RecordBatch.from_arrays(cols + lists, [f.name for f in fields + listed])

    if near and held:
        return docs.mapInArrow(run, T.StructType(fields))
    whole = written(docs.mapInArrow(run, T.StructType(fields + listed)).withColumn("row", F.monotonically_increasing_id()), "ctw_lists")
    both, plus = whole.drop(*[f.name for f in listed]), {}
    if not near:
        each = whole.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
        met = each.join(vocabulary, "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
        both = both.join(met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(below))).alias("b")), "row", "left")
        plus |= {"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("b", F.lit(0.0))}
    if not held:
        each = whole.select("row", F.explode(F.arrays_zip("grams", "often")).alias("g")).select("row", F.col("g.grams").alias("key"), F.col("g.often").alias("often"))
        logs = written(joined_logs(each.select("key").distinct(), nodes), "ctw_logs")
        both = both.join(each.join(logs, "key").groupBy("row").agg(F.sum(F.col("often") * F.col("log")).alias("s")), "row", "left")
        plus["score"] = F.col("score") + F.coalesce("s", F.lit(0.0))
    return both.select(*[plus[f.name].alias(f.name) if f.name in plus else F.col(f.name) for f in fields])


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = written(counted(docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD).select("text")), "counts")
    scored = score(docs, counts)
    per_byte = -F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", per_byte.alias("bits_per_byte"))
