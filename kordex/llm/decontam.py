"""Benchmark decontamination by an FM-index of each shard of the training texts.

A shard is a run of whole documents of about common.SLICE_BYTES; a text of more than SHARD_WORDS words is dealt over
shards that overlap by a window. Its words become numbers, and the whole of it gets
a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All windows
(phrases of WINDOW words; shorter items whole) are searched backwards together; the positions
found give hit words, merged into spans to remove.

The benchmark is dealt into blocks of about BLOCK_BYTES of text, and tasks make each block's table of windows; the driver
passes one on at a time. A benchmark of several blocks takes more passes over the texts, chained in one plan.
Words are compared by 64-bit hashes.

Defined results: a null text, or one without words, has no hits; so has every document if the benchmark is
empty; items without words never occur; rows of one item_id count as one item, a null one as an item
without a name; repeated rows are judged alike; a very long text gives what it would in one shard; an empty documents table gives an
empty result; extra columns pass through removed().
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM, FOLD, buffers, words
from .common import free_name, slices, table, written

WINDOW, BLOCK_BYTES, SAMPLING, SHARD_WORDS = 10, 4 << 20, 8, 1 << 19
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrases:
    """The windows of a block of items: vocabulary, windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        _, _, h, of = words(*buffers(pa.array([t for _, t in items], pa.string())), ALNUM, FOLD)
        self.names = sorted({i or "" for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        owner = np.repeat(np.array([number[i or ""] for i, _ in items], np.int64), np.diff(of))
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int32)
        size = np.diff(of)
        self.groups = []
        for width in np.unique(np.minimum(size, window)).tolist():
            some = np.flatnonzero(np.minimum(size, window) == width)
            if not width:
                continue
            n = size[some] - width + 1
            begin = np.repeat(of[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = np.lib.stride_tricks.sliding_window_view(ids, width)[begin]
            windows, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner[begin]], axis=1), axis=0)
            ends = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
            self.groups.append((width, windows, ends, pairs[:, 1]))

    def within(self, alphabet: np.ndarray) -> np.ndarray:
        """The number of each word of the vocabulary in a sorted alphabet of hashes, from 1; 0 if it is not there."""
        if not len(self.vocabulary) or not len(alphabet):
            return np.zeros(len(self.vocabulary), np.int64)
        at = np.minimum(np.searchsorted(alphabet, self.vocabulary), len(alphabet) - 1)
        return np.where(alphabet[at] == self.vocabulary, at + 1, 0)


class FMIndex:
    """Of runs of positive numbers, each ended by a 0 that equals no other 0."""

    def __init__(self, text: np.ndarray, run_start: np.ndarray):
        n = self.n = len(text)
        zero = text == 0
        rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()) - 1).astype(np.int64)
        order, unsure, k = np.arange(n), np.arange(n), 0
        while len(unsure):  # places of suffixes that equal a neighbour in their first k symbols; unlike zeros end each run, so none is left
            some = order[unsure]
            key = rank[some] * (2 * n + 2) + (rank[some + k] if k else 0)
            by = np.argsort(key)
            some, key = some[by], key[by]
            order[unsure] = some
            first = np.concatenate(([True], key[1:] != key[:-1]))
            rank[some] = np.repeat(unsure[first], np.diff(np.append(np.flatnonzero(first), len(key))))
            alone = first & np.append(first[1:], True)
            unsure, k = unsure[~alone], max(1, 2 * k)
        suffixes = order
        bwt = text[suffixes - 1]
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.bits = max(1, int(text.max()).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        row = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((ones, n - int(ones[-1])))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.bwt = bwt
        sampled = (suffixes - run_start[suffixes]) % SAMPLING == 0
        self.marked = sampled
        self.before = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = suffixes[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        lo = np.zeros_like(at)
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            bit = ((symbol >> b) & 1).astype(bool)
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64)
            lo[live] = self.less[c] + self.rank(c, lo[live])
            hi[live] = self.less[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, from the nearest sampled ones. Run starts are sampled, so no walk leaves its run."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.samples[self.before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.bwt[at]
            at = self.less[c] + self.rank(c, at)
            steps += 1
        return out


def find(phrases: Phrases, texts: pa.Array, most: int = SHARD_WORDS) -> tuple[np.ndarray, list[tuple[list, list]]]:
    """Words of each text, and its (merged spans of word numbers, names of items)."""
    _, _, h, of = words(*buffers(texts), ALNUM, FOLD)
    none: list[tuple[list, list]] = [([], []) for _ in range(len(of) - 1)]
    size = np.diff(of)
    if not len(h) or not phrases.groups:
        return size, none
    depth, pairs = np.zeros(len(h) + 1, np.int64), []
    row_of = np.repeat(np.arange(len(size)), size)
    beyond = phrases.groups[-1][0] - 1
    for lo in range(0, len(h), most):  # a window that begins in a shard ends in it
        hi = min(len(h), lo + most + beyond)
        for at, width, item in occurrences(phrases, h[lo:hi], np.clip(of, lo, hi) - lo):
            np.add.at(depth, at + lo, 1)
            np.add.at(depth, at + lo + width, -1)
            pairs.append(np.unique(np.stack([np.repeat(row_of[at + lo], np.diff(item[0])), item[1]]), axis=1))
    hit = np.cumsum(depth[:-1]) > 0
    edge = hit.copy()
    edge[1:] &= ~hit[:-1]
    edge[of[:-1][size > 0]] |= hit[of[:-1][size > 0]]
    for a in np.flatnonzero(edge).tolist():
        stop = int(of[row_of[a] + 1])
        b = a + int(np.argmin(hit[a:stop])) if not hit[a:stop].all() else stop
        none[row_of[a]][0].append((a - int(of[row_of[a]]), b - int(of[row_of[a]])))
    if pairs:
        for r, k in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            none[r][1].append(phrases.names[k])
    return size, none


def occurrences(phrases: Phrases, h: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, int, tuple[np.ndarray, np.ndarray]]]:
    """Where the windows occur in a shard (h: hashes of its words, of: where texts begin): for each length the first words,
    the length, and the items of each occurrence (where they begin, and their numbers)."""
    alphabet, ids = np.unique(h, return_inverse=True)
    number = phrases.within(alphabet)
    groups = [(width, number[windows], begin, owners) for width, windows, begin, owners in phrases.groups]
    if not any((w > 0).all(axis=1).any() for _, w, _, _ in groups):
        return
    full = np.diff(of)[np.diff(of) > 0]
    ends = np.cumsum(full + 1)  # a 0 ends each text
    text = np.zeros(ends[-1], np.int64)
    text[np.delete(np.arange(ends[-1]), ends - 1)] = ids + 1
    place = np.arange(ends[-1]) - np.repeat(np.arange(len(full)), full + 1)  # the number of each symbol's word
    index = FMIndex(text, np.repeat(ends - full - 1, full + 1))
    for width, windows, begin, owners in groups:
        some = np.flatnonzero((windows > 0).all(axis=1))
        if not len(some):
            continue
        lo, hi = index.search(windows[some])
        n = hi - lo
        if not n.sum():
            continue
        which = np.repeat(np.arange(len(some)), n)
        at = place[index.locate(np.arange(n.sum()) - (np.cumsum(n) - n)[which] + lo[which])]
        k = begin[some[which] + 1] - begin[some[which]]
        starts = np.concatenate(([0], np.cumsum(k)))
        yield at, width, (starts, owners[np.arange(starts[-1]) - np.repeat(starts[:-1], k) + np.repeat(begin[some[which]], k)])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES, window: int = WINDOW) -> list:
    """Broadcasts of the windows of items, a block of about `limit` bytes of text each, dealt by a hash of the id.

    Tasks make the tables of windows. The driver passes them on one after the other and keeps none of them.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, item, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault(k, []).append((item, text))
        for rows in held.values():
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Phrases(rows, window))], pa.binary())], ["phrases"])

    dealt = items.select(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(""))), F.lit(n)).cast("int").alias("block"), "item_id", "text").repartition(n, "block")
    found = [spark.sparkContext.broadcast(bytes(r["phrases"])) for r in dealt.mapInArrow(run, "phrases binary").toLocalIterator()]
    return found or [spark.sparkContext.broadcast(pickle.dumps(Phrases([], window)))]


_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def find_passages(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (its first two columns: an id and a text) -> both, n_words, spans (merged, word numbers), items (names)."""
    fields, todo = docs.schema.fields[:2], blocks(benchmark, block_bytes, window)
    found = docs.select(*[f.name for f in fields])
    for k, shared in enumerate(todo):
        keep = keep_text or k + 1 < len(todo)
        schema = T.StructType([*fields[: 2 if keep else 1], *_FOUND])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=k > 0, keep=keep, names=tuple(schema.names)) -> Iterator[pa.RecordBatch]:
            phrases = pickle.loads(shared.value)
            for part in slices(batches, 1):
                size, rows = find(phrases, part.column(1))
                spans, items = [s for s, _ in rows], [i for _, i in rows]
                if again:
                    old = [[(x["first"], x["end"]) for x in s] for s in part.column(3).to_pylist()]
                    spans = [merged(a + b) for a, b in zip(old, spans, strict=True)]
                    items = [a + b for a, b in zip(part.column(4).to_pylist(), items, strict=True)]
                made = [pa.array(size, pa.int64()), pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: 2 if keep else 1], *made], list(names))

        found = found.mapInArrow(run, schema)
    return found


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans; what stood between them goes too."""
    places = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    out, reach = [], 0
    for a, b in spans:
        out.append(text[reach : places[a][0]])
        reach = places[b - 1][1]
    return "".join([*out, text[reach:]])


def removed(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with every hit span cut out of the text and the length column brought up to date.

    What a cut joins may be a hit again, so texts that were cut are searched until none is left. With one block of
    items that happens where the text is; with more, the rows that were cut are written and searched again.
    A document whose hits were all its words goes altogether.
    """
    names = docs.columns
    whole = free_name(names, "whole_row")
    packed = docs.select(F.struct(*[F.col(c) for c in names if c != text_col]).alias(whole), F.col(text_col))
    todo = blocks(benchmark, block_bytes, window)
    row_type, text_type = packed.schema[0].dataType, T.StringType()
    schema = T.StructType([T.StructField("row", row_type), T.StructField("text", text_type), T.StructField("kept", T.BooleanType()), T.StructField("again", T.BooleanType())])

    def cleaned(rows: DataFrame) -> DataFrame:
        for k, shared in enumerate(todo):

            def run(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
                phrases = pickle.loads(shared.value)
                for part in slices(batches, 1):
                    texts, keep, cuts = part.column(1).to_pylist(), [True] * part.num_rows, [False] * part.num_rows
                    if not first:
                        keep, cuts = part.column(2).to_pylist(), part.column(3).to_pylist()
                    live = [i for i in range(part.num_rows) if keep[i]]
                    while live:
                        size, found = find(phrases, pa.array([texts[i] for i in live], pa.string()))
                        live, old = [], live
                        for i, n, (pairs, _) in zip(old, size.tolist(), found, strict=True):
                            if pairs:
                                texts[i], cuts[i] = cut(texts[i], pairs), True
                                keep[i] = sum(b - a for a, b in pairs) < n
                                live += [i] * keep[i]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(keep), pa.array(cuts)], ["row", "text", "kept", "again"])

            rows = rows.mapInArrow(run, schema)
        return rows.where("kept")

    clean = cleaned(packed)
    if len(todo) > 1:  # a later block's cuts may have joined what an earlier block holds
        rest = written(clean, "cut")
        clean = rest.where("not again")
        while not (cut_again := rest.where("again")).isEmpty():
            rest = written(cleaned(cut_again.select("row", "text")), "cut")
            clean = clean.unionByName(rest.where("not again"))
    touched = {c: F.col("row").getField(c) for c in names if c != text_col} | {text_col: F.col("text")}
    if count_col in names:
        touched[count_col] = F.when(F.col("text").isNull(), F.col("row").getField(count_col)).otherwise(F.length("text").cast(docs.schema[count_col].dataType))
    return clean.select(*[touched[c].alias(c) for c in names])


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
with d as (
  select doc_id, row_number() over () as r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), b as (
  select cast(item_id as varchar) as item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark
), bw as (
  select distinct item, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)
), ks as (select distinct k from bw), dw as (
  select r, k, i, array_to_string(w[i : i + k - 1], ' ') as g
  from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, ks where len(w) >= k)
), occ as (select dw.r, dw.i, dw.k, bw.item from dw join bw on dw.g = bw.g and dw.k = bw.k),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + k - 1)) as p from (select distinct r, i, k from occ)) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from occ) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit.n_hit, 0) as bigint) as n_hit, cast(coalesce(its.n_items, 0) as bigint) as n_items,
  sha256(coalesce(its.names, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join its using (r)
"""
