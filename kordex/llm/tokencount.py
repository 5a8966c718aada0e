"""Token counts by a compiled tokenizer.

The tokenizer file (a BPE with word ends behind a splitting rule) becomes two machines. The outer one is
a deterministic automaton over character classes; its transitions say where pre-tokens end. Its state
maps are closed under composition, so all maps that any chunk of text can have are numbered beforehand
and composed by a table: each chunk of a text gets its map in one sweep, a parallel prefix scan composes
the maps, and with the entry states known a second sweep runs all chunks at once. The inner machine
returns to its start state at every pre-token end; the transition that ends a pre-token emits its number
of tokens. That annotation is compiled on demand from the merge ranks, for many words together, and
kept in a table of fixed size.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows count alike; extra columns
are ignored; an empty table gives an empty result. No text is cut or capped: very long ones only
make longer arrays.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import mix
from .common import slices, table

LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"
CHUNK, CACHE_BITS, WIDE, NONE = 128, 20, 48, np.iinfo(np.int32).max

# Classes of characters: white space, number, other, apostrophe, letter, and the letters of contractions.
S, N, O, QUOTE, L, STMD, RV, E, LL = range(9)
# States: at a border, in letters, in others, after an apostrophe that began a pre-token, after 'r or 'v, after 'l.
BORDER, LETTERS, OTHERS, QUOTED, QUOTED_RV, QUOTED_L = range(6)
HERE, EARLIER = 1, 2  # a pre-token begins at this character; at the one before it
#: The characters that the splitting rule takes as white space.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by (state, class) of the rule 's|'t|'re|'ve|'m|'ll|'d|letters|number|others."""
    nxt, out = np.zeros((6, 9), np.uint8), np.zeros((6, 9), np.uint8)
    for state in range(6):
        for c in range(9):
            letter = c >= L
            target = BORDER if c in (S, N) else LETTERS if letter else QUOTED if c == QUOTE else OTHERS
            mark = 0 if c == S else HERE
            if state == LETTERS and letter:
                mark = 0
            elif state == OTHERS and c in (O, QUOTE):
                target, mark = OTHERS, 0
            elif state == QUOTED:
                if c in (O, QUOTE):
                    target, mark = OTHERS, 0
                elif c == STMD:
                    target, mark = BORDER, 0
                elif c in (RV, LL):
                    target, mark = QUOTED_RV if c == RV else QUOTED_L, 0
            elif state in (QUOTED_RV, QUOTED_L):
                if c == (E if state == QUOTED_RV else LL):
                    target, mark = BORDER, 0
                else:
                    mark = EARLIER | (0 if letter else mark)
            nxt[state, c], out[state, c] = target, mark
    return nxt, out


@functools.cache
def compiled() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next, output, maps, by class, product): all state maps that texts can have, numbered from the identity 0.

    by class[m, c] is map m followed by a character of class c; product[a, b] is a followed by b.
    """
    nxt, out = machine()
    maps, number, todo = [tuple(range(6))], {tuple(range(6)): 0}, 0
    step: list[list[int]] = []
    while todo < len(maps):
        row = []
        for c in range(9):
            made = tuple(int(nxt[s, c]) for s in maps[todo])
            if made not in number:
                number[made] = len(maps)
                maps.append(made)
            row.append(number[made])
        step.append(row)
        todo += 1
    product = np.array([[number[tuple(b[s] for s in a)] for b in maps] for a in maps], dtype=np.int32)
    return nxt, out, np.array(maps, np.uint8), np.array(step, np.int32), product


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    found = np.full(0x110000, O, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            found[code] = L
        elif kind == "N":
            found[code] = N
    found[list(SPACES)] = S
    for chars, c in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", LL)):
        found[[ord(x) for x in chars]] = c
    return found


def starts(cls: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a run of classes that ends with a white space. White space itself is not marked."""
    nxt, out, maps, step, product = compiled()
    n = len(cls)
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    whole = np.zeros(rows, np.int32)
    for column in grid:
        whole = step[whole, column]
    gap = 1
    while gap < rows:  # after this loop whole[i] is the map of all chunks up to i
        whole[gap:] = product[whole[:-gap], whole[gap:]]
        gap *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[whole[:-1], BORDER]
    marks = np.empty((CHUNK, rows), np.uint8)
    for k, column in enumerate(grid):
        marks[k] = out[state, column]
        state = nxt[state, column]
    flat = marks.T.reshape(-1)[:n]
    begin = (flat & HERE).astype(bool)
    begin[:-1] |= (flat[1:] & EARLIER).astype(bool)
    return begin & (cls != S)


class Words:
    """The inner machine: numbers of tokens of pre-tokens, from merge ranks."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab = model["model"]["vocab"]
        ids = {t: i for i, t in enumerate(vocab)}
        end = model["model"]["end_of_word_suffix"] or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
        self.inner = np.array([ids[names[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[names[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["model"]["merges"]]
        codes = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        self.special = [x["content"] for x in model["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.keys, self.counts = np.zeros(1 << CACHE_BITS, np.uint64), np.zeros(1 << CACHE_BITS, np.int32)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def count_many(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, words of like length together."""
        size = np.array([len(w) for w in words])
        found = np.ones(len(words), np.int64)
        for lo, hi in ((2, 8), (8, 12), (12, 18), (18, 28), (28, WIDE + 1)):
            rows = np.flatnonzero((size >= lo) & (size < hi))
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                found[part] = self._merged([words[i] for i in part], hi - 1)
        for i in np.flatnonzero(size > WIDE):
            found[i] = self.count_long(words[i])
        return found

    def _merged(self, words: list[bytes], width: int) -> np.ndarray:
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        place = np.arange(width)
        sym = np.where(place < size[:, None], self.inner[raw], -1)
        rows = np.arange(len(words))
        sym[rows, size - 1] = self.last[raw[rows, size - 1]]
        rank = np.full((len(words), width), NONE, np.int32)
        rank[:, :-1] = self.ranked(sym[:, :-1], sym[:, 1:])
        left, who = size.copy(), rows
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            live = best != NONE
            if not live.any():
                return left
            sym, rank, at, best, who = sym[live], rank[live], at[live], best[live], who[live]
            left[who] -= 1
            rows = np.arange(len(sym))
            sym[rows, at] = self.made[best]
            shift = np.minimum(place + (place > at[:, None]), width - 1)
            sym, rank = np.take_along_axis(sym, shift, 1), np.take_along_axis(rank, shift, 1)
            sym[:, -1], rank[:, -1] = -1, NONE
            nextto = np.minimum(at + 1, width - 1)
            rank[rows, at] = np.where(at + 1 < width, self.ranked(sym[rows, at], sym[rows, nextto]), NONE)
            some = at > 0
            rank[rows[some], at[some] - 1] = self.ranked(sym[rows[some], at[some] - 1], sym[rows[some], at[some]])

    def count_long(self, word: bytes) -> int:
        """Tokens of one word by a heap of ranked pairs: n log n for a word of n bytes."""
        n = len(word)
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            left -= 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := self.rank.get(sym[x] << 32 | sym[y])) is not None:
                    heapq.heappush(heap, (q, x, sym[x], sym[y]))
        return left

    def counts_of(self, text: str, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of text[a:b] for each pair; code: the text's code points."""
        h = _hashes(code, a, b)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        slot = (keys & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64)
        found = self.counts[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            at = first[miss]
            new = self.count_many([text[i:j].encode("utf-8", "replace") for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)])
            found[miss] = new
            self.keys[slot[miss]] = keys[miss]
            self.counts[slot[miss]] = new
            # two new words may share a slot: the later assignment wins in both arrays alike
        return found[back]

    def count_texts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        plain = []
        for i, t in enumerate(texts):
            t = t or ""
            if self.split is not None and "<" in t:
                pieces = self.split.split(t)
                extra[i] = len(pieces) - 1
                plain.append(" ".join(normal(p) for p in pieces))
            else:
                plain.append(normal(t))
        joined = " ".join(plain) + " "
        offs = np.concatenate(([0], np.cumsum([len(t) + 1 for t in plain])))
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = classes()[code]
        begin = starts(cls)
        a = np.flatnonzero(begin)
        stop = begin.copy()
        stop[1:] |= (cls[1:] == S) & (cls[:-1] != S)
        ends = np.flatnonzero(stop)
        b = ends[np.searchsorted(ends, a, "right")] if len(a) else a
        counts = self.counts_of(joined, code, a, b) if len(a) else np.zeros(0, np.int64)
        row = np.searchsorted(offs, a, "right") - 1
        return extra + np.bincount(row, counts, len(texts)).astype(np.int64)[: len(texts)]


def normal(t: str) -> str:
    """NFC, then lower case character by character (white space is handled by its class)."""
    if t.isascii():
        return t.lower()
    if not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
    return t.replace("Σ", "σ").lower()


_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _hashes(code: np.ndarray, a: np.ndarray, b: np.ndarray, segment: int = 1 << 20) -> np.ndarray:
    out = np.empty(len(a), np.uint64)
    i = 0
    while i < len(a):
        lo = a[i]
        j = max(i + 1, int(np.searchsorted(b, lo + segment, "right")))
        hi = int(b[j - 1])
        p, q = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((mix(code[lo:hi].astype(np.uint64) + np.uint64(77)) | np.uint64(1)) * p[:-1], out=total[1:])
        x, y = a[i:j] - lo, b[i:j] - lo
        out[i:j] = mix((total[y] - total[x]) * q[x] + (y - x).astype(np.uint64))
        i = j
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _power_table(1 << max(16, (int(n) - 1).bit_length()))
    return p[:n], q[:n]


@functools.lru_cache(maxsize=2)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (_P, _Q):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    return made[0], made[1]


_loaded: dict[str, Words] = {}


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs (its first two columns: an id and a text) -> the id, n_bytes, n_tokens.

    tokenizer: the path of a tokenizer file on every executor; None: the package of public tokenizers finds it there.
    """
    kept = docs.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        if path not in _loaded:
            _loaded[path] = Words(path)
        for part in slices(batches, 1):
            texts = part.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = _loaded[path].count_texts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(counts, pa.int64())], [kept.name, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
