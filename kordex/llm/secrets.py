"""Secret scans: patterns, and a battery of randomness tests for what the patterns do not name.

Runs of encoded-looking characters get an encoding (the smallest of some alphabets that holds them) and
become numbers. Three tests ask whether they look drawn at random from that alphabet: chi-squared over
the whole alphabet, Wald-Wolfowitz runs about the middle, and lag-one serial correlation.
A run that fails one (Bonferroni) is ordinary text. For the rest, the likelihood of the run as ordinary text
(a chain of lower case, capitals, digits and signs, with common and rare letters; text all in capitals as if in lower case) over that of a uniform
draw bounds the probability that ordinary text looks as random, and falls with the length. It goes through
the Benjamini-Hochberg procedure over the tested runs of the document, which bounds the share of false finds.
Plain numbers and runs of signs are not tested. A run that fits no encoding is tested in pieces, between
the signs of one alphabet and between those of the other.

Defined results: a null or empty text has no spans (empty strings, zero counts, the hash of the empty
text); spans are in code points, end exclusive; a run that a pattern already covers is not reported
again; of parts that overlap with the same likelihood the first is told; repeated rows scan alike; a very long text is
scanned whole; an empty table gives an empty result; extra columns pass through redact() and are ignored otherwise.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import buffers, spans
from .common import slices, table

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Runs of fewer characters say too little; level of the battery; share of false finds.
LEAST_RANDOM, LEVEL, FALSE_SHARE = 20, 0.01, 0.01

_UP, _LOW, _NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (("hex", _NUM + "abcdef"), ("HEX", _NUM + "ABCDEF"), ("base32", _UP + "234567"), ("base36", _NUM + _LOW), ("base64", _UP + _LOW + _NUM + "+/"), ("base64url", _UP + _LOW + _NUM + "-_"))
_VALUES = [(name, {c: i for i, c in enumerate(chars)}, frozenset(chars)) for name, chars in ENCODINGS]


#: Ordinary text: which class (lower case, capital, digit, sign) begins it and follows which, and the share of each sign in its class.
_CLASS = {c: k for k, chars in enumerate((_LOW, _UP, _NUM, "+/-_")) for c in chars}
_BEGINS = np.log([0.5, 0.3, 0.15, 0.05])
_FOLLOWS = np.log([[0.85, 0.04, 0.03, 0.08], [0.45, 0.42, 0.05, 0.08], [0.06, 0.05, 0.77, 0.12], [0.5, 0.25, 0.2, 0.05]])
_SHARE = {c: math.log(0.8 / 12 if c.lower() in "etaoinshrdlu" else 0.2 / 14) for c in _LOW + _UP} | {c: math.log(0.1) for c in _NUM} | {c: math.log(0.5) for c in "+/-_"}


def _bytes_in(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[list(chars.encode())] = True
    return m


_HEX, _RUN = _bytes_in(_NUM + "abcdef"), _bytes_in(_UP + _LOW + _NUM + "+/-_")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")


def infer(run: str) -> tuple[str, np.ndarray, int] | None:
    """(encoding, values, size of its alphabet), or None for no encoding, for plain numbers and for signs alone."""
    seen = set(run)
    if seen <= set(_NUM + "+/-_"):
        return None
    for name, values, chars in _VALUES:
        if seen <= chars:
            return name, np.array([values[c] for c in run], dtype=np.float64), len(chars)
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(x: np.ndarray, size: int) -> tuple[float, float]:
    """Chi-squared over every letter of the alphabet, with its upper p-value.

    Runs may be shorter than the alphabet, so the statistic's own mean and variance among uniform draws (size - 1 and
    2 (size - 1)(n - 1) / n) set a gamma distribution, whose tail follows by the cube root of Wilson and Hilferty.
    """
    n = len(x)
    count = np.bincount(x.astype(int), minlength=size)
    chi2 = float((count * count).sum()) * size / n - n
    mean, shape = size - 1, (size - 1) * n / (2 * max(n - 1, 1))
    return chi2, 0.5 * math.erfc(((chi2 / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape) / math.sqrt(2))


def battery(x: np.ndarray, size: int) -> tuple[float, float, float, float]:
    """Statistic and p-values of chi-squared uniformity, runs, and serial correlation."""
    n = len(x)
    chi2, uniform = uniformity(x, size)
    high = x >= size / 2
    up, down = int(high.sum()), int(n - high.sum())
    mean, var = 2 * up * down / n + 1, 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
    runs = 1 + int((high[1:] != high[:-1]).sum())
    by_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    d = x - x.mean()
    total = float((d * d).sum())
    serial = _two_sided((float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total > 0 else 0.0
    return chi2, uniform, by_runs, serial


def ordinary(run: str, size: int) -> float:
    """Bound on the probability that ordinary text looks as drawn from an alphabet of this size: the ratio of its likelihoods."""
    kinds = np.array([_CLASS[c] for c in (run.lower() if run.isupper() else run)])
    told = _BEGINS[kinds[0]] + _FOLLOWS[kinds[:-1], kinds[1:]].sum() + sum(_SHARE[c] for c in run)
    return math.exp(min(0.0, told + len(run) * math.log(size)))


def pieces(run: str) -> list[tuple[int, int]]:
    """The parts of a run to test: all of it, or, if it mixes signs of two alphabets, what is long enough between either's."""
    signs = set(run) - set(_UP + _LOW + _NUM)
    if not (signs & set("+/") and signs & set("-_")):
        return [(0, len(run))]
    return sorted({m.span() for at in (r"[^+/]+", r"[^_-]+") for m in re.finditer(at, run) if m.end() - m.start() >= LEAST_RANDOM})


def random_spans(runs: list[str]) -> list[tuple[int, int, int]]:
    """(number of the run, start, end) of the random parts of a document's runs: those that pass the battery and then the
    false-discovery control over all that were tested. Of parts that overlap the likelier one is told."""
    left, tested = [], 0
    for i, run in enumerate(runs):
        for a, b in pieces(run):
            if (found := infer(run[a:b])) is None:
                continue
            tested += 1
            if 3 * min(battery(found[1], found[2])[1:]) >= LEVEL:
                left.append((ordinary(run[a:b], found[2]), i, a, b))
    left.sort()
    taken = max((k + 1 for k, (p, *_) in enumerate(left) if p <= FALSE_SHARE * (k + 1) / tested), default=0)
    kept: dict[int, list[tuple[int, int]]] = {}
    for _, i, a, b in left[:taken]:
        own = kept.setdefault(i, [])
        if not any(x < b and a < y for x, y in own):
            own.append((a, b))
    return sorted((i, a, b) for i, own in kept.items() for a, b in own)


def discoveries(runs: list[str]) -> list[int]:
    """Which runs of a document are random, or hold a random part."""
    return sorted({i for i, _, _ in random_spans(runs)})


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns; hexes: the hexadecimal runs that are long enough."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(a, b, 2) for a, b in hexes]


def scan(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, end, kind) by start, then kind. Only texts with a run or a keyword are decoded."""
    data, offs = buffers(texts)
    raw = data.tobytes()
    hits: dict[int, tuple[list, list]] = {}

    def at(place: int) -> tuple[list, list]:
        return hits.setdefault(int(np.searchsorted(offs, place, "right")) - 1, ([], []))

    for k, (inside, least) in enumerate(((_HEX, LEAST_HEX), (_RUN, LEAST_RANDOM))):
        start, end = spans(data, offs, inside)
        far = end - start >= least
        for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True):
            at(a)[k].append((a, b))
    low = raw.lower()
    for word, where in ((b"AKIA", raw), *((w, low) for w in _WORDS)):
        place = where.find(word)
        while place >= 0:
            at(place)
            row = int(np.searchsorted(offs, place, "right")) - 1
            place = where.find(word, int(offs[row + 1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for row, (hexes, runs) in hits.items():
        lo, hi = int(offs[row]), int(offs[row + 1])
        own = raw[lo:hi]
        text = own.decode("utf-8", "replace")
        if text.isascii():
            shifted = lambda ps, lo=lo: [(a - lo, b - lo) for a, b in ps]
        else:
            before = np.concatenate(([0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)))
            shifted = lambda ps, lo=lo, before=before: [(int(before[a - lo]), int(before[b - lo])) for a, b in ps]
        found = base_spans(text, shifted(hexes))
        covered = sorted((a, b) for a, b, _ in found)
        free = [(a, b) for a, b in shifted(runs) if not any(x < b and a < y for x, y in covered)] if len(covered) < 8 else _free(shifted(runs), covered)
        found += [(free[i][0] + a, free[i][0] + b, 3) for i, a, b in random_spans([text[a:b] for a, b in free])]
        out[row] = sorted(found, key=lambda s: (s[0], s[2]))
    return out


def _free(runs: list[tuple[int, int]], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that meet no covered span; both are in order."""
    reach, merged = -1, []
    for a, b in covered:
        if a > reach:
            merged.append([a, b])
        merged[-1][1] = reach = max(reach, b)
    starts = [a for a, _ in merged]
    kept = []
    for a, b in runs:
        k = int(np.searchsorted(starts, b, "left")) - 1
        if k < 0 or merged[k][1] <= a:
            kept.append((a, b))
    return kept


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs (its first two columns: an id and a text) -> the id, found: array of (start, end, kind)."""
    kept = docs.schema.fields[0]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for part in slices(batches, 1):
            found = pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in row] for row in scan(part.column(1))], kind)
            yield pa.RecordBatch.from_arrays([part.column(0), found], [kept.name, "found"])

    return docs.mapInArrow(run, T.StructType([kept, T.StructField("found", T.ArrayType(span))]))


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by a mark (overlapping spans by one), and its length column brought up to date."""
    names = docs.columns
    at = names.index(text_col)
    counted = names.index(count_col) if count_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            found = scan(part.column(at))
            if any(found):
                texts = part.column(at).to_pylist()
                lengths = part.column(counted).to_pylist() if counted is not None else None
                for i, row in enumerate(found):
                    if row:
                        texts[i] = replaced(texts[i], row, mark)
                        if lengths is not None:
                            lengths[i] = len(texts[i])
                cols = list(part.columns)
                cols[at] = pa.array(texts, part.schema.field(at).type)
                if lengths is not None:
                    cols[counted] = pa.array(lengths, part.schema.field(counted).type)
                part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
            yield part

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    out, reach = [], 0
    for a, b, _ in found:
        if a >= reach:
            out += [text[reach:a], mark]
        reach = max(reach, b)
    return "".join([*out, text[reach:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["kind"] != "random"), line), ",")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"),
    )
