"""Values of extra columns, also of those named like a column that an operator makes; ties; seams of removed passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kordex.llm import decontam, jaccard, learning, mixing, secrets, warc

NAMES = ("keep_row", "keep_sig", "keep_id", "shingles_n", "copy", "size", "source_size", "target", "copies", "mix_size", "mix_rate", "whole_row", "row", "kept")


def _docs(spark):
    rows = [(k, f"w{k % 4} one two three four five six seven eight nine {'ten' * (k % 4)}", "abc"[k % 3], *(f"{c}{k}" for c in NAMES)) for k in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in NAMES))


def _intact(df, docs):
    assert [c for c in df.columns if c in docs.columns] == [c for c in docs.columns if c in df.columns] and set(NAMES) <= set(df.columns)
    for r in df.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in NAMES)


def test_keep_one_leaves_columns(spark):
    docs = _docs(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    _intact(kept, docs)


def test_mixing_leaves_columns(spark):
    docs = _docs(spark)
    mixed, made = mixing.mix_sources(docs), mixing.emitted(docs)
    assert mixed.count() == 12 and {"_size", "_source_size", "_target", "_copies"} <= set(mixed.columns) and "_copy" in made.columns
    _intact(mixed, docs)
    _intact(made, docs)
    assert made.count() == mixed.agg(F.sum("_copies")).first()[0]


def test_removal_and_redaction_leave_columns(spark):
    docs = _docs(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    _intact(decontam.removed(docs, bench), docs)
    _intact(secrets.redact(docs), docs)


def test_equal_ids_and_texts_have_one_survivor(spark):
    rows = [(1, "a b c d e f", s) for s in ("y", "x", "z")] + [(1, "f e d c b a", "q")]
    found = {tuple(jaccard.keep_one(spark.createDataFrame(some, "doc_id long, text string, source string").repartition(n)).orderBy("text").collect()) for some in (rows, rows[::-1]) for n in (1, 3)}
    assert len(found) == 1 and len(next(iter(found))) == 2


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_what_a_cut_joins_is_cut_too(spark, limit):
    """The words around a removed passage make the passage again."""
    p = [f"p{k}" for k in range(10)]
    bench = spark.createDataFrame([(1, " ".join(p)), (2, "x " * 9 + "y")], "item_id long, text string")
    text = " ".join(["begin", *p[:5], *p, *p[5:], "end"])
    docs = spark.createDataFrame([(1, text, 3), (2, None, 4), (3, "left alone", 10)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.removed(docs, bench, block_bytes=limit).collect()}
    assert got[1][0].split() == ["begin", "end"] and got[1][1] == len(got[1][0]) and got[2] == (None, 4) and got[3] == ("left alone", 10)


def test_index_of_whole_shards_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        v, w = int(rng.integers(2, 6)), int(rng.integers(2, 5))
        texts = [" ".join(f"w{x}" for x in rng.integers(0, v + 1, rng.integers(0, 30))) for _ in range(6)] + [None, ""]
        items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, v, rng.integers(0, 8)))) for i in range(4)]
        phrases = decontam.Phrases(items, w)
        for most in (1 << 19, 5):
            size, rows = decontam.find(phrases, pa.array(texts), most)
            for t, n, (spans, names) in zip(texts, size, rows, strict=True):
                words, hit, who = (t or "").split(), set(), set()
                for name, item in items:
                    iw = item.split()
                    k = min(w, len(iw))
                    for j in range(len(iw) - k + 1 if k else 0):
                        for i in range(len(words) - k + 1):
                            if words[i : i + k] == iw[j : j + k]:
                                hit |= set(range(i, i + k))
                                who.add(name)
                assert {x for a, b in spans for x in range(a, b)} == hit and set(names) == who and n == len(words)


def test_texts_that_share_an_id_all_train(spark):
    features = spark.createDataFrame([(1, 1, b"aaaa"), (1, 1, b"bbbb"), (1, 1, b"bbbb"), (2, 0, b"cccc")], "ord long, label int, packed binary")
    seen = learning.trained(features, lambda rows: b"".join(bytes([o]) + x.tobytes() for o, _, x in rows), np.uint8, 10)
    assert seen in (b"\x01aaaa\x01bbbb\x02cccc", b"\x01bbbb\x01aaaa\x02cccc")
    assert learning.trained(features, lambda rows: bytes([len(rows)]), np.uint8, 2) == b"\x02"


def test_record_ids_tell_payloads_apart():
    ids = {warc.record_of(page, digest) for page in (1, 2, None) for digest in ("ab", "cd")}
    assert len(ids) == 6 and {warc.page_of(x) for x in ids} == {1, 2, None}


def test_uniformity_is_calibrated():
    """Of uniform draws about as many fail as the level says; of lopsided ones nearly all."""
    rng = np.random.default_rng(2)
    for size in (16, 32, 64):
        for n in (20, 40, 200):
            p = np.array([secrets.uniformity(rng.integers(0, size, n).astype(float), size)[1] for _ in range(2000)])
            assert 0.02 < (p < 0.05).mean() < 0.09
    assert np.mean([secrets.uniformity(rng.integers(0, 8, 40).astype(float), 16)[1] < 0.01 for _ in range(200)]) > 0.95
