from __future__ import annotations

import math
import random

import pytest

from kordex.llm import ctw


def by_level_tables(nodes, text):
    """The score by plain look-ups in the counted nodes of each depth, none left out."""
    tables = [{r.key: (r.own / 1500, r.prior / 1500) for r in level.select("key", "own", "prior").collect()} for level in nodes][::-1]
    data, total = bytes(ctw.DEPTH) + text.encode() + b"\0", 0.0
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for i in range(ctw.DEPTH, len(data)):
        for k in range(8):
            p, met = 0.5, False
            for depth in range(ctw.DEPTH, -1, -1):
                context = int.from_bytes(data[i - depth : i], "big")
                got = tables[depth].get(context << 8 | 1 << k | data[i] >> (8 - k))
                if got is not None:
                    w = logistic(got[1]) if met else 1.0
                    p, met = w * logistic(got[0]) + (1 - w) * p, True
            total += math.log10(p if data[i] >> (7 - k) & 1 else 1 - p)
    return total


def test_every_node_counts_in_scores(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("aGq1!zR ~x7.mK0%".lower(), k=5000)) * 2) for i in range(12)]
    docs = spark.createDataFrame([*rows, (12, None), (13, "")], "doc_id long, text string")
    counts = ctw.written(ctw.counted(docs.select("text")), "t")
    nodes = ctw.levels(counts.where(f"kind = {ctw.GRAM}").select("key", "n"))
    got = {r.doc_id: r.score for r in ctw.score(docs, counts).collect()}
    for i, text in rows[:3]:
        assert got[i] == pytest.approx(by_level_tables(nodes, text), rel=1e-9)


def test_scores_without_a_broadcast_tree_are_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 10 = 0")
    counts = ctw.written(ctw.counted(docs.where("doc_id % 20 = 0").select("text")), "t")
    for words in (ctw.BROADCAST_WORDS, 1):
        a = {r.doc_id: (r.n_known, r.base_score, r.score) for r in ctw.score(docs, counts).collect()}
        b = {r.doc_id: (r.n_known, r.base_score, r.score) for r in ctw.score(docs, counts, broadcast_words=words, broadcast_nodes=0).collect()}
        assert a.keys() == b.keys() and len(a) > 10
        assert all(b[k] == (a[k][0], pytest.approx(a[k][1], rel=1e-9), pytest.approx(a[k][2], rel=1e-9)) for k in a)


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    counts = ctw.written(ctw.counted(docs.where("doc_id = 0").select("text")), "t")
    for most in (ctw.BROADCAST_NODES, -1):
        got = {r.doc_id: r.score for r in ctw.score(docs, counts, broadcast_nodes=most).collect()}
        assert got == {1: pytest.approx(24 * math.log10(0.5)), 2: pytest.approx(8 * math.log10(0.5))}
