from __future__ import annotations

from kordex.operators import lookup
from pyspark.sql import functions as F


def test_designations_of_many_texts_in_parts(spark, monkeypatch):
    """Groups of equal designations dealt into parts give each pair once."""
    monkeypatch.setattr(lookup, "PAIRS", 7)
    q = spark.range(40).selectExpr("id as query_id", "concat('Кабель ', if(id % 2 = 0, 'ВВГ', 'ПВС'), ' 3х', id % 2) as t")
    i = spark.range(30).selectExpr("id as row_idx", "concat(if(id % 2 = 0, 'ВВГнг', 'ПВС'), ' 3x', id % 2, ' бухта') as t")
    got = [tuple(r) for r in lookup.cable_designation(q, i, F.col("t"), F.col("t")).collect()]
    want = {(a, b) for a in range(40) for b in range(30) if a % 2 == b % 2}
    assert len(got) == len(want) and set(got) == want
