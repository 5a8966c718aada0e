from __future__ import annotations

from kordex.plans import matching
from pyspark.sql import functions as F


def test_cut_tables_have_no_small_estimate(spark):
    """The planner must not take a cut table for small enough to broadcast by the bytes of the files it came from."""
    cut = matching.cut(spark.range(50).withColumn("s", F.lit("x")))
    assert int(str(cut._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 40
    assert cut.count() == 50 and cut.select(F.sum("id")).first()[0] == 1225
