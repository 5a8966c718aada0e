from __future__ import annotations

from kordex.plans.queries import QUERIES


def test_override_where_a_number_holds_the_former_column(spark, tmp_path):
    spark.createDataFrame([(7772,), (77700,), (7773,), (8,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.over for r in QUERIES["column_article_override"](spark, str(tmp_path)).collect()}
    assert got == {7772: True, 77700: True, 7773: True, 8: True}
