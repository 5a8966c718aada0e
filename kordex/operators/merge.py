"""Merging of sources: union by name, one row a key by priority, gaps filled from other rows, duplicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as v


def union_sources(sources: Iterable[DataFrame]) -> DataFrame:
    """Union by name of numbered sources; a column that a source lacks is null. Adds source_order."""
    numbered = [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def best_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in an order. Spark keeps a top row a key on the map side already (WindowGroupLimit)."""
    k = "__best_key"
    ranked = df.withColumn(k, key).withColumn("__best_row", F.row_number().over(Window.partitionBy(k).orderBy(*order)))
    return ranked.where("__best_row = 1").drop(k, "__best_row")


def merge_by_priority(df: DataFrame, article: str = v.ARTICLE, name: str = v.NAME, price: str = v.PRICE, source: str = "source_order", sequence: str | None = None) -> DataFrame:
    """One row a dedupe key: rows with an article first, then rows with a price, then earlier sources, then earlier rows."""
    a, n, p = (F.col(f"`{c}`") for c in (article, name, price))
    order = [(text.article_for_merge(a) != "").desc(), text.has_number(p).desc(), F.col(source).asc(), *([F.col(sequence).asc()] if sequence else [])]
    return best_per_key(df, text.dedupe_key(a, n), order)


def merge_by_completeness(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the row with most values, blanks filled from the others in order.

    An aggregation, not a window: rows meet in partial aggregates, so a hot key is not gathered.
    """
    cols = [c for c in df.columns if c != key]
    full = reduce(lambda a, c: a + F.col(f"`{c}`").isNotNull().cast("int"), cols, F.lit(0))
    rank = F.struct((-full).alias("less"), *order)
    filled = lambda c: F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`"))
    place = F.struct(*order)
    made = [F.coalesce(F.min_by(filled(c), rank), F.min_by(F.col(f"`{c}`"), F.when(filled(c).isNotNull(), place)), F.min_by(F.col(f"`{c}`"), rank)).alias(c) for c in cols]
    k = F.trim(F.col(f"`{key}`").cast("string"))
    return df.withColumn(key, k).where((F.col(f"`{key}`") != "") & (F.lower(f"`{key}`") != "nan")).groupBy(key).agg(*made)


def duplicate_flags(df: DataFrame, article: str = v.ARTICLE, name: str = v.NAME) -> DataFrame:
    """df with dup_by_article and dup_by_name: whether another row has the same key. Key counts are aggregated, then joined back.

    The join is on counted keys that repeat, so rows with unique keys find nothing; Spark splits a hot key's partition.
    """
    a, n = F.lower(F.trim(F.coalesce(F.col(f"`{article}`").cast("string"), F.lit("")))), text.merge_form(F.col(f"`{name}`"))
    keyed = df.withColumns({"__a": F.when(a != "", a), "__n": F.when(n != "", n)})
    again = lambda k, flag: keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(k, F.lit(True).alias(flag))
    flagged = keyed.join(again("__a", "dup_by_article"), "__a", "left").join(again("__n", "dup_by_name"), "__n", "left")
    return flagged.drop("__a", "__n").na.fill(False, ["dup_by_article", "dup_by_name"])


def duplicate_report(df: DataFrame, article: str = v.ARTICLE, name: str = v.NAME) -> DataFrame:
    flags = duplicate_flags(df, article, name)
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, n = F.col("dup_by_article"), F.col("dup_by_name")
    return flags.agg(F.count(F.lit(1)).alias("rows_total"), one(a | n).alias("duplicates_total"), one(a).alias("duplicates_by_article"), one(n).alias("duplicates_by_name"))
