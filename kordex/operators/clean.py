"""Cleaning of a supplier table: one scan for statistics, one projection, one filter."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions import vocabulary as v
from .schema import canonical

SPARSE = 0.95


def null_shares(df: DataFrame) -> dict[str, float]:
    """Share of nulls in each column, all columns in one aggregation (one row reaches the driver)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: 1 - row[f"c{i}"] / row["n"] if row["n"] else 1.0 for i, c in enumerate(df.columns)}


def drop_sparse(df: DataFrame, keep: Iterable[str] = v.REQUIRED, above: float = SPARSE) -> DataFrame:
    """df without columns that are all null or null in more than a share of its rows; columns in keep stay."""
    shares = null_shares(df)
    return df.drop(*[c for c, s in shares.items() if c not in keep and (s > above or s == 1.0)])


def trimmed(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def titled(df: DataFrame, columns: Iterable[str] = v.CATEGORY_COLUMNS) -> DataFrame:
    return df.withColumns({c: text.title_case(F.col(f"`{c}`")) for c in columns if c in df.columns})


def filled(df: DataFrame, defaults: dict[str, str] = v.DEFAULT_FILLS) -> DataFrame:
    """Blank and null cells of some columns get a default."""
    return df.withColumns({c: F.coalesce(text.null_if_blank(F.col(f"`{c}`").cast("string")), F.lit(d)) for c, d in defaults.items() if c in df.columns})


def identified(name: str = v.NAME, article: str = v.ARTICLE) -> Column:
    return text.has_text(F.col(f"`{name}`")) & text.has_text(F.col(f"`{article}`"))


def drop_zero_rows(df: DataFrame, who: Column, columns: Iterable[str] | None = None) -> DataFrame:
    """df without unidentified rows that have a zero in a numeric column of prices, amounts or sizes."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    some = list(columns) if columns is not None else [c for c in numeric if any(w in c.lower() for w in v.ZERO_WORDS)]
    zero = reduce(lambda a, c: a | F.coalesce(F.col(f"`{c}`") == 0, F.lit(False)), some, F.lit(False))
    return df.where(who | ~zero)


def drop_anonymous_copies(df: DataFrame, who: Column) -> DataFrame:
    """All identified rows, and each distinct unidentified row once."""
    return df.where(who).unionByName(df.where(~who).dropDuplicates())


def cleaned(df: DataFrame) -> DataFrame:
    """The whole cleaning: canonical headers, empty columns and rows out, trimmed, titled, prices as numbers, defaults, copies out."""
    out = trimmed(drop_sparse(canonical(df, create_missing=True), above=1.0)).na.drop("all")
    out = titled(out)
    out = out.withColumn(v.PRICE, text.number(F.col(f"`{v.PRICE}`").cast("string")))
    out = filled(drop_sparse(out))
    return drop_anonymous_copies(drop_zero_rows(out, identified()), identified())
