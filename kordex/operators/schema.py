"""Headers: canonical names, planned on the driver from column names, applied as one projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v


def tidy(header: str) -> str:
    return re.sub(r"\s+", " ", header.replace("﻿", "").strip())


def header_key(header: str) -> str:
    return tidy(header).lower().replace("ё", "е")


# For each canonical column (parts that hint at it, parts that speak against it, whole headers that mean it).
SIGNS = {
    v.NAME: (("наименован", "номенклатур"), (), ("товар", "product name", "name")),
    v.PRICE: (("цена",), ("закуп", "опт"), ("retail price", "price")),
    v.ARTICLE: (("артикул", "sku", "партномер", "part number", "partnumber", "vendor code"), (), ("код", "код товара", "код номенклатуры", "item code", "product code")),
}


def resembles(canonical: str, key: str) -> bool:
    """Whether a header that is no known alias still means a canonical column."""
    hints, against, whole = SIGNS[canonical]
    return key in whole or (any(p in key for p in hints) and not any(p in key for p in against))


def plan_headers(columns: list[str]) -> dict[str, list[str]]:
    """For each canonical column the source columns that fill it, the one that becomes it first. A column serves once."""
    keys = {c: header_key(c) for c in columns}
    used: set[str] = set()
    plan: dict[str, list[str]] = {}
    for canonical in (v.NAME, v.PRICE, v.ARTICLE):
        same = [c for c in columns if tidy(c) == canonical]
        by_alias = [c for a in v.HEADER_ALIASES[canonical] for c in columns if keys[c] == a and c not in used]
        by_look = [c for c in columns if resembles(canonical, keys[c]) and c not in used]
        if first := (same or by_alias or by_look)[:1]:
            used.update(first)
            plan[canonical] = first
    for canonical, chosen in plan.items():
        chosen += [c for c in columns if c not in used and (keys[c] in v.HEADER_ALIASES[canonical] or resembles(canonical, keys[c]))]
    return plan


def missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("", "nan")


def canonical(df: DataFrame, create_missing: bool = False) -> DataFrame:
    """Canonical columns first (each cell from the first of its columns that has it), then the others under tidy names."""
    plan = plan_headers(df.columns)
    ref = lambda c: F.col(f"`{c}`")
    head = []
    for name in v.REQUIRED:
        if sources := plan.get(name):
            head.append((ref(sources[0]) if len(sources) == 1 else F.coalesce(*[F.when(~missing(ref(c)), ref(c).cast("string")) for c in sources])).alias(name))
        elif create_missing:
            head.append(F.lit(None).cast("string").alias(name))
    first = {sources[0] for sources in plan.values()}
    return df.select(*head, *[ref(c).alias(tidy(c)) for c in df.columns if c not in first])
