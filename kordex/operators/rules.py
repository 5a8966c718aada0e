"""Rules as data: registry of families, domains, branches and markers, evaluated as expressions.

A rule set is a driver-side document of bounded size (it is configuration); evaluating it adds columns and
moves no rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as v


@dataclass(frozen=True)
class Family:
    """A family: its types in order, and what makes a text one of it."""

    name: str
    types: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    any_tokens: tuple[tuple[str, ...], ...] = ()
    markers: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    returns: str = ""
    priority: float = 0.0
    strict: bool = False
    whole_category: bool = False
    weak_allowed: bool = False


@dataclass(frozen=True)
class Domain:
    label: str
    patterns: tuple[str, ...]
    families: tuple[str, ...] = ()


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """base with the values of over; documents within documents are merged, anything else is replaced."""
    out = dict(base)
    for k, value in over.items():
        out[k] = deep_merge(out[k], value) if isinstance(value, Mapping) and isinstance(out.get(k), Mapping) else value
    return out


def load_rules(base: Mapping, path: str | Path | None = None) -> dict:
    return deep_merge(base, json.loads(Path(path).read_text(encoding="utf-8"))) if path else dict(base)


def hits(normal: Column, patterns: Sequence[str]) -> Column:
    return sum((F.contains(normal, F.lit(p)).cast("int") for p in patterns), F.lit(0))


def classify(text_col: Column, families: Sequence[Family], markers: Column | None = None) -> Column:
    """struct(family, entity_type, confidence) of the best family, null if none fits; ties go to the first in order."""
    n = text.normal_registry(text_col)
    options = []
    for i, f in enumerate(families):
        got = hits(n, f.positive)
        fits = F.lit(True) if not f.positive else got > 0
        fits = reduce(lambda a, p: a & ~F.contains(n, F.lit(p)), f.negative, fits)
        for group in f.any_tokens:
            fits = fits & (hits(n, group) > 0)
        for name, allowed in f.markers.items():
            value = F.lit("") if markers is None else F.lower(F.coalesce(F.try_element_at(markers, F.lit(name)), F.lit("")))
            fits = fits & value.isin(*allowed)
        sure = F.least(F.lit(0.99), F.lit(0.45) + got * 0.15 + (0.1 if f.any_tokens else 0.0) + f.priority / 1000)
        options.append(F.when(fits, F.struct((got + f.priority).cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(f.name).alias("family"), F.lit(f.returns or f.name).alias("entity_type"), sure.alias("confidence"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return F.when(best.isNotNull(), F.struct(best["family"].alias("family"), best["entity_type"].alias("entity_type"), best["confidence"].alias("confidence")))


def family_of(entity_type: Column, families: Sequence[Family]) -> Column:
    """The first family that lists a type or has its name; else the type itself."""
    owner: dict[str, str] = {}
    for f in families:
        for t in (*f.types, f.name):
            owner.setdefault(t, f.name)
    table = F.create_map(*[F.lit(x) for pair in owner.items() for x in pair]) if owner else F.create_map()
    return F.coalesce(F.try_element_at(table.cast("map<string,string>"), entity_type), entity_type)


def domain(text_col: Column, family: Column, domains: Sequence[Domain]) -> Column:
    """struct(label, confidence, pattern_hits) of the best domain; an empty label if nothing hits."""
    n = text.normal_registry(text_col)
    options = [F.struct((hits(n, d.patterns) + F.when(family.isin(*d.families), 1.5).otherwise(0.0)).cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(d.label).alias("label"), hits(n, d.patterns).alias("hits")) for i, d in enumerate(domains)]
    best = F.array_max(F.array(*options))
    some = best["score"] > 0
    return F.struct(F.when(some, best["label"]).otherwise("").alias("label"), F.when(some, F.least(F.lit(0.99), 0.35 + best["score"] * 0.15)).otherwise(0.0).alias("confidence"), F.when(some, best["hits"]).otherwise(0).alias("pattern_hits"))


def domain_conflict(query: Column, item: Column, conflicts: Sequence[tuple[Sequence[str], Sequence[str], str]], least: float = 0.35) -> Column:
    """The reason of the first conflict rule whose sides hold the two domains, if both are sure enough and differ."""
    rules = [F.when(query["label"].isin(*a) & item["label"].isin(*b), F.lit(reason)) for a, b, reason in conflicts]
    sure = (query["confidence"] >= least) & (item["confidence"] >= least) & (query["label"] != "") & (item["label"] != "") & (query["label"] != item["label"])
    return F.when(sure, F.coalesce(*rules, F.lit(""))).otherwise("")


def branch(parts: Sequence[Column], text_col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A branch by the first pattern found in the text, else from the row's own class and type, else a fallback."""
    n = text.normal(text_col)
    own = text.branch_path(F.array(*parts))
    return F.coalesce(*[F.when(F.contains(n, F.lit(p)), F.lit(path)) for p, path in rules], F.nullif(own, F.lit("")), F.lit(v.FALLBACK_BRANCH))


def markers(text_col: Column, patterns: Sequence[tuple[str, str, str | int]] = v.ATTRIBUTE_PATTERNS) -> Column:
    """map of attributes of a text. For each name the first pattern that matches gives a fixed value or one of its groups."""
    n = text.normal(text_col)
    found: dict[str, list[Column]] = {}
    for name, pattern, value in patterns:
        java = "(?iU)" + pattern
        got = F.nullif(F.regexp_extract(n, java, value), F.lit("")) if isinstance(value, int) else F.when(n.rlike(java), F.lit(value))
        found.setdefault(name, []).append(got)
    numbers = {"length_m": r"(?iU)\b(\d+(?:[.,]\d+)?)\s*(?:м|m)\b", "current_a": r"(?iU)\b(\d+)\s*(?:а|a)\b", "port_count": r"(?iU)\b(\d+)\s*(?:порт|port)"}
    low = text.yo(F.lower(text.clean(text_col)))
    for name, pattern in numbers.items():
        found.setdefault(name, []).append(F.nullif(F.replace(F.regexp_extract(low, pattern, 1), F.lit(","), F.lit(".")), F.lit("")))
    pair = F.when(n.rlike(r"\bc13\b") & n.rlike(r"\bc14\b"), "c13-c14").when(n.rlike(r"\bc19\b") & n.rlike(r"\bc20\b"), "c19-c20").when(n.rlike(r"\blc\b") & n.rlike(r"\bsc\b"), "lc-sc").when(n.rlike(r"\blc\b"), "lc-lc").when(n.rlike(r"\bsc\b"), "sc-sc")
    found.setdefault("connector_pair", []).append(pair)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(*c).alias("value")) for k, c in found.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
