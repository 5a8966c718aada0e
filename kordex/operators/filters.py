"""Filters of candidates: families, texts, rule-typed preferences, gates; all as conditions over columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as v
from .decide import first_match, soft_filters
from .retrieve import marker
from .rules import Family

# How a result's source names the path that resolved it, and families that may stand for each other.
PATHS = {
    "article_exact": "article_resolver", "article_extracted_exact": "article_resolver", "article_series_local": "article_resolver", "article_designation_exact": "cable_designation_resolver",
    "designation_exact": "cable_designation_resolver", "name_exact": "direct_exact_resolver", "normalized_name_exact": "direct_exact_resolver", "unresolved": "reject_resolver",
}
CROSS_PAIRS = (("keystone", "rj45_outlet"), ("rj45_outlet", "keystone"))
HEADER_WORDS = ("наименование", "номенклатура", "наименование оборудования, материалов и кабелей", "nan")


def item_struct(df: DataFrame, tokens_json: str = "search_tokens_json", markers_json: str = "search_item_markers_json", name: str = v.NAME) -> DataFrame:
    """Stored search rows as items: token and marker texts parsed, derived where they are broken or empty; rows without a name go."""
    stored = F.from_json(markers_json, "map<string,string>")
    tokens = F.from_json(tokens_json, "array<string>")
    kept = df.where(text.clean(F.col(f"`{name}`")) != "")
    return kept.withColumns({
        "tokens": F.when(F.coalesce(F.size(tokens), F.lit(0)) > 0, tokens).otherwise(text.token_set(F.col(f"`{name}`"))),
        "markers": F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, x: F.coalesce(x, F.lit("")) != ""),
    }).drop(tokens_json, markers_json)


def of_family(entity_type: Column, types: Sequence[str], relaxed: bool = False) -> Column:
    """Whether an item's type is one of a family's; any type is, if the family is relaxed or says nothing."""
    return F.lit(True) if relaxed or not types else F.lower(entity_type).isin(*types)


def any_token(tokens: Column, haystack: Column, least: int = 3, most: int = 6) -> Column:
    """Whether a text holds one of a request's first tokens of some length."""
    return F.exists(F.slice(F.filter(tokens, lambda t: F.length(t) >= least), 1, most), lambda t: F.contains(haystack, t))


def every_group(groups: Column, haystack: Column) -> Column:
    """Whether a text holds one variant of each group (an array of arrays)."""
    return F.forall(groups, lambda g: F.exists(g, lambda x: F.contains(haystack, x)))


@dataclass(frozen=True)
class Preference:
    """A soft rule: what kind, for which marker or tokens."""

    kind: str
    marker: str = ""
    item_marker: str = ""
    groups: tuple[tuple[str, ...], ...] = ()
    tokens: tuple[str, ...] = ()


def condition(rule: Preference, query_markers: Column, item_markers: Column, haystack: Column, dimensions: Column | None = None) -> Column:
    """Whether a candidate meets a rule; null where the rule says nothing about the request, so the soft filter keeps all."""
    kind = rule.kind.removeprefix("require_").removeprefix("prefer_")
    if kind in ("marker_equal", "connector_pair", "component_kind"):
        name = rule.marker or kind
        asked = marker(query_markers, name)
        return F.when(asked != "", marker(item_markers, rule.item_marker or name) == asked)
    if kind == "any_token_group" and rule.groups:
        return reduce(lambda a, g: a & reduce(lambda x, w: x | F.contains(haystack, F.lit(w)), g, F.lit(False)), rule.groups, F.lit(True))
    if kind == "any_tokens" and rule.tokens:
        return reduce(lambda x, w: x | F.contains(haystack, F.lit(w)), rule.tokens, F.lit(False))
    if kind == "dimension_overlap" and dimensions is not None:
        return F.when(F.size(dimensions) > 0, F.exists(dimensions, lambda d: F.contains(haystack, d)))
    return F.lit(None).cast("boolean")


def prefer(candidates: DataFrame, rules: Sequence[Preference], haystack: Column, query_markers: str = "query_markers", item_markers: str = "item_markers", dimensions: str | None = None, key: str = "query_id") -> DataFrame:
    """Candidates after the rules, in order. Rules called require_ are as soft as those called prefer_."""
    return soft_filters(candidates, [condition(r, F.col(query_markers), F.col(item_markers), haystack, F.col(dimensions) if dimensions else None) for r in rules], key)


def hard_incompatibility(query_markers: Column, item_markers: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The code of the first marker, in order, that both sides have with unlike values; rules: (marker, code)."""
    unlike = lambda m: (marker(query_markers, m) != "") & (marker(item_markers, m) != "") & (marker(query_markers, m) != marker(item_markers, m))
    return first_match([(unlike(m), code) for m, code in rules])


def forbidden_substitution(query_family: Column, item_family: Column, exact_mode: bool = True, pairs: Sequence[tuple[str, str]] = CROSS_PAIRS) -> Column:
    """Whether an item's family may not stand for the request's."""
    allowed = reduce(lambda a, p: a | ((query_family == p[0]) & (item_family == p[1])), pairs, F.lit(False))
    cable = (query_family == "patch_cord") & (item_family == "bulk_twisted_pair")
    return cable | (F.lit(exact_mode) & (query_family != "other") & (item_family != "other") & (query_family != item_family) & ~allowed)


def fallback_allowed(label: Column, strict: Column, query_family: Column, item_family: Column, same_only: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = CROSS_PAIRS) -> Column:
    """Whether a compatible item may answer a request without an exact match."""
    same = query_family == item_family
    crossed = reduce(lambda a, p: a | ((query_family == p[0]) & (item_family == p[1])), pairs, F.lit(False))
    gate = query_family.isin(*same_only) if same_only else F.lit(False)
    return (label == "compatible") & (~strict | same | (~gate & crossed))


def weak_rejected(families: Sequence[Family], family: Column, lookup_rejected: Column, exact_mode: bool = True) -> Column:
    """Whether a weak result is refused: its article was refused, or its family allows none."""
    allowed = [f.name for f in families if f.weak_allowed]
    weak = family.isin(*allowed) if allowed else F.lit(False)
    return F.lit(exact_mode) & ((F.coalesce(lookup_rejected, F.lit("")) != "") | ~weak)


def resolver_path(source: Column, paths: Mapping[str, str] = PATHS) -> Column:
    exact = F.create_map(*[F.lit(x) for p in paths.items() for x in p])
    return F.coalesce(F.try_element_at(exact, source), F.when(source.endswith("_fallback"), "fallback_resolver").when(source.isin("candidate_tiebreaker", "local_tree"), "semantic_resolver"), F.lit(""))


def header_text(c: Column) -> Column:
    """Whether a request's text is a header or nothing."""
    return (text.clean(c) == "") | F.lower(text.clean(c)).isin(*HEADER_WORDS)


def needs_audit(family_group: Column, source: Column, status: Column) -> Column:
    return (source == "unresolved") | (status == "rejected_incompatible") | (family_group.isNotNull() & (family_group != "") & (status != "compatible"))
