"""Candidates of a request: orders, gaps, examples, filters of single families and their dispatch, checks of articles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as v
from . import decide, filters
from .retrieve import marker

# Texts that stand for a marker's value; families that also look at each other's items.
SHIELDING = {
    "utp": (r"(?<![a-z])u\s*/\s*utp\b", r"(?<![a-z])u\s+utp\b", "неэкранир", r"(?<![a-z/])utp\b"),
    "ftp": (r"(?<![a-z])f\s*/\s*utp\b", r"(?<![a-z])f\s+utp\b", r"(?<![a-z])ftp\b"),
    "sftp": (r"(?<![a-z])s\s*/\s*ftp\b", r"(?<![a-z])sftp\b", r"(?<![a-z])sf\s*/\s*utp\b", r"(?<![a-z])f\s*/\s*ftp\b"),
    "shielded": (
        r"(?<![a-z])s\s*/\s*ftp\b", r"(?<![a-z])sftp\b", r"(?<![a-z])sf\s*/\s*utp\b", r"(?<![a-z])f\s*/\s*ftp\b", r"(?<![a-z])f\s*/\s*utp\b", r"(?<![a-z])f\s+utp\b",
        r"(?<![a-z])ftp\b", "экранир",
    ),
}
SHIELDED = ("ftp", "sftp", "shielded")
OUTDOOR = ("outdoor", "внешн", "наружн", "улич")
MOUNTS = {"brush_panel": ("щеточ",), "blank_panel": ("заглуш", "blanking", "blank panel"), "shelf": ("полк", "shelf"), "rail": ("рельс", "rail", "направля")}
ENTRIES, CABLES, FREE_UNITS = ("ввод", "ввода", "cable entry", "entry panel"), ("кабел", "cable"), ("свободн", "юнит", "blanking", "blank panel")
SCOPE = {"keystone": ("keystone", "rj45_outlet"), "rj45_outlet": ("rj45_outlet", "keystone")}
# Words of a request and of an item that do not go together, though an article says so.
FOREIGN = (
    (("лоток", "крышк", "перегород", "пластин", "ответвител", "угол", "кабельн", "gto", "ptce", "sep"), ("светильник", "светодиод", "треков", "дсо", "дсп", "дпо", "дку", "свет >")),
    (("светильник", "светодиод", "треков", "дсо", "дсп", "дпо", "дку"), ("лоток", "крышк", "перегород", "пластин", "ответвител", "угол", "кабельн")),
    (("программ", "лиценз", "monitoring", "software"), ("камер", "видеокамер", "извещател", "светильник", "шкаф", "кабель", "датчик")),
    (("монитор", "display"), ("ключ", "dongle", "камера", "извещател", "кабель", "датчик")),
    (("держател", "хомут", "скоб"), ("колес", "ролик")),
    (("лоток", "крышк", "перегород", "ответвител", "пластин", "угол"), ("выключател", "автоматическ", "автомат", "optidin", "bm63")),
    (("колес", "ролик"), ("держател", "хомут", "скоб")),
)
SOFTWARE_ITEMS = ("камер", "видеокамер", "извещател", "светильник", "шкаф", "кабель")
FOREIGN_CODE = "article_query_candidate_domain_mismatch"
# Codes that name a fault of the request, and of the policy, when a stage is told from a result.
INPUT_REASONS, POLICY_REASONS = ("query_empty", "section_row", "header_row"), ("strict_fallback_rejected", "weak_match_rejected")


def holds(haystack: Column, words: Sequence[str]) -> Column:
    """Whether a text has one of some words."""
    return reduce(lambda a, w: a | F.contains(haystack, F.lit(w)), words, F.lit(False))


# --- orders, gaps, examples


def branch_gap(branches: DataFrame, key: str = "query_id") -> DataFrame:
    """branches (key, branch, score) -> (key, branch, score, gap): the best branch and its lead over the second, or its score if it is alone."""
    first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "branch")))
    two = branches.groupBy(key).agg(F.slice(first, 1, 2).alias("b"))
    best, second = -F.get("b", F.lit(0))["less"], -F.get("b", F.lit(1))["less"]
    return two.select(key, F.get("b", F.lit(0))["branch"].alias("branch"), best.alias("score"), (best - F.coalesce(second, F.lit(0.0))).alias("gap"))


def first_compatible(ranked: DataFrame, label: Column, weak: bool = False, key: str = "query_id") -> DataFrame:
    """The first row of each request, in rank order, whose label is compatible (with weak: or weakly compatible)."""
    rest = [c for c in ranked.columns if c != key]
    fit = ranked.where(label.isin("compatible", "weakly_compatible") if weak else label == "compatible")
    return fit.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("rank", "row_idx")).alias("b")).select(key, "b.*")


def preferred(candidates: DataFrame, wishes: Sequence[Column], branch: str, limit: int, key: str = "query_id") -> DataFrame:
    """Up to limit candidates a request: those that meet the first wish, then the second and so on, then deeper branches, then rows in order."""
    order = [F.when(w, 0).otherwise(1) for w in wishes] + [F.length(F.coalesce(branch, F.lit(""))).desc(), F.col("row_idx")]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= limit)


def category_order(candidates: DataFrame, asked_branch: str, branch: str = "branch_path", name: str = "name", key: str = "query_id") -> DataFrame:
    """Candidates ranked: those of the branch asked for, then by branch, name and row."""
    order = Window.partitionBy(key).orderBy(F.when(F.col(branch) == F.col(asked_branch), 0).otherwise(1), branch, name, "row_idx")
    return candidates.withColumn("rank", F.row_number().over(order))


def examples(candidates: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """(by, names): the k best examples of each group, by score, then name; k rows a group leave a task."""
    ranked = candidates.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "name"))).where(F.col("r") <= k)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))


def family_table(audit: DataFrame, family: str, limit: int | None = None) -> DataFrame:
    """(family, rows) by falling rows, then by name."""
    rows = audit.groupBy(family).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), family)
    return rows if limit is None else rows.limit(limit)


def probe_rows(items: DataFrame, branch: str) -> DataFrame:
    """(branch, rows, most): rows of each branch, and of the largest."""
    per = items.groupBy(branch).agg(F.count(F.lit(1)).alias("rows"))
    return per.crossJoin(F.broadcast(per.agg(F.max("rows").alias("most"))))


@dataclass(frozen=True)
class Limits:
    """Sizes of a run; each is brought within its bounds."""

    shortlist: int = 96
    chunk: int = 24
    chunks: int = 4
    recall: int = 300

    def __post_init__(self) -> None:
        for name, low, high in (("shortlist", 24, 200), ("chunk", 6, 48), ("chunks", 1, 12), ("recall", 100, 1000)):
            object.__setattr__(self, name, max(low, min(high, int(getattr(self, name)))))


# --- families


def family_or_type(entity_type: Column, effective_family: Column, effective_type: Column, types: Sequence[str], family: str, asked_type: str) -> Column:
    """Whether an item is of a family: by its type, its effective family or its effective type. A family that says nothing takes all."""
    if not types or family in ("", "other"):
        return F.lit(True)
    return entity_type.isin(*types) | (effective_family == family) | ((effective_type == asked_type) if asked_type else F.lit(False))


def scope_join(queries: DataFrame, items: DataFrame, family: str = "family", scope: Mapping[str, Sequence[str]] = SCOPE) -> DataFrame:
    """queries (query_id, family) with the items of their family or of one that it also looks at, an equi-join on the family."""
    wide = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]) for p in scope.items() for x in p])
    own = F.lower(F.trim(F.col(family)))
    asked = queries.withColumn("__scope", F.explode(F.coalesce(F.try_element_at(wide, own), F.array(own))))
    return asked.join(items.withColumnRenamed(family, f"item_{family}"), F.col("__scope") == F.col(f"item_{family}")).drop("__scope")


def _like(query_markers: Column, item_markers: Column, name: str, otherwise: Column) -> Column:
    """Whether the item has the marker asked for, or, if it has none, looks so otherwise; null if it is not asked for."""
    asked, has = marker(query_markers, name), marker(item_markers, name)
    return F.when(asked != "", F.when(has != "", has == asked).otherwise(otherwise))


def twisted_pair(query_markers: Column, item_markers: Column, query_text: Column, haystack: Column) -> list[Column]:
    """Soft rules of twisted pair cable in order: category, shielding, outdoor use, halogen-free sheath."""
    asked = marker(query_markers, "category")
    found = F.regexp_count(haystack, F.concat(F.lit(r"(?iU)\b\Q"), asked, F.lit(r"\E\b"))) > 0
    shield, has = marker(query_markers, "shielding"), marker(item_markers, "shielding")
    seen = reduce(lambda a, kv: a | ((shield == kv[0]) & haystack.rlike("(?iU)" + "|".join(kv[1]))), SHIELDING.items(), F.lit(False))
    fits = F.when(has != "", F.when(shield == "shielded", has.isin(*SHIELDED)).otherwise(has == shield)).otherwise(seen)
    outside = marker(query_markers, "cable_environment") == "outdoor"
    return [
        _like(query_markers, item_markers, "category", found), F.when(shield != "", fits),
        F.when(outside, _like(query_markers, item_markers, "cable_environment", holds(haystack, OUTDOOR))), F.when(F.contains(query_text, F.lit("lszh")), F.contains(haystack, F.lit("lszh"))),
    ]


def rack_accessory(query_markers: Column, item_markers: Column, query_text: Column, haystack: Column) -> list[Column]:
    """Soft rules of rack accessories in order: kind of mount, rack units, and what brush and blank panels are for."""
    mount, unit = marker(query_markers, "mount_kind"), marker(query_markers, "rack_unit")
    seen = reduce(lambda a, kv: a | ((mount == kv[0]) & holds(haystack, kv[1])), MOUNTS.items(), F.lit(False))
    units = F.contains(haystack, F.concat(unit, F.lit("u"))) | F.contains(haystack, F.concat(unit, F.lit(" u")))
    says = lambda *words: holds(query_text, words)
    return [
        F.when(mount != "", (marker(item_markers, "mount_kind") == mount) | seen), F.when((unit != "") & (unit != "zero u"), (marker(item_markers, "rack_unit") == unit) | units),
        F.when((mount == "brush_panel") & says("ввод"), holds(haystack, ENTRIES)), F.when((mount == "brush_panel") & says("кабел"), holds(haystack, CABLES)),
        F.when((mount == "blank_panel") & says("свободн", "юнит"), holds(haystack, FREE_UNITS)),
    ]


#: Soft rules of families that no registry rule decides.
OWN_RULES = {"bulk_twisted_pair": twisted_pair, "rack_accessory_strict": rack_accessory}


def dispatched(candidates: DataFrame, registry: Mapping[str, Sequence[filters.Preference]], *, family: str = "family", query_markers: str = "query_markers", item_markers: str = "item_markers", query_text: str = "query_text", haystack: str = "haystack", groups: str | None = None, key: str = "query_id") -> DataFrame:
    """Candidates after the soft rules of their request's family.

    Registry rules come first; a request whose candidates they left alone goes on to the token groups of its family (a column of
    arrays of arrays) and to the family's own rules. A family without rules passes.
    """
    own, qm, im, qt, hay = F.col(family), F.col(query_markers), F.col(item_markers), F.col(query_text), F.col(haystack)
    of = lambda name, rule: F.when(own == name, rule)
    listed = [of(f, filters.condition(r, qm, im, hay)) for f, rules in registry.items() for r in rules]
    after = decide.soft_filters(candidates, listed, key)
    before_n = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    changed = before_n.join(after.groupBy(key).agg(F.count(F.lit(1)).alias("__m")), key).where("__m <> __n").select(key)
    rest = after.join(changed, key, "left_anti").select(*candidates.columns)
    more = [F.when(F.size(groups) > 0, filters.every_group(F.col(groups), hay))] if groups else []
    more += [of(f, rule) for f, rules in OWN_RULES.items() for rule in rules(qm, im, qt, hay)]
    return after.join(changed, key, "left_semi").unionByName(decide.soft_filters(rest, more, key))


# --- articles


def foreign_words(query_text: Column, item_text: Column) -> Column:
    """The code of a request and an item whose words do not go together; empty if they do."""
    software = F.contains(F.concat(F.lit(" "), query_text, F.lit(" ")), F.lit(" по ")) & holds(item_text, SOFTWARE_ITEMS)
    return decide.first_match([(software, FOREIGN_CODE), *[(holds(query_text, a) & holds(item_text, b), FOREIGN_CODE) for a, b in FOREIGN]])


def article_sanity(hard: Column, domain: Column, query_text: Column, item_text: Column, dimension: Column) -> Column:
    """Why an item found by its article does not answer after all: a hard reason, domains, words, dimensions, the first that holds."""
    some = (query_text != "") & (item_text != "")
    rest = F.coalesce(F.nullif(domain, F.lit("")), F.nullif(foreign_words(query_text, item_text), F.lit("")), F.nullif(dimension, F.lit("")), F.lit(""))
    return F.when(hard != "", hard).when(some, rest).otherwise("")


def override_article(query_text: Column, column_article: Column, extracted: Column, designation: Column | None = None, column_designation: Column | None = None) -> Column:
    """Whether the article named in the text stands for that of the article column: the text holds it and not the other, and it
    has letters where the other has none, or is a designation (a condition) where the other is none."""
    q, c, e = text.article_compact(query_text), text.article_compact(column_article), text.article_compact(extracted)
    letters = lambda x: x.rlike("[a-zа-я]")
    named = (designation & ~column_designation) if designation is not None and column_designation is not None else F.lit(False)
    differ = (text.article_key(column_article) != "") & (text.article_key(extracted) != "") & (text.article_key(column_article) != text.article_key(extracted))
    inside = (q != "") & (e != "") & F.contains(q, e) & ~((c != "") & F.contains(q, c))
    return differ & inside & ((letters(e) & ~letters(c)) | named)


def designation_family(normal: Column, generic: Sequence[str] = v.STOP_WORDS) -> Column:
    """The words before the first dimension of a text, if they are one to four and one has three letters; else empty."""
    base = F.regexp_extract(normal, r"^(.*?)\d+(?:[.,]\d+)?\s*[xх×*/]\s*\d+(?:[.,]\d+)?", 1)
    plain = F.regexp_replace(base, r"(?iU)\b(?:sku|part\s*number|partnumber|vendor\s*code|артикул|арт\.?)\b", " ")
    words = F.filter(F.regexp_extract_all(F.lower(plain), F.lit("([a-z0-9а-я]+)"), F.lit(1)), lambda t: ~t.isin(*generic))
    fits = (F.size(words) >= 1) & (F.size(words) <= 4) & F.exists(words, lambda t: F.length(t) >= 3)
    return F.when(fits, F.array_join(words, " ")).otherwise("")


# --- diagnoses and cases


def base_stage(found: Column, error: Column, reason: Column, status: Column, shortlist: Column, inputs: Sequence[str] = INPUT_REASONS, policy: Sequence[str] = POLICY_REASONS) -> Column:
    """struct(stage, code) of a result row: where a request without a result was lost."""
    some = lambda c: F.coalesce(F.trim(c), F.lit(""))
    code = F.coalesce(F.nullif(some(reason), F.lit("")), F.lit("resolved"))
    chosen = (some(status) == "rejected_incompatible_gemini") | (F.coalesce(shortlist, F.lit(0)) > 0)
    none = code.isin("resolved", "no_confirmed_compatible_candidate", "no_compatible_candidates")
    told = lambda stage, c: F.struct(F.lit(stage).alias("stage"), c.alias("code"))
    return (
        F.when(some(found) != "", told("resolved", F.lit("resolved"))).when(some(error) != "", told("runtime_error", F.lit("runtime_exception"))).when(code.isin(*inputs), told("query_input", code))
        .when(code.isin(*policy), told("fallback_policy", code)).when(chosen, told("gemini_selection", F.when(none, "gemini_rejected_all_candidates").otherwise(code)))
        .when(code == "resolved", told("local_recall", F.lit("no_compatible_candidates"))).when(code.endswith("_mismatch"), told("compatibility_filter", code)).otherwise(told("local_recall", code))
    )


def case_records(cases: DataFrame, results: DataFrame, diagnostics: DataFrame, coverage: DataFrame, key: str = "row_number") -> DataFrame:
    """Cases with their result, diagnosis and coverage by row number; columns of the latter two have a prefix, missing counts are 0."""
    named = lambda df, prefix: df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])
    both = cases.join(results, key, "left").join(named(diagnostics, "diagnosis"), key, "left").join(named(coverage, "coverage"), key, "left")
    texts = [c for c, t in both.dtypes if t == "string" and c not in cases.columns]
    counts = [c for c, t in both.dtypes if t in ("int", "bigint", "double") and c not in cases.columns]
    return both.na.fill("", texts).na.fill(0, counts)


# --- rules of types as data


@dataclass(frozen=True)
class TextRule:
    """A code for texts that have a word of each group and none of others."""

    code: str
    groups: tuple[tuple[str, ...], ...]
    none_of: tuple[str, ...] = ()


def first_rule(normal: Column, rules: Sequence[TextRule], default: str = "other") -> Column:
    """The code of the first rule, in order, that fits a normal text. Rule tables are documents of bounded size."""
    fits = lambda r: reduce(lambda a, g: a & holds(normal, g), r.groups, F.lit(True)) & ~holds(normal, r.none_of)
    return decide.first_match([(fits(r), r.code) for r in rules], default)


def effective_type(entity_type: Column, normal: Column, rules: Sequence[tuple[str, TextRule]]) -> Column:
    """The type that a rule for the item's type (or for any, "*") makes of its text; else the type itself."""
    return F.coalesce(*[F.when((F.lit(of == "*") | (entity_type == of)) & (first_rule(normal, [r], "") != ""), r.code) for of, r in rules], entity_type)
