"""Building the catalogue: sources, cleaning, merging, search projection. One lineage, one shuffle on the dedupe key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as v
from ..operators import clean, merge, rules
from ..sources import csv

BRANCH_RULES = tuple((p, v.BRANCH_SEPARATOR.join(path)) for patterns, path, _ in v.KEYWORD_ROUTES for p in patterns)


def build(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The merged catalogue of source files, in the order of their paths."""
    cleaned = [clean.cleaned(csv.convert_csv(csv.read_csv(spark, p))) for p in sorted(paths)]
    return merge.merge_by_priority(merge.union_sources(cleaned))


def project(items: DataFrame, families: Sequence[rules.Family] = (), branch_rules: Sequence[tuple[str, str]] = BRANCH_RULES, name: str = v.NAME, article: str = v.ARTICLE, class_name: str = "Название класса", item_type: str = "Тип изделия") -> DataFrame:
    """items with the search columns: row_idx, normal form, tokens, branch, type, family and attributes."""
    col = lambda c: F.col(f"`{c}`") if c in items.columns else F.lit("")
    branch = rules.branch([col(class_name), col(item_type)], col(name), branch_rules)
    marks = rules.markers(col(name))
    best = rules.classify(col(name), families, marks) if families else F.lit(None).cast("struct<family:string,entity_type:string,confidence:double>")
    kind = F.coalesce(best["entity_type"], F.lit("other"))
    return items.withColumns({
        "branch_path": branch, "normalized_name": text.normal(col(name)), "tokens": text.token_set(col(name)), "entity_type": kind,
        "effective_family": F.coalesce(best["family"], rules.family_of(kind, families)), "markers": marks,
    }).withColumns({"branch_leaf": text.branch_leaf(F.col("branch_path")), "row_idx": text.stable_row_id(col(name), col(article), F.col("branch_path"))})
