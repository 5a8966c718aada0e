"""Decisions: ordered rules, soft filters, compatibility, the ladder of lanes, the verifier."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v


def first_match(rules: Sequence[tuple[Column, str]], default: str = "") -> Column:
    """The code of the first rule, in order, whose condition holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules], F.lit(default))


def soft_filter(candidates: DataFrame, keep: Column, key: str = "query_id") -> DataFrame:
    """Candidates that hold the condition; all of a request's, if none does.

    Keys with a hit are a partial aggregate and come back by an anti-join, whose hot partitions Spark splits.
    """
    hit = F.coalesce(keep, F.lit(False))
    some = candidates.where(hit).select(key).distinct()
    return candidates.where(hit).unionByName(candidates.where(~hit).join(some, key, "left_anti").select(*candidates.columns))


def soft_filters(candidates: DataFrame, rules: Iterable[Column], key: str = "query_id") -> DataFrame:
    """Soft filters one after the other: each keeps the candidates that hold it among those that are left, or all of them.

    A candidate's hits are the bits of a number. A request has few different numbers, which one partial aggregation collects; what the
    chain leaves of them is worked out there, and the candidates that have one of these stay: one join, however many rules.
    """
    listed = list(rules)
    if not listed:
        return candidates
    if len(listed) > 62:
        return soft_filters(soft_filters(candidates, listed[:62], key), listed[62:], key)
    bits = reduce(lambda a, x: a.bitwiseOR(F.when(F.coalesce(x[1], F.lit(False)), F.lit(1 << x[0])).otherwise(F.lit(0)).cast("long")), enumerate(listed), F.lit(0).cast("long"))
    marked = candidates.withColumn("__hits", bits)

    def step(left: Column, i: Column) -> Column:
        hit = F.filter(left, lambda p: F.expr("1L") == F.call_function("shiftright", p, i).bitwiseAND(F.lit(1).cast("long")))
        return F.when(F.size(hit) > 0, hit).otherwise(left)

    chain = F.aggregate(F.sequence(F.lit(0), F.lit(len(listed) - 1)), F.collect_set("__hits"), step)
    stay = marked.groupBy(F.col(key).alias("__key")).agg(chain.alias("__stay"))
    met = marked.join(stay, F.col(key).eqNullSafe(F.col("__key")))
    return met.where(F.array_contains("__stay", F.col("__hits"))).select(*candidates.columns)


def disjoint(a: Column, b: Column) -> Column:
    """Both have values and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def dimension_mismatch(query: str, item: str) -> Column:
    """A reason if both sides of a struct of signatures have a group with nothing in common."""
    any_group = reduce(lambda x, g: x | disjoint(F.col(f"{query}.{g}"), F.col(f"{item}.{g}")), ("triples", "pairs", "lengths", "diameters"), F.lit(False))
    return F.when(any_group, "article_query_candidate_dimension_mismatch").otherwise("")


def ladder(lanes: Sequence[tuple[str, DataFrame]], key: str = "query_id") -> DataFrame:
    """For each request the row of the first lane that has one (ties: score, then row_idx), with lane and ordinal.

    Rows of all lanes are reduced by one aggregation, so lanes may be of any size and a request is never gathered.
    """
    parts = [df.withColumn("lane", F.lit(name)).withColumn("ordinal", F.lit(i)) for i, (name, df) in enumerate(lanes)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in every.columns if c != key]
    order = F.struct("ordinal", (-F.coalesce(F.col("score"), F.lit(0.0))).alias("s"), "row_idx")
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("b")).select(key, "b.*")


def unresolved(queries: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Requests that a lane has not answered: what the next, dearer lane looks at."""
    return queries.join(done.select(key).distinct(), key, "left_anti")


def confidence(score: Column, review: Column) -> Column:
    return F.when(review, F.when(score >= 0.8, "medium").otherwise("low")).when(score >= v.CONFIDENT, "high").when(score >= 0.75, "medium").otherwise("low")


def verifier(row_type: Column, compatibility: Column, source: Column, review: Column, accept: Iterable[str] = v.AUTO_ACCEPT_SOURCES, reject_types: Iterable[str] = ("section",)) -> tuple[Column, Column]:
    """(decision, reason): rejected kinds of rows, then incompatible ones to review, then accepted sources, else review."""
    rejected, fits, trusted = row_type.isin(*reject_types), compatibility == "compatible", source.isin(*accept)
    decision = F.when(rejected, "reject").when(fits & trusted, "auto_accept").otherwise("review")
    status = F.when(compatibility == "", "unknown").otherwise(F.coalesce(compatibility, F.lit("unknown")))
    reason = (
        F.when(rejected, F.concat(F.lit("reject_row_type:"), row_type)).when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("compatibility:"), status))
        .when(trusted, F.concat(F.lit("auto_accept_source:"), source)).when(review, "requires_review_flag").otherwise("default_review")
    )
    return decision, reason


def cost_columns(df: DataFrame, price: str = "price", quantity: str = "quantity") -> DataFrame:
    """Unit cost, total where both are known, and an empty labour cost."""
    return df.withColumns({"unit_cost": F.col(price), "total_cost": F.col(price) * F.col(quantity), "labour_cost": F.lit(None).cast("double")})


def with_article(text_col: Column, article: Column) -> Column:
    """The request's text with its article in brackets, unless it names it already."""
    return F.when((F.coalesce(article, F.lit("")) != "") & ~F.contains(text_col, article), F.concat(text_col, F.lit(" ["), article, F.lit("]"))).otherwise(text_col)
