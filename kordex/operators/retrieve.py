"""Retrieval and ranking: inverted index, subtrees of branches, local scores, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..functions import vocabulary as v


def token_idf(items: DataFrame, tokens: Column) -> DataFrame:
    """(token, df, idf): ln((1 + N) / (1 + df)) + 1."""
    total = items.agg(F.count(F.lit(1)).alias("n"))
    df = items.select(F.explode_outer(F.array_distinct(tokens)).alias("token")).where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(total)).select("token", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode_outer(tokens).alias("token")).where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def token_sets(df: DataFrame, key: str, size: str) -> DataFrame:
    """(key, size, token): the distinct tokens of each row of df (key, tokens); a row without any has a null one.

    An outer explode, since Spark makes a filter of the other kind that computes the tokens once more.
    """
    return df.select(key, F.size("tokens").alias(size), F.explode_outer("tokens").alias("token"))


def postings(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, row_idx, shared, q_size, i_size): every item that shares a token with a request.

    queries (query_id, tokens) and items (row_idx, tokens). All tokens of a request are looked up. Items are dealt by row_idx
    before their tokens are looked up, so all hits of a pair meet where the item is: if the requests are small
    enough for Spark to broadcast, no pair moves, only each item's tokens, once. Sizes give Jaccard exactly.
    """
    index = token_sets(items.select("row_idx", F.array_distinct("tokens").alias("tokens")).repartition("row_idx"), "row_idx", "i_size")
    asked = token_sets(queries.select("query_id", F.array_distinct("tokens").alias("tokens")), "query_id", "q_size")
    counts = index.join(asked, "token").groupBy("row_idx", "query_id").agg(F.count(F.lit(1)).cast("int").alias("shared"), F.max("q_size").alias("q_size"), F.max("i_size").alias("i_size"))
    return counts.select("query_id", "row_idx", "shared", "q_size", "i_size")


def jaccard_of(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(0.0)


def top_k(scored: DataFrame, k: int, score: str = "score", *, key: str = "query_id", ties: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def subtree(queries: DataFrame, items: DataFrame, query_branch: str = "branch", item_branch: str = "branch_path") -> DataFrame:
    """queries joined with the items of their branch and of all below: items offer each of their ancestors as an equal key."""
    offers = items.withColumn("__ancestor", F.explode(text.branch_ancestors(F.col(item_branch))))
    return queries.join(offers, F.col(query_branch) == F.col("__ancestor")).drop("__ancestor")


def best_and_margin(ranked: DataFrame, key: str = "query_id", score: str = "score") -> DataFrame:
    """(key, best, second, margin): the gap from the first to the second score; the first alone counts whole."""
    best, second = F.max(F.when(F.col("rank") == 1, F.col(score))), F.max(F.when(F.col("rank") == 2, F.col(score)))
    return ranked.groupBy(key).agg(best.alias("best"), second.alias("second")).withColumn("margin", F.col("best") - F.coalesce("second", F.lit(0.0)))


def alternatives(ranked: DataFrame, label: Column, key: str = "query_id", limit: int = 3) -> DataFrame:
    """(key, alternatives): the runners-up joined by bars."""
    some = ranked.where((F.col("rank") >= 2) & (F.col("rank") <= 1 + limit))
    listed = F.array_sort(F.collect_list(F.struct("rank", label.alias("l"))))
    return some.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["l"]), " | ").alias("alternatives"))


def keyword_routes(queries: DataFrame, normal_text: Column, routes: tuple = v.KEYWORD_ROUTES) -> DataFrame:
    """(query_id, branch, score): each branch with the summed weights of its patterns found in the text. Routes are a fixed table."""
    hits = F.array(*[F.struct(F.lit(v.BRANCH_SEPARATOR.join(path)).alias("branch"), (F.lit(weight) * sum((F.contains(normal_text, F.lit(p)).cast("int") for p in patterns), F.lit(0))).alias("score")) for patterns, path, weight in routes])
    return queries.select("query_id", F.explode(hits).alias("h")).where("h.score > 0").groupBy("query_id", F.col("h.branch").alias("branch")).agg(F.sum("h.score").alias("score"))


def branch_bonus(scores: Column, branch: Column) -> Column:
    """scores: map of branch to score. A candidate in a branch gains min(.22, .04 s); below one, min(.18, .03 s)."""
    below = F.aggregate(F.map_entries(scores), F.lit(0.0), lambda a, e: F.greatest(a, F.when(F.startswith(branch, e["key"]), F.least(F.lit(0.18), e["value"] * 0.03)).otherwise(0.0)))
    own = F.try_element_at(scores, branch)
    return F.when(own.isNotNull(), F.least(F.lit(0.22), own * 0.04)).otherwise(F.coalesce(below, F.lit(0.0)))


def marker(markers: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(markers, F.lit(key)), F.lit(""))


def penalty(query_markers: Column, item_markers: Column, weights: tuple = v.MISMATCH) -> Column:
    """The sum of weights of markers that both sides have with unlike values."""
    one = lambda k, w: F.when((marker(query_markers, k) != "") & (marker(item_markers, k) != "") & (marker(query_markers, k) != marker(item_markers, k)), F.lit(w)).otherwise(0.0)
    return sum((one(k, w) for k, w in weights), F.lit(0.0))


def compatibility(hard_reason: Column, weak: Column) -> Column:
    return F.when(hard_reason != "", "incompatible").when(weak >= v.WEAK_FROM, "weakly_compatible").otherwise("compatible")


def attribute_score(base: Column, same_family: Column, query_markers: Column, item_markers: Column, item_text: Column, hard_reason: Column) -> Column:
    """The local score: family and equal markers add, missing category text, conflicts and penalties subtract; within [0, .999]."""
    score = base + F.when(same_family, 0.08).otherwise(0.0)
    for key, bonus in v.EQUAL_BONUS:
        score = score + F.when((marker(query_markers, key) != "") & (marker(query_markers, key) == marker(item_markers, key)), bonus).otherwise(0.0)
    category, rack = marker(query_markers, "category"), marker(query_markers, "rack_unit")
    score = score + F.when(category == "", 0.0).when(F.contains(item_text, category), 0.12).otherwise(-0.18)
    score = score + F.when(rack == "", 0.0).when(rack == "zero u", F.when(F.contains(item_text, F.lit("zero u")), 0.14).when(F.contains(item_text, F.lit("1u")), -0.18).otherwise(0.0)).when(F.contains(F.replace(item_text, F.lit(" "), F.lit("")), F.concat(rack, F.lit("u"))), 0.12).otherwise(0.0)
    for key, bonus in (("length_m", 0.06), ("current_a", 0.05)):
        score = score + F.when((marker(query_markers, key) != "") & F.contains(F.replace(item_text, F.lit(","), F.lit(".")), marker(query_markers, key)), bonus).otherwise(0.0)
    for when, patterns, weight in v.CONFLICT_RULES:
        asked = {"zero_u": rack == "zero u", "rack_1u": rack == "1", "category_cat6": category == "cat6", "category_cat5e": category == "cat5e"}[when]
        met = sum((F.contains(item_text, F.lit(p)).cast("int") for p in patterns), F.lit(0)) > 0
        score = score - F.when(asked & met, weight).otherwise(0.0)
    score = score - F.when(hard_reason != "", v.HARD_PENALTY).otherwise(penalty(query_markers, item_markers))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.999), score))


def lexical_score(candidates: DataFrame, query_text: Column, item_text: Column) -> DataFrame:
    """candidates with lexical: three quarters token Jaccard, one quarter sequence ratio."""
    return candidates.withColumn("lexical", similarity.lexical(text.tokens(query_text), text.tokens(item_text), text.normal(query_text), text.normal(item_text)))
