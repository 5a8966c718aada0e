"""Lookups of requests in the catalogue: exact, unique, prefix, typo and affinity joins.

Each is an equi-join on a derived key with a residual condition; none compares all pairs. Requests are
(query_id, ...) rows, items (row_idx, ...) rows; both are keyed by expressions, so sides may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text

#: Pairs that one part of a group of equal designations makes at most, as far as its requests can be dealt.
PAIRS = 20_000_000


def first_by(df: DataFrame, key: str, *order: Column, k: int = 1) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def exact_first(queries: DataFrame, items: DataFrame, query_key: Column, item_key: Column) -> DataFrame:
    """(query_id, row_idx): for each request the first item with its key. Items are reduced to one a key before the join."""
    one = items.withColumn("k", item_key).where("k <> ''").groupBy("k").agg(F.min("row_idx").alias("row_idx"))
    return queries.select("query_id", query_key.alias("k")).join(one, "k").select("query_id", "row_idx")


def unique_article(queries: DataFrame, items: DataFrame, query_article: Column, item_article: Column) -> DataFrame:
    """(query_id, row_idx): items whose article no other item has."""
    one = items.withColumn("k", text.article_key(item_article)).where("k <> ''").groupBy("k").agg(F.min("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return queries.select("query_id", text.article_key(query_article).alias("k")).join(one, "k").select("query_id", "row_idx")


def beginnings(items: DataFrame, c: str, least: int, own: bool) -> DataFrame:
    """items once for each beginning (k) of column c that has `least` characters or more; own: the whole text is one too."""
    end = F.length(c) - (0 if own else 1)
    return items.where(end >= least).withColumn("n", F.explode(F.sequence(F.lit(least), end))).withColumn("k", F.substring(F.col(c), F.lit(1), F.col("n"))).drop("n")


def article_series(queries: DataFrame, items: DataFrame, query_article: Column, item_article: Column, least: int = 5, limit: int | None = 40) -> DataFrame:
    """(query_id, row_idx): up to limit items (None: all) whose compact article goes on from the request's.

    Items offer each beginning of `least` characters or more as a key, which must equal the request's whole article:
    an item has as many rows as its article is longer, and a key meets its true matches only.
    """
    q = queries.select("query_id", text.article_compact(query_article).alias("k")).where(F.length("k") >= least)
    i = items.select("row_idx", text.article_compact(item_article).alias("i"))
    met = q.join(beginnings(i, "i", least, own=False), "k")
    return (met if limit is None else first_by(met, "query_id", F.col("row_idx"), k=limit)).select("query_id", "row_idx")


def article_typo(queries: DataFrame, items: DataFrame, query_article: Column, item_article: Column, limit: int | None = 10) -> DataFrame:
    """(query_id, row_idx, score): up to limit items (None: all) that differ from the request's article in one digit among its last two signs."""
    def keyed(c: str) -> Column:
        return F.struct(F.length(c), F.substring(F.col(c), F.lit(1), F.greatest(F.lit(4), F.length(c) - 2)))

    q = queries.select("query_id", text.article_compact(query_article).alias("q")).where("length(q) >= 6").withColumn("k", keyed("q"))
    i = items.select("row_idx", text.article_compact(item_article).alias("i")).where("length(i) >= 6").withColumn("k", keyed("i"))
    met = q.join(i, "k").where(similarity.single_digit_typo(F.col("q"), F.col("i")))
    scored = met.withColumn("score", similarity.article_affinity(F.col("q"), F.col("i")))
    return (scored if limit is None else first_by(scored, "query_id", F.desc("score"), F.col("row_idx"), k=limit)).select("query_id", "row_idx", "score")


def affinity_terms(compact: Column) -> Column:
    """The article and its two longest blocks of four digits or more: beginnings to look for."""
    blocks = F.array_distinct(F.filter(F.regexp_extract_all(compact, F.lit("([0-9]+)"), F.lit(1)), lambda b: F.length(b) >= 4))
    longest = F.slice(F.transform(F.array_sort(F.transform(blocks, lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b")))), lambda x: x["b"]), 1, 2)
    return F.array_distinct(F.concat(F.array(compact), longest))


def article_affinity(queries: DataFrame, items: DataFrame, query_article: Column, item_article: Column, least: float = 0.45, limit: int = 20) -> DataFrame:
    """(query_id, row_idx, score): items that begin with a term of the request's article and resemble it enough."""
    q = queries.select("query_id", text.article_compact(query_article).alias("q")).where("length(q) >= 4").withColumn("k", F.explode(affinity_terms(F.col("q"))))
    i = items.select("row_idx", text.article_compact(item_article).alias("i"))
    met = q.join(beginnings(i, "i", 4, own=True), "k").select("query_id", "row_idx", "q", "i").distinct()
    scored = met.withColumn("score", similarity.article_affinity(F.col("q"), F.col("i"))).where(F.col("score") >= least)
    return first_by(scored, "query_id", F.desc("score"), F.col("row_idx"), k=limit).select("query_id", "row_idx", "score")


def add_absent(pool: DataFrame, more: DataFrame, keys: tuple[str, ...] = ("query_id", "row_idx")) -> DataFrame:
    """pool and those rows of more whose keys it does not have."""
    return pool.unionByName(more.join(pool.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def cached(queries: DataFrame, cache: DataFrame, text_col: Column, article: Column, stamp: str = "stored_at") -> DataFrame:
    """queries with the latest stored result of the same normalised text and article (a struct, null if there is none)."""
    rest = [c for c in cache.columns if c not in ("query_hash", stamp)]
    latest = cache.groupBy("query_hash").agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("hit"))
    return queries.withColumn("query_hash", text.query_hash(text_col, article)).join(latest, "query_hash", "left")


def designated(df: DataFrame, c: Column) -> DataFrame:
    """Rows of df whose text has a cable designation, with its words (base) and its dimension."""
    parts = F.split(F.col("__signature"), r"\|")
    return df.withColumn("__signature", similarity.designation_signature(c)).where("__signature <> ''").withColumns({"base": F.split(parts[0], " "), "dimension": parts[1]}).drop("__signature")


def cable_designation(queries: DataFrame, items: DataFrame, query_text: Column, item_text: Column, slack: int = 3) -> DataFrame:
    """(query_id, row_idx): items with the same dimension in the same order whose base has each word of the request's, up to `slack` letters longer.

    Designations are compared once each, however many texts have them: distinct ones of items offer each of their words, and it cut by
    up to `slack` letters, with the dimension as an equal key; a distinct one of requests looks up its longest word. Common dimensions alone
    are no key. An item's designation has at most 4 * (slack + 1) rows. Rows then meet by equal keys, PAIRS of a group at a time.
    """
    spread = lambda df, key, t: designated(df.select(key, t.alias("t")), F.col("t")).select(key, "dimension", "base")
    q, i = spread(queries, "query_id", query_text), spread(items, "row_idx", item_text)
    counts = lambda df, n: df.groupBy("dimension", "base").agg(F.count(F.lit(1)).alias(n))
    longest = F.array_max(F.transform("base", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    cut = lambda w: F.transform(F.sequence(F.greatest(F.lit(1), F.length(w) - slack), F.length(w)), lambda n: F.substring(w, F.lit(1), n))
    asked = counts(q, "nq").select("dimension", longest.alias("word"), F.col("base").alias("wanted"), "nq")
    offered = counts(i, "ni").select("dimension", "base", "ni", F.explode(F.array_distinct(F.flatten(F.transform("base", cut)))).alias("word"))
    inside = F.forall("wanted", lambda t: F.exists("base", lambda u: F.startswith(u, t) & (F.length(u) - F.length(t) <= slack)))
    met = asked.join(offered, ["dimension", "word"]).where(inside)
    deals = F.ceil(F.col("nq") * F.col("ni") / F.lit(PAIRS))
    # A group's requests are dealt over its parts, its items go to each of them.
    parted = met.select("dimension", "wanted", "base", F.least(deals, F.col("nq")).cast("int").alias("parts"))
    mine = q.withColumnRenamed("base", "wanted").join(parted, ["dimension", "wanted"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    theirs = i.join(parted, ["dimension", "base"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    told = ["dimension", "wanted", "base", "part"]
    return mine.select("query_id", *told).join(theirs.select("row_idx", *told).hint("shuffle_hash"), told).select("query_id", "row_idx")
