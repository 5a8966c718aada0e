"""Matching of requests: lanes from exact to similar, each over what the lanes before left open, then one decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..functions import vocabulary as v
from ..operators import candidates, decide, filters, lookup, retrieve, rules

#: Exact lanes in order, with the score of their finds.
LANES = (("article_exact", 1.0), ("designation_exact", 0.995), ("article_series_local", 0.985), ("article_typo_local", 0.955), ("name_exact", 1.0), ("normalized_name_exact", 0.98))

#: Markers whose unlike values rule an item out, in order, with the code of the reason.
HARD = (
    ("connector_pair", "connector_mismatch"), ("category", "category_mismatch"), ("shielding", "shielding_mismatch"), ("port_count", "port_count_mismatch"), ("cable_environment", "cable_environment_mismatch"),
    ("designation_family", "designation_family_mismatch"), ("sensor_kind", "sensor_type_mismatch"), ("fiber_mode", "optical_marker_mismatch"),
)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, so that plans do not repeat it in each lane that reads it.

    Its size is unknown to the planner. A checkpoint keeps the estimate of its plan, which comes from the compressed bytes of the tables read and lets whole
    catalogues pass as small enough for the driver to broadcast; of unknown size, a side is broadcast only once a shuffle has measured it.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    held = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def judged(found: DataFrame, asked: DataFrame, offered: DataFrame, by_article: bool = False) -> DataFrame:
    """found (query_id, row_idx, score) without incompatible items, with the penalty of the others.

    asked (query_id, qm, qd, low) and offered (row_idx, im, idm, whole) have markers, dimensions and texts in lower case. An
    article's find must also agree in its words and dimensions.
    """
    both = found.join(asked.select("query_id", "qm", "qd", "low"), "query_id").join(offered.select("row_idx", "im", "idm", "whole"), "row_idx")
    reason = filters.hard_incompatibility(F.col("qm"), F.col("im"), HARD)
    if by_article:
        reason = candidates.article_sanity(reason, F.lit(""), F.col("low"), F.col("whole"), decide.dimension_mismatch("qd", "idm"))
    kept = both.where(reason == "").withColumn("penalty", retrieve.penalty(F.col("qm"), F.col("im")))
    return kept.select("query_id", "row_idx", "score", "penalty")


def fittest(found: DataFrame) -> DataFrame:
    """One row a request: the least penalty, then the best score, then the first item."""
    rest = ("row_idx", "score", "penalty")
    order = F.struct("penalty", (-F.col("score")).alias("s"), "row_idx")
    return found.groupBy("query_id").agg(F.min_by(F.struct(*rest), order).alias("b")).select("query_id", "b.*")


def local_scores(pool: DataFrame, prune: bool = True) -> DataFrame:
    """pool (query_id, row_idx, penalty, text, name, branch_path, qm, im, whole, branches) with lexical, score and rank.

    The score is the lexical one with what branches and attributes add or take. The sequence ratio, the dear part of it, adds a quarter
    at most: rows that cannot reach a request's two best nor its best compatible one are left out, unless prune is false.
    """
    gained = lambda base: retrieve.attribute_score(base + retrieve.branch_bonus(F.col("branches"), F.coalesce("branch_path", F.lit(""))), F.lit(False), F.col("qm"), F.col("im"), F.col("whole"), F.lit(""))
    shared = pool.withColumn("shared", F.lit(v.JACCARD_WEIGHT) * text.jaccard(text.tokens(F.col("text")), text.tokens(F.col("name"))))
    if prune:
        least = shared.withColumns({"least": gained(F.col("shared")), "most": gained(F.col("shared") + v.RATIO_WEIGHT)})
        own = Window.partitionBy("query_id")
        placed = least.withColumn("place", F.row_number().over(own.orderBy(F.desc("least"), "row_idx")))
        second = F.coalesce(F.max(F.when(F.col("place") == 2, F.col("least"))).over(own), F.lit(0.0))
        fit = F.coalesce(F.max(F.when(F.col("penalty") < v.WEAK_FROM, F.col("least"))).over(own), F.lit(1.0))
        shared = placed.withColumn("bar", F.least(second, fit)).where("most >= bar").drop("least", "most", "place", "bar")
    scored = shared.withColumn("lexical", F.col("shared") + F.lit(v.RATIO_WEIGHT) * similarity.sequence_ratio(text.normal(F.col("text")), text.normal(F.col("name"))))
    scored = scored.withColumn("score", gained(F.col("lexical")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("lexical"), "row_idx")))


def chosen(ranked: DataFrame, gaps: DataFrame) -> DataFrame:
    """(query_id, row_idx, score, penalty, lane): the first compatible row of each request in rank order, else its first row.

    It is local_tree if it is the first of all, sure, ahead of the second row and in a branch ahead of the second branch.
    """
    weak = F.col("penalty") >= v.WEAK_FROM
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    best = ranked.groupBy("query_id").agg(F.min_by(F.struct("row_idx", "score", "penalty", "rank"), F.struct(weak, "rank")).alias("b"), at(2).alias("second"))
    lead = F.col("score") - F.coalesce("second", F.lit(0.0))
    told = best.select("query_id", "b.*", "second").join(gaps.select("query_id", "gap"), "query_id", "left")
    sure = (F.col("rank") == 1) & (F.col("score") >= v.CONFIDENT) & (lead >= v.MARGIN) & (F.coalesce("gap", F.lit(0.0)) >= v.BRANCH_GAP)
    lane = F.when(weak, "weak_compatible_fallback").when(sure, "local_tree").otherwise("compatible_local_fallback")
    return told.select("query_id", "row_idx", "score", "penalty", lane.alias("lane"))


def match(queries: DataFrame, items: DataFrame, shortlist: int = 96) -> DataFrame:
    """queries (query_id, text, article) and items (row_idx, name, article, branch_path, tokens, markers if stored) -> a row a request.

    An article named in the text stands in for one that the request has not, or overrides it. Exact lanes are equi-joins, each
    over the requests that those before left open; their candidates are judged first: incompatible ones go, and what is left has its label by
    the penalty. What no lane answers is scored: the `shortlist` items that share most tokens, and those whose article resembles the request's.
    """
    named, has = text.extract_article(F.col("text")), text.article_key(F.col("article")) != ""
    from_text = (named != "") & (~has | candidates.override_article(F.col("text"), F.col("article"), named))
    q = queries.withColumns({
        "kind": text.row_type(F.col("text")), "tokens": text.token_set(F.col("text")), "qm": rules.markers(F.col("text")), "qd": similarity.dimension_signatures(F.col("text")),
        "low": F.lower(text.clean(F.col("text"))), "from_text": from_text, "article": F.when(from_text, named).otherwise(F.col("article")),
    })
    q = cut(q)
    derived = rules.markers(F.col("name"))
    offered = cut(items.withColumns({
        "im": F.coalesce(F.col("markers"), derived) if "markers" in items.columns else derived, "idm": similarity.dimension_signatures(F.col("name")),
        "whole": F.lower(F.concat_ws(" ", text.clean(F.col("name")), "branch_path")),
    }))
    asked, article = q.where("kind = 'item'"), F.col("article")

    def firsts(key: Column) -> DataFrame:
        """The first item of each key and each set of markers: the others with that key would be judged alike."""
        one = offered.withColumns({"k": key, "m": F.array_sort(F.map_entries("im"))}).where("k <> ''")
        return one.groupBy("k", "m").agg(F.min("row_idx").alias("row_idx"))

    def by_name(open_: DataFrame, form) -> DataFrame:
        return open_.select("query_id", form(F.col("text")).alias("k")).join(firsts(form(F.col("name"))), "k")

    found_by = {
        "article_exact": lambda open_: lookup.unique_article(open_, offered, article, article),
        "designation_exact": lambda open_: lookup.cable_designation(open_, firsts(similarity.designation_signature(F.col("name"))).join(offered.select("row_idx", "name"), "row_idx"), F.col("text"), F.col("name")),
        "article_series_local": lambda open_: lookup.article_series(open_, offered, article, article, limit=None),
        "article_typo_local": lambda open_: lookup.article_typo(open_, offered, article, article, limit=None),
        "name_exact": lambda open_: by_name(open_, lambda c: F.lower(text.clean(c))),
        "normalized_name_exact": lambda open_: by_name(open_, text.normal),
    }
    done, left = [], asked
    for name, score in LANES:
        met = found_by[name](left)
        ranked = met if "score" in met.columns else met.withColumn("score", F.lit(score))
        best = fittest(judged(ranked, asked, offered, name.startswith("article"))).withColumn("score", F.lit(score))
        done.append((name, cut(best)))
        left = reduce(decide.unresolved, [d for _, d in done], asked)
    exact = decide.ladder(done)
    left = cut(left)
    pairs = ("query_id", "row_idx")
    near = retrieve.postings(left, offered).withColumn("score", F.lit(v.JACCARD_WEIGHT) * retrieve.jaccard_of(F.col("shared"), F.col("q_size"), F.col("i_size")))
    alike = judged(lookup.article_affinity(left, offered, article, article), left, offered, by_article=True).select(*pairs, "penalty")
    pool = lookup.add_absent(retrieve.top_k(judged(near, left, offered), shortlist).select(*pairs, "penalty"), alike, pairs)
    branches = retrieve.keyword_routes(left, text.normal(F.col("text")))
    routes = branches.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("branch", "score"))).alias("branches"))
    asking = left.select("query_id", "text", "qm").join(routes, "query_id", "left").withColumn("branches", F.coalesce("branches", F.from_json(F.lit("{}"), "map<string,double>")))
    ranked = cut(local_scores(pool.join(offered.select("row_idx", "name", "branch_path", "im", "whole"), "row_idx").join(asking, "query_id")).select(*pairs, "score", "penalty", "rank"))
    similar = chosen(ranked, candidates.branch_gap(branches)).withColumn("ordinal", F.lit(len(LANES)))
    found = exact.unionByName(similar, allowMissingColumns=True)
    results = q.join(found, "query_id", "left").join(offered.select("row_idx", F.col("name").alias("found_name"), F.col("article").alias("found_article"), "branch_path"), "row_idx", "left")
    lane, has = F.col("lane"), text.article_key(F.col("article")) != ""
    source = F.when((lane == "article_exact") & F.col("from_text"), "article_extracted_exact").when((lane == "designation_exact") & has, "article_designation_exact").otherwise(F.coalesce(lane, F.lit("unresolved")))
    status = F.when(F.col("row_idx").isNull(), "unresolved_no_compatible_candidates").otherwise(retrieve.compatibility(F.lit(""), F.col("penalty")))
    review = ~source.isin(*v.AUTO_ACCEPT_SOURCES)
    decision, reason = decide.verifier(F.col("kind"), status, source, review)
    return results.select(
        "query_id", "found_name", "found_article", "branch_path", F.coalesce("score", F.lit(0.0)).alias("score"), source.alias("resolution_source"), status.alias("compatibility_status"),
        decision.alias("verifier_decision"), reason.alias("verifier_reason"), decide.confidence(F.coalesce("score", F.lit(0.0)), decision != "auto_accept").alias("confidence_level"),
    )
