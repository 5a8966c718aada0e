"""Quality tables: families and branches, coverage, diagnostics, golden cases, run statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from .decide import first_match


def branch_family_summary(items: DataFrame, branch: Column, family: Column) -> DataFrame:
    """(branch, branch_total_rows, effective_family, rows_count, share): blanks are left out, families in lower case."""
    rows = items.select(branch.alias("branch"), F.lower(family).alias("effective_family")).where("branch <> '' and effective_family <> ''")
    counts = rows.groupBy("branch", "effective_family").agg(F.count(F.lit(1)).alias("rows_count"))
    total = F.sum("rows_count").over(Window.partitionBy("branch"))
    return counts.withColumn("branch_total_rows", total).withColumn("share", F.round(F.col("rows_count") / F.col("branch_total_rows"), 6))


def branch_cleanup_audit(summary: DataFrame, least_rows: int = 100) -> DataFrame:
    """Branches whose mix of families looks wrong, with a score of how wrong."""
    ranked = summary.withColumn("r", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("rows_count"), "effective_family")))
    at = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    other = lambda c: F.coalesce(F.max(F.when(F.col("effective_family") == "other", F.col(c))), F.lit(0))
    listed = F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", F.concat(F.col("effective_family"), F.lit(" ("), F.col("rows_count").cast("string"), F.lit(")")).alias("t")))))
    wide = ranked.groupBy("branch").agg(
        F.max("branch_total_rows").alias("branch_total_rows"), F.count(F.lit(1)).alias("family_count"), at("effective_family", 1).alias("top_family"), at("rows_count", 1).alias("top_family_rows"),
        at("share", 1).alias("top_family_share"), F.coalesce(at("effective_family", 2), F.lit("")).alias("second_family"), F.coalesce(at("rows_count", 2), F.lit(0)).cast("long").alias("second_family_rows"),
        F.coalesce(at("share", 2), F.lit(0.0)).alias("second_family_share"), other("rows_count").cast("long").alias("other_rows"), other("share").cast("double").alias("other_share"),
        F.array_join(F.transform(listed, lambda x: x["t"]), " | ").alias("top_families"),
    )
    odd = (F.col("top_family") == "other") | (F.col("top_family_share") < 0.85) | (F.col("second_family_share") >= 0.1) | (F.col("family_count") >= 5) | (F.col("other_share") >= 0.1)
    n = F.col("branch_total_rows")
    score = (1 - F.col("top_family_share")) * n + F.col("second_family_share") * n + F.greatest(F.lit(0), F.col("family_count") - 2) * 25 + F.col("other_share") * n
    return wide.where((n >= least_rows) & odd).withColumn("suspicious_score", F.round(score, 3))


def alignment_status(total: Column, other: Column) -> Column:
    share = other / total
    return F.when(total <= 0, "empty").when(other <= 0, "mapped").when(share >= 0.999, "all_other").when(share >= 0.8, "mostly_other").otherwise("mixed")


def branch_alignment(items: DataFrame, branch: str, family: str) -> DataFrame:
    per = items.groupBy(branch).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.lower(family) == "other").alias("other_rows"))
    return per.withColumn("other_share", F.round(F.col("other_rows") / F.col("total_rows"), 6)).withColumn("status", alignment_status(F.col("total_rows"), F.col("other_rows")))


def profile(items: DataFrame, by: Mapping[str, Sequence[str]]) -> DataFrame:
    """(dimension, key, n): counts of several groupings from one expanded scan."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("key")) for name, cols in by.items()])
    return items.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"))


def sample_rows(items: DataFrame, n: int, key: Column, seed: int = 17) -> DataFrame:
    """n rows that a seeded hash picks, the same on every run (a sampling operator)."""
    return items.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def gap_reason(incompatibility: Column) -> Column:
    c = F.coalesce(incompatibility, F.lit(""))
    return F.when(c == "", "other_spec_mismatch").when(c == "catalog_missing_family", "missing_family").otherwise(first_match([(F.contains(c, F.lit(part)), reason) for part, reason in v.GAP_REASONS], "other_spec_mismatch"))


def coverage_audit(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries (query_id, target: bool) and candidates (query_id, compatible: bool, incompatibility, name, score) -> a row a request.

    Counts, reasons and examples come from partial aggregates: reasons are counted per (request, reason) first.
    """
    counts = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("same_family"), F.count_if("compatible").alias("compatible_candidates"), F.max_by("name", F.struct("score", "name")).alias("best_example"))
    per = candidates.where("not compatible").groupBy("query_id", gap_reason(F.col("incompatibility")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    tops = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "reason", "n"))).alias("rs"))
    ties = F.size(F.filter("rs", lambda r: r["n"] == F.get("rs", F.lit(0))["n"]))
    both = queries.join(counts, "query_id", "left").join(tops, "query_id", "left").na.fill(0, ["same_family", "compatible_candidates"])
    diagnosis = F.when(~F.col("target"), "non_target_family").when(F.col("same_family") == 0, "catalog_missing_family").when(F.col("compatible_candidates") == 0, "catalog_has_family_but_no_compatible_specs").otherwise("catalog_has_compatible_candidates")
    gap = F.when(F.col("diagnosis") == "catalog_missing_family", "missing_family").when(F.col("diagnosis") != "catalog_has_family_but_no_compatible_specs", "").when(ties > 1, "multiple_spec_mismatches").otherwise(F.coalesce(F.get("rs", F.lit(0))["reason"], F.lit("other_spec_mismatch")))
    return both.withColumn("diagnosis", diagnosis).withColumn("gap_reason_code", gap).drop("rs")


def coverage_summary(audit: DataFrame, family: str) -> DataFrame:
    """A row a family: requests by diagnosis."""
    kinds = ("catalog_missing_family", "catalog_has_family_but_no_compatible_specs", "catalog_has_compatible_candidates")
    return audit.where("diagnosis <> 'non_target_family'").groupBy(family).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("diagnosis") == k).alias(k) for k in kinds])


#: Codes that say the request itself, the search or the policy is at fault. They are parameters of reason_class.
INPUT_CODES, SEARCH_CODES, POLICY_CODES = ("query_empty", "section_row", "header_row"), ("no_candidates_found", "branch_not_found"), ("strict_fallback_rejected", "weak_match_rejected")


def reason_class(stage: Column, code: Column, inputs: Sequence[str] = INPUT_CODES, search: Sequence[str] = SEARCH_CODES, policy: Sequence[str] = POLICY_CODES) -> Column:
    s, c = F.coalesce(F.nullif(F.trim(stage), F.lit("")), F.lit("runtime_error")), F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit("resolved"))
    return first_match(
        [(s == "resolved", "resolved"), (s.isin("query_input", "query_classification") | c.isin(*inputs), "input_or_query_shape"), (c.isin(*search), "search_layer_gap"), (s == "catalog_gap", "catalog_gap"),
         (s.isin("gemini_selection", "fallback_policy") | c.isin(*policy), "gemini_or_decision_policy"), ((s == "runtime_error") | (c == "runtime_exception"), "runtime_error")],
        "matcher_retrieval_or_ranking",
    )


def diagnostics_summary(rows: DataFrame, stage: str, code: str) -> DataFrame:
    """(metric, key, n): resolved and unresolved rows, and histograms of stage, class and code."""
    keyed = rows.select(F.col(stage).alias("stage"), F.coalesce(F.col(code), F.lit("resolved")).alias("code"), reason_class(F.col(stage), F.col(code)).alias("class"))
    resolved = F.when(F.col("stage") == "resolved", "resolved").otherwise("unresolved")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), k.alias("key")) for m, k in (("outcome", resolved), ("stage", F.col("stage")), ("class", F.col("class")), ("code", F.col("code")))])
    return keyed.select(F.explode(pairs).alias("p")).groupBy("p.metric", "p.key").agg(F.count(F.lit(1)).alias("n"))


def joined_diagnostics(results: DataFrame, diagnostics: DataFrame, key: str = "run_row_number") -> DataFrame:
    """results with the columns of their diagnostics; columns of both take the diagnosis where there is one."""
    both = [c for c in diagnostics.columns if c in results.columns and c != key]
    d = diagnostics.select(key, *[F.col(c).alias(f"__d_{c}") for c in diagnostics.columns if c != key])
    joined = results.join(d, key, "left")
    merged = joined.withColumns({c: F.coalesce(f"__d_{c}", c) for c in both}) if both else joined
    new = [c for c in diagnostics.columns if c != key and c not in both]
    return merged.withColumnsRenamed({f"__d_{c}": c for c in new}).drop(*[f"__d_{c}" for c in both])


def score_case(outcome: Column, auto: Column, fits: Column, found: Column, expected: Column, forbidden: Column, allowed: Column, resolver: Column, review: Column, open_: Column, refused: Column) -> Column:
    """struct(passed, bucket) of a golden case: exact, review, catalog_gap or non_target."""
    right, wrong = (found != "") & F.array_contains(expected, found), (found != "") & F.array_contains(forbidden, found)
    permitted = (F.size(allowed) == 0) | F.array_contains(allowed, resolver)
    exact, reviewed = auto & fits & right & permitted, (open_ | review | ~auto) & ~wrong
    passed = F.when(outcome == "exact", exact).when(outcome == "review", reviewed).when(outcome == "catalog_gap", open_ & ~auto).when(outcome == "non_target", refused & ~auto).otherwise(False)
    bucket = F.when(passed & ~wrong, "").when((outcome == "exact") & ~exact, "false_negative").when((outcome == "review") & ~reviewed, F.when(auto, "false_positive").otherwise("review_policy_miss")).when(~passed, "false_positive").otherwise("forbidden_article")
    return F.struct((passed & (bucket == "")).alias("passed"), bucket.alias("bucket"))


def benchmark_summary(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """cases (passed, auto_accept, bucket) per group: counts, pass rate and precision of acceptance (null if nothing was accepted)."""
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if("auto_accept").alias("auto_accepts"), F.count_if(F.col("bucket") == "false_positive").alias("false_positives"),
        F.count_if(F.col("bucket") == "false_negative").alias("false_negatives"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"),
        F.round(F.try_divide(F.count_if(F.col("auto_accept") & F.col("passed")).cast("double"), F.count_if("auto_accept")), 4).alias("auto_accept_precision"),
    )


def benchmark_metrics(cases: DataFrame) -> DataFrame:
    share = lambda of, where: F.round(F.try_divide(F.count_if(of & where).cast("double"), F.count_if(where)), 4)
    passed, auto, outcome = F.col("passed"), F.col("auto_accept"), F.col("outcome")
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if("passed").alias("passed_cases"), F.count_if(~passed).alias("failed_cases"), F.count_if("auto_accept").alias("auto_accepts"), share(passed, auto).alias("auto_accept_precision"),
        share(F.col("bucket") == "false_positive", outcome == "catalog_gap").alias("catalog_gap_false_positive_rate"), share(passed, outcome == "review").alias("review_capture_rate"),
    )


def conditional_counts(rows: DataFrame, conditions: Mapping[str, Column], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """All counters and sums of a run in one aggregation."""
    return rows.agg(F.count(F.lit(1)).alias("rows_total"), *[F.count_if(c).alias(k) for k, c in conditions.items()], *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (sums or {}).items()])


def branch_context(items: DataFrame, branch: str, name: str, order: str, n: int = 3) -> DataFrame:
    """(branch, names): the first n distinct names of each branch in order of appearance."""
    first = items.groupBy(branch, name).agg(F.min(order).alias("o"))
    some = first.withColumn("r", F.row_number().over(Window.partitionBy(branch).orderBy("o", name))).where(F.col("r") <= n)
    return some.groupBy(branch).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", name))), lambda x: x[name]).alias("names"))


def matching_branches(branches: DataFrame, selections: DataFrame, branch: str = "branch", selection: str = "selection") -> DataFrame:
    """Branches that equal, lie below or lie above a selected one, by equal keys on ancestors of both sides."""
    from ..functions.text import branch_ancestors

    b = branches.select(branch).distinct()
    s = selections.select(selection).distinct()
    below = b.withColumn("a", F.explode(branch_ancestors(F.col(branch)))).join(s, F.col("a") == F.col(selection)).select(branch)
    above = s.withColumn("a", F.explode(branch_ancestors(F.col(selection)))).join(b, F.col("a") == F.col(branch)).select(branch)
    return below.union(above).distinct()


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, c: a & c, conditions)
