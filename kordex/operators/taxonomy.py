"""Work on the tree of branches: proposals for branches, guardrails, reports, and the hook of a language model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..functions import vocabulary as v


def needs_split(audit: DataFrame) -> Column:
    """Whether a row of the cleanup audit is a branch too wide and mixed to be one."""
    n, k, top = F.col("branch_total_rows"), F.col("family_count"), F.col("top_family_share")
    mixed = ((n >= 20_000) & (k >= 5) & (top < 0.9)) | ((n >= 5_000) & (k >= 6) & (top < 0.8)) | ((n >= 1_000) & (k >= 8) & (top < 0.7))
    return mixed & ((F.col("second_family_share") >= 0.03) | (F.col("other_share") >= 0.08))


def new_family_candidate(split: Column) -> Column:
    """Whether a branch is mostly of no known family and not to be split: a gap in the taxonomy."""
    return (F.col("top_family") == "other") & (F.col("branch_total_rows") >= 100) & (F.col("top_family_share") >= 0.6) & (F.col("other_share") >= 0.6) & (F.col("family_count") <= 6) & ~split


def branch_key(c: Column) -> Column:
    return text.normal(text.branch_path(F.split(text.clean(c), r"\s*>\s*")))


def aligned(proposals: DataFrame, expected: DataFrame, least: float = 0.88, margin: float = 0.05) -> DataFrame:
    """proposals (proposal_id, branch) -> (proposal_id, matched, method): exact, else the only equal key, else a clearly best likeness.

    Likeness is looked for among branches that share a stem of a word, an equi-join, not among all.
    """
    p = proposals.select("proposal_id", text.clean(F.col("branch")).alias("branch")).where("branch <> ''").withColumn("key", branch_key(F.col("branch")))
    e = expected.select(text.clean(F.col("branch")).alias("matched")).where("matched <> ''").distinct().withColumn("key", branch_key(F.col("matched")))
    exact = p.join(e.select("matched"), p["branch"] == e["matched"]).select("proposal_id", "matched", F.lit("exact").alias("method"))
    left = p.join(exact.select("proposal_id"), "proposal_id", "left_anti").where("key <> ''")
    only = e.groupBy("key").agg(F.min("matched").alias("matched"), F.count(F.lit(1)).alias("n")).where("n = 1")
    equal = left.join(only, "key").select("proposal_id", "matched", F.lit("normalized_exact").alias("method"))
    rest = left.join(equal.select("proposal_id"), "proposal_id", "left_anti")
    stems = lambda df: df.withColumn("s", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("key", F.lit("([a-zа-я0-9]{2,})"), F.lit(1)), lambda t: F.substring(t, 1, 4)))))
    met = stems(rest).join(stems(e).withColumnRenamed("key", "ekey"), "s").select("proposal_id", "key", "ekey", "matched").distinct()
    tokens = lambda c: text.tokens(F.col(c))
    scored = met.withColumn("score", F.greatest(similarity.sequence_ratio("key", "ekey"), text.jaccard(tokens("key"), tokens("ekey"))))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("proposal_id").orderBy(F.desc("score"), "matched")))
    two = ranked.where("r <= 2").groupBy("proposal_id").agg(F.max_by("matched", -F.col("r")).alias("matched"), F.max("score").alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    fuzzy = two.where((F.col("best") >= least) & (F.col("best") - F.coalesce("second", F.lit(0.0)) >= margin)).select("proposal_id", "matched", F.lit("fuzzy").alias("method"))
    return exact.unionByName(equal).unionByName(fuzzy)


def probe_report(summary: DataFrame) -> DataFrame:
    """(branch, rows_total, families): each branch with its families as an array by descending counts."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("rows_count")).alias("less"), F.col("effective_family").alias("family"), "rows_count", "share")))
    per = summary.groupBy("branch").agg(F.max("branch_total_rows").alias("rows_total"), listed.alias("f"))
    return per.select("branch", "rows_total", F.transform("f", lambda x: F.struct(x["family"].alias("family"), x["rows_count"].alias("rows_count"), x["share"].alias("share"))).alias("families"))


def frequent_branches(items: DataFrame, branch: str, k: int = 3) -> DataFrame:
    """The k branches with most items: where a request without a better clue looks."""
    return items.groupBy(branch).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), branch).limit(k)


def matches_selection(branches: DataFrame, selections: DataFrame) -> DataFrame:
    """Branches that equal, contain or lie in a selected one, or share a word's stem with its last segment below the same root."""
    from .audit import matching_branches

    b, s = branches.select("branch").distinct(), selections.select("selection").distinct()
    first = lambda c: F.split(c, v.BRANCH_SEPARATOR)[0]
    deep = lambda c: F.contains(F.col(c), F.lit(v.BRANCH_SEPARATOR))
    bk = b.withColumn("stem", F.explode(text.stem_keys(F.col("branch"))))
    sk = s.where(deep("selection")).withColumn("stem", F.explode(text.stem_keys(text.branch_leaf(F.col("selection")))))
    alike = bk.join(sk, "stem").where(~deep("branch") | (first("branch") == first("selection"))).select("branch")
    return matching_branches(branches, selections).union(alike).distinct()


def parse_reply(reply: str | None) -> object:
    """JSON from a model's text: fenced, or from its first bracket on."""
    t = (reply or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", t, re.S | re.I)
    starts = [i for i in (t.find("{"), t.find("[")) if i >= 0]
    for candidate in ([fenced[1].strip()] if fenced else []) + [t] + ([t[min(starts) :]] if starts else []):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    raise ValueError("the reply has no JSON")


def with_chooser(open_requests: DataFrame, choose: Callable[[str, list[str]], str] | None) -> DataFrame:
    """open_requests (query_id, text, options: array<string>) with `chosen`; null without a chooser, which is the default.

    choose(text, options) returns a reply with JSON {"index": n}; a reply that fails leaves the request open.
    """
    if choose is None:
        return open_requests.withColumn("chosen", F.lit(None).cast("string"))

    def ask(frames):
        for pdf in frames:
            out = []
            for t, options in zip(pdf["text"], pdf["options"], strict=True):
                try:
                    out.append(list(options)[int(parse_reply(choose(t, list(options)))["index"])])
                except (ValueError, KeyError, IndexError, TypeError):
                    out.append(None)
            yield pdf.assign(chosen=pd.Series(out, index=pdf.index, dtype="object"))

    return open_requests.mapInPandas(ask, f"{open_requests._jdf.schema().toDDL()}, chosen string")
