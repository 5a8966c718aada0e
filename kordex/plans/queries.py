"""Every operator as a query over the driver's tables, with the SQL that says the same.

The bridge: parts are catalogue items (their brand and number make an article, their type and brand a
branch, the last word of the name a family), line items are offers of suppliers, documents are free text.
All queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..functions import vocabulary as v
from ..operators import audit, clean, decide, filters, lookup, merge, proposals, retrieve, rules, taxonomy
from ..sources import tables
from . import catalogue, matching

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return note


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf}/{name}.parquet")
    return tables.spread(read, "doc_id") if name == "documents" else read


def items(spark: SparkSession, sf: str) -> DataFrame:
    """(row_idx, name, article, branch_path, family, price, tokens) of parts."""
    last = F.element_at(F.split(F.lower("p_name"), " "), -1)
    return t(spark, sf, "part").select(
        F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("name"), F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("article"),
        text.branch_path(F.array("p_type", "p_brand")).alias("branch_path"), F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(last).alias("family"), F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"), text.token_set(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("tokens"),
    )


def _replaces(c: str) -> str:
    for a, b in (*v.TERM_ALIASES.items(), *v.SYNONYMS.items()):
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return f"replace({c}, 'ё', 'е')"


_STOPS = ", ".join(f"'{w}'" for w in v.STOP_WORDS)
_CLEAN = lambda c: f"case when lower(trim(coalesce({c}, ''))) in ('nan', 'none', '<na>') then '' else trim(coalesce({c}, '')) end"
_TOKENS = lambda c: f"list_filter(regexp_extract_all({_replaces(f'lower({_CLEAN(c)})')}, '[a-zа-я0-9]+'), lambda x: length(x) >= 2 and x not in ({_STOPS}))"
_MERGE = lambda c: f"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"
_COMPACT = lambda c: f"regexp_replace(lower({c}), '[^0-9a-zа-я]+', '', 'g')"
_ITEMS = f"""items as (
  select p_partkey as row_idx, p_name as name, p_brand || '-' || p_partkey as article, lower(p_type) || ' > ' || lower(p_brand) as branch_path,
    case when p_partkey % 7 = 0 then 'other' else string_split(lower(p_name), ' ')[-1] end as family, p_retailprice as price, p_size as size,
    list_sort(list_distinct({_TOKENS("p_name || ' ' || p_type || ' ' || p_brand")})) as tokens
  from part)"""


# --- merging


@query("""
select l_partkey, l_suppkey, price, l_orderkey, l_linenumber from (
  select *, row_number() over (partition by l_partkey order by (price is not null) desc, l_suppkey, l_orderkey, l_linenumber) as r
  from (select l_partkey, l_suppkey, l_orderkey, l_linenumber, case when l_linenumber % 5 = 0 then null else l_extendedprice / l_quantity end as price from lineitem)
) where r = 1""")
def merge_priority_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice") / F.col("l_quantity"))
    offers = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", price.alias("price"), "l_orderkey", "l_linenumber")
    return merge.best_per_key(offers, F.col("l_partkey"), [F.col("price").isNotNull().desc(), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")])


_OFFERS = """offers as (
  select p_name as name, case when p_partkey % 3 = 0 then 'unknown' else p_brand || '-' || (p_partkey % 400) end as article,
    case when p_partkey % 4 = 0 then null else replace(cast(cast(p_retailprice as decimal(12, 2)) as varchar), '.', ',') end as price, p_partkey % 5 as source_order, p_partkey as seq from part)"""


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    price = F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    return t(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "unknown").otherwise(F.concat(F.col("p_brand"), F.lit("-"), (F.col("p_partkey") % 400).cast("string"))).alias("article"),
        F.when(F.col("p_partkey") % 4 != 0, price).alias("price"), (F.col("p_partkey") % 5).alias("source_order"), F.col("p_partkey").alias("seq"),
    )


@query(f"""
with {_OFFERS} select name, article, price, source_order, seq from (
  select *, row_number() over (partition by case when article <> 'unknown' then lower(article) else {_MERGE('name')} end order by (article <> 'unknown') desc, (price is not null) desc, source_order, seq) as r from offers
) where r = 1""")
def merge_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_by_priority(_offers(spark, sf), "article", "name", "price", sequence="seq")


@query("""
select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment, 0 as source_order from customer
union all select s_suppkey, s_name, s_acctbal, null, 1 from supplier""")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return merge.union_sources([c, s])


@query("""
with r as (
  select cast(o_custkey as varchar) as k, o_orderkey, case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then ' ' else o_orderstatus end as status,
    case when o_orderkey % 2 = 0 then null else o_orderpriority end as priority from orders
), f as (select *, (status is not null)::int + (priority is not null)::int as n from r)
select k, coalesce(first(nullif_s order by n desc, o_orderkey), min_by(nb_s, o_orderkey) filter (where nb_s is not null), first(status order by n desc, o_orderkey)) as status,
  coalesce(first(priority order by n desc, o_orderkey), min_by(priority, o_orderkey) filter (where priority is not null)) as priority
from (select *, case when trim(status) <> '' then status end as nullif_s, case when trim(status) <> '' then status end as nb_s from f) group by k""")
def completeness_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"), "o_orderkey", F.when(o % 3 == 0, None).when(o % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"), F.when(o % 2 != 0, F.col("o_orderpriority")).alias("priority"))
    return merge.merge_by_completeness(rows, "k", ["o_orderkey"]).drop("o_orderkey")


_DUPES = f"""k as (select *, nullif(lower(trim(article)), '') as a, nullif({_MERGE('name')}, '') as n from offers),
flags as (select name, article, price, source_order, seq, a is not null and count(*) over (partition by a) > 1 as dup_by_article, n is not null and count(*) over (partition by n) > 1 as dup_by_name from k)"""


@query(f"""with {_OFFERS}, {_DUPES}
select count(*) as rows_total, sum((dup_by_article or dup_by_name)::bigint)::bigint as duplicates_total, sum(dup_by_article::bigint)::bigint as duplicates_by_article, sum(dup_by_name::bigint)::bigint as duplicates_by_name from flags""")
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return merge.duplicate_report(_offers(spark, sf), "article", "name")


@query(f"with {_OFFERS}, {_DUPES} select seq, dup_by_article, dup_by_name from flags where dup_by_article or dup_by_name")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return merge.duplicate_flags(_offers(spark, sf), "article", "name").where("dup_by_article or dup_by_name").select("seq", "dup_by_article", "dup_by_name")


# --- cleaning


@query("select p_partkey, cast(p_retailprice as decimal(12, 2))::double as price, true as readable from part")
def price_normalize(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    written = F.concat(F.substring(p, 1, 1), F.lit(" "), F.replace(p.substr(F.lit(2), F.length(p)), F.lit("."), F.lit(",")), F.lit(" "))
    return t(spark, sf, "part").select("p_partkey", text.number(F.concat(written, F.lit("руб"))).alias("price"), text.has_number(written).alias("readable"))


@query("""
select distinct o_orderstatus as status, o_custkey as customer, o_orderpriority as priority from orders where o_orderstatus <> 'F'
union all select o_orderstatus, o_custkey, o_orderpriority from orders where o_orderstatus = 'F'""")
def drop_unidentified_dups(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    return clean.drop_anonymous_copies(rows, F.col("status") == "F")


@query("select l_orderkey, l_linenumber, l_discount, l_tax from lineitem where l_returnflag = 'A' or not (l_discount = 0 or l_tax = 0)")
def zero_row_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag")
    return clean.drop_zero_rows(rows, F.col("l_returnflag") == "A", ["l_discount", "l_tax"]).drop("l_returnflag")


@query("select p_partkey, coalesce(nullif(trim(case when p_partkey % 3 = 0 then ' ' when p_partkey % 3 = 1 then p_brand end), ''), 'шт') as unit from part")
def default_fill(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return clean.filled(t(spark, sf, "part").select("p_partkey", F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("p_brand")).alias("unit")), {"unit": "шт"})


@query("""select avg((o_orderkey % 3 <> 0)::int)::double as rare, avg((o_orderkey % 100 = 0)::int)::double as common from orders""")
def sparse_column_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    shares = clean.null_shares(t(spark, sf, "orders").select(F.when(o % 3 == 0, o).alias("rare"), F.when(o % 100 != 0, o).alias("common")))
    return spark.createDataFrame([(shares["rare"], shares["common"])], "rare double, common double")


@query("select p_partkey, list_aggregate(list_transform(regexp_extract_all(p_name || '-' || p_type, '([a-zA-Z]+|[^a-zA-Z]+)'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') as title from part")
def title_case(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", text.title_case(F.concat("p_name", F.lit("-"), "p_type")).alias("title"))


# --- text and keys


@query(f"select doc_id, md5({_MERGE('text')}) as form_md5, length({_MERGE('text')}) as form_length from documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    form = text.merge_form(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.md5(form.cast("binary")).alias("form_md5"), F.length(form).cast("long").alias("form_length"))


@query(f"select doc_id, len(w)::bigint as n_tokens, len(list_distinct(w))::bigint as n_distinct, md5(array_to_string(list_sort(list_distinct(w)), ' ')) as set_md5 from (select doc_id, {_TOKENS('text')} as w from documents)")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    kinds = F.array_sort(F.array_distinct("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(kinds).cast("long").alias("n_distinct"), F.md5(F.array_join(kinds, " ").cast("binary")).alias("set_md5"))


@query(f"with {_ITEMS} select row_idx, lower(article) as lookup_key, {_COMPACT('article')} as compact_key from items")
def article_keys(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("row_idx", text.article_key(F.col("article")).alias("lookup_key"), text.article_compact(F.col("article")).alias("compact_key"))


@query(f"with {_ITEMS} select row_idx, cast('0x' || substr(md5(lower(name) || '|' || lower(article) || '|' || branch_path), 1, 12) as bigint) as stable_id from items")
def stable_row_id(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("row_idx", text.stable_row_id(F.col("name"), F.col("article"), F.col("branch_path")).alias("stable_id"))


@query("select p_partkey, cast(cast('0x' || substr(md5(lower(p_brand) || '-' || p_partkey), 1, 8) as bigint) % 16 as int) as shard from part")
def shard_id(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", text.shard(F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")), 16).alias("shard"))


@query("select p_partkey, lower(p_brand) || '/' || p_partkey as article from part")
def extract_article(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("p_name"), F.lit(", part  number: "), F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(" ;"))
    return t(spark, sf, "part").select("p_partkey", text.extract_article(line).alias("article"))


# --- families and branches

_SUMMARY = f"""{_ITEMS}, c as (select branch_path as branch, family as effective_family, count(*) as rows_count from items group by 1, 2),
summary as (select *, sum(rows_count) over (partition by branch)::bigint as branch_total_rows, round(rows_count / (sum(rows_count) over (partition by branch)), 6) as share from c)"""


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.branch_family_summary(items(spark, sf), F.col("branch_path"), F.col("family"))


@query(f"with {_SUMMARY} select branch, effective_family, rows_count, branch_total_rows, share from summary")
def branch_family_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf)


@query(f"""with {_SUMMARY}, r as (select *, row_number() over (partition by branch order by rows_count desc, effective_family) as r from summary),
w as (select branch, max(branch_total_rows) as branch_total_rows, count(*) as family_count, max(effective_family) filter (r = 1) as top_family, max(rows_count) filter (r = 1) as top_family_rows, max(share) filter (r = 1) as top_family_share,
  coalesce(max(effective_family) filter (r = 2), '') as second_family, coalesce(max(rows_count) filter (r = 2), 0) as second_family_rows, coalesce(max(share) filter (r = 2), 0.0)::double as second_family_share,
  coalesce(max(rows_count) filter (effective_family = 'other'), 0) as other_rows, coalesce(max(share) filter (effective_family = 'other'), 0.0)::double as other_share,
  string_agg(effective_family || ' (' || rows_count || ')', ' | ' order by r) filter (r <= 5) as top_families from r group by branch)
select *, round((1 - top_family_share) * branch_total_rows + second_family_share * branch_total_rows + greatest(0, family_count - 2) * 25 + other_share * branch_total_rows, 3) as suspicious_score
from w where branch_total_rows >= 10 and (top_family = 'other' or top_family_share < 0.85 or second_family_share >= 0.1 or family_count >= 5 or other_share >= 0.1)""")
def branch_cleanup_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.branch_cleanup_audit(_summary(spark, sf), least_rows=10)


@query(f"""with {_ITEMS}, p as (select branch_path, count(*) as total_rows, count(*) filter (family = 'other') as other_rows from items group by 1)
select *, round(other_rows / total_rows, 6) as other_share, case when other_rows <= 0 then 'mapped' when other_rows / total_rows >= 0.999 then 'all_other' when other_rows / total_rows >= 0.8 then 'mostly_other' else 'mixed' end as status from p""")
def branch_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return audit.branch_alignment(items(spark, sf), "branch_path", "family")


@query(f"""with {_ITEMS} select 'branch' as dimension, branch_path as key, count(*) as n from items where family = 'other' group by 2
union all select 'branch_size', branch_path || ' | ' || size, count(*) from items where family = 'other' group by 2""")
def other_profile(spark: SparkSession, sf: str) -> DataFrame:
    return audit.profile(items(spark, sf).where("family = 'other'"), {"branch": ["branch_path"], "branch_size": ["branch_path", "size"]})


@query(f"""with {_ITEMS}, f as (select branch_path as branch, name, min(row_idx) as o from items group by 1, 2), r as (select *, row_number() over (partition by branch order by o, name) as r from f)
select branch, string_agg(name, ' | ' order by r) as names from r where r <= 3 group by branch""")
def branch_context(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.branch_context(items(spark, sf).withColumnRenamed("branch_path", "branch"), "branch", "name", "row_idx")
    return found.select("branch", F.array_join("names", " | ").alias("names"))


@query(f"""with {_ITEMS}, b as (select distinct branch_path as branch from items union select distinct lower(p_type) from part), s as (select distinct lower(p_type) as selection from part where p_size > 25)
select distinct branch from b, s where branch = selection or starts_with(branch, selection || ' > ') or starts_with(selection, branch || ' > ')""")
def branch_probe(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part")
    branches = items(spark, sf).select(F.col("branch_path").alias("branch")).union(parts.select(F.lower("p_type")))
    return audit.matching_branches(branches, parts.where("p_size > 25").select(F.lower("p_type").alias("selection")))


@query(f"select x as token, count(*) as n from (select unnest({_TOKENS('text')}) as x from documents) group by x")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.token_counts(t(spark, sf, "documents"), text.tokens(F.col("text")))


# --- lookups


def _asks(spark: SparkSession, sf: str) -> DataFrame:
    """Requests made of parts: the name in capitals, and the article with its last digit turned or cut."""
    i = items(spark, sf)
    turned = F.concat(F.expr("substring(article, 1, length(article) - 1)"), ((F.right(F.col("article"), F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return i.select(F.col("row_idx").alias("query_id"), F.upper("name").alias("text"), "article", turned.alias("typo"), F.expr("substring(article, 1, length(article) - 1)").alias("cut"), "tokens", "branch_path", "family")


_ASKS = f"""{_ITEMS}, asks as (select row_idx as query_id, upper(name) as text, article, substr(article, 1, length(article) - 1) || ((right(article, 1)::int + 1) % 10) as typo,
  substr(article, 1, length(article) - 1) as cut, tokens, branch_path, family from items)"""


@query(f"with {_ASKS} select query_id, min(row_idx) as row_idx from asks join items on lower(asks.text) = lower(items.name) group by query_id")
def exact_name_join(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.exact_first(_asks(spark, sf), items(spark, sf), F.lower("text"), F.lower("name"))


_HALVED = "lower(substr(article, 1, length(article) - (row_idx % 2)::int))"


@query(f"with {_ASKS}, one as (select {_HALVED} as k, min(row_idx) as row_idx from items group by 1 having count(*) = 1) select query_id, row_idx from asks join one on lower(article) = k")
def unique_article_join(spark: SparkSession, sf: str) -> DataFrame:
    some = items(spark, sf).withColumn("article", F.expr("substring(article, 1, length(article) - cast(row_idx % 2 as int))"))
    return lookup.unique_article(_asks(spark, sf), some, F.col("article"), F.col("article"))


@query(f"""with {_ASKS} select query_id, row_idx from (select query_id, row_idx, row_number() over (partition by query_id order by row_idx) as r
  from asks join items on starts_with({_COMPACT('items.article')}, {_COMPACT('asks.cut')}) and length({_COMPACT('items.article')}) > length({_COMPACT('asks.cut')}) where length({_COMPACT('asks.cut')}) >= 5) where r <= 40""")
def article_series_join(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.article_series(_asks(spark, sf), items(spark, sf), F.col("cut"), F.col("article"))


# How much one compact article resembles another, and the sums it is made of.
_BLOCKS = lambda c, p: f"list_filter(regexp_extract_all({c}, '([0-9]+|[a-zа-я]+)'), lambda x: regexp_matches(x, '{p}'))"
_SAME = "coalesce(list_max(list_filter(generate_series(1, least(length(q), length(i))), lambda n: left(q, n) = left(i, n))), 0)"
_AFFINITY = f"""case when length(q) < 4 or length(i) < 4 then 0.0 when q = i then 1.0 else least(0.999::double, case when starts_with(i, q) then 0.7::double when starts_with(q, i) then 0.5::double else 0.0::double end
  + case when {_SAME} >= 4 then least(0.2::double, 0.2::double * {_SAME} / greatest(length(q), length(i))) else 0.0::double end
  + coalesce(0.15::double * list_sum(list_transform(list_filter({_BLOCKS('q', '^[0-9]{3,}$')}, lambda x: contains(i, x)), lambda x: length(x))) / list_sum(list_transform({_BLOCKS('q', '^[0-9]{3,}$')}, lambda x: length(x))), 0.0::double)
  + coalesce(0.1::double * len(list_filter({_BLOCKS('q', '^[^0-9]+$')}, lambda x: contains(i, x))) / nullif(len({_BLOCKS('q', '^[^0-9]+$')}), 0), 0.0::double)) end"""


@query(f"""with {_ASKS}, q as (select query_id, {_COMPACT('typo')} as q from asks), i as (select row_idx, {_COMPACT('article')} as i from items),
found as (select query_id, row_idx, {_AFFINITY} as score from q join i on length(q) = length(i) and substr(q, 1, greatest(4, length(q) - 2)) = substr(i, 1, greatest(4, length(i) - 2))
where length(q) >= 6 and len(list_filter(list_zip(string_split(q, ''), string_split(i, '')), lambda x: x[1] <> x[2])) = 1
  and len(list_filter(list_zip(string_split(q, ''), string_split(i, '')), lambda x: x[1] <> x[2] and not (regexp_matches(x[1], '[0-9]') and regexp_matches(x[2], '[0-9]')))) = 0)
select query_id, row_idx, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, row_idx) as r from found) where r <= 10""")
def article_typo_join(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.article_typo(_asks(spark, sf), items(spark, sf), F.col("typo"), F.col("article")).withColumn("score", F.round("score", 9))


@query(f"""with {_ASKS}, q as (select query_id, {_COMPACT('cut')} as q from asks where length({_COMPACT('cut')}) >= 4), i as (select row_idx, {_COMPACT('article')} as i from items where length({_COMPACT('article')}) >= 4),
blocks as (select query_id, q, b, row_number() over (partition by query_id order by length(b) desc, b) as r from (select query_id, q, unnest(list_distinct(list_filter(regexp_extract_all(q, '[0-9]+'), lambda x: length(x) >= 4))) as b from q)),
terms as (select query_id, q, q as t from q union select query_id, q, b from blocks where r <= 2),
met as (select distinct query_id, q, row_idx, i from terms join i on starts_with(i, t)), found as (select query_id, row_idx, {_AFFINITY} as score from met)
select query_id, row_idx, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, row_idx) as r from found where score >= 0.45) where r <= 20""")
def article_affinity_join(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.article_affinity(_asks(spark, sf), items(spark, sf), F.col("cut"), F.col("article")).withColumn("score", F.round("score", 9))


@query(f"""with {_ITEMS}, a as (select size as query_id, row_idx, 1 as lane from items where price > 1200), b as (select size as query_id, row_idx, 2 as lane from items)
select * from a union all select * from b where not exists (select 1 from a where a.query_id = b.query_id and a.row_idx = b.row_idx)""")
def candidate_union_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf).select(F.col("size").alias("query_id"), "row_idx", "price")
    return lookup.add_absent(i.where("price > 1200").drop("price").withColumn("lane", F.lit(1)), i.drop("price").withColumn("lane", F.lit(2)))


@query(f"""with {_ASKS}, stored as (select lower(c_mktsegment) as note, c_custkey as stamp, md5({_MERGE("'part ' || c_nationkey")}) as h from customer),
latest as (select h, max_by(note, stamp) as note from stored group by h)
select query_id, note from (select query_id, md5({_MERGE("'part ' || (query_id % 40)")}) as h from asks) left join latest using (h)""")
def result_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.lit("")
    cache = t(spark, sf, "customer").select(text.query_hash(F.concat(F.lit("part "), F.col("c_nationkey").cast("string")), empty).alias("query_hash"), F.lower("c_mktsegment").alias("note"), F.col("c_custkey").alias("stored_at"))
    asked = _asks(spark, sf).select("query_id")
    return lookup.cached(asked, cache, F.concat(F.lit("Part "), (F.col("query_id") % 40).cast("string")), empty).select("query_id", F.col("hit.note").alias("note"))


# --- retrieval and scores


@query(f"""with {_ITEMS}, d as (select token, count(*) as df from (select unnest(tokens) as token from items) group by token)
select token, df, ln((1 + (select count(*) from items)) / (1 + df)) + 1 as idf from d""")
def token_idf(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.token_idf(items(spark, sf), F.col("tokens"))


_REQUESTS = f"requests as (select item_id as query_id, list_distinct({_TOKENS('text')}) as tokens from benchmark)"
_DOCS = f"texts as (select doc_id as row_idx, list_distinct({_TOKENS('text')}) as tokens from documents)"
_MET = f"""{_REQUESTS}, {_DOCS}, idx as (select row_idx, unnest(tokens) as token from texts),
met as (select distinct query_id, row_idx from (select query_id, unnest(tokens) as token from requests) join idx using (token)),
pairs as (select query_id, row_idx, len(list_intersect(q.tokens, t.tokens)) as shared, len(q.tokens) as a, len(t.tokens) as b from met join requests q using (query_id) join texts t using (row_idx)),
scored as (select query_id, row_idx, shared, shared / (a + b - shared) as score from pairs), ranked as (select *, row_number() over (partition by query_id order by score desc, row_idx) as rank from scored)"""


def _met(spark: SparkSession, sf: str) -> DataFrame:
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("tokens"))
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), text.tokens(F.col("text")).alias("tokens"))
    return retrieve.postings(q, d).withColumn("score", retrieve.jaccard_of(F.col("shared"), F.col("q_size"), F.col("i_size")))


@query(f"with {_MET} select query_id, row_idx, shared::int as shared, rank from (select *, row_number() over (partition by query_id order by shared desc, row_idx) as rank from (select query_id, row_idx, shared from scored)) where rank <= 10")
def inverted_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.top_k(_met(spark, sf), 10, "shared").select("query_id", "row_idx", "shared", "rank")


@query(f"with {_MET} select query_id, row_idx, score, rank from ranked where rank <= 10")
def jaccard_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.top_k(_met(spark, sf), 10).select("query_id", "row_idx", "score", "rank")


@query(f"""with {_MET} select query_id, max(score) filter (rank = 1) as best, max(score) filter (rank = 2) as second,
  max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0) as margin from ranked where rank <= 2 group by query_id""")
def margin_gap(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.best_and_margin(retrieve.top_k(_met(spark, sf), 2))


@query(f"with {_MET} select query_id, string_agg('doc [' || row_idx || ']', ' | ' order by rank) as alternatives from ranked where rank between 2 and 4 group by query_id")
def alternatives_string(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("doc ["), F.col("row_idx").cast("string"), F.lit("]"))
    return retrieve.alternatives(retrieve.top_k(_met(spark, sf), 4), label)


@query(f"""with {_ITEMS}, b as (select distinct lower(p_type) as branch from part where p_size < 25 union select distinct lower(p_type) || ' > ' || lower(p_brand) from part where p_size = 25)
select branch, row_idx from b join items on branch_path = branch or starts_with(branch_path, branch || ' > ')""")
def branch_subtree_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part")
    asked = parts.where("p_size < 25").select(F.lower("p_type").alias("branch")).union(parts.where("p_size = 25").select(F.concat_ws(" > ", F.lower("p_type"), F.lower("p_brand")))).distinct()
    return retrieve.subtree(asked, items(spark, sf).select("row_idx", "branch_path")).select("branch", "row_idx")


@query()
def lexical_score(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieve.top_k(_met(spark, sf), 3)
    both = top.join(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("qt")), "query_id").join(t(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("dt")), "row_idx")
    return retrieve.lexical_score(both, F.col("qt"), F.col("dt")).select("query_id", "row_idx", "lexical")


_ROUTES = ((("ring", "bolt"), ("metal",), 2.5), (("large",), ("size", "large"), 1.5), (("small", "bolt"), ("size", "small"), 1.0))


@query("""select p_partkey as query_id, branch, score from part, lateral (values ('metal', 2.5 * (contains(lower(p_name || ' ' || p_type), 'ring')::int + contains(lower(p_name || ' ' || p_type), 'bolt')::int)::double),
  ('size > large', 1.5 * contains(lower(p_name || ' ' || p_type), 'large')::int::double), ('size > small', (contains(lower(p_name || ' ' || p_type), 'small')::int + contains(lower(p_name || ' ' || p_type), 'bolt')::int)::double)) as r(branch, score) where score > 0""")
def branch_ranking(spark: SparkSession, sf: str) -> DataFrame:
    q = t(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return retrieve.keyword_routes(q, text.normal(F.col("text")), _ROUTES)


# --- decisions


@query(f"""with {_ITEMS}, f as (select size as query_id, row_idx, price > 1500 as hit, max((price > 1500)::int) over (partition by size) as anyhit from items) select query_id, row_idx from f where hit or anyhit = 0""")
def soft_filter(spark: SparkSession, sf: str) -> DataFrame:
    return decide.soft_filter(items(spark, sf).select(F.col("size").alias("query_id"), "row_idx", "price"), F.col("price") > 1500).select("query_id", "row_idx")


def _marked(c: str, salt: int) -> Column:
    k = F.col(c) + salt
    return F.create_map(F.lit("category"), F.when(k % 3 == 0, "cat6").when(k % 3 == 1, "cat5e").otherwise(""), F.lit("rack_unit"), F.when(k % 4 == 0, "1").when(k % 4 == 1, "2").otherwise(""), F.lit("duplex"), F.when(k % 5 == 0, "yes").otherwise("no"))


@query("""
with m as (select p_partkey as k, p_size, [(p_partkey + s) % 3 for s in [0, 2]] as c, [(p_partkey + s) % 4 for s in [0, 2]] as r, [(p_partkey + s) % 5 for s in [0, 2]] as d from part),
p as (select k, (case when c[1] < 2 and c[2] < 2 and c[1] <> c[2] then 0.18 else 0 end + case when r[1] < 2 and r[2] < 2 and r[1] <> r[2] then 0.12 else 0 end + case when (d[1] = 0) <> (d[2] = 0) then 0.12 else 0 end)::double as penalty,
  case when p_size > 45 then 'too_large' else '' end as reason from m)
select k as row_idx, penalty, case when reason <> '' then 'incompatible' when penalty >= 0.2 then 'weakly_compatible' else 'compatible' end as label from p""")
def compatibility_label(spark: SparkSession, sf: str) -> DataFrame:
    reason = decide.first_match([(F.col("p_size") > 45, "too_large")])
    weak = retrieve.penalty(_marked("p_partkey", 0), _marked("p_partkey", 2))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("row_idx"), weak.alias("penalty"), retrieve.compatibility(reason, weak).alias("label"))


_KIND = "case when o_orderkey % 11 = 0 then 'section' else 'item' end"
_SOURCE = "case when o_orderkey % 2 = 0 then 'article_exact' else 'local_tree' end"


@query(f"""with r as (select o_orderkey, {_KIND} as kind, {_SOURCE} as source, case o_orderstatus when 'F' then 'compatible' when 'O' then 'weakly_compatible' else '' end as status, o_orderpriority like '1%' as review from orders)
select o_orderkey, case when kind = 'section' then 'reject' when status = 'compatible' and source = 'article_exact' then 'auto_accept' else 'review' end as decision,
  case when kind = 'section' then 'reject_row_type:section' when status <> 'compatible' then 'compatibility:' || case when status = '' then 'unknown' else status end
    when source = 'article_exact' then 'auto_accept_source:article_exact' when review then 'requires_review_flag' else 'default_review' end as reason from r""")
def verifier_decision(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "compatible").when(F.col("o_orderstatus") == "O", "weakly_compatible").otherwise("")
    decision, reason = decide.verifier(F.expr(_KIND), status, F.expr(_SOURCE), F.col("o_orderpriority").startswith("1"))
    return t(spark, sf, "orders").select("o_orderkey", decision.alias("decision"), reason.alias("reason"))


@query(f"""with {_ITEMS}, lanes as (select size as query_id, row_idx, 1.0::double as score, 'exact' as lane, 0 as ordinal from items where row_idx % 97 = 0 union all
  select size, row_idx, price / 10000, 'similar', 1 from items where row_idx % 5 = 0 union all select size, row_idx, 0.1, 'fallback', 2 from items)
select query_id, row_idx, score, lane, ordinal from (select *, row_number() over (partition by query_id order by ordinal, score desc, row_idx) as r from lanes) where r = 1""")
def match_ladder(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf).select(F.col("size").alias("query_id"), "row_idx", "price")
    lane = lambda where, score: i.where(where).select("query_id", "row_idx", score.alias("score"))
    return decide.ladder([("exact", lane("row_idx % 97 = 0", F.lit(1.0))), ("similar", lane("row_idx % 5 = 0", F.col("price") / 10000)), ("fallback", lane("true", F.lit(0.1)))]).select("query_id", "row_idx", "score", "lane", "ordinal")


@query()
def match_requests(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match(_asks(spark, sf).select("query_id", "text", F.col("typo").alias("article")), items(spark, sf).select("row_idx", "name", "article", "branch_path", "tokens"))


# --- rules

_FAMILIES = (
    rules.Family("ring", positive=("ring",), negative=("hot",), priority=5, types=("ring_part",), returns="ring_part"),
    rules.Family("bolt", positive=("bolt", "red"), priority=3),
    rules.Family("small_thing", positive=("small",), any_tokens=(("bolt", "ring", "gear"),), priority=8),
)
_DOMAINS = (rules.Domain("metal", ("ring", "bolt", "gear"), ("ring",)), rules.Domain("finish", ("red", "hot", "old")), rules.Domain("scale", ("small", "large", "medium")))


@query("""with p as (select p_partkey, lower(p_name || ' ' || p_type) as x from part),
h as (select *, contains(x, 'ring')::int as s, contains(x, 'bolt')::int + contains(x, 'red')::int as b, contains(x, 'small')::int as m, contains(x, 'hot') as no, contains(x, 'bolt') or contains(x, 'ring') or contains(x, 'gear') as any_t from p),
o as (select p_partkey, unnest([{'ok': s > 0 and not no, 'score': 5.0 + s, 'k': 0, 'family': 'ring', 'entity_type': 'ring_part', 'confidence': 0.45 + s * 0.15 + 0.005}, {'ok': b > 0, 'score': 3.0 + b, 'k': 1, 'family': 'bolt', 'entity_type': 'bolt', 'confidence': 0.45 + b * 0.15 + 0.003},
  {'ok': m > 0 and any_t, 'score': 8.0 + m, 'k': 2, 'family': 'small_thing', 'entity_type': 'small_thing', 'confidence': 0.45 + m * 0.15 + 0.1 + 0.008}]) as o from h),
best as (select p_partkey, o, row_number() over (partition by p_partkey order by o.score desc, o.k) as r from o where o.ok)
select p.p_partkey, best.o.family as family, best.o.entity_type as entity_type, round(best.o.confidence::double, 6) as confidence from p left join best on best.p_partkey = p.p_partkey and r = 1""")
def registry_classifier(spark: SparkSession, sf: str) -> DataFrame:
    best = rules.classify(F.concat_ws(" ", "p_name", "p_type"), _FAMILIES)
    return t(spark, sf, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.family", "b.entity_type", F.round("b.confidence", 6).alias("confidence"))


_DOMAIN_SQL = lambda c, fam: f"""list_transform([{{'s': (contains({c}, 'ring')::int + contains({c}, 'bolt')::int + contains({c}, 'gear')::int + {fam})::double, 'k': 0, 'l': 'metal'}}, {{'s': (contains({c}, 'red')::int + contains({c}, 'hot')::int + contains({c}, 'old')::int)::double, 'k': 1, 'l': 'finish'}},
  {{'s': (contains({c}, 'small')::int + contains({c}, 'large')::int + contains({c}, 'medium')::int)::double, 'k': 2, 'l': 'scale'}}], lambda x: {{'s': x.s, 'k': -x.k, 'l': x.l}})"""  # noqa: E731


@query(f"""with p as (select p_partkey, list_reverse_sort({_DOMAIN_SQL('lower(p_name)', "case when p_partkey % 2 = 0 then 1.5 else 0 end")})[1] as a, list_reverse_sort({_DOMAIN_SQL('lower(p_type)', '0')})[1] as b from part)
select p_partkey, case when a.s > 0 then a.l else '' end as name_domain, case when b.s > 0 then b.l else '' end as type_domain, case when a.s > 0 and b.s > 0 and a.l = 'metal' and b.l in ('finish', 'scale') then 'metal_against_other' else '' end as reason from p""")
def domain_conflict(spark: SparkSession, sf: str) -> DataFrame:
    family = F.when(F.col("p_partkey") % 2 == 0, "ring").otherwise("")
    a, b = rules.domain(F.col("p_name"), family, _DOMAINS), rules.domain(F.col("p_type"), F.lit(""), _DOMAINS)
    both = t(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    reason = rules.domain_conflict(F.col("a"), F.col("b"), [(("metal",), ("finish", "scale"), "metal_against_other")])
    return both.select("p_partkey", F.col("a.label").alias("name_domain"), F.col("b.label").alias("type_domain"), reason.alias("reason"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'cat6' else 'cat5e' end as category, cast(p_size as varchar) as rack_unit, cast(p_partkey % 9 as varchar) || '.5' as length_m from part""")
def markers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(F.lit("Шнур "), F.when(k % 2 == 0, "CAT 6").otherwise("cat 5e"), F.lit(", "), F.col("p_size").cast("string"), F.lit(" U, "), (k % 9).cast("string"), F.lit(",5 м"))
    m = rules.markers(line)
    return t(spark, sf, "part").select("p_partkey", *[retrieve.marker(m, c).alias(c) for c in ("category", "rack_unit", "length_m")])


@query("""select p_partkey, case when p_size <= p_partkey % 50 then p_size || 'x' || (p_partkey % 50) else (p_partkey % 50) || 'x' || p_size end as pairs, cast(p_partkey as varchar) as lengths from part""")
def dimension_signatures(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("х"), (F.col("p_partkey") % 50).cast("string"), F.lit(" L="), F.col("p_partkey").cast("string"))
    d = similarity.dimension_signatures(line)
    return t(spark, sf, "part").select("p_partkey", d.alias("d")).select("p_partkey", F.array_join("d.pairs", " ").alias("pairs"), F.array_join("d.lengths", " ").alias("lengths"))


@query()
def search_projection(spark: SparkSession, sf: str) -> DataFrame:
    named = t(spark, sf, "part").select(F.col("p_name").alias(v.NAME), F.col("p_brand").alias(v.ARTICLE), F.col("p_type").alias("Тип изделия"))
    return catalogue.project(named, _FAMILIES)


# --- audits

_CASES = """cases as (select doc_id, l.quality = 1 as auto_accept, d.source as suite, case when l.toxic = 1 then 'catalog_gap' when d.lang = 'en' then 'exact' else 'review' end as outcome, d.n_chars > 500 as right_one from labels l join documents d using (doc_id)),
scored as (select *, case outcome when 'exact' then auto_accept and right_one when 'review' then not auto_accept or not right_one else not auto_accept end as passed from cases),
judged as (select *, case when passed then '' when outcome = 'exact' then 'false_negative' when outcome = 'review' and not auto_accept then 'review_policy_miss' else 'false_positive' end as bucket from scored)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    both = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    outcome = F.when(F.col("toxic") == 1, "catalog_gap").when(F.col("lang") == "en", "exact").otherwise("review")
    right, auto, none = F.col("n_chars") > 500, F.col("quality") == 1, F.array().cast("array<string>")
    found = F.when(outcome == "exact", F.when(right, "a").otherwise("b")).otherwise("c")
    verdict = audit.score_case(outcome, auto, F.lit(True), found, F.array(F.lit("a")), none, none, F.lit(""), F.lit(False), ~right & (outcome == "review") | (outcome == "catalog_gap"), F.lit(False))
    return both.select("doc_id", F.col("source").alias("suite"), outcome.alias("outcome"), auto.alias("auto_accept"), verdict.alias("v")).select("doc_id", "suite", "outcome", "auto_accept", "v.passed", "v.bucket")


@query(f"""with {_CASES} select suite, count(*) as cases, count(*) filter (passed) as passed, count(*) filter (auto_accept) as auto_accepts, count(*) filter (bucket = 'false_positive') as false_positives, count(*) filter (bucket = 'false_negative') as false_negatives,
  round(avg(passed::int), 4) as pass_rate, round(count(*) filter (auto_accept and passed) / nullif(count(*) filter (auto_accept), 0), 4) as auto_accept_precision from judged group by suite""")
def benchmark_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.benchmark_summary(_cases(spark, sf), ["suite"])


@query(f"""with {_CASES} select count(*) as total_cases, count(*) filter (passed) as passed_cases, count(*) filter (not passed) as failed_cases, count(*) filter (auto_accept) as auto_accepts,
  round(count(*) filter (auto_accept and passed) / nullif(count(*) filter (auto_accept), 0), 4) as auto_accept_precision,
  round(count(*) filter (bucket = 'false_positive' and outcome = 'catalog_gap') / nullif(count(*) filter (outcome = 'catalog_gap'), 0), 4) as catalog_gap_false_positive_rate,
  round(count(*) filter (passed and outcome = 'review') / nullif(count(*) filter (outcome = 'review'), 0), 4) as review_capture_rate from judged""")
def benchmark_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return audit.benchmark_metrics(_cases(spark, sf))


_REASONS = "case p_partkey % 6 when 0 then 'category_mismatch_x' when 1 then 'shield_y' when 2 then 'rack_depth' when 3 then 'connector_kind' when 4 then 'catalog_missing_family' else 'odd' end"


@query(f"""with c as (select p_size % 30 as query_id, p_partkey % 10 = 0 and p_size % 3 = 0 as compatible, case {_REASONS} when 'category_mismatch_x' then 'category_mismatch' when 'shield_y' then 'shielding_mismatch' when 'rack_depth' then 'rack_form_factor_mismatch'
    when 'connector_kind' then 'connector_mismatch' when 'catalog_missing_family' then 'missing_family' else 'other_spec_mismatch' end as reason, p_name as name, p_retailprice as score from part),
q as (select item_id as query_id, length(text) % 7 <> 0 as target from benchmark), n as (select query_id, count(*) as same_family, count(*) filter (compatible) as compatible_candidates, max_by(name, {{'s': score, 'n': name}}) as best_example from c group by 1),
r as (select query_id, reason, count(*) as n from c where not compatible group by 1, 2), top as (select query_id, max(n) as m from r group by 1), tied as (select query_id, min(reason) as reason, count(*) as k from r join top using (query_id) where n = m group by 1),
d as (select q.query_id, target, coalesce(same_family, 0) as same_family, coalesce(compatible_candidates, 0) as compatible_candidates, best_example, reason, k,
  case when not target then 'non_target_family' when coalesce(same_family, 0) = 0 then 'catalog_missing_family' when compatible_candidates = 0 then 'catalog_has_family_but_no_compatible_specs' else 'catalog_has_compatible_candidates' end as diagnosis
  from q left join n using (query_id) left join tied using (query_id))
select query_id, target, same_family, compatible_candidates, best_example, diagnosis, case when diagnosis = 'catalog_missing_family' then 'missing_family' when diagnosis <> 'catalog_has_family_but_no_compatible_specs' then '' when k > 1 then 'multiple_spec_mismatches' else reason end as gap_reason_code from d""")
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    candidates = t(spark, sf, "part").select((F.col("p_size") % 30).cast("long").alias("query_id"), F.expr("p_partkey % 10 = 0 and p_size % 3 = 0").alias("compatible"), F.expr(_REASONS).alias("incompatibility"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("score"))
    return audit.coverage_audit(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.length("text") % 7 != 0).alias("target")), candidates)


_STAGES = "case event_id % 5 when 0 then 'resolved' when 1 then 'query_input' when 2 then 'catalog_gap' when 3 then 'retrieval' else null end"
_CODES = "case event_id % 7 when 0 then 'section_row' when 1 then 'no_candidates_found' when 2 then 'weak_match_rejected' when 3 then 'runtime_exception' else null end"


@query(f"""with e as (select {_STAGES} as stage, coalesce({_CODES}, 'resolved') as code from events),
k as (select stage, code, case when stage = 'resolved' then 'resolved' when stage = 'query_input' or code = 'section_row' then 'input_or_query_shape' when code = 'no_candidates_found' then 'search_layer_gap' when stage = 'catalog_gap' then 'catalog_gap'
  when code = 'weak_match_rejected' then 'gemini_or_decision_policy' when stage is null or code = 'runtime_exception' then 'runtime_error' else 'matcher_retrieval_or_ranking' end as class from e)
select 'outcome' as metric, case when stage = 'resolved' then 'resolved' else 'unresolved' end as key, count(*) as n from k group by 2 union all select 'stage', stage, count(*) from k group by 2
union all select 'class', class, count(*) from k group by 2 union all select 'code', code, count(*) from k group by 2""")
def diagnostics_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.diagnostics_summary(t(spark, sf, "events").select(F.expr(_STAGES).alias("stage"), F.expr(_CODES).alias("code")), "stage", "code")


@query("""select count(*) as rows_total, count(*) filter (event_type = 'purchase') as purchases, count(*) filter (value > 50) as large, count(*) filter (cast(json_extract_string(props, '$.k') as int) % 2 = 0) as even, round(sum(value), 2) as value_sum from events""")
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    out = audit.conditional_counts(e, {"purchases": F.col("event_type") == "purchase", "large": F.col("value") > 50, "even": F.col("k") % 2 == 0}, {"value_sum": F.col("value")})
    return out.withColumn("value_sum", F.round("value_sum", 2))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then 'seen' || (o_orderkey % 3) else o_orderstatus end as status, case when o_orderkey % 2 = 0 then o_orderkey % 3 end as level from orders""")
def diagnostics_join(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    d = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.concat(F.lit("seen"), (F.col("o_orderkey") % 3).cast("string")).alias("status"), (F.col("o_orderkey") % 3).alias("level"))
    return audit.joined_diagnostics(o, d, "o_orderkey")


@query("""with o as (select o_orderkey, case when o_orderkey % 13 = 0 then ' ' else o_orderpriority end as asked, case when o_custkey % 4 = 0 then null else o_orderstatus end as found, o_orderkey % 11 = 0 as section, o_orderstatus = 'P' as review, case when o_custkey % 9 = 0 then 'x' end as error from orders),
k as (select *, trim(asked) <> '' as a, coalesce(found, '') = '' as lost from o)
select count(*) filter (a and not section) as total, count(*) filter (a and not section and not lost) as found, count(*) filter (a and not section and lost) as not_found, count(*) filter (a and not section and review) as requires_review,
  count(*) filter (a and not section and error is not null) as errors, count(*) filter (section) as skipped_non_item, count(*) filter (not a) as blank_rows from k""")
def business_summary(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked, found = F.when(k % 13 == 0, " ").otherwise(F.col("o_orderpriority")), F.when(c % 4 != 0, F.col("o_orderstatus"))
    return proposals.business_summary(t(spark, sf, "orders"), asked, found, k % 11 == 0, F.col("o_orderstatus") == "P", F.when(c % 9 == 0, "x"))


_WIDE = """w as (select l_suppkey % 7 as branch, case when l_partkey % 4 = 0 then 'other' else 'f' || (l_partkey % 11) end as family from lineitem), c as (select branch, family, count(*) as n from w group by 1, 2),
s as (select *, sum(n) over (partition by branch)::bigint as total, round(n / (sum(n) over (partition by branch)), 6) as share, row_number() over (partition by branch order by n desc, family) as r from c),
g as (select branch, max(total) as n, count(*) as k, max(family) filter (r = 1) as top, max(share) filter (r = 1) as t, coalesce(max(share) filter (r = 2), 0) as second, coalesce(max(share) filter (family = 'other'), 0) as other from s group by 1)"""


@query(f"""with {_WIDE}, f as (select *, ((n >= 20000 and k >= 5 and t < 0.9) or (n >= 5000 and k >= 6 and t < 0.8) or (n >= 1000 and k >= 8 and t < 0.7)) and (second >= 0.03 or other >= 0.08) as split from g)
select cast(branch as varchar) as branch, split, top = 'other' and n >= 100 and t >= 0.6 and other >= 0.6 and k <= 6 and not split as new_family from f where n >= 100 and (top = 'other' or t < 0.85 or second >= 0.1 or k >= 5 or other >= 0.1)""")
def branch_guardrails(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_partkey")
    rows = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).cast("string").alias("branch"), F.when(p % 4 == 0, "other").otherwise(F.concat(F.lit("f"), (p % 11).cast("string"))).alias("family"))
    found = audit.branch_cleanup_audit(audit.branch_family_summary(rows, F.col("branch"), F.col("family")))
    split = taxonomy.needs_split(found)
    return found.select("branch", split.alias("split"), taxonomy.new_family_candidate(split).alias("new_family"))


@query(f"with {_SUMMARY} select branch, max(branch_total_rows) as rows_total, string_agg(effective_family || ':' || rows_count, ' ' order by rows_count desc, effective_family) as families from summary group by branch")
def branch_probe_report(spark: SparkSession, sf: str) -> DataFrame:
    report = taxonomy.probe_report(_summary(spark, sf))
    return report.select("branch", "rows_total", F.array_join(F.transform("families", lambda x: F.concat_ws(":", x["family"], x["rows_count"].cast("string"))), " ").alias("families"))


@query("select lower(p_type) as branch, count(*) as n from part group by 1 order by n desc, branch limit 3")
def frequent_branches(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.frequent_branches(t(spark, sf, "part").select(F.lower("p_type").alias("branch")), "branch")


@query()
def branch_proposals(spark: SparkSession, sf: str) -> DataFrame:
    branches = items(spark, sf).select(F.col("branch_path").alias("branch")).distinct()
    asked = branches.select(F.monotonically_increasing_id().alias("proposal_id"), F.when(F.length("branch") % 2 == 0, F.upper("branch")).otherwise(F.col("branch")).alias("branch"))
    return taxonomy.aligned(asked, branches)


@query("""select l_orderkey, l_linenumber, l_extendedprice as unit_cost, l_extendedprice * l_quantity as total_cost, null::double as labour_cost from lineitem""")
def cost_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return decide.cost_columns(rows).drop("price", "quantity")


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'edited' else o_orderstatus end as status, o_orderpriority as priority from orders""")
def corrections_join(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    edits = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("edited").alias("status"), F.lit(None).cast("string").alias("priority"))
    return proposals.corrected(o, edits, "o_orderkey")


@query("select o_orderkey, case when o_custkey % 5 = 0 then 'service_error|' || o_orderpriority || '|timeout' when o_custkey % 3 = 0 then 'no_compatible_candidate|' || o_orderpriority || '|rack_depth' when o_custkey % 2 = 0 then 'not_in_catalogue|' || o_orderpriority || '|no branch' else 'nothing_alike|' || o_orderpriority end as told from orders")
def not_found_reason(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    told = proposals.not_found(F.col("o_orderpriority"), F.when(c % 2 == 0, "no branch"), F.when(c % 5 == 0, "timeout"), F.when(c % 3 == 0, "rack_depth"))
    return t(spark, sf, "orders").select("o_orderkey", told.alias("told"))


@query("""with s as (select p_partkey, 0.1 * (p_size <= 25)::int + 0.18 * (p_size > 0)::int as bonus from part) select p_partkey, round(least(0.45, bonus)::double, 6) as bonus from s""")
def series_bonus(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("лоток 3х"), k)
    other = F.concat(F.lit("короб "), F.when(F.col("p_size") <= 25, F.lit("3x")).otherwise("7x"), k)
    rows = t(spark, sf, "part").select("p_partkey", "p_size", line.alias("q"), other.alias("i")).withColumns({"qd": similarity.dimension_signatures("q"), "idn": similarity.dimension_signatures("i")})
    bonus = proposals.series_bonus(F.col("q"), F.col("i"), F.col("qd"), F.col("idn"), F.lit("ab100"), F.concat(F.lit("ab100"), F.col("p_size").cast("string")))
    return rows.select("p_partkey", F.round(bonus, 6).alias("bonus"))


_PAIRS_SQL = f"{_ITEMS}, c as (select size as query_id, row_idx, name, branch_path, price, row_idx % 3 as im, size % 3 as qm from items)"


@query(f"""with {_PAIRS_SQL}, a as (select *, case when qm > 0 then (qm = im)::int end as h1 from c), b as (select * from (select *, max(coalesce(h1, 0)) over (partition by query_id) as any1 from a) where coalesce(h1, 0) = 1 or any1 = 0),
d as (select *, (contains(name, 'ring') or contains(name, 'bolt'))::int as h2 from b), e as (select * from (select *, max(h2) over (partition by query_id) as any2 from d) where h2 = 1 or any2 = 0) select query_id, row_idx from e""")
def secondary_filters(spark: SparkSession, sf: str) -> DataFrame:
    m = lambda c: F.create_map(F.lit("category"), F.when(c > 0, c.cast("string")).otherwise(""))
    pairs = items(spark, sf).select(F.col("size").alias("query_id"), "row_idx", "name", m(F.col("size") % 3).alias("query_markers"), F.create_map(F.lit("category"), (F.col("row_idx") % 3).cast("string")).alias("item_markers"))
    rules_ = [filters.Preference("require_marker_equal", marker="category"), filters.Preference("prefer_any_tokens", tokens=("ring", "bolt"))]
    return filters.prefer(pairs, rules_, F.col("name")).select("query_id", "row_idx")


@query("""select p_partkey, case when p_partkey % 3 <> p_size % 3 and p_partkey % 3 > 0 and p_size % 3 > 0 then 'category_mismatch' when (p_partkey % 2) <> (p_size % 2) then 'duplex_mismatch' else '' end as reason from part""")
def hard_incompatibility(spark: SparkSession, sf: str) -> DataFrame:
    m = lambda c: F.create_map(F.lit("category"), F.when(F.col(c) % 3 > 0, (F.col(c) % 3).cast("string")).otherwise(""), F.lit("duplex"), (F.col(c) % 2).cast("string"))
    reason = filters.hard_incompatibility(m("p_partkey"), m("p_size"), [("category", "category_mismatch"), ("duplex", "duplex_mismatch")])
    return t(spark, sf, "part").select("p_partkey", reason.alias("reason"))


@query(f"""with {_ITEMS}, f as (select row_idx, family as qf, case when row_idx % 5 = 0 then 'rod' else family end as cf, row_idx % 4 = 0 as strict, case when row_idx % 9 = 0 then 'weakly_compatible' else 'compatible' end as label from items)
select row_idx, qf <> 'other' and cf <> 'other' and qf <> cf and not (qf = 'gear' and cf = 'rod') as forbidden, label = 'compatible' and (not strict or qf = cf or (qf <> 'gizmo' and qf = 'gear' and cf = 'rod')) as fallback from f""")
def substitution_gates(spark: SparkSession, sf: str) -> DataFrame:
    k, family = F.col("row_idx"), F.col("family")
    other = F.when(k % 5 == 0, "rod").otherwise(family)
    pairs = (("gear", "rod"),)
    fallback = filters.fallback_allowed(F.when(k % 9 == 0, "weakly_compatible").otherwise("compatible"), k % 4 == 0, family, other, ("gizmo",), pairs)
    return items(spark, sf).select("row_idx", filters.forbidden_substitution(family, other, pairs=pairs).alias("forbidden"), fallback.alias("fallback"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'article_resolver' when 1 then 'direct_exact_resolver' when 2 then 'fallback_resolver' when 3 then 'reject_resolver' else '' end as path from orders""")
def resolver_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    source = F.when(k == 0, "article_exact").when(k == 1, "name_exact").when(k == 2, "compatible_local_fallback").when(k == 3, "unresolved").otherwise("else")
    return t(spark, sf, "orders").select("o_orderkey", filters.resolver_path(source).alias("path"))


@query(f"""with {_REQUESTS}, d as (select doc_id, text from documents)
select doc_id, len(list_filter(list_slice(list_filter(w, lambda x: length(x) >= 3), 1, 6), lambda x: contains(text, x))) > 0 as hit from (select doc_id, coalesce(text, '') as text, {_TOKENS("'the with that hein thtion and blees'")} as w from documents)""")
def token_like_filter(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.tokens(F.lit("the with that hein thtion and blees"))
    return t(spark, sf, "documents").select("doc_id", filters.any_token(tokens, F.coalesce("text", F.lit(""))).alias("hit"))


from . import more_queries as _more_queries  # noqa: E402, F401  (registers its queries here)
