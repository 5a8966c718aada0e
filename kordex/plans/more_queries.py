"""More operators as queries with their SQL: sources and sinks, cleaning, filters of families, orders, decisions, cases.

The bridge is that of plans.queries. Texts that the driver's tables lack (labels, units, headers) are made of columns of whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..functions import vocabulary as v
from ..operators import audit, candidates, clean, decide, filters, lookup, proposals, retrieve, rules, schema, taxonomy
from ..sources import csv, tables
from .queries import _FAMILIES, _ITEMS, _MERGE, _OFFERS, _offers, items, query, t

# --- sources and sinks


@query("select cast(p_partkey as varchar) as p_partkey, p_name, cast(p_retailprice as varchar) as price from part")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written with a header, found in its folder, its dialect read from its first bytes, scanned as text."""
    path = tables.shared_path(spark, "csv")
    csv.write_csv(t(spark, sf, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price")), path)
    first = csv.list_sources(spark, path, "part-*.csv")[0]
    return csv.convert_csv(csv.read_csv(spark, path, csv.sniff(csv.head_bytes(spark, first)))).select("p_partkey", "p_name", F.col("price").cast("double").cast("string").alias("price"))


@query("select cast(p_partkey as varchar) as id, case when p_partkey % 9 = 4 then 'a;b' else p_name end as name, case when p_partkey % 7 = 3 then null else p_brand end as brand from part where p_partkey % 5 <> 1")
def malformed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a field too many go; short rows, rows that end in separators and quoted separators stay."""
    k, path = F.col("p_partkey"), tables.shared_path(spark, "rows")
    name = F.when(k % 9 == 4, '"a;b"').otherwise(F.col("p_name"))
    line = F.concat(k.cast("string"), F.lit(";"), name, F.when(k % 7 == 3, "").otherwise(F.concat(F.lit(";"), "p_brand")), F.when(k % 5 == 1, F.when(k % 7 == 3, ";;extra").otherwise(";extra")).when((k % 5 == 2) & (k % 7 != 3), ";;").otherwise(""))
    t(spark, sf, "part").select(line.alias("id;name;brand")).write.options(header=True, quote="", sep="\x01", emptyValue="").csv(path)
    return csv.read_rows(spark, path)


@query(f"with {_OFFERS} select coalesce(case when article <> 'unknown' then lower(article) else {_MERGE('name')} end, '') as dedupe_key, name, coalesce(article, '') as article, coalesce(price, '') as price, cast(seq as varchar) as seq from offers")
def sorted_export(spark: SparkSession, sf: str) -> DataFrame:
    """The merged table exported in the order of its dedupe key, read again."""
    path = tables.shared_path(spark, "export")
    keyed = _offers(spark, sf).select(text.dedupe_key(F.col("article"), F.col("name")).alias("dedupe_key"), "name", "article", "price", "seq")
    csv.export_sorted(keyed, path, "dedupe_key")
    return csv.read_csv(spark, path, (";", "utf-8")).na.fill("")


@query(f"with {_ITEMS} select row_idx, name, price from items where price > 100 order by branch_path, row_idx limit 40 offset 80")
def paged_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of a filtered and ordered scan (a report)."""
    return tables.page(items(spark, sf).where("price > 100"), ["branch_path", "row_idx"], 40, 2).select("row_idx", "name", "price")


@query(f"with {_ITEMS} select row_idx, family in ('ring', 'bolt') as strict, true as relaxed from items")
def entity_scan(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("ring", "bolt")
    return items(spark, sf).select("row_idx", filters.of_family(F.col("family"), kinds).alias("strict"), filters.of_family(F.col("family"), kinds, relaxed=True).alias("relaxed"))


@query("select o_custkey as customer, o_orderkey as row, o_orderstatus as status from orders")
def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.shared_path(spark, "json")
    tables.write_json(t(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("status")), path)
    return spark.read.schema("customer long, row long, status string").json(path)


@query("select c_custkey % 50 as h, max_by(c_name, c_custkey) as name from customer group by 1")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of results appended to the cache; the later row of a hash wins."""
    path = tables.shared_path(spark, "cache")
    rows = t(spark, sf, "customer").select((F.col("c_custkey") % 50).cast("string").alias("query_hash"), F.col("c_name").alias("name"), F.col("c_custkey").alias("stored_at"))
    for part in (rows.where("stored_at % 2 = 0"), rows.where("stored_at % 2 = 1")):
        tables.append_cache(part, path)
    latest = spark.read.parquet(path).groupBy("query_hash").agg(F.max_by("name", "stored_at").alias("name"))
    return latest.select(F.col("query_hash").cast("long").alias("h"), "name")


@query("select event_type, count(*) as n from events group by 1")
def history_append(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.shared_path(spark, "history")
    e = t(spark, sf, "events").select("event_id", "event_type")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        tables.append_history(part, path)
    return spark.read.parquet(path).where("stored_at is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_ITEMS} select branch_path, count(*) as n, sum(price) as total from items where family = 'ring' group by 1")
def search_table(spark: SparkSession, sf: str) -> DataFrame:
    """The search table by family; a scan of one family reads its folder only."""
    path = tables.shared_path(spark, "search")
    tables.write_search_table(items(spark, sf).withColumnRenamed("family", "effective_family"), path)
    return spark.read.parquet(path).where("effective_family = 'ring'").groupBy("branch_path").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


# --- headers and cleaning

_SHEET = """sheet as (select p_partkey as id, case when p_partkey % 6 = 0 then ' ' else p_brand || '-' || p_partkey end as code, case when p_partkey % 4 = 0 then 'sku' || p_partkey else '' end as sku,
  case when p_partkey % 10 = 0 then null else ' ' || p_name || ' ' end as title, case when p_partkey % 8 = 0 then 0 else cast(p_retailprice as decimal(12, 2)) end as price, p_type as type from part)"""


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf, "part").select(
        F.when(k % 6 == 0, " ").otherwise(F.concat(F.col("p_brand"), F.lit("-"), k.cast("string"))).alias("Код товара"), F.when(k % 4 == 0, F.concat(F.lit("sku"), k.cast("string"))).otherwise("").alias("SKU"),
        F.when(k % 10 != 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("Номенклатура "), F.when(k % 8 == 0, "0").otherwise(F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))).alias("Цена"),
        F.col("p_type").alias("Тип изделия"), F.when(k % 50 == 0, "x").alias("редкое"), F.lit(None).cast("string").alias("пустое"),
    )


@query(f"""with {_SHEET} select title as name, coalesce(case when trim(code) <> '' then code end, case when sku <> '' then sku end) as article, case when id % 8 = 0 then '0' else replace(cast(price as varchar), '.', ',') end as price from sheet""")
def canonical_headers(spark: SparkSession, sf: str) -> DataFrame:
    return schema.canonical(_sheet(spark, sf)).select(F.col(v.NAME).alias("name"), F.col(v.ARTICLE).alias("article"), F.col(f"`{v.PRICE}`").alias("price"))


@query(f"""with {_SHEET}, c as (select trim(title) as name, coalesce(case when trim(code) <> '' then trim(code) end, case when sku <> '' then sku end) as article, cast(price as double) as price, type from sheet),
w as (select *, coalesce(name, '') <> '' and coalesce(article, '') <> '' as who from c), k as (select * from w where who or price <> 0)
select name, article, price, type from k where who union all select distinct name, article, price, type from k where not who""")
def etl_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaning; the sparse and the empty column are gone, prices are numbers, words of types begin with capitals."""
    done = clean.cleaned(_sheet(spark, sf))
    if {"редкое", "пустое"} & set(done.columns):
        raise ValueError("a sparse column was kept")
    return done.select(F.col(v.NAME).alias("name"), F.col(v.ARTICLE).alias("article"), F.col(f"`{v.PRICE}`").alias("price"), F.upper("Тип изделия").alias("type"))


# --- texts and keys


@query("""with k as (select p_partkey, case p_partkey % 5 when 0 then ' NaN ' when 1 then '<na>' when 2 then ' ' || p_name || ' ' when 3 then upper(p_name) || ' / ' || p_type else null end as c from part),
c as (select p_partkey, case when lower(trim(coalesce(c, ''))) in ('nan', 'none', '<na>') then '' else trim(coalesce(c, '')) end as c from k)
select p_partkey, c as clean, trim(regexp_replace(lower(c), '[^a-z0-9_]+', ' ', 'g')) as normal from c""")
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    c = F.when(k == 0, " NaN ").when(k == 1, "<na>").when(k == 2, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 3, F.concat(F.upper("p_name"), F.lit(" / "), "p_type"))
    return t(spark, sf, "part").select("p_partkey", text.clean(c).alias("clean"), text.normal(c).alias("normal"))


@query(f"""with w as (select p_partkey, list_filter(regexp_extract_all(lower(p_name) || ' кабели синего ' || lower(p_type), '[a-zа-я0-9]+'), lambda x: length(x) >= 4) as w from part),
k as (select p_partkey, list_transform(w, lambda x: left(case when length(regexp_replace(x, '({"|".join(v.ENDINGS)})$', '')) >= 4 then regexp_replace(x, '({"|".join(v.ENDINGS)})$', '') else x end, 5)) as k from w)
select p_partkey, array_to_string(list_sort(list_distinct(k)), ' ') as keys from k""")
def stem_keys(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.array_join(text.stem_keys(F.concat(F.lower("p_name"), F.lit(" кабели синего "), F.lower("p_type"))), " ").alias("keys"))


_LINES = "case p_partkey % 6 when 0 then 'РАЗДЕЛ 1' when 1 then 'Материалы и оборудование' when 2 then '  ' when 3 then 'НАРУЖНОЕ ОСВЕЩЕНИЕ' when 4 then 'Наименование' else 'Болт ' || p_name || ' ' || p_size end"


@query("select p_partkey, case when p_partkey % 6 in (0, 1, 3) then 'section' when p_partkey % 6 = 2 then 'empty' else 'item' end as kind, p_partkey % 6 in (2, 4) as header from part")
def row_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "part").select("p_partkey", F.expr(_LINES).alias("line"))
    return rows.select("p_partkey", text.row_type(F.col("line")).alias("kind"), filters.header_text(F.col("line")).alias("header"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then 'ввгнг ls' else 'nym' end as family from part")
def designation_families(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.lit("a b c d eee 3x1,5")).when(k % 3 == 1, F.concat(F.lit("ВВГнг LS 3х"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("арт. NYM 5x"), F.col("p_size").cast("string"), F.lit(",5 x 2")))
    return t(spark, sf, "part").select("p_partkey", candidates.designation_family(F.lower(line)).alias("family"))


@query("select p_partkey, p_partkey % 4 = 0 or (p_partkey % 4 = 1 and p_partkey % 3 = 0) as over from part")
def column_article_override(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    part = F.concat(F.lit("ab-"), k.cast("string"))
    line = F.concat(F.lit("bolt "), F.when(k % 4 == 3, F.concat(F.lit("999"), k.cast("string"), F.lit(" "))).otherwise(""), part)
    column = F.when(k % 4 == 3, F.concat(F.lit("999"), k.cast("string"))).when(k % 4 == 2, part).when(k % 4 == 1, F.lit("zz-777")).otherwise(F.concat(F.lit("0"), k.cast("string")))  # longer than the number in the line, so never in it
    over = candidates.override_article(line, column, part, k % 3 == 0, F.lit(False))
    return t(spark, sf, "part").select("p_partkey", over.alias("over"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 and not contains(o_orderpriority, cast(o_custkey as varchar)) then o_orderpriority || ' [' || o_custkey || ']' else o_orderpriority end as line from orders")
def appended_article(spark: SparkSession, sf: str) -> DataFrame:
    article = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.substring("o_orderpriority", 1, 1))
    return t(spark, sf, "orders").select("o_orderkey", decide.with_article(F.col("o_orderpriority"), article).alias("line"))


@query("select event_id, case when event_id % 2 = 0 then 'a,b' || event_id else '' end as listed from events")
def json_lists(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    told = F.when(k % 2 == 0, F.concat(F.lit('["a", "b'), k.cast("string"), F.lit('"]'))).when(k % 3 == 0, "broken [")
    return t(spark, sf, "events").select("event_id", F.array_join(proposals.json_list(told), ",").alias("listed"))


# --- families, branches, scores


@query("select p_partkey, case when p_partkey % 3 = 0 then 'ring' when p_partkey % 3 = 1 then 'bolt' else 'gear' end as family from part")
def family_of_type(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "ring_part").when(k == 1, "bolt").otherwise("gear")
    return t(spark, sf, "part").select("p_partkey", rules.family_of(kind, _FAMILIES).alias("family"))


@query(f"""with {_ITEMS} select row_idx, array_to_string(tokens, ' ') as tokens, regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g') as normalized_name, lower(split_part(branch_path, ' > ', 1)) as branch_path from items""")
def search_columns(spark: SparkSession, sf: str) -> DataFrame:
    from . import catalogue

    named = items(spark, sf).select("row_idx", F.col("name").alias(v.NAME), F.col("article").alias(v.ARTICLE), F.split("branch_path", " > ")[0].alias("Тип изделия"), F.col("tokens").alias("own_tokens"))
    out = catalogue.project(named, _FAMILIES)
    return named.select("row_idx", F.array_join("own_tokens", " ").alias("tokens")).join(out.select(F.col(v.NAME).alias("n"), "normalized_name", "branch_path", F.col(v.ARTICLE).alias("a")).withColumn("row_idx", F.element_at(F.split("a", "-"), -1).cast("long")).drop("a", "n"), "row_idx")


@query("""select p_partkey, case when p_partkey % 3 = 0 then least(0.22, p_size * 0.04) when p_partkey % 3 = 1 then least(0.18, p_size * 0.03) else 0.0 end::double as bonus from part""")
def branch_bonus(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    scores = F.create_map(F.lower("p_type"), F.col("p_size").cast("double"))
    branch = F.when(k == 0, F.lower("p_type")).when(k == 1, F.concat(F.lower("p_type"), F.lit(" > below"))).otherwise("elsewhere")
    return t(spark, sf, "part").select("p_partkey", retrieve.branch_bonus(scores, branch).alias("bonus"))


@query("""with m as (select p_partkey as k, p_size, p_partkey % 3 as a, p_size % 3 as b from part)
select k, round(greatest(0.0, least(0.999, 0.5 + case when k % 2 = 0 then 0.08 else 0 end + case when a > 0 and a = b then 0.12 else 0 end + case when a = 0 then 0 when a = b then 0.12 else -0.18 end
  - case when a > 0 and b > 0 and a <> b then 0.18 else 0 end - case when a = 1 and b = 2 or a = 2 and b = 1 then 0.2 else 0 end))::double, 6) as score from m""")
def attribute_score(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = lambda c: F.when(c % 3 == 1, "cat6").when(c % 3 == 2, "cat5e").otherwise("")
    asked, has = F.create_map(F.lit("category"), kind(k)), F.create_map(F.lit("category"), kind(F.col("p_size")))
    score = retrieve.attribute_score(F.lit(0.5), k % 2 == 0, asked, has, F.concat(F.lit("cable "), kind(F.col("p_size"))), F.lit(""))
    return t(spark, sf, "part").select(k.alias("k"), F.round(score, 6).alias("score"))


_BRANCHES = "b as (select p_size as query_id, lower(p_type) as branch, sum(p_retailprice) as score from part group by 1, 2)"


@query(f"""with {_BRANCHES}, r as (select *, row_number() over (partition by query_id order by score desc, branch) as r from b)
select query_id, max(branch) filter (r = 1) as branch, round(max(score) filter (r = 1), 6) as score, round(max(score) filter (r = 1) - coalesce(max(score) filter (r = 2), 0), 6) as gap from r where r <= 2 group by 1""")
def branch_gap(spark: SparkSession, sf: str) -> DataFrame:
    scores = t(spark, sf, "part").groupBy(F.col("p_size").alias("query_id"), F.lower("p_type").alias("branch")).agg(F.sum("p_retailprice").alias("score"))
    return candidates.branch_gap(scores).select("query_id", "branch", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


_RANKED = f"{_ITEMS}, c as (select size as query_id, row_idx, name, branch_path, price, row_number() over (partition by size order by price desc, row_idx) as rank, case row_idx % 7 when 0 then 'compatible' when 1 then 'weakly_compatible' else 'incompatible' end as label from items)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("row_idx") % 7
    rows = items(spark, sf).select(F.col("size").alias("query_id"), "row_idx", "name", "branch_path", "price", F.when(k == 0, "compatible").when(k == 1, "weakly_compatible").otherwise("incompatible").alias("label"))
    return retrieve.top_k(rows, 1 << 30, "price")


@query(f"with {_RANKED} select query_id, min_by(row_idx, rank) filter (label = 'compatible') as strict, min_by(row_idx, rank) filter (label <> 'incompatible') as weak from c group by 1 having count(*) filter (label = 'compatible') > 0")
def first_compatible(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranked(spark, sf)
    one = lambda weak, name: candidates.first_compatible(ranked, F.col("label"), weak).select("query_id", F.col("row_idx").alias(name))
    return one(False, "strict").join(one(True, "weak"), "query_id")


@query(f"with {_RANKED}, e as (select query_id, label, name, row_number() over (partition by query_id, label order by price desc, name) as r from c) select query_id, label, string_agg(name, ' | ' order by r) as names from e where r <= 3 group by 1, 2")
def example_pools(spark: SparkSession, sf: str) -> DataFrame:
    found = candidates.examples(_ranked(spark, sf).withColumnRenamed("price", "score"), ["query_id", "label"])
    return found.select("query_id", "label", F.array_join("names", " | ").alias("names"))


@query(f"""with {_RANKED}, p as (select query_id, row_idx, row_number() over (partition by query_id order by case when contains(name, 'ring') then 0 else 1 end, case when price > 1200 then 0 else 1 end, length(branch_path) desc, row_idx) as rank from c)
select query_id, row_idx, rank from p where rank <= 12""")
def preference_sort(spark: SparkSession, sf: str) -> DataFrame:
    wishes = [F.contains("name", F.lit("ring")), F.col("price") > 1200]
    return candidates.preferred(_ranked(spark, sf).drop("rank"), wishes, "branch_path", 12).select("query_id", "row_idx", "rank")


@query(f"""with {_RANKED}, a as (select query_id, min(branch_path) as asked from c group by 1)
select query_id, row_idx, row_number() over (partition by query_id order by case when branch_path = asked then 0 else 1 end, branch_path, name, row_idx) as rank from c join a using (query_id)""")
def category_sort(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranked(spark, sf).drop("rank")
    asked = ranked.groupBy("query_id").agg(F.min("branch_path").alias("asked"))
    return candidates.category_order(ranked.join(asked, "query_id"), "asked").select("query_id", "row_idx", "rank")


@query(f"with {_ITEMS} select family, count(*) as rows from items group by 1 order by rows desc, family limit 5")
def family_table(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.family_table(items(spark, sf), "family", 5)


@query(f"with {_ITEMS}, p as (select branch_path, count(*) as rows from items group by 1) select *, (select max(rows) from p) as most from p")
def probe_max_rows(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.probe_rows(items(spark, sf), "branch_path")


@query(f"""with {_RANKED} select query_id, row_idx, row_number() over (partition by query_id order by round(price / 500) desc, price desc, length(name) desc, row_idx) as rank from c""")
def affinity_order(spark: SparkSession, sf: str) -> DataFrame:
    scored = _ranked(spark, sf).drop("rank").withColumns({"affinity": F.round(F.col("price") / 500), "score": F.col("price"), "lexical": F.length("name")})
    return proposals.by_affinity(scored).select("query_id", "row_idx", "rank")


# --- filters of families

_CABLES = """cables as (select p_size as query_id, p_partkey as row_idx, p_size % 4 as f, (p_size % 3) as qc, p_partkey % 4 as ic, p_size % 5 as qs, p_partkey % 6 as s, p_size % 2 as qo, p_partkey % 7 as o from part)"""


def _cables(spark: SparkSession, sf: str) -> DataFrame:
    q, k = F.col("p_size"), F.col("p_partkey")
    kind = lambda c, none: F.when(c == 1, "cat6").when(c == 2, "cat5e").otherwise(none)
    asked = F.create_map(F.lit("category"), kind(q % 3, ""), F.lit("shielding"), F.when(q % 5 == 0, "utp").when(q % 5 == 1, "shielded").otherwise(""), F.lit("cable_environment"), F.when(q % 2 == 1, "outdoor").otherwise(""))
    has = F.create_map(F.lit("category"), kind(k % 4, ""), F.lit("shielding"), F.when(k % 6 == 0, "utp").when(k % 6 == 1, "ftp").otherwise(""), F.lit("cable_environment"), F.when(k % 7 == 0, "outdoor").when(k % 7 == 1, "indoor").otherwise(""))
    hay = F.concat(F.lit("кабель "), F.when(k % 4 == 3, "cat6 ").otherwise(""), F.when(k % 6 == 2, "u/utp ").when(k % 6 == 3, "f/utp ").otherwise(""), F.when(k % 7 == 2, "уличный ").otherwise(""), F.when(k % 3 == 0, "lszh").otherwise(""))
    family = F.when(q % 4 == 0, "bulk_twisted_pair").when(q % 4 == 1, "ring").otherwise("other")
    return t(spark, sf, "part").select(q.alias("query_id"), k.alias("row_idx"), asked.alias("query_markers"), has.alias("item_markers"), F.when(q % 7 == 0, "витая пара lszh").otherwise("витая пара").alias("query_text"), hay.alias("haystack"), family.alias("family"))


def _soft(steps: list[str], start: str, keep: str = "*") -> str:
    """SQL of soft filters, each a condition (null: says nothing) over the rows that the ones before left."""
    out, last = [], start
    for i, c in enumerate(steps):
        out.append(f"s{i} as (select {keep} from (select *, coalesce(({c})::int, 0) as h{i}, max(coalesce(({c})::int, 0)) over (partition by query_id) as m{i} from {last}) where h{i} = 1 or m{i} = 0)")
        last = f"s{i}"
    return ", ".join(out)


_PAIR_STEPS = [
    "case when qc > 0 then case when ic in (1, 2) then ic = qc else ic = 3 and qc = 1 end end",
    "case when qs = 0 then case when s < 2 then s = 0 else s = 2 end when qs = 1 then case when s < 2 then s = 1 else s = 3 end end",
    "case when qo = 1 then case when o < 2 then o = 0 else o = 2 end end", "case when query_id % 7 = 0 then row_idx % 3 = 0 end",
]


@query(f"with {_CABLES}, {_soft(_PAIR_STEPS, 'cables')} select query_id, row_idx from s3")
def twisted_pair_filter(spark: SparkSession, sf: str) -> DataFrame:
    steps = candidates.twisted_pair(F.col("query_markers"), F.col("item_markers"), F.col("query_text"), F.col("haystack"))
    return decide.soft_filters(_cables(spark, sf), steps).select("query_id", "row_idx")


_RACK_STEPS = ["case when m < 2 then (im = m and im < 2) or (m = 0 and im = 2) or (m = 1 and im = 3) end", "case when u > 0 then iu = u end", "case when m = 0 and w = 0 then x = 0 end", "case when m = 1 then im = 3 or x = 1 end"]


@query(f"""with racks as (select p_size as query_id, p_partkey as row_idx, p_size % 3 as m, p_partkey % 5 as im, p_size % 4 as u, p_partkey % 6 as iu, p_size % 2 as w, p_partkey % 4 as x from part), {_soft(_RACK_STEPS, 'racks')} select query_id, row_idx from s3""")
def rack_accessory_filter(spark: SparkSession, sf: str) -> DataFrame:
    q, k = F.col("p_size"), F.col("p_partkey")
    mount = lambda c: F.when(c == 0, "brush_panel").when(c == 1, "blank_panel").otherwise("")
    asked = F.create_map(F.lit("mount_kind"), mount(q % 3), F.lit("rack_unit"), F.when(q % 4 > 0, (q % 4).cast("string")).otherwise(""))
    has = F.create_map(F.lit("mount_kind"), mount(k % 5), F.lit("rack_unit"), F.when(k % 6 > 3, "").otherwise((k % 6).cast("string")))
    query_text = F.when(q % 2 == 0, "панель ввод").otherwise("панель юнит")
    query_text = F.when(q % 3 == 1, "панель юнит").otherwise(query_text)
    hay = F.concat(F.lit("панель "), F.when(k % 5 == 2, "щеточная ").when(k % 5 == 3, "blanking ").otherwise(""), F.when(k % 4 == 0, "cable entry").when(k % 4 == 1, "свободная").otherwise(""))
    rows = t(spark, sf, "part").select(q.alias("query_id"), k.alias("row_idx"), asked.alias("a"), has.alias("h"), query_text.alias("t"), hay.alias("x"))
    return decide.soft_filters(rows, candidates.rack_accessory(F.col("a"), F.col("h"), F.col("t"), F.col("x"))).select("query_id", "row_idx")


@query(f"""with {_CABLES}, own as (select * from cables where f = 0), {_soft(_PAIR_STEPS, 'own')}, reg as (select *, (row_idx % 3 = 0)::int as hit from cables where f = 1), regs as (select * from (select *, max(hit) over (partition by query_id) as any1 from reg) where hit = 1 or any1 = 0)
select query_id, row_idx from s3 union all select query_id, row_idx from regs union all select query_id, row_idx from cables where f > 1""")
def filter_dispatcher(spark: SparkSession, sf: str) -> DataFrame:
    registry = {"ring": (filters.Preference("prefer_any_tokens", tokens=("lszh",)),)}
    return candidates.dispatched(_cables(spark, sf), registry).select("query_id", "row_idx")


@query(f"with {_ITEMS} select row_idx, family = 'ring' or row_idx % 3 = 0 or row_idx % 5 = 0 as member, true as open from items")
def family_or_type(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("row_idx")
    kinds = (F.col("family"), F.when(k % 3 == 0, "ring").otherwise("rod"), F.when(k % 5 == 0, "ring_part").otherwise("x"))
    return items(spark, sf).select("row_idx", candidates.family_or_type(*kinds, ("ring",), "ring", "ring_part").alias("member"), candidates.family_or_type(*kinds, ("ring",), "other", "").alias("open"))


@query("select p_partkey, (contains(p_name, 'ring') or contains(p_name, 'bolt')) and (contains(p_type, 'LARGE') or contains(p_type, 'SMALL')) as every from part")
def designation_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.array(F.array(F.lit("ring"), F.lit("bolt")), F.array(F.lit("LARGE"), F.lit("SMALL")))
    return t(spark, sf, "part").select("p_partkey", filters.every_group(groups, F.concat_ws(" ", "p_name", "p_type")).alias("every"))


@query("""select o_orderkey, o_orderstatus = 'O' or o_orderkey % 3 = 0 or (o_orderpriority like '1%' and o_orderstatus <> 'F') as audit, o_orderkey % 5 = 0 or o_custkey % 2 = 0 as refused from orders""")
def audit_focus(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    status = F.when(k % 3 == 0, "rejected_incompatible").when(s == "F", "compatible").otherwise("weak")
    need = filters.needs_audit(F.when(F.col("o_orderpriority").startswith("1"), "group").otherwise(""), F.when(s == "O", "unresolved").otherwise("article_exact"), status)
    families = (rules.Family("loose", weak_allowed=True), rules.Family("tight"))
    refused = filters.weak_rejected(families, F.when(F.col("o_custkey") % 2 == 0, "tight").otherwise("loose"), F.when(k % 5 == 0, "refused"))
    return t(spark, sf, "orders").select("o_orderkey", need.alias("audit"), refused.alias("refused"))


# --- articles and cables


@query("""with k as (select p_partkey, p_partkey % 7 as k, p_size from part)
select p_partkey, case k when 0 then 'hard_reason' when 1 then 'domains_differ' when 2 then 'article_query_candidate_domain_mismatch' when 3 then 'article_query_candidate_domain_mismatch'
  when 4 then case when p_size <> 30 then 'article_query_candidate_dimension_mismatch' else '' end else '' end as reason from k""")
def article_sanity(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    q = F.when(k == 2, "лоток перфорированный").when(k == 3, "по для камер").when(k == 4, "короб 30x40").otherwise("болт")
    i = F.when(k == 2, "светильник дсп").when(k == 3, "камера купольная").when(k == 4, F.concat(F.lit("короб "), size, F.lit("x40"))).otherwise("болт")
    rows = t(spark, sf, "part").select("p_partkey", k.alias("k"), q.alias("q"), i.alias("i")).withColumns({"qd": similarity.dimension_signatures(F.col("q")), "idn": similarity.dimension_signatures(F.col("i"))})
    reason = candidates.article_sanity(F.when(F.col("k") == 0, "hard_reason").otherwise(""), F.when(F.col("k") == 1, "domains_differ").otherwise(""), F.col("q"), F.col("i"), decide.dimension_mismatch("qd", "idn"))
    return rows.select("p_partkey", reason.alias("reason"))


@query("select p.p_partkey as query_id, i.p_partkey as row_idx from part p join part i on p.p_size = i.p_size and (p.p_partkey % 2 = i.p_partkey % 2)")
def cable_designation_join(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, "ВВГнг").otherwise("ПВС")
    parts = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("Кабель "), name, F.lit(" 3х"), F.col("p_size").cast("string")).alias("q"), F.concat(name, F.lit(" 3x"), F.col("p_size").cast("string"), F.lit(" бухта")).alias("i"))
    return lookup.cable_designation(parts.select(F.col("p_partkey").alias("query_id"), "q"), parts.select(F.col("p_partkey").alias("row_idx"), "i"), F.col("q"), F.col("i"))


@query(f"""with {_ITEMS} select i.row_idx as query_id, min(j.row_idx) as row_idx from items i join items j on regexp_replace(lower(i.name), '[^a-z0-9_]+', ' ', 'g') = regexp_replace(lower(j.name), '[^a-z0-9_]+', ' ', 'g') group by 1""")
def normalized_name_join(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf)
    asked = i.select(F.col("row_idx").alias("query_id"), F.concat(F.upper(F.replace("name", F.lit(" "), F.lit(" / "))), F.lit(" ;")).alias("q"))
    return lookup.exact_first(asked, i, text.normal(F.col("q")), text.normal(F.col("name")))


@query("""select o_orderkey, case when review then case when s >= 0.8 then 'medium' else 'low' end when s >= 0.92 then 'high' when s >= 0.75 then 'medium' else 'low' end as level
from (select o_orderkey, (o_orderkey % 100) / 100 as s, o_orderstatus = 'O' as review from orders)""")
def confidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", decide.confidence((F.col("o_orderkey") % 100) / 100, F.col("o_orderstatus") == "O").alias("level"))


# --- diagnoses, cases, runs

_RESULTS = """r as (select event_id, case when event_id % 3 = 0 then 'found' else '' end as found, case when event_id % 5 = 0 then 'boom' else '' end as error,
  case event_id % 8 when 1 then 'section_row' when 2 then 'weak_match_rejected' when 3 then 'category_mismatch' when 4 then 'no_compatible_candidates' when 5 then 'odd' else '' end as reason, case when event_id % 11 = 0 then 3 else 0 end as shortlist from events)"""


@query(f"""with {_RESULTS} select event_id, case when found <> '' then 'resolved' when error <> '' then 'runtime_error' when reason = 'section_row' then 'query_input' when reason = 'weak_match_rejected' then 'fallback_policy'
  when shortlist > 0 then 'gemini_selection' when reason = 'category_mismatch' then 'compatibility_filter' else 'local_recall' end as stage,
  case when found <> '' then 'resolved' when error <> '' then 'runtime_exception' when reason in ('section_row', 'weak_match_rejected') then reason when shortlist > 0 then case when reason in ('', 'no_compatible_candidates') then 'gemini_rejected_all_candidates' else reason end
  when reason = '' then 'no_compatible_candidates' else reason end as code from r""")
def base_stage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    reason = F.when(k % 8 == 1, "section_row").when(k % 8 == 2, "weak_match_rejected").when(k % 8 == 3, "category_mismatch").when(k % 8 == 4, "no_compatible_candidates").when(k % 8 == 5, "odd")
    found = candidates.base_stage(F.when(k % 3 == 0, "found"), F.when(k % 5 == 0, "boom"), reason, F.lit(""), F.when(k % 11 == 0, 3).otherwise(0))
    return t(spark, sf, "events").select("event_id", found.alias("s")).select("event_id", "s.stage", "s.code")


@query("""select o_orderkey as row_number, o_orderpriority as asked, o_orderstatus as found, case when o_orderkey % 2 = 0 then o_orderpriority else '' end as diagnosis_stage, case when o_orderkey % 3 = 0 then o_custkey else 0 end as coverage_same_family from orders""")
def case_records(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_number")
    diagnoses = o.where("row_number % 2 = 0").select("row_number", F.col("o_orderpriority").alias("stage"))
    coverage = o.where("row_number % 3 = 0").select("row_number", F.col("o_custkey").alias("same_family"))
    return candidates.case_records(o.select("row_number", F.col("o_orderpriority").alias("asked")), o.select("row_number", F.col("o_orderstatus").alias("found")), diagnoses, coverage)


@query("""with q as (select p_partkey as query_id, case p_partkey % 3 when 0 then 'keystone' when 1 then 'rj45_outlet' else 'rod' end as family from part where p_size = 7), i as (select s_suppkey as row_idx, case s_suppkey % 4 when 0 then 'keystone' when 1 then 'rj45_outlet' when 2 then 'rod' else 'x' end as family from supplier)
select query_id, q.family as family, row_idx, i.family as item_family from q join i on q.family = i.family or (q.family, i.family) in (('keystone', 'rj45_outlet'), ('rj45_outlet', 'keystone'))""")
def family_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the items of the families that theirs looks at (parts of one size ask, all suppliers answer)."""
    k, s = F.col("p_partkey") % 3, F.col("s_suppkey") % 4
    asked = t(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("query_id"), F.when(k == 0, "Keystone ").when(k == 1, "rj45_outlet").otherwise("rod").alias("family"))
    offers = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_idx"), F.when(s == 0, "keystone").when(s == 1, "rj45_outlet").when(s == 2, "rod").otherwise("x").alias("family"))
    return candidates.scope_join(asked, offers).withColumn("family", F.lower(F.trim("family")))


@query("""with f as (select l_suppkey as file, count(*) as total, count(*) filter (l_returnflag = 'A') as found from lineitem group by 1) select count(*) as files, sum(total)::bigint as total, sum(found)::bigint as found from f""")
def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("file")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "A").alias("found"))
    return proposals.batch_totals(files)


@query(f"with {_ITEMS}, a as (select family, case when size % 3 = 0 then 'catalog_missing_family' when size % 3 = 1 then 'catalog_has_compatible_candidates' else 'non_target_family' end as d from items) select family, count(*) as rows, count(*) filter (d = 'catalog_missing_family') as catalog_missing_family, 0::bigint as catalog_has_family_but_no_compatible_specs, count(*) filter (d = 'catalog_has_compatible_candidates') as catalog_has_compatible_candidates from a where d <> 'non_target_family' group by 1")
def coverage_by_family(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("size") % 3
    rows = items(spark, sf).select("family", F.when(k == 0, "catalog_missing_family").when(k == 1, "catalog_has_compatible_candidates").otherwise("non_target_family").alias("diagnosis"))
    return audit.coverage_summary(rows, "family")


@query("select o_orderkey as row_id, o_orderpriority as asked, o_orderstatus as found, o_totalprice as price from orders")
def business_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("debug"), F.col("o_orderpriority").alias("asked"), F.col("o_orderstatus").alias("found"), F.lit(1).alias("trace"), F.col("o_totalprice").alias("price"))
    return proposals.business_view(rows, ["debug"], "found", "price")


@query(f"""with {_ITEMS}, b as (select distinct branch_path as branch from items) select branch as proposal_id, branch as matched, case when length(branch) % 2 = 0 then 'normalized_exact' else 'exact' end as method from b""")
def branch_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals that say a branch, half of them in capitals: found as they are or by their equal key."""
    branches = items(spark, sf).select(F.col("branch_path").alias("branch")).distinct()
    return taxonomy.aligned(branches.select(F.col("branch").alias("proposal_id"), F.when(F.length("branch") % 2 == 0, F.upper("branch")).otherwise(F.col("branch")).alias("branch")), branches)


_TYPES = (candidates.TextRule("large_bolt", (("bolt",), ("large",))), candidates.TextRule("metal", (("bolt", "ring", "gear"),), ("hot",)), candidates.TextRule("soft", (("red", "old"),)))


@query("""with p as (select p_partkey, lower(p_name || ' ' || p_type) as x from part), k as (select *, case when contains(x, 'bolt') and contains(x, 'large') then 'large_bolt' when (contains(x, 'bolt') or contains(x, 'ring') or contains(x, 'gear')) and not contains(x, 'hot') then 'metal' when contains(x, 'red') or contains(x, 'old') then 'soft' else 'other' end as kind from p)
select p_partkey, kind, case when kind = 'metal' and contains(x, 'ring') then 'ring_part' when contains(x, 'promo') then 'promo_item' else kind end as effective from k""")
def type_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Types by a table of rules, first hit wins, and the types that rules make of them."""
    normal = text.normal(F.concat_ws(" ", "p_name", "p_type"))
    made = (("metal", candidates.TextRule("ring_part", (("ring",),))), ("*", candidates.TextRule("promo_item", (("promo",),))))
    rows = t(spark, sf, "part").select("p_partkey", normal.alias("n")).withColumn("kind", candidates.first_rule(F.col("n"), _TYPES))
    return rows.select("p_partkey", "kind", candidates.effective_type(F.col("kind"), F.col("n"), made).alias("effective"))
