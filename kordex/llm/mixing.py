"""Mixing sources to target weights.

Tokens (words) are summed per source, water-filled targets give each source a repetition rate, and
each document is taken floor(rate) times plus one more with probability equal to the fraction,
decided by a hash of its id. Only (id, source, size) ever moves, the table of sources has one row a
source, and no row of a source meets another one: a hot source is summed by partial aggregates and
joined by a broadcast, or, if the sources outgrow Spark's broadcast threshold, by a join whose hot
partitions Spark splits.

Defined results: a null or empty text has size 0 and is never short of its target; a null source is a
source of its own, the last one; a null id is hashed as an empty text; repeated ids draw alike; extra
columns, also those named as a new one, pass through untouched; a very long text is one row with a large size;
equal sizes draw apart, by their ids; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, free_name, small_or_not, table, written

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, size) -> (source, source_size, target).

    Weights go to the sources by code point, null last, and repeat. Each target is the smaller of
    most * source_size and level * weight, where the level makes the targets add up to share of all;
    resharing the excess again and again ends there. In order of cap / weight the level is the greatest
    of (total - caps before) / (weights from here on).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = capped.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / from_here)
    target = F.least("cap", F.max("level").over(everything) * F.col("w"))
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs -> (all columns but the text, size, source_size, target, copies): how often the mix takes each document.

    Where docs has a column of one of these names, its own stays and the new one gets a leading underscore.
    Texts are read once: their sizes are written with the other columns.
    """
    names = [c for c in docs.columns if c != text_col]
    made: dict[str, str] = {}
    for c in ("size", "source_size", "target", "copies"):
        made[c] = free_name([*docs.columns, *made.values()], c)
    key = free_name([*docs.columns, *made.values()], "mix_source")
    sized = written(docs.withColumn(made["size"], size_of(F.col(text_col))).select(*names, made["size"]), "sizes")
    targets = small_or_not(source_targets(sized.select(F.col(source_col).alias("source"), F.col(made["size"]).alias("size")), weights, share, most))
    whole, rate = F.floor(taken_rate(made["source_size"], made["target"])), taken_rate(made["source_size"], made["target"])
    copies = whole + F.when(draw(F.col(id_col), seed) < rate - whole, 1).otherwise(0)
    joined = sized.join(targets.toDF(key, made["source_size"], made["target"]), F.col(source_col).eqNullSafe(F.col(key)))
    return joined.drop(key).withColumn(made["copies"], copies.cast("long"))


def taken_rate(source_size: str, target: str) -> Column:
    """How often a source is taken; one without words is not."""
    return F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)


def emitted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs, all columns as they are, as often as it is taken, with its number (from 1) in a new
    column copy, which has a leading underscore if docs has such a column."""
    names = docs.columns
    size, key, rate_col, number = (free_name(names, c) for c in ("mix_size", "mix_source", "mix_rate", "copy"))
    sizes = docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    targets = small_or_not(source_targets(sizes, weights, share, most).select(F.col("source").alias(key), taken_rate("source_size", "target").alias(rate_col)))
    joined = docs.join(targets, F.col(source_col).eqNullSafe(F.col(key)))
    whole = F.floor(rate_col)
    copies = (whole + F.when(draw(F.col(id_col), seed) < F.col(rate_col) - whole, 1).otherwise(0)).cast("int")
    taken = joined.withColumn(size, copies).where(F.col(size) > 0)
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col(size))).alias(number))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), per as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), ranked as (
  select *, row_number() over (order by source asc nulls last) - 1 as k from per
), capped as (
  select *, case k % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, source_size * 2.0::double as cap from ranked
), levels as (
  select *, ((sum(source_size) over ())::double * 1.5::double
    - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(w) over (order by cap / w, k rows between current row and unbounded following) as level from capped
), targets as (
  select source, source_size, least(cap, max(level) over () * w) as target from levels
), rated as (
  select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
    cast('0x' || substr(md5('mix-1:' || coalesce(cast(s.doc_id as varchar), '')), 1, 13) as bigint)::double / 4503599627370496.0::double as u
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from rated
"""
