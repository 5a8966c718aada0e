"""Quality rules: fixed limits, then divergence from the document's language.

Everything is a column expression: no Python runs on the executors. One pass over the texts writes
counts and two histograms a document (character classes; common words and all others) to the shared
folder; the histograms are summed per language into references, and the Jensen-Shannon distance
(base 2, so between 0 and 1) of each document to the reference of its language decides. Short
documents are guarded: their histograms are too noisy to judge.

Defined results: a null or empty text has no words and fails the base rules; a null language is a
language of its own; a document that is alone in its language equals its reference; repeated rows are
judged each; distances in the same step as the middle one are all in the near half; a very long text is a row
of arrays as long as its words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, small_or_not, table, written

#: Frequent function words (ASCII only) of the four languages.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "en": ("the", "of", "and", "to", "a", "that", "is", "with", "for", "was"),
    "es": ("de", "la", "que", "el", "los", "se", "del", "las", "por", "para"),
    "fr": ("le", "les", "et", "des", "est", "une", "un", "pour", "dans", "au"),
}
SYMBOLS = "#*$%&|<>"
#: A document of n words is kept up to a distance of limit + slack / sqrt(n), for a short text's histogram
#: strays by chance; below so many words a distance does not judge.
CHAR_LIMIT, CHAR_SLACK, CHAR_WORDS = 0.1, 1.2, 20
WORD_LIMIT, WORD_SLACK, WORD_WORDS = 0.15, 1.2, 50
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Steps in which distances are ordered to find their middle.
BINS = 1 << 16

_LIST = tuple(dict.fromkeys(w for ws in COMMON.values() for w in ws))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in a window of n words found twice or more in the list (the first one included).

    Windows are compared by a 64-bit hash. They are sorted with their places, so a text of any length
    and repetition costs n log n.
    """

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        same = lambda s, j: lambda x: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
        places = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, j)(x)), lambda x: x["i"])))
        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))
        return let(places, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k))))
    return F.when(F.size(words) <= n, F.lit(0)).otherwise(counted)


def _left(text: Column, keep: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs -> counts of the base rules, `chars` and `common` (histograms as arrays of counts)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    by_word = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            let(F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: x.isin(*_LIST)), lambda c: F.concat(F.array(*[F.size(c) - F.size(F.array_remove(c, x)) for x in _LIST]), F.array(F.size(w) - F.size(c)))).alias("common"),
        ),
    )
    lines = let(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    chars = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))
    counted = base.select(
        "doc_id", "lang", by_word.alias("w"), lines.alias("n_dup_lines"), chars.alias("word_chars"), _left(F.col("text"), r"#*$%&|<>").alias("n_symbols"),
        _left(F.col("text"), "A-Z").alias("upper"), _left(F.col("text"), "0-9").alias("digit"), _left(F.col("text"), r".,;:!?'\"()\-").alias("point"),
        (F.octet_length("text") - F.length("text")).alias("wide"), F.length("text").alias("n"),
    )
    rest = F.greatest(F.lit(0), F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("point") - F.col("n_symbols") - F.col("wide"))
    return counted.select(
        "doc_id", "lang", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        F.array("upper", "digit", "point", "n_symbols", "wide", F.col("n") - F.col("word_chars"), rest).alias("chars"), F.col("w.common").alias("common"),
    )


def _summed(profiles: DataFrame, chars: Column, common: Column) -> DataFrame:
    """The histograms of each language, summed over the rows where chars (common) holds: one row a language."""
    sums = lambda name, k, keep: F.array(*[F.sum(F.when(keep, F.get(name, F.lit(i))).otherwise(0)).cast("double") for i in range(k)])
    return profiles.groupBy(F.col("lang").alias("ref_lang")).agg(sums("chars", 7, chars).alias("ref_chars"), sums("common", len(_LIST) + 1, common).alias("ref_common"))


def _measured(profiles: DataFrame, refs: DataFrame) -> DataFrame:
    both = profiles.join(small_or_not(refs), F.col("lang").eqNullSafe(F.col("ref_lang"))).drop("ref_lang")
    return both.withColumn("char_distance", js_distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", js_distance(F.col("common"), F.col("ref_common"))).drop("ref_chars", "ref_common")


def bin_of(distance: Column) -> Column:
    """The number of the step of 1 / BINS that a distance falls into."""
    return F.floor(distance * F.lit(float(BINS))).cast("int")


def _median_bins(measured: DataFrame, distance: str, name: str) -> DataFrame:
    """(cut_lang, name): the bin that holds a language's middle distance. Documents are counted a bin, so it is exact at any size.

    The bins of a language are looked through in two steps, groups of 256 bins and then the bins of one group, so few rows meet.
    """
    counts = checkpointed(measured.groupBy(F.col("lang").alias("cut_lang"), bin_of(F.col(distance)).alias("b")).agg(F.count(F.lit(1)).alias("n")))

    def middle(rows: DataFrame, by: str) -> DataFrame:
        """The row of each language in which the counts, with what came before, reach half of all."""
        up = rows.withColumn("up", F.col("before") + F.sum("n").over(Window.partitionBy("cut_lang").orderBy(by)))
        return up.where((2 * F.col("up") >= F.col("of")) & (2 * (F.col("up") - F.col("n")) < F.col("of")))

    groups = counts.groupBy("cut_lang", F.shiftright("b", 8).alias("g")).agg(F.sum("n").alias("n"))
    whole = groups.withColumns({"of": F.sum("n").over(Window.partitionBy("cut_lang")), "before": F.lit(0).cast("long")})
    found = middle(whole, "g").select(F.col("cut_lang").alias("l"), F.col("g").alias("in_g"), (F.col("up") - F.col("n")).alias("before"), "of")
    near = counts.join(small_or_not(found), F.col("cut_lang").eqNullSafe(F.col("l")) & (F.shiftright("b", 8) == F.col("in_g")))
    return middle(near, "b").select("cut_lang", F.col("b").alias(name))


def references(profiles: DataFrame) -> DataFrame:
    """One row a language: histograms of the half of its documents that is nearest to the histograms of all.

    The second look keeps junk, which may be frequent, out of the reference it is compared with.
    """
    first = _measured(profiles, _summed(profiles, F.lit(True), F.lit(True)))
    near = first
    for distance, name in (("char_distance", "cut_char"), ("word_distance", "cut_word")):
        near = near.join(small_or_not(_median_bins(first, distance, name)), F.col("lang").eqNullSafe(F.col("cut_lang"))).drop("cut_lang")
    return _summed(near, bin_of(F.col("char_distance")) <= F.col("cut_char"), bin_of(F.col("word_distance")) <= F.col("cut_word"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0 if one of them is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    half = lambda v, m: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
    term = lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2
    sums = lambda a, b: F.aggregate(F.zip_with(p, q, lambda x, y: term(x / a, y / b)), F.lit(0.0), lambda s, x: s + x)
    found = let(total(p), lambda a: let(total(q), lambda b: F.when((a > 0) & (b > 0), sums(a, b)).otherwise(0.0)))
    return F.sqrt(F.greatest(F.lit(0.0), found))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", char: tuple[float, float, int] = (CHAR_LIMIT, CHAR_SLACK, CHAR_WORDS), word: tuple[float, float, int] = (WORD_LIMIT, WORD_SLACK, WORD_WORDS)) -> DataFrame:
    """docs -> counts, base_failed, char_distance, word_distance, kept (a row for each row of docs)."""
    profiles = written(profile(docs, id_col, text_col, lang_col), "profiles")
    both = _measured(profiles, references(profiles))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = both.select(
        "doc_id", *[F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), "char_distance", "word_distance",
    )
    beyond = lambda name, limit, slack, least: (F.col("n_words") >= least) & (F.col(name) > limit + slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    return measured.withColumn("kept", ~(F.col("base_failed") | beyond("char_distance", *char) | beyond("word_distance", *word)))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    kept = lambda chars: f"length(regexp_replace(t, '[^{chars}]+', '', 'g'))"
    sums = lambda name, k, when: "[" + ", ".join(f"sum(case when {when} then {name}[{i + 1}] else 0 end)::double" for i in range(k)) + "]"
    share = "(x[1] / list_sum({p}))", "(x[2] / list_sum({q}))"

    def distance(p: str, q: str) -> str:
        a, b = (s.format(p=p, q=q) for s in share)
        half = lambda v: f"case when {v} > 0 then {v} * log2({v} / (({a} + {b}) / 2)) else 0 end"
        return f"case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda x: ({half(a)} + {half(b)}) / 2)))) else 0.0 end"

    k = len(_LIST) + 1
    common = ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))" for w in _LIST)
    listed = ", ".join(f"'{w}'" for w in _LIST)
    beyond = lambda name, limit, slack, least: f"(n_words >= {least} and {name} > {limit} + {slack} / sqrt(greatest(n_words, 1)))"
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
win as (select r, i, count(*) over (partition by r, g) as c from (select r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as g from (select r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from w where len(w) >= {WINDOW}))),
rep as (select r, count(distinct p) as c from (select r, unnest(generate_series(i, i + {WINDOW - 1})) as p from win where c > 1) group by r),
n as (select w.r, doc_id, lang, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, {kept('#*$%&|<>')}::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.c, 0)::bigint as n_repeat_words,
  {kept('A-Z')} as up, {kept('0-9')} as dg, {kept(".,;:!?''" + '"()' + chr(92) + '-')} as pt, strlen(t) - length(t) as wd, length(t) as ln, list_filter(list_transform(w, lambda x: lower(x)), lambda x: x in ({listed})) as lw from w left join rep using (r)),
p as (select *, [up, dg, pt, n_symbols, wd, ln - word_chars, greatest(0, word_chars - up - dg - pt - n_symbols - wd)] as chars, [{common}, n_words - len(lw)] as common from n),
r1 as (select lang as l, {sums('chars', 7, 'true')} as c1, {sums('common', k, 'true')} as w1 from p group by lang),
m1 as (select p.*, {distance('chars', 'c1')} as cd, {distance('common', 'w1')} as wdist from p join r1 on lang is not distinct from l),
cut as (select lang as l, quantile_disc(floor(cd * {BINS}), 0.5) as cc, quantile_disc(floor(wdist * {BINS}), 0.5) as cw from m1 group by lang),
r2 as (select lang as l, {sums('chars', 7, f'floor(cd * {BINS}) <= cc')} as c2, {sums('common', k, f'floor(wdist * {BINS}) <= cw')} as w2 from m1 join cut on lang is not distinct from l group by lang),
m2 as (select p.*, {distance('chars', 'c2')} as cd, {distance('common', 'w2')} as wdist, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from p join r2 on lang is not distinct from l)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or {beyond('cd', CHAR_LIMIT, CHAR_SLACK, CHAR_WORDS)} or {beyond('wdist', WORD_LIMIT, WORD_SLACK, WORD_WORDS)}) as kept
from m2
"""


ORACLE = _oracle()
