"""Text as column expressions: cleaning, normal forms, tokens, keys. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v


def clean(c: Column) -> Column:
    """Trimmed text; null and the words nan, none, <na> are empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "<na>"), "").otherwise(t)


def has_text(c: Column) -> Column:
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return ~F.lower(t).isin("", "nan", "none", "nat", "<na>")


def yo(c: Column) -> Column:
    return F.replace(c, F.lit("ё"), F.lit("е"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def replaced(c: Column, pairs: Mapping[str, str]) -> Column:
    """Literal replacements, one after the other in the order given."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)


def normal_terms(c: Column, aliases: Mapping[str, str] = v.TERM_ALIASES, synonyms: Mapping[str, str] = v.SYNONYMS) -> Column:
    return yo(replaced(replaced(F.lower(clean(c)), aliases), synonyms))


def normal(c: Column, aliases: Mapping[str, str] = v.TERM_ALIASES, synonyms: Mapping[str, str] = v.SYNONYMS) -> Column:
    """Search form: terms unified, everything but letters, digits and _ is one space."""
    return squeeze(F.regexp_replace(normal_terms(c, aliases, synonyms), r"(?U)[^\w]+", " "))


def normal_registry(c: Column) -> Column:
    return squeeze(F.regexp_replace(yo(F.lower(clean(c))), r"(?U)[^\w]+", " "))


def merge_form(c: Column) -> Column:
    """The form in which names are compared in merging and in duplicate reports."""
    return F.trim(F.regexp_replace(yo(F.lower(F.coalesce(c.cast("string"), F.lit("")))), "[^a-zа-я0-9]+", " "))


def tokens(c: Column, stop: Iterable[str] = v.STOP_WORDS, aliases: Mapping[str, str] = v.TERM_ALIASES, synonyms: Mapping[str, str] = v.SYNONYMS) -> Column:
    # The signs between tokens need not become blanks first: they are in no token.
    found = F.regexp_extract_all(normal_terms(c, aliases, synonyms), F.lit("([a-zа-я0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stop))


def token_set(c: Column, **kw) -> Column:
    return F.array_sort(F.array_distinct(tokens(c, **kw)))


def stem_keys(c: Column) -> Column:
    """Five-letter keys of words of four letters or more, one ending cut if four letters stay."""
    words = F.filter(F.regexp_extract_all(normal(c), F.lit("([a-zа-я0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 4)
    endings = f"({'|'.join(v.ENDINGS)})$"

    def key(t: Column) -> Column:
        cut = F.regexp_replace(t, endings, "")
        return F.substring(F.when(F.length(cut) >= 4, cut).otherwise(t), 1, 5)

    return F.array_sort(F.array_distinct(F.transform(words, key)))


def branch_path(parts: Column) -> Column:
    """A path of clean lower-case segments; separators within a segment become spaces."""
    one = lambda p: F.lower(squeeze(F.regexp_replace(clean(p), r"[|/\\]", " ")))
    return F.array_join(F.filter(F.transform(parts, one), lambda p: p != ""), v.BRANCH_SEPARATOR)


def branch_leaf(path: Column) -> Column:
    return F.element_at(F.split(path, v.BRANCH_SEPARATOR), -1)


def branch_ancestors(path: Column) -> Column:
    """The path and all its prefixes, shortest first."""
    parts = F.split(path, v.BRANCH_SEPARATOR)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), v.BRANCH_SEPARATOR))


def article_key(c: Column) -> Column:
    return F.lower(squeeze(clean(c)))


def article_compact(c: Column) -> Column:
    return F.regexp_replace(article_key(c), "[^0-9a-zа-я]+", "")


def article_for_merge(c: Column) -> Column:
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("", "unknown", "nan", "none", "null"), "").otherwise(t)


def dedupe_key(article: Column, name: Column) -> Column:
    a = F.lower(article_for_merge(article))
    return F.when(a != "", a).otherwise(merge_form(name))


def number(c: Column) -> Column:
    """A price from text: blanks and no-break spaces go, a comma is a point, other signs are dropped; null if nothing is left."""
    t = F.replace(F.regexp_replace(c.cast("string"), "[ \\s]", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(t, r"[^\d.\-]", "").try_cast("double")


def has_number(c: Column) -> Column:
    """Whether text reads as a number; NaN does not."""
    x = F.replace(F.regexp_replace(c.cast("string"), "[ \\s]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return x.isNotNull() & ~F.isnan(x)


def shard(key: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def stable_row_id(*parts: Column) -> Column:
    """48 bits of the md5 of the parts in lower case, joined by bars."""
    joined = F.concat_ws("|", *[F.lower(clean(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("long")


def query_hash(text: Column, article: Column) -> Column:
    """The md5 that names a query in the cache of results."""
    key = article_key(article)
    return F.md5(F.concat(normal(text), F.when(key != "", F.concat(F.lit("‖‖article:"), key)).otherwise("")).cast("binary"))


def title_case(c: Column) -> Column:
    """Each run of letters begins with a capital; other signs separate runs."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays as sets; 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def extract_article(c: Column) -> Column:
    """The article that follows a label such as sku or part number."""
    label = r"(?iu)(?:^|[\s,;/\(\)])(?:артикул|арт\.?|sku|part\s*number|partnumber|vendor\s*code)\s*[:№#-]?\s*(.+?)\s*$"
    return F.regexp_replace(squeeze(F.regexp_extract(squeeze(clean(c)), label, 1)), r"^[ ,;:.]+|[ ,;:.]+$", "")


def row_type(c: Column, section_patterns: Iterable[str] = ()) -> Column:
    """empty, section or item: what a line of a request is."""
    original, n = clean(c), normal(c)
    few = (F.size(tokens(c)) <= 4) & ~n.rlike(r"\d")
    shouting = (original == F.upper(original)) & (F.length(original) <= 80) & original.rlike("[А-ЯЁ]") & ~original.rlike(r"\d") & (F.size(F.split(n, " ")) >= 2)
    section = reduce(lambda a, p: a | n.rlike(f"(?iu){p}"), section_patterns, n.rlike(r"^материалы(?:\s+и\s+оборудование)?$") | n.startswith("раздел"))
    section = section | shouting | (n.startswith("наименование ") & (F.size(tokens(c)) <= 8)) | (few & reduce(lambda a, w: a | n.startswith(w), v.SECTION_WORDS, F.lit(False)))
    return F.when(n == "", "empty").when(section, "section").otherwise("item")


def null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
