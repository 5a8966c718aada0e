"""Request sheets: which column asks for what, embedded headers, result columns, corrections, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .schema import header_key

# The header of a request sheet, the word of result columns, the text of a missing position.
FULL_HEADER = "наименование оборудования, материалов и кабелей"
FOUND, MISSING = "найден", "Позиция отсутствует в БД"


@dataclass(frozen=True)
class Role:
    """What a column of a sheet is for: whole headers that say so with their points, parts of headers with theirs (tight ones are
    looked for in the header without blanks; each entry counts once), and parts without which a header has no points at all."""

    whole: Mapping[str, int] = field(default_factory=dict)
    whole_tight: Mapping[str, int] = field(default_factory=dict)
    parts: Sequence[tuple[tuple[str, ...], int]] = ()
    tight: Sequence[tuple[tuple[str, ...], int]] = ()
    needs: tuple[str, ...] = ()

    def points(self, header: str) -> int:
        key = header_key(header)
        close = key.replace(" ", "")
        if not all(w in key for w in self.needs):
            return 0
        if key in self.whole or close in self.whole_tight:
            return self.whole.get(key) or self.whole_tight[close]
        return sum(n for where, entries in ((key, self.parts), (close, self.tight)) for words, n in entries if any(w in where for w in words))

    def best(self, columns: Sequence[str]) -> str | None:
        """The column with the most points, the first of equals; None if none has any."""
        points, _, column = max(((self.points(c), -i, c) for i, c in enumerate(columns)), default=(0, 0, None))
        return column if points > 0 else None


# Headers and parts of headers of each role, with points.
ROLES = {
    "query": Role({FULL_HEADER: 100, "наименование": 90, "номенклатура": 90, "product name": 90, "name": 90}, parts=((("наименован",), 60), (("номенклатур",), 55), (("оборудован", "материал", "кабел"), 20), ((FOUND,), -100))),
    "article": Role(dict.fromkeys(("артикул", "sku", "партномер", "vendor code", "part number"), 100), parts=((("артикул",), 80), (("sku",), 80), (("партномер", "vendor code", "part number"), 70), ((FOUND,), -100))),
    "quantity": Role(dict.fromkeys(("количество", "quantity", "qty"), 100), {"кол-во": 100, "колво": 100}, ((("колич",), 80), (("qty", "quantity"), 80), (("кол-во",), 80), (("цена", "стоим", "сумма", "итог", "работ", "материал"), -100)), ((("колво",), 80),)),
    "material_unit_cost": Role(parts=((("стоим",), 80), (("общ",), -100), (("работ",), -100)), tight=((("заед",), 20),), needs=("стоим", "материал")),
    "material_total_cost": Role(parts=((("стоим",), 70), (("общ",), 30), (("работ",), -100)), needs=("стоим", "материал")),
    "labour_unit_cost": Role(parts=((("стоим",), 80), (("общ",), -100)), tight=((("заед",), 20),), needs=("стоим", "работ")),
    "labour_total_cost": Role(parts=((("стоим",), 70), (("общ",), 30)), needs=("стоим", "работ")),
}


def input_columns(columns: Sequence[str], roles: Mapping[str, Role] = ROLES) -> tuple[str, str | None]:
    """(query column, article column) of a sheet: those of these roles, else the second and the third column."""
    if not columns:
        raise ValueError("the sheet has no columns")
    asked = roles["query"].best(columns) or columns[min(1, len(columns) - 1)]
    spare = [c for c in (roles["article"].best(columns), *columns[2:3]) if c not in (None, asked)]
    return asked, spare[0] if spare else None


def sheet_columns(columns: Sequence[str], roles: Mapping[str, Role] = ROLES) -> dict[str, str | None]:
    """The column of each role; None where no header speaks for one. A unit and a total may fall on one column."""
    asked, article = input_columns(columns, roles)
    return {name: role.best(columns) for name, role in roles.items()} | {"query": asked, "article": article}


def costs(df: DataFrame, price: Column, roles: Mapping[str, Role] = ROLES) -> DataFrame:
    """df with quantity, unit_cost and total_cost as numbers: the quantity of the sheet (null without a column or a number), the price found, and their product."""
    column = sheet_columns(df.columns, roles)["quantity"]
    quantity = text.number(F.col(f"`{column}`")) if column else F.lit(None).cast("double")
    return df.withColumns({"quantity": quantity, "unit_cost": price, "total_cost": price * quantity})


def placeholder(header: str) -> bool:
    h = header.strip()
    return not h or h.startswith(("Unnamed", "_c")) or h.isdigit()


def promoted(df: DataFrame, order: str = "row_id") -> DataFrame:
    """df with its first row as headers, if most headers say nothing and that row names what is asked for."""
    names = [c for c in df.columns if c != order]
    if not names or sum(map(placeholder, names)) < max(2, len(names) // 2):
        return df
    first = df.orderBy(order).limit(1).collect()
    if not first or ROLES["query"].best([str(first[0][c] or "") for c in names]) is None:
        return df
    taken = {c: (str(first[0][c]).strip() if first[0][c] is not None and str(first[0][c]).strip() else c) for c in names}
    return df.where(F.col(order) > first[0][order]).withColumnsRenamed(taken)


def business_view(df: DataFrame, hidden: Sequence[str], last: str, price: str) -> DataFrame:
    """Columns that matter to a reader: none of the hidden, none after the found name; the price always."""
    shown = [c for c in df.columns if c not in hidden]
    shown = shown[: shown.index(last) + 1] if last in shown else shown
    return df.select(*shown, *([price] if price in df.columns and price not in shown else []))


def corrected(df: DataFrame, edits: DataFrame, key: str = "row_id") -> DataFrame:
    """df with the cells that edits (key and some columns) give; null cells of edits change nothing."""
    renamed = edits.select(key, *[F.col(c).alias(f"__e_{c}") for c in edits.columns if c != key])
    changed = [c for c in edits.columns if c != key]
    both = df.join(renamed, key, "left")
    return both.select(*[F.coalesce(f"__e_{c}", c).alias(c) if c in changed else F.col(c) for c in df.columns])


def not_found(query: Column, reason: Column, error: Column, incompatibility: Column) -> Column:
    """(kind, detail) of why a request has no result, joined by a bar: error, incompatible, reason or nothing alike."""
    some = lambda c: F.coalesce(F.trim(c), F.lit(""))
    cases = [("service_error", error), ("no_compatible_candidate", incompatibility), ("not_in_catalogue", reason)]
    told = reduce(lambda rest, c: F.when(some(c[1]) != "", F.concat(F.lit(f"{c[0]}|"), some(query), F.lit("|"), some(c[1]))).otherwise(rest), reversed(cases), F.concat(F.lit("nothing_alike|"), some(query)))
    return told


def business_summary(df: DataFrame, query: Column, found: Column, section: Column, review: Column, error: Column) -> DataFrame:
    """One row of counts: requests, found, not found, to review, in error, section rows and blank rows."""
    asked = F.trim(F.coalesce(query, F.lit(""))) != ""
    real = asked & ~section
    lost = F.trim(F.coalesce(found, F.lit(""))).isin("", MISSING)
    counts = {"total": real, "found": real & ~lost, "not_found": real & lost, "requires_review": real & review, "errors": real & (F.trim(F.coalesce(error, F.lit(""))) != ""), "skipped_non_item": section, "blank_rows": ~asked}
    return df.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def batch_totals(files: DataFrame) -> DataFrame:
    """Sums over the per-file summaries of a batch."""
    return files.agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c, t in files.dtypes if t in ("int", "bigint")])


def series_bonus(query_text: Column, item_text: Column, query_dims: Column, item_dims: Column, query_compact: Column, item_compact: Column, stop: Sequence[str] = ()) -> Column:
    """What an item of the same article series gains: dimensions, thickness, shared Latin words, and what follows the article."""
    low = lambda c: text.squeeze(text.yo(F.lower(text.clean(c))))
    q, i = low(query_text), low(item_text)
    shared = lambda g: F.arrays_overlap(query_dims[g], item_dims[g])
    has = lambda g: (F.size(query_dims[g]) > 0) & (F.size(item_dims[g]) > 0)
    dims = F.when(has("triples"), F.when(shared("triples"), 0.14).otherwise(0.0)).when(has("pairs") & shared("pairs"), 0.1).otherwise(0.0)
    thick = lambda c: F.replace(F.regexp_extract(c, r"толщ(?:ина|\.?)?\s*(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    plies = F.when((thick(q) == "") | (thick(i) == ""), 0.0).when(thick(q) == thick(i), 0.12).otherwise(-0.06)
    words = F.slice(F.filter(F.regexp_extract_all(q, F.lit("([a-z]{2,8})"), F.lit(1)), lambda w: ~w.isin(*stop) if stop else F.lit(True)), 1, 4)
    rest = F.when((query_compact != "") & F.startswith(item_compact, query_compact), item_compact.substr(F.length(query_compact) + 1, F.length(item_compact))).otherwise("")
    tail = F.when(rest.rlike("^[0-9]+$"), 0.18).when(rest.rlike("[a-zа-я]"), -0.04).otherwise(0.0)
    total = dims + plies + F.size(F.filter(words, lambda w: F.contains(i, w))) * 0.08 + tail
    return F.when((q == "") | (i == ""), 0.0).otherwise(F.greatest(F.lit(-0.2), F.least(F.lit(0.45), total)))


def by_affinity(candidates: DataFrame, key: str = "query_id") -> DataFrame:
    """Candidates ranked by affinity, then score, then lexical score, then row."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("affinity"), F.desc("score"), F.desc("lexical"), "row_idx")
    return candidates.withColumn("rank", F.row_number().over(order))


def json_list(c: Column) -> Column:
    """A JSON list of texts; an empty list for anything else."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
