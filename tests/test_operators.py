from __future__ import annotations

import difflib

import pytest
from pyspark.sql import functions as F

from kordex.functions import similarity, text
from kordex.functions import vocabulary as v
from kordex.operators import audit, clean, decide, lookup, merge, retrieve, rules, schema


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("1 200,50", 1200.5), ("12 руб", 12.0), ("", None), ("abc", None), (None, None), ("-3", -3.0)])
def test_number(spark, raw, want):
    assert one(spark, text.number(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1 200,5", True), ("nan", False), ("", False), (None, False), ("1e3", True), ("x", False)])
def test_has_number(spark, raw, want):
    assert one(spark, text.has_number(F.col("c")), c=raw) is want


@pytest.mark.parametrize(("raw", "want"), [("  NaN ", ""), (None, ""), ("<NA>", ""), (" ab ", "ab")])
def test_clean(spark, raw, want):
    assert one(spark, text.clean(F.col("c")), c=raw) == want


def test_normal_unifies_terms_and_keeps_cyrillic(spark):
    assert one(spark, text.normal(F.col("c")), c="Патч-корд  UTP, ёлка_1") == "патч корд utp елка_1"
    assert one(spark, text.merge_form(F.col("c")), c="Ёлка № 5/A") == "елка 5 a"


def test_tokens_drop_short_and_stop_words(spark):
    assert one(spark, text.tokens(F.col("c")), c="Кабель для шкафа 5 м the LAN") == ["кабель", "шкафа", "lan"]


def test_stem_keys(spark):
    assert one(spark, text.stem_keys(F.col("c")), c="кабелями силовые и шкаф") == ["кабел", "силов", "шкаф"]


def test_title_case(spark):
    assert one(spark, text.title_case(F.col("c")), c="кв.м ШТУКА-a") == "Кв.М Штука-A"


def test_branches(spark):
    assert one(spark, text.branch_path(F.array(F.col("a"), F.col("b"))), a=" Электрика | свет", b="Лампы") == "электрика свет > лампы"
    assert one(spark, text.branch_ancestors(F.col("a")), a="a > b > c") == ["a", "a > b", "a > b > c"]
    assert one(spark, text.branch_leaf(F.col("a")), a="a > b") == "b"


@pytest.mark.parametrize(("raw", "want"), [("Кабель арт. АБ-12/3", "АБ-12/3"), ("Switch SKU: X 1 ;", "X 1"), ("part number # 77", "77"), ("смартфон", ""), (None, "")])
def test_extract_article(spark, raw, want):
    assert one(spark, text.extract_article(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("", "empty"), (None, "empty"), ("Материалы и оборудование", "section"), ("Раздел 2 свет", "section"), ("Шкафы", "section"), ("Кабель ВВГнг 3х1,5", "item"), ("СИСТЕМА ОСВЕЩЕНИЯ", "section")])
def test_row_type(spark, raw, want):
    assert one(spark, text.row_type(F.col("c")), c=raw) == want


def test_dimension_signatures(spark):
    d = one(spark, similarity.dimension_signatures(F.col("c")), c="Лоток 100х50х3000 L=3000 d 20-25, 3x1,5")
    assert d.asDict() == {"pairs": ["1.5x3"], "triples": ["50x100x3000"], "lengths": ["3000"], "diameters": ["20-25"]}
    assert one(spark, similarity.dimension_signatures(F.col("c")), c=None).pairs == []


@pytest.mark.parametrize(("raw", "want"), [("Кабель ВВГнг 3х1,5", "ввгнг|3x1.5"), ("нет размера", ""), (None, ""), ("ВВГ 4x1 и 1x4", "ввг|4x1")])
def test_designation(spark, raw, want):
    assert one(spark, similarity.designation_signature(F.col("c")), c=raw) == want


@pytest.mark.parametrize(
    ("raw", "pairs", "triples"),
    [("3x3.0", ["3x3.0"], []), ("3.0x3", ["3.0x3"], []), ("5х2×5.0", [], ["2x5.0x5"]), ("10*9 / 4", [], ["4x9x10"]), ("1x2x3x4", [], ["1x2x3"]), ("1x2 1х2", ["1x2"], []), ("", [], [])],
)
def test_products_of_numbers(spark, raw, pairs, triples):
    d = one(spark, similarity.dimension_signatures(F.col("c")), c=raw)
    assert (d.pairs, d.triples) == (pairs, triples)


def test_sequence_ratio(spark):
    a, b = "патч корд", "патч-корды"
    assert one(spark, similarity.sequence_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


@pytest.mark.parametrize(("a", "b", "want"), [("ab1234", "ab1234", 1.0), ("abc", "abcd", 0.0), ("ab12345", "ab1234567", 0.999), ("ab12345", "ab12399", 0.2 * 5 / 7 + 0.1)])
def test_article_affinity(spark, a, b, want):
    assert one(spark, similarity.article_affinity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_single_digit_typo(spark):
    check = lambda a, b: one(spark, similarity.single_digit_typo(F.col("a"), F.col("b")), a=a, b=b)
    assert check("ab123", "ab124") and not check("ab123", "ab123") and not check("ab123", "ac123") and not check("ab123", "ab134") and not check("ab12", "ab123")


def test_headers_and_backfill(spark):
    df = spark.createDataFrame([("n1", "", "s1", "1 200,50"), ("n2", "a2", "s2", None)], "`Номенклатура ` string, `Артикул` string, `Код товара` string, `Цена` string")
    out = schema.canonical(df)
    assert out.columns == [v.NAME, v.PRICE, v.ARTICLE, "Код товара"]
    assert [r[v.ARTICLE] for r in out.collect()] == ["s1", "a2"]


def test_cleaning_keeps_identified_rows(spark):
    rows = [("T1", "A1", "0", "x"), ("T2", "", "0", "y"), ("T3", None, "5", "z"), ("T3", None, "5", "z"), ("T4", "A4", "7", "w"), ("T4", "A4", "7", "w")]
    out = clean.cleaned(spark.createDataFrame(rows, f"`{v.NAME}` string, `{v.ARTICLE}` string, `{v.PRICE}` string, note string"))
    assert sorted((r[v.NAME], r[v.PRICE]) for r in out.collect()) == [("T1", 0.0), ("T3", 5.0), ("T4", 7.0), ("T4", 7.0)]


def test_empty_table_is_cleaned(spark):
    assert clean.cleaned(spark.createDataFrame([], f"`{v.NAME}` string, `{v.ARTICLE}` string, `{v.PRICE}` string")).count() == 0


def test_merge_by_priority(spark):
    cols = f"`{v.NAME}` string, `{v.ARTICLE}` string, `{v.PRICE}` string"
    a = spark.createDataFrame([("T1", "A-1", None), ("T2", "UNKNOWN", "10"), ("T3", "", "1")], cols)
    b = spark.createDataFrame([("T1", "a-1", "150", "kind"), ("t2", None, "20", "other")], cols + ", item_type string")
    out = {r[v.NAME].lower(): (r[v.PRICE], r["item_type"]) for r in merge.merge_by_priority(merge.union_sources([a, b])).collect()}
    assert out == {"t1": ("150", "kind"), "t2": ("10", None), "t3": ("1", None)}


def test_merge_by_completeness_fills_blanks(spark):
    rows = [("K1", "n", "", 1), ("K1", "n", "ART-1", 2), ("K2", None, "x", 3), (" ", "n", "x", 4), (None, "n", "x", 5)]
    out = merge.merge_by_completeness(spark.createDataFrame(rows, "k string, name string, article string, seq long"), "k", ["seq"])
    assert sorted((r.k, r.name, r.article) for r in out.collect()) == [("K1", "n", "ART-1"), ("K2", None, "x")]


def test_duplicate_report(spark):
    rows = spark.createDataFrame([("N1", "A-1"), ("N1", ""), ("N2", "A-1")], "name string, article string")
    assert merge.duplicate_report(rows, "article", "name").first().asDict() == {"rows_total": 3, "duplicates_total": 3, "duplicates_by_article": 2, "duplicates_by_name": 2}
    assert merge.duplicate_report(rows.limit(0), "article", "name").first()["duplicates_total"] == 0


def test_lookups(spark):
    items = spark.createDataFrame([(1, "AB-100"), (2, "ab100"), (3, "AB-1001"), (4, "XY-77777"), (5, None)], "row_idx long, article string")
    q = spark.createDataFrame([(1, "AB-100"), (2, "xy 77778"), (3, None)], "query_id long, article string")
    a = F.col("article")
    pairs = lambda df: sorted((r.query_id, r.row_idx) for r in df.collect())
    assert pairs(lookup.unique_article(q, items, a, a)) == [(1, 1)]
    assert pairs(lookup.article_series(q, items, a, a)) == [(1, 3)]
    assert pairs(lookup.article_typo(q, items, a, a)) == [(2, 4)]
    assert (1, 3) in pairs(lookup.article_affinity(q, items, a, a))


def test_cable_designation_keeps_order(spark):
    items = spark.createDataFrame([(1, "Кабель ВВГнгLS 3х1,5"), (2, "ВВГнг 1,5х3"), (3, None)], "row_idx long, name string")
    q = spark.createDataFrame([(1, "ВВГнг 3x1.5")], "query_id long, text string")
    found = lookup.cable_designation(q, items, F.col("text"), F.col("name"))
    assert [(r.query_id, r.row_idx) for r in found.collect()] == [(1, 1)]


def test_cable_designation_equals_all_pairs(spark):
    words = ["ввг", "ввгнг", "ввгнгls", "пвс", "нг", "кг"]
    texts = [f"{a} {b} {d}".strip() for a in words for b in ("", *words[:4]) for d in ("3x1,5", "1,5х3", "2x4")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in lookup.cable_designation(rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "row_idx"), F.col("t"), F.col("t")).collect()}
    split = [(t.split()[:-1], t.split()[-1].replace("х", "x").replace(",", ".")) for t in texts]
    fits = lambda q, i: all(any(u.startswith(t) and len(u) - len(t) <= 3 for u in i) for t in q)
    assert got == {(a, b) for a, (q, d) in enumerate(split) for b, (i, e) in enumerate(split) if d == e and fits(q, i)}


def test_cache_takes_the_latest(spark):
    h = text.query_hash(F.lit("a"), F.lit(""))
    cache = spark.range(3).select(h.alias("query_hash"), F.col("id").alias("result"), F.col("id").alias("stored_at"))
    q = spark.createDataFrame([(1, "A"), (2, "b")], "query_id long, text string")
    assert {r.query_id: r.hit.result if r.hit else None for r in lookup.cached(q, cache, F.col("text"), F.lit("")).collect()} == {1: 2, 2: None}


def test_soft_filter_keeps_all_if_none_hits(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, None)], "query_id long, x long")
    assert sorted((r.query_id, r.x) for r in decide.soft_filters(df, [F.col("x") == 2]).collect() if r.x) == [(1, 2), (2, 3)]


def test_dimension_mismatch(spark):
    df = spark.createDataFrame([("3x1,5", "3х2,5"), ("3x1,5", "1,5x3"), ("3x1,5", "x")], "a string, b string").select(similarity.dimension_signatures("a").alias("q"), similarity.dimension_signatures("b").alias("i"))
    assert [r[0] != "" for r in df.select(decide.dimension_mismatch("q", "i")).collect()] == [True, False, False]


def test_penalty_and_score(spark):
    m = lambda **kw: F.create_map(*[F.lit(x) for p in kw.items() for x in p])
    df = spark.range(1)
    got = df.select(retrieve.penalty(m(category="cat6", shielding="utp"), m(category="cat5e", shielding="utp")), retrieve.attribute_score(F.lit(0.5), F.lit(True), m(category="cat6"), m(category="cat6"), F.lit("cable cat6"), F.lit(""))).first()
    assert got[0] == pytest.approx(0.18) and got[1] == pytest.approx(0.5 + 0.08 + 0.12 + 0.12)
    assert df.select(retrieve.compatibility(F.lit(""), F.lit(0.2))).first()[0] == "weakly_compatible"


def test_branch_bonus(spark):
    scores = F.create_map(F.lit("a"), F.lit(3.0), F.lit("b"), F.lit(9.0))
    got = spark.range(1).select(retrieve.branch_bonus(scores, F.lit("a")), retrieve.branch_bonus(scores, F.lit("b > c")), retrieve.branch_bonus(scores, F.lit("z"))).first()
    assert list(got) == [pytest.approx(0.12), pytest.approx(0.18), 0.0]


def test_rules(spark):
    m = rules.markers(F.col("c"))
    assert one(spark, m, c='Патч-корд кат 6, 2,5 м, 19" LC-SC 24 порта')["category"] == "cat6"
    got = one(spark, m, c="Шкаф 42U 19 дюйм")
    assert got["rack_unit"] == "42" and got["rack_size"] == "19 inch"
    assert one(spark, m, c=None) == {}
    families = (rules.Family("a", types=("x",)), rules.Family("b", types=("x", "y")))
    assert one(spark, rules.family_of(F.col("c"), families), c="x") == "a" and one(spark, rules.family_of(F.col("c"), families), c="q") == "q"
    assert rules.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}


@pytest.mark.parametrize(("code", "want"), [("category_x", "category_mismatch"), ("", "other_spec_mismatch"), ("catalog_missing_family", "missing_family"), ("rack_depth", "rack_form_factor_mismatch"), (None, "other_spec_mismatch"), ("zz", "other_spec_mismatch")])
def test_gap_reason(spark, code, want):
    assert one(spark, audit.gap_reason(F.col("c")), c=code) == want


@pytest.mark.parametrize(("stage", "code", "want"), [("resolved", None, "resolved"), (None, None, "runtime_error"), ("query_input", "x", "input_or_query_shape"), ("retrieval", "no_candidates_found", "search_layer_gap"), ("retrieval", "x", "matcher_retrieval_or_ranking")])
def test_reason_class(spark, stage, code, want):
    assert one(spark, audit.reason_class(F.col("s"), F.col("c")), s=stage, c=code) == want


def test_sheet_columns():
    from kordex.operators import proposals as p

    assert p.input_columns(["A", "Наименование оборудования, материалов и кабелей", "Найденная номенклатура", "Артикул"]) == ("Наименование оборудования, материалов и кабелей", "Артикул")
    assert p.input_columns(["x", "y", "z"]) == ("y", "z") and p.input_columns(["x"]) == ("x", None)
    with pytest.raises(ValueError, match="columns"):
        p.input_columns([])
    assert p.input_columns(["x", "Наименование", "y", "Артикул"]) == ("Наименование", "Артикул") and p.input_columns(["x", "y", "Наименование"]) == ("Наименование", None)


@pytest.mark.parametrize(
    ("role", "header", "points"),
    [
        ("query", "Найденная номенклатура", -45), ("query", "Наименование материалов", 80), ("query", "  NAME ", 90), ("article", "Артикул (SKU)", 160), ("article", "part number 2", 70), ("quantity", "Кол-во", 100),
        ("quantity", "Кол - во", 100), ("quantity", "Количество, стоимость", -20), ("quantity", "", 0), ("material_unit_cost", "Стоимость материалов за ед.", 100), ("material_unit_cost", "Общая стоимость материалов", -20),
        ("material_total_cost", "Общая стоимость материалов", 100), ("material_total_cost", "Стоимость работ", 0), ("labour_unit_cost", "Стоимость работ за единицу", 100), ("labour_total_cost", "Общая стоимость работ", 100),
    ],
)
def test_points_of_headers(role, header, points):
    from kordex.operators import proposals as p

    assert p.ROLES[role].points(header) == points


def test_columns_of_a_sheet(spark):
    from kordex.operators import proposals as p

    names = ["№", "Наименование", "Кол-во", "Стоимость материалов за ед.", "Общая стоимость работ"]
    found = p.sheet_columns(names)
    assert (found["query"], found["article"], found["quantity"]) == ("Наименование", "Кол-во", "Кол-во")
    assert (found["material_unit_cost"], found["labour_total_cost"]) == (names[3], names[4])
    df = p.costs(spark.createDataFrame([("a", "2,5"), ("b", None), ("c", "шт")], "`Наименование` string, `Кол-во` string"), F.lit(4.0))
    assert [(r["quantity"], r["total_cost"]) for r in df.collect()] == [(2.5, 10.0), (None, None), (None, None)]


def test_embedded_header_and_views(spark):
    from kordex.operators import proposals as p

    df = spark.createDataFrame([(0, "№", "Наименование", None), (1, "1", "Кабель", "x")], "row_id long, _c0 string, _c1 string, _c2 string")
    out = p.promoted(df)
    assert out.columns == ["row_id", "№", "Наименование", "_c2"] and out.count() == 1
    assert p.promoted(out).count() == 1
    view = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, debug int, found int, extra int, price int")
    assert p.business_view(view, ["debug"], "found", "price").columns == ["a", "found", "price"]


def test_proposals_are_aligned(spark):
    from kordex.operators import taxonomy as tx

    expected = spark.createDataFrame([("электрика > кабели",), ("электрика > провода",), ("свет > лампы светодиодные",)], "branch string")
    asked = spark.createDataFrame([(1, "электрика > кабели"), (2, "Электрика>Провода"), (3, "свет > лампы светодиодны"), (4, "мебель"), (5, None)], "proposal_id long, branch string")
    assert {r.proposal_id: r.method for r in tx.aligned(asked, expected).collect()} == {1: "exact", 2: "normalized_exact", 3: "fuzzy"}


def test_branch_selection_by_stem(spark):
    from kordex.operators import taxonomy as tx

    branches = spark.createDataFrame([("а > кабели силовые",), ("а > б",), ("в > кабели",), ("а",), ("кабель",)], "branch string")
    picked = spark.createDataFrame([("а > кабелями",)], "selection string")
    assert {r.branch for r in tx.matches_selection(branches, picked).collect()} == {"а > кабели силовые", "а", "кабель"}


def test_replies_and_chooser(spark):
    from kordex.operators import taxonomy as tx

    assert tx.parse_reply('Sure: ```json\n{"index": 1}\n```') == {"index": 1} and tx.parse_reply("so [1, 2]") == [1, 2]
    with pytest.raises(ValueError, match="JSON"):
        tx.parse_reply("no")
    df = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", [])], "query_id long, text string, options array<string>")
    assert {r.chosen for r in tx.with_chooser(df, None).collect()} == {None}
    assert [r.chosen for r in tx.with_chooser(df, lambda t, o: '{"index": 1}').orderBy("query_id").collect()] == ["b", None]


def test_json_list(spark):
    from kordex.operators import proposals as p

    assert one(spark, p.json_list(F.col("c")), c='["a"]') == ["a"] and one(spark, p.json_list(F.col("c")), c="oops") == [] and one(spark, p.json_list(F.col("c")), c=None) == []


def test_items_from_stored_texts(spark):
    from kordex.operators import filters

    rows = [("Кабель ВВГ", '["x"]', '{"category": "cat6", "duplex": ""}'), ("Лампа", "oops", None), (None, "[]", "{}")]
    out = {r[v.NAME]: (r["tokens"], r["markers"]) for r in filters.item_struct(spark.createDataFrame(rows, f"`{v.NAME}` string, search_tokens_json string, search_item_markers_json string")).collect()}
    assert out == {"Кабель ВВГ": (["x"], {"category": "cat6"}), "Лампа": (["лампа"], {})}


def test_gates_and_texts(spark):
    from kordex.operators import filters

    assert one(spark, filters.forbidden_substitution(F.col("a"), F.col("b")), a="keystone", b="rj45_outlet") is False
    assert one(spark, filters.forbidden_substitution(F.col("a"), F.col("b")), a="patch_cord", b="bulk_twisted_pair") is True
    assert one(spark, filters.header_text(F.col("c")), c="Наименование") is True and one(spark, filters.header_text(F.col("c")), c="Кабель") is False
    assert one(spark, filters.every_group(F.array(F.array(F.lit("3x1.5"), F.lit("3х1,5")), F.array(F.lit("ls"))), F.col("c")), c="ввг 3х1,5 ls") is True
    assert one(spark, filters.needs_audit(F.col("g"), F.col("s"), F.col("c")), g=None, s="unresolved", c=None) is True
    assert one(spark, filters.weak_rejected((rules.Family("rack", weak_allowed=True),), F.col("c"), F.lit(None).cast("string")), c="rack") is False


def test_dimension_preference_is_soft(spark):
    from kordex.operators import filters

    df = spark.createDataFrame([(1, 1, "лоток 50x100"), (1, 2, "лоток 60x100"), (2, 3, "без размера")], "query_id long, row_idx long, name string")
    df = df.withColumns({"query_markers": F.create_map().cast("map<string,string>"), "item_markers": F.create_map().cast("map<string,string>"), "dims": F.array(F.lit("50x100"))})
    got = filters.prefer(df, [filters.Preference("prefer_dimension_overlap"), filters.Preference("prefer_connector_pair")], F.col("name"), dimensions="dims")
    assert sorted(r.row_idx for r in got.collect()) == [1, 3]
