from __future__ import annotations

from kordex.functions import text
from kordex.plans import matching
from pyspark.sql import functions as F


def test_candidates_are_judged_in_every_lane(spark):
    rows = [
        (1, "Кабель cat 5e красный", "AB-1001"), (2, "Кабель cat 6 красный", "XY-20001"), (3, "Кабель cat 6 синий", "XY-20002"),
        (4, "Лоток 50x100", "QQ-7001"), (5, "Лампа дневная", "ZZ-9001"), (6, "Шкаф 42u дверь 3 м", "RK-4201"),
    ]
    items = spark.createDataFrame(rows, "row_idx long, name string, article string").withColumns({"branch_path": F.lit("a"), "tokens": text.token_set(F.col("name"))})
    asked = [
        (1, "Патч cat 6", "AB-1001"), (2, "Нечто cat 6", "XY-2000"), (3, "Лоток 60x200", "QQ-7001"), (4, "Лампа дневная", ""),
        (5, "Шкаф 24u дверь 5 м", "RK-4201"), (6, "cat 5e", "AB-100"),
    ]
    got = {r.query_id: r for r in matching.match(spark.createDataFrame(asked, "query_id long, text string, article string"), items).collect()}
    assert len(got) == 6 and not any(got[k].verifier_decision == "auto_accept" for k in (1, 2, 3, 5, 6))
    assert got[1].resolution_source != "article_exact" and got[1].found_article != "AB-1001"
    assert (got[2].resolution_source, got[2].found_article) == ("article_series_local", "XY-20001")
    assert got[3].resolution_source != "article_exact"
    assert (got[4].resolution_source, got[4].compatibility_status, got[4].verifier_decision) == ("name_exact", "compatible", "auto_accept")
    assert (got[5].found_article, got[5].resolution_source, got[5].compatibility_status) == ("RK-4201", "article_exact", "weakly_compatible")
    assert (got[6].found_article, got[6].resolution_source) == ("AB-1001", "article_series_local")


def test_a_later_candidate_of_a_series_answers(spark):
    rows = [(1, "Кабель cat 5e", "AB-1001"), (2, "Кабель cat 6", "AB-1002")]
    items = spark.createDataFrame(rows, "row_idx long, name string, article string").withColumns({"branch_path": F.lit("a"), "tokens": text.token_set(F.col("name"))})
    got = matching.match(spark.createDataFrame([(1, "Шнур cat 6", "AB-100")], "query_id long, text string, article string"), items).first()
    assert (got.found_article, got.resolution_source, got.compatibility_status) == ("AB-1002", "article_series_local", "compatible")


def test_designations_articles_in_texts_and_fallbacks(spark):
    rows = [
        (1, "Кабель ВВГнг 3х1,5", "AB-1", "кабели"), (2, "ВВГнг 3х2,5 бухта", "AB-2", None), (3, "Щит навесной", "QX-77", "щиты"), (4, "Светильник дсп", "LT-50", "свет"), (5, None, None, None),
        (6, "Полка 42u белая стальная 3 м", None, None), (7, "Полка белая", None, None), (8, "Ящик 1u 5 м", None, None), (9, "Иное", "12345", None),
    ]
    asked = [
        (1, "ВВГнг 3x1.5 красный", None), (2, "ВВГнг 3x2,5 синий", "ZZ-5"), (3, "Тара артикул QX-77", ""), (4, "Лоток прямой", "LT-50"), (5, None, None), (6, "", "QX-77"),
        (7, "Полка 24u белая стальная 5 м", None), (8, "Ящик 7u 3 м", None), (9, "совсем чужое", None), (10, "Нечто", "12345AB"),
    ]
    items = spark.createDataFrame(rows, "row_idx long, name string, article string, branch_path string").withColumn("tokens", text.token_set(F.col("name")))
    found = matching.match(spark.createDataFrame(asked, "query_id long, text string, article string"), items).collect()
    got = {r.query_id: (r.found_name, r.resolution_source, r.compatibility_status) for r in found}
    assert len(found) == len(asked)
    assert got[1] == ("Кабель ВВГнг 3х1,5", "designation_exact", "compatible")
    assert got[2] == ("ВВГнг 3х2,5 бухта", "article_designation_exact", "compatible")
    assert got[3] == ("Щит навесной", "article_extracted_exact", "compatible")
    assert got[7] == ("Полка белая", "compatible_local_fallback", "compatible")
    assert got[8] == ("Ящик 1u 5 м", "weak_compatible_fallback", "weakly_compatible")
    assert got[10] == ("Иное", "compatible_local_fallback", "compatible")
    assert {k: got[k][1] for k in (4, 5, 6, 9)} == dict.fromkeys((4, 5, 6, 9), "unresolved")


def test_bounds_leave_what_is_chosen(spark):
    words = ("кабель", "cat6", "cat5e", "красный", "синий", "pdu", "2u", "1u", "шкаф", "медь")
    line = lambda k: " ".join(words[(k * m + m) % 10] for m in (1, 3, 7))
    rows = [(a, b, ((a * 7 + b) % 5) * 0.07, line(a * 3 + 1), line(b), "телеком > питание") for a in range(12) for b in range(25)]
    pool = spark.createDataFrame(rows, "query_id long, row_idx long, penalty double, text string, name string, branch_path string")
    pool = pool.withColumns({"qm": F.from_json(F.lit("{}"), "map<string,string>"), "im": F.from_json(F.lit("{}"), "map<string,string>"), "whole": F.lower("name"), "branches": F.expr("map('телеком', double(query_id % 3))")})
    gaps = pool.groupBy("query_id").agg(F.lit(1.0).alias("gap"))
    cut, whole = matching.local_scores(pool), matching.local_scores(pool, prune=False)
    assert sorted(matching.chosen(cut, gaps).collect()) == sorted(matching.chosen(whole, gaps).collect())
    assert cut.count() < whole.count() == 300
