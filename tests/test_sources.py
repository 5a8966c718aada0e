from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from kordex.functions import vocabulary as v
from kordex.plans import catalogue, runs
from kordex.sources import csv, tables
from kordex.streaming import incremental


@pytest.mark.parametrize(("data", "want"), [("a;b\n1;2\n".encode(), (";", "utf-8")), ("имя,цена\n".encode("cp1251"), (",", "windows-1251")), ("﻿a\tb\n".encode(), ("\t", "utf-8"))])
def test_sniff(data, want):
    assert csv.sniff(data) == want


def test_sniff_refuses_one_column():
    with pytest.raises(ValueError, match="column"):
        csv.sniff(b"abc\n1\n")


def test_rows_too_long_are_left_out(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name;article;price\nT1;A1;100\nT2;A2;200;EXTRA\nT3;A3;300\nT4;A4\nT5;A5;1;\n", encoding="utf-8")
    rows = csv.read_rows(spark, str(tmp_path / "x.csv")).collect()
    assert sorted((r.article, r.price) for r in rows) == [("A1", "100"), ("A3", "300"), ("A4", None), ("A5", "1")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, ["x"]), ('b;"c"', "2", [])], "n string, p string, t array<string>")
    csv.write_csv(df, str(tmp_path / "out"))
    back = spark.read.options(header=True, sep=";", escape='"').csv(str(tmp_path / "out"))
    assert sorted((r.n, r.t) for r in back.collect()) == [("a", '["x"]'), ('b;"c"', "[]")]


def test_catalogue_from_files(spark, tmp_path):
    (tmp_path / "a_clean.csv").write_text("Номенклатура;Код товара;Цена;Unnamed: 3\nКабель ВВГ;A-1;;\nЛампа;;5;\n", encoding="utf-8")
    (tmp_path / "b_clean.csv").write_bytes("Наименование,Артикул,Цена розничная\nКабель ВВГ,a-1,1 200.50\n".encode("cp1251"))
    paths = csv.list_sources(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a_clean.csv", "b_clean.csv"]
    built = catalogue.project(catalogue.build(spark, paths))
    got = {r[v.NAME]: (r[v.PRICE], r["branch_path"], r["tokens"]) for r in built.collect()}
    assert got == {"Кабель ВВГ": (1200.5, "электрика > кабели", ["ввг", "кабель"]), "Лампа": (5.0, "прочее", ["лампа"])}
    tables.write_search_table(built, str(tmp_path / "search"))
    assert spark.read.parquet(str(tmp_path / "search")).count() == 2


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1.5), (None, 2.0)], "n string, p double")
    tables.write_workbook({"one": df, "two": df.limit(0)}, tmp_path / "x.xlsx")
    (tmp_path / "~$x.xlsx").touch()
    (tmp_path / "x_matched.xlsx").touch()
    assert [p.name for p in tables.list_workbooks(tmp_path)] == ["x.xlsx"]
    assert [(r.row_id, r.n, r.p) for r in tables.read_workbook(spark, tmp_path / "x.xlsx").orderBy("row_id").collect()] == [(0, "a<b", "1.5"), (1, None, "2.0")]


def test_golden_cases(spark):
    rows = [("c1", "exact", '["A"]'), ("c2", "review", "[]")]
    df = spark.createDataFrame(rows, "case_id string, expected_outcome string, expected_articles_json string")
    assert sorted(map(tuple, (r.expected_articles for r in tables.golden_cases(df, df.columns).collect()))) == [(), ("A",)]
    with pytest.raises(ValueError, match="twice"):
        tables.golden_cases(df.union(df), df.columns)
    with pytest.raises(ValueError, match="header"):
        tables.golden_cases(df, ["x"])


def test_incremental_merge(spark, tmp_path):
    for k, rows in enumerate(([("a", None, 1), ("b", 5.0, 1)], [("a", 7.0, 2), ("c", None, 2)], [("b", 9.0, 3)])):
        spark.createDataFrame(rows, "article string, price double, source long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("article string, price double, source long").parquet(str(tmp_path / "in"))
        order = [F.col("price").isNotNull().desc(), F.col("source")]
        q = incremental.start_merge(stream, str(tmp_path / "table"), str(tmp_path / "ckpt"), F.col("article"), order, buckets=2).trigger(availableNow=True).start()
        q.awaitTermination()
        assert k >= 0
    got = {r.article: r.price for r in incremental.current(spark, str(tmp_path / "table")).collect()}
    assert got == {"a": 7.0, "b": 5.0, "c": None}


def test_runs(spark, tmp_path):
    book = runs.Runs(tmp_path)
    run = book.create(file="x")["run_id"]
    assert runs.run_job(spark, book, run, lambda: {"rows": spark.range(5).count()})["result"] == {"rows": 5}
    with pytest.raises(ValueError, match="cannot go"):
        book.move(run, "running")
    bad = book.create()["run_id"]
    with pytest.raises(ZeroDivisionError):
        runs.run_job(spark, book, bad, lambda: 1 / 0)
    assert book.get(bad)["state"] == "failed"
    old = book.create()["run_id"]
    book.move(old, "running")
    time.sleep(0.01)
    assert book.interrupt_stale(dt.timedelta(0)) == [old]
    assert [r["run_id"] for r in book.newest(1)] == [old]


def test_sync_of_folders(spark, tmp_path):
    from kordex.sources import remote

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.csv").write_text("1")
    (tmp_path / "a" / "y.txt").write_text("1")
    (tmp_path / "b" / "old.csv").write_text("1")
    assert remote.sync(spark, str(tmp_path / "a"), str(tmp_path / "b")) == (["x.csv"], ["old.csv"])
    assert remote.sync(spark, str(tmp_path / "a"), str(tmp_path / "b")) == ([], [])
    assert sorted(n for n in remote.listing(spark, str(tmp_path / "b")) if n.endswith(".csv")) == ["x.csv"]


def test_windowed_counts(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(str(tmp_path / "events"))
    q = incremental.windowed_counts(stream, "ts", "event_type", "1 day", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
