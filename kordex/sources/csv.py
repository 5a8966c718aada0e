"""Delimited files: dialect, scans, rows that are too long, folders of files, sinks."""

from __future__ import annotations

import csv as _csv
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS, ENCODINGS, PROBE_BYTES = (";", ",", "\t"), ("utf-8", "windows-1251"), 1 << 16


def head_bytes(spark: SparkSession, path: str, n: int = PROBE_BYTES) -> bytes:
    """The first bytes of a file in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream.builder().setInputStream(stream).setMaxCount(n).get()))
    except Exception:  # noqa: BLE001  an older library: read through Spark instead
        return bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, n)).first()[0])
    finally:
        stream.close()


def sniff(data: bytes) -> tuple[str, str]:
    """(separator, encoding): the first pair, separators first, under which the header has more than one column."""
    whole = data[: data.rfind(b"\n") + 1] or data
    for sep in SEPARATORS:
        for encoding in ENCODINGS:
            try:
                header = whole.decode(encoding).lstrip("﻿").split("\n", 1)[0]
            except UnicodeDecodeError:
                continue
            if len(header.split(sep)) > 1:
                return sep, encoding
    raise ValueError("no known separator and encoding gives more than one column")


def read_csv(spark: SparkSession, path: str, dialect: tuple[str, str] | None = None) -> DataFrame:
    """All columns as text. Types are cast later, where a bad value becomes null instead of an error."""
    sep, encoding = dialect or sniff(head_bytes(spark, path))
    if encoding != "utf-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=False, escape='"').csv(path)


def convert_csv(df: DataFrame) -> DataFrame:
    """df without columns whose header is empty or made up for an empty one, under trimmed headers."""
    kept = [c for c in df.columns if c.strip() and not c.strip().startswith(("Unnamed", "_c"))]
    return df.select(*[F.col(f"`{c}`").alias(c.strip().lstrip("﻿")) for c in kept])


def read_rows(spark: SparkSession, path: str, sep: str = ";", beyond: int = 64) -> DataFrame:
    """A file, or a folder of files with one header, in which rows may be short (padded with nulls) or end in separators (kept).

    Rows with more fields that say something are left out, and so are rows that repeat the header and rows that say nothing.
    Spark's own mode that drops malformed rows also drops short ones, so rows are read with `beyond` more
    columns than the header has. Quoted fields may hold separators.
    """
    first = path if not (parts := list_sources(spark, path, "part-*")) else parts[0]
    header = next(_csv.reader([head_bytes(spark, first).decode("utf-8-sig").split("\n", 1)[0].rstrip("\r")], delimiter=sep))
    own, more = [f"c{i}" for i in range(len(header))], [f"m{i}" for i in range(beyond)]
    rows = spark.read.options(header=False, sep=sep, encoding="utf-8", escape='"', ignoreTrailingWhiteSpace=False).schema(", ".join(f"{c} string" for c in [*own, *more])).csv(path)
    said = lambda c: F.trim(F.coalesce(F.regexp_replace(c, "^\ufeff", ""), F.lit("")))
    title = reduce(lambda a, x: a & (said(x[0]) == x[1].strip()), zip(own, header, strict=True), F.lit(True))
    something = reduce(lambda a, c: a | (said(c) != ""), own, F.lit(False))
    too_long = reduce(lambda a, c: a | (said(c) != ""), more, F.lit(False))
    return rows.where(~title & something & ~too_long).select(*[F.col(c).alias(h.strip()) for c, h in zip(own, header, strict=True)])


def list_sources(spark: SparkSession, folder: str, pattern: str = "*_clean.csv", exclude: Iterable[str] = ()) -> list[str]:
    """Files of a folder that match, by path, without some names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder, pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(s.getPath().toString() for s in found if s.getPath().getName() not in set(exclude))


def columns_of(spark: SparkSession, path: str) -> list[str]:
    return read_csv(spark, path).limit(0).columns


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """Text files with a header; arrays and maps are written as JSON, nulls as empty cells."""
    plain = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields]
    df.select(*plain).na.fill("").write.mode(mode).options(header=True, sep=sep, encoding="utf-8", emptyValue="", escape='"').csv(path)


def export_sorted(df: DataFrame, path: str, key: str, sep: str = ";") -> None:
    """Rows in the order of a key, over files in the order of their names; nulls as empty cells."""
    write_csv(df.orderBy(key), path, sep)
