"""Tables and documents: search table, result cache, history, JSON and workbook files, run folders."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys, if its files have splits for half of the cores at most: a file of one row group keeps one core busy."""
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(*keys) if 2 * splits <= df.sparkSession.sparkContext.defaultParallelism else df


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the folder that the cluster shares (spark.checkpoint.dir; where it is unset, below the warehouse)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def page(df: DataFrame, order: Sequence[Column | str], size: int, number: int = 0) -> DataFrame:
    """Page `number` (from 0) of rows in an order that ends in a unique column."""
    return df.orderBy(*order).offset(size * number).limit(size)


def public_copy(spark: SparkSession, source: str, target: str) -> str:
    """A file copied for the public under a byte order mark, once: a copy that is there is used again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, to = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = to.getFileSystem(conf)
    if files.exists(to):
        return target
    part = jvm.org.apache.hadoop.fs.Path(target + ".part")
    out, held = files.create(part, True), where.getFileSystem(conf).open(where)
    out.write(bytearray(b"\xef\xbb\xbf"))
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, conf, True)
    files.rename(part, to)
    return target


def write_search_table(df: DataFrame, path: str, family: str = "effective_family") -> None:
    """Parquet by family, sorted by branch within files, so that scans of a family or a branch skip the rest."""
    salted = df.repartition(F.col(family), F.pmod(F.xxhash64("row_idx"), F.lit(16)))
    salted.sortWithinPartitions(family, "branch_path").write.mode("overwrite").partitionBy(family).parquet(path)


def append_cache(rows: DataFrame, path: str) -> None:
    """Results with a query_hash and stored_at; later rows of a hash win when the cache is read by lookup.cached."""
    rows.write.mode("append").parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(payload: Mapping, path: str | Path) -> None:
    """A small document of the driver, written whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(payload, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    part.replace(target)


def list_workbooks(folder: str | Path) -> list[Path]:
    """Workbooks of a folder without lock files and without results."""
    return sorted(p for p in Path(folder).glob("*.xlsx") if not p.name.startswith("~$") and not p.stem.endswith("_matched"))


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELATION = '<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>'


def _cell(x: object) -> str:
    if x is None:
        return "<c/>"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"<c><v>{x}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'


def write_workbook(sheets: Mapping[str, DataFrame], path: str | Path) -> None:
    """A workbook file with a sheet a DataFrame. Rows stream through the driver one partition at a time."""
    names = list(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES.format(sheets="".join(_SHEET_TYPE.format(n=i + 1) for i in range(len(names)))))
        z.writestr("_rels/.rels", _RELATIONS.format(rows=_RELATION.format(n=1, kind="officeDocument", target="xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", _RELATIONS.format(rows="".join(_RELATION.format(n=i + 1, kind="worksheet", target=f"worksheets/sheet{i + 1}.xml") for i in range(len(names)))))
        z.writestr("xl/workbook.xml", _BOOK.format(sheets="".join(f'<sheet name="{escape(n[:31])}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))))
        for i, name in enumerate(names):
            df = sheets[name]
            with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for row in _rows(df):
                    f.write(f"<row>{''.join(_cell(x) for x in row)}</row>".encode())
                f.write(b"</sheetData></worksheet>")


def _rows(df: DataFrame) -> Iterator[tuple]:
    yield tuple(df.columns)
    yield from (tuple(r) for r in df.toLocalIterator())


def read_workbook(spark: SparkSession, path: str | Path, sheet: int = 1) -> DataFrame:
    """A sheet's cells as text, the first row as headers, with row_id in the order of the sheet. A workbook fits the driver."""
    import xml.etree.ElementTree as ET

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{ns}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row):
                at = _column(c.get("r")) if c.get("r") else k
                value = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[at] = text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    header = [h or f"_c{i}" for i, h in enumerate(rows[0])] if rows else []
    data = [(i, *(r + [None] * len(header))[: len(header)]) for i, r in enumerate(rows[1:])]
    return spark.createDataFrame(data, "row_id long" + "".join(f", `{h}` string" for h in header))


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def golden_cases(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Golden cases with their JSON lists parsed; wrong headers, repeated ids and exact cases without an expectation are errors."""
    if list(df.columns) != list(columns):
        raise ValueError(f"the header is {df.columns}")
    lists = [c for c in df.columns if c.endswith("_json")]
    parsed = df.withColumns({c.removesuffix("_json"): F.from_json(c, "array<string>") for c in lists}).drop(*lists)
    again = parsed.groupBy("case_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"case {again[0][0]} is there twice")
    bad = parsed.where("expected_outcome = 'exact' and coalesce(size(expected_articles), 0) < 1").limit(1).collect()
    if bad:
        raise ValueError(f"case {bad[0]['case_id']} expects nothing")
    return parsed
