"""WARC archives with dictionary-compressed records.

Pages become WARC/1.1 records. Of pages with equal payloads (of DEDUP_BYTES or more) the one with the
smallest id is a response and the others are revisits that refer to it. Each task packs its records into
archives of a bounded size: a Zstandard dictionary is built from the archive's records and put into a
skippable frame at its beginning, then each record is a Zstandard frame of its own. Archives are rows
(archive_id, n_records, content), so Spark's own writers and readers move them in any store;
export_archives and import_archives use plain files.

Only (digest, smallest id) of repeated payloads is joined: by a broadcast if it is small, else by a join
whose hot partitions Spark splits.

Defined results: a null html is an empty payload; rows that share the smallest id of a payload are all
responses; a null id comes after all others; a null url is replaced by the record's id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_or_not, table, written

DEDUP_BYTES, ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 100, 8 << 20, 64 << 10, 6
#: Frame magics and the profile of revisits.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE = T.StructType([T.StructField("archive_id", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("content", T.BinaryType())])
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def record_of(page: int | None, digest: str) -> str:
    """A record's name. Rows that share an id are told apart by their payloads; those that share both are one record twice."""
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def page_of(record: str) -> int | None:
    digits = record.removeprefix("<urn:page:").partition(":")[0]
    return int(digits) if digits else None


def encode(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_of(page, digest)}", f"WARC-Date: {date}"]
    head.append(f"WARC-Target-URI: {' '.join((url or record_of(page, digest)[1:-1]).split())}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_of(first, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record -> a row of RECORD. A response's digest is taken from its payload and held against its header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
        return page_of(fields["WARC-Record-ID"]), size, stated, "revisit", page_of(fields["WARC-Refers-To"])
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return page_of(fields["WARC-Record-ID"]), len(payload), digest, "response", None


def dictionary(records: list[bytes]):
    """A trained dictionary, or, where the records are too few or too alike to train one, their last bytes as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, f=18, accel=4)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    import zstandard

    built = dictionary(records)
    content = zstandard.ZstdCompressor(level=LEVEL).compress(built.as_bytes())
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=built)
    return b"".join([struct.pack("<II", SKIPPABLE, len(content)), content, *(press.compress(r) for r in records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive. The dictionary frame may be compressed or plain, and may be absent."""
    import zstandard

    view, at, known = memoryview(archive), 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        known, at = bytes(view[8 : 8 + size]), 8 + size
        if known[:4] == FRAME:
            known = zstandard.ZstdDecompressor().decompress(known)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)) if known else zstandard.ZstdDecompressor()
    while at < len(archive):
        one, parts = context.decompressobj(), []
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(view[at : at + 65536]))
            at += 65536
        at = min(at, len(archive)) - len(one.unused_data)
        yield b"".join(parts)


def decided(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, payload, digest, first_id, revisit)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = rows.where(F.octet_length("payload") >= DEDUP_BYTES)
    groups = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n > 1")
    firsts = groups.select(F.col("digest").alias("same_digest"), "first_id", F.lit(True).alias("repeated"))
    both = rows.join(small_or_not(firsts), F.col("digest") == F.col("same_digest"), "left")
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.select("page_id", "url", "payload", "digest", "first_id", revisit.alias("revisit"))


def write_archives(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> archives, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:06d}"]), pa.array([len(held)], pa.int64()), pa.array([pack(held)], pa.binary())], ARCHIVE.names)

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, digest, first, revisit = (batch.column(c)[k].as_py() for c in range(6))
                record = encode(page, url, payload, digest, first, revisit, date)
                if held and size + len(record) > archive_bytes:
                    yield closed()
                    made, held, size = made + 1, [], 0
                held.append(record)
                size += len(record)
        if held:
            yield closed()

    return decided(pages).mapInArrow(run, ARCHIVE)


def read_archives(archives: DataFrame) -> DataFrame:
    """Archives (a column content) -> a row of RECORD for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [decode(r) for r in unpack(batch.column(0)[k].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], RECORD.names)

    return archives.select("content").mapInArrow(run, RECORD)


def export_archives(archives: DataFrame, folder: str) -> int:
    """Archives as files <archive_id>.warc.zst in a folder of any file system that Spark knows; one at a time passes the driver."""
    spark = archives.sparkSession
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for row in archives.select("archive_id", "content").toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(top, f"{row[0]}.warc.zst"))
        out.write(bytes(row[1]))
        out.close()
        n += 1
    return n


def import_archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(written(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "warc"))


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages
), f as (
  select d, count(*) as c, min(page_id) as first_id from p where n >= 100 group by d
)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.c > 1 and p.page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
  case when f.c > 1 and p.page_id is distinct from f.first_id then f.first_id end as refers_to
from p left join f on p.d = f.d
"""
