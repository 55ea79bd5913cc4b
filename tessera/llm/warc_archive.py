"""Content-addressed WARC archive (operator 6, DataFrame functions; files are parsed in Python).

An archive has two parts. payloads holds the bytes of each distinct payload once, under their SHA-256; headers holds the
exact header of every record apart, with the digest of its payload: one WARC/1.1 record per row, a response for the
smallest page id of a payload, revisits for the others. Records are rebuilt by joins, header to payload, and what is
rebuilt is verified: both digests and the length that the header states are worked out from the bytes again, and reading
fails where they differ.

export writes the records as gzipped WARC files of about FILE_BYTES, through Spark's text writer with the record end as
line separator, so they can lie in any store that Spark reaches; import_files reads such files by Content-Length.

Defined cases: a null html is an empty payload; a null url becomes an empty target URI, of other urls CR, LF and % are
escaped where one of them breaks a line; a null page id ranks after all others and revisits the smallest id, or is the
response if there is none; rows with the same page id and payload are all responses (equal records); an empty table
gives an empty archive; other columns are ignored. min_revisit_bytes leaves smaller payloads as responses each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, staged, table

RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST = 2**63 - 1
#: Bytes of an exported file, on average; a file is read back whole by one task, a larger record alone.
FILE_BYTES = 64 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of binary in base32: ten hex digits at a time make eight symbols."""
    h = F.sha1(payload)
    symbols = F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(symbols, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: Column, sha256: Column) -> Column:
    """A name-based UUID of id and payload digest."""
    h = F.sha1(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("/"), sha256).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _header(kind: Column, page_id: Column, url: Column, sha256: Column, sha1: Column, length: Column, first: Column) -> Column:
    """The exact header of a record, with the empty line that ends it."""
    uri = F.coalesce(url, F.lit(""))
    uri = F.when(uri.rlike("[\r\n]"), F.replace(F.replace(F.replace(uri, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))).otherwise(uri)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", record_id(page_id, sha256)), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), line("X-Payload-SHA256", sha256), line("X-Page-Id", F.coalesce(page_id.cast("string"), F.lit(""))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(first, sha256)))).otherwise(line("Content-Type", F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))), F.lit("\r\n"),
    )


def field(header: Column, name: str) -> Column:
    """A header field, null if it is not there."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write the archive of pages (page_id, url, html) to path: payloads by digest, and headers."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    # equal payloads meet in a map-side aggregate: one that a third of the pages have sends one row per task
    raw.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(path + "/payloads")
    narrow = staged(raw.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-pages")
    pid = F.coalesce(F.col("page_id"), F.lit(LAST))
    # written, so that Spark can split the payload that very many pages have
    first = staged(narrow.groupBy("sha256").agg(F.min(pid).alias("first")), "warc-first")
    small = F.col("n") < min_revisit_bytes
    rows = narrow.join(first, "sha256").withColumn("kind", F.when(small | (pid == F.col("first")), "response").otherwise("revisit"))
    refers = F.when((F.col("kind") == "revisit") & (F.col("first") < LAST), F.col("first"))
    header = _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("sha256"), F.col("sha1"), F.col("n"), refers)
    rows.select(header.alias("header"), "sha256").write.parquet(path + "/headers")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): exact record headers with their payload's digest, and payload bytes once per digest."""
    headers = spark.read.schema("header string, sha256 string").parquet(path + "/headers")
    return headers, spark.read.schema("sha256 string, payload binary").parquet(path + "/payloads")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its full payload, rebuilt by joins and verified.

    (page_id, record_id, record_type, refers_record, sha256, payload_digest, header, payload)
    """
    headers, payloads = read(spark, path)
    # a payload is verified once, under its digest, before it is joined to its records
    payloads = payloads.withColumn("sha1", base32_sha1(F.col("payload"))).withColumn("good", F.sha2("payload", 256) == F.col("sha256")).withColumnRenamed("sha256", "_sha256")
    h = F.col("header")
    rows = headers.select(
        field(h, "X-Page-Id").cast("long").alias("page_id"), field(h, "WARC-Record-ID").alias("record_id"), field(h, "WARC-Type").alias("record_type"), field(h, "WARC-Refers-To").alias("refers_record"),
        field(h, "X-Payload-SHA256").alias("sha256"), F.replace(field(h, "WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("payload_digest"), field(h, "Content-Length").cast("long").alias("stated"), "header",
    )
    joined = rows.join(payloads, F.col("sha256") == F.col("_sha256"), "left")
    right = F.col("good") & (F.col("sha1") == F.col("payload_digest")) & ((F.col("record_type") == "revisit") | (F.col("stated") == F.octet_length("payload")))
    checked = F.when(F.coalesce(right, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not have the digest and length of its record: "), F.col("record_id"))))
    return joined.select("page_id", "record_id", "record_type", "refers_record", "sha256", "payload_digest", "header", checked.cast("binary").alias("payload"))


def export(spark: SparkSession, path: str, files: str) -> None:
    """Write the archive at path as gzipped WARC files: responses with their payload, revisits without."""
    rows = restore(spark, path).select("record_type", "record_id", F.when(F.col("record_type") == "response", F.concat("header", F.col("payload").cast("string"))).otherwise(F.col("header")).alias("value"))
    rows = staged(rows, "warc-records")
    size = rows.agg(F.sum(F.octet_length("value").cast("long"))).first()[0] or 0
    parts = -(-size // FILE_BYTES) or 1
    rows.repartition(parts, "record_id").select("value").write.option("lineSep", RECORD_END).option("compression", "gzip").text(files)


def parse(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(exact header, its fields, content) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end].decode()
        fields = dict(x.split(": ", 1) for x in header.split("\r\n")[1:] if ": " in x)
        n = int(fields["Content-Length"])
        if data[end + n : end + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its Content-Length says")
        yield header, fields, data[end : end + n]
        at = end + n + 4


def members(data: bytes) -> Iterator[bytes]:
    """The contents of a gzip file's members, be it one for the file or one for each record."""
    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        headers, kinds, payloads = zip(*rows) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(kinds, pa.string()), pa.array(payloads, pa.binary())], ["header", "record_type", "payload"])

    for b in batches:
        for content in b.column("content").to_pylist():
            rows, held = [], 0
            for header, x, payload in parse(b"".join(members(content))):
                if "X-Payload-SHA256" not in x:
                    raise ValueError(f"record {x.get('WARC-Record-ID')} does not say which payload it has")
                rows.append((header, x["WARC-Type"], payload))
                held += len(payload) + len(header)
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)


def import_files(spark: SparkSession, files: str, path: str) -> None:
    """Make an archive at path of WARC files that export has written."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(files).select("content").mapInArrow(_read, "header string, record_type string, payload binary")
    found = staged(found, "warc-imported")
    found.where("record_type = 'response'").groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.first("payload").alias("payload")).write.parquet(path + "/payloads")
    found.select("header", field(F.col("header"), "X-Payload-SHA256").alias("sha256")).write.parquet(path + "/headers")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, as rebuilt from the archive; a revisit's response is found by the record that it refers to."""
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    records = restore(spark, path).select("page_id", "record_id", "record_type", "refers_record", "sha256", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    records = staged(records, "warc-restored")
    source = staged(records.where("record_type = 'response'").groupBy(F.col("record_id").alias("source_record")).agg(F.min("page_id").alias("refers_to")), "warc-sources")
    return records.join(source, F.col("refers_record") == F.col("source_record"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sha256")


#: The digest in base32: five bytes of SHA-1 at a time make eight symbols.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS sha256, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha256) AS first_id,
         list_aggregate(list_transform(range(0, 4), lambda g: list_aggregate(list_transform(range(0, 8), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (g * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * j)::INT) & 31)::BIGINT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS d
  FROM p
)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, sha256
FROM f
"""
