"""Readers of tables, page files and line records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; filters and columns are pushed to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filing_files(spark: SparkSession, root: str) -> DataFrame:
    """Per folder (accession) its largest HTML page, or else the full submission file: accession, path, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("accession", F.element_at(F.split("path", "/"), -2)).withColumn("html", F.lower("path").rlike(r"\.html?$"))
    files = files.where(F.col("html") | F.col("path").endswith("full-submission.txt"))
    order = W.partitionBy("accession").orderBy(F.desc("html"), F.desc("length"), "path")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("accession", "path", "length", "content")


def filing_headers(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds the header fields that stand in a submission's first 8,000 characters; null where absent."""
    head = F.substring(column, 1, 8000)
    field = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    return texts.withColumns({
        "cik": field(r"CENTRAL INDEX KEY:\s*(\d+)"),
        "form_type": field(r"CONFORMED SUBMISSION TYPE:\s*(\S+)"),
        "filed": field(r"FILED AS OF DATE:\s*(\d{8})"),
        "period_of_report": field(r"CONFORMED PERIOD OF REPORT:\s*(\d{8})"),
        "fiscal_year_end": field(r"FISCAL YEAR END:\s*(\d{4})"),
    })


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, failing on a line that does not fit the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def feed_rows(entries: DataFrame) -> DataFrame:
    """Feed entries (title, link, summary, content, published) as articles; content is preferred over summary."""
    body = F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.col("summary"))
    return entries.select("title", F.col("link").alias("source_url"), body.alias("text"), parse_timestamp(F.col("published")).alias("published_at"))


def parse_timestamp(c):
    """RFC 2822 or ISO text as a timestamp, null if neither."""
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")),
    )


def submission_documents(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, seq, type, text): the <DOCUMENT> blocks of full submissions."""
    blocks = F.regexp_extract_all(column, F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    rows = texts.select(key, F.posexplode(blocks).alias("seq", "_b"))
    return rows.select(key, "seq", F.trim(F.regexp_extract("_b", r"<TYPE>([^\r\n<]*)", 1)).alias("type"), F.regexp_extract("_b", r"(?s)<TEXT>(.*?)(?:</TEXT>|$)", 1).alias("text"))


def primary_documents(documents: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """Per submission its first document of the form (key, form), and for a 10-K also the longest annual-report exhibit with two of three financial signals."""
    d = documents.join(forms, key)
    first = W.partitionBy(key).orderBy("seq")
    main = d.where(F.col("type") == F.col("form")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    low = F.lower("text")
    signals = sum(low.contains(w).cast("int") for w in ("balance sheet", "cash flow", "net income"))
    extra = d.where((F.col("form") == "10-K") & (F.col("type").startswith("ARS") | F.col("type").startswith("EX-13")) & (signals >= 2))
    extra = extra.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.length("text")), "seq"))).where("_n = 1").drop("_n")
    return main.withColumn("role", F.lit("primary")).unionByName(extra.withColumn("role", F.lit("annual_report")))
