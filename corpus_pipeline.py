"""A corpus pipeline of five stages; counts as part of tessera.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns documents,
the last one with what the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, mixing, quality_rules, secret_scan
from tessera.llm.common import drop_since, mark, new_path, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the least id stays."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: ids, sizes and words taken, without the texts."""
    sized = staged(mixing.sizes(docs, "source", "lang"), "mix-sizes")
    return mixing.mix(sized).select("doc_id", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: The near-duplicate stage keeps one of each connected group; see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, point = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        docs = staged(stage(spark, docs, sf_dir), "", path)
        drop_since(spark, point, path)  # what the stage read and made is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
