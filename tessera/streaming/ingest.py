"""Incremental ingestion: new files flow through a batch transformation into a keyed table.

State is kept by the stream's checkpoint (which files were read) and by the target table (what was
stored); the transformation itself is stateless, so no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import versions


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], transform: Callable[[DataFrame], DataFrame], format: str = "json", name: str = "ingest") -> None:
    """Read the files that are new since the last call, transform them, and merge them by key into the versioned table target.

    Only partitions that a batch's keys touch are rewritten. A version notes the last batch of the stream `name` that it holds,
    so a batch that is run again after a failure is merged once; a crash at any point leaves the version before.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = versions.version(spark, target)
        if last is not None and int(last.marks.get(name, -1)) >= batch_id:
            return
        new = transform(batch)
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(c) for c in new.columns]))).where("_n = 1").drop("_n")
        versions.merge(spark, target, new, key, marks={name: str(batch_id)})

    stream = spark.readStream.schema(schema).format(format).load(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per window and key of a stream or a table, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
