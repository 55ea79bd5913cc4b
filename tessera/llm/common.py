"""What the operators of this subpackage share: words, staging in the shared folder, components."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once per row; a plain reference inside a lambda would repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text, none for null or blank."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session under the cluster's checkpoint folder; executors and driver all see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        here = spark.sparkContext._jsc.sc().getCheckpointDir()
        if here.isDefined():
            base = here.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="tessera-")  # one machine: driver and executors are one process
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    app = spark.sparkContext.applicationId
    path = f"{base}/tessera-{app}"
    _forget_at_exit(spark, path)
    return path


_registered: set[str] = set()


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    if path in _registered:
        return
    _registered.add(path)

    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(drop)


#: Folders of staged tables in the order in which each thread made them: a run drops only its own.
_made = threading.local()


def _own() -> list[str]:
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _own().append(path)
    return path


def mark() -> int:
    """A point in the list of staged tables, for drop_since."""
    return len(_own())


def drop_since(spark: SparkSession, point: int, keep: str) -> None:
    """Delete all tables that were staged since the point but one, once nothing reads them any more."""
    for path in _own()[point:]:
        if path != keep:
            drop_path(spark, path)
    _own()[point:] = [keep]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # what was shuffled for the table is not needed any more: the driver's cleaner deletes it once its handles are collected
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the undirected edges (a, b); component is the least id reachable.

    Goes on until nothing changes, about the logarithm of the longest path in rounds. Alternates the large-star and small-star steps. Each step is a minimum per node and an equi-join,
    so a node with very many neighbours is a skewed join key that Spark can split, never a list in one task.
    """
    spark = edges.sparkSession
    at = new_path(spark, "components")
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "", f"{at}/0")
    before = _digest(now)
    for k in count(1):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # what is joined is written first: then both sides of a join are plain exchanges, which Spark can split at a node with very many neighbours
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "", f"{at}/{k}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "", f"{at}/{k}-large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "", f"{at}/{k}-low")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        now = staged(small, "", f"{at}/{k}")
        for old in (k - 1, f"{k}-least", f"{k}-large", f"{k}-low"):
            drop_path(spark, f"{at}/{old}")
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def least_hashes(keys: DataFrame, key: str, n_rows: int, limit: int) -> DataFrame:
    """At most limit keys, those with the least hashes, of a table of n_rows rows.

    Only hashes in a range that holds about four times limit are sorted, so what meets in one task
    stays as small however many rows and partitions there are.
    """
    share = min(1.0, 4 * limit / max(n_rows, 1))
    h = F.xxhash64(key)
    near = keys.select(key).where(F.col(key).isNotNull())
    if share < 1:
        near = near.where(h <= int(-(2**63) + share * 2**64))
    return near.distinct().orderBy(h, key).limit(limit)
