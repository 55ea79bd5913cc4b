"""Keyed upsert, prune, guarded update, de-duplication and contiguity as DataFrame to DataFrame operators.

Each returns the table's new state; atomic_write swaps a path, so a reader sees the old or the new state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], keep_old: dict[str, Column] | None = None) -> DataFrame:
    """Rows of existing replaced or extended by incoming.

    A null in incoming keeps the old value; keep_old gives, per column, a condition on the new value
    (column n.<name>) and the old one (o.<name>) under which the old one stays.
    """
    o, n = existing.alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    cols = []
    for c in existing.columns:
        if c in key or c not in incoming.columns:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in incoming.columns else F.col(f"o.{c}").alias(c))
            continue
        new = F.coalesce(f"n.{c}", f"o.{c}")
        stay = (keep_old or {}).get(c)
        cols.append((new if stay is None else F.when(F.col(f"o.{c}").isNotNull() & F.coalesce(stay, F.lit(False)), F.col(f"o.{c}")).otherwise(new)).alias(c))
    return joined.select(*cols)


def replace_rows(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Last write wins by key, without merging columns."""
    return existing.join(incoming, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key by order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def prune(existing: DataFrame, keep: DataFrame, parent: list[str], key: list[str]) -> DataFrame:
    """Of parents that keep mentions, only the kept keys stay; other parents are untouched."""
    touched = keep.select(*parent).distinct()
    return existing.join(touched, parent, "left_anti").unionByName(existing.join(keep.select(*parent, *key).distinct(), [*parent, *key], "left_semi"))


def changes(existing: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of incoming that differ from existing in one of columns (null-safe), with the old values as old_<name>."""
    o = existing.select(*key, *[F.col(c).alias(f"old_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return incoming.join(o, key).where(differs)


def duplicate_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def islands(rows: DataFrame, group: list[str], index: str) -> DataFrame:
    """Runs of consecutive indexes: group, first, last, length."""
    r = rows.select(*group, index).distinct()
    r = r.withColumn("_i", F.col(index) - F.row_number().over(W.partitionBy(*group).orderBy(index)))
    return r.groupBy(*group, "_i").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).drop("_i")


def contiguity(rows: DataFrame, group: list[str], index: str, start: int = 0) -> DataFrame:
    """Per group: rows, distinct indexes, whether they run from start without gap or repetition."""
    a = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(index).alias("n_distinct"), F.min(index).alias("low"), F.max(index).alias("high"))
    return a.withColumn("contiguous", (F.col("n") == F.col("n_distinct")) & (F.col("low") == start) & (F.col("high") == F.col("n") - 1 + start))


def _paths(spark: SparkSession, path: str):
    """(file system, target, new, old, mark of a complete new state)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, new, old, mark = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".new", path + ".old", path + ".new/_SUCCESS"))
    return target.getFileSystem(conf), target, new, old, mark


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def recover(spark: SparkSession, path: str) -> bool:
    """Bring a table back that a crash left between the two renames of atomic_write; whether there is a table.

    The complete new state moves in if there is one, else the old one moves back; neither is deleted before.
    """
    fs, target, new, old, mark = _paths(spark, path)
    if not fs.exists(target):
        if fs.exists(mark) and fs.exists(old):
            _rename(fs, new, target)
        elif fs.exists(old):
            _rename(fs, old, target)
    return fs.exists(target)


def atomic_write(df: DataFrame, path: str, keep_backup: bool = False) -> None:
    """Write beside path, then swap: after a crash at any point, recover finds the old or the new state whole.

    With keep_backup the state before stays at path.old, for rollback.
    """
    spark = df.sparkSession
    fs, target, new, old, _ = _paths(spark, path)
    recover(spark, path)
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(target):
        fs.delete(old, True)
        _rename(fs, target, old)
    _rename(fs, new, target)
    if not keep_backup:
        fs.delete(old, True)


def rollback(spark: SparkSession, path: str) -> None:
    """Put the backup that atomic_write kept in the place of the table."""
    fs, target, new, old, _ = _paths(spark, path)
    if not fs.exists(old):
        raise FileNotFoundError(f"no backup of {path}")
    fs.delete(new, True)
    if fs.exists(target):
        _rename(fs, target, new)
        fs.delete(new.suffix("/_SUCCESS"), False)
    _rename(fs, old, target)
    fs.delete(new, True)
