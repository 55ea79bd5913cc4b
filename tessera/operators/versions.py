"""A keyed table in versions: a merge rewrites only the partitions that its keys touch and becomes visible by one rename.

    root/data/<write>/part=<n>/...   files of partitions, never changed once written
    root/versions/<n>                a version: which folder holds each partition, the schema, counts

A version is written beside its place and renamed into it; the rename fails if the place is taken, so of two writers one
wins and the other is told. Whatever a crash leaves behind is not part of any version: readers see the version before, and
vacuum removes it. A reader stays on the version that it opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partitions of a table, by the hash of the columns that it is dealt by.
PARTS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer's version took the place of this one."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    by: list[str]
    parts: int
    folders: dict[str, str]  #: partition to folder below the root
    marks: dict[str, str] = field(default_factory=dict)  #: what writers note, such as a stream's last batch


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions that there are, oldest first."""
    fs, p = _fs(spark, f"{root}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """A version, the latest by default; None before the first."""
    have = numbers(spark, root)
    if number is None and not have:
        return None
    if number is not None and number not in have:
        raise FileNotFoundError(f"{root} has no version {number}")
    row = spark.read.text(f"{root}/versions/{have[-1] if number is None else number:020d}", wholetext=True).first()
    return Version(**json.loads(row[0]))


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table as it is in a version; later merges do not change what is read."""
    v = version(spark, root, number)
    if v is None:
        raise FileNotFoundError(f"{root} has no version yet")
    return _folders(spark, root, v, sorted(set(v.folders.values())))


def _folders(spark: SparkSession, root: str, v: Version, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(v.schema))
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def commit(spark: SparkSession, root: str, v: Version) -> None:
    """Make a version visible, if its number is free."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, f"{root}/versions/{v.number:020d}")
    _, draft = _fs(spark, f"{root}/versions/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(asdict(v)).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise ConcurrentWrite(f"version {v.number} of {root} was written meanwhile") from e
        raise


def merge(
    spark: SparkSession, root: str, incoming: DataFrame, key: list[str], by: list[str] | None = None, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    parts: int = PARTS, marks: dict[str, str] | None = None, drop: DataFrame | None = None,
) -> Version:
    """The next version: rows of incoming (one a key) in the place of those with their key, all others as they are.

    by: the columns that rows are dealt by, key or some of it. drop: values of by whose old rows all go, so that incoming
    replaces whole groups. combine(old, incoming) gives the new rows of the touched partitions instead. Only those
    partitions are read and written.
    """
    last = version(spark, root)
    by = last.by if last else (by or key)
    parts = last.parts if last else parts
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    names = incoming.select(part.alias("part"))
    if drop is not None:
        names = names.unionByName(drop.select(part.alias("part")))
    touched = [str(r[0]) for r in names.distinct().collect()]  # at most `parts` rows
    old = _folders(spark, root, last, sorted({last.folders[p] for p in touched if p in last.folders})) if last else incoming.limit(0)
    if combine is not None:
        new = combine(old, incoming)
    else:
        rest = old if drop is None else old.join(drop.select(*by).distinct(), by, "left_anti")
        new = rest.join(incoming.select(*key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)
    folder = f"data/{uuid.uuid4().hex}"
    new.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{root}/{folder}")
    fs, at = _fs(spark, f"{root}/{folder}")
    made = [s.getPath().getName().removeprefix("part=") for s in fs.listStatus(at) if s.getPath().getName().startswith("part=")]
    folders = {p: f for p, f in (last.folders if last else {}).items() if p not in touched} | {p: f"{folder}/part={p}" for p in made}
    v = Version(last.number + 1 if last else 1, json.dumps(new.schema.jsonValue()), by, parts, folders, (last.marks if last else {}) | (marks or {}))
    commit(spark, root, v)
    return v


def replace_groups(spark: SparkSession, root: str, incoming: DataFrame, group: str, index: str, dims: dict[str, int] | None = None, groups: DataFrame | None = None) -> Version:
    """Whole groups in the place of what they were: new rows in, stale ones out, in one version.

    incoming is checked before anything is written: groups are positive, each counts its index from 0 without gaps or repeats,
    vectors have the length that dims gives them and finite numbers. groups: all that are replaced, also those without rows now.
    """
    bad = []
    g = incoming.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    r = g.agg(F.count_if(F.col(group).isNull() | (F.col(group) <= 0)), F.count_if((F.col("n") != F.col("d")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | F.col("low").isNull())).first()
    bad += [f"{r[0]} groups without a positive {group}"] * bool(r[0]) + [f"{r[1]} groups whose {index} has gaps or repeats"] * bool(r[1])
    for column, size in (dims or {}).items():
        whole = F.coalesce((F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        n = incoming.where(~whole).count()
        bad += [f"{n} rows without {size} finite numbers in {column}"] * bool(n)
    if bad:
        raise ValueError("; ".join(bad))
    return merge(spark, root, incoming, [group, index], [group], drop=incoming.select(group) if groups is None else groups.select(group))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the last versions, and folders and drafts that none of these holds; how many folders went."""
    have = numbers(spark, root)
    held = {f.split("/")[1] for n in have[-keep:] for f in version(spark, root, n).folders.values()}
    fs, data = _fs(spark, f"{root}/data")
    for n in have[:-keep]:
        fs.delete(_fs(spark, f"{root}/versions/{n:020d}")[1], False)
    for s in fs.listStatus(_fs(spark, f"{root}/versions")[1]):
        if s.getPath().getName().startswith(".draft-"):
            fs.delete(s.getPath(), False)
    gone = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in held]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def write_once(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a small JSON file that never changes: whether it was written now. Another value than the one that is there is refused."""
    fs, p = _fs(spark, path)
    text = json.dumps(value, sort_keys=True, separators=(",", ":"))
    if fs.exists(p):
        there = spark.read.text(path, wholetext=True).first()
        if there is None or there[0] != text:
            raise ValueError(f"{path} holds another value")
        return False
    _, draft = _fs(spark, f"{path}.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, p):
        raise OSError(f"could not write {path}")
    return True
