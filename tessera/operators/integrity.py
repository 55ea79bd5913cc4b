"""Corpus checks, manifests and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def mismatches(children: DataFrame, parents: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
    """Children whose copies of parent columns differ (null-safe); pairs: child column to parent column."""
    p = parents.select(key, *[F.col(v).alias(f"_p_{v}") for v in pairs.values()])
    bad = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_p_{v}")) for c, v in pairs.items()])
    return children.join(p, key).where(bad)


def check(name: str, observed: DataFrame, expected: int = 0) -> DataFrame:
    """One report row: how many rows observed has against expected."""
    return observed.agg(F.count("*").alias("observed")).select(F.lit(name).alias("check_name"), "observed", F.lit(expected).cast("long").alias("expected"), (F.col("observed") == expected).alias("passed"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()])


def row_text(columns: list[str]) -> Column:
    """A row as text: values joined by |, null as an empty string."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def row_digest(columns: list[str]) -> Column:
    return F.sha2(row_text(columns), 256)


#: The numbers of 32 bits that a row's SHA-256 is read as.
LIMBS = 8


def state(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, n_rows, s0 to s7): the sum of the rows' SHA-256 values, each part of 32 bits by itself, and their number.

    A multiset hash: it does not depend on order, is summed where rows lie before anything is shuffled, and states of parts
    add up (merged), so that a table that gains or loses rows has its new state without being read again. Whoever can choose
    very many rows could make two tables of the same sum; it is for finding changes, not for holding off forgers.
    """
    d = rows.select(*(by or []), row_digest(columns).alias("_d"))
    parts = [F.sum(F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(18,0)")).alias(f"s{i}") for i in range(LIMBS)]
    out = d.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), *parts)
    return out.na.fill(0, [f"s{i}" for i in range(LIMBS)])


def merged(states: DataFrame, other: DataFrame, by: list[str] | None = None, sign: int = 1) -> DataFrame:
    """The state of the rows of both; with sign -1 that of the first without the rows of the second."""
    columns = ["n_rows", *[f"s{i}" for i in range(LIMBS)]]
    second = other.select(*(by or []), *[(sign * F.col(c)).alias(c) for c in columns])
    return states.select(*(by or []), *columns).unionByName(second).groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in columns])


def finished(states: DataFrame) -> DataFrame:
    """States with their digest."""
    parts = [f"s{i}" for i in range(LIMBS)]
    return states.withColumn("digest", F.sha2(F.concat_ws(",", "n_rows", *parts), 256)).drop(*parts)


def content_digest(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Order-insensitive digest (digest, n_rows) per group; see state."""
    return finished(state(rows, columns, by))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows on one side only, counted by side."""
    only = lambda a, b, side: a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return only(old, new, "old").unionByName(only(new, old, "new"))


def manifest(filings: DataFrame, counts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Counts and digest of a corpus in one row."""
    out = content_digest(filings, filings.columns)
    for name, t in counts.items():
        out = out.join(F.broadcast(t.agg(F.count("*").alias(f"{name}_count"))))
    return out


def full_match(expected: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that are missing, unexpected, repeated or differ in a column, with the reason; no rows if the sets are equal."""
    e = expected.groupBy(key).agg(F.count("*").alias("_ne"), *[F.first(c).alias(f"_e_{c}") for c in columns])
    f = found.groupBy(key).agg(F.count("*").alias("_nf"), *[F.first(c).alias(f"_f_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"_e_{c}").eqNullSafe(F.col(f"_f_{c}"))
    reason = F.when(F.col("_nf").isNull(), "missing").when(F.col("_ne").isNull(), "unexpected").when((F.col("_ne") > 1) | (F.col("_nf") > 1), "repeated").when(differs, "different")
    return e.join(f, key, "full").withColumn("reason", reason).where("reason IS NOT NULL").select(key, "reason")


def manifest_errors(stored: DataFrame, filings: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, check_name, passed): a manifest's rows (by, digest, n_rows) against the filings that it describes; what only one side has does not pass."""
    now = content_digest(filings, columns, by).select(*by, F.col("digest").alias("_d"), F.col("n_rows").alias("_n"))
    both = stored.select(*by, "digest", "n_rows").join(now, by, "full")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), same(n, c).alias("passed")) for n, c in (("digest", "_d"), ("n_rows", "_n"))])
    return both.select(*by, F.explode(checks).alias("c")).select(*by, "c.*")


def preconditions(pairs: list[tuple[str, str, str, str]], spark) -> DataFrame:
    """Assertions as rows (check_name, left, right, passed); pairs: name, left, right, 'eq' or 'ne'."""
    rows = [(n, str(a), str(b), (a == b) == (how == "eq")) for n, a, b, how in pairs]
    return spark.createDataFrame(rows, "check_name string, left string, right string, passed boolean")


def chained(entries: DataFrame, file: str, order: str, payload: str, previous: str, own: str) -> DataFrame:
    """Entries of an append log whose hash, or whose link to the entry before, does not hold.

    The log lies in files that are numbered without gaps. Each is checked by itself; the first entry of a file is then joined
    with the last one of the file before, so files are checked side by side however many there are.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(file).orderBy(order)
    want = F.sha2(F.concat(F.coalesce(F.col(previous), F.lit("")), F.col(payload)), 256)
    seen = entries.withColumns({"_n": F.row_number().over(w), "_before": F.lag(own).over(w)})
    ends = entries.groupBy((F.col(file) + 1).alias(file)).agg(F.max_by(own, order).alias("_end"))
    seen = seen.join(ends, file, "left").withColumn("_before", F.when(F.col("_n") == 1, F.col("_end")).otherwise(F.col("_before")))
    bad = (F.coalesce(F.col(own), F.lit("")) != F.coalesce(want, F.lit("-"))) | ~F.col(previous).eqNullSafe(F.col("_before"))
    return seen.where(bad).drop("_n", "_before", "_end")
