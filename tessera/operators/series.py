"""Calendar series: daily spine, fills, pivot, wide statements and fiscal periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily(rows: DataFrame, series: str, date: str, value: str, how: str = "ffill") -> DataFrame:
    """One row per series and day from its first to its last date; gaps filled forward or backward, leading nulls dropped."""
    ends = rows.groupBy(series).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    spine = ends.select(series, F.explode(F.sequence("_a", "_b")).alias(date))
    joined = spine.join(rows.select(series, date, value), [series, date], "left")
    w = W.partitionBy(series).orderBy(date)
    fill = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) if how == "ffill" else F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return joined.withColumn(value, fill).where(F.col(value).isNotNull())


def wide(rows: DataFrame, series: str, date: str, value: str, names: list[str]) -> DataFrame:
    """A column per series; naming them spares a pass over the data."""
    return rows.groupBy(date).pivot(series, names).agg(F.first(value)).orderBy(date)


def long(rows: DataFrame, key: list[str], name: str, value: str) -> DataFrame:
    """Wide statement columns as rows."""
    return rows.unpivot(key, [c for c in rows.columns if c not in key], name, value)


def first_of(rows: DataFrame, aliases: dict[str, list[str]]) -> dict[str, Column]:
    """For each item the first label that the statement has and that is not null."""
    return {k: F.coalesce(*[F.col(a) for a in v if a in rows.columns], F.lit(None)) for k, v in aliases.items()}


def in_effect(rows: DataFrame, group: str, order: list[str], marker: Column, name: str) -> DataFrame:
    """The last non-null marker at or before each row (an as-of lookup inside the group)."""
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def fiscal_year(report: Column, form: Column, fye_month: Column, fye_day: Column) -> Column:
    """Fiscal year of a report date.

    A year that ends around New Year (52 or 53 weeks) belongs to the year it mostly covers; annual
    reports carry their own year, other forms roll forward after the fiscal year's end.
    """
    y, m, d = F.year(report), F.month(report), F.dayofmonth(report)
    turnover = (m == 1) & (d <= 14) & ((fye_month == 12) | ((fye_month == 1) & (fye_day <= 14)))
    after = (m > fye_month) | ((m == fye_month) & (d > fye_day))
    return F.when(turnover, y - 1).when(form.startswith("10-K"), y).otherwise(F.when(after, y + 1).otherwise(y))


def fiscal_quarter(report: Column, fye_month: Column, fye_day: Column) -> Column:
    """Quarter 1 to 4 by the days since the prior fiscal year's end over 91, rounded half to even."""
    end = lambda year: F.coalesce(F.try_make_timestamp(year, fye_month, fye_day, F.lit(0), F.lit(0), F.lit(0.0)).cast("date"), F.make_date(year, fye_month, F.lit(28)))
    y = F.year(report)
    prior = F.when(end(y) < report, end(y)).otherwise(end(y - 1))
    return F.greatest(F.lit(1), F.least(F.lit(4), F.bround(F.datediff(report, prior) / 91).cast("int")))


def compact_date(text: Column) -> Column:
    """YYYYMMDD as a date, null if malformed."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))
