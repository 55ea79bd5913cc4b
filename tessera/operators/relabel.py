"""Sections of quarterly reports that were named after the wrong part: found by content, then by position, and renamed under guard.

Runs of consecutive chunks under a label that both parts have are judged as wholes: by words of either part, and where both or
neither are found by whether the run lies before the first section that only the second part has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Labels of the second part that may stand for the first part's, with words of either; and sections of the second part alone.
RISK, MINES = "Defaults upon Senior Securities", "Mine Safety Disclosures"
TARGETS = {RISK: "Quantitative and Qualitative Disclosures about Market Risk", MINES: "Controls and Procedures"}
FIRST = {
    RISK: r"(?i)interest rate risk|commodity price|foreign currency|exchange rate|market risk|value at risk|hedg|derivative|notional|sensitivity|basis point"
    r"|trading portfolio|marketable securities|available-for-sale|fair value|equity securities|impair",
    MINES: r"(?i)disclosure controls|internal control|principal executive|principal financial|certification|exhibit 31|rule 13a-15|rule 15d-15"
    r"|material weakness|effectiveness of|evaluation of|chief executive officer|chief financial officer",
}
SECOND = {RISK: r"(?i)default(s)? upon senior|dividend arrearage|senior securities", MINES: r"(?i)mine safety|mine act|msha|federal mine|dodd-frank.{0,40}mine"}
ANCHORS = ("Legal Proceedings", "Risk Factors", "Unregistered Sales of Equity Securities")


@dataclass(frozen=True)
class Rules:
    """Words and labels as above, or of another vocabulary."""

    targets: dict[str, str]
    first: dict[str, str]
    second: dict[str, str]
    anchors: tuple[str, ...]


REPORTS = Rules(TARGETS, FIRST, SECOND, ANCHORS)


def _by_label(label: Column, values: dict[str, str], then) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(label == name, then(value)).otherwise(out)
    return out


def _judged(chunks: DataFrame, filing: str, index: str, section: str, text: str, rules: Rules, order: tuple[str, ...]) -> DataFrame:
    """(filing, section, first, last, basis, target) of every run, basis and target null under labels that are not affected.

    A run's last chunk knows all of it from what was met before, so runs are rows of one order and need no grouping or join; the order is
    all that a task sorts. A chunk without a filing has no anchor and stays as it is, as does one without an index.
    """
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")
    said = lambda words: F.coalesce(_by_label(F.col(section), words, lambda w: flat.rlike(w)), F.lit(False))
    order = order or (index,)
    rows = chunks.select(*dict.fromkeys([filing, *order, index, section]), said(rules.first).alias("_p1"), said(rules.second).alias("_p2"))
    w = W.partitionBy(filing).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    far, whole = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    beside = lambda f, step: F.coalesce((f(index).over(w) == F.col(index) + step) & f(section).over(w).eqNullSafe(F.col(section)), F.lit(False))
    anchor = F.when(F.col(section).isin(*rules.anchors) & F.col(filing).isNotNull(), F.col(index))
    rows = rows.withColumns({"_goes_on": beside(F.lag, -1), "_ends": ~beside(F.lead, 1), "second": F.min(anchor).over(whole)})
    latest = lambda c: F.max(F.when(c, F.col(index))).over(far)
    rows = rows.withColumns({"first": latest(~F.col("_goes_on")), "_at1": latest(F.col("_p1")), "_at2": latest(F.col("_p2"))}).where("_ends").withColumnRenamed(index, "last")
    here = lambda c: F.coalesce(F.col(c) >= F.col("first"), F.lit(False))
    p1, p2 = here("_at1"), here("_at2")
    before, after = F.col("last") < F.col("second"), F.col("first") >= F.col("second")
    basis = (
        F.when(p2 & ~p1, "content:part-ii").when(p1 & ~p2, "content:part-i")
        .when(p1 & F.col("second").isNull(), "mixed:no-anchor-default-part-i").when(p1, "mixed:position-tiebreak")
        .when(before, "position:before-part-ii").when(after, "position:after-part-ii").otherwise("unresolved")
    )
    rows = rows.withColumn("basis", F.when(F.col(section).isin(*rules.targets), basis))
    renamed = F.col("basis").isin("content:part-i", "mixed:no-anchor-default-part-i", "position:before-part-ii") | ((F.col("basis") == "mixed:position-tiebreak") & before)
    return rows.select(filing, section, "first", "last", "basis", F.when(renamed & F.col(filing).isNotNull() & F.col("last").isNotNull(), _by_label(F.col(section), rules.targets, F.lit)).alias("target"))


def runs(chunks: DataFrame, filing: str, index: str, section: str, text: str, rules: Rules = REPORTS, order: tuple[str, ...] = ()) -> DataFrame:
    """(filing, section, first, last, basis, target): each run under an affected label and what it is; target is null where it stays, basis 'unresolved' where nothing tells.

    A filing has an index once. order: columns that the index was numbered by, if it was: chunks that are sorted by them are not sorted again.
    """
    return _judged(chunks, filing, index, section, text, rules, order).where("basis IS NOT NULL")


def renamed(chunks: DataFrame, filing: str, index: str, section: str, text: str, rules: Rules = REPORTS, order: tuple[str, ...] = ()) -> DataFrame:
    """(filing, index, section) of every chunk, with its new name: plan and names in one pass, as runs hold each chunk once. Arguments as in runs()."""
    every = _judged(chunks, filing, index, section, text, rules, order)
    return every.select(filing, F.explode_outer(F.sequence("first", "last")).alias(index), F.coalesce("target", section).alias(section))


def relabelled(chunks: DataFrame, plan: DataFrame, filing: str, index: str, section: str) -> DataFrame:
    """The chunks with the plan's names; a chunk whose label is no longer the one that the plan saw stays as it is."""
    names = plan.where("target IS NOT NULL").select(filing, F.col(section).alias("_was"), F.explode(F.sequence("first", "last")).alias(index), "target")
    both = chunks.join(names, [filing, index], "left")
    return both.withColumn(section, F.when(F.col("target").isNotNull() & F.col(section).eqNullSafe(F.col("_was")), F.col("target")).otherwise(F.col(section))).drop("_was", "target").select(*chunks.columns)


def basis_counts(plan: DataFrame) -> DataFrame:
    """(basis, runs, renamed): what the plan rests on."""
    return plan.groupBy("basis").agg(F.count("*").alias("runs"), F.count("target").alias("renamed"))


def repeated_targets(chunks: DataFrame, filing: str, index: str, section: str) -> DataFrame:
    """(filing, section, runs): sections that a filing has in more than one run, which a rename must not make more of."""
    r = chunks.withColumn("_i", F.col(index) - F.row_number().over(W.partitionBy(filing, section).orderBy(index)))
    return r.groupBy(filing, section).agg(F.count_distinct("_i").alias("runs")).where("runs > 1")
