"""Versions of filings, provenance and context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_amendment(form: Column) -> Column:
    return F.upper(F.trim(form)).endswith("/A")


def base_form(form: Column) -> Column:
    return F.regexp_replace(form, "(?i)/A$", "")


# Annual report items and the section that each stands for.
ITEM_SECTIONS = {
    "ITEM 1": "BUSINESS DESCRIPTION", "ITEM 1A": "RISK FACTORS", "ITEM 1B": "UNRESOLVED STAFF COMMENTS", "ITEM 2": "PROPERTIES",
    "ITEM 3": "LEGAL PROCEEDINGS", "ITEM 4": "MINE SAFETY DISCLOSURES", "ITEM 5": "MARKET FOR COMMON EQUITY",
    "ITEM 6": "SELECTED FINANCIAL DATA", "ITEM 7": "MD&A", "ITEM 7A": "QUANTITATIVE AND QUALITATIVE DISCLOSURES ABOUT MARKET RISK",
    "ITEM 8": "FINANCIAL STATEMENTS", "ITEM 9": "CHANGES IN AND DISAGREEMENTS WITH ACCOUNTANTS", "ITEM 9A": "CONTROLS AND PROCEDURES",
    "ITEM 9B": "OTHER INFORMATION", "ITEM 10": "DIRECTORS AND CORPORATE GOVERNANCE", "ITEM 11": "EXECUTIVE COMPENSATION",
    "ITEM 12": "SECURITY OWNERSHIP", "ITEM 13": "CERTAIN RELATIONSHIPS", "ITEM 14": "PRINCIPAL ACCOUNTANT FEES", "ITEM 15": "EXHIBITS",
}


def canonical_section(section: Column, base: Column) -> Column:
    """The section that a label stands for in a form without its amendment mark; null where any section may be meant.

    Items of an annual report are mapped; items of other forms repeat between their parts, so they say nothing.
    """
    label = F.upper(F.trim(F.regexp_replace(section, r"\s+", " ")))
    label = F.when(label.isin("", "FULL DOCUMENT", "UNKNOWN"), None).otherwise(label)
    items = F.create_map(*[F.lit(x) for pair in ITEM_SECTIONS.items() for x in pair])
    annual = F.coalesce(F.upper(base) == "10-K", F.lit(False))
    return F.when(annual & F.array_contains(F.map_keys(items), label), F.try_element_at(items, label)).when(label.startswith("ITEM "), None).otherwise(label)


#: What identifies a filing's text between versions: keys that must agree, then period and section.
VERSION = ["_company", "_base", "_year"]


def version_keys(rows: DataFrame) -> DataFrame:
    """Rows with VERSION, _period and _section; all null for what no amendment can replace: other sources, unknown filings.

    rows: company, form, fiscal_year and, where there are any, period_label, section_name and source_type.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    base = F.nullif(F.trim(base_form(F.trim("form"))), F.lit(""))
    known = (F.coalesce(F.nullif(has("source_type"), F.lit("")), F.lit("sec")) == "sec") & (F.coalesce("company", F.lit("")) != "") & base.isNotNull() & F.col("fiscal_year").isNotNull()
    values = {
        "_company": F.upper("company"), "_base": base, "_year": F.col("fiscal_year").cast("int"),
        "_period": F.nullif(F.upper(F.trim(has("period_label"))), F.lit("")), "_section": canonical_section(has("section_name"), base),
    }
    return rows.withColumns({n: F.when(known, v) for n, v in values.items()})


def amended_keys(filings: DataFrame, chunks: DataFrame, filing: str, keys: list[str], section: str) -> DataFrame:
    """Keys of amendments with each distinct section they hold; an amendment without sections has one row with null.

    filings: filing id, keys, form; chunks: filing id, section.
    """
    sections = chunks.where(F.nullif(F.trim(section), F.lit("")).isNotNull()).select(filing, section).distinct()
    return filings.where(is_amendment(F.col("form"))).join(sections, filing, "left").select(*keys, section).distinct()


def not_superseded(rows: DataFrame, amended: DataFrame, equal: list[str], period: list[str], section: list[str], form: str = "form") -> DataFrame:
    """Drops rows that an amendment replaces; amendments themselves stay.

    equal keys must agree. An amendment without a period covers them all, a row without one only such amendments. A section
    agrees if either side has none: nothing shows that the row lies outside the amendment. The equal keys are the hash keys
    of an anti-join, the others its residual condition.
    """
    a = amended.select(*[F.col(c).alias(f"_a_{c}") for c in [*equal, *period, *section]]).distinct()
    cond = ~F.coalesce(is_amendment(F.col(form)), F.lit(False))
    for c in equal:
        cond = cond & (F.col(c) == F.col(f"_a_{c}"))
    for c in period:
        cond = cond & (F.col(f"_a_{c}").isNull() | (F.col(c) == F.col(f"_a_{c}")))
    for c in section:
        cond = cond & (F.col(c).isNull() | F.col(f"_a_{c}").isNull() | (F.col(c) == F.col(f"_a_{c}")))
    return rows.join(a, cond, "left_anti")


def current_versions(rows: DataFrame, amendments: DataFrame) -> DataFrame:
    """The rows that no amendment of amendments replaces; both with the columns that version_keys reads."""
    keys = version_keys(amendments.where(is_amendment(F.col("form"))))
    return not_superseded(version_keys(rows), keys, VERSION, ["_period"], ["_section"]).drop(*VERSION, "_period", "_section")


def first_child(parents: DataFrame, children: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Parents with their first child by order, if any."""
    one = children.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return parents.join(one, key, "left")


def context_window(chunks: DataFrame, anchors: DataFrame, group: str, index: str, width: int) -> DataFrame:
    """Chunks within width places of an anchor in the same group; anchors: group, anchor."""
    a = anchors.select(group, F.explode(F.sequence(F.greatest(F.col("anchor") - width, F.lit(0)), F.col("anchor") + width)).alias(index), "anchor")
    return chunks.join(a, [group, index])


def provenance(chunks: DataFrame, filings: DataFrame, ids: DataFrame, filing: str, chunk: str | list[str]) -> DataFrame:
    """The chunks of ids with the columns of their filing."""
    return chunks.join(ids, chunk, "left_semi").join(filings, filing)


def future_free(rows: DataFrame, as_of_year: int, year: str = "fiscal_year") -> DataFrame:
    """Drops rows of a later fiscal year; 0 and null say nothing."""
    return rows.where(F.coalesce(F.nullif(F.col(year), F.lit(0)), F.lit(as_of_year)) <= as_of_year)


def context_lookup(chunks: DataFrame, filings: DataFrame, anchors: DataFrame, filing: str, index: str, width: int, text: str) -> DataFrame:
    """Chunks around the anchors (filing, anchor) with their filing's columns, in the order of the document; what an amendment replaced is withheld.

    filings: filing, company, form, fiscal_year and, where there is one, period_label; chunks: filing, index, text and, where there
    is one, section_name. A withheld chunk has no text and a message that says why.
    """
    near = context_window(chunks, anchors, filing, index, width).join(filings, filing)
    amendments = filings.where(is_amendment(F.col("form"))).join(chunks.select(filing, *[c for c in ("section_name",) if c in chunks.columns]).distinct(), filing, "left")
    if "section_name" in chunks.columns:
        # an amendment's chunks without a section say nothing, unless it has no others
        named = F.max(F.col("section_name").isNotNull()).over(W.partitionBy(filing))
        amendments = amendments.withColumn("_named", named).where(F.col("section_name").isNotNull() | ~F.col("_named")).drop("_named")
    # what decides is the same for all chunks of a filing's section, so only these are asked
    asked = [c for c in ("company", "form", "fiscal_year", "period_label", "section_name", "source_type") if c in near.columns]
    kept = current_versions(near.select(*asked).distinct(), amendments).select(*[F.col(c).alias(f"_{n}") for n, c in enumerate(asked)], F.lit(True).alias("_kept"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{n}")) for n, c in enumerate(asked)])
    out = near.join(kept, same, "left").withColumn("withheld", F.col("_kept").isNull()).drop("_kept", *[f"_{n}" for n in range(len(asked))])
    what = F.concat_ws(" ", "company", "form", F.col("fiscal_year").cast("string"))
    message = F.when(F.col("withheld"), F.concat(F.lit("replaced by a later amendment of "), what))
    return out.withColumns({text: F.when(~F.col("withheld"), F.col(text)), "message": message})
