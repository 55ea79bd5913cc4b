"""Column functions on records: sectors, periods in titles, labels, manifest fields, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, none_like

# Sectors and the words that tell them, in the order in which they decide.
SECTOR_WORDS = (
    ("banking", ("bank", "banks", "capital markets", "credit", "financial services", "asset management", "insurance", "brokerage")),
    ("tech", ("technology", "software", "semiconductor", "internet", "communication equipment", "hardware", "electronics", "it services", "artificial intelligence")),
    ("healthcare", ("healthcare", "health care", "biotech", "biotechnology", "pharmaceutical", "pharma", "medical", "drug manufacturers", "diagnostics")),
    ("energy", ("energy", "oil", "gas", "petroleum", "midstream", "upstream", "downstream", "exploration", "refining", "drilling")),
    ("consumer", ("consumer", "retail", "restaurants", "apparel", "footwear", "household", "discount stores", "specialty retail", "home improvement", "packaged foods", "beverages")),
)
UNKNOWN_SECTOR = "unknown"


def sector(*texts: Column) -> Column:
    """The first sector one of whose words the texts hold; null if none."""
    t = F.concat_ws(" ", *texts)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in SECTOR_WORDS:
        out = out.when(contains_any(t, words), name)
    return out


def company_metadata(long_name: Column, short_name: Column, curated_name: Column, ticker: Column, classified: Column, curated_sector: Column) -> tuple[Column, Column]:
    """(name, sector), each the first that is not empty-like."""
    return F.coalesce(*map(none_like, (long_name, short_name, curated_name)), ticker), F.coalesce(*map(none_like, (classified, curated_sector)), F.lit(UNKNOWN_SECTOR))


def title_period(title: Column) -> tuple[Column, Column]:
    """(year, quarter) named in a transcript's title, null if absent."""
    return F.regexp_extract(title, r"\b(20[0-9]{2})\b", 1).try_cast("int"), F.regexp_extract(title, r"(?i)\bQ([1-4])\b", 1).try_cast("int")


# Verdict labels of other collections.
VERDICTS = {"supported": "verified", "true": "verified", "verified": "verified", "refuted": "refuted", "false": "refuted", "conflicting": "conflicting", "not enough evidence": "insufficient_evidence", "insufficient_evidence": "insufficient_evidence"}


def gold_verdict(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in VERDICTS.items():
        out = out.when(F.lower(F.trim(label)) == k, v)
    return out


# Forms in document labels.
DOC_FORMS = {"10k": "10-K", "10q": "10-Q", "8k": "8-K"}


def gold_document(doc_name: Column, doc_type: Column, doc_period: Column) -> tuple[Column, Column, Column]:
    """(form, fiscal year, quarter) of a gold document."""
    form = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in DOC_FORMS.items():
        form = form.when(F.lower(doc_type) == k, v)
    quarter = F.upper(F.nullif(F.regexp_extract(doc_name, r"(?i)(?<![0-9])20[0-9]{2}(Q[1-4])(?![0-9])", 1), F.lit("")))
    return form, doc_period.cast("int"), quarter


def provenance_ok(row: dict[str, Column], gold: dict[str, Column]) -> Column:
    """Whether a row comes from the gold document; what the gold leaves open passes."""
    out = F.lit(True)
    for k, g in gold.items():
        out = out & (g.isNull() | row[k].eqNullSafe(g))
    return out


ACCESSION, CIK = r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$", r"^[0-9]{1,10}$"


def manifest_field_errors(accession: Column, cik: Column, url: Column, host: str = "www.sec.gov") -> Column:
    """Names of the fields that do not fit."""
    bad_url = ~F.coalesce(F.try_parse_url(url, F.lit("HOST")) == host, F.lit(False)) | F.try_parse_url(url, F.lit("USERINFO")).isNotNull() | url.contains("..")
    return F.array_compact(F.array(F.when(~F.coalesce(accession.rlike(ACCESSION), F.lit(False)), "accession"), F.when(~F.coalesce(cik.rlike(CIK), F.lit(False)), "cik"), F.when(F.coalesce(bad_url, F.lit(True)), "source_url")))


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def final_number(answer: Column) -> Column:
    """The number after the last ####, else the last number."""
    marked = F.regexp_extract(answer, r"(?s).*####\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(answer, F.lit(r"-?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))), -1)
    return F.replace(F.coalesce(F.nullif(marked, F.lit("")), last), F.lit(","), F.lit("")).try_cast("double")


def final_scope(answer: Column, direct: int = 280) -> Column:
    """Where the answer stands: all of a short text, else after the last marker, else the last paragraph."""
    marked = F.trim(F.regexp_extract(answer, r"(?is).*\b(?:final answer|answer)\s*:\s*(.+)$", 1))
    paragraphs = F.filter(F.split(answer, r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.when(marked != "", marked).when(F.length(answer) <= direct, answer).otherwise(F.trim(F.coalesce(F.get(F.reverse(paragraphs), F.lit(0)), F.lit(""))))
