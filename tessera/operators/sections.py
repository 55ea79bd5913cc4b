"""Sections of filings from their text: headings as candidates among the lines, one ordered pass of windows over them.

A text is exploded into lines with their offsets. Lines that look like headings of items, of parts or of their own are
candidates; what is around a line (blank lines, the part in effect, the heading before) comes from windows over the lines of
one text. Whether a text is cut at its items or at general headings is decided per text from where its items stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.chunking import qa_pairs, speaker_turns, transcript_sections
from tessera.operators.pages import contents, squeezed

# What the items of each form are called, by part where a form counts them twice.
ITEMS_10K = {
    "item 1": "Business Description", "item 1a": "Risk Factors", "item 1b": "Unresolved Staff Comments", "item 2": "Properties",
    "item 3": "Legal Proceedings", "item 4": "Mine Safety Disclosures", "item 5": "Market for Common Equity", "item 6": "Selected Financial Data",
    "item 7": "MD&A", "item 7a": "Quantitative and Qualitative Disclosures about Market Risk", "item 8": "Financial Statements",
    "item 9": "Changes in and Disagreements with Accountants", "item 9a": "Controls and Procedures", "item 9b": "Other Information",
    "item 10": "Directors and Corporate Governance", "item 11": "Executive Compensation", "item 12": "Security Ownership",
    "item 13": "Certain Relationships", "item 14": "Principal Accountant Fees", "item 15": "Exhibits",
}
ITEMS_10Q_I = {
    "item 1": "Financial Statements", "item 2": "MD&A", "item 3": "Quantitative and Qualitative Disclosures about Market Risk", "item 4": "Controls and Procedures",
}
ITEMS_10Q_II = {
    "item 1": "Legal Proceedings", "item 1a": "Risk Factors", "item 2": "Unregistered Sales of Equity Securities", "item 3": "Defaults upon Senior Securities",
    "item 4": "Mine Safety Disclosures", "item 5": "Other Information", "item 6": "Exhibits",
}
ITEMS_8K = {
    "item 1.01": "Entry into a Material Definitive Agreement", "item 1.02": "Termination of a Material Definitive Agreement",
    "item 2.01": "Completion of Acquisition or Disposition", "item 2.02": "Results of Operations and Financial Condition",
    "item 2.03": "Creation of a Direct Financial Obligation", "item 4.01": "Changes in Registrant's Certifying Accountant",
    "item 5.02": "Departure of Directors or Officers", "item 7.01": "Regulation FD Disclosure", "item 8.01": "Other Events",
    "item 9.01": "Financial Statements and Exhibits",
}
# Headings of older filings that stand for sections, and lines that only look like headings.
_DISCUSSION = "management's discussion and analysis of financial condition and results of operations"
_RISK = "quantitative and qualitative disclosures about market risk"
ALIASES = {
    "10-K": {
        "business": "Business Description", _DISCUSSION: "MD&A", "financial statements and supplementary data": "Financial Statements",
        "consolidated statements of operations": "Financial Statements", "consolidated balance sheets": "Financial Statements",
        "notes to consolidated financial statements": "Financial Statements", _RISK: "Quantitative and Qualitative Disclosures about Market Risk",
        "changes in and disagreements with accountants on accounting and financial disclosure": "Changes in and Disagreements with Accountants",
    },
    "10-Q": {_DISCUSSION: "MD&A", "financial statements": "Financial Statements", _RISK: "Quantitative and Qualitative Disclosures about Market Risk"},
}
NOT_HEADINGS = [
    "form 10-k cross-reference index", "annual report on form 10-k", "citigroup’s 2018 annual report on form 10-k", "for the year ended december 31, 2018",
    "table continues on the next page, including footnotes.", "nm not meaningful", "n/a not applicable",
]
ITEM_LINE = r"(?i)^\s*(ITEM\s+\d+[AB]?(?:\.\d+)?)(?:[\s.\-–—:]+(.{0,80}))?\s*$"
PART_LINE = r"^\s*(?i:PART)\s+((?i:IV|III|II|I))\b(?:[\s.\-–—:]+[A-Z][^\n]{0,60}?)?\s*$"
COVER = [r"(?i)UNITED STATES\s+SECURITIES AND EXCHANGE COMMISSION", r"(?i)Washington,\s*D\.C\.\s*20549", r"(?i)FORM\s+10-[KQ]\s*\n"]
SIGNATURES = [r"(?i)SIGNATURES?\s*\n", r"(?is)Pursuant to the requirements of.*Securities Exchange Act"]
EXHIBITS = [r"(?i)EXHIBIT\s+INDEX\s*\n", r"(?i)List of Exhibits\s*\n"]
PHRASES = [r"(?i)Table of Contents", r"(?im)^\s*Page\s*$", r"(?m)^\s*F-\d+\s*$"]
#: Characters of a section at least; of an appendix that is no use to a search, at most.
LEAST, APPENDIX = 200, 100_000


def _share(n: Column, share: float) -> Column:
    return F.floor(n * share).cast("int")


def body(text: Column) -> Column:
    """A filing's text without its cover, signatures, index of exhibits and page marks.

    The cover ends at the first item after it, if that is near the front; the end is cut in the second half only.
    """
    n = F.length(text)
    front = F.least(F.lit(50_000), F.greatest(F.lit(8_000), _share(n, 0.2)))

    def after(pattern: str) -> Column:
        end = F.regexp_instr(text, F.lit(pattern)) + F.length(F.regexp_extract(text, pattern, 0)) - 1
        item = F.regexp_instr(F.substring(text, end + 1, n), F.lit(r"(?im)^\s*ITEM\s+\d+[AB]?(?:\.\d+)?[\s.\-–—:]+.{0,80}$"))
        at = end + item
        return F.when((F.regexp_instr(text, F.lit(pattern)) > 0) & (item > 0) & (at - 1 <= front), at)

    out = F.substring(text, F.coalesce(*[after(p) for p in COVER], F.lit(1)), n)

    def cut(whole: Column, patterns: list[str]) -> Column:
        def at_first(t: Column) -> Column:
            late = F.greatest(F.lit(5_000), _share(F.length(t), 0.5))
            at = [F.regexp_instr(t, F.lit(p)) - 1 for p in patterns]
            return F.substring(t, F.lit(1), F.coalesce(*[F.when(a > late, a) for a in at], F.length(t)))

        return F.regexp_replace(F.element_at(F.transform(F.array(whole), at_first), 1), r"\s+$", "")

    for patterns in (SIGNATURES, EXHIBITS):
        out = cut(out, patterns)
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), PHRASES, out)


def section_name(item: Column, form: Column, part: Column) -> Column:
    """What an item (any case) is called in a form; a quarterly report's items depend on the part in effect (I, II, else none)."""
    label = F.lower(squeezed(item))
    named = lambda names: F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), label)
    merged = named(ITEMS_10Q_II | ITEMS_10Q_I)
    own = (
        F.when(form == "10-K", named(ITEMS_10K)).when(form == "8-K", named(ITEMS_8K))
        .when(form == "10-Q", F.coalesce(F.when(part == "I", named(ITEMS_10Q_I)).when(part == "II", named(ITEMS_10Q_II)), merged))
    )
    return F.coalesce(own, F.concat(F.lit("Item "), F.upper(F.substring(label, F.lit(6), F.length(label)))))


def heading_name(heading: Column, form: Column) -> Column:
    """The section that a general heading stands for in a form, or the heading."""
    plain = F.replace(F.lower(squeezed(heading)), F.lit("’"), F.lit("'"))
    named = [F.when(form == f, F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), plain)) for f, names in ALIASES.items()]
    return F.coalesce(*named, F.trim(heading))


def lines(texts: DataFrame, key: str, text: str = "text", form: str = "form", least: int = LEAST) -> DataFrame:
    """(key, form, n, line, size, heading, name, title) of each line: whether it is a heading where its text is cut, the
    section it begins and whether the line is only a heading's title."""
    df = texts.select(key, F.upper(F.col(form)).alias("form"), F.length(text).alias("size"), F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    w, whole = W.partitionBy(key).orderBy("n"), W.partitionBy(key)
    past, to_here = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    filled = F.when(squeezed(F.col("line")) != "", F.trim("line"))
    df = df.withColumns({
        "offset": F.coalesce(F.sum(F.length("line") + 1).over(past), F.lit(0)), "before": F.last(filled, ignorenulls=True).over(past),
        "next": F.last(filled, ignorenulls=True).over(W.partitionBy(key).orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)),
        "blank_before": F.coalesce(F.max((squeezed(F.col("line")) == "").cast("int")).over(w.rowsBetween(-4, -1)), F.lit(0)) == 1,
        "blank_after": F.coalesce(F.max((squeezed(F.col("line")) == "").cast("int")).over(w.rowsBetween(1, 4)), F.lit(0)) == 1,
        "part": F.last(F.nullif(F.upper(F.regexp_extract("line", PART_LINE, 1)), F.lit("")), ignorenulls=True).over(to_here),
        "item": F.nullif(F.regexp_extract("line", ITEM_LINE, 1), F.lit("")),
    })
    heading = squeezed(F.col("line"))
    words = F.split(heading, " ")
    letters = lambda x: F.regexp_replace(x, "[^A-Za-z]", "")
    capital = F.size(F.filter(words, lambda x: letters(x).rlike("^[A-Z]")))
    plain = F.lower(heading)
    known = heading_name(heading, F.col("form")) != heading
    alone = ((F.col("n") == 0) | F.col("blank_before") | F.col("before").startswith("[/TABLE]")) & (F.col("blank_after") | F.col("next").startswith("[TABLE]"))
    styled = ~heading.rlike(r"\p{Ll}") | (capital >= F.greatest(F.lit(1), F.floor(F.size(words) * 0.6)))
    general = (
        (heading != "") & ~((F.col("size") > 20_000) & (F.col("offset") < F.greatest(F.lit(5_000), F.floor(F.col("size") / 100)))) & ~heading.startswith("[")
        & ~plain.isin(NOT_HEADINGS) & ~plain.startswith("part ") & F.length(heading).between(3, 100) & ~heading.endswith(".")
        & (F.length(F.regexp_replace(heading, r"\P{L}", "")) >= 3) & (F.size(words) <= 14) & (known | F.coalesce(alone & styled, F.lit(False)))
        & ~F.coalesce(F.lower(squeezed(F.col("before"))) == plain, F.lit(False))
    )
    first, found = F.min(F.when(F.col("item").isNotNull(), F.col("offset"))).over(whole), F.count("item").over(whole)
    late = F.least(F.lit(50_000), F.greatest(F.lit(12_000), _share(F.col("size"), 0.2)))
    single = F.greatest(F.lit(8_000), _share(F.col("size"), 0.05))
    by_items = F.coalesce((found > 0) & (first <= late) & ~((found == 1) & (first > single)), F.lit(False))
    df = df.withColumns({"general": general, "by_items": by_items})
    df = df.withColumn("heading", F.when(F.col("by_items"), F.col("item").isNotNull()).otherwise(F.col("general")))
    name = F.when(F.col("by_items"), section_name(F.col("item"), F.col("form"), F.col("part"))).otherwise(heading_name(F.col("line"), F.col("form")))
    # the title of an item whose label stands alone on its line
    bare = F.when(squeezed(F.col("line")) != "", F.col("by_items") & (F.coalesce(F.regexp_extract("line", ITEM_LINE, 2), F.lit("")) == "") & F.col("item").isNotNull())
    title = F.coalesce(F.last(bare, ignorenulls=True).over(past), F.lit(False)) & (F.length("line") <= 80) & F.col("item").isNull() & (heading != "")
    return df.withColumns({"name": F.when(F.col("heading"), name), "title": title}).select(key, "form", "n", "line", "size", "heading", "name", "title")


def sections(texts: DataFrame, key: str, text: str = "text", form: str = "form", least: int = LEAST) -> DataFrame:
    """(key, idx, section, text): a filing's text cut at its headings, short sections and appendices left out; without any, the whole.

    texts: key, text, form ('10-K', '10-Q', '8-K' or another).
    """
    found = lines(texts, key, text, form, least)
    number = F.sum(F.col("heading").cast("int")).over(W.partitionBy(key).orderBy("n"))
    line = F.struct("n", "line")
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n")
    parts = found.withColumn("number", number).groupBy(key, "number").agg(
        F.first("name", ignorenulls=True).alias("section"), _stripped(told(F.when(~F.col("heading") & ~F.col("title"), line))).alias("text"), told(line).alias("own"),
    )
    good = (F.col("number") > 0) & (F.length("text") >= least)
    appendix = (F.col("section") == "Exhibits") | (F.lower("section").isin("item 16", "item 6") & (F.length("text") > APPENDIX))
    parts = parts.withColumns({"good": good, "kept": good & ~appendix})
    # the parts of a text in one row, as whether it stays whole depends on all of them
    texts = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "section", "text", "kept", "own"))).alias("parts"), F.bool_or("good").alias("cut"))
    kept = F.transform(F.filter("parts", lambda p: p["kept"]), lambda p: F.struct(p["section"].alias("section"), p["text"].alias("text")))
    texts = texts.select(key, "cut", kept.alias("kept"), _stripped(F.array_join(F.transform("parts", lambda p: p["own"]), "\n")).alias("whole"))
    whole = F.array(F.struct(F.lit("Full Document").alias("section"), F.col("whole").alias("text")))
    out = F.when(F.size("kept") > 0, F.col("kept")).when(F.length("whole") >= F.when(F.col("cut"), least).otherwise(1), whole)
    return texts.select(key, F.posexplode_outer(out).alias("idx", "x")).where("x IS NOT NULL").select(key, "idx", "x.section", "x.text")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


_TABLE = r"\[TABLE\][\s\S]*?\[/TABLE\]"


def segments(parts: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """(key, idx, section, kind, title, text, table_index, header_text, row_count) of sections (key, idx, section, text): tables and the narrative between them."""
    told, tables = F.split("text", _TABLE, -1), F.regexp_extract_all("text", F.lit(f"({_TABLE})"))
    both = F.arrays_zip(told.alias("told"), tables.alias("table"))
    rows = parts.select(key, "idx", "section", F.col("text").alias("whole"), F.posexplode_outer(both).alias("n", "x"))
    pieces = F.explode(F.array(F.struct((2 * F.col("n")).alias("at"), F.lit("narrative").alias("kind"), _stripped(F.col("x.told")).alias("text")), F.struct((2 * F.col("n") + 1).alias("at"), F.lit("table").alias("kind"), F.col("x.table").alias("text"))))
    rows = rows.select(key, "idx", "section", "whole", "n", pieces.alias("p")).select(key, "idx", "section", "whole", "n", "p.*").where("text IS NOT NULL")
    held = F.col("text").rlike(r"(?m)^\[(?:ROW|HEADER)\]")
    rows = rows.withColumn("good", F.when(F.col("kind") == "table", held).otherwise(F.length("text") >= least))
    some = F.max("good").over(W.partitionBy(key, "idx"))
    rows = rows.withColumn("some", some).where(F.col("good") | (~F.col("some") & (F.col("at") == 0) & (F.length("whole") >= least)))
    text = F.when(F.col("some"), F.col("text")).otherwise(F.col("whole"))
    table = F.col("kind") == "table"
    return rows.select(
        key, (F.row_number().over(W.partitionBy(key).orderBy("idx", "at")) - 1).alias("idx"), "section", "kind",
        F.when(table, F.nullif(F.trim(F.regexp_extract("text", r"^\[TABLE\]([^\n]*)", 1)), F.lit(""))).otherwise(F.col("section")).alias("title"), text.alias("text"),
        F.when(table, F.col("n") + 1).alias("table_index"), F.when(table, F.nullif(F.regexp_extract("text", r"(?m)^\[HEADER\] ([^\n]*)", 1), F.lit(""))).alias("header_text"),
        F.when(table, F.regexp_count("text", F.lit(r"(?m)^\[ROW\]"))).alias("row_count"),
    )


def cleaned(pages: DataFrame, key: str, html: str = "html", form: str = "form", profile: str = "candidate") -> DataFrame:
    """(key, form, text) of filings as HTML: blocks and tables in order, then without cover, signatures and indexes."""
    rows = contents(pages, key, html, profile)
    line = F.concat(F.repeat(F.lit("\n"), F.when(F.col("idx") > 0, F.col("gap")).otherwise(0)), F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "")
    told = rows.groupBy(key).agg(text.alias("text"))
    return told.join(pages.select(key, F.col(form).alias("form")), key).select(key, "form", body(F.col("text")).alias("text"))


def filing_segments(pages: DataFrame, key: str, html: str = "html", form: str = "form", least: int = LEAST, profile: str = "candidate") -> DataFrame:
    """Segments of filings from their HTML: the whole cleaner."""
    return segments(sections(cleaned(pages, key, html, form, profile), key, least=least), key, least)


def news_segments(articles: DataFrame, key: str) -> DataFrame:
    """(key, idx, section, kind, title, text) of articles (key, title, summary, content): summary and content as one narrative, or, where
    they hold tables, as a page's segments; an article without either has none. The article's title, where it has one, is that of all."""
    filled = lambda c: F.nullif(_stripped(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = articles.select(key, filled("title").alias("title"), F.concat_ws("\n\n", filled("summary"), filled("content")).alias("body")).where("body <> ''")
    has_table = F.lower("body").contains("<table")
    plain = rows.where(~has_table).select(
        key, F.lit(0).alias("idx"), F.lit("news_article").alias("section"), F.lit("narrative").alias("kind"), F.coalesce("title", F.lit("News Article")).alias("title"), F.col("body").alias("text")
    )
    pages = rows.where(has_table).select(key, F.col("body").alias("html"), F.lit("10-K").alias("form"))
    rich = filing_segments(pages, key, least=1).withColumnRenamed("title", "_title").join(rows.select(key, "title"), key)
    return plain.unionByName(rich.select(key, "idx", "section", "kind", F.coalesce("title", "_title").alias("title"), "text"))


# Fixed value: a paragraph that begins a speaker's turn.
SPEAKER = r"^([A-Z][A-Za-z0-9 .,&'/-]{1,80}):\s*(.+)$"


def transcript_segments(calls: DataFrame, key: str) -> DataFrame:
    """(key, idx, section, kind, title, text) of calls (key, ticker, fiscal_year, quarter, text): a narrative for each turn of the prepared
    remarks and of the closing, and questions with their answers."""
    parts = transcript_sections(calls, key, F.col("text"))
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("section"), F.col(c).alias("said")) for i, (n, c) in enumerate((("prepared_remarks", "prepared"), ("qa", "qa"), ("closing", "closing")))]))
    rows = parts.select(key, named.alias("x")).select(key, "x.*")
    paragraphs = rows.select(F.struct(key, "at", "section").alias("place"), F.posexplode(F.split("said", r"\n\s*\n")).alias("n", "raw")).withColumn("raw", _stripped(F.col("raw"))).where("raw <> ''")
    speaker = F.nullif(F.trim(F.regexp_extract("raw", SPEAKER, 1)), F.lit(""))
    turns = speaker_turns(paragraphs, "place", "n", speaker, F.when(speaker.isNotNull(), F.trim(F.regexp_extract("raw", SPEAKER, 2))).otherwise(F.col("raw")))
    told = F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    single = turns.where("place.section <> 'qa'").select("place", F.col("turn").alias("n"), F.lit("narrative").alias("kind"), told.alias("text"))
    pairs = qa_pairs(turns.where("place.section = 'qa'"), "place").select("place", F.col("pair").alias("n"), F.lit("qa").alias("kind"), "text")
    both = single.unionByName(pairs).select(f"place.{key}", "place.at", "place.section", "n", "kind", "text").join(calls.select(key, "ticker", "fiscal_year", "quarter"), key)
    label = F.when(F.col("section") == "qa", "Q&A").otherwise(F.initcap(F.replace("section", F.lit("_"), F.lit(" "))))
    title = F.concat_ws(" ", F.col("ticker"), F.concat(F.lit("Q"), F.col("quarter").cast("string")), F.col("fiscal_year").cast("string"), label)
    return both.select(key, (F.row_number().over(W.partitionBy(key).orderBy("at", "n")) - 1).alias("idx"), "section", "kind", title.alias("title"), "text")
