"""Pages as rows: blocks, tables and their titles under both profiles, sections of filings, links. All cases of a kind run in one job."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.operators import sections as S

BIG = 2**60 + 1


def told(spark, cases, profile="candidate"):
    """[(kind, text)] of each case's page."""
    df = spark.createDataFrame([(BIG + i, h) for i, h in enumerate(cases.values())], "k long, html string")
    got = {name: [] for name in cases}
    for r in P.contents(df, "k", profile=profile).orderBy("k", "idx").collect():
        got[list(cases)[r.k - BIG]].append((r.kind, r.text))
    return got


def table(*rows, title=None, th=False):
    cell = "th" if th else "td"
    cap = f"<caption>{title}</caption>" if title else ""
    return f"<table>{cap}" + "".join("<tr>" + "".join(f"<{cell if i == 0 else 'td'}>{c}</{cell if i == 0 else 'td'}>" for c in r) + "</tr>" for i, r in enumerate(rows)) + "</table>"


FIGURES = [("Sales", "120", "110"), ("Costs", "80", "75")]
CASES = {
    "plain": "<html><head><title>T</title><style>p{}</style></head><body>One<p>two <b>bo</b>ld<p>three<br>four<script>var x='<p>no</p>'</script></body></html>",
    "references": "<p>a &lt; b &amp;amp; c&nbsp;d &#65;&#x42; &#xD800; &unknown; &copy;</p>",
    "comment": "<p>a<!-- <p>no</p> -->b</p><!-- open",
    "broken": "</div></table><p>a<div>b</td></table>c",
    "empty": "",
    "caption": table(("Item", "2023"), *FIGURES[:1], title="Income", th=True),
    "attribute": f"<table summary=' By  region '>{table(*FIGURES)[7:]}",
    "bare attribute": f"<table border=1 aria-label=Regions>{table(*FIGURES)[7:]}",
    "number": "<p>x</p>" + "<div></div>" + table(*FIGURES) + table(*FIGURES),
    "block before": "<p>Debt by year</p>" + table(*FIGURES),
    "long block before": f"<p>{'word ' * 60}</p>" + table(*FIGURES),
    "statement in a cell": table(("Consolidated Statements of Income", "2023", "2022"), *FIGURES),
    "statement in a table before": table(("Acme Corp. Consolidated Statements of Income",)) + table(("Year Ended May 31,",), ("(In millions, except per share data)", "2023", "2022"), *FIGURES),
    "statement behind a wrapper": "<body><div><div><p>ACME, INC.</p><p>Consolidated Balance Sheets</p></div><div>" + table(("2023", "2022"), *FIGURES) + "</div></div></body>",
    "statement too far up": "<body><p>Consolidated Balance Sheets</p><div><div><div><div>" + table(*FIGURES) + "</div></div></div></div></body>",
    "narrative between": "<p>Consolidated Balance Sheets</p><p>These notes explain how the figures of the year were made and what they do not show.</p>" + table(*FIGURES),
    "sentence about statements": "<p>We have audited the consolidated balance sheets of the company and found no fault.</p>" + table(*FIGURES),
    "contents before": table(("Consolidated Balance Sheets", "12"), ("Notes", "14")) + table(*FIGURES),
    "remark": "<p>Condensed Consolidated Statements of Cash Flows (unaudited)</p>" + table(("Six months ended June 30,", "2023", "2022"), *FIGURES),
    "amounts like years": table(("Rent", "2,023", "2,011"), ("2019", "5", "4"), title="Leases"),
    "date with figures": table(("As of May 31", "500", "480"), *FIGURES, title="Cash"),
    "two years": table(("2023", "2022"), *FIGURES, title="Assets"),
    "item row": table(("Item 7.", "Management’s Discussion")) + "<p>text</p>",
    "nested": "<table><tr><td>a</td><td><table><tr><td>b</td></tr></table></td></tr><tr><td>1</td></tr></table>",
    "no cells": "<table><tr></tr></table><p>x</p>",
}


def test_contents(spark):
    got = told(spark, CASES)
    row = "[ROW] Sales | 120 | 110\n[ROW] Costs | 80 | 75\n[/TABLE]"
    want = {
        "plain": [("text", "One"), ("text", "two bold"), ("text", "three"), ("text", "four")],
        "references": [("text", "a < b &amp; c d AB &#xD800; &unknown; ©")],
        "comment": [("text", "ab")],
        "broken": [("text", "a"), ("text", "b"), ("text", "c")],
        "empty": [],
        "caption": [("table", "[TABLE] Income\n[HEADER] Item | 2023\n[ROW] Sales | 120 | 110\n[/TABLE]")],
        "attribute": [("table", f"[TABLE] By region\n{row}")],
        "bare attribute": [("table", f"[TABLE] Regions\n{row}")],
        "number": [("text", "x"), ("table", f"[TABLE] x\n{row}"), ("table", f"[TABLE] Table 2\n{row}")],
        "block before": [("text", "Debt by year"), ("table", f"[TABLE] Debt by year\n{row}")],
        "long block before": [("text", ("word " * 60).strip()), ("table", f"[TABLE] Table 1\n{row}")],
        "statement in a cell": [("table", f"[TABLE] Consolidated Statements of Income\n[HEADER] 2023 | 2022\n{row}")],
        # a table that is only a title is told as the title of the next
        "statement in a table before": [
            ("table", f"[TABLE] Acme Corp. Consolidated Statements of Income\n[HEADER] Year Ended May 31, | (In millions, except per share data) | 2023 | 2022\n{row}"),
        ],
        "statement behind a wrapper": [("text", "ACME, INC."), ("text", "Consolidated Balance Sheets"), ("table", f"[TABLE] ACME, INC. Consolidated Balance Sheets\n[HEADER] 2023 | 2022\n{row}")],
        "statement too far up": [("text", "Consolidated Balance Sheets"), ("table", f"[TABLE] Table 1\n{row}")],
        "narrative between": [("text", "Consolidated Balance Sheets"), ("text", "These notes explain how the figures of the year were made and what they do not show."), ("table", f"[TABLE] These notes explain how the figures of the year were made and what they do not show.\n{row}")],
        "sentence about statements": [("text", "We have audited the consolidated balance sheets of the company and found no fault."), ("table", f"[TABLE] Table 1\n{row}")],
        "contents before": [("table", "[TABLE] Consolidated Balance Sheets\n[ROW] 12\n[ROW] Notes | 14\n[/TABLE]"), ("table", f"[TABLE] Table 2\n{row}")],
        "remark": [("text", "Condensed Consolidated Statements of Cash Flows (unaudited)"), ("table", f"[TABLE] Condensed Consolidated Statements of Cash Flows (unaudited)\n[HEADER] Six months ended June 30, | 2023 | 2022\n{row}")],
        "amounts like years": [("table", "[TABLE] Leases\n[ROW] Rent | 2,023 | 2,011\n[ROW] 2019 | 5 | 4\n[/TABLE]")],
        "date with figures": [("table", f"[TABLE] Cash\n[ROW] As of May 31 | 500 | 480\n{row}")],
        "two years": [("table", f"[TABLE] Assets\n[HEADER] 2023 | 2022\n{row}")],
        "item row": [("text", "Item 7. Management’s Discussion"), ("text", "text")],
        "nested": [("table", "[TABLE] Table 1\n[ROW] a\n[ROW] b\n[ROW] 1\n[/TABLE]")],
        "no cells": [("text", "x")],
    }
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == want[name], name


def test_baseline_profile_keeps_rows_as_they_are(spark):
    got = told(spark, {k: CASES[k] for k in ("statement in a cell", "two years", "caption", "remark")}, "baseline")
    row = "[ROW] Sales | 120 | 110\n[ROW] Costs | 80 | 75\n[/TABLE]"
    assert got["statement in a cell"] == [("table", f"[TABLE] Table 1\n[ROW] Consolidated Statements of Income | 2023 | 2022\n{row}")]
    assert got["two years"] == [("table", f"[TABLE] Assets\n[ROW] 2023 | 2022\n{row}")]
    assert got["caption"] == [("table", "[TABLE] Income\n[HEADER] Item | 2023\n[ROW] Sales | 120 | 110\n[/TABLE]")]
    with pytest.raises(ValueError, match="unknown representation profile"):
        P.contents(spark.createDataFrame([], "k long, html string"), "k", profile="other")


LONG = "This is what the section says, at some length, so that it is kept. " * 5


def cut(spark, cases):
    """[(section, text)] of each case (text, form)."""
    df = spark.createDataFrame([(BIG + i, t, f) for i, (t, f) in enumerate(cases.values())], "k long, text string, form string")
    got = {name: [] for name in cases}
    for r in S.sections(df, "k").orderBy("k", "idx").collect():
        got[list(cases)[r.k - BIG]].append((r.section, r.text))
    return got


def test_sections(spark):
    long = LONG.strip()
    early = "line\n" * 30
    late = "word " * 6000
    got = cut(spark, {
        "items": (f"cover\nITEM 1. Business\n{LONG}\nItem 1A — Risk Factors\n{LONG}\nItem 2. Properties\nshort\nItem 12. Owners\n{LONG}", "10-K"),
        "label alone": (f"Item 7\n\nManagement's Discussion\n{LONG}", "10-K"),
        "parts": (f"PART I. FINANCIAL INFORMATION\nItem 3. Market Risk\n{LONG}\nItem 4. Controls\n{LONG}\nas part ii of this says\nPart II\nItem 3. Defaults\n{LONG}\nItem 4. Mines\n{LONG}\nItem 5. Other\n{LONG}", "10-Q"),
        "no part": (f"Item 1. Statements\n{LONG}\nItem 1A. Risks\n{LONG}\nItem 3. Market\n{LONG}", "10-Q"),
        "part without the item": (f"PART I\nItem 5. Other\n{LONG}\nItem 9. None\n{LONG}", "10-Q"),
        "current report": (f"Item 2.02. Results\n{LONG}\nItem 3.03. Rights\n{LONG}", "8-K"),
        "exhibits go": (f"Item 1. Business\n{LONG}\nItem 15. Exhibits\n{LONG}", "10-K"),
        "only exhibits": (f"Item 15. Exhibits\n{LONG}", "10-K"),
        "late item": (f"{late}\nItem 1. Business\n{LONG}", "10-K"),
        "one item not near the front": (f"{'word ' * 1800}\nItem 1. Business\n{LONG}", "10-K"),
        "headings": (f"{early}\n\nLiquidity and Capital\n\n{LONG}\n\nBusiness\n\n{LONG}\n\nnot a heading of this text.\n\n{LONG}", "10-K"),
        "aliases": (f"\nManagement’s  Discussion and Analysis of Financial Condition and Results of Operations\n{LONG}\n\nOur People And Places\n\n{LONG}", "10-Q"),
        "twice": (f"\nOur People\n\nOur People\n\n{LONG}", "10-K"),
        "nothing": ("a few words", "10-K"),
        "blank": (" \n ", "10-K"),
        "null": (None, "10-K"),
    })
    assert got["items"] == [("Business Description", long), ("Risk Factors", long), ("Security Ownership", long)]
    assert got["label alone"] == [("MD&A", long)]
    assert [n for n, _ in got["parts"]] == ["Quantitative and Qualitative Disclosures about Market Risk", "Controls and Procedures", "Defaults upon Senior Securities", "Mine Safety Disclosures", "Other Information"]
    assert [n for n, _ in got["no part"]] == ["Financial Statements", "Risk Factors", "Quantitative and Qualitative Disclosures about Market Risk"]
    assert [n for n, _ in got["part without the item"]] == ["Other Information", "Item 9"]
    assert [n for n, _ in got["current report"]] == ["Results of Operations and Financial Condition", "Item 3.03"]
    assert [n for n, _ in got["exhibits go"]] == ["Business Description"]
    assert [n for n, _ in got["only exhibits"]] == ["Full Document"]
    assert [n for n, _ in got["late item"]] == ["Full Document"]
    assert [n for n, _ in got["one item not near the front"]] == ["Full Document"]
    assert [n for n, _ in got["headings"]] == ["Liquidity and Capital", "Business Description"]
    assert [n for n, _ in got["aliases"]] == ["MD&A", "Our People And Places"]
    assert got["twice"] == [("Our People", f"Our People\n\n{long}")]
    assert got["nothing"] == [("Full Document", "a few words")]
    assert got["blank"] == got["null"] == []


def test_body_of_a_filing(spark):
    front = "UNITED STATES\nSECURITIES AND EXCHANGE COMMISSION\ncover words\n"
    back = "\nSIGNATURES\nnames"
    texts = {
        "cover": f"{front}Item 1. Business\n{LONG}", "late exhibit item only": f"{front}{'word ' * 4000}\nItem 15. Exhibits\nlist",
        "signatures": f"{'word ' * 3000}{back}", "early signatures": f"words{back}", "index": f"{'word ' * 3000}\nEXHIBIT INDEX\n1 2 3", "marks": "a Table of Contents b\n  Page \nF-12\nc",
    }
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "k string, t string")
    got = {r.k: r.b for r in df.select("k", S.body(F.col("t")).alias("b")).collect()}
    assert got["cover"].startswith("Item 1. Business")
    assert got["late exhibit item only"] == texts["late exhibit item only"]
    assert got["signatures"] == ("word " * 3000).rstrip() and got["index"] == ("word " * 3000).rstrip()
    assert got["early signatures"] == texts["early signatures"]
    assert got["marks"].split() == ["a", "b", "c"]


def test_filing_to_segments(spark):
    html = f"""<html><body><p>Item 7. Discussion</p><p>{LONG}</p><p>Results by year</p>{table(("", "2023"), *[(a, b) for a, b, _ in FIGURES], th=True)}
      <p>short</p><p>Item 8. Statements</p><p>{LONG}</p><ix:header><p>hidden</p></ix:header><p>{LONG}</p></body></html>"""
    got = S.filing_segments(spark.createDataFrame([(BIG, html, "10-K")], "k long, html string, form string"), "k").orderBy("idx").collect()
    long = LONG.strip()
    assert [(r.k, r.idx, r.section, r.kind, r.title) for r in got] == [(BIG, 0, "MD&A", "narrative", "MD&A"), (BIG, 1, "MD&A", "table", "Results by year"), (BIG, 2, "Financial Statements", "narrative", "Financial Statements")]
    assert got[0].text == f"{long}\nResults by year" and got[2].text == f"{long}\n{long}"
    assert (got[1].table_index, got[1].header_text, got[1].row_count) == (1, "2023", 2)


def test_links_are_resolved(spark):
    base = "https://www.example.com/a/b/page.html?q=1#top"
    want = {
        "c.html": "https://www.example.com/a/b/c.html", "../c": "https://www.example.com/a/c", "../../../c": "https://www.example.com/c", "./": "https://www.example.com/a/b/",
        "/x?y=2": "https://www.example.com/x?y=2", "//other.example/x": "https://other.example/x", "http://o.example/": "http://o.example/", "?r=3": "https://www.example.com/a/b/page.html?r=3",
        "#s": "https://www.example.com/a/b/page.html?q=1#s", "mailto:a@example.com": "mailto:a@example.com",
    }
    for link, out in want.items():
        from urllib.parse import urljoin

        assert urljoin(base, link) == out
    quotes = ['"{}"', "'{}'", "{}"]
    html = "".join(f"<A class=x\n HREF = {quotes[i % 3].format(k)} id=y>t</a>" for i, k in enumerate(want)) + "<a name=n>no</a><a href='c.html'>again</a><abbr href='no'>"
    df = spark.createDataFrame([(1, base, html), (2, "https://www.example.com", "<a href=x>"), (3, None, None)], "k int, url string, html string")
    got = P.links(df, "k").collect()
    assert sorted(r.link for r in got if r.k == 1) == sorted(want.values())
    assert [r.link for r in got if r.k == 2] == ["https://www.example.com/x"]
    dated = spark.createDataFrame([(1, base, "<a href='/2023/x'><a href='/2019/y'><a href='/z'>")], "k int, url string, html string")
    assert [r.link for r in P.links(dated, "k", years=(2020, 2024)).collect()] == ["https://www.example.com/2023/x"]


def test_titles_and_main_part(spark):
    rows = [
        (1, "<meta content='Og &amp; co' property='og:title'><meta name=description content=\"Sum\"><title>T</title><main>m</main><article>a<p>b</article><div class='x article-body y'>body<div>in</div></div>after"),
        (2, "<title> T\n t </title><meta name='twitter:title' content='Tw'><main>m<table><tr><td>c</table></main>x"), (3, "<title>T</title><p>x</p>"), (4, None),
    ]
    df = spark.createDataFrame(rows, "k int, html string")
    got = {r.k: (r.t, r.s) for r in df.select("k", P.page_title(F.col("html")).alias("t"), P.page_summary(F.col("html")).alias("s")).collect()}
    assert got == {1: ("Og & co", "Sum"), 2: ("Tw", ""), 3: ("T", ""), 4: ("", "")}
    main = {}
    for r in P.main_blocks(df, "k").orderBy("k", "idx").collect():
        main.setdefault(r.k, []).append(r.text)
    assert main == {1: ["body", "in"], 2: ["m", "c"], 3: ["x"]}


def test_news_and_calls_to_segments(spark):
    news = [(BIG, " T ", "Sum", " Body "), (BIG + 2, None, None, "x"), (3, "T", " ", None), (4, "Own", "s", "<p>p</p>" + table(("a", "1"), ("b", "2")))]
    got = {}
    for r in S.news_segments(spark.createDataFrame(news, "k long, title string, summary string, content string"), "k").orderBy("k", "idx").collect():
        got.setdefault(r.k, []).append((r.section, r.kind, r.title, r.text))
    assert got[BIG] == [("news_article", "narrative", "T", "Sum\n\nBody")] and got[BIG + 2] == [("news_article", "narrative", "News Article", "x")] and 3 not in got
    assert [(k, t) for _, k, t, _ in got[4]] == [("narrative", "Own"), ("table", "Own")]
    call = "Operator: Welcome.\n\nJane Roe: Sales rose.\n\nCosts fell.\n\nQuestion-and-Answer Session\n\nJohn Doe: Why?\n\nJane Roe: Prices.\n\nJohn Doe: Thanks.\n\nThis concludes our call."
    calls = spark.createDataFrame([(BIG, "ACME", 2023, 2, call), (4, "X", 2023, 1, None)], "k long, ticker string, fiscal_year int, quarter int, text string")
    rows = S.transcript_segments(calls, "k").orderBy("k", "idx").collect()
    assert [(r.section, r.kind, r.title) for r in rows[:2]] == [("prepared_remarks", "narrative", "ACME Q2 2023 Prepared Remarks")] * 2
    assert rows[1].text == "Jane Roe: Sales rose.\n\nCosts fell."
    assert [(r.kind, r.title) for r in rows if r.section == "qa"][0] == ("qa", "ACME Q2 2023 Q&A")
    assert "John Doe: Why?" in " ".join(r.text for r in rows if r.section == "qa") and {r.k for r in rows} == {BIG}
    assert [r.text for r in rows if r.section == "closing"] == ["Unknown: This concludes our call."]


def test_pages_are_read_once(spark):
    """Tokens are made in one place of the plan's shuffles and pieces meet without joins, whatever is made of them."""
    df = spark.createDataFrame([(1, "<p>a</p><table><tr><td>1</td></tr></table>", "10-K")], "k long, html string, form string")
    plan = S.filing_segments(df, "k")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("posexplode(regexp_extract_all" in x for x in plan) <= 4 and sum("Join" in x for x in plan) == 1
    assert not any("Filter" in x and "<!--" in x for x in plan)  # nor read by a filter before
