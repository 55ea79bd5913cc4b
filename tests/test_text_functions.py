import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [("Revenue was $11,588 in 2,019,000!", "revenue was 11588 in 2019000"), ("", ""), (None, "")])
def test_normalised(spark, text, want):
    assert one(spark, text, X.normalised) == want


def test_content_tokens_drop_boilerplate_and_stop_words(spark):
    assert one(spark, "See accompanying notes. The revenue of the segment", X.content_tokens) == ["revenue", "segment"]


def test_overlap_is_recall_of_gold(spark):
    row = spark.createDataFrame([("alpha beta gamma", "alpha delta", "the")], "a string, b string, c string")
    t = lambda c: X.content_tokens(F.col(c))
    got = row.select(X.token_overlap(t("a"), t("b")).alias("x"), X.token_overlap(t("a"), t("c")).alias("y")).first()
    assert (got.x, got.y) == (0.5, 0.0)


@pytest.mark.parametrize(
    "q,want",
    [
        ("FY2019 vs FY22", ["2019", "2022"]), ("Q22023 and Q2 2024", ["2023", "2024"]), ("FY2018 - FY2020", ["2018", "2019", "2020"]),
        ("FY20 to FY21", ["2020", "2021"]), ("2001 to 2030", ["2001", "2030"]), ("0001018724-20-000004", []), (None, []),
    ],
)
def test_years(spark, q, want):
    assert one(spark, q, X.years_mentioned) == want


@pytest.mark.parametrize("q,named,hint", [("the annual report", "10-K", "10-K"), ("10-K or 10-Q", None, None), ("results of Q3", None, "10-Q"), ("in fiscal year 2020", None, "10-K"), ("hello", None, None)])
def test_forms(spark, q, named, hint):
    row = spark.createDataFrame([(q,)], "t string").select(X.form_named(F.col("t")).alias("a"), X.form_hint(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == (named, hint)


@pytest.mark.parametrize("q,want", [("What does OpenAI's SEC annual filing say?", "OpenAI"), ("What is the Company's 10-K about", None), ("OpenAI's revenue", None)])
def test_unknown_issuer(spark, q, want):
    got = one(spark, q, X.unknown_issuer)
    assert (got or "").split(" ")[-1] == (want or "")


def test_aliases(spark):
    got = one(spark, "The Costco Wholesale Corporation", X.company_aliases)
    assert {"costco", "costco wholesale", "costcowholesale", "costco wholesale corporation"} <= set(got)
    assert one(spark, "", X.company_aliases) == []


@pytest.mark.parametrize("text,want", [("a" * 260, 260), ("a" * 300, 257)])
def test_shortened(spark, text, want):
    assert len(one(spark, text, X.shortened)) == want


def test_features(spark):
    f = X.chunk_features(F.col("s"), F.col("t"))
    rows = spark.createDataFrame([("MD&A", "Revenue grew 5% to $1,200 million; EPS 3"), ("x", "We make things.")], "s string, t string")
    got = rows.select(*[c.alias(n) for n, c in f.items()]).collect()
    assert [r.is_quantitative for r in got] == [True, False]
    assert got[0].numeric_token_count == 3 and got[0].data_signal_score == 8.0


def test_citations_and_numbers(spark):
    assert one(spark, "so [1], and [2, 3]", X.citations) == [1, 2, 3]
    assert [float(x) for x in one(spark, "$1,200.5 and (7) and -3", X.numbers_in)] == [1200.5, -7.0, -3.0]


def test_stems():
    from tessera.functions.fts import stem

    words = {"caresses": "caress", "ponies": "poni", "running": "run", "relational": "relat", "hopping": "hop", "motoring": "motor", "happy": "happi", "adjustment": "adjust", "controlling": "control", "electricity": "electr", "filings": "file"}
    assert {w: stem(w) for w in words} == words


def test_rank_prefers_near_and_frequent_words():
    from tessera.functions.fts import positions, rank

    one = rank(positions("revenue grew"), ["revenu"])
    assert abs(one - 0.1 / 1.64493406685) < 1e-12
    assert rank(positions("revenue revenue"), ["revenu"]) > one
    near, far = rank(positions("net revenue grew"), ["net", "revenu"]), rank(positions("net a b c d e f g revenue"), ["net", "revenu"])
    assert near > far > 0 and rank(positions("net"), ["net", "revenu"]) == 0.0


def test_search_needs_all_lexemes(spark):
    from tessera.functions import fts

    d = spark.createDataFrame([(1, "The company's revenues grew quickly"), (2, "growth of the company"), (3, None)], "k int, text string")
    q = spark.createDataFrame([(7, "company revenue"), (8, "the of")], "q int, query_text string")
    assert [(r.q, r.k) for r in fts.search(d, q, "k", "q").collect()] == [(7, 1)]


def test_records(spark):
    from tessera.functions import records as D

    row = spark.createDataFrame([("Acme Q3 2023 call", "AMAZON_2019Q2_10K", "I say 4.\n#### 1,234", "0000320193-20-000096", "320193", "https://www.sec.gov/Archives/x")], "t string, d string, a string, acc string, cik string, u string")
    y, q = D.title_period(F.col("t"))
    got = row.select(y.alias("y"), q.alias("q"), D.final_number(F.col("a")).alias("n"), D.gold_document(F.col("d"), F.lit("10k"), F.lit("2019"))[2].alias("gq"), D.manifest_field_errors(F.col("acc"), F.col("cik"), F.col("u")).alias("ok"), D.manifest_field_errors(F.col("t"), F.col("t"), F.lit("http://u:p@evil/../x")).alias("bad")).first()
    assert (got.y, got.q, got.n, got.gq, got.ok) == (2023, 3, 1234.0, "Q2", []) and got.bad == ["accession", "cik", "source_url"]
    assert one(spark, "Long\n\nFinal answer: it is 7", D.final_scope) == "it is 7" and one(spark, "short", D.final_scope) == "short"


def test_question_parsing(spark):
    from tessera.operators import queryparse as P

    c = spark.createDataFrame([("JNJ", "Johnson & Johnson"), ("COST", "Costco Wholesale Corporation"), ("ARE", "Alexandria Real Estate Equities, Inc.")], "ticker string, name string")
    q = spark.createDataFrame([(1, "Are JnJ's sales up?"), (2, "What did Costco earn?"), (3, "COST revenue"), (4, "nothing here"), (5, None)], "k int, t string")
    got = {r.k: r.ticker for r in P.companies_named(q, c, "k", "t").collect()}
    assert got == {1: "JNJ", 2: "COST", 3: "COST", 4: None, 5: None}
    f = spark.createDataFrame([("cost",), ("johnson & johnson",), ("Costco",), ("Other",)], "n string")
    assert [r.resolved for r in P.resolved_filter(f.withColumn("k", F.lit(1)), c, "k", "n").orderBy("n").collect()] == ["COST", "Other", "COST", "JNJ"]
    s = spark.createDataFrame([("AMZN revenue 2019", ["AMZN", "Amazon"]), ("amazon", ["Amazon"])], "q string, n array<string>")
    assert [r.x for r in s.select(P.without_mentions(F.col("q"), F.col("n")).alias("x")).collect()] == ["revenue 2019", "amazon"]


def test_search_reads_each_text_where_it_lies(spark):
    """No text travels to be ranked, and a document is found once however many lexemes and copies of it there are."""
    from tessera.functions import fts

    docs = [(i, " ".join(f"alpha{i % 7} beta word{(i * k) % 50}" for k in range(60))) for i in range(200)] + [(900, None), (901, ""), (902, "alpha1 beta")]
    asked = [(1, "alpha1 beta"), (2, "alpha2 word4 beta"), (3, "the of"), (4, "nowhere")]
    found = fts.search(spark.createDataFrame(docs, "k long, body string"), spark.createDataFrame(asked, "q int, query_text string"), "k", "q", "body")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = sorted((q, k, fts.rank(fts.positions(t), list(fts.positions(x)))) for q, x in asked for k, t in docs)
    assert sorted((r.q, r.k, r.bm25_raw) for r in found.collect()) == [w for w in want if w[2] > 0]


def test_questions_are_not_joined_with_themselves(spark):
    """Repeated and null keys stay, aliases match whole words only, and questions are shuffled by key once."""
    from tessera.operators import queryparse as P

    c = spark.createDataFrame([("COST", "Costco Wholesale Corporation"), ("ARE", "Alexandria Real Estate Equities, Inc.")], "ticker string, name string")
    q = spark.createDataFrame([(1, "did costco earn"), (1, "nothing"), (2, "what costcos sell"), (None, "costco"), (3, None)], "k int, t string")
    found = P.companies_named(q, c, "k", "t")
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k or 0, r.ticker or "") for r in found.collect()) == [(0, ""), (1, "COST"), (1, "COST"), (2, ""), (3, "")]
