"""Questions resolved against known companies, many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


def aliases(companies: DataFrame) -> DataFrame:
    """(alias, ticker) of companies (ticker, name); an alias that two tickers claim is dropped."""
    a = companies.select("ticker", F.explode(X.company_aliases(F.col("name"))).alias("alias")).distinct()
    return a.groupBy("alias").agg(F.min("ticker").alias("ticker"), F.count("*").alias("n")).where("n = 1").drop("n")


def companies_named(questions: DataFrame, companies: DataFrame, key: str, text: str, longest: int = 6) -> DataFrame:
    """(key, ticker): a ticker in capitals first, then one in mixed case with two capitals, then the longest alias.

    Words of a question meet tickers and the first words of aliases in equi-joins; an alias of up to longest words is then
    looked up in the question, so that a question has a row for each word and not for each phrase.
    """
    tickers = companies.select("ticker").distinct()
    token = lambda p: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))

    def first(words: Column, grade: int) -> DataFrame:
        w = questions.select(key, F.posexplode(words).alias("at", "word")).withColumn("ticker", F.upper("word"))
        return w.join(tickers, "ticker").select(key, "ticker", F.lit(grade).alias("grade"), F.col("at").alias("place"))

    mixed = F.filter(token(r"\b([A-Za-z]{2,5})\b"), lambda x: F.length(F.regexp_replace(x, "[^A-Z]", "")) >= 2)
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    a = aliases(companies).withColumn("_w", words(F.col("alias")))
    a = a.where(F.size("_w").between(1, longest) & (F.array_join("_w", " ") == F.col("alias"))).select("alias", "ticker", F.col("_w")[0].alias("_first"))
    said = questions.select(key, words(X.company_text(F.col(text))).alias("_w")).select(key, F.array_join("_w", " ").alias("_said"), F.explode(F.array_distinct("_w")).alias("_first"))
    p = said.join(a, "_first").where(spaced(F.col("_said")).contains(spaced(F.col("alias"))))
    found = first(token(r"\b([A-Z]{2,5})\b"), 0).unionByName(first(mixed, 1)).unionByName(p.select(key, "ticker", F.lit(2).alias("grade"), (-F.length("alias")).alias("place")))
    # every question is a row beside what was found for it, so keys are shuffled once
    asked = questions.select(key, F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("int").alias("grade"), F.lit(None).cast("int").alias("place"))
    best = asked.unionByName(found).groupBy(key).agg(F.min(F.when(F.col("grade").isNotNull() & F.col(key).isNotNull(), F.struct("grade", "place", "ticker"))).alias("b"), F.count_if(F.col("grade").isNull()).cast("int").alias("n"))
    return best.select(key, F.explode(F.array_repeat(F.col("b.ticker"), F.col("n"))).alias("ticker"))


def resolved_filter(wanted: DataFrame, companies: DataFrame, key: str, name: str) -> DataFrame:
    """Adds resolved: the ticker, else the ticker of the exact name, else that of an alias, else the text as given."""
    t = companies.select(F.col("ticker").alias("_t1")).distinct()
    n = companies.select(F.lower("name").alias("_n"), F.col("ticker").alias("_t2")).dropDuplicates(["_n"])
    a = aliases(companies).select(F.col("alias").alias("_a"), F.col("ticker").alias("_t3"))
    c = F.trim(F.col(name))
    out = wanted.join(t, F.upper(c) == F.col("_t1"), "left").join(n, F.lower(c) == F.col("_n"), "left").join(a, X.company_text(c) == F.col("_a"), "left")
    return out.withColumn("resolved", F.coalesce("_t1", "_t2", "_t3", name)).drop("_t1", "_n", "_t2", "_a", "_t3")


def without_mentions(question: Column, names: Column) -> Column:
    """The question without the names (longest first), blanks collapsed; unchanged if nothing would be left."""
    ordered = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    quoted = lambda n: F.concat(F.lit(r"(?i)\b\Q"), n, F.lit(r"\E\b"))
    cleaned = F.trim(F.regexp_replace(F.aggregate(ordered, question, lambda q, n: F.regexp_replace(q, quoted(n), F.lit(" "))), r"\s+", " "))
    return F.when(cleaned == "", question).otherwise(cleaned)


def context_block(rank: Column, title: Column, text: Column, limit: int) -> Column:
    """A numbered block of context for a language model."""
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title, F.lit("\n"), X.excerpt(text, limit))
