"""Audit of how document filters interact in every order (operator 12).

Each document fails some of five filters: a mask of bits. What an order of filters keeps and removes depends on the
masks alone, so documents are counted once by part, mask and labels, and the audit runs on these cells.

1. Masks of A to D are worked out in the scan; texts never move. E compares the 256-bit digests of whole texts: rows are
   counted by digest, id and mask, then by digest and mask (combined before each shuffle, so a text that a third of all
   documents share is a few rows a task), and the least id of a text decides.
2. Cells are unpivoted against the 120 x 5 steps. A running bit-or over the steps of an order gives the filters that
   went before, conditional sums give a step's counts, and a window over a part's filter totals what it removed.

Defined cases: a null text counts as empty and a null lang as the part ''; a null id is neither smaller nor larger than
another id, so such a row never fails E nor makes another fail it, and it has no labels; of repeated rows with the same
id none is smaller; several labels of one id count as 1 where any is 1; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, let, staged, table

FILTERS = "ABCDE"
MIN_WORDS = 100
#: Per cent: distinct words of all words, at least, and capital letters of all code points, at most.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
MARKS = "[#$%&*|]"


def mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (not null) fails."""

    def words(w: Column) -> Column:
        # only the first and the last part of a split can be empty; distinct words are counted without them
        blank = F.lit("")
        n = F.size(w) - (F.get(w, F.lit(0)) == blank).cast("int") - ((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == blank)).cast("int")
        distinct = F.size(F.array_distinct(w)) - F.array_contains(w, "").cast("int")
        return F.when(n < MIN_WORDS, 1).otherwise(0) + F.when(100 * distinct.cast("long") < MIN_DISTINCT * n.cast("long"), 2).otherwise(0)

    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return (
        let(F.split(text, SPACE_CLASS), words)
        + F.when(100 * capitals > MAX_CAPITALS * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(MARKS), 8).otherwise(0)
    )


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail the filters of the mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    # written, so that what is joined and counted is a plain exchange and texts are read once
    rows = staged(rows, "masks")
    cell = ["part", "mask", "good", "toxic"]
    marked = rows.join(staged(marks, "marks"), "id", "left").na.fill(0, ["good", "toxic"])
    by_id = marked.groupBy("digest", "id", *cell).agg(F.count("*").alias("n"))
    # ids ascending, null last: the first element of the minimum is the least id and how many rows have it
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    by_text = staged(by_id.groupBy("digest", *cell).agg(F.sum("n").alias("n"), F.min(rank).alias("low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")), "texts")
    least = F.min("low.id").over(Window.partitionBy("digest"))  # as many rows as a text has parts and labels
    first = F.when(F.col("low.id") == least, F.col("low.n")).otherwise(0) + F.col("unnamed")
    counted = by_text.select(*cell, "n", first.alias("first"))
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("first").alias("k")), F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - F.col("first")).alias("k"))))
    long = counted.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", F.col("x.m").alias("mask"), F.col("x.k").alias("k"))
    return long.groupBy("part", "mask").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from cells (part, mask, n, good, toxic)."""
    steps = [
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(f).alias("filter"), F.lit(1 << filters.index(f)).alias("bit"))
        for order in permutations(filters)
        for k, f in enumerate(order)
    ]
    long = counts.select("*", F.explode(F.array(*steps)).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0

    def total(cond: Column, of: str = "n") -> Column:
        return F.sum(F.when(cond, F.col(of)).otherwise(0))

    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = staged(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "cells")
    return audit(counts).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e
  FROM d LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS prior FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN m & (prior | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN m & prior = 0 AND m & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN m & prior <> 0 AND m & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN m = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN m & prior = 0 AND m & bit <> 0 THEN n * good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN m & prior = 0 AND m & bit <> 0 THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
