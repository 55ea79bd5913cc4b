"""Quality rules judged per document and per host (operator 5, DataFrame functions only).

Every document gets rule counts over its whole text. Rule failures are summed by host, the failure
rate of each host is shrunk towards an empirical beta prior, and the host's verdict is joined back.

Defined cases: a null text counts as empty (no words, base rules fail it); a null host is a host of
its own; repeated rows are judged alike, one result row each; an empty table gives an empty result;
other columns are ignored by the verdicts and kept by the filter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, staged, table, words

WINDOW = 8
MIN_WORDS = 20
#: Per cent of words in repeated windows above which a document fails.
MAX_REPEAT_PCT = 30
#: Symbols for every 100 words, and repeated lines for every 100 lines, above which a document fails.
MAX_SYMBOL_PCT = 40
MAX_DUP_LINE_PCT = 60
#: Mean word length outside these bounds fails.
MEAN_WORD = (2.0, 16.0)
#: A host whose shrunk failure rate is above this is rejected with all its documents.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR = (1.0, 1000.0)


def _adjacent_equal(a: Column, key) -> Column:
    """Elements of the sorted array whose key equals a neighbour's."""
    return F.filter(
        a,
        lambda x, k: F.coalesce(key(F.get(a, k - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(a, k + 1)) == key(x), F.lit(False)),
    )


def repeated_window_words(w: Column, n: int = WINDOW) -> Column:
    """How many words of array w lie in an n-word window that occurs twice or more in it.

    Hashes only choose which windows to compare; the windows themselves decide.
    """
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    single = F.transform(w, lambda x: F.xxhash64(x))
    hashed = let(single, lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(n)])))

    def exact(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
        like = let(pairs, lambda s: _adjacent_equal(s, lambda x: x["h"]))
        texts = F.sort_array(F.transform(like, lambda x: F.struct(F.concat_ws(" ", F.slice(w, x["i"], n)).alias("t"), x["i"].alias("i"))))
        at = F.sort_array(F.transform(let(texts, lambda s: _adjacent_equal(s, lambda x: x["t"])), lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x))

    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(0)).cast("long")


def document_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """Rule counts of every document's whole text, beside the columns in keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    out = docs.select(
        F.struct(*keep).alias("keep"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return out.select("keep.*", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def with_rules(stats: DataFrame) -> DataFrame:
    """Adds base_failed and failed (any rule)."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * n)
    soft = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))
        | (F.col("word_chars") < MEAN_WORD[0] * n)
        | (F.col("word_chars") > MEAN_WORD[1] * n)
    )
    return stats.withColumn("base_failed", base).withColumn("failed", base | soft)


def host_verdicts(judged: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict.

    The prior's mean is the overall failure rate; its strength comes from the variance between hosts
    beyond what sampling explains. Only these scalars reach the driver.
    """
    per = judged.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    r = per.agg(F.sum(n), F.sum(f), F.sum(f * f / n), F.count("*")).first()
    docs, failed, squares, hosts = r[0] or 0.0, r[1] or 0.0, r[2] or 0.0, r[3]
    mean = failed / docs if docs else 0.0
    inside = mean * (1 - mean)
    between = squares / docs - mean * mean - inside * hosts / docs if docs else 0.0
    strength = min(PRIOR[1], max(PRIOR[0], inside / between - 1)) if between > 0 else PRIOR[1]
    rate = (f + strength * mean) / (n + strength)
    return per.select(host, rate.alias("host_rate"), (rate <= MAX_HOST_RATE).alias("host_kept"))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """Rule counts and verdicts, one row per row of docs."""
    stats = staged(document_stats(docs, key, host), "quality")
    judged = with_rules(stats)
    # written, so that Spark can split a host with very many documents
    verdicts = staged(host_verdicts(judged, host).withColumnRenamed(host, "_host"), "host-verdicts")
    return (
        judged.join(verdicts, judged[host].eqNullSafe(verdicts["_host"]))
        .withColumn("kept", ~F.col("failed") & F.col("host_kept"))
        .drop("_host")
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that pass, with their own columns.

    Counts are worked out once. What passes the rules is written with its verdict, of what fails the host only; then
    the hosts are judged, and the rows of bad ones go.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text", F.col(host).alias("host"))
    judged = with_rules(document_stats(rows, "doc", "host")).select("host", "failed", F.when(~F.col("failed"), F.col("doc")).alias("doc"))
    judged = staged(judged, "quality")
    bad = staged(host_verdicts(judged, "host").where(~F.col("host_kept")).select(F.col("host").alias("bad")), "bad-hosts")
    return judged.where(~F.col("failed")).join(bad, F.col("host").eqNullSafe(F.col("bad")), "left_anti").select("doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "source", F.round("host_rate", 6).alias("host_rate")
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT k, i, array_to_string(w[i:i+7], ' ') AS t
  FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), dup AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT k, sum(least(8, g)) AS n FROM (SELECT k, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8) AS g FROM dup) GROUP BY k
), s AS (
  SELECT doc_id, source, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS wc,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (k)
), j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         100 * n_symbols > 40 * n_words OR 100 * n_dup_lines > 60 * n_lines
           OR coalesce(wc, 0) < 2.0 * n_words OR coalesce(wc, 0) > 16.0 * n_words AS soft
  FROM s
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft)::INT)::DOUBLE AS f FROM j GROUP BY source
), m AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) AS sq, count(*) AS hosts FROM h
), p AS (
  SELECT mean, mean * (1 - mean) AS inside, sq / n - mean * mean - mean * (1 - mean) * hosts / n AS between_hosts FROM m
), q AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN least(1000.0, greatest(1.0, inside / between_hosts - 1)) ELSE 1000.0 END AS k FROM p
), v AS (
  SELECT source, (f + k * mean) / (n + k) AS host_rate FROM h, q
)
SELECT j.doc_id, n_words::BIGINT AS n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR soft) AND host_rate <= 0.5 AS kept, n_lines::BIGINT AS n_lines, j.source, round(host_rate, 6) AS host_rate
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
