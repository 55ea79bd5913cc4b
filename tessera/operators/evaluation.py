"""Retrieval metrics, ceilings, gates and answer scores as DataFrame operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import citations, content_tokens, normalised, numbers_in, token_overlap
from tessera.operators.topk import query_blocks, query_ids

# Thresholds of the sweep and cut-offs.
THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
CUTOFFS = (1, 3, 5, 10)


def with_overlaps(retrieved: DataFrame, docs: DataFrame, gold: DataFrame, query: str, doc: str, variants: dict[str, bool]) -> DataFrame:
    """retrieved (query, doc, rank) with a column for each variant (name: clean): the share of the gold text's content tokens in the document.

    retrieved has some rows a query, so it goes to the documents: texts stay where they are, and only those that were found are read as tokens.
    """
    texts = docs.select(doc, F.col("text").alias("_text")).join(F.broadcast(retrieved), doc).join(F.broadcast(gold.select(query, F.col("text").alias("_gold"))), query)
    # the found texts are dealt anew, as they may all lie in a few files
    texts = texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)
    tokens = lambda c, clean: content_tokens(F.col(c), clean, clean)
    return texts.withColumns({name: token_overlap(tokens("_text", clean), tokens("_gold", clean)) for name, clean in variants.items()}).drop("_text", "_gold")


def with_overlap(retrieved: DataFrame, docs: DataFrame, gold: DataFrame, query: str, doc: str, clean: bool = True) -> DataFrame:
    return with_overlaps(retrieved, docs, gold, query, doc, {"overlap": clean})


def _shares(docs: DataFrame, gold: DataFrame, query: str, doc: str, keep) -> DataFrame:
    """(query, doc, overlap) of what keep(query numbers, doc rows, overlaps) chooses of each batch of documents.

    The gold spans are a stated set: tasks hold their tokens, each with the spans that have it, and count a document's tokens span
    by span, so that no pair of a span and a document leaves a task unless it is chosen.
    """
    spans = gold.select(query, content_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    rows = docs.select(doc, content_tokens(F.col("text")).alias("tokens"))
    schema = T.StructType([T.StructField(query, spans.schema[query].dataType), T.StructField(doc, rows.schema[doc].dataType), T.StructField("overlap", T.DoubleType())])

    def task(asked):
        ids = query_ids(asked, query, spans.schema[query].dataType)
        sizes = np.array([len(a.tokens) for a in asked], float)
        holds: dict[str, list[int]] = {}
        for q, a in enumerate(asked):
            for t in a.tokens:
                holds.setdefault(t, []).append(q)

        def run(batches):
            for b in batches:
                found = [[], [], []]
                for i, tokens in enumerate(b.column("tokens").to_pylist()):
                    hits = [q for t in tokens for q in holds.get(t, ())]
                    if hits:
                        share = np.bincount(hits, minlength=len(asked)) / sizes
                        q = np.flatnonzero(share)
                        for x, y in zip(found, (q, np.full(len(q), i), share[q])):
                            x.append(y)
                if found[0]:
                    q, i, share = keep(*map(np.concatenate, found))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), b.column(doc).take(pa.array(i)), pa.array(share)], [query, doc, "overlap"])

        return run

    return reduce(DataFrame.unionByName, (rows.mapInArrow(task(asked), schema) for asked in query_blocks(spans, query)))


def all_overlaps(docs: DataFrame, gold: DataFrame, query: str, doc: str, least: float) -> DataFrame:
    """(query, doc, overlap) of every pair whose overlap is at least least (above 0)."""

    def enough(q, i, share):
        at = share >= least
        return q[at], i[at], share[at]

    return _shares(docs, gold, query, doc, enough)


def best_overlaps(docs: DataFrame, gold: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, best): the highest overlap of each gold span, 0 where no document has a token of it."""

    def highest(q, i, share):
        order = np.lexsort((-share, q))
        first = order[np.r_[True, q[order][1:] != q[order][:-1]]]
        return q[first], i[first], share[first]

    best = _shares(docs, gold, query, doc, highest).groupBy(query).agg(F.max("overlap").alias("best"))
    return gold.select(query).join(best, query, "left").na.fill(0.0, ["best"])


def gated(overlaps: DataFrame, passes: Column) -> DataFrame:
    """Each row twice, by gate: as it is (false), and with an overlap of 0 unless it passes the provenance gate (true)."""
    both = overlaps.withColumn("gate", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.withColumn("overlap", F.when(F.col("gate") & ~F.coalesce(passes, F.lit(False)), 0.0).otherwise(F.col("overlap")))


def first_hits(overlaps: DataFrame, query: str, thresholds=THRESHOLDS, by: tuple[str, ...] = ()) -> DataFrame:
    """(query, by, threshold, hit_rank): rank of the first row at or above each threshold, null if none."""
    t = overlaps.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return t.groupBy(query, *by, "threshold").agg(F.min(F.when(F.col("overlap") >= F.col("threshold"), F.col("rank"))).alias("hit_rank"))


def metric_grid(hits: DataFrame, query: str, span: str | None = None, cutoffs=CUTOFFS, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold, k, recall, hit, mrr): recall over gold spans, then means over queries; an empty set is 0."""
    h = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in cutoffs])))
    found = F.coalesce(F.col("hit_rank") <= F.col("k"), F.lit(False))
    per = h.groupBy(query, *by, "threshold", "k").agg(
        F.avg(found.cast("double")).alias("recall"), F.max(found.cast("double")).alias("hit"), F.coalesce(1.0 / F.min(F.when(found, F.col("hit_rank"))), F.lit(0.0)).alias("rr")
    )
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9)  # the order in which parts are summed must not decide the fourth place
    return per.groupBy(*by, "threshold", "k").agg(*[F.round(mean(c), 4).alias(n) for c, n in (("recall", "recall"), ("hit", "hit"), ("rr", "mrr"))])


def ceiling(best: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row per threshold: gold spans that some document reaches, with statistics of the best overlap (column best)."""
    t = best.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return t.groupBy("threshold").agg(
        F.count_if(F.col("best") >= F.col("threshold")).alias("reachable"), F.count("*").alias("spans"), F.round(F.avg("best"), 4).alias("mean"),
        F.round(F.median("best"), 4).alias("median"), F.round(F.min("best"), 4).alias("low"), F.round(F.max("best"), 4).alias("high"),
    )


def gate_diagnostics(retrieved: DataFrame, query: str, passes: Column) -> DataFrame:
    """Mean rows that pass the provenance gate, queries with none, queries."""
    per = retrieved.groupBy(query).agg(F.count_if(passes).alias("_n"))
    return per.agg(F.round(F.avg("_n"), 4).alias("mean_passing"), F.count_if(F.col("_n") == 0).alias("zero_passing"), F.count("*").alias("queries"))


# What a new configuration must reach to replace the old one.
MIN_RECALL, MAX_LATENCY_RATIO = 0.25, 1.5


def paired_decision(pair: DataFrame) -> DataFrame:
    """Accept or reject from old_ and new_ recall, zero_passing, reachable and p95."""
    checks = {
        "recall_ok": F.col("new_recall") >= MIN_RECALL, "provenance_ok": F.col("new_zero_passing") <= F.col("old_zero_passing"),
        "ceiling_ok": F.col("new_reachable") >= F.col("old_reachable"), "latency_ok": F.col("new_p95") <= MAX_LATENCY_RATIO * F.col("old_p95"),
    }
    out = pair.withColumns(checks)
    return out.withColumn("accepted", F.col("recall_ok") & F.col("provenance_ok") & F.col("ceiling_ok") & F.col("latency_ok"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """Scores per answer.

    answers: id, answer, abstained, should_abstain, accepted (texts), expected (numbers as text), n_chunks
    and supporting (1-based positions). An answer is right if it equals an accepted one after
    normalising, or holds all expected values as numbers or as text.
    """
    norm = normalised(F.col("answer"))
    accepted = F.exists(F.coalesce("accepted", F.array().cast("array<string>")), lambda a: normalised(a) == norm)
    numbers = numbers_in(F.col("answer"))
    has = lambda v: F.coalesce(F.array_contains(numbers, F.regexp_replace(v, ",", "").try_cast("decimal(30,6)")), F.lit(False)) | F.contains(norm, normalised(v))
    expected = (F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0) & F.forall(F.coalesce("expected", F.array().cast("array<string>")), has)
    cited = F.array_distinct(citations(F.col("answer")))
    valid = (F.size(cited) > 0) & F.forall(cited, lambda c: (c >= 1) & (c <= F.col("n_chunks")))
    support = F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, "supporting")) / F.size(cited)).otherwise(0.0)
    out = answers.select("*", (F.col("abstained") == F.col("should_abstain")).alias("answerability_ok"), (accepted | expected).alias("correct"), valid.alias("citations_ok"), support.alias("support_precision"))
    end = F.when(F.col("should_abstain"), F.col("abstained")).otherwise(~F.col("abstained") & F.col("correct") & F.col("citations_ok"))
    return out.withColumn("end_to_end", end)


def held_out(records: DataFrame, seen_ids: DataFrame, seen_groups: DataFrame, key: str, group: str) -> DataFrame:
    """Records whose id and group are both new."""
    return records.join(seen_ids.select(key).distinct(), key, "left_anti").join(seen_groups.select(group).distinct(), group, "left_anti")


def requirements(records: DataFrame, doc: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row per document in order, documents whose records disagree)."""
    g = records.groupBy(doc).agg(*[F.min(f).alias(f) for f in fields], F.count_distinct(F.struct(*fields)).alias("_n"))
    return g.where("_n = 1").drop("_n").orderBy(doc), g.where("_n > 1").select(doc)


def partition_errors(ids: DataFrame, curated: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Ids that are not in exactly one of curated and excluded, or unknown: key, reason."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    j = mark(ids, "_i").join(mark(curated, "_c"), key, "full").join(mark(excluded, "_x"), key, "full")
    reason = F.when(F.col("_i").isNull(), "unknown").when(F.col("_c") & F.col("_x"), "both").when(F.col("_c").isNull() & F.col("_x").isNull(), "neither")
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select(key, "reason")


def answer_rates(scored: DataFrame) -> DataFrame:
    """Rates over scored answers; those that need an answer count only where one is due."""
    due = ~F.col("should_abstain")
    rate = lambda c, cond=None: F.round(F.coalesce(F.avg((F.when(cond, F.col(c)) if cond is not None else F.col(c)).cast("double")), F.lit(0.0)), 4)
    return scored.agg(
        F.count("*").alias("n"), rate("answerability_ok").alias("answerability"), rate("correct", due & ~F.col("abstained")).alias("accuracy"), rate("citations_ok", due & ~F.col("abstained")).alias("citation_validity"),
        rate("support_precision", due & ~F.col("abstained")).alias("support_precision"), rate("end_to_end").alias("end_to_end"),
    )


def model_report(outputs: DataFrame) -> DataFrame:
    """pass@1, coverage and mean latency of outputs (predicted, gold, latency)."""
    return outputs.agg(
        F.round(F.avg(F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False)).cast("double")), 4).alias("pass_at_1"), F.round(F.avg(F.col("predicted").isNotNull().cast("double")), 4).alias("coverage"), F.round(F.avg("latency"), 4).alias("mean_latency")
    )


def gate_measures(pool: DataFrame, query: str) -> DataFrame:
    """(query, measure, value) of ranked pools (query, cos_sim, rank from 1): the best similarity, the means of the best three and ten."""
    sims = pool.where("rank <= 10").groupBy(query).agg(
        F.max("cos_sim").alias("top1"), F.avg(F.when(F.col("rank") <= 3, F.col("cos_sim"))).alias("mean3"), F.avg("cos_sim").alias("mean10")
    )
    return sims.unpivot([query], ["top1", "mean3", "mean10"], "measure", "value")


#: Accuracy of the quantile sketches: they are exact up to about so many values.
SKETCH = 4096


def calibration(measures: DataFrame, group: str, edge: float = 0.25) -> DataFrame:
    """(measure, group, n, low, median, high, floor, refused): distributions of the gate's measures in two groups of questions.

    measures: group (true where the corpus has the answer), measure, value. Distributions are quantile sketches, which merge
    between tasks. floor lies in the gap between the groups, nearer to those without an answer; where they overlap, at the
    median of those without. refused: the share of the group below the floor.
    """
    sketch = measures.groupBy("measure", group).agg(F.kll_sketch_agg_double("value", SKETCH).alias("s"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    at = sketch.withColumn("median", F.kll_sketch_get_quantile_double("s", F.lit(0.5)))
    of = lambda has, c: F.max(F.when(F.col(group) == has, F.col(c)))
    ends = at.groupBy("measure").agg(of(True, "low").alias("_in"), of(False, "high").alias("_out"), of(False, "median").alias("_mid"))
    floor = F.when(F.col("_in") > F.col("_out"), F.col("_out") + edge * (F.col("_in") - F.col("_out"))).otherwise(F.col("_mid"))
    ends = ends.select("measure", floor.alias("floor"))
    below = measures.join(ends, "measure").groupBy("measure", group).agg(F.avg((F.col("value") < F.col("floor")).cast("double")).alias("refused"))
    return at.join(ends, "measure").join(below, ["measure", group]).select("measure", group, "n", "low", "median", "high", "floor", "refused")


def hint_scores(cases: DataFrame, positive: str, negative: str, verdict: str, expected: str) -> DataFrame:
    """One row: hit rates and verdict accuracy of benchmark cases.

    positive, negative: whether the evidence holds what it should and what it should not; a case is met with the one and without
    the other. Gated rates count only cases whose verdict is not an abstention.
    """
    met = (F.col(positive) & ~F.col(negative)).cast("double")
    answered = ~F.col(verdict).isin("abstain", "not_yet_decidable")
    return cases.agg(
        F.count("*").alias("n_cases"), F.count_if(answered).alias("answered"), F.round(F.avg(met), 4).alias("met"), F.round(F.avg(F.when(answered, met)), 4).alias("met_answered"),
        F.round(F.avg((F.col(verdict) == F.col(expected)).cast("double")), 4).alias("verdict_accuracy"),
    )
