from decimal import Decimal

from pyspark.sql import functions as F

from tessera.operators import claims as C
from tessera.operators import evaluation as E


def test_scaled_values_agree():
    assert C.bindings("$11.6 billion")[0][0] == C.bindings("$11,600 million")[0][0] == Decimal("11600000000")
    assert C.bindings("(12.5)%")[0][0] == Decimal("-12.5") and C.bindings("12 percent")[0][1] == "%"


def test_period_labels_are_no_values():
    assert C.bindings("in fiscal 2023") == [] and C.bindings("sold 2023 units") == [(Decimal(2023), None, "2023")]


def test_split_drops_connectives_and_repeats(spark):
    d = spark.createDataFrame([(1, "Revenue rose, and costs fell. costs fell; Done!"), (2, None)], "k int, text string")
    assert [r.claim for r in C.split_claims(d, "k").orderBy("idx").collect()] == ["Revenue rose", "costs fell", "Done!"]


def test_types(spark):
    rows = spark.createDataFrame([("Sales will rise",), ("Revenue was 5",), ("Growth because of demand",), ("They might",), ("We sell cars",)], "c string")
    got = [r.x for r in rows.select(C.claim_type(F.col("c"), loose_k=False).alias("x")).collect()]
    assert got == ["prediction", "reported_numeric", "causal", "opinion", "narrative_disclosure"]


def test_verdicts(spark):
    claims = spark.createDataFrame(
        [("a", "revenue was 5", "check_now", "revenue", None, Decimal(5), 2020), ("b", "revenue was 6", "check_now", "revenue", None, Decimal(6), 2020), ("c", "x", "non_verifiable", None, None, None, 2020),
         ("d", "x", "watch_later", None, None, None, 2020), ("e", "we sell red cars", "check_now", None, None, None, 2020), ("f", "nothing", "check_now", None, None, None, 2020), ("g", "revenue was 5", "check_now", "revenue", None, Decimal(5), 2018)],
        "claim_id string, claim string, check string, metric string, comparator string, value decimal(38,6), as_of_year int",
    )
    ev = spark.createDataFrame([("a", "net sales 5", 2020), ("b", "sales 5", 2020), ("e", "we sell blue and red cars", 2020), ("g", "sales 5", 2020)], "claim_id string, text string, fiscal_year int").withColumn("found", C.numeric_bindings("text"))
    got = {r.claim_id: r.verdict for r in C.verify(claims, ev).collect()}
    assert got == {"a": "verified", "b": "conflicting", "c": "non_verifiable", "d": "not_yet_decidable", "e": "verified", "f": "insufficient_evidence", "g": "insufficient_evidence"}


def test_claims_that_share_their_evidence(spark):
    claims = spark.createDataFrame(
        [("a", "revenue was 5", "check_now", "revenue", None, Decimal(5), 2020, 1), ("b", "revenue was 6", "check_now", "revenue", None, Decimal(6), 2020, 1), ("c", "we sell red cars", "check_now", None, None, None, 2020, 1),
         ("d", "we sell red cars", "check_now", None, None, None, 2020, None), ("e", "we sell red cars", "check_now", None, None, None, 2020, 2)],
        "claim_id string, claim string, check string, metric string, comparator string, value decimal(38,6), as_of_year int, id long",
    )
    ev = spark.createDataFrame([(1, "sales of 5 as we sell blue and red cars", 2020), (2, None, 2020), (None, "we sell red cars", 2020)], "id long, text string, fiscal_year int").withColumn("found", C.numeric_bindings("text"))
    got = C.verify(claims, ev, "id")
    assert {r.claim_id: (r.verdict, r.n_for, r.n_against) for r in got.collect()} == {"a": ("verified", 1, 0), "b": ("conflicting", 0, 1), "c": ("verified", 1, 0), "d": ("insufficient_evidence", 0, 0), "e": ("insufficient_evidence", 0, 0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    words = [x for x in plan.splitlines() if "array_distinct" in x]
    assert len(words) == 2 and not any("Join" in x or "Aggregate" in x for x in words)  # each side's words are taken apart before they meet


def test_ids_of_many_claims(spark):
    rows = spark.range(99, 101).select(C.claim_id(F.lit("x"), F.lit("ACME"), F.col("id")).substr(20, 9).alias("x")).collect()
    assert [r.x for r in rows] == ["99", "100"]


def test_metrics_over_spans(spark):
    o = spark.createDataFrame([("q", "s1", 1, 0.1), ("q", "s1", 2, 0.6), ("q", "s2", 1, 0.3)], "q string, span string, rank int, overlap double")
    hits = o.withColumn("threshold", F.lit(0.5)).groupBy("q", "span", "threshold").agg(F.min(F.when(F.col("overlap") >= 0.5, F.col("rank"))).alias("hit_rank"))
    got = {r.k: (r.recall, r.hit, r.mrr) for r in E.metric_grid(hits, "q", cutoffs=(1, 2)).collect()}
    assert got == {1: (0.0, 0.0, 0.0), 2: (0.5, 1.0, 0.5)}


def test_held_out_excludes_ids_and_groups(spark):
    r = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, g string")
    got = E.held_out(r, r.where("id = 1"), r.where("g = 'b'"), "id", "g")
    assert [x.id for x in got.collect()] == [3]
