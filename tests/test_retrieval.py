from pyspark.sql import functions as F

from tessera.operators import governance as G
from tessera.operators import retrieval as R


def test_rrf_weights_arms_and_normalises(spark):
    arm = lambda rows: spark.createDataFrame(rows, "q int, id string, rank int")
    got = {r.id: r.fused for r in R.fuse_rrf(arm([(1, "a", 1), (1, "b", 2)]), arm([(1, "b", 1), (1, "c", 2)]), "q", "id").collect()}
    assert got["b"] == 1.0 and got["c"] == 0.0 and 0 < got["a"] < 1


def test_minmax_edges(spark):
    arm = lambda rows: spark.createDataFrame(rows, "q int, id string, score double")
    got = {r.id: r.fused for r in R.fuse_minmax(arm([(1, "a", 0.9), (1, "b", 0.4)]), arm([]), "q", "id").collect()}
    assert got == {"a": 0.7, "b": 0.0}  # an empty arm adds nothing
    same = R.fuse_minmax(arm([(1, "a", 0.5), (1, "b", 0.5)]), arm([(1, "a", 2.0), (1, "b", 2.0)]), "q", "id").collect()
    assert {r.fused for r in same} == {1.0}


def test_gate_boundaries(spark):
    pool = spark.createDataFrame([(1, 0.42), (1, 0.40), (1, 0.38), (2, 0.41), (3, 0.9), (3, 0.1), (3, 0.1), (4, None)], "q int, cos_sim double")
    q = spark.createDataFrame([(i,) for i in range(1, 6)], "q int")
    got = {r.q: (r.status, r.abstain) for r in R.confidence(pool, q, "q").collect()}
    assert got == {1: ("pass", False), 2: ("below_top1_floor", True), 3: ("below_mean_top3_floor", True), 4: ("sparse_only_unmeasurable", False), 5: ("no_results", True)}


def test_fallback_is_per_query(spark):
    pool = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q int, id string")
    scoped = pool.where("id = 'a'")
    q = spark.createDataFrame([(1,), (2,)], "q int")
    assert {(r.q, r.id) for r in R.with_fallback(scoped, pool, q, "q").collect()} == {(1, "a"), (2, "c")}


def test_overfetch():
    assert R.overfetch(5, True) == 30 and R.overfetch(20, True) == 60 and R.overfetch(5, False) == 15


def test_supersession_wildcards(spark):
    rows = spark.createDataFrame(
        [(1, "T", 2020, "Q1", "5", "10-K"), (2, "T", 2020, "Q1", "8", "10-K"), (3, "T", 2020, None, "5", "10-K"), (4, "T", 2020, "Q1", "5", "10-K/A"), (5, "T", 2021, "Q1", "5", "10-K"), (6, "T", 2020, "Q1", None, "10-K")],
        "id int, ticker string, fy int, period string, section string, form string",
    )
    amended = spark.createDataFrame([("T", 2020, "Q1", "5")], "ticker string, fy int, period string, section string")
    kept = G.not_superseded(rows, amended, ["ticker", "fy"], ["period"], ["section"])
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5]  # a row without a period is replaced by amendments without one only
    assert "Join" in kept._jdf.queryExecution().executedPlan().toString() and "CartesianProduct" not in kept._jdf.queryExecution().executedPlan().toString()


def test_context_window_clips_at_zero(spark):
    chunks = spark.createDataFrame([(1, i) for i in range(5)], "f int, i int")
    got = G.context_window(chunks, spark.createDataFrame([(1, 0)], "f int, anchor int"), "f", "i", 2)
    assert sorted(r.i for r in got.collect()) == [0, 1, 2]


def test_future_evidence_goes(spark):
    rows = spark.createDataFrame([(2019,), (2025,), (0,), (None,)], "fiscal_year int")
    assert G.future_free(rows, 2024).count() == 3


def test_boost_multiplies(spark):
    row = spark.createDataFrame([(1, None)], "a int, b int").select(R.boost((F.col("a") == 1, 1.5), (F.col("b") == 1, 1.3)).alias("x")).first()
    assert row.x == 1.5


def test_retrieve_whole(spark):
    """Scope with fallback, boosts before the cut, amendments, bonuses, ties to the higher key, no cosine from the sparse arm."""
    rows = [  # key, company, form, year, kind, source, signal
        (1, "A", "10-K", 2020, "narrative", "sec", 0.0), (2, "A", "10-K", 2021, "narrative", "sec", 0.0), (3, "B", "10-K", 2020, "table", "sec", 4.0),
        (4, "B", "10-K/A", 2020, "narrative", "sec", None), (5, None, "10-Q", None, "qa", None, 1.0),
    ]
    meta = spark.createDataFrame(rows, "doc_id int, company string, form string, fiscal_year int, kind string, source_type string, signal double")
    asked = spark.createDataFrame(
        [(1, "A", None, [], False, False), (2, "Z", None, [2021], False, False), (3, None, "10-Q", [], True, False), (4, None, None, None, False, False)],
        "q int, scope string, form_hint string, years array<int>, figures boolean, explanation boolean",
    )
    dense = meta.join(spark.createDataFrame([(q, d, c) for q in (1, 2, 3) for d, c in ((1, 0.5), (2, 0.5), (3, 0.6), (5, 0.55))], "q int, doc_id int, cos_sim double"), "doc_id")
    words = meta.join(spark.createDataFrame([(3, 4, 1.0), (4, 4, 1.0), (4, 5, 1.0)], "q int, doc_id int, raw double"), "doc_id")
    amended = meta.where("form = '10-K/A'")
    dense, words = R.as_arm(dense, asked, "q", "cos_sim"), R.as_arm(words, asked, "q", "raw")
    for fusion in ("rrf", "minmax"):
        got = {}
        for r in R.retrieve(dense, words, asked, "q", "doc_id", 3, amended, fusion).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append((r.doc_id, r.cos_sim))
        assert sorted(got[1]) == [(1, 0.5), (2, 0.5)]  # the scope's documents only
        assert got[2][0] == (2, 0.5) and {d for d, _ in got[2]} == {1, 2, 5}  # nothing in scope: all; 3 is replaced; the year lifts 2 over 5
        assert got[3][0] == (5, 0.55) and 3 not in dict(got[3])
        assert sorted(got[4]) == [(4, None), (5, None)]
    tied = R.retrieve(dense.where("q = 1"), words, asked, "q", "doc_id", 3, None, "minmax").where("q = 1").orderBy("rank").collect()
    assert [r.doc_id for r in tied] == [2, 1]
