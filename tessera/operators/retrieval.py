"""Dense and sparse retrieval, fusion, reranking and the abstain gate, for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_with
from tessera.operators.governance import current_versions
from tessera.operators.nearest import nearest
from tessera.operators.topk import Factor

# Weights, boosts and floors.
ALPHA, RRF_K = 0.7, 60
BOOST_COMPANY, BOOST_FORM, BOOST_YEAR = 1.5, 1.3, 1.3
TOP1_FLOOR, MEAN3_FLOOR = 0.42, 0.40


def overfetch(k: int, quantitative: bool) -> int:
    """Candidates of an arm for k results."""
    return max(3 * k, 30) if quantitative else 3 * k


def boost(*pairs: tuple[Column, float]) -> Column:
    """Product of the factors whose condition holds."""
    out = F.lit(1.0)
    for cond, factor in pairs:
        out = out * F.when(F.coalesce(cond, F.lit(False)), factor).otherwise(1.0)
    return out


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that agree with every value given; None is no condition, a list is membership."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return rows


def dense_topk(corpus: DataFrame, vector: Sequence[float], k: int, key: str, boost_by: Column | None = None, column: str = "embedding") -> DataFrame:
    """k rows with the highest boosted cosine similarity to one vector: key, cos_sim, score_v and the other columns."""
    scored = corpus.where(F.col(column).isNotNull()).withColumn("cos_sim", cosine_with(F.col(column), vector))
    scored = scored.withColumn("score_v", F.col("cos_sim") * (F.lit(1.0) if boost_by is None else boost_by)).drop(column)
    return scored.orderBy(F.desc("score_v"), key).limit(k)


def dense_topk_many(corpus: DataFrame, queries: DataFrame, k: int, key: str, query: str, column: str = "embedding") -> DataFrame:
    """Per query (query, query_vector) its k nearest rows with rank."""
    near = nearest(corpus, queries, k, key, query, column).drop("inside", "score").withColumnRenamed("raw", "cos_sim")
    return ranked(near, query, [F.desc("cos_sim"), F.asc(key)]).where(F.col("rank") <= k)


def ranked(rows: DataFrame, by: str | list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)))


def terms_of(text: Column) -> Column:
    """Lower-case alphanumeric terms of a text, in order and with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def minmax(score: str, within: str | list[str]) -> Column:
    """Min-max within a group; 1 if all scores are equal."""
    w = W.partitionBy(within)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def fuse_rrf(dense: DataFrame, sparse: DataFrame, query: str, key: str, alpha: float = ALPHA, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal ranks of two arms (query, key, rank), an absent arm adding nothing, then min-max per query."""
    v, b = dense.select(query, key, F.col("rank").alias("rank_v")), sparse.select(query, key, F.col("rank").alias("rank_b"))
    both = v.join(b, [query, key], "full")
    raw = F.coalesce(alpha / (k + F.col("rank_v")), F.lit(0.0)) + F.coalesce((1 - alpha) / (k + F.col("rank_b")), F.lit(0.0))
    return both.withColumn("rrf", raw).withColumn("fused", minmax("rrf", query))


def fuse_minmax(dense: DataFrame, sparse: DataFrame, query: str, key: str, alpha: float = ALPHA) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse of min-max scores; a missing score counts as 0 before, an empty arm is 0 throughout."""
    v, b = dense.select(query, key, F.col("score").alias("v")), sparse.select(query, key, F.col("score").alias("b"))
    both = v.join(b, [query, key], "full")
    w = W.partitionBy(query)
    empty = lambda c: F.max(F.col(c)).over(w).isNull()
    both = both.withColumn("_ev", empty("v")).withColumn("_eb", empty("b")).fillna(0.0, ["v", "b"])
    part = lambda c: F.when(F.col(f"_e{c}"), 0.0).otherwise(minmax(c, query))
    return both.withColumn("fused", alpha * part("v") + (1 - alpha) * part("b")).drop("_ev", "_eb")


def evidence_bonus(figures: Column, explanation: Column, kind: Column, source: Column) -> Column:
    """Bonus by what a question asks for and what form the evidence has."""
    return (
        F.when(figures & (kind == "table"), 0.20).otherwise(0.0)
        + F.when(explanation & (kind == "narrative"), 0.12).otherwise(0.0)
        + F.when(explanation & (source == "transcript") & kind.isin("qa", "narrative"), 0.08).otherwise(0.0)
        - F.when(figures & (source == "news"), 0.03).otherwise(0.0)
    )


def signal_bonus(signal: str, query: str, figures: Column) -> Column:
    """0.15 of the min-max data signal over a query's candidates, if it asks for figures."""
    return F.when(figures, 0.15 * minmax(signal, query)).otherwise(0.0)


def best_child(children: DataFrame, parent: str, score: str, tie: list[str]) -> DataFrame:
    """One row per parent: its best child."""
    return ranked(children, parent, [F.desc(score), *[F.asc(t) for t in tie]], "_n").where("_n = 1").drop("_n")


def merge_arms(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of both arms, of each key the one with the highest score."""
    return best_child(a.unionByName(b), key, score, [])


def with_fallback(scoped: DataFrame, unscoped: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """The scoped pool of each query, or the unscoped one where the scoped pool is empty."""
    empty = queries.select(query).join(scoped.select(query).distinct(), query, "left_anti")
    return scoped.unionByName(unscoped.join(empty, query, "left_semi"))


#: What an arm multiplies by where a candidate agrees with the question, and what a question keeps to.
BOOSTS = (Factor("company", "scope", BOOST_COMPANY), Factor("form", "form_hint", BOOST_FORM), Factor("fiscal_year", "years", BOOST_YEAR))
SCOPE = ("company", "scope")
#: Rows of the child arm of a question, before and after their parents are told apart.
CHILDREN = 30
#: What retrieve reads of a candidate: for versions, and for bonuses.
FILING = {"company": "string", "form": "string", "fiscal_year": "int", "period_label": "string", "section_name": "string"}
EVIDENCE = {"kind": "string", "source_type": "string", "signal": "double"}


def as_arm(rows: DataFrame, queries: DataFrame, query: str, raw: str) -> DataFrame:
    """Rows (query, raw, FILING) that were scored elsewhere, as a search gives them: with inside, score and raw."""
    asked = queries.select(query, "scope", "form_hint", "years")
    factor = boost(
        (F.col("company") == F.col("scope"), BOOST_COMPANY), (F.col("form") == F.col("form_hint"), BOOST_FORM),
        (F.array_contains("years", F.col("fiscal_year")), BOOST_YEAR),
    )
    inside = F.coalesce(F.col("scope").isNull() | (F.col("company") == F.col("scope")), F.lit(False))
    out = rows.withColumnRenamed(raw, "raw").join(asked, query)
    return out.withColumns({"inside": inside, "score": F.col("raw") * factor}).drop("scope", "form_hint", "years")


def retrieve(
    dense: DataFrame, sparse: DataFrame, queries: DataFrame, query: str, key: str, k: int, amended: DataFrame | None = None, fusion: str = "rrf",
    alpha: float = ALPHA, children: DataFrame | None = None, child: str | None = None, described=None,
) -> DataFrame:
    """(query, key, score, cos_sim, rank): the k best candidates of every query, from all arms.

    dense and sparse: what nearest and search give, (query, inside, score, raw, key) with at least the columns of FILING
    that there are and those of EVIDENCE, unless described(rows) adds the latter to the few rows that are left. children:
    the same for rows of tables, by their key `child`, with key their parent's. queries: query, figures, explanation.

    In this order: each arm is cut to its fetch of a question; a question keeps to its scope unless all arms are empty
    there; a question for figures takes the best child of each parent into the dense arm; rows that amended filings replace
    make room; ranks or scores are fused; bonuses are added; ties go to the higher key. cos_sim is null for what only
    the sparse arm found. All that is shuffled follows the queries and not the corpus.
    """
    fetch = F.when(F.col("figures"), overfetch(k, True)).otherwise(overfetch(k, False))
    asked = queries.select(query, "figures", "explanation").withColumn("_fetch", fetch)
    kept = FILING | EVIDENCE if described is None else FILING

    def arm(rows: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kept.items()]
        cos = F.col("raw") if name != "b" else F.lit(None).cast("double")
        tie = F.asc(child) if name == "c" else F.asc(key)
        r = rows.join(asked, query)
        r = ranked(r if name != "c" else r.where("figures"), [query, "inside"], [F.desc("score"), tie], "_at")
        r = r.where(F.col("_at") <= (CHILDREN if name == "c" else F.col("_fetch")))
        return r.select(query, key, *columns, F.col("score").alias("_score"), cos.alias("cos_sim"), F.lit(name).alias("_arm"), F.col("inside").alias("_in"), "_at", "figures", "explanation", "_fetch")

    both = reduce(DataFrame.unionByName, [arm(dense, "v"), arm(sparse, "b"), *([arm(children, "c")] if children is not None else [])])
    both = both.withColumn("_any", F.max("_in").over(W.partitionBy(query))).where("_in = _any").drop("_any")
    if children is not None:
        near = ranked(both.where("_arm <> 'b'"), [query, key], [F.desc("_score"), F.desc("_arm"), F.asc("_at")], "_n").where("_n = 1").drop("_n")
        near = ranked(near.withColumn("_arm", F.lit("v")), query, [F.desc("_score"), F.asc(key)], "_n").where("_n <= _fetch").drop("_n")
        both = near.unionByName(both.where("_arm = 'b'"))
    if amended is not None:
        both = current_versions(both, amended)
    both = ranked(both, [query, "_arm"], [F.desc("_score"), F.asc(key)])
    of = lambda name, c: F.max(F.when(F.col("_arm") == name, F.col(c)))
    # a candidate has the same columns in each arm, so any of its rows will do
    same = ["figures", "explanation", *(EVIDENCE if described is None else ())]
    found = both.groupBy(query, key).agg(
        of("v", "rank").alias("_rv"), of("b", "rank").alias("_rb"), of("v", "_score").alias("_v"), of("b", "_score").alias("_b"),
        F.max("cos_sim").alias("cos_sim"), *[F.first(c).alias(c) for c in same],
    )
    if described is not None:
        found = described(found)
    found = found.withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    if fusion == "rrf":
        rrf = F.coalesce(alpha / (RRF_K + F.col("_rv")), F.lit(0.0)) + F.coalesce((1 - alpha) / (RRF_K + F.col("_rb")), F.lit(0.0))
        found = found.withColumn("_rrf", rrf).withColumn("_fused", minmax("_rrf", query))
    else:
        w = W.partitionBy(query)
        empty = lambda c: F.max(F.col(c)).over(w).isNull()
        found = found.withColumns({"_ev": empty("_v"), "_eb": empty("_b")}).fillna(0.0, ["_v", "_b"])
        part = lambda c: F.when(F.col(f"_e{c}"), 0.0).otherwise(minmax(f"_{c}", query))
        found = found.withColumn("_fused", alpha * part("v") + (1 - alpha) * part("b"))
    figures = F.col("figures")
    final = F.col("_fused") + signal_bonus("signal", query, figures) + evidence_bonus(figures, F.col("explanation"), F.col("kind"), F.coalesce("source_type", F.lit("sec")))
    # nine places: sums that differ in their last bit only are ties
    best = ranked(found.withColumn("_final", F.round(final, 9)), query, [F.desc("_final"), F.desc(key)]).where(F.col("rank") <= k)
    return best.select(query, key, F.round("_final", 6).alias("score"), F.round("cos_sim", 6).alias("cos_sim"), "rank")


def confidence(pool: DataFrame, queries: DataFrame, query: str, top1_min: float = TOP1_FLOOR, mean3_min: float = MEAN3_FLOOR) -> DataFrame:
    """Per query the gate's status from the cosine similarities of its candidates (null: sparse only)."""
    placed = ranked(pool, query, [F.desc_nulls_last("cos_sim")], "_place")
    sims = placed.groupBy(query).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_place") <= 3, F.col("cos_sim"))), asc=False).alias("top"))
    got = queries.select(query).distinct().join(sims, query, "left")
    top1 = F.get("top", F.lit(0))
    mean3 = F.when(F.size("top") > 0, F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top"))
    status = (
        F.when(F.col("n").isNull(), "no_results").when(top1.isNull(), "sparse_only_unmeasurable")
        .when(top1 < top1_min, "below_top1_floor").when(mean3 < mean3_min, "below_mean_top3_floor").otherwise("pass")
    )
    return got.select(query, top1.alias("top1"), mean3.alias("mean_top3"), status.alias("status"), status.isin("no_results", "below_top1_floor", "below_mean_top3_floor").alias("abstain"))


def answerability(asked: DataFrame) -> DataFrame:
    """Metadata checks before the cosine gate.

    asked: n_results, unknown_company, company, companies, years, evidence_years, gate (a confidence status).
    """
    has_years = F.size(F.coalesce("years", F.array().cast("array<string>"))) > 0
    status = (
        F.when(F.col("n_results") == 0, "no_results").when(F.col("unknown_company").isNotNull(), "unknown_company")
        .when(F.col("company").isNotNull() & ~F.array_contains("companies", F.col("company")), "company_mismatch")
        .when(has_years & ~F.arrays_overlap("years", "evidence_years"), "year_mismatch").otherwise(F.col("gate"))
    )
    return asked.withColumn("status", status)


def citation_title(r: dict[str, Column] | None = None) -> Column:
    """Label of a source from display_title, company_name, company, source_type, filing_type, fiscal_year, period_label."""
    c = r or {}
    col = lambda n: c.get(n, F.col(n))
    blank = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    name = F.coalesce(blank(col("company_name")), blank(col("company")))
    year = F.nullif(col("fiscal_year"), F.lit(0)).cast("string")
    return F.coalesce(
        blank(col("display_title")),
        F.when(col("source_type") == "news", F.concat_ws(" ", name, F.lit("News")))
        .when(col("source_type") == "transcript", F.concat_ws(" ", name, F.lit("Earnings Call"), year, blank(col("period_label"))))
        .otherwise(F.concat_ws(" ", name, blank(col("filing_type")), year)),
    )
