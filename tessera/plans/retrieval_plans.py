"""Retrieval queries over embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.vectors import cosine, dot, l2_normalised
from tessera.operators import governance as G
from tessera.operators import postings as P
from tessera.operators import retrieval as R
from tessera.operators.nearest import fit_cells, in_cells, nearest, nearest_in_cells
from tessera.operators.topk import order_of
from tessera.plans.registry import query
from tessera.sources.tables import table

#: A query vector is that of the row with this id.
PROBE = 0
K = 10

_COS = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"
_PROBE = f"q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {PROBE})"
_MANY = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0)"


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE).select("embedding").first()
    return [float(x) for x in row[0]]


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def r6(c: str):
    return F.round(c, 6).alias(c)


@query("dense_topk", f"WITH {_PROBE} SELECT vec_id, label, round({_COS}, 6) AS cos_sim FROM embeddings e, q ORDER BY {_COS} DESC, vec_id LIMIT {K}")
def dense_topk(spark, sf_dir):
    return R.dense_topk(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), K, "vec_id").select("vec_id", "label", r6("cos_sim"))


_BOOST = "CASE WHEN label = 3 THEN 1.5 ELSE 1.0 END * CASE WHEN vec_id % 4 = 0 THEN 1.3 ELSE 1.0 END"


@query("dense_topk_boosted", f"WITH {_PROBE}, s AS (SELECT vec_id, {_COS} AS c, {_COS} * ({_BOOST})::DOUBLE AS s FROM embeddings e, q) SELECT vec_id, round(c, 6) AS cos_sim, round(s, 6) AS score_v FROM s ORDER BY s DESC, vec_id LIMIT {K}")
def dense_topk_boosted(spark, sf_dir):
    b = R.boost((F.col("label") == 3, R.BOOST_COMPANY), (F.col("vec_id") % 4 == 0, R.BOOST_FORM))
    return R.dense_topk(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), K, "vec_id", b).select("vec_id", r6("cos_sim"), r6("score_v"))


@query("dense_filtered", f"WITH {_PROBE} SELECT vec_id, label, round({_COS}, 6) AS cos_sim FROM embeddings e, q WHERE label IN (1, 4) ORDER BY {_COS} DESC, vec_id LIMIT {K}")
def dense_filtered(spark, sf_dir):
    rows = R.matching(table(spark, sf_dir, "embeddings"), label=[1, 4], vec_id=None)
    return R.dense_topk(rows, probe(spark, sf_dir), K, "vec_id").select("vec_id", "label", r6("cos_sim"))


_MANY_RANKED = f"WITH {_MANY}, s AS (SELECT query_id, vec_id, label, {_COS} AS c FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id)::INTEGER AS rank FROM s)"


@query("dense_multi_query", f"{_MANY_RANKED} SELECT query_id, vec_id, round(c, 6) AS cos_sim, rank FROM r WHERE rank <= {K}")
def dense_multi_query(spark, sf_dir):
    return R.dense_topk_many(table(spark, sf_dir, "embeddings"), probes(spark, sf_dir), K, "vec_id", "query_id").select("query_id", "vec_id", r6("cos_sim"), "rank")


@query("cosine_zero_guard", f"WITH {_PROBE} SELECT vec_id, 0.0::DOUBLE AS zero_cos, round(list_dot_product(e.embedding::DOUBLE[], q.v), 6) AS dot, round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm, len(e.embedding)::INTEGER AS dims FROM embeddings e, q")
def cosine_zero_guard(spark, sf_dir):
    e, q = F.col("embedding"), F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    zero = F.transform(e, lambda x: F.lit(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", cosine(e, zero).alias("zero_cos"), F.round(dot(e, q), 6).alias("dot"), F.round(F.sqrt(dot(e, e)), 6).alias("norm"), F.size(e).alias("dims"))


@query("l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def l2_normalise(spark, sf_dir):
    unit = l2_normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_TERMS = """tf AS (
  SELECT doc_id, n_terms, term, count(*) AS tf FROM (
    SELECT doc_id, len(w) AS n_terms, unnest(w) AS term FROM (
      SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)) GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark)
), need AS (SELECT item_id, count(*) AS need FROM q GROUP BY item_id),
hits AS (
  SELECT item_id, doc_id, count(*) AS hits, round(sum(ln(1.0 + tf) / ln(1.0 + n_terms)), 9) AS score FROM tf JOIN q USING (term) GROUP BY ALL
)"""


def item_terms(spark, sf_dir) -> DataFrame:
    """All terms of each benchmark item's whole text, as its query."""
    return table(spark, sf_dir, "benchmark").select("item_id", R.terms_of(F.col("text")).alias("terms"))


def sparse_best(spark, sf_dir, k: int) -> DataFrame:
    """(item_id, doc_id, score, rank) of each item's k best documents."""
    found = P.search_texts(table(spark, sf_dir, "documents"), item_terms(spark, sf_dir), k, "doc_id", "text", "item_id")
    return R.ranked(found, "item_id", order_of("score", "doc_id")).where(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")


@query("sparse_term_match", f"WITH {_TERMS} SELECT item_id, doc_id, hits::BIGINT AS hits FROM hits JOIN need USING (item_id) WHERE hits = need")
def sparse_term_match(spark, sf_dir):
    return P.matches_texts(table(spark, sf_dir, "documents"), item_terms(spark, sf_dir), "doc_id", "text", "item_id").select("item_id", "doc_id", "hits")


@query("sparse_term_rank", f"WITH {_TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM hits) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}")
def sparse_term_rank(spark, sf_dir):
    return sparse_best(spark, sf_dir, K).select("item_id", "doc_id", r6("score"), "rank")


# two rankings of the same vectors: by similarity, and by a second score that follows from the ids
_ARMS = f"""WITH {_MANY}, s AS (SELECT query_id, vec_id, {_COS} AS c, (((vec_id * 7919 + query_id * 104729) % 1009) / 1009.0)::DOUBLE AS b FROM embeddings e, q),
v AS (SELECT * FROM (SELECT query_id, vec_id, c AS score, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) WHERE rank <= 30),
t AS (SELECT * FROM (SELECT query_id, vec_id, b AS score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, vec_id) AS rank FROM s) WHERE rank <= 30)"""


def arms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, q = table(spark, sf_dir, "embeddings"), probes(spark, sf_dir)
    dense = R.dense_topk_many(e, q, 30, "vec_id", "query_id").withColumnRenamed("cos_sim", "score")
    second = e.select("vec_id").join(F.broadcast(q.select("query_id"))).withColumn("score", ((F.col("vec_id") * 7919 + F.col("query_id") * 104729) % 1009) / 1009.0)
    return dense, R.ranked(second, "query_id", [F.desc("score"), F.asc("vec_id")]).where("rank <= 30")


_MINMAX = lambda c, w="query_id": f"CASE WHEN max({c}) OVER (PARTITION BY {w}) = min({c}) OVER (PARTITION BY {w}) THEN 1.0 ELSE ({c} - min({c}) OVER (PARTITION BY {w})) / (max({c}) OVER (PARTITION BY {w}) - min({c}) OVER (PARTITION BY {w})) END"
_RRF = "coalesce(0.7::DOUBLE / (60 + v.rank), 0) + coalesce(0.3::DOUBLE / (60 + t.rank), 0)"


@query("rrf_fusion", f"{_ARMS}, f AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.vec_id, t.vec_id) AS vec_id, {_RRF} AS rrf FROM v FULL JOIN t ON v.query_id = t.query_id AND v.vec_id = t.vec_id) SELECT query_id, vec_id, round(rrf, 9) AS rrf, round({_MINMAX('rrf')}, 6) AS fused FROM f")
def rrf_fusion(spark, sf_dir):
    return R.fuse_rrf(*arms(spark, sf_dir), "query_id", "vec_id").select("query_id", "vec_id", F.round("rrf", 9).alias("rrf"), r6("fused"))


@query("minmax_fusion", f"{_ARMS}, f AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.vec_id, t.vec_id) AS vec_id, coalesce(v.score, 0.0) AS v, coalesce(t.score, 0.0) AS b FROM v FULL JOIN t ON v.query_id = t.query_id AND v.vec_id = t.vec_id) SELECT query_id, vec_id, round(0.7 * {_MINMAX('v')} + 0.3 * {_MINMAX('b')}, 6) AS fused FROM f")
def minmax_fusion(spark, sf_dir):
    return R.fuse_minmax(*arms(spark, sf_dir), "query_id", "vec_id").select("query_id", "vec_id", r6("fused"))


_KIND = "CASE WHEN doc_id % 3 = 0 THEN 'table' WHEN doc_id % 3 = 1 THEN 'narrative' ELSE 'qa' END"
_SRC = "CASE WHEN doc_id % 4 = 0 THEN 'news' WHEN doc_id % 4 = 1 THEN 'transcript' ELSE 'sec' END"
_NUM = r"len(regexp_extract_all(text, '\$\s*\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s*%|\d[\d,]*(?:\.\d+)?'))"


@query("rerank_bonus", f"""WITH s AS (SELECT doc_id, lang, {_KIND} AS kind, {_SRC} AS src, {_NUM}::DOUBLE AS signal, lang IN ('en', 'fr') AS fig, lang IN ('en', 'de') AS exp FROM documents)
SELECT doc_id, round(CASE WHEN fig AND kind = 'table' THEN 0.2 ELSE 0 END + CASE WHEN exp AND kind = 'narrative' THEN 0.12 ELSE 0 END
  + CASE WHEN exp AND src = 'transcript' AND kind IN ('qa', 'narrative') THEN 0.08 ELSE 0 END - CASE WHEN fig AND src = 'news' THEN 0.03 ELSE 0 END, 6)::DOUBLE AS bonus,
  round(CASE WHEN fig THEN 0.15 * {_MINMAX('signal', 'lang')} ELSE 0 END, 6)::DOUBLE AS signal_bonus FROM s""")
def rerank_bonus(spark, sf_dir):
    figures, explain = F.col("lang").isin("en", "fr"), F.col("lang").isin("en", "de")
    s = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_KIND).alias("kind"), F.expr(_SRC).alias("src"), F.regexp_count("text", F.lit(X.NUMBER)).cast("double").alias("signal"))
    return s.select("doc_id", F.round(R.evidence_bonus(figures, explain, F.col("kind"), F.col("src")), 6).alias("bonus"), F.round(R.signal_bonus("signal", "lang", figures), 6).alias("signal_bonus"))


# flagship: the sparse arm ranks documents for each benchmark item, the dense arm vectors that stand for the documents;
# filing metadata and the signals of a question follow from the ids
_FORM = "CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END || CASE WHEN doc_id % 500 = 7 THEN '/A' ELSE '' END"
_SCOPE = "CASE WHEN item_id % 4 = 0 THEN NULL WHEN item_id % 9 = 1 THEN 'nobody' ELSE 'src' || (item_id % 20) END"
_HINT = "CASE WHEN item_id % 5 = 1 THEN '10-K' WHEN item_id % 5 = 2 THEN '10-Q' END"
_HYBRID = f"""WITH {_TERMS}, emb AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT item_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
m AS (SELECT doc_id, source AS company, {_FORM} AS form, 2018 + doc_id % 4 AS fiscal_year, {_KIND} AS kind, {_SRC} AS src, {_NUM}::DOUBLE AS signal FROM documents),
asked AS (SELECT item_id, {_SCOPE} AS scope, {_HINT} AS hint, 2018 + item_id % 4 AS fy, item_id % 3 = 0 AS fig, item_id % 3 = 1 AS exp FROM benchmark),
arms AS (
  SELECT 'v' AS arm, item_id, doc_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS raw FROM emb, p
  UNION ALL SELECT 'b', item_id, doc_id, score FROM hits),
s AS (
  SELECT *, raw * (CASE WHEN company = scope THEN 1.5 ELSE 1 END::DOUBLE * CASE WHEN form = hint THEN 1.3 ELSE 1 END::DOUBLE * CASE WHEN fiscal_year = fy THEN 1.3 ELSE 1 END::DOUBLE) AS boosted
  FROM arms JOIN m USING (doc_id) JOIN asked USING (item_id)),
scoped AS (SELECT * FROM s WHERE scope IS NULL OR company = scope),
pool AS (SELECT * FROM scoped UNION ALL SELECT * FROM s WHERE item_id NOT IN (SELECT item_id FROM scoped)),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, item_id ORDER BY boosted DESC, doc_id) AS n FROM pool) WHERE n <= CASE WHEN fig THEN 30 ELSE 15 END),
gone AS (SELECT DISTINCT company, fiscal_year, replace(form, '/A', '') AS form FROM m WHERE form LIKE '%/A'),
alive AS (SELECT *, row_number() OVER (PARTITION BY arm, item_id ORDER BY boosted DESC, doc_id) AS rank FROM fetched ANTI JOIN gone USING (company, fiscal_year, form)),
f AS (
  SELECT item_id, doc_id, fig, exp, kind, src, signal, max(raw) FILTER (arm = 'v') AS cos_sim,
    coalesce(0.7::DOUBLE / (60 + max(rank) FILTER (arm = 'v')), 0) + coalesce(0.3::DOUBLE / (60 + max(rank) FILTER (arm = 'b')), 0) AS rrf
  FROM alive GROUP BY ALL),
g AS (
  SELECT *, round({_MINMAX('rrf', 'item_id')} + CASE WHEN fig THEN 0.15::DOUBLE * {_MINMAX('signal', 'item_id')} ELSE 0 END
    + CASE WHEN fig AND kind = 'table' THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN exp AND kind = 'narrative' THEN 0.12 ELSE 0 END::DOUBLE
    + CASE WHEN exp AND src = 'transcript' AND kind IN ('qa', 'narrative') THEN 0.08 ELSE 0 END::DOUBLE - CASE WHEN fig AND src = 'news' THEN 0.03 ELSE 0 END::DOUBLE, 9) AS final FROM f)
SELECT item_id, doc_id, round(final, 6)::DOUBLE AS score, round(cos_sim, 6) AS cos_sim, rank
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id DESC)::INTEGER AS rank FROM g) WHERE rank <= 5"""


@query("hybrid_topk", _HYBRID)
def hybrid_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("company"), F.expr(_FORM).alias("form"), (2018 + F.col("doc_id") % 4).alias("fiscal_year"),
    )
    asked = table(spark, sf_dir, "benchmark").select(
        "item_id", F.expr(_SCOPE).alias("scope"), F.expr(_HINT).alias("form_hint"), F.array(2018 + F.col("item_id") % 4).alias("years"),
        (F.col("item_id") % 3 == 0).alias("figures"), (F.col("item_id") % 3 == 1).alias("explanation"), R.terms_of(F.col("text")).alias("terms"),
    )
    meta = docs.drop("text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = asked.join(e.select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("query_vector")), "item_id")
    most = R.overfetch(5, True)
    words = P.search_texts(docs, asked, most, "doc_id", "text", "item_id", ["company", "form", "fiscal_year"], R.BOOSTS, R.SCOPE)
    near = nearest(e.join(meta, "doc_id"), q, most, "doc_id", "item_id", "embedding", R.BOOSTS, R.SCOPE)
    signal = docs.select("doc_id", "text"), F.regexp_count("text", F.lit(X.NUMBER)).cast("double")
    amended = meta.where(G.is_amendment(F.col("form")))
    return R.retrieve(near, words, asked.drop("terms"), "item_id", "doc_id", 5, amended, described=lambda found: found.join(signal[0], "doc_id").select(
        "*", F.expr(_KIND).alias("kind"), F.expr(_SRC).alias("source_type"), signal[1].alias("signal")).drop("text"))


# the whole retrieval: a child arm, amendments by period and section, min-max fusion; periods, sections and children follow from the ids
_PERIOD = "CASE WHEN doc_id % 7 > 0 THEN ' q' || (1 + doc_id % 3) END"
_SECTION = "CASE doc_id % 6 WHEN 0 THEN 'Item 7' WHEN 1 THEN 'MD&A' WHEN 2 THEN 'Full Document' WHEN 4 THEN 'Item  1A' WHEN 5 THEN 'Risk factors' END"
_FORMS = "CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END || CASE WHEN doc_id % 37 = 5 THEN '/A' ELSE '' END"
_FACTORS = "(CASE WHEN company = scope THEN 1.5 ELSE 1 END::DOUBLE * CASE WHEN form = hint THEN 1.3 ELSE 1 END::DOUBLE * CASE WHEN fiscal_year = fy THEN 1.3 ELSE 1 END::DOUBLE)"
_PAIR = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"
_WHOLE = f"""WITH {_TERMS}, emb AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT item_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
m AS (
  SELECT doc_id, source AS company, {_FORMS} AS form, 2018 + doc_id % 4 AS fiscal_year, {_KIND} AS kind, {_SRC} AS src, {_NUM}::DOUBLE AS signal,
    upper(trim({_PERIOD})) AS period, upper({_SECTION}) AS section FROM documents),
asked AS (SELECT item_id, {_SCOPE} AS scope, {_HINT} AS hint, 2018 + item_id % 4 AS fy, item_id % 3 = 0 AS fig, item_id % 3 = 1 AS exp FROM benchmark),
arms AS (
  SELECT 'v' AS arm, item_id, vec_id AS doc_id, NULL AS child, {_PAIR} AS raw FROM emb, p
  UNION ALL SELECT 'b', item_id, doc_id, NULL, score FROM hits
  UNION ALL SELECT 'c', item_id, vec_id // 3, vec_id, {_PAIR} FROM emb, p WHERE item_id % 3 = 0),
s AS (SELECT *, raw * {_FACTORS} AS boosted, coalesce(scope IS NULL OR company = scope, false) AS side FROM arms JOIN m USING (doc_id) JOIN asked USING (item_id)),
pool AS (SELECT * FROM (SELECT *, bool_or(side) OVER (PARTITION BY item_id) AS best_side FROM s) WHERE side = best_side),
cut AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, item_id ORDER BY boosted DESC, coalesce(child, doc_id)) AS n FROM pool)
  WHERE n <= CASE WHEN arm = 'c' OR fig THEN 30 ELSE 15 END),
near AS (SELECT * FROM cut WHERE arm <> 'b' QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY boosted DESC, arm DESC, n) = 1),
found AS (
  SELECT 'v' AS side_arm, * FROM near QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY boosted DESC, doc_id) <= CASE WHEN fig THEN 30 ELSE 15 END
  UNION ALL SELECT 'b', * FROM cut WHERE arm = 'b'),
named AS (
  SELECT doc_id, upper(company) AS company, replace(form, '/A', '') AS base, fiscal_year, form LIKE '%/A' AS amends, period,
    CASE WHEN section = 'FULL DOCUMENT' THEN NULL WHEN section LIKE 'ITEM%' THEN
      CASE WHEN form LIKE '10-Q%' THEN NULL WHEN section = 'ITEM 7' THEN 'MD&A' ELSE 'RISK FACTORS' END ELSE section END AS section FROM m),
gone AS (SELECT * FROM named WHERE amends),
alive AS (
  SELECT f.* FROM found f JOIN named x USING (doc_id) WHERE x.amends OR NOT EXISTS (
    SELECT 1 FROM gone g WHERE g.company = x.company AND g.base = x.base AND g.fiscal_year = x.fiscal_year
      AND (g.period IS NULL OR g.period = x.period) AND (x.section IS NULL OR g.section IS NULL OR g.section = x.section))),
f AS (
  SELECT item_id, doc_id, fig, exp, kind, src, signal, max(raw) FILTER (side_arm = 'v') AS cos_sim,
    max(boosted) FILTER (side_arm = 'v') AS v, max(boosted) FILTER (side_arm = 'b') AS b FROM alive GROUP BY ALL),
e AS (SELECT *, max(v) OVER (PARTITION BY item_id) IS NULL AS ev, max(b) OVER (PARTITION BY item_id) IS NULL AS eb FROM f),
z AS (SELECT * REPLACE (coalesce(v, 0) AS v, coalesce(b, 0) AS b) FROM e),
g AS (
  SELECT *, round(0.7::DOUBLE * CASE WHEN ev THEN 0 ELSE {_MINMAX('v', 'item_id')} END + 0.3::DOUBLE * CASE WHEN eb THEN 0 ELSE {_MINMAX('b', 'item_id')} END
    + CASE WHEN fig THEN 0.15::DOUBLE * {_MINMAX('signal', 'item_id')} ELSE 0 END
    + CASE WHEN fig AND kind = 'table' THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN exp AND kind = 'narrative' THEN 0.12 ELSE 0 END::DOUBLE
    + CASE WHEN exp AND src = 'transcript' AND kind IN ('qa', 'narrative') THEN 0.08 ELSE 0 END::DOUBLE - CASE WHEN fig AND src = 'news' THEN 0.03 ELSE 0 END::DOUBLE, 9) AS final FROM z)
SELECT item_id, doc_id, round(final, 6)::DOUBLE AS score, round(cos_sim, 6) AS cos_sim, rank
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id DESC)::INTEGER AS rank FROM g) WHERE rank <= 5"""


@query("retrieve_whole", _WHOLE)
def retrieve_whole(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("company"), F.expr(_FORMS).alias("form"), (2018 + F.col("doc_id") % 4).cast("int").alias("fiscal_year"),
        F.expr(_PERIOD).alias("period_label"), F.expr(_SECTION).alias("section_name"),
    )
    asked = table(spark, sf_dir, "benchmark").select(
        "item_id", F.expr(_SCOPE).alias("scope"), F.expr(_HINT).alias("form_hint"), F.array((2018 + F.col("item_id") % 4).cast("int")).alias("years"),
        (F.col("item_id") % 3 == 0).alias("figures"), (F.col("item_id") % 3 == 1).alias("explanation"), R.terms_of(F.col("text")).alias("terms"),
    )
    meta, e = docs.drop("text"), table(spark, sf_dir, "embeddings").drop("label")
    q = asked.join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")), "item_id")
    most = R.overfetch(5, True)
    words = P.search_texts(docs, asked, most, "doc_id", "text", "item_id", list(R.FILING), R.BOOSTS, R.SCOPE)
    near = nearest(e.withColumnRenamed("vec_id", "doc_id").join(meta, "doc_id"), q, most, "doc_id", "item_id", "embedding", R.BOOSTS, R.SCOPE)
    rows = e.withColumn("doc_id", F.expr("vec_id div 3")).join(meta, "doc_id")
    children = nearest(rows, q.where("figures"), R.CHILDREN, "vec_id", "item_id", "embedding", R.BOOSTS, R.SCOPE)
    texts, signal = docs.select("doc_id", "text"), F.regexp_count("text", F.lit(X.NUMBER)).cast("double").alias("signal")

    def described(found):
        return found.join(texts, "doc_id").select("*", F.expr(_KIND).alias("kind"), F.expr(_SRC).alias("source_type"), signal).drop("text")

    return R.retrieve(near, words, asked, "item_id", "doc_id", 5, meta, "minmax", children=children, child="vec_id", described=described)


#: Cells of the inverted file.
CELLS = 16


@query("dense_in_cells", f"{_MANY_RANKED} SELECT query_id, vec_id, round(c, 6) AS cos_sim, rank FROM r WHERE rank <= {K}")
def dense_in_cells(spark, sf_dir):
    """The inverted file with all its cells probed: the exact search, by another way."""
    e, q = table(spark, sf_dir, "embeddings"), probes(spark, sf_dir)
    centres = fit_cells(e, CELLS, "vec_id")
    found = nearest_in_cells(in_cells(e, centres), centres, q, CELLS, K, "vec_id", "query_id")
    return R.ranked(found, "query_id", order_of("raw", "vec_id")).where(F.col("rank") <= K).select("query_id", "vec_id", F.round("raw", 6).alias("cos_sim"), "rank")


@query("parent_child_best", "SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE n = 1")
def parent_child_best(spark, sf_dir):
    best = R.best_child(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return best.join(table(spark, sf_dir, "orders"), best["l_orderkey"] == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus")


@query("child_dense_merge", f"WITH {_PROBE}, s AS (SELECT vec_id % 50 AS parent_id, {_COS} AS c, vec_id FROM embeddings e, q), k AS (SELECT parent_id, c FROM s WHERE vec_id % 2 = 0 UNION ALL SELECT parent_id, c * 0.95::DOUBLE FROM s WHERE vec_id % 2 = 1) SELECT parent_id, round(max(c), 6) AS score FROM k GROUP BY parent_id")
def child_dense_merge(spark, sf_dir):
    from tessera.functions.vectors import cosine_with

    s = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("parent_id"), cosine_with(F.col("embedding"), probe(spark, sf_dir)).alias("score"))
    a, b = s.where("vec_id % 2 = 0").select("parent_id", "score"), s.where("vec_id % 2 = 1").select("parent_id", (F.col("score") * 0.95).alias("score"))
    return R.merge_arms(a, b, "parent_id", "score").select("parent_id", r6("score"))


@query("scope_fallback", f"{_MANY_RANKED}, sc AS (SELECT * FROM r WHERE rank <= 5 AND label = query_id % 10), em AS (SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM sc)) SELECT query_id, vec_id, rank FROM sc UNION ALL SELECT query_id, vec_id, rank FROM r WHERE rank <= 5 AND query_id IN (SELECT query_id FROM em)")
def scope_fallback(spark, sf_dir):
    pool = R.dense_topk_many(table(spark, sf_dir, "embeddings"), probes(spark, sf_dir), 5, "vec_id", "query_id")
    scoped = pool.where(F.col("label") == F.col("query_id") % 10)
    return R.with_fallback(scoped, pool, probes(spark, sf_dir), "query_id").select("query_id", "vec_id", "rank")


_GATE = f"""{_MANY_RANKED}, p AS (SELECT query_id, max(c) AS top1, avg(c) AS m FROM r WHERE rank BETWEEN 2 AND 4 GROUP BY query_id)
SELECT query_id, round(top1, 6) AS top1, round(m, 6) AS mean_top3, CASE WHEN top1 < 0.42 THEN 'below_top1_floor' WHEN m < 0.40 THEN 'below_mean_top3_floor' ELSE 'pass' END AS status, top1 < 0.42 OR m < 0.40 AS abstain FROM p"""


@query("abstain_gate", _GATE)
def abstain_gate(spark, sf_dir):
    pool = R.dense_topk_many(table(spark, sf_dir, "embeddings"), probes(spark, sf_dir), 4, "vec_id", "query_id").where("rank > 1")
    return R.confidence(pool, probes(spark, sf_dir), "query_id").select("query_id", r6("top1"), r6("mean_top3"), "status", "abstain")


_MEASURES = f"""{_MANY_RANKED}, p AS (SELECT query_id, query_id % 200 = 0 AS inside, c, rank - 1 AS rank FROM r WHERE rank BETWEEN 2 AND 11),
t AS (SELECT query_id, inside, max(c) AS top1, avg(c) FILTER (rank <= 3) AS mean3, avg(c) AS mean10 FROM p GROUP BY ALL),
m AS (UNPIVOT t ON top1, mean3, mean10 INTO NAME measure VALUE value),
d AS (SELECT measure, inside, count(*) AS n, min(value) AS low, quantile_disc(value, 0.5) AS median, max(value) AS high FROM m GROUP BY ALL),
f AS (SELECT measure, CASE WHEN max(low) FILTER (inside) > max(high) FILTER (NOT inside) THEN max(high) FILTER (NOT inside) + 0.25::DOUBLE * (max(low) FILTER (inside) - max(high) FILTER (NOT inside))
  ELSE max(median) FILTER (NOT inside) END AS floor FROM d GROUP BY measure),
b AS (SELECT measure, inside, avg((value < floor)::INT) AS refused FROM m JOIN f USING (measure) GROUP BY ALL)
SELECT measure, inside, n, round(low, 6) AS low, round(median, 6) AS median, round(high, 6) AS high, round(floor, 6) AS floor, round(refused, 6) AS refused FROM d JOIN f USING (measure) JOIN b USING (measure, inside)"""


@query("gate_calibration", _MEASURES)
def gate_calibration(spark, sf_dir):
    """Every other probe stands for a question whose answer the corpus has; a probe itself is not counted."""
    from tessera.operators import evaluation as E

    pool = R.dense_topk_many(table(spark, sf_dir, "embeddings"), probes(spark, sf_dir), 11, "vec_id", "query_id").where("rank > 1")
    m = E.gate_measures(pool.withColumn("rank", F.col("rank") - 1), "query_id").withColumn("inside", F.col("query_id") % 200 == 0)
    return E.calibration(m, "inside").select("measure", "inside", "n", *[r6(c) for c in ("low", "median", "high", "floor", "refused")])


@query("answerability", """WITH a AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS n_results, CASE WHEN text LIKE '%a%' AND conv_id % 11 = 0 THEN 'X' END AS unknown_company, 'c' || (conv_id % 4) AS company, conv_id % 3 AS cs, turn % 3 AS y FROM conversations)
SELECT conv_id, turn, CASE WHEN n_results = 0 THEN 'no_results' WHEN unknown_company IS NOT NULL THEN 'unknown_company' WHEN cs < conv_id % 4 THEN 'company_mismatch' WHEN y = 1 THEN 'year_mismatch' ELSE 'pass' END AS status FROM a""")
def answerability(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    asked = c.select(
        "conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 6).alias("n_results"), F.when(F.col("text").contains("a") & (F.col("conv_id") % 11 == 0), "X").alias("unknown_company"),
        F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("company"), F.transform(F.sequence(F.lit(0), F.col("conv_id") % 3), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("companies"),
        F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("2019"))).alias("years"), F.when(F.col("turn") % 3 == 1, F.array(F.lit("2018"))).otherwise(F.array(F.lit("2019"), F.lit("2020"))).alias("evidence_years"), F.lit("pass").alias("gate"),
    )
    return R.answerability(asked).select("conv_id", "turn", "status")


@query("citation_title", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Title ' || doc_id WHEN doc_id % 4 = 0 THEN source || ' News' WHEN doc_id % 4 = 1 THEN source || ' Earnings Call' || CASE WHEN doc_id % 3 > 0 THEN ' ' || (2018 + doc_id % 3) ELSE '' END || ' Q' || (1 + doc_id % 4)
  ELSE source || ' 10-K' || CASE WHEN doc_id % 3 > 0 THEN ' ' || (2018 + doc_id % 3) ELSE '' END END AS title FROM documents""")
def citation_title(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 5 == 0, F.concat(F.lit("Title "), i.cast("string"))).otherwise(" ").alias("display_title"), F.lit(None).cast("string").alias("company_name"), F.col("source").alias("company"), F.expr(_SRC).alias("source_type"),
        F.lit("10-K").alias("filing_type"), F.when(i % 3 > 0, 2018 + i % 3).alias("fiscal_year"), F.concat(F.lit("Q"), (1 + i % 4).cast("string")).alias("period_label"),
    )
    return rows.select("doc_id", R.citation_title().alias("title"))


@query("query_intents", r"""SELECT conv_id, turn, regexp_matches(text, '[0-9]') OR regexp_matches(lower(text), 'revenue|income|cash flow|gross margin|operating margin|operating income|eps|earnings per share|guidance|grew|growth|decline|decrease|increase|how much|what was|million|billion|%') AS figures,
regexp_matches(lower(text), 'why|risk|strategy|demand|outlook|guidance|commentary|management|discussion|explain|because') AS explanation FROM conversations""")
def query_intents(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.wants_figures(t).alias("figures"), X.wants_explanation(t).alias("explanation"))


@query("ts_rank_topk")
def ts_rank_topk(spark, sf_dir):
    from tessera.functions import fts

    q = item_terms(spark, sf_dir).select("item_id", F.array_join(F.sort_array(F.array_distinct("terms")), " ").alias("query_text"))
    found = fts.search(table(spark, sf_dir, "documents").select("doc_id", "text"), q, "doc_id", "item_id")
    return R.ranked(found, "item_id", [F.desc("bm25_raw"), F.asc("doc_id")]).where(F.col("rank") <= K).select("item_id", "doc_id", F.round("bm25_raw", 9).alias("bm25_raw"), "rank")


_NAMES = "n AS (SELECT n_nationkey AS k, lower(n_name) AS alias FROM nation)"


@query("question_companies", f"WITH {_NAMES} SELECT o_orderkey, 'T' || n.k AS ticker FROM orders LEFT JOIN n ON n.k = o_custkey % 30")
def question_companies(spark, sf_dir):
    from tessera.operators import queryparse as P

    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("name"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("k")).join(names, "k", "left")
    asked = o.select("o_orderkey", F.concat(F.lit("what were sales of "), F.lower(F.coalesce("n_name", F.lit("nobody"))), F.lit(" last year?")).alias("question"))
    return P.companies_named(asked, n, "o_orderkey", "question")
