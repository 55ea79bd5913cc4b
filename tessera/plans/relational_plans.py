"""Governance, merge, series and integrity queries over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import governance as G
from tessera.operators import integrity as I
from tessera.operators import relabel as L
from tessera.operators import merge as M
from tessera.operators import series as S
from tessera.plans.registry import query
from tessera.sources.tables import table

# stand-ins: orders are filings, line items chunks, customers companies
_FILINGS = """f AS (SELECT o_orderkey AS filing, o_custkey AS ticker, year(o_orderdate)::INTEGER AS fy, CASE WHEN o_orderstatus = 'P' THEN '10-K/A' ELSE '10-K' END AS form,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Q' || quarter(o_orderdate) END AS period FROM orders)"""
_CHUNKS = "c AS (SELECT l_orderkey AS filing, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS section FROM lineitem)"


def filings(spark, sf_dir) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("filing"), F.col("o_custkey").alias("ticker"), F.year(d).alias("fy"), F.when(F.col("o_orderstatus") == "P", "10-K/A").otherwise("10-K").alias("form"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("Q"), F.quarter(d).cast("string"))).alias("period"),
    )


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("filing"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("section")
    )


_AMENDED = "a AS (SELECT DISTINCT ticker, fy, period, section FROM f LEFT JOIN (SELECT DISTINCT filing, section FROM c WHERE section IS NOT NULL) s USING (filing) WHERE form LIKE '%/A')"


@query("amended_keys", f"WITH {_FILINGS}, {_CHUNKS}, {_AMENDED} SELECT * FROM a")
def amended_keys(spark, sf_dir):
    return G.amended_keys(filings(spark, sf_dir), chunks(spark, sf_dir), "filing", ["ticker", "fy", "period"], "section")


@query("supersession_antijoin", f"""WITH {_FILINGS}, {_CHUNKS}, {_AMENDED}, r AS (SELECT c.*, ticker, fy, form, period FROM c JOIN f USING (filing))
SELECT form, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM r WHERE form LIKE '%/A' OR NOT EXISTS (SELECT 1 FROM a WHERE a.ticker = r.ticker AND a.fy = r.fy AND (a.period IS NULL OR a.period = r.period)
  AND (a.section IS NULL OR r.section IS NULL OR a.section = r.section)) GROUP BY form""")
def supersession_antijoin(spark, sf_dir):
    f, c = filings(spark, sf_dir), chunks(spark, sf_dir)
    amended = G.amended_keys(f, c, "filing", ["ticker", "fy", "period"], "section")
    kept = G.not_superseded(c.join(f, "filing"), amended, ["ticker", "fy"], ["period"], ["section"])
    return kept.groupBy("form").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("lateral_first_child", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) l ON l_orderkey = o_orderkey AND n = 1")
def lateral_first_child(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.asc_nulls_last("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return G.first_child(table(spark, sf_dir, "orders").select("o_orderkey"), c, "o_orderkey", order).select("o_orderkey", "l_linenumber", "l_partkey")


@query("provenance_join", f"WITH {_FILINGS}, {_CHUNKS} SELECT filing, l_linenumber, l_partkey, form, fy, c_name FROM c JOIN f USING (filing) LEFT JOIN customer ON c_custkey = ticker WHERE l_extendedprice > 90000")
def provenance_join(spark, sf_dir):
    c = chunks(spark, sf_dir).where("l_extendedprice > 90000")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), "c_name")
    return c.join(filings(spark, sf_dir), "filing").join(names, "ticker", "left").select("filing", "l_linenumber", "l_partkey", "form", "fy", "c_name")


@query("context_window", "WITH a AS (SELECT o_orderkey, 3 AS anchor FROM orders WHERE o_totalprice > 250000) SELECT l_orderkey, l_linenumber, anchor, l_partkey, l_extendedprice FROM lineitem JOIN a ON l_orderkey = o_orderkey AND l_linenumber BETWEEN anchor - 1 AND anchor + 1")
def context_window(spark, sf_dir):
    anchors = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(3).alias("anchor"))
    return G.context_window(table(spark, sf_dir, "lineitem"), anchors, "l_orderkey", "l_linenumber", 1).select("l_orderkey", "l_linenumber", "anchor", "l_partkey", "l_extendedprice")


@query("context_lookup", f"""WITH {_FILINGS}, {_CHUNKS}, {_AMENDED}, r AS (SELECT c.*, f.*, c.filing AS id FROM c JOIN f USING (filing) WHERE c.l_linenumber BETWEEN 1 AND 3 AND c.filing IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)),
w AS (SELECT *, form NOT LIKE '%/A' AND EXISTS (SELECT 1 FROM a WHERE a.ticker = r.ticker AND a.fy = r.fy AND (a.period IS NULL OR a.period = r.period) AND (a.section IS NULL OR r.section IS NULL OR a.section = r.section)) AS withheld FROM r)
SELECT id AS filing, l_linenumber, withheld, CASE WHEN NOT withheld THEN l_partkey::VARCHAR END AS text, CASE WHEN withheld THEN 'replaced by a later amendment of ' || ticker || ' ' || form || ' ' || fy END AS message FROM w""")
def context_lookup(spark, sf_dir):
    f = filings(spark, sf_dir).select("filing", F.col("ticker").cast("string").alias("company"), "form", F.col("fy").alias("fiscal_year"), F.col("period").alias("period_label"))
    c = chunks(spark, sf_dir).select("filing", "l_linenumber", F.col("l_partkey").cast("string").alias("text"), F.col("section").alias("section_name"))
    anchors = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("filing"), F.lit(2).alias("anchor"))
    return G.context_lookup(c, f, anchors, "filing", "l_linenumber", 1, "text").select("filing", "l_linenumber", "withheld", "text", "message")


@query("union_view", """SELECT 'document' AS source_type, doc_id AS id, coalesce(c_name, source) AS owner, length(text)::BIGINT AS n FROM documents LEFT JOIN customer ON c_custkey = doc_id
UNION ALL SELECT 'page', page_id, regexp_extract(url, '://([^/?#]+)', 1), length(html)::BIGINT FROM pages UNION ALL SELECT 'turn', conv_id, role, length(text)::BIGINT FROM conversations""")
def union_view(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    d = table(spark, sf_dir, "documents").join(names, "doc_id", "left")
    shape = lambda df, kind, key, owner, text: df.select(F.lit(kind).alias("source_type"), F.col(key).alias("id"), owner.alias("owner"), F.length(text).cast("long").alias("n"))
    out = shape(d, "document", "doc_id", F.coalesce("c_name", "source"), "text")
    out = out.unionByName(shape(table(spark, sf_dir, "pages"), "page", "page_id", F.regexp_extract("url", "://([^/?#]+)", 1), "html"))
    return out.unionByName(shape(table(spark, sf_dir, "conversations"), "turn", "conv_id", F.col("role"), "text"))


@query("key_universe_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation UNION SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region")
def key_universe_union(spark, sf_dir):
    keys = [("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("region", "r_regionkey")]
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


@query("filter_options", "SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR DESC) AS years FROM orders")
def filter_options(spark, sf_dir):
    listed = lambda c, asc=True: F.array_join(F.sort_array(F.collect_set(c), asc), ",")
    return table(spark, sf_dir, "orders").agg(listed("o_orderstatus").alias("statuses"), listed("o_orderpriority").alias("priorities"), listed(F.year("o_orderdate").cast("string"), False).alias("years"))


@query("coverage_summary", "SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS with_vector, count(*) FILTER (label IS NULL OR len(embedding) <> 64) AS incomplete, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS labels FROM embeddings")
def coverage_summary(spark, sf_dir):
    ok = F.size("embedding") == 64
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.count_if(ok).alias("with_vector"), F.count_if(F.col("label").isNull() | ~ok).alias("incomplete"), F.array_join(F.sort_array(F.collect_set(F.col("label").cast("string"))), ",").alias("labels"))


@query("gaps_and_islands", "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d) SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS length FROM i GROUP BY l_orderkey, g")
def gaps_and_islands(spark, sf_dir):
    return M.islands(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("section_in_effect", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM events")
def section_in_effect(spark, sf_dir):
    marker = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return S.in_effect(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], marker, "part").select("event_id", "part")


@query("dedup_keep_first", r"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    # texts meet by digest, so that the sort never moves them
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), 256).alias("k"))
    return M.latest(d, ["k"], [F.asc("doc_id")]).select("doc_id")


@query("infer_index", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS chunk_index FROM lineitem")
def infer_index(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", (F.row_number().over(w) - 1).alias("chunk_index"))


@query("upsert_merge", """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN c_custkey::VARCHAR ELSE upper(c_name) END AS c_name, CASE WHEN c_custkey % 21 = 0 THEN '' ELSE 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey + 1000000, 'added ' || c_custkey, 'NEW' FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN o.c_name IS NOT NULL AND n.c_name = n.c_custkey::VARCHAR THEN o.c_name ELSE coalesce(n.c_name, o.c_name) END AS c_name,
  CASE WHEN o.c_mktsegment IS NOT NULL AND n.c_mktsegment IN ('', 'unknown') THEN o.c_mktsegment ELSE coalesce(n.c_mktsegment, o.c_mktsegment) END AS c_mktsegment, o.c_acctbal
FROM customer o FULL JOIN n ON n.c_custkey = o.c_custkey""")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    new = old.where(k % 7 == 0).select(k, F.when(k % 14 == 0, k.cast("string")).otherwise(F.upper("c_name")).alias("c_name"), F.when(k % 21 == 0, "").otherwise("NEW").alias("c_mktsegment"))
    new = new.unionByName(old.where(k % 50 == 0).select((k + 1000000).alias("c_custkey"), F.concat(F.lit("added "), k.cast("string")).alias("c_name"), F.lit("NEW").alias("c_mktsegment")))
    keep = {"c_name": F.col("n.c_name") == F.col("n.c_custkey").cast("string"), "c_mktsegment": F.col("n.c_mktsegment").isin("", "unknown")}
    return M.upsert(old, new, ["c_custkey"], keep)


@query("prune_stale", "WITH t AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 7 = 0) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM t) OR l_linenumber <= 3")
def prune_stale(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parents = rows.where("l_orderkey % 7 = 0").select("l_orderkey").distinct()
    keep = parents.select("l_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("l_linenumber"))
    return M.prune(rows, keep, ["l_orderkey"], ["l_linenumber"])


@query("guarded_update", "SELECT o_orderkey, o_orderstatus AS old_o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice > 200000 AND o_orderstatus IS DISTINCT FROM 'P'")
def guarded_update(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 7 = 0").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "P").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return M.changes(old, new, ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "old_o_orderstatus", "o_orderstatus")


@query("last_write_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_write_wins(spark, sf_dir):
    return M.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("contiguity_check", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct, count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey")
def contiguity_check(spark, sf_dir):
    return M.contiguity(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1).select("l_orderkey", "n", "n_distinct", "contiguous")


@query("duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return M.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphan_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def orphan_rows(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return I.orphans(table(spark, sf_dir, "lineitem"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("parent_mismatch", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus IS DISTINCT FROM o_orderstatus OR year(l_shipdate) IS DISTINCT FROM year(o_orderdate)")
def parent_mismatch(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.year("o_orderdate").alias("o_year"))
    return I.mismatches(c, p, "l_orderkey", {"l_linestatus": "o_orderstatus", "year": "o_year"}).select("l_orderkey", "l_linenumber", "l_partkey")


@query("accession_collisions", "SELECT o_custkey, year(o_orderdate)::INTEGER AS fy, string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS accessions FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderkey) > 1")
def accession_collisions(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("a"))
    return g.where(F.size("a") > 1).select("o_custkey", "fy", F.array_join(F.sort_array("a"), ",").alias("accessions"))


_CHECKS = {
    "duplicate_orders": "SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1",
    "orphan_orders": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "orphan_lines": "SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "duplicate_lines": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "null_vectors": "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64",
    "blank_texts": "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) = ''",
    "numeric_names": "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^[0-9]+$')",
    "unlabelled_ids": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
}


@query("quality_report", " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) AS observed, 0::BIGINT AS expected, count(*) = 0 AS passed FROM ({q})" for n, q in _CHECKS.items()))
def quality_report(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return I.report([
        I.check("duplicate_orders", M.duplicate_groups(t("orders"), ["o_orderkey"])),
        I.check("orphan_orders", I.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey")),
        I.check("orphan_lines", I.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey")),
        I.check("duplicate_lines", M.duplicate_groups(t("lineitem"), ["l_orderkey", "l_linenumber"])),
        I.check("null_vectors", t("embeddings").where(F.col("embedding").isNull() | (F.size("embedding") != 64))),
        I.check("blank_texts", t("documents").where(F.trim(F.coalesce("text", F.lit(""))) == "")),
        I.check("numeric_names", t("customer").where(F.col("c_name").rlike("^[0-9]+$"))),
        I.check("unlabelled_ids", I.orphans(t("labels"), t("documents"), "doc_id", "doc_id")),
    ])


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_stats", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _TABLES))
def table_stats(spark, sf_dir):
    return I.table_counts({n: table(spark, sf_dir, n) for n in _TABLES})


#: Values below it are no measurement, so days without a higher one are gaps that the fills close.
LEAST_VALUE = 300.0
_DAILY = f"d AS (SELECT event_type, ts::DATE AS day, avg(CASE WHEN value >= {LEAST_VALUE} THEN value END) AS value FROM events GROUP BY ALL HAVING max(value) >= {LEAST_VALUE}), sp AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY event_type), j AS (SELECT sp.event_type, sp.day, value FROM sp LEFT JOIN d ON d.event_type = sp.event_type AND d.day = sp.day)"


def daily_means(spark, sf_dir) -> DataFrame:
    measured = F.when(F.col("value") >= LEAST_VALUE, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg(measured).alias("value")).where("value IS NOT NULL")


def _fill(fn, frame):
    return f"WITH {_DAILY} SELECT event_type, day::VARCHAR AS day, round(v, 6) AS value FROM (SELECT event_type, day, {fn}(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN {frame}) AS v FROM j) WHERE v IS NOT NULL"


@query("macro_ffill", _fill("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def macro_ffill(spark, sf_dir):
    return S.daily(daily_means(spark, sf_dir), "event_type", "day", "value").select("event_type", F.col("day").cast("string").alias("day"), F.round("value", 6).alias("value"))


@query("macro_bfill", _fill("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def macro_bfill(spark, sf_dir):
    return S.daily(daily_means(spark, sf_dir), "event_type", "day", "value", "bfill").select("event_type", F.col("day").cast("string").alias("day"), F.round("value", 6).alias("value"))


_TYPES = ["signup", "error", "click", "view", "purchase"]


@query("macro_pivot", "WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS value FROM events GROUP BY ALL) SELECT day::VARCHAR AS day, " + ", ".join(f"round(max(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in _TYPES) + " FROM d GROUP BY day")
def macro_pivot(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return S.wide(d, "event_type", "day", "value", _TYPES).select(F.col("day").cast("string").alias("day"), *[F.round(t, 6).alias(t) for t in _TYPES])


@query("financials_merge", """WITH q AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS total_revenue, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS revenue, count(*) AS n FROM orders GROUP BY ALL),
u AS (SELECT period, CASE WHEN right(period, 1) = '1' THEN NULL ELSE total_revenue END AS total_revenue, revenue, n FROM q)
SELECT period, coalesce(total_revenue, revenue) AS revenue, n FROM u""")
def financials_merge(spark, sf_dir):
    d = F.col("o_orderdate")
    period = F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    total = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    q = table(spark, sf_dir, "orders").groupBy(period.alias("period")).agg(total("F").alias("total_revenue"), total("O").alias("revenue"), F.count("*").alias("n"))
    q = q.withColumn("total_revenue", F.when(F.right("period", F.lit(1)) != "1", F.col("total_revenue")))
    # statements arrive with items as rows and periods as columns; here they are unpivoted and merged on the period
    long = S.long(q.select("period", "total_revenue", "revenue"), ["period"], "item", "value").where("value IS NOT NULL")
    wide = long.groupBy("period").pivot("item", ["total_revenue", "revenue"]).agg(F.first("value"))
    items = S.first_of(wide, {"revenue": ["total_revenue", "revenue"]})
    return wide.select("period", items["revenue"].alias("revenue")).join(q.select("period", "n"), "period")


@query("fiscal_year_period", """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form, CASE o_custkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 1 ELSE 6 END AS m, CASE o_custkey % 3 WHEN 0 THEN 31 WHEN 1 THEN 10 ELSE 30 END AS e FROM orders),
p AS (SELECT *, CASE WHEN make_date(year(d), m, e) < d THEN make_date(year(d), m, e) ELSE make_date(year(d) - 1, m, e) END AS prior FROM o)
SELECT o_orderkey, (CASE WHEN month(d) = 1 AND day(d) <= 14 AND (m = 12 OR (m = 1 AND e <= 14)) THEN year(d) - 1 WHEN form = '10-K' THEN year(d) WHEN month(d) > m OR (month(d) = m AND day(d) > e) THEN year(d) + 1 ELSE year(d) END)::INTEGER AS fy,
 greatest(1, least(4, round_even((d - prior) / 91.0, 0)))::INTEGER AS quarter FROM p""")
def fiscal_year_period(spark, sf_dir):
    k = F.col("o_custkey") % 3
    month, day = F.when(k == 0, 12).when(k == 1, 1).otherwise(6), F.when(k == 0, 31).when(k == 1, 10).otherwise(30)
    d = F.to_date("o_orderdate")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.fiscal_year(d, form, month, day).alias("fy"), S.fiscal_quarter(d, month, day).alias("quarter"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("denormalised_view", "SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def denormalised_view(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n", F.round("b", 2).alias("balance"))


@query("identity_digest", "SELECT n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS digest FROM nation")
def identity_digest(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", I.row_digest(["n_nationkey", "n_name", "n_regionkey"]).alias("digest"))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
_LIMBS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)" for i in range(8))


@query("content_digest", f"SELECT l_returnflag, l_linestatus, count(*) AS n_rows, sha256(concat_ws(',', count(*), {_LIMBS})) AS digest FROM (SELECT *, sha256(concat_ws('|', {', '.join(_LINE)})) AS h FROM lineitem) GROUP BY ALL")
def content_digest(spark, sf_dir):
    return I.content_digest(table(spark, sf_dir, "lineitem"), _LINE, ["l_returnflag", "l_linestatus"])


@query("digest_update", f"SELECT l_linestatus, count(*) AS n_rows, sha256(concat_ws(',', count(*), {_LIMBS})) AS digest FROM (SELECT *, sha256(concat_ws('|', {', '.join(_LINE)})) AS h FROM lineitem WHERE l_linenumber <> 2) GROUP BY ALL")
def digest_update(spark, sf_dir):
    """The digest of a table after rows came and went, from the states of what it was and of these rows."""
    line, by = table(spark, sf_dir, "lineitem"), ["l_linestatus"]
    part = lambda cond: I.state(line.where(cond), _LINE, by)
    return I.finished(I.merged(I.merged(part("l_linenumber <= 4"), part("l_linenumber > 4"), by), part("l_linenumber = 2"), by, -1))


@query("corpus_diff", "SELECT 'old' AS side, count(*) AS n FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END FROM orders) UNION ALL SELECT 'new', count(*) FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)")
def corpus_diff(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = old.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "P").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return I.differences(old, new)


@query("smoke_fraction", "SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT % 10000 / 10000.0)::DOUBLE AS fraction FROM documents")
def smoke_fraction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.smoke_fraction(F.col("doc_id").cast("string")).alias("fraction"))


@query("latency_p95", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, max(value) FILTER (n = ceil(0.95 * c)) AS p95, round(median(value), 6) AS p50 FROM r GROUP BY event_type")
def latency_p95(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.round(F.median("value"), 6).alias("p50"))


@query("manifest_check", "SELECT l_returnflag, name AS check_name, count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 1) = 0 AS passed FROM lineitem, (SELECT unnest(['digest', 'n_rows']) AS name) GROUP BY ALL")
def manifest_check(spark, sf_dir):
    """A manifest that was written before some rows of one group came."""
    line, by = table(spark, sf_dir, "lineitem"), ["l_returnflag"]
    return I.manifest_errors(I.content_digest(line.where("NOT (l_returnflag = 'R' AND l_linenumber = 1)"), _LINE, by), line, _LINE, by)


# filings stand for orders, their chunks for lines; sections and texts follow from the keys
_LABEL = "CASE l_partkey % 5 WHEN 0 THEN 'Defaults upon Senior Securities' WHEN 1 THEN 'Mine Safety Disclosures' WHEN 2 THEN 'Risk Factors' WHEN 3 THEN 'MD&A' ELSE 'Defaults upon Senior Securities' END"
_SAYS = "CASE l_suppkey % 6 WHEN 0 THEN 'our  Market Risk is' WHEN 1 THEN 'of senior securities' WHEN 2 THEN 'disclosure controls' WHEN 3 THEN 'the Federal Mine Act' ELSE 'nothing' END"
_CHUNK = f"c AS (SELECT l_orderkey AS filing, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, {_LABEL} AS section, {_SAYS} AS says FROM lineitem)"


@query("section_relabel", f"""WITH {_CHUNK}, a AS (SELECT filing, min(i) AS second FROM c WHERE section = 'Risk Factors' GROUP BY filing),
g AS (SELECT *, i - row_number() OVER (PARTITION BY filing, section ORDER BY i) AS island FROM c WHERE section LIKE 'D%' OR section LIKE 'Mine%'),
r AS (SELECT filing, section, min(i) AS first, max(i) AS last, bool_or(says = CASE WHEN section LIKE 'D%' THEN 'our  Market Risk is' ELSE 'disclosure controls' END) AS p1,
  bool_or(says = CASE WHEN section LIKE 'D%' THEN 'of senior securities' ELSE 'the Federal Mine Act' END) AS p2 FROM g GROUP BY filing, section, island),
b AS (SELECT r.*, second, CASE WHEN p1 AND p2 THEN CASE WHEN second IS NULL THEN 'mixed:no-anchor-default-part-i' ELSE 'mixed:position-tiebreak' END WHEN p1 THEN 'content:part-i'
  WHEN p2 THEN 'content:part-ii' WHEN last < second THEN 'position:before-part-ii' WHEN first >= second THEN 'position:after-part-ii' ELSE 'unresolved' END AS basis FROM r LEFT JOIN a USING (filing)),
n AS (SELECT *, basis LIKE '%-part-i' OR basis IN ('content:part-i', 'position:before-part-ii') OR (basis LIKE '%tiebreak' AND last < second) AS renamed FROM b)
SELECT c.filing, c.i::INTEGER AS i, CASE WHEN coalesce(renamed, false) THEN CASE WHEN c.section LIKE 'D%' THEN 'Quantitative and Qualitative Disclosures about Market Risk' ELSE 'Controls and Procedures' END ELSE c.section END AS section
FROM c LEFT JOIN n ON n.filing = c.filing AND n.section = c.section AND c.i BETWEEN n.first AND n.last""")
def section_relabel(spark, sf_dir):
    return L.renamed(report_chunks(spark, sf_dir), "filing", "i", "section", "says", order=_PLACED)


_PLACED = ("l_linenumber", "l_partkey", "l_suppkey")


def report_chunks(spark, sf_dir):
    """Labels and texts are made after the chunks are numbered, so that keys alone are dealt and sorted."""
    place = F.row_number().over(W.partitionBy("filing").orderBy(*[F.col(c).asc_nulls_last() for c in _PLACED]))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("filing"), *_PLACED).withColumn("i", place)
    return rows.withColumns({"section": F.expr(_LABEL), "says": F.expr(_SAYS)})


@query("set_equality", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' ELSE 'different' END AS reason FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def set_equality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    found = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "?").otherwise(F.col("o_orderstatus")))
    return I.full_match(o, found, "o_orderkey", ["o_orderstatus"])


@query("sector_class", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'energy' WHEN p_partkey % 3 = 1 THEN 'banking' END AS sector FROM part")
def sector_class(spark, sf_dir):
    from tessera.functions.records import sector

    k = F.col("p_partkey") % 3
    industry = F.when(k == 0, "Oil & Gas refining").when(k == 1, "Regional Banks, retail").otherwise("Misc")
    return table(spark, sf_dir, "part").select("p_partkey", sector(F.lit(None).cast("string"), industry).alias("sector"))
