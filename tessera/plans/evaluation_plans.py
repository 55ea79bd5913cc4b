"""Evaluation and claim queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import claims as C
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.plans.registry import query
from tessera.plans.retrieval_plans import _TERMS, sparse_best
from tessera.sources.tables import table


def _norm(c: str) -> str:
    pair = "'([0-9]),([0-9])', '\\1\\2', 'g'"
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), {pair}), {pair}), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(c: str, clean: bool = True) -> str:
    t = _norm(c)
    if clean:
        for p in X.BOILERPLATE:
            t = f"replace({t}, '{p}', ' ')"
    stop = " AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")" if clean else ""
    return f"list_distinct(list_filter(string_split({t}, ' '), lambda x: x <> ''{stop}))"


_SETS = f"dt AS (SELECT doc_id, {_tokens('text')} AS t FROM documents), gt AS (SELECT item_id, {_tokens('text')} AS t FROM benchmark)"
_PAIRS = f"""{_SETS}, g AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM gt), d AS (SELECT doc_id, unnest(t) AS token FROM dt),
o AS (SELECT item_id, doc_id, count(*) / n AS overlap FROM d JOIN g USING (token) GROUP BY item_id, doc_id, n)"""


@query("token_overlap", f"WITH {_PAIRS} SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.2")
def token_overlap(spark, sf_dir):
    o = E.all_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", "doc_id", 0.2)
    return o.select("item_id", "doc_id", F.round("overlap", 6).alias("overlap"))


_RETRIEVED = f"{_TERMS}, r AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 10)"


def retrieved(spark, sf_dir):
    return sparse_best(spark, sf_dir, 10).select("item_id", "doc_id", "rank")


def _overlaps(name: str, clean: bool) -> str:
    return f"""{name} AS (SELECT r.item_id, r.doc_id, rank, CASE WHEN len(g.t) > 0 THEN len(list_intersect(d.t, g.t)) / len(g.t) ELSE 0.0 END AS overlap
  FROM r JOIN (SELECT doc_id, {_tokens('text', clean)} AS t FROM documents) d USING (doc_id) JOIN (SELECT item_id, {_tokens('text', clean)} AS t FROM benchmark) g USING (item_id))"""


def overlaps(spark, sf_dir, clean=True):
    return E.with_overlap(retrieved(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", "doc_id", clean)


_LEVELS = "(SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold) th"


@query("overlap_first_hit", f"WITH {_RETRIEVED}, {_overlaps('v', True)} SELECT item_id, threshold, min(CASE WHEN overlap >= threshold THEN rank END)::INTEGER AS hit_rank FROM v, {_LEVELS} GROUP BY item_id, threshold")
def overlap_first_hit(spark, sf_dir):
    return E.first_hits(overlaps(spark, sf_dir), "item_id")


def _grid(v: str) -> str:
    return f"""SELECT '{v}' AS variant, gate, threshold, k, round(round(avg(f), 9), 4) AS recall, round(round(avg(f), 9), 4) AS hit, round(round(avg(CASE WHEN f > 0 THEN 1.0::DOUBLE / h ELSE 0 END), 9), 4) AS mrr FROM (
  SELECT gate, threshold, k, h, (CASE WHEN h <= k THEN 1 ELSE 0 END)::DOUBLE AS f FROM (
    SELECT item_id, gate, threshold, min(CASE WHEN overlap >= threshold AND (NOT gate OR coalesce(source = 'src' || (item_id % 20), false)) THEN rank END) AS h
    FROM {v} JOIN documents USING (doc_id), {_LEVELS}, (SELECT unnest([true, false]) AS gate) GROUP BY ALL), (SELECT unnest([1, 3, 5, 10])::INTEGER AS k)) GROUP BY gate, threshold, k"""


@query("recall_mrr_grid", f"WITH {_RETRIEVED}, {_overlaps('clean', True)}, {_overlaps('raw', False)} {_grid('clean')} UNION ALL {_grid('raw')}")
def recall_mrr_grid(spark, sf_dir):
    """Thresholds by token variants by gate: an item's provenance is its source."""
    docs = table(spark, sf_dir, "documents")
    passes = F.col("source") == F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    found = retrieved(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id")
    both = E.with_overlaps(found, docs, table(spark, sf_dir, "benchmark"), "item_id", "doc_id", {"clean": True, "raw": False})
    long = both.unpivot(["item_id", "doc_id", "rank", "source"], ["clean", "raw"], "variant", "overlap")
    return E.metric_grid(E.first_hits(E.gated(long, passes), "item_id", by=("variant", "gate")), "item_id", by=("variant", "gate"))


_BEST = f"WITH {_PAIRS}, b AS (SELECT item_id, coalesce(max(overlap), 0.0)::DOUBLE AS best FROM benchmark LEFT JOIN o USING (item_id) GROUP BY item_id)"
_CEILING = f"{_BEST} SELECT threshold, count(*) FILTER (best >= threshold) AS reachable, count(*) AS spans, round(avg(best), 4) AS mean, round(median(best), 4) AS median, round(min(best), 4) AS low, round(max(best), 4) AS high FROM b, {_LEVELS} GROUP BY threshold"


def best_overlap(spark, sf_dir):
    return E.best_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", "doc_id")


@query("oracle_ceiling", _CEILING)
def oracle_ceiling(spark, sf_dir):
    return E.ceiling(best_overlap(spark, sf_dir))


@query("gate_diagnostics", f"WITH {_RETRIEVED}, p AS (SELECT item_id, count(*) FILTER (source = 'src' || (item_id % 20)) AS n FROM r JOIN documents USING (doc_id) GROUP BY item_id) SELECT round(avg(n), 4) AS mean_passing, count(*) FILTER (n = 0) AS zero_passing, count(*) AS queries FROM p")
def gate_diagnostics(spark, sf_dir):
    r = retrieved(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return E.gate_diagnostics(r, "item_id", F.col("source") == F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))


@query("paired_decision", f"""WITH {_RETRIEVED}, {_overlaps('v', True)}, h AS (SELECT item_id, min(CASE WHEN overlap >= 0.5 THEN rank END) AS h FROM v GROUP BY item_id),
p AS (SELECT round(avg((coalesce(h, 99) <= 5)::INT), 4) AS old_recall, round(avg((coalesce(h, 99) <= 10)::INT), 4) AS new_recall FROM h),
l AS (SELECT quantile_disc(value, 0.95) FILTER (event_id % 2 = 0) AS old_p95, quantile_disc(value, 0.95) FILTER (event_id % 2 = 1) AS new_p95 FROM events),
i AS (SELECT item_id, count(*) FILTER (source = 'src' || (item_id % 20) AND rank <= 5) AS o, count(*) FILTER (source = 'src' || (item_id % 20)) AS n, max((overlap >= 0.5 AND rank <= 5)::INT) AS ro, max((overlap >= 0.5)::INT) AS rn
  FROM v JOIN documents USING (doc_id) GROUP BY item_id),
z AS (SELECT count(*) FILTER (o = 0) AS old_zero, count(*) FILTER (n = 0) AS new_zero, sum(ro)::BIGINT AS old_reachable, sum(rn)::BIGINT AS new_reachable FROM i)
SELECT old_recall, new_recall, old_zero AS old_zero_passing, new_zero AS new_zero_passing, old_reachable, new_reachable, new_recall >= 0.25 AS recall_ok, new_zero <= old_zero AS provenance_ok, new_reachable >= old_reachable AS ceiling_ok,
new_p95 <= 1.5 * old_p95 AS latency_ok, new_recall >= 0.25 AND new_zero <= old_zero AND new_reachable >= old_reachable AND new_p95 <= 1.5 * old_p95 AS accepted FROM p, l, z""")
def paired_decision(spark, sf_dir):
    recall = lambda k: F.round(F.avg(F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("double")), 4)
    p95 = lambda odd: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_id % 2 = {odd})")
    b = table(spark, sf_dir, "events").agg(p95(0).alias("old_p95"), p95(1).alias("new_p95"))
    passes = F.col("source") == F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    rows = overlaps(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    per = rows.groupBy("item_id").agg(
        F.count_if(passes & (F.col("rank") <= 5)).alias("o"), F.count_if(passes).alias("n"), F.min(F.when(F.col("overlap") >= 0.5, F.col("rank"))).alias("hit_rank"), F.max(((F.col("overlap") >= 0.5) & (F.col("rank") <= 5)).cast("int")).alias("ro"), F.max((F.col("overlap") >= 0.5).cast("int")).alias("rn")
    )
    c = per.agg(recall(5).alias("old_recall"), recall(10).alias("new_recall"), F.count_if(F.col("o") == 0).alias("old_zero_passing"), F.count_if(F.col("n") == 0).alias("new_zero_passing"), F.sum("ro").alias("old_reachable"), F.sum("rn").alias("new_reachable"))
    pair = c.join(F.broadcast(b))
    cols = ["old_recall", "new_recall", "old_zero_passing", "new_zero_passing", "old_reachable", "new_reachable", "recall_ok", "provenance_ok", "ceiling_ok", "latency_ok", "accepted"]
    return E.paired_decision(pair).select(*cols)


@query("holdout_select", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND doc_id % 4 = 0)")
def holdout_select(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    return E.held_out(d, labels, d.join(labels.where("toxic = 1 AND doc_id % 4 = 0"), "doc_id"), "doc_id", "source").select("doc_id", "source")


# an answer about each order: a total with its thousands apart, and the evidence that it cites
@query("citation_scoring", """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 10 = 0 AS abstained, o_orderkey % 7 = 0 AS due, list_distinct([1 + o_custkey % 5, 1 + o_orderkey % 4]) AS cited FROM orders),
s AS (SELECT k, abstained = due AS answerability_ok, NOT abstained AND k % 3 <> 0 AS correct, NOT abstained AND list_max(cited) <= 4 AS citations_ok,
  CASE WHEN abstained THEN 0.0 ELSE len(list_filter(cited, lambda c: c <= 2)) / len(cited) END::DOUBLE AS support_precision, abstained, due FROM a)
SELECT k AS id, answerability_ok, correct, citations_ok, round(support_precision, 6) AS support_precision, CASE WHEN due THEN abstained ELSE NOT abstained AND correct AND citations_ok END AS end_to_end FROM s""")
def citation_scoring(spark, sf_dir):
    k, first, second = F.col("o_orderkey"), 1 + F.col("o_custkey") % 5, 1 + F.col("o_orderkey") % 4
    told = F.concat(F.lit("The total was $"), F.format_number(k + 0.5, 1), F.lit(" in all ["), first.cast("string"), F.lit(", "), second.cast("string"), F.lit("] and no more ["), first.cast("string"), F.lit("]."))
    wanted = (k + F.when(k % 3 == 0, 1).otherwise(0)).cast("string")
    answers = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 10 == 0, "").otherwise(told).alias("answer"), (k % 10 == 0).alias("abstained"), (k % 7 == 0).alias("should_abstain"), F.array(F.lit("nothing of the kind")).alias("accepted"),
        F.array(F.concat(wanted, F.lit(".5"))).alias("expected"), F.lit(4).alias("n_chunks"), F.array(F.lit(1), F.lit(2)).alias("supporting"),
    )
    return E.answer_scores(answers).select("id", "answerability_ok", "correct", "citations_ok", F.round("support_precision", 6).alias("support_precision"), "end_to_end")


# benchmark cases stand for orders: what the evidence holds and what was said of it follow from the keys
@query("benchmark_scores", """WITH c AS (SELECT o_orderkey % 4 > 0 AS p, o_custkey % 5 = 0 AS n, ['supported', 'refuted', 'abstain'][1 + o_orderkey % 3] AS v, ['supported', 'refuted'][1 + o_custkey % 2] AS e FROM orders)
SELECT count(*) AS n_cases, count(*) FILTER (v <> 'abstain') AS answered, round(avg((p AND NOT n)::INT), 4) AS met, round(avg((p AND NOT n)::INT) FILTER (v <> 'abstain'), 4) AS met_answered, round(avg((v = e)::INT), 4) AS verdict_accuracy FROM c""")
def benchmark_scores(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda x, *names: F.element_at(F.array(*map(F.lit, names)), (1 + x % len(names)).cast("int"))
    cases = table(spark, sf_dir, "orders").select((k % 4 > 0).alias("p"), (c % 5 == 0).alias("n"), pick(k, "supported", "refuted", "abstain").alias("v"), pick(c, "supported", "refuted").alias("e"))
    return E.hint_scores(cases, "p", "n", "v", "e")


_CLAIMS = r"""n AS (SELECT conv_id, turn, trim(regexp_replace(translate(text, '“”‘’', '""'''''), '\s+', ' ', 'g')) AS t FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS piece FROM (SELECT conv_id, turn, string_split_regex(t, '[.;!?]\s+') AS x FROM n)),
c AS (SELECT conv_id, turn, i, unnest(range(1, len(y) + 1)) AS j, trim(unnest(y)) AS claim FROM (SELECT conv_id, turn, i, string_split_regex(trim(piece), '\s*,\s*(?:and/or|and|or)\s+') AS y FROM p)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(claim) ORDER BY i, j) AS n FROM c WHERE claim <> '' AND lower(claim) NOT IN ('and', 'or', 'and/or')),
s AS (SELECT conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j)::INTEGER AS idx, claim FROM o WHERE n = 1)"""


def split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return C.split_claims(c, "id")


@query("claim_split", f"WITH {_CLAIMS} SELECT id, idx, claim FROM s")
def claim_split(spark, sf_dir):
    return split(spark, sf_dir)


def _any(words):
    return "(" + " OR ".join(f"contains(lower(claim), '{w}')" for w in words) + ")"


_TYPE = f"CASE WHEN {_any(C.PREDICTION)} THEN 'prediction' WHEN regexp_matches(claim, '[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?') AND {_any(C.METRIC_NEAR_NUMBER)} THEN 'reported_numeric' " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in C.FAMILIES) + " ELSE 'narrative_disclosure' END"


@query("claim_types", f"WITH {_CLAIMS}, t AS (SELECT id, idx, claim, {_TYPE} AS kind FROM s) SELECT id, idx, kind, CASE WHEN kind = 'prediction' THEN 'watch_later' WHEN kind = 'opinion' THEN 'non_verifiable' ELSE 'check_now' END AS check_now, 'claim_' || substr(sha1('ACME::' || lower(trim(claim))), 1, 12) || '_' || lpad(idx::VARCHAR, greatest(2, length(idx::VARCHAR))::INT, '0') AS claim_id FROM t")
def claim_types(spark, sf_dir):
    t = split(spark, sf_dir).withColumn("kind", C.claim_type(F.col("claim")))
    return t.select("id", "idx", "kind", C.checkability(F.col("kind"), F.lit("ACME")).alias("check_now"), C.claim_id(F.col("claim"), F.lit("ACME"), F.col("idx")).alias("claim_id"))


@query("claim_numeric")
def claim_numeric(spark, sf_dir):
    found = C.numeric_bindings(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))
    p = C.primary(F.col("found"))
    return rows.select("doc_id", F.size("found").alias("n_numbers"), p["value"].alias("value"), p["unit"].alias("unit"))


def _listed(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _keywords(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in C.OVERLAP_STOP)
    return f"list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> '' AND x NOT IN ({stop})))"


_STRICT_TYPE = _TYPE.replace(" OR contains(lower(claim), 'k')", "")
# the turns hold no digits, so no claim has a number and words alone decide; a turn with one fails the comparison
_VERDICT = f"""WITH {_CLAIMS}, t AS (SELECT *, {_STRICT_TYPE} AS kind, lower(claim) AS low FROM s),
v AS (
  SELECT t.*, h.text, id || '/claim_' || substr(sha1('ACME::' || lower(trim(claim))), 1, 12) || '_' || lpad(idx::VARCHAR, greatest(2, length(idx::VARCHAR))::INT, '0') AS claim_id,
    CASE kind WHEN 'prediction' THEN 'watch_later' WHEN 'opinion' THEN 'non_verifiable' ELSE 'check_now' END AS todo,
    CASE WHEN {_listed('low', ['revenue', '营收'])} THEN 'revenue' WHEN {_listed('low', ['profit', '利润', 'net income'])} THEN 'profit' WHEN {_listed('low', ['margin', '毛利'])} THEN 'margin'
      WHEN {_listed('low', ['eps', '每股'])} THEN 'eps' WHEN contains(low, 'share') AND contains(low, 'repurchase') THEN 'share' WHEN contains(low, 'cash') AND contains(low, 'flow') THEN 'cash flow' END AS metric
  FROM t JOIN conversations h ON h.conv_id * 1000 + h.turn = t.id),
w AS (
  SELECT *, {_keywords('claim')} AS a, {_keywords('text')} AS b,
    todo <> 'check_now' OR metric IS NULL OR CASE metric {" ".join(f"WHEN '{m}' THEN {_listed('lower(text)', names)}" for m, names in C.METRICS)} ELSE contains(lower(text), metric) END AS usable FROM v),
x AS (SELECT *, usable AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) >= {C.SUPPORT_OVERLAP} * len(a) AS good FROM w)
SELECT claim_id, CASE todo WHEN 'non_verifiable' THEN 'non_verifiable' WHEN 'watch_later' THEN 'not_yet_decidable' ELSE CASE WHEN good THEN 'verified' ELSE 'insufficient_evidence' END END AS verdict,
  (todo = 'check_now' AND good)::BIGINT AS n_for, (todo = 'check_now' AND usable AND NOT good)::BIGINT AS n_against FROM x"""


@query("claim_verdict", _VERDICT)
def claim_verdict(spark, sf_dir):
    c = split(spark, sf_dir).select(F.col("id"), "claim", C.claim_type(F.col("claim"), loose_k=False).alias("kind"), C.claim_id(F.col("claim"), F.lit("ACME"), F.col("idx")).alias("hash"), "idx")
    c = c.withColumn("claim_id", F.concat_ws("/", F.col("id").cast("string"), F.col("hash"))).withColumn("found", C.numeric_bindings(F.col("claim")))
    claims = c.select("claim_id", "claim", C.checkability(F.col("kind"), F.lit("ACME")).alias("check"), C.metric(F.col("claim")).alias("metric"), C.comparator(F.col("claim")).alias("comparator"), C.primary(F.col("found"))["value"].alias("value"), F.lit(2024).alias("as_of_year"), "id")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit(2020).alias("fiscal_year"))
    return C.verify(claims, turns.withColumn("found", C.numeric_bindings(F.col("text"))), "id")


@query("gold_partition", "WITH i AS (SELECT doc_id FROM documents), c AS (SELECT doc_id FROM labels WHERE quality = 1), x AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM c) THEN 'both' ELSE 'neither' END AS reason FROM i WHERE (doc_id IN (SELECT doc_id FROM c)) = (doc_id IN (SELECT doc_id FROM x))")
def gold_partition(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return E.partition_errors(table(spark, sf_dir, "documents").select("doc_id"), labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id")


@query("requirement_manifest", "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def requirement_manifest(spark, sf_dir):
    return E.requirements(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"])[0]


@query("answer_rates", """WITH a AS (SELECT l_suppkey % 4 = 0 AS due_no, (l_suppkey % 4 = 0) <> (l_partkey % 10 = 0) AS abst, l_partkey % 3 <> 0 AS correct, l_linenumber <= 5 AS ok, (l_linenumber <= 3)::INT AS support FROM lineitem)
SELECT count(*) AS n, round(avg((due_no = abst)::INT), 4) AS answerability, round(avg(correct::INT) FILTER (NOT due_no AND NOT abst), 4) AS accuracy, round(avg(ok::INT) FILTER (NOT due_no AND NOT abst), 4) AS citation_validity,
round(avg(support) FILTER (NOT due_no AND NOT abst), 4) AS support_precision, round(avg(CASE WHEN due_no THEN abst::INT ELSE (NOT abst AND correct AND ok)::INT END), 4) AS end_to_end FROM a""")
def answer_rates(spark, sf_dir):
    """Each line of an order is an answer that states its price and cites one of five chunks."""
    price = F.format_string("%.2f", F.col("l_extendedprice").cast("double"))
    due_no = F.col("l_suppkey") % 4 == 0
    wrong = F.format_string("%.2f", F.col("l_extendedprice").cast("double") + 10_000_000.0)
    answers = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("The price was $"), price, F.lit(" ["), F.col("l_linenumber").cast("string"), F.lit("].")).alias("answer"), (due_no != (F.col("l_partkey") % 10 == 0)).alias("abstained"),
        due_no.alias("should_abstain"), F.array().cast("array<string>").alias("accepted"), F.array(F.when(F.col("l_partkey") % 3 == 0, wrong).otherwise(price)).alias("expected"),
        F.lit(5).alias("n_chunks"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("supporting"),
    )
    return E.answer_rates(E.answer_scores(answers))


@query("model_report", "SELECT round(avg((l_linenumber = l_quantity % 7)::INT), 4) AS pass_at_1, round(avg((l_discount > 0.035)::INT), 4) AS coverage, 0.0::DOUBLE AS mean_latency FROM lineitem WHERE false".replace(" WHERE false", "").replace("(l_linenumber = l_quantity % 7)", "(l_discount > 0.035 AND l_linenumber = l_quantity % 7)").replace("0.0::DOUBLE", "round(avg(l_tax), 4)"))
def model_report(spark, sf_dir):
    from tessera.functions.records import final_number

    l = table(spark, sf_dir, "lineitem")
    answer = F.when(F.col("l_discount") > 0.035, F.concat(F.lit("so 3 and then\n#### "), (F.col("l_quantity") % 7).cast("string")))
    return E.model_report(l.select(final_number(answer).alias("predicted"), F.col("l_linenumber").cast("double").alias("gold"), F.col("l_tax").alias("latency")))
