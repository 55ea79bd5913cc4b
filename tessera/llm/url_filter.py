"""URL filter by a ratio of character language models (operator 7, DataFrame functions only).

Rules on host and path decide first, the longest that fits. All other URLs are judged by two smoothed variable-order
Markov models, one of the URLs that the rules accept and one of those they reject (the rules are the only labels). Each
symbol is judged after the longest context that its model has seen, up to ORDER symbols, blended with the shorter ones
by how varied each context has been (Witten-Bell). The verdict compares the length-normalised log-likelihood difference
with a threshold calibrated on rule-labelled URLs that the models have not seen.

Every distinct URL is cut to its sequences of ORDER + 1 symbols; each distinct sequence is judged once, in joins with
the counts of its ends, and the ratios are summed by URL in whole millionths, so no order of adding changes a score.
The work is linear in the length of a URL, and only a histogram of scores reaches the driver.

Defined cases: a null URL or one without :// has empty host and path and is judged as the empty string; repeated rows
are judged alike; an empty table gives an empty result; without labelled URLs every ratio is 0 and the verdict is allow;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, staged, table

#: (verdict, host, path): fits the host and its subdomains if the path starts so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Symbols: letters, any digit, separators, any other, end, start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/._-~$^"
A = len(ALPHABET)
#: Symbols of the longest context.
ORDER = 4
#: Share of accepted held-out URLs that may be blocked.
FALSE_BLOCK = 0.01
#: Ratios are whole parts of a nat, scores are whole parts of a nat per symbol.
PARTS, STEPS = 1_000_000, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path, rule and rule_verdict."""
    url = F.coalesce(F.col("url"), F.lit(""))
    out = pages.withColumn("host", F.translate(F.regexp_extract(url, SPLIT_URL, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, SPLIT_URL, 2))
    rule = verdict = None
    for kind, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def symbols(host: Column, path: Column) -> Column:
    """The string that the models read: start marks, host and path in the alphabet, end mark."""
    s = F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "0" * 9)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(s, r"[^a-z0/._-]", "~"), F.lit("$"))


def sequences(s: Column) -> Column:
    """The sequences of ORDER + 1 symbols in s, one for each symbol after the start marks."""
    return let(F.split(s, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - (ORDER + 1)), lambda i: F.concat(*[F.get(c, i + j) for j in range(ORDER + 1)])))


def train(counts: DataFrame, every: DataFrame) -> DataFrame:
    """(seq, ratio) of every sequence: log ratio of the rejected to the accepted model, in PARTS.

    counts: seq, n1, n0 (how often it stands in rejected and in accepted URLs); every: seq, each once.
    """
    out = every.select("seq", F.lit(1.0 / A).alias("p1"), F.lit(1.0 / A).alias("p0"))
    for order in range(ORDER + 1):
        # of each end of order + 1 symbols its counts, of each context of order symbols how often and how varied it is
        end = counts.groupBy(F.right("seq", F.lit(order + 1)).alias("end")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        end = staged(end, "url-ends")
        context = end.groupBy(F.substring("end", 1, order).alias("context")).agg(*[f(k) for k in "10" for f in (lambda k: F.sum(f"n{k}").alias(f"m{k}"), lambda k: F.count_if(F.col(f"n{k}") > 0).alias(f"t{k}"))])
        out = out.withColumn("end", F.right("seq", F.lit(order + 1))).withColumn("context", F.substring("end", 1, order))
        out = out.join(end, "end", "left").join(context, "context", "left").fillna(0, ["n1", "n0", "m1", "m0", "t1", "t0"])
        p = lambda k: F.when(F.col(f"m{k}") > 0, (F.col(f"n{k}") + F.col(f"t{k}") * F.col(f"p{k}")) / (F.col(f"m{k}") + F.col(f"t{k}"))).otherwise(F.col(f"p{k}"))
        out = out.select("seq", p("1").alias("p1"), p("0").alias("p0"))
    return out.select("seq", F.round((F.log("p1") - F.log("p0")) * PARTS).cast("long").alias("ratio"))


def judge(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, score (nats per symbol, in 1/STEPS) of every row."""
    parts = with_parts(pages.select(key, "url")).withColumn("s", symbols(F.col("host"), F.col("path")))
    parts = staged(parts.select(key, "host", "path", "rule", "rule_verdict", "s", F.unhex(F.md5("s")).alias("k")), "url-parts")
    held_out = F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long") % 5 == 0
    # URLs that are equal to the models are cut once; how often each stands in which class goes with it
    blocked, accepted = (F.count_if(F.coalesce(F.col("rule_verdict") == v, F.lit(False))) for v in ("block", "allow"))
    urls = parts.groupBy("k").agg(F.first("s").alias("s"), blocked.alias("blocked"), accepted.alias("accepted"))
    cut = staged(urls.select("k", "blocked", "accepted", held_out.alias("held_out"), F.explode(sequences(F.col("s"))).alias("seq")), "url-sequences")
    use = lambda c: F.sum(F.when(F.col("held_out"), 0).otherwise(F.col(c)))
    every = staged(cut.groupBy("seq").agg(use("blocked").alias("n1"), use("accepted").alias("n0")), "url-counts")
    trained = every.agg(F.sum("n1"), F.sum("n0")).first()
    if trained[0] and trained[1]:
        model = staged(train(every.where("n1 + n0 > 0"), every), "url-model")
    else:
        model = every.select("seq", F.lit(0).cast("long").alias("ratio"))
    mean = F.sum("ratio").cast("double") / (F.count("*") * (PARTS // STEPS)).cast("double")
    scores = staged(cut.join(model, "seq").groupBy("k", "held_out", "accepted").agg(F.floor(mean).cast("long").alias("score")), "url-scores")
    # the histogram has at most a few ten thousand bars: scores are bounded by the smoothing
    bars = scores.where("held_out AND accepted > 0").groupBy("score").agg(F.sum("accepted").alias("n")).orderBy(F.desc("score")).collect()
    allowed, threshold = int(FALSE_BLOCK * sum(b["n"] for b in bars)), 0
    for b in bars:
        allowed -= b["n"]
        if allowed < 0:
            threshold = max(0, b["score"])
            break
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return parts.join(scores.select("k", "score"), "k").select(key, "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """Every symbol of every URL by itself, blended from the longest context down by one expression."""
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(k, h, p)}'" for k, h, p in order) + " END"
    ends = lambda o: f"""e{o} AS (SELECT right(q, {o + 1}) AS e{o}, count(*) FILTER (rv = 'block')::DOUBLE AS n1_{o}, count(*) FILTER (rv = 'allow')::DOUBLE AS n0_{o} FROM tr GROUP BY 1),
c{o} AS (SELECT left(e{o}, {o}) AS x{o}, sum(n1_{o}) AS m1_{o}, sum(n0_{o}) AS m0_{o}, count(*) FILTER (n1_{o} > 0)::DOUBLE AS t1_{o}, count(*) FILTER (n0_{o} > 0)::DOUBLE AS t0_{o} FROM e{o} GROUP BY 1)"""  # noqa: E731

    def blend(k: str, o: int) -> str:
        lower = blend(k, o - 1) if o else f"(1.0::DOUBLE / {A}::DOUBLE)"
        return f"(CASE WHEN coalesce(m{k}_{o}, 0) > 0 THEN (coalesce(n{k}_{o}, 0) + t{k}_{o} * {lower}) / (m{k}_{o} + t{k}_{o}) ELSE {lower} END)"

    orders = range(ORDER + 1)
    joins = " ".join(f"LEFT JOIN e{o} ON e{o}.e{o} = right(q, {o + 1}) LEFT JOIN c{o} ON c{o}.x{o} = left(right(q, {o + 1}), {o})" for o in orders)
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(coalesce(url, ''), '{SPLIT_URL}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{SPLIT_URL}', 2) AS path
  FROM pages
), r AS (
  SELECT *, {case(lambda k, h, p: h + p)} AS rule, {case(lambda k, h, p: k)} AS rv,
         '{"^" * ORDER}' || regexp_replace(translate(host || path, '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0/._-]', '~', 'g') || '$' AS s
  FROM p
), t AS (
  SELECT *, ('0x' || substr(md5(s), 1, 8))::BIGINT % 5 = 0 AS held FROM r
), g AS (
  SELECT k, rv, held, substr(s, i, {ORDER + 1}) AS q FROM (SELECT k, rv, held, s, unnest(range(1, length(s) - {ORDER - 1})) AS i FROM t)
), tr AS (
  SELECT q, rv FROM g WHERE rv IS NOT NULL AND NOT held
), {", ".join(map(ends, orders))}, m AS (
  SELECT q, round((ln({blend('1', ORDER)}) - ln({blend('0', ORDER)})) * {PARTS})::BIGINT AS ratio FROM (SELECT DISTINCT q FROM g) {joins}
), sc AS (
  SELECT k, floor(sum(ratio)::DOUBLE / (count(*) * {PARTS // STEPS})::DOUBLE)::BIGINT AS score FROM g JOIN m USING (q) GROUP BY k
), h AS (
  SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS above, sum(count(*)) OVER () AS n FROM sc JOIN t USING (k) WHERE rv = 'allow' AND held GROUP BY score
), th AS (
  SELECT greatest(0, coalesce(max(score) FILTER (above > floor({FALSE_BLOCK}::DOUBLE * n)), 0)) AS t FROM h
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN score > (SELECT t FROM th) THEN 'block' ELSE 'allow' END) AS verdict, score FROM t JOIN sc USING (k)
"""


ORACLE = _oracle()
