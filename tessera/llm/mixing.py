"""Mixing sources to target weights by Sainte-Lague apportionment (operator 2, DataFrame functions only).

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words; a source stops at twice its size and the excess goes to the others by weight.

Blocks of equal word counts are allotted to the sources by highest quotients w / (2a + 1), then a
source's blocks to its shards by the same rule. A shard's documents stand in seeded order on a line
that holds them twice. Its quota picks blocks of the first pass at even seeded distances; what goes
beyond one whole pass picks from the second. A document's share is the overlap of its two places
with the blocks picked, a closed form, so no block is ever a row and no document exceeds twice its size.

Defined cases: null or blank texts have size 0 and take 0; a null source is a source of its own and
comes last; repeated rows each take their own share; an empty table gives an empty mix; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import staged, table, words

#: Words of a block.
BLOCK = 16
#: Documents of a shard on average, and the most shards of a source; shards grow beyond that, as rows without texts.
SHARD_DOCS, MAX_SHARDS = 256, 65536
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 17


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """Word count, source key (nulls last) and seeded order of every row."""
    hashed = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        "doc_id", *keep,
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("skey"),
        F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long").alias("ord"),
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: size, documents, weight, target. The windows run over sources, not rows."""
    by_key, all_rows = W.orderBy("skey"), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    at = F.row_number().over(by_key) % len(WEIGHTS)
    s = s.withColumn("weight", F.when(at == 1, WEIGHTS[0]).when(at == 2, WEIGHTS[1]).otherwise(WEIGHTS[2]).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * float(MAX_REPEAT)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "skey")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) * SHARE - before) / rest)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    return s.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("skey", "source_size", "docs", "target")


def sainte_lague(parties: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds quota: the column seats (equal within a group) shared in proportion to weight.

    Seats that a party is sure to get are given at once; only the last few of each party, at most about
    three per party, are ranked by quotient. So the work follows the parties, not the seats.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    n, total = F.count("*").over(g), F.sum(weight).over(g)
    p = parties.withColumn("_n", n).withColumn("_t", total)
    share = lambda off: F.when(F.col("_t") > 0, F.col(weight) * (F.col(seats) + off * F.col("_n") / 2) / F.col("_t")).otherwise(0.0)
    p = p.withColumn("_base", F.greatest(F.lit(0), F.floor(share(-1) + 0.5) - 1).cast("long")).withColumn("_top", F.floor(share(1) + 0.5).cast("long") + 1)
    p = p.withColumn("_left", F.col(seats) - F.sum("_base").over(g))
    last = p.withColumn("_a", F.explode(F.sequence(F.col("_base") + 1, F.col("_top"))))
    order = g.orderBy(F.desc(F.col(weight) / (2 * F.col("_a") - 1)), key, "_a")
    last = last.withColumn("_won", (F.row_number().over(order) <= F.col("_left")).cast("long"))
    return last.groupBy(*parties.columns).agg((F.max("_base") + F.sum("_won")).alias("quota"))


def _picked(y: str) -> str:
    """SQL: words among the first y of a shard's line that lie in picked blocks."""
    def part(x: str, q: str, m: str, o: str) -> str:
        upto = lambda b: f"((({b}) * {q} + {o}) div {m})"
        b = f"({x}) div {BLOCK}"
        return f"({BLOCK} * {upto(b)} + ({upto(b + ' + 1')} - {upto(b)}) * (({x}) % {BLOCK}))"

    return f"(CASE WHEN {y} <= m1 * {BLOCK} THEN {part(y, 'q1', 'm1', 'o1')} ELSE {BLOCK} * q1 + {part(f'{y} - m1 * {BLOCK}', 'q2', 'm2', 'o2')} END)"


def mix(sized: DataFrame) -> DataFrame:
    """sized (see sizes) with source_size, target and taken."""
    sources = source_targets(sized)
    sources = sainte_lague(sources.withColumn("seats", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / BLOCK).cast("long")), [], "skey", "target", "seats")
    sources = sources.withColumn("shards", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("docs") / SHARD_DOCS)).cast("long")).select("skey", "source_size", "target", F.col("quota").alias("source_quota"), "shards")
    sources = staged(sources, "mix-sources")
    placed = sized.join(sources, "skey").withColumn("shard", F.col("ord") % F.col("shards"))
    shards = placed.groupBy("skey", "source_quota", "shard").agg(F.sum("size").alias("line")).where("line > 0")
    shards = sainte_lague(shards, ["skey"], "shard", "line", "source_quota").selectExpr(
        "skey", "shard", "line", f"(line + {BLOCK - 1}) div {BLOCK} AS m1", f"({MAX_REPEAT} * line + {BLOCK - 1}) div {BLOCK} AS m", "quota"
    ).selectExpr("skey", "shard", "line", "m1", "greatest(m - m1, 1) AS m2", "least(quota, m1) AS q1", "least(greatest(quota - m1, 0), m - m1) AS q2")
    shards = shards.selectExpr("*", f"(shard * 7919 + {SEED}) % m1 AS o1", f"(shard * 104729 + {SEED}) % m2 AS o2")
    line = W.partitionBy("skey", "shard").orderBy("ord", "doc_id", "size")
    at = placed.withColumn("p", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    taken = f"({_picked('(p + size)')} - {_picked('p')} + {_picked('(line + p + size)')} - {_picked('(line + p)')})"
    return at.join(shards, ["skey", "shard"], "left").withColumn("taken", F.coalesce(F.expr(taken), F.lit(0)).cast("long"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = staged(sizes(table(spark, sf_dir, "documents")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def _oracle() -> str:
    """Every block that a document lies in is a row here, picked or not; the operator works with sums in closed form."""
    return rf"""
WITH d AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ord
  FROM documents
), s0 AS (
  SELECT skey, sum(size)::DOUBLE AS source_size, count(*) AS docs FROM d GROUP BY skey
), s1 AS (
  SELECT *, 2 * source_size AS cap, CASE row_number() OVER (ORDER BY skey) % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s0
), s2 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), s3 AS (
  SELECT *, least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) AS target FROM s2
), seats AS (
  SELECT round(sum(target) / {BLOCK})::BIGINT AS n, sum(target) AS total, count(*) AS parties FROM s3
), sq AS (
  SELECT skey, a, row_number() OVER (ORDER BY target / (2 * a - 1) DESC, skey, a) AS r
  FROM (SELECT skey, target, unnest(range(1, floor(target * (n + parties / 2.0::DOUBLE) / total + 0.5)::BIGINT + 2)) AS a FROM s3, seats)
), s4 AS (
  SELECT s3.skey, source_size, target, least(65536, ceil(docs / {SHARD_DOCS}.0))::BIGINT AS shards,
         (SELECT count(*) FROM sq, seats WHERE sq.skey = s3.skey AND r <= n) AS quota
  FROM s3
), placed AS (
  SELECT d.*, source_size, target, quota, ord % shards AS shard FROM d JOIN s4 USING (skey)
), l AS (
  SELECT skey, shard, any_value(quota) AS quota, sum(size)::BIGINT AS line FROM placed GROUP BY skey, shard HAVING sum(size) > 0
), lt AS (
  SELECT *, sum(line) OVER (PARTITION BY skey) AS total, count(*) OVER (PARTITION BY skey) AS parties FROM l
), lq AS (
  SELECT skey, shard, quota, row_number() OVER (PARTITION BY skey ORDER BY line / (2 * a - 1)::DOUBLE DESC, shard, a) AS r
  FROM (SELECT *, unnest(range(1, floor(line * (quota + parties / 2.0::DOUBLE) / total + 0.5)::BIGINT + 2)) AS a FROM lt)
), lw AS (
  SELECT skey, shard, count(*) AS won FROM lq WHERE r <= quota GROUP BY skey, shard
), b AS (
  SELECT l.skey, l.shard, line, (line + {BLOCK - 1}) // {BLOCK} AS m1, (2 * line + {BLOCK - 1}) // {BLOCK} AS m, coalesce(won, 0) AS quota
  FROM l LEFT JOIN lw ON l.skey = lw.skey AND l.shard = lw.shard
), c AS (
  SELECT skey, shard, line, m1, greatest(m - m1, 1) AS m2, least(quota, m1) AS q1, least(greatest(quota - m1, 0), m - m1) AS q2 FROM b
), e AS (
  SELECT *, (shard * 7919 + {SEED}) % m1 AS o1, (shard * 104729 + {SEED}) % m2 AS o2 FROM c
), f AS (
  SELECT *, (sum(size) OVER (PARTITION BY skey, shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS p FROM placed
), g AS (
  SELECT f.*, row_number() OVER () AS rid, line, m1, m2, q1, q2, o1, o2 FROM f LEFT JOIN e USING (skey, shard)
), place AS (
  SELECT *, p AS a, p + size AS z FROM g WHERE size > 0 UNION ALL SELECT *, line + p AS a, line + p + size AS z FROM g WHERE size > 0
), block AS (
  SELECT *, unnest(range(a // {BLOCK}, (z - 1) // {BLOCK} + 1)) AS i FROM place
), held AS (
  SELECT rid, sum(least(z, (i + 1) * {BLOCK}) - greatest(a, i * {BLOCK})) FILTER (
    CASE WHEN i < m1 THEN ((i + 1) * q1 + o1) // m1 > (i * q1 + o1) // m1 ELSE ((i - m1 + 1) * q2 + o2) // m2 > ((i - m1) * q2 + o2) // m2 END
  ) AS taken FROM block GROUP BY rid
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM g LEFT JOIN held USING (rid)
"""


ORACLE = _oracle()
