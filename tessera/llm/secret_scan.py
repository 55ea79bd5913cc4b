"""Secret scans over an incremental blob ledger (operator 4, DataFrame functions only).

Every version of a text is addressed by its SHA-256. The ledger holds the (blob, rule version) pairs
scanned so far with what was found; a run scans only unseen pairs, each blob once however many paths
hold it, appends them to the ledger and joins the findings back to all paths. A new RULE_VERSION makes every pair new.
Texts that no rule's hint fits are entered as clean where they are read; only the others are shuffled.

Defined cases: a null text counts as empty and has no findings; repeated rows each get their
findings; an empty table gives an empty result; other columns are ignored by the scan and kept by
the redaction. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import let, new_path, staged, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length is tested with its least length, and a cheap test that never misses."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    base: bool = True


RULES = (
    Rule("assign", ASSIGN, 2, 12, r"""(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk])[A-Za-z]*["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 16, "[0-9a-f]{16}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN ", False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ", False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh[pousr]_", False),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox[abprs]-", False),
)
RULE_VERSION = "2"
MARK = "[SECRET]"
SPANS = "array<struct<start:bigint,kind:int,stop:bigint>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _pieces(rule: Rule, at: int, text: Column) -> Column:
    """Array of (kind, i, length of the text before match i since the last match, of the match, of the tested group)."""
    # one character class repeated is matched as its long runs only: shorter ones would be dropped anyway
    pattern = f"[0-9a-f]{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
    p = F.lit(pattern)
    found = let(
        F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("part")),
        lambda s: F.transform(
            s["all"],
            lambda m, i: F.struct(
                F.lit(at).alias("kind"), i.alias("i"), F.length(F.get(s["gap"], i)).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), F.length(F.get(s["part"], i)).cast("long").alias("part")
            ),
        ),
    )
    return F.when(text.rlike(rule.hint), found)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of the blobs (blob, text) that have any; spans sorted by start, then kind."""
    text = F.col("text")
    nothing = F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,part:bigint>>")
    rows = blobs.select("blob", F.explode(F.flatten(F.array(*[F.coalesce(_pieces(r, k, text), nothing) for k, r in enumerate(RULES)]))).alias("m")).select("blob", "m.*")
    w = W.partitionBy("blob", "kind").orderBy("i")
    least = F.element_at(F.array(*[F.lit(r.least) for r in RULES]), F.col("kind") + 1)
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("part") >= least)
    span = F.struct((F.col("stop") - F.col("len")).alias("start"), F.col("kind"), F.col("stop"))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(span)).cast(SPANS).alias("spans"))


LEDGER = "blob binary, rule_version string, spans array<struct<start:bigint,kind:int,stop:bigint>>"


def likely(text: Column) -> Column:
    """Whether a rule may match; what no hint fits is clean, and its text need not travel."""
    def may(rule: Rule) -> Column:
        literal = next((x for x in ("AKIA", "-----BEGIN ", "eyJ", "gh", "xox") if rule.hint.startswith(x)), None)
        fits = F.lit(True) if literal == rule.hint else text.rlike(rule.hint)
        return fits if literal is None else text.contains(literal) & fits

    return F.coalesce(reduce(lambda a, b: a | b, map(may, RULES)), F.lit(False))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, empty before the first run."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def address(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, blob, likely, text) of every row, written: the text only where a hint fits, so it is all that a run reads."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(key, blob_id(text).alias("blob"), likely(text).alias("likely"), text.alias("text"))
    return staged(rows.select(key, "blob", "likely", F.when(F.col("likely"), F.col("text")).alias("text")), "secret-paths")


def unseen(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows of the blobs of paths (blob, likely, text) that the ledger lacks under RULE_VERSION, each scanned once.

    Blobs without a hint are entered as clean from their address alone; of the others one text each meets the ledger.
    Copies of a blob meet in a map-side aggregate, so a blob that holds a third of all rows sends one row per task.
    """
    known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
    new = paths.select("blob").distinct().join(known, "blob", "left_anti")
    texts = paths.where("likely").groupBy("blob").agg(F.first("text").alias("text"))
    found = scan_blobs(texts.join(known, "blob", "left_anti"))
    return new.join(found, "blob", "left").select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")


def update(paths: DataFrame, path: str) -> None:
    """One run: scan what is new in paths (see address) and append it to the ledger at path. One run at a time writes a ledger.

    A run that fails has appended nothing, or all: run again, it scans what is still unseen.
    """
    new = staged(unseen(paths, read_ledger(paths.sparkSession, path)), "secret-entries")
    new.write.mode("append").parquet(path)


def findings(paths: DataFrame, path: str) -> DataFrame:
    """Every path (key, blob) with the spans that the ledger has of its blob, null if none."""
    ledger = read_ledger(paths.sparkSession, path)
    known = ledger.where((F.col("rule_version") == RULE_VERSION) & F.col("spans").isNotNull()).select("blob", "spans")
    return paths.drop("likely", "text").join(known, "blob", "left")


def scan(docs: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(paths with spans, ledger after the run), without a folder: ledger has the rows of earlier runs."""
    before = docs.sparkSession.createDataFrame([], LEDGER) if ledger is None else ledger.select("blob", "rule_version", "spans")
    paths = address(docs, key)
    after = before.unionByName(staged(unseen(paths, before), "secret-entries"))
    known = after.where((F.col("rule_version") == RULE_VERSION) & F.col("spans").isNotNull()).select("blob", "spans")
    return paths.drop("likely", "text").join(known, "blob", "left").drop("blob"), after


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with every span found replaced by a mark, n_chars brought up to date; rows stay.

    path: a ledger that earlier runs have written to; without one every blob is new. Rows without a hint are passed on
    in place, whatever their columns are named.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "secret-ledger")
    text = F.col("text")
    marked = docs.select(F.struct(*docs.columns).alias("doc"), blob_id(text).alias("blob"), likely(text).alias("likely"))
    marked = staged(marked.select("blob", "likely", F.when(F.col("likely"), F.col("doc")).alias("doc")), "secret-rows")
    update(marked.select("blob", "likely", F.col("doc")["text"].alias("text")), path)

    def cut(spans: Column, text: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.transform(F.slice(spans, 1, i), lambda x: x["stop"])))
            return F.when(s["start"] >= done, F.concat(F.substr(text, (done + 1).cast("int"), (s["start"] - done).cast("int")), F.lit(MARK))).otherwise("")

        last = F.array_max(F.transform(spans, lambda x: x["stop"]))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(text, (last + 1).cast("int"), F.length(text)))

    rows = findings(marked.where("likely"), path)
    own, spans = F.col("doc")["text"], F.col("spans")
    new = F.when(spans.isNull(), own).otherwise(cut(spans, own))
    columns = {c: F.col("doc")[c] for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(spans.isNull(), F.col("doc")["n_chars"]).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return docs.where(~likely(text)).unionByName(rows.select(*[c.alias(n) for n, c in columns.items()]))


def digest_columns(paths: DataFrame) -> DataFrame:
    spans = F.coalesce(F.col("spans"), F.array().cast(SPANS))
    names = F.array(*[F.lit(r.kind) for r in RULES])
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n_base = sum(r.base for r in RULES)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return paths.select(
        "doc_id", *[count(k).alias(f"n_{RULES[k].kind}") for k in range(n_base)],
        F.sha2(text(F.filter(spans, lambda s: s["kind"] < n_base)), 256).alias("base_sha256"), text(spans).alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the versions that were there first (even ids), then all, of which only the rest is scanned."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "secret-ledger")
    paths = address(docs)
    earlier = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    update(paths.where(earlier), path)
    update(paths, path)
    return digest_columns(findings(paths, path))


def _oracle() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {k} AS k, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS m, unnest(v) AS v, {r.least} AS least "
            f"FROM (SELECT rid, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS v FROM d WHERE regexp_matches(text, '{p}'))"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY rid, k ORDER BY i))::BIGINT AS stop FROM pieces),
spans AS (SELECT rid, k, kind, stop - length(m) AS start, stop, kind || ':' || (stop - length(m))::BIGINT || ':' || stop AS s FROM placed WHERE length(v) >= least),
g AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
