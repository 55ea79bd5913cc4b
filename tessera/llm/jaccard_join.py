"""N-gram Jaccard join with Bayesian candidate pruning (operator 1).

Texts are sets of five-word shingles (whole texts, words as they stand). Linked are documents whose
Jaccard similarity is at least THRESHOLD.

1. Equal texts become one class with its number of copies; only classes are compared.
2. MinHash bands put classes into buckets. Inside a bucket pairs are compared incrementally, STEP
   values at a time: with s of n values equal, the similarity's posterior (uniform prior) reaches the
   threshold with the probability that a binomial (n + 1, THRESHOLD) is at most s, and a pair whose
   probability falls below TOLERANCE is dropped. Surviving pairs leave a spanning forest, never all pairs.
3. The forests' components hold every surviving pair. In each, all pairs are verified exactly by
   counting common shingles, with matrix products over the shingles that two texts share.
4. Links are counted with copies; classes of linked documents are components of verified links.

Buckets and components with more than BLOCK members (or SHINGLES shingles) are split into blocks, and
pairs of blocks are dealt to tasks, so none is held whole, nothing is capped, and only rows per
member leave a task. Counting every link of a component of m different texts compares m * m pairs and carries each text
m / BLOCK times; equal texts are one member, whatever their number. A pair of similarity 0.8 shares no band with a probability of 3e-5, and is
pruned with a probability of at most TOLERANCE at each comparison.

Defined cases: null or blank texts have no shingles and no links, each is its own class; a text of
one to four words is one shingle; rows with equal id and text are copies of each other; a null id
ranks last and is no class: of texts without any id, class_id is null, and those that are not linked all
stay; texts that share an id only are not linked; an empty table gives an empty result; other columns are ignored by the join and kept by
the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, connected_components, drop_path, new_path, staged, table
from tessera.llm.shingles import WordHashes, chunks, minima32, scramble, shingles

THRESHOLD = 0.8
ROWS, BANDS = 5, 26
HASHES = ROWS * BANDS
TOLERANCE = 1e-5
STEP = 26
#: Members and shingles of a block.
BLOCK, SHINGLES = 512, 1_000_000
SEED = 5
BIG = 2**63 - 1

SIGNED = "pid long, cls binary, n long, sig binary, keys array<long>"


def _sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    mix = np.uint64(0x9E3779B97F4A7C15)
    for f in frames:
        texts, pids, cls = f.text.tolist(), f.pid.tolist(), f.cls.tolist()
        for s in chunks(texts):
            values, counts = shingles(texts[s], known)
            used = np.flatnonzero(counts)
            if not len(used):
                continue
            first = np.cumsum(counts) - counts
            sig = minima32(values, first[used], HASHES, SEED)
            keys = np.zeros((BANDS, len(used)), np.uint64)
            for b in range(BANDS):
                keys[b] += np.uint64(b + 1)
                for r in range(ROWS):
                    keys[b] = scramble(keys[b] * mix + sig[b * ROWS + r])
            short = (sig >> np.uint32(16)).astype(np.uint16).T.copy()
            keys = keys.T.copy().view(np.int64)
            yield pd.DataFrame(
                {"pid": [pids[s.start + i] for i in used], "cls": [cls[s.start + i] for i in used], "n": counts[used], "sig": [x.tobytes() for x in short], "keys": list(keys)}
            )


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of n equal values with which the posterior still reaches the threshold often enough."""
    total = 0.0
    for s in range(n + 1):
        total += comb(n + 1, s) * threshold**s * (1 - threshold) ** (n + 1 - s)
        if total >= tolerance:
            return s
    return n


LEAST = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}


def surviving(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of left and right that no step drops."""
    i, j = np.divmod(np.arange(len(left) * len(right)), len(right))
    if left is right:
        keep = i < j
        i, j = i[keep], j[keep]
    same = np.zeros(len(i), np.int32)
    for a in range(0, HASHES, STEP):
        part = np.empty(len(i), np.int32)
        for x in range(0, len(i), 100_000):
            y = slice(x, x + 100_000)
            part[y] = (left[i[y], a : a + STEP] == right[j[y], a : a + STEP]).sum(axis=1)
        same += part
        keep = same >= LEAST[a + STEP]
        i, j, same = i[keep], j[keep], same[keep]
        if not len(i):
            break
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(edges that connect what the pairs connect, root of each of n nodes)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((a, b))
    return edges, [find(x) for x in range(n)]


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that are sorted by keys, across batches."""
    held, at = [], None
    for f in frames:
        if not len(f):
            continue
        k = f[keys].to_numpy()
        cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        for a, b in zip(cut, np.r_[cut[1:], len(f)]):
            now = tuple(k[a])
            if now != at and held:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            at = now
            held.append(f.iloc[a:b])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


TASK = ["key", "b1", "b2"]


def _prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges of the surviving pairs in each bucket, or between two of its blocks."""
    out: list[tuple] = []
    for g in _groups(frames, TASK):
        if len(g) > 1:
            sig = np.frombuffer(b"".join(g.sig), np.uint16).reshape(len(g), HASHES)
            cls, b1, b2 = g.cls.tolist(), g.b1.iloc[0], g.b2.iloc[0]
            if b1 == b2:
                i, j = surviving(sig, sig)
            else:
                l, r = np.flatnonzero(g.block.to_numpy() == b1), np.flatnonzero(g.block.to_numpy() == b2)
                i, j = surviving(sig[l], sig[r]) if len(l) and len(r) else (l[:0], r[:0])
                i, j = l[i], r[j]
            out += [(cls[a], cls[b]) for a, b in forest(len(g), i, j)[0]]
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets of distinct values share."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(start) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    out = np.zeros((n, n))
    width = 2048
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], column[a:b] - c] = 1
        out += x @ x.T
    return out


VERIFIED = "cls binary, links long, label long, root binary, other binary"


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (cls, links, label, root) of each member; of a component in blocks, label and root are null and rows with other are its links' forest."""
    known = WordHashes()
    out: list[tuple] = []
    for g in _groups(frames, ["comp", "b1", "b2"]):
        if len(g) > 1:
            values, counts = shingles(g.text.tolist(), known)
            sets = [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])]
            size, copies, cls = np.array([len(s) for s in sets]), g.copies.to_numpy(), g.cls.tolist()
            common = common_counts(sets)
            # J >= t as common * (1 + t) >= t * (|a| + |b|), in whole numbers: t is 4/5
            linked = common.astype(np.int64) * 9 >= 4 * (size[:, None] + size[None, :])
            np.fill_diagonal(linked, False)
            b1, b2, block = g.b1.iloc[0], g.b2.iloc[0], g.block.to_numpy()
            if b1 != b2:
                linked &= block[:, None] != block[None, :]
            links = linked @ copies
            edges, root = forest(len(g), *np.nonzero(np.triu(linked)))
            if g.blocks.iloc[0] == 1:
                least: dict[int, int] = {}
                first: dict[int, bytes] = {}
                for r, p, c in zip(root, g.rep.tolist(), cls):
                    least[r] = min(least.get(r, BIG), p)
                    first[r] = min(first.get(r, c), c)
                out += [(c, int(k), least[r], first[r], None) for c, k, r in zip(cls, links, root) if k]
            else:
                out += [(c, int(k), None, None, None) for c, k in zip(cls, links) if k]
                out += [(cls[a], 0, None, None, cls[b]) for a, b in edges]
        if len(out) > 5000:
            yield _verified(out)
            out = []
    yield _verified(out)


def _verified(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["cls", "links", "label", "root", "other"])
    f["label"] = pd.array([r[2] for r in rows], "Int64")  # a column of numbers and nothing would pass through floats
    return f


def _dealt(members: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each member once for every pair of blocks that its block is in: b1 <= b2."""
    own = F.pmod(F.xxhash64("cls"), F.col(blocks)).cast("int")
    m = members.withColumn("block", own)
    m = m.withColumn("_j", F.explode(F.when(F.col(blocks) == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))))
    return m.withColumn("b1", F.least("block", "_j")).withColumn("b2", F.greatest("block", "_j")).drop("_j")


def classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pid, cls, root, class_id, n_links) of every row of docs (key, text).

    root: least cls among the texts that links connect, null for texts without shingles; class_id: least id among the documents that links connect; n_links: other documents linked directly.
    Ids may be null or repeated, so class_id is for output only; what is one class has one root.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    pid = F.coalesce(F.col(key).cast("long"), F.lit(BIG))
    rows = docs.select(F.col(key), pid.alias("pid"), F.unhex(F.md5(text)).alias("cls"), text.alias("text"))
    path = new_path(spark, "signed")
    signed = staged(rows.select("pid", "cls", "text").mapInPandas(_sign, SIGNED), "", path)
    reps = staged(signed.groupBy("cls").agg(F.min("pid").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "classes")
    drop_path(spark, path)
    banded = reps.select("cls", F.explode("keys").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    full = staged(full, "full-buckets")
    members = _dealt(banded.join(full, "key"), "key", "blocks").select("key", "b1", "b2", "block", "cls").join(reps.select("cls", "sig"), "cls")
    edges = members.repartition(parts, *TASK).sortWithinPartitions(*TASK).mapInPandas(_prune, "a binary, b binary")
    comps = staged(connected_components(edges).select(F.col("id").alias("cls"), F.col("component").alias("comp")).join(reps.select("cls", "rep", "copies", "n"), "cls"), "components")
    sizes = staged(comps.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("blocks")), "component-sizes")
    comps = comps.join(sizes, "comp")
    # always by shuffling: a plan that changes with the size would not show on small tables what large ones cost
    wanted = comps.select(F.col("rep").alias("pid"), "cls").hint("merge")
    texts = rows.select("pid", "cls", "text").join(wanted, ["pid", "cls"], "left_semi").dropDuplicates(["cls"]).select("cls", "text")
    group = ["comp", "b1", "b2"]
    tasks = _dealt(comps, "comp", "blocks").join(texts, "cls").select(*group, "block", "blocks", "cls", "rep", "copies", "text")
    checked = staged(tasks.repartition(parts, *group).sortWithinPartitions(*group).mapInPandas(_verify, VERIFIED), "verified")
    links = checked.where("other IS NULL").groupBy("cls").agg(F.sum("links").alias("links"), F.min("label").alias("label"), F.min("root").alias("near_root"))
    split = connected_components(checked.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls")
    split = split.join(reps.select("cls", "rep"), "cls")
    labels = split.join(split.groupBy("component").agg(F.min("rep").alias("far")), "component").select("cls", "far", F.col("component").alias("far_root"))
    per_class = reps.select("cls", "rep", "copies").join(links, "cls", "left").join(labels, "cls", "left").select(
        "cls", F.coalesce("far_root", "near_root", "cls").alias("root"), F.coalesce("far", "label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    # written, so that Spark can split a class that holds many of the rows
    out = rows.select(key, "pid", "cls").join(staged(per_class, "per-class"), "cls", "left")
    class_id = F.coalesce("class_id", "pid")
    class_id = F.when(class_id == BIG, F.col(key).cast("long")).otherwise(class_id).alias("class_id")
    return out.select(key, "pid", "cls", "root", class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, one of each class: the one with the least id."""
    found = classes(docs, key)
    alone = F.col("root").isNull()
    kept = found.groupBy("root", F.when(alone, F.col("pid")), F.when(alone, F.col("cls"))).agg(F.min(F.struct("pid", "cls")).alias("k")).select(F.col("k.pid").alias("_pid"), F.col("k.cls").alias("_cls"))
    kept = staged(kept, "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    # without id and words nothing says that two rows are one document
    own = F.when(F.col(key).isNull() & ~text.rlike(WORD), F.monotonically_increasing_id())
    # a row travels as one value, so that no column of the user's has a name of ours
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(key).cast("long"), F.lit(BIG)).alias("_pid"), F.unhex(F.md5(text)).alias("_cls"), own.alias("_own"))
    joined = marked.join(kept.hint("merge"), ["_pid", "_cls"], "left_semi")
    order = W.partitionBy("_pid", "_cls", "_own").orderBy(*[F.col(f"doc.`{c}`") for c, t in docs.dtypes if c != "text" and not t.startswith("map")])
    return joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


#: Exact: every pair that shares a shingle is counted.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT k, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE 9 * c >= 4 * (na.n + nb.n)),
r AS (SELECT k, k AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.k WHERE r.root < l.b),
m AS (SELECT k, min(root) AS root FROM r GROUP BY k)
SELECT d.doc_id, c.doc_id AS class_id, (SELECT count(*) FROM l WHERE l.a = d.k)::BIGINT AS n_links FROM d JOIN m USING (k) JOIN d c ON c.k = m.root
"""
