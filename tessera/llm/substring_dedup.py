"""Exact removal of repeated passages by super-k-mer partitioning (operator 8).

A window is WINDOW consecutive words. Its minimiser is the least hash among its SEED_WORDS-word sequences; consecutive
windows that share a minimiser travel as one packed string (a super-k-mer, of at most RUN windows) to the minimiser's
bucket, where sorting the windows counts them exactly. A word is removed if a window that covers it also starts in a
document with a smaller id.

1. One pass in place notes each document's minimisers, beside the digest that the document has if nothing goes. Of
   documents with the same whole text only those with the least id go on: of the others every word of every window goes.
2. Equal windows have equal minimisers, so only super-k-mers whose minimiser stands in more than one document travel.
   Equal packed strings are merged on the way (a map-side minimum and maximum of the document id).
3. Buckets are sorted window by window: by a hash, then equal hashes word by word. The strings of a minimiser with more
   than HOT windows are cut into super-k-mers again, by another order of longer sequences (ORDERS): equal windows have
   equal minimisers in any order, consecutive ones still travel as one string, equal strings are merged on the way, and
   what has a minimiser that no other document has ends there. So it goes on while there are such minimisers; in the
   last order a sequence is a whole window, so a bucket is one window however many documents have it.
4. Results go back by string to the strings that it was cut from, to the occurrences, then as intervals to the
   documents, of which only those with a hit are read again.

Defined cases: a null text has no words; a null id ranks after all ids; rows with the same id do not repeat each other
(only a smaller id does); repeated rows are judged alike; an empty table gives an empty result; other columns are
ignored. Documents are told apart by id and the 128-bit digest of their text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, drop_path, new_path, staged, table
from tessera.llm.shingles import WordHashes, scramble

WINDOW = 50
SEED_WORDS = 8
#: Windows of a packed string, and of a minimiser that one task sorts together.
RUN, HOT = 400, 16_384
#: Words of the sequences whose least hash is the minimiser: at first, and of strings whose minimiser has too many windows.
ORDERS = (SEED_WORDS, 24, 40, 47, WINDOW)
#: Rank of a null id.
LAST = 2**63 - 1
#: Characters of packed strings that a task holds before it passes them on.
HELD = 8 << 20
_WORD = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n-word sequence."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MIX + h[i : i + len(out)]
    return scramble(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(h: np.ndarray, window: int = WINDOW, seed_words: int = SEED_WORDS, run: int = RUN, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of at most so many windows that share a minimiser."""
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = gram_hashes(h, seed_words)
    least = sliding_min(scramble(grams ^ np.uint64(order)) if order else grams, window - seed_words + 1)
    at = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[at, len(least)])
    if size.max() > run:
        pieces = -(-size // run)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, size = np.repeat(at, pieces) + nth * run, np.minimum(np.repeat(size, pieces) - nth * run, run)
    return least[at].view(np.int64), at, size


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a record batch; whole numbers stay whole beside nulls."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else ((),) * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


SEEN = "doc_id long, pid long, cls binary, n_words long, sha string, minimisers array<long>"


def _see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        out = []
        for doc_id, text in _rows(b, "doc_id", "text"):
            words = _WORD.findall(text)
            found = np.unique(super_kmers(word_hashes(words, known))[0])
            out.append((doc_id, LAST if doc_id is None else doc_id, hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), len(words), _sha(words), found.tolist()))
        yield _batch(SEEN, out)


PACKED = "minimiser long, n int, pid long, cls binary, start int, sid binary, packed string"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    out, held = [], 0
    for b in batches:
        for pid, cls, text, wanted in _rows(b, "pid", "cls", "text", "wanted"):
            words = _WORD.findall(text)
            keys, starts, counts = super_kmers(word_hashes(words, known))
            hit = np.isin(keys, np.asarray(wanted, np.int64))
            for k, s, n in zip(keys[hit].tolist(), starts[hit].tolist(), counts[hit].tolist()):
                packed = " ".join(words[s : s + n + WINDOW - 1])
                out.append((k, n, pid, cls, s, hashlib.blake2b(packed.encode("utf-8", "surrogatepass"), digest_size=16).digest(), packed))
                held += len(packed)
            if held > HELD:
                yield _batch(PACKED, out)
                out, held = [], 0
    yield _batch(PACKED, out)


def sorted_windows(strings: list[str], low: list[int]) -> list[np.ndarray]:
    """Of each packed string the least id of each of its windows, over all strings: windows are sorted, equal ones side by side.

    Sorted are hashes; windows with the same hash are told apart by their words, and sorted by them where hashes lie.
    """
    ids: dict[str, int] = {}
    words = [np.fromiter((ids.setdefault(w, len(ids)) for w in s.split(" ")), np.int32) for s in strings]
    counts = np.array([len(w) - WINDOW + 1 for w in words])
    flat = np.concatenate(words)
    first_word = np.cumsum([0, *[len(w) for w in words[:-1]]])
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_word, counts)
    seeds = gram_hashes(scramble((flat.astype(np.uint64) + np.uint64(1)) * _MIX), WINDOW)[at]
    order = np.argsort(seeds, kind="stable")
    windows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)
    same = seeds[order][1:] == seeds[order][:-1]
    pairs = np.flatnonzero(same)
    equal = np.concatenate([(windows[at[order[p]]] == windows[at[order[p + 1]]]).all(axis=1) for p in np.array_split(pairs, len(pairs) // 20_000 + 1)])
    if not equal.all():
        order = np.lexsort(windows[at].T)
        same = (windows[at[order[1:]]] == windows[at[order[:-1]]]).all(axis=1)
    begin = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(np.repeat(np.asarray(low, np.int64), counts)[order], begin)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[begin, len(order)]))
    return np.split(out, np.cumsum(counts)[:-1])


#: Of a string the windows that a smaller id repeats, and the least id of each.
LEAST = "sid binary, at array<int>, least array<long>"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings (minimiser, n, sid, packed, low, high), sorted by minimiser, that a smaller id repeats.

    Whole buckets are sorted together, up to about HOT windows: equal windows are of one bucket.
    """
    out, held, windows, bucket = [], [], 0, None

    def sort() -> None:
        sids, packed, low, high = zip(*held)
        for sid, h, least in zip(sids, high, sorted_windows(list(packed), list(low))):
            at = np.flatnonzero(least < h)
            if len(at):
                out.append((sid, at.tolist(), least[at].tolist()))

    for b in batches:
        for k, n, *row in _rows(b, "minimiser", "n", "sid", "packed", "low", "high"):
            if k != bucket and windows > HOT:
                sort()
                held, windows = [], 0
            bucket, windows = k, windows + n
            held.append(row)
        if len(out) > 2000:
            yield _batch(LEAST, out)
            out = []
    if held:
        sort()
    yield _batch(LEAST, out)


CUT = "parent binary, offset int, minimiser long, n int, sid binary, packed string, low long, high long"


def _cut(order: int, seed_words: int):
    """Super-k-mers of strings in another order, with where in which string each begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            out, held = [], 0
            for parent, packed, low, high in _rows(b, "sid", "packed", "low", "high"):
                words = packed.split(" ")
                for k, s, n in zip(*(x.tolist() for x in super_kmers(word_hashes(words, known), seed_words=seed_words, order=order))):
                    part = " ".join(words[s : s + n + WINDOW - 1])
                    out.append((parent, s, k, n, hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest(), part, low, high))
                    held += len(part)
                if held > HELD:
                    yield _batch(CUT, out)
                    out, held = [], 0
            yield _batch(CUT, out)

    return run


def _results(strings: DataFrame, parts: int, order: int = 0, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(sid, at, least) of strings (minimiser, n, sid, packed, low, high): the windows that a smaller id repeats, in order."""
    keys = strings.groupBy("minimiser").agg(F.sum("n").alias("windows"), F.min("low").alias("first"), F.max("high").alias("last")).where("first < last")
    last = order + 1 == len(orders)
    keys = staged(keys.select("minimiser", (F.lit(not last) & (F.col("windows") > HOT)).alias("hot")), f"minimisers-{order}")
    cold = strings.join(keys.where("NOT hot"), "minimiser", "left_semi").repartition(parts, "minimiser").sortWithinPartitions("minimiser")
    found = cold.select("minimiser", "n", "sid", "packed", "low", "high").mapInArrow(_buckets, LEAST)
    hot = keys.where("hot")
    if last or hot.isEmpty():
        return found
    whole = strings.join(hot, "minimiser", "left_semi").select("sid", "packed", "low", "high")
    cut = staged(whole.mapInArrow(_cut(order + 1, orders[order + 1]), CUT), f"cut-{order + 1}")
    again = staged(cut.groupBy("minimiser", "n", "sid", "packed").agg(F.min("low").alias("low"), F.max("high").alias("high")), f"strings-{order + 1}")
    inner = staged(_results(again, parts, order + 1, orders), f"results-{order + 1}")
    # a string's windows meet again: at most RUN of them
    back = cut.select("parent", "offset", "sid").join(inner, "sid")
    windows = F.arrays_zip(F.transform("at", lambda i: i + F.col("offset")).alias("at"), "least")
    whole = back.groupBy(F.col("parent").alias("sid")).agg(F.array_sort(F.flatten(F.collect_list(windows))).alias("w"))
    return found.unionByName(whole.select("sid", F.col("w.at").alias("at"), F.col("w.least").alias("least")))


COVERED = "pid long, cls binary, a long, b long"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word intervals that repeated windows of an occurrence cover."""
    for b in batches:
        out = []
        for pid, cls, start, at, least in _rows(b, "pid", "cls", "start", "at", "least"):
            at = np.asarray(at, np.int64)[np.asarray(least, np.int64) < pid]
            if len(at):
                cut = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                out += [(pid, cls, int(start + x), int(start + y + WINDOW)) for x, y in zip(at[cut], at[np.r_[cut[1:], len(at)] - 1])]
        yield _batch(COVERED, out)


def kept_words(words: list[str], intervals) -> list[str]:
    keep = np.ones(len(words), bool)
    for x in intervals if intervals is not None else ():
        keep[x["a"] : x["b"]] = False
    return words if keep.all() else [w for w, k in zip(words, keep) if k]


def _texts(docs: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("pid"), F.unhex(F.md5(text)).alias("cls"), text.alias("text"))


def found(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, copies, gone) of docs (key, text).

    documents: doc_id, pid, cls, n_words and sha of the whole text; copies: the least id (first) of each text with a
    window that several documents have; gone: the word intervals to remove from each (pid, cls) with the least id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, key)
    seen = staged(texts.select("doc_id", "text").mapInArrow(_see, SEEN), "seen")
    copies = staged(seen.where(F.col("n_words") >= WINDOW).groupBy("cls").agg(F.min("pid").alias("first"), F.max("pid").alias("last")).where("first < last").select("cls", "first"), "copies")
    alone = seen.where(F.col("n_words") >= WINDOW).select("pid", "cls", "minimisers").join(copies, "cls", "left").where("first IS NULL OR first = pid")
    path = new_path(spark, "minimisers")
    occurs = staged(alone.select("pid", "cls", F.explode("minimisers").alias("minimiser")), "", path)
    shared = staged(occurs.groupBy("minimiser").agg(F.min("pid").alias("low"), F.max("pid").alias("high")).where("low < high").select("minimiser"), "shared")
    wanted = staged(occurs.join(shared, "minimiser").groupBy("pid", "cls").agg(F.collect_set("minimiser").alias("wanted")), "wanted")
    drop_path(spark, path)
    packed = staged(texts.join(wanted, ["pid", "cls"]).select("pid", "cls", "text", "wanted").mapInArrow(_pack, PACKED), "super-kmers")
    strings = staged(packed.groupBy("minimiser", "n", "sid", "packed").agg(F.min("pid").alias("low"), F.max("pid").alias("high")), "strings")
    results = staged(_results(strings, parts), "string-results")
    spans = packed.select("pid", "cls", "start", "sid").join(results, "sid").select("pid", "cls", "start", "at", "least").mapInArrow(_covered, COVERED)
    gone = spans.groupBy("pid", "cls").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    return seen.drop("minimisers"), copies, staged(gone, "gone")


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, text, gone in _rows(b, "doc_id", "text", "gone"):
            words = _WORD.findall(text)
            kept = kept_words(words, gone)
            out.append((doc_id, len(words), len(words) - len(kept), _sha(kept)))
        yield _batch(DIGEST, out)


def digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs."""
    seen, copies, gone = found(docs, key)
    rows = seen.join(copies, "cls", "left").join(gone.select("pid", "cls", F.lit(True).alias("hit")), ["pid", "cls"], "left")
    copy = F.coalesce(F.col("first") < F.col("pid"), F.lit(False))
    whole = rows.where(copy | F.col("hit").isNull()).select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256")
    )
    cut = _texts(docs, key).join(gone, ["pid", "cls"]).select("doc_id", "text", "gone").mapInArrow(_digest, DIGEST)
    return whole.unionByName(cut)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [" ".join(kept_words(_WORD.findall(text), gone)) if gone is not None else text for text, gone in _rows(b, "text", "gone")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def remove_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) with repeated passages removed; untouched texts stay as they are."""
    kind = docs.schema[key].dataType.simpleString()
    _, copies, gone = found(docs, key)
    rows = _texts(docs, key).join(copies, "cls", "left").join(gone, ["pid", "cls"], "left")
    rows = rows.withColumn("text", F.when(F.col("first") < F.col("pid"), F.lit("")).otherwise(F.col("text")))
    return rows.select("doc_id", "text", "gone").mapInArrow(_rewrite, "doc_id long, text string").select(F.col("doc_id").cast(kind).alias(key), "text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT k, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS t
  FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), bad AS (
  SELECT k, i FROM (SELECT k, i, doc_id, min(doc_id) OVER (PARTITION BY t) AS first FROM win) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT k, unnest(range(i, i + {WINDOW})) AS i FROM bad
), word AS (
  SELECT k, i, w[i] AS x FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), kept AS (
  SELECT k, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (k, i) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
