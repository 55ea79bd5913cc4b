"""Benchmark decontamination by size-partitioned MinHash containment search (operator 9).

A test item is short and a document may be long, so their Jaccard similarity says little. Items are
partitioned by size. Those with up to EXACT shingles are looked up by so many of their shingle hashes
that a document with 0.8 of them holds one, so none is missed. Those with up to S = 16, 32, 64, ...
shingles are looked for in segments of 2 S
shingles that overlap by S, so that a passage as long as the item lies whole in one segment. An item
of q shingles, more than EXACT, and the segment that holds 0.8 of it have a Jaccard similarity of at least 0.8 q / (2 S + 0.2 q) > 0.18,
and one of HASHES equal MinHash values makes a candidate: a passage at that bound is missed with a
probability below 4e-6. Minima of the larger segments come from those of the smaller. Candidates are
verified by the exact share of the item's shingles in the whole document.

Documents are never shuffled: items come to every task in blocks of at most about BLOCK_CHARS characters, one pass a
block, so that what is broadcast is bounded whatever the number and length of the items (one item is never cut).

What is found are items of which a passage holds the share; shingles that lie scattered over a document count when a
candidate is verified, but a document that has them scattered only is not surely a candidate.

Defined cases: a null or blank text holds nothing; a text of one to four words is one shingle, so it
matches an equal text only; blank items never match; repeated rows are reported each; an empty table
on either side gives no pairs; other columns are kept by the filter and ignored by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, table
from tessera.llm.shingles import WordHashes, chunks, minima32, shingles

HASHES = 64
THRESHOLD = 0.8
SMALLEST = 16
#: Items of up to so many shingles are looked up without MinHash, whose segments are too long for them.
EXACT = 8
#: Characters of the items of one pass (the index takes about eight bytes for each); an item counts for ITEM_CHARS more, its MinHash values.
BLOCK_CHARS, ITEM_CHARS = 8_000_000, 100
SEED = 9


class ItemIndex:
    """The items of a block: shingle sets, and for each size class the MinHash values to look for."""

    def __init__(self, texts: list):
        self.sets, self.classes = [], {}
        values, counts = shingles(texts, WordHashes())
        for i, x in enumerate(np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []):
            self.sets.append(np.unique(x))
            if len(x) and len(self.sets[-1]) > EXACT:
                level = max(0, int(np.ceil(np.log2(len(self.sets[-1]) / SMALLEST)))) if len(self.sets[-1]) > SMALLEST else 0
                self.classes.setdefault(level, []).append(i)
        small = [i for i, x in enumerate(self.sets) if 0 < len(x) <= EXACT]
        # at least ceil(0.8 n) of n are shared, so of any n - ceil(0.8 n) + 1 one is
        heads = [self.sets[i][: len(self.sets[i]) // 5 + 1] for i in small]
        keys, items = np.concatenate([*heads, np.zeros(0, np.uint64)]), np.repeat(np.asarray(small, np.int64), [len(x) for x in heads])
        order = np.argsort(keys, kind="stable")
        self.small = keys[order], items[order]
        self.lookup = {}
        for level, members in self.classes.items():
            flat, starts = np.concatenate([self.sets[i] for i in members]), np.cumsum([0, *[len(self.sets[i]) for i in members[:-1]]])
            sig = minima32(flat, starts, HASHES, SEED)
            order = np.argsort(sig, axis=1, kind="stable")
            self.lookup[level] = (np.take_along_axis(sig, order, 1), np.asarray(members)[order])

    def search(self, texts: list, known: WordHashes) -> list[tuple[int, int, int]]:
        """(text, item, shingles shared) of every verified pair."""
        values, counts = shingles(texts, known)
        used = np.flatnonzero(counts)
        if not len(used) or not (self.lookup or len(self.small[0])):
            return []
        first, found = np.cumsum(counts) - counts, set()
        keys, items = self.small
        if len(keys):
            near = np.searchsorted(keys, values)
            held = np.flatnonzero(keys[np.minimum(near, len(keys) - 1)] == values)
            ends = np.searchsorted(keys, values[held], "right")
            for d, lo, hi in zip(np.searchsorted(first + counts, held, "right").tolist(), near[held].tolist(), ends.tolist()):
                found.update((d, i) for i in items[lo:hi].tolist())
        if self.lookup:
            self._like(found, values, counts, used, first)
        return self._verified(found, values, counts, first)

    def _like(self, found: set, values: np.ndarray, counts: np.ndarray, used: np.ndarray, first: np.ndarray) -> None:
        """Adds the pairs (text, item) of a segment and a larger item with an equal MinHash value."""
        blocks = -(-counts[used] // SMALLEST)
        owner = np.repeat(used, blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        sig = minima32(values, first[owner] + SMALLEST * within, HASHES, SEED)
        for level in range(max(self.lookup) + 1):
            if level:
                head = np.flatnonzero(within % 2 == 0)
                sig, owner, within = np.minimum.reduceat(sig, head, axis=1), owner[head], within[head] // 2
            if level not in self.lookup:
                continue
            pair = sig.copy()
            same = np.flatnonzero(owner[1:] == owner[:-1])
            pair[:, same] = np.minimum(sig[:, same], sig[:, same + 1])
            keys, items = self.lookup[level]
            for row, ks, its in zip(pair, keys, items):
                lo, hi = np.searchsorted(ks, row, "left"), np.searchsorted(ks, row, "right")
                for s in np.flatnonzero(hi > lo):
                    found.update((int(owner[s]), int(i)) for i in its[lo[s] : hi[s]])

    def _verified(self, found: set, values: np.ndarray, counts: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        out, at, own = [], -1, None
        for d, i in sorted(found):
            if d != at:
                at, own = d, np.unique(values[first[d] : first[d] + counts[d]])
            item = self.sets[i]
            pos = np.searchsorted(own, item)
            shared = int((own[np.minimum(pos, len(own) - 1)] == item).sum())
            if shared >= THRESHOLD * len(item):
                out.append((d, i, shared))
        return out


def _blocks(spark: SparkSession, benchmark: DataFrame):
    """(indexes of the items, their keys as Arrow values) of blocks of at most about BLOCK_CHARS characters."""
    weight = F.length(F.coalesce("text", F.lit(""))) + ITEM_CHARS
    key = F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    items = benchmark.where(F.col("text").rlike(WORD)).select("item_id", "text")
    parts = -(-(items.agg(F.sum(weight.cast("long"))).first()[0] or 0) // BLOCK_CHARS)
    for k in range(parts):
        t = (items if parts == 1 else items.where(F.pmod(key, F.lit(parts)) == k)).toArrow()
        ids, texts = t.column("item_id").combine_chunks(), t.column("text").to_pylist()
        yield spark.sparkContext.broadcast((ItemIndex(texts), ids))


def _found(index, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int]]]]:
    """Each batch with the (row, item, shingles shared) in it."""
    known = WordHashes()
    for b in batches:
        texts, out = b.column("text").to_pylist(), []
        for s in chunks(texts):
            out += [(s.start + d, i, n) for d, i, n in index.search(texts[s], known)]
        yield b, out


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item) where the document holds at least THRESHOLD of the item; ids keep their types."""
    spark, out = docs.sparkSession, None
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_item long"
    for block in _blocks(spark, benchmark):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, ids = block.value
            for b, pairs in _found(index, batches):
                rows, items = pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())
                shared, sizes = pa.array([p[2] for p in pairs], pa.int64()), pa.array([len(index.sets[p[1]]) for p in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), ids.take(items), shared, sizes], ["doc_id", "item_id", "n_shared", "n_item"])

        found = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, decided in place; rows are passed on as they are."""
    spark = docs.sparkSession
    for block in _blocks(spark, benchmark):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b, pairs in _found(block.value[0], batches):
                good = np.ones(b.num_rows, bool)
                good[[d for d, _, _ in pairs]] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS k, item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT k, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), bs AS (
  SELECT DISTINCT k, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM b)
), bn AS (SELECT k, count(*) AS n_item FROM bs GROUP BY k),
m AS (SELECT ds.k AS dk, bs.k AS bk, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item, round(n_shared / n_item, 6) AS containment
FROM m JOIN bn ON bn.k = m.bk JOIN d ON d.k = m.dk JOIN b ON b.k = m.bk
WHERE n_shared >= 0.8 * n_item
"""
