"""Sparse search over a table of postings with block maxima.

The table has a row for each block of documents: its terms in order, for each term the list of the block's documents that
have it with their weights, and the highest weight of the list. A search reads the blocks once. For each query it adds up
the maxima of the query's terms: a block whose sum, times the highest boost, is below the query's k-th score so far has no
document for it and its lists are not opened. Lists that are opened are added up document by document inside the
block; only the k best of a query leave a task. No (query, document) pair is shuffled before that cut.

The blocks are of documents and not of terms, so that a document's whole score is in one place. The table depends on no
query: it can be written once (it is a plain DataFrame) and extended by the blocks of new documents. Texts that are searched
once need no table: search_texts and matches_texts read each block where it was built, so a task holds one block at a time.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.batches import pieces
from tessera.operators.topk import Best, Factor, boosts, inside, key_ranks, query_blocks, query_ids, result_schema

#: Documents and postings of a block, whichever comes first.
BLOCK, POSTINGS = 4096, 1_000_000
_TERM = re.compile(rb"[a-z0-9]+")


def postings(docs: DataFrame, key: str, text: str, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Blocks (block, rows, terms, tops, ends, docs, weights) of the documents; rows holds key and the columns in keep.

    A document's weight for a term is log(1 + its count) / log(1 + the document's terms). Null texts have no terms.
    """
    rows = _texts(docs, key, text, keep)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))])
    for name, kind in (("terms", T.StringType()), ("tops", T.DoubleType()), ("ends", T.IntegerType()), ("docs", T.IntegerType()), ("weights", T.DoubleType())):
        schema = schema.add(name, T.ArrayType(kind))
    return rows.mapInArrow(_build(block), schema)


def _texts(docs: DataFrame, key: str, text: str, keep: Sequence[str]) -> DataFrame:
    return docs.select(F.struct(key, *keep).alias("row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def _one(values: pa.Array) -> pa.Array:
    """An array as the only element of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _build(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32 | k for k in count())
        rows, sizes, counts = [], [], []
        place: dict[bytes, int] = {}
        terms, tfs = array("i"), array("i")  # one number a posting

        def close() -> pa.RecordBatch:
            names = sorted(place)
            ranks = np.empty(len(names), np.int32)
            ranks[[place[t] for t in names]] = np.arange(len(names))
            term = ranks[np.frombuffer(terms, np.int32)] if len(terms) else np.zeros(0, np.int32)
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
            weight = np.log1p(np.array(tfs, float)) / np.log1p(np.repeat(np.array(sizes, float), counts))
            order = np.lexsort((doc, term))
            ends = np.cumsum(np.bincount(term, minlength=len(names))).astype(np.int32)
            tops = np.maximum.reduceat(weight[order], np.r_[0, ends[:-1]]) if len(names) else np.zeros(0)
            kept = pa.concat_arrays(rows)
            lists = [kept, pa.array([t.decode() for t in names], pa.string()), pa.array(tops), pa.array(ends), pa.array(doc[order]), pa.array(weight[order])]
            return pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), *map(_one, lists)], ["block", "rows", "terms", "tops", "ends", "docs", "weights"])

        for b in pieces(batches):
            begin = 0
            for i, text in enumerate(b.column("text").to_pylist()):
                found = _TERM.findall(text.encode("utf-8", "surrogatepass"))
                c = Counter(found)
                sizes.append(len(found))
                counts.append(len(c))
                terms.extend(place.setdefault(t, len(place)) for t in c)
                tfs.extend(c.values())
                if len(sizes) >= block or len(terms) >= POSTINGS:
                    rows.append(b.column("row")[begin : i + 1])
                    yield close()
                    rows, sizes, counts, place, terms, tfs, begin = [], [], [], {}, array("i"), array("i"), i + 1
            if begin < b.num_rows:
                rows.append(b.column("row")[begin:])
        if sizes:
            yield close()

    return run


class _Block:
    """A block's lists, opened one by one."""

    def __init__(self, b: pa.RecordBatch, i: int) -> None:
        def at(c: str) -> pa.Array:
            return b.column(c)[i].values

        struct = at("rows")
        self.rows = pa.table({f.name: struct.field(k) for k, f in enumerate(struct.type)})
        self.place = {t: k for k, t in enumerate(at("terms").to_pylist())}
        self.tops, ends, self.docs, self.weights = (at(c).to_numpy() for c in ("tops", "ends", "docs", "weights"))
        self.begins = np.r_[0, ends]

    def held(self, terms: list[str]) -> list[int]:
        return [self.place[t] for t in terms if t in self.place]

    def scores(self, held: list[int]) -> np.ndarray:
        """Of every document of the block the sum of its weights, in the order of the terms."""
        out = np.zeros(self.rows.num_rows)
        for k in held:
            at = slice(self.begins[k], self.begins[k + 1])
            out[self.docs[at]] += self.weights[at]
        return out

    def sharing(self, held: list[int]) -> np.ndarray:
        """Documents that have all terms: lists are intersected, the shortest first."""
        lists = sorted((self.docs[self.begins[k] : self.begins[k + 1]] for k in held), key=len)
        return reduce(lambda a, b: a[np.isin(a, b, assume_unique=True)], lists)


def _queries(queries: DataFrame, query: str) -> list[list[Row]]:
    return query_blocks(queries.withColumn("terms", F.sort_array(F.array_distinct("terms"))), query)


def scan(batches: Iterator[pa.RecordBatch], asked: list[Row], k: int, key: str, factors: Sequence[Factor], scope: tuple[str, str] | None) -> Best:
    """The best documents of some blocks; lists of a block are opened for a query only if their maxima can reach its k-th score."""
    highest = float(np.prod([max(f.value, 1.0) for f in factors]))
    best = Best(k, key)
    for b in batches:
        for i in range(b.num_rows):
            block = _Block(b, i)
            ranks = key_ranks(block.rows, key)
            for q, a in enumerate(asked):
                held = block.held(a.terms)
                if not held:
                    continue
                sides = inside(block.rows, a, scope)
                # 1e-8: what rounding may add
                if block.tops[held].sum() * highest + 1e-8 < min(best.floor(q, bool(s)) for s in np.unique(sides)):
                    continue
                raw = np.round(block.scores(held), 9)
                at = np.flatnonzero(raw > 0)
                best.offer(block.rows, ranks, q, at, sides[at], raw[at] * boosts(block.rows, a, factors)[at], raw[at])
    return best


Batches = Iterator[pa.RecordBatch]


def _search(rows: DataFrame, fields: list[T.StructField], blocks: Callable[[Batches], Batches], queries: DataFrame, k: int, key: str, query: str, factors: Sequence[Factor], scope: tuple[str, str] | None) -> DataFrame:
    def task(asked: list[Row]):
        ids = query_ids(asked, query, queries.schema[query].dataType)

        def run(batches: Batches) -> Batches:
            out = scan(blocks(batches), asked, k, key, factors, scope).result(query, ids)
            if out is not None:
                yield from out.combine_chunks().to_batches()

        return run

    schema = result_schema(queries.schema[query], fields)
    return reduce(DataFrame.unionByName, (rows.mapInArrow(task(asked), schema) for asked in _queries(queries, query)))


def search(lists: DataFrame, queries: DataFrame, k: int, key: str, query: str, factors: Sequence[Factor] = (), scope: tuple[str, str] | None = None) -> DataFrame:
    """(query, inside, score, raw, key and kept columns): at least the k best documents of each query and side of its scope.

    queries: query, terms (an array) and what factors and scope read. raw is the sum of the weights, to nine decimals;
    score is raw times the factors. Each task gives its k best, so a ranking of the result by score, then key, has the k
    best of all first. Documents without any of the terms are not found.
    """
    return _search(lists, lists.schema["rows"].dataType.elementType.fields, iter, queries, k, key, query, factors, scope)


def search_texts(docs: DataFrame, queries: DataFrame, k: int, key: str, text: str, query: str, keep: Sequence[str] = (), factors: Sequence[Factor] = (), scope: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """search over the postings of the documents, which are built and read block by block in the same task."""
    rows = _texts(docs, key, text, keep)
    return _search(rows, rows.schema["row"].dataType.fields, _build(block), queries, k, key, query, factors, scope)


def _matches(rows: DataFrame, fields: list[T.StructField], blocks: Callable[[Batches], Batches], queries: DataFrame, query: str) -> DataFrame:
    def task(asked: list[Row]):
        ids = query_ids(asked, query, queries.schema[query].dataType)

        def run(batches: Batches) -> Batches:
            for b in blocks(batches):
                for i in range(b.num_rows):
                    block = _Block(b, i)
                    for q, a in enumerate(asked):
                        held = block.held(a.terms)
                        at = block.sharing(held) if held and len(held) == len(a.terms) else ()
                        if len(at):
                            some = block.rows.take(pa.array(at))
                            head = {query: ids.take(pa.array([q] * len(at))), "hits": pa.array([len(held)] * len(at), pa.int64())}
                            yield from pa.table({**head, **{n: some.column(n) for n in some.column_names}}).combine_chunks().to_batches()

        return run

    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField("hits", T.LongType()), *fields])
    return reduce(DataFrame.unionByName, (rows.mapInArrow(task(asked), schema) for asked in _queries(queries, query)))


def matches(lists: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """(query, hits, key and kept columns) of all documents that have all terms of a query; hits is their number."""
    return _matches(lists, lists.schema["rows"].dataType.elementType.fields, iter, queries, query)


def matches_texts(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """matches over the postings of the documents, which are built and read block by block in the same task."""
    rows = _texts(docs, key, text, keep)
    return _matches(rows, rows.schema["row"].dataType.fields, _build(block), queries, query)
