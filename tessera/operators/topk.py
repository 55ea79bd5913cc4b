"""Best rows of each query, kept task by task: what is shuffled after scoring is at most k rows a query and task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that go to the tasks at a time; more of them go in further passes over the rows.
QUERY_BLOCK = 2000


@dataclass(frozen=True)
class Factor:
    """Multiplies a score where a row's column is the query's value, or one of the query's list."""

    column: str
    query: str
    value: float


def query_blocks(queries: DataFrame, query: str) -> list[list[Row]]:
    """The rows of a stated query set, in blocks of about QUERY_BLOCK."""
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    if blocks == 1:
        return [queries.collect()]
    return [queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b).collect() for b in range(blocks)]


def agreeing(rows: pa.Table, column: str, wanted) -> np.ndarray:
    """Which rows have the wanted value, or one of a list; a null agrees with nothing."""
    values = rows.column(column).combine_chunks().dictionary_encode()
    has = set(wanted) if isinstance(wanted, (list, tuple)) else {wanted}
    lookup = np.array([v is not None and v in has for v in values.dictionary.to_pylist()] + [False])
    return lookup[values.indices.fill_null(len(lookup) - 1).to_numpy(zero_copy_only=False)]


def boosts(rows: pa.Table, asked: Row, factors: Sequence[Factor]) -> np.ndarray:
    out = np.ones(rows.num_rows)
    for f in factors:
        if asked[f.query] is not None:
            out = out * np.where(agreeing(rows, f.column, asked[f.query]), f.value, 1.0)
    return out


def inside(rows: pa.Table, asked: Row, scope: tuple[str, str] | None) -> np.ndarray:
    """Which rows lie in the query's scope (column, query's column); without a scope all do."""
    if scope is None or asked[scope[1]] is None:
        return np.ones(rows.num_rows, bool)
    return agreeing(rows, scope[0], asked[scope[1]])


def key_ranks(rows: pa.Table, key: str) -> np.ndarray:
    """Place of each row by its key, nulls first."""
    column = rows.column(key).combine_chunks()
    null = column.is_null().to_numpy(zero_copy_only=False)
    blank = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else 0
    order = np.argsort(column.fill_null(blank).to_numpy(zero_copy_only=False), kind="stable")
    order = order[np.argsort(~null[order], kind="stable")]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


class Best:
    """The k best rows of each query inside and outside its scope, by score, then by key."""

    def __init__(self, k: int, key: str) -> None:
        self.k, self.key = k, key
        self.found: dict[tuple[int, bool], list[tuple]] = {}
        self.rows: list[pa.Table] = []
        self.size = 0

    def floor(self, q: int, side: bool) -> float:
        """What a row must reach to be among the best; ties may still win by their key."""
        have = self.found.get((q, side), ())
        return -have[-1][0] if len(have) == self.k else -np.inf

    def offer(self, rows: pa.Table, ranks: np.ndarray, q: int, at: np.ndarray, sides: np.ndarray, score: np.ndarray, raw: np.ndarray) -> None:
        """Rows `at` with their scores."""
        for side in (True, False):
            here = np.flatnonzero((sides == side) & (score >= self.floor(q, side)))
            if not len(here):
                continue
            here = here[np.lexsort((ranks[at[here]], -score[here]))[: self.k]]
            some = rows.take(pa.array(at[here]))
            keys = some.column(self.key).to_pylist()
            new = [(-float(s), k is not None, k, float(r), self.size + i) for i, (s, k, r) in enumerate(zip(score[here], keys, raw[here]))]
            self.found[q, side] = sorted([*self.found.get((q, side), ()), *new], key=lambda x: x[:2] + ((x[2],) if x[1] else ()))[: self.k]
            self.rows.append(some)
            self.size += len(here)
        if self.size > 4 * self.k * (len(self.found) + 100):
            self._compact()

    def _compact(self) -> None:
        keep = sorted({x[4] for have in self.found.values() for x in have})
        place = {old: new for new, old in enumerate(keep)}
        self.rows = [pa.concat_tables(self.rows).take(pa.array(keep, pa.int64()))]
        self.size = len(keep)
        self.found = {at: [(*x[:4], place[x[4]]) for x in have] for at, have in self.found.items()}

    def result(self, query: str, ids: pa.Array) -> pa.Table | None:
        """(query, inside, score, raw, the rows' columns)."""
        flat = [(q, side, -x[0], x[3], x[4]) for (q, side), have in self.found.items() for x in have]
        if not flat:
            return None
        q, side, score, raw, at = zip(*flat)
        rows = pa.concat_tables(self.rows).take(pa.array(at, pa.int64()))
        head = {query: ids.take(pa.array(q, pa.int64())), "inside": pa.array(side), "score": pa.array(score), "raw": pa.array(raw)}
        return pa.table({**head, **{n: rows.column(n) for n in rows.column_names}})


def result_schema(query: T.StructField, rows: list[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(query.name, query.dataType), T.StructField("inside", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("raw", T.DoubleType()), *rows])


def query_ids(asked: list[Row], query: str, kind: T.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array([r[query] for r in asked], to_arrow_type(kind))


def order_of(score: str, key: str) -> list[Column]:
    return [F.desc(score), F.asc(key)]
