"""Nearest vectors of many queries: exact by matrix products in the tasks, or in the nearest cells of an inverted file.

Norms are worked out once for each vector, and each task keeps its k best rows of a query, so no pair of a query and a row
is shuffled before that cut.

The inverted file deals vectors to the cells of a k-means fit. It is a DataFrame with the column `cell`, to be written
partitioned by it: a search asks the queries' nearest cells only, so the files of other cells are not read, and rescores
what is there exactly. With all cells probed it is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.topk import Best, Factor, boosts, inside, key_ranks, query_blocks, query_ids, result_schema

#: Rows whose similarities to all queries are worked out at a time.
CHUNK = 2048
#: Vectors for each cell on which the cells are fitted: a bound on the sample, whatever the corpus.
SAMPLE = 256


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a whole vector of so many finite numbers, their vectors)."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    m = flat.reshape(len(at), dims)
    fine = np.isfinite(m).all(axis=1)
    return at[fine], m[fine]


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows by their length; zero vectors stay, so that their similarity to all is 0."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _vectors(asked: Sequence[Row]) -> np.ndarray:
    return _unit(np.array([a.query_vector for a in asked], float).reshape(len(asked), -1))


def _task(asked: list[Row], ids: pa.Array, k: int, key: str, query: str, column: str, factors, scope, probed: list[set[int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, best = _vectors(asked), Best(k, key)
        for b in batches:
            at, m = _matrix(b.column(column), wanted.shape[1])
            whole = pa.Table.from_batches([b]).drop_columns([column]).take(pa.array(at))
            for begin in range(0, len(at), CHUNK):
                rows = whole.slice(begin, CHUNK)
                # twelve places: equal vectors tie, whatever order a product sums in
                sims = np.round(_unit(m[begin : begin + CHUNK]) @ wanted.T, 12)
                ranks = key_ranks(rows, key)
                cells = rows.column("cell").to_numpy() if probed is not None else None
                for q, a in enumerate(asked):
                    some = np.arange(rows.num_rows) if cells is None else np.flatnonzero(np.isin(cells, list(probed[q])))
                    if len(some):
                        best.offer(rows, ranks, q, some, inside(rows, a, scope)[some], sims[some, q] * boosts(rows, a, factors)[some], sims[some, q])
        out = best.result(query, ids)
        if out is not None:
            yield from out.combine_chunks().to_batches()

    return run


def nearest(corpus: DataFrame, queries: DataFrame, k: int, key: str, query: str, column: str = "embedding", factors: Sequence[Factor] = (), scope: tuple[str, str] | None = None) -> DataFrame:
    """(query, inside, score, raw, the corpus's other columns): at least the k nearest rows of each query and side of its scope.

    queries: query, query_vector and what factors and scope read. raw is the cosine similarity, 0 for a zero vector; score
    is raw times the factors. Rows without a vector of the queries' length, or with numbers that are not finite, are left out.
    """
    fields = [f for f in corpus.schema.fields if f.name != column]
    schema = result_schema(queries.schema[query], fields)
    rows = corpus.where(F.col(column).isNotNull())
    out = []
    for asked in query_blocks(queries, query):
        ids = query_ids(asked, query, queries.schema[query].dataType)
        out.append(rows.mapInArrow(_task(asked, ids, k, key, query, column, factors, scope, None), schema) if asked else corpus.sparkSession.createDataFrame([], schema))
    return reduce(DataFrame.unionByName, out)


def fit_cells(corpus: DataFrame, cells: int, key: str, column: str = "embedding", seed: int = 7) -> np.ndarray:
    """Centres of at most so many cells: spherical k-means over at most about SAMPLE vectors a cell, those of the
    most common length with the least hashes of their keys."""
    usual = corpus.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return np.zeros((1, 1))
    share = SAMPLE * cells / usual["count"]
    near = F.lit(True) if share >= 1 else F.xxhash64(F.col(key), F.lit(seed)) <= int(-(2**63) + share * 2**64)
    some = corpus.where((F.size(column) == usual["dims"]) & F.exists(F.col(column), lambda x: x != 0) & near).select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=20, initMode="random").fit(some)
    return np.array([c for c in model.clusterCenters()])


def _assign(centres: np.ndarray, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _unit(centres)
        for b in batches:
            at, m = _matrix(b.column(column), unit.shape[1])
            cell = np.full(b.num_rows, -1, np.int32)
            cell[at] = (_unit(m) @ unit.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return run


def in_cells(corpus: DataFrame, centres: np.ndarray, column: str = "embedding") -> DataFrame:
    """The corpus with the cell of every row's vector, -1 where there is none to compare. Write it partitioned by `cell`."""
    return corpus.mapInArrow(_assign(centres, column), T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType())]))


def nearest_in_cells(filed: DataFrame, centres: np.ndarray, queries: DataFrame, probes: int, k: int, key: str, query: str, column: str = "embedding") -> DataFrame:
    """As nearest, among the rows of each query's nearest cells. `cell` is read from the file, so other cells are pruned."""
    fields = [f for f in filed.schema.fields if f.name != column]
    schema = result_schema(queries.schema[query], fields)
    unit, out = _unit(centres), []
    for asked in query_blocks(queries, query):
        near = np.argsort(-(_vectors(asked) @ unit.T), axis=1, kind="stable")[:, :probes] if asked else np.zeros((0, 0), int)
        probed = [set(x.tolist()) for x in near]
        rows = filed.where(F.col("cell").isin(*sorted(set().union(*probed))) & F.col(column).isNotNull())
        out.append(rows.mapInArrow(_task(asked, query_ids(asked, query, queries.schema[query].dataType), k, key, query, column, (), None, probed), schema))
    return reduce(DataFrame.unionByName, out)
