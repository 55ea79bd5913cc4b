"""Postings with block maxima, nearest vectors and the inverted file, against brute force."""

import math
import os
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import nearest as N
from tessera.operators import postings as P
from tessera.operators import retrieval as R
from tessera.operators.topk import Factor, order_of

DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata")

BIG = 2**60 + 1
FACTORS = (Factor("company", "scope", 1.5), Factor("year", "years", 1.3))


def corpus(rnd, n=300):
    words = ["".join(rnd.choices("abcdefg0", k=rnd.choice((1, 2, 2, 3)))) for _ in range(60)]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(40))) for _ in range(n)]
    texts[10:20] = [texts[5]] * 10  # copies tie
    texts[20] = None
    texts[21] = "ÄB-c d.É"
    return [(BIG + 2 * i if i % 50 else (None if i == 150 else i), t, rnd.choice(["A", "B", None]), rnd.choice([2019, 2020, None])) for i, t in enumerate(texts)], words


def brute(docs, queries, k):
    """Per query and side of its scope the k best, every document scored."""
    out = {}
    for q, terms, scope, years in queries:
        for d, t, company, year in docs:
            w = re.findall("[a-z0-9]+", (t or "").lower())
            raw = round(sum(math.log1p(c) / math.log1p(len(w)) for x, c in Counter(w).items() if x in set(terms)), 9)
            if raw > 0:
                score = raw * (1.5 if scope is not None and company == scope else 1.0) * (1.3 if years is not None and year is not None and year in years else 1.0)
                out.setdefault((q, scope is None or company == scope), []).append((-score, d is not None, d or 0, raw))
    return {at: sorted(x)[:k] for at, x in out.items()}


@pytest.mark.parametrize("block", [7, 4096])
def test_search_is_exact_whatever_the_blocks(spark, block):
    rnd = random.Random(block)
    docs, words = corpus(rnd)
    queries = [(i, rnd.choices(words, k=rnd.choice((1, 3, 8))), rnd.choice(["A", "Z", None]), rnd.choice([[2019], [], None])) for i in range(25)]
    queries += [(100, [], None, None), (101, ["nothing"], None, None), (102, ["a", "a", "b"], None, None)]
    df = spark.createDataFrame(docs, "id long, text string, company string, year int").repartition(3)
    lists = P.postings(df, "id", "text", ["company", "year"], block)
    asked = spark.createDataFrame(queries, "q int, terms array<string>, scope string, years array<int>")
    found = P.search(lists, asked, 5, "id", "q", FACTORS, ("company", "scope"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    got = {}
    for r in R.ranked(found, ["q", "inside"], order_of("score", "id")).where("rank <= 5").orderBy("rank").collect():
        got.setdefault((r.q, r.inside), []).append((-r.score, r.id is not None, r.id or 0, r.raw))
    want = brute(docs, queries, 5)
    assert got.keys() == want.keys()
    for at in want:
        assert [x[1:3] for x in got[at]] == [x[1:3] for x in want[at]]
        assert [x[0] for x in got[at]] == pytest.approx([x[0] for x in want[at]])


def test_blocks_are_skipped_by_their_maxima(monkeypatch):
    """A short document in the first block: of the blocks of long ones no list is opened, but for one that may tie."""
    monkeypatch.setattr(P, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = ["x y"] + ["x " + " ".join(f"w{i}" for i in range(30))] * 35 + ["x z"] + ["q"] * 3
    rows = pa.array([{"id": i} for i in range(40)], pa.struct([("id", pa.int64())]))
    blocks = list(P._build(4)([pa.RecordBatch.from_arrays([rows, pa.array(texts)], ["row", "text"])]))
    assert [b.column("block")[0].as_py() for b in blocks] == list(range(10))
    opened = []
    monkeypatch.setattr(P._Block, "scores", lambda self, held, inner=P._Block.scores: opened.append(self.rows.column("id")[0].as_py()) or inner(self, held))
    best = P.scan(blocks, [Row(q=1, terms=["x"])], 1, "id", (), None)
    assert opened == [0, 36]
    assert [x[2] for x in best.found[0, True]] == [0]


def test_conjunctive_matches(spark):
    rnd = random.Random(3)
    docs, words = corpus(rnd)
    queries = [(i, rnd.choices(words, k=rnd.choice((1, 2, 3)))) for i in range(40)] + [(98, []), (99, ["a", "nothing"])]
    lists = P.postings(spark.createDataFrame(docs, "id long, text string, company string, year int"), "id", "text", block=16)
    got = sorted((r.q, r.id or 0, r.hits) for r in P.matches(lists, spark.createDataFrame(queries, "q int, terms array<string>"), "q").collect())
    has = [(d, set(re.findall("[a-z0-9]+", (t or "").lower()))) for d, t, *_ in docs]
    assert got == sorted((q, d or 0, len(set(terms))) for q, terms in queries if terms for d, w in has if set(terms) <= w)


def test_written_postings_and_more_documents(spark, tmp_path):
    """A table that was written, with blocks of later documents appended, is searched as a whole."""
    rnd = random.Random(8)
    docs, words = corpus(rnd)
    schema = "id long, text string, company string, year int"
    for part in (docs[:200], docs[200:]):
        P.postings(spark.createDataFrame(part, schema), "id", "text", block=32).write.mode("append").parquet(str(tmp_path / "lists"))
    asked = spark.createDataFrame([("one", words[:4])], "q string, terms array<string>")
    found = R.ranked(P.search(spark.read.parquet(str(tmp_path / "lists")), asked, 9, "id", "q"), "q", order_of("score", "id")).where("rank <= 9").orderBy("rank").collect()
    want = brute(docs, [("one", words[:4], None, None)], 9)["one", True]
    assert [r.id or 0 for r in found] == [x[2] for x in want]


def test_string_keys_and_empty_tables(spark):
    lists = P.postings(spark.createDataFrame([("é", "x y"), ("b", "x y"), ("", "x y"), (None, "x y")], "id string, text string"), "id", "text")
    asked = spark.createDataFrame([(1, ["x"])], "q int, terms array<string>")
    found = R.ranked(P.search(lists, asked, 3, "id", "q"), "q", order_of("score", "id")).where("rank <= 3").orderBy("rank").collect()
    assert [r.id for r in found] == [None, "", "b"]
    assert P.search(lists, asked.where("q = 2"), 3, "id", "q").count() == 0
    assert P.search(P.postings(spark.createDataFrame([], "id string, text string"), "id", "text"), asked, 3, "id", "q").count() == 0


def test_nearest_is_exact(spark):
    rnd = random.Random(5)
    rows = [(BIG + i if i % 40 else None, [rnd.gauss(0, 1) for _ in range(6)], rnd.choice("AB")) for i in range(200)]
    rows[3:8] = [(BIG + 3 + i, rows[50][1], "A") for i in range(5)]  # equal vectors tie
    rows += [(1, [0.0] * 6, "A"), (2, None, "A"), (3, [1.0] * 5, "A"), (4, [float("nan")] + [1.0] * 5, "A")]
    asked = [(i, [rnd.gauss(0, 1) for _ in range(6)], rnd.choice(["A", None])) for i in range(9)] + [(50, rows[50][1], None), (51, [0.0] * 6, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, company string").repartition(4)
    q = spark.createDataFrame(asked, "q int, query_vector array<double>, scope string")
    found = N.nearest(df, q, 4, "id", "q", factors=(Factor("company", "scope", 1.5),), scope=("company", "scope"))
    got = {}
    for r in R.ranked(found, ["q", "inside"], order_of("score", "id")).where("rank <= 4").orderBy("rank").collect():
        got.setdefault((r.q, r.inside), []).append((r.id, round(r.raw, 9)))
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for i, v, scope in asked:
        sides = {}
        for d, e, c in rows:
            if e and len(e) == 6 and all(map(math.isfinite, e)):
                cos = sum(a * b for a, b in zip(e, v)) / (norm(e) * norm(v)) if norm(e) * norm(v) else 0.0
                cos = round(cos, 12)
                sides.setdefault(scope is None or c == scope, []).append((-cos * (1.5 if c == scope else 1.0), d is not None, d or 0, cos))
        for side, x in sides.items():
            want = sorted(x)[:4]
            assert [(d or 0, c) for d, c in got[i, side]] == [(w[2], pytest.approx(w[3], abs=1e-8)) for w in want]


def recalls(spark, e, path, probes):
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query_vector"))
    centres = N.fit_cells(e, 16, "vec_id")
    assert len(centres) <= 16
    N.in_cells(e, centres).write.partitionBy("cell").parquet(path)
    filed = spark.read.parquet(path)
    top = lambda found: {(r.q, r.vec_id) for r in R.ranked(found, "q", order_of("raw", "vec_id")).where("rank <= 10").collect()}
    exact = top(N.nearest(e, q, 10, "vec_id", "q"))
    assert top(N.nearest_in_cells(filed, centres, q, 16, 10, "vec_id", "q")) == exact
    one = N.nearest_in_cells(filed, centres, q.where("q = 0"), 1, 10, "vec_id", "q")
    assert re.search(r"PartitionFilters: \[[^\]]*cell", one._jdf.queryExecution().executedPlan().toString())
    assert one.select("cell").distinct().count() == 1
    return [len(exact & top(N.nearest_in_cells(filed, centres, q, p, 10, "vec_id", "q"))) / len(exact) for p in probes]


def test_inverted_file_of_vectors_in_groups(spark, tmp_path):
    """Vectors around forty directions: three cells of sixteen hold the nearest."""
    rnd = random.Random(9)
    middle = [[rnd.gauss(0, 1) for _ in range(32)] for _ in range(40)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in middle[i % 40]]) for i in range(2000)] + [(2001, None), (2002, [1.0])]
    assert recalls(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), str(tmp_path / "cells"), [3])[0] >= 0.95


def test_inverted_file_of_vectors_without_groups(spark, tmp_path):
    """The test table's vectors have no direction in common (the nearest are at 0.4), the worst case: it takes most cells."""
    few, most = recalls(spark, spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").select("vec_id", "embedding"), str(tmp_path / "cells"), [4, 14])
    assert few < most and most >= 0.95


def test_texts_are_searched_block_by_block(spark):
    """Texts searched where they lie give what stored lists give; Python runs once a task and holds no whole batch of words."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 40)), "c", 2019) for i in range(400)], "id long, text string, company string, year int")
    asked = spark.createDataFrame([(1, ["w0", "w3"], "c", [2019]), (2, ["w96"], None, None), (3, ["none"], None, None)], "q int, terms array<string>, scope string, years array<int>")
    lists = P.postings(docs, "id", "text", ["company", "year"], 16)
    both = [P.search(lists, asked, 500, "id", "q", FACTORS, ("company", "scope")), P.search_texts(docs, asked, 500, "id", "text", "q", ["company", "year"], FACTORS, ("company", "scope"), 16)]
    a, b = (sorted(map(tuple, x.collect())) for x in both)
    assert a == b and a
    plans = [x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for x in both]
    assert plans == [2, 1]
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(P.matches(lists.select("*"), asked, "q")) == key(P.matches_texts(docs, asked, "id", "text", "q", ["company", "year"], 16)) != []


def test_building_lists_holds_numbers_only(monkeypatch):
    """Half a million postings of many equal words in one batch: a posting is a number, not a word of its own."""
    texts = [" ".join(f"word{(i + k * 13) % 3001}" for k in range(250)) for i in range(2000)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([ids], ["id"]), pa.array(texts)], ["row", "text"])
    monkeypatch.setattr(P, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    tracemalloc.start()
    blocks = sum(b.num_rows for b in P._build(P.BLOCK)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert blocks == 1 and peak < 40e6
