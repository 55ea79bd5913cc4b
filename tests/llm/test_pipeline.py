"""The pipeline against a brute-force version, stage by stage."""

import corpus_pipeline
from tessera.llm import mixing

from .helpers import BIG_ID, SCHEMA, brute_mix, frame, rows, shingles, words
from .test_copies import brute_links, near_copies
from .test_text_rules import brute_repeat, brute_secrets


def test_stages(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(20))
    texts = near_copies(groups=5, size=6) + ["too short", "leak " * 3 + item + " and some more words", "my token=abcdefghijklmnop is here with " + " ".join(f"z{i}" for i in range(30)), "again " * 50, None]
    data = rows(texts) + [(BIG_ID, "a document with an id beyond floats " + " ".join(f"y{i}" for i in range(30)), "en", "src1", None)]
    data += [(BIG_ID + 2, "another document with such an id " + " ".join(f"x{i}" for i in range(30)), "en", "src1", BIG_ID)]
    d = str(tmp_path)
    frame(spark, data).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        if name != "mix":
            assert docs.columns == frame(spark, []).columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    good = [x for x in data if len(words(x[1])) >= 20 and 100 * brute_repeat(x[1]) <= 30 * len(words(x[1]))]
    assert set(seen[0]) == {x[0] for x in good}
    _, roots = brute_links(good)
    assert set(seen[1]) == set(roots)
    clean = {x[0] for x in good if x[0] in roots and len(shingles(item) & shingles(x[1])) < 0.8 * len(shingles(item))}
    assert set(seen[2]) == set(seen[3]) == clean
    assert [i for i in clean if brute_secrets(seen[2][i].text)] and not [i for i in clean if brute_secrets(seen[3][i].text)]
    assert set(seen[4]) == clean and sum(r.taken for r in seen[4].values()) > 0
    assert {i: r.taken for i, r in seen[4].items()} == brute_mix([(i, r.text, r.source) for i, r in seen[3].items()])
    assert all(r.taken <= mixing.MAX_REPEAT * r.size for r in seen[4].values())


def test_run_gives_the_same(spark, small):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) for _ in range(2))
    assert a == b and a


def test_rows_pass_unchanged(spark, tmp_path):
    """Ids beyond floats beside a null one, and other whole numbers with nulls, come through all stages as they are."""
    d = str(tmp_path)
    text = lambda c: f"the document {c} has its own words " + " ".join(f"{c}{i}" for i in range(30))
    data = [(BIG_ID, text("a"), "en", "s", None), (None, text("b"), None, None, BIG_ID), (BIG_ID + 2, text("c"), "en", "s", 7)]
    docs = frame(spark, data)
    spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, data)), name


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
