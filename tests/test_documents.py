from pyspark.sql import functions as F

from tessera.operators import chunking as K

BIG = 2**60 + 1


def test_table_rows_inherit_context(spark):
    t = "[TABLE] Sales\n[HEADER] Item | A\n[ROW] 2023 | 2022\n[ROW] Cars | 1\n[ROW] Notes | none\n[ROW] Cars | 2\n[ROW] Cars | 1\n[/TABLE]"
    rows = [(BIG, 0, t), (BIG, 1, "plain"), (None, 0, "[TABLE] T\n[ROW] a | 1"), (BIG + 2, 0, "[TABLE] T\n[ROW] 1\n[/TABLE]"), (3, 0, None)]
    got = K.table_rows(spark.createDataFrame(rows, "k long, idx int, text string"), "k").orderBy("k", "child_index").collect()
    head = "Sales\nItem | A\n2023 | 2022"
    assert [(r.k, r.child_index, r.text) for r in got] == [
        (BIG, 0, f"{head}\nCars | 1"), (BIG, 1, f"{head}\nNotes | none\nCars | 2"), (BIG, 2, f"{head}\nNotes | none\nCars | 1"), (BIG + 2, 0, "T\n1"),
    ]


def test_ids_that_no_float_holds(spark):
    """Long ids beside nulls stay what they are in chunks and vectors."""
    rows = [(BIG, 0, "s", "narrative", "Words of a text that is long enough to be kept as one chunk."), (None, 0, "s", "narrative", "x" * 80), (BIG + 2, 1, None, "table", "[TABLE] T\n[ROW] a | 1\n[/TABLE]"), (4, 0, "s", "narrative", None)]
    df = spark.createDataFrame(rows, "k long, idx int, section string, kind string, text string")
    assert {r.k for r in K.chunks(df, "k", "sec").collect()} >= {BIG, BIG + 2, None}
    assert {r.k for r in K.embedded(df, "k").collect()} == {BIG, None, BIG + 2, 4}


def test_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None), (4, "x")], "k int, t string")
    got = [(r.k, r.text) for r in K.windows(df, "k", F.col("t"), 4, 2).orderBy("k", "chunk_index").collect()]
    assert got == [(1, "a b c d"), (1, "c d e f"), (1, "e f g"), (4, "x")]


def test_packed_sentences_overlap():
    text = " ".join(f"Sentence number {i} has exactly seven words." for i in range(4))
    got = K.packed_sentences(text, 14, 7)
    assert len(got) == 3
    for (a, _), (b, _) in zip(got, got[1:]):
        assert a.split(". ")[-1].rstrip(".") == b.split(". ")[0].rstrip(".")
    assert K.packed_sentences("short", 14, 7) == []


def test_packed_sentences_fall_back_to_windows():
    assert len(K.packed_sentences("word " * 100, 30, 5)) > 3


def test_packed_rows_repeat_title_and_header():
    table = "\n".join(["[TABLE] T", "[HEADER] a | b", *[f"[ROW] r{i} | {i}" for i in range(8)], "[/TABLE]"])
    got = K.packed_rows(table, 20, 1)
    assert len(got) > 1 and all(c.startswith("[TABLE] T\n[HEADER] a | b\n[ROW]") for c, _ in got)
    assert {x for c, _ in got for x in c.split("\n") if x.startswith("[ROW]")} == {f"[ROW] r{i} | {i}" for i in range(8)}


def test_turns_and_pairs(spark):
    p = spark.createDataFrame([(1, 0, None, "intro"), (1, 1, "Ann", "hi"), (1, 2, None, "more"), (1, 3, "Bob", "yes")], "k int, o int, s string, b string")
    t = K.speaker_turns(p, "k", "o", F.col("s"), F.col("b"))
    assert [(r.speaker, r.text) for r in t.orderBy("turn").collect()] == [("Unknown", "intro"), ("Ann", "hi\n\nmore"), ("Bob", "yes")]
    assert [r.text for r in K.qa_pairs(t, "k").orderBy("pair").collect()] == ["Unknown: intro\n\nAnn: hi\n\nmore", "Bob: yes"]


def test_transcript_sections(spark):
    d = spark.createDataFrame([(1, "Hello all. Question-and-answer: what? This concludes our call."), (2, "Only remarks")], "k int, t string")
    got = {r.k: (r.prepared, r.qa, r.closing) for r in K.transcript_sections(d, "k", F.col("t")).collect()}
    assert got[1] == ("Hello all. ", "Question-and-answer: what? ", "This concludes our call.") and got[2] == ("Only remarks", "", "")


def test_submission_documents(spark):
    from tessera.sources import tables as T

    doc = lambda kind, text: f"<DOCUMENT>\n<TYPE>{kind}\n<TEXT>{text}</TEXT>\n</DOCUMENT>\n"
    sub = doc("10-K", "main") + doc("EX-13", "Balance sheet and net income") + doc("EX-13.1", "Balance sheet and net income, longer") + doc("EX-21", "list") + doc("10-K", "second")
    texts = spark.createDataFrame([(1, sub), (2, "no blocks")], "k int, text string")
    docs = T.submission_documents(texts, "k")
    assert docs.count() == 5
    got = T.primary_documents(docs, spark.createDataFrame([(1, "10-K")], "k int, form string"), "k").orderBy("role").collect()
    assert [(r.role, r.type, r.text) for r in got] == [("annual_report", "EX-13.1", "Balance sheet and net income, longer"), ("primary", "10-K", "main")]


def test_body_of_filing(spark):
    body = "x" * 300
    texts = spark.createDataFrame([(f"cover\nItem 1. Business\n{body}\nSIGNATURES\nnames",), (body,)], "t string")
    got = [r[0] for r in texts.select(K.body_of_filing(F.col("t"))).collect()]
    assert got[0].strip().startswith("Item 1.") and "names" not in got[0] and got[1] == body


def test_embedding_is_a_unit_vector(spark):
    got = K.embedded(spark.createDataFrame([(1, "net sales"), (2, None)], "k int, text string"), "k", dim=8).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in got)
