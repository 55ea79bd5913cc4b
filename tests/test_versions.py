"""Versioned tables, resumable runs, digests and logs: kills at every step, concurrent writers, cases of whole-group replacement."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import integrity as I
from tessera.operators import relabel as L
from tessera.operators import resumable
from tessera.operators import versions as V

SCHEMA = "k long, i int, v string"
BIG = 2**60 + 1


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    root = str(tmp_path)
    first = [(k, 0, "a") for k in range(40)] + [(BIG, 0, "a"), (None, 0, "a")]
    v1 = V.merge(spark, root, frame(spark, first), ["k", "i"], ["k"], parts=8)
    v2 = V.merge(spark, root, frame(spark, [(3, 0, "b"), (3, 1, "b")]), ["k", "i"])
    assert (v1.number, v2.number) == (1, 2)
    assert sum(v1.folders[p] != v2.folders[p] for p in v1.folders) == 1
    assert rows(V.read(spark, root)) == sorted([*[r for r in first if r[0] != 3], (3, 0, "b"), (3, 1, "b")], key=repr)
    assert rows(V.read(spark, root, 1)) == sorted(first, key=repr)  # a version that was opened stays
    with pytest.raises(FileNotFoundError):
        V.read(spark, root, 9)


def test_a_kill_at_any_step_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    V.merge(spark, root, frame(spark, [(1, 0, "a")]), ["k", "i"], ["k"])
    before = rows(V.read(spark, root))

    def die(*_):
        raise RuntimeError("killed")

    # before anything is visible: while rows are written, and before the version is renamed
    bad = frame(spark, [(1, 0, "b")]).withColumn("v", F.expr("raise_error('killed')").cast("string"))
    with pytest.raises(Exception, match="killed"):
        V.merge(spark, root, bad, ["k", "i"])
    assert rows(V.read(spark, root)) == before
    with monkeypatch.context() as m:
        m.setattr(V, "commit", die)
        with pytest.raises(RuntimeError, match="killed"):
            V.merge(spark, root, frame(spark, [(1, 0, "b"), (2, 0, "b")]), ["k", "i"])
    assert rows(V.read(spark, root)) == before and V.numbers(spark, root) == [1]
    V.merge(spark, root, frame(spark, [(1, 0, "b"), (2, 0, "b")]), ["k", "i"])
    assert rows(V.read(spark, root)) == [(1, 0, "b"), (2, 0, "b")]
    assert V.vacuum(spark, root, keep=1) >= 2  # what the kills left, and the first version
    assert rows(V.read(spark, root)) == [(1, 0, "b"), (2, 0, "b")] and V.numbers(spark, root) == [2]


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    V.merge(spark, root, frame(spark, [(1, 0, "a")]), ["k", "i"], ["k"])
    stale = V.version(spark, root)
    V.merge(spark, root, frame(spark, [(1, 0, "b")]), ["k", "i"])
    monkeypatch.setattr(V, "version", lambda *_: stale)
    with pytest.raises(V.ConcurrentWrite):
        V.merge(spark, root, frame(spark, [(1, 0, "c")]), ["k", "i"])
    monkeypatch.undo()
    assert rows(V.read(spark, root)) == [(1, 0, "b")]


def test_groups_are_replaced_whole(spark, tmp_path):
    root, schema = str(tmp_path), "k long, i int, v string, e array<double>"
    make = lambda k, n, v: [(k, i, v, [1.0, 2.0]) for i in range(n)]
    V.replace_groups(spark, root, frame(spark, make(17, 3, "a") + make(18, 2, "a"), schema), "k", "i", {"e": 2})
    V.replace_groups(spark, root, frame(spark, make(17, 2, "b")[::-1], schema), "k", "i", {"e": 2})
    assert [r[:3] for r in rows(V.read(spark, root))] == [(17, 0, "b"), (17, 1, "b"), (18, 0, "a"), (18, 1, "a")]
    for bad, message in (
        (make(0, 1, "x"), "positive k"), (make(None, 1, "x"), "positive k"), (make(17, 3, "x")[1:], "gaps or repeats"), (make(17, 2, "x") + make(17, 1, "x"), "gaps or repeats"),
        ([(17, 0, "x", [1.0])], "2 finite numbers"), ([(17, 0, "x", [1.0, float("nan")])], "2 finite numbers"), ([(17, 0, "x", None)], "2 finite numbers"),
    ):
        with pytest.raises(ValueError, match=message):
            V.replace_groups(spark, root, frame(spark, bad, schema), "k", "i", {"e": 2})
    assert V.numbers(spark, root) == [1, 2]
    V.replace_groups(spark, root, frame(spark, [], schema), "k", "i", groups=frame(spark, [(18, 0, "", [])], schema))
    assert [r[:2] for r in rows(V.read(spark, root))] == [(17, 0), (17, 1)]


def test_write_once(spark, tmp_path):
    path = f"{tmp_path}/contract"
    assert V.write_once(spark, path, {"b": 1, "a": [2]}) and not V.write_once(spark, path, {"a": [2], "b": 1})
    with pytest.raises(ValueError, match="another value"):
        V.write_once(spark, path, {"a": [2], "b": 2})


def lengths(texts):
    return texts.select("k", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("n"))


def test_a_stopped_run_ends_as_one_that_was_not(spark, tmp_path):
    inputs = frame(spark, [(BIG + i, "x" * (i % 5)) for i in range(40)], "k long, t string")
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    want = rows(resumable.run(spark, inputs, "k", {"model": "a"}, lengths, whole, pages=4))
    calls = []

    def dying(df):
        calls.append(rows(df))
        if len(calls) == 3:
            raise RuntimeError("killed")
        return lengths(df)

    with pytest.raises(RuntimeError, match="killed"):
        resumable.run(spark, inputs, "k", {"model": "a"}, dying, cut, pages=4)
    assert 0 < V.read(spark, f"{cut}/done").count() < 40
    assert rows(resumable.run(spark, inputs, "k", {"model": "a"}, dying, cut, pages=4)) == want
    assert rows(V.read(spark, f"{cut}/outputs")) == rows(V.read(spark, f"{whole}/outputs")) == rows(lengths(inputs))
    seen = [r for page in [*calls[:2], *calls[3:]] for r in page]
    assert len(seen) == len(set(seen)) == 40  # what was done is not done again
    before = len(calls)
    changed = inputs.withColumn("t", F.when(F.col("k") == BIG, "xxxxxxx").otherwise(F.col("t")))
    resumable.run(spark, changed, "k", {"model": "a"}, dying, cut, pages=4)
    assert [r[0] for page in calls[before:] for r in page] == [BIG]  # another input under the same key is
    assert rows(V.read(spark, f"{cut}/outputs")) == rows(lengths(changed))
    with pytest.raises(resumable.OtherContract):
        resumable.run(spark, inputs, "k", {"model": "b"}, lengths, cut)


def test_kill_between_results_and_note(spark, tmp_path, monkeypatch):
    inputs, root = frame(spark, [(i, "xy") for i in range(6)], "k long, t string"), str(tmp_path)
    merge = V.merge

    def half(spark_, to, *a, **kw):
        if to.endswith("/done"):
            raise RuntimeError("killed")
        return merge(spark_, to, *a, **kw)

    monkeypatch.setattr(V, "merge", half)
    with pytest.raises(RuntimeError, match="killed"):
        resumable.run(spark, inputs, "k", {}, lengths, root, pages=1)
    monkeypatch.undo()
    assert resumable.run(spark, inputs, "k", {}, lengths, root, pages=1).count() == 6
    assert rows(V.read(spark, f"{root}/outputs")) == rows(lengths(inputs))


def test_digest_states_add_up(spark):
    rnd = random.Random(2)
    data = [(rnd.randrange(9), i, rnd.choice(["a", None, ""])) for i in range(60)] * 2
    whole = I.content_digest(frame(spark, data), ["k", "i", "v"], ["k"])
    a, b = frame(spark, data[:70]), frame(spark, data[70:])
    state = lambda df: I.state(df, ["k", "i", "v"], ["k"])
    assert rows(I.finished(I.merged(state(a), state(b), ["k"]))) == rows(whole.select("k", "n_rows", "digest"))
    left = I.finished(I.merged(state(frame(spark, data)), state(b), ["k"], -1))
    assert rows(left.where("n_rows > 0")) == rows(I.finished(state(a)))
    assert I.content_digest(frame(spark, data[1:]), ["k"]).first().digest != I.content_digest(frame(spark, data), ["k"]).first().digest
    assert I.content_digest(frame(spark, []), ["k"]).first().n_rows == 0
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def log(n, files):
    out, last = [], None
    for i in range(n):
        payload = f"entry {i}"
        own = hashlib.sha256(((last or "") + payload).encode()).hexdigest()
        out.append([i * files // n, i, payload, last, own])
        last = own
    return out


def test_broken_links_are_found_also_at_borders(spark):
    schema = "file int, n int, payload string, previous string, own string"
    check = lambda entries: sorted(r.n for r in I.chained(frame(spark, entries, schema), "file", "n", "payload", "previous", "own").collect())
    good = log(40, 5)
    assert check(good) == []
    assert check([x for x in good if x[1] != 8]) == [9]  # the first entry of a file is lost, its last border too
    assert check([x for x in good if x[1] != 7]) == [8]  # the last entry of a file
    assert check([x for x in good if x[0] != 2]) == [24]  # a whole file
    changed = [list(x) for x in good]
    changed[20][2] = "other"
    assert check(changed) == [20]
    changed[20][4] = hashlib.sha256((changed[20][3] + "other").encode()).hexdigest()
    assert check(changed) == [21]
    assert check([x for x in good if x[1] > 0]) == [1]
    plan = I.chained(frame(spark, good, schema), "file", "n", "payload", "previous", "own")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_relabelling_by_content_then_position(spark):
    risk, mines = L.RISK, L.MINES
    cases = {  # filing: (section, text) of its chunks in order, expected basis of the runs
        1: ([(risk, "interest rate\nrisk"), (risk, "more"), ("Risk Factors", ""), (mines, "none")], ["content:part-i", "position:after-part-ii"]),
        2: ([(risk, "default upon senior securities")], ["content:part-ii"]),
        3: ([(mines, "internal control and mine safety"), ("Legal Proceedings", "")], ["mixed:position-tiebreak"]),
        4: ([("Legal Proceedings", ""), (mines, "internal control and mine safety")], ["mixed:position-tiebreak"]),
        5: ([(mines, "internal control and mine safety")], ["mixed:no-anchor-default-part-i"]),
        6: ([(risk, None), ("Risk Factors", "")], ["position:before-part-ii"]),
        7: ([(risk, "")], ["unresolved"]),
        8: ([(risk, "hedging"), ("MD&A", ""), (risk, "senior securities")], ["content:part-i", "content:part-ii"]),
    }
    data = [(k, i, s, t) for k, (chunks, _) in cases.items() for i, (s, t) in enumerate(chunks)]
    df = frame(spark, data, "k long, i int, section string, text string")
    plan = L.runs(df, "k", "i", "section", "text")
    got = {}
    for r in plan.orderBy("k", "first").collect():
        got.setdefault(r.k, []).append((r.basis, r.target is not None))
    assert {k: [b for b, _ in v] for k, v in got.items()} == {k: v for k, (_, v) in cases.items()}
    assert [got[k][0][1] for k in (1, 2, 3, 4, 5, 6, 7)] == [True, False, True, False, True, True, False]
    new = {(r.k, r.i): r.section for r in L.relabelled(df, plan, "k", "i", "section").collect()}
    assert len(new) == len(data) and new[1, 0] == new[1, 1] == L.TARGETS[risk] and new[1, 3] == mines and new[3, 0] == L.TARGETS[mines] and new[8, 2] == risk
    moved = df.withColumn("section", F.when(F.col("k") == 1, "MD&A").otherwise(F.col("section")))
    assert {r.section for r in L.relabelled(moved, plan, "k", "i", "section").where("k = 1").collect()} == {"MD&A"}  # changed meanwhile
    assert {(r.k, r.runs) for r in L.repeated_targets(df, "k", "i", "section").collect()} == {(8, 2)}
    assert {r.basis: (r.runs, r.renamed) for r in L.basis_counts(plan).collect()}["mixed:position-tiebreak"] == (2, 1)


def test_relabelling_in_one_pass(spark):
    """The same names as by a plan that is joined; keys are dealt and sorted once, however the index was numbered."""
    import random

    r = random.Random(7)
    texts = ["hedging", "mine act", "senior securities", "disclosure controls", "", None]
    labels = [L.RISK, L.MINES, "Risk Factors", "MD&A", None]
    data = [(k if k < 60 else None, i, s, r.choice(texts)) for k in range(61) for s, i in zip(r.choices(labels, [4, 4, 1, 1, 1], k=30), sorted(r.sample(range(40), 30)))]
    df = frame(spark, data, "k long, i int, section string, text string").withColumn("place", F.col("i") * 10)
    plan = L.runs(df, "k", "i", "section", "text")
    assert plan.select("basis").distinct().count() == 7 and plan.where("k IS NULL").count() and not plan.where("k IS NULL AND target IS NOT NULL").count()
    want = sorted(L.relabelled(df, plan, "k", "i", "section").select("k", "i", "section").collect(), key=repr)
    for order in ((), ("place",), ("place", "i")):
        assert sorted(L.renamed(df, "k", "i", "section", "text", order=order).collect(), key=repr) == want
    assert len(want) == len(data) and {x.section for x in want} == {*labels, *L.TARGETS.values()}
    bare = frame(spark, [(1, 0, L.RISK, "hedging"), (1, None, L.RISK, "hedging"), (1, None, L.RISK, "hedging")], "k long, i int, section string, text string")
    assert sorted(map(tuple, L.renamed(bare, "k", "i", "section", "text").collect()), key=repr) == [(1, 0, L.TARGETS[L.RISK])] + 2 * [(1, None, L.RISK)]


def test_relabelling_sorts_keys_once(spark, small):
    from tessera.plans.relational_plans import section_relabel

    plan = section_relabel(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert "section" not in plan[plan.index("Sort [") :]


def test_calibration_of_the_gate(spark):
    from tessera.operators import evaluation as E

    pool = [(q, c, i + 1) for q, cs in ((1, [0.9, 0.8, 0.7]), (2, [0.8, 0.6, 0.5]), (3, [0.3, 0.2, 0.1]), (4, [0.4, 0.2])) for i, c in enumerate(cs)]
    m = E.gate_measures(frame(spark, pool, "q int, cos_sim double, rank int"), "q").withColumn("inside", F.col("q") <= 2)
    got = {(r.measure, r.inside): r for r in E.calibration(m, "inside").collect()}
    assert got["top1", True].low == 0.8 and got["top1", False].high == 0.4
    assert got["top1", True].floor == pytest.approx(0.5) and (got["top1", True].refused, got["top1", False].refused) == (0.0, 1.0)
    assert got["mean3", True].floor == pytest.approx(0.3 + 0.25 * (1.9 / 3 - 0.3))
    mixed = m.withColumn("inside", F.col("q") % 2 == 1)
    assert all(r.floor == r.median for r in E.calibration(mixed, "inside").collect() if not r.inside)
    cases = frame(spark, [(True, False, "supported", "supported"), (True, True, "refuted", "supported"), (False, False, "abstain", "abstain")], "p boolean, n boolean, v string, e string")
    assert tuple(E.hint_scores(cases, "p", "n", "v", "e").first()) == (3, 2, 0.3333, 0.5, 0.6667)
