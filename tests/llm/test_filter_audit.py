"""Filter interactions: brute force over all orders, hard rows, shared texts, empty tables."""

import itertools
import re

from tessera.llm import filter_audit

from .helpers import HARD, frame, rows, words

LABELS = "doc_id long, quality int, toxic int"


def brute(data, labels):
    """Every order applied to every document by itself."""
    least = {}
    for d, t, *_ in data:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    fails = []
    for d, t, lang, *_ in data:
        w, t = words(t), t or ""
        f = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d,
        }
        fails.append((lang or "", {x for x in f if f[x]}, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        docs = [x for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                all_f = [x for x in docs if f in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(all_f) - len(gone), sum(x[1] == {f} for x in docs), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def check(spark, data, labels, extra=False):
    df = frame(spark, data, extra)
    got = filter_audit.audit(filter_audit.cells(df, spark.createDataFrame(labels, LABELS))).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got)
    assert found == brute(data, labels)


def test_brute_force_on_hard_rows(spark):
    varied = " ".join(f"word{i}" for i in range(120))
    texts = [varied, varied, "  " + varied + " \n", varied.upper(), varied + " #1", "a b " * 80, "", " ", None, "|", varied.upper() + " |", "A" * 12 + "b" * 108, "Ab" * 5 + "c" * 90]
    data = HARD + rows(texts, start=100) + [(7, varied, "de", "src1", 1), (None, varied, "de", "src1", 1), (None, varied, None, "src1", 1), (100, varied, "de", "src0", 1), (2**60 + 3, varied, "fr", "s", 1)]
    labels = [(100, 1, 0), (101, 1, 1), (101, 0, 0), (7, None, 1), (4, 1, None), (None, 1, 1), (2**60 + 3, 1, 1), (999, 1, 1), (103, 0, 1)]
    check(spark, data, labels)
    check(spark, data, [], extra=True)


def test_one_text_in_most_documents(spark):
    varied = " ".join(f"word{i}" for i in range(120))
    data = [(1000 - i, varied if i % 3 else f"{varied} {i}", ("en", "de", None)[i % 7 % 3], "s", 1) for i in range(600)]
    check(spark, data, [(i, i % 2, int(i % 5 == 0)) for i in range(400, 1001)])


def test_empty_table(spark):
    assert filter_audit.audit(filter_audit.cells(frame(spark, []), spark.createDataFrame([], LABELS))).count() == 0
