"""Toxicity and personal data: accuracy on held-out rows, brute force, hard rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, toxicity

from .helpers import HARD, SCHEMA, frame, rows


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    y = np.asarray(label)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def toxic_corpus(n=1500, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "er", "on", "th", "le", "ti"]) for _ in range(rnd.randint(1, 3)))
    texts, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.2
        w = [word() for _ in range(rnd.randint(30, 200))]
        if bad:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["Vlugmor!", "grubkin", "dworf."])
        texts.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = toxic_corpus()
    docs, lab = frame(spark, rows(texts), extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, lab).toPandas().sort_values("doc_id")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    y = np.array([t for _, _, t in labels])[got.doc_id]
    held = got.held_out.to_numpy()
    assert auc(got.score[held].to_numpy(), y[held]) > 0.99
    assert ((got.predicted == 1) == (got.score >= 0.5)).all() and ((got.predicted == y)[held]).mean() > 0.97


def test_held_out_labels_are_not_used(spark):
    texts, labels = toxic_corpus(400)
    docs = frame(spark, rows(texts))
    flipped = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    a, b = (toxicity.score(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, flipped))
    assert np.allclose(a, b)


def test_hard_rows_and_odd_labels(spark):
    texts, labels = toxic_corpus(200)
    data = rows(texts, start=1000) + HARD
    lab = spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels] + [(1000, 1, 1), (None, 1, 1), (1001, 1, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, data), lab).toPandas()
    assert len(got) == len(data) and got.score.between(0, 1).all()
    for none in ([], [(1, 1, 0)]):
        got = toxicity.score(frame(spark, HARD), spark.createDataFrame(none, "doc_id long, quality int, toxic int")).toPandas()
        assert len(got) == len(HARD) and got.score.between(0, 1).all()
    assert toxicity.score(spark.createDataFrame([], SCHEMA), lab).count() == 0


def brute_ratio(words, n1, n0):
    """Log ratio of each word from dictionaries of prefixes, one probability at a time."""
    D, H, end = toxicity.DISCOUNT, toxicity.HEAD, toxicity.END
    trees = [{}, {}, {}]
    for w, counts in zip(words, zip(n1, n0, (a + b for a, b in zip(n1, n0)))):
        for tree, c in zip(trees, counts):
            for i in range(min(H, len(w) + 1), len(w) + 2):
                tree[(w + end)[:i]] = tree.get((w + end)[:i], 0) + c
    keep = [lambda c: c - D if c > 1 else 0, lambda c: c - D if c > 1 else 0, lambda c: max(c - D, 0)]
    is_head = lambda x: len(x) == H or (len(x) < H and x.endswith(end))
    follows = {}
    for x, c in trees[2].items():
        if not is_head(x) and c:
            follows[x[-1]] = follows.get(x[-1], 0) + 1
    below = [{} for _ in trees]
    for t, tree in enumerate(trees):
        for x, c in tree.items():
            at = "" if is_head(x) else x[:-1]
            have = below[t].setdefault(at, [0, 0])
            have[0] += c
            have[1] += keep[t](c)

    def p(t, x, base):
        c, kept = below[t].get("" if is_head(x) else x[:-1], (0, 0))
        return (keep[t](trees[t].get(x, 0)) + (c - kept) * base) / c if c else base

    heads = sum(1 for x, c in trees[2].items() if is_head(x) and c)
    total = sum(follows.values()) + len(follows) + 1
    out = []
    for w in words:
        s, r = w + end, 0.0
        for i in range(min(H, len(s)), len(s) + 1):
            x = s[:i]
            if not is_head(x) and not trees[2].get(x[:-1], 0):
                break
            both = p(2, x, 1 / (heads + 1) if is_head(x) else (follows.get(x[-1], 0) + 1) / total)
            r += np.log(p(0, x, both) / p(1, x, both))
        out.append(r)
    return out


def test_ratios_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, toxicity.RUN))) for _ in range(400)} | {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))) for _ in range(80)})
    n1, n0 = ([rnd.choice((0, 0, 0, 1, 2, 7)) for _ in words] for _ in "10")
    want = dict(zip(words, brute_ratio(words, n1, n0)))
    heads = {}
    for w, *n in zip(words, n1, n0):
        heads.setdefault(toxicity.head_of(w), {})[w] = n
    counted = spark.createDataFrame([toxicity._counted_row(h, c) for h, c in heads.items()], toxicity.COUNTED).repartition(3)
    for spelled in (toxicity.SPELLED, 10):
        monkeypatch.setattr(toxicity, "SPELLED", spelled)
        got = toxicity.Spelling(words, np.array(n1), np.array(n0)).ratios(toxicity.base_of(counted))
        assert np.allclose(got, [want[w] for w in words], atol=1e-9)


def test_class_models_are_probabilities():
    """What follows a context sums to one in each class: kept counts and what the shared backoff gives out."""
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(200)})
    n = [np.array([float(rnd.choice((0, 1, 2, 9))) for _ in words]) for _ in "10"]
    tree = toxicity.Spelling(words, *n)
    node, _, counts = tree.nodes(toxicity.HEAD)
    for depth in range(toxicity.HEAD + 1, 8):
        below, begin, c = tree.nodes(depth)
        parent = node[begin]
        for k in (0, 1):
            kept = np.bincount(parent, toxicity.kept(c[k]), len(counts[k]))
            assert (kept <= counts[k] + 1e-9).all()
        node, counts = below, c


@pytest.mark.parametrize("small", [False, True])
def test_features_equal_brute_force(spark, monkeypatch, small):
    """Sums over words that stand in batches, tasks and partitions are those over each text."""
    if small:  # many batches, chunks and salts
        real_salted = toxicity._salted
        monkeypatch.setattr(toxicity, "_salted", lambda index, counted, parts: real_salted(index, counted, 40))
        for name, value in (("BATCH_TEXTS", 7), ("SPELLED", 10), ("HELD", 50)):
            monkeypatch.setattr(toxicity, name, value)
    texts, labels = toxic_corpus(150)
    texts += [texts[0], "", None, "ab " * 70_000, "grubkin " * 300]
    docs, lab = frame(spark, rows(texts)).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = {}
    real = toxicity._curve
    toxicity._curve = lambda found: seen.update(found=found) or real(found)
    try:
        toxicity.score(docs, lab).count()
    finally:
        toxicity._curve = real
    n = [Counter(), Counter()]
    for i, (t, y) in enumerate(zip(texts, [y for _, _, y in labels])):
        if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            n[1 - y].update(toxicity.units(t))
    words = sorted({w for t in texts for w in toxicity.units(t or "")})
    ratio = dict(zip(words, brute_ratio(words, [n[0][w] for w in words], [n[1][w] for w in words])))
    got = {r.doc_id: r for r in seen["found"].collect()}
    for i, t in enumerate(texts):
        c = Counter(toxicity.units(t or ""))
        strong = [max(ratio[w] - toxicity.EVIDENCE, 0) for w in c]
        want = (sum(c.values()), sum(k * ratio[w] for w, k in c.items()), sum(strong), sum(x**toxicity.POWER for x in strong))
        assert np.allclose((got[i].n, got[i].total, got[i].strong, got[i].peak), want, rtol=1e-4, atol=1e-3)


def test_no_labels_predict_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, HARD), none).collect()
    assert len(got) == len(HARD) and {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in HARD)


def test_ends_of_long_runs_count(spark):
    """Words alike in their first eight characters, and texts without spaces, are told apart by what follows."""
    rnd = random.Random(7)
    texts, y = [], []
    for i in range(1000):
        bad = rnd.random() < 0.3
        runs = ["".join(rnd.choice(["an", "er", "on", "th", "le", "ti"]) for _ in range(40)) for _ in range(3)]
        runs[1] = runs[1][:50] + ("vlugmorgrub" if bad else "vlugmorfolk") + runs[1][50:]
        texts.append("".join(runs) if i % 2 else " ".join(["commonwealth" + ("grub" if bad else "folk")] * 2 + ["other", "words"] * 10))
        y.append(int(bad))
    labels = spark.createDataFrame([(i, 1, k) for i, k in enumerate(y)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, rows(texts)), labels).toPandas().sort_values("doc_id")
    for odd in (0, 1):
        some = got[got.held_out & (got.doc_id % 2 == odd)]
        assert auc(some.score.to_numpy(), np.array(y)[some.doc_id]) > 0.9


def test_every_code_point_is_read():
    R = toxicity.RUN
    for n in range(1, 70):
        word = "".join(chr(97 + i % 26) for i in range(n))
        windows = [word[i : i + R] for i in range(max(n - R, 0) + 1)]
        assert list(toxicity.units(f"{word}, {word.upper()}!")) == [*windows, ",", *windows, "!"]
    assert list(toxicity.units("हिन्दी में f*ck 😀👍🏽 a_b e\u0301t\u00e9 $5\x00")) == ["हिन्दी", "में", "f", "*", "ck", "😀", "👍", "🏽", "a", "_", "b", "e\u0301té", "$", "5", "\x00"]
    assert list(toxicity.units("ภาษาไทยที่")) == ["ภาษาไทยที่"[i:] for i in range(10)]
    assert list(toxicity.units("漢字x漢")) == ["漢字", "字", "x", "漢"]
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(chr(rnd.choice([rnd.randrange(32, 0x300), rnd.randrange(32, 0x3000), rnd.randrange(0x3000, 0xD800), rnd.randrange(0x1F300, 0x1FA00)])) for _ in range(rnd.randrange(40)))
        assert toxicity.words_of(t.lower()) == toxicity._WORD.findall(t.lower())
        told = Counter("".join(toxicity.units(t)))
        assert all(told[c] >= n for c, n in Counter(t.lower()).items() if not c.isspace())


def test_marks_symbols_and_runs_decide(spark):
    """Texts that differ in vowel signs, in signs, in emoji or somewhere in a run without spaces are told apart."""
    rnd = random.Random(17)
    pairs = [("किताब", "कुताब"), ("f*ck", "f+ck"), ("😡😡", "😀😀"), ("สวัสดีชาวโลก", "สวัสดีชาวโฅก")]
    texts, y = [], []
    for i in range(1600):
        bad = rnd.random() < 0.3
        filler = "".join(rnd.choice("กขคง") for _ in range(9)) if i % 4 == 3 else " " + " ".join(rnd.choice(["one", "two", "three", "four"]) for _ in range(9)) + " "
        texts.append(filler + pairs[i % 4][0 if bad else 1] + filler)
        y.append(int(bad))
    labels = spark.createDataFrame([(i, 1, k) for i, k in enumerate(y)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, rows(texts)), labels).toPandas().sort_values("doc_id")
    for kind in range(4):
        some = got[got.held_out & (got.doc_id % 4 == kind)]
        assert auc(some.score.to_numpy(), np.array(y)[some.doc_id]) > 0.95, kind


# personal data

E_ = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I_ = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C_ = re.compile(r"[0-9]([\x20-]?[0-9])+")
P_ = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute_luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in E_.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in I_.finditer(t) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in C_.finditer(t) if 12 <= len(digits(m[0])) <= 19 and brute_luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in P_.finditer(t) if 9 <= len(digits(m[0])) <= 15])


def pii_texts(n=3000):
    rnd = random.Random(9)
    return ["".join(rnd.choice("ab.@@-+ 1234.0(é\n") for _ in range(rnd.randint(1, 60))) for _ in range(n)] + [
        "call +1 (323) 555-9830 or 4111 1111 1111 1111", "a.b@c.d.e@f.gg", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.0.0.1", "@" * 50, "a" * 20000 + "@", "+1+2+3 (4) 5-6.7 8", "1" * 5000 + ".1.1.1",
    ]


def test_base_rules_equal_brute_force():
    for t in pii_texts():
        assert pii.base_spans(t) == brute_pii(t), t


def test_found_spans(spark):
    data = rows(pii_texts(300), start=100) + HARD
    got = pii.find(frame(spark, data, extra=True).drop("spans")).collect()
    assert len(got) == len(data) and {r.doc_id for r in got} == {d for d, *_ in data}
    by = {d: t for d, t, *_ in data}
    for r in got:
        base = brute_pii(by[r.doc_id])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [s for s in r.spans.split(",") if s and not s.startswith("x_")] == said
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()


def planted(n, seed):
    """(texts, loose spans planted in them): personal data in forms that no base rule knows, beside decoys of the same shapes."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "er", "on", "th", "le", "ti"]) for _ in range(rnd.randint(1, 3)))
    fill = lambda: " ".join(word() for _ in range(rnd.randint(3, 20)))
    texts, spans = [], []
    for i in range(n):
        d = [str(rnd.randint(0, 255)) for _ in range(4)]
        card = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if brute_luhn(card + c))
        loose = rnd.choice([f"{word()} at {word()} dot com", f"{word()}.{word()} (at) {word()} (dot) org", " . ".join(d), "[.]".join(d), ".".join(card[j : j + 4] for j in (0, 4, 8, 12)), f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", f"{rnd.randint(200, 999)}-555-{rnd.randint(1000, 9999)}"])
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        decoy = rnd.choice([f"{word()} at {word()} and", " . ".join([*d[:3], "700"]), ".".join(wrong[j : j + 4] for j in (0, 4, 8, 12)), f"{rnd.randint(1, 28):02d}.{rnd.randint(1, 12):02d}.2023", str(rnd.randint(10**6, 10**10)), f"1.{rnd.randint(100, 999)}.{rnd.randint(100, 999)}"])
        a = fill()
        texts.append(f"{a} {loose} {fill()}. {decoy} {fill()}")
        spans.append((len(a) + 1, len(a) + 1 + len(loose)))
    return texts, spans


def known_forms(n, seed):
    rnd = random.Random(seed)
    out = []
    for t in planted(n, seed)[0]:
        card = "5" + "".join(rnd.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if brute_luhn(card + c))
        out.append(rnd.choice([f"a.b{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com", ".".join(str(rnd.randint(0, 255)) for _ in range(4)), card, f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"]).join([t[:40].rsplit(" ", 1)[0] + " ", " and more"]))
    return out


def test_added_spans_are_right(spark):
    """Trees that were trained on rewritten spans of a corpus find such forms in texts that they have not seen."""
    texts, spans = planted(700, 21)
    docs = frame(spark, rows(known_forms(1500, 22)) + rows(texts, start=10_000), extra=True)
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    hit = wrong = 0
    for i, (a, b) in enumerate(spans):
        added = [tuple(map(int, s.split(":")[1:])) for s in got[10_000 + i].split(",") if s.startswith("x_")]
        right = [min(b, y) - max(a, x) >= 0.8 * (max(b, y) - min(a, x)) for x, y in added]
        hit += any(right)
        wrong += right.count(False)
    assert hit >= 0.8 * len(spans) and wrong <= 0.1 * hit, (hit, wrong, len(spans))


def test_added_spans_equal_brute_force(spark):
    """Every candidate that its threshold selects is reported unless a base span or a likelier candidate overlaps it."""
    texts, _ = planted(200, 31)
    model = pii.redactor(frame(spark, rows(known_forms(800, 32))))
    assert model.trees is not None and min(model.limits) <= 1
    for t, spans in zip(texts, model.spans(texts)):
        base = brute_pii(t)
        assert [s for s in spans if s[1] < 4] == base
        good = []
        for a, k, b in pii.candidates(t):
            p = float(model.trees.predict(np.array([pii.features(t, a, k, b)]))[0])
            if p >= model.limits[k] and not any(x < b and a < y for x, _, y in base):
                good.append((p, a, k + 4, b))
        added = [s for s in spans if s[1] >= 4]
        assert all(any((a, k, b) == (x, j, y) for _, x, j, y in good) for a, k, b in added)
        for p, a, _, b in good:
            assert any(x < b and a < y for x, _, y in added)


def test_a_list_of_numbers_takes_linear_time():
    text = "; ".join(f"{200 + i % 700}-555-{1000 + i % 9000}" for i in range(30_000)) + " " + " ".join(str(i * 7919 % 10**6) for i in range(100_000))
    model = pii.Redactor([(3, True, f"call {n} now", 5, 5 + len(n)) for n in (f"+1 ({300 + i}) 555-{1000 + i}" for i in range(200))])
    assert model.trees is not None and model.limits[3] <= 1
    model.limits = [0.0] * 4
    began = time.time()
    assert len(model.spans([text])[0]) >= 29_999 and time.time() - began < 30


def test_ids_stay_exact(spark):
    data = [(2**60 + 1, "ip 10.0.0.1", "en", "s", 1), (None, "none", "en", "s", 1), (2**60 + 3, None, "en", "s", 1)]
    docs = frame(spark, data)
    want = sorted(str(d) for d, *_ in data)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (pii.find(docs), pii.redact(docs), toxicity.score(docs, lab)):
        assert sorted(str(r.doc_id) for r in df.collect()) == want


def test_boosting_fits_a_rule():
    rnd = np.random.RandomState(1)
    x = rnd.rand(800, 4)
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    assert ((pii.BoostedTrees().fit(x[:600], y[:600]).predict(x[600:]) > 0.5) == y[600:]).mean() > 0.97


def test_redaction_and_empty_tables(spark):
    docs = frame(spark, rows(["mail a.b@c.org now", None, "ip 10.0.0.1"]), extra=True)
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["mail [EMAIL] now", "", "ip [IP]"]
    mail = frame(spark, rows([f"write to u{i}@mail{i}.example.com or +1 ({200 + i}) 555-{1000 + i}" for i in range(300)] + ["write to anna (at) example (dot) org please"]))
    assert pii.redact(mail).where("doc_id = 300").first().text == "write to [EMAIL] please"
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0
