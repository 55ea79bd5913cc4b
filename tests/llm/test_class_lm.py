"""Class bigrams: scores recomputed word by word, sums to 1, exchange against full likelihoods, planted classes, hard rows."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import class_lm

from .helpers import HARD, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SIZES = {"classes": 5, "contexts": 12, "lexicon": 25, "least": 2}


def words(t):
    return [w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def sentences(n, seed, start=0):
    """Two languages whose words take turns: a noun of many, then a verb of many."""
    rnd = random.Random(seed)
    kinds = [[f"{p}{k}{i}" for i in range(m)] for p in "xy" for k, m in (("n", 30), ("v", 30))]
    out = []
    for i in range(n):
        a, b = kinds[:2] if rnd.random() < 0.6 else kinds[2:]
        w = []
        for _ in range(rnd.randrange(12)):
            w += [a[min(int(rnd.expovariate(0.15)), 29)], b[min(int(rnd.expovariate(0.15)), 29)]]
        w += [f"rare{rnd.randrange(400)}"] if rnd.random() < 0.3 else []
        out.append(" ".join(w).upper() if rnd.random() < 0.1 else "\n".join(w))
    return rows(out, start=start)


def brute(data, model):
    """Scores in plain Python, with the classes of the lexicon as the model has them."""
    train = [words(t) for d, t, *_ in data if not held(d)]
    count = Counter(w for t in train for w in [*t, ""])
    total, kinds = sum(count.values()), len(count)
    lexicon = {w.decode(): k for k, w in enumerate(model.lexicon, start=2)} | {"": 0}
    c = model.classes
    prior = lambda w: int(model.context[lexicon.get(w, 1)])
    after = lambda w: int(model.column[lexicon.get(w, 1)])

    def bigrams(texts):
        return [x for t in texts for x in zip(["", *t], [*t, ""])]

    def smooth(pairs, columns, contexts):
        n, row, col = Counter(pairs), Counter(g for g, _ in pairs), Counter(x for _, x in pairs)
        wide = defaultdict(set)
        for g, x in pairs:
            wide[g].add(x)
        low = {x: col[x] / len(pairs) if pairs else 1 / len(columns) for x in columns}
        return {(g, x): (n[g, x] + len(wide[g]) * low[x]) / (row[g] + len(wide[g])) if row[g] else low[x] for g in contexts for x in columns}

    contexts = range(c + 2)
    t = smooth([(prior(a), after(b)) for a, b in bigrams(train)], range(2 * c + 2), contexts)
    of = Counter()
    for w, n in count.items():
        if w in lexicon:
            of[after(w)] += n
    near = defaultdict(Counter)
    both = Counter()
    for a, b in bigrams(train):
        if b not in lexicon:
            near[b][prior(a)] += 1
        elif b and after(b) != c:
            both[prior(a), after(b) % (c + 2)] += 1
    size = [sum(both[g, x] for g in contexts) for x in range(c)]
    kind = {}
    for w, gs in near.items():
        fit = [sum(n * math.log((both[g, x] + 0.5) / (size[x] + 0.5 * (c + 2))) for g, n in gs.items()) for x in range(c)]
        kind[w] = max(range(c), key=lambda x: (round(fit[x], 9), -x))
    q = smooth([(g, kind[w]) for w, gs in near.items() for g, n in gs.items() for _ in range(n)], range(c), contexts)
    rest, types = Counter(), Counter(kind.values())
    for w in near:
        rest[kind[w]] += count[w]
    ones, twos = (sum(count[w] == k for w in near) for k in (1, 2))
    d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
    weight = class_lm.WEIGHT if total else 0.0

    def p(g, w):
        flat = (1 - weight) * (count[w] + 1) / (total + kinds + 1)
        if w in lexicon:
            return weight * t[g, after(w)] * count[w] / max(of[after(w)], 1) + flat
        if w in near:
            return weight * t[g, c + 1] * q[g, kind[w]] * (count[w] - d) / rest[kind[w]] + flat
        return weight * t[g, c + 1] * sum(q[g, x] * (d * types[x] / rest[x] if rest[x] else 1) for x in range(c)) + flat

    out = []
    for i, text, *_ in data:
        w = words(text)
        score = sum(math.log10(p(prior(a), b)) for a, b in bigrams([w]))
        base = sum(math.log10((count[b] + 1) / (total + kinds + 1)) for b in [*w, ""])
        out.append((i, held(i), len(w) + 1, sum(count[b] > 0 for b in [*w, ""]), total, base, score))
    sums = [sum(p(g, w) for w in count) + p(g, "\x00never") for g in contexts]
    return out, sums


def compare(spark, data, sizes, extra=False):
    df = frame(spark, data, extra)
    got = class_lm.scores(df, **sizes).collect()
    model = class_lm.train(frame(spark, [x for x in data if not held(x[0])]).select("text"), **sizes)
    want, sums = brute(data, model)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:5], round(x[5], 4))
    assert len(got) == len(want)
    for r, w in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)):
        assert r[:5] == w[:5]
        assert r[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-8)
    assert sums == pytest.approx([1.0] * len(sums), abs=1e-9)
    for r in got:
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens), rel=1e-5)
    return got


def test_scores_word_by_word(spark):
    got = compare(spark, sentences(400, 1), SIZES)
    assert sum(r.held_out for r in got) > 30
    assert any(r.n_known < r.n_tokens for r in got if r.held_out)
    assert all(r.n_known == r.n_tokens for r in got if not r.held_out)


def test_hard_rows(spark):
    # some of the hard rows have ids that are held out; all have texts that are hard to read
    compare(spark, HARD + sentences(60, 2, start=100), SIZES, extra=True)
    compare(spark, HARD[:4], SIZES)


def test_no_training_texts(spark):
    data = [(i, f"some words {i}", "en", "s", 1) for i in range(200) if held(i)]
    for r in compare(spark, data, SIZES):
        assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    assert class_lm.scores(frame(spark, [])).count() == 0


def test_exchange_moves_to_the_best_class():
    rnd = np.random.default_rng(4)
    words_, classes = 12, 4
    for _ in range(20):
        inner = rnd.poisson(1.5, (words_, words_)).astype(float)
        border = rnd.poisson(2.0, (2, words_, 2)).astype(float)  # with the end and all other words
        at = rnd.integers(0, classes, words_)

        def counts(at):
            m = np.zeros((classes + 2, classes + 2))
            np.add.at(m, (at[:, None].repeat(words_, 1), at[None].repeat(words_, 0)), inner)
            for x in range(2):
                np.add.at(m, (classes + x, at), border[0, :, x])
                np.add.at(m, (at, classes + x), border[1, :, x])
            return m

        want = at.copy()
        for k in range(words_):
            tries = [class_lm.likelihood(counts(np.r_[want[:k], b, want[k + 1 :]])) for b in range(classes)]
            want[k] = int(np.argmax(np.round(tries, 6)))
        near = np.zeros((2, words_, classes + 2))
        for k in range(words_):
            np.add.at(near[0][k], at, inner[:, k])
            np.add.at(near[1][k], at, inner[k])
        near[:, :, classes:] = border
        m = counts(at)
        got = class_lm.exchange(inner, near[0], near[1], at.copy(), m, classes)
        assert got.tolist() == want.tolist()
        assert np.allclose(m, counts(got))


def test_planted_classes_and_held_out_perplexity(spark):
    data = sentences(3000, 7)
    got = [r for r in class_lm.scores(frame(spark, data), classes=4, contexts=200, lexicon=400, least=5).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.3
    model = class_lm.train(frame(spark, data).select("text"), classes=4, contexts=200, lexicon=400, least=5)
    found = defaultdict(Counter)
    for k, w in enumerate(model.lexicon, start=2):
        if not w.startswith(b"rare"):
            found[int(model.context[k])][w[:2]] += int(model.counts[k])
    pure = sum(c.most_common(1)[0][1] for c in found.values()) / sum(sum(c.values()) for c in found.values())
    assert pure > 0.95


@pytest.mark.parametrize("step", ["count", "bigrams", "score"])
def test_memory_does_not_grow_with_the_batch(step):
    """A batch of many long rows is taken apart piece by piece: 1.2 million words at once take some hundred MB."""
    texts = [" ".join(f"w{(i * 31 + k * 7) % 3000}" for k in range(600)) for i in range(2000)]
    names = [f"w{i}".encode() for i in range(2000)]
    n, c = len(names), 4
    context = np.r_[c, c + 1, np.arange(n) % c]
    model = class_lm.Model(names, np.r_[1, 0, np.ones(n, np.int64)], context, context, np.ones((c + 2, 2 * c + 2)), np.full((c + 2, 2 * c + 2), 0.1), np.full(n + 2, 0.1), n, n, c)
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([False] * len(texts)), pa.array(texts)], ["row", "doc_id", "held_out", "text"])
    run = {"count": class_lm._count_words, "bigrams": class_lm._bigrams(SimpleNamespace(value=names), n), "score": class_lm._in_place(SimpleNamespace(value=model))}[step]
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) if step == "score" else rows > 0
    assert peak < 60e6
