"""Phrase mining: brute force on hard rows and random texts, blocks of a few tokens, exact large numbers."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import phrase_mining

from .helpers import HARD, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for _, t, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cands = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    covered = set()
    for p, c in cands.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                q = (p[0], *p[i : i + m])
                if 100 * c >= 100 * f[q]:
                    covered.add(q)
    out = []
    for lang in n:
        scored = []
        for p, a in cands.items():
            if p[0] == lang and p not in covered:
                cut = min((1000 * a * n[lang] // (f[(lang, *p[1 : k + 1])] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
                scored.append((-cut[0], -a, " ".join(p[1:]).encode(), f[(lang, *p[1 : cut[1] + 1])], f[(lang, *p[cut[1] + 1 :])]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(scored)[:top], start=1)]
    return sorted(out)


def mine(df, least, **kw):
    return sorted(tuple(r) for r in phrase_mining.collocations(*phrase_mining.frequent_phrases(df, least=least), **kw).collect())


def test_brute_force_on_random_texts(spark):
    rnd = random.Random(11)
    common = ["the", "The", "of", "a", "né", "x-1", "漢字", "😀"]
    texts = [" ".join(rnd.choice(common) + rnd.choice(["", "", "", ".", ",\t", "\n", " ;"]) for _ in range(rnd.randrange(60))) for _ in range(120)]
    data = [(i, t, ("en", "de", None, "und", "")[i % 5], "s", 1) for i, t in enumerate(texts)] + HARD
    want = brute(data, 5)
    assert len(want) > 50 and max(len(x[2].split(" ")) for x in want) >= 4
    assert mine(frame(spark, data), 5) == want
    assert mine(frame(spark, data, extra=True), 5, top=7) == brute(data, 5, top=7)


def test_ties_overlaps_and_repeated_rows(spark):
    texts = ["a a a a a a", "a a a a a a", "b c. b c! b c?", "b c", None, "", "  ", "d e f g h i j", "d e f g h i j", "d e f g h", "x\x1cy z q", "x\x1cy z q"]
    data = rows(texts) + rows(texts)
    assert mine(frame(spark, data), 2) == brute(data, 2)


def test_blocks_are_cut_at_pieces(spark):
    """A text longer than a block, and many small blocks, count as one."""
    rnd = random.Random(5)
    words = [rnd.choice("abcdefg") + rnd.choice(["", "", "", "."]) for _ in range(3000)]
    segments = list(_cut(" ".join(words), 50))
    assert len(segments) > 20 and all(s[-1] == phrase_mining._END for s in segments)
    assert max(map(len, segments)) < 120
    data = rows([" ".join(words)] + [" ".join(words[i : i + 40]) for i in range(0, 3000, 40)])
    df = frame(spark, data).repartition(40, F.rand(1))
    assert mine(df, 20) == brute(data, 20)


def _cut(text, size):
    old = phrase_mining.BLOCK
    phrase_mining.BLOCK = size
    try:
        yield from phrase_mining.segments(text)
    finally:
        phrase_mining.BLOCK = old


def test_products_beyond_64_bits(spark):
    """Counts of a corpus of ten trillion words, written as the tables that the levels are."""
    schema = "lang string, id long, phrase string, tail string, f long, pre array<long>, suf array<long>"
    big = [("en", 0, "a", "a", 9 * 10**11 + 7, [], []), ("en", 1, "b", "b", 8 * 10**11 + 3, [], [])]
    pair = [("en", 0, "a b", "b", 7 * 10**11 + 1, [9 * 10**11 + 7], [8 * 10**11 + 3], 0, 1)]
    totals = spark.createDataFrame([("en", 10**13 + 9)], "lang string, n long")
    got = phrase_mining.collocations([spark.createDataFrame(big, schema), spark.createDataFrame(pair, schema + ", first long, last long")], totals).collect()
    assert [r.score for r in got] == [1000 * (7 * 10**11 + 1) * (10**13 + 9) // ((9 * 10**11 + 7) * (8 * 10**11 + 3))]


def test_nothing_frequent(spark):
    assert mine(frame(spark, []), 100) == []
    assert mine(frame(spark, HARD[:3]), 100) == []
    assert mine(frame(spark, rows(["a. b. a. b."])), 2) == []
