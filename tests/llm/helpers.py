"""Brute-force versions in plain Python, and rows that are hard for every operator."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall(t or "")


def rows(texts, source="src0", start=0):
    return [(start + i, t, "en", source, len(t) if t is not None else None) for i, t in enumerate(texts)]


def frame(spark, data, extra=False):
    df = spark.createDataFrame(data, SCHEMA)
    if extra:  # columns whose names the operators use themselves
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("size", "spans", "blob", "cls", "pid", "row", "score", "kept", "target", "n_words", "w", "l", "_spans", "doc", "host", "failed", "likely", "k", "s", "at", "batch")})
    return df


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BIG_ID = 2**60 + 1
HARD = [
    (None, "a null id with some words in it", "en", "src1", 5), (1, None, "en", "src1", None), (2, "", None, "src1", 0), (3, " \t\n ", "de", None, 4), (4, LONG, "en", "src0", len(LONG)),
    (5, "same text twice over here", "en", "src0", 25), (5, "same text twice over here", "en", "src0", 25), (6, "one", "en", "src2", 3), (7, "ünïcode wörds é ß 漢字 😀 tail", "fr", "src2", 26),
    (BIG_ID, "an id that a float cannot hold beside a null", "en", "src1", 43), (BIG_ID + 2, "same again " * 3000, "en", "src1", 33_000), (10, "x" * 300_000, "en", "src1", 300_000),
    (11, " ".join(str(i * 7919 % 10**6) for i in range(20_000)), "en", "src1", 1), (8, "a\x00b control \x1c separators \u00a0 kept \u2003 too", "en", "src2", 10),
]


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_targets(sizes, weights, share):
    """Fill by weight; who reaches its cap stops and the rest goes on."""
    cap, left = {k: 2.0 * v for k, v in sizes.items()}, share
    out, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_ and left > 1e-9:
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if out[k] + left * weights[k] / w >= cap[k]}
        if not full:
            for k in open_:
                out[k] += left * weights[k] / w
            break
        for k in full:
            left -= cap[k] - out[k]
            out[k] = cap[k]
        open_ -= full
    return out


def brute_mix(data):
    """Words taken of each (id, text, source), every block of every shard's line by itself; ids are distinct."""
    from tessera.llm import mixing

    size = {d: len(words(t)) for d, t, _ in data}
    sources = {}
    for d, _, s in data:
        sources.setdefault(s, []).append(d)
    order = sorted(k for k in sources if k is not None) + [k for k in sources if k is None]
    total = {k: sum(size[d] for d in sources[k]) for k in order}
    target = brute_targets(total, {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(order)}, mixing.SHARE * sum(total.values()))

    def seats(weights, n):
        """Highest quotients; equal ones to the first."""
        won = dict.fromkeys(weights, 0)
        for _ in range(n):
            k = max(weights, key=lambda k: weights[k] / (2 * won[k] + 1))
            won[k] += 1
        return won

    quota = seats(target, round(sum(target.values()) / mixing.BLOCK)) if any(target.values()) else dict.fromkeys(order, 0)
    taken = dict.fromkeys(size, 0)
    for k in order:
        place = {d: int(hashlib.md5(f"{mixing.SEED}:{'' if d is None else d}".encode()).hexdigest()[:15], 16) for d in sources[k]}
        n = -(-len(sources[k]) // mixing.SHARD_DOCS)
        shards = {}
        for d in sorted(sources[k], key=lambda d: (place[d], d)):
            shards.setdefault(place[d] % n, []).append(d)
        lines = {s: [d for d in ds for _ in range(size[d])] for s, ds in sorted(shards.items())}
        won = seats({s: len(x) for s, x in lines.items() if x}, quota[k]) if any(lines.values()) else {}
        for s, q in won.items():
            twice, m1 = lines[s] * 2, -(-len(lines[s]) // mixing.BLOCK)
            blocks = [twice[i : i + mixing.BLOCK] for i in range(0, len(twice), mixing.BLOCK)]
            m2 = max(len(blocks) - m1, 1)
            first, second = min(q, m1), min(max(q - m1, 0), len(blocks) - m1)
            for picks, part, seed in ((first, blocks[:m1], 7919), (second, blocks[m1:], 104729)):
                m = m1 if seed == 7919 else m2
                off = (s * seed + mixing.SEED) % m
                for i, block in enumerate(part):
                    if (off + (i + 1) * picks) // m > (off + i * picks) // m:
                        for d in block:
                            taken[d] += 1
    return taken
