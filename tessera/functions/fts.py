"""English full-text search: lexemes with positions, AND queries, rank by frequency and nearness.

Stemming is Porter's published algorithm. The rank follows the public definition of PostgreSQL's
ts_rank with its default weight; no database was at hand to compare with.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.batches import pieces

# Stop words of the English dictionary.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split()
)
WEIGHT = 0.1
_WORD = re.compile(r"[a-z0-9]+")
_V = "aeiou"


def _measure(w: str) -> int:
    kinds = "".join("v" if c in _V or (c == "y" and i and w[i - 1] not in _V) else "c" for i, c in enumerate(w))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(c in _V or (c == "y" and i > 0 and w[i - 1] not in _V) for i, c in enumerate(w))


def _short(w: str) -> bool:
    return len(w) >= 3 and w[-1] not in _V + "wxy" and (w[-2] in _V or w[-2] == "y") and w[-3] not in _V


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


@lru_cache(200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) <= 2 or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in _V + "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_STEP2, 0), (_STEP3, 0)):
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# PostgreSQL's text search keeps so many positions of a lexeme and counts no further than the highest.
MAX_POSITIONS, MAX_POSITION = 255, 16383


def positions(text: str | None) -> dict[str, list[int]]:
    """Lexemes with their positions; stop words take a position but are no lexemes."""
    out: dict[str, list[int]] = {}
    for i, w in enumerate(_WORD.findall((text or "").lower()), 1):
        if w not in STOP:
            at = out.setdefault(stem(w), [])
            if len(at) < MAX_POSITIONS:
                at.append(min(i, MAX_POSITION))
    return out


def _near(gap: int) -> float:
    near = 1e-30 if gap > 100 else 1.0 / (1.005 + 0.05 * math.exp(gap / 1.5 - 2))
    return math.sqrt(WEIGHT * WEIGHT * near)


#: Weight of two positions by the words between them, the last one for all that are further apart.
_GAPS = [_near(g) for g in range(102)]


def rank(doc: dict[str, list[int]], lexemes: list[str]) -> float:
    """Rank of a document that has all lexemes, 0 otherwise."""
    lexemes = list(dict.fromkeys(lexemes))
    if not lexemes or any(x not in doc for x in lexemes):
        return 0.0
    if len(lexemes) == 1:
        total, best, at = 0.0, -1.0, 0
        for j in range(len(doc[lexemes[0]])):
            total += WEIGHT / (j + 1) ** 2
            if WEIGHT > best:
                best, at = WEIGHT, j
        return (best + total - best / (at + 1) ** 2) / 1.64493406685
    res = -1.0
    for i in range(len(lexemes)):
        for k in range(i):
            for a in doc[lexemes[i]]:
                for b in doc[lexemes[k]]:
                    gap = abs(a - b)
                    if gap:
                        w = _GAPS[min(gap, 101)]
                        res = w if res < 0 else 1.0 - (1.0 - res) * (1.0 - w)
    return max(res, 0.0)


VECTOR = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))


@F.pandas_udf(VECTOR)
def tsvector(text: pd.Series) -> pd.Series:
    return text.map(positions)


@F.pandas_udf(T.ArrayType(T.StringType()))
def tsquery(text: pd.Series) -> pd.Series:
    """Distinct lexemes that must all be present."""
    return text.map(lambda t: list(positions(t)))


def _found(asked: list[Row], ids: pa.Array, query: str, key: str):
    """Ranks of the asked queries in each text; a text is met by the queries whose longest lexeme it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[int]] = {}
        for q, a in enumerate(asked):
            by.setdefault(min(a.lexemes, key=lambda x: (-len(x), x)), []).append(q)
        for b in pieces(batches):
            at, who, ranks = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                doc = positions(text)
                for q in (q for x in doc.keys() & by.keys() for q in by[x]):
                    r = rank(doc, asked[q].lexemes)
                    if r > 0:
                        at.append(i)
                        who.append(q)
                        ranks.append(r)
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), b.column(key).take(pa.array(at)), pa.array(ranks)], [query, key, "bm25_raw"])

    return run


def search(docs: DataFrame, queries: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """(query, key, bm25_raw) of the documents that have all lexemes of a query (query, query_text).

    The queries go to the tasks in blocks; a text is read once for each block, where it lies, and is never shuffled.
    """
    from tessera.operators.topk import query_blocks, query_ids

    q = queries.select(query, tsquery("query_text").alias("lexemes")).where(F.size("lexemes") > 0)
    schema = T.StructType([q.schema[query], docs.schema[key], T.StructField("bm25_raw", T.DoubleType())])
    rows = docs.select(key, F.col(text).alias("text"))
    blocks = ((asked, query_ids(asked, query, q.schema[query].dataType)) for asked in query_blocks(q, query))
    return reduce(DataFrame.unionByName, (rows.mapInArrow(_found(asked, ids, query, key), schema) for asked, ids in blocks))
