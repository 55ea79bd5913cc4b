"""Phrase collocation mining over vertical positional lists (operator 11).

A language's documents are dealt into blocks of tokens; a block keeps, for each frequent phrase, the list of the
positions where it starts. Lists are extended level by level:

1. Words are counted in their blocks and summed by language; postings of words below the least frequency are dropped.
2. The lists of a block are merged in position order with the postings of the adjacent words. A posting of a word is kept
   as that of the frequent phrase of the present length which the word ends, so what a merge finds has a frequent first
   and a frequent last part, and postings that cannot extend anything are met no more.
3. The length of a new list is the exact frequency in the block; lengths are summed by phrase (first part, last part),
   and only phrases that reach the least frequency keep their lists.

Which phrases a block keeps is a window over the narrow (phrase, block, length) rows of all blocks: they are shuffled
once, and a phrase has one row a block, as its block has counted it already. No set of phrases is collected or broadcast
by hand, and no task holds more than a block. Scores, the parts' counts and the test for longer phrases are joins of
the tables of frequent phrases; the first 2,000 of a language are ranked by shares of it first.

Defined cases: a null text counts as empty, a null lang as `und`; repeated rows and rows without an id count each; empty
pieces have no words; phrases never leave a piece, so a document may be cut between blocks at any piece; an empty table
gives an empty result; other columns are ignored. Counts are 64-bit, products of counts exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, new_path, staged, table

#: Words of a phrase at most, occurrences at least, phrases of a language in the result.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A phrase goes if a longer one has at least this per cent of its occurrences.
COVER_PCT = 100
#: Tokens of a block, and of the open blocks of a task together.
BLOCK, HELD = 1_000_000, 3_000_000
#: Shares in which a language's phrases are ranked before the final ranking.
SHARES = 256
#: Bytes of a UTF-8 text: letters A-Z to lower case, ends of pieces to a byte that no text has, tabs to spaces.
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(97, 123)) + b"\xff" * 10 + b" ")
_END = b"\xff"


class _Vocabulary(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def segments(text: str) -> Iterator[list[bytes]]:
    """The words of a text, each piece followed by its end, in parts of about BLOCK words that are cut at ends."""
    words = text.encode("utf-8", "surrogatepass").translate(_BYTES).replace(_END, b" \xff ").split()
    begin = 0
    while len(words) - begin > BLOCK:
        try:
            end = words.index(_END, begin + BLOCK) + 1
        except ValueError:
            break
        yield words[begin:end]
        begin = end
    yield [*words[begin:], _END]


def tokens(words: list[bytes], known: _Vocabulary) -> np.ndarray:
    """Numbers of words, with 0 once where one or more pieces end."""
    ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return ids[(ids > 0) | np.r_[True, ids[:-1] > 0]]


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, their lowest bytes first: most of the others are alike."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 3)


def _unpacked(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


BLOCKS = "block long, lang string, vocabulary array<string>, counts array<long>, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() << 32 | k for k in count())
    known: dict[str, _Vocabulary] = {}
    parts: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def close(lang: str) -> pa.RecordBatch:
        ids = np.concatenate(parts.pop(lang))
        words = [w.decode("utf-8", "surrogatepass") for w in islice(known.pop(lang), 1, None)]
        counts = np.bincount(ids, minlength=len(words) + 1)[1:].tolist()
        del sizes[lang]
        columns = [([next(number)], pa.int64()), ([lang], pa.string()), ([words], pa.list_(pa.string())), ([counts], pa.list_(pa.int64())), ([_packed(ids)], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], ["block", "lang", "vocabulary", "counts", "tokens"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            for words in segments(text):
                if lang not in known:
                    known[lang], parts[lang], sizes[lang] = _Vocabulary(), [], 0
                parts[lang].append(tokens(words, known[lang]))
                sizes[lang] += len(parts[lang][-1])
                if sizes[lang] >= BLOCK:
                    yield close(lang)
                elif sum(sizes.values()) >= HELD:
                    yield close(max(sizes, key=sizes.__getitem__))
    for lang in list(known):
        yield close(lang)


LISTS = "block long, keys binary, sizes binary, at binary"


def _lists(block: int, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The vertical lists of a block: phrases, lengths of their lists, positions list by list."""
    order = np.lexsort((at, ids))
    keys, sizes = np.unique(ids, return_counts=True)
    gaps = np.diff(at[order].astype(np.int32), prepend=np.int32(0))  # small within a list
    binary = [pa.array([_packed(x)], pa.binary()) for x in (keys.astype(np.int64), sizes.astype(np.int32), gaps)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *binary], ["block", "keys", "sizes", "at"])


def merged(keys: bytes, sizes: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first part, last part) where a phrase of the lists is followed, one word on, by another: all lists merged by position."""
    keys, sizes, gaps = (_unpacked(x, t) for x, t in ((keys, np.int64), (sizes, np.int32), (at, np.int32)))
    where, ids = np.cumsum(gaps, dtype=np.int32), np.repeat(keys, sizes)
    order = np.argsort(where)
    where, ids = where[order], ids[order]
    hit = np.flatnonzero(where[1:] == where[:-1] + 1)
    return where[hit], ids[hit], ids[hit + 1]


def _structs(b: pa.RecordBatch, column: str, i: int, *fields: str) -> list[np.ndarray]:
    values = b.column(column)[i].values
    return [values.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            local = _unpacked(b.column("tokens")[i].as_py(), np.int32)
            nth, ids = _structs(b, "known", i, "nth", "id")
            to = np.full(int(local.max(initial=0)) + 1, -1, np.int64)
            to[nth] = ids
            ids = to[local]
            at = np.flatnonzero(ids >= 0)
            yield _lists(b.column("block")[i].as_py(), at, ids[at])


PAIRS = "block long, first long, last long, n long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths of the lists that the merged lists of a block would have."""
    for b in batches:
        for i in range(b.num_rows):
            _, first, last = merged(*(b.column(c)[i].as_py() for c in ("keys", "sizes", "at")))
            names, local = np.unique(np.concatenate([first, last]), return_inverse=True)
            local = local.astype(np.int64)
            keys, n = np.unique(local[: len(first)] * len(names) + local[len(first) :], return_counts=True)
            block = np.full(len(keys), b.column("block")[i].as_py(), np.int64)
            columns = [block, names[keys // max(len(names), 1)], names[keys % max(len(names), 1)], n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["block", "first", "last", "n"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of the frequent ones among the phrases that the merged lists have."""
    for b in batches:
        for i in range(b.num_rows):
            at, first, last = merged(*(b.column(c)[i].as_py() for c in ("keys", "sizes", "at")))
            kf, kl, ids = _structs(b, "known", i, "first", "last", "id")
            names = np.unique(np.concatenate([kf, kl]))

            def number(x: np.ndarray) -> np.ndarray:
                return np.minimum(np.searchsorted(names, x), len(names) - 1)

            f, l = number(first), number(last)
            known = (names[f] == first) & (names[l] == last)
            keys = number(kf) * len(names) + number(kl)
            order = np.argsort(keys)
            found = f[known] * len(names) + l[known]
            nth = np.minimum(np.searchsorted(keys[order], found), len(keys) - 1)
            hit = keys[order][nth] == found
            yield _lists(b.column("block")[i].as_py(), at[known][hit], ids[order][nth[hit]])


def _frequent(rows: DataFrame, phrase: list[str], least: int) -> DataFrame:
    """The rows (one a block and phrase, with n) of phrases with at least so many occurrences, f; id is the `row` of one of a phrase's rows.

    Rows are numbered where they have met, so a phrase has one number however often a task is run again.
    """
    same = Window.partitionBy(*phrase)
    met = rows.withColumn("f", F.sum("n").over(same)).where(F.col("f") >= least)
    return met.withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.min("row").over(same))


def _with_known(lists: DataFrame, known: DataFrame, *fields: str) -> DataFrame:
    """Blocks beside those frequent phrases that they hold: at most as many as a block has words. Merged at every size, as one plan for all."""
    per = known.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("known"))
    return lists.hint("merge").join(per, "block")


def frequent_phrases(docs: DataFrame, lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """([phrases of 1, 2, ... words], words of each language) of docs (text, lang).

    Phrases: lang, id, phrase, f and, for the phrase without its last words one by one, the counts `pre` (of 1, 2, ...
    words), and without its first words one by one `suf`; `first` and `last` are the ids of its parts, one word shorter.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    whole = new_path(spark, "blocks")
    blocks = staged(texts.mapInArrow(_blocks, BLOCKS), "", whole)
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("vocabulary", "counts")).alias("nth", "w")).select("block", "lang", F.col("nth") + 1, "w.*").toDF("block", "lang", "nth", "word", "n")
    totals = staged(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    none = F.array().cast("array<long>")
    words = staged(_frequent(words, ["lang", "word"], least), "words")
    level = words.where("row = id").select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("tail"), "f", none.alias("pre"), none.alias("suf"))
    levels = [level]
    path = new_path(spark, "lists-1")
    lists = staged(_with_known(blocks.select("block", "tokens"), words, "nth", "id").mapInArrow(_word_lists, LISTS), "", path)
    drop_path(spark, whole)
    for k in range(2, longest + 1):
        pairs = staged(_frequent(lists.mapInArrow(_pairs, PAIRS), ["first", "last"], least), f"pairs-{k}")
        found = pairs.where("row = id").select("id", "first", "last", "f")
        head = level.select("lang", F.col("id").alias("first"), F.col("phrase").alias("head"), F.concat("pre", F.array("f")).alias("pre"))
        tail = level.select(F.col("id").alias("last"), "tail", F.concat(F.array("f"), F.col("suf")).alias("suf"))
        level = staged(
            found.join(head, "first").join(tail, "last").select("lang", "id", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail", "f", "pre", "suf", "first", "last"), f"phrases-{k}"
        )
        levels.append(level)
        if k == longest or level.isEmpty():
            break
        path, old = new_path(spark, f"lists-{k}"), path
        lists = staged(_with_known(lists, pairs, "first", "last", "id").mapInArrow(_extended, LISTS), "", path)
        drop_path(spark, old)
    return levels, totals


def collocations(levels: list[DataFrame], totals: DataFrame, top: int = TOP, cover_pct: int = COVER_PCT) -> DataFrame:
    """The first phrases of each language by the score of their weakest cut, without those that a longer phrase covers.

    A phrase inside a much longer one is inside one of one word more that is at least as frequent, so only those are asked.
    """
    kept = None
    for k, level in enumerate(levels[1:], start=1):
        if k + 1 < len(levels):
            longer = levels[k + 1]
            cover = longer.select(F.explode(F.array("first", "last")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("cover"))
            level = level.join(cover, "id", "left").where(f"cover IS NULL OR 100 * cover < {cover_pct} * f")
        level = level.select("lang", "phrase", F.col("f").alias("a"), "pre", "suf")
        kept = level if kept is None else kept.unionByName(level)
    exact = "CAST({} AS DECIMAL(19, 0))".format
    cuts = f"""transform(arrays_zip(pre, suf), (x, k) -> named_struct(
        'score', ({exact('1000 * a')} * {exact('n')}) DIV ({exact('x.pre')} * {exact('x.suf')}), 'k', k, 'l', x.pre, 'r', x.suf))"""
    scored = kept.join(totals, "lang").select("lang", "phrase", "a", "n", F.array_min(F.expr(cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.drop("share", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*frequent_phrases(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), n AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, phrase, m, count(*)::HUGEINT AS c
  FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w))
  GROUP BY lang, phrase, m HAVING count(*) >= 100
), s AS (
  SELECT lang, phrase, m, c, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(c) AS cover
  FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM s), (SELECT unnest([2, 3, 4]) AS j) WHERE j < m AND i + j - 1 <= m GROUP BY ALL
), cut AS (
  SELECT s.lang, s.phrase, s.c AS a, l.c AS l, r.c AS r, n.n, k, (1000 * s.c * n.n) // (l.c * r.c) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM s) s JOIN n USING (lang)
  JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:k], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[k + 1:s.m], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.cover IS NULL OR 100 * i.cover < 100 * b.a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
