"""Language-model scores from Brown class-based bigrams (operator 13).

A word's probability is that of its class after the class of the word before, times that of the word in its class.

1. Words of the training texts are counted. The most frequent ones (at most LEXICON, a bound that does not depend on the
   corpus) form the lexicon that tasks hold; the first CONTEXTS of them are clustered and are contexts, every other word
   is a context of one class of its own.
2. Bigrams of lexicon words are counted: a table of at most CONTEXTS x LEXICON rows, whatever the corpus.
3. Exchange clustering: classes begin with the most frequent words. In each sweep buckets of words, side by side, move
   words to the class that raises the likelihood of the class bigrams most, each bucket on its own copy of the class
   counts; a sweep counts if the likelihood of all bigrams rises, else the clustering ends.
4. The other words of the lexicon go to the class that their contexts make most likely, and so do, as a join, all words
   outside the lexicon. Both have classes of their own beside those of the clustered words, so that frequent and rare
   words do not share their emission probabilities.
5. One pass scores lexicon words in place; what is left of a text, its words outside the lexicon by context, meets their
   counts and classes in a join that Spark can split, and adds to the document's score.

Smoothing: class transitions fall back to class frequencies (Witten-Bell); emissions of words outside the lexicon are
discounted, and what that frees is the probability of unknown words; the whole is mixed with add-one unigrams, so that no
token has probability 0. Over the V known words and one unknown word, each context's probabilities sum to 1.

Defined cases: a null or empty text is one end; a null id counts as training; repeated rows count and are scored each;
without training texts every token has probability 1; ties in frequency go by the word's bytes, ties between classes to
the first; an empty table gives an empty result; other columns are ignored. Scores are rounded to nine decimals, as
the order of a distributed sum decides the last digits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import pieces
from tessera.llm.common import staged, table

#: Classes of clustered words; words that are clustered; words that tasks hold.
CLASSES, CONTEXTS, LEXICON = 64, 8192, 131_072
#: Occurrences of a lexicon word at least, and bytes at most.
LEAST, WIDEST = 3, 256
SWEEPS, BUCKETS = 6, 256
#: Weight of the class model; the rest is that of the add-one unigrams.
WEIGHT = 0.999
#: Tokens that are counted before counts are passed on, and different words.
CHUNK, HELD = 4_000_000, 400_000
#: Numbers of the end and of all words outside the lexicon.
END, REST = 0, 1
_BYTES = bytes.maketrans(bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n); the end is the empty word."""
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = [w.decode("utf-8", "surrogatepass") for w in found]
        return pa.RecordBatch.from_arrays([_column(words, pa.string()), _column(list(found.values()), pa.int64())], ["word", "n"])

    for b in pieces(batches):
        for text in b.column("text").to_pylist():
            found.update(tokens(text))
            found[b""] += 1
            if len(found) > HELD:
                yield out()
                found = Counter()
    yield out()


class _Numbers(dict):
    """Numbers of lexicon words, REST for all others."""

    def __missing__(self, word: bytes) -> int:
        return REST


def numbered(texts: list, known: _Numbers) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words, numbers of all tokens, where each text ends): every text is followed by an end."""
    lists = [tokens(t) for t in texts]
    ids = np.fromiter((k for words in lists for k in (*map(known.__getitem__, words), END)), np.int64)
    return lists, ids, np.cumsum([len(words) + 1 for words in lists])


PAIRS = "prev int, cur int, n long"


def _bigrams(lexicon, contexts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers((w, k) for k, w in enumerate(lexicon.value, start=2))
        size = len(known) + 2
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            columns = [_column(keys // size, pa.int32()), _column(keys % size, pa.int32()), _column(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["prev", "cur", "n"])

        for b in pieces(batches):
            _, ids, _ = numbered(b.column("text").to_pylist(), known)
            prev = np.r_[END, ids[:-1]]  # what precedes a text is the end of another
            held.append(np.where(prev < contexts + 2, prev, REST) * size + ids)
            n += len(ids)
            if n > CHUNK:
                yield out()
                held, n = [], 0
        yield out()

    return run


def _class_bigrams(classes, columns):
    """Sums of (class of prev, column of cur), at most one row for each pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cols = classes.value, columns.value
        m = np.zeros((int(rows.max()) + 1, int(cols.max()) + 1), np.int64)
        for b in batches:
            prev, cur, n = (b.column(c).to_numpy() for c in ("prev", "cur", "n"))
            np.add.at(m, (rows[prev], cols[cur]), n)
        g, c = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([_column(g, pa.int32()), _column(c, pa.int32()), _column(m[g, c], pa.int64())], ["prev", "cur", "n"])

    return run


def _matrix(pairs: DataFrame, classes: np.ndarray, columns: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    sc = pairs.sparkSession.sparkContext
    a, b = sc.broadcast(classes), sc.broadcast(columns)
    out = np.zeros(shape, np.int64)
    for r in pairs.mapInArrow(_class_bigrams(a, b), PAIRS).groupBy("prev", "cur").agg(F.sum("n").alias("n")).collect():  # at most as many rows as the matrix has cells
        out[r.prev, r.cur] = r.n
    a.unpersist()
    b.unpersist()
    return out


BUCKET = "bucket int, word binary, side binary, other binary, n binary"


def _bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All bigrams of a bucket's words as one row: at most CONTEXTS x CONTEXTS x 2 / BUCKETS."""
    rows = rows.sort_values(["word", "side", "other"])
    packed = [rows[c].to_numpy(t).tobytes() for c, t in (("word", np.int32), ("side", np.int8), ("other", np.int32), ("n", np.int64))]
    return pd.DataFrame([[key[0], *packed]], columns=["bucket", "word", "side", "other", "n"])


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, up to what no clustering changes."""
    m = m.astype(float)
    return float(_h(m).sum() - _h(m.sum(axis=0)).sum() - _h(m.sum(axis=1)).sum())


def exchange(inner: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, m: np.ndarray, classes: int) -> np.ndarray:
    """Classes of words after each in turn went to the best one, given theirs in `at`.

    left and right: how often each class precedes and follows each word; inner: bigrams of the words among themselves;
    m: counts of class bigrams. The last three change as words move.
    """
    own = np.arange(classes)
    for k, s in enumerate(np.diag(inner).copy()):
        a = at[k]
        l, r = left[k].copy(), right[k].copy()
        l[a] -= s
        r[a] -= s
        m[:, a] -= l
        m[a, :] -= r
        m[a, a] -= s
        lower, upper = m[:, :classes], m[:classes, :]
        i, j = np.flatnonzero(l), np.flatnonzero(r)
        gain = (_h(lower[i] + l[i, None]) - _h(lower[i])).sum(axis=0) + (_h(upper[:, j] + r[None, j]) - _h(upper[:, j])).sum(axis=1)
        d = m[own, own]
        gain += _h(d + l[:classes] + r[:classes] + s) + _h(d) - _h(d + l[:classes]) - _h(d + r[:classes])
        # the word's neighbours stay counted wherever it goes
        for total, n in ((lower.sum(axis=0) + r[:classes], l.sum() + s), (upper.sum(axis=1) + l[:classes], r.sum() + s)):
            gain -= _h(total + n) - _h(total)
        b = at[k] = int(gain.argmax())
        m[:, b] += l
        m[b, :] += r
        m[b, b] += s
        for near, n in ((left, inner[k]), (right, inner[:, k])):
            near[:, a] -= n
            near[:, b] += n
    return at


def _sweep(state, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m = state.value
        for b in batches:
            for i in range(b.num_rows):
                word, side, other, n = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("word", np.int32), ("side", np.int8), ("other", np.int32), ("n", np.int64)))
                words, local = np.unique(word, return_inverse=True)  # more frequent ones first
                near = np.zeros((2, len(words), classes + 2))
                np.add.at(near, (side, local, at[other]), n)
                mate = np.minimum(np.searchsorted(words, other), len(words) - 1)
                mates = (words[mate] == other) & (side == 1)
                inner = np.zeros((len(words), len(words)))
                np.add.at(inner, (local[mates], mate[mates]), n[mates])
                new = exchange(inner, near[0], near[1], at[words], m.astype(float), classes)
                yield pa.RecordBatch.from_arrays([_column(words, pa.int32()), _column(new, pa.int32())], ["word", "class"])

    return run


def cluster(pairs: DataFrame, contexts: int, lexicon: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """(class of each of the numbers up to contexts + 2, likelihood) from the bigrams."""
    sc = pairs.sparkSession.sparkContext
    at = np.full(contexts + 2, classes + 1, np.int64)
    at[END] = classes
    at[2 : 2 + classes] = np.arange(classes)[:contexts]
    if contexts <= 1:
        return at, 0.0
    size = classes + 2
    inner = pairs.where((F.col("cur") < contexts + 2))
    both = F.explode(F.array(F.struct(F.col("cur").alias("word"), F.lit(0).alias("side"), F.col("prev").alias("other")), F.struct(F.col("prev").alias("word"), F.lit(1).alias("side"), F.col("cur").alias("other"))))
    sided = inner.select(both.alias("x"), "n").select("x.*", "n").where("word > 1")
    # a word's neighbour outside the contexts is the class of all others
    outer = pairs.where((F.col("cur") >= contexts + 2) & (F.col("prev") > 1)).groupBy("prev").agg(F.sum("n").alias("n")).select(F.col("prev").alias("word"), F.lit(1).alias("side"), F.lit(REST).alias("other"), "n")
    sided = sided.unionByName(outer).withColumn("bucket", F.pmod("word", F.lit(BUCKETS)))
    buckets = staged(sided.groupBy("bucket").applyInPandas(_bucket, BUCKET), "buckets")

    def count(at: np.ndarray) -> np.ndarray:
        return _matrix(pairs, at, np.r_[at, np.full(lexicon - contexts, classes + 1)], (size, size))

    m = count(at)
    best = likelihood(m)
    for _ in range(sweeps):
        state = sc.broadcast((at, m))
        new = at.copy()
        for r in buckets.mapInArrow(_sweep(state, classes), "word int, class int").collect():  # contexts rows
            new[r[0]] = r[1]
        state.unpersist()
        moved = count(new)
        now = likelihood(moved)
        if now <= best:
            break
        at, m, best = new, moved, now
    return at, best


def _assign(fit):
    """The class that makes a word's contexts most likely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = fit.value
        for b in batches:
            sizes = b.column("near").value_lengths().to_numpy()
            flat = b.column("near").flatten()
            rows = np.repeat(np.arange(b.num_rows), sizes)
            near = np.zeros((b.num_rows, logs.shape[0]))
            np.add.at(near, (rows, flat.field("ctx").to_numpy()), flat.field("n").to_numpy())
            best = (near @ logs).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), _column(best, pa.int32()), b.column("near")], ["word", "n", "class", "near"])

    return run


NEAR = "n long, class int, near array<struct<ctx:int,n:long>>"


def assigned(counts: DataFrame, m: np.ndarray) -> DataFrame:
    """(word, n, class, near) from counts (word, ctx, n), by m, how often classes (columns) follow contexts (rows)."""
    logs = np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * len(m)))
    per = counts.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("ctx", "n")).alias("near"))  # as many contexts as classes at most
    kind = counts.schema["word"].dataType.simpleString()
    return per.mapInArrow(_assign(counts.sparkSession.sparkContext.broadcast(logs)), f"word {kind}, {NEAR}")


def _to_class(at):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cur"), _column(at.value[b.column("prev").to_numpy()], pa.int32()), b.column("n")], ["word", "ctx", "n"])

    return run


def transitions(m: np.ndarray) -> np.ndarray:
    """Witten-Bell: of each context (row) the probabilities of what follows, over the frequencies of columns."""
    total = m.sum()
    lower = m.sum(axis=0) / total if total else np.full(m.shape[1], 1 / m.shape[1])
    n, kinds = m.sum(axis=1, keepdims=True), (m > 0).sum(axis=1, keepdims=True)
    return (m + kinds * lower) / np.maximum(n + kinds, 1) + (n == 0) * lower


@dataclass
class Model:
    """What tasks hold of the model: its size is bounded by LEXICON and CLASSES."""

    lexicon: list[bytes]
    counts: np.ndarray  #: of the numbers; of REST 0
    context: np.ndarray  #: class of each number as what precedes
    column: np.ndarray  #: class of each number as what follows
    bigrams: np.ndarray  #: counts of (context, column)
    after: np.ndarray  #: probabilities of columns after contexts
    emission: np.ndarray  #: of each number in its column
    tokens: int
    kinds: int
    classes: int

    def probabilities(self, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of lexicon words and the end after contexts."""
        return self.weight * self.after[ctx, self.column[ids]] * self.emission[ids] + (1 - self.weight) * (self.counts[ids] + 1) / self.base

    @property
    def weight(self) -> float:
        return WEIGHT if self.tokens else 0.0

    @property
    def base(self) -> int:
        return self.tokens + self.kinds + 1


def _band(n: Column) -> Column:
    """Counts by size, each by itself up to 4,096 and sixteen bands an octave beyond: some thousand values at most."""
    return F.when(n < 4096, n).otherwise(4096 + F.floor(16 * F.log2(n / 4096.0))).cast("long")


def train(texts: DataFrame, classes: int = CLASSES, contexts: int = CONTEXTS, lexicon: int = LEXICON, least: int = LEAST) -> Model:
    """The model but for words outside the lexicon, from texts (text)."""
    sc = texts.sparkSession.sparkContext
    words = staged(texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    total = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("n")))).first()
    able = words.where((F.col("word") != "") & (F.col("n") >= least) & (F.octet_length("word") <= WIDEST)).select("word", "n", _band(F.col("n")).alias("band"))
    lowest, room = 0, lexicon
    for r in sorted(able.groupBy("band").count().collect(), reverse=True):  # at most as many rows as there are bands
        room -= r[1]
        if room < 0:
            lowest = r[0] + 1
            break
    top = sorted(able.where(F.col("band") >= lowest).collect(), key=lambda r: (-r.n, r.word))  # at most lexicon rows
    names = [r.word.encode("utf-8", "surrogatepass") for r in top]
    counts = np.array([total[2] or 0, 0, *(r.n for r in top)], np.int64)
    contexts = min(contexts, len(names))
    known = sc.broadcast(names)
    pairs = staged(texts.mapInArrow(_bigrams(known, contexts), PAIRS).groupBy("prev", "cur").agg(F.sum("n").alias("n")), "bigrams")
    at, _ = cluster(pairs, contexts, len(names), classes)
    context = np.r_[at, np.full(len(names) - contexts, classes + 1)]
    column = context.copy()
    m = _matrix(pairs, at, column, (classes + 2, classes + 2))
    # the lexicon's other words: classes + 2 + class
    sent = sc.broadcast(at)
    near = pairs.where(F.col("cur") >= contexts + 2).mapInArrow(_to_class(sent), "word int, ctx int, n long").groupBy("word", "ctx").agg(F.sum("n").alias("n"))
    for r in assigned(near, m[:, :classes]).select("word", "class").collect():  # lexicon rows
        column[r[0]] = classes + 2 + r[1]
    m = _matrix(pairs, at, column, (classes + 2, 2 * classes + 2))
    sent.unpersist()
    known.unpersist()
    of_column = np.bincount(column, counts, 2 * classes + 2)
    emission = counts / np.maximum(of_column[column], 1)
    return Model(names, counts, context, column, m, transitions(m), emission, total[0] or 0, total[1], classes)


IN_PLACE = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:string,ctx:int,tf:int>>"


def _in_place(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        known = _Numbers((w, k) for k, w in enumerate(model.lexicon, start=2))
        base = np.log10((model.counts + 1) / model.base)
        for b in pieces(batches):
            lists, ids, ends = numbered(b.column("text").to_pylist(), known)
            if not len(lists):
                continue
            begins = np.r_[0, ends[:-1]]
            ctx = model.context[np.r_[END, ids[:-1]]]
            inside = ids != REST
            scored = np.where(inside, np.log10(model.probabilities(ctx, ids)), 0.0)
            based = np.where(inside, base[ids], 0.0)
            rest: list[tuple[str, int]] = []
            tf: list[int] = []
            cuts = [0]
            for words, begin, end in zip(lists, begins, ends):
                at = np.flatnonzero(ids[begin:end] == REST)
                found = Counter(zip([words[k] for k in at], ctx[begin + at].tolist()))
                rest += found
                tf += found.values()
                cuts.append(len(tf))
            pairs = [_column([w.decode("utf-8", "surrogatepass") for w, _ in rest], pa.string()), _column([c for _, c in rest], pa.int32()), _column(tf, pa.int32())]
            columns = [b.column("row"), b.column("doc_id"), b.column("held_out")]
            sums = [np.add.reduceat((inside & (model.counts[ids] > 0)).astype(np.int64), begins), np.add.reduceat(based, begins), np.add.reduceat(scored, begins)]
            columns += [_column(ends - begins, pa.int64()), _column(sums[0], pa.int64()), _column(sums[1], pa.float64()), _column(sums[2], pa.float64())]
            columns.append(pa.ListArray.from_arrays(_column(cuts, pa.int32()), pa.StructArray.from_arrays(pairs, ["word", "ctx", "tf"])))
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    return run


def rest_factors(model: Model, m: np.ndarray, kinds: np.ndarray, ones: int, twos: int) -> tuple[float, list[tuple[int, int, float, float]]]:
    """(discount, [(ctx, class, factor, plus)]) of words outside the lexicon.

    Such a word of the class with n occurrences has factor * (n - discount) after ctx; plus is, with class -1, what a word
    that was never seen has. m counts their classes (columns) after contexts (rows), kinds their different words.
    """
    discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
    has, kinds = m.sum(axis=0).tolist(), kinds.tolist()
    after = (model.weight * model.after[:, model.classes + 1][:, None] * transitions(m)).tolist()
    out = []
    for g in range(len(m)):
        plus = 0.0
        for c in range(m.shape[1]):
            share = after[g][c]
            if has[c]:
                out.append((g, c, share / has[c], 0.0))
                share *= discount * kinds[c] / has[c]
            plus += share
        out.append((g, -1, 0.0, plus))
    return discount, out


def scores(docs: DataFrame, key: str = "doc_id", **sizes) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs (key, text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text", out.alias("held_out"))
    model = train(rows.where("NOT held_out").select("text"), **sizes)
    sent = sc.broadcast(model)
    placed = staged(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_in_place(sent), IN_PLACE), "in-place")
    rest = placed.select("row", "held_out", F.explode("rest").alias("x")).select("row", "held_out", "x.*")
    near = rest.where("NOT held_out").groupBy("word", "ctx").agg(F.sum("tf").alias("n"))
    both = model.bigrams[:, : model.classes] + model.bigrams[:, model.classes + 2 :]
    words = staged(assigned(near, both), "rest-words")
    shape = (model.classes + 2, model.classes)
    m, kinds = np.zeros(shape, np.int64), np.zeros(model.classes, np.int64)
    for r in words.select("class", F.explode("near").alias("x")).groupBy("x.ctx", "class").agg(F.sum("x.n").alias("n")).collect():  # contexts x classes rows
        m[r[0], r[1]] = r.n
    ones = twos = 0
    for r in words.groupBy("class").agg(F.count("*").alias("k"), F.sum((F.col("n") == 1).cast("long")).alias("a"), F.sum((F.col("n") == 2).cast("long")).alias("b")).collect():
        kinds[r[0]] = r.k
        ones, twos = ones + r.a, twos + r.b
    discount, factors = rest_factors(model, m, kinds, ones, twos)
    lookup = spark.createDataFrame(factors, "ctx int, class int, factor double, plus double")  # (classes + 2) x (classes + 1) rows
    met = rest.join(words.select("word", F.col("n"), "class"), "word", "left").na.fill({"n": 0, "class": -1})
    met = met.join(F.broadcast(lookup), ["ctx", "class"])
    p = F.col("factor") * (F.col("n") - discount) + F.col("plus") + (1 - model.weight) * (F.col("n") + 1) / model.base
    late = met.groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(p)).alias("more"), F.sum(F.col("tf") * F.log10((F.col("n") + 1) / F.lit(float(model.base)))).alias("more_base"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known")
    )
    zero = F.lit(0)
    joined = placed.drop("rest").join(late, "row", "left")
    score = F.round(F.col("score") + F.coalesce("more", zero), 9)
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.round(F.col("base_score") + F.coalesce("more_base", zero), 9).alias("base_score"), score.alias("score"), F.round(F.pow(F.lit(10.0), -score / F.col("n_tokens")), 6).alias("perplexity"),
    )


def op13_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
