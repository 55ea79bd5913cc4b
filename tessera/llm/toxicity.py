"""Toxicity by class-conditional Kneser-Ney models (operator 3).

Two models, one of toxic and one of ordinary texts, spell an expression (a word) to its end: its first HEAD
characters at once, then character by character, each given all that comes before it in the word. Every code point but
white space is read: letters, marks and digits that follow each other are a word, every other sign (punctuation, symbols,
emoji) is one by itself. A word is read as all its windows of RUN characters, of which a word of up to so many has one,
itself. A run in a script that is written without spaces is read from each of its characters on, for as many characters,
so that expressions are met wherever they stand.

Class counts are discounted absolutely; one that was seen once keeps nothing of its own (its discount is 1). What is
taken away goes to a backoff that both classes share: the counts of both together, discounted in turn, and below them
the Kneser-Ney continuation of the character (in how many different contexts it follows). So an expression that is rare
in both classes is judged by shared counts and weighs nothing, and only what a class has seen repeatedly moves the ratio.

A text is judged by the difference of its two log-likelihoods over its length, and by the part of that difference that
strong expressions (log ratio above EVIDENCE) make, each counted once: over the length, in all, and as a power mean that
the strongest dominate. A logistic curve fitted on labelled texts that the counts have not seen makes a score of them.

How it runs, with one plan at every size: each task numbers the texts of a batch and writes, for each head in the
batch, its words and in which texts they stand how often. Labels meet a batch as a list of its labelled texts, and class
counts meet by head; a head's counted words and its words of all batches then meet in one sorted stream, where words are
spelled and sums per text made, which go back to their batch. Heads that hold more than their share are salted. No model
is collected or broadcast (but one number for each character that occurs, of 1.1 million that Unicode has), and whole
texts are read once and never shuffled.

Defined cases: null or blank texts score as texts without evidence; a null id counts as held out; labels that are null,
neither 0 nor 1, or without a text are not used, of repeated labels the largest counts; repeated rows are scored alike;
empty tables give an empty result; without labels every score is 0, with labels of one class only the share of toxic
ones; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged, table

HEAD = 3
#: Characters of the windows of a word.
RUN = 16
#: The end of a word: white space, which no word has.
END = "\t"
DISCOUNT = 0.75
#: Log ratio from which an expression speaks for toxicity, and the power of the mean that the strongest dominate.
EVIDENCE, POWER = 2.0, 4
#: Characters and texts of a batch; words that are spelled at a time and the bytes that go with them; sums or words that a task holds before it passes them on.
BATCH_CHARS, BATCH_TEXTS, SPELLED, SPELLED_BYTES, HELD = 16_000_000, 60_000, 200_000, 16 << 20, 2_000_000
#: Labelled rows at most that the logistic curve is fitted on, least hashes first.
FIT_ROWS = 20_000
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, Japanese syllables, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"


def _letters(stop: int, marks_only: bool = False) -> str:
    """Ranges of letters, marks and digits of other scripts."""
    apart = re.compile(f"[{UNSPACED}]")
    mark = lambda c: unicodedata.category(c)[0] == "M"
    inside = [(mark(c) or (c.isalnum() and not marks_only)) and not apart.match(c) for c in map(chr, range(stop))]
    at = np.flatnonzero(np.diff(np.r_[0, np.array(inside, np.int8), 0]))
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in at.reshape(-1, 2).tolist())


_LETTERS = _letters(0x110000)
_WORD = re.compile(rf"[{_LETTERS}]+|[{UNSPACED}]+|[^\s{_LETTERS}{UNSPACED}]")
_APART = re.compile(f"[{UNSPACED}]")
#: The same for texts that hold no marks, no script without spaces and nothing beyond the first 65,536 code points, much faster.
_PLAIN = re.compile(r"[^\W_]+|[^\w\s]|_")
_OTHER = re.compile(f"[{_letters(0x10000, True)}{UNSPACED.split(chr(0x20000))[0]}]")

INDEX = "batch long, head string, words string, lens binary, posts binary, at int, doc_id long, fold long, n long"
_INDEX = pa.schema(
    [("batch", pa.int64()), ("head", pa.string()), ("words", pa.string()), ("lens", pa.binary()), ("posts", pa.binary()), ("at", pa.int32()), ("doc_id", pa.int64()), ("fold", pa.int64()), ("n", pa.int64())]
)
#: A word in a text: the text's number and how often; more than 255 times are several in a row.
_POST = np.dtype([("at", "<u2"), ("n", "u1")])
_TOTAL, _STRONG = np.dtype([("at", "<u2"), ("total", "<f4")]), np.dtype([("at", "<u2"), ("strong", "<f4"), ("peak", "<f4")])


def head_of(w: str) -> str:
    return (w + END)[:HEAD]


def words_of(low: str) -> list[str]:
    """Words, other signs and runs of scripts without spaces of a text in lower case."""
    plain = low.isascii() or not (_OTHER.search(low) or max(low) > "\uffff")
    return (_PLAIN if plain else _WORD).findall(low)


def units(text: str) -> Iterator[str]:
    """What is spelled of a text: windows of its words, its other signs, and runs of scripts without spaces from each character on."""
    for w in words_of(text.lower()):
        last = len(w) - 1 if _APART.match(w) else max(len(w) - RUN, 0)
        for i in range(last + 1):
            yield w[i : i + RUN]


class _Numbers(dict):
    """Number of each word, given as it is met."""

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        return n


class _Batch:
    """Numbered texts with the words in them."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.known, self.codes, self.times, self.rows = _Numbers(), [], [], []

    def add(self, doc_id, fold, text: str) -> None:
        if len(text) > BATCH_CHARS:
            found = Counter(units(text))
            code, times = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        else:
            words = words_of(text.lower())
            if max(map(len, words), default=0) > RUN or _APART.search(text):
                words = list(units(text))
            code, times = np.unique(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.codes.append(code.astype(np.int32))
        self.times.append(times.astype(np.int32))
        self.rows.append((doc_id, fold, int(times.sum())))
        self.chars += len(text)

    def tables(self) -> Iterator[pa.RecordBatch]:
        n, words = len(self.rows), list(self.known)
        by_word = sorted(range(len(words)), key=words.__getitem__)
        place = np.empty(len(words), np.int32)
        place[by_word] = np.arange(len(words))
        words = [words[i] for i in by_word]
        sizes = np.fromiter(map(len, self.codes), np.int64, n)
        code, times, at = place[np.concatenate(self.codes)], np.concatenate(self.times), np.repeat(np.arange(n, dtype=np.uint16), sizes)
        order = np.argsort(code, kind="stable")
        code, times, at = code[order], times[order], at[order]
        several = -(-times // 255)
        if len(times) and several.max() > 1:
            nth = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
            code, at, times = np.repeat(code, several), np.repeat(at, several), np.minimum(np.repeat(times, several) - 255 * nth, 255)
        posts = np.empty(len(code), _POST)
        posts["at"], posts["n"] = at, times
        lens = np.bincount(code, minlength=len(words)).astype("<u4")
        ends = np.r_[0, np.cumsum(lens.astype(np.int64))]
        rows, held, a = [], 0, 0
        for b in range(1, len(words) + 1):
            if b == len(words) or head_of(words[b]) != head_of(words[a]):
                rows.append((head_of(words[a]), " ".join(words[a:b]), lens[a:b].tobytes(), posts[ends[a] : ends[b]].tobytes()))
                held += len(rows[-1][3])
                a = b
                if held > 4 << 20 or b == len(words):
                    columns = zip(("head", "words", "lens", "posts"), zip(*rows))
                    yield self._table(len(rows), **{c: pa.array(x, _INDEX.field(c).type) for c, x in columns})
                    rows, held = [], 0
        doc_id, fold, length = zip(*self.rows)
        yield self._table(n, at=pa.array(range(n), pa.int32()), doc_id=pa.array(doc_id, pa.int64()), fold=pa.array(fold, pa.int64()), n=pa.array(length, pa.int64()))

    def _table(self, size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["batch"] = pa.array(np.full(size, self.number))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _INDEX], schema=_INDEX)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held = _Batch(part << 32)
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "fold", "text"))):
            held.add(*row)
            if held.chars >= BATCH_CHARS or len(held.rows) >= BATCH_TEXTS:
                yield from held.tables()
                number += 1
                held = _Batch(part << 32 | number)
    if held.rows:
        yield from held.tables()


COUNTED = "head string, words string, n1 binary, n0 binary"


def _counted_row(head: str, counts: dict[str, list[int]]) -> tuple:
    words = sorted(counts)
    n = np.array([counts[w] for w in words], np.int64)
    return head, " ".join(words), n[:, 0].tobytes(), n[:, 1].tobytes()


def _counted_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.binary()))], ["head", "words", "n1", "n0"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index, sorted by batch after the list of its labelled texts, as class counts of each head's words."""
    held: dict[str, dict[str, list[int]]] = {}
    size, number, toxic = 0, None, None
    for b in batches:
        for batch, marks, head, words, lens, posts in zip(*(b.column(c).to_pylist() for c in ("batch", "marks", "head", "words", "lens", "posts"))):
            if batch != number:
                number, toxic = batch, None
            if marks is not None:
                toxic = np.zeros(1 << 16, np.int8)
                marks = np.asarray(marks, np.int64)
                toxic[marks >> 1] = 1 + (marks & 1)
            elif toxic is not None:
                p, ends = np.frombuffer(posts, _POST), np.cumsum(np.frombuffer(lens, "<u4").astype(np.int64))
                kind = toxic[p["at"]]
                if not kind.any():
                    continue
                n0, n1 = (np.diff(np.r_[0, np.cumsum(p["n"].astype(np.int64) * (kind == k))[ends - 1]]) for k in (1, 2))
                own, names = held.setdefault(head, {}), words.split(" ")
                for i in np.flatnonzero(n0 + n1).tolist():
                    c = own.get(names[i])
                    if c is None:
                        own[names[i]] = [int(n1[i]), int(n0[i])]
                        size += 1
                    else:
                        c[0] += int(n1[i])
                        c[1] += int(n0[i])
        if size > HELD // 4:
            yield _counted_rows([_counted_row(h, c) for h, c in held.items()])
            held, size = {}, 0
    if held:
        yield _counted_rows([_counted_row(h, c) for h, c in held.items()])


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, sorted by head, as one row per head."""
    out, held, size, at = [], {}, 0, None
    for b in batches:
        for head, words, n1, n0 in zip(*(b.column(c).to_pylist() for c in ("head", "words", "n1", "n0"))):
            if head != at and held:
                out.append(_counted_row(at, held))
                size += len(held)
                held = {}
                if size > 100_000:
                    yield _counted_rows(out)
                    out, size = [], 0
            at = head
            for w, x, y in zip(words.split(" "), np.frombuffer(n1, np.int64).tolist(), np.frombuffer(n0, np.int64).tolist()):
                c = held.setdefault(w, [0, 0])
                c[0] += x
                c[1] += y
    if held:
        out.append(_counted_row(at, held))
    yield _counted_rows(out)


def kept(n: np.ndarray) -> np.ndarray:
    """What a class keeps of its counts."""
    return np.where(n > 1, n - DISCOUNT, 0.0)


def shared(n: np.ndarray) -> np.ndarray:
    """What both classes together keep."""
    return np.maximum(n - DISCOUNT, 0.0)


class Spelling:
    """The tree of the prefixes of words that come in order, with whole heads."""

    def __init__(self, words: list[str], n1: np.ndarray, n0: np.ndarray):
        self.counts = (n1, n0, n1 + n0)
        letters = np.array([w + END for w in words], f"U{RUN + 1}")
        self.codes = letters.view(np.uint32).reshape(len(words), RUN + 1)
        self.new = np.vstack([np.ones(RUN + 1, bool), np.logical_or.accumulate(self.codes[1:] != self.codes[:-1], axis=1)])

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(node of each word, first word of each node, counts of each node) of the prefixes of so many characters."""
        begin = np.flatnonzero(self.new[:, depth - 1])
        return np.cumsum(self.new[:, depth - 1]) - 1, begin, [np.add.reduceat(c, begin) for c in self.counts]

    def continuations(self) -> tuple[np.ndarray, np.ndarray]:
        """(character, number of contexts that it follows in the counted words)."""
        found = []
        for depth in range(HEAD + 1, RUN + 2):
            _, begin, (_, _, n) = self.nodes(depth)
            c = self.codes[begin, depth - 1]
            found.append(c[(c > 0) & (n > 0)])
        return np.unique(np.concatenate(found), return_counts=True)

    def ratios(self, base: Base) -> np.ndarray:
        """Log ratio of the toxic to the ordinary model of each word."""
        node, _, counts = self.nodes(HEAD)
        out = base.of_heads(*counts)[node]
        for depth in range(HEAD + 1, RUN + 2):
            below, begin, n = self.nodes(depth)
            parent, c = node[begin], self.codes[begin, depth - 1]
            before = [x[parent] for x in counts]
            rest = [x - np.bincount(parent, k(y), len(x)) for x, y, k in zip(counts, n, (kept, kept, shared))]
            with np.errstate(divide="ignore", invalid="ignore"):
                both = (shared(n[2]) + rest[2][parent] * base.of(c)) / before[2]
                p = [np.where(before[k] > 0, (kept(n[k]) + rest[k][parent] * both) / before[k], both) for k in (0, 1)]
                step = np.where((c > 0) & (before[2] > 0), np.log(p[0] / p[1]), 0.0)
            out += step[below]
            node, counts = below, n
        return out


class Base:
    """What the whole of the counts says: totals of the heads, and the continuation of each character."""

    def __init__(self, chars: list[int], times: list[int], totals: list[float], rests: list[float], heads: int):
        order = np.argsort(np.asarray(chars, np.uint32))
        self.chars, self.times = np.asarray(chars, np.uint32)[order], np.asarray(times, np.float64)[order]
        self.total = float(self.times.sum()) + len(self.chars) + 1
        self.totals, self.rests, self.n_heads = totals, rests, heads

    def of(self, c: np.ndarray) -> np.ndarray:
        if not len(self.chars):
            return np.full(len(c), 1.0)
        at = np.minimum(np.searchsorted(self.chars, c), len(self.chars) - 1)
        return (np.where(self.chars[at] == c, self.times[at], 0.0) + 1) / self.total

    def of_heads(self, n1: np.ndarray, n0: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not (self.totals[0] and self.totals[1]):
            return np.zeros(len(n))
        both = (shared(n) + self.rests[2] / (self.n_heads + 1)) / self.totals[2]
        return np.log((kept(n1) + self.rests[0] * both) / self.totals[0] / ((kept(n0) + self.rests[1] * both) / self.totals[1]))


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[Spelling]:
    """Rows of COUNTED as trees of whole heads, about SPELLED words at a time."""
    words, n1, n0 = [], [], []
    for b in batches:
        for w, x, y in zip(*(b.column(c).to_pylist() for c in ("words", "n1", "n0"))):
            words += w.split(" ")
            n1.append(np.frombuffer(x, np.int64))
            n0.append(np.frombuffer(y, np.int64))
            if len(words) > SPELLED:
                yield Spelling(words, np.concatenate(n1), np.concatenate(n0))
                words, n1, n0 = [], [], []
    if words:
        yield Spelling(words, np.concatenate(n1), np.concatenate(n0))


BASE = "c long, times long, h1 long, h0 long, k1 double, k0 double, k double, heads long"


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition's heads add to Base: how often each character follows, and in a row without character the heads' sums."""
    for tree in _spellings(batches):
        c, times = tree.continuations()
        n1, n0, n = tree.nodes(HEAD)[2]
        values = (int(n1.sum()), int(n0.sum()), float(kept(n1).sum()), float(kept(n0).sum()), float(shared(n).sum()), int((n > 0).sum()))
        columns = [[*c.tolist(), None], [*times.tolist(), None], *[[None] * len(c) + [v] for v in values]]
        types = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], [x.split()[0] for x in BASE.split(", ")])


def base_of(counted: DataFrame) -> Base:
    """counted: one row of COUNTED per head."""
    found = counted.mapInArrow(_base, BASE).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("times", "h1", "h0", "k1", "k0", "k", "heads")]).collect()
    t = next((r for r in found if r["c"] is None), None)
    if t is None:
        return Base([], [], [0.0] * 3, [0.0] * 3, 0)
    n1, n0 = float(t["h1"]), float(t["h0"])
    follows = [r for r in found if r["c"] is not None]
    return Base([r["c"] for r in follows], [r["times"] for r in follows], [n1, n0, n1 + n0], [n1 - t["k1"], n0 - t["k0"], n1 + n0 - t["k"]], t["heads"])


PACKED = "batch long, totals binary, strongs binary"


def _packed(batch: np.ndarray, at: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    """Sums, sorted by batch, as one row per batch."""
    totals, strongs = np.empty(len(at), _TOTAL), np.empty(len(at), _STRONG)
    totals["at"], totals["total"] = at, values[0]
    strongs["at"], strongs["strong"], strongs["peak"] = at, values[1], values[2]
    cut = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(batch) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(at)]
    some = [strongs[a:b] for a, b in zip(cut, ends)]
    rows = [totals[a:b].tobytes() for a, b in zip(cut, ends)], [x[x["strong"] > 0].tobytes() for x in some]
    return pa.RecordBatch.from_arrays([pa.array(batch[cut], pa.int64()), *(pa.array(r, pa.binary()) for r in rows)], ["batch", "totals", "strongs"])


def _merged(parts: list[tuple]) -> tuple:
    """(batch, at, sums) of all parts, each (batch, at) once, in order."""
    batch, at = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.lexsort((at, batch))
    batch, at = batch[order], at[order]
    first = np.flatnonzero(np.r_[True, (batch[1:] != batch[:-1]) | (at[1:] != at[:-1])])
    return batch[first], at[first], [np.add.reduceat(np.concatenate([p[2][k] for p in parts])[order], first) for k in range(3)]


class _Chunk:
    """Words of some heads, counted or standing in batches."""

    def __init__(self):
        self.counts: dict[str, tuple[int, int]] = {}
        self.names, self.lens, self.posts, self.batches, self.bytes = [], [], [], [], 0

    def add(self, batch, words, lens, posts, n1, n0) -> None:
        names = words.split(" ")
        if posts is None:
            self.counts.update(zip(names, zip(np.frombuffer(n1, np.int64).tolist(), np.frombuffer(n0, np.int64).tolist())))
        else:
            self.names += names
            self.lens.append(np.frombuffer(lens, "<u4").astype(np.int64))
            self.posts.append(posts)
            self.batches.append((batch, len(names)))
            self.bytes += len(posts)

    def sums(self, base: Base) -> tuple:
        words = sorted({*self.counts, *self.names})
        n = np.array([self.counts.get(w, (0, 0)) for w in words], np.int64)
        ratio = dict(zip(words, Spelling(words, n[:, 0], n[:, 1]).ratios(base).tolist()))
        each = np.concatenate(self.lens)
        value = np.repeat(np.fromiter(map(ratio.__getitem__, self.names), np.float64, len(self.names)), each)
        batch = np.repeat(np.repeat([b for b, _ in self.batches], [k for _, k in self.batches]), each)
        p = np.frombuffer(b"".join(self.posts), _POST)
        # of a word that stands in a text more than 255 times, the strong part counts once
        starts = np.zeros(len(p), bool)
        starts[np.cumsum(each) - each] = True
        once = starts | np.r_[True, p["at"][1:] != p["at"][:-1]]
        strong = np.where(once, np.maximum(value - EVIDENCE, 0.0), 0.0)
        return _merged([(batch, p["at"].astype(np.int64), [p["n"] * value, strong, strong**POWER])])


def _sums(base: Base):
    """Rows sorted by head and salt, counted words first, as sums per text, packed by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk, at = [], 0, _Chunk(), None
        for b in batches:
            for head, salt, batch, words, lens, posts, n1, n0 in zip(*(b.column(c).to_pylist() for c in ("head", "salt", "batch", "words", "lens", "posts", "n1", "n0"))):
                full = len(chunk.names) > SPELLED or chunk.bytes > SPELLED_BYTES
                if full and chunk.names:
                    held.append(chunk.sums(base))
                    size += len(held[-1][0])
                    counts = chunk.counts if (head, salt) == at else {}  # the head goes on in the next chunk
                    chunk = _Chunk()
                    chunk.counts = {w: c for w, c in counts.items() if head_of(w) == head}
                    if size > HELD:
                        held = [_merged(held)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield _packed(*held[0])
                            held, size = [], 0
                at = head, salt
                chunk.add(batch, words, lens, posts, n1, n0)
        if chunk.names:
            held.append(chunk.sums(base))
        if held:
            yield _packed(*_merged(held))

    return run


FEATURES = "batch long, at int, total double, strong double, peak double"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums, sorted by batch, as one row per text."""
    held, at = [], None

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        batch, place, values = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(batch), pa.array(place.astype(np.int32)), *map(pa.array, values)], ["batch", "at", "total", "strong", "peak"])

    for b in batches:
        for number, totals, strongs in zip(*(b.column(c).to_pylist() for c in ("batch", "totals", "strongs"))):
            if number != at and held:
                yield rows(held)
                held = []
            at = number
            for sums, kind in ((totals, _TOTAL), (strongs, _STRONG)):
                x = np.frombuffer(sums, kind)
                held.append((np.full(len(x), number), x["at"].astype(np.int64), [x[c].astype(np.float64) if c in kind.names else np.zeros(len(x)) for c in ("total", "strong", "peak")]))
    if held:
        yield rows(held)


def inputs() -> list:
    """What the curve sees: the difference over the length; strong parts over the length, in all and as a power mean; the length."""
    m = F.greatest(F.col("n"), F.lit(1))
    difference = F.least(F.greatest(F.col("total") / m, F.lit(-3.0)), F.lit(3.0))
    return [difference, F.log1p(100 * F.col("strong") / m), F.log1p(F.col("strong")), F.pow(F.col("peak"), F.lit(1 / POWER)), F.log(m.cast("double"))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w * np.r_[0, np.ones(len(w) - 1)]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _salted(index: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """Rows of the index and counted words, in the order of heads; a head with more than a quarter of a part of all bytes is dealt."""
    quarter = 4 * parts
    sizes = staged(index.groupBy("head").agg(F.sum(F.octet_length("posts").cast("long")).alias("bytes")), "tox-heads")
    total = sizes.agg(F.sum("bytes")).first()[0] or 1
    hot = sizes.where(F.col("bytes") * quarter > total).select("head", F.ceil(F.col("bytes") * quarter / total).cast("int").alias("salts"))
    hot = F.broadcast(hot)  # fewer rows than quarters of parts
    salts = F.coalesce(F.col("salts"), F.lit(1))
    empty = F.lit(None).cast("binary")
    a = index.join(hot, "head", "left").select("head", F.pmod(F.xxhash64("batch"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "batch", "words", "lens", "posts", empty.alias("n1"), empty.alias("n0"))
    b = counted.join(hot, "head", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    b = b.select("head", "salt", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("batch"), "words", empty.alias("lens"), empty.alias("posts"), "n1", "n0")
    return a.unionByName(b).repartition(parts, "head", "salt").sortWithinPartitions("head", "salt", "kind")


def _curve(found: DataFrame) -> list[float] | float:
    """Weights of the curve, or the score of every text if the labels have one class or none."""
    known = found.where("toxic IS NOT NULL AND fold <> 0")
    n = {(r["last"], r["toxic"]): r["n"] for r in known.groupBy((F.col("fold") == 4).alias("last"), "toxic").agg(F.count("*").alias("n")).collect()}
    classes = {k[1] for k in n}
    if len(classes) < 2:
        return float(next(iter(classes), 0))
    if (True, 0) in n and (True, 1) in n:
        known = known.where("fold = 4")
        rows = n[True, 0] + n[True, 1]
    else:
        rows = sum(n.values())
    order = F.xxhash64("doc_id", "n", "total")
    share = min(1.0, 4 * FIT_ROWS / rows)
    if share < 1:
        known = known.where(order <= int(-(2**63) + share * 2**64))
    sample = known.select(order.alias("h"), "doc_id", F.col("toxic").cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(inputs())])
    sample = sample.orderBy("h", "doc_id", "y", "x0").limit(FIT_ROWS).collect()
    y = np.array([r["y"] for r in sample])
    if len(set(y.tolist())) < 2:
        return float(y.mean())
    return fit(np.array([r[3:] for r in sample], float), y).tolist()


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); labels: doc_id, toxic."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = staged(known, "tox-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    every = staged(texts.mapInArrow(_index, INDEX), "tox-index")
    rows = staged(every.where("at IS NOT NULL").select("batch", "at", "doc_id", "fold", "n").join(known, "doc_id", "left"), "tox-texts")
    index = every.where("head IS NOT NULL").select("batch", "head", "words", "lens", "posts")
    none = F.lit(None).cast("string")
    marks = rows.where("toxic IS NOT NULL AND fold IN (1, 2, 3)").groupBy("batch").agg(F.collect_list(F.col("at") * 2 + F.col("toxic")).alias("marks"))
    marks = marks.select("batch", F.lit(0).alias("kind"), "marks", none.alias("head"), none.alias("words"), none.cast("binary").alias("lens"), none.cast("binary").alias("posts"))
    met = index.select("batch", F.lit(1).alias("kind"), F.lit(None).cast("array<int>").alias("marks"), "head", "words", "lens", "posts").unionByName(marks)
    counted = met.repartition(parts, "batch").sortWithinPartitions("batch", "kind").mapInArrow(_count, COUNTED)
    counted = staged(counted.repartition(parts, "head").sortWithinPartitions("head").mapInArrow(_sum_counts, COUNTED), "tox-counted")
    sums = staged(_salted(index, counted, parts).mapInArrow(_sums(base_of(counted)), PACKED), "tox-sums")
    sums = sums.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(_spread, FEATURES)
    found = staged(rows.join(sums, ["batch", "at"], "left").fillna(0.0, ["total", "strong", "peak"]), "tox-found")
    curve = _curve(found)
    if isinstance(curve, float):
        value = F.lit(curve)
    else:
        z = F.lit(curve[0])
        for w, x in zip(curve[1:], inputs()):
            z = z + F.lit(w) * x
        value = F.round(1 / (1 + F.exp(-z)), 9)
    out = found.select("doc_id", (F.col("fold") == 0).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
