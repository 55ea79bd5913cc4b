"""Personal data by candidate gradient boosting (operator 10).

Rules give the base spans (email, ip, card, phone). High-recall generators also propose looser, overlapping spans of the
same kinds; boosted trees judge each by its format and its context, and those that no base span overlaps are added, as
x_email and so on, if their score passes their kind's threshold; of added spans that overlap the likeliest stays.

The trees are trained here, and not on what the base rules say of a span: spans that a rule confirms are rewritten in
forms that the rules do not know (spelt-out or spaced emails, spaced or bracketed ips, dotted cards, phones without
plus) where they stand in their text, and what the generators find there is right; the same forms with values that
cannot be (a failing checksum, a part above 255, a date, words around "at" and "dot") are wrong, and so are loose
candidates of the corpus that something contradicts; what is merely not confirmed is not used. Thresholds are calibrated for a precision of PRECISION on spans whose
texts the trees have not seen in any form; a kind with fewer than LEAST_SUPPORT of them adds nothing.

The sample has at most FIT_SPANS confirmed and as many unconfirmed spans of each kind, those with the least hashes, drawn
from all texts that have any: a first pass counts them, a second draws them, each as a snippet of at most SNIPPET
characters on either side. All texts are searched whole, in place; nothing is shuffled but the sample.

Defined cases: a null text counts as empty and has no spans; repeated rows are reported each; an empty table gives an
empty result; other columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import staged, table

KINDS = ("email", "ip", "card", "phone")
#: Sampled spans of a kind at most, confirmed and unconfirmed each; characters of a snippet on either side, and of a span in one.
FIT_SPANS, SNIPPET, LONGEST = 1500, 48, 256
PRECISION, LEAST_SUPPORT = 0.98, 15
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
SEED = 23
#: Candidates that are judged at a time.
JUDGED = 20_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Looser forms: spelt-out or spaced emails, spaced or bracketed ips, number groups with any separators and brackets.
_NAMES_AT = re.compile(r"[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?\.[\x20]?[A-Za-z0-9-]{1,63})+")
_NAMES_SPELT = re.compile(r"[\x20]?[A-Za-z0-9-]{1,63}(?:(?:\.|[\x20]?(?:\(dot\)|\[dot\])[\x20]?|\x20dot\x20)[A-Za-z0-9-]{1,63})+")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]?\(?[0-9]{1,6}\)?){1,7}(?![0-9A-Za-z])")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:[\x20]?\.[\x20]?|\[\.\])[0-9]{1,3}){3}(?![0-9])")
_AT = (("@", _NAMES_AT), ("(at)", _NAMES_SPELT), ("[at]", _NAMES_SPELT), (" at ", _NAMES_SPELT))
#: Digits and what may stand between them: where loose numbers can be.
_REGION = re.compile(r"[0-9][0-9\x20./()-]*")
#: Last parts of names of hosts that are common.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu nl ch biz".split())
_CUE = {
    "email": re.compile(r"mail|contact|write|address", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|credit|iban|account", re.I),
    "phone": re.compile(r"tel|phone|call|mobil|fax", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        elif start < at:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """Names before and after each mark for "at", found from the mark; a name before it has at most 64 characters."""
    for mark, names in _AT:
        at = text.find(mark)
        while at >= 0:
            m = names.match(text, at + len(mark))
            start = at - 1 if text[at - 1 : at] == " " and mark != " at " else at
            low = start
            while m and low > 0 and start - low < 64 and text[low - 1] in _LOCAL:
                low -= 1
            while low < start and not text[low].isalnum():
                low += 1
            if m and low < start:
                yield low, m.end()
            at = text.find(mark, at + 1)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Loose (start, kind, end) proposals; they may overlap, also between kinds."""
    out = [(a, 0, b) for a, b in _loose_emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _LOOSE_IP.finditer(text)]
        for region in _REGION.finditer(text):
            if region.end() - region.start() < 7:
                continue
            for m in _LOOSE_NUMBER.finditer(text, max(0, region.start() - 2), region.end() + 1):
                n = sum(c in "0123456789" for c in m[0])
                if 12 <= n <= 19:
                    out.append((m.start(), 2, m.end()))
                if 7 <= n <= 15:
                    out.append((m.start(), 3, m.end()))
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """What the trees see of a candidate: its kind, format and neighbourhood."""
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    seps = re.sub(r"[0-9A-Za-z]", "", s)
    last = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    side = lambda c: 0.0 if not c or c.isspace() else 2.0 if c.isalnum() else 1.0
    sizes = [len(g) for g in groups]
    return [
        *[float(kind == k) for k in range(4)], len(s), len(digits), len(seps), len(groups), float(s.startswith(("+", "00"))), float("(" in s),
        float(bool(digits) and luhn(digits)), float(bool(groups) and all(int(g[:6]) <= 255 for g in groups)), float("@" in s), float("at)" in s or "at]" in s), float("dot" in s), s.count("."),
        float(groups[0][0]) if groups else -1.0, float(bool(_CUE[KINDS[kind]].search(text[max(0, start - 24) : start]))), side(before), side(after),
        float(sum(c.isdigit() for c in text[max(0, start - 12) : start] + text[end : end + 12])), float(sizes[0]) if sizes else -1.0, float(sizes[-1]) if sizes else -1.0, float(max(sizes, default=0)), float(len(set(seps))), float(last in TOP_DOMAINS), float(len(last)), float(any(c.isdigit() for c in s[:4])),
    ]


def rewritten(kind: int, s: str, rnd: random.Random) -> tuple[list[str], list[str]]:
    """(forms of a confirmed span that no base rule knows, the same forms with values that cannot be)."""
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        local, host = s.split("@", 1)
        dots = host.split(".")
        word = lambda: "".join(rnd.choice("aeionrstl") for _ in range(rnd.randint(5, 9)))
        spelt = lambda n, d: [f"{n} at {' dot '.join(d)}", f"{n} (at) {' (dot) '.join(d)}", f"{n}[at]{'[dot]'.join(d)}", f"{n} @ {' . '.join(d)}"]
        right = spelt(local, dots) + spelt(word(), [word(), dots[-1]]) + spelt(f"{word()}.{word()}", dots[-2:])
        return right, [f"{word()} at {word()} dot {word()}", f"{word()} @ {word()}. {word()}", f"{word()} at {word()}.{word()}"]
    if kind == 1:
        parts = s.split(".")
        bad = list(parts)
        bad[rnd.randrange(4)] = str(rnd.randint(256, 999))
        forms = lambda p: [" . ".join(p), "[.]".join(p), ". ".join(p)]
        return forms(parts), forms(bad)
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + rnd.randint(1, 9)) % 10)
        forms = lambda d: [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in ("./"[rnd.randrange(2)], ".")]
        return forms(digits), forms(wrong)
    local = digits[-10:]
    groups = (local[:-7], local[-7:-4], local[-4:])
    right = ["-".join(groups), ".".join(groups), f"({groups[0]}) {groups[1]}-{groups[2]}", " ".join(groups), f"00{digits[:-10]} {' '.join(groups)}"]
    day = lambda: (f"{rnd.randint(1, 28):02d}", f"{rnd.randint(1, 12):02d}", str(rnd.randint(1950, 2035)))
    return right, [".".join(day()), "-".join(reversed(day())), f"{rnd.randint(1, 999)}.{rnd.randint(0, 999):03d}.{rnd.randint(0, 999):03d}", str(rnd.randint(10**6, 10**11)), f"{rnd.randint(1900, 2030)}-{rnd.randint(1900, 2030)}"]


class BoostedTrees:
    """Gradient boosting for the logistic loss over histograms; trees of fixed depth as flat arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._leaf(tree, binned)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        feature, cut, value = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS), np.zeros(2**DEPTH)
        node = np.zeros(len(b), int)
        for level in range(DEPTH):
            for k in range(2**level):
                at, best = 2**level - 1 + k, 1e-6
                rows = np.flatnonzero(node == k)
                if len(rows) > 1:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f in range(b.shape[1]):
                        gl = np.cumsum(np.bincount(b[rows, f], g[rows], BINS + 1))[:-1]
                        hl = np.cumsum(np.bincount(b[rows, f], h[rows], BINS + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        c = int(gain.argmax())
                        if gain[c] > best:
                            best, feature[at], cut[at] = gain[c], f, c
            node = 2 * node + (b[np.arange(len(b)), feature[2**level - 1 + node]] > cut[2**level - 1 + node])
        for k in range(2**DEPTH):
            rows = node == k
            value[k] = RATE * g[rows].sum() / (h[rows].sum() + 1)
        return feature, cut, value

    @staticmethod
    def _leaf(tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + (b[np.arange(len(b)), feature[at]] > cut[at])
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        return 1 / (1 + np.exp(-(self.start + sum(self._leaf(t, b) for t in self.trees))))


_DATE = re.compile(r"[0-3]?[0-9][./-][01]?[0-9][./-][0-9]{2,4}|[0-9]{4}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-9]{4}-[0-9]{4}")
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:[. ][0-9]{3})+")


def contradicted(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a candidate cannot be of its kind: what merely is not confirmed may be, and teaches nothing."""
    s = text[start:end]
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9-]+", s)[-1]
        return not last.isalpha() or len(last) > 6
    if kind == 1:
        return any(int(g) > 255 for g in re.findall("[0-9]+", s))
    if kind == 2:
        return not luhn(digits)
    beside = any(c.isdigit() for c in text[max(0, start - 6) : start] + text[end : end + 6])  # a row of a table of numbers
    return s == digits or beside or bool(_DATE.fullmatch(s) or _THOUSANDS.fullmatch(s))


Sample = tuple[int, bool, str, int, int]  # kind, confirmed, snippet, start and end in it


class Redactor:
    """Trees and thresholds, fitted on sampled snippets."""

    def __init__(self, sample: list[Sample]):
        self.trees, self.limits = None, [2.0] * len(KINDS)
        xs, ys, kinds, held = [], [], [], []
        for kind, confirmed, text, a, b in sample:
            rnd = random.Random(f"{SEED}/{text}/{a}")
            apart = rnd.random() < 0.4  # all forms of a text are on one side
            spans = [(features(text, a, kind, b), False)] if not confirmed and contradicted(kind, text, a, b) else []
            for right, forms in zip((True, False), rewritten(kind, text[a:b], rnd)) if confirmed else ():
                for form in forms:
                    t, end = text[:a] + form + text[b:], a + len(form)
                    near = [(x, y) for x, k, y in candidates(t) if k == kind and x < end and a < y]
                    spans += [(features(t, x, kind, y), right) for x, y in near if not right or min(y, end) - max(x, a) >= 0.8 * (max(y, end) - min(x, a))]
            for x, y in spans:
                xs.append(x)
                ys.append(float(y))
                kinds.append(kind)
                held.append(apart)
        y, kinds, held = np.array(ys), np.array(kinds), np.array(held, bool)
        if len(xs) < 40 or len(set(y[~held].tolist())) < 2 or not held.any():
            return
        x = np.array(xs)
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        p = self.trees.predict(x[held])
        for k in range(len(KINDS)):
            own = np.flatnonzero(kinds[held] == k)
            order = own[np.argsort(-p[own], kind="stable")]
            right = np.cumsum(y[held][order])
            good = np.flatnonzero((right >= PRECISION * np.arange(1, len(order) + 1)) & (right >= LEAST_SUPPORT))
            if len(good):
                self.limits[k] = float(max(0.5, p[order[good[-1]]]))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Base spans and added ones (kinds from len(KINDS) on) of each text, sorted."""
        out, loose = [base_spans(t) for t in texts], []
        if self.trees is None:
            return out
        for i, text in enumerate(texts):
            free = _outside(out[i])
            loose += [(i, a, k, b) for a, k, b in candidates(text) if self.limits[k] <= 1 and free(a, b)]
        added: dict[int, list[tuple[float, int, int, int]]] = {}
        for c in range(0, len(loose), JUDGED):
            some = loose[c : c + JUDGED]
            for (i, a, k, b), p in zip(some, self.trees.predict(np.array([features(texts[i], a, k, b) for i, a, k, b in some]))):
                if p >= self.limits[k]:
                    added.setdefault(i, []).append((float(p), a, k + len(KINDS), b))
        for i, found in added.items():
            out[i] = sorted(out[i] + _likeliest(found))
        return out


def _outside(spans: list[tuple[int, int, int]]):
    """A test whether an interval overlaps none of the sorted spans."""
    starts, reach, far = [s for s, _, _ in spans], [], 0
    for _, _, e in spans:
        far = max(far, e)
        reach.append(far)

    def free(a: int, b: int) -> bool:
        n = bisect.bisect_left(starts, b)  # those that start before b
        return not n or reach[n - 1] <= a

    return free


def _likeliest(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the candidates, from left to right, each that overlaps no likelier one chosen before it."""
    kept: list[tuple[float, int, int, int]] = []
    for c in sorted(found, key=lambda c: (c[1], -c[0], c[2])):
        if not kept or kept[-1][3] <= c[1]:
            kept.append(c)
        elif c[0] > kept[-1][0]:
            kept[-1] = c
    return [(a, k, b) for _, a, k, b in kept]


def _sorted_out(text: str) -> Iterator[tuple[int, bool, int, int]]:
    """(kind, confirmed, start, end) of base spans and of the candidates that overlap none."""
    base = base_spans(text)
    free = _outside(base)
    for a, k, b in base:
        yield k, True, a, b
    for a, k, b in candidates(text):
        if free(a, b):
            yield k, False, a, b


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            n.update((k, hit) for k, hit, _, _ in _sorted_out(text))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.int32()), pa.array([h for _, h in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], ["kind", "hit", "n"])


DRAWN = "kind int, hit boolean, h long, snippet string, a int, b int"


def _drawn(share: dict[tuple[int, bool], float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                for k, hit, a, b in _sorted_out(text):
                    if b - a > LONGEST:
                        continue
                    begin = max(0, a - SNIPPET)
                    snippet = text[begin : b + SNIPPET]
                    h = xxhash.xxh3_64_intdigest(f"{k}/{a - begin}/{snippet}")
                    if h <= share[k, hit] * 2**64:
                        rows.append((k, hit, h >> 1, snippet, a - begin, b - begin))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "hit", "h", "snippet", "a", "b"])

    return run


def redactor(docs: DataFrame) -> Redactor:
    """A model from at most FIT_SPANS spans of each kind, confirmed and unconfirmed, of all documents."""
    texts = docs.where(F.col("text").rlike("[0-9@]| at |[(\\[]at")).select("text")
    n = {(r["kind"], r["hit"]): r["n"] for r in texts.mapInArrow(_counted, "kind int, hit boolean, n long").groupBy("kind", "hit").agg(F.sum("n").alias("n")).collect()}
    if not n:
        return Redactor([])
    share = {k: min(1.0, 4 * FIT_SPANS / v) for k, v in n.items()}
    drawn = staged(texts.mapInArrow(_drawn(share), DRAWN).dropDuplicates(["kind", "hit", "snippet", "a"]), "pii-sample")
    place = F.row_number().over(W.partitionBy("kind", "hit").orderBy("h", "snippet", "a"))
    rows = drawn.withColumn("place", place).where(F.col("place") <= FIT_SPANS).orderBy("kind", "hit", "place").collect()
    return Redactor([(r["kind"], r["hit"], r["snippet"], r["a"], r["b"]) for r in rows])


ALL_KINDS = KINDS + tuple(f"x_{k}" for k in KINDS)
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of docs (key, text): counts, digest of the base spans, all spans."""
    model = docs.sparkSession.sparkContext.broadcast(redactor(docs))  # trees of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spans in model.value.spans(b.column("text").to_pylist()):
                said = [(k, f"{ALL_KINDS[k]}:{x}:{y}") for x, k, y in spans]
                base = ",".join(s for k, s in said if k < len(KINDS))
                n = Counter(k for k, _ in said)
                out.append((*[n[j] for j in range(len(KINDS))], hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in said)))
            columns = list(zip(*out)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], [key, *[x.split()[0] for x in RESULT.split(", ")]])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"`{key}` {kind}, {RESULT}")


def redact(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    model = docs.sparkSession.sparkContext.broadcast(redactor(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, new = b.column("text").to_pylist(), []
            for text, spans in zip(texts, model.value.spans(texts)):
                parts, done = [], 0
                for x, k, y in spans:
                    if x >= done:
                        parts += [text[done:x], f"[{ALL_KINDS[k].removeprefix('x_').upper()}]"]
                    done = max(done, y)
                new.append("".join([*parts, text[done:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], [key, "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"`{key}` {kind}, text string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
