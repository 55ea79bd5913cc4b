"""Chunkers: fixed windows, packed sentences, table rows; speaker turns and question-answer pairs.

Sizes count tokens of an injected tokenizer; here, white-space words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Size and overlap per source and kind; shortest chunk; rows that tables repeat.
SIZES = {
    ("sec", "narrative"): (420, 60, 480, 60), ("sec", "table"): (320, 3, 320, 3), ("news", "narrative"): (380, 40, 420, 40),
    ("transcript", "narrative"): (420, 60, 420, 60), ("transcript", "qa"): (520, 80, 560, 80),
}
DEFAULT_SIZE = (512, 64, 512, 64)
MIN_CHARS, ROW_OVERLAP = 50, 3
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'])")


def windows(docs: DataFrame, key: str, text: Column, size: int, overlap: int) -> DataFrame:
    """(key, chunk_index, text, n_tokens): windows of size words, each starting size - overlap after the last; JVM only."""
    step = max(1, size - overlap)
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    def sliced(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / step), F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * step + 1, F.lit(size)))
        return F.when(F.size(w) > 0, F.transform(parts, lambda x: F.struct(F.array_join(x, " ").alias("text"), F.size(x).alias("n_tokens"))))

    # the windows are made before they are exploded, so that each row has its own words only
    rows = docs.select(key, F.posexplode(F.element_at(F.transform(F.array(w), sliced), 1)).alias("chunk_index", "x"))
    return rows.select(key, "chunk_index", "x.text", "x.n_tokens")


def trimmed_windows(words: list[str], size: int, overlap: int) -> list[str]:
    """Windows cut back to a sentence's end, except the last, and started at a sentence, except the first."""
    step, out, start = max(1, size - overlap), [], 0
    while start < len(words):
        stop = min(start + size, len(words))
        text = " ".join(words[start:stop])
        if stop < len(words):
            ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", text)]
            text = text[: ends[-1]] if ends else text
        if start:
            m = SENTENCE.search(text)
            text = text[m.end() :] if m and m.end() < len(text) else text
        if len(text) >= MIN_CHARS:
            out.append(text.strip())
        if stop == len(words):
            break
        start += step
    return out


def packed_sentences(text: str, size: int, overlap: int, fallback: tuple[int, int] | None = None, least: int = MIN_CHARS) -> list[tuple[str, int]]:
    """(chunk, tokens): sentences packed up to size tokens; the next chunk repeats the last sentences up to overlap tokens.

    A text that fits is one chunk; one sentence, or one longer than size, falls back to windows.
    """
    text = (text or "").strip()
    words = text.split()
    if len(text) < least or not words:
        return []
    if len(words) <= size:
        return [(" ".join(words), len(words))]
    units = [u for u in SENTENCE.split(text) if u.strip()]
    lengths = [len(u.split()) for u in units]
    if len(units) <= 1 or max(lengths) > size:
        return [(c, len(c.split())) for c in trimmed_windows(words, *(fallback or (size, overlap)))]
    out, start = [], 0
    while True:
        stop, total = start, 0
        while stop < len(units) and (stop == start or total + lengths[stop] <= size):
            total += lengths[stop]
            stop += 1
        chunk = " ".join(units[start:stop])
        if len(chunk) >= least:
            out.append((chunk, total))
        if stop == len(units):
            return out
        back, repeated = stop, 0
        while back > start and repeated < overlap:
            back -= 1
            repeated += lengths[back]
        start = back if back > start else stop


def packed_rows(table: str, size: int, repeat: int = ROW_OVERLAP) -> list[tuple[str, int]]:
    """(chunk, tokens): table rows packed under size with title and header before each chunk; the last rows of a chunk open the next."""
    lines = (table or "").strip().split("\n")
    head = [x for x in lines if x.startswith(("[TABLE]", "[HEADER]"))]
    rows = [x for x in lines if x.startswith("[ROW]")]
    count = lambda xs: sum(len(x.split()) for x in xs)
    out, start = [], 0
    while start < len(rows):
        stop = start + 1
        while stop < len(rows) and count([*head, *rows[start : stop + 1]]) <= size:
            stop += 1
        part = [*head, *rows[start:stop]]
        out.append(("\n".join(part), count(part)))
        if stop == len(rows):
            break
        start = max(stop - repeat, start + 1)
    return out


def chunks(segments: DataFrame, key: str, source: str) -> DataFrame:
    """(key, idx, chunk_index, section, kind, text, n_tokens) of segments (key, idx, section, kind, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (section, kind, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("section", "kind", "text")))):
                size, overlap, *wide = SIZES.get((source, kind), DEFAULT_SIZE)
                made = packed_rows(text or "", size, overlap) if kind == "table" else packed_sentences(text or "", size, overlap, tuple(wide))
                at += [i] * len(made)
                out += [(n, section, kind, t, c) for n, (t, c) in enumerate(made)]
            n, section, kind, text, count = zip(*out) if out else ((),) * 5
            ids = b.select([key, "idx"]).take(pa.array(at, pa.int32()))  # as they came: no number passes through another type
            columns = [ids.column(0), ids.column(1), pa.array(n, pa.int32()), *(pa.array(x, pa.string()) for x in (section, kind, text)), pa.array(count, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [key, "idx", "chunk_index", "section", "kind", "text", "n_tokens"])

    rows = segments.select(key, F.col("idx").cast("int").alias("idx"), "section", "kind", "text")
    text, number = T.StringType(), T.IntegerType()
    made = [T.StructField(n, t) for n, t in (("chunk_index", number), ("section", text), ("kind", text), ("text", text), ("n_tokens", number))]
    return rows.mapInArrow(run, T.StructType([rows.schema[key], rows.schema["idx"], *made]))


def speaker_turns(paragraphs: DataFrame, key: str, order: str, speaker: Column, body: Column) -> DataFrame:
    """(key, turn, speaker, text): a paragraph with a speaker opens a turn, others continue it; before the first the speaker is Unknown."""
    w = W.partitionBy(key).orderBy(order)
    p = paragraphs.select(key, F.col(order).alias("_o"), speaker.alias("_s"), body.alias("_b"))
    w = W.partitionBy(key).orderBy("_o")
    p = p.withColumn("_t", F.sum(F.col("_s").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = p.groupBy(key, "_t").agg(F.max("_s").alias("speaker"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_b"))), lambda x: x["_b"]), "\n\n").alias("text"))
    return g.select(key, (F.row_number().over(W.partitionBy(key).orderBy("_t")) - 1).alias("turn"), F.coalesce("speaker", F.lit("Unknown")).alias("speaker"), "text")


def qa_pairs(turns: DataFrame, key: str) -> DataFrame:
    """(key, pair, speakers, text): turns two by two, an odd last one alone."""
    t = turns.withColumn("pair", F.floor(F.col("turn") / 2).cast("int"))
    said = F.struct("turn", F.concat(F.col("speaker"), F.lit(": "), F.col("text")).alias("line"), "speaker")
    g = t.groupBy(key, "pair").agg(F.sort_array(F.collect_list(said)).alias("s"))
    return g.select(key, "pair", F.array_join(F.transform("s", lambda x: x["speaker"]), ",").alias("speakers"), F.array_join(F.transform("s", lambda x: x["line"]), "\n\n").alias("text"))


def transcript_sections(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, prepared, qa, closing): cut at the first question marker, then at the first closing marker after it."""
    t = F.coalesce(text, F.lit(""))
    q = F.regexp_instr(t, F.lit(r"(?i)question[- ]and[- ]answer|q&a session|first question"))
    rest = F.when(q > 0, F.substr(t, q)).otherwise("")
    c = F.regexp_instr(rest, F.lit(r"(?i)this concludes|end of (?:the )?call|thank you for joining"))
    return docs.select(key, F.when(q > 0, F.substr(t, F.lit(1), q - 1)).otherwise(t).alias("prepared"), F.when(c > 0, F.substr(rest, F.lit(1), c - 1)).otherwise(rest).alias("qa"), F.when(c > 0, F.substr(rest, c)).otherwise("").alias("closing"))


def body_of_filing(text: Column) -> Column:
    """A filing without its cover page and signatures: from the first item heading if that stands in the first third, up to the signatures if they stand in the last third."""
    n = F.length(text)
    start = F.regexp_instr(text, F.lit(r"(?im)^\s*item\s+1[.:\s]"))
    begin = F.when((start > 0) & (start * 3 <= n), start).otherwise(1)
    stop = F.regexp_instr(text, F.lit(r"(?m)^\s*SIGNATURES?\s*$"))
    end = F.when((stop > 0) & (stop * 3 >= 2 * n), stop - 1).otherwise(n)
    return F.substr(text, begin, end - begin + 1)


def embedded(docs: DataFrame, key: str, dim: int = 64, embed=None, text: str = "text") -> DataFrame:
    """(key, embedding): unit vectors of texts, by embed(list of texts) or else a hashed bag of words; an empty text counts as a blank.

    embed is called once per batch and may keep a model per worker.
    """
    import zlib

    kind = docs.schema[key].dataType.simpleString()

    def bag(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall(r"[a-z0-9]+", t.lower()) or [" "]:
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x80000000 else -1.0
            length = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / length for x in v])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = (embed or bag)([t or " " for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def table_rows(segments: DataFrame, key: str) -> DataFrame:
    """(key, idx, child_index, text): of each table among segments (key, idx, text) one text for each row with figures.

    It has the table's title, its header and the rows of labels and years before the row, then the row. Rows that repeat are
    given once; what is no whole table gives none.
    """
    whole = F.col("text").startswith("[TABLE]") & F.col("text").endswith("[/TABLE]")
    lines = segments.where(whole).select(key, "idx", F.posexplode(F.split("text", "\n")).alias("n", "raw")).where("raw <> '[/TABLE]'")
    lines = lines.withColumn("line", F.regexp_replace("raw", r"^\[(?:TABLE|HEADER|ROW)\] ?", ""))
    years = F.forall(F.split("line", r" \| "), lambda c: c.rlike(r"^(?:FY\s?)?(?:19|20)\d{2}$"))
    label = ~F.col("raw").startswith("[ROW]") | years | ~F.col("line").rlike(r"\d")
    w = W.partitionBy(key, "idx").orderBy("n")
    lines = lines.withColumn("label", label).withColumn("context", F.array_join(F.collect_list(F.when(F.col("label"), F.col("line"))).over(w.rowsBetween(W.unboundedPreceding, -1)), "\n"))
    rows = lines.where("NOT label").groupBy(key, "idx", F.concat_ws("\n", "context", "line").alias("text")).agg(F.min("n").alias("n"))
    return rows.select(key, "idx", (F.row_number().over(w) - 1).alias("child_index"), "text")
