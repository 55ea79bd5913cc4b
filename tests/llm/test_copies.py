"""Jaccard join, repeated passages, decontamination, WARC: against brute force."""

import base64
import hashlib
import random
import gzip
import shutil
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, jaccard_join, substring_dedup, warc_archive

from .helpers import HARD, SCHEMA, frame, rows, shingles, words


def brute_links(data):
    n = len(data)
    sets = [shingles(t) for _, t, *_ in data]
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in link[i]:
                root[i] = min(root[i], root[j])
    return [len(x) for x in link], [data[r][0] for r in root]


def near_copies(seed=1, groups=8, size=12, length=120):
    rnd = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"t{rnd.randint(0, 400)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(length)] = f"e{rnd.randint(0, 10**6)}"
            texts.append(" ".join(w))
        texts += [texts[-1]] * 3
    return texts


def check_join(spark, data):
    got = {}
    for r in jaccard_join.classes(frame(spark, data)).collect():
        got.setdefault(r.doc_id, []).append((r.n_links, r.class_id))
    links, roots = brute_links(data)
    want = {}
    for (d, *_), n, c in zip(data, links, roots):
        want.setdefault(d, []).append((n, c))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_join_equals_brute_force(spark):
    check_join(spark, rows(near_copies()))


def test_join_of_hard_rows(spark):
    data = [(99 if d is None else d, *x) for d, *x in HARD] + rows(["a b c", "a b c", "a b c d", "a b c d e f"], start=200)
    check_join(spark, data)
    got = jaccard_join.classes(frame(spark, HARD)).where("doc_id IS NULL").collect()
    assert len(got) == 1 and got[0].n_links == 0


def test_join_in_blocks(spark, monkeypatch):
    """Groups larger than a block are dealt as pairs of blocks and lose nothing."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    check_join(spark, rows(near_copies(seed=2, groups=3, size=20)))


def test_keep_one(spark):
    data = rows(near_copies(seed=3)) + [(900, "lone text of six words here", "en", "s", 1)] * 2
    docs = frame(spark, data, extra=True)
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_links(data)[1]))


def test_keep_one_keeps_columns_of_any_name(spark):
    data = rows(["one two three four five six", "one two three four five six", "another text of some words here"])
    named = {"_n": 7, "_pid": 99, "_cls": "c", "_own": "o", "doc": "d", "k": 1, "root": "r", "a.b": 2}
    docs = frame(spark, data).withColumns({c: F.lit(v) for c, v in named.items()})
    got = jaccard_join.keep_one(docs).collect()
    assert sorted(r.doc_id for r in got) == [0, 2]
    assert all(r[c] == v for r in got for c, v in named.items())


def test_runs_in_threads_drop_only_their_own(spark):
    paths = {}

    def run(name):
        point = common.mark()
        paths[name] = [common.new_path(spark, name) for _ in range(2)]
        for p in paths[name]:
            spark.range(1).write.parquet(p)
        barrier.wait()
        if name == "first":
            common.drop_since(spark, point, paths[name][1])

    barrier = threading.Barrier(2)
    threads = [threading.Thread(target=run, args=(n,)) for n in ("first", "second")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [spark.read.parquet(p).count() for p in (paths["first"][1], *paths["second"])] == [1, 1, 1]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths["first"][0])


def test_keep_one_with_null_and_repeated_ids(spark, monkeypatch):
    """Different texts without an id, or under one id, are different documents; equal and near ones are not."""
    near = near_copies(seed=6, groups=1, size=12)
    data = [(None, f"text {i} without an id of its own", "en", "s", 1) for i in "abc"] * 2 + [(None, t, "en", "s", 1) for t in near]
    data += [(7, "one text of some words here", "en", "s", 1), (7, "quite another text under that id", "en", "s", 1), (None, None, "en", "s", 1), (None, " ", "en", "s", 2), (None, None, "en", "s", 1), (8, "", "en", "s", 0), (8, "", "en", "s", 0)]
    n = len(set(brute_links([(i, t) for i, t in enumerate(near)])[1]))
    want = sorted(map(repr, set((d, t) for d, t, *_ in data if t not in near) | {(None, None)})) + ["(None, None)"]
    for block in (jaccard_join.BLOCK, 5):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = [(r.doc_id, r.text) for r in jaccard_join.keep_one(frame(spark, data)).collect()]
        assert sorted(repr(x) for x in got if x[1] not in near) == sorted(want)
        assert sum(x[1] in near for x in got) == n
    assert {r.class_id for r in jaccard_join.classes(frame(spark, data)).where("doc_id IS NULL").collect()} == {None}


def test_posterior_prunes_only_what_cannot_reach(spark):
    for n, s in jaccard_join.LEAST.items():
        p = lambda k: sum(jaccard_join.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert p(s) >= jaccard_join.TOLERANCE > p(s - 1)


def test_common_counts():
    rnd = np.random.RandomState(0)
    sets = [np.unique(rnd.randint(0, 5000, n).astype(np.uint64)) for n in (3000, 2500, 10, 1)]
    got = jaccard_join.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(i))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# repeated passages


def brute_removed(data, n=50):
    first = {}
    for d, t, *_ in data:
        w = words(t)
        k = 2**63 - 1 if d is None else d
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            first[x] = min(first.get(x, k), k)
    out = []
    for d, t, *_ in data:
        w = words(t)
        k = 2**63 - 1 if d is None else d
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < k for j in range(i, i + n)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def passages(seed=1):
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randint(0, 3000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 120, 300)]
    texts = []
    for _ in range(40):
        w = [word() for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 2)):
            w += rnd.choice(shared) + [word() for _ in range(rnd.randint(0, 30))]
        texts.append("  ".join(w) if rnd.random() < 0.5 else "\n".join(w))
    texts += [texts[5], texts[5], " ".join(["same"] * 200), " ".join(["same"] * 120)]
    rnd.shuffle(texts)
    return texts


def check_removed(spark, data):
    docs = substring_dedup.digests(frame(spark, data))
    assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, brute_removed(data)))


@pytest.mark.parametrize("hot", [16_384, 60, 1])
def test_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    check_removed(spark, rows(passages()))


def test_one_passage_in_very_many_contexts(spark, monkeypatch):
    """Orders end with one string for the passage, and what is cut stays strings of many windows."""
    monkeypatch.setattr(substring_dedup, "HOT", 400)
    cuts = []
    staged = substring_dedup.staged
    monkeypatch.setattr(substring_dedup, "staged", lambda df, name, *a: (lambda out: (cuts.append((name, out.count(), out.agg(F.sum("n")).first()[0])) if name.startswith("cut") else None, out)[1])(staged(df, name, *a)))
    rnd = random.Random(6)
    word = lambda: f"v{rnd.randint(0, 100_000)}"
    passage = [word() for _ in range(50)]
    check_removed(spark, rows([" ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(rnd.choice((0, 60))))]) for _ in range(150)] + [" ".join(passage)] * 3))
    assert len(cuts) >= 3 and [name for name, *_ in cuts] == [f"cut-{k}" for k in range(1, len(cuts) + 1)]
    assert all(b[2] <= 0.8 * a[2] for a, b in zip(cuts, cuts[1:]))  # windows that no other document has end in each order
    assert all(strings < 6 * 150 for _, strings, _ in cuts)


def test_passages_of_hard_rows(spark):
    check_removed(spark, HARD + [(None, HARD[4][1], "en", "s", 1), (3, HARD[4][1], "en", "s", 1)])


def test_runs_of_one_word_stay_small():
    """Many windows with one minimiser travel in strings of at most RUN windows, and every window is in one of them."""
    h = substring_dedup.word_hashes(["a"] * 5000 + ["b"] * 60, substring_dedup.WordHashes())
    _, at, n = substring_dedup.super_kmers(h)
    assert n.max() <= substring_dedup.RUN and n.sum() == len(h) - 49 and (at[1:] == at[:-1] + n[:-1]).all()


def test_windows_are_told_apart_by_their_words(monkeypatch):
    """Sorting by lying hashes falls back on the words."""
    rnd = random.Random(3)
    strings = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(50, 70))) for _ in range(30)] + [" ".join("a" * 60)] * 2
    low = [rnd.randint(0, 9) for _ in strings]
    first = {}
    cut = [[tuple(s.split()[i : i + 50]) for i in range(len(s.split()) - 49)] for s in strings]
    for ws, k in zip(cut, low):
        for w in ws:
            first[w] = min(first.get(w, k), k)
    want = [[first[w] for w in ws] for ws in cut]
    assert [x.tolist() for x in substring_dedup.sorted_windows(strings, low)] == want
    monkeypatch.setattr(substring_dedup, "scramble", lambda h: h & np.uint64(1))
    assert [x.tolist() for x in substring_dedup.sorted_windows(strings, low)] == want


def test_copies_without_ids_stay(spark):
    base = " ".join(f"u{i}" for i in range(60))
    data = [(None, base, "en", "s", 1)] * 3 + [(4, base, "en", "s", 1)]
    check_removed(spark, data)
    check_removed(spark, data[:3])


def test_rewritten_texts(spark):
    base = " ".join(f"u{i}" for i in range(60))
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame(spark, rows([base, "before " + base + " after", "  two  blanks "]), extra=True)).collect()}
    assert got == {0: base, 1: "before after", 2: "  two  blanks "}


# decontamination


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: f"k{rnd.randint(0, 2000)}"
    items = [" ".join(word() for _ in range(n)) for n in (1, 4, 5, 9, 15, 20, 21, 36, 70, 140, 300)] + ["", None]
    texts = []
    for i, item in enumerate(items[:-2] * 3):
        w = item.split()
        if i % 3 == 1 and len(w) > 30:
            w[len(w) // 2] = "changed"
        texts.append(" ".join([word() for _ in range(rnd.randint(0, 3000))] + w + [word() for _ in range(rnd.randint(0, 200))]))
    texts += [items[0], items[1], " ".join(word() for _ in range(500))]
    data = rows(texts) + [(d + 1000 if d is not None else None, *x) for d, *x in HARD]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = set()
    for d, t, *_ in data:
        s = shingles(t)
        want |= {(d, i, len(shingles(x) & s)) for i, x in enumerate(items) if shingles(x) and 5 * len(shingles(x) & s) >= 4 * len(shingles(x))}
    docs = frame(spark, data, extra=True)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in decontamination.contained_items(docs, bench).collect()} == want
    kept = decontamination.drop_contaminated(docs, bench)
    bad = {d for d, *_ in want}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, *_ in data if d not in bad) and kept.columns == docs.columns


def test_ids_of_any_type_stay_exact(spark):
    """Ids pass unchanged beside nulls, also those that are no numbers, and so do all columns of kept rows."""
    item = " ".join(f"i{j}" for j in range(20))
    docs = spark.createDataFrame([(2**60 + 1, item, None), (None, item, 2**60 + 3), (2**60 + 3, "clean words in this one", 2**60 + 5)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([("item/1", item), (None, item)], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, bench).collect()}
    assert got == {(d, i) for d in (2**60 + 1, None) for i in ("item/1", None)}
    assert [tuple(r) for r in decontamination.drop_contaminated(docs, bench).collect()] == [(2**60 + 3, "clean words in this one", 2**60 + 5)]


def test_recall_of_near_copies(spark):
    """Pairs at 0.8 to 0.85 are all linked: what bands and pruning miss is far below one in a thousand."""
    rnd = random.Random(8)
    texts = []
    for i in range(300):
        w = [f"p{i}x{j}" for j in range(104)]
        for c in range(rnd.choice((1, 2))):  # each change in the middle touches five of a hundred shingles: 95/105 and 90/110
            w[20 + 40 * c] = "changed"
        texts += [" ".join(f"p{i}x{j}" for j in range(104)), " ".join(w)]
    got = jaccard_join.classes(frame(spark, rows(texts))).groupBy("class_id").count().where("count = 2").count()
    assert got == 300


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 1000)
    items = [" ".join(f"i{k}w{j}" for j in range(20)) for k in range(10)]
    docs = frame(spark, rows(["x " + " ".join(items[:2]), "clean words only in this one", items[9]]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, bench).collect()} == {(0, 0), (0, 1), (2, 9)}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [1]


# WARC


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "é😀\n\n\r\n\r\n", "x" * 300_000, "<p>a</p>"]
    data = [(i, f"http://h/{i}", h) for i, h in enumerate(html * 2)] + [(None, None, "<p>a</p>"), (100, "http://x\r\ny", "lonely"), (0, "http://h/0", "<p>a</p>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    path = str(tmp_path / "w")
    warc_archive.write(pages, path)
    got = warc_archive.restore(spark, path).collect()
    assert sorted((str(r.page_id), bytes(r.payload)) for r in got) == sorted((str(i), (h or "").encode()) for i, _, h in data)
    assert all(r.header.startswith("WARC/1.1\r\n") and r.header.endswith("\r\n\r\n") for r in got)
    warc_archive.export(spark, path, path + "/files")
    warc_archive.import_files(spark, path + "/files", path + "/again")
    key = lambda r: (r.header, bytes(r.payload))
    assert sorted(map(key, warc_archive.restore(spark, path + "/again").collect())) == sorted(map(key, got))
    # a gzip member for each record, as most archives have, loses none
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w" / "files").glob("*.gz")))
    parts = [h.encode() + content + b"\r\n\r\n" for h, _, content in warc_archive.parse(whole)]
    (tmp_path / "each").mkdir()
    (tmp_path / "each" / "all.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    warc_archive.import_files(spark, str(tmp_path / "each"), path + "/each")
    assert sorted(map(key, warc_archive.restore(spark, path + "/each").collect())) == sorted(map(key, got))
    (tmp_path / "each" / "all.warc.gz").write_bytes(gzip.compress(parts[0])[:-9])
    with pytest.raises(Exception, match="cut short"):
        warc_archive.import_files(spark, str(tmp_path / "each"), path + "/short")
    (tmp_path / "each" / "all.warc.gz").write_bytes(gzip.compress(parts[0].replace(b"X-Payload-SHA256", b"X-Other")))
    with pytest.raises(Exception, match="does not say which payload"):
        warc_archive.import_files(spark, str(tmp_path / "each"), path + "/other")
    _, payloads = warc_archive.read(spark, path)
    assert payloads.count() == len({h or "" for _, _, h in data})
    smallest = {}
    for i, _, h in data:
        smallest[h or ""] = min(smallest.get(h or "", 10**9), 10**9 if i is None else i)
    ids = {(r.page_id, bytes(r.payload)): r.record_id for r in got}
    for r in got:
        first = smallest[bytes(r.payload).decode()]
        assert r.refers_record == (ids[first, bytes(r.payload)] if r.record_type == "revisit" else None)
        assert r.record_type == ("response" if r.page_id == first else "revisit")


def test_warc_reader_notices_damage(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [p for _, _, p in warc_archive.parse(good * 2)] == [b"hi", b"hi"]
    with pytest.raises(ValueError):
        list(warc_archive.parse(good.replace(b"hi", b"hihi")))
    path = str(tmp_path / "w")
    warc_archive.write(spark.createDataFrame([(1, "u", "hi")], "page_id long, url string, html string"), path)
    warc_archive.read(spark, path)[1].withColumn("payload", F.lit("ho").cast("binary")).write.parquet(path + "/other")
    shutil.rmtree(path + "/payloads")
    shutil.move(path + "/other", path + "/payloads")
    with pytest.raises(Exception, match="does not have the digest"):
        warc_archive.restore(spark, path).collect()


def test_warc_digests(spark):
    for payload in (b"", b"hi", bytes(range(256)) * 9):
        got = spark.createDataFrame([(payload,)], "p binary").select(warc_archive.base32_sha1(F.col("p")).alias("x")).first().x
        assert got == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.classes(docs).count() == 0 and jaccard_join.keep_one(docs).count() == 0
    assert substring_dedup.digests(docs).count() == 0 and substring_dedup.remove_repeats(docs).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(docs, none).count() == 0 and decontamination.drop_contaminated(docs, none).count() == 0
    warc_archive.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc_archive.restore(spark, str(tmp_path / "e")).count() == 0


def test_short_items_in_long_documents(spark):
    """Every item of one to twelve shingles that a long document holds is found, whole or but for a fifth."""
    rnd = random.Random(11)
    docs, items = [], []
    for i in range(3000):
        n = i % 12 + 1
        item = [f"q{i}x{j}" for j in range(n + 4)]
        items.append((i, " ".join(item)))
        held = item[: 4 + -(-4 * n // 5)] if i % 2 else item
        docs.append([f"f{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 90))] + held + [f"f{rnd.randint(0, 10**6)}" for _ in range(90)])
    texts = [" ".join(w) for w in docs]
    index = decontamination.ItemIndex([t for _, t in items])
    got = {(d, i) for d, i, _ in index.search(texts, decontamination.WordHashes())}
    assert got == {(i, i) for i in range(3000)}
