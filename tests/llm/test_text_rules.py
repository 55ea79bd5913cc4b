"""Quality rules, mixing, secrets, URLs: DuckDB and brute force, hard rows, empty tables."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality_rules, registry, secret_scan, url_filter

from .helpers import HARD, LONG, SCHEMA, brute_mix, brute_targets, frame, rows, words

TABLES = "documents pages benchmark labels".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = registry.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    res = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in res.fetchall())


# quality rules


def brute_repeat(t):
    w = words(t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_counts(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(n)) for n in (0, 7, 8, 9, 16, 40, 200)] + [LONG, "x y\nx y\n\n \nx y", "# $$ %"]
    data = rows(texts) + HARD
    got = quality_rules.judge(frame(spark, data, extra=False)).collect()
    assert len(got) == len(data)
    by = {}
    for d, t, *_ in data:
        by.setdefault(d, []).append(t)
    for r in got:
        want = []
        for t in by[r.doc_id]:
            lines = [x for x in (t or "").split("\n") if words(x)]
            want.append((len(words(t)), sum(map(len, words(t))), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeat(t)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in want
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_bad_host_goes_with_its_good_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    data = rows([good] * 3 + ["bad"] * 60, "farm") + rows([good + f" {i}" for i in range(60)], "fine", 100) + rows([good], None, 500)
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, data)).collect()}
    assert not got[0].kept and got[100].kept and got[500].kept
    kept = quality_rules.keep_good(frame(spark, data))
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept} and kept.columns == frame(spark, data).columns


# mixing


def test_mix_follows_targets(spark):
    rnd = random.Random(1)
    data = []
    for i, (s, n) in enumerate([("a", 300), ("b", 20), ("Z", 40), (None, 30), ("é", 5), ("c", 80)]):
        data += rows([" ".join("w" * rnd.randint(0, 60)) for _ in range(n)], s, 1000 * i)
    sized = mixing.sizes(frame(spark, data), "source")
    got = mixing.mix(sized).collect()
    assert len(got) == len(data)
    sizes = {}
    for d, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((k for k in sizes if k is not None)) + [None]
    want = brute_targets(sizes, {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(sized).collect()))
    assert {r.doc_id: r.taken for r in got} == brute_mix([(d, t, s) for d, t, _, s, _ in data])


def test_sainte_lague_gives_the_highest_quotients(spark):
    rnd = random.Random(5)
    for _ in range(4):
        n, seats = rnd.randint(1, 30), rnd.randint(0, 200)
        votes = [float(rnd.randint(0, 1000)) for _ in range(n)]
        votes[0] = 5000.0
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "k int, v double, seats long")
        got = {r.k: r.quota for r in mixing.sainte_lague(df, [], "k", "v", "seats").collect()}
        won = [0] * n
        for _ in range(seats):
            k = max(range(n), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[k] += 1
        assert got == dict(enumerate(won))


def test_mix_of_hard_rows(spark):
    data = [(100 + i if d in (None, 5) else d, *x) for i, (d, *x) in enumerate(HARD)]
    got = mixing.mix(mixing.sizes(frame(spark, data), "source")).collect()
    assert {r.doc_id: r.taken for r in got} == brute_mix([(d, t, s) for d, t, _, s, _ in data])
    got = mixing.mix(mixing.sizes(frame(spark, HARD), "source")).collect()
    assert len(got) == len(HARD) and all(r.taken <= 2 * r.size for r in got)


# secrets

BASE = {
    "assign": (re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def brute_secrets(t):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(t or "") if len(m[g]) >= n]
    return [s for _, _, s in sorted(found)]


def secret_texts():
    rnd = random.Random(7)
    parts = ["token=", "password : ", 'Secret":"', "api_key = '", "apikey=", "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeef", "0123456789ab", "é", "😀", "\n", " ", "=", "token=secret: abcdefghijklmnop", "xyz", "TOKEN=Ab/+_.-=xyz123"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(300)]


def test_secrets_equal_brute_force(spark):
    data = rows(secret_texts()) + [(d + 10_000 if d is not None else None, *x) for d, *x in HARD]
    docs = frame(spark, data)
    got = secret_scan.digest_columns(secret_scan.scan(docs)[0]).collect()
    assert len(got) == len(data)
    by = {}
    for d, t, *_ in data:
        by[d] = brute_secrets(t)
    for r in got:
        assert r.spans.split(",") == (by[r.doc_id] or [""])
        assert r.base_sha256 == hashlib.sha256(",".join(by[r.doc_id]).encode()).hexdigest()
        assert r.n_hex == sum(s.startswith("hex") for s in by[r.doc_id])


def test_ledger_scans_only_unseen_blobs(spark):
    a, b = frame(spark, rows(["token=abcdefghijkl", "clean"])), frame(spark, rows(["token=abcdefghijkl", "deadbeefdeadbeef", "clean"], start=10))
    _, ledger = secret_scan.scan(a)
    ledger = spark.createDataFrame(ledger.collect(), ledger.schema)
    assert ledger.count() == 2
    # what the ledger says is believed: a changed finding shows that the blob was not scanned again
    marked = ledger.withColumn("spans", F.when(F.col("spans").isNotNull(), F.expr("array(named_struct('start', 1L, 'kind', 0, 'stop', 2L))")).cast(secret_scan.SPANS))
    paths, after = secret_scan.scan(b, marked)
    got = {r.doc_id: r.spans for r in secret_scan.digest_columns(paths).collect()}
    assert got == {10: "assign:1:2", 11: "hex:0:16", 12: ""} and after.count() == 3
    stale = marked.withColumn("rule_version", F.lit("1"))
    assert {r.doc_id: r.spans for r in secret_scan.digest_columns(secret_scan.scan(b, stale)[0]).collect()}[10] == "assign:0:18"


def test_ledger_in_a_folder(spark, tmp_path):
    """Runs append what is new; what an earlier run has entered is not scanned again, whatever paths hold it."""
    path = str(tmp_path / "ledger")
    a, b = frame(spark, rows(["token=abcdefghijkl", "clean"])), frame(spark, rows(["token=abcdefghijkl", "deadbeefdeadbeef", "clean", None], start=10))
    secret_scan.update(secret_scan.address(a), path)
    assert secret_scan.read_ledger(spark, path).count() == 2
    for _ in range(2):
        secret_scan.update(secret_scan.address(b), path)
    ledger = secret_scan.read_ledger(spark, path)
    assert ledger.count() == 4 and ledger.select("blob").distinct().count() == 4
    assert ledger.where("blob = unhex(sha2('clean', 256)) AND spans IS NULL").count() == 1
    found = secret_scan.digest_columns(secret_scan.findings(secret_scan.address(b), path))
    assert {r.doc_id: r.spans for r in found.collect()} == {10: "assign:0:18", 11: "hex:0:16", 12: "", 13: ""}
    # what the ledger says is believed: an entry of another finding shows that the redaction did not scan the blob again
    marked = str(tmp_path / "marked")
    ledger.withColumn("spans", F.when(F.col("spans").isNotNull(), F.expr("array(named_struct('start', 0L, 'kind', 0, 'stop', 2L))")).cast(secret_scan.SPANS)).write.parquet(marked)
    assert {r.doc_id: r.text for r in secret_scan.redact(b, marked).collect()} == {10: "[SECRET]ken=abcdefghijkl", 11: "[SECRET]adbeefdeadbeef", 12: "clean", 13: None}


def test_hints_never_miss(spark):
    texts = [*secret_texts(), "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3", "ghp_" + "a" * 36, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----"]
    docs = frame(spark, rows(texts))
    found = {r.blob for r in secret_scan.scan_blobs(docs.select(secret_scan.blob_id(F.col("text")).alias("blob"), "text")).collect()}
    likely = {r.blob for r in docs.where(secret_scan.likely(F.col("text"))).select(secret_scan.blob_id(F.col("text")).alias("blob")).collect()}
    assert len(found) > 4 and found <= likely


def test_redaction(spark):
    docs = frame(spark, rows(["é token=abcdefghijkl end", "clean", None, "token=deadbeefdeadbeef deadbeefdeadbeef"]), extra=True)
    got = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert [got[i].text for i in range(4)] == ["é [SECRET] end", "clean", None, "[SECRET] [SECRET]"]
    assert got[0].n_chars == len(got[0].text) and got[1].n_chars == 5 and got[0].spans == "clash"


# URLs


def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_urls(spark):
    urls = [None, "", "no scheme", "://", "http://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "https://x.example.net/de/8", "https://example.net/de/7", "http://notexample.com/en/7", "ftp://org/es/1", "http://x.org?/es/", "http://x.org/a://b", "http://é.com/ü\n/x", "http://" + "a" * 5000 + ".com/en/", "data://x/" + "Zz9%é" * 20_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, html string").withColumn("score", F.lit("clash"))
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) * 2
    for r in got:
        assert (r.host, r.path) == brute_url(urls[r.page_id % len(urls)])
        fits = [(len(h + p), h + p, k) for k, h, p in url_filter.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, r.verdict)) and r.verdict in ("allow", "block")


def test_url_ratios_equal_brute_force(spark):
    """Each symbol is blended from the longest context that was seen, whatever comes before it."""
    rnd = random.Random(4)
    strings = [["^" * url_filter.ORDER + "".join(rnd.choice("abc/") for _ in range(rnd.randint(0, 12))) + "$" for _ in range(30)] for _ in "10"]
    cut = [[s[i : i + url_filter.ORDER + 1] for s in c for i in range(len(s) - url_filter.ORDER)] for c in strings]

    def p(k, seq):
        out = 1 / url_filter.A
        for o in range(url_filter.ORDER + 1):
            ends = [q[-o - 1 :] for q in cut[k]]
            same = [e for e in ends if e[:o] == seq[-o - 1 : -1][:o]] if o else ends
            if same:
                out = (same.count(seq[-o - 1 :]) + len(set(same)) * out) / (len(same) + len(set(same)))
        return out

    every = sorted(set(cut[0]) | set(cut[1]) | {"zzzzz", "abcd$"})
    counts = spark.createDataFrame([(q, cut[0].count(q), cut[1].count(q)) for q in every], "seq string, n1 long, n0 long")
    got = {r.seq: r.ratio for r in url_filter.train(counts.where("n1 + n0 > 0"), counts).collect()}
    for q in every:
        assert abs(got[q] / url_filter.PARTS - math.log(p(0, q) / p(1, q))) < 1e-5, q


def test_url_model_tells_the_classes_apart(spark):
    rnd = random.Random(2)
    word = lambda cs: "".join(rnd.choice(cs) for _ in range(8))
    urls = [f"http://{word('abc')}.net/de/{word('abc')}" for _ in range(300)] + [f"http://{word('xyz')}.org/es/{word('xyz')}" for _ in range(300)]
    new = [f"http://{word('abc')}.info/q/{word('abc')}" for _ in range(50)] + [f"http://{word('xyz')}.info/q/{word('xyz')}" for _ in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert sum(got[i] == "allow" for i in range(600, 650)) >= 48 and sum(got[i] == "block" for i in range(650, 700)) >= 45


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(docs).count() == 0 and quality_rules.keep_good(docs).count() == 0
    assert mixing.mix(mixing.sizes(docs)).count() == 0
    assert secret_scan.scan(docs)[0].count() == 0 and secret_scan.redact(docs).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
