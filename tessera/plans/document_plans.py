"""Document, page and transcript queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking as K
from tessera.operators import pages as H
from tessera.operators import sections as S
from tessera.plans.registry import query
from tessera.sources.tables import table

_NUMBERS = r"len(regexp_extract_all(text, '\$\s*\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s*%|\d[\d,]*(?:\.\d+)?'))"
_WORDS = f"len(regexp_extract_all(text, '(?i)\\b(?:{X.DATA_WORDS.replace(chr(39), chr(39) * 2)})\\b'))"
_FEATURES = f"""f AS (SELECT doc_id, source, lang, {_NUMBERS} AS numbers, {_NUMBERS} + {_WORDS} + CASE WHEN contains(text, '[TABLE]') OR contains(text, '[ROW]') OR contains(text, '[HEADER]') THEN 8 ELSE 0 END AS signal, length(text) AS n FROM documents)"""


def features(spark, sf_dir):
    f = X.chunk_features(F.col("lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", *[c.alias(n) for n, c in f.items()])


@query("chunk_features", f"WITH {_FEATURES} SELECT doc_id, numbers::BIGINT AS numeric_token_count, round(numbers / greatest(n, 1), 6) AS number_density, signal::DOUBLE AS data_signal_score, signal >= 6 AS is_quantitative FROM f")
def chunk_features(spark, sf_dir):
    return features(spark, sf_dir).drop("source", "lang")


@query("quant_by_group", f"WITH {_FEATURES} SELECT source, lang, count(*) AS n, count(*) FILTER (signal >= 6) AS quantitative, round(avg(signal), 6) AS mean_signal FROM f GROUP BY source, lang")
def quant_by_group(spark, sf_dir):
    return features(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if("is_quantitative").alias("quantitative"), F.round(F.avg("data_signal_score"), 6).alias("mean_signal"))


@query("windowed_chunks", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 512) / 448.0), 0)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INTEGER AS chunk_index, md5(array_to_string(w[i * 448 + 1:i * 448 + 512], ' ')) AS digest, len(w[i * 448 + 1:i * 448 + 512])::INTEGER AS n_tokens FROM c""")
def windowed_chunks(spark, sf_dir):
    c = K.windows(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 512, 64)
    return c.select("doc_id", "chunk_index", F.md5("text").alias("digest"), "n_tokens")


def _narrative(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("idx"), F.col("lang").alias("section"), F.lit("narrative").alias("kind"), "text")


@query("sentence_pack_chunks")
def sentence_pack_chunks(spark, sf_dir):
    return K.chunks(_narrative(spark, sf_dir), "doc_id", "sec").select("doc_id", "chunk_index", "n_tokens", F.md5("text").alias("digest"))


@query("speaker_turns", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1)::INTEGER AS turn, coalesce(max(role), 'Unknown') AS speaker, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT *, sum((role <> 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT conv_id, turn, text, CASE WHEN role <> 'system' THEN role END AS role2, role FROM conversations)) GROUP BY conv_id, g".replace("max(role)", "max(role2)"))
def speaker_turns(spark, sf_dir):
    role = F.when(F.col("role") != "system", F.col("role"))
    return K.speaker_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", role, F.col("text"))


@query("qa_pairs", "WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations) SELECT conv_id, (turn // 2)::INTEGER AS pair, string_agg(role, ',' ORDER BY turn) AS speakers, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id, turn // 2")
def qa_pairs(spark, sf_dir):
    turns = K.speaker_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))
    return K.qa_pairs(turns, "conv_id")


_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_MAIN = "CASE WHEN contains(html, '<article') THEN regexp_extract(html, '(?s)<article.*?</article>') ELSE html END"


@query("html_title", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    t = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("title"))


@query("html_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


_TAGS = "html|body|div|section|article|main|header|footer|nav|aside|table|center|form|blockquote|ul|ol|dl|p|h1|h2|h3|h4|h5|h6|li|dt|dd|tr|td|th|caption|br|hr|pre|title|head"


def _plain(text: str) -> str:
    """Character references of a text in SQL, the ampersand's last, and white space as single blanks."""
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{value}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _bare(html: str) -> str:
    return f"regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<![^>]*>|<title[^>]*>.*?</title>', ' ', 'g')"


def _blocks(html: str) -> str:
    """Blocks of text of a page in SQL: every tag that shapes a page cuts, other tags vanish."""
    cut = f"regexp_replace({_bare(html)}, '(?i)</?({_TAGS})(\\s[^>]*)?/?>', chr(1), 'g')"
    return f"list_filter(list_transform(string_split(regexp_replace({cut}, '<[a-zA-Z/][^>]*>', '', 'g'), chr(1)), lambda x: {_plain('x')}), lambda x: x <> '')"


@query("html_text", f"SELECT page_id, {_plain(_TITLE)} AS title, len(b)::INTEGER AS n_blocks, array_to_string(b, chr(10)) AS text FROM (SELECT page_id, html, {_blocks('html')} AS b FROM pages)")
def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    told = H.contents(p, "page_id").groupBy("page_id").agg(F.count("*").cast("int").alias("n_blocks"), F.array_join(lines, "\n").alias("text"))
    title = H.squeezed(H.unescaped(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)))
    return p.select("page_id", title.alias("title")).join(told, "page_id", "left").select("page_id", "title", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("text", F.lit("")).alias("text"))


@query("page_main", f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS idx, text FROM (SELECT page_id, unnest(b) AS text, unnest(range(1, len(b) + 1)) AS i FROM (SELECT page_id, {_blocks(_MAIN)} AS b FROM pages))")
def page_main(spark, sf_dir):
    return H.main_blocks(table(spark, sf_dir, "pages"), "page_id")


@query("page_links", "SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def page_links(spark, sf_dir):
    return H.links(table(spark, sf_dir, "pages"), "page_id")


def _filings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html", F.lit("10-K").alias("form"))


def _lines(html: str) -> str:
    """A page's text in SQL: blocks on lines of their own, an empty one where two or more tags that begin a line lie between."""
    marked = f"regexp_replace({_bare(html)}, '(?i)<(p|div|tr|br|h1|h2|h3|h4|h5|li)(\\s[^>]*)?/?>', chr(2), 'g')"
    marked = f"regexp_replace(regexp_replace({marked}, '(?i)</?({_TAGS})(\\s[^>]*)?/?>', chr(1), 'g'), '<[a-zA-Z/][^>]*>', '', 'g')"
    wide = f"regexp_replace({marked}, '[\\x01\\s]*\\x02[\\x01\\s]*\\x02[\\x01\\x02\\s]*', chr(3), 'g')"
    line = f"replace(replace({_plain('x')}, chr(3), chr(10) || chr(10)), chr(1), chr(10))"
    pieces = f"list_transform(string_split(regexp_replace({wide}, '[\\x01\\x02\\s]*[\\x01\\x02][\\x01\\x02\\s]*', chr(1), 'g'), chr(1)), lambda x: {line})"
    return f"trim(array_to_string(list_filter({pieces}, lambda x: x <> ''), chr(10)), chr(10))"


# no page of the table has a heading on a line between empty ones, or an item: each is one section
@query("html_segments", f"SELECT page_id, 0::INTEGER AS idx, 'Full Document' AS section, 'narrative' AS kind, t AS text FROM (SELECT page_id, {_lines('html')} AS t FROM pages) WHERE length(t) >= 200")
def html_segments(spark, sf_dir):
    return S.filing_segments(_filings(spark, sf_dir), "page_id").select("page_id", "idx", "section", "kind", "text")


@query("page_chunks")
def page_chunks(spark, sf_dir):
    return K.chunks(S.filing_segments(_filings(spark, sf_dir), "page_id"), "page_id", "news")


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '/(20[0-9]{2})/', 1) AS year, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages")
def url_parts(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("://([^/?#]+)").alias("host"), part("://[^/?#]+([^?#]*)").alias("path"), part("/(20[0-9]{2})/").alias("year"), part("[?&]page=([^&#]*)").alias("page"))


_RANGE = "SELECT o_orderkey, o_orderkey % 30 + 2000 AS a, o_orderkey % 30 + 2000 + o_orderkey % 13 AS b FROM orders"


@query("year_mentions", f"SELECT o_orderkey, array_to_string(list_sort(list_distinct(CASE WHEN b - a <= 10 THEN range(a, b + 1) ELSE [a, b] END || [2000 + o_orderkey % 100])), ',') AS years FROM ({_RANGE})")
def year_mentions(spark, sf_dir):
    k = F.col("o_orderkey")
    short = F.lpad((k % 100).cast("string"), 2, "0")
    rows = _year_range(table(spark, sf_dir, "orders")).withColumn("question", F.concat(F.lit("Sales from FY"), "a", F.lit(" to "), "b", F.lit("? See FY"), short, F.lit(" and 0001-20190101.")))
    return rows.select("o_orderkey", F.array_join(X.years_mentioned(F.col("question")), ",").alias("years"))


def _year_range(orders):
    return orders.selectExpr("o_orderkey", "cast(o_orderkey % 30 + 2000 AS string) AS a", "cast(o_orderkey % 30 + 2000 + o_orderkey % 13 AS string) AS b")


_SPLIT = "string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("company_mentions", f"""WITH a AS (SELECT DISTINCT item_id, alias FROM (SELECT item_id, unnest({_SPLIT}) AS alias FROM benchmark) WHERE length(alias) >= 7),
u AS (SELECT alias, min(item_id) AS item_id FROM a GROUP BY alias HAVING count(*) = 1), t AS (SELECT DISTINCT doc_id, unnest({_SPLIT}) AS alias FROM documents)
SELECT doc_id, item_id, alias FROM t JOIN u USING (alias)""")
def company_mentions(spark, sf_dir):
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))
    # the long words of an item stand for a company's aliases; one that two companies claim is dropped
    a = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("alias")).where(F.length("alias") >= 7)
    u = a.groupBy("alias").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("alias"))
    return t.join(u, "alias").select("doc_id", "item_id", "alias")


# names of two words, the first of five letters or more, without legal words: whole, compact and the first word
_NAME = "trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'))"


@query("company_aliases", f"SELECT c_custkey, unnest(list_distinct([{_NAME}, replace({_NAME}, ' ', ''), string_split({_NAME}, ' ')[1]])) AS alias FROM customer")
def company_aliases(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(X.company_aliases(F.col("c_name"))).alias("alias"))


@query("excerpts", "SELECT doc_id, CASE WHEN length(text) <= 260 THEN text ELSE substr(text, 1, 128) || '…' || right(text, 128) END AS short, CASE WHEN length(text) > 120 THEN rtrim(substr(text, 1, 120)) || ' …' ELSE text END AS block FROM documents")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shortened(F.col("text")).alias("short"), X.excerpt(F.col("text"), 120).alias("block"))


@query("batch_embed")
def batch_embed(spark, sf_dir):
    return K.embedded(table(spark, sf_dir, "documents"), "doc_id")
