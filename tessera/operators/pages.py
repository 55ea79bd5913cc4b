"""HTML pages as rows: tokens with their place in the tree of containers, blocks of text, tables with titles, links.

A page is exploded into its tokens. What a tree would hold is worked out by windows over a page's tokens in order: the
number of open containers (closings without an opening are left out), the open table, row and cell, the block of text. A
page is the unit of these windows; pages are dealt out by their key once, and all that follows groups by more than the key.

Containers are tags that are always closed; paragraphs, rows, cells and list items end where the next begins, so pages
that leave them open read as browsers read them. Text of nested tables belongs to the rows of the outer one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Elements without visible text, among them those of inline reports, and the tags that shape a page.
UNSEEN = "script style noscript iframe ix:header ix:hidden ix:resources xbrli:xbrl xbrl:context link:linkbase".split()
CONTAINERS = "html body div section article main header footer nav aside table center form blockquote ul ol dl".split()
BLOCKS = [*CONTAINERS, *"p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption br hr pre title head".split()]
#: Tags that begin a line of their own.
BREAKS = "p div tr br h1 h2 h3 h4 h5 li".split()
PROFILES = ("baseline", "candidate")
MAX_TITLE = 160
NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "sect": "§", "para": "¶", "deg": "°", "euro": "€", "pound": "£",
    "yen": "¥", "cent": "¢", "frac12": "½", "frac14": "¼", "frac34": "¾", "times": "×", "dagger": "†", "amp": "&",
}
# Names of financial statements, and cells that name periods, years and units.
STATEMENT = (
    r"(?i)\b(?:(?:unaudited|condensed|combined)\s+)*(?:consolidated\s+)?(?:statements?\s+of\s+(?:operations|income(?:\s+and\s+comprehensive\s+income)?|"
    r"earnings|comprehensive\s+income|cash\s+flows?|financial\s+position|changes\s+in\s+(?:shareholders['’]?|stockholders['’]?)\s+equity|"
    r"(?:shareholders['’]?|stockholders['’]?)\s+equity)|balance\s+sheets?|selected\s+financial\s+data)\b"
)
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"
PERIOD = (
    rf"(?i)^(?:for\s+the\s+)?(?:(?:(?:one|two|three|six|nine|twelve|\d+)\s+)?(?:years?|months?|quarters?)\s+ended(?:\s+|,\s*)?(?:{_MONTH})?\s*\d{{0,2}}|"
    rf"(?:as\s+of\s+)?(?:{_MONTH})\s+\d{{1,2}})[,\s]*$"
)
YEAR = r"(?i)^(?:FY\s*)?(?:19|20)\d{2}$"
UNIT = r"(?i)^\(?\s*in\s+(?:thousands|millions|billions)(?:,?\s+except\b.*)?\)?$"
ITEM_CELL = r"(?i)^(ITEM\s+\d+[A-Z]?(?:\.\d+)?)\.?$"
ITEM = r"(?i)^\s*(ITEM\s+(\d+[AB]?(?:\.\d+)?))(?:[\s.\-–—:]+(.{0,80}))?\s*$"

_TOKEN = r"""<!--[\s\S]*?(?:-->|\z)|<[/!?a-zA-Z][^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>|<[/!?a-zA-Z][^<>]*+>|[^<]++|<"""


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\xa0"), F.lit(" ")), r"\s+", " "))


def unescaped(text: Column) -> Column:
    """Character references in decimal and hexadecimal, and those of NAMED; others stay as they are."""
    code = lambda m: F.when(m.rlike("(?i)^&#x"), F.conv(F.regexp_extract(m, "(?i)x([0-9a-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(m, r"(\d+)", 1)).cast("long")
    letter = lambda m: F.when(code(m).between(1, 0xD7FF) | code(m).between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code(m)), 8, "0")), "UTF-32")).otherwise(m)
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)(&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});)")))
    out = F.aggregate(numbers, text, lambda t, m: F.replace(t, m, letter(m)))
    for name, value in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return F.when(text.contains("&"), out).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in double quotes, in single quotes or bare; '' if it is not there."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return squeezed(unescaped(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])))


def _balanced(df: DataFrame, name: str, tags: list[str], w) -> DataFrame:
    """A running number of open tags; a closing tag without an open one counts as nothing."""
    is_tag = F.col("tag").isin(*tags) & ~F.col("void")
    df = df.withColumn("_s", F.sum(F.when(is_tag & F.col("close"), -1).when(is_tag, 1).otherwise(0)).over(w))
    return df.withColumn(name, (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("int")).drop("_s")


def tokens(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, token, tag, close, level, tables, titles, block, breaks, row, cell, region, item, start) of each token of each page.

    tag is '' for text. level, tables and titles: open containers, tables and titles after the token; block, breaks, row and cell:
    their running numbers; region: the part of a table that the token is in ('td', 'th', 'caption' or ''); item: how many pieces of
    content, blocks outside tables and outermost tables, have begun; start: whether the token begins one.
    """
    unseen = rf"(?is)<({'|'.join(UNSEEN)})\b[^>]*>.*?(?:</\1\s*>|\z)"
    seen = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), unseen, " ")
    # the outer form is not preceded by a filter that reads each page again; its null token falls to the condition
    df = pages.select(key, F.posexplode_outer(F.regexp_extract_all(seen, F.lit(_TOKEN), F.lit(0))).alias("pos", "token")).where("NOT rlike(token, '^<[!?]')")
    df = df.withColumns({"tag": F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][^\s/>]*)", 1)), "close": F.col("token").startswith("</"), "void": F.col("token").rlike("^<[a-zA-Z][^>]*/>$")})
    w = W.partitionBy(key).orderBy("pos")
    for name, tags in (("level", CONTAINERS), ("tables", ["table"]), ("titles", ["title"])):
        df = _balanced(df, name, tags, w)
    opens = lambda *t: F.col("tag").isin(*t) & ~F.col("close")
    count = lambda c: F.sum(c.cast("int")).over(w).cast("int")
    part = F.when(opens("td", "th", "caption"), F.col("tag")).when(F.col("tag").isin("td", "th", "caption", "tr", "table"), "")
    df = df.withColumns({
        "block": count(F.col("tag").isin(*BLOCKS)), "breaks": count(opens(*BREAKS)), "row": count(opens("tr")), "cell": count(opens("td", "th")),
        "region": F.coalesce(F.last(part, ignorenulls=True).over(w), F.lit("")),
    })
    shown = (F.col("tag") == "") & (F.col("tables") == 0) & (F.col("titles") == 0) & F.col("token").rlike(r"[^\s\xA0]")
    before = F.max(F.when(shown, F.col("block"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    start = (shown & (F.coalesce(before, F.lit(-1)) != F.col("block"))) | (opens("table") & (F.col("tables") == 1))
    df = df.withColumn("start", start)
    return df.withColumn("item", count(F.col("start"))).drop("void")


def _joined(of: list[str], df: DataFrame, **more: Column) -> DataFrame:
    """The texts of groups in order, as one text."""
    return df.groupBy(*of).agg(_told(F.collect_list(_placed())).alias("text"), *[c.alias(n) for n, c in more.items()])


def _placed() -> Column:
    """A token of text with its place; null for a tag."""
    return F.when(F.col("tag") == "", F.struct("pos", "token"))


def _told(texts: Column) -> Column:
    """Tokens of text (an array of structs of pos and token) in order, as one text."""
    return squeezed(unescaped(F.array_join(F.transform(F.array_sort(texts), lambda x: x["token"]), "")))


def semantic_title(text: Column) -> Column:
    """The text if it is the name of a financial statement, with at most a company before and a remark in brackets after it; else null."""
    name = F.regexp_extract(text, STATEMENT, 0)
    at = F.regexp_instr(text, F.lit(STATEMENT))
    before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"^[\s\-–—:]+|[\s\-–—:]+$", "")
    after = F.trim(F.substring(text, at + F.length(name), F.length(text)))
    company = (before == "") | ((before == F.upper(before)) & (before != F.lower(before))) | before.rlike(r"(?i)\b(?:inc\.?|corp\.?|corporation|company|ltd\.?|plc|llc)\s*$")
    fits = (name != "") & (F.length(text) <= MAX_TITLE) & (F.size(F.split(text, " ")) <= 18) & company & after.rlike(r"^(?:\([^)]{1,60}\))?[\s\-–—:]*$")
    return F.when(fits, text)


def names_columns(values: Column) -> Column:
    """Whether a row of plain cells names periods, years or units rather than figures."""
    first = F.get(values, F.lit(0))
    year = lambda v: v.rlike(YEAR)
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    period = first.rlike(PERIOD) & F.forall(rest, year)
    years = F.forall(values, lambda v: year(v) | v.rlike(UNIT)) & (F.size(F.filter(values, year)) >= 2)
    return ((F.size(values) == 1) & first.rlike(UNIT)) | period | (~first.rlike(PERIOD) & years)


def serialised(rows: Column, title: Column, given: Column, infer: bool = True) -> Column:
    """[TABLE] title, [HEADER], [ROW] lines and [/TABLE] of rows (an array of structs of values and th); null without rows.

    given: whether the title says more than a number; then its cell is left out of the first two rows.
    """
    def without(r: Column, i: Column) -> Column:
        at = F.array_position(r["values"], title)
        earlier = (i == 1) & F.array_contains(F.get(rows, F.lit(0))["values"], title)
        left = F.filter(r["values"], lambda v, k: k + 1 != at)
        return F.struct(F.when(given & (i < 2) & (at > 0) & ~earlier, left).otherwise(r["values"]).alias("values"), r["th"].alias("th"))

    def lines(rs: Column) -> Column:
        marked = F.array_position(F.transform(rs, lambda r: r["th"]), True)
        plain = F.array_position(F.transform(rs, lambda r: names_columns(r["values"])), False)
        leading = F.when(plain > 0, plain - 1).otherwise(F.size(rs)) if infer else F.lit(0)
        heads = F.filter(rs, lambda r, k: F.when(marked > 0, k + 1 == marked).otherwise(k < leading))
        body = F.filter(rs, lambda r, k: F.when(marked > 0, k + 1 != marked).otherwise(k >= leading))
        head = F.when(F.size(heads) > 0, F.array(F.concat(F.lit("[HEADER] "), F.array_join(F.flatten(F.transform(heads, lambda r: r["values"])), " | ")))).otherwise(F.array().cast("array<string>"))
        told = F.concat(F.array(F.concat(F.lit("[TABLE] "), title)), head, F.transform(body, lambda r: F.concat(F.lit("[ROW] "), F.array_join(r["values"], " | "))), F.array(F.lit("[/TABLE]")))
        one = F.get(body, F.lit(0))["values"]
        label = F.regexp_extract(F.get(one, F.lit(0)), ITEM_CELL, 1)
        heading = (F.size(heads) == 0) & (F.size(body) == 1) & (F.size(one) == 2) & (label != "")
        return F.when(F.size(rs) == 0, None).when(heading, F.concat(label, F.lit(". "), F.get(one, F.lit(1)))).otherwise(F.array_join(told, "\n"))

    shown = F.filter(F.transform(rows, without), lambda r: F.size(r["values"]) > 0)
    return F.element_at(F.transform(F.array(shown), lines), 1)


def contents(pages: DataFrame, key: str, html: str = "html", profile: str = "candidate") -> DataFrame:
    """(key, idx, kind, title, gap, text) of each page's pieces of content in order: blocks of text, and tables as serialised.

    gap: lines from the piece before, 2 where an empty one lies between.

    profile: 'candidate' looks for titles in a table's first rows and before it, at most three containers up, and takes rows of
    periods as header; 'baseline' takes captions, attributes and the block before, and rows of th cells only. A table of one
    row that names a filing's item becomes a heading, a block of text.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown representation profile: {profile}")
    toks = tokens(pages, key, html)
    text = (F.col("tag") == "") & (F.col("titles") == 0)
    blocks = _joined([key, "block"], toks.where(text & (F.col("tables") == 0)), item=F.max("item"), begin=F.min(F.when(F.col("start"), F.struct("pos", "breaks", "level"))))
    blocks = blocks.where("text <> '' AND begin IS NOT NULL").select(key, "item", "begin", "text")
    # what tables hold, cell by cell, then row by row
    ordered = lambda c: F.array_sort(F.collect_list(c))
    th = (F.col("tag") == "th") & ~F.col("close")
    inside = toks.where((F.col("tables") > 0) & (text | th))
    cells = _joined([key, "item", "row", "cell", "region"], inside, th=F.bool_or(th), caption=F.collect_list(F.when(F.col("region") == "caption", _placed())))
    value = F.when(F.col("region").isin("td", "th") & (F.col("text") != ""), F.struct("cell", "text"))
    rows = cells.groupBy(key, "item", "row").agg(F.transform(ordered(value), lambda x: x["text"]).alias("values"), F.bool_or("th").alias("th"), F.flatten(F.collect_list("caption")).alias("caption"))
    row = F.when(F.size("values") > 0, F.struct("row", "values", "th"))
    grids = rows.groupBy(key, "item").agg(F.transform(ordered(row), lambda x: F.struct(x["values"].alias("values"), x["th"].alias("th"))).alias("rows"), _told(F.flatten(F.collect_list("caption"))).alias("caption"))
    # pieces of content are grouped, not joined, as a join would read the tokens again for each use of a side. They are dealt anew:
    # windows over tokens and windows over pieces in one stage are more generated code than Spark keeps, compiled again by each task
    spans = toks.groupBy(key, "item").agg(F.min("level").alias("low"), F.min(F.when(F.col("start") & (F.col("tag") == "table"), F.struct("pos", "breaks", "level", "token"))).alias("head"))
    parts = reduce(lambda a, x: a.unionByName(x, allowMissingColumns=True), (spans, blocks, grids, _containers(toks, key))).repartition(key, "item")
    line = parts.groupBy(key, "item").agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns if c not in (key, "item")])
    w = W.partitionBy(key).orderBy("item")
    line = line.withColumns({"number": F.count("head").over(w), "dip": F.lag("low").over(w)})
    is_table = F.col("head").isNotNull() & (F.size("rows") > 0)
    one = F.when((F.size("rows") == 1) & (F.size(F.get("rows", F.lit(0))["values"]) == 1), F.get(F.get("rows", F.lit(0))["values"], F.lit(0)))
    count = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.size(r["values"]))
    either = lambda c: F.when(is_table, F.col(f"head.{c}")).otherwise(F.col(f"begin.{c}")).alias(c)
    items = line.where(is_table | F.col("begin").isNotNull()).select(
        key, "item", either("pos"), either("breaks"), either("level"), F.when(is_table, "table").otherwise("text").alias("kind"), F.when(is_table, one).otherwise(F.col("text")).alias("text"),
        F.when(is_table, count).alias("cells"), "dip", "number", "rows", "caption", F.when(is_table, F.col("head.token")).alias("token"), "c0", "c1", "c2",
    )
    named = F.coalesce(*[F.nullif(attribute(F.col("token"), a), F.lit("")) for a in ("summary", "aria-label", "title")])
    full = _before(items, key).withColumn("named", F.when(F.col("kind") == "table", named))
    inline = F.get(F.filter(F.flatten(F.transform(F.slice("rows", 1, 2), lambda r: F.transform(r["values"], semantic_title))), lambda t: t.isNotNull()), F.lit(0))
    data = (F.size("rows") >= 2) & F.exists("rows", lambda r: F.exists(r["values"], lambda v: v.rlike(r"\d")))
    better = [inline, F.when(data, semantic_title(F.col("sibling")))] if profile == "candidate" else []
    given = F.coalesce(F.nullif("caption", F.lit("")), "named", *better, "block_before")
    title = F.coalesce(given, F.concat(F.lit("Table "), F.col("number").cast("string")))
    full = full.withColumns({"given": given.isNotNull(), "label": title})
    told = F.when(F.col("kind") == "table", serialised(F.col("rows"), F.col("label"), F.col("given"), profile == "candidate")).otherwise(F.col("text"))
    shown = full.select(key, "item", "breaks", (F.col("kind") == "table").alias("table"), "label", told.alias("text")).where("text IS NOT NULL")
    is_table = F.col("table") & F.col("text").startswith("[TABLE]")
    out = shown.select(key, "item", "breaks", F.when(is_table, "table").otherwise("text").alias("kind"), F.when(is_table, F.col("label")).alias("title"), "text")
    w = W.partitionBy(key).orderBy("item")
    beside = (F.col("kind") == "table") | (F.lag("kind").over(w) == "table")
    gap = F.when((F.col("breaks") - F.lag("breaks").over(w) >= 2) | beside, 2).otherwise(1)
    return out.select(key, (F.row_number().over(w) - 1).alias("idx"), "kind", "title", gap.alias("gap"), "text")


def _containers(toks: DataFrame, key: str) -> DataFrame:
    """(key, item, c0, c1, c2) of tables: place of the container that holds it, of the one around that and of the next, and whether it is the body."""
    # at each level the last container that was opened before the table
    opened = F.struct("level", "pos", F.col("tag").isin("body", "html").alias("top"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("int").alias("up"))
    asked = [F.struct((F.col("level") - 1 - i).alias("level"), "pos", F.lit(None).cast("boolean").alias("top"), "item", F.lit(i).alias("up")) for i in (0, 1, 2)]
    both = F.when(F.col("start") & (F.col("tag") == "table"), F.array(opened, *asked)).otherwise(F.array(opened))
    rows = toks.where(F.col("tag").isin(*CONTAINERS) & ~F.col("close")).select(key, F.explode(both).alias("x")).select(key, "x.*")
    last = F.last(F.when(F.col("item").isNull(), F.struct("pos", "top")), ignorenulls=True).over(W.partitionBy(key, "level").orderBy("pos", F.col("item").isNotNull()).rowsBetween(W.unboundedPreceding, -1))
    found = rows.withColumn("c", last).where("item IS NOT NULL")
    root = F.struct(F.lit(-1).alias("pos"), F.lit(True).alias("top"))
    return found.groupBy(key, "item").agg(*[F.first(F.when(F.col("up") == i, F.coalesce(F.when(F.col("level") > 0, F.col("c")), root)), ignorenulls=True).alias(f"c{i}") for i in (0, 1, 2)])


def _before(items: DataFrame, key: str) -> DataFrame:
    """Adds sibling and block_before to tables: the text of the nearest sibling with content before it, and a short block before it in its container.

    The sibling is looked for among the table's own siblings, then among its container's, then one up, up to the body. Its text
    is that of up to three pieces of content; a longer sibling, or a table of several cells, has none.
    """
    w = W.partitionBy(key).orderBy("item")
    back = {f"p{n}": F.lag(F.struct("item", "pos", "level", "kind", "text", "cells", "dip"), n).over(w) for n in (1, 2, 3, 4)}
    line = items.withColumns(back)
    holds = lambda i: F.col("p1.pos") > F.col(f"c{i}.pos")
    up = F.when(holds(0), 0).when(~F.col("c0.top") & holds(1), 1).when(~F.col("c0.top") & ~F.col("c1.top") & holds(2), 2)
    line = line.withColumn("up", up).withColumn("base", F.col("level") - 1 - F.col("up"))
    same, parts = F.col("p1.level") > F.col("base"), [F.col("p1")]
    chain = []
    for n in (2, 3, 4):
        same = same & (F.col(f"p{n - 1}.dip") > F.col("base")) & F.col(f"p{n}").isNotNull()
        chain.append(same)
    for n, cond in zip((2, 3), chain):
        parts.insert(0, F.when(cond, F.col(f"p{n}")))
    told = F.filter(F.array(*parts), lambda p: p.isNotNull())
    whole = F.forall(told, lambda p: p["text"].isNotNull() & (F.coalesce(p["cells"], F.lit(1)) == 1)) & ~F.coalesce(chain[2], F.lit(False))
    sibling = F.when(F.col("up").isNotNull() & whole, F.array_join(F.transform(told, lambda p: p["text"]), " "))
    stops = lambda p: (p["kind"] == "table") | p["text"].rlike(STATEMENT) | p["text"].rlike(ITEM)
    own = F.filter(F.array("p1", "p2", "p3"), lambda p: p.isNotNull() & (p["pos"] > F.col("c0.pos")))
    ended = F.array_position(F.transform(own, lambda p: F.coalesce(stops(p), F.lit(True))), True)
    short = F.filter(F.when(ended > 0, F.slice(own, 1, (ended - 1).cast("int"))).otherwise(own), lambda p: F.length(p["text"]) <= MAX_TITLE)
    table = F.col("kind") == "table"
    return line.select(*items.columns, F.when(table, sibling).alias("sibling"), F.when(table, F.get(short, F.lit(0))["text"]).alias("block_before"))


def page_title(html: Column) -> Column:
    """Title of a news page: og:title, else twitter:title, else the title element."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (meta(html, "og:title"), meta(html, "twitter:title"), squeezed(unescaped(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))))], F.lit(""))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by its property or name, whatever the order of the two attributes."""
    tag = F.regexp_extract(html, rf"""(?is)(<meta\b(?=[^>]*\s(?:property|name)\s*=\s*["']?{name}["'\s])[^>]*>)""", 1)
    return attribute(tag, "content")


def page_summary(html: Column) -> Column:
    return F.coalesce(F.nullif(meta(html, "og:description"), F.lit("")), F.nullif(meta(html, "description"), F.lit("")), F.lit(""))


def resolved(base: Column, link: Column) -> Column:
    """A link against the address of its page; dots in paths are worked out, fragments alone stay on the page."""
    scheme, host = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(base, "^[^/?#]*//([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    path, query = F.regexp_extract(base, "^[^/?#]*//[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"(\?[^#]*)", 1)
    own, tail = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1)), own))
    parts = F.aggregate(
        F.split(merged, "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    folder = F.when(merged.rlike(r"(?:^|/)\.{1,2}$"), "/").otherwise("")
    flat = F.concat(F.array_join(parts, "/"), F.when(F.size(parts) == 0, "/").otherwise(folder))
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link == "", base).when(own == "", F.concat(root, path, F.when(tail.startswith("#"), query).otherwise(""), tail)).otherwise(F.concat(root, flat, tail))
    )


def links(pages: DataFrame, key: str, url: str = "url", html: str = "html", years: tuple[int, int] | None = None) -> DataFrame:
    """(key, link) without repeats: what the page's anchors lead to, resolved against its address; years keeps links with such a year in their path."""
    anchors = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)(<a\s[^>]*>)"))
    out = pages.select(key, url, F.explode(anchors).alias("a")).where(F.col("a").rlike(r"(?i)\shref\s*="))
    out = out.select(key, resolved(F.col(url), attribute(F.col("a"), "href")).alias("link")).distinct()
    if years is None:
        return out
    year = F.regexp_extract("link", r"/(20\d{2})/", 1)
    return out.where((year != "") & F.try_to_number(year, F.lit("9999")).between(*years))


# Where a page keeps its main text, the best place first.
BODIES = (r"""(?is)^<div\b[^>]*\s(?:class|id)\s*=\s*["']?[^"'>]*article-body""", r"(?i)^<article\b", r"(?i)^<main\b")


def main_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, idx, text) of the blocks of text in the page's main container: an article body, else an article, else the main part, else the page."""
    toks = tokens(pages, key, html)
    place = reduce(lambda a, x: a.when(F.col("token").rlike(x[1]), x[0]), enumerate(BODIES[1:], start=2), F.when(F.col("token").rlike(BODIES[0]), 1))
    first = toks.where(~F.col("close") & place.isNotNull()).groupBy(key).agg(F.min(F.struct(place.alias("place"), "pos", "level")).alias("b"))
    ends = toks.join(first, key).where("close AND pos > b.pos AND level < b.level").groupBy(key, "b").agg(F.min("pos").alias("end"))
    bounds = first.join(ends, [key, "b"], "left").select(key, F.col("b.pos").alias("begin"), F.coalesce("end", F.lit(2**31 - 1)).alias("end"))
    text = toks.where("tag = '' AND titles = 0").join(bounds, key, "left").where("begin IS NULL OR pos BETWEEN begin AND end")
    blocks = _joined([key, "block"], text).where("text <> ''")
    return blocks.select(key, (F.row_number().over(W.partitionBy(key).orderBy("block")) - 1).alias("idx"), "text")
