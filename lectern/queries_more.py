"""Queries over insertion, resuming, lists, questions and stylesheets of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import css, enrich, html, insert, lists, questions, resume, sequence, tags
from lectern.plans import prepare
from lectern.queries_html import _PARTS, _TOKENS, _sql
from lectern.queries_text import _LINES
from lectern.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _sql(sql)
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_ESCAPED = "replace(replace(replace('[offline]' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_ELEMENTS = (
    _PARTS
    + r""", els AS (
  SELECT page_id, ord AS e, tag, text AS tok, anc[-1].ord AS up, list_contains(list_transform(anc, lambda a: a.tag), 'nav') AS in_nav, len(anc) AS depth
  FROM tokens WHERE kind = 'start' AND text NOT LIKE '%/>'),
ends AS (
  SELECT l.page_id, l.e, min(t.ord) AS stop, arg_min(len(t.anc), t.ord) = any_value(l.depth) AS own FROM els l JOIN tokens t ON t.page_id = l.page_id AND t.ord > l.e
    AND t.kind = 'end' AND NOT list_contains(list_transform(t.anc, lambda a: a.ord), l.e) GROUP BY l.page_id, l.e),
hosts AS (
  SELECT u.page_id, u.owner, u.text, l.tag, l.tok, l.in_nav,
         CASE WHEN l.tag = 'li' AND l.in_nav THEN coalesce((SELECT min(k.e) FROM els k WHERE k.page_id = u.page_id AND k.up = u.owner AND k.tag IN ('a', 'span')), u.owner) ELSE u.owner END AS host
  FROM units u JOIN els l ON l.page_id = u.page_id AND l.e = u.owner),
marks AS (
  SELECT h.page_id, n.stop, h.owner, CASE WHEN h.in_nav OR h.tag IN ('figcaption', 'caption', 'legend', 'summary') OR NOT n.own THEN 'in' ELSE 'after' END AS side,
         CASE WHEN h.in_nav OR h.tag IN ('figcaption', 'caption', 'legend', 'summary') THEN '<br/><span>' || @esc || '</span>'
              ELSE regexp_replace(h.tok, '\s+id="[^"]*"', '') || @esc || '</' || h.tag || '>' END AS made
  FROM hosts h JOIN ends n ON n.page_id = h.page_id AND n.e = h.host),
placed_in AS (SELECT page_id, stop AS ord, string_agg(made, '' ORDER BY owner DESC) AS made FROM marks WHERE side = 'in' GROUP BY page_id, stop),
placed_after AS (SELECT page_id, stop AS ord, string_agg(made, '' ORDER BY owner DESC) AS made FROM marks WHERE side = 'after' GROUP BY page_id, stop)
SELECT r.page_id, sha256(string_agg(coalesce(i.made, '') || r.tok || coalesce(a.made, ''), '' ORDER BY r.ord)) AS html, CAST(sum(length(coalesce(i.made, '')) + length(coalesce(a.made, ''))) AS BIGINT) AS added
FROM raw r LEFT JOIN placed_in i ON i.page_id = r.page_id AND i.ord = r.ord LEFT JOIN placed_after a ON a.page_id = r.page_id AND a.ord = r.ord GROUP BY r.page_id"""
).replace("@esc", _ESCAPED)


def _offline_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = html.page_units(table(spark, sf_dir, "pages"))
    return units.select("page_id", "owner", enrich.offline(F.col("text")).alias("translation"))


@query(_ELEMENTS)
def html_bilingual(spark, sf_dir):
    """Pages with the translation of every unit beside it or, in nav and captions, inside it; by digest, and the characters added."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html")
    out = insert.insert_translations(pages, _offline_units(spark, sf_dir)).withColumnRenamed("html", "new")
    out = out.join(pages, "page_id")
    return out.select("page_id", F.sha2(F.col("new").cast("binary"), 256).alias("html"), (F.length("new") - F.length("html")).cast("long").alias("added"))


@query(
    _PARTS.replace("FROM pages", "FROM (SELECT page_id, url, replace(html, '<br>', ' ') AS html FROM pages)")
    + """, kept AS (SELECT p.page_id, p.ord, row_number() OVER (PARTITION BY p.page_id, p.owner ORDER BY p.ord) AS nth, p.owner FROM parts p WHERE reason IS NULL)
SELECT r.page_id, sha256(string_agg(CASE WHEN k.ord IS NULL THEN r.tok WHEN k.nth = 1 THEN 'X' || k.owner ELSE '' END, '' ORDER BY r.ord)) AS html
FROM raw r LEFT JOIN kept k ON k.page_id = r.page_id AND k.ord = r.ord GROUP BY r.page_id"""
)
def html_single(spark, sf_dir):
    """Pages without line breaks, the text of each unit replaced by a sign of its owner; by digest."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<br>"), F.lit(" ")).alias("html"))
    units = html.page_units(pages).select("page_id", "owner", F.concat(F.lit("X"), F.col("owner").cast("string")).alias("translation"))
    out = insert.insert_translations(pages, units, single=True)
    return out.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("html"))


@query(
    """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth, sha256(text) AS s FROM documents),
g AS (SELECT source, min(nth) AS gap FROM d WHERE nth % 11 = 10 GROUP BY source)
SELECT d.source, CAST(nth AS INTEGER) AS nth, CASE WHEN gap IS NULL OR nth < gap THEN '[offline]' || s END AS result FROM d LEFT JOIN g ON g.source = d.source"""
)
def recovered_book(spark, sf_dir):
    """Every eleventh job of a source is not done; what stands before the first of these is recovered."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    jobs = _docs(spark, sf_dir).filter("source is not null").select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text")).withColumn("nth", nth)
    done = jobs.filter("nth % 11 != 10").withColumn("result", enrich.offline(F.col("text")))
    return resume.recovered(jobs, done, "source", "nth", "text", "result").select("source", "nth", "result")


@query(
    _LINES
    + """, n AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id),
s AS (SELECT l.doc_id, l.line_no, 0 AS new, l.line_no AS pos, '[offline]' || l.line AS line FROM lines l JOIN n USING (doc_id) WHERE NOT (l.line_no BETWEEN last // 3 AND last // 2)
UNION ALL SELECT l.doc_id, l.line_no, 1, last // 3, 'again ' || l.line FROM lines l JOIN n USING (doc_id) WHERE l.line_no BETWEEN last // 3 AND last // 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, new, line_no) - 1 AS INTEGER) AS line_no, line FROM s"""
)
def retranslate_splice(spark, sf_dir):
    """A stretch of each document is done again and takes its old place."""
    lines = sequence.lines(_docs(spark, sf_dir))
    span = lines.groupBy("doc_id").agg(F.max("line_no").alias("last")).select("doc_id", F.floor(F.col("last") / 3).alias("low"), F.floor(F.col("last") / 2).alias("high"))
    old = lines.withColumn("line", enrich.offline(F.col("line")))
    again = lines.join(span, "doc_id").filter("line_no between low and high").select("doc_id", "line_no", F.concat(F.lit("again "), F.col("line")).alias("line"))
    return resume.spliced(old, again, "doc_id", "line_no", span).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")


@query(
    """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE (conv_id + turn) % 7 <> 3)
SELECT conv_id, turn FROM c WHERE place = turn"""
)
def in_order_prefix(spark, sf_dir):
    """Turns that arrived out of order, some missing: what can be written out so far."""
    rows = table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 7 != 3").orderBy(F.xxhash64("conv_id", "turn"))
    return resume.in_order(rows, "conv_id", "turn").select("conv_id", "turn")


@query(
    _LINES
    + r""", b AS (SELECT *, trim(line, E' \t\n\f\r') = '' AS blank FROM lines),
i AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER w + sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
j AS (SELECT doc_id, min(line_no) AS pos, string_agg(CASE WHEN blank THEN line ELSE trim(line, E' \t\n\f\r') END, ' ' ORDER BY line_no) AS line FROM i GROUP BY doc_id, coalesce(island, CASE WHEN blank THEN 1 ELSE 0 END))
SELECT doc_id, sha256(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\n\z', '')) AS joined FROM j GROUP BY doc_id"""
)
def joined_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(lists.join_lines(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("joined"))


@query(
    _LINES.replace("WITH lists", "WITH RECURSIVE lists")
    + """, t AS (SELECT doc_id, line_no, length(line) AS c FROM lines),
w(doc_id, line_no, win, s) AS (
  SELECT doc_id, line_no, 0, c FROM t WHERE line_no = 0
  UNION ALL
  SELECT t.doc_id, t.line_no, w.win + CASE WHEN w.s + t.c > 300 THEN 1 ELSE 0 END, CASE WHEN w.s + t.c > 300 THEN t.c ELSE w.s + t.c END FROM w JOIN t ON t.doc_id = w.doc_id AND t.line_no = w.line_no + 1)
SELECT doc_id, win, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars FROM w JOIN t USING (doc_id, line_no) GROUP BY doc_id, win"""
)
def char_windows(spark, sf_dir):
    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x))
    rows = _docs(spark, sf_dir).select("doc_id", sizes.alias("sizes"))
    rows = rows.select("doc_id", F.explode(F.arrays_zip("sizes", lists.windows(F.col("sizes"), 300).alias("wins"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.wins").alias("win")).agg(F.count("*").alias("n"), F.sum("x.sizes").alias("chars"))


@query(_LINES + "SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN 'key-a' WHEN 1 THEN 'key-b' ELSE 'key-c' END AS key FROM lines")
def rotated_keys(spark, sf_dir):
    rows = lists.round_robin(sequence.lines(_docs(spark, sf_dir)), F.col("line_no"), ["key-a", "key-b", "key-c"])
    return rows.select("doc_id", "line_no", "key")


@query("SELECT doc_id, translate FROM (SELECT doc_id, source <> 'books' AND lang <> 'de' AS translate FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)")
def file_choice(spark, sf_dir):
    """Sources stand for files: one is excluded; of another choice, only three languages are taken."""
    docs = _docs(spark, sf_dir).filter("lang is not null and source is not null")
    rows = lists.choose_files(docs, "source", exclude=["books"]).withColumnRenamed("translate", "a")
    rows = lists.choose_files(rows, "lang", exclude=["de"])
    return rows.select("doc_id", (F.col("a") & F.col("translate")).alias("translate"))


@query("SELECT doc_id FROM documents WHERE doc_id < 100")
def test_limit(spark, sf_dir):
    """The operator's feature is a limit by index."""
    return lists.first_units(_docs(spark, sf_dir), "doc_id", 100).select("doc_id")


@query(
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS base, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: CASE WHEN x[1] = '/' THEN '../s/.' || x || '#f' ELSE x END)) AS href FROM pages),
p AS (SELECT *, string_split(regexp_replace(base, '[^/]*$', '') || regexp_replace(href, '#.*$', ''), '/') AS parts FROM h WHERE NOT regexp_matches(href, '^([a-z]+:|/)'))
SELECT page_id, href, list_reduce(list_prepend('', parts), lambda acc, x: CASE WHEN x = '' OR x = '.' THEN acc WHEN x = '..' THEN regexp_replace(acc, '(^|/)[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END) AS path, count(*) AS n
FROM p GROUP BY ALL"""
)
def resolved_paths(spark, sf_dir):
    """References of pages, those to a root made relative, as seen from the page's address."""
    base = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.explode(F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda x: F.when(x.startswith("/"), F.concat(F.lit("../s/."), x, F.lit("#f"))).otherwise(x))).alias("href")).filter(~F.col("href").rlike("^([a-z]+:|/)"))
    return rows.select("page_id", "href", lists.resolve_path(F.col("base"), F.col("href")).alias("path")).groupBy("page_id", "href", "path").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 2 THEN NULL WHEN doc_id % 5 = 3 THEN 'text ' || doc_id ELSE 'plain ' || doc_id END AS text,
CASE doc_id % 5 WHEN 0 THEN 'refused: no' WHEN 1 THEN 'cut off' WHEN 2 THEN 'no text under german' END AS error FROM documents"""
)
def batch_choices(spark, sf_dir):
    """Replies of a batch service: refused, cut off, without the field, with it, and plain."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    content = F.when(k == 2, F.to_json(F.struct(n.alias("french")))).when(k == 3, F.to_json(F.struct(F.concat(F.lit("text "), n).alias("german")))).otherwise(F.concat(F.lit("plain "), n))
    rows = _docs(spark, sf_dir).select(n.alias("custom_id"), F.when(k == 1, "length").otherwise("stop").alias("finish"), F.when(k == 0, "no").alias("refusal"), content.alias("content"))
    return questions.batch_results(rows, "german").select(F.col("custom_id").cast("long").alias("doc_id"), "text", "error")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'unsupported' WHEN doc_id % 6 = 1 THEN 'unsupported' WHEN doc_id % 6 = 2 THEN 'json' WHEN doc_id % 6 = 3 THEN 'json' WHEN doc_id % 6 = 4 THEN 'shape' ELSE 'strict' END AS grade,
CASE doc_id % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'schema' ELSE 'other' END AS kind FROM documents"""
)
def probe_grades(spark, sf_dir):
    k = F.col("doc_id") % 6
    content = F.when(k == 1, "prose").when(k == 2, '{"other": "a"}').when(k == 3, '{"word": 1}').when(k == 4, '{"word": "b"}').otherwise('{"word": "a"}')
    message = F.when(F.col("doc_id") % 3 == 0, "Unsupported value: Temperature").when(F.col("doc_id") % 3 == 1, "bad response_format").otherwise("no such model")
    return _docs(spark, sf_dir).select("doc_id", questions.grade_probe(F.when(k == 0, "length").otherwise("stop"), content, "word", "a").alias("grade"), questions.error_kind(message).alias("kind"))


@query(
    """WITH d AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^ ]')] AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(parts) AS n, sha256(array_to_string(list_transform(parts, lambda x: trim(x)), chr(10))) AS parts FROM d WHERE len(parts) > 0 AND len(list_filter(parts, lambda x: contains(x, '@@'))) = 0"""
)
def delimiter_batches(spark, sf_dir):
    """Lines joined into one request and taken apart again, by digest."""
    parts = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ ]"))
    rows = _docs(spark, sf_dir).select("doc_id", parts.alias("parts")).filter((F.size("parts") > 0) & ~F.exists("parts", lambda x: F.contains(x, F.lit("@@"))))
    back = questions.split_reply(questions.batch_prompt(F.col("parts")), F.size("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n"), F.sha2(F.array_join(back, "\n").cast("binary"), 256).alias("parts"))


@query(
    _TOKENS
    + """, el AS (SELECT page_id, ord, tag, cls, len(anc) AS depth FROM toks JOIN (SELECT page_id AS p, ord AS o, anc FROM tokens) a ON a.p = page_id AND a.o = ord WHERE kind = 'start'),
shown AS (SELECT page_id, ord, CASE WHEN tag = 'div' AND list_contains(string_split(regexp_extract(tok, 'class="([^"]*)"', 1), ' '), 'ad') THEN 'none' WHEN list_contains(string_split(regexp_extract(tok, 'class="([^"]*)"', 1), ' '), 'ad') THEN 'inline' WHEN tag = 'p' THEN 'flex' WHEN tag = 'span' THEN 'block' END AS display, tag FROM toks WHERE kind = 'start')
SELECT tag, display, count(*) AS n FROM shown WHERE tag IN ('div', 'p', 'span', 'h1') GROUP BY ALL"""
)
def css_display(spark, sf_dir):
    """The display of elements of the pages by a stylesheet with rules of all three tiers."""
    sheet = ".ad{display:inline} div.ad{display:none} p{display:block} @media print{h1{display:none}} p{display:flex} span{display:block}"
    rules = css.rule_table(spark.createDataFrame([(0, sheet)], "sheet int, css string"))
    toks = html.tokens(table(spark, sf_dir, "pages")).filter("kind = 'start' and tag in ('div', 'p', 'span', 'h1')")
    classes = F.split(F.regexp_extract("text", 'class="([^"]*)"', 1), " ")
    elements = toks.select(F.struct("page_id", "ord").alias("element"), "tag", classes.alias("classes"))
    of = css.resolved(elements, rules)
    return elements.join(of, "element").groupBy("tag", "display").agg(F.count("*").alias("n"))


@query(_PARTS + "SELECT page_id % 2 = 0 AS styled, starts_with(signature, 'h1') AS heading, count(*) AS n FROM units WHERE NOT (page_id % 2 = 0 AND starts_with(signature, 'h1')) GROUP BY ALL")
def plan_by_sheets(spark, sf_dir):
    """Units of pages that each bring a stylesheet of their own: even pages hide their headings."""
    sheets = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("h1{display:none}"))).otherwise(F.array().cast("array<string>"))
    units = html.page_units(table(spark, sf_dir, "pages").withColumn("sheets", sheets), sheets="sheets")
    return units.groupBy((F.col("page_id") % 2 == 0).alias("styled"), F.col("signature").startswith("h1").alias("heading")).agg(F.count("*").alias("n"))


@query("SELECT reason, n FROM (VALUES ('hidden'), ('link'), ('non-content'), ('pagebreak'), ('ruby'), ('symbol'), ('excluded-tag')) r(reason), (SELECT count(*) AS n FROM pages)")
def skip_reasons(spark, sf_dir):
    """Every page with a block in front that has each reason to skip once: the reasons by frequency."""
    body = "<div hidden>gone</div><p>http://a.b/c</p><svg>drawn</svg><p role='doc-pagebreak'>12</p><p>* * *</p><p><ruby>base<rt>note</rt></ruby> kept</p><sup>x1</sup>"
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(f"<html><body>{body}</body></html>"), F.lit("")).alias("html"))
    parts = html.partition(pages).filter("reason is not null and chars > 0")
    return lists.most_common(parts, "reason")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'skip' ELSE 'translate' END AS verdict, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) GROUP BY 1")
def plan_classifier(spark, sf_dir):
    """Signatures by a stand-in model that answers by their number, and only half of a page at once."""
    import json

    def ask(prompt: str, schema: dict) -> str:
        names = list(schema["schema"]["properties"])
        return "Sure: " + json.dumps({s: {"content_type": "x", "verdict": "skip" if int(s.split(".s")[1]) % 2 == 0 else "translate"} for s in names[: max(1, len(names) // 2)]})

    rows = _docs(spark, sf_dir).select(F.concat(F.lit("p.s"), F.col("doc_id").cast("string")).alias("signature"), F.lit(1).alias("units"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.array(F.lit("sample")).alias("samples")).dropDuplicates(["signature"])
    return questions.classify(rows, ask).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_mktsegment AS title, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0")
def catalogue(spark, sf_dir):
    """A catalogue: keys joined with what they open, without those that need none, by title."""
    opened = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    free = opened.filter("o_orderkey % 3 = 0").select("o_orderkey")
    rows = table(spark, sf_dir, "customer").join(opened.join(free, "o_orderkey", "left_anti"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("title")).agg(F.count("*").alias("n")).orderBy("title")


@query("SELECT conv_id, list_aggregate(list_filter(['assistant', 'system', 'user'], lambda r: list_contains(list(role), r)), 'string_agg', ',') AS found, coalesce(list_aggregate(list_filter(['assistant', 'system', 'user'], lambda r: NOT list_contains(list(role), r)), 'string_agg', ','), '') AS lacking FROM conversations GROUP BY conv_id")
def preferences(spark, sf_dir):
    """Roles of a conversation in an order of preference, and those it lacks."""
    order = F.array(*map(F.lit, ("assistant", "system", "user")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return rows.select("conv_id", F.array_join(lists.preferred(F.col("roles"), order), ",").alias("found"), F.array_join(lists.missing(order, F.col("roles")), ",").alias("lacking"))


@query("SELECT doc_id, sha256(CASE WHEN regexp_matches(string_split(text, chr(10))[1], '^[0-9]+$') THEN string_split(text, chr(10))[1] || chr(10) || '[offline]' || text ELSE '[offline]' || text END) AS text FROM documents WHERE text IS NOT NULL")
def numbered_paragraphs(spark, sf_dir):
    rows = _docs(spark, sf_dir).filter("text is not null")
    return rows.select("doc_id", F.sha2(questions.with_number(F.col("text"), enrich.offline(F.col("text"))).cast("binary"), 256).alias("text"))


@query(
    _LINES
    + r"""SELECT doc_id, line_no, line_no % 4 = 1 AND length(trim(line, E' \t\n\f\r')) + 11 < 80 AS listing, line_no % 4 = 2 AND length(trim(line, E' \t\n\f\r')) + 10 < 80 AS figure FROM lines
WHERE trim(line, E' \t\n\f\r') <> ''"""
)
def listings_and_figures(spark, sf_dir):
    """Lines with a head as listings and figures have it: the short ones are told apart."""
    k = F.col("line_no") % 4
    rows = sequence.lines(_docs(spark, sf_dir)).filter(T.strip(F.col("line")) != "")
    head = F.concat(F.when(k == 1, "Listing 12 ").when(k == 2, "Figure 3: ").otherwise("Listings "), T.strip(F.col("line")))
    return rows.select("doc_id", "line_no", T.is_listing(head).alias("listing"), T.is_figure(head).alias("figure"))


@query(
    _TOKENS
    + r""", chosen AS (SELECT page_id, ord, tag FROM tokens WHERE kind = 'start' AND tag IN ('p', 'li')),
holders AS (SELECT page_id, unnest(list_transform(anc, lambda a: a.ord)) AS ord FROM tokens WHERE kind = 'start' AND tag IN ('p', 'li')),
texts AS (SELECT page_id, ord AS n, unnest(list_transform(anc, lambda a: a.ord)) AS ord, text, len(list_filter(anc, lambda a: a.tag IN (@excluded))) > 0 AS gone FROM tokens WHERE kind = 'text'),
units AS (SELECT c.page_id, c.ord, c.tag, NOT EXISTS (SELECT 1 FROM holders h WHERE h.page_id = c.page_id AND h.ord = c.ord) AS leaf,
  coalesce(string_agg(t.text, '' ORDER BY t.n), '') AS text, coalesce(string_agg(CASE WHEN NOT t.gone THEN t.text END, '' ORDER BY t.n), '') AS kept
  FROM chosen c LEFT JOIN texts t ON t.page_id = c.page_id AND t.ord = c.ord GROUP BY c.page_id, c.ord, c.tag)
SELECT page_id, ord, tag, leaf, sha256(text) AS text, sha256(kept) AS kept FROM units
UNION ALL SELECT page_id, ord, NULL, true, sha256(text), sha256(text) FROM tokens WHERE kind = 'text'"""
)
def tag_mode_units(spark, sf_dir):
    """Elements of chosen tags and then all strings, whose texts come again; texts by digest."""
    pages = table(spark, sf_dir, "pages")
    both = lists.all_passes(tags.tag_units(pages, ("p", "li")), tags.strings(html.tokens(pages)))
    return both.select("page_id", "ord", "tag", "leaf", *(F.sha2(F.col(c).cast("binary"), 256).alias(c) for c in ("text", "kept")))


@query(
    _PARTS
    + """SELECT CASE WHEN signature IN ('footer', 'div.ad') THEN 'skipped' ELSE 'translated' END AS what, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM units GROUP BY 1"""
)
def plan_prepared(spark, sf_dir):
    """The whole way of a plan: gate, verdicts of a stand-in model that skips everything in doubt but headings, actions of a person, translation, insertion."""
    import json

    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    actions = spark.createDataFrame([("footer", "skip"), ("div.ad", "skip"), ("h1", "translate"), ("p", "translate"), ("li", "translate")], "signature string, action string")

    def ask(prompt: str, schema: dict) -> str:
        return json.dumps({s: {"content_type": "x", "verdict": "skip"} for s in schema["schema"]["properties"]})

    plan = prepare.prepare(pages, actions, ask, least=0.1)
    done = prepare.translated(plan.units).join(plan.units.select("page_id", "owner", "chars"), ["page_id", "owner"])
    stay = done.filter("translation is not null").agg(F.lit("translated").alias("what"), F.count("*").alias("n"), F.sum("chars").alias("chars"))
    every = html.page_units(pages).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    rest = every.select(F.lit("skipped").alias("what"), "n", "chars").unionByName(stay.select(F.lit("skipped").alias("what"), (-F.col("n")).alias("n"), (-F.col("chars")).alias("chars")))
    return stay.unionByName(rest.groupBy("what").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")))
