"""Queries over pages: tokens, the total partition, the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import html
from lectern.plans import translation
from lectern.session import table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def html_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.tokens(_pages(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def html_path_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = html.tokens(_pages(spark, sf_dir)).filter("kind = 'text'")
    path = F.array_join(F.transform("anc", lambda a: a["tag"]), "/")
    return toks.groupBy(path.alias("path")).agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("chars"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.partition(_pages(spark, sf_dir))


def plan_skip_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.skips(_parts(spark, sf_dir))


def plan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_units(_pages(spark, sf_dir)).select("page_id", "unit_ord", "signature", "text", "chars")


def plan_signature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = translation.signature_rows(html.page_units(_pages(spark, sf_dir)))
    return rows.select("signature", "units", "chars", F.array_join("samples", "|").alias("samples"))


def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.coverage(_parts(spark, sf_dir))


def plan_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page the characters of units and skips and their difference to the total, which is 0."""
    parts = _parts(spark, sf_dir)
    unit = html.units(parts).groupBy("page_id").agg(F.sum("chars").alias("unit_chars"))
    total = parts.groupBy("page_id").agg(F.sum("chars").alias("total_chars"), F.sum(F.when(F.col("reason").isNotNull(), F.col("chars")).otherwise(0)).alias("skip_chars"))
    out = total.join(unit, "page_id", "left").withColumn("unit_chars", F.coalesce("unit_chars", F.lit(0)))
    return out.select("page_id", "total_chars", "unit_chars", "skip_chars", (F.col("total_chars") - F.col("unit_chars") - F.col("skip_chars")).alias("difference"))


def plan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    total = translation.coverage(parts).first()["total_chars"]
    rows = translation.candidates(html.units(parts), total or 1)
    return rows.select("signature", "units", "chars", F.array_join("samples", "|").alias("samples"))


def plan_override_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that a skip of footers and a model's skip of adverts leave out, and what stays."""
    actions = spark.createDataFrame([("footer", "skip"), ("div.ad", "llm-skip"), ("p", "translate")], "signature string, action string")
    stay, gone = translation.override(html.page_units(_pages(spark, sf_dir)), actions)
    return gone.unionByName(stay.agg(F.lit("kept").alias("reason"), F.sum("chars").alias("chars")))


def plan_top_rows_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.report(translation.signature_rows(html.page_units(_pages(spark, sf_dir))), top=3)


def tag_mode_leaf_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag mode: p and li elements that hold no other, with the length of their text without excluded elements."""
    toks = html.tokens(_pages(spark, sf_dir))
    chosen = toks.filter(F.col("kind").isin("start") & F.col("tag").isin("p", "li")).select("page_id", "ord", "tag")
    holders = toks.filter(F.col("kind").isin("start") & F.col("tag").isin("p", "li")).select("page_id", F.explode(F.transform("anc", lambda a: a["ord"])).alias("ord"))
    leaves = chosen.join(holders, ["page_id", "ord"], "left_anti")
    excluded = F.exists("anc", lambda a: a["tag"].isin(*K.EXCLUDED_TAGS))
    texts = toks.filter((F.col("kind") == "text") & ~excluded).select("page_id", F.explode(F.transform("anc", lambda a: a["ord"])).alias("ord"), F.length("text").alias("chars"))
    return leaves.join(texts, ["page_id", "ord"], "left").groupBy("tag").agg(F.countDistinct("page_id", "ord").alias("leaves"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def nav_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages under /en/: text nodes in restricted containers (nav, figcaption, caption, legend, summary) and others."""
    toks = html.tokens(_pages(spark, sf_dir).filter(F.contains("url", F.lit("/en/")))).filter("kind = 'text'")
    restricted = F.exists("anc", lambda a: a["tag"].isin("nav", "figcaption", "caption", "legend", "summary"))
    return toks.groupBy(F.when(restricted, "append-inline").otherwise("sibling").alias("insertion")).agg(F.count("*").alias("nodes"), F.countDistinct("page_id").alias("pages"))


def find_pages_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page whose text has each of some words."""
    words = spark.createDataFrame([("the",), ("der",), ("que",)], "word string")
    texts = html.page_units(_pages(spark, sf_dir)).select("page_id", "text")
    return texts.join(F.broadcast(words), F.contains("text", F.col("word"))).groupBy("word").agg(F.min("page_id").alias("page_id"), F.countDistinct("page_id").alias("pages"))


_LIST = ", ".join
_TAGS = {n: _LIST(f"'{t}'" for t in v) for n, v in (("block", K.BLOCK_TAGS), ("void", K.VOID_TAGS), ("noncontent", K.NON_CONTENT_TAGS), ("ruby", K.RUBY_TAGS), ("excluded", K.EXCLUDED_TAGS))}

#: Tokens and their open elements by a recursion over the tokens of all pages at once.
_TOKENS = (
    r"""
WITH RECURSIVE lists AS (
  SELECT page_id, url, regexp_extract_all(html, '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>?|[^<]+') AS l FROM pages),
raw AS (SELECT page_id, url, unnest(l) AS tok, CAST(generate_subscripts(l, 1) AS INTEGER) AS ord FROM lists),
named AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS tag FROM raw),
toks AS (
  SELECT page_id, url, ord, tok, nullif(tag, '') AS tag,
         CASE WHEN tok[1] <> '<' THEN 'text' WHEN tag IN ('script', 'style') AND tok[2] <> '/' THEN 'opaque' WHEN tag = '' THEN 'other'
              WHEN tok[2] = '/' THEN 'end' WHEN tag IN (@void) THEN 'void' ELSE 'start' END AS kind,
         regexp_extract(regexp_extract(tok, 'class="([^"]*)"', 1), '^\s*(\S*)', 1) AS cls
  FROM named),
walk(page_id, ord, st, after_st) AS (
  SELECT page_id, 0, CAST([] AS STRUCT(ord INTEGER, tag VARCHAR, cls VARCHAR)[]), CAST([] AS STRUCT(ord INTEGER, tag VARCHAR, cls VARCHAR)[]) FROM pages
  UNION ALL
  SELECT w.page_id, t.ord,
         CASE WHEN t.kind = 'end' AND list_position(list_reverse(list_transform(w.after_st, lambda a: a.tag)), t.tag) > 0
              THEN w.after_st[1:len(w.after_st) - list_position(list_reverse(list_transform(w.after_st, lambda a: a.tag)), t.tag)] ELSE w.after_st END,
         CASE WHEN t.kind = 'start' AND t.tok NOT LIKE '%/>' THEN list_append(w.after_st, {'ord': t.ord, 'tag': t.tag, 'cls': t.cls})
              WHEN t.kind = 'end' AND list_position(list_reverse(list_transform(w.after_st, lambda a: a.tag)), t.tag) > 0
              THEN w.after_st[1:len(w.after_st) - list_position(list_reverse(list_transform(w.after_st, lambda a: a.tag)), t.tag)] ELSE w.after_st END
  FROM walk w JOIN toks t ON t.page_id = w.page_id AND t.ord = w.ord + 1),
tokens AS (
  SELECT t.page_id, t.url, t.ord, t.kind, t.tag, w.st AS anc,
         CASE WHEN t.kind = 'text' THEN replace(replace(replace(replace(t.tok, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') ELSE t.tok END AS text
  FROM toks t JOIN walk w ON w.page_id = t.page_id AND w.ord = t.ord)
"""
)
_URL = T.URL
_PARTS = (
    _TOKENS
    + r""",
nodes AS (
  SELECT page_id, ord, CASE WHEN kind = 'void' THEN chr(10) ELSE text END AS text, anc
  FROM tokens WHERE list_contains(list_transform(anc, lambda a: a.tag), 'body')
    AND (kind = 'text' OR (kind = 'void' AND tag = 'br' AND NOT list_contains(list_transform(anc, lambda a: a.tag), 'pre')))),
placed AS (
  SELECT *, length(trim(text, E' \t\n\f\r')) AS chars,
         len(anc) + 1 - list_position(list_reverse(list_transform(anc, lambda a: a.tag IN (@block))), true) AS place,
         list_filter(list_transform(list_reverse(anc), lambda a: CASE WHEN a.tag IN (@noncontent) THEN 'non-content' WHEN a.tag IN (@ruby) THEN 'ruby' WHEN a.tag IN (@excluded) THEN 'excluded-tag' END), lambda r: r IS NOT NULL)[1] AS anc_reason
  FROM nodes),
rooted AS (
  SELECT *, CASE WHEN chars = 0 THEN 'whitespace' ELSE anc_reason END AS of_elements,
         CASE WHEN chars > 0 AND anc_reason IS NULL AND len(anc) > place THEN anc[place + 1].ord END AS root
  FROM placed),
subtrees AS (
  SELECT r.page_id, r.root, trim(regexp_replace(translate(string_agg(n.text, '' ORDER BY n.ord), chr(173) || chr(8203) || chr(65279), ''), '[ \t\n\f\r]+', ' ', 'g')) AS whole
  FROM (SELECT DISTINCT page_id, root FROM rooted WHERE root IS NOT NULL) r
  JOIN (SELECT page_id, ord, text, unnest(list_transform(anc, lambda a: a.ord)) AS root FROM rooted
        WHERE len(list_filter(anc, lambda a: a.tag IN (@ruby))) = 0) n ON n.page_id = r.page_id AND n.root = r.root
  GROUP BY r.page_id, r.root),
judged AS (
  SELECT r.*, CASE WHEN r.root IS NULL THEN trim(regexp_replace(translate(r.text, chr(173) || chr(8203) || chr(65279), ''), '[ \t\n\f\r]+', ' ', 'g')) ELSE s.whole END AS whole
  FROM rooted r LEFT JOIN subtrees s ON s.page_id = r.page_id AND s.root = r.root),
parts AS (
  SELECT page_id, ord, text, CAST(chars AS BIGINT) AS chars, anc[place].ord AS owner,
         anc[place].tag || CASE WHEN anc[place].cls <> '' THEN '.' || anc[place].cls ELSE '' END AS signature,
         coalesce(of_elements, CASE WHEN whole = '' THEN 'whitespace' WHEN regexp_matches(whole, '^@url') THEN 'link' WHEN NOT regexp_matches(whole, '[\p{L}\p{N}]') THEN 'symbol' END) AS reason
  FROM judged),
units AS (
  SELECT page_id, owner, signature, min(ord) FILTER (reason IS NULL) AS unit_ord,
         trim(regexp_replace(translate(string_agg(CASE WHEN reason IS NULL OR chars = 0 THEN text WHEN text <> trim(text, E' \t\n\f\r') THEN ' ' ELSE '' END, '' ORDER BY ord), chr(173) || chr(8203) || chr(65279), ''), '[ \t\n\f\r]+', ' ', 'g')) AS text,
         CAST(coalesce(sum(chars) FILTER (reason IS NULL), 0) AS BIGINT) AS chars
  FROM parts GROUP BY page_id, owner, signature HAVING min(ord) FILTER (reason IS NULL) IS NOT NULL),
totals AS (SELECT CAST(coalesce(sum(chars), 0) AS BIGINT) AS total_chars, CAST(coalesce(sum(chars) FILTER (reason IS NULL), 0) AS BIGINT) AS translate_chars FROM parts),
texts AS (SELECT signature, text, min({'page_id': page_id, 'unit_ord': unit_ord}) AS seen FROM units GROUP BY signature, text),
samples AS (
  SELECT signature, string_agg(CASE WHEN length(text) > 80 THEN text[1:80] || '…' ELSE text END, '|' ORDER BY seen) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY seen) AS nth FROM texts) WHERE nth <= 5 GROUP BY signature),
rows AS (
  SELECT u.signature, count(*) AS units, CAST(sum(u.chars) AS BIGINT) AS chars, min({'page_id': u.page_id, 'unit_ord': u.unit_ord}) AS first, any_value(s.samples) AS samples
  FROM units u JOIN samples s ON s.signature = u.signature GROUP BY u.signature)
"""
)


def _sql(text: str) -> str:
    for name, tags in _TAGS.items():
        text = text.replace(f"@{name}", tags)
    return text.replace("@url", _URL.replace("'", "''"))


QUERIES = {
    f.__name__: f
    for f in (html_token_counts, html_path_chars, plan_skip_totals, plan_units, plan_signature_report, plan_coverage, plan_invariant, plan_candidates, plan_override_skip, plan_top_rows_tail, tag_mode_leaf_p, nav_page_filter, find_pages_containing)
}

ORACLE_SQL = {
    k: _sql(v)
    for k, v in {
        "html_token_counts": _TOKENS + "SELECT kind, count(*) AS n FROM toks GROUP BY kind",
        "html_path_chars": _TOKENS + "SELECT array_to_string(list_transform(anc, lambda a: a.tag), '/') AS path, count(*) AS nodes, CAST(sum(length(text)) AS BIGINT) AS chars FROM tokens WHERE kind = 'text' GROUP BY 1",
        "plan_skip_totals": _PARTS + "SELECT reason, CAST(sum(chars) AS BIGINT) AS chars FROM parts WHERE reason IS NOT NULL AND chars > 0 GROUP BY reason",
        "plan_units": _PARTS + "SELECT page_id, unit_ord, signature, text, chars FROM units",
        "plan_signature_report": _PARTS + "SELECT signature, units, chars, samples FROM rows",
        "plan_coverage": _PARTS + "SELECT total_chars, translate_chars, CASE WHEN total_chars = 0 THEN CAST(1 AS DOUBLE) ELSE translate_chars / total_chars END AS coverage FROM totals",
        "plan_invariant": _PARTS
        + """, u AS (SELECT page_id, CAST(sum(chars) AS BIGINT) AS unit_chars FROM units GROUP BY page_id),
t AS (SELECT page_id, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(coalesce(sum(chars) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS skip_chars FROM parts GROUP BY page_id)
SELECT t.page_id, total_chars, coalesce(unit_chars, CAST(0 AS BIGINT)) AS unit_chars, skip_chars, total_chars - coalesce(unit_chars, CAST(0 AS BIGINT)) - skip_chars AS difference FROM t LEFT JOIN u ON u.page_id = t.page_id""",
        "plan_candidates": _PARTS
        + """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY page_id, unit_ord) AS nth FROM units) WHERE nth <= 50),
uniq AS (SELECT signature, text, min(nth) AS nth FROM firsts GROUP BY signature, text),
ranked AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY nth) - 1 AS i, count(*) OVER (PARTITION BY signature) AS n FROM uniq),
few AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY i) AS k FROM ranked WHERE i % greatest(1, n // 5) = 0),
shown AS (SELECT signature, string_agg(CASE WHEN length(text) > 80 THEN text[1:80] || '…' ELSE text END, '|' ORDER BY i) AS samples FROM few WHERE k <= 5 GROUP BY signature),
ratio AS (SELECT signature, count(DISTINCT text) / count(*) AS r FROM firsts GROUP BY signature)
SELECT rows.signature, units, chars, shown.samples FROM rows JOIN shown USING (signature) JOIN ratio USING (signature), totals
WHERE split_part(rows.signature, '.', 1) NOT IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') AND 100 * chars / greatest(total_chars, 1) < 10 AND NOT (chars / units > 50 AND r > 0.5)""",
        "plan_override_skip": _PARTS
        + """SELECT CASE signature WHEN 'footer' THEN 'user-excluded' WHEN 'div.ad' THEN 'llm-excluded' ELSE 'kept' END AS reason, CAST(sum(chars) AS BIGINT) AS chars FROM units GROUP BY 1""",
        "plan_top_rows_tail": _PARTS
        + """, ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY chars DESC, first) AS INTEGER) AS nth FROM rows)
SELECT nth, signature, units, chars FROM ranked WHERE nth <= 3
UNION ALL SELECT CAST(0 AS INTEGER), '... ' || count(*) || ' more', CAST(sum(units) AS BIGINT), CAST(sum(chars) AS BIGINT) FROM ranked WHERE nth > 3 HAVING count(*) > 0""",
        "tag_mode_leaf_p": _TOKENS
        + """, chosen AS (SELECT page_id, ord, tag FROM tokens WHERE kind = 'start' AND tag IN ('p', 'li')),
holders AS (SELECT page_id, unnest(list_transform(anc, lambda a: a.ord)) AS ord FROM tokens WHERE kind = 'start' AND tag IN ('p', 'li')),
leaves AS (SELECT * FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM holders h WHERE h.page_id = c.page_id AND h.ord = c.ord)),
texts AS (SELECT page_id, unnest(list_transform(anc, lambda a: a.ord)) AS ord, length(text) AS chars FROM tokens WHERE kind = 'text' AND len(list_filter(anc, lambda a: a.tag IN (@excluded))) = 0)
SELECT tag, count(DISTINCT (l.page_id, l.ord)) AS leaves, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars FROM leaves l LEFT JOIN texts t ON t.page_id = l.page_id AND t.ord = l.ord GROUP BY tag""",
        "nav_page_filter": _TOKENS
        + """SELECT CASE WHEN len(list_filter(anc, lambda a: a.tag IN ('nav', 'figcaption', 'caption', 'legend', 'summary'))) > 0 THEN 'append-inline' ELSE 'sibling' END AS insertion, count(*) AS nodes, count(DISTINCT page_id) AS pages
FROM tokens WHERE kind = 'text' AND contains(url, '/en/') GROUP BY 1""",
        "find_pages_containing": _PARTS + "SELECT word, min(page_id) AS page_id, count(DISTINCT page_id) AS pages FROM units JOIN (VALUES ('the'), ('der'), ('que')) w(word) ON contains(text, word) GROUP BY word",
    }.items()
}
