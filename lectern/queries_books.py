"""Queries over small books given inline: Markdown, subtitles, stylesheets; and streaming over conversations."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import css, enrich, markdown, subtitles
from lectern.session import scratch, table
from lectern.streaming import context

_MD = """---
title: x
---
# Main

First paragraph with `code` and <https://a.b>.

```py
# not a heading
```

| a | b |
|---|---|
| 1 | 2 |

## Detail {#d}

![image](x.png)
Second paragraph.
Third line.

{4}----
42
### Deep
Last [link](http://a.b) text."""

_SRT = """1
00:00:01,000 --> 00:00:02,000
One

2
00:00:02,000 --> 00:00:03,000
Two
lines


3
00:00:03,000 --> 00:00:04,000
Three"""

_CSS = [
    "/* no */ .poem{display:block} span.linenum { color:red; display : inline-block } div.run-in, p.also{display:inline} div p{display:none}",
    "@media print{.poem{display:none}} @media screen{.poem{display:flex}} @import 'x.css'; @font-face{display:none} p{margin:0}",
]


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def md_blocks(spark, sf_dir):
    return markdown.block_table(_one(spark, _MD))


def md_batches(spark, sf_dir):
    return markdown.batch_table(_one(spark, _MD)).select("doc_id", "batch_no", "section", F.array_join("texts", "|").alias("texts"))


def md_breadcrumbs(spark, sf_dir):
    return markdown.batch_table(_one(spark, _MD)).select("doc_id", "batch_no", "breadcrumb")


def srt_blocks(spark, sf_dir):
    return subtitles.cues(_one(spark, _SRT))


def srt_pack(spark, sf_dir):
    return subtitles.packs(subtitles.cues(_one(spark, _SRT)), 14)


def srt_bilingual(spark, sf_dir):
    cues = subtitles.cues(_one(spark, _SRT)).withColumn("done", enrich.offline(F.col("text")))
    return subtitles.rendered(cues, "done")


def css_resolution(spark, sf_dir):
    sheets = spark.createDataFrame(list(enumerate(_CSS)), "sheet int, css string")
    elements = spark.createDataFrame([(0, "div", ["poem"]), (1, "span", ["linenum"]), (2, "div", ["run-in", "poem"]), (3, "p", ["also"]), (4, "p", [])], "element int, tag string, classes array<string>")
    return css.resolved(elements, css.rule_table(sheets))


def stream_context_state(spark, sf_dir):
    """The rolling context of conversations as a stream over the table's files, run to its end."""
    path = f"{sf_dir}/conversations.parquet"
    source = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).option("pathGlobFilter", "*.parquet")
    stream = source.parquet(path if os.path.isdir(path) else f"{sf_dir}/conversations*.parquet")
    out = scratch(spark, "rolling")
    q = context.rolling_context(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema("conv_id long, turn long, context string").parquet(out)


def _cues(spark, sf_dir) -> DataFrame:
    """Subtitles of documents: every line with letters is a cue."""
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[A-Za-z]"))
    part = F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n00:00:0"), (i % 7).cast("string"), F.lit(" --> 00:00:09\n"), x))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(part, "\n\n").alias("text"))
    return subtitles.cues(rows)


def srt_documents(spark, sf_dir):
    return _cues(spark, sf_dir)


def srt_document_packs(spark, sf_dir):
    return subtitles.packs(_cues(spark, sf_dir), 300).select("doc_id", "pack", "first", "last")


def srt_document_bilingual(spark, sf_dir):
    """The subtitles of documents with translations below, by digest."""
    out = subtitles.rendered(_cues(spark, sf_dir).withColumn("done", enrich.offline(F.col("text"))), "done")
    return out.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"))


def _plain_lines() -> Column:
    """The lines of a document as words of ASCII letters alone, those without any dropped."""
    cleaned = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z ]", ""), " +", " ")))
    return F.filter(cleaned, lambda x: x != "")


def md_document_blocks(spark, sf_dir):
    """Markdown made of documents: every fifth line a heading, every fifth a fence."""
    made = F.transform("l", lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).when(i % 5 == 4, F.concat(F.lit("```\n"), x, F.lit("\n\n# no heading\n```"))).otherwise(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", _plain_lines().alias("l")).select("doc_id", F.array_join(made, "\n\n").alias("text"))
    return markdown.block_table(docs).select("doc_id", "block_no", "text", "translatable")


def reply_paragraphs(spark, sf_dir):
    """Replies to batches of the lines of documents in four shapes, taken apart again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _plain_lines().alias("l")).filter("size(l) > 0")
    n = F.size("l")
    marked = F.transform("l", lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x))
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, F.array_join(marked, " ")).when(k == 1, F.array_join(F.reverse(marked), "\n")).when(k == 2, F.array_join("l", enrich.DELIMITER)).otherwise(F.array_join("l", "\n\n"))
    taken = F.udf(enrich.extract_paragraphs, "array<string>", useArrow=True)
    return docs.select("doc_id", F.sha2(F.array_join(taken(reply, n), "|").cast("binary"), 256).alias("paragraphs"))


QUERIES = {f.__name__: f for f in (md_blocks, md_batches, md_breadcrumbs, srt_blocks, srt_pack, srt_bilingual, css_resolution, stream_context_state, srt_documents, srt_document_packs, srt_document_bilingual, md_document_blocks, reply_paragraphs)}

_SRT_LINES = r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[A-Za-z]')) AS l FROM documents),
cues AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS cue, trim(unnest(l), E' \t\n\f\r') AS text FROM l)
"""

_PLAIN = r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
"""

ORACLE_SQL = {
    "srt_document_bilingual": _SRT_LINES + """SELECT doc_id, sha256(string_agg((cue + 1) || chr(10) || '00:00:0' || cue % 7 || ' --> 00:00:09' || chr(10) || text || chr(10) || '[offline]' || text, chr(10) || chr(10) ORDER BY cue)) AS text FROM cues GROUP BY doc_id""",
    "md_document_blocks": _PLAIN
    + """, b AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS block_no, unnest(l) AS x FROM p)
SELECT doc_id, block_no, CASE block_no % 5 WHEN 0 THEN '## ' || x WHEN 4 THEN '```' || chr(10) || x || chr(10) || chr(10) || '# no heading' || chr(10) || '```' ELSE x END AS text, block_no % 5 <> 4 AS translatable FROM b""",
    "reply_paragraphs": _PLAIN + "SELECT doc_id, sha256(array_to_string(l, '|')) AS paragraphs FROM p WHERE len(l) > 0",
    "srt_documents": _SRT_LINES + "SELECT doc_id, cue, CAST(cue + 1 AS VARCHAR) AS number, '00:00:0' || cue % 7 || ' --> 00:00:09' AS time, text FROM cues",
    "srt_document_packs": _SRT_LINES
    + """, t AS (SELECT doc_id, cue, length(CAST(cue + 1 AS VARCHAR)) + 1 + length(text) AS n FROM cues),
w(doc_id, cue, pack, used) AS (
  SELECT doc_id, 0, 0, n FROM t WHERE cue = 0
  UNION ALL
  SELECT t.doc_id, t.cue, w.pack + CASE WHEN w.used + t.n < 300 THEN 0 ELSE 1 END, CASE WHEN w.used + t.n < 300 THEN w.used + 2 + t.n ELSE t.n END FROM w JOIN t ON t.doc_id = w.doc_id AND t.cue = w.cue + 1)
SELECT doc_id, pack, min(cue) AS first, max(cue) + 1 AS last FROM w GROUP BY doc_id, pack""",
    "stream_context_state": "SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations",
    "srt_blocks": "SELECT CAST(d AS BIGINT) AS doc_id, CAST(c AS INTEGER) AS cue, n AS number, t AS time, x AS text FROM (VALUES (1, 0, '1', '00:00:01,000 --> 00:00:02,000', 'One'), (1, 1, '2', '00:00:02,000 --> 00:00:03,000', 'Two' || chr(10) || 'lines'), (1, 2, '3', '00:00:03,000 --> 00:00:04,000', 'Three')) v(d, c, n, t, x)",
    "css_resolution": "SELECT CAST(e AS INTEGER) AS element, d AS display FROM (VALUES (0, 'flex'), (1, 'inline-block'), (2, 'inline'), (3, 'inline'), (4, NULL)) v(e, d)",
    "md_breadcrumbs": "SELECT CAST(1 AS BIGINT) AS doc_id, CAST(b AS INTEGER) AS batch_no, c AS breadcrumb FROM (VALUES (0, 'Main'), (1, 'Main > Detail'), (2, 'Main > Detail'), (3, 'Main > Detail > Deep')) v(b, c)",
}
