"""Queries over documents, conversations and inline rows: text functions, sequences, joins, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import languages
from lectern.functions import text as T
from lectern.operators import enrich, html, resume, sequence
from lectern.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("@url", T.URL).replace("@ws", r"[ \t\n\f\r]")
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _count(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


_LINES = """
WITH lists AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM lists)
"""
_NORMAL = "trim(regexp_replace(translate(text, chr(173) || chr(8203) || chr(65279), ''), '@ws+', ' ', 'g'))"


@query("SELECT doc_id, length(" + _NORMAL + ") AS n FROM documents")
def normalized_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(T.normalize(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:80] || '…' ELSE text END AS sample FROM documents")
def sample_clip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clip(F.col("text")).alias("sample"))


@query("SELECT page_id, CASE WHEN length(regexp_extract(t, '@url')) >= 20 THEN regexp_replace(t, '@url', '...', 'g') ELSE t END AS text FROM (SELECT page_id, 'see ' || url || ' and www.a.b' AS t FROM pages)")
def shorten_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.shorten_links(F.concat(F.lit("see "), F.col("url"), F.lit(" and www.a.b"))).alias("text"))


@query(
    _LINES
    + r"""SELECT count(*) AS n,
count(*) FILTER (regexp_matches(trim(line, E' \t\n\f\r'), '^@url')) AS links,
count(*) FILTER (regexp_matches(trim(line, E' \t\n\f\r'), '@url$') AND length(trim(line, E' \t\n\f\r')) < 80) AS tail_links,
count(*) FILTER (starts_with(trim(line, E' \t\n\f\r'), 'Source: ')) AS sources,
count(*) FILTER (regexp_matches(line, '^[\p{Nd} \t\n\f\r]*$')) AS digits,
count(*) FILTER (regexp_matches(line, '^[Ee]?ISBN@ws*[0-9][0-9 \t\n\f\r]*$')) AS isbns,
count(*) FILTER (regexp_matches(line, '^[!-/:-@\[-`{-~]*$') OR regexp_matches(line, '^[\p{Nd} \t\n\f\r]*$') OR regexp_matches(trim(line, E' \t\n\f\r'), '^@url')) AS special,
count(*) FILTER (NOT regexp_matches(line, '[\p{L}\p{N}]')) AS symbols FROM lines"""
)
def text_predicates(spark, sf_dir):
    c = F.col("line")
    return sequence.lines(_docs(spark, sf_dir)).agg(
        F.count("*").alias("n"), _count(T.is_link(c), "links"), _count(T.is_tail_link(c), "tail_links"), _count(T.is_source(c), "sources"), _count(T.is_digits(c), "digits"),
        _count(T.is_isbn(c), "isbns"), _count(T.is_special(c, "epub"), "special"), _count(~c.rlike(r"[\p{L}\p{N}]"), "symbols"),
    )


_SENTENCES = r"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(trim(text, E' \t\n\f\r'), '([.!?])@ws+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents),
parts AS (SELECT doc_id, unnest(list_filter(list_transform(l, lambda x: trim(x, E' \t\n\f\r')), lambda x: x <> '')) AS s, generate_subscripts(list_filter(list_transform(l, lambda x: trim(x, E' \t\n\f\r')), lambda x: x <> ''), 1) - 1 AS nth FROM cut)
"""


@query(_SENTENCES + "SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM parts GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query(_SENTENCES + "SELECT doc_id, CAST(nth AS INTEGER) AS nth, k AS part, CASE k WHEN 0 THEN s ELSE '[offline]' || s END AS text FROM parts, (VALUES (0), (1)) v(k)")
def sentence_mode_pairs(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("nth", "s"))
    return s.select("doc_id", "nth", F.posexplode(F.array("s", enrich.offline(F.col("s")))).alias("part", "text"))


@query(_LINES + "SELECT doc_id, CAST(line_no // 10 AS INTEGER) AS batch, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines GROUP BY ALL")
def txt_batches(spark, sf_dir):
    rows = sequence.fixed_batches(sequence.lines(_docs(spark, sf_dir)), ["doc_id"], "line_no")
    return rows.groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def _txt(spark, sf_dir, single: bool) -> DataFrame:
    rows = sequence.fixed_batches(sequence.lines(_docs(spark, sf_dir)), ["doc_id"], "line_no")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    batches = rows.groupBy("doc_id", "batch").agg(whole.alias("source")).filter(~T.is_special(F.col("source")))
    pieces = F.array(enrich.offline(F.col("source"))) if single else F.array("source", enrich.offline(F.col("source")))
    out = batches.select("doc_id", "batch", F.posexplode(pieces))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "pos", "col"))), lambda x: x["col"]), "\n").alias("text"))


_TXT = _LINES + r""", batches AS (SELECT doc_id, line_no // 10 AS batch, string_agg(line, chr(10) ORDER BY line_no) AS source FROM lines GROUP BY ALL)
SELECT doc_id, string_agg(@piece, chr(10) ORDER BY batch) AS text FROM batches WHERE NOT regexp_matches(source, '^[\p{Nd} \t\n\f\r]*$') GROUP BY doc_id"""


@query(_TXT.replace("@piece", "source || chr(10) || '[offline]' || source"))
def txt_bilingual(spark, sf_dir):
    return _txt(spark, sf_dir, single=False)


@query(_TXT.replace("@piece", "'[offline]' || source"))
def txt_single(spark, sf_dir):
    return _txt(spark, sf_dir, single=True)


def _greedy(limit: int, items: str, tail: str) -> str:
    full = f"(w.n > 0 AND (w.s + t.c >= {limit} OR {items}))"
    return (
        _LINES.replace("WITH", "WITH RECURSIVE")
        + f""", t AS (SELECT doc_id, line_no, CAST(length(line) AS BIGINT) AS c FROM lines),
w(doc_id, line_no, c, batch, after_batch, s, n) AS (
  SELECT DISTINCT doc_id, -1, CAST(0 AS BIGINT), 0, 0, CAST(0 AS BIGINT), 0 FROM t
  UNION ALL
  SELECT t.doc_id, t.line_no, t.c, w.after_batch + CASE WHEN w.n > 0 AND (t.c >= {limit} OR {full}) THEN 1 ELSE 0 END,
         w.after_batch + CASE WHEN w.n > 0 AND (t.c >= {limit} OR {full}) THEN 1 ELSE 0 END + CASE WHEN t.c >= {limit} THEN 1 ELSE 0 END,
         CASE WHEN t.c >= {limit} THEN 0 WHEN {full} THEN t.c ELSE w.s + t.c END, CASE WHEN t.c >= {limit} THEN 0 WHEN {full} THEN 1 ELSE w.n + 1 END
  FROM w JOIN t ON t.doc_id = w.doc_id AND t.line_no = w.line_no + 1),
p AS (SELECT doc_id, line_no, c, batch FROM w WHERE line_no >= 0)
"""
        + tail
    )


_BATCHES = "SELECT doc_id, batch, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars FROM p GROUP BY doc_id, batch"


@query(_greedy(2000, "w.n >= 10", _BATCHES))
def greedy_char_pack(spark, sf_dir):
    return sequence.pack_lines(_docs(spark, sf_dir), 2000, 10).groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(_greedy(1200, "false", _BATCHES))
def greedy_token_pack(spark, sf_dir):
    return sequence.pack_lines(_docs(spark, sf_dir), 1200).groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(_greedy(200, "false", "SELECT c >= 200 AS oversize, count(DISTINCT (doc_id, batch)) AS batches, count(*) AS n FROM p GROUP BY 1"))
def oversize_isolation(spark, sf_dir):
    rows = sequence.pack_lines(_docs(spark, sf_dir), 200)
    return rows.groupBy((F.col("chars") >= 200).alias("oversize")).agg(F.countDistinct("doc_id", "batch").alias("batches"), F.count("*").alias("n"))


@query(
    _LINES
    + """, f AS (SELECT doc_id, line_no, length(line) AS c, length(line) < 70 AS short FROM lines),
i AS (SELECT *, sum(CASE WHEN short IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, lag(short) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM f))
SELECT doc_id, min(line_no) AS first, count(*) AS n, CAST(median(c) AS DOUBLE) AS median FROM i WHERE short GROUP BY doc_id, run HAVING count(*) >= 3"""
)
def poetry_runs(spark, sf_dir):
    rows = sequence.lines(_docs(spark, sf_dir)).select("doc_id", "line_no", F.length("line").alias("c"), (F.length("line") < 70).alias("short"))
    rows = rows.withColumn("prev", F.lag("short").over(Window.partitionBy("doc_id").orderBy("line_no")))
    rows = sequence.islands(rows, ["doc_id"], ["line_no"], F.col("short") != F.col("prev"), "run")
    return rows.filter("short").groupBy("doc_id", "run").agg(F.min("line_no").alias("first"), F.count("*").alias("n"), F.median("c").alias("median")).filter("n >= 3").drop("run")


def _stanzas(spark, sf_dir) -> DataFrame:
    return sequence.stanzas(html.page_units(table(spark, sf_dir, "pages")), group_size=4)


def _stanza_sql(tail: str) -> str:
    from lectern import queries_html

    # in these pages a run has one signature, so heads never mark stanzas; the parents' siblings do count
    return queries_html._sql(
        queries_html._PARTS.replace("anc[place].ord AS owner,", "anc[place].ord AS owner, anc[place - 1].ord AS parent, anc[place - 2].ord AS grandparent, anc[place - 1].tag || CASE WHEN anc[place - 1].cls <> '' THEN '.' || anc[place - 1].cls ELSE '' END AS psig,").replace("GROUP BY page_id, owner, signature HAVING", "GROUP BY page_id, owner, signature, parent, grandparent, psig HAVING").replace("SELECT page_id, owner, signature, min(ord)", "SELECT page_id, owner, signature, parent, grandparent, psig, min(ord)")
        + """, lagged AS (SELECT *, split_part(signature, '.', 1) AS tag, lag(split_part(signature, '.', 1)) OVER o AS ltag, lag(parent) OVER o AS lparent, lag(grandparent) OVER o AS lgrand, lag(psig) OVER o AS lpsig FROM units WINDOW o AS (PARTITION BY page_id ORDER BY unit_ord)),
run AS (SELECT *, parent IS DISTINCT FROM lparent AS new_parent, sum(CASE WHEN tag = ltag AND (parent IS NOT DISTINCT FROM lparent OR (psig IS NOT DISTINCT FROM lpsig AND grandparent IS NOT DISTINCT FROM lgrand)) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY unit_ord) AS run FROM lagged),
meas AS (SELECT page_id, run, count(*) >= 3 AND median(chars) < 70 AS poetry, min(unit_ord) AS head FROM run GROUP BY page_id, run),
part AS (SELECT r.*, poetry, sum(CASE WHEN unit_ord = head OR new_parent THEN 1 ELSE 0 END) OVER (PARTITION BY r.page_id, r.run ORDER BY unit_ord) AS part FROM run r JOIN meas m ON m.page_id = r.page_id AND m.run = r.run),
win AS (SELECT *, (row_number() OVER (PARTITION BY page_id, run, part ORDER BY unit_ord) - 1) // 4 AS win FROM part),
grp AS (SELECT page_id, unit_ord, chars, poetry, CASE WHEN poetry THEN min(unit_ord) OVER (PARTITION BY page_id, run, part, win) ELSE unit_ord END AS first FROM win)
"""
        + tail
    )


@query(_stanza_sql("SELECT page_id, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY first) - 1 AS INTEGER) AS stanza, n, chars FROM (SELECT page_id, first, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM grp WHERE poetry GROUP BY page_id, first)"))
def stanza_windows(spark, sf_dir):
    return _stanzas(spark, sf_dir).filter("poetry").groupBy("page_id", "stanza").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(_stanza_sql("SELECT page_id, unit_ord, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY first) - 1 AS INTEGER) AS batch FROM grp"))
def plan_batch_index(spark, sf_dir):
    return sequence.batch_index(_stanzas(spark, sf_dir)).select("page_id", "unit_ord", "batch")


@query(_LINES + "SELECT doc_id, line_no, 'epub:' || doc_id || ':doc.xhtml:' || line_no || ':' || sha256(line)[1:16] AS job_id FROM lines")
def job_ids(spark, sf_dir):
    return sequence.lines(_docs(spark, sf_dir)).select("doc_id", "line_no", T.job_id(F.col("doc_id"), F.lit("doc.xhtml"), F.col("line_no"), F.col("line")).alias("job_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id < (SELECT CAST(round(0.75 * max(doc_id)) AS BIGINT) FROM documents)")
def completed_prefix(spark, sf_dir):
    """Three quarters are done, and of the rest every second one."""
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    gap = docs.agg(F.round(0.75 * F.max("doc_id")).cast("long")).first()[0] or 0
    return sequence.completed_prefix(docs, "doc_id", (F.col("doc_id") < gap) | ((F.col("doc_id") - gap) % 2 == 1))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sha256('[offline]' || text) END AS translation, doc_id % 3 = 0 AS pending FROM documents")
def resume_left_join(spark, sf_dir):
    """The whole translations of the jobs that are done, by digest."""
    jobs = _docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("job"), "text")
    done = jobs.filter("doc_id % 3 != 0").select("doc_id", "job", F.sha2(enrich.offline(F.col("text")).cast("binary"), 256).alias("translation"))
    out = resume.resumed(jobs.select("doc_id", "job"), done, ["doc_id", "job"])
    return out.select("doc_id", "translation", "pending")


@query("SELECT count(*) AS checked, count(*) FILTER (doc_id % 50 = 7) AS mismatches FROM documents")
def checkpoint_prefix_check(spark, sf_dir):
    jobs = _docs(spark, sf_dir).select("doc_id", T.job_id(F.col("doc_id"), F.col("source"), F.lit(0), F.col("text")).alias("job"))
    saved = jobs.select("doc_id", F.when(F.col("doc_id") % 50 == 7, "changed").otherwise(F.col("job")).alias("job"))
    return resume.prefix_check(saved, jobs, "doc_id", "job")


@query("SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def rolling_context(spark, sf_dir):
    rows = sequence.rolling_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"))
    return rows.select("conv_id", "turn", F.array_join("context", "|").alias("context"))


@query(
    """WITH RECURSIVE m AS (SELECT conv_id, 2 * count(*) AS n FROM conversations GROUP BY conv_id),
w(conv_id, i, kept) AS (SELECT conv_id, 0, 0 FROM m UNION ALL SELECT w.conv_id, i + 1, CASE WHEN kept + 1 > 10 THEN 8 ELSE kept + 1 END FROM w JOIN m ON m.conv_id = w.conv_id WHERE i < n)
SELECT conv_id, i, kept FROM w WHERE i > 0"""
)
def chat_history_trim(spark, sf_dir):
    """Two messages a turn."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((2 * F.count("*")).cast("int").alias("n"))
    return n.select("conv_id", F.posexplode(sequence.history_sizes(F.col("n"))).alias("i", "kept")).select("conv_id", (F.col("i") + 1).alias("i"), F.col("kept").cast("int").alias("kept"))


@query(
    """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, len(list_filter(string_split(text, ' '), lambda x: x <> '')) >= 100 AS is_long FROM documents),
r AS (SELECT *, (pos // 20) * 20 AS refresh FROM d),
x AS (SELECT r.source, r.doc_id, l.doc_id AS seen, row_number() OVER (PARTITION BY r.source, r.doc_id ORDER BY l.pos DESC) AS nth FROM r JOIN d l ON l.source = r.source AND l.is_long AND l.pos < r.refresh),
s AS (SELECT source, doc_id, string_agg(CAST(seen AS VARCHAR), ',' ORDER BY nth) AS seen FROM x WHERE nth <= 3 GROUP BY ALL HAVING count(*) = 3)
SELECT r.doc_id, coalesce(s.seen, '') AS seen FROM r LEFT JOIN s ON s.source = r.source AND s.doc_id = r.doc_id"""
)
def long_paragraph_lookback(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("source", "doc_id", (F.size(F.filter(F.split("text", " "), lambda x: x != "")) >= 100).alias("is_long_text"))
    out = sequence.lookback(docs, "source", "doc_id", F.col("is_long_text"), every=20)
    return out.select("doc_id", F.coalesce(F.array_join(F.transform("seen", lambda x: x.cast("string")), ","), F.lit("")).alias("seen"))


@query(
    """SELECT conv_id, turn, 'system:translate' || CASE WHEN p IS NULL THEN '' ELSE '|user:' || p || '|assistant:[offline]' || p END || '|user:' || text AS messages
FROM (SELECT *, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS p FROM conversations)"""
)
def message_assembly(spark, sf_dir):
    rows = sequence.rolling_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), 2)
    before = F.array_join("context", " ")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    pair = F.when(F.size("context") > 0, F.array(message("user", before), message("assistant", enrich.offline(before))))
    messages = F.concat(F.array(message("system", F.lit("translate"))), F.coalesce(pair, F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", F.col("text"))))
    return rows.select("conv_id", "turn", F.array_join(F.transform(messages, lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("messages"))


@query(
    """WITH m AS (SELECT i AS batch, i * 400 AS lo, (i + 1) * 400 AS hi FROM range(0, 1 + (SELECT max(doc_id) FROM documents) // 400) r(i))
SELECT batch, count(*) AS n, min(doc_id) AS first FROM documents JOIN m ON doc_id >= lo AND doc_id < hi GROUP BY batch"""
)
def batch_manifest_range_join(spark, sf_dir):
    """Ranges of equal width: the range join is an equi-join on the quotient."""
    docs = _docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 400).alias("batch"))
    manifest = docs.select("batch").distinct().withColumn("lo", F.col("batch") * 400).withColumn("hi", (F.col("batch") + 1) * 400)
    return docs.join(manifest, "batch").filter("doc_id >= lo and doc_id < hi").groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT d.doc_id, 'book-' || d.doc_id AS custom_id, l.quality FROM documents d JOIN labels l ON 'book-' || d.doc_id = 'book-' || l.doc_id")
def custom_id_lookup(spark, sf_dir):
    results = table(spark, sf_dir, "labels").select(F.concat(F.lit("book-"), F.col("doc_id").cast("string")).alias("custom_id"), "quality")
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("book-"), F.col("doc_id").cast("string")).alias("custom_id"))
    return rows.join(results, "custom_id").select("doc_id", "custom_id", "quality")


@query(_LINES + "SELECT doc_id, line_no, CASE WHEN trim(line, E' \\t\\n\\f\\r') = '' THEN line ELSE '[offline]' || line END AS text FROM lines")
def restore_empty_positions(spark, sf_dir):
    rows = sequence.lines(_docs(spark, sf_dir))
    done = rows.filter(T.strip(F.col("line")) != "").select("doc_id", "line_no", enrich.offline(F.col("line")).alias("done"))
    return rows.join(done, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("done", "line").alias("text"))


@query(_LINES + "SELECT line_no % 3 AS key, count(*) AS n FROM lines GROUP BY 1")
def round_robin_keys(spark, sf_dir):
    return sequence.lines(_docs(spark, sf_dir)).groupBy((F.col("line_no") % 3).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' ELSE upper(lang[1]) || lower(lang[2:]) END AS name, count(*) AS n FROM documents GROUP BY 1, 2")
def language_dim_join(spark, sf_dir):
    dim = spark.createDataFrame(list(languages.LANGUAGES.items()), "lang string, name string")
    rows = _docs(spark, sf_dir).join(F.broadcast(dim), "lang", "left")  # a fixed table
    return rows.groupBy("lang", F.coalesce("name", F.initcap("lang")).alias("name")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE s AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, row_number() OVER (ORDER BY source) AS i FROM documents GROUP BY source),
share AS (SELECT greatest(1, CAST(sum(chars) AS BIGINT) // 4) AS share FROM s),
w(i, source, chars, section, used) AS (
  SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT)
  UNION ALL
  SELECT s.i, s.source, s.chars, w.section + CASE WHEN w.used > 0 AND w.used + s.chars >= share THEN 1 ELSE 0 END, CASE WHEN w.used > 0 AND w.used + s.chars >= share THEN s.chars ELSE w.used + s.chars END
  FROM w JOIN s ON s.i = w.i + 1, share)
SELECT section, count(*) AS sources, CAST(sum(chars) AS BIGINT) AS chars FROM w WHERE i > 0 GROUP BY section"""
)
def section_share_packing(spark, sf_dir):
    """Sections (sources here) in order, packed to the share of one of four workers."""
    s = _docs(spark, sf_dir).groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    whole = s.agg(F.array_sort(F.collect_list(F.struct("source", "chars"))).alias("all"), F.greatest(F.lit(1), F.floor(F.sum("chars") / 4)).alias("share"))  # a row a source

    def step(st: Column, x: Column) -> Column:
        full = (st["used"] > 0) & (st["used"] + x["chars"] >= st["share"])
        section = st["section"] + F.when(full, 1).otherwise(0)
        return F.struct(section.alias("section"), F.when(full, x["chars"]).otherwise(st["used"] + x["chars"]).alias("used"), st["share"].alias("share"), F.concat(st["out"], F.array(section)).alias("out"))

    zero = F.struct(F.lit(0).alias("section"), F.lit(0).cast("long").alias("used"), F.col("share").alias("share"), F.array().cast("array<int>").alias("out"))
    sections = whole.select("all", F.aggregate("all", zero, step, lambda st: st["out"]).alias("sections"))
    rows = sections.select(F.explode(F.arrays_zip("all", "sections")).alias("x")).select(F.col("x.sections").alias("section"), F.col("x.all.chars").alias("chars"))
    return rows.groupBy("section").agg(F.count("*").alias("sources"), F.sum("chars").alias("chars"))


@query("SELECT source AS signature, CAST((row_number() OVER (ORDER BY sum(length(text)) DESC, source) - 1) // 12 AS INTEGER) AS page FROM documents GROUP BY source")
def classifier_pages(spark, sf_dir):
    rows = _docs(spark, sf_dir).groupBy(F.col("source").alias("signature")).agg(F.sum(F.length("text")).alias("chars"))
    return enrich.classify_pages(rows).select("signature", "page")


@query(
    """SELECT * FROM (VALUES ('p', 'translate', 'translate', true), ('div.head', 'skip', 'llm-skip', true), ('span.n', 'unsure', 'translate', false), ('td', 'unsure', 'translate', true), ('li', 'unsure', 'translate', false)) v(signature, verdict, action, answered)"""
)
def verdict_lint(spark, sf_dir):
    asked = spark.createDataFrame([(s,) for s in ("p", "div.head", "span.n", "td", "li")], "signature string")
    replies = spark.createDataFrame([("p", "translate"), ("div.head", "SKIP"), ("span.n", "remove"), ("td", "unsure"), ("other", "skip")], "signature string, verdict string")
    return enrich.lint_verdicts(asked, replies)


@query(
    _LINES
    + """, a AS (SELECT *, max(contains(line, 'the')) OVER (PARTITION BY doc_id ORDER BY line_no) AS started FROM lines),
b AS (SELECT *, coalesce(max(started AND contains(line, 'was')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM a)
SELECT doc_id, line_no, line FROM b WHERE started AND NOT ended"""
)
def retranslate_range(spark, sf_dir):
    return sequence.range_filter(sequence.lines(_docs(spark, sf_dir)), "doc_id", "line_no", F.contains("line", F.lit("the")), F.contains("line", F.lit("was")))


@query()
def extract_paragraph_ladder(spark, sf_dir):
    replies = [("(1) one (2) two", 2), ("(2) two\n(1) one", 2), ("one\n\n@@\n\ntwo", 2), ("one\n\ntwo", 2), ("one", 2)]
    return spark.createDataFrame([(i, n, "|".join(enrich.extract_paragraphs(r, n))) for i, (r, n) in enumerate(replies)], "id int, n int, paragraphs string")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n, sha256(list_aggregate(list_transform(string_split(text, chr(10)), lambda x: '[offline]' || x), 'string_agg', chr(10))) AS translated FROM documents")
def enrich_offline(spark, sf_dir):
    """Batches through the translator protocol: one list of lines a document; all translated lines by digest."""
    batches = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("texts"))
    done = enrich.enrich(batches)
    return done.select("doc_id", F.size("translated").cast("long").alias("n"), F.sha2(F.array_join("translated", "\n").cast("binary"), 256).alias("translated"))
