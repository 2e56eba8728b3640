"""python -m lectern --book a.epub --out done: a book, or many by a pattern, translated with the registered translator."""

from __future__ import annotations

import os
import posixpath
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import enrich, lists, markdown, sequence, subtitles
from lectern.options import Options, from_args
from lectern.plans import prepare, translation
from lectern.session import local_session
from lectern.sources import archive, books


def _save(rows: DataFrame, folder: str, suffix: str) -> list[str]:
    """Writes rows (book, content) as files named after the books; returns their paths."""
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = pafs.FileSystem.from_uri(uri)
        fs.create_dir(at, recursive=True)
        for frame in frames:
            names = []
            for book, content in zip(frame["book"], frame["content"]):
                stem = posixpath.splitext(posixpath.basename(book))[0]
                with fs.open_output_stream(f"{at}/{stem}_{suffix}{posixpath.splitext(book)[1]}") as f:
                    f.write(bytes(content))
                names.append(f"{folder}/{stem}_{suffix}{posixpath.splitext(book)[1]}")
            yield pd.DataFrame({"path": names})

    return sorted(r[0] for r in rows.mapInPandas(run, "path string").collect())  # a name a book


def pages_of(spark: SparkSession, o: Options) -> DataFrame:
    """book, name, page_id, html, sheets, translate of the documents of archives."""
    parts = books.read_epub(spark, o.book)
    html = F.decode("content", "UTF-8")
    documents = parts.filter(F.col("media_type") == books.DOCUMENT).select("book", "name", html.alias("html"))
    sheets = parts.filter(F.col("media_type") == books.STYLESHEET).select("book", F.col("name").alias("path"), F.col("item").alias("at"), html.alias("css"))
    rows = archive.sheets_of(documents, sheets).withColumn("page_id", F.xxhash64("book", "name"))
    return lists.choose_files(rows, "name", o.only_files, o.exclude_files)


def run_archives(spark: SparkSession, o: Options) -> list[str]:
    pages = pages_of(spark, o)
    chosen = pages.filter("translate")
    plan = prepare.prepare(chosen, least=o.min_coverage, excluded=tuple(o.exclude_tags), sheets="sheets")
    if o.dry_run:
        return [f"{r['signature']}: {r['units']} units, {r['chars']} characters" for r in translation.report(plan.rows).orderBy("nth").collect()]
    if o.limit():
        first = plan.units.orderBy("page_id", "unit_ord").limit(o.limit())
        plan.units = first
    done = spark.read.parquet(o.resume) if o.resume else None
    new = prepare.bilingual(chosen.select("page_id", "html"), plan, o.translator, done, o.css(), o.single)
    parts = chosen.select("book", "name", "page_id").join(new, "page_id").select("book", "name", F.encode("html", "UTF-8").alias("content"))
    whole = spark.read.format("binaryFile").load(o.book).select(F.col("path").alias("book"), "content")
    return _save(archive.rebuild_books(whole, parts, o.language, "single" if o.single else "bilingual"), o.out, "bilingual")


def run_texts(spark: SparkSession, o: Options, kind: str) -> list[str]:
    whole = spark.read.text(o.book, wholetext=True).select(F.input_file_name().alias("book"), F.col("value").alias("text")).withColumn("doc_id", F.xxhash64("book"))
    if kind == "subtitles":
        cues = subtitles.cues(whole)
        of = cues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cue", "text"))).alias("c"))
        done = enrich.enrich(of.select("doc_id", F.col("c.cue").alias("cues"), F.col("c.text").alias("texts")), o.translator)
        done = done.select("doc_id", F.explode(F.arrays_zip("cues", "translated")).alias("x")).select("doc_id", F.col("x.cues").alias("cue"), F.col("x.translated").alias("done"))
        out = subtitles.rendered(cues.join(done, ["doc_id", "cue"]), "done", o.single)
    else:
        if kind == "markdown":
            rows = markdown.block_table(whole).select("doc_id", F.col("block_no").alias("line_no"), F.col("text").alias("line"), "translatable")
        else:
            rows = sequence.lines(whole).withColumn("translatable", F.trim("line") != "")
        if o.limit():
            rows = rows.withColumn("translatable", F.col("translatable") & (F.col("line_no") < o.limit()))
        of = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "translatable"))).alias("l"))
        texts = F.transform(F.col("l"), lambda x: F.when(x["translatable"], x["line"]).otherwise(""))
        done = enrich.enrich(of.select("doc_id", F.col("l.line").alias("lines"), texts.alias("texts")), o.translator)
        pair = F.zip_with("lines", "translated", lambda a, b: F.when(b == "", a).otherwise(b if o.single else F.concat(a, F.lit("\n" if kind == "text" else "\n\n"), b)))
        out = done.select("doc_id", F.array_join(pair, "\n" if kind == "text" else "\n\n").alias("text"))
    return _save(out.select("doc_id", F.col("text").alias("new")).join(whole.select("doc_id", "book"), "doc_id").select("book", F.encode("new", "UTF-8").alias("content")), o.out, "bilingual")


def run(spark: SparkSession, o: Options) -> list[str]:
    """The paths of what was written, or the lines of a plan."""
    kind = books.format_of(o.book)
    if kind == "pdf":
        raise ValueError("texts of this format come from an extractor: see sources.archive.read_pdf")
    return list(run_archives(spark, o) if kind == "epub" else run_texts(spark, o, kind))


def main(args: list[str] | None = None) -> None:
    o = from_args(sys.argv[1:] if args is None else args)
    said = run(SparkSession.getActiveSession() or local_session(), o)
    if not o.quiet:
        print("\n".join(said))


if __name__ == "__main__":
    main()
