"""Subtitles: cues as rows, packing, and checking of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip

#: Characters of a pack at most.
MOST_CHARS = 512


def cues(texts: DataFrame) -> DataFrame:
    """doc_id, cue, number, time, text of texts (doc_id, text); parts are those between blank lines."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t\r\f\n]*\n"), strip), lambda x: x != "")
    rows = texts.select("doc_id", F.posexplode(parts).alias("cue", "part")).withColumn("lines", F.split("part", r"\r?\n"))
    body = F.array_join(F.slice("lines", F.lit(3), F.size("lines")), "\n")
    return rows.select("doc_id", "cue", F.trim(F.get("lines", 0)).alias("number"), F.trim(F.get("lines", 1)).alias("time"), strip(body).alias("text"))


def source_text() -> Column:
    """What a translator sees of a cue."""
    return F.concat_ws("\n", "number", "text")


def packs(cue_rows: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """doc_id, pack, first, last (exclusive), text: cues joined while the text stays below `most` characters without the joints."""
    most = min(most, MOST_CHARS)
    of = cue_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cue", source_text().alias("text")))).alias("cues"))

    def step(s: Column, x: Column) -> Column:
        joins = F.length(s["text"]) + F.length(x["text"]) < most
        text = F.when(s["text"] == "", x["text"]).otherwise(F.concat(s["text"], F.lit("\n\n"), x["text"]))
        done = F.when(s["text"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), x["cue"].alias("last"), s["text"].alias("text")))))
        return F.struct(F.when(joins, text).otherwise(x["text"]).alias("text"), F.when(joins, s["first"]).otherwise(x["cue"]).alias("first"), F.when(joins, s["out"]).otherwise(done).alias("out"))

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), F.size("cues").alias("last"), s["text"].alias("text"))))

    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,last:int,text:string>>").alias("out"))
    return of.select("doc_id", F.posexplode(F.aggregate("cues", zero, step, finish)).alias("pack", "p")).select("doc_id", "pack", "p.first", "p.last", "p.text")


def reply_cues(reply: Column) -> Column:
    """number and text of each part of a reply."""
    parts = F.filter(F.split(strip(reply), "\n\n"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.trim(F.element_at(F.split(x, "\n"), 1)).alias("number"), F.array_join(F.slice(F.split(x, "\n"), 2, 1_000_000), "\n").alias("text")))


def numbers_match(reply: Column, numbers: Column) -> Column:
    """Whether a reply has the cues of an array of numbers, in their order."""
    return F.transform(reply_cues(reply), lambda x: x["number"].try_cast("int")) == F.transform(numbers, lambda x: x.try_cast("int"))


def rendered(cue_rows: DataFrame, translation: str, single: bool = False) -> DataFrame:
    """doc_id, text: the subtitles with the column `translation` after or instead of each cue's text."""
    body = F.concat_ws("\n", "number", "time", *([] if single else ["text"]), translation)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", body.alias("body")))), lambda x: x["body"]), "\n\n")
    return cue_rows.groupBy("doc_id").agg(whole.alias("text"))
