"""The plan of a book: signatures, coverage, candidates for review, overrides."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T

# What a plan may say of a signature, and the samples that it carries.
ACTIONS = ("translate", "skip", "llm-skip", "force-translate")
SAMPLES, FIRST_TEXTS, PLAN_VERSION = 5, 50, 3
#: Signatures in doubt are smaller than this share, and shorter than this mean or less varied than this ratio.
DOUBT_PERCENT, DOUBT_MEAN, DOUBT_UNIQUE = 10.0, 50, 0.5


def _in_order(units: DataFrame) -> Column:
    return F.array_sort(F.collect_list(F.struct("page_id", "unit_ord", "text")))


def signature_rows(units: DataFrame) -> DataFrame:
    """signature, units, chars, first (page and ordinal of its first unit), samples (distinct, first-seen order, clipped)."""
    # one row a distinct text, known by its digest: what is shuffled are samples, not texts
    at = F.min(F.struct("page_id", "unit_ord", T.clip(F.col("text")).alias("sample"))).alias("at")
    distinct = units.groupBy("signature", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), at)
    rank = Window.partitionBy("signature").orderBy("at")  # cut to SAMPLES rows before the shuffle
    samples = distinct.withColumn("nth", F.row_number().over(rank)).filter(F.col("nth") <= SAMPLES)
    samples = samples.groupBy("signature").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "at.sample"))), lambda x: x["sample"]).alias("samples"))
    first = F.min(F.struct("at.page_id", "at.unit_ord")).alias("first")
    return distinct.groupBy("signature").agg(F.sum("n").alias("units"), F.sum("chars").alias("chars"), first).join(samples, "signature")


def coverage(parts: DataFrame) -> DataFrame:
    """total_chars, translate_chars, coverage (1 if there is no text)."""
    kept = F.sum(F.when(F.col("reason").isNull(), F.col("chars")).otherwise(0))
    out = parts.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"), F.coalesce(kept, F.lit(0)).alias("translate_chars"))
    return out.withColumn("coverage", F.when(F.col("total_chars") == 0, 1.0).otherwise(F.col("translate_chars") / F.col("total_chars")))


def check_coverage(parts: DataFrame, least: float = 0.5) -> None:
    """Fails on a plan without text or with too little of it to translate."""
    row = coverage(parts).first()
    if not row["total_chars"]:
        raise ValueError("the plan is empty")
    if row["coverage"] < least:
        raise ValueError(f"the plan covers {row['coverage']:.0%} of the text; {least:.0%} is asked for")


def override(units: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units that stay, and reason, chars of those that actions (signature, action) skip."""
    joined = units.join(actions, "signature", "left")  # Spark broadcasts actions if they are small
    out = F.coalesce(F.col("action").isin("skip", "llm-skip"), F.lit(False))
    gone = joined.filter(out).groupBy(F.when(F.col("action") == "skip", "user-excluded").otherwise("llm-excluded").alias("reason")).agg(F.sum("chars").alias("chars"))
    return joined.filter(~out).drop("action"), gone


def candidates(units: DataFrame, total_chars: Column | int) -> DataFrame:
    """Signatures in doubt: signature, units, chars, samples (evenly spaced among its first distinct texts).

    units may have a column poetry; signatures of verse are never in doubt, nor are headings.
    """
    verse = F.max("poetry") if "poetry" in units.columns else F.lit(False)
    rank = Window.partitionBy("signature").orderBy("page_id", "unit_ord")
    firsts = units.withColumn("nth", F.row_number().over(rank)).filter(F.col("nth") <= FIRST_TEXTS).groupBy("signature").agg(F.transform(_in_order(units), lambda x: x["text"]).alias("texts"))
    rows = units.groupBy("signature").agg(F.count("*").alias("units"), F.sum("chars").alias("chars"), verse.alias("verse"))
    rows = rows.join(firsts, "signature").withColumn("uniq", F.array_distinct("texts"))
    heading = F.element_at(F.split("signature", r"\."), 1).isin(*K.HEADINGS)
    sure = (F.col("chars") / F.col("units") > DOUBT_MEAN) & (F.size("uniq") / F.size("texts") > DOUBT_UNIQUE)
    step = F.greatest(F.lit(1), F.floor(F.size("uniq") / SAMPLES)).cast("int")
    rows = rows.withColumn("step", step).filter(~F.coalesce("verse", F.lit(False)) & ~heading & (100 * F.col("chars") / total_chars < DOUBT_PERCENT) & ~sure)
    samples = F.slice(F.filter("uniq", lambda x, i: i % F.col("step") == 0), 1, SAMPLES)
    return rows.select("signature", "units", "chars", F.transform(samples, lambda x: T.clip(x)).alias("samples"))


def report(rows: DataFrame, top: int = 25) -> DataFrame:
    """nth, signature, units, chars of the largest signatures, and one row (nth 0) for the rest together."""
    order = Window.orderBy(F.col("chars").desc(), "first")  # a row a signature
    ranked = rows.withColumn("nth", F.row_number().over(order))
    rest = ranked.filter(F.col("nth") > top).agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("chars").alias("chars")).filter("n > 0")
    return ranked.filter(F.col("nth") <= top).select("nth", "signature", "units", "chars").unionByName(rest.select(F.lit(0).alias("nth"), F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" more")).alias("signature"), "units", "chars"))


def plan_json(rows: DataFrame, parts: DataFrame, skipped: DataFrame, book: bytes, excluded=K.EXCLUDED_TAGS, group_size: int = 8) -> str:
    """The plan as JSON, bound to the book's bytes. Signatures and reasons are few."""
    total = coverage(parts).first()
    found = rows.orderBy(F.col("chars").desc(), "first").collect()
    signatures = [
        {"signature": r["signature"], "units": r["units"], "chars": r["chars"], "samples": r["samples"], "pct": round(100 * r["chars"] / (total["total_chars"] or 1), 1), "mean_chars": round(r["chars"] / r["units"], 1), "action": "translate", "decided_by": "default", "sample": (r["samples"] or [""])[0][:60]}
        for r in found
    ]
    return json.dumps(
        {
            "schema_version": PLAN_VERSION, "coverage": total["coverage"], "total_chars": total["total_chars"], "translate_chars": total["translate_chars"],
            "skipped": {r["reason"]: r["chars"] for r in skipped.collect()}, "exclude_tags": list(excluded), "poetry_group_size": group_size, "signatures": signatures, "book_sha256": sha256(book).hexdigest(),
        },
        ensure_ascii=False,
    )


def load_overrides(plan: str, book: bytes) -> dict[str, str]:
    """The actions of a plan that are not to translate, by signature; fails on another book, unknown or missing actions."""
    data = json.loads(plan)
    if data.get("book_sha256") not in (None, sha256(book).hexdigest()):
        raise ValueError("the plan belongs to another book")
    rows = data.get("signatures")
    if not isinstance(rows, list):
        raise ValueError("the plan has no signatures")
    wrong = [r.get("signature") for r in rows if r.get("action") is not None and r["action"] not in ACTIONS]
    open_ = [r.get("signature") for r in rows if r.get("action") is None]
    if wrong or open_:
        raise ValueError(f"unknown actions for {wrong}; no action for {open_}")
    return {r["signature"]: r["action"] for r in rows if r["action"] in ("skip", "llm-skip")}


def fingerprint(settings: dict) -> str:
    """SHA-256 of settings as JSON with sorted keys."""
    return sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
