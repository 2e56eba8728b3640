"""Resuming: saved states, checks of their order, recovery of what is done, splices of what is done again.

A saved state is a table of jobs with their results. It is joined by key, so it may hold any part of the
jobs in any order; only a recovered book goes by the prefix that is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load_state(text: Column) -> Column:
    """The strings of a saved state: a JSON list, or lines if it is no JSON; an error if it is JSON but no list."""
    parsed = F.try_parse_json(text)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", ""), "\n")
    return F.when(parsed.isNull(), lines).when(is_list, F.from_json(text, "array<string>")).otherwise(F.raise_error(F.lit("the saved state is no list")).cast("array<string>"))


def resumed(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """jobs with the columns of done where it has them, and pending; a key that done repeats counts once (any of its rows)."""
    out = jobs.join(done.dropDuplicates(keys).withColumn("pending", F.lit(False)), keys, "left")
    return out.withColumn("pending", F.coalesce("pending", F.lit(True)))


def prefix_check(saved: DataFrame, jobs: DataFrame, order: str, job: str) -> DataFrame:
    """checked, mismatches: rows of saved (order, job), and those whose place has another job now, or none."""
    now = jobs.select(order, F.col(job).alias("now"))
    differs = ~F.col(job).eqNullSafe(F.col("now"))
    return saved.select(order, job).join(now, order, "left").agg(F.count("*").alias("checked"), F.count_if(differs).alias("mismatches"))


def require_prefix(saved: DataFrame, jobs: DataFrame, order: str, job: str) -> None:
    """Fails on a state of other jobs."""
    row = prefix_check(saved, jobs, order, job).first()
    if row["mismatches"]:
        raise ValueError(f"{row['mismatches']} of {row['checked']} saved jobs are not at their place")


def require_same_plan(saved: str | None, current: str) -> None:
    """Fails on a state whose plan has another fingerprint; one without any is accepted."""
    if saved is not None and saved != current:
        raise ValueError("the saved state belongs to another plan")


def in_order(rows: DataFrame, by: str, order: str, first: int = 0) -> DataFrame:
    """Of rows that came in any order those that follow each other from `first` on; what comes after a gap waits."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1 + first
    return rows.withColumn("_place", place).filter(F.col("_place") == F.col(order)).drop("_place")


def recovered(jobs: DataFrame, done: DataFrame, by: str, order: str, text: str, result: str) -> DataFrame:
    """jobs with `result` for the rows of each book up to the first that is not done, and null from there on."""
    out = jobs.join(done.select(by, order, result), [by, order], "left")
    open_before = F.max(F.col(result).isNull()).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.select(by, order, text, F.when(~open_before, F.col(result)).alias(result))


def spliced(rows: DataFrame, again: DataFrame, by: str, order: str, span: DataFrame) -> DataFrame:
    """rows without those between low and high of `span` (by, low, high; a row a book), in their place the rows of `again`, renumbered from 0."""
    of = span.select(by, "low", "high")
    base = rows.join(of, by, "left")
    base = base.filter(F.col("low").isNull() | ~F.col(order).between(F.col("low"), F.col("high")))
    base = base.select(*rows.columns, F.col(order).alias("_at"), F.lit(0).alias("_new"))
    new = again.join(of, by).select(*rows.columns, F.col("low").alias("_at"), F.lit(1).alias("_new"))
    place = Window.partitionBy(by).orderBy("_at", "_new", order)
    return base.unionByName(new).withColumn(order, F.row_number().over(place) - 1).drop("_at", "_new")
