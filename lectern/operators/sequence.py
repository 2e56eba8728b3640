"""Operators on ordered rows: batches, packing, runs, stanzas, rolling context, prefixes.

Every relation carries its order as a column. Windows are partitioned by the document, page or
conversation; an order over everything is had from an aggregate instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch

# Verse is runs of at least so many short units, in windows of so many.
VERSE_RUN, VERSE_MEDIAN, STANZA, HEAD_SHARE = 3, 70, 8, 0.4
# A chat history above the first number is cut to the second.
HISTORY_FULL, HISTORY_KEPT = 10, 8


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of each line of text."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def fixed_batches(rows: DataFrame, by: list[str], order: str, size: int = 10) -> DataFrame:
    """rows with batch: so many rows each, in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("int"))


def packed(sizes: Column, limit: int, max_items: int | None = None) -> Column:
    """Batch of each of an array of sizes, greedily: a new one when the sum would reach the limit; a size that does so alone is alone."""

    def step(s: Column, x: Column) -> Column:
        over = x >= limit
        full = (s["n"] > 0) & ((s["sum"] + x >= limit) | (F.lit(False) if max_items is None else s["n"] >= max_items))
        batch = s["batch"] + F.when((s["n"] > 0) & (full | over), 1).otherwise(0)
        return F.struct(
            (batch + F.when(over, 1).otherwise(0)).cast("int").alias("batch"),
            F.when(over, 0).when(full, x).otherwise(s["sum"] + x).cast("long").alias("sum"),
            F.when(over, 0).when(full, 1).otherwise(s["n"] + 1).cast("int").alias("n"),
            F.concat(s["out"], F.array(batch.cast("int"))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def pack_lines(docs: DataFrame, limit: int, max_items: int | None = None) -> DataFrame:
    """doc_id, line_no, chars, batch of each line, packed by characters."""
    of = docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x)).alias("sizes"))
    of = of.select("doc_id", F.posexplode(F.arrays_zip("sizes", packed(F.col("sizes"), limit, max_items).alias("batches"))).alias("line_no", "x"))
    return of.select("doc_id", "line_no", F.col("x.sizes").alias("chars"), F.col("x.batches").alias("batch"))


def islands(rows: DataFrame, by: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    """rows with `name`: a number that grows by one where breaks holds (its null is a break)."""
    return rows.withColumn(name, F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order)))


def stanzas(units: DataFrame, group_size: int = STANZA) -> DataFrame:
    """Units of pages with run, poetry and stanza (null outside verse); stanzas are numbered in each page.

    A run is consecutive units of one tag under one parent, or under parents of one signature and
    grandparent. Runs of VERSE_RUN units or more with a median below VERSE_MEDIAN characters are verse.
    A stanza ends where the parent changes, where the signature of the run's first unit comes again if
    it marks stanzas, and after group_size units.
    """
    order = Window.partitionBy("page_id").orderBy("unit_ord")
    tag = F.element_at(F.split("signature", r"\."), 1)
    last = {c: F.lag(c).over(order) for c in ("signature", "parent", "parent_signature", "grandparent")}
    same_tag = tag == F.element_at(F.split(last["signature"], r"\."), 1)
    same_parent = F.col("parent").eqNullSafe(last["parent"])
    siblings = F.col("parent_signature").eqNullSafe(last["parent_signature"]) & F.col("grandparent").eqNullSafe(last["grandparent"])
    rows = units.withColumn("new_parent", ~same_parent).withColumn("goes_on", same_tag & (same_parent | siblings))
    rows = islands(rows, ["page_id"], ["unit_ord"], ~F.col("goes_on"), "run")
    heads = rows.groupBy("page_id", "run").agg(F.count("*").alias("n"), F.median("chars").alias("median"), F.min_by("signature", "unit_ord").alias("head"), F.countDistinct("signature").alias("kinds"))
    rows = rows.join(heads, ["page_id", "run"])
    of_head = F.sum(F.when(F.col("signature") == F.col("head"), 1).otherwise(0)).over(Window.partitionBy("page_id", "run"))
    rows = rows.withColumn("poetry", (F.col("n") >= VERSE_RUN) & (F.col("median") < VERSE_MEDIAN)).withColumn("of_head", of_head)
    marks = (F.col("kinds") > 1) & (F.col("of_head") >= 2) & (F.col("of_head") / F.col("n") < HEAD_SHARE)
    first = F.row_number().over(Window.partitionBy("page_id", "run").orderBy("unit_ord")) == 1
    rows = islands(rows, ["page_id", "run"], ["unit_ord"], first | F.col("new_parent") | (marks & (F.col("signature") == F.col("head"))), "part")
    at = F.floor((F.row_number().over(Window.partitionBy("page_id", "run", "part").orderBy("unit_ord")) - 1) / group_size)
    rows = rows.withColumn("window", F.when(F.col("poetry"), F.struct("run", "part", at.alias("at"))))
    dense = F.dense_rank().over(Window.partitionBy("page_id").orderBy(F.col("window").asc_nulls_last()))
    return rows.withColumn("stanza", F.when(F.col("poetry"), dense - 1)).select(*units.columns, "run", "poetry", "stanza")


def batch_index(grouped: DataFrame) -> DataFrame:
    """grouped (page_id, unit_ord, stanza) with batch: one a stanza and one for each other unit, in order."""
    first = F.when(F.col("stanza").isNull(), F.col("unit_ord")).otherwise(F.min("unit_ord").over(Window.partitionBy("page_id", "stanza")))
    return grouped.withColumn("first", first).withColumn("batch", F.dense_rank().over(Window.partitionBy("page_id").orderBy("first")) - 1).drop("first")


def rolling_context(rows: DataFrame, by: str, order: str, value: Column, limit: int = 3) -> DataFrame:
    """rows with context: the values of up to `limit` rows before, oldest first; a limit of 0 keeps none."""
    frame = Window.partitionBy(by).orderBy(order).rowsBetween(-max(limit, 1), -1)
    return rows.withColumn("context", F.collect_list(value).over(frame) if limit > 0 else F.array().cast("array<string>"))


def history_sizes(n: Column) -> Column:
    """After each of n messages, how many are kept: above HISTORY_FULL, the last HISTORY_KEPT (a saw-tooth)."""
    period = HISTORY_FULL - HISTORY_KEPT + 1
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i <= HISTORY_FULL, i).otherwise(HISTORY_KEPT + (i - HISTORY_FULL - 1) % period))


def ordinals(rows: DataFrame, by: str, order: str, **counted: str) -> DataFrame:
    """rows with at (the ordinal within `by`) and, by name, how many rows before have a boolean column that is true.

    Rows are dealt out by ranges of (by, order) and written, so a key with many rows spreads over tasks; what a range
    begins with comes from the counts of the ranges before it.
    """
    path = scratch(rows.sparkSession, "ordinals")
    rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    names = {"at": F.lit(1)} | {k: F.when(F.col(c), 1).otherwise(0) for k, c in counted.items()}
    sums = ranged.groupBy(by, "_range").agg(*(F.sum(v).alias(f"_{k}") for k, v in names.items()))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in names))
    here = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({k: F.coalesce(F.sum(v).over(here), F.lit(0)) for k, v in names.items()})
    out = out.join(bases, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in names}).drop("_by", "_of", "_range", *(f"_{k}" for k in names))


def lookback(items: DataFrame, by: str, order: str, long: Column, n: int = 3, every: int = 50) -> DataFrame:
    """items with at (ordinal) and seen: the `n` nearest long items before the last refresh, nearest first; none if there are fewer."""
    rows = ordinals(items.withColumn("is_long", long), by, order, long_before="is_long")
    longs = rows.filter("is_long").select(F.col(by).alias("k"), F.col("long_before").alias("rank"), F.col(order).alias("item"))
    points = rows.filter(F.col("at") % every == 0).select(F.col(by).alias("k"), F.col("at").alias("refresh"), F.explode(F.sequence(F.col("long_before") - n, F.col("long_before") - 1)).alias("rank"))
    seen = points.join(longs, ["k", "rank"]).groupBy("k", "refresh").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item")), False), lambda x: x["item"]).alias("seen")).filter(F.size("seen") == n)
    rows = rows.withColumn("refresh", F.floor(F.col("at") / every) * every)
    return rows.join(seen.withColumnRenamed("k", by), [by, "refresh"], "left").drop("is_long", "long_before")


def completed_prefix(rows: DataFrame, order: str, done: Column) -> DataFrame:
    """The rows before the first that is not done."""
    gap = rows.filter(~done).agg(F.min(order).alias("gap"))  # one row
    return rows.join(F.broadcast(gap), F.col("gap").isNull() | (F.col(order) < F.col("gap")), "left_semi")


def range_filter(rows: DataFrame, by: str, order: str, starts: Column, ends: Column) -> DataFrame:
    """From the first row that starts through the first that ends, itself or later."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("_on", F.max(starts).over(w))
    rows = rows.withColumn("_ended", F.coalesce(F.max(F.col("_on") & ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    return rows.filter(F.col("_on") & ~F.col("_ended")).drop("_on", "_ended")
