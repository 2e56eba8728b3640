"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a virtual finish time: the words of its source up
to and including it, in a fixed shuffled order, divided by the source's target.
Sorting all sources by that time interleaves them in proportion to their targets;
the mix is the longest prefix of that order within the budget. A source whose target
is larger than itself is queued again, up to `max_repeats` times in all.

Plan: one aggregate over (source, shuffle bucket) gives the bases of the prefix sums,
so no source is ever ordered in one task; a histogram of finish times gives the range
in which the budget ends, a finer one of that range the part, and only that part is ordered
to find the exact cut. The mix itself is dealt by the same histogram into ranges of finish
time, each sorted, so its files are in the order of the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import forget, fresh, n_words, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MAX_REPEATS = 3
#: Ranges per unit of virtual time, the last one, which takes what is beyond, and parts of the range where the budget ends.
RANGES, LAST_RANGE, PARTS = 16_384, 65_535, 65_536


def targets(totals: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.

    The weights share the sum of all sizes. A source stops at max_repeats times its
    size and the rest is shared again by weight. Sources fill up in the order of
    cap / weight, so those before the first that stays below its cap are at theirs.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("nth"))
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    t = totals.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeats)
    t = t.withColumn("all_words", F.sum("source_size").over(Window.partitionBy()))
    level = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    t = t.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    fills = F.struct(F.col("cap") / F.col("weight"), "nth", "level")
    t = t.withColumn("final_level", F.min(F.when(F.col("open"), fills)).over(Window.partitionBy())["level"])
    share = F.when(F.col("final_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final_level") * F.col("weight")))
    return t.select("source", "source_size", share.cast("double").alias("target"))


def _shuffle_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _over(queue: DataFrame, by: str, start: int, budget: int):
    """The first of the ranges `by` in whose course the words reach beyond the budget, and the words before it."""
    ends = queue.groupBy(by).agg(F.sum("size").alias("n")).withColumn("end", F.sum("n").over(Window.orderBy(by)) + start)  # one row a range
    return ends.filter(F.col("end") > budget).orderBy(by).limit(1).select(F.col(by).alias("at"), (F.col("end") - F.col("n")).alias("start")).first()


class _Queue:
    """The queue of a table: written sizes and finish times, and where the budget ends."""

    def __init__(self, docs: DataFrame, size: Column | None, weights, max_repeats: int):
        self.docs, self.max_repeats = docs.drop("size", "source_size", "target", "copies", "taken"), max_repeats
        self.size = n_words(F.col("text")) if size is None else size
        self.key, self.part, self.upto, self.p_source, self.p_part, self.base = (fresh(docs, x) for x in ("mix_key", "mix_part", "mix_upto", "mix_of_source", "mix_of_part", "mix_base"))
        small = written(self.keyed(self.docs).select("doc_id", "source", "size", self.key, self.part), "mix-sizes")
        per_part = small.groupBy("source", self.part).agg(F.sum("size").alias("part_size"))
        in_source = Window.partitionBy("source").orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        goal = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
        per_part = per_part.withColumn(self.base, F.coalesce(F.sum("part_size").over(in_source), F.lit(0)))
        per_part = per_part.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(F.col("p.source").alias(self.p_source), F.col(self.part).alias(self.p_part), self.base, "source_size", "target")
        self.per_part = written(per_part, "mix-parts")  # 4,096 rows a source at most
        copies = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.struct(self.finish(e).alias("at"), e.alias("copy")))
        queue = self.numbered(small).filter("size > 0").select("doc_id", "size", F.explode(copies).alias("q")).select("doc_id", "size", "q.at", "q.copy")
        self.budget = small.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.queue = written(queue.withColumn("range", self.range_of(F.col("at"))), "mix-queue")
        self.cut = self.find_cut()
        forget(small)

    def keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("size", self.size).withColumn(self.key, _shuffle_key()).withColumn(self.part, F.substring(self.key, 1, 3))

    def numbered(self, df: DataFrame) -> DataFrame:
        """df with upto: the words of its source up to and including each row."""
        within = Window.partitionBy("source", self.part).orderBy(self.key, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(self.upto, F.sum("size").over(within))
        df = df.join(self.per_part, F.col("source").eqNullSafe(F.col(self.p_source)) & (F.col(self.part) == F.col(self.p_part)))
        return df.withColumn(self.upto, F.col(self.upto) + F.col(self.base)).drop(self.p_source, self.p_part, self.base)

    def finish(self, copy: Column) -> Column:
        return F.try_divide(F.col("source_size") * copy + F.col(self.upto), F.col("target"))

    def range_of(self, at: Column) -> Column:
        return F.least(F.floor(at * RANGES), F.lit(LAST_RANGE)).cast("int")

    def find_cut(self):
        """at, doc_id and copy of the first place of the queue that the budget does not hold, or None."""
        over = _over(self.queue, "range", 0, self.budget)
        if over is None:
            return None
        rows = self.queue.filter(F.col("range") == over["at"])
        ends = rows.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
        width = max(ends["high"] - ends["low"], 1e-300)
        rows = rows.withColumn("part", F.floor((F.col("at") - F.lit(ends["low"])) / F.lit(width) * PARTS))
        over = _over(rows, "part", over["start"], self.budget)
        rows = rows.filter(F.col("part") == over["at"])
        order = Window.orderBy("at", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)  # a part of a range, in which a source's times differ
        rows = rows.withColumn("end", F.sum("size").over(order) + over["start"])
        return rows.filter(F.col("end") > self.budget).orderBy("at", "doc_id", "copy").select("at", "doc_id", "copy").first()

    def taken(self) -> DataFrame:
        """docs with size, source_size, target, copies, taken, and what finish() reads."""
        if self.cut is None:
            chosen = F.lit(self.max_repeats)
        else:
            kind = self.docs.schema["doc_id"].dataType
            cut = F.struct(F.lit(self.cut["at"]).alias("at"), F.lit(self.cut["doc_id"]).cast(kind).alias("doc_id"), F.lit(self.cut["copy"]).alias("copy"))
            before = [F.struct(self.finish(F.lit(e)).alias("at"), F.col("doc_id").alias("doc_id"), F.lit(e).alias("copy")) < cut for e in range(self.max_repeats)]
            chosen = sum((b.cast("int") for b in before), F.lit(0))
        out = self.numbered(self.keyed(self.docs)).withColumn("copies", F.when(F.col("size") > 0, chosen).otherwise(0))
        return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs with size, source_size, target, copies (times it is taken) and taken (words).

    Needs doc_id, source and what `size` reads (by default the words of `text`). Nulls:
    a null text has size 0, a null source is a source of its own, a null doc_id is shuffled
    as the empty string. Documents of size 0 are never taken. Equal finish times are in the order
    of doc_id in its own type, null first. Rows that repeat a doc_id
    count as documents of their own. An empty table gives an empty result. Other columns
    pass through; those named like a result column are replaced. Reruns agree: the
    shuffled order is that of md5(doc_id).
    """
    queue = _Queue(docs, size, weights, max_repeats)
    return queue.taken().drop(queue.key, queue.part, queue.upto)


def mixed(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of docs, in the order of the queue.

    Partition after partition, and within each row after row, finish times ascend; nulls, repeated rows and
    empty tables as in mix().
    """
    queue = _Queue(docs, size, weights, max_repeats)
    n, q, shard, of_range = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(fresh(docs, x) for x in ("mix_place", "mix_shard", "mix_range"))
    ends = queue.queue.groupBy("range").agg(F.sum("size").alias("n")).withColumn("end", F.sum("n").over(Window.orderBy("range")))
    shards = ends.select(F.col("range").alias(of_range), F.least(F.floor((F.col("end") - F.col("n")) * n / max(queue.budget, 1)), F.lit(n - 1)).cast("int").alias(shard))
    places = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: F.struct(queue.finish(e).alias("at"), F.col("doc_id").alias("doc_id"), e.alias("copy")))
    rows = queue.taken().filter("copies > 0").withColumn(q, F.explode(places))
    # LAST_RANGE + 1 rows at most are broadcast
    rows = rows.join(F.broadcast(shards), queue.range_of(F.col(f"{q}.at")) == F.col(of_range))
    return rows.repartitionById(n, shard).sortWithinPartitions(shard, q).select(*docs.columns)
