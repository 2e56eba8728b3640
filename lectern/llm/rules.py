"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering.

Each rule is a conjunction such as `symbol_rate >= 0.02 and log_words < 6.1` that says a
text is bad. A rule grows on two thirds of the rows not yet covered, adding the condition
with the highest information gain, of equal ones that with the widest gap between the rows
on its two sides, in the middle of which its threshold lies; it is pruned on the other third by dropping its last
conditions while that does not lower (bad - good) / (bad + good), and is kept if it is
right often enough there. The rows it covers then leave, and the next rule is grown.
Every step is a grouped count over binned statistics, so the data stay in Spark; the
driver sees one row for each statistic and bin (counts and the least and largest value). What comes out is one ordered
CASE WHEN expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import stats
from lectern.llm.common import forget, written

#: Labelled rows to learn from at most (the first by a hash of doc_id); thresholds tried for each statistic.
SAMPLE, BINS = 20_000, 24
#: Rules, conditions of a rule, rows a rule must cover, and share of them that must be bad.
MAX_RULES, MAX_CONDITIONS, MIN_ROWS, MIN_PRECISION = 8, 4, 4, 0.9


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.stat) >= self.threshold if self.above else F.col(self.stat) < self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a text that meets one is bad, any other is good."""

    rules: list[list[Condition]] = field(default_factory=list)

    def good(self) -> Column:
        if not self.rules:
            return F.lit(True)
        chain = None
        for rule in self.rules:
            test = _all(rule)
            chain = F.when(test, False) if chain is None else chain.when(test, False)
        return chain.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(["bad if " + " and ".join(map(str, r)) for r in self.rules] + ["otherwise good"])


def _all(rule: list[Condition]) -> Column:
    test = F.lit(True)
    for c in rule:
        test = test & c.column()
    return test


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


@dataclass
class _Bin:
    """Bad and good rows of a statistic's bin, and their least and largest value."""

    bad: int
    good: int
    low: float
    high: float


def _counts(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, dict[int, _Bin]]:
    """Occupied bins by statistic; bin i is between edges i - 1 and i."""
    each = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(f"bin_{s}").alias("bin"), F.col(s).alias("value")) for s in edges))
    of = rows.select("bad", F.explode(each).alias("x")).groupBy("x.stat", "x.bin")
    got = of.agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.count("*").alias("n"), F.min("x.value").alias("low"), F.max("x.value").alias("high")).collect()
    out: dict[str, dict[int, _Bin]] = {s: {} for s in edges}
    for r in got:
        out[r["stat"]][r["bin"]] = _Bin(r["bad"], r["n"] - r["bad"], r["low"], r["high"])
    return out


def best_condition(counts: dict[str, dict[int, _Bin]]) -> Condition | None:
    """The condition of the highest gain, the widest gap relative to the statistic's range among equals; None if none gains.

    Ties beyond that go to the first statistic, the lowest threshold, and below before above.
    """
    best, what = (1e-9, -1.0), None
    for stat, bins in counts.items():
        order = [bins[i] for i in sorted(bins)]
        bad0, good0 = sum(b.bad for b in order), sum(b.good for b in order)
        bad = good = 0
        for under, over in zip(order, order[1:]):
            bad, good = bad + under.bad, good + under.good
            gap = (over.low - under.high) / (order[-1].high - order[0].low)
            for above, x, y in ((False, bad, good), (True, bad0 - bad, good0 - good)):
                if (worth := (_gain(x, y, bad0, good0), gap)) > best:
                    middle = under.high + (over.low - under.high) / 2
                    best, what = worth, Condition(stat, above, middle if middle > under.high else over.low)
    return what


def _grow(rows: DataFrame, edges: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        counts = _counts(rows.filter(_all(rule)), edges)
        some = next(iter(counts.values())).values()
        if not any(b.bad for b in some) or rule and not any(b.good for b in some):
            break
        what = best_condition(counts)
        if what is None:
            break
        rule.append(what)
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The best prefix of rule, with the bad and good rows that it covers."""
    tests = [_all(rule[: i + 1]) for i in range(len(rule))]
    got = rows.agg(*(F.sum((t & F.col("bad")).cast("int")) for t in tests), *(F.sum((t & ~F.col("bad")).cast("int")) for t in tests)).first()
    pairs = [(got[i] or 0, got[len(rule) + i] or 0) for i in range(len(rule))]
    worth = [((b - g) / (b + g) if b + g else -1, -i) for i, (b, g) in enumerate(pairs)]
    keep = -max(worth)[1]
    return rule[: keep + 1], *pairs[keep]


def learn(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """A decision list for labels.quality from at most about `sample` labelled rows outside the held-out fold.

    rows: doc_id and the statistics of stats.shape(). Rows that the base rules reject are left to those. Without labels, or without bad or good
    ones, the list is empty and every text is good.
    """
    n = labels.filter(~stats.held_out()).count()
    if not n:
        return DecisionList()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("rules")), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000
    known = stats.labelled(rows.filter(~stats.base_failed()), labels.filter(share), "quality")
    known = written(known.withColumn("bad", F.col("label") == 0), "rules-sample")
    points = [i / BINS for i in range(1, BINS)] + [0.01, 0.99]
    cuts = known.agg(*(F.percentile_approx(s, points, 10_000).alias(s) for s in stats.SHAPE)).first()
    if cuts[0] is None:
        return DecisionList()
    # an edge just above the bad or good rows' common value separates it from larger ones
    edges = {s: sorted({x for v in cuts[s] for x in (v, math.nextafter(v, math.inf))}) for s in stats.SHAPE}
    bins = {f"bin_{s}": sum(((F.col(s) >= e).cast("int") for e in edges[s]), F.lit(0)) for s in stats.SHAPE}
    third = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("prune")), F.lit(3)) == 0
    binned = written(known.withColumns(bins).withColumn("to_prune", third).coalesce(2), "rules-bins")
    learned, left = DecisionList(), binned
    while len(learned.rules) < MAX_RULES:
        rule = _grow(left.filter(~F.col("to_prune")), edges)
        if not rule:
            break
        rule, bad, good = _prune(left.filter("to_prune"), rule)
        if bad + good < MIN_ROWS or bad < MIN_PRECISION * (bad + good):
            break
        learned.rules.append(rule)
        left = left.filter(~_all(rule))
    forget(known)
    forget(binned)
    return learned


def judged(rows: DataFrame, learned: DecisionList) -> DataFrame:
    """rows, which have the statistics of stats.shape(), with base_failed and kept.

    A null or empty text has no words and fails the base rules. Equal rows get equal results,
    an empty table an empty one; other columns pass through.
    """
    return rows.withColumn("base_failed", stats.base_failed()).withColumn("kept", ~stats.base_failed() & learned.good())
