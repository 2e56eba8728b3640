"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector o of D numbers is rotated at random; its code is the signs x of the rotated
numbers, and its correction factor is f = <x, Po> / sqrt(D), how far the code points along the
vector. For any other unit vector q, <x, Pq> / (sqrt(D) f) is an unbiased estimate of <o, q>,
with an error of deviation sqrt((1 - f^2) / f^2) * sqrt(1 - <o, q>^2) / sqrt(D - 1). For q its rotated
numbers are stored as bytes, rounded up or down at random so that the estimate stays unbiased.

1. Equal vectors become one class, whose smallest vec_id stands for it.
2. Each class gets its code, factor, bytes and buckets once, and these are stored. The codes of several
   rotations make one long code. Each of `tables` tables takes bits of its own
   from it, about log2 of the number of vectors, as the bucket; there are as many rotations as that
   takes. Two vectors at the threshold agree in all bits of a bucket with a chance that depends on
   the angle alone; the number of tables makes the chance to meet in none as small as MISS.
3. Within a bucket, the estimate and its confidence bound decide which pairs are computed again,
   exactly, in double precision. Only codes travel to the buckets; the vectors follow for
   those that have such a pair there. A pair is looked at in the first table in which it meets alone, which
   both codes tell, so nothing is sent round to remove repetitions.
4. Buckets larger than BLOCK are dealt out as pairs of blocks, so no task has more than two blocks
   of a bucket at a time. Blocks return the number of links of each vector and a spanning forest
   of its links; whole pair lists exist nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import forget, written
from lectern.llm.components import components, forest

#: Links by cosine; the chance to miss a pair at the threshold; deviations of the bound.
LEAST_COSINE, MISS, DEVIATIONS = 0.95, 5e-4, 6.0
#: Vectors of a block of a large bucket; rows that a worker compares at once.
BLOCK, AT_ONCE = 256, 8_192
SEED = 20_240_513


class Codes:
    """Rotations and tables for vectors of `dim` numbers, the same for all workers."""

    def __init__(self, dim: int, n: int, least: float):
        rng = np.random.default_rng([SEED, dim])
        self.dim, self.least = dim, least
        agree = 1 - math.acos(least) / math.pi
        self.bits = max(4, min(24, dim * 2, round(math.log2(max(n, 2)))))
        self.tables = math.ceil(math.log(MISS) / math.log1p(-(agree**self.bits)))
        used = self.tables * self.bits
        self.rotations = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(math.ceil(used / dim))]
        # no bit is in two tables, or they would miss the same pairs
        self.chosen = np.sort(rng.permutation(dim * len(self.rotations))[:used].reshape(self.tables, self.bits), axis=1)

    def signs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ r.T >= 0 for r in self.rotations], axis=1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        weights = 1 << np.arange(self.bits, dtype=np.int32)
        s = self.signs(x)
        return np.stack([s[:, c] @ weights for c in self.chosen], axis=1).astype("<i4")

    def code(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, correction factor, rotated numbers as bytes and their unit of each vector; the same for the same id."""
        rotated = x @ self.rotations[0].T
        factor = np.abs(rotated).sum(axis=1) / math.sqrt(self.dim)
        unit = np.maximum(np.abs(rotated).max(axis=1) / 127, 1e-300)
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.dim, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        chance = (mixed >> np.uint64(40)) / float(1 << 24)
        rounded = np.clip(np.floor(rotated / unit[:, None] + chance), -127, 127).astype(np.int8)
        return np.packbits(rotated >= 0, axis=1), factor, rounded, unit


def _unit(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of those that have a direction, and which those are."""
    rows = [None if v is None or any(c is None for c in v) else np.asarray(v, dtype=np.float64) for v in values.to_pylist()]
    # scaled first, so that no square overflows or vanishes
    top = [np.abs(r).max() if r is not None and len(r) else 0.0 for r in rows]
    rows = [r / t if r is not None and np.isfinite(t) and t > 0 else None for r, t in zip(rows, top)]
    norm = np.array([np.linalg.norm(r) if r is not None else 0.0 for r in rows])
    good = np.isfinite(norm) & (norm > 0)
    return [r / n for r, n, g in zip(rows, norm, good) if g], good


def _units(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        units, good = _unit(batch.column(1))
        ids = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([i for i, g in zip(ids, good) if g], pa.int64()), pa.array([len(u) for u in units], pa.int32()), pa.array([u.astype("<f8").tobytes() for u in units], pa.binary())], ["vec_id", "dim", "unit"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype="<f8").reshape(len(column), -1)


#: Where a vector stands: its bucket, and the pair of blocks with its own.
_PLACE = ("vec_id", "dim", "bucket", "first", "second", "block")
_CODED = "vec_id long, dim int, times long, signs binary, factor double, bytes binary, scale double, words binary"


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _coded(n: int, least: float):
    """What is stored of each class: (vec_id, dim, times, unit) to the columns of _CODED; words: the bucket in each table."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for batch in rows:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                c = codes.setdefault(int(dim), Codes(int(dim), n, least))
                for start in range(0, part.num_rows, 1_000):
                    some = part.slice(start, 1_000)
                    x = _matrix(some.column(3))
                    signs, factor, rounded, scale = c.code(x, some.column(0).to_numpy())
                    columns = [some.column(0), some.column(1), some.column(2), _binaries(signs), pa.array(factor), _binaries(rounded), pa.array(scale), _binaries(c.buckets(x))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "times", "signs", "factor", "bytes", "scale", "words"])

    return batches


def _bucketed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, bucket (with the table in it) of each vector in each table, from vec_id, dim, words."""
    for batch in rows:
        for start in range(0, batch.num_rows, 1_000):
            some = batch.slice(start, 1_000)
            words = [np.frombuffer(w.as_buffer(), dtype="<i4") for w in some.column(2)]
            tables = [len(w) for w in words]
            keys = np.concatenate([w.astype(np.int64) * len(w) + np.arange(len(w)) for w in words]) if words else np.empty(0, dtype=np.int64)
            at = pa.array(np.repeat(np.arange(len(words)), tables))
            yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(keys)], ["vec_id", "dim", "bucket"])


def _numbers(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype=dtype).reshape(len(column), -1)


def may_link(signs: np.ndarray, factor: np.ndarray, rounded: np.ndarray, scale: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Of the pairs (i, j) those whose estimate's upper bound reaches `least`; signs: +1 and -1, rounded: the bytes."""
    root = math.sqrt(signs.shape[1])
    estimate = np.einsum("ij,ij->i", signs[i], rounded[j]) * scale[j] / (root * factor[i])
    wide = np.sqrt(np.maximum(1 - factor[i] ** 2, 0)) / factor[i] / math.sqrt(max(signs.shape[1] - 1, 1))
    return estimate + DEVIATIONS * (wide * math.sqrt(1 - least**2) + scale[j] / 2 / factor[i]) + 1e-3 >= least


def _compared(least: float, exact: bool):
    """Compares rows sorted by (bucket, first, second), which have the columns of _CODED with bucket, first, second, block.

    Without `exact`, the vectors that have a pair to compute again; with it, and the column unit, the number of
    links of each vector, and the smallest row that it is joined with.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("vec_id", "times", "dim", "bucket", "first", "second", "block", "factor", "scale")

        def compare(part: pa.RecordBatch) -> pa.RecordBatch | None:
            def column(name: str) -> pa.Array:
                return part.column(part.schema.get_field_index(name))

            v = {c: column(c).to_numpy() for c in names}
            dim, found = int(v["dim"][0]), _numbers(column("words"), "<i4")
            signs = np.unpackbits(_numbers(column("signs"), "u1"), axis=1, count=dim).astype(np.float32) * 2 - 1
            rounded = _numbers(column("bytes"), "i1").astype(np.float32)
            x = _matrix(column("unit")) if exact else None
            table = v["bucket"] % found.shape[1]
            same = np.concatenate([[True], (np.diff(v["bucket"]) != 0) | (np.diff(v["first"]) != 0) | (np.diff(v["second"]) != 0)])
            group = np.cumsum(same)
            ends = np.searchsorted(group, group, side="right")
            links_i, links_j = [], []
            step = 1
            rows_left = np.flatnonzero(np.arange(len(found)) + step < ends)
            while len(rows_left):
                i, j = rows_left, rows_left + step
                use = (v["first"][i] == v["second"][i]) | (v["block"][i] != v["block"][j])
                i, j = i[use], j[use]
                if len(i):
                    use = may_link(signs, v["factor"], rounded, v["scale"], i, j, least)
                    i, j = i[use], j[use]
                if len(i):
                    met = found[i] == found[j]
                    use = met.argmax(axis=1) == table[i]  # the first table where they meet is this one
                    i, j = i[use], j[use]
                if len(i) and exact:
                    use = np.einsum("ij,ij->i", x[i], x[j]) >= least
                    i, j = i[use], j[use]
                if len(i):
                    links_i.append(i)
                    links_j.append(j)
                step += 1
                rows_left = rows_left[rows_left + step < ends[rows_left]]
            i, j = (np.concatenate(k) if k else np.empty(0, dtype=np.int64) for k in (links_i, links_j))
            if not len(i):
                return None
            if not exact:
                at = pa.array(np.union1d(i, j))
                return pa.RecordBatch.from_arrays([column(c).take(at) for c in _PLACE], list(_PLACE))
            count = np.bincount(i, v["times"][j], len(x)) + np.bincount(j, v["times"][i], len(x))
            root = forest(len(x), i, j)
            at = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(v["vec_id"][at]), pa.array(count[at].astype(np.int64)), pa.array(v["vec_id"][root[at]])], ["vec_id", "n", "root"])

        kept: list[pa.RecordBatch] = []

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Compares what has come up to the last group that may go on, dimension by dimension."""
            nonlocal kept
            table = pa.Table.from_batches(kept).combine_chunks()
            key = [table.column(c).to_numpy() for c in ("bucket", "first", "second", "dim")]
            change = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
            stop = table.num_rows if last else (int(change[-1]) if len(change) else 0)
            dims = np.flatnonzero(np.diff(key[3][:stop])) + 1
            for a, b in zip([0, *dims], [*dims, stop]):
                if b > a and (found := compare(table.slice(a, b - a).combine_chunks().to_batches()[0])):
                    yield found
            kept = table.slice(stop).to_batches()

        for batch in rows:
            for start in range(0, batch.num_rows, AT_ONCE):
                kept.append(batch.slice(start, AT_ONCE))
                if sum(k.num_rows for k in kept) >= AT_ONCE:
                    yield from ready(False)
        if kept:
            yield from ready(True)

    return batches


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id an integer, embedding an array of numbers).

    Vectors link whose cosine, in double precision, is at least `least`; vectors of different lengths
    never do. n_links is the number of other vectors linked directly, component_id the smallest vec_id
    reachable, the vector's own included, and kept says whether it is the vector's own. Vectors that
    are null, empty, zero, or hold null or non-finite numbers link with nothing; a row with null vec_id
    neither, and is kept. Rows that repeat a vec_id count as vectors of their own in n_links.
    An empty table gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = written(vectors.filter("vec_id is not null").mapInArrow(_units, "vec_id long, dim int, unit binary"), "units")
    # doubles of equal vectors are equal; so classes lose nothing
    classes = written(units.groupBy("dim", "unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")), "vector-classes")
    n = classes.count()
    units_of = classes.select(F.col("id").alias("vec_id"), "dim", "times", "unit")
    codes = written(units_of.mapInArrow(_coded(n, least), _CODED), "vector-codes")
    buckets = written(codes.select("vec_id", "dim", "words").mapInArrow(_bucketed, "vec_id long, dim int, bucket long"), "buckets")
    sizes = buckets.groupBy("dim", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.when(blocks > 1, F.pmod(F.xxhash64("vec_id"), blocks)).otherwise(0).cast("int")
    each = buckets.join(sizes, ["dim", "bucket"]).withColumn("blocks", blocks).withColumn("block", block)
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).select(*_PLACE)

    def together(rows: DataFrame) -> DataFrame:
        tile = ("dim", "bucket", "first", "second")
        return rows.repartition(*tile).sortWithinPartitions(*tile, "vec_id")

    place = "vec_id long, dim int, bucket long, first int, second int, block int"
    close = written(together(each.join(codes.drop("dim"), "vec_id")).mapInArrow(_compared(least, False), place), "vector-places")
    full = close.join(codes.drop("dim"), "vec_id").join(units_of.select("vec_id", "unit"), "vec_id")
    found = written(together(full).mapInArrow(_compared(least, True), "vec_id long, n long, root long"), "vector-links")
    for df in (buckets, close, codes):
        forget(df)
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    of = classes.join(links.withColumnRenamed("vec_id", "id"), "id", "left").join(groups, "id", "left")
    of = of.select("dim", "unit", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # a row's class is found by its unit vector; rows without one are left over
    linked = units.join(of, ["dim", "unit"]).select("vec_id", "n_links", "component_id")
    rest = vectors.filter("vec_id is not null").select("vec_id").exceptAll(linked.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    lost = vectors.filter("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), "vec_id")
    return linked.unionByName(rest).union(lost).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
