"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text gets the set of hashes of its word shingles; the SKETCH smallest are kept, and
   texts with equal sets become one class, whose smallest doc_id stands for it.
2. Inverted lists of the INDEX smallest hashes give overlaps. Two sets that are similar enough share
   at least SHARED of them but for a chance of about 1e-7, and the first documents of the lists,
   rarest first, must then meet (a prefix filter), so widespread passages make no pairs.
3. The estimate of the Jaccard similarity from the sketch of the union drops pairs.
4. Exact Jaccard similarity of the full sets verifies the others.

What is asked for are the classes of linked documents, so pairs are tried in two passes. First each
document with the one that its lists name most, where a list names its most typical document, the
one whose hashes are the most widespread: a text that others were copied from has no hash of its
own. This joins large groups by as many pairs as they have members. Then every pair that shares a
list and still lies in different components, but for those that a count rules out: a document has
no more in common with any of another component than its shingles that occur in other components
at all, which bounds the size of whatever it can be linked with. What is left of a list is dealt into
blocks of BLOCK documents, and pairs of blocks into tiles. A tile finds out which of its documents have a pair left at all;
with the full sets of these it counts what any two share at once and puts out a spanning forest of their links, so no
table of pairs exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import forget, written
from lectern.llm.components import components, forest

#: Retained hashes for estimates; those of them in inverted lists; how many of these a linked pair shares at least.
SKETCH, INDEX, SHARED = 64, 32, 13
#: Links by percent of the union; the estimate, in percent, below which a pair is dropped (five and a half deviations).
PERCENT, LEAST_ESTIMATE = 80, 52
#: Rounds of counting what documents can share with other components; each leaves fewer of them.
COUNTS = 3
#: Documents of a block of a long list; shingles that a tile counts at once.
BLOCK, AT_ONCE = 1_024, 8_192
#: Ids that are broadcast to pick out texts at most; with more, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


class _Words(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes, 63 bits, ascending, of the k-word shingles of a text.

    A-Z is lower-cased; words are parted by ASCII white space. A text of fewer words has one
    shingle, all its words; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=n)
    size = min(n, k)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = (h ^ w[j : n - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)))


def _sketched(k: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                sets = [shingles(t.as_py(), k) for t in part.column(1)]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(digest, pa.binary()), _lists([s[:SKETCH] for s in sets])], ["doc_id", "n_shingles", "digest", "sketch"])

    return batches


def _full(k: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t.as_py(), k) for t in part.column(1)])], ["id", "set"])

    return batches


def _estimate(a: Column, b: Column) -> Column:
    """Percent of the smallest hashes of the union that are in both sketches."""
    size = F.greatest(F.least(F.size(a), F.lit(SKETCH)), F.least(F.size(b), F.lit(SKETCH)))
    union = F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), size)
    return 100 * F.size(F.array_intersect(union, F.array_intersect(a, b))) / size


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sets have in common."""
    whose = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = often[column] > 1
    whose, column = whose[several], (np.cumsum(often > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    whose, column = whose[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)  # whole numbers up to 2^24 are exact
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, AT_ONCE):
        a, b = np.searchsorted(column, [start, start + AT_ONCE])
        has = np.zeros((len(sets), AT_ONCE), dtype=np.float32)
        has[whose[a:b], column[a:b] - start] = 1
        both += has @ has.T
    return both.astype(np.int64)


#: Where a document stands: a list, a pair of its blocks, and its own block; what decides on pairs.
_PLACE, _KNOWN = ("value", "first", "second", "block", "id"), ("component", "n", "largest", "values")


def open_pairs(tile: dict[str, list], percent: int) -> np.ndarray:
    """Which pairs of a tile's documents are to be compared: columns value, first, second, block, id, component, n, largest, values."""
    n, largest, component, block = (np.asarray(tile[c], dtype=np.int64) for c in ("n", "largest", "component", "block"))
    found = np.triu(component[:, None] != component, 1) & (n[:, None] <= largest) & (n <= largest[:, None])
    found &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
    if tile["first"][0] != tile["second"][0]:
        found &= block[:, None] != block
    if found.any():
        # a pair is looked at in the first of the lists that it shares
        at = np.flatnonzero(found.any(axis=0) | found.any(axis=1))
        found[np.ix_(at, at)] &= _shared_counts([v[v < tile["value"][0]] for v in (tile["values"][i] for i in at)]) == 0
    return found


def tile_links(tile: dict[str, list], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links across components within a tile, which also has the column set."""
    open_ = open_pairs(tile, percent)
    at = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
    if not len(at):
        return []
    both = _shared_counts([tile["set"][i] for i in at])
    n = np.asarray(tile["n"], dtype=np.int64)[at]
    i, j = np.nonzero(open_[np.ix_(at, at)] & (100 * both >= percent * (n[:, None] + n - both)))
    root = forest(len(at), i, j)
    ids = np.asarray(tile["id"], dtype=np.int64)[at]
    return [(int(ids[r]), int(x)) for x, r, k in zip(ids, root, range(len(at))) if r != k]


def _tiles(percent: int, with_sets: bool):
    """Rows sorted by (value, first, second): without sets the places of documents that have a pair there; with sets links a, b."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*_PLACE, *_KNOWN, "set") if with_sets else (*_PLACE, *_KNOWN)
        tile: dict[str, list] = {c: [] for c in names}

        def done() -> Iterator[pa.RecordBatch]:
            if len(tile["id"]) < 2:
                return
            if with_sets:
                out, columns, types = tile_links(tile, percent), ["a", "b"], [pa.int64()] * 2
            else:
                open_ = open_pairs(tile, percent)
                at = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
                out, columns, types = [tuple(tile[c][i] for c in _PLACE) for i in at], list(_PLACE), [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], columns)

        for batch in rows:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            plain = {c: v.to_pylist() for c, v in columns.items() if c not in ("values", "set")}
            for i in range(batch.num_rows):
                key = tuple(plain[c][i] for c in _PLACE[:3])
                if tile["id"] and key != tuple(tile[c][0] for c in _PLACE[:3]):
                    yield from done()
                    tile = {c: [] for c in names}
                for c, v in columns.items():
                    tile[c].append(plain[c][i] if c in plain else v[i].values.to_numpy())
        yield from done()

    return batches


class _Search:
    """Candidate pairs of classes, and their links."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent = docs, classes, k, percent

    def postings(self) -> DataFrame:
        """value, id, df, nth: the indexed hashes that several classes have; nth: rank in the class, rarest first."""
        every = self.classes.select("id", "n", F.explode(F.slice("sketch", 1, INDEX)).alias("value"))
        often = every.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
        of = every.join(often, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))  # INDEX at most
        least = F.least(F.lit(SHARED), F.ceil(F.col("n") * self.percent / 100)).cast("int")
        of = of.withColumn("prefix", F.size("values") - least + 1).filter("prefix > 0")
        return of.select("id", "prefix", F.posexplode("values").alias("nth", "v")).select("id", "v.value", "v.df", (F.col("nth") < F.col("prefix")).alias("in_prefix"))

    def sets(self, ids: DataFrame) -> DataFrame:
        """id, set: the full sets of the classes in ids."""
        ids = written(ids, "near-ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = self.docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi").dropDuplicates(["id"])
        out = written(texts.mapInArrow(_full(self.k), "id long, set array<bigint>"), "near-sets")
        forget(ids)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose sets are similar enough."""
        c = self.classes
        a, b = (c.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
        near = pairs.join(c.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(c.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
        near = near.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")).select("a", "b")
        near = near.join(a, "a").join(b, "b").filter(_estimate(F.col("s_a"), F.col("s_b")) >= LEAST_ESTIMATE).select("a", "b", "n_a", "n_b")
        near = written(near, "near-pairs")
        sets = self.sets(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
        both = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("both"))
        found = written(both.filter(100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"), "near-links")
        for df in (near, sets):
            forget(df)
        return found

    def typical(self, postings: DataFrame) -> DataFrame:
        """Pairs (a, b): each class with the one that its lists name most."""
        spread = postings.groupBy("id").agg(F.sum("df").alias("spread"))
        rows = postings.select("value", "id").join(spread, "id")
        named = rows.groupBy("value").agg(F.max(F.struct("spread", -F.col("id")))["col2"].alias("minus"))
        votes = rows.join(named, "value").select("id", (-F.col("minus")).alias("hub")).filter("id != hub").groupBy("id", "hub").agg(F.count("*").alias("votes"))
        best = votes.groupBy("id").agg(F.min(F.struct(-F.col("votes"), "hub"))["hub"].alias("hub"))
        return best.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()

    def across(self, postings: DataFrame, known: DataFrame) -> DataFrame:
        """Links (a, b) that join the classes of different components which share a list within the prefixes."""
        lists = postings.filter("in_prefix").select("value", "id").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = lists.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("value")
        open_lists = lists = written(lists.join(mixed, "value"), "open-lists")
        sets = self.sets(lists.select("id").distinct())
        left = lists.groupBy("id").agg(F.first("component").alias("component"), F.array_sort(F.collect_set("value")).alias("values"))  # INDEX at most
        for _ in range(COUNTS):
            shingles_of = sets.select("id", F.explode("set").alias("s")).join(left.select("id", "component"), "id")
            shared = shingles_of.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("s")
            common = shingles_of.join(shared, "s").groupBy("id").agg(F.count("*").alias("common"))
            size = left.select("id", "component", "values").join(common, "id").join(self.classes.select("id", "n"), "id")
            size = size.withColumn("largest", F.floor(F.col("common") * (100 + self.percent) / self.percent) - F.col("n"))
            last, left = left, written(size.filter(100 * F.col("largest") >= self.percent * F.col("n")).drop("common"), "open-classes")
            forget(last)
        lists = lists.select("value", "id").join(left.select("id"), "id")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        sizes = lists.groupBy("value").agg(F.count("*").alias("size")).filter("size > 1").select("value", blocks.alias("blocks"))
        each = lists.join(sizes, "value").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.select("value", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "id")

        def together(rows: DataFrame) -> DataFrame:
            tile = ("value", "first", "second")
            return rows.repartition(*tile).sortWithinPartitions(*tile, "id")

        open_ = together(each.join(left, "id")).mapInArrow(_tiles(self.percent, False), "value long, first int, second int, block int, id long")
        open_ = written(open_, "open-places")
        found = written(together(open_.join(left, "id").join(sets, "id")).mapInArrow(_tiles(self.percent, True), "a long, b long"), "tile-links")
        forget(open_)
        for df in (open_lists, left, sets):
            forget(df)
        return found


def link_classes(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """id, component of the classes (id, n, sketch) that are linked to another."""
    search = _Search(docs, classes, k, percent)
    postings = written(search.postings(), "postings")
    links = search.links(search.typical(postings))
    return components(links.unionByName(search.across(postings, components(links))))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id an integer, text).

    Documents are linked when the Jaccard similarity of their sets of k-word shingles is at least
    `percent`. component_id is the smallest doc_id reachable by links, the document's own
    included; kept says whether it is the document's own. A text that is null, empty or
    without words is linked with nothing. Rows that repeat a doc_id are one document, whose
    results every such row gets; a row with null doc_id is linked with nothing and kept. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(docs.mapInArrow(_sketched(k), "doc_id long, n_shingles long, digest binary, sketch array<bigint>"), "sketches")
    some = known.filter("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    linked = link_classes(docs, classes, k, percent)
    of = written(classes.select("digest", "id").join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")), "class-components")
    out = known.drop("sketch").join(of, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
