"""Byte-level BPE encoding and decoding.

First the distinct words of a sample of about SAMPLE_CHARS characters, KNOWN_WORDS of them at most, are folded and
sent to all tasks, since most words of a text are common ones. The sample only saves work: any other word is folded
where it stands, and the ids are the same whatever is in it.

Then encoding goes per partition and without a shuffle:

1. A streaming pass splits each text by the tokenizer's pattern. It passes on every
   distinct word (a match of the pattern) of the block that is not known yet once, as an array of bytes, and
   after those the document as a list of word numbers.
2. Spark folds the ranked merges over the byte array of each distinct word with
   higher-order functions. The rank map is a constant: one array of ranks and one of the place at which
   the row of each left id begins in it.
3. A second streaming pass in the same stage puts the ids of the words together again.

A block ends when it has BLOCK_WORDS distinct words, so memory is bounded whatever the size
of a partition. Both passes keep the order of rows within a partition and nothing between
them moves rows, so a lost executor only repeats its own partitions.

Decoding looks the ids up in a constant array of byte pieces and concatenates them.

Constants are scalar subqueries over rows of the driver. The driver keeps the text of every plan that has run, in several
copies, and a literal of this size would be spelt out in each.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyspark.sql.types as T
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm.common import forget, fresh, let, written

#: New words of a block; characters of text between two hand-overs; pieces between white space whose word numbers are kept.
BLOCK_WORDS, HAND_OVER, KEPT_UNITS = 250_000, 2_000_000, 150_000
#: Characters of the sample whose words are folded beforehand, and such words at most.
SAMPLE_CHARS, KNOWN_WORDS = 32_000_000, 300_000
#: Files that the known words are dealt into, and so tasks that fold them.
FOLD_TASKS = 16
#: A longer word has its merges found with a heap in the second pass: the fold copies its arrays at every merge.
LONG_WORD = 1_024
#: White space as the tokenizer's pattern means it (Unicode's White_Space).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of the joined token by each pair of ids that ranked merging can join into it.

    When a token's rank is the lowest, all lower merges inside it are done, so it is always
    joined from the same two parts: those that merges of lower rank leave of it.
    """
    merges: dict[tuple[int, int], int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = merged([ranks[token[i : i + 1]] for i in range(len(token))], merges)
            if len(parts) == 2:
                merges[parts[0], parts[1]] = rank
    return merges


def merged(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """Ranked merging with a heap, in n log n: for building the map and for very long words."""
    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    ids = list(ids)
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := merges.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)

    def push(i: int, j: int) -> None:
        if i >= 0 and j < len(ids) and (r := merges.get((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or ids[i] != left or j >= len(ids) or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        push(before[i], i)
        push(i, after[i])
    return [x for x, a in zip(ids, alive) if a]


@cache
def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], int]]:
    ranks = load_ranks(path)
    return ranks, pair_merges(ranks)


def _literal(value, kind: str) -> Column:
    """A constant of a nested type; Spark folds it into one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _with_constants(df: DataFrame, **arrays: pa.Array) -> DataFrame:
    """df with a column for each array, which is the same in all rows.

    Whoever uses such a column once, in the next projection, gets the subquery put there by the optimizer, so no row
    holds the array; a higher-order function takes no subquery directly.
    """
    one = df.sparkSession.createDataFrame(pa.table({k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in arrays.items()}))
    return df.select("*", *(one.select(k).scalar().alias(k) for k in arrays))


@cache
def _rank_map(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """base, table, bits: table[base[left] + right] ^ (left << bits) is the rank of a pair of ids that merges.

    For any other pair that number has more than `bits` bits. Each left id has a row of right ids; the rows are
    laid into one table, each shifted so that none meets another, and every place says whose it is.
    """
    ranks, merges = _vocabulary(path)
    n = max(ranks.values()) + 1
    bits = n.bit_length()
    if 3 * bits > 62:
        raise ValueError("the vocabulary has more than a million ids")
    rows: dict[int, list[tuple[int, int]]] = {}
    for (left, right), rank in merges.items():
        rows.setdefault(left, []).append((right, rank))
    free, table, base, top, first = np.ones(len(merges) + 4 * n, dtype=bool), np.full(len(merges) + 4 * n, n << bits, dtype=np.int64), np.zeros(n, dtype=np.int64), 0, 0
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        rights = np.array([right for right, _ in row])
        least = rights.min()
        first += int(free[first:].argmax())
        at = max(first - int(least), 0)
        while True:
            shifts = np.flatnonzero(free[at + least : at + least + 4_096]) + at
            fits = free[shifts[:, None] + rights].all(axis=1)
            if fits.any():
                break
            at += 4_096
        base[left] = at = int(shifts[fits.argmax()])
        free[at + rights] = False
        table[at + rights] = [left << bits | rank for _, rank in row]
        top = max(top, at)
    return base, table[: top + n].copy(), bits


def fold(words: DataFrame, path: str, *keep: str) -> DataFrame:
    """The columns `keep` of words, and ids: those of its column word, an array of byte values, or null; the ranked merges as a fold.

    The state has, for each token, the rank of its pair with the next one and its own id in one number,
    so that the least number is the pair to join, the leftmost of equals first. Every step joins it
    and looks up the one or two pairs that this makes.
    """
    ranks, _ = _vocabulary(path)
    base, table, bits = _rank_map(path)
    words = _with_constants(words.select(*keep, F.col("word").alias("bytes_of_word")), rank_table=pa.array(table), rank_base=pa.array(base))
    ids_of, none = (1 << bits) - 1, 1 << 2 * bits  # none: above the number of every pair that merges
    byte_ids = _literal([ranks[bytes([b])] for b in range(256)], "array<bigint>")

    def folded(table: Column, base: Column) -> Column:
        def paired(left: Column, right: Column) -> Column:
            """The number of a token before another; null before nothing."""
            rank = F.get(table, F.get(base, left) + right).bitwiseXOR(left * (1 << bits))
            return (rank * (1 << bits)).bitwiseOR(left)

        def last(left: Column) -> Column:
            return left.bitwiseOR(F.lit(none))

        def step(s: Column, _: Column) -> Column:
            def join(least: Column, p: Column) -> Column:
                new, left, right = F.shiftright(least, bits), F.get(s, p - 2).bitwiseAND(ids_of), F.get(s, p + 1).bitwiseAND(ids_of)
                here, rest = F.coalesce(paired(new, right), last(new)), F.slice(s, p + 2, F.size(s))
                return F.when(p > 1, F.concat(F.slice(s, F.lit(1), p - 2), F.array(paired(left, new), here), rest)).otherwise(F.concat(F.array(here), rest))

            def least_at(least: Column) -> Column:
                return F.when(least >= none, s).otherwise(let(F.array_position(s, least).cast("int"), lambda p: join(least, p)))

            return let(F.array_min(s), least_at)

        def run(ids: Column) -> Column:
            start = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), lambda left, right: F.coalesce(paired(left, right), last(left)))
            return F.transform(F.aggregate(F.sequence(F.lit(1), F.size(ids) - 1), start, step), lambda x: x.bitwiseAND(ids_of).cast("int"))

        return let(F.transform("bytes_of_word", lambda b: F.get(byte_ids, b)), lambda ids: F.when(F.size(ids) > 1, run(ids)).otherwise(ids.cast("array<int>")))

    # each constant is in the plan once
    ids = let(F.col("rank_table"), lambda t: let(F.col("rank_base"), lambda b: folded(t, b)))
    return words.select(*keep, F.when(F.col("bytes_of_word").isNotNull(), ids).alias("ids"))


def _splitter(pattern: str):
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def _word_counts(pattern: str):
    """Each distinct word of up to BLOCK_WORDS, as an array of bytes, and how often it stands there; longer words than LONG_WORD left out."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in, counts = _splitter(pattern).findall, Counter()

        def done() -> pa.RecordBatch:
            words = [(list(b), n) for w, n in counts.items() if len(b := w.encode("utf-8", "surrogatepass")) <= LONG_WORD]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.list_(pa.int32())), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

        for batch in rows:
            for text in batch.column(0):
                counts.update(words_in(text.as_py() or ""))
                if len(counts) >= BLOCK_WORDS:
                    yield done()
                    counts.clear()
        yield done()

    return batches


def _known_words(texts: DataFrame, path: str, pattern: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words of a sample of the table's texts (one column), one after the other, their ends, the ends of their ids, and the ids."""
    name = texts.columns[0]
    chars = texts.agg(F.sum(F.length(name))).first()[0] or 0
    some = texts.filter(F.pmod(F.xxhash64(name), F.lit(1_000_000)) < min(1.0, SAMPLE_CHARS / max(chars, 1)) * 1_000_000)
    words = some.mapInArrow(_word_counts(pattern), "word array<int>, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.orderBy(F.col("n").desc(), "word").limit(KNOWN_WORDS).select("word")
    words = written(words.repartition(FOLD_TASKS), "known-words")
    found = fold(words, path, "word").toArrow()
    forget(words)

    def flat(name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """The values of a column of lists, one after the other, and the ends of the lists."""
        chunks = [c for c in found.column(name).chunks if len(c)]
        values = [c.flatten().to_numpy(zero_copy_only=False).astype(dtype) for c in chunks]
        sizes = [c.value_lengths().to_numpy(zero_copy_only=False) for c in chunks]
        return np.concatenate([np.empty(0, dtype=dtype), *values]), np.cumsum(np.concatenate([np.empty(0, dtype="<i8"), *sizes]))

    raw, word_ends = flat("word", "u1")
    ids, ends = flat("ids", "<i4")
    return raw.tobytes(), word_ends.astype("<i8"), ends.astype("<i8"), ids


def _split(keep: pa.Schema, text: str, pattern: str, out: pa.Schema, known: Broadcast):
    #: White space and what follows it up to the next: no match of the pattern crosses such a unit's end.
    unit = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    #: Units that are one match of the pattern, and most are.
    simple = re.compile(" ?(?:[A-Za-z]|[\xc0-\xd6]|[\xd8-\xf6]|[\xf8-\xff])+").fullmatch if pattern == public_tokenizers.PATTERN else lambda _: None

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in, (raw, ends, _, _) = _splitter(pattern).findall, known.value
        known_numbers = {raw[a:b].decode("utf-8", "surrogatepass"): i for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist()))}

        class Units(dict):
            """Word numbers, as bytes, of each unit; takes note of words neither known nor yet seen in the block."""

            def __init__(self):
                self.numbers: dict[str, int] = dict(known_numbers)
                self.new: list[bytes] = []

            def __missing__(self, key: str) -> bytes:
                found, numbers = array("i"), self.numbers
                for w in (key,) if simple(key) else words_in(key):
                    if (n := numbers.get(w)) is None:
                        n = numbers[w] = len(numbers)
                        self.new.append(w.encode("utf-8", "surrogatepass"))
                    found.append(n)
                if len(self) >= KEPT_UNITS:
                    self.clear()
                self[key] = out = found.tobytes()
                return out

        units = Units()

        def hand_over(docs: pa.RecordBatch | None, streams: list[bytes], starts: bool) -> pa.RecordBatch:
            new, units.new = units.new, []
            sizes = np.fromiter(map(len, new), dtype="<i4", count=len(new))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i4")
            flat = pa.array(np.frombuffer(b"".join(new), dtype=np.uint8).astype("<i4"))
            short = pa.ListArray.from_arrays(pa.array(np.concatenate([offsets, np.full(len(streams), offsets[-1], dtype="<i4")])), flat)
            if streams:
                short = pa.concat_arrays([short[: len(new)], pa.nulls(len(streams), short.type)])
            long = [w if len(w) > LONG_WORD else None for w in new]
            if any(x is not None for x in long):
                short = pa.array([None if l is not None else x for l, x in zip(long + [None] * len(streams), short.to_pylist())], type=short.type)
            columns = [pa.concat_arrays([pa.nulls(len(new), f.type), docs.column(f.name)]) if docs is not None else pa.nulls(len(new), f.type) for f in keep]
            columns += [short, pa.array([*long, *streams], type=pa.binary())]
            columns += [pa.array([0] * len(new) + [1] * len(streams), type=pa.int32()), pa.array([starts and i == 0 for i in range(len(new) + len(streams))])]
            return pa.RecordBatch.from_arrays(columns, schema=out)

        starts = True
        for batch in rows:
            texts, docs = batch.column(batch.schema.get_field_index(text)), batch.select([f.name for f in keep])
            first, size, streams = 0, 0, []
            for i, t in enumerate(texts):
                t = t.as_py() or ""
                streams.append(b"".join(map(units.__getitem__, unit.findall(t))))
                size += len(t)
                if size >= HAND_OVER or i == len(texts) - 1:
                    yield hand_over(docs.slice(first, i + 1 - first), streams, starts)
                    first, size, streams, starts = i + 1, 0, [], False
                    if len(units.numbers) - len(known_numbers) >= BLOCK_WORDS:
                        units, starts = Units(), True

    return batches


def _joined(keep: pa.Schema, path_merges, out: pa.Schema, known: Broadcast):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_ids, get_merges = path_merges
        _, _, known_ends, known_ids = known.value
        pool, ends = np.concatenate([known_ids, np.empty(1 << 16, dtype="<i4")]), np.concatenate([[0], known_ends, np.zeros(1 << 12, dtype="<i8")])  # ends[i + 1]: end of word i's ids
        fill, words = len(known_ids), len(known_ends)

        for batch in rows:
            n = batch.num_rows
            docs = batch.column(batch.schema.get_field_index("kind")).to_numpy() == 1
            resets = batch.column(batch.schema.get_field_index("starts")).to_numpy(zero_copy_only=False)
            streams, found = batch.column(batch.schema.get_field_index("stream")), batch.column(batch.schema.get_field_index("ids"))
            made: list[np.ndarray] = []
            cuts = [0, *(int(i) for i in np.flatnonzero(resets) if i), n]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and resets[a]:
                    fill, words = len(known_ids), len(known_ends)
                i = a
                while i < b:
                    j = i
                    while j < b and docs[j] == docs[i]:
                        j += 1
                    if docs[i]:
                        for k in range(i, j):
                            w = np.frombuffer(streams[k].as_buffer() or b"", dtype="<i4")
                            size = ends[w + 1] - ends[w]
                            total = int(size.sum())
                            made.append(pool[np.repeat(ends[w] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)] if total else pool[:0])
                    else:
                        part, size = found.slice(i, j - i), None
                        if part.null_count:
                            lists = [x if x is not None else merged([byte_ids[c] for c in streams[i + k].as_py()], get_merges()) for k, x in enumerate(part.to_pylist())]
                            part = pa.array(lists, type=pa.list_(pa.int32()))
                        flat, size = part.flatten().to_numpy(zero_copy_only=False), part.value_lengths().to_numpy(zero_copy_only=False)
                        while fill + len(flat) > len(pool):
                            pool = np.concatenate([pool, np.empty_like(pool)])
                        while words + j - i + 1 > len(ends):
                            ends = np.concatenate([ends, np.zeros_like(ends)])
                        pool[fill : fill + len(flat)] = flat
                        ends[words + 1 : words + 1 + j - i] = fill + np.cumsum(size)
                        fill, words = fill + len(flat), words + j - i
                    i = j
            if made:
                size = np.fromiter(map(len, made), dtype="<i4", count=len(made))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype("<i4")), pa.array(np.concatenate(made).astype("<i4")))
                chosen = batch.filter(pa.array(docs))
                yield pa.RecordBatch.from_arrays([*(chosen.column(f.name) for f in keep), ids], schema=out)

    return batches


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns `keep` of docs (by default all but text) and the ids of each row's whole text.

    A null text is empty and has no ids. Rows are independent of each other: repeated rows get
    equal ids, an empty table gives an empty one. A column of docs named like `ids` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, ids)]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    plain = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in names.items()), F.col(text).alias("text"))
    kept = T.StructType([T.StructField(k, plain.schema[k].dataType, True) for k in names.values()])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType, timezone="UTC") if isinstance(f.dataType, T.TimestampType) else to_arrow_type(f.dataType)) for f in kept])
    mid = T.StructType([*kept, T.StructField("word", T.ArrayType(T.IntegerType())), T.StructField("stream", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("starts", T.BooleanType())])
    mid_arrow = pa.schema([*arrow, pa.field("word", pa.list_(pa.int32())), pa.field("stream", pa.binary()), pa.field("kind", pa.int32()), pa.field("starts", pa.bool_())])
    end = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    end_arrow = pa.schema([*arrow, pa.field("ids", pa.list_(pa.int32()))])
    ranks, _ = _vocabulary(path)
    spark = docs.sparkSession.sparkContext
    known = spark.broadcast(_known_words(plain.select("text"), path, pattern))  # KNOWN_WORDS at most
    split = plain.mapInArrow(_split(arrow, "text", pattern, mid_arrow, known), mid)
    folded = fold(split, path, *names.values(), "stream", "kind", "starts")
    byte_ids = [ranks[bytes([b])] for b in range(256)]
    merges = spark.broadcast(_vocabulary(path)[1])  # as large as the vocabulary
    done = folded.mapInArrow(_joined(arrow, (byte_ids, lambda: merges.value), end_arrow, known), end)
    return done.select(*(F.col(k).alias(c) for c, k in names.items()), F.col("ids").alias(ids))


@cache
def _pieces(path: str) -> list[str]:
    """The bytes of each id in hexadecimal."""
    ranks, _ = _vocabulary(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return pieces


def _decoded(ids: Column, pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: the pieces of a literal array, concatenated; null for null."""
    return _decoded(ids, _literal(_pieces(path), "array<string>"))


def digests(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns `keep`, n_tokens, and SHA-256 of the ids in decimal and of the decoded bytes."""
    of, pieces = F.col(ids), fresh(encoded, "pieces")
    return _with_constants(encoded, **{pieces: pa.array(_pieces(path))}).select(
        *keep,
        F.size(of).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(of.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(_decoded(of, F.col(pieces)), 256).alias("decoded_sha256"),
    )
