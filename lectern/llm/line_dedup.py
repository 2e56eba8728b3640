"""Line dedup by pairwise alignment.

1. Every line with a word gets a hash of its trimmed text.
2. Runs of lines find overlapping documents: the shortest run of BLOCK_WORDS words or more from a
   line on, and the shortest up to a line. Every line of a block of so many words is in such a run of the block. A
   later document is paired with the first document of each of its runs, so a passage in a million
   documents makes a million pairs, not their square, and none is too frequent to be found.
3. Each pair is aligned as patience diff does, with runs as what is matched: the longest chain of common runs in the same
   order on both sides, then again without that chain, for blocks that have moved or come several times.
4. Lines of aligned runs are deleted from the later document.

Only hashes of runs and their places are shuffled. The texts meet what is deleted at the end.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, written

#: Words of a block that is deleted at least.
BLOCK_WORDS = 25


def runs(hashes: list[int], words: list[int], block_words: int) -> list[tuple[int, int, int]]:
    """(hash, first line, last line) of the shortest runs of block_words words or more from each line on, and of the
    shortest up to each line where that is none of the first kind."""
    raw = array("q", hashes).tobytes()
    found: list[tuple[int, int, int]] = []
    start = total = 0

    def run(a: int, b: int) -> tuple[int, int, int]:
        return xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b + 8]) - 2**63, a, b

    for end, w in enumerate(words):
        total += w
        first = start
        while start <= end and total >= block_words:
            found.append(run(start, end))
            total -= words[start]
            start += 1
        if start == first and start:
            found.append(run(start - 1, end))
    return found


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _runs(block_words: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes, sizes = [], []
                for line in _lines(text.as_py()):
                    if w := len(line.split()):
                        hashes.append(xxhash.xxh3_64_intdigest(line.strip()) - 2**63)
                        sizes.append(w)
                for run in runs(hashes, sizes, block_words):
                    for c, v in zip(out, (doc, version, *run)):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["doc_id", "version", "run", "nth", "last"])

    return batches


def longest_chain(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence of numbers, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    under = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        under[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [p], [i]
    chain, i = [], piles[-1] if piles else -1
    while i >= 0:
        chain.append(i)
        i = under[i]
    return chain[::-1]


def aligned_blocks(matches: list[tuple[int, int, int]], passes: int = 8) -> list[tuple[int, int]]:
    """The (first, last) lines of the later document's blocks that another has; matches: (nth, last, other) of common runs.

    Chains are taken out one after the other; what is left after `passes` of them lies in no order, and each run of it is a
    block of its own.
    """
    left, blocks = sorted(matches), []
    for _ in range(passes):
        if not left:
            break
        chain = longest_chain([m[2] for m in left])
        taken = set(chain)
        last = None
        for nth, end, other in (left[i] for i in chain):
            if last and nth <= blocks[-1][1] + 1 and other - last[1] == nth - last[0]:
                blocks[-1] = (blocks[-1][0], max(end, blocks[-1][1]))
            else:
                blocks.append((nth, end))
            last = (nth, other)
        left = [m for i, m in enumerate(left) if i not in taken]
    return blocks + [(nth, end) for nth, end, _ in left]


def _aligned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, version, blocks (first and last lines, flat), firsts from (doc_id, version, matches)."""
    for batch in rows:
        docs, versions, blocks, firsts = [], [], [], []
        for row in batch.to_pylist():
            gone, of = [], []
            for first, some in groupby(sorted(row["matches"], key=lambda m: m["first"]), key=lambda m: m["first"]):
                gone += aligned_blocks([(m["nth"], m["last"], m["other"]) for m in some])
                of.append(first)
            docs.append(row["doc_id"])
            versions.append(row["version"])
            blocks.append([x for block in sorted(gone) for x in block])
            firsts.append(of)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(versions, pa.int64()), pa.array(blocks, pa.list_(pa.int32())), pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "version", "blocks", "firsts"])


def _version() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def removals(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, version (of the text), blocks (first and last of the lines with a word to delete, one after the other), firsts (the documents aligned with).

    Rows that repeat a doc_id are judged each by its own text, and never against each other; a null doc_id is left out.
    """
    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version"), "text")
    of = written(keyed.mapInArrow(_runs(block_words), "doc_id long, version long, run long, nth int, last int"), "runs")
    shared = of.groupBy("run").agg(F.min(F.struct("doc_id", "nth")).alias("at"), F.count("*").alias("df")).filter("df > 1")
    shared = shared.select("run", F.col("at.doc_id").alias("first"), F.col("at.nth").alias("other"))
    common = of.join(shared, "run").filter("doc_id > first").groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "nth", "last", "other")).alias("matches"))  # a document's own runs
    return common.mapInArrow(_aligned, "doc_id long, version long, blocks array<int>, firsts array<long>")


def _cut(text: str | None, blocks: Iterable[int] | None) -> tuple[str | None, int, int]:
    """A text without the lines of its blocks, and the lines and words that go."""
    if text is None or blocks is None:
        return text, 0, 0
    gone: set[int] = set()
    flat = list(blocks)
    for a, b in zip(flat[::2], flat[1::2]):
        gone.update(range(a, b + 1))
    kept, nth, words = [], -1, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        nth += n > 0
        if n and nth in gone:
            words += n
        else:
            kept.append(line)
    return "\n".join(kept), len(gone), words


def _rest(text: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_cut(t, b) for t, b in zip(text, blocks)], columns=["text", "n_lines", "n_words"])


def deduplicated(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the blocks of lines that an earlier document (a smaller doc_id) has, plus n_lines_gone, n_words_gone, aligned_with.

    Blank lines neither match nor count; the rest of a text stays as it is, its lines joined by one
    newline. A null or empty text, and a row with null doc_id, stays unchanged. Rows that repeat a doc_id
    lose the lines that their own text shares with smaller doc_ids, and none to each other. An empty table gives an empty result.
    Other columns pass through; those named like the added ones are replaced. A text all of whose
    lines are deleted is empty.
    """
    docs = docs.drop("n_lines_gone", "n_words_gone", "aligned_with")
    key, version, blocks, firsts, own, rest = (fresh(docs, f"dedup_{c}") for c in ("doc", "version", "blocks", "firsts", "own", "rest"))
    found = removals(docs, block_words).toDF(key, version, blocks, firsts).hint("merge")  # the same plan at every size
    out = docs.withColumn(own, _version())
    out = out.join(found, (out["doc_id"].cast("long") == found[key]) & (out[own] == found[version]), "left")
    hit = F.col(blocks).isNotNull()
    cut = F.pandas_udf(_rest, "text string, n_lines int, n_words int")
    out = out.withColumn(rest, cut(F.when(hit, F.col("text")), F.col(blocks)))  # only texts that lose lines go to Python
    return out.select(
        *(F.when(hit, F.col(f"{rest}.text")).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(hit, F.col(f"{rest}.n_lines")).otherwise(0).alias("n_lines_gone"),
        F.when(hit, F.col(f"{rest}.n_words")).otherwise(0).alias("n_words_gone"),
        F.coalesce(F.col(firsts), F.array().cast("array<bigint>")).alias("aligned_with"),
    )
