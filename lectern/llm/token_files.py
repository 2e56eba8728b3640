"""Token ids in flat binary files.

A data set is a folder of shards in document order. Shard N has

* `shard-N.ids`: the ids of its documents, unsigned and little-endian, of 16 bits where the vocabulary
  has no more than 65,536 ids and else of 32, nothing between;
* `shard-N.offsets`: 64-bit little-endian offsets into that file, one a document and one at the end;
* `shard-N.docs`: the documents' doc_id, signed 64-bit little-endian (NO_DOC_ID for null);

and the manifest, a small Parquet table, has a row a shard with the bytes of an id and the number of ids and
documents before it: prefix sums of the shards' totals. A document's place in the whole is
its shard's base plus its offset. Readers map the files into memory where the folder is local.

Texts are encoded where they are read; what travels into document order are ids. The bounds of the shards
come from the keys alone, before that.

Files are written under a name of the task attempt and then renamed, so that an attempt that
is lost or repeated leaves nothing half written.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import new_path, written

#: White space as Unicode has it, at which a text falls into units that are encoded alike anywhere.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The tokenizer's own split of a unit, used where lower-casing and normalising are trivial.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
#: Units whose ids a worker keeps; then it starts afresh.
CACHE_UNITS = 1_000_000
#: A unit of letters of Latin-1 and at most one mark, as most are: the split needs no look at it.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]?)").fullmatch
#: White space to Python's split() that is none to Unicode.
SEPARATORS = re.compile("[\x1c-\x1f]").search
NO_DOC_ID = -(2**63)


def _printable_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Units(dict):
    """Ids, as bytes, of a unit of text between white space.

    The tokenizer drops white space, so a text's ids are those of its units in turn. Units
    outside Latin-1, or with what may be a special token, go through the whole tokenizer;
    others are lower-cased, split and given to the tokenizer's model word by word.
    """

    def __init__(self, json: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_str(json), {}
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.model, self.split, self.chars = self.tokenizer.model, regex.compile(WORDS), _printable_bytes()

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE_UNITS:
            self.clear()
            self.words.clear()
        if plain := PLAIN(unit):
            word, mark = plain.groups()
            ids = self.word(word.lower()) + self.word(mark) if mark else self.word(word.lower())
        elif "<|" in unit or max(unit) > "\xff":
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        else:
            ids = [i for w in self.split.findall(unit.lower()) for i in self.word(w)]
        self[unit] = out = array(self.kind, ids).tobytes()
        return out

    def word(self, w: str) -> list[int]:
        if (ids := self.words.get(w)) is None:
            ids = self.words[w] = [t.id for t in self.model.tokenize(w if w.isascii() and w.isprintable() else "".join(self.chars[b] for b in w.encode()))]
        return ids


@cache
def _units(json: str) -> Units:
    return Units(json)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder's address."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


def _encoder(json: str, end_id: int, bounds: list[tuple[int, int]]):
    """doc_id, tie, shard and ids, the end id with them, of rows (doc_id, tie, text)."""
    unit = regex.compile(f"[^{SPACE}]+").findall

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(json)
        end = array(units.kind, [end_id]).tobytes()
        for batch in rows:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = []
                for text in part.column(2):
                    text = text.as_py() or ""
                    ids.append(b"".join(map(units.__getitem__, unit(text) if SEPARATORS(text) else text.split())) + end)
                keys = zip(part.column(0).fill_null(NO_DOC_ID).to_pylist(), part.column(1).to_pylist())
                shards = [max(bisect_right(bounds, k) - 1, 0) for k in keys]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shards, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "tie", "shard", "ids"])

    return encode


def _writer(folder: str, width: int):
    """Writes the files of the shards in rows (shard, doc_id, ids) sorted by shard; a row a shard with its totals."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        attempt = f".{TaskContext.get().taskAttemptId()}"
        shard, ids_file, offsets, docs = None, None, [0], []

        def finished() -> pa.RecordBatch:
            name = f"{at}/shard-{shard:06d}"
            ids_file.close()
            for kind, data in (("offsets", np.array(offsets, dtype="<u8")), ("docs", np.concatenate(docs))):
                with fs.open_output_stream(f"{name}.{kind}{attempt}") as f:
                    f.write(data.tobytes())
            for kind in ("ids", "offsets", "docs"):
                fs.move(f"{name}.{kind}{attempt}", f"{name}.{kind}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(offsets) - 1], pa.int64()), "n_ids": pa.array([offsets[-1]], pa.int64())})

        for batch in rows:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and shards[a] != shard:
                    if shard is not None:
                        yield finished()
                    shard, offsets, docs = int(shards[a]), [0], []
                    ids_file = fs.open_output_stream(f"{at}/shard-{shard:06d}.ids{attempt}")
                for ids in batch.column(2)[a:b]:
                    data = ids.as_buffer()
                    ids_file.write(data)
                    offsets.append(offsets[-1] + data.size // width)
                docs.append(batch.column(1)[a:b].fill_null(NO_DOC_ID).to_numpy(zero_copy_only=False).astype("<i8"))
        if shard is not None:
            yield finished()

    return write


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the ids of every whole text, each followed by end_id, in ascending doc_id order; return the manifest.

    tokenizer: the path of a tokenizers file. docs needs doc_id (an integer) and text; a null
    text is empty and has the end id alone, a null doc_id sorts first, rows with equal doc_id
    follow each other in the order of a hash of their text. An empty table gives an empty
    manifest. The shards are ranges of doc_id and that hash, so repeated ids spread. Other columns are not read.
    """
    spark = docs.sparkSession
    folder, json = folder or new_path(spark, "tokens"), Path(tokenizer).read_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("doc_id", "tie").repartitionByRange(n, "doc_id", "tie").groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_DOC_ID)).alias("doc_id"), "tie")).alias("least"))
    bounds = sorted((r["least"]["doc_id"], r["least"]["tie"]) for r in ranges.collect())  # as many as shards
    encoded = rows.mapInArrow(_encoder(json, end_id, bounds), "doc_id long, tie long, shard int, ids binary")
    encoded = encoded.repartitionById(max(len(bounds), 1), "shard").sortWithinPartitions("shard", "doc_id", "tie").select("shard", "doc_id", "ids")
    width = _units(json).width
    shards = written(encoded.mapInArrow(_writer(folder, width), "shard int, n_docs long, n_ids long"), "token-shards")  # the files are written here, once
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shards
    bases = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n_docs", "n_ids")]
    return written(shards.select(F.lit(folder).alias("folder"), "shard", F.lit(width).alias("id_bytes"), "n_docs", "n_ids", *bases), "token-manifest")


class _File:
    """Numbers of a file by position: mapped into memory where the folder is local, else read piece by piece."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.dtype, local = np.dtype(dtype), isinstance(fs, pafs.LocalFileSystem)
        self.mapped = np.memmap(path, dtype=dtype, mode="r") if local else None
        self.file = None if local else fs.open_input_file(path)

    def part(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * size, start * size), dtype=self.dtype)


def open_shard(folder: str, shard: int, id_bytes: int) -> tuple[_File, _File, _File]:
    """ids, offsets and doc_ids of a shard."""
    fs, at = filesystem(folder)
    return tuple(_File(fs, f"{at}/shard-{shard:06d}.{kind}", dtype) for kind, dtype in (("ids", f"<u{id_bytes}"), ("offsets", "<u8"), ("docs", "<i8")))


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for row in batch.to_pylist():
            ids, offsets, docs = open_shard(row["folder"], row["shard"], row["id_bytes"])
            for i in range(0, row["n_docs"], 10_000):
                part = docs.part(i, min(i + 10_000, row["n_docs"]))
                ends = offsets.part(i, i + len(part) + 1).astype("<i8")
                crc = [zlib.crc32(ids.part(a, b).astype("<u4").data) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(np.asarray(part), mask=np.asarray(part) == NO_DOC_ID),
                        "start": pa.array(ends[:-1] + row["n_ids_before"]),
                        "n_tokens": pa.array(np.diff(ends)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )


def read(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document.

    One row a document that was written, null ids and repeated ones too; none for an empty manifest.
    """
    shards = manifest.repartition(F.col("shard"))
    return shards.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
