"""A corpus pipeline: quality classifier, line dedup, near-dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, classifier, line_dedup, minhash, mixing, stats
from lectern.llm.common import fresh, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.fit_texts(docs, labels)
    row = fresh(docs, "row")
    packed = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "text")
    good = classifier.scored(stats.shape(packed, [row, "doc_id"]), model).filter("predicted = 1")
    return good.select(f"{row}.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the blocks of lines of earlier ones; a document of which nothing is left goes.

    n_chars follows the text of a document that has lost lines.
    """
    out = line_dedup.deduplicated(docs).filter("n_lines_gone = 0 or length(trim(text)) > 0")
    changed = {"n_chars": F.when(F.col("n_lines_gone") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of documents linked by 5-word shingles."""
    gone = minhash.near_duplicates(docs, k=5).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)  # the same plan at every size


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, in the order of the queue."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids of each whole text, with their number and the digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    keep = [c for c in docs.columns if c in ("doc_id", "lang", "source")]
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=keep)
    return bpe.digests(ids, path, [*keep, "ids"])


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("source mixing", mix),
    ("byte-level bpe", tokenise),
]

#: The first stage learns from data, which SQL cannot express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
