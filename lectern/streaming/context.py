"""Rolling context as keyed streaming state, and resumable output by batches.

The state of a key is its last pairs; jobs that come again in another batch are not enriched twice, since
what is committed is left out before the translator is called.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Texts of a key's context.
LIMIT = 3


def _roll(limit: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")  # a key's rows of one micro-batch
        contexts = []
        for text in rows["text"]:
            contexts.append("|".join(seen))
            seen = [*seen, text][-limit:] if limit else []
        yield pd.DataFrame({"conv_id": key[0], "turn": rows["turn"], "context": contexts})
        state.update((seen,))

    return run


def rolling_context(stream: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, turn, context of a stream (conv_id, turn, text) whose turns come in order from one micro-batch to the next; within one they are sorted."""
    keyed = stream.select("conv_id", "turn", "text").groupBy("conv_id")
    return keyed.applyInPandasWithState(_roll(limit), "conv_id long, turn long, context string", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def commit_new(path: str, translate):
    """A foreachBatch function that translates the jobs (job_id, ...) not yet in the Parquet table at path and adds them.

    Each micro-batch has a folder of its own, batch=N, which it overwrites: a batch that comes again, after its first
    try failed at any point, leaves the same rows once. Jobs of other batches are left out before the translator is called.
    """

    def commit(batch: DataFrame, nth: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [str(s.getPath()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [d for d in done if d.rsplit("/", 1)[-1].startswith("batch=") and not d.endswith(f"batch={nth}") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{d}/_SUCCESS"))]
        todo = batch.dropDuplicates(["job_id"])
        if done:
            todo = todo.join(spark.read.parquet(*done).select("job_id"), "job_id", "left_anti")
        translate(todo).write.mode("overwrite").parquet(f"{path}/batch={nth}")

    return commit
