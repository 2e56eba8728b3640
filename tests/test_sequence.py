import uuid

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import sequence
from lectern.streaming import context


def test_packing(spark):
    sizes = [[30, 40, 50, 200, 10, 90, 9], [], [100], [1, 1, 1]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s array<int>").select("i", sequence.packed(F.col("s"), 100).alias("a"), sequence.packed(F.col("s"), 100, 2).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in rows] == [[0, 0, 1, 2, 3, 4, 4], [], [0], [0, 0, 0]]
    assert rows[3]["b"] == [0, 0, 1]


def _history():
    sizes, kept = [], 0
    for _ in range(40):
        kept = 8 if kept + 1 > 10 else kept + 1
        sizes.append(kept)
    return sizes


def test_history_sizes(spark):
    got = spark.range(1).select(sequence.history_sizes(F.lit(40)).alias("s")).first()["s"]
    assert got == _history()


def test_uuid5(spark):
    got = spark.createDataFrame([("book|en",), ("ü",)], "t string").select("t", T.uuid5(uuid.NAMESPACE_URL.hex, F.col("t")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["t"])) for r in got)


def test_text_functions(spark):
    row = spark.createDataFrame([("  a­b \n c ", "x" * 81, "Hello, World!", "see http://example.com/a/very/long and www.a.b")], "a string, b string, c string, d string").select(T.normalize(F.col("a")).alias("a"), F.length(T.clip(F.col("b"))).alias("b"), T.slug(F.col("c")).alias("c"), T.shorten_links(F.col("d")).alias("d"), T.is_link(F.lit("https://" + "a" * 100_000)).alias("e")).first()
    assert row["a"] == "ab c" and row["b"] == 81 and row["c"] == "hello_world" and row["d"] == "see ... and ..." and row["e"]


def test_exactly_once(spark, tmp_path):
    calls = []

    def translate(todo):
        calls.append(todo.count())
        return todo

    commit = context.commit_new(str(tmp_path / "done"), translate)
    jobs = spark.createDataFrame([("a",), ("b",), ("b",)], "job_id string")
    commit(jobs, 0)
    commit(jobs.unionByName(spark.createDataFrame([("c",)], "job_id string")), 1)
    assert calls == [2, 1] and spark.read.parquet(str(tmp_path / "done")).count() == 3
