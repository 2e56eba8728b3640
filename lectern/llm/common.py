"""What the operators share: written cuts of lineage, let-binding, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset, as in tests, a temporary folder of this machine is set; on a cluster, whose executors
    would not see it, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not str(spark.conf.get("spark.master", "local")).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="lectern-")
        atexit.register(folder.cleanup)
        at = f"file://{folder.name}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, read again.

    A lost executor costs nothing beyond its running tasks, since every later
    read starts from the shared files.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.lectern_path = path
    return again


def forget(df: DataFrame | None) -> None:
    """Delete the files of a table from written() that nothing reads any more."""
    path = getattr(df, "lectern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
