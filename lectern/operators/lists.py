"""Small operators on rows and lists: joined lines, windows of characters, wrapping, rotation, preference, limits, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def join_lines(text: Column) -> Column:
    """Consecutive lines that are not blank become one, trimmed and parted by a space; blank lines stay. A literal ^M ends a line."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.when(T.strip(x) == "", x).otherwise(T.strip(x)))
    joined = F.regexp_replace(F.array_join(trimmed, "\n"), r"(?<=[^ \t\n\f\r])\n(?=[^ \t\n\f\r])", " ")
    return F.regexp_replace(F.regexp_replace(joined, r"\^M\n?", "\n"), r"\n\z", "")


def windows(sizes: Column, share: Column | int) -> Column:
    """The window of each of an array of sizes: a new one when the sum would be above the share; each has one entry at least."""
    share = share if isinstance(share, Column) else F.lit(share)

    def step(s: Column, x: Column) -> Column:
        new = (s["n"] > 0) & (s["sum"] + x > share)
        window = s["window"] + F.when(new, 1).otherwise(0)
        return F.struct(window.alias("window"), F.when(new, x).otherwise(s["sum"] + x).cast("long").alias("sum"), F.lit(1).alias("n"), F.concat(s["out"], F.array(window)).alias("out"))

    zero = F.struct(F.lit(0).alias("window"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, step, lambda s: s["out"])


#: Characters that take two places.
WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}！-｠]"


def wrap(line: Column, width: int) -> Column:
    """A line's pieces that fit into `width` places, cut between any two characters; a tab is four spaces, a space at a cut goes."""
    chars = F.split(F.rtrim(F.regexp_replace(line, "\t", "    ")), "")

    def step(s: Column, c: Column) -> Column:
        size = F.when(c.rlike(WIDE), 2).otherwise(1)
        full = (s["cur"] != "") & (s["w"] + size > width)
        out = F.when(full, F.concat(s["out"], F.array(F.rtrim(s["cur"])))).otherwise(s["out"])
        blank = full & (c == " ")
        cur = F.when(blank, "").when(full, c).otherwise(F.concat(s["cur"], c))
        return F.struct(out.alias("out"), cur.alias("cur"), F.when(blank, 0).when(full, size).otherwise(s["w"] + size).alias("w"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("w"))
    pieces = F.aggregate(chars, zero, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(F.rtrim(s["cur"])))).otherwise(s["out"]))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))


def round_robin(rows: DataFrame, index: Column, keys: list[str], name: str = "key") -> DataFrame:
    """rows with one of the keys each, in turn by index."""
    return rows.withColumn(name, F.element_at(F.array(*map(F.lit, keys)), (F.pmod(index, F.lit(len(keys))) + 1).cast("int")))


def preferred(found: Column, order: Column) -> Column:
    """What is found of a list of preferences, in their order, each once."""
    return F.array_intersect(order, found)


def missing(wanted: Column, found: Column) -> Column:
    return F.array_except(wanted, found)


def most_common(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """key, n by falling n, then key."""
    return rows.groupBy(key).agg((F.sum(weight) if weight else F.count("*")).alias("n")).orderBy(F.col("n").desc(), key)


def largest_first(rows: DataFrame, size: str, *then: str) -> DataFrame:
    return rows.orderBy(F.col(size).desc(), *then)


def first_units(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The units with an index below n: a limit for trials, the same on every run."""
    return rows.filter(F.col(order) < n)


def first_batches(rows: DataFrame, order: str, batch: str, n: int) -> DataFrame:
    """Whole batches up to the one in which an index passes n: trials that stop after a batch."""
    last = rows.filter(F.col(order) > n).agg(F.min(batch).alias("last"))  # one row
    return rows.join(F.broadcast(last), F.col("last").isNull() | (F.col(batch) <= F.col("last")), "left_semi")


def choose_files(rows: DataFrame, name: str, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """rows with translate: a list of only some files drops the others; else excluded ones stay as they are."""
    if only:
        return rows.filter(F.col(name).isin(*only)).withColumn("translate", F.lit(True))
    return rows.withColumn("translate", ~F.col(name).isin(*exclude) if exclude else F.lit(True))


def all_passes(tagged: DataFrame, strings: DataFrame) -> DataFrame:
    """Units of tags and then of strings, duplicates kept."""
    return tagged.unionByName(strings)


def require_no_failures(rows: DataFrame, name: str, error: str) -> None:
    """Fails with the names that have an error, the first twenty of them, and their number."""
    failed = rows.filter(F.col(error).isNotNull())
    n = failed.count()
    if n:
        names = [str(r[0]) for r in failed.select(name).distinct().orderBy(name).limit(20).collect()]
        raise RuntimeError(f"{n} failed: {', '.join(names)}")


def resolve_path(base: Column, href: Column) -> Column:
    """The path that a relative reference names, seen from the file `base`: fragments cut, `.` and `..` resolved."""
    path = F.concat(F.regexp_replace(base, "[^/]*$", ""), F.regexp_replace(href, "#.*$", ""))

    def step(done: Column, part: Column) -> Column:
        up = F.regexp_replace(done, "(^|/)[^/]*$", "")
        return F.when((part == "") | (part == "."), done).when(part == "..", up).when(done == "", part).otherwise(F.concat(done, F.lit("/"), part))

    return F.aggregate(F.split(path, "/"), F.lit(""), step)


def api_root(url: Column) -> Column:
    """An API's address without a version at its end."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/v1$", "")
