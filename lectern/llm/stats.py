"""Statistics of a text as Spark expressions: the inputs of the quality rules and classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, WORD, let, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 8
#: What base() adds, and what shape() adds.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = ("mean_word", "symbol_rate", "upper_rate", "digit_rate", "mark_rate", "stop_rate", "other_rate", "distinct_rate", "repeat_rate", "dup_line_rate", "log_words", "line_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _rest(a: Column, start: int) -> Column:
    return F.slice(a, F.lit(start), F.size(a))


def _paired(a: Column, step: int) -> Column:
    """Hashes of twice as many words from the hashes `a` of windows of `step` words."""
    return let(a, lambda x: F.when(F.size(x) > step, F.slice(F.zip_with(x, _rest(x, step + 1), lambda p, q: F.xxhash64(p, q)), F.lit(1), F.size(x) - step)).otherwise(F.array().cast("array<bigint>")))


def _covered(windows: Column) -> Column:
    """Positions covered by windows whose hash occurs at least twice."""

    def positions(ranked: Column) -> Column:
        twice = F.zip_with(ranked, _rest(ranked, 2), lambda p, q: F.when(p["h"] == q["h"], F.array(p["i"], q["i"])).otherwise(F.array().cast("array<int>")))
        return F.array_sort(F.array_distinct(F.flatten(twice)))

    def length(at: Column) -> Column:
        steps = F.zip_with(at, _rest(at, 2), lambda p, q: F.coalesce(F.least(F.lit(WINDOW), q - p), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ranked, positions), length)


def repeat_words(word_list: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text.

    Windows are compared by a 64-bit hash, built by doubling: 1, 2, 4, 8 words. Only a
    text with a repeated window pays for the sort that finds where.
    """
    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    windows = _paired(_paired(_paired(hashes, 1), 2), 4)
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))


def base(df: DataFrame, keep: list[str], shape: bool = False) -> DataFrame:
    """The columns `keep` of df and the BASE statistics of its column text (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(w: Column) -> Column:
        fields = [F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")]
        if shape:
            fields.append(F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))).alias("n_distinct"))
        return F.struct(*fields)

    counts = [
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]
    if shape:
        counts += [
            _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            _without(text, "abcdefghijklmnopqrstuvwxyz").alias("n_lower"),
            _without(text, "0123456789").alias("n_digit"),
            _without(text, "!?").alias("n_mark"),
            _without(text, ".,;:").alias("n_stop"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]\n")).alias("n_lines"),
        ]
    out = df.select(*keep, let(words(F.col("text")), of).alias("of_words"), *counts)
    return out.select(*keep, "of_words.*", *(c for c in out.columns if c not in keep and c != "of_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shape(df: DataFrame, keep: list[str]) -> DataFrame:
    """BASE and the rates SHAPE of each text; rates of an empty text are 0."""
    b = base(df, keep, shape=True)
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    other = F.col("word_chars") - F.col("n_upper") - F.col("n_lower") - F.col("n_digit") - F.col("n_symbols") - F.col("n_mark") - F.col("n_stop")
    rates = {
        "mean_word": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / chars,
        "upper_rate": F.col("n_upper") / chars,
        "digit_rate": F.col("n_digit") / chars,
        "mark_rate": F.col("n_mark") / chars,
        "stop_rate": F.col("n_stop") / n,
        "other_rate": other / chars,
        "distinct_rate": F.col("n_distinct") / n,
        "repeat_rate": F.col("n_repeat_words") / n,
        "dup_line_rate": F.col("n_dup_lines") / (F.col("n_lines") + 1),
        "log_words": F.log1p("n_words"),
        "line_words": F.log1p(F.col("n_words") / (F.col("n_lines") + 1)),
    }
    return b.select(*keep, *BASE, *(v.cast("double").alias(k) for k, v in rates.items()))


def held_out() -> Column:
    """The fold that no model learns from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """rows (doc_id and statistics) outside the held-out fold with 0/1 in `label`; of several labels of a document the lowest counts.

    Statistics are joined, not texts, so what is shuffled is small whatever the texts are.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return rows.join(known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")), "doc_id")
