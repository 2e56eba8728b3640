"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They are the seed entities of
a graph between instances (every word with a digit, without the marks around it, and phone numbers) and lexical
patterns: one or two words to the left or right, the letters that the instance begins with, and its shape (each digit as 9, each
letter as a). Scores go round it:

* A pattern of words is worth the share of its occurrences that are instances scored so far; its occurrences in the
  whole corpus count, so "de" or "the" are worth nothing however often they precede an address. (For two words
  the count of the rarer one stands in, so that such a pattern is worth less rather than more.)
* A pattern of the instance itself is worth the share of scored instances among its own, where one that nothing is
  known about counts UNKNOWN, and one more counts against it.
* An unknown instance is worth the mean of its patterns of words, or the best of its own patterns if that is more. From LEAST_SCORE
  on it is personal data too, and takes part in the next round.

Positions come from marking: a replacement puts a sign before and after each match, and
splitting at the signs leaves the pieces whose lengths add up to positions. All expressions used
are free of repeated groups, on which Java's matcher would recurse, and of unbounded retries; running sums go by
chunks, so the work on a text grows in proportion to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, forget, let, written

KINDS = ("email", "ip", "card", "phone")
#: What the method finds beyond the base, and its place after those.
FOUND = "found"
#: Rounds of scoring; score of a found instance at least; occurrences that make a pattern count; what an unknown instance counts against a shape.
ROUNDS, LEAST_SCORE, LEAST_SEEN, UNKNOWN = 3, 0.6, 3, 0.05
#: Pieces whose lengths are summed at a time.
CHUNK = 128

#: Signs that mark a match's start and end, a separator within a number, and a dot within a domain.
START, END, LINK, DOT = "\x01", "\x02", "\x03", "\x04"
_LOCAL = r"A-Za-z0-9._%+\x04-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x04[A-Za-z0-9\x04-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x03]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word with a digit, once white space is blanks.
_NUMBERED = r"(?<![^\x20])(?=[^\x20]*?[0-9])[^\x20]++"

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid_card(m: Column) -> Column:
    return let(F.translate(m, f" -{LINK}", ""), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))


def _valid_phone(m: Column) -> Column:
    return F.length(F.translate(m, "+ ().-", "")).between(9, 15)


def _starts(first: Column, pieces: Column) -> Column:
    """Where each of `pieces` begins in the unmarked text, `first` characters being before them; each piece has one sign."""

    def sums(lengths: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def placed(chunks: Column) -> Column:
        bases = sums(F.transform(chunks, lambda c: c["at"]))["out"]
        return F.flatten(F.zip_with(chunks, bases, lambda c, base: F.transform(c["out"], lambda at: at + base + first)))

    last = F.ceil(F.size(pieces) / CHUNK).cast("int") - 1
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: sums(F.transform(F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK)), lambda p: F.length(p) - 1)))
    return F.when(F.size(pieces) > 0, let(chunks, placed)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """The valid ones of the leftmost non-overlapping matches: start and end in code points, value."""
    marked = F.split(F.regexp_replace(text, f"({pattern})", f"{START}$1{END}"), START)

    def spans(first: Column, pieces: Column) -> Column:
        found = F.zip_with(pieces, _starts(F.length(first), pieces), lambda p, at: let(F.substring_index(p, END, 1), lambda v: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value"))))
        return found if valid is None else F.filter(found, lambda m: valid(m["value"]))

    return let(marked, lambda all_pieces: let(F.slice(all_pieces, F.lit(2), F.size(all_pieces)), lambda pieces: spans(all_pieces[0], pieces)))


def _plain(text: Column) -> Column:
    """The text, null as empty, with the signs that mark matches replaced, so that lengths stay."""
    return F.translate(F.coalesce(text, F.lit("")), START + END + LINK + DOT, "\ufffd" * 4)


def base_spans(text: Column) -> Column:
    """A struct with the spans of each kind in KINDS; text: as _plain() gives it."""
    none = F.array().cast(_SPAN)
    dotted = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    linked = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", LINK)
    email = F.when(F.contains(text, F.lit("@")), matches(dotted, _EMAIL)).otherwise(none)
    digits = text.rlike("[0-9]")
    ip = F.when(digits & F.contains(text, F.lit(".")), matches(text, _IP, lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))).otherwise(none)
    card = F.when(digits, matches(linked, _CARD, _valid_card)).otherwise(none)
    phone = F.when(digits & F.contains(text, F.lit("+")), matches(text, _PHONE, _valid_phone)).otherwise(none)
    return F.struct(*(c.cast(_SPAN).alias(k) for k, c in zip(KINDS, (email, ip, card, phone))))


def _blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, " " * len(BLANKS))


def occurrences(rows: DataFrame) -> DataFrame:
    """doc_id, row_hash, start, end, instance, left, left2, right, right2 of each instance in rows (doc_id, row_hash, text).

    left and right are the words next to it, in lower case, left2 and right2 the ones beyond (null where there is none among the three
    nearest places between blanks). Rows that repeat doc_id and row_hash count once.
    """
    marked = F.split(F.regexp_replace(_blanks(F.col("text")), f"({_PHONE}|{_NUMBERED})", f"{START}$1{END}"), START)
    some = rows.filter(F.col("text").rlike("[0-9]"))

    def near(before: Column, after: Column) -> list[Column]:
        left = F.filter(F.split(F.lower(F.substring_index(before, " ", -4)), " "), lambda w: w != "")
        right = F.filter(F.split(F.lower(F.substring_index(after, " ", 4)), " "), lambda w: w != "")
        return [F.try_element_at(left, F.lit(-1)).alias("left"), F.try_element_at(left, F.lit(-2)).alias("left2"), F.get(right, 0).alias("right"), F.get(right, 1).alias("right2")]

    def found(all_pieces: Column, pieces: Column) -> Column:
        rest = F.transform(all_pieces, lambda p, i: F.when(i == 0, p).otherwise(F.substring_index(p, END, -1)))
        starts = _starts(F.length(all_pieces[0]), pieces)

        def of(rest: Column, starts: Column) -> Column:
            return F.transform(pieces, lambda p, i: F.struct(F.get(starts, i).alias("at"), F.substring_index(p, END, 1).alias("raw"), *near(F.get(rest, i), F.get(rest, i + 1))))

        return let(rest, lambda r: let(starts, lambda s: of(r, s)))

    each = let(marked, lambda all_pieces: let(F.slice(all_pieces, F.lit(2), F.size(all_pieces)), lambda pieces: found(all_pieces, pieces)))
    some = some.select("doc_id", "row_hash", F.explode(each).alias("x")).select("doc_id", "row_hash", "x.*")
    lead = F.length(F.regexp_extract("raw", r"^[\"'(\[<{]*+", 0))
    tail = F.length(F.regexp_extract(F.reverse("raw"), r"^[\"'.,;:!?)\]>}%#$*|&]*+", 0))
    some = some.withColumn("start", F.col("at") + lead).withColumn("end", F.col("at") + F.greatest(F.length("raw") - tail, lead))
    some = some.withColumn("instance", F.substring(F.col("raw"), lead + 1, F.greatest(F.length("raw") - lead - tail, F.lit(0)))).filter("instance != ''")
    return some.select("doc_id", "row_hash", "start", "end", "instance", "left", "left2", "right", "right2").dropDuplicates(["doc_id", "row_hash", "start"])


def word_counts(text: DataFrame) -> DataFrame:
    """word, n: how often each word, in lower case, stands in the texts of the table."""
    return text.select(F.explode(F.split(F.lower(_blanks(F.col("text"))), " ")).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def graph(found: DataFrame, counts: DataFrame) -> DataFrame:
    """instance, pattern, inner (of the instance itself), n (their occurrences together), total (those of the pattern)."""
    shape = F.regexp_replace(F.translate("instance", "0123456789", "9" * 10), "[A-Za-z]", "a")
    own = F.array(F.concat(F.lit("P "), F.regexp_extract("instance", "^[A-Za-z]{4}", 0)), F.concat(F.lit("H "), shape))
    inner = found.select("instance", F.explode(own).alias("pattern")).filter("length(pattern) > 2").groupBy("instance", "pattern").agg(F.count("*").alias("n"))
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.col(a).alias("word"), F.col(b).alias("beyond")) for k, a, b in (("L", "left", "left2"), ("R", "right", "right2"))))
    outer = found.select("instance", F.explode(sides).alias("s")).select("instance", "s.*").filter("word is not null").groupBy("instance", "side", "word", "beyond").agg(F.count("*").alias("n"))
    words = outer.select("word").unionByName(outer.select(F.col("beyond").alias("word"))).distinct()
    known = written(counts.join(words, "word"), "pii-words")
    outer = outer.join(known.withColumnRenamed("n", "of_word"), "word").join(known.select(F.col("word").alias("beyond"), F.col("n").alias("of_beyond")), "beyond", "left")
    one = outer.groupBy("instance", F.concat_ws(" ", "side", "word").alias("pattern")).agg(F.sum("n").alias("n"), F.first("of_word").alias("total"))
    two = outer.filter("beyond is not null").select("instance", F.concat_ws(" ", "side", "word", "beyond").alias("pattern"), "n", F.least("of_word", "of_beyond").alias("total"))
    outside = one.unionByName(two).withColumn("inner", F.lit(False))
    return outside.unionByName(inner.withColumn("inner", F.lit(True)).withColumn("total", F.lit(0).cast("long")))


def scores(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance, score of the instances that are no seeds (instance) and reach LEAST_SCORE, by rounds over the graph."""
    edges = written(edges.join(seeds.withColumn("seed", F.lit(True)), "instance", "left").withColumn("seed", F.coalesce("seed", F.lit(False))), "pii-graph")
    score = None
    for _ in range(rounds):
        if score is None:
            worth = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
        else:
            worth = edges.join(score, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        good, unknown = F.sum(F.col("score") * F.col("n")), F.sum(F.when(F.col("score") == 0, F.col("n")).otherwise(0))
        of = worth.groupBy("pattern", "inner").agg(good.alias("good"), unknown.alias("unknown"), F.sum("n").alias("seen"), F.max("total").alias("total"))
        against = F.when(F.col("inner"), F.col("good") + UNKNOWN * F.col("unknown")).otherwise(F.greatest("total", "seen")) + 1
        of = of.filter(F.col("seen") >= LEAST_SEEN).select("pattern", (F.col("good") / against).alias("worth"))
        mean, best = F.avg(F.when(~F.col("inner"), F.col("worth"))), F.max(F.when(F.col("inner"), F.col("worth")))
        new = edges.filter("not seed").join(of, "pattern").groupBy("instance").agg(F.coalesce(F.greatest(mean, best), F.lit(0.0)).alias("score"))
        last, score = score, written(new.filter(F.col("score") >= LEAST_SCORE), "pii-scores")
        forget(last)
    forget(edges)
    return score


def personal_data(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by kind and then start, joined by
    commas; base_sha256 is of the base kinds' alone. A null or empty text has none. Equal rows get equal
    results; an empty table gives an empty one; columns other than doc_id are not passed on.
    """
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row_hash"), _plain(F.col("text")).alias("text"))
    rows = rows.select("doc_id", "row_hash", "text", base_spans(F.col("text")).alias("base"))
    plain = written(rows.select("doc_id", "row_hash", "base", F.when(F.col("text").rlike("[0-9]"), F.col("text")).alias("text")), "pii-base")
    found = written(occurrences(plain.filter("text is not null").select("doc_id", "row_hash", "text")), "pii-found")
    seeds = plain.select(F.explode(F.flatten(F.array(*(F.col(f"base.{k}.value") for k in KINDS)))).alias("value"))
    seeds = seeds.select(F.translate("value", DOT + LINK, ".-").alias("instance")).distinct()
    good = scores(graph(found, word_counts(docs.filter("text is not null").select("text"))), seeds).select("instance")
    more = found.join(good, "instance").groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    out = plain.select("doc_id", "row_hash", "base").alias("p").join(more.alias("m"), F.col("p.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("p.row_hash") == F.col("m.row_hash")), "left")

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = F.flatten(F.array(*(named(k, F.col(f"base.{k}")) for k in KINDS)))
    spans = F.flatten(F.array(*(F.col(f"base.{k}") for k in KINDS)))
    beside = F.filter(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), lambda m: ~F.exists(spans, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])))
    other = named(FOUND, beside)
    return out.select(
        F.col("p.doc_id").alias("doc_id"),
        *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, other), ",").alias("spans"),
    )
