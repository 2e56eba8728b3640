"""Scalar functions and predicates on lines of text, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, alike in Java and RE2.
WS = r"[ \t\n\f\r]"
#: A URL; one character class, since Java's matcher recurses on alternatives that repeat.
URL_HEAD, URL_TAIL = r"(?:https?://|www\.)+", r"[a-zA-Z0-9$-_@.&+!*(),%]"
URL = URL_HEAD + URL_TAIL + "+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def normalize(c: Column) -> Column:
    """Invisible characters removed, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "­​﻿", ""), rf"{WS}+", " "))


def clip(c: Column, size: int = 80) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c)


def is_link(c: Column) -> Column:
    return strip(c).rlike(f"^{URL}")


def is_tail_link(c: Column, size: int = 80) -> Column:
    return strip(c).rlike(f"{URL}$") & (F.length(strip(c)) < size)


def is_source(c: Column) -> Column:
    return strip(c).startswith("Source: ")


def is_listing(c: Column, size: int = 80) -> Column:
    return strip(c).rlike(rf"^Listing{WS}*[0-9]+") & (F.length(strip(c)) < size)


def is_figure(c: Column, size: int = 80) -> Column:
    return strip(c).rlike(rf"^Figure{WS}*[0-9]+") & (F.length(strip(c)) < size)


def is_digits(c: Column) -> Column:
    """Digits and white space alone; true of the empty text."""
    return c.rlike(r"^[\p{Nd} \t\n\f\r]*$")


def is_isbn(c: Column) -> Column:
    return c.rlike(rf"^[Ee]?ISBN{WS}*[0-9][0-9 \t\n\f\r]*$")


def is_untranslatable(c: Column) -> Column:
    return is_link(c) | is_tail_link(c) | is_source(c) | is_listing(c) | is_figure(c) | is_digits(c) | is_isbn(c)


def is_special(c: Column, kind: str = "txt") -> Column:
    """Lines that pass through untranslated; each format has its own rule, as the formats do."""
    if kind == "base":
        return (F.length(c) > 0) & is_digits(c)
    if kind == "txt":
        return is_digits(c)
    if kind == "md":
        return is_digits(strip(c))
    if kind == "epub":
        return is_digits(c) | is_link(c) | c.rlike(r"^[!-/:-@\[-`{-~]*$")
    raise ValueError(kind)


def skip_reason(c: Column) -> Column:
    """whitespace, link or symbol, else null."""
    return F.when(strip(c) == "", "whitespace").when(is_link(c), "link").when(~c.rlike(r"[\p{L}\p{N}]"), "symbol")


def shorten_links(c: Column, size: int = 20) -> Column:
    return F.when(F.length(F.regexp_extract(c, URL, 0)) >= size, F.regexp_replace(c, URL, "...")).otherwise(c)


def slug(c: Column, empty: str = "translated") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s)


def book_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-.]", "_"), r"^[._]+|[._]+$", "")


def sentences(c: Column) -> Column:
    """Parts between sentence ends; empty parts dropped."""
    cut = F.split(strip(c), rf"(?<=[.!?]){WS}+(?=[A-Z\"'(])")
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def job_id(doc: Column, name: Column, node: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("epub"), doc.cast("string"), name, node.cast("string"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def uuid5(namespace: str, c: Column) -> Column:
    """UUID of version 5 in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), c.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
