"""Stylesheets as rules of display, and their resolution as a top-1 join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?(?:\.([\w-]+))?")
_DISPLAY = re.compile(r"(?:^|[;\s{])display\s*:\s*([a-zA-Z-]+)")
_OTHER_MEDIA = re.compile(r"\b(print|speech|aural)\b")


def _statements(css: str) -> Iterator[tuple[str, str | None]]:
    """Preludes with their bodies; a statement that ends before any body has none."""
    depth = begin = opened = 0
    for m in re.finditer(r"[{};]", css):
        sign, at = m[0], m.start()
        if sign == "{":
            if not depth:
                opened = at
            depth += 1
        elif sign == "}" and depth:
            depth -= 1
            if not depth:
                yield css[begin:opened].strip(), css[opened + 1 : at]
                begin = at + 1
        elif sign == ";" and not depth:
            yield css[begin:at].strip(), None
            begin = at + 1
    if depth:
        yield css[begin:opened].strip(), css[opened + 1 :]


def rules(css: str) -> Iterator[tuple[str | None, str | None, str]]:
    """(tag, class, display) of simple selectors in the order of declaration.

    Rules within @media for the screen and @supports count; those for print, speech or aural media, fonts,
    pages and key frames do not.
    """
    for prelude, body in _statements(re.sub(r"/\*.*?\*/", " ", css, flags=re.S)):
        if prelude.startswith("@"):
            head = prelude.lower()
            if body and (head.startswith("@supports") or head.startswith("@media") and not _OTHER_MEDIA.search(head)):
                yield from rules(body)
        elif body and (shown := _DISPLAY.search(body)):
            for part in prelude.split(","):
                if (m := _SELECTOR.fullmatch(part.strip())) and (m[1] or m[2]):
                    yield m[1] and m[1].lower(), m[2], shown[1].lower()


def displays(sheets: list[str]) -> dict[str, str]:
    """Display by selector, last declared last; a selector declared again moves to the end."""
    out: dict[str, str] = {}
    for sheet in sheets:
        for tag, cls, value in rules(sheet):
            key = f"{tag or ''}.{cls}" if cls else str(tag)
            out.pop(key, None)
            out[key] = value
    return out


def rule_table(sheets: DataFrame) -> DataFrame:
    """sheet, rule, tag, class, display of sheets (sheet, css)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, i, *r) for s, css in zip(frame["sheet"], frame["css"]) for i, r in enumerate(rules(css or ""))]
            yield pd.DataFrame(rows, columns=["sheet", "rule", "tag", "class", "display"])

    return sheets.select("sheet", "css").mapInPandas(run, "sheet int, rule int, tag string, class string, display string")


def resolved(elements: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """elements (element, tag, classes) with display: the rule of the highest tier and, in it, the last declared; null without one.

    A join on what a selector names: an element has as many keys as classes, twice, and its tag. Of each selector only the last rule takes part.
    """
    cls = F.col("class")
    key = F.when(cls.isNull(), F.col("tag")).otherwise(F.concat(F.coalesce("tag", F.lit("")), F.lit("."), cls))
    tier = F.when(cls.isNull(), 1).when(F.col("tag").isNull(), 2).otherwise(3)
    last = rule_rows.groupBy(key.alias("key"), tier.alias("tier")).agg(F.max(F.struct("sheet", "rule", "display")).alias("last"))
    named = F.filter("classes", lambda c: c != "")
    keys = F.array_distinct(F.concat(F.array("tag"), F.transform(named, lambda c: F.concat(F.lit("."), c)), F.transform(named, lambda c: F.concat(F.col("tag"), F.lit("."), c))))
    of = elements.select("element", F.explode(keys).alias("key")).join(last, "key")
    best = of.groupBy("element").agg(F.max_by("last.display", F.struct("tier", "last.sheet", "last.rule")).alias("display"))
    return elements.select("element").distinct().join(best, "element", "left")
