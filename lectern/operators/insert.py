"""Translations back into pages: beside each unit, inside elements that may not be doubled, or in the unit's place.

A page is written again token by token, so that what no unit owns stays byte for byte as it was.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.operators.html import TOKEN, _walk, parts_of

# Elements that a parent may have once; parts of a ruby annotation.
SINGLE_TAGS = ("figcaption", "caption", "legend", "summary")
ANNOTATIONS = ("rt", "rp", "rtc")
_ID = re.compile(r"\s+id\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


@dataclass
class _Span:
    """An element: its tag, the places of its first token and of the token before which it ends, and whether that token is its own end tag."""

    ord: int
    tag: str
    up: "_Span | None"
    in_nav: bool
    end: int = 0
    closed: bool = False
    children: list["_Span"] = field(default_factory=list)


def _spans(html: str) -> tuple[list[str], dict[int, _Span], dict[int, int]]:
    """Tokens, elements by the number of their start tag, and the element that each token is in."""
    tokens, spans, parents, open_ = TOKEN.findall(html), {}, {}, []
    for i, kind, tag, _, step in _walk(html):
        if kind == "open":
            up = open_[-1] if open_ else None
            span = spans[i] = _Span(i, tag, up, bool(up and (up.in_nav or up.tag == "nav")))
            if up:
                up.children.append(span)
            open_.append(span)
        elif kind == "close":
            for k, span in enumerate(reversed(open_[step:])):
                span.end, span.closed = i - 1, k == len(open_) - step - 1
            del open_[step:]
        else:
            parents[i] = open_[-1].ord if open_ else 0
    for span in open_:
        span.end = len(tokens)
    return tokens, spans, parents


def _only_text(tokens: list[str], span: _Span) -> str | None:
    """The text of an element that has no other content than one text, maybe in elements around it alone."""
    inside = tokens[span.ord : span.end]
    texts = [t for t in inside if t[0] != "<"]
    at = next((k for k, t in enumerate(inside) if t[0] != "<"), 0)
    lone = len(texts) == 1 and all(t[1] != "/" for t in inside[:at]) and all(t[1:2] == "/" for t in inside[at + 1 :])
    return _html.unescape(texts[0]) if lone else None


def _beside(tokens: list[str], spans: dict[int, _Span], wanted: dict[int, str], style: str) -> str:
    before: dict[int, list[str]] = {}
    css = f' style="{_html.escape(style)}"' if style else ""
    for owner, text in sorted(wanted.items(), key=lambda x: -x[0]):  # what is inside comes first where two elements end together
        span = spans.get(owner)
        if span is None or (own := _only_text(tokens, span)) is not None and own.replace(" ", "").strip() == text.replace(" ", "").strip():
            continue
        shown = _html.escape(text, quote=False)
        if span.tag in SINGLE_TAGS or span.in_nav:
            host = next((c for c in span.children if c.tag in ("a", "span")), span) if span.tag == "li" and span.in_nav else span
            before.setdefault(host.end, []).append(f"<br/><span{css}>{shown}</span>")
        else:
            start = _ID.sub("", tokens[owner - 1])
            start = re.sub(r"(?i)\s+style\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", start)[:-1] + css + ">" if css else start
            at = span.end + 1 if span.closed else span.end
            before.setdefault(at, []).append(f"{start}{shown}</{span.tag}>")
    return "".join("".join(before.get(i, ())) + (tokens[i] if i < len(tokens) else "") for i in range(len(tokens) + 1))


def _instead(html: str, tokens: list[str], spans: dict[int, _Span], parents: dict[int, int], wanted: dict[int, str], excluded: frozenset[str], displays: dict[str, str]) -> str:
    owned: dict[int, list[int]] = {}
    for part in parts_of(html, excluded, displays):
        if part[3] is None:
            owned.setdefault(part[4], []).append(part[0])
    new = list(tokens)
    for owner, nodes in owned.items():
        if owner not in wanted:
            continue
        inside = {parents[n] for n in nodes}
        for n in nodes:
            new[n - 1] = ""
            up = spans.get(parents[n])
            while up and up.ord != owner:
                if up.tag == "ruby":
                    stack = list(up.children)
                    while stack:
                        child = stack.pop()
                        if child.tag in ANNOTATIONS:
                            new[child.ord - 1 : child.end + child.closed] = [""] * (child.end + child.closed - child.ord + 1)
                        else:
                            stack += child.children
                up = up.up
        new[nodes[0] - 1] = _html.escape(wanted[owner], quote=False)
        for i in range(owner + 1, spans[owner].end + 1):
            parent = parents.get(i)
            if parent in inside and re.match(r"(?i)<br\b", tokens[i - 1]):
                kin = [n for n in nodes if parents[n] == parent]
                if kin[0] < i < kin[-1]:
                    new[i - 1] = ""  # a break between what is one text now
    return "".join(new)


def inserted(html: str | None, wanted: dict[int, str], style: str = "", single: bool = False, excluded=K.EXCLUDED_TAGS, displays: dict[str, str] | None = None) -> str | None:
    """A page with translations by the number of the block that owns a unit.

    Beside the original stands a copy of its element without ids, with the translation as its text; where a copy
    would not be valid (captions, legends, summaries, anything in nav) it stands in the element behind a line break. With
    `single` the unit's own text nodes are replaced, and everything else in the element stays. A text that is
    its own translation gets none. A null page stays null.
    """
    if html is None or not wanted:
        return html
    tokens, spans, parents = _spans(html)
    if single:
        return _instead(html, tokens, spans, parents, wanted, frozenset(excluded), displays or {})
    return _beside(tokens, spans, wanted, style)


def insert_translations(pages: DataFrame, translations: DataFrame, style: str = "", single: bool = False, failed: str | None = None) -> DataFrame:
    """page_id, html of pages (page_id, html) with translations (page_id, owner, translation); those that are null or `failed` are left out.

    One shuffle by page; a page's translations are as large as the page. A page without any stays as it is.
    """
    good = translations.filter(F.col("translation").isNotNull() & (F.lit(True) if failed is None else F.col("translation") != failed))
    of = good.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("owner").cast("int"), "translation")))).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [inserted(html, dict(wanted or ()), style, single) for html, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["page_id", "html"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").join(of, "page_id", "left")
    return rows.mapInArrow(run, "page_id long, html string")
