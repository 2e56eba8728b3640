"""Pages as tables of tokens with their open elements, and the total partition of their text.

Every text node of a body becomes part of a unit, which its nearest block owns, or is skipped
for a stated reason: the characters of units and skips add up to those of the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import css

#: Comments, scripts and styles are one token each; a tag that the page's end cuts off is one too.
TOKEN = re.compile(r"<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>?|[^<]+", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_DISPLAY = re.compile(r"display\s*:\s*([a-zA-Z-]+)")

_ANCESTOR = pa.struct([("ord", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("note", pa.bool_()), ("pagebreak", pa.bool_()), ("hidden", pa.bool_())])
TOKENS = "page_id long, ord int, kind string, tag string, text string, anc array<struct<ord:int,tag:string,classes:array<string>,note:boolean,pagebreak:boolean,hidden:boolean>>"


def attributes(tag: str) -> dict[str, str]:
    head = _NAME.match(tag)
    found = _ATTR.findall(tag[head.end() :].rstrip(">").rstrip("/")) if head else []
    return {k.lower(): _html.unescape(v.strip("\"'")) for k, v in found}


def _ancestor(i: int, name: str, tag: str) -> dict:
    a = attributes(tag)
    kinds, role = a.get("epub:type", ""), a.get("role", "")
    shown = _DISPLAY.search(a.get("style", ""))
    return {
        "ord": i,
        "tag": name,
        "classes": a.get("class", "").split(),
        "note": bool(set(kinds.split()) & set(K.NOTE_TYPES)) or role in K.NOTE_ROLES,
        "pagebreak": "pagebreak" in kinds or "page-list" in kinds or role == "doc-pagebreak",
        "hidden": "hidden" in a or bool(shown and shown[1].lower() == "none"),
    }


def _walk(html: str | None) -> Iterator[tuple[int, str, str | None, str, object]]:
    """ord, kind, tag, text of each token; after a token that opens an element a step `open` with the element, before
    one that closes some a step `close` with how many stay open.

    A start tag opens its element unless it is void; an end tag closes the innermost of its name and
    what is open within, or nothing. Texts have character references decoded.
    """
    tags: list[str] = []
    for i, token in enumerate(TOKEN.findall(html or ""), 1):
        if token[0] != "<":
            yield i, "text", None, _REFERENCE.sub(lambda m: _html.unescape(m[0]), token) if "&" in token else token, None
            continue
        name = _NAME.match(token)
        tag = name[1].lower() if name else None
        if tag in ("script", "style") and token[1] != "/":
            yield i, "opaque", tag, token, None
        elif not tag:
            yield i, "other", None, token, None
        elif token[1] == "/":
            at = next((k for k in range(len(tags) - 1, -1, -1) if tags[k] == tag), None)
            if at is not None:
                del tags[at:]
                yield i, "close", tag, token, at
            yield i, "end", tag, token, None
        else:
            yield i, "void" if tag in K.VOID_TAGS else "start", tag, token, None
            if tag not in K.VOID_TAGS and not token.endswith("/>"):
                tags.append(tag)
                yield i, "open", tag, token, _ancestor(i, tag, token)


def tokenize(html: str | None) -> Iterator[tuple[int, str, str | None, str, list[dict]]]:
    """ord, kind, tag, text and open elements of each token."""
    open_: list[dict] = []
    for i, kind, tag, token, step in _walk(html):
        if kind == "open":
            open_.append(step)
        elif kind == "close":
            del open_[step:]
        else:
            yield i, kind, tag, token, list(open_)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(_ANCESTOR))
    names = ["page_id", "ord", "kind", "tag", "text", "anc"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            for row in tokenize(html.as_py()):
                for column, value in zip(out, (page, *row)):
                    column.append(value)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)


def tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), html).mapInArrow(_rows, TOKENS)


def body_nodes(toks: DataFrame) -> DataFrame:
    """Text nodes of the bodies; a line break outside pre is a node of white space."""

    def inside(tag: str) -> Column:
        return F.exists("anc", lambda a: a["tag"] == tag)

    breaks = (F.col("kind") == "void") & (F.col("tag") == "br") & ~inside("pre")
    return toks.filter(inside("body") & ((F.col("kind") == "text") | breaks)).select("page_id", "ord", F.when(breaks, "\n").otherwise(F.col("text")).alias("text"), "anc")


def signature(anc: Column) -> Column:
    """The tag, with the first class if there is one."""
    return F.concat_ws(".", anc["tag"], F.try_element_at(anc["classes"], F.lit(1)))


def is_block(anc: Column, displays: dict[str, str] | None = None) -> Column:
    """Whether an element is a block; displays: display by `tag.class`, `.class` or `tag`, the last declared of each tier first."""
    by_tag = anc["tag"].isin(*K.BLOCK_TAGS)
    if not displays:
        return by_tag
    shown = display_of(anc, displays)
    return F.when(shown.isNull(), by_tag).otherwise(shown.isin(*K.BLOCK_DISPLAYS))


def display_of(anc: Column, displays: dict[str, str]) -> Column:
    """The display that a stylesheet gives an element, or null: tag.class before .class before tag, the last declaration in a tier."""
    last_first = list(displays.items())[::-1]

    def tier(test) -> Column:
        found = F.lit(None).cast("string")
        for selector, value in reversed([x for x in last_first if test(*x[0].split(".", 1)) is not None]):
            found = F.when(test(*selector.split(".", 1)), F.lit(value)).otherwise(found)
        return found

    return F.coalesce(
        tier(lambda tag, cls=None: (anc["tag"] == tag) & F.array_contains(anc["classes"], cls) if tag and cls else None),
        tier(lambda tag, cls=None: F.array_contains(anc["classes"], cls) if not tag and cls else None),
        tier(lambda tag, cls=None: anc["tag"] == tag if not cls else None),
    )


def ancestor_reason(anc: Column, excluded: tuple[str, ...] = K.EXCLUDED_TAGS, displays: dict[str, str] | None = None) -> Column:
    """The reason of the nearest element that has one; hidden only without such and outside notes."""

    def of(a: Column) -> Column:
        return F.when(a["tag"].isin(*K.NON_CONTENT_TAGS), "non-content").when(a["tag"].isin(*K.RUBY_TAGS), "ruby").when(a["tag"].isin(*excluded), "excluded-tag").when(a["pagebreak"], "pagebreak")

    def hides(a: Column) -> Column:
        return a["hidden"] | (F.coalesce(display_of(a, displays) == "none", F.lit(False)) if displays else F.lit(False))

    direct = F.filter(F.transform(F.reverse(anc), of), lambda r: r.isNotNull())
    hidden = F.exists(anc, hides) & ~F.exists(anc, lambda a: a["note"])
    return F.coalesce(F.get(direct, 0), F.when(hidden, "hidden"))


_PART = "page_id long, ord int, text string, chars int, reason string, owner int, parent int, grandparent int, parent_signature string, signature string"
_UNIT = "page_id long, unit_ord int, signature string, text string, chars long, owner int, parent int, grandparent int, parent_signature string"
_ALNUM = regex.compile(r"[\p{L}\p{N}]").search
_LINK = re.compile(T.URL).match
_STRIP = " \t\n\f\r"
_INVISIBLE = dict.fromkeys(map(ord, "\xad\u200b\ufeff"))
_BLANK = re.compile(T.WS + "+")


def _normal(text: str) -> str:
    return _BLANK.sub(" ", text.translate(_INVISIBLE)).strip(" ")


def _skip(text: str) -> str | None:
    """whitespace, link or symbol, else None: what functions.text.skip_reason() says of normalised text."""
    return "whitespace" if not text.strip(_STRIP) else "link" if _LINK(text.strip(_STRIP)) else None if _ALNUM(text) else "symbol"


class _Element:
    """An open element, with what it and the elements around it say of the text inside."""

    __slots__ = ("block", "hidden", "in_body", "in_pre", "in_ruby", "noted", "of_block", "ord", "pieces", "reason", "roots", "signature", "up")

    def __init__(self, of: dict, up: "_Element | None", excluded: frozenset[str], displays: dict[str, str]):
        tag, self.up, self.ord = of["tag"], up, of["ord"]
        self.signature = f"{tag}.{of['classes'][0]}" if of["classes"] else tag
        shown = _display(tag, of["classes"], displays) if displays else None
        self.block = tag in K.BLOCK_TAGS if shown is None else shown in K.BLOCK_DISPLAYS
        own = "non-content" if tag in K.NON_CONTENT_TAGS else "ruby" if tag in K.RUBY_TAGS else "excluded-tag" if tag in excluded else "pagebreak" if of["pagebreak"] else None
        self.reason = own or (up.reason if up else None)
        self.hidden = of["hidden"] or shown == "none" or bool(up and up.hidden)
        self.noted = of["note"] or bool(up and up.noted)
        self.in_body, self.in_pre, self.in_ruby = (any((tag in tags, up and getattr(up, name))) for tags, name in ((("body",), "in_body"), (("pre",), "in_pre"), (K.RUBY_TAGS, "in_ruby")))
        self.of_block = self if self.block else up.of_block if up else None
        # the outermost inline element within a block: its whole text has one verdict
        self.pieces: list[str] | None = [] if not self.block and up and up.block else None
        self.roots: list[_Element] = [*(up.roots if up else ()), *([self] if self.pieces is not None else ())]

    def verdict(self) -> str | None:
        return self.reason or ("hidden" if self.hidden and not self.noted else None)

    def root(self) -> "_Element | None":
        """The root that the text inside shares its verdict with: the last one, unless a block stands within."""
        return self.roots[-1] if self.of_block and not self.block and self.roots else None


def _display(tag: str, classes: list[str], displays: dict[str, str]) -> str | None:
    """What display_of() says."""
    last_first = [(*s.partition("."), v) for s, v in displays.items()][::-1]
    tiers = (lambda t, c: t == tag and c and c in classes, lambda t, c: not t and c and c in classes, lambda t, c: t == tag and not c)
    return next((v for fits in tiers for t, _, c, v in last_first if fits(t, c)), None)


def parts_of(html: str | None, excluded: frozenset[str], displays: dict[str, str]) -> list[tuple]:
    """The rows of partition() of one page, without page_id."""
    open_: list[_Element] = []
    nodes: list[tuple[int, str, _Element]] = []
    for i, kind, tag, token, anc in _walk(html):
        if kind == "open":
            open_.append(_Element(anc, open_[-1] if open_ else None, excluded, displays))
        elif kind == "close":
            del open_[anc:]
        elif open_ and open_[-1].in_body and (kind == "text" or tag == "br" and not open_[-1].in_pre):
            top, text = open_[-1], token if kind == "text" else "\n"
            nodes.append((i, text, top))
            if not top.in_ruby:
                for root in top.roots:
                    root.pieces.append(text)
    judged: dict[int, str | None] = {}
    out = []
    for i, text, top in nodes:
        chars = len(text.strip(_STRIP))
        reason = top.verdict() if chars else "whitespace"
        if reason is None:
            if (root := top.root()) is None:
                reason = _skip(_normal(text))
            else:
                if root.ord not in judged:
                    judged[root.ord] = _skip(_normal("".join(root.pieces)))
                reason = judged[root.ord]
        block = top.of_block
        parent = block.up if block else None
        grand = parent.up if parent else None
        out.append((i, text, chars, reason, block and block.ord, parent and parent.ord, grand and grand.ord, parent.signature if parent else "", block.signature if block else ""))
    return out


def units_of(parts: list[tuple]) -> list[tuple]:
    """The rows of units() of one page's parts, without page_id."""
    blocks: dict[tuple, list[tuple]] = {}
    for part in parts:
        blocks.setdefault(part[4:], []).append(part)
    out = []
    for (owner, parent, grand, parent_signature, signature), some in blocks.items():
        kept = [p for p in some if p[3] is None]
        if kept:
            pieces = [text if reason is None or not chars else " " if text != text.strip(_STRIP) else "" for _, text, chars, reason, *_ in some]
            out.append((kept[0][0], signature, _normal("".join(pieces)), sum(p[2] for p in kept), owner, parent, grand, parent_signature))
    return out


def _one_pass(schema: str, of_page, excluded: tuple[str, ...], displays: dict[str, str] | None):
    fields = [f.split() for f in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t] for _, t in fields]
    names, without, shown = [n for n, _ in fields], frozenset(excluded), displays or {}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_sheets: dict[tuple[str, ...], dict[str, str]] = {}
        for batch in rows:
            out: list[list] = [[] for _ in names]
            for page, html, sheets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                own = shown
                if sheets:
                    own = of_sheets.get(tuple(sheets)) or of_sheets.setdefault(tuple(sheets), css.displays(sheets))
                for row in of_page(parts_of(html.as_py(), without, own)):
                    for column, value in zip(out, (page, *row)):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    return batches


def _for_pass(pages: DataFrame, html: str, sheets: str | None) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), html, F.col(sheets) if sheets else F.lit(None).cast("array<string>").alias("_sheets"))


def partition(pages: DataFrame, excluded: tuple[str, ...] = K.EXCLUDED_TAGS, displays: dict[str, str] | None = None, html: str = "html", sheets: str | None = None) -> DataFrame:
    """The text nodes of pages: page_id, ord, text, chars, reason (null: kept), owner (ord of the block), parent, grandparent, parent_signature, signature.

    A node without a reason of its elements shares the verdict on the text of its whole inline
    element, so `<a><span>C</span><span>HAPTER I</span></a>` is judged as CHAPTER I. Everything that a verdict needs is on its page, so
    one pass over the pages does it, without a shuffle. A null page has no nodes. sheets: a column with the stylesheets of
    each page (an array, in order); where it is null or empty, displays holds.
    """
    return _for_pass(pages, html, sheets).mapInArrow(_one_pass(_PART, lambda parts: parts, excluded, displays), _PART)


def page_units(pages: DataFrame, excluded: tuple[str, ...] = K.EXCLUDED_TAGS, displays: dict[str, str] | None = None, html: str = "html", sheets: str | None = None) -> DataFrame:
    """units(partition(pages)) in the same pass, without a shuffle."""
    return _for_pass(pages, html, sheets).mapInArrow(_one_pass(_UNIT, units_of, excluded, displays), _UNIT)


def units(parts: DataFrame) -> DataFrame:
    """page_id, unit_ord (the first kept node), signature, text, chars, owner, parent, grandparent, parent_signature of each unit of a partition()."""
    kept = F.col("reason").isNull()
    edge = F.col("text") != T.strip(F.col("text"))
    piece = F.when(kept | (F.col("chars") == 0), F.col("text")).when(edge, " ").otherwise("")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("piece")))), lambda x: x["piece"]), "")
    out = parts.groupBy("page_id", "owner", "parent", "grandparent", "parent_signature", "signature").agg(F.min(F.when(kept, F.col("ord"))).alias("unit_ord"), T.normalize(whole).alias("text"), F.sum(F.when(kept, F.col("chars")).otherwise(0)).alias("chars"))
    return out.filter("unit_ord is not null").select("page_id", "unit_ord", "signature", "text", "chars", "owner", "parent", "grandparent", "parent_signature")


def skips(parts: DataFrame) -> DataFrame:
    """reason, chars of what is skipped."""
    return parts.filter("reason is not null and chars > 0").groupBy("reason").agg(F.sum("chars").alias("chars"))
