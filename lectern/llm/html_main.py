"""Main text of web pages by markup and by differencing against the nearest URLs.

1. A page is parsed into blocks of text. Blocks inside navigation, forms, adverts and the like are
   dropped by their markup.
2. Pages of a host with the same blocks count once. They are ordered by URL path, so that the nearest pages share the longest part of
   their address and most likely their template.
3. The blocks of every page are aligned with those of its nearest pages by the longest common
   subsequence, and the shared ones are deleted. A neighbour that shares most of a page's
   text is a copy of it, not a page of the same template, and the next nearest is taken.
4. A page amid many near copies, or one that is little more than its template, may find no neighbour that is not taken for a
   copy. So blocks that stand on more than TEMPLATE_SHARE of a host's pages, and at least TEMPLATE_PAGES, are deleted too, where
   pages with the same longest block count as one, as near copies have it, and so do pages whose longest is the template's.
5. Blocks inside a marked article are guarded: a sentence that two articles have in common is not a
   template. They are deleted only if both alignment and these counts say so.

Only hashes of blocks are ordered and aligned; the texts are parsed again and meet what is deleted at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head title script style noscript template nav aside form button select option textarea iframe object embed svg math canvas audio video map dialog menu search".split())
#: Words in class, id or role that say what an element is for.
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search popup modal overlay dialog toolbar pagination pager widget widgets skip copyright masthead complementary contentinfo".split()
)
EDGES = frozenset({"header", "footer"})
CONTENT = frozenset("article post entry content story body main".split())
#: A neighbour that shares more of a page's characters is its copy; neighbours looked at to each side, and used.
COPY_SHARE, LOOKED_AT, USED = 0.6, 4, 2
#: A block is a template by counts if a larger share of the host's pages have it, and so many of them.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 4


def _words_of(attrs: dict[str, str | None]) -> set[str]:
    found = " ".join(attrs.get(a) or "" for a in ("class", "id", "role"))
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()))


class Blocks(HTMLParser):
    """blocks: (text, inside article, inside main) of the blocks that no markup drops, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, inside article, inside main
        self.blocks: list[tuple[str, bool, bool]] = []
        self.pieces: list[str] = []

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                _, _, article, main = self.stack[-1] if self.stack else ("", False, False, False)
                self.blocks.append((text, article, main))

    def _drops(self, tag: str, attrs: dict[str, str | None], article: bool) -> bool:
        if tag in DROPPED or tag == "footer" or tag == "header" and not article:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            return True
        if tag in ("html", "body", "main", "h1"):
            return False
        words = _words_of(attrs)
        return bool(words & JUNK) or bool(words & EDGES) and not article and not words & CONTENT

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            return
        _, dropped, article, main = self.stack[-1] if self.stack else ("", False, False, False)
        dropped = dropped or self._drops(tag, dict(attrs), article)
        self.stack.append((tag, dropped, article or tag == "article" and not dropped, main or tag == "main" and not dropped))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
            if self.stack[i][0] in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                break  # an end tag without its start doesn't close the article around it

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.pieces.append(data)


def blocks(html: str | None) -> list[tuple[str, bool]]:
    """The blocks that may be main text, and whether each is inside the page's article, or its main part if it has no article."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    inside = next((i for i in (1, 2) if any(b[i] for b in parser.blocks)), None)
    return [(b[0], bool(inside and b[inside])) for b in parser.blocks]


def longest_common(a: list[int], b: list[int]) -> list[int]:
    """Indexes in `a` of a longest common subsequence of a and b."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    tops: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(tops, j)
            node = (i, nodes[k - 1] if k else None)
            tops[k : k + 1], nodes[k : k + 1] = [j], [node]
    chain, node = [], nodes[-1] if nodes else None
    while node:
        chain.append(node[0])
        node = node[1]
    return chain[::-1]


def shared_lines(own: list[int], sizes: list[int], neighbours: list[list[int]]) -> set[int]:
    """Indexes of a page's lines that its nearest pages share, nearest first, copies passed over."""
    gone: set[int] = set()
    used = 0
    for other in neighbours:
        common = longest_common(own, other)
        if other and sum(sizes[i] for i in common) <= COPY_SHARE * sum(sizes):
            gone.update(common)
            used += 1
            if used == USED:
                break
    return gone


def url_order(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, without its scheme, query and fragment."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), path.rstrip("/")


_PARSED = "kind binary, page_id long, url string, host string, path string, hashes array<long>, sizes array<int>, guarded array<boolean>"


def _page(url: str | None, html: str | None) -> tuple[bytes, str, str, list[int], list[tuple[str, bool]]]:
    """kind (the same for pages of a host with the same blocks), host, path, hashes of the blocks, blocks."""
    host, path = url_order(url)
    found = blocks(html)
    hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t, _ in found]
    kind = xxhash.xxh3_128_digest(repr((host, hashes, [g for _, g in found])).encode("utf-8", "surrogatepass"))
    return kind, host, path, hashes, found


def _parsed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            out: dict[str, list] = {c: [] for c in ("kind", "host", "path", "hashes", "sizes", "guarded")}
            for url, html in zip(part.column(1).to_pylist(), part.column(2)):
                kind, host, path, hashes, found = _page(url, html.as_py())
                for c, v in zip(out, (kind, host, path, hashes, [len(t) for t, _ in found], [g for _, g in found])):
                    out[c].append(v)
            types = (pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            kind, *rest = (pa.array(v, t) for v, t in zip(out.values(), types))
            yield pa.RecordBatch.from_arrays([kind, part.column(0), part.column(1), *rest], ["kind", "page_id", "url", *list(out)[1:]])


def _lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            kinds, lines = [], []
            for url, html in zip(part.column(1).to_pylist(), part.column(2)):
                kind, *_, found = _page(url, html.as_py())
                kinds.append(kind)
                lines.append([t for t, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.binary()), part.column(0), part.column(1), pa.array(lines, pa.list_(pa.string()))], ["kind", "page_id", "url", "lines"])


def _differenced(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, host, line, h, guarded of the lines that a page's nearest pages share."""
    for batch in rows:
        out: dict[str, list] = {c: [] for c in ("kind", "host", "line", "h", "guarded")}
        for row in batch.select(["kind", "host", "hashes", "sizes", "guarded", "near"]).to_pylist():
            near = [x for x in row["near"] if x is not None]
            for i in shared_lines(row["hashes"], row["sizes"], near):
                for c, v in zip(out, (row["kind"], row["host"], i, row["hashes"][i], row["guarded"][i])):
                    out[c].append(v)
        types = (pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def nearest(kinds: DataFrame) -> DataFrame:
    """kinds with near: the line hashes of the nearest pages of the same host by path, nearest first, null where there is none.

    Pages are dealt out by ranges of (host, path), so a large host spreads over many tasks; the
    first and last pages of a range are also given to the LOOKED_AT ranges that have pages on either side, which is as
    far as a neighbour can be.
    """
    order = ["host", "path", "page_id", "url"]
    ranged = kinds.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "page-ranges")
    dense = ranged.select("part").distinct().withColumn("range", F.row_number().over(Window.orderBy("part")))  # a row a partition
    ranged = ranged.join(F.broadcast(dense), "part").drop("part")
    within = Window.partitionBy("range").orderBy(*order)
    back = Window.partitionBy("range").orderBy(*(F.col(c).desc() for c in order))
    edges = ranged.select(*order, "hashes", "range", F.row_number().over(within).alias("nth"), F.row_number().over(back).alias("last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(LOOKED_AT))).alias("step")
    up = edges.filter(F.col("nth") <= LOOKED_AT).select("*", steps).withColumn("range", F.col("range") - F.col("step"))
    down = edges.filter(F.col("last") <= LOOKED_AT).select("*", steps).withColumn("range", F.col("range") + F.col("step"))
    halo = up.unionByName(down).drop("nth", "last", "step")
    every = ranged.withColumn("halo", F.lit(False)).unionByName(halo.withColumn("halo", F.lit(True)), allowMissingColumns=True)
    near = []
    for step in range(1, LOOKED_AT + 1):
        for at in (F.lag, F.lead):
            near.append(F.when(at("host", step).over(within) == F.col("host"), at("hashes", step).over(within)))
    return every.withColumn("near", F.array(*near)).filter("not halo").drop("halo", "range")


def templates(kinds: DataFrame) -> DataFrame:
    """host, h of the blocks that stand on so many pages of a host that they are a template; near copies, which have their longest block in common, count once."""
    longest = F.max(F.struct("size", "h"))["h"]
    each = kinds.select("kind", "host", F.explode(F.arrays_zip("hashes", "sizes")).alias("b")).select("kind", "host", F.col("b.hashes").alias("h"), F.col("b.sizes").alias("size"))
    core = each.groupBy("kind", "host").agg(longest.alias("core"))
    pages = core.select("host", "core").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    having = each.join(core, ["kind", "host"]).select("host", "h", "core").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= TEMPLATE_PAGES)
    return having.join(pages, "host").filter(F.col("n") > TEMPLATE_SHARE * F.col("pages")).select("host", "h")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id an integer, url, html).

    White space within a block becomes one space, blocks are joined by a newline, character
    references are decoded. A null or empty html has the empty text; a null url is a host of its own.
    Rows that repeat a page get equal texts. An empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    parsed = pages.mapInArrow(_parsed, _PARSED)
    first = F.min(F.struct("host", "path", "page_id", "url")).alias("at")
    same = {c: F.first(c).alias(c) for c in ("hashes", "sizes", "guarded")}  # a kind has one of each
    kinds = written(parsed.groupBy("kind").agg(first, *same.values()).select("kind", "at.*", *same), "page-kinds")
    shared = written(nearest(kinds).mapInArrow(_differenced, "kind binary, host string, line int, h long, guarded boolean"), "page-shared")
    counted = written(templates(kinds), "page-templates")
    sure = shared.filter("not guarded").select("kind", "line")
    guarded = shared.filter("guarded").join(counted, ["host", "h"]).select("kind", "line")
    open_ = kinds.select("kind", "host", F.posexplode(F.arrays_zip("hashes", "guarded")).alias("line", "b")).filter("not b.guarded")
    often = open_.select("kind", "host", "line", F.col("b.hashes").alias("h")).join(counted, ["host", "h"]).select("kind", "line")
    gone = sure.unionByName(guarded).unionByName(often).groupBy("kind").agg(F.collect_set("line").alias("gone"))  # a page's lines
    out = pages.mapInArrow(_lines, "kind binary, page_id long, url string, lines array<string>").join(gone, "kind", "left")
    kept = F.filter("lines", lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return out.select("page_id", "url", F.array_join(kept, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
