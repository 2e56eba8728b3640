"""E-book archives beyond their parts: metadata, contents and stylesheets as tables, and archives written anew.

An archive is small and its parts depend on each other, so each is read and written in one piece; a collection of them is
a table of archives, one a row.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.html import TOKEN, attributes
from lectern.operators.lists import resolve_path
from lectern.sources.books import DOCUMENT, STYLESHEET, epub_bytes

# Namespaces of the package format, and what its parts are called.
OPF, DC, CONTAINER = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "urn:oasis:names:tc:opendocument:xmlns:container"
NCX, XHTML, OPS = "http://www.daisy.org/z3986/2005/ncx/", "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops"
NCX_TYPE = "application/x-dtbncx+xml"


@dataclass
class Entry:
    """An entry of the contents and those under it."""

    title: str
    href: str = ""
    children: list["Entry"] = field(default_factory=list)


@dataclass
class Package:
    """What an archive says of itself; paths are those in the archive."""

    path: str
    metadata: list[tuple[str, str, dict[str, str]]]
    items: dict[str, tuple[str, str, str]]  # by id: path, media type, properties
    spine: list[str]
    contents: list[Entry]
    parts: dict[str, bytes]

    def first(self, name: str) -> str:
        return next((v for n, v, _ in self.metadata if n == name), "")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _join(base: str, href: str) -> str:
    path, _, fragment = href.partition("#")
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) + (f"#{fragment}" if fragment else "")


def _nav_entries(ol: ElementTree.Element, base: str) -> list[Entry]:
    out = []
    for li in ol:
        label = next((x for x in li if _local(x.tag) in ("a", "span")), None)
        title = " ".join("".join(label.itertext()).split()) if label is not None else ""
        href = label.get("href", "") if label is not None else ""
        below = next((x for x in li if _local(x.tag) == "ol"), None)
        out.append(Entry(title, _join(base, href) if href else "", _nav_entries(below, base) if below is not None else []))
    return out


def _ncx_entries(node: ElementTree.Element, base: str) -> list[Entry]:
    out = []
    for point in node.findall(f"{{{NCX}}}navPoint"):
        text, content = point.find(f"{{{NCX}}}navLabel/{{{NCX}}}text"), point.find(f"{{{NCX}}}content")
        href = content.get("src", "") if content is not None else ""
        out.append(Entry((text.text or "").strip() if text is not None else "", _join(base, href) if href else "", _ncx_entries(point, base)))
    return out


def _contents(items: dict[str, tuple[str, str, str]], parts: dict[str, bytes]) -> list[Entry]:
    """From the navigation document, else from the older table, else nothing; one that can't be parsed counts as absent."""
    for path, kind, properties in items.values():
        if "nav" in properties.split():
            try:
                for nav in ElementTree.fromstring(parts.get(path, b"")).iter(f"{{{XHTML}}}nav"):
                    if "toc" in nav.get(f"{{{OPS}}}type", "toc").split() and (ol := nav.find(f"{{{XHTML}}}ol")) is not None:
                        return _nav_entries(ol, path)
            except ElementTree.ParseError:
                pass
    for path, kind, _ in items.values():
        if kind == NCX_TYPE:
            try:
                return _ncx_entries(ElementTree.fromstring(parts.get(path, b"")).find(f"{{{NCX}}}navMap"), path)
            except (ElementTree.ParseError, AttributeError):
                pass
    return []


def with_hrefs(entries: list[Entry]) -> list[Entry]:
    """The contents with the href of the first entry below for every one that has none."""
    out = []
    for e in entries:
        children = with_hrefs(e.children)
        out.append(Entry(e.title, e.href or next((c.href for c in children if c.href), ""), children))
    return out


def flat(entries: list[Entry], depth: int = 0) -> Iterator[tuple[int, str, str]]:
    """depth, title, href of each entry, an entry before those below it."""
    for e in entries:
        yield depth, e.title, e.href
        yield from flat(e.children, depth + 1)


def package(book: bytes) -> Package:
    """What an archive says of itself. Parts that the manifest names and the archive lacks are left out."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        parts = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    path = next(ElementTree.fromstring(parts["META-INF/container.xml"]).iter(f"{{{CONTAINER}}}rootfile")).get("full-path")
    root = ElementTree.fromstring(parts[path])
    meta = root.find(f"{{{OPF}}}metadata")
    metadata = [(_local(m.tag), (m.text or "").strip(), {_local(k): v for k, v in m.attrib.items()}) for m in (meta if meta is not None else ())]
    items = {i.get("id", ""): (_join(path, i.get("href", "")), i.get("media-type", ""), i.get("properties", "")) for i in root.iter(f"{{{OPF}}}item")}
    items = {k: v for k, v in items.items() if v[0] in parts}
    spine = [r.get("idref", "") for r in root.iter(f"{{{OPF}}}itemref") if r.get("idref") in items]
    return Package(path, metadata, items, spine, _contents(items, parts), parts)


def is_fixed_layout(metadata: list[tuple[str, str, dict[str, str]]]) -> bool:
    """Whether the first statement on layout says that pages are laid out beforehand."""
    return next(("pre-paginated" in v for n, v, a in metadata if n == "meta" and a.get("property") == "rendition:layout"), False)


def _nav_list(entries: list[Entry], base: str) -> str:
    rows = "".join(f"<li><a href={quoteattr(posixpath.relpath(e.href, posixpath.dirname(base) or '.') if e.href else '#')}>{escape(e.title)}</a>{_nav_list(e.children, base)}</li>" for e in entries)
    return f"<ol>{rows}</ol>" if rows else ""


def _nav(p: Package, entries: list[Entry], base: str) -> bytes:
    title = escape(p.first("title"))
    return f'<html xmlns="{XHTML}" xmlns:epub="{OPS}"><head><title>{title}</title></head><body><nav epub:type="toc">{_nav_list(entries, base)}</nav></body></html>'.encode()


def _ncx(p: Package, entries: list[Entry], base: str, identifier: str) -> bytes:
    count = iter(range(10**9))

    def points(some: list[Entry]) -> str:
        out = ""
        for e in some:
            n = next(count)
            src = posixpath.relpath(e.href, posixpath.dirname(base) or ".") if e.href else ""
            out += f'<navPoint id="navpoint-{n}" playOrder="{n + 1}"><navLabel><text>{escape(e.title)}</text></navLabel><content src={quoteattr(src)}/>{points(e.children)}</navPoint>'
        return out

    return f'<ncx xmlns="{NCX}" version="2005-1"><head><meta name="dtb:uid" content={quoteattr(identifier)}/></head><docTitle><text>{escape(p.first("title"))}</text></docTitle><navMap>{points(entries)}</navMap></ncx>'.encode()


def derived_identifier(source: str, language: str, mode: str) -> str:
    """The identity of a translation: the same for the same source, language and mode."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{source}|{language}|{mode}"))


def rebuilt(book: bytes, replaced: dict[str, bytes], language: str = "", mode: str = "bilingual") -> bytes:
    """The archive with some parts replaced, an identity of its own, and contents that lead somewhere.

    Metadata stay but for links to other files; the source's identifiers stay as further ones without the id that
    the new one takes. A navigation document with contents stays, an empty or missing one is made, and so is the
    older table. Every other part is copied as it is.
    """
    p = package(book)
    entries = with_hrefs(p.contents) or [Entry(posixpath.basename(p.items[i][0]), p.items[i][0]) for i in p.spine]
    identifier = derived_identifier(p.first("identifier") or p.first("title"), language, mode)
    folder = posixpath.dirname(p.path)
    parts, items = p.parts | {k: v for k, v in replaced.items() if k in p.parts}, dict(p.items)
    nav = next((k for k, v in items.items() if "nav" in v[2].split()), None)
    if nav is None or not p.contents:
        path = items[nav][0] if nav else posixpath.join(folder, "nav.xhtml")
        nav = nav or "nav"
        items[nav], parts[path] = (path, DOCUMENT, "nav"), _nav(p, entries, path)
    if not any(kind == NCX_TYPE for _, kind, _ in items.values()):
        path = posixpath.join(folder, "toc.ncx")
        items["ncx"], parts[path] = (path, NCX_TYPE, ""), _ncx(p, entries, path, identifier)
    ncx = next(k for k, v in items.items() if v[1] == NCX_TYPE)
    meta = f'<dc:identifier id="uid">{identifier}</dc:identifier>'
    for name, value, attrs in p.metadata:
        if name == "link":
            continue
        attrs = {k: v for k, v in attrs.items() if not (k == "id" and v == "uid")}
        said = "".join(f" {k}={quoteattr(v)}" for k, v in attrs.items() if k in ("id", "property", "refines", "name", "content", "scheme"))
        prefix = "" if name == "meta" else "dc:"
        meta += f"<{prefix}{name}{said}>{escape(value)}</{prefix}{name}>"
    manifest = "".join(f"<item id={quoteattr(k)} href={quoteattr(posixpath.relpath(v[0], folder or '.'))} media-type={quoteattr(v[1])}" + (f" properties={quoteattr(v[2])}" if v[2] else "") + "/>" for k, v in items.items())
    spine = "".join(f"<itemref idref={quoteattr(i)}/>" for i in p.spine)
    parts[p.path] = f'<package xmlns="{OPF}" version="3.0" unique-identifier="uid"><metadata xmlns:dc="{DC}">{meta}</metadata><manifest>{manifest}</manifest><spine toc={quoteattr(ncx)}>{spine}</spine></package>'.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        for name, content in parts.items():
            if name != "mimetype":
                z.writestr(name, content)
    return out.getvalue()


def rebuild_books(books: DataFrame, parts: DataFrame, language: str = "", mode: str = "bilingual") -> DataFrame:
    """book, content of books (book, content) rebuilt with their parts (book, name, content); a row is a whole archive."""
    of = parts.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("replaced"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [rebuilt(bytes(c), {k: bytes(v) for k, v in (dict(r) if r is not None else {}).items()}, language, mode) for c, r in zip(frame["content"], frame["replaced"])]
            yield pd.DataFrame({"book": frame["book"], "content": done})

    return books.select("book", "content").join(of, "book", "left").mapInPandas(run, "book string, content binary")


def contents_table(books: DataFrame) -> DataFrame:
    """book, nth, depth, title, href of the contents of books (book, content), every entry with an href if one below it has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(b, n, *e) for b, c in zip(frame["book"], frame["content"]) for n, e in enumerate(flat(with_hrefs(package(bytes(c)).contents)))]
            yield pd.DataFrame(rows, columns=["book", "nth", "depth", "title", "href"])

    return books.select("book", "content").mapInPandas(run, "book string, nth int, depth int, title string, href string")


def style_links(documents: DataFrame) -> DataFrame:
    """book, name, nth, href, css of documents (book, name, html): linked sheets (css null) and style elements (href null), in page order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book, name, html in zip(frame["book"], frame["name"], frame["html"]):
                for nth, token in enumerate(TOKEN.findall(html or "")):
                    if re.match(r"(?i)<link\b", token):
                        a = attributes(token)
                        if a.get("href") and ("stylesheet" in a.get("rel", "").lower().split() or a.get("type", "").lower() == STYLESHEET):
                            rows.append((book, name, nth, a["href"], None))
                    elif re.match(r"(?i)<style\b", token):
                        rows.append((book, name, nth, None, re.sub(r"(?is)^<style[^>]*>|</style>$", "", token)))
            yield pd.DataFrame(rows, columns=["book", "name", "nth", "href", "css"])

    return documents.select("book", "name", "html").mapInPandas(run, "book string, name string, nth int, href string, css string")


def sheets_of(documents: DataFrame, sheets: DataFrame) -> DataFrame:
    """documents with sheets: the stylesheets that apply to each, in order; all of the book's where it links and holds none.

    sheets: book, path, at (place in the book), css.
    """
    links = style_links(documents)
    inline = links.filter("css is not null").select("book", "name", "nth", "css")
    linked = links.filter("href is not null").withColumn("path", resolve_path(F.col("name"), F.col("href"))).join(sheets.select("book", "path", F.col("css").alias("of")), ["book", "path"])
    own = inline.unionByName(linked.select("book", "name", "nth", F.col("of").alias("css")))

    def ordered(at: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(at, "css"))), lambda x: x["css"])

    own = own.groupBy("book", "name").agg(ordered("nth").alias("own"))
    all_of = sheets.groupBy("book").agg(ordered("at").alias("all"))
    out = documents.join(own, ["book", "name"], "left").join(all_of, "book", "left")
    return out.withColumn("sheets", F.coalesce("own", "all", F.array().cast("array<string>"))).drop("own", "all")


def pdf_lines(pages: DataFrame) -> DataFrame:
    """book, line_no, line of pages (book, page_no, text) as any extractor gives them; a book's pages are one list of lines."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.regexp_replace(x["text"], r"\n\z", "")), "\n")
    return pages.groupBy("book").agg(whole.alias("text")).select("book", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def read_pdf(spark, path: str) -> DataFrame:
    """pdf_lines() of files, where a library that extracts their text (pymupdf) is installed; fails without it."""
    import pymupdf  # noqa: F401  an optional dependency

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for frame in frames:
            for book, content in zip(frame["path"], frame["content"]):
                with pymupdf.open(stream=bytes(content), filetype="pdf") as doc:
                    yield pd.DataFrame([(book, i, page.get_text("text")) for i, page in enumerate(doc)], columns=["book", "page_no", "text"])

    return pdf_lines(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "book string, page_no int, text string"))


def pairs_book(title: str, pairs: list[tuple[str, str]], language: str = "en") -> bytes:
    """An archive with a chapter for each pair of a text and its translation."""
    body = [f"<p>{escape(a)}</p><p>{escape(b)}</p>" for a, b in pairs]
    return epub_bytes(title, [(f"index_split_{i:03d}.xhtml", b) for i, b in enumerate(body)], language)
