"""Books as tables: archives, Markdown, subtitles and plain text, and the writers of each."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Formats by the last suffix of a name; the types of an archive's parts.
FORMATS = {"epub": "epub", "txt": "text", "srt": "subtitles", "md": "markdown", "pdf": "pdf"}
DOCUMENT, STYLESHEET = "application/xhtml+xml", "text/css"
_OPF, _CONTAINER = "{http://www.idpf.org/2007/opf}", "{urn:oasis:names:tc:opendocument:xmlns:container}"


def format_of(name: str) -> str:
    """The format of a file by its suffix; fails on others."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {name}")
    return FORMATS[suffix]


def items(book: bytes) -> Iterator[tuple[int, str, str, bytes]]:
    """item, name, media_type, content of an archive's parts, in the manifest's order."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        root = next(ElementTree.fromstring(z.read("META-INF/container.xml")).iter(f"{_CONTAINER}rootfile")).get("full-path")
        folder = posixpath.dirname(root)
        for i, part in enumerate(ElementTree.fromstring(z.read(root)).iter(f"{_OPF}item")):
            name = posixpath.normpath(posixpath.join(folder, part.get("href", "")))
            if name in z.namelist():
                yield i, name, part.get("media-type", ""), z.read(name)


class _Book(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.types = paths, None

    def partitions(self) -> list[InputPartition]:
        return [_Book(p) for p in self.paths]

    def read(self, partition: _Book):
        with open(partition.path, "rb") as f:
            for i, name, kind, content in items(f.read()):
                if self.types is None or kind in self.types:
                    yield partition.path, i, name, kind, content


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        """A filter on media_type skips the other parts of an archive."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("media_type",):
                self.types = {f.value}
            elif isinstance(f, In) and f.attribute == ("media_type",):
                self.types = set(f.value)
            yield f


class Epub(DataSource):
    """spark.read.format("lectern_epub").option("paths", "a.epub,b.epub"): a row a part, a partition a book; for folders that all executors mount.

    With option("pushdown", "true") a filter on media_type is pushed down, for sessions with
    spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls) -> str:
        return "lectern_epub"

    def schema(self) -> str:
        return "book string, item int, name string, media_type string, content binary"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("pushdown") == "true" else _Reader
        return kind([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """book, item, name, media_type, content of the archives that a path or pattern names, in any store that Spark reads."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for book, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame([(book, *x) for x in items(bytes(content))], columns=["book", "item", "name", "media_type", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "book string, item int, name string, media_type string, content binary")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """book, line_no, line of text files; a newline at the end makes no line."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book"), F.regexp_replace("value", r"\r\n?|\x0B|\f|[\x1C-\x1E]|\x{85}|\x{2028}|\x{2029}", "\n").alias("text"))
    cut = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    return whole.filter(F.length("text") > 0).select("book", F.posexplode(cut).alias("line_no", "line"))


def write_lines(rows: DataFrame, path: str) -> None:
    """A text file a book from rows (book, line_no, line): one partition a book, in order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    rows.groupBy("book").agg(whole.alias("value")).repartition("book").write.partitionBy("book").text(path)


def epub_bytes(title: str, chapters: list[tuple[str, str]], language: str = "en", identifier: str = "id") -> bytes:
    """An archive of chapters (name, body markup), with package, navigation and spine."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    out = io.BytesIO()
    manifest = "".join(f'<item id="c{i}" href="{n}" media-type="{DOCUMENT}"/>' for i, (n, _) in enumerate(chapters))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    points = "".join(f'<li><a href="{n}">{esc(n)}</a></li>' for n, _ in chapters)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr(
            "OEBPS/content.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{esc(identifier)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{language}</dc:language></metadata><manifest>{manifest}<item id="nav" href="nav.xhtml" properties="nav" media-type="{DOCUMENT}"/></manifest><spine>{spine}</spine></package>',
        )
        z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{esc(title)}</title></head><body><nav epub:type="toc"><ol>{points}</ol></nav></body></html>')
        for name, body in chapters:
            z.writestr(f"OEBPS/{name}", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(name)}</title></head><body>{body}</body></html>')
    return out.getvalue()


def write_batch_requests(rows: DataFrame, path: str, per_file: int = 40_000) -> DataFrame:
    """Requests (nth, custom_id, body) as JSON lines in a folder for each range of nth; returns the manifest batch, start, end."""
    rows = rows.withColumn("batch", F.floor(F.col("nth") / per_file))
    rows.write.partitionBy("batch").json(path)
    written = rows.sparkSession.read.schema("nth long, batch long").json(path)  # what stands in the files, not the input again
    return written.groupBy("batch").agg(F.min("nth").alias("start"), (F.max("nth") + 1).alias("end"))


def _markdown_prompt(text: str) -> dict[str, str]:
    """user and system of a prompt in Markdown: the first user row of the table under Conversation; the developer's or else the system's message."""
    parts = dict(re.findall(r"(?ms)^##\s+(.+?)\s*\n(.*?)(?=^##\s|\Z)", text))
    parts = {k.strip().lower(): v.strip() for k, v in parts.items()}
    rows = [[c.strip() for c in line.strip().strip("|").split("|", 1)] for line in parts.get("conversation", "").split("\n") if line.strip().startswith("|")]
    user = next((r[1].strip().replace("\\n", "\n") for r in rows if len(r) == 2 and r[0].lower() == "user"), "")
    system = parts.get("developer message") or parts.get("system message")
    return {"user": user} | ({"system": system} if system else {})


def parse_prompt(text: str, name: str = "") -> dict[str, str]:
    """A prompt's parts: JSON with user and system, Markdown (a name that ends in .md), or a template for the user; {text} must be in the user's."""
    if name.endswith(".md"):
        found = _markdown_prompt(text)
    elif name.endswith(".txt"):
        found = {"user": text}
    else:
        try:
            found = json.loads(text)
        except ValueError:
            if name.endswith(".json"):
                raise
            found = {"user": text}
    if not isinstance(found, dict) or set(found) - {"user", "system"} or "{text}" not in found.get("user", ""):
        raise ValueError("a prompt has user, with {text} in it, and may have system")
    return found


def read_prompt(spark: SparkSession, path: str) -> dict[str, str]:
    """parse_prompt() of a file in any store that Spark reads."""
    return parse_prompt(spark.read.text(path, wholetext=True).first()[0], path)


def merge_providers(shared: dict[str, dict], own: dict[str, dict]) -> dict[str, dict]:
    """Provider settings by name, one's own over the shared; fails on fields that are unknown or missing."""
    out = shared | own
    for name, p in out.items():
        if set(p) - {"api_style", "base_url", "default_models", "env_key"} or "api_style" not in p or not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"provider {name}: fields are api_style, base_url, default_models, env_key")
    return out
