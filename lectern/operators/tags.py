"""Tag mode: the elements of chosen tags that hold no other such element, with their text, and the strings of a page.

One pass over each page, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators.html import _walk

_ROW = "page_id long, ord int, tag string, leaf boolean, text string, kept string"


def chosen_of(html: str | None, tags: frozenset[str], excluded: frozenset[str]) -> list[tuple[int, str, bool, str, str]]:
    """ord, tag, whether it is a leaf, whole text, and text outside excluded elements of a page's elements of the chosen tags."""
    open_: list[list] = []  # ord, tag, chosen, in excluded, leaf, texts, kept texts
    out = []

    def close(down_to: int) -> None:
        for ord_, tag, chosen, _, leaf, texts, kept in reversed(open_[down_to:]):
            if chosen:
                out.append((ord_, tag, leaf, "".join(texts), "".join(kept)))
        del open_[down_to:]

    for i, kind, tag, token, step in _walk(html):
        if kind == "open":
            chosen = tag in tags
            if chosen:
                for up in open_:
                    up[4] = False
            open_.append([i, tag, chosen, tag in excluded or bool(open_ and open_[-1][3]), True, [], []])
        elif kind == "close":
            close(step)
        elif kind == "text":
            hidden = bool(open_ and open_[-1][3])
            for up in open_:
                if up[2]:
                    up[5].append(token)
                    if not hidden:
                        up[6].append(token)
    close(0)
    return sorted(out)


def tag_units(pages: DataFrame, tags: tuple[str, ...] = ("p",), excluded: tuple[str, ...] = K.EXCLUDED_TAGS) -> DataFrame:
    """page_id, ord, tag, leaf, text, kept of the elements of chosen tags: those with leaf false hold another one and are no units."""
    of, without = frozenset(tags), frozenset(excluded)
    types = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
    names = [f.split()[0] for f in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, *row) for page, html in zip(batch.column(0).to_pylist(), batch.column(1)) for row in chosen_of(html.as_py(), of, without)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, _ROW)


def strings(toks: DataFrame) -> DataFrame:
    """page_id, ord, tag (null), leaf, text, kept of every string of html.tokens(): a pass beside that of tags, its texts come again."""
    text = F.col("text")
    return toks.filter("kind = 'text'").select("page_id", "ord", F.lit(None).cast("string").alias("tag"), F.lit(True).alias("leaf"), text.alias("text"), text.alias("kept"))


def only_excluded(kept: Column) -> Column:
    """Whether nothing to translate is left of an element's text outside excluded ones."""
    return (T.strip(kept) == "") | T.is_special(T.strip(kept), "epub")


def translatable(units: DataFrame) -> DataFrame:
    """The leaves that have something to translate."""
    return units.filter("leaf").filter(~only_excluded(F.col("kept")) & ~T.is_untranslatable(F.col("kept")))
