"""Markdown as blocks, batches and sections.

A document's lines go through one pass that knows the construct it is in; order is kept as block and
batch ordinals. Documents are independent, so a table of them is worked on in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

# Patterns of the constructs that pass through, and of inline markup that a translator must not see.
FENCE = re.compile(r"^(`{3,}|~{3,})")
PASSES = re.compile(r"^(\{\d+\}-+$|!\[|<!--.*-->$)")
RULE_CELL = re.compile(r"^:?-{3,}:?$")
HEADING = re.compile(r"^(#{1,6})\s+\S")
HEADING_ID = re.compile(r"[ \t]*\{#[A-Za-z0-9_-]+\}[ \t]*$", re.M)
INLINE = (re.compile(r"!\[[^\]\n]*\]\([^)]+\)"), re.compile(r"\[[^\]\n]+\]\([^)]+\)"), re.compile(r"(?<!`)`[^`\n]+`(?!`)"), re.compile(r"<https?://[^>\s]+>"), HEADING_ID)
#: Blocks and characters of a batch.
BATCH_BLOCKS, BATCH_CHARS = 10, 2_000


@dataclass(frozen=True)
class Block:
    text: str
    translatable: bool

    @property
    def heading(self) -> bool:
        return self.translatable and bool(HEADING.match(self.text.strip()))

    @property
    def special(self) -> bool:
        t = self.text.strip()
        return not t or t.isdigit()


@dataclass(frozen=True)
class Batch:
    texts: tuple[str, ...]
    breadcrumb: str

    @property
    def chars(self) -> int:
        return sum(map(len, self.texts))


def _rule_row(line: str) -> bool:
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return len(cells) > 1 and all(RULE_CELL.match(c) for c in cells)


def _construct_end(lines: list[str], i: int) -> int:
    """Where the construct that begins at line i and passes through ends, or i if none does."""
    here = lines[i].strip()
    if i == 0 and here == "---":
        return next((j + 1 for j in range(1, len(lines)) if lines[j].strip() == "---"), i)
    if fence := FENCE.match(here):
        mark = fence[1]
        close = re.compile(rf"^{re.escape(mark[0])}{{{len(mark)},}}\s*$")
        return next((j + 1 for j in range(i + 1, len(lines)) if close.match(lines[j].strip())), len(lines))
    if "|" in lines[i] and i + 1 < len(lines) and _rule_row(lines[i + 1]):
        return next((j for j in range(i + 2, len(lines)) if "|" not in lines[j] or not lines[j].strip()), len(lines))
    return i + 1 if PASSES.match(here) else i


def blocks(text: str) -> Iterator[Block]:
    """Front matter, fences, tables and the like as they are; headings; paragraphs."""
    lines, prose, i = text.splitlines(), [], 0

    def paragraph() -> Iterator[Block]:
        if prose:
            yield Block("\n".join(prose), True)
            prose.clear()

    while i < len(lines):
        end, here = _construct_end(lines, i), lines[i].strip()
        if end > i:
            yield from paragraph()
            yield Block("\n".join(lines[i:end]), False)
        elif not here or here.startswith("#"):
            yield from paragraph()
            if here:
                yield Block(lines[i], True)
        else:
            prose.append(lines[i])
        i = max(end, i + 1)
    yield from paragraph()


def heading_label(text: str) -> str:
    return HEADING_ID.sub("", re.sub(r"^#{1,6}\s+", "", text.strip())).strip("*_` ")


def batches(of: list[Block], max_blocks: int = BATCH_BLOCKS, max_chars: int = BATCH_CHARS) -> Iterator[Batch | Block]:
    """Batches of blocks in order, and between them the blocks that pass through.

    A heading begins a batch and is never alone in one that more could join; a skipped heading level makes
    no empty step of the breadcrumb.
    """
    path: list[str] = []
    now: list[Block] = []
    crumb = ""

    def full() -> Iterator[Batch]:
        joined = "\n\n".join(b.text for b in now)
        if now and not Block(joined, True).special:
            yield Batch(tuple(b.text for b in now), crumb)
        now.clear()

    for block in of:
        if not block.translatable or block.special:
            yield from full()
            yield block
            continue
        alone = len(now) == 1 and now[0].heading
        size = sum(len(b.text) for b in now)
        if block.heading:
            yield from full()
            level = len(HEADING.match(block.text.strip())[1])
            path = [*path[: level - 1], heading_label(block.text)]
        elif now and not alone and size + len(block.text) > max_chars:
            yield from full()
        if not now:
            crumb = " > ".join(filter(None, path))
        now.append(block)
        if (len(now) >= max_blocks or sum(len(b.text) for b in now) >= max_chars) and not (len(now) == 1 and now[0].heading):
            yield from full()
    yield from full()


def sections(of: list[Batch], workers: int) -> list[list[int]]:
    """Ordinals of batches in contiguous sections of about a worker's share; a heading's batches stay together."""
    share = max(1, sum(b.chars for b in of) // max(1, workers))
    units: list[list[int]] = []
    for i, batch in enumerate(of):
        same = units and of[units[-1][-1]].breadcrumb == batch.breadcrumb
        if same and (batch.breadcrumb or sum(of[k].chars for k in units[-1]) + batch.chars <= share):
            units[-1].append(i)
        else:
            units.append([i])
    out: list[list[int]] = []
    for unit in units:
        if out and sum(of[k].chars for k in out[-1] + unit) <= share:
            out[-1] += unit
        else:
            out.append(list(unit))
    return out


def protect(text: str) -> tuple[str, dict[str, str]]:
    """The text with inline markup replaced by tokens, and what each token stands for."""
    kept: dict[str, str] = {}

    def token(m: re.Match) -> str:
        kept[name := f"@@LECTERN_{len(kept)}@@"] = m[0]
        return name

    for pattern in INLINE:
        text = pattern.sub(token, text)
    return text, kept


def restore(text: str, kept: dict[str, str]) -> str:
    for name in reversed(kept):  # a later token may stand for text with an earlier one
        text = text.replace(name, kept[name])
    return text


def block_table(docs: DataFrame) -> DataFrame:
    """doc_id, block_no, text, translatable, heading of docs (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, b.text, b.translatable, b.heading) for d, t in zip(frame["doc_id"], frame["text"]) for i, b in enumerate(blocks(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_no", "text", "translatable", "heading"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, block_no int, text string, translatable boolean, heading boolean")


def batch_table(docs: DataFrame, max_blocks: int = BATCH_BLOCKS, max_chars: int = BATCH_CHARS, workers: int = 2) -> DataFrame:
    """doc_id, batch_no, section, breadcrumb, texts of docs (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, t in zip(frame["doc_id"], frame["text"]):
                found = [b for b in batches(list(blocks(t or "")), max_blocks, max_chars) if isinstance(b, Batch)]
                of = {i: n for n, s in enumerate(sections(found, workers)) for i in s}
                rows += [(d, i, of[i], b.breadcrumb, list(b.texts)) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "batch_no", "section", "breadcrumb", "texts"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, batch_no int, section int, breadcrumb string, texts array<string>")
