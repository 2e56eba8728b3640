"""Enrichment: text-to-text functions behind one protocol, alignment, validation, retries.

A translator runs inside tasks, one instance a partition. The offline one needs no network
and is an expression, so results stay exact and comparable.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

OFFLINE = "[offline]"
# What joins the texts of a batch, and what a schema echo consists of.
DELIMITER = "\n\n@@\n\n"
SCHEMA_KEYS = frozenset(["type", "properties", "required", "additionalProperties", "$schema", "items", "enum", "description", "title"])
VERDICTS = ("translate", "skip", "unsure")


def offline(text: Column) -> Column:
    """The stand-in translation."""
    return F.concat(F.lit(OFFLINE), text)


class Translator:
    """One text at a time; subclasses may answer lists. Same length, same order."""

    def translate(self, text: str) -> str:
        raise NotImplementedError

    def translate_list(self, texts: Sequence[str]) -> list[str]:
        return [self.translate(t) for t in texts]


class Offline(Translator):
    def translate(self, text: str) -> str:
        return OFFLINE + text


#: Translators by name; services that need a network are registered by their users.
REGISTRY: dict[str, Callable[..., Translator]] = {"offline": Offline}


def register(name: str, make: Callable[..., Translator]) -> None:
    REGISTRY[name] = make


@dataclass
class Retry:
    """Calls again after failures, waiting ever longer."""

    times: int = 3
    first: float = 2.0
    most: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, call: Callable[[], object]) -> object:
        for n in range(self.times):
            try:
                return call()
            except Exception:
                if n == self.times - 1:
                    raise
                self.sleep(min(self.most, self.first * 2**n))


@dataclass
class Aligned:
    """A list in, a list of the same length out: the whole, else halves, else one by one.

    After a fatal failure the rest is marked and nothing more is asked.
    """

    translator: Translator
    retry: Retry = field(default_factory=lambda: Retry(times=1))
    failed: str = "[Translation unavailable]"
    fatal: tuple[type[BaseException], ...] = ()
    stopped: bool = False

    def __call__(self, texts: Sequence[str]) -> list[str]:
        if self.stopped:
            return [self.failed] * len(texts)
        if not texts:
            return []
        try:
            out = list(self.retry(lambda: self.translator.translate_list(texts) if len(texts) > 1 else [self.translator.translate(texts[0])]))
        except self.fatal:
            self.stopped = True
            return [self.failed] * len(texts)
        if len(out) == len(texts):
            return out
        half = (len(texts) + 1) // 2
        return self(texts[:half]) + self(texts[half:])


def with_empties(translate: Callable[[list[str]], list[str]], texts: Sequence[str]) -> list[str]:
    """Texts that are blank keep their place untranslated."""
    full = [t for t in texts if t.strip()]
    done = iter(translate(full))
    return [next(done) if t.strip() else t for t in texts]


def enrich(batches: DataFrame, translator: str = "offline", texts: str = "texts", **options) -> DataFrame:
    """batches with translated: an array as long as texts, from one translator a partition. Blank texts stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligned = Aligned(REGISTRY[translator](**options))
        for frame in frames:
            yield frame.assign(translated=[with_empties(aligned, list(x)) for x in frame[texts]])

    schema = StructType([*batches.schema, StructField("translated", ArrayType(StringType()))])
    return batches.mapInPandas(run, schema)


def extract_paragraphs(reply: str, n: int) -> list[str]:
    """n paragraphs of a reply: marked (1) .. (n), in their order; marked in any order; parted by @@; lines. The last step stands as it is."""
    marked = re.findall(r"\((\d+)\)\s*(.*?)(?=\n*\(\d+\)|\Z)", reply, re.S)
    in_turn = [t.strip() for i, (k, t) in enumerate(marked, 1) if int(k) == i]
    if len(in_turn) == n:
        return in_turn
    by_number = [t.strip() for _, t in sorted(marked, key=lambda m: int(m[0]))]
    if len(by_number) == n:
        return by_number
    parted = [t.strip() for t in reply.split("@@") if t.strip()]
    if len(parted) == n:
        return parted
    return [t.strip() for t in reply.splitlines() if t.strip()]


def extract_json(reply: str) -> dict | None:
    """The first balanced object of a reply that parses, brackets in strings ignored."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", reply):
        try:
            found, _ = decoder.raw_decode(reply, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def unwrap_echo(found: dict, layers: int = 2) -> dict:
    """The values inside an echoed schema: at most `layers` deep, only where every key is a schema's."""
    for _ in range(layers):
        inner = found.get("properties")
        if not (found and set(found) <= SCHEMA_KEYS and isinstance(inner, dict)):
            break
        found = inner
    return found


def lint_verdicts(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """asked (signature) with verdict, action, answered: what is missing or unknown is unsure; only skip skips."""
    known = replies.select("signature", F.lower("verdict").alias("said"))
    out = asked.join(known, "signature", "left")
    verdict = F.when(F.col("said").isin(*VERDICTS), F.col("said")).otherwise("unsure")
    return out.select("signature", verdict.alias("verdict"), F.when(verdict == "skip", "llm-skip").otherwise("translate").alias("action"), F.coalesce(F.col("said").isin(*VERDICTS), F.lit(False)).alias("answered"))


def classify_pages(rows: DataFrame, size: int = 12) -> DataFrame:
    """Signatures with the page of the questionnaire that they are on, largest first."""
    from pyspark.sql import Window

    order = Window.orderBy(F.col("chars").desc(), "signature")  # a row a signature
    return rows.withColumn("page", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


class Delimited(Translator):
    """Lists in one request, texts parted by the delimiter; one by one where the reply has another number of parts.

    ask: the request that a user plugs in. An empty reply is an error.
    """

    def __init__(self, ask: Callable[[str], str]):
        self.ask = ask

    def translate(self, text: str) -> str:
        reply = self.ask(text)
        if not reply.strip():
            raise ValueError("the reply is empty")
        return reply

    def translate_list(self, texts: Sequence[str]) -> list[str]:
        if len(texts) < 2:
            return [self.translate(t) for t in texts]
        reply = self.translate(DELIMITER.join(texts))
        parts = extract_paragraphs(reply, len(texts))
        return parts if len(parts) == len(texts) else [self.translate(t) for t in texts]


def chat_tokens(count: Callable[[str], int], text: str | None) -> int:
    """Tokens of a text as a chat's only message: its own, those of the role, four for the message and two for the reply."""
    return 4 + count("user") + count(text or "") + 2


def token_counts(rows: DataFrame, text: str, counter: Callable[[], Callable[[str], int]], name: str = "tokens") -> DataFrame:
    """rows with chat_tokens() of a text; counter makes, once a task, what counts the tokens of a string."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter()
        for batch in batches:
            yield batch.map(lambda t: chat_tokens(count, t)).astype("int64")

    return rows.withColumn(name, F.pandas_udf(run, "long")(F.col(text)))
