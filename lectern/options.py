"""Settings of a run, as options of a command line, and what they mean to the operators.

Keys of services are never options: a translator that a user registers reads them from its own environment.
"""

from __future__ import annotations

import argparse
import re
from dataclasses import MISSING, dataclass, field, fields

from lectern.functions import constants as K
from lectern.functions import languages
from lectern.operators import enrich
from lectern.operators.questions import check_modes


def _opt(default, text: str):
    return field(default_factory=(lambda: list(default)), metadata={"help": text}) if isinstance(default, list) else field(default=default, metadata={"help": text})


@dataclass
class Options:
    """Every option with its default; lists are given as texts parted by commas."""

    book: str = _opt("", "the book: an archive, text, Markdown or subtitle file, or a pattern")
    out: str = _opt("", "folder of the results")
    only_files: list[str] = _opt([], "parts of an archive to translate, others are left out")
    exclude_files: list[str] = _opt([], "parts of an archive that stay as they are")
    test_limit: int = _opt(0, "translate only so many units (0: all)")
    start: str = _opt("", "text of the first unit to translate again")
    end: str = _opt("", "text of the last unit to translate again")
    resume: str = _opt("", "table of translations that are done")
    tags: list[str] = _opt([], "tag mode: elements to translate; without it a plan is made")
    exclude_tags: list[str] = _opt(list(K.EXCLUDED_TAGS), "elements whose text stays")
    strings: bool = _opt(False, "tag mode: translate all strings too")
    sentences: bool = _opt(False, "translate sentence by sentence")
    dry_run: bool = _opt(False, "print the plan alone")
    min_coverage: float = _opt(0.5, "least share of the text that a plan must cover")
    group_size: int = _opt(8, "lines of verse that are translated together")
    classify: bool = _opt(False, "ask a model about signatures in doubt")
    batch_size: int = _opt(10, "lines of a batch")
    block_size: int = _opt(2000, "characters of a batch of Markdown or subtitles")
    batch: str = _opt("", "folder to write requests for a batch service into")
    batch_results: str = _opt("", "results of a batch service to go on with")
    context: int = _opt(0, "earlier pairs to send along")
    workers: int = _opt(1, "translators at a time")
    interval: float = _opt(0.0, "seconds between two requests of a translator")
    single: bool = _opt(False, "the translation alone")
    style: str = _opt("", "style of inserted translations")
    color: str = _opt("", "colour of inserted translations")
    quiet: bool = _opt(False, "print nothing")
    language: str = _opt("zh-hans", "language of the translation, by code or name")
    source: str = _opt("auto", "language of the book")
    translator: str = _opt("offline", "a registered translator")
    models: list[str] = _opt([], "models in turn")
    base_url: str = _opt("", "address of the service")
    prompt: str = _opt("", "a prompt, or a file with one")
    temperature: float = _opt(1.0, "temperature of the model")
    extra: str = _opt("", "more fields of requests, as JSON")

    def __post_init__(self) -> None:
        """Fails on settings that can't be carried out."""
        self.workers = max(1, self.workers)
        names = {v.lower() for v in languages.LANGUAGES.values()} | {k.lower() for k in languages.LANGUAGES}
        if self.language.lower() not in names:
            raise ValueError(f"unknown language {self.language}")
        if self.translator not in enrich.REGISTRY:
            raise ValueError(f"unknown translator {self.translator}; there are {', '.join(sorted(enrich.REGISTRY))}")
        if bool(self.start) != bool(self.end):
            raise ValueError("start and end belong together")
        if not 0 <= self.min_coverage <= 1:
            raise ValueError("min_coverage is a share")
        modes = {"plan"} if not self.tags else set()
        modes |= {name for name, on in (("retranslate", self.start), ("batch", self.batch or self.batch_results), ("sentence", self.sentences), ("context", self.context)) if on}
        check_modes(modes)

    def css(self) -> str:
        """The style of inserted translations."""
        return "; ".join(x for x in (self.style.strip().rstrip(";"), f"color: {self.color}" if self.color else "") if x)

    def limit(self) -> int | None:
        return self.test_limit or None


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lectern", description="Translates books, keeping their structure.")
    for f in fields(Options):
        name = "--" + f.name.replace("_", "-")
        default = f.default if f.default_factory is MISSING else f.default_factory()
        if isinstance(default, bool):
            out.add_argument(name, action="store_true", help=f.metadata["help"])
        elif isinstance(default, list):
            out.add_argument(name, type=lambda x: [p for p in re.split(r"\s*,\s*", x) if p], default=default, help=f.metadata["help"])
        else:
            out.add_argument(name, type=type(default), default=default, help=f.metadata["help"])
    return out


def from_args(args: list[str]) -> Options:
    return Options(**vars(parser().parse_args(args)))
