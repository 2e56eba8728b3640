"""From pages to pages: the plan of a book made, checked and carried out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.operators import enrich, html, insert, questions, resume
from lectern.plans import translation


@dataclass
class Plan:
    """units to translate, what is skipped (reason, chars), the rows of signatures, and the fingerprint of how it was made."""

    units: DataFrame
    skipped: DataFrame
    rows: DataFrame
    fingerprint: str


def prepare(pages: DataFrame, actions: DataFrame | None = None, ask: Callable[[str, dict], str] | None = None, least: float = 0.5, excluded: tuple[str, ...] = K.EXCLUDED_TAGS, sheets: str | None = None, saved: str | None = None) -> Plan:
    """The plan of pages (page_id, html), in this order: units and skips; a gate on coverage; verdicts of a model on signatures in doubt;
    actions of a person, which go before verdicts; a gate on the fingerprint of a saved state.

    actions: signature, action. ask: a channel for questions.classify(). saved: the fingerprint of the state to go on from.
    """
    parts = html.partition(pages, excluded, sheets=sheets)
    translation.check_coverage(parts, least)
    units, skipped = html.page_units(pages, excluded, sheets=sheets), html.skips(parts)
    decided = actions
    if ask:
        doubt = translation.candidates(units, translation.coverage(parts).first()["total_chars"] or 1)
        said = questions.classify(doubt, ask).filter("verdict = 'skip'").select("signature", F.lit("llm-skip").alias("action"))
        decided = said if actions is None else actions.unionByName(said.join(actions.select("signature"), "signature", "left_anti"))
    if decided is not None:
        units, gone = translation.override(units, decided)
        skipped = skipped.unionByName(gone)
    rows = translation.signature_rows(units)
    chosen = sorted(map(tuple, decided.collect())) if decided is not None else []  # a row a signature that someone decided on
    mark = translation.fingerprint({"excluded": list(excluded), "actions": [list(c) for c in chosen], "sheets": bool(sheets), "version": translation.PLAN_VERSION})
    resume.require_same_plan(saved, mark)
    return Plan(units, skipped, rows, mark)


def translated(units: DataFrame, translator: str = "offline", done: DataFrame | None = None, **options) -> DataFrame:
    """page_id, owner, translation of a plan's units; those that `done` (page_id, owner, translation) has are not asked for again."""
    todo = units if done is None else units.join(done.select("page_id", "owner"), ["page_id", "owner"], "left_anti")
    of = todo.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "owner", "text"))).alias("u"))
    new = enrich.enrich(of.select("page_id", F.col("u.owner").alias("owners"), F.col("u.text").alias("texts")), translator, **options)
    new = new.select("page_id", F.explode(F.arrays_zip("owners", "translated")).alias("x")).select("page_id", F.col("x.owners").alias("owner"), F.col("x.translated").alias("translation"))
    return new if done is None else new.unionByName(done.select("page_id", "owner", "translation"))


def bilingual(pages: DataFrame, plan: Plan, translator: str = "offline", done: DataFrame | None = None, style: str = "", single: bool = False, **options) -> DataFrame:
    """page_id, html with the translations of a plan's units."""
    return insert.insert_translations(pages, translated(plan.units, translator, done, **options), style, single)
