"""One call from notes to scores, with a caller's client or by rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..sources import tables
from . import backends, generation, normalize, recover, risk


@dataclass(frozen=True)
class Analysis:
    """``documents`` has (hadm_id, backend, error, raw), ``facts`` normalized facts, ``scores`` one row per document with facts."""

    documents: DataFrame
    facts: DataFrame
    scores: DataFrame


def analyse(notes: DataFrame, make: Callable[[], generation.Client] | None = None, path: str | None = None, fall_back: bool = True, at_once: int = 8) -> Analysis:
    """Facts and scores of notes (hadm_id, text).

    Without a client all notes go through the rules. With one, each note is asked for once and its
    answer kept at ``path``; notes whose request fails go through the rules if ``fall_back``, else they
    have no facts and an error. Empty and null notes have the error empty_input and no facts.
    """
    said = strip(F.coalesce("text", F.lit(""))) != ""
    whole = notes.filter(said)
    none = notes.filter(~said).select("hadm_id", F.lit("none").alias("backend"), F.lit("empty_input").alias("error"), F.lit(None).cast("string").alias("raw"))
    ruled = lambda rows: backends.by_rules(rows).join(rows.select("hadm_id"), "hadm_id", "right")
    if make is None:
        made = ruled(whole).select("hadm_id", F.lit("rules").alias("backend"), F.lit(None).cast("string").alias("error"), "raw")
    else:
        path = path or tables.new_place(notes.sparkSession, "analysis")
        told = generation.once_written(whole.select("hadm_id", F.col("text").alias("prompt")), lambda rows: generation.completions(rows, make, at_once), f"{path}/answers")
        good = told.filter("error IS NULL").select("hadm_id", F.lit("client").alias("backend"), "error", "raw")
        failed = told.filter("error IS NOT NULL").select("hadm_id", F.concat(F.lit("pipeline_error: "), "error").alias("error"))
        if fall_back:
            again = ruled(whole.join(failed.select("hadm_id"), "hadm_id", "left_semi")).join(failed, "hadm_id")
            rest = again.select("hadm_id", F.lit("rules after the client").alias("backend"), "error", "raw")
        else:
            rest = failed.select("hadm_id", F.lit("client").alias("backend"), "error", F.lit(None).cast("string").alias("raw"))
        made = good.unionByName(rest)
    documents = made.unionByName(none)
    facts = normalize.normalize(recover.extract_facts(documents.select("hadm_id", "raw")))
    return Analysis(documents, facts, risk.results(risk.parse(normalize.render(facts))))
