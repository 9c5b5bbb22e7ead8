"""Canonical terms by synonym groups, ordered patterns and code prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import first_pattern, first_prefix, lookup, strip


def _table(groups: dict[str, list[str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, words in groups.items():
        for w in (name, *words):
            out.setdefault(w.lower(), name)
    return out


DIAGNOSES, SYMPTOMS = _table(C.DIAGNOSIS_SYNONYMS), _table(C.SYMPTOM_SYNONYMS)


def diagnosis(c: Column) -> Column:
    """The canonical diagnosis, or the term itself."""
    return lookup(F.lower(strip(c)), DIAGNOSES, strip(c))


def symptom(c: Column) -> Column:
    return lookup(F.lower(strip(c)), SYMPTOMS, strip(c))


def terms_match(a: Column, b: Column, kind: str = "diagnosis") -> Column:
    """Equality under synonyms; terms of other kinds are equal but for case."""
    name = {"diagnosis": diagnosis, "symptom": symptom}.get(kind, strip)
    return F.lower(name(a)) == F.lower(name(b))


def disposition(c: Column) -> Column:
    return first_pattern(F.lower(c), C.DISPOSITION_RULES, "Other")


def symptom_pattern(c: Column) -> Column:
    return first_pattern(F.lower(c), C.SYMPTOM_RULES, "")


def medication_pattern(c: Column) -> Column:
    return first_pattern(F.lower(c), C.MEDICATION_RULES)


def procedure_pattern(c: Column) -> Column:
    return first_pattern(F.lower(c), C.PROCEDURE_RULES)


def sex(c: Column) -> Column:
    """male or female, or the term itself."""
    low = F.lower(strip(c))
    return F.when(low.isin("m", "male", "man"), "male").when(low.isin("f", "female", "woman"), "female").otherwise(strip(c))


def icd9(c: Column) -> Column:
    """The canonical problem of a code, by its longest known prefix."""
    return first_prefix(F.upper(strip(c)), C.ICD9_PREFIXES)


def problem_display(c: Column) -> Column:
    """The display name of a problem by its first pattern, or the text itself."""
    return F.coalesce(first_pattern(F.lower(c), C.PROBLEM_DISPLAY), c)
