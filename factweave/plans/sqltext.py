"""Pieces of SQL for the statements that state what the operators compute, for another engine."""

from __future__ import annotations

from collections.abc import Iterable

from .. import config as C
from ..sources import adapter as A


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def within(expr: str, words: Iterable[str]) -> str:
    return f"{expr} IN ({', '.join(lit(w) for w in words)})"


def words(expr: str, table: dict[str, Iterable[str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {within(expr, ws)} THEN {lit(v)}" for v, ws in table.items()) + f" ELSE {otherwise} END"


def lookup(expr: str, table: dict[str, str], otherwise: str | None = None) -> str:
    by: dict[str, list[str]] = {}
    for k, v in table.items():
        by.setdefault(v, []).append(k)
    return words(expr, by, otherwise or "NULL")


def number(expr: str) -> str:
    return f"nullif(regexp_extract({expr}, '-?[0-9]+(?:\\.[0-9]+)?'), '')"


def contains_any(expr: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(n)})" for n in needles) + ")"


def name(expr: str) -> str:
    return f"upper(trim(trim(trim({expr}), '*<>')))"


def strict_ok(c: str, k: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = {lit(cl)} THEN {within(k, ks)}" for cl, ks in C.STRICT_KEYWORDS.items()) + " ELSE true END"


def canonical(c: str, k: str, v: str) -> str:
    low = f"lower({v})"
    sq = f"regexp_replace({low}, '\\s+', ' ', 'g')"
    return f"""CASE
  WHEN {c} = 'DEMOGRAPHICS' THEN CASE WHEN {k} = 'Sex' THEN {words(low, C.SEX_WORDS)} WHEN {k} = 'Age' THEN {number(v)} ELSE {v} END
  WHEN {within(c, C.NUMERIC_CLUSTERS)} THEN {number(v)}
  WHEN {c} = 'MEDICATIONS' THEN CASE WHEN {k} IN ('Medication Count', 'New Medications Count') THEN {number(v)} WHEN {within(k, C.LOW_INFO_FLAGS)} THEN {words(low, C.FLAG_WORDS)} ELSE {v} END
  WHEN {c} = 'PROCEDURES' THEN CASE WHEN {k} = 'Dialysis' THEN {words(low, C.DIALYSIS_WORDS)} WHEN {k} = 'Mechanical Ventilation' THEN CASE WHEN {low} = 'no' THEN 'no' ELSE coalesce({number(v)}, 'yes') END ELSE {words(low, C.PROCEDURE_WORDS)} END
  WHEN {c} = 'DISPOSITION' THEN CASE WHEN {k} = 'Discharge Disposition' THEN CASE WHEN {contains_any(low, ["home with", "home w", "services"])} THEN 'Home with Services' WHEN {low} = 'home' OR starts_with({low}, 'home ') THEN 'Home'
      WHEN {contains_any(low, ["snf", "skilled nursing"])} THEN 'SNF' WHEN contains({low}, 'rehab') THEN 'Rehab' WHEN contains({low}, 'ltac') THEN 'LTAC' WHEN contains({low}, 'hospice') THEN 'Hospice' WHEN {contains_any(low, ["ama", "against medical advice"])} THEN 'AMA' END
    WHEN {k} = 'Mental Status' THEN CASE WHEN contains({low}, 'confus') THEN 'confused' WHEN contains({low}, 'letharg') THEN 'lethargic' WHEN contains({low}, 'alert') THEN 'alert' WHEN contains({low}, 'orient') THEN 'oriented' END ELSE {v} END
  WHEN {c} = 'PROBLEMS' THEN {words(sq, C.PROBLEM_WORDS)}
  WHEN {c} = 'SYMPTOMS' THEN {words(sq, C.SYMPTOM_WORDS, f"CASE WHEN contains({sq}, 'severe') THEN 'severe' END")}
  ELSE {v} END"""


def parsed(lines: str) -> str:
    """CTEs ending in ``parsed`` (hadm_id, pos, line, c, k, v, t); c is null for lines that are no facts."""
    return f"""
lines AS MATERIALIZED ({lines}),
split AS (SELECT hadm_id, pos, line, list_transform(string_split(trim(regexp_replace(trim(line), '^[-*•]\\s+', '')), '|'), lambda x: trim(x)) AS p FROM lines),
shaped AS (SELECT *, len(p) AS n, {name('p[1]')} AS guess, {lookup('p[1]', C.KEYWORD_CLUSTER)} AS inferred FROM split),
parsed AS (SELECT hadm_id, pos, line,
  CASE WHEN n = 4 AND p[1] <> '' AND p[2] <> '' AND p[3] <> '' THEN p[1] WHEN n = 3 AND p[1] <> '' AND p[2] <> '' AND p[3] <> '' THEN CASE WHEN {within('guess', C.CLUSTERS)} THEN guess ELSE inferred END END AS c,
  CASE WHEN n = 4 THEN p[2] WHEN {within('guess', C.CLUSTERS)} THEN p[2] ELSE p[1] END AS k,
  CASE WHEN n = 4 THEN p[3] WHEN {within('guess', C.CLUSTERS)} THEN p[3] ELSE p[2] END AS v,
  CASE WHEN n = 4 THEN CASE WHEN p[4] = '' THEN 'Unknown' ELSE p[4] END WHEN {within('guess', C.CLUSTERS)} THEN 'Unknown' ELSE p[3] END AS t
  FROM shaped)"""


def normalized(lines: str) -> str:
    """CTEs ending in ``judged`` (status per line), ``facts`` and ``best`` (one per key)."""
    return (
        parsed(lines)
        + f""",
named AS (SELECT hadm_id, pos, c IS NOT NULL AS is_fact, {name('c')} AS c, trim(k) AS k0, trim(v) AS v, CASE WHEN {within('t', C.TIMESTAMPS)} THEN t WHEN lower(t) = 'adm' THEN 'Admission' WHEN lower(t) = 'dc' THEN 'Discharge' ELSE 'Unknown' END AS t FROM parsed),
aliased AS (SELECT *, CASE WHEN c = 'VITALS' THEN {lookup('k0', C.VITAL_ALIASES, 'k0')} WHEN c = 'LABS' THEN {lookup('k0', C.LAB_ALIASES, 'k0')} ELSE k0 END AS k FROM named),
pairs AS (SELECT *, c = 'VITALS' AND k = 'Blood Pressure' AS bp, regexp_extract(v, '([0-9]+(?:\\.[0-9]+)?)\\s*/\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS b1, regexp_extract(v, '([0-9]+(?:\\.[0-9]+)?)\\s*/\\s*([0-9]+(?:\\.[0-9]+)?)', 2) AS b2 FROM aliased),
valued AS (SELECT *, CASE WHEN bp THEN nullif(b1, '') WHEN {strict_ok('c', 'k')} THEN {canonical('c', 'k', 'v')} END AS value FROM pairs),
judged AS (SELECT *, CASE WHEN NOT is_fact THEN 'unparsed' WHEN {within('v', C.PLACEHOLDERS)} THEN 'placeholder' WHEN value IS NULL THEN 'noncanonical' WHEN bp THEN 'expanded' ELSE 'kept' END AS status FROM valued),
facts AS (
  SELECT hadm_id, pos, 0 AS sub_pos, c AS cluster, k AS keyword, value, CASE WHEN t <> 'Unknown' THEN t WHEN c = 'DISPOSITION' THEN 'Discharge' WHEN c = 'UTILIZATION' THEN 'Past' WHEN c = 'PROBLEMS' THEN CASE WHEN value = 'acute' THEN 'Discharge' ELSE 'Past' END ELSE 'Admission' END AS ts FROM judged WHERE status = 'kept'
  UNION ALL SELECT hadm_id, pos, 0, c, 'Systolic BP', b1, t FROM judged WHERE status = 'expanded'
  UNION ALL SELECT hadm_id, pos, 1, c, 'Diastolic BP', b2, t FROM judged WHERE status = 'expanded'),
ranked AS (SELECT *, CASE ts WHEN 'Discharge' THEN 0 WHEN 'Admission' THEN 1 WHEN 'Past' THEN 2 WHEN 'Unknown' THEN 3 ELSE 999 END AS r FROM facts),
best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY hadm_id, cluster, keyword ORDER BY r, pos, sub_pos) = 1)"""
    )


#: Sanitized facts, in all combinations of scope and profile that queries use.
_RECOVERED_TS = "CASE guess WHEN 'DISPOSITION' THEN 'Discharge' WHEN 'UTILIZATION' THEN 'Past' ELSE 'Admission' END"


def items(v: str, limit: int | None = None, drop: bool = True) -> str:
    """The items of a list value."""
    split = f"list_filter(list_transform(string_split_regex(trim({v}), '[;\\n,]+'), lambda x: trim(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' -')), lambda x: x <> '')"
    if limit:
        split = f"{split}[1:{limit}]"
    if drop:
        split = f"list_filter({split}, lambda x: NOT ({within('lower(x)', [*C.TEXT_PLACEHOLDERS, 'nil'])}))"
    return split


def sanitized(lines: str, scope: str, experimental: bool = False) -> str:
    """CTEs ending in ``clean`` (hadm_id, pos, sub_pos, cluster, keyword, value, ts)."""
    recover = f"CASE WHEN n = 3 AND {within('guess', C.OBJECTIVE_CLUSTERS + C.SEMANTIC_CLUSTERS)} AND p[2] <> '' AND p[3] <> '' THEN [guess, p[2], p[3], {_RECOVERED_TS}] WHEN n = 3 AND inferred IS NOT NULL AND p[2] <> '' AND p[3] <> '' THEN [inferred, p[1], p[2], p[3]] ELSE p END" if experimental else "p"
    moved = f"CASE WHEN {within('c', C.SEMANTIC_CLUSTERS)} AND {within('k', C.STRICT_KEYWORDS['DEMOGRAPHICS'] + C.STRICT_KEYWORDS['DISPOSITION'])} THEN {lookup('k', C.KEYWORD_CLUSTER)} ELSE c END" if experimental else "c"
    sq = "regexp_replace(lower(trim(v)), '\\s+', ' ', 'g')"
    objective_ts = "CASE cluster WHEN 'DISPOSITION' THEN 'Discharge' WHEN 'UTILIZATION' THEN 'Past' ELSE 'Admission' END" if scope == "objective" or experimental else "ts"
    kw = "rtrim(regexp_replace(trim(k), '\\s+', ' ', 'g'), ' :;,.')"
    placeholder = within(sq, C.TEXT_PLACEHOLDERS)
    problem = words(sq, C.PROBLEM_WORDS, f"CASE WHEN t = 'Discharge' AND contains({sq}, 'discharg') THEN 'acute' WHEN lower(t) = 'past' AND (contains({sq}, 'hist') OR contains({sq}, 'past')) THEN 'chronic' END")
    symptom = words(sq, C.SYMPTOM_WORDS, f"CASE WHEN contains({sq}, 'severe') THEN 'severe' END")
    if not experimental:
        semantic = "SELECT hadm_id, pos, 0 AS sub_pos, c AS cluster, k AS keyword, v AS value, t AS ts FROM semantic"
    else:
        semantic = f"""
SELECT hadm_id, pos, 0 AS sub_pos, c AS cluster, k AS keyword, v AS value, t AS ts FROM semantic WHERE c NOT IN ('PROBLEMS', 'SYMPTOMS')
UNION ALL SELECT hadm_id, pos, i - 1, c, its[i], CASE WHEN c = 'SYMPTOMS' THEN 'yes' WHEN {within('lower(kw)', C.ACUTE_KEYS)} THEN 'acute' ELSE 'chronic' END, CASE WHEN c = 'SYMPTOMS' THEN CASE WHEN {within('lower(kw)', C.ADMISSION_KEYS)} THEN 'Admission' ELSE 'Discharge' END WHEN {within('lower(kw)', C.ACUTE_KEYS)} THEN 'Discharge' ELSE 'Past' END
  FROM (SELECT *, unnest(range(1, len(its) + 1)) AS i FROM keyed WHERE listed)
UNION ALL SELECT hadm_id, pos, 0, c, kw, nv, CASE WHEN c = 'PROBLEMS' AND lower(t) = 'unknown' THEN CASE nv WHEN 'acute' THEN 'Discharge' WHEN 'chronic' THEN 'Past' ELSE 'Admission' END ELSE t END
  FROM (SELECT *, CASE WHEN c = 'PROBLEMS' THEN {problem} ELSE {symptom} END AS nv FROM keyed WHERE NOT listed AND NOT {placeholder}) WHERE nv IS NOT NULL"""
    keep = "AND false" if scope == "objective" else ""
    return f"""
lines AS MATERIALIZED ({lines}),
split AS (SELECT hadm_id, pos, list_transform(string_split(line, '|'), lambda x: trim(x)) AS p FROM lines),
shaped AS (SELECT *, len(p) AS n, {name('p[1]')} AS guess, {lookup('p[1]', C.KEYWORD_CLUSTER)} AS inferred FROM split),
recovered AS MATERIALIZED (SELECT hadm_id, pos, {recover} AS p FROM shaped),
fields AS (SELECT hadm_id, pos, {name('p[1]')} AS c, p[2] AS k, CASE WHEN starts_with(p[3], '$') THEN trim(ltrim(p[3], '$')) ELSE p[3] END AS v, CASE WHEN lower(p[4]) = 'adm' THEN 'Admission' WHEN lower(p[4]) = 'dc' THEN 'Discharge' ELSE p[4] END AS t
  FROM recovered WHERE len(p) = 4 AND p[1] <> '' AND p[2] <> '' AND p[3] <> '' AND p[4] <> ''),
stated AS MATERIALIZED (SELECT * FROM fields WHERE lower(v) <> 'not stated' AND NOT ({within('c', C.NUMERIC_CLUSTERS)} AND NOT regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?'))),
placed AS MATERIALIZED (SELECT hadm_id, pos, {moved} AS c, k, v, t FROM stated),
top AS (SELECT hadm_id, pos, 0 AS sub_pos, c AS cluster, k AS keyword, v AS value, t AS ts FROM placed WHERE {within('c', C.OBJECTIVE_CLUSTERS)}
  QUALIFY row_number() OVER (PARTITION BY hadm_id, c, k ORDER BY CASE WHEN lower(t) = 'discharge' THEN 0 WHEN lower(t) = 'admission' THEN 1 ELSE 2 END, pos) = 1),
semantic AS (SELECT * FROM placed WHERE NOT {within('c', C.OBJECTIVE_CLUSTERS)} {keep}),
keyed AS MATERIALIZED (SELECT *, {within('lower(kw)', C.ACUTE_KEYS + C.CHRONIC_KEYS)} AND c = 'PROBLEMS' AND len(its) > 0 OR {within('lower(kw)', C.ADMISSION_KEYS + C.DISCHARGE_KEYS)} AND c = 'SYMPTOMS' AND len(its) > 0 AS listed FROM (SELECT *, list_filter(its0, lambda x, i: list_position(its0, x) = i) AS its FROM (SELECT *, {kw} AS kw, {items('v')} AS its0 FROM semantic WHERE c IN ('PROBLEMS', 'SYMPTOMS')) y) z),
both_kinds AS (SELECT 0 AS o, hadm_id, pos, sub_pos, cluster, keyword, value, {objective_ts} AS ts FROM top UNION ALL SELECT 1 AS o, * FROM ({semantic}) sem),
clean AS (SELECT * FROM both_kinds QUALIFY row_number() OVER (PARTITION BY hadm_id, cluster, keyword, value, ts ORDER BY o, pos, sub_pos) = 1)"""


LINES, SCORED, MARKDOWN, FACTS = A.LINES, A.SCORED, A.MARKDOWN, A.FACTS
