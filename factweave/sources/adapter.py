"""Deterministic fact lines from the relational tables, in SQL that several engines read alike.

The tables hold no notes. These statements turn orders and line items of a customer into the fact
lines of a document, with every kind of drift the operators repair. They use integers only inside
values, so that no engine's number formatting shows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import once

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"]


def choose(number: str, options: list[str]) -> str:
    """One of some SQL expressions, by a whole number."""
    return f"CASE ({number}) % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def pick(number: str, words: list[str]) -> str:
    """One of some words, by a whole number, in one call that engines know alike."""
    joined = ";".join(words).replace("'", "''")
    return f"split_part('{joined}', ';', CAST(({number}) % {len(words)} AS INT) + 1)"


def quoted(words: list[str]) -> list[str]:
    return ["'" + w.replace("'", "''") + "'" for w in words]


_KEYWORDS = {
    "VITALS": ["Heart Rate", "HR", "BP", "Blood Pressure", "Temp", "SpO2", "Resp", "Weight", "SBP", "Mood"],
    "LABS": ["Sodium", "Na", "Hgb", "HGB", "Creatinine", "BUN", "K", "WBC", "Plt", "UREA N", "Glucose"],
    "DEMOGRAPHICS": ["Age", "Sex", "Sex", "Race"],
    "UTILIZATION": ["Prior Admissions 12mo", "ED Visits 6mo", "Current Length of Stay", "LOS"],
    "MEDICATIONS": ["Medication Count", "Polypharmacy", "Anticoagulation", "Opioid Therapy", "New Medications Count", "Statin"],
    "PROCEDURES": ["Dialysis", "Mechanical Ventilation", "Any Procedure", "Surgery", "Biopsy"],
    "DISPOSITION": ["Discharge Disposition", "Mental Status", "Discharge Disposition"],
    "PROBLEMS": ["CHF", "Discharge Dx", "Essential hypertension", "PMH/Comorbidities", "Type 2 diabetes", "and arm", "Stroke"],
    "SYMPTOMS": ["Fever", "ADM Symptoms", "chest pain", "and arm", "face", "DC symptoms", "Shortness of breath"],
}
_VALUES = {
    "VITALS": ["concat(q, '/', q + 40)", "concat(q, ' bpm')", "concat('', q)", "'___'", "'high'", "concat('-', q, '.5 x')"],
    "LABS": ["concat(q, ' mg')", "concat('', q)", "concat(q, '.', q)", "'pending'", "'N/A'", "concat('$', q)"],
    "DEMOGRAPHICS": ["concat(q, ' years')", "'m'", "'Female'", "'x'"],
    "UTILIZATION": ["concat('', q % 6)", "concat(q, ' days')", "'none'", "'not stated'"],
    "MEDICATIONS": ["concat('', q)", "'Yes'", "'no'", "'TRUE'", "'0'", "'maybe'"],
    "PROCEDURES": ["'yes'", "'canceled'", "'no'", "'done'", "concat(q, ' days')", "'started'", "'absent'"],
    "DISPOSITION": ["'Home'", "'Home with services'", "'SNF'", "'alert and oriented'", "'Confused'", "'rehab facility'", "'AMA'", "'moon'"],
    "PROBLEMS": ["'chronic'", "'Present'", "'ruled  out'", "'active'", "'CHF; COPD, HTN; CHF'", "'history'", "'unclear'", "'not stated'"],
    "SYMPTOMS": ["'yes'", "'Denies'", "'very severe'", "'fever; cough, none; - chills -'", "'marked'", "'odd'", "'no'"],
}
_CLUSTERS = list(_KEYWORDS)

#: (hadm_id, pos, p, s, q, pr, os, cluster, keyword, value, ts), before drift.
FACTS = f"""
SELECT hadm_id, pos, p, s, q, pr, os, cluster, kw AS keyword,
  CASE cluster {" ".join(f"WHEN '{c}' THEN {choose('q + pos', _VALUES[c])}" for c in _CLUSTERS)} END AS value,
  CASE WHEN rf = 'R' THEN 'Past' WHEN rf = 'A' AND q % 3 = 0 THEN 'Unknown' WHEN rf = 'A' THEN 'ADM' WHEN ls = 'O' AND q % 4 = 0 THEN 'dc' WHEN ls = 'O' THEN 'Discharge' ELSE 'Admission' END AS ts
FROM (
  SELECT *, CASE cluster {" ".join(f"WHEN '{c}' THEN {pick('s + q', _KEYWORDS[c])}" for c in _CLUSTERS)} END AS kw
  FROM (SELECT *, {pick('p + pos', _CLUSTERS)} AS cluster FROM (
    SELECT o_custkey AS hadm_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
      l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INT) AS q, l_returnflag AS rf, l_linestatus AS ls, o_orderpriority AS pr, o_orderstatus AS os
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) base) clustered) worded
"""

#: (hadm_id, pos, line): the facts with drift by position.
LINES = f"""
SELECT hadm_id, pos, CASE pos % 13
  WHEN 1 THEN concat_ws('|', 'CLUSTER', cluster, keyword, value, ts)
  WHEN 2 THEN concat_ws('|', cluster, keyword, value)
  WHEN 3 THEN concat('- ', concat_ws('|', cluster, keyword, value, ts))
  WHEN 4 THEN concat_ws('|', keyword, value, ts)
  WHEN 5 THEN concat_ws(' | ', concat('*', cluster, '**'), keyword, value, ts)
  WHEN 6 THEN concat_ws('|', 'CLUSTERS', keyword, value, ts)
  WHEN 7 THEN concat_ws('|', lower(cluster), keyword, value, '')
  WHEN 8 THEN 'CLUSTER|Keyword|Value|Timestamp'
  WHEN 9 THEN concat('## ', cluster, ' one fact per line')
  ELSE concat_ws('|', cluster, keyword, value, ts) END AS line
FROM ({FACTS}) f
"""

_SCALED = [
    ("DEMOGRAPHICS", "Age", "q + 45"), ("VITALS", "Heart Rate", "q * 4 + 20"), ("VITALS", "Systolic BP", "q * 4 + 40"), ("VITALS", "Respiratory Rate", "q"), ("VITALS", "Temperature", "q % 15 + 92"), ("VITALS", "SpO2", "q % 25 + 78"),
    ("LABS", "Hemoglobin", "q % 14 + 4"), ("LABS", "WBC", "q % 22"), ("LABS", "Platelet", "q * 9"), ("LABS", "Sodium", "q % 40 + 115"), ("LABS", "Potassium", "q % 8"), ("LABS", "Creatinine", "q % 6"), ("LABS", "BUN", "q * 2"),
    ("LABS", "Glucose", "q * 10"), ("LABS", "Bicarbonate", "q"), ("MEDICATIONS", "Medication Count", "q % 20"), ("UTILIZATION", "Prior Admissions 12mo", "q % 7"), ("UTILIZATION", "ED Visits 6mo", "q % 5"),
    ("UTILIZATION", "Current Length of Stay", "q"), ("UTILIZATION", "Days Since Last Admission", "q * 5"),
]
_NAMED = [
    ("DEMOGRAPHICS", "Sex", ["male", "female"]), ("MEDICATIONS", "Anticoagulation", ["yes", "no"]), ("MEDICATIONS", "Polypharmacy", ["yes", "no", "no"]), ("PROCEDURES", "Dialysis", ["done", "no", "decided"]), ("PROCEDURES", "Any Procedure", ["yes", "no"]),
    ("PROCEDURES", "Mechanical Ventilation", ["no", "3", "yes"]), ("DISPOSITION", "Discharge Disposition", ["Home", "SNF", "AMA", "Home health", "Rehab"]), ("DISPOSITION", "Mental Status", ["alert", "Confused", "lethargic", "A&O"]),
    ("PROBLEMS", "CHF", ["chronic", "acute", "not exist"]), ("PROBLEMS", "PMH: Essential hypertension", ["chronic", "exist"]), ("PROBLEMS", "Discharge Dx", ["CHF; COPD, copd", "acute stroke"]), ("PROBLEMS", "Type 2 diabetes with CKD", ["chronic", "no"]),
    ("PROBLEMS", "Metastatic cancer", ["exist", "absent"]), ("PROBLEMS", "Dementia", ["exist", "not exist"]), ("SYMPTOMS", "ADM: leg edema", ["yes", "severe", "no"]), ("SYMPTOMS", "Shortness of breath", ["yes", "no"]), ("SYMPTOMS", "severe headache/fever", ["severe", "no"]),
    ("SYMPTOMS", "confusion", ["yes", "no"]), ("SYMPTOMS", "DC:cough", ["yes", "no", "odd"]), ("NONSENSE", "x", ["y"]),
]
_ALL = [*[(c, k) for c, k, _ in _SCALED], *[(c, k) for c, k, _ in _NAMED]]

#: (hadm_id, pos, line): canonical facts for scoring, with a few broken lines.
SCORED = f"""
SELECT hadm_id, pos, CASE WHEN pos % 17 = 0 THEN concat('# ', kw) WHEN pos % 19 = 0 THEN concat_ws('|', cluster, kw) WHEN pos % 23 = 0 AND cluster = 'VITALS' THEN concat_ws('|', cluster, kw, concat(value, '/80'), ts) WHEN pos % 7 = 0 THEN concat_ws('|', cluster, kw, concat(value, ' u'), ts) ELSE concat_ws('|', cluster, kw, value, ts) END AS line
FROM (
  SELECT hadm_id, pos, {pick('ix', [c for c, _ in _ALL])} AS cluster, {pick('ix', [k for _, k in _ALL])} AS kw, CASE WHEN q % 2 = 0 THEN 'Admission' ELSE 'Discharge' END AS ts,
    replace(CASE WHEN ix < {len(_SCALED)} THEN concat('', CASE ix {" ".join(f"WHEN {i} THEN {v}" for i, (_, _, v) in enumerate(_SCALED))} END) ELSE CASE ix {" ".join(f"WHEN {len(_SCALED) + i} THEN {pick('q', [w.replace(';', '~') for w in ws])}" for i, (_, _, ws) in enumerate(_NAMED))} END END, '~', ';') AS value
  FROM (SELECT *, (p * 7 + s * 3 + q * 11 + pos) % {len(_ALL)} AS ix FROM ({FACTS}) f) i) g
"""

#: (hadm_id, pos, line): Markdown summaries, one section line or content line per position.
MARKDOWN = f"""
SELECT hadm_id, pos, CASE
  WHEN pos % 5 = 1 THEN concat('## ', cluster)
  WHEN q % 7 = 0 THEN 'not stated'
  WHEN cluster IN ('VITALS', 'LABS') THEN concat(CASE WHEN q % 2 = 0 THEN 'ADM: ' ELSE '' END, keyword, '=', q, '; Weight=not stated')
  WHEN q % 5 = 0 THEN concat(keyword, '=not stated')
  WHEN q % 11 = 0 THEN 'Weight=not stated; SpO2=Not Stated'
  ELSE concat(keyword, '=', value) END AS line
FROM ({FACTS}) f
"""

#: (event and user tables) lines about use of care, one document per user.
USERS = """
SELECT user_id AS hadm_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS pos,
  CASE event_type WHEN 'purchase' THEN concat('UTILIZATION|Prior Admissions 12mo|', n, '|Unknown') WHEN 'error' THEN concat('UTILIZATION|ED Visits 6mo|', n, ' visits|') WHEN 'signup' THEN 'MEDICATIONS|Polypharmacy|1|Unknown' WHEN 'click' THEN concat('MEDICATIONS|Medication Count|', n, '|Unknown') ELSE concat('PROCEDURES|Surgery|', CASE WHEN n % 2 = 0 THEN 'performed' ELSE '0' END, '|Unknown') END AS line
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs one of the statements above over the tables of a folder."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the statement stay as they are
    for t in named:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    made = spark.sql(sql, **named)
    return once(made, [c for c in made.columns if c != "line"], line=F.col("line")) if "line" in made.columns else made
