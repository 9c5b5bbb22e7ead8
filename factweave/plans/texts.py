"""Queries on raw outputs, notes and summaries that are made of the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import cloud as CL
from ..operators import gates as G
from ..operators import markdown as M
from ..operators import notes as T
from ..operators import objective as O
from ..operators import recover as V
from ..operators import risk as R
from ..operators import sanitize as S
from ..operators import stage1 as G1
from ..operators import synonyms as Y
from ..sources import adapter as A
from . import queries as Q
from . import sqltext as X

query, read = Q.query, Q.read
_F4 = "concat_ws('|', cluster, keyword, value, ts)"


def joined(lines: DataFrame, name: str = "raw") -> DataFrame:
    """One text per document of its lines (hadm_id, pos, line)."""
    return lines.groupBy("hadm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias(name))


def made(s, d, sql: str) -> DataFrame:
    return A.from_sql(s, d, sql)


# --- raw output --------------------------------------------------------------------------------------

_MARKED = f"SELECT hadm_id, pos, CASE pos % 13 WHEN 1 THEN concat('Thought: ', keyword) WHEN 2 THEN concat('I see ', keyword) WHEN 5 THEN concat('<unused', pos, '>', {_F4}) WHEN 6 THEN concat('input: ', value) WHEN 7 THEN '{{\"K\": 1}}' WHEN 9 THEN concat('constraints: ', {_F4}) WHEN 10 THEN keyword ELSE {_F4} END AS line FROM ({A.FACTS}) f"
_KEPT = f"""m AS ({_MARKED}), n AS (SELECT hadm_id, row_number() OVER (PARTITION BY hadm_id ORDER BY pos) - 1 AS i, regexp_replace(line, '<unused[0-9]+>', '', 'g') AS line FROM m),
e AS (SELECT *, CASE WHEN {X.contains_any("lower(trim(line))", V.THINKING)} THEN 1 WHEN length(line) - length(replace(line, '|', '')) >= 3 OR starts_with(trim(line), '{{') THEN 0 END AS ev FROM n),
k AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY hadm_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS inside FROM e)"""


@query(f"WITH {_KEPT} SELECT hadm_id, i::INT AS pos, line FROM k WHERE coalesce(inside, 0) = 0")
def raw_output_lines(s, d):
    """Outputs with thinking in between and internal tokens."""
    return V.raw_lines(joined(made(s, d, _MARKED)))


_FENCED = f"SELECT hadm_id, pos, CASE pos % 9 WHEN 1 THEN 'START' WHEN 2 THEN '```json' WHEN 4 THEN '```' WHEN 6 THEN ' End ' WHEN 7 THEN keyword ELSE {_F4} END AS line FROM ({A.FACTS}) f"


@query(f"SELECT hadm_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM ({_FENCED}) x WHERE upper(trim(line)) NOT IN ('START', 'END') AND NOT starts_with(trim(line), '```') GROUP BY hadm_id")
def raw_output_text(s, d):
    return V.clean_text(joined(made(s, d, _FENCED)))


def _pairs(names: tuple[str, str, str, str], quote: str, skip_cluster: bool = False) -> Column:
    cols = list(zip(names, ("cluster", "keyword", "value", "ts"), strict=True))[1 if skip_cluster else 0 :]
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"{quote}{n}{quote}: {quote}"), F.col(c), F.lit(quote)) for n, c in cols]), F.lit("}"))


def _outputs(s, d) -> DataFrame:
    """Raw outputs in eight shapes, by document: JSON lists, dictionaries, lists by cluster, whole and cut off, lines and fields."""
    f = made(s, d, A.FACTS)
    shape = F.col("hadm_id") % 8
    text = lambda head, each, glue, tail: F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", each.alias("t")))), lambda x: x["t"]), glue), F.lit(tail))
    field = lambda name, c: F.concat(F.lit(name), F.col(c))
    line = F.concat_ws("|", "cluster", "keyword", "value", "ts")
    told = F.concat_ws("\n", field("**CLUSTER:** ", "cluster"), field("Keyword: ", "keyword"), field("**Value:** ", "value"), F.when(F.col("pos") % 3 != 0, field("* Timestamp: ".removeprefix("* "), "ts")))
    flat = f.groupBy("hadm_id").agg(
        F.when(shape == 0, text("[", _pairs(("C", "K", "V", "T"), '"'), ", ", "]")).when(shape == 1, text("[", _pairs(("cluster", "keyword", "value", "timestamp"), "'"), ", ", "]"))
        .when(shape == 4, text("Facts:\n", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit('] - "'), line, F.lit('",')), "\n", "")).when(shape == 5, text("", F.concat(F.lit("CLUSTER|"), line), "\n", "\nEND"))
        .when(shape == 6, text("", told, "\n\n", "")).when(shape == 7, text("", F.concat(F.lit("«"), line, F.lit("»")), "\n", "")).alias("raw")
    )
    own = f.filter(shape.isin(2, 3)).groupBy("hadm_id", "cluster").agg(F.min("pos").alias("pos"), text("", _pairs(("C", "K", "V", "T"), '"', True), ", ", "").alias("t"))
    lists = own.select("hadm_id", "pos", F.concat(F.lit('"'), "cluster", F.lit('": ['), "t", F.lit("]")).alias("line"))
    grouped = joined(lists, "t").select("hadm_id", F.concat(F.lit("{"), F.replace("t", F.lit("\n"), F.lit(", ")), F.when(shape == 2, "}").otherwise(', "LABS": [{"K": "cut')).alias("raw"))
    return flat.filter("raw IS NOT NULL").unionByName(grouped)


@query(f"""SELECT DISTINCT hadm_id, concat_ws('|', cluster, keyword, value, CASE WHEN hadm_id % 8 = 6 AND pos % 3 = 0 THEN 'Unknown' ELSE ts END) AS line FROM ({A.FACTS}) f WHERE NOT (hadm_id % 8 IN (4, 5) AND contains(lower(keyword), 'any procedure'))""")
def raw_output_facts(s, d):
    """The same facts out of outputs of eight shapes."""
    return V.extract_facts(_outputs(s, d)).select("hadm_id", "line")


_HEADED = f"""SELECT hadm_id, pos, CASE WHEN pos % 4 = 1 THEN concat('* **', cluster, ':**') WHEN pos % 9 = 3 THEN concat('{{"K":"', keyword, '","V":"1","T":"Past"}}') ELSE concat('- see {{"K":"', keyword, '","V":"', value, '","T":"', ts, '"}} ok') END AS line FROM ({A.FACTS}) f"""
_ANY_CLUSTER = "(?i)\\b(" + "|".join(C.CLUSTERS) + ")\\b"


@query(f"""WITH h AS (SELECT hadm_id, pos, cluster, keyword, value, ts, pos % 4 = 1 AS heading, pos % 9 = 3 AND pos % 4 <> 1 AS bare, line FROM ({A.FACTS}) f JOIN ({_HEADED}) l USING (hadm_id, pos)),
n AS (SELECT *, CASE WHEN heading THEN cluster WHEN NOT bare THEN nullif(upper(regexp_extract(line, '{_ANY_CLUSTER}', 1)), '') END AS named FROM h),
c AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY hadm_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cl FROM n)
SELECT hadm_id, row_number() OVER (PARTITION BY hadm_id ORDER BY pos)::INT AS n, concat_ws('|', cl, keyword, value, ts) AS line FROM c WHERE NOT heading AND NOT bare AND cl IS NOT NULL AND {X.within('lower(ts)', [t.lower() for t in C.TIMESTAMPS])}""")
def inline_items(s, d):
    return V.inline_facts(joined(made(s, d, _HEADED), "text")).select("hadm_id", "n", "line")


_CUT = f"""SELECT hadm_id, pos, concat('{{"cluster": "', cluster, '", "keyword": "', keyword, '", "value": "$', value, '", "timestamp": "', ts, '"}}') AS line FROM ({A.FACTS}) f WHERE hadm_id % 2 = 0 UNION ALL SELECT hadm_id, pos, concat('note ', keyword) FROM ({A.FACTS}) f WHERE hadm_id % 2 = 1"""


@query(f"SELECT DISTINCT hadm_id, concat_ws('|', cluster, keyword, '$' || value, ts) AS line FROM ({A.FACTS}) f WHERE hadm_id % 2 = 0")
def json_mode_output(s, d):
    """Cut-off JSON in the mode of objects; documents without a fact give nothing."""
    x = joined(made(s, d, _CUT)).withColumn("raw", F.when(F.col("hadm_id") % 2 == 0, F.concat(F.lit('{"facts": ['), F.replace("raw", F.lit("\n"), F.lit(", ")), F.lit(', {"cluster": "L'))).otherwise(F.col("raw")))
    return V.json_mode_facts(x).select("hadm_id", "line").distinct()


_HEADER4 = "list_transform(p, lambda x: trim(trim(x), '«»\"'''))"
_RE_GUESS = Q._GUESS
_REEXTRACTED = f"""SELECT hadm_id, min(pos) AS pos, line FROM (
SELECT hadm_id, pos, recovered AS line, list_transform(string_split(trim(recovered), '|'), lambda x: trim(x)) AS p FROM (
SELECT hadm_id, pos, CASE WHEN len(p) = 5 THEN CASE WHEN upper(p[1]) IN ('CLUSTER', 'CLUSTERS') THEN concat_ws('|', p[2], p[3], p[4], p[5]) END
  WHEN len(p) = 4 THEN CASE WHEN upper(p[1]) IN ('CLUSTER', 'CLUSTERS') THEN CASE WHEN NOT (lower(p[2]) = 'keyword' AND lower(p[3]) = 'value') AND {_RE_GUESS} IS NOT NULL THEN concat_ws('|', {_RE_GUESS}, p[2], p[3], p[4]) END ELSE array_to_string(p, '|') END
  WHEN len(p) = 3 THEN array_to_string(p, '|') END AS recovered
FROM (SELECT hadm_id, pos, {_HEADER4} AS p FROM (SELECT hadm_id, pos, string_split(regexp_replace(trim(line), '^[-*•]\\s+', ''), '|') AS p FROM ({A.LINES}) l0) l1) l2) l3 WHERE recovered IS NOT NULL) l4
WHERE length(trim(line)) BETWEEN 5 AND 400 AND len(p) IN (3, 4) AND len(list_filter(p, lambda x: x = '')) = 0
  AND lower(array_to_string(p, '|')) NOT IN ('k|v|t', 'category|keyword|value|timestamp')
  AND NOT (contains(lower(p[2]), 'any diagnosis') OR contains(lower(p[2]), 'any symptom') OR contains(lower(p[2]), 'any procedure') OR contains(lower(p[2]), 'value:')) AND NOT (contains(p[2], '(') AND contains(p[2], ')'))
  AND length(p[1]) <= 80 AND length(p[2]) <= 80 AND length(p[3]) <= 200 AND coalesce(length(p[4]), 0) <= 40
  AND len(string_split_regex(p[1], '\\s+')) <= 8 AND len(string_split_regex(p[2], '\\s+')) <= 8 AND len(string_split_regex(p[3], '\\s+')) <= 14 AND coalesce(len(string_split_regex(p[4], '\\s+')), 0) <= 4
GROUP BY hadm_id, line"""


@query(f"WITH {X.sanitized(_REEXTRACTED, 'all')} SELECT DISTINCT hadm_id, cluster, keyword, value, ts FROM clean")
def reextract_sanitize(s, d):
    """Raw outputs go through the extractor again, and what it finds is sanitized."""
    again = V.extract_facts(joined(Q.lines(s, d)))
    return S.sanitize(again, "all").select("hadm_id", "cluster", "keyword", "value", "ts").distinct()


# --- notes -------------------------------------------------------------------------------------------

#: Numbers of each document, from its facts.
_CLINIC = f"SELECT hadm_id, hadm_id % 4 AS kind, 50 + max(q) AS hr, 90 + max(p) % 70 AS sbp, 50 + max(s) % 40 AS dbp, 12 + min(q) % 12 AS rr, 90 + min(p) % 10 AS ox, 96 + min(s) % 6 AS t, 3 + count(*) % 15 AS w, 7 + max(s) % 8 AS h, 70 + max(p) % 200 AS g, 8 + max(q) % 40 AS b, count(*) % 9 AS c FROM ({A.FACTS}) f GROUP BY hadm_id"
_SEEN = {
    0: ["'Seen today.'", "''", "'VITALS:'", "concat('  T ', t, '.5 HR ', hr)", "concat('BP ', sbp, '/', dbp)", "'no digits'", "concat('RR ', rr, ', SaO2 ', ox)", "concat('WBC-', w, '.3* HGB-', h, '.8*')", "'Losartan Potassium 100 mg PO'"],
    1: ["concat('exam: ', sbp, '/', dbp, ' ', hr, ' ', rr, ' ', t, ' ', ox, '% RA')", "concat('Na: ', g, ', K: ', c, '.1')", "concat('GLUCOSE-', g, '  UREA N-', b, ' CREAT-1.', c)"],
    2: ["concat('Vitals: ', t, '.4 ', hr, ' ', sbp, '/', dbp, ' ', rr, ' ', ox)", "concat('___ | URINE WBC-', w, ' RBC-2')"],
    3: ["'nothing here'"],
}
_NOTE = f"SELECT x.*, CASE kind {' '.join(f'WHEN {k} THEN concat_ws(chr(10), {", ".join(parts)})' for k, parts in _SEEN.items())} END AS text FROM ({_CLINIC}) x"
_VITAL_LINES = "CASE kind WHEN 0 THEN concat('VITALS:', chr(10), 'T ', t, '.5 HR ', hr, chr(10), 'BP ', sbp, '/', dbp) WHEN 1 THEN concat('exam: ', sbp, '/', dbp, ' ', hr, ' ', rr, ' ', t, ' ', ox, '% RA') WHEN 2 THEN concat('Vitals: ', t, '.4 ', hr, ' ', sbp, '/', dbp, ' ', rr, ' ', ox, chr(10), 'not stated URINE WBC-', w, ' RBC-2') ELSE '' END"
_LAB_LINES = "CASE kind WHEN 0 THEN concat('WBC-', w, '.3* HGB-', h, '.8*') WHEN 1 THEN concat('GLUCOSE-', g, ' UREA N-', b, ' CREAT-1.', c) WHEN 2 THEN concat('not stated URINE WBC-', w, ' RBC-2') ELSE '' END"


def _evidence(s, d) -> DataFrame:
    return O.objective_lines(made(s, d, _NOTE))


@query(f"SELECT hadm_id, replace({_VITAL_LINES}, 'not stated URINE', 'URINE') AS vitals, replace({_LAB_LINES}, 'not stated URINE', 'URINE') AS labs FROM ({_CLINIC}) x")
def objective_evidence(s, d):
    return _evidence(s, d).select("hadm_id", F.array_join("vitals", "\n").alias("vitals"), F.array_join("labs", "\n").alias("labs"))


@query(f"""WITH v AS (SELECT hadm_id, replace({_VITAL_LINES}, 'not stated URINE', 'URINE') AS v, replace({_LAB_LINES}, 'not stated URINE', 'URINE') AS l FROM ({_CLINIC}) x)
SELECT hadm_id, CASE WHEN v = '' AND l = '' THEN '' ELSE concat_ws(chr(10), 'OBJECTIVE EVIDENCE EXCERPT (verbatim):', CASE WHEN v <> '' THEN 'VITALS:' || chr(10) || v END, CASE WHEN l <> '' THEN 'LABS:' || chr(10) || l END) END AS appendix FROM v""")
def objective_appendix(s, d):
    return _evidence(s, d).select("hadm_id", O.appendix(F.col("vitals"), F.col("labs")).alias("appendix"))


_TOLD = {
    "temperature": "CASE kind WHEN 0 THEN concat(t, '.5') WHEN 1 THEN concat(t, '') WHEN 2 THEN concat(t, '.4') END", "heart_rate": "CASE WHEN kind < 3 THEN concat(hr, '') END", "systolic_bp": "CASE WHEN kind < 3 THEN concat(sbp, '') END",
    "diastolic_bp": "CASE WHEN kind < 3 THEN concat(dbp, '') END", "respiratory_rate": "CASE WHEN kind IN (1, 2) THEN concat(rr, '') END", "spo2": "CASE WHEN kind IN (1, 2) THEN concat(ox, '') END", "weight": "CAST(NULL AS VARCHAR)",
}


@query(f"SELECT hadm_id, {', '.join(f'{v} AS {k}' for k, v in _TOLD.items())} FROM ({_CLINIC}) x")
def vitals_from_lines(s, d):
    return _evidence(s, d).select("hadm_id", O.vital_values(F.col("vitals")).alias("v")).select("hadm_id", "v.*")


@query(f"""SELECT hadm_id, CASE kind WHEN 0 THEN concat(w, '.3') END AS wbc, CASE kind WHEN 0 THEN concat(h, '.8') END AS hemoglobin, NULL::VARCHAR AS hematocrit, NULL::VARCHAR AS platelet, NULL::VARCHAR AS sodium, NULL::VARCHAR AS potassium,
  CASE kind WHEN 1 THEN concat('1.', c) END AS creatinine, CASE kind WHEN 1 THEN concat(b, '') END AS bun, CASE kind WHEN 1 THEN concat(g, '') END AS glucose, NULL::VARCHAR AS bicarbonate FROM ({_CLINIC}) x""")
def labs_from_lines(s, d):
    return _evidence(s, d).select("hadm_id", O.lab_values(F.col("labs")).alias("v")).select("hadm_id", "v.*")


@query(f"SELECT hadm_id, CASE WHEN b % 2 = 0 THEN coalesce({_TOLD['heart_rate']}, 'Not stated') ELSE '77' END AS heart_rate, coalesce({_TOLD['spo2']}, 'not stated') AS spo2, concat(g, '') AS weight FROM ({_CLINIC}) x")
def fill_objective(s, d):
    """Values that a summary does not state, from the evidence of its note."""
    x = made(s, d, _NOTE)
    stated = F.create_map(F.lit("heart_rate"), F.when(F.col("b") % 2 == 0, "Not stated").otherwise("77"), F.lit("spo2"), F.lit("not stated"), F.lit("weight"), F.col("g").cast("string"))
    both = x.select("hadm_id", stated.alias("m")).join(O.objective_lines(x), "hadm_id")
    filled = both.select("hadm_id", O.fill_map(F.col("m"), O.vital_values(F.col("vitals")), O.VITALS).alias("m"))
    return filled.select("hadm_id", *[F.col("m")[n].alias(n) for n in ("heart_rate", "spo2", "weight")])


@query(f"WITH n AS (SELECT * FROM ({_CLINIC}) x) SELECT hadm_id, cluster, keyword, CASE WHEN value = 'not stated' AND kind = 0 AND cluster = 'VITALS' THEN CASE keyword WHEN 'Heart Rate' THEN hr::VARCHAR WHEN 'Respiratory Rate' THEN rr::VARCHAR ELSE value END ELSE value END AS value FROM n, LATERAL (VALUES ('VITALS', 'Heart Rate', CASE WHEN b % 2 = 0 THEN 'not stated' ELSE '77' END), ('VITALS', 'Respiratory Rate', 'not stated'), ('LABS', 'Glucose', g::VARCHAR)) AS u(cluster, keyword, value)")
def fill_from_note(s, d):
    """Facts without a value, filled with what the rules find in the note."""
    x = made(s, d, _NOTE)
    fact = lambda c, k, v: F.struct(F.lit(c).alias("cluster"), F.lit(k).alias("keyword"), v.alias("value"))
    stated = x.select("hadm_id", F.inline(F.array(fact("VITALS", "Heart Rate", F.when(F.col("b") % 2 == 0, "not stated").otherwise("77")), fact("VITALS", "Respiratory Rate", F.lit("not stated")), fact("LABS", "Glucose", F.col("g").cast("string")))))
    return T.fill_from_evidence(stated, T.extract(x)).select("hadm_id", "cluster", "keyword", "value")


@query(f"SELECT hadm_id, CASE kind WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'not stated' END AS sex, CASE WHEN kind = 2 THEN 'not stated' ELSE concat(hr, '') END AS age, concat(sbp, '') AS systolic, concat(dbp, '') AS diastolic, concat(h, '.5') AS weight, CASE WHEN kind = 3 THEN 'not stated' ELSE concat(ox, '') END AS spo2 FROM ({_CLINIC}) x")
def object_profiles(s, d):
    x = made(s, d, _CLINIC)
    pair = F.concat(F.col("sbp").cast("string"), F.lit("/"), F.col("dbp").cast("string"))
    weight = F.concat(F.col("g").cast("string"), F.lit(" lbs ("), F.col("h").cast("string"), F.lit(".5 kg)"))
    part = F.create_map(F.lit("systolic_bp"), pair, F.lit("diastolic_bp"), pair, F.lit("weight"), weight, F.lit("spo2"), F.when(F.col("kind") == 3, "low").otherwise(F.concat(F.col("ox").cast("string"), F.lit("% RA"))))
    sex = F.when(F.col("kind") == 0, "M").when(F.col("kind") == 1, " Female").otherwise("x")
    age = F.when(F.col("kind") == 2, "Not stated").otherwise(F.concat(F.col("hr").cast("string"), F.lit(" years")))
    both = x.select("hadm_id", O.demographics_object(sex, age).alias("d"), O.objective_object(part, "vitals").alias("m"))
    return both.select("hadm_id", "d.sex", "d.age", F.col("m")["systolic_bp"].alias("systolic"), F.col("m")["diastolic_bp"].alias("diastolic"), F.col("m")["weight"].alias("weight"), F.col("m")["spo2"].alias("spo2"))


@query(f"SELECT hadm_id, string_agg(replace(replace(concat(cluster, '|', value), '|', ' '), '___', 'not stated'), ';' ORDER BY pos) AS text, string_agg(CASE WHEN q % 3 <> 0 THEN replace(replace(concat(keyword, ' ', value, '|'), '|', ' '), '___', 'not stated') END, ';' ORDER BY pos) AS items FROM ({A.FACTS}) f GROUP BY hadm_id")
def clean_summary_values(s, d):
    f = made(s, d, A.FACTS)
    item = F.when(F.col("q") % 3 == 0, " \n ").otherwise(F.concat(F.lit(" "), "keyword", F.lit("\n"), "value", F.lit("|")))
    rows = f.groupBy("hadm_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("cluster", F.lit("|"), "value").alias("t"), item.alias("i")))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: O.clean_value(x["t"])), ";")
    return rows.select("hadm_id", text.alias("text"), F.nullif(F.array_join(O.clean_list(F.transform("_l", lambda x: x["i"])), ";"), F.lit("")).alias("items"))


# --- windows of long texts ---------------------------------------------------------------------------


def _windows_sql(text: str, terms: list[str], most: int, around: int, head: int, word: bool) -> str:
    """The windows of ``documents`` as SQL: places of each term from the lengths between them, spans joined where they touch."""
    pattern = lambda t: f"(?i)\\b{t}\\b" if word else f"(?i){t}"
    places = " UNION ALL ".join(f"SELECT doc_id, {len(t)} AS n, list_transform(string_split_regex(text, '{pattern(t)}'), lambda x: length(x)) AS g FROM big" for t in terms)
    return f"""
doc AS (SELECT doc_id, {text} AS text FROM documents), big AS (SELECT * FROM doc WHERE length(text) > {most}),
gap AS (SELECT doc_id, n, g, unnest(range(1, len(g))) AS i FROM ({places}) z),
place AS (SELECT gap.doc_id, list_sum(g[1:i]) + (i - 1) * n AS o, n, length(text) AS size FROM gap JOIN big USING (doc_id)),
span AS (SELECT doc_id, greatest(o - {around}, 0) AS a, least(o + n + {around}, size) AS b FROM place),
edge AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM span),
isle AS (SELECT *, count(*) FILTER (upto IS NULL OR a > upto) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM edge),
whole AS (SELECT doc_id, k, min(a) AS a, max(b) AS b FROM isle GROUP BY doc_id, k),
spent AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM whole),
piece AS (SELECT doc_id, k, a, least(b, a + {most - head} - before) AS b FROM spent),
kept AS (SELECT doc_id, string_agg(substr(text, (a + 1)::BIGINT, (b - a)::BIGINT), chr(10) || chr(10) ORDER BY k) AS t FROM piece JOIN big USING (doc_id) WHERE b > a GROUP BY doc_id),
seen AS (SELECT DISTINCT doc_id FROM span)
SELECT doc.doc_id, CASE WHEN length(text) <= {most} OR text IS NULL THEN text WHEN seen.doc_id IS NULL THEN substr(text, (length(text) - {most}) // 2 + 1, {most}) ELSE concat_ws(chr(10) || chr(10), left(text, {head}), t) END AS trimmed FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN seen USING (doc_id)"""


_TERMS = ["the", "que", "und"]
_PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"


@query(f"WITH {_windows_sql('text', _TERMS, 400, 8, 60, False)}")
def note_windows(s, d):
    return T.trim_windows(read(s, d, "documents").select("doc_id", "text"), 400, _TERMS, around=8, head=60, key="doc_id")


@query(f"WITH {_windows_sql(_PLAIN, _TERMS, 500, 5, 40, True)}")
def keyword_windows(s, d):
    x = read(s, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))
    return T.trim_windows(x, 500, _TERMS, around=5, head=40, key="doc_id", whole_words=True)


# --- terms -------------------------------------------------------------------------------------------


@query(f"SELECT mode, name, count(*) AS n FROM (SELECT mode, CASE {' '.join(f'WHEN {X.within("replace(upper(mode), chr(45), chr(95))", ws)} THEN {X.lit(k)}' for k, ws in C.MODES.items())} ELSE '{C.DEFAULT_MODE}' END AS name FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'ccde-admission' WHEN 1 THEN 'Tabular' WHEN 2 THEN 'pydantic' WHEN 3 THEN o_orderpriority END AS mode FROM orders) o) m GROUP BY ALL")
def mode_names(s, d):
    x = made(s, d, "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'ccde-admission' WHEN 1 THEN 'Tabular' WHEN 2 THEN 'pydantic' WHEN 3 THEN o_orderpriority END AS mode FROM orders")
    return x.select("mode", CL.mode(F.col("mode")).alias("name")).groupBy("mode", "name").agg(F.count("*").alias("n"))


_HOSTED = f"SELECT hadm_id, pos, CASE pos % 7 WHEN 1 THEN '```' WHEN 2 THEN '# facts' WHEN 3 THEN concat('// ', {_F4}) WHEN 4 THEN concat('see ', keyword) ELSE concat_ws('|', lower(cluster), keyword, value, ts) END AS line FROM ({A.FACTS}) f"


@query(f"""WITH h AS ({_HOSTED}), l AS (SELECT *, starts_with(line, '```') OR starts_with(line, '#') AS fence, len(string_split(line, '|')) = 4 AND NOT (starts_with(line, '```') OR starts_with(line, '#') OR starts_with(line, '//')) AS fact FROM h),
c AS (SELECT hadm_id, upper(string_split(line, '|')[1]) AS cl, min(pos) AS o FROM l WHERE fact GROUP BY ALL), g AS (SELECT hadm_id, string_agg(cl, ',' ORDER BY o) AS cov FROM c GROUP BY hadm_id)
SELECT l.hadm_id, (count(*) FILTER (fact))::INT AS fact_count, coalesce(any_value(cov), '') AS cluster_coverage, round(coalesce(count(*) FILTER (fact) / nullif(count(*) FILTER (NOT fence), 0)::DOUBLE, 0), 6) AS format_validity FROM l LEFT JOIN g USING (hadm_id) GROUP BY l.hadm_id""")
def cloud_summary(s, d):
    return CL.summarize(joined(made(s, d, _HOSTED)))


_WORDS = ["Lasix", "s/p PCI", " F ", "CHF", "sob", "afib, new", "AMLO5", "metformin 500", "ct scan", "Room spinning", "dm ", "man"]
_TERM = f"SELECT DISTINCT term FROM (SELECT keyword AS term FROM ({A.FACTS}) f UNION ALL SELECT concat({A.pick('p_partkey', _WORDS)}, CASE WHEN p_size % 4 = 0 THEN '' ELSE concat(' ', p_size) END) AS term FROM part) t"
_MAPPED = lambda rules: "CASE " + " ".join(f"WHEN regexp_matches(lower(term), {X.lit(p)}) THEN {X.lit(v)}" for p, v in rules) + " END"


@query(f"""SELECT term, {_MAPPED(C.MEDICATION_RULES)} AS medication, {_MAPPED(C.PROCEDURE_RULES)} AS procedure, CASE WHEN lower(trim(term)) IN ('m', 'male', 'man') THEN 'male' WHEN lower(trim(term)) IN ('f', 'female', 'woman') THEN 'female' ELSE trim(term) END AS sex,
  {X.lookup('lower(trim(term))', Y.DIAGNOSES, 'trim(term)')} AS diagnosis, {X.lookup('lower(trim(term))', Y.SYMPTOMS, 'trim(term)')} AS symptom, coalesce({_MAPPED(C.PROBLEM_DISPLAY)}, term) AS display FROM ({_TERM}) x""")
def term_maps(s, d):
    t = F.col("term")
    rows = made(s, d, _TERM)
    return rows.select("term", Y.medication_pattern(t).alias("medication"), Y.procedure_pattern(t).alias("procedure"), Y.sex(t).alias("sex"), Y.diagnosis(t).alias("diagnosis"), Y.symptom(t).alias("symptom"), Y.problem_display(t).alias("display"))


_PAIR = f"SELECT DISTINCT a, b FROM (SELECT keyword AS a, {A.pick('q', ['CHF', 'heart failure', 'htn', 'Stroke', 'T2DM', 'x', 'TIA', 'Cva '])} AS b FROM ({A.FACTS}) f WHERE cluster = 'PROBLEMS') t"
_NAMED = lambda x: X.lookup(f"lower(trim({x}))", Y.DIAGNOSES, f"trim({x})")


@query(f"SELECT a, b, lower({_NAMED('a')}) = lower({_NAMED('b')}) AS same FROM ({_PAIR}) x")
def terms_same(s, d):
    return made(s, d, _PAIR).select("a", "b", Y.terms_match(F.col("a"), F.col("b")).alias("same"))


_SYMPTOM_WORDS = [x for _, _, ws in C.SYMPTOM_GROUPS for x in ws[::3]]
_SYMPTOM = f"SELECT DISTINCT concat({A.pick('p_partkey', _SYMPTOM_WORDS)}, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN concat(' ', p_size) WHEN 2 THEN '/fever' WHEN 3 THEN 'x' ELSE ' (new)' END) AS keyword FROM part"


@query(f"WITH k AS ({_SYMPTOM}), m AS ({Q._match('SELECT keyword FROM k', C.SYMPTOM_GROUPS)}) SELECT k.keyword, m.gid FROM k LEFT JOIN m USING (keyword)")
def symptom_groups(s, d):
    return R.with_groups(made(s, d, _SYMPTOM).withColumn("cluster", F.lit("SYMPTOMS"))).select("keyword", "gid")


_STATUS = f"SELECT DISTINCT value FROM (SELECT value FROM ({A.FACTS}) f WHERE cluster = 'DISPOSITION' UNION ALL SELECT {A.pick('o_orderkey', ['A&O', 'Alert and oriented x3', 'A/Ox4', 'confused ', 'alert', 'ao', 'Oriented'])} FROM orders) x"


@query(f"SELECT value, CASE WHEN contains(lower(value), 'alert') AND contains(lower(value), 'orient') OR {X.within('lower(trim(value))', C.ALERT_VARIANTS)} THEN 'alert' ELSE trim(value) END AS status FROM ({_STATUS}) x")
def mental_status_variants(s, d):
    return made(s, d, _STATUS).select("value", R.mental_status(F.col("value")).alias("status"))


# --- contracts ---------------------------------------------------------------------------------------

_VALID = f"{X.within('cluster', C.CLUSTERS)} AND ({X.within('ts', C.TIMESTAMPS)} OR regexp_full_match(ts, '[0-9]{{8}}')) AND (cluster NOT IN ('VITALS', 'LABS') OR regexp_full_match(value, '-?[0-9]+(?:\\.[0-9]+)?'))"
_TOLD_LINE = "CASE q % 6 WHEN 0 THEN concat('s/p CABG ', q) WHEN 1 THEN 'Surgery=no' WHEN 2 THEN concat('laparoscopic ', keyword) WHEN 3 THEN concat('declined surgery of ', keyword) WHEN 4 THEN concat(keyword, '=', value) ELSE keyword END"
_CONTRACT = f"""SELECT hadm_id, pos, {_TOLD_LINE} AS line, concat('{{"A":', q, CASE WHEN q % 2 = 0 THEN ',"B":2' ELSE '' END, CASE WHEN q % 7 = 0 THEN '' ELSE '}}' END) AS json, CASE WHEN q % 9 = 0 THEN 'Odd' ELSE cluster END AS cluster, CASE WHEN q % 11 = 0 THEN concat('202401', 10 + q) ELSE ts END AS ts, value FROM ({A.FACTS}) f"""
_SURGERY = f"regexp_matches(line, '(?i)({G1.SURGERY}|\\bs/p\\b|\\bcabg\\b|laparoscopic)') AND NOT regexp_matches(line, '(?i)^\\s*(surgery|any procedure)\\s*=\\s*(no|0|0\\.0|false|not stated)\\s*$') AND NOT regexp_matches(line, '(?i)\\b(without surgery|no surgery|denies surgery|declined surgery)\\b')"


@query(f"""SELECT hadm_id, pos, {_SURGERY} AS surgery, contains(json, '"B"') AND ends_with(json, '}}') AS keys, {_VALID} AS valid FROM ({_CONTRACT}) x""")
def contracts(s, d):
    x = made(s, d, _CONTRACT)
    return x.select("hadm_id", "pos", G1.surgery_evidence(F.col("line")).alias("surgery"), G1.has_keys(F.col("json"), ["A", "B"]).alias("keys"), G1.valid_fact(F.col("cluster"), F.col("ts"), F.col("value")).alias("valid"))


@query(f"""WITH l AS (SELECT hadm_id, pos, list_transform(string_split(trim(line), '|'), lambda x: trim(x)) AS p FROM ({A.LINES}) z WHERE trim(line) <> ''), f AS (SELECT hadm_id, pos, p[1] AS cluster, p[2] AS keyword, p[3] AS value, p[4] AS ts FROM l WHERE len(p) = 4) SELECT * FROM f WHERE {_VALID}""")
def strict_contract(s, d):
    return G1.strict_facts(Q.lines(s, d))


_SECTION = "CASE q % 7 WHEN 0 THEN 'Dialysis=started' WHEN 1 THEN 'Dialysis=no' WHEN 2 THEN 'Surgery=no' WHEN 3 THEN 'Mechanical Ventilation=Not stated' WHEN 4 THEN 'plain' WHEN 5 THEN concat('was ', keyword) ELSE 'Any Procedure=no' END"
_PROCEDURE = f"SELECT hadm_id, pos, {_SECTION} AS line FROM ({A.FACTS}) f WHERE pos % 5 = 0"
_TELLS = f"({_SURGERY} OR regexp_matches(line, '(?i)({G1.DIALYSIS}|{G1.VENTILATION})') AND NOT (contains(line, '=') AND {X.within("lower(trim(regexp_replace(line, '^[^=]*=', '')))", [*C.TEXT_PLACEHOLDERS, 'no', '0', '0.0', 'false'])}))"


@query(f"SELECT hadm_id, bool_or({_TELLS}) AS evidence FROM ({_PROCEDURE}) x GROUP BY hadm_id")
def any_procedure_evidence(s, d):
    x = joined(made(s, d, _PROCEDURE), "section")
    return x.select("hadm_id", G1.procedure_evidence(F.split("section", "\n")).alias("evidence"))


_CHECKED = f"""SELECT hadm_id, string_agg(concat('ADM: ', keyword, '=', value, '; SpO2=not stated'), chr(10) ORDER BY pos) FILTER (cluster = 'VITALS') AS vitals, string_agg(concat(keyword, '=', value), ';' ORDER BY pos) FILTER (cluster = 'LABS') AS labs,
  string_agg(concat(keyword, '= ', value), chr(10) ORDER BY pos) FILTER (cluster = 'DISPOSITION') AS disposition, string_agg(keyword, chr(10) ORDER BY pos) AS lines FROM ({A.FACTS}) f GROUP BY hadm_id"""
_FINE = lambda c: f"coalesce(bool_and(regexp_full_match(lower(trim(value)), '-?[0-9]+(?:\\.[0-9]+)?|not stated')) FILTER (cluster = '{c}'), true) AND NOT coalesce(bool_or(contains(value, '%')) FILTER (cluster = '{c}'), false)"


@query(f"""SELECT hadm_id, {_FINE('VITALS')} AS vitals_ok, {_FINE('LABS')} AS labs_ok, coalesce(arg_min(lower(trim(value)), pos) FILTER (cluster = 'DISPOSITION' AND keyword = 'Mental Status'), '') AS mental, count(*)::INT AS total, count(DISTINCT keyword)::INT AS different FROM ({A.FACTS}) f GROUP BY hadm_id""")
def gate_checks(s, d):
    f = made(s, d, A.FACTS)
    of = lambda c, head, tail, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cluster") == c, F.struct("pos", F.concat(F.lit(head), "keyword", F.lit("="), "value", F.lit(tail)).alias("t"))))), lambda x: x["t"]), glue)
    rows = f.groupBy("hadm_id").agg(of("VITALS", "ADM: ", "; SpO2=not stated", "\n").alias("vitals"), of("LABS", "", "", ";").alias("labs"), of("DISPOSITION", "", "", "\n").alias("disposition"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda x: x["keyword"]).alias("lines"))
    counts = G.repeat_counts(F.col("lines"))
    return rows.select("hadm_id", G.measured_ok(F.col("vitals"), True).alias("vitals_ok"), G.measured_ok(F.col("labs"), False).alias("labs_ok"), G.told_mental_status(F.col("disposition")).alias("mental"), counts["total"].alias("total"), counts["different"].alias("different"))


# --- summaries and factors ---------------------------------------------------------------------------


_SECTIONED = f"SELECT hadm_id, cluster, pos, CASE WHEN cluster IN ('VITALS', 'LABS') THEN concat(CASE q % 3 WHEN 0 THEN 'ADM: ' WHEN 1 THEN 'DC: ' ELSE '' END, keyword, '=', q, '; ', keyword, '=not stated') ELSE concat(keyword, '=', value) END AS line FROM ({A.FACTS}) f"
_KNOWN = " OR ".join(f"(cluster = '{c}' AND {X.within('keyword', C.STRICT_KEYWORDS[c])})" for c in C.OBJECTIVE_CLUSTERS)


@query(f"""WITH l AS (SELECT hadm_id, cluster, row_number() OVER (PARTITION BY hadm_id, cluster ORDER BY pos) - 1 AS n, trim(line) AS line FROM ({_SECTIONED}) x),
t AS (SELECT *, CASE WHEN starts_with(line, 'ADM:') THEN 'Admission' WHEN starts_with(line, 'DC:') THEN 'Discharge' WHEN cluster = 'DISPOSITION' THEN 'Discharge' WHEN cluster = 'UTILIZATION' THEN 'Past' ELSE 'Admission' END AS ts, string_split(regexp_replace(line, '^(ADM|DC):', ''), ';') AS a FROM l),
u AS (SELECT hadm_id, cluster, n, ts, unnest(range(len(a))) AS m, unnest(a) AS x FROM t), k AS (SELECT *, trim(regexp_extract(x, '^([^=]*)=', 1)) AS keyword, trim(regexp_replace(x, '^[^=]*=', '')) AS value FROM u WHERE contains(x, '='))
SELECT hadm_id, n::BIGINT AS pos, m::INT AS sub_pos, cluster, keyword, value, ts FROM k WHERE ({_KNOWN}) AND lower(value) <> 'not stated' AND (NOT ({X.within('cluster', C.NUMERIC_CLUSTERS)} OR keyword = 'Age') OR regexp_full_match(value, '-?[0-9]+(?:\\.[0-9]+)?'))""")
def objective_fact_lines(s, d):
    """Facts in the sections of summaries."""
    rows = made(s, d, _SECTIONED)
    texts = rows.groupBy("hadm_id", F.col("cluster").alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return G1.objective_facts(texts).select("hadm_id", "pos", "sub_pos", "cluster", "keyword", "value", "ts")


_TYPED = f"SELECT hadm_id, max(q) AS hr, min(q) AS na, count(*) AS n FROM ({A.FACTS}) f GROUP BY hadm_id"
_PAIRS_OF = lambda keys, known: "concat_ws('; ', " + ", ".join(f"'{k}=' || {known.get(k, X.lit('not stated'))}" for k in keys) + ")"


@query(f"""WITH t AS ({_TYPED}), i AS (SELECT hadm_id, string_agg(k, ', ' ORDER BY pos) FILTER (cluster = 'PROBLEMS') AS pr, array_to_string((list(k ORDER BY pos) FILTER (cluster = 'SYMPTOMS'))[1:3], ', ') AS sy FROM (
  SELECT * FROM (SELECT hadm_id, cluster, keyword AS k, min(pos) AS pos FROM ({A.FACTS}) f WHERE cluster IN ('PROBLEMS', 'SYMPTOMS') GROUP BY hadm_id, cluster, keyword) w QUALIFY row_number() OVER (PARTITION BY hadm_id, cluster, trim(regexp_replace(lower(k), '[^a-z0-9]+', ' ', 'g')) ORDER BY pos) = 1) g GROUP BY hadm_id),
r AS (SELECT hadm_id, unnest(['## DEMOGRAPHICS', 'Sex=' || CASE WHEN n % 2 = 0 THEN 'male' ELSE 'not stated' END, 'Age=' || (40 + n % 50), '## VITALS', 'ADM: ' || {_PAIRS_OF(C.STRICT_KEYWORDS['VITALS'], {'Heart Rate': 'hr'})}, '## LABS', 'ADM: ' || {_PAIRS_OF(C.STRICT_KEYWORDS['LABS'], {'Sodium': 'na'})},
  '## PROBLEMS', 'PMH/Comorbidities=' || coalesce(nullif(pr, ''), 'not stated'), 'Discharge Dx=not stated', 'Complications=not stated', 'Working Dx=not stated', '## SYMPTOMS', 'ADM symptoms=' || coalesce(nullif(sy, ''), 'not stated'), 'DC symptoms=not stated']) AS line, unnest(range(15))::INT AS pos FROM t LEFT JOIN i USING (hadm_id)) SELECT hadm_id, pos, line FROM r""")
def typed_summaries(s, d):
    """Typed summaries as Markdown: problems without repetitions, at most three symptoms."""
    t = made(s, d, _TYPED)
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("cluster") == c, F.struct("pos", F.concat(F.lit(" ["), "keyword", F.lit("], ")).alias("k"))))), lambda x: x["k"])
    lists = made(s, d, A.FACTS).groupBy("hadm_id").agg(of("PROBLEMS").alias("pmh"), of("SYMPTOMS").alias("adm_symptoms"))
    none = F.array().cast("array<string>")
    obj = t.join(lists, "hadm_id").select(
        "hadm_id", F.when(F.col("n") % 2 == 0, "male").alias("sex"), (40 + F.col("n") % 50).cast("string").alias("age"), F.create_map(F.lit("Heart Rate"), F.col("hr").cast("string"), F.lit("Odd"), F.lit("1")).alias("vitals"), F.create_map(F.lit("Sodium"), F.col("na").cast("string")).alias("labs"),
        "pmh", none.alias("discharge_dx"), none.alias("complications"), none.alias("working_dx"), "adm_symptoms", none.alias("dc_symptoms"),
    )
    return M.domain_markdown(obj).select("hadm_id", "pos", "line")


_ORDER = "list_position([" + ", ".join(X.lit(c) for c in C.CLUSTERS) + "], cluster)"


@query(f"""WITH {Q._PATTERNS}, f AS (SELECT hadm_id, string_agg(concat(keyword, '=', value, ' (+', pts, ')'), ';' ORDER BY {_ORDER}, pos, sub_pos) AS t FROM lv WHERE pts > 0 GROUP BY hadm_id),
o(pattern, n) AS (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(R.BONUS))}), b AS (SELECT hadm_id, string_agg(concat('[PATTERN] ', pattern, ' (+', bonus, ')'), ';' ORDER BY n) AS t FROM ph JOIN o USING (pattern) GROUP BY hadm_id),
h AS (SELECT hadm_id, list(DISTINCT cluster) FILTER (NOT dropped) AS have FROM rf GROUP BY hadm_id), z AS (SELECT hadm_id, list(cluster) AS zero FROM cs WHERE score = 0 GROUP BY hadm_id)
SELECT h.hadm_id, concat_ws(';', f.t, b.t) AS risk_factors, array_to_string(string_split(concat_ws(';', f.t, b.t), ';')[1:6], ';') AS top_factors,
  concat_ws(';', {', '.join(f"CASE WHEN list_contains(have, '{c}') AND list_contains(zero, '{c}') THEN '{t}' END" for c, t in (('VITALS', 'Normal vitals at discharge'), ('LABS', 'Normal labs at discharge'), ('DISPOSITION', 'Stable disposition (Home, alert)')))}) AS protective_factors
FROM h LEFT JOIN f USING (hadm_id) LEFT JOIN b USING (hadm_id) LEFT JOIN z USING (hadm_id)""")
def risk_factors(s, d):
    """What adds to each score, and what is in order."""
    return R.factors(Q.scored(s, d)).select("hadm_id", *[F.array_join(c, ";").alias(c) for c in ("risk_factors", "top_factors", "protective_factors")])


# --- displays, runs compared, and the whole way ------------------------------------------------------

_SHOWN = f"""SELECT hadm_id, pos, CASE hadm_id % 3 WHEN 0 THEN concat('{{"Cluster": "', cluster, '", "key": "', keyword, '", "VALUE": "', value, '", "time": "', ts, '"}}') WHEN 1 THEN {_F4} ELSE concat('{{"cluster": "', cluster, '", "Keyword": "', keyword, '"}}') END AS line FROM ({A.FACTS}) f WHERE hadm_id % 3 < 2 OR pos = 1"""


@query(f"""WITH l AS ({_SHOWN}) SELECT hadm_id, (row_number() OVER (PARTITION BY hadm_id ORDER BY pos) - 1)::INT AS pos, CASE hadm_id % 3 WHEN 0 THEN regexp_replace({_F4}, '(?i)(start|end)\\s*', '', 'g') WHEN 1 THEN line ELSE concat(cluster, '|', keyword, '||') END AS row FROM l JOIN ({A.FACTS}) f USING (hadm_id, pos)""")
def display_rows(s, d):
    """Outputs as a display shows them: lists in fences, lines, single objects."""
    x = joined(made(s, d, _SHOWN))
    fenced = F.concat(F.lit("Result\n```json\n["), F.replace("raw", F.lit("\n"), F.lit(",\n")), F.lit("]\n```\nbye"))
    return CL.display_rows(x.withColumn("raw", F.when(F.col("hadm_id") % 3 == 0, fenced).when(F.col("hadm_id") % 3 == 2, F.concat(F.lit("START\n"), "raw", F.lit("\nEND"))).otherwise(F.col("raw"))))


_RUN_A = "SELECT o_orderkey AS hadm_id, o_orderpriority AS t, o_custkey AS c FROM orders"


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0), o AS (SELECT o_orderkey AS k FROM orders),
n AS (SELECT k, unnest(['stage2_raw', 'stage2_normalized']) AS kind, k % 5 <> 0 AS in_a, k % 7 <> 0 AS in_b FROM o)
SELECT k AS hadm_id, kind, CASE WHEN in_a AND in_b THEN CASE kind WHEN 'stage2_raw' THEN 'content_diff' ELSE 'json_semantic_diff' END ELSE 'missing_file' END AS note FROM n WHERE (in_a OR in_b) AND (NOT in_a OR NOT in_b OR kind = 'stage2_raw' AND k % 3 = 0 OR kind = 'stage2_normalized' AND k % 4 = 0)""")
def runs_compared(s, d):
    """Artifacts of two runs: texts, and objects that count by what they mean, whatever the order of their keys."""
    o = made(s, d, _RUN_A)
    obj = lambda c, swap: F.concat(F.lit('{"url": "'), F.lit(str(swap)), F.lit('", '), *([F.lit('"format_stats": {"b": 1, "a": 2}, "normalized": ['), c, F.lit("]}")] if swap else [F.lit('"normalized": ['), c, F.lit('], "format_stats": {"a": 2, "b": 1}}')]))
    one = lambda rows, text, c, swap: rows.select("hadm_id", F.inline(F.array(F.struct(F.lit("stage2_raw").alias("kind"), text.alias("text")), F.struct(F.lit("stage2_normalized").alias("kind"), obj(c, swap).alias("text")))))
    number = F.col("c").cast("string")
    a = one(o.filter("hadm_id % 5 <> 0"), F.col("t"), number, 0)
    b = one(o.filter("hadm_id % 7 <> 0"), F.when(F.col("hadm_id") % 3 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t")), F.when(F.col("hadm_id") % 4 == 0, F.concat(number, F.lit(", 1"))).otherwise(number), 1)
    meta = s.range(1).select(*[F.lit(k).alias(k) for k in G.RUN_KEYS])
    return G.ab_record(a, b, o, meta, meta, ["stage2_normalized"])[0].select("hadm_id", "kind", "note")


def _half_client():
    """A stand-in for a server that fails on every third note."""
    import re

    def answer(prompt: str, form: str | None) -> str:
        age = int(re.search(r"is a (\d+) year", prompt)[1])
        if age % 3 == 0:
            raise RuntimeError("down")
        return f"DEMOGRAPHICS|Age|{age}|Admission\nLABS|Sodium|{100 + age}|Discharge"

    return answer


_AGE = "(20 + hadm_id % 75)"


@query(f"""WITH nt AS ({Q.NOTES_SQL}), f AS ({Q._NOTE_FACTS}), lines_ AS (SELECT hadm_id, pos, concat_ws('|', cluster, keyword, value, ts) AS line FROM f WHERE {_AGE} % 3 = 0 AND NOT contains(lower(keyword), 'any procedure') UNION ALL SELECT hadm_id, 1, concat('DEMOGRAPHICS|Age|', {_AGE}, '|Admission') FROM nt WHERE {_AGE} % 3 <> 0 UNION ALL SELECT hadm_id, 2, concat('LABS|Sodium|', 100 + {_AGE}, '|Discharge') FROM nt WHERE {_AGE} % 3 <> 0),
{X.normalized("SELECT * FROM lines_")} SELECT hadm_id, cluster, keyword, value, ts FROM best""")
def analysed_notes(s, d):
    """Notes through a client that fails on some, which then go through the rules."""
    from ..operators import service

    return service.analyse(Q._notes(s, d), _half_client).facts.select("hadm_id", "cluster", "keyword", "value", "ts")
