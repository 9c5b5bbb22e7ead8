"""All queries over the relational tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import line
from ..operators import backends as B
from ..operators import cloud as CL
from ..operators import evaluate as E
from ..operators import gates as G
from ..operators import markdown as M
from ..operators import normalize as N
from ..operators import recover as V
from ..operators import notes as T
from ..operators import risk as R
from ..operators import sanitize as S
from ..operators import stage1 as G1
from ..operators import synonyms as Y
from ..sources import adapter as A
from ..streaming import progress as P
from . import sqltext as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FACT = ["hadm_id", "pos", "sub_pos", "cluster", "keyword", "value", "ts"]
COLS = ", ".join(FACT)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def lines(s, d):
    return A.from_sql(s, d, A.LINES)


def read(s, d, t):
    return A.table(s, d, t)


# --- parsing ---------------------------------------------------------------------------------------


@query(f"WITH {Q.parsed(A.LINES)} SELECT hadm_id, pos, c AS cluster, k AS keyword, v AS value, t AS ts FROM parsed WHERE c IS NOT NULL")
def kvt_parse(s, d):
    return N.parse_lines(lines(s, d)).filter("cluster IS NOT NULL")


@query(f"WITH lines AS ({A.LINES}) SELECT hadm_id, count(*) AS n_lines, count(*) FILTER (len(string_split(line, '|')) = 4 AND len(list_filter(string_split(line, '|'), lambda x: trim(x) = '')) = 0) AS n_valid FROM lines GROUP BY hadm_id")
def kvt_valid(s, d):
    return lines(s, d).groupBy("hadm_id").agg(F.count("*").alias("n_lines"), F.count_if(S.valid_line(F.col("line"))).alias("n_valid"))


_GUESS = f"coalesce({Q.lookup('p[2]', C.KEYWORD_CLUSTER)}, CASE WHEN lower(p[3]) IN ('acute', 'chronic', 'exist', 'not exist') THEN 'PROBLEMS' WHEN lower(p[3]) IN ('yes', 'no', 'severe') THEN 'SYMPTOMS' END)"


@query(f"""
WITH lines AS ({A.LINES}), s AS (SELECT hadm_id, pos, list_transform(string_split(line, '|'), lambda x: trim(trim(x), '«»"''')) AS p FROM lines),
r AS (SELECT hadm_id, pos, CASE WHEN len(p) = 5 THEN CASE WHEN upper(p[1]) IN ('CLUSTER', 'CLUSTERS') THEN concat_ws('|', p[2], p[3], p[4], p[5]) END
  WHEN len(p) = 4 THEN CASE WHEN upper(p[1]) IN ('CLUSTER', 'CLUSTERS') THEN CASE WHEN NOT (lower(p[2]) = 'keyword' AND lower(p[3]) = 'value') AND {_GUESS} IS NOT NULL THEN concat_ws('|', {_GUESS}, p[2], p[3], p[4]) END ELSE array_to_string(p, '|') END
  WHEN len(p) = 3 THEN array_to_string(p, '|') END AS recovered FROM s)
SELECT * FROM r WHERE recovered IS NOT NULL""")
def kvt_drift_recover(s, d):
    return lines(s, d).select("hadm_id", "pos", S.recovered_line(F.col("line")).alias("recovered")).filter("recovered IS NOT NULL")


_LOW = "list_transform(p, lambda x: lower(x))"


@query(f"""
WITH lines AS ({A.LINES}), s AS (SELECT hadm_id, pos, trim(line) AS l, list_transform(string_split(trim(line), '|'), lambda x: trim(x)) AS p FROM lines),
t AS (SELECT *, len(p) AS n, {_LOW} AS w FROM s)
SELECT hadm_id, count(*) AS n_candidates FROM t WHERE length(l) BETWEEN 5 AND 400 AND n IN (3, 4) AND len(list_filter(p, lambda x: x = '')) = 0
  AND array_to_string(w, '|') NOT IN ('k|v|t', 'category|keyword|value|timestamp') AND NOT (n = 4 AND starts_with(w[1], 'category') AND w[2] = 'keyword' AND w[3] = 'value' AND starts_with(w[4], 'timestamp'))
  AND NOT (contains(w[1], 'format') AND w[2] = 'keyword' AND w[3] = 'value') AND NOT ((starts_with(w[1], 'format') OR starts_with(w[1], 'output format')) AND contains(w[n], 'timestamp'))
  AND NOT (contains(w[2], 'any diagnosis') OR contains(w[2], 'any symptom') OR contains(w[2], 'any procedure') OR contains(w[2], 'value:')) AND NOT (contains(p[2], '(') AND contains(p[2], ')'))
  AND length(p[1]) <= 80 AND length(p[2]) <= 80 AND length(p[3]) <= 200 AND coalesce(length(p[4]), 0) <= 40
  AND len(string_split_regex(p[1], '\\s+')) <= 8 AND len(string_split_regex(p[2], '\\s+')) <= 8 AND len(string_split_regex(p[3], '\\s+')) <= 14 AND coalesce(len(string_split_regex(p[4], '\\s+')), 0) <= 4
GROUP BY hadm_id""")
def kvt_candidates(s, d):
    return lines(s, d).filter(S.looks_like_fact(F.col("line"))).groupBy("hadm_id").agg(F.count("*").alias("n_candidates"))


def _objects(s, d, head: str, tail: str):
    """One text of fact objects per document."""
    f = A.from_sql(s, d, A.FACTS)
    one = F.concat(*[x for k, c in (("cluster", "cluster"), ("keyword", "keyword"), ("value", "value"), ("timestamp", "ts")) for x in (F.lit(f'{"{" if k == "cluster" else ","}"{k}":"'), F.col(c), F.lit('"'))], F.lit("}"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))), lambda x: x["t"]), ",")
    return f.groupBy("hadm_id").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("raw"))


_OBJECTS = f"WITH f AS ({A.FACTS}) SELECT DISTINCT hadm_id, concat_ws('|', cluster, keyword, value, ts) AS line FROM f"


@query(_OBJECTS)
def json_recover(s, d):
    return V.extract_facts(_objects(s, d, '{"facts":[', "]}"), literals=False).select("hadm_id", "line")


@query(_OBJECTS)
def broken_json_recover(s, d):
    return V.salvaged_facts(_objects(s, d, '{"facts":[', ',{"cluster":"LA').withColumnRenamed("raw", "text")).select("hadm_id", "line").distinct()


@query(f"WITH f AS ({A.FACTS}), g AS (SELECT {Q.lookup('keyword', C.KEYWORD_CLUSTER)} AS inferred, coalesce({Q.lookup('lower(cluster)', C.CATEGORY_ALIASES)}, cluster) AS mapped FROM f) SELECT inferred, mapped, count(*) AS n FROM g GROUP BY ALL")
def cluster_infer(s, d):
    f = A.from_sql(s, d, A.FACTS)
    return f.select(N.infer_cluster(F.col("keyword")).alias("inferred"), N.category_to_cluster(F.col("cluster")).alias("mapped")).groupBy("inferred", "mapped").agg(F.count("*").alias("n"))


# --- normalization ---------------------------------------------------------------------------------


@query(f"WITH {Q.normalized(A.LINES)} SELECT {COLS} FROM best")
def normalize_facts(s, d):
    return N.normalize(lines(s, d)).select(*FACT)


@query(f"""
WITH {Q.normalized(A.LINES)},
arrived AS (SELECT *, min(r) OVER (PARTITION BY hadm_id, cluster, keyword ORDER BY pos, sub_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ranked),
lost AS (SELECT hadm_id, count(*) AS n FROM arrived WHERE prev IS NOT NULL AND r >= prev GROUP BY hadm_id),
strict AS (SELECT *, {Q.within('cluster', list(C.STRICT_KEYWORDS))} AS is_strict, cluster IN ('VITALS', 'LABS') AS m FROM best),
after AS (SELECT hadm_id, count(*) AS n, CASE WHEN count(*) FILTER (is_strict) > 0 THEN count(*) FILTER (is_strict AND {Q.strict_ok('cluster', 'keyword')}) * 1.0 / count(*) FILTER (is_strict) ELSE 1.0 END AS ck, CASE WHEN count(*) FILTER (m) > 0 THEN count(*) FILTER (m AND regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?')) * 1.0 / count(*) FILTER (m) ELSE 1.0 END AS nr FROM strict GROUP BY hadm_id)
SELECT j.hadm_id, count(*) AS input_lines, count(*) FILTER (status <> 'unparsed') AS parsed_kvt4, count(*) FILTER (status = 'placeholder') AS dropped_placeholders, count(*) FILTER (status = 'noncanonical') AS dropped_noncanonical, count(*) FILTER (status = 'disallowed') AS dropped_by_allowed_clusters,
  count(*) FILTER (status = 'expanded') AS expanded_bp, coalesce(any_value(lost.n), 0) AS dedup_dropped, coalesce(any_value(after.n), 0) AS output_lines, coalesce(any_value(ck), 1.0)::DOUBLE AS canonical_keyword_rate_strict, coalesce(any_value(nr), 1.0)::DOUBLE AS numeric_only_rate_vitals_labs, 0::BIGINT AS duplicates_after_dedup
FROM judged j LEFT JOIN lost ON lost.hadm_id = j.hadm_id LEFT JOIN after ON after.hadm_id = j.hadm_id GROUP BY j.hadm_id""")
def normalize_stats(s, d):
    return N.normalize_stats(lines(s, d))


@query(f"WITH {Q.normalized(A.LINES)} SELECT ts, cluster, count(*) AS n, count(DISTINCT hadm_id) AS n_docs FROM best GROUP BY ts, cluster")
def dedupe_priority(s, d):
    return N.normalize(lines(s, d)).groupBy("ts", "cluster").agg(F.count("*").alias("n"), F.count_distinct("hadm_id").alias("n_docs"))


@query(f"""WITH {Q.normalized(A.LINES)}, arrived AS (SELECT *, min(r) OVER (PARTITION BY hadm_id, cluster, keyword ORDER BY pos, sub_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ranked)
SELECT {COLS} FROM arrived WHERE prev IS NOT NULL AND r >= prev""")
def dedup_dropped_frame(s, d):
    return N.losers(N.explode_facts(N.candidates(lines(s, d)))).select(*FACT)


@query(f"WITH {Q.normalized(A.LINES)} SELECT {COLS} FROM facts WHERE (hadm_id, pos) IN (SELECT (hadm_id, pos) FROM judged WHERE status = 'expanded')")
def bp_expand(s, d):
    return N.explode_facts(N.candidates(lines(s, d)).filter("status = 'expanded'")).select(*FACT)


@query(f"WITH {Q.normalized(A.USERS)} SELECT {COLS} FROM best")
def ts_fill(s, d):
    return N.normalize(A.from_sql(s, d, A.USERS)).select(*FACT)


# --- sanitizing and post-filters -------------------------------------------------------------------


@query(f"WITH {Q.sanitized(A.LINES, 'objective')} SELECT {COLS} FROM clean")
def sanitize_objective(s, d):
    return S.sanitize(lines(s, d), "objective").select(*FACT)


@query(f"WITH {Q.sanitized(A.LINES, 'all')} SELECT {COLS} FROM clean")
def sanitize_all(s, d):
    return S.sanitize(lines(s, d), "all").select(*FACT)


@query(f"WITH {Q.sanitized(A.LINES, 'all', True)} SELECT {COLS} FROM clean")
def semantic_expand(s, d):
    return S.sanitize(lines(s, d), "all", C.EngineConfig.experimental()).select(*FACT)


_NK = "trim(regexp_replace(lower(keyword), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {Q.sanitized(A.LINES, 'all', True)}, k AS (SELECT *, {_NK} AS nk FROM clean),
ok AS (SELECT * FROM k WHERE NOT (cluster = 'SYMPTOMS' AND (nk = '' OR {Q.within('nk', C.FRAGMENTS)} OR starts_with(nk, 'and ') OR starts_with(nk, 'or ') OR len(string_split(nk, ' ')) <= 2 AND len(list_filter(string_split(nk, ' '), lambda x: NOT ({Q.within('x', C.ANATOMIC + C.DIRECTIONS)}))) = 0))),
picked AS (SELECT * FROM ok WHERE cluster IN ('PROBLEMS', 'SYMPTOMS') QUALIFY row_number() OVER (PARTITION BY hadm_id, cluster, nk ORDER BY CASE WHEN CASE WHEN cluster = 'PROBLEMS' THEN lower(value) = 'chronic' OR ts = 'Past' ELSE ts = 'Admission' END THEN 0 ELSE 1 END, pos, sub_pos) = 1)
SELECT {COLS} FROM ok WHERE cluster NOT IN ('PROBLEMS', 'SYMPTOMS') UNION ALL SELECT {COLS} FROM picked""")
def semantic_gate(s, d):
    return S.semantic_gate(S.sanitize(lines(s, d), "all", C.EngineConfig.experimental())).select(*FACT)


_FLAG = f"CASE WHEN {Q.within('keyword', C.BINARY_FLAG_KEYWORDS)} AND {Q.within('lower(value)', C.BINARY_TRUE)} THEN CASE WHEN keyword = 'Dialysis' THEN 'done' ELSE 'yes' END WHEN {Q.within('keyword', C.BINARY_FLAG_KEYWORDS)} AND {Q.within('lower(value)', C.BINARY_FALSE)} THEN 'no' ELSE value END"


@query(f"WITH {Q.sanitized(A.LINES, 'all')} SELECT hadm_id, pos, cluster, keyword, {_FLAG} AS value, ts FROM clean WHERE cluster IN ('MEDICATIONS', 'PROCEDURES')")
def binary_flags(s, d):
    f = S.sanitize(lines(s, d), "all").filter(F.col("cluster").isin("MEDICATIONS", "PROCEDURES"))
    return S.binary_flags(f).select("hadm_id", "pos", "cluster", "keyword", "value", "ts")


_SECTIONS = f"md AS ({A.MARKDOWN}), heads AS (SELECT hadm_id, pos, line, starts_with(trim(line), '## ') AS h, CASE WHEN starts_with(trim(line), '## ') THEN upper(trim(substr(trim(line), 4))) END AS nm FROM md), secs AS (SELECT hadm_id, pos, line, h, last_value(nm IGNORE NULLS) OVER w AS section, count(nm) OVER w AS section_no FROM heads WINDOW w AS (PARTITION BY hadm_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"


def md(s, d):
    return A.from_sql(s, d, A.MARKDOWN)


@query(f"""WITH {Q.sanitized(A.LINES, 'all')}, {_SECTIONS} SELECT {COLS} FROM clean c WHERE NOT (cluster IN ('MEDICATIONS', 'PROCEDURES') AND lower(value) = 'no' AND NOT (cluster = 'PROCEDURES' AND keyword = 'Any Procedure')
  AND NOT EXISTS (SELECT 1 FROM secs x WHERE x.h AND x.hadm_id = c.hadm_id AND x.section = c.cluster))""")
def neg_guard(s, d):
    have = M.sections(md(s, d)).filter("is_header").select("hadm_id", "section")
    return S.drop_unfounded_negatives(S.sanitize(lines(s, d), "all"), have).select(*FACT)


@query(f"""WITH {Q.sanitized(A.LINES, 'all')} SELECT {COLS} FROM clean WHERE NOT (cluster = 'MEDICATIONS' AND ({Q.within('keyword', C.LOW_INFO_FLAGS)} AND lower(value) = 'no' OR keyword = 'New Medications Count' AND coalesce(try_cast({Q.number('value')} AS DOUBLE) = 0, false)))
  AND NOT (cluster = 'PROCEDURES' AND {Q.within('keyword', C.LOW_INFO_PROCEDURES)} AND lower(value) = 'no')""")
def low_info_negatives(s, d):
    return S.drop_low_information(S.sanitize(lines(s, d), "all")).select(*FACT)


@query(f"""WITH {Q.sanitized(A.LINES, 'all')}, {_SECTIONS}, said AS (SELECT DISTINCT hadm_id FROM secs WHERE section = 'UTILIZATION' AND NOT h AND len(list_filter(string_split(line, ';'), lambda x: trim(x) <> '' AND NOT ({Q.within("lower(trim(CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE x END))", C.UTILIZATION_PLACEHOLDERS)}))) > 0)
SELECT {COLS} FROM clean WHERE cluster <> 'UTILIZATION' OR hadm_id IN (SELECT hadm_id FROM said)""")
def util_gate(s, d):
    return S.gate_utilization(S.sanitize(lines(s, d), "all"), M.sections(md(s, d)).filter("NOT is_header")).select(*FACT)


_PAIRS = f"{_SECTIONS}, pairs AS (SELECT hadm_id, pos, section, trim(regexp_extract(trim(line), '^([^=]*)=', 1)) AS key, trim(regexp_replace(trim(line), '^[^=]*=', '')) AS value FROM secs WHERE NOT h AND contains(line, '='))"
_BIN = lambda x: f"CASE WHEN {Q.within(x, C.BINARY_TRUE)} THEN 'yes' WHEN {Q.within(x, C.BINARY_FALSE)} THEN 'no' END"
_VAL = lambda k: f"max(lower(value)) FILTER (key = '{k}')"


@query(f"""WITH {Q.sanitized(A.LINES, 'all')}, {_PAIRS},
wide AS (SELECT hadm_id, {_VAL('Any Procedure')} AS a, {_VAL('Surgery')} AS su, {_VAL('Dialysis')} AS di, {_VAL('Mechanical Ventilation')} AS ve, bool_or(lower(value) IN ('done', 'started') AND key = 'Surgery') AS ev FROM pairs WHERE section = 'PROCEDURES' GROUP BY hadm_id),
typed AS (SELECT hadm_id, {_BIN('a')} AS a, coalesce({_BIN('su')}, CASE WHEN ev THEN 'yes' END) AS su, ev, coalesce(di IN ('started', 'done', 'decided', 'cancelled', '1', '1.0', 'true', 'yes', 'y'), false) AS di, coalesce(NOT {Q.within('ve', [*C.TEXT_PLACEHOLDERS, *C.BINARY_FALSE])}, false) AS ve FROM wide),
pos_ AS (SELECT *, coalesce(su = 'yes', false) OR di OR ve OR ev AS positive FROM typed),
outs AS (SELECT *, CASE WHEN a = 'yes' THEN CASE WHEN positive THEN 'yes' ELSE 'no' END WHEN a = 'no' THEN 'no' WHEN NOT positive THEN 'no' END AS any_out FROM pos_),
kept AS (SELECT c.hadm_id, c.cluster, c.keyword, c.value, c.ts FROM clean c LEFT JOIN outs o ON o.hadm_id = c.hadm_id WHERE NOT coalesce(c.cluster = 'PROCEDURES' AND o.positive IS NOT NULL AND (c.keyword = 'Any Procedure' AND (o.any_out IS NOT NULL OR lower(c.value) = 'yes' AND NOT o.positive) OR c.keyword = 'Surgery' AND (o.su = 'yes' OR o.su = 'no' AND NOT coalesce(o.ev, false) AND lower(c.value) = 'yes')), false))
SELECT * FROM kept UNION ALL SELECT hadm_id, 'PROCEDURES', 'Any Procedure', any_out, 'Admission' FROM outs WHERE any_out IS NOT NULL UNION ALL SELECT hadm_id, 'PROCEDURES', 'Surgery', 'yes', 'Past' FROM outs WHERE su = 'yes'""")
def proc_fallback(s, d):
    p = M.pairs(md(s, d)).filter("section = 'PROCEDURES'")
    typed = p.select("hadm_id", F.col("key").alias("keyword"), "value", (F.lower("value").isin("done", "started") & (F.col("key") == "Surgery")).alias("evidence"))
    return S.procedure_fallback(S.sanitize(lines(s, d), "all"), typed).select("hadm_id", "cluster", "keyword", "value", "ts")


@query("WITH e AS (SELECT user_id AS hadm_id, event_id AS pos, event_type AS line FROM events), l AS (SELECT *, lag(line) OVER (PARTITION BY hadm_id ORDER BY pos) AS b FROM e) SELECT hadm_id, pos, line FROM l WHERE b IS NULL OR b <> line")
def consecutive_dedup(s, d):
    return S.drop_consecutive(read(s, d, "events").select(F.col("user_id").alias("hadm_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("line")))


@query(f"""WITH lines AS ({A.LINES}), t AS (SELECT hadm_id, pos, trim(line) AS line, lower(trim(line)) AS w FROM lines) SELECT hadm_id, pos, line FROM t WHERE w <> '' AND NOT ({" OR ".join(f"starts_with(w, {Q.lit(x)})" for x in C.LEAK_PREFIXES)}) AND NOT {Q.contains_any('w', C.LEAK_SUBSTRINGS)}""")
def leakage_filter(s, d):
    return S.drop_leakage(lines(s, d)).select("hadm_id", "pos", "line")


# --- synonyms --------------------------------------------------------------------------------------


@query(f"WITH f AS ({A.FACTS}) SELECT cluster, keyword, CASE WHEN cluster = 'PROBLEMS' THEN {Q.lookup('lower(keyword)', Y.DIAGNOSES, 'keyword')} ELSE {Q.lookup('lower(keyword)', Y.SYMPTOMS, 'keyword')} END AS canonical, count(*) AS n FROM f WHERE cluster IN ('PROBLEMS', 'SYMPTOMS') GROUP BY ALL")
def synonym_map(s, d):
    f = A.from_sql(s, d, A.FACTS).filter(F.col("cluster").isin("PROBLEMS", "SYMPTOMS"))
    name = F.when(F.col("cluster") == "PROBLEMS", Y.diagnosis(F.col("keyword"))).otherwise(Y.symptom(F.col("keyword")))
    return f.select("cluster", "keyword", name.alias("canonical")).groupBy("cluster", "keyword", "canonical").agg(F.count("*").alias("n"))


def _rules(expr: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {Q.lit(p)}) THEN {Q.lit(v)}" for p, v in rules) + f" ELSE {Q.lit(otherwise)} END"


_ICD = "CASE " + " ".join(f"WHEN starts_with(code, {Q.lit(p)}) THEN {Q.lit(v)}" for p, v in sorted(C.ICD9_PREFIXES, key=lambda r: -len(r[0]))) + " END"


@query(f"""WITH f AS ({A.FACTS}), g AS (SELECT value, {_rules('lower(value)', C.DISPOSITION_RULES, 'Other')} AS disposition, {_rules('lower(keyword)', C.SYMPTOM_RULES, '')} AS symptom, concat('4', q % 40 + 1) AS code FROM f WHERE cluster IN ('DISPOSITION', 'SYMPTOMS'))
SELECT disposition, symptom, {_ICD} AS problem, count(*) AS n FROM g GROUP BY ALL""")
def regex_map(s, d):
    f = A.from_sql(s, d, A.FACTS).filter(F.col("cluster").isin("DISPOSITION", "SYMPTOMS"))
    code = F.concat(F.lit("4"), (F.col("q") % 40 + 1).cast("string"))
    return f.select(Y.disposition(F.col("value")).alias("disposition"), Y.symptom_pattern(F.col("keyword")).alias("symptom"), Y.icd9(code).alias("problem")).groupBy("disposition", "symptom", "problem").agg(F.count("*").alias("n"))


def _index(groups):
    out = {}
    for g, w, ss in groups:
        for x in ss:
            out.setdefault(x, (g, w))
    return "(VALUES " + ", ".join(f"({Q.lit(x)}, {Q.lit(g)}, {w}, {i})" for i, (x, (g, w)) in enumerate(out.items())) + ") AS syn(s, g, w, o)"


def _match(source: str, groups) -> str:
    """(keyword, gid, weight) of the distinct keywords of a one-column relation."""
    return f"""SELECT keyword, g AS gid, w AS weight FROM (SELECT keyword, s, g, w, o, CASE WHEN k = s THEN 3 WHEN list_contains(string_split_regex(k, '[\\s,;/\\-()]+'), s) OR starts_with(k, s || ' ') OR ends_with(k, ' ' || s) OR contains(k, ' ' || s || ' ') THEN 2 WHEN length(s) >= 4 THEN 1 ELSE 0 END AS tier
  FROM (SELECT keyword, lower(trim(keyword)) AS k FROM ({source}) src) kk JOIN {_index(groups)} ON contains(k, s)) hits WHERE tier > 0 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY tier DESC, length(s) DESC, o) = 1"""


def _scored(lines_sql: str) -> str:
    """CTEs ending in ``rf``: facts for scoring, with dropped."""
    strip = lambda k, ps: _strip_sql(k, ps)
    its = "list_transform(string_split_regex(trim(v), '[;\\n,]+'), lambda x: trim(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' -'))"
    its = f"list_filter({its}, lambda x: x <> '')[1:20]"
    ranged = " OR ".join(f"(cluster = {Q.lit(c)} AND keyword = {Q.lit(k)})" for c, k in C.RANGES if c not in C.NUMERIC_CLUSTERS)
    plaus = "CASE " + " ".join(f"WHEN cluster = {Q.lit(c)} AND keyword = {Q.lit(k)} THEN vn BETWEEN {lo} AND {hi}" for (c, k), ((lo, hi), _) in C.RANGES.items()) + " ELSE true END"
    num = "CASE WHEN NOT contains(value, '/') THEN try_cast(nullif(regexp_extract(value, '[-+]?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) END"
    return f"""
sl AS ({lines_sql}), sp AS (SELECT hadm_id, pos, list_transform(string_split(trim(line), '|'), lambda x: trim(x)) AS p FROM sl WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
sk AS (SELECT hadm_id, pos, coalesce(len(p) = 4 AND {Q.within('p[1]', C.CLUSTERS)}, false) AS ok, p[1] AS cluster, CASE WHEN p[1] = 'PROBLEMS' THEN {strip('p[2]', C.PROBLEM_PREFIXES)} WHEN p[1] = 'SYMPTOMS' THEN {strip('p[2]', C.SYMPTOM_PREFIXES)} ELSE p[2] END AS k, p[3] AS v, p[4] AS t FROM sp),
si AS (SELECT *, list_filter(its0, lambda x, i: list_position(low, lower(x)) = i) AS its FROM (SELECT *, list_transform(its0, lambda y: lower(y)) AS low FROM (SELECT *, {its} AS its0 FROM sk) w) w2),
sf AS (SELECT hadm_id, pos, unnest(range(len(its))) AS sub_pos, ok, cluster, unnest(its) AS keyword, CASE WHEN {Q.within('lower(k)', C.ACUTE_KEYS)} THEN 'acute' ELSE 'chronic' END AS value, CASE WHEN {Q.within('lower(k)', C.ACUTE_KEYS)} THEN 'Discharge' ELSE 'Past' END AS ts FROM si WHERE cluster = 'PROBLEMS' AND len(its) > 0 AND {Q.within('lower(k)', C.ACUTE_KEYS + C.CHRONIC_KEYS)}
  UNION ALL SELECT hadm_id, pos, 0, ok, cluster, k, v, t FROM si WHERE NOT coalesce(cluster = 'PROBLEMS' AND len(its) > 0 AND {Q.within('lower(k)', C.ACUTE_KEYS + C.CHRONIC_KEYS)}, false)),
sn AS (SELECT *, coalesce({Q.within('cluster', C.NUMERIC_CLUSTERS)} OR {ranged}, false) AS must, CASE WHEN {Q.within('cluster', C.NUMERIC_CLUSTERS)} OR {ranged} OR (cluster = 'PROCEDURES' AND keyword = 'Mechanical Ventilation') THEN {num} END AS vn FROM sf),
sx AS (SELECT *, NOT ok OR (must AND vn IS NULL) AS fail FROM sn),
rf AS (SELECT hadm_id, pos, sub_pos, cluster, keyword, value, vn AS value_num, vn IS NOT NULL AS is_numeric, coalesce({plaus}, true) AS plausible, ts, fail OR coalesce({Q.within('cluster', C.OBJECTIVE_CLUSTERS)} AND row_number() OVER (PARTITION BY hadm_id, cluster, keyword, fail ORDER BY pos, sub_pos) > 1, false) AS dropped FROM sx)"""


def _strip_sql(k: str, prefixes) -> str:
    for p in prefixes:
        k = f"CASE WHEN starts_with(lower({k}), {Q.lit(p.lower())}) THEN trim(substr({k}, {len(p) + 1})) ELSE {k} END"
    return k


_RF = _scored(A.SCORED)


@query(f"""WITH {_RF}, kk AS (SELECT DISTINCT cluster, keyword FROM rf WHERE NOT dropped AND cluster IN ('PROBLEMS', 'SYMPTOMS')), pm AS ({_match("SELECT keyword FROM kk WHERE cluster = 'PROBLEMS'", C.PROBLEM_GROUPS)}), sm AS ({_match("SELECT keyword FROM kk WHERE cluster = 'SYMPTOMS'", C.SYMPTOM_GROUPS)})
SELECT kk.cluster, kk.keyword, coalesce(pm.gid, sm.gid) AS gid, coalesce(pm.weight, sm.weight) AS weight FROM kk LEFT JOIN pm ON kk.cluster = 'PROBLEMS' AND pm.keyword = kk.keyword LEFT JOIN sm ON kk.cluster = 'SYMPTOMS' AND sm.keyword = kk.keyword""")
def concept_match(s, d):
    return R.with_groups(scored(s, d).filter("NOT dropped AND cluster IN ('PROBLEMS', 'SYMPTOMS')").select("cluster", "keyword").distinct())


def scored(s, d):
    return R.parse(A.from_sql(s, d, A.SCORED))


@query(f"WITH {_RF} SELECT * FROM rf")
def risk_parse(s, d):
    return scored(s, d).select("hadm_id", "pos", "sub_pos", "cluster", "keyword", "value", "value_num", "is_numeric", "plausible", "ts", "dropped")


def _points_sql() -> str:
    out = []
    for (c, k), (_, ranges) in C.RANGES.items():
        hit = "CASE " + " ".join(f"WHEN value_num BETWEEN {lo} AND {hi} THEN {p}" for lo, hi, p in ranges) + " ELSE 0 END"
        out.append(f"WHEN cluster = {Q.lit(c)} AND keyword = {Q.lit(k)}" + (" AND plausible" if c in ("VITALS", "LABS") else "") + f" THEN {hit}")
    low = "lower(trim(value))"
    home = "'home with service', 'home w service', 'home with svc', 'home w/ service', 'home w services', 'home w/ services', 'home health', 'home health care'"
    for (c, k), table in C.VALUES.items():
        x = f"CASE WHEN {low} IN ({home}) THEN 'home with services' WHEN {low} IN ('hospice residence', 'hospice care') THEN 'hospice' ELSE {low} END" if k == "Discharge Disposition" else low
        out.append(f"WHEN cluster = {Q.lit(c)} AND keyword = {Q.lit(k)} THEN CASE " + " ".join(f"WHEN {x} = {Q.lit(v)} THEN {p}" for v, p in table.items()) + " ELSE 0 END")
    out.append(f"WHEN cluster = 'PROCEDURES' AND keyword = 'Mechanical Ventilation' THEN CASE WHEN coalesce(value_num > 0, false) OR {low} <> 'no' THEN {C.VENTILATION_POINTS} ELSE 0 END")
    return "CASE " + " ".join(out) + " ELSE 0 END"


_ACT = "lower(trim(value)) IN ('chronic', 'acute', 'exist')"
_SCORES = f"""{_RF}, kk AS (SELECT DISTINCT cluster, keyword FROM rf WHERE NOT dropped AND cluster IN ('PROBLEMS', 'SYMPTOMS')), pm AS ({_match("SELECT keyword FROM kk WHERE cluster = 'PROBLEMS'", C.PROBLEM_GROUPS)}), sm AS ({_match("SELECT keyword FROM kk WHERE cluster = 'SYMPTOMS'", C.SYMPTOM_GROUPS)}),
lv AS (SELECT rf.*, CASE WHEN cluster = 'PROBLEMS' THEN pg WHEN cluster = 'SYMPTOMS' THEN sg END AS gid, CASE WHEN cluster = 'PROBLEMS' THEN pw WHEN cluster = 'SYMPTOMS' THEN sw END AS weight, {_points_sql()} AS pts FROM rf LEFT JOIN (SELECT keyword AS pk, gid AS pg, weight AS pw FROM pm) pm ON pk = rf.keyword LEFT JOIN (SELECT keyword AS sk, gid AS sg, weight AS sw FROM sm) sm ON sk = rf.keyword WHERE NOT dropped),
dc AS (SELECT DISTINCT hadm_id FROM rf),
one AS (SELECT hadm_id, coalesce(sum(pts) FILTER (cluster = 'DEMOGRAPHICS'), 0) + CASE WHEN coalesce(bool_or(is_numeric) FILTER (cluster = 'DEMOGRAPHICS' AND keyword = 'Age'), false) THEN 0 ELSE {C.AGE_MISSING} END AS dem, coalesce(sum(pts) FILTER (cluster = 'VITALS'), 0) AS vit, coalesce(sum(pts) FILTER (cluster = 'LABS'), 0) AS lab,
  least(coalesce(sum(pts) FILTER (cluster = 'MEDICATIONS'), 0) + CASE WHEN arg_max(value_num, (pos, sub_pos)) FILTER (cluster = 'MEDICATIONS' AND keyword = 'Medication Count') >= 5 AND NOT coalesce(bool_or(pts > 0) FILTER (cluster = 'MEDICATIONS' AND keyword = 'Polypharmacy'), false) THEN {C.POLYPHARMACY_POINTS} ELSE 0 END, 15) AS med,
  coalesce(sum(pts) FILTER (cluster = 'PROCEDURES' AND keyword <> 'Any Procedure'), 0) AS spec, coalesce(arg_min(pts, (pos, sub_pos)) FILTER (cluster = 'PROCEDURES' AND keyword = 'Any Procedure'), 0) AS anyp,
  least(coalesce(sum(pts) FILTER (cluster = 'UTILIZATION'), 0), 20) AS util, least(coalesce(sum(pts) FILTER (cluster = 'DISPOSITION'), 0), 15) AS disp FROM lv GROUP BY hadm_id),
gr AS (SELECT hadm_id, cluster, gid, max(weight * CASE WHEN cluster = 'PROBLEMS' THEN 1.0 WHEN lower(trim(value)) = 'severe' THEN 1.5 ELSE 1.0 END) AS w, count(*) AS n FROM lv WHERE (cluster = 'PROBLEMS' AND {_ACT}) OR (cluster = 'SYMPTOMS' AND lower(trim(value)) IN ('yes', 'severe')) GROUP BY ALL),
gs AS (SELECT hadm_id, cluster, coalesce(sum(w) FILTER (gid IS NOT NULL), 0) AS w, count(gid) AS g, sum(n) AS n FROM gr GROUP BY ALL),
sc AS (SELECT hadm_id, CASE WHEN cluster = 'PROBLEMS' THEN least(w + greatest(least(g - 3, 5), 0), 40) ELSE least(round_even(w + CASE WHEN n > 3 THEN 2 ELSE 0 END, 0), 15) END AS score, cluster FROM gs),
cs AS (SELECT dc.hadm_id, u.cluster, u.score::INT AS score FROM dc LEFT JOIN one USING (hadm_id) LEFT JOIN (SELECT * FROM sc WHERE cluster = 'PROBLEMS') pr USING (hadm_id) LEFT JOIN (SELECT * FROM sc WHERE cluster = 'SYMPTOMS') sy USING (hadm_id),
  LATERAL (VALUES ('DEMOGRAPHICS', coalesce(dem, {C.AGE_MISSING})), ('VITALS', coalesce(vit, 0)), ('LABS', coalesce(lab, 0)), ('MEDICATIONS', coalesce(med, 0)), ('PROCEDURES', least(coalesce(CASE WHEN spec = 0 THEN anyp ELSE spec END, 0), 15)), ('UTILIZATION', coalesce(util, 0)), ('DISPOSITION', coalesce(disp, 0)), ('PROBLEMS', coalesce(pr.score, 0)), ('SYMPTOMS', coalesce(sy.score, 0))) AS u(cluster, score))"""
_V = lambda c, k: f"arg_min(value_num, (pos, sub_pos)) FILTER (cluster = '{c}' AND keyword = '{k}' AND is_numeric)"
_S = lambda c, k: f"arg_min(lower(trim(value)), (pos, sub_pos)) FILTER (cluster = '{c}' AND keyword = '{k}')"
_H = lambda c, g, vs: f"coalesce(bool_or(lower(trim(value)) IN ({vs})) FILTER (cluster = '{c}' AND gid = '{g}'), false)"
_PATTERNS = f"""{_SCORES},
pw AS (SELECT hadm_id, {_V('VITALS', 'Heart Rate')} AS hr, {_V('VITALS', 'Systolic BP')} AS sbp, {_V('VITALS', 'Respiratory Rate')} AS rr, {_V('VITALS', 'Temperature')} AS temp, {_V('VITALS', 'SpO2')} AS spo2, {_V('LABS', 'WBC')} AS wbc, {_V('LABS', 'Creatinine')} AS cr, {_V('LABS', 'BUN')} AS bun, {_V('LABS', 'Potassium')} AS kal, {_V('LABS', 'Sodium')} AS na, {_V('LABS', 'Bicarbonate')} AS bic, {_V('LABS', 'Hemoglobin')} AS hgb, {_V('LABS', 'Glucose')} AS glu, {_V('LABS', 'Platelet')} AS plt, {_V('DEMOGRAPHICS', 'Age')} AS age,
  {_S('DISPOSITION', 'Mental Status')} AS mental, {_S('DISPOSITION', 'Discharge Disposition')} AS disp, {_S('MEDICATIONS', 'Anticoagulation')} AS anticoag, {_H('PROBLEMS', 'heart_failure', "'chronic', 'acute', 'exist'")} AS hf, {_H('SYMPTOMS', 'edema_fluid', "'yes', 'severe'")} AS edema, {_H('SYMPTOMS', 'respiratory_distress', "'yes', 'severe'")} AS resp,
  count(DISTINCT gid) FILTER (cluster = 'PROBLEMS' AND {_ACT}) AS grp FROM lv GROUP BY hadm_id),
ph AS (SELECT hadm_id, u.pattern, u.bonus FROM pw, LATERAL (VALUES
  ('sepsis_pattern', 10, hr > 100 AND (coalesce(sbp < 100, false) OR coalesce(rr > 22, false)) AND (coalesce(wbc > 12, false) OR coalesce(wbc < 4, false) OR coalesce(temp > 100.4, false))),
  ('aki_pattern', 8, cr > 1.5 AND bun > 30 AND (coalesce(kal > 5.0, false) OR coalesce(na < 135, false) OR coalesce(bic < 22, false))), ('decompensated_hf', 8, hf AND (edema OR resp OR coalesce(bun > 40, false))),
  ('frailty_syndrome', 6, age > 75 AND (grp >= 3)::INT + coalesce(hgb < 10, false)::INT + coalesce(mental IN ('confused', 'lethargic'), false)::INT + coalesce(disp IN ('snf', 'ltac', 'rehab'), false)::INT >= 2),
  ('unstable_discharge', 5, coalesce(disp = 'ama', false) OR (coalesce(mental IN ('confused', 'lethargic'), false) AND (disp IS NULL OR disp = 'home'))), ('respiratory_failure', 6, spo2 < 92 AND (coalesce(rr > 24, false) OR resp)),
  ('metabolic_crisis', 6, glu > 300 AND (coalesce(bic < 18, false) OR coalesce(kal > 5.5, false))), ('bleeding_risk', 6, hgb < 8 AND (coalesce(plt < 100, false) OR coalesce(anticoag = 'yes', false)))) AS u(pattern, bonus, hit) WHERE u.hit)"""


@query(f"WITH {_SCORES} SELECT * FROM cs")
def risk_cluster_scores(s, d):
    return R.cluster_scores(scored(s, d))


@query(f"WITH {_PATTERNS} SELECT * FROM ph")
def risk_patterns(s, d):
    return R.patterns(scored(s, d))


_BAND = "CASE " + " ".join(f"WHEN composite_score BETWEEN {lo} AND {hi} THEN {Q.lit(n)}" for lo, hi, n in C.BANDS) + " ELSE 'Critical' END"
_K = f"greatest(0.5, {C.K_BASE} + 0.02 * (composite_score - 30))"
_RESULT = f"""{_PATTERNS},
tot AS (SELECT cs.hadm_id, (sum(score) + coalesce(any_value(b.bonus), 0))::INT AS composite_score, coalesce(any_value(b.bonus), 0)::INT AS interaction_bonus, coalesce(any_value(b.pats), '') AS patterns FROM cs LEFT JOIN (SELECT hadm_id, sum(bonus) AS bonus, string_agg(pattern, ',' ORDER BY pattern) AS pats FROM ph GROUP BY hadm_id) b ON b.hadm_id = cs.hadm_id GROUP BY cs.hadm_id),
seen AS (SELECT hadm_id, count(*) FILTER (NOT dropped) AS n_facts_parsed, count(*) FILTER (dropped) AS n_facts_dropped, list(DISTINCT cluster) FILTER (NOT dropped) AS have FROM rf GROUP BY hadm_id),
pre AS (SELECT tot.*, n_facts_parsed, n_facts_dropped, list_sort(list_filter([{', '.join(Q.lit(c) for c in C.CLUSTERS)}], lambda x: NOT list_contains(coalesce(have, []), x))) AS miss, 1 / (1 + exp(-({C.ALPHA}::DOUBLE + {C.BETA}::DOUBLE * composite_score))) AS p, greatest(1.0::DOUBLE, {C.D_MAX}::DOUBLE * exp(-{C.GAMMA}::DOUBLE * composite_score)) AS dd, {_K}::DOUBLE AS k FROM tot JOIN seen USING (hadm_id)),
result AS (SELECT hadm_id, composite_score, interaction_bonus, patterns, round(p, 4) AS probability, {_BAND} AS risk_category, round(dd, 1) AS estimated_days, CASE WHEN dd <= 7 THEN '0-7 days' WHEN dd <= 14 THEN '8-14 days' ELSE '15-30 days' END AS days_bucket,
  {', '.join(f"round(least(greatest(p * (1 - exp(-k * ({t} / 30.0::DOUBLE))) / (1 - exp(-k)), 0), 1), 4) AS p_{t}d" for t in C.HORIZONS)}, array_to_string(miss, ',') AS missing_clusters, round(1 - len(miss) / 9.0::DOUBLE, 2) AS data_completeness,
  CASE WHEN 1 - len(miss) / 9.0 >= 0.7 THEN 'high' WHEN 1 - len(miss) / 9.0 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, n_facts_parsed, n_facts_dropped FROM pre)"""


@query(f"WITH {_RESULT} SELECT * FROM result")
def risk_result(s, d):
    return R.results(scored(s, d))


@query(f"""WITH {_RESULT} SELECT count(*) AS n, round(avg(composite_score), 6) AS mean_score, min(composite_score) AS min_score, max(composite_score) AS max_score, count(*) FILTER (risk_category = 'Low') AS n_low, count(*) FILTER (risk_category = 'Moderate') AS n_moderate, count(*) FILTER (risk_category = 'High') AS n_high, count(*) FILTER (risk_category = 'Critical') AS n_critical,
  list_sort(list(composite_score))[count(*) // 2 + 1] AS median_score FROM result""")
def risk_summary(s, d):
    return R.summary(R.results(scored(s, d)))


@query(f"SELECT s AS score, {', '.join(f'round(least(greatest((1 / (1 + exp(-({C.ALPHA}::DOUBLE + {C.BETA}::DOUBLE * s)))) * (1 - exp(-k * ({t} / 30.0::DOUBLE))) / (1 - exp(-k)), 0), 1), 4) AS p_{t}d' for t in C.HORIZONS)} FROM (SELECT DISTINCT (o_custkey % 120)::INT AS s, greatest(0.5, {C.K_BASE} + 0.02 * (o_custkey % 120 - 30))::DOUBLE AS k FROM orders)")
def survival(s, d):
    x = read(s, d, "orders").select((F.col("o_custkey") % 120).cast("int").alias("score")).distinct()
    return x.select("score", *[R.survival(F.col("score"), R.probability(F.col("score")), t).alias(f"p_{t}d") for t in C.HORIZONS])


# --- evaluation ------------------------------------------------------------------------------------

_TRUTH_SQL = f"SELECT hadm_id, pos, concat_ws('|', cluster, CASE WHEN pos % 7 = 1 THEN upper(keyword) ELSE keyword END, CASE WHEN pos % 7 = 2 AND cluster IN ('VITALS', 'LABS') THEN concat(value, '0') WHEN pos % 7 = 3 THEN upper(value) ELSE value END, CASE WHEN pos % 7 = 4 THEN 'Past' ELSE ts END) AS line FROM (SELECT {COLS} FROM best WHERE pos % 7 <> 5) b"


def _sides(s, d, best=None):
    best = N.normalize(lines(s, d)) if best is None else best
    pred = N.render(best)
    k, v, t, m = F.col("keyword"), F.col("value"), F.col("ts"), F.col("pos") % 7
    truth = best.filter("pos % 7 <> 5").select("hadm_id", "pos", line(F.col("cluster"), F.when(m == 1, F.upper(k)).otherwise(k), F.when((m == 2) & F.col("cluster").isin("VITALS", "LABS"), F.concat(v, F.lit("0"))).when(m == 3, F.upper(v)).otherwise(v), F.when(m == 4, "Past").otherwise(t)).alias("line"))
    return pred, truth


_AS_MAP = lambda src: f"SELECT hadm_id, upper(p[1]) AS cluster, p[2] AS keyword, arg_max(p[3], pos) AS value, arg_max(p[4], pos) AS ts, min(pos) AS pos FROM (SELECT hadm_id, pos, list_transform(string_split(line, '|'), lambda x: trim(x)) AS p FROM ({src}) z) y WHERE len(p) = 4 AND len(list_filter(p, lambda x: x = '')) = 0 GROUP BY hadm_id, upper(p[1]), p[2]"
_PRED_SQL = "SELECT hadm_id, pos, concat_ws('|', cluster, keyword, value, ts) AS line FROM best"
_NUM = lambda x: f"CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') THEN try_cast({x} AS DOUBLE) END"


def _details(timestamp: bool, semantic: bool) -> str:
    ts = "p.ts <> t.ts" if timestamp else "false"
    base = f"""{Q.normalized(A.LINES)}, pr AS ({_AS_MAP(_PRED_SQL)}), tr AS ({_AS_MAP(_TRUTH_SQL)}),
jd AS (SELECT p.hadm_id, p.cluster, p.keyword, CASE WHEN t.value IS NULL THEN 'not_in_gt' WHEN {ts} THEN 'timestamp_mismatch' WHEN NOT coalesce(CASE WHEN {Q.within('p.cluster', C.NUMERIC_CLUSTERS)} THEN abs({_NUM('p.value')} - {_NUM('t.value')}) <= greatest(0.01, 0.1::DOUBLE * abs({_NUM('t.value')})) ELSE lower(p.value) = lower(t.value) END, false) THEN 'value_mismatch' END AS reason
  FROM pr p LEFT JOIN tr t ON t.hadm_id = p.hadm_id AND t.cluster = p.cluster AND t.keyword = p.keyword {"WHERE p.cluster NOT IN ('PROBLEMS', 'SYMPTOMS')" if semantic else ''}),
one AS (SELECT hadm_id, cluster, keyword, CASE WHEN reason IS NULL THEN 'tp' ELSE 'fp' END AS outcome, reason FROM jd)"""
    if semantic:
        by = "hadm_id, kn, pres" + (", ts" if timestamp else "")
        side = lambda t: f"SELECT *, lower(trim(regexp_replace(keyword, '\\s+', ' ', 'g'))) AS kn, CASE WHEN lower(value) IN ('acute', 'chronic', 'exist', 'yes', 'severe') THEN true WHEN lower(value) IN ('not exist', 'no') THEN false END AS pres FROM {t} WHERE cluster IN ('PROBLEMS', 'SYMPTOMS')"
        base += f""", sa AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY pos, cluster, keyword) AS n FROM ({side('pr')}) x), sb AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY pos, cluster, keyword) AS n FROM ({side('tr')}) x),
sj AS (SELECT a.hadm_id, coalesce(b.cluster, a.cluster) AS cluster, coalesce(b.keyword, a.keyword) AS keyword, CASE WHEN b.cluster IS NOT NULL THEN 'tp' ELSE 'fp' END AS outcome, CASE WHEN b.cluster IS NOT NULL THEN NULL WHEN NOT EXISTS (SELECT 1 FROM sb c WHERE c.hadm_id = a.hadm_id AND c.kn = a.kn) THEN 'not_in_gt' ELSE 'value_mismatch' END AS reason
  FROM sa a LEFT JOIN sb b ON b.hadm_id = a.hadm_id AND b.kn = a.kn AND b.pres = a.pres AND b.n = a.n {'AND b.ts = a.ts' if timestamp else ''}), two AS (SELECT * FROM one UNION ALL SELECT * FROM sj)"""
    else:
        base += ", two AS (SELECT * FROM one)"
    return base + ", det AS (SELECT * FROM two UNION ALL SELECT hadm_id, cluster, keyword, 'fn', NULL FROM tr t WHERE NOT EXISTS (SELECT 1 FROM two w WHERE w.outcome = 'tp' AND w.hadm_id = t.hadm_id AND w.cluster = t.cluster AND w.keyword = t.keyword))"


_CNT = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("tp", "fp", "fn"))
_RAT = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END AS f1"


@query(f"WITH {_details(True, False)}, c AS (SELECT hadm_id, {_CNT} FROM det GROUP BY hadm_id) SELECT *, {_RAT} FROM c")
def eval_metrics(s, d):
    return E.ratios(E.counts(E.compare(*_sides(s, d), require_timestamp=True), ["hadm_id"]))


@query(f"WITH {_details(False, True)} SELECT hadm_id, cluster, keyword, outcome, reason FROM det")
def eval_semantic(s, d):
    return E.compare(*_sides(s, d), semantic=True)


@query(f"WITH {_details(False, False)}, c AS (SELECT cluster, {_CNT} FROM det GROUP BY cluster) SELECT n.cluster, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES {', '.join(f'({Q.lit(c)})' for c in C.CLUSTERS)}) AS n(cluster) LEFT JOIN c ON c.cluster = n.cluster")
def eval_per_cluster(s, d):
    return E.per_cluster(E.compare(*_sides(s, d)))


def _f1(c: str) -> str:
    n = lambda o: f"count(*) FILTER (outcome = '{o}' AND cluster = '{c}')"
    return f"coalesce(2 * {n('tp')} / nullif(2 * {n('tp')} + {n('fp')} + {n('fn')}, 0)::DOUBLE, 0)"


@query(f"""WITH {_details(False, False)}, x AS (SELECT hadm_id, {' + '.join(f'{w}::DOUBLE * {_f1(c)}' for c, w in C.CLUSTER_WEIGHTS.items())} AS weighted_f1, count(*) FILTER (outcome = 'fn' AND {Q.within('cluster', C.CRITICAL_FN)}) AS critical_fn, count(*) FILTER (outcome = 'fp' AND {Q.within('cluster', C.CRITICAL_FP)}) AS critical_fp,
  coalesce(count(*) FILTER (outcome = 'tp' AND cluster = 'VITALS') / nullif(count(*) FILTER (outcome IN ('tp', 'fn') AND cluster = 'VITALS'), 0)::DOUBLE, 0) AS vitals_recall FROM det GROUP BY hadm_id)
SELECT hadm_id, round(weighted_f1, 9) AS weighted_f1, critical_fn, critical_fp, vitals_recall, vitals_recall >= {C.VITALS_MIN_RECALL} AS gate_passed, CASE WHEN vitals_recall >= {C.VITALS_MIN_RECALL} THEN round(weighted_f1 - {C.LAMBDA_FN}::DOUBLE * critical_fn - {C.LAMBDA_FP}::DOUBLE * critical_fp, 9) END AS score FROM x""")
def downstream_score(s, d):
    return E.downstream(E.compare(*_sides(s, d))).withColumns({"weighted_f1": F.round("weighted_f1", 9), "score": F.round("score", 9)})


_FS = "list_filter(p, lambda x: x = '')"


@query(f"""WITH lines AS ({A.LINES}), a AS (SELECT hadm_id, trim(line) AS s, list_transform(string_split(trim(line), '|'), lambda x: trim(x)) AS p FROM lines WHERE trim(line) <> ''),
b AS (SELECT *, lower(s) = 'end' AS e, coalesce(len(p) = 3 AND lower(p[2]) = 'not stated', false) AS u FROM a), c AS (SELECT *, NOT e AND NOT u AS cand, NOT e AND NOT u AND len(p) = 4 AND len({_FS}) = 0 AS valid, NOT e AND NOT u AND len(p) = 5 AND upper(p[1]) IN ('CLUSTER', 'CLUSTERS') AND len(list_filter(p[2:5], lambda x: x = '')) = 0 AS rec FROM b)
SELECT hadm_id, count(*) FILTER (cand) AS raw_total_lines, count(*) FILTER (valid) AS raw_valid_kvt4_lines, count(*) FILTER (cand AND NOT valid) AS raw_invalid_lines, count(*) FILTER (valid) - count(DISTINCT s) FILTER (valid) AS raw_duplicates_exact, count(*) FILTER (rec) AS raw_recovered_cluster_prefix_lines, count(*) FILTER (e) AS raw_end_lines, count(*) FILTER (u) AS raw_kvt3_not_stated_lines,
  count(*) FILTER (valid OR rec) AS raw_effective_valid_kvt4_lines, round(coalesce(count(*) FILTER (valid OR rec) / nullif(count(*) FILTER (cand), 0)::DOUBLE, 0), 6) AS raw_effective_valid_rate FROM c GROUP BY hadm_id""")
def format_stats(s, d):
    return E.format_stats(lines(s, d))


# --- summaries -------------------------------------------------------------------------------------


@query(f"WITH {_SECTIONS} SELECT hadm_id, section, count(*) FILTER (NOT h) AS n_lines, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h) AS body FROM secs GROUP BY hadm_id, section")
def md_sections(s, d):
    x = M.sections(md(s, d))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("pos", "line")))), lambda v: v["line"]), "\n")
    return x.groupBy("hadm_id", "section").agg(F.count_if(~F.col("is_header")).alias("n_lines"), F.nullif(body, F.lit("")).alias("body"))


_BODY = "trim(CASE WHEN starts_with(upper(s), 'ADM:') THEN substr(s, 5) WHEN starts_with(upper(s), 'DC:') THEN substr(s, 4) ELSE s END)"
_PFX = "CASE WHEN starts_with(upper(s), 'ADM:') THEN substr(s, 1, 4) || ' ' WHEN starts_with(upper(s), 'DC:') THEN substr(s, 1, 3) || ' ' ELSE '' END"
_KEPT = f"list_filter(list_transform(string_split({_BODY}, ';'), lambda x: trim(x)), lambda x: NOT ends_with(lower(x), '=not stated'))"


@query(f"""WITH {_SECTIONS}, z AS (SELECT *, trim(line) AS s FROM secs),
o AS (SELECT hadm_id, pos, h, section, section_no, CASE WHEN lower(s) = 'not stated' THEN NULL WHEN h THEN rtrim(line) WHEN contains(s, ';') AND contains(s, '=') THEN CASE WHEN len({_KEPT}) > 0 THEN {_PFX} || array_to_string({_KEPT}, '; ') END WHEN contains(s, '=') AND lower(trim(regexp_replace(s, '^[^=]*=', ''))) = 'not stated' THEN NULL ELSE rtrim(line) END AS line FROM z),
f AS (SELECT *, max((NOT h AND trim(line) <> '')::INT) OVER (PARTITION BY hadm_id, section_no) AS filled FROM o WHERE line IS NOT NULL)
SELECT hadm_id, pos, section, line FROM f WHERE NOT h OR filled = 1""")
def md_compact(s, d):
    return M.compact(md(s, d)).select("hadm_id", "pos", "section", "line")


@query(f"WITH {_SECTIONS} SELECT hadm_id, pos, line FROM secs WHERE section IN ('VITALS', 'PROBLEMS') AND lower(trim(line)) <> 'not stated'")
def md_filter(s, d):
    return M.filter_sections(M.drop_not_stated(md(s, d)), ["vitals", "problems"]).select("hadm_id", "pos", "line")


@query(f"""WITH {Q.normalized(A.LINES)}, x AS (SELECT *, list_position([{', '.join(Q.lit(c) for c in C.CLUSTERS)}], cluster) AS o FROM best), t AS (SELECT hadm_id, o, '## ' || cluster || chr(10) || string_agg(keyword || '=' || value || ' (' || ts || ')', chr(10) ORDER BY pos, sub_pos) AS t FROM x WHERE o > 0 GROUP BY hadm_id, o, cluster)
SELECT hadm_id, string_agg(t, chr(10) || chr(10) ORDER BY o) AS md FROM t GROUP BY hadm_id""")
def stage1_to_md(s, d):
    return M.summary_markdown(N.normalize(lines(s, d)))


_PK = "CASE key " + " ".join(f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, (v, _) in M._PROBLEM_KEYS.items()) + " END"
_PT = "CASE key " + " ".join(f"WHEN {Q.lit(k)} THEN {Q.lit(t)}" for k, (_, t) in M._PROBLEM_KEYS.items()) + " END"


@query(f"""WITH {Q.sanitized(A.LINES, 'all')}, {_PAIRS}, bs AS (SELECT DISTINCT hadm_id, cluster, keyword, value, ts FROM clean),
ms AS (SELECT hadm_id, 'MEDICATIONS' AS cluster, key AS keyword, value, 'Admission' AS ts FROM pairs WHERE section = 'MEDICATIONS' AND {Q.within('key', C.STRICT_KEYWORDS['MEDICATIONS'])} AND NOT {Q.within('lower(value)', C.TEXT_PLACEHOLDERS)}),
ps AS (SELECT hadm_id, 'PROBLEMS' AS cluster, unnest(list_filter(list_transform(string_split_regex(value, '[;\\n,]+'), lambda x: regexp_replace(trim(x), '\\s+', ' ', 'g')), lambda x: x <> '')[1:12]) AS keyword, {_PK} AS v, {_PT} AS t FROM pairs WHERE section = 'PROBLEMS' AND {Q.within('key', list(M._PROBLEM_KEYS))} AND NOT {Q.within('lower(value)', C.TEXT_PLACEHOLDERS)}),
ad AS (SELECT DISTINCT * FROM (SELECT * FROM ms UNION ALL SELECT hadm_id, cluster, keyword, v, t FROM ps) u EXCEPT SELECT * FROM bs),
bt AS (SELECT *, 'base' AS origin FROM bs UNION ALL SELECT *, 'supplement' FROM ad),
ol AS (SELECT hadm_id, pos, section AS cluster, CASE WHEN regexp_matches(upper(trim(line)), '^(ADM|ADMISSION):') THEN 'Admission' WHEN regexp_matches(upper(trim(line)), '^(DC|DISCHARGE):') THEN 'Discharge' ELSE 'Unknown' END AS ts, string_split(regexp_replace(trim(line), '^(ADM|DC|ADMISSION|DISCHARGE):', '', 'i'), ';') AS sg FROM secs WHERE NOT h AND section IN ('VITALS', 'LABS')),
op AS (SELECT hadm_id, pos, cluster, ts, unnest(range(len(sg))) AS i, unnest(sg) AS part FROM ol),
ok AS (SELECT hadm_id, pos, i, cluster, ts, regexp_replace(trim(regexp_extract(part, '^([^=]*)=', 1)), '\\s+', ' ', 'g') AS keyword, trim(regexp_replace(part, '^[^=]*=', '')) AS v FROM op WHERE contains(part, '=')),
ov AS (SELECT *, CASE WHEN keyword = 'Diastolic BP' AND contains(v, '/') AND len(regexp_extract_all(v, '-?[0-9]+(?:\\.[0-9]+)?')) >= 2 THEN regexp_extract_all(v, '-?[0-9]+(?:\\.[0-9]+)?')[2] ELSE regexp_extract_all(v, '-?[0-9]+(?:\\.[0-9]+)?')[1] END AS value FROM ok WHERE NOT {Q.within('lower(v)', C.TEXT_PLACEHOLDERS)} AND (cluster = 'VITALS' AND {Q.within('keyword', C.STRICT_KEYWORDS['VITALS'])} OR cluster = 'LABS' AND {Q.within('keyword', C.STRICT_KEYWORDS['LABS'])})),
og AS (SELECT hadm_id, cluster, keyword, ts, arg_max(value, (pos, i)) AS value FROM ov WHERE value IS NOT NULL GROUP BY ALL),
oo AS (SELECT hadm_id, cluster, keyword, value, ts FROM og QUALIFY row_number() OVER (PARTITION BY hadm_id, cluster, keyword ORDER BY list_position(['Admission', 'Discharge', 'Unknown'], ts)) = 1)
SELECT * FROM bt UNION ALL SELECT *, 'objective' FROM oo WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.hadm_id = oo.hadm_id AND bt.cluster = oo.cluster AND bt.keyword = oo.keyword)""")
def hybrid_merge(s, d):
    return M.hybrid(S.sanitize(lines(s, d), "all"), md(s, d))


_SECTION_TEXTS = """SELECT k AS hadm_id,
  concat('ADM: BP=', 90 + k % 70, '/', 50 + k % 40, '; SpO2=', 85 + k % 15, '% RA; Heart Rate=', 50 + k % 90, '*; Foo=1', chr(10), 'DC: Weight=', 100 + k % 100, ' lbs ', 40 + k % 60, ' kg') AS vitals,
  concat('Hgb=', 7 + k % 8, ' g; UREA N=', k % 60, '; ASA=NEG; Na=1; Na=', 128 + k % 20) AS labs,
  concat('Medication Count=', k % 20, ' pills', chr(10), 'Polypharmacy=', CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN 'No' WHEN 2 THEN 'n/a' ELSE 'maybe' END, chr(10), 'Other=1') AS medications,
  CASE k % 4 WHEN 0 THEN concat('Home w services', chr(10), 'clear') WHEN 1 THEN concat('Disposition: extended', chr(10), 'mental=Lethargic', chr(10), 'Disposition=home') WHEN 2 THEN '' ELSE concat('Disposition=not stated', chr(10), 'rehab', chr(10), 'support=cane') END AS disposition,
  CASE k % 5 WHEN 0 THEN concat('Surgery=no', chr(10), 'Dialysis=1') WHEN 1 THEN concat('Surgery=no', chr(10), 'Dialysis=0') WHEN 2 THEN 's/p appendectomy' WHEN 3 THEN concat('intubated for ', k % 9, ' days') ELSE '' END AS procedures,
  CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN concat('Age=', k % 90) ELSE concat('Sex=M', chr(10), 'Age=', k % 90, chr(10), 'rest') END AS demographics
FROM (SELECT c_custkey AS k FROM customer) c"""
_NS = "not stated"


@query(f"""SELECT k AS hadm_id, concat('ADM: Heart Rate=', 50 + k % 90, '; Systolic BP=', 90 + k % 70, '; Diastolic BP=', 50 + k % 40, '; SpO2=', 85 + k % 15, chr(10), 'DC: Weight=', 40 + k % 60) AS vitals, concat('Hemoglobin=', 7 + k % 8, '; Sodium=', 128 + k % 20, '; BUN=', k % 60) AS labs,
  concat('Medication Count=', k % 20, chr(10), 'New Medications Count={_NS}', chr(10), 'Polypharmacy=', CASE k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '{_NS}' ELSE 'maybe' END, {", ".join(f"chr(10), '{x}={_NS}'" for x in C.STRICT_KEYWORDS["MEDICATIONS"][3:])}) AS medications,
  CASE k % 4 WHEN 2 THEN '{_NS}' ELSE concat('Discharge Disposition=', CASE k % 4 WHEN 0 THEN 'Home with Services' WHEN 1 THEN 'SNF' ELSE 'Rehab' END, chr(10), 'Mental Status=', CASE k % 4 WHEN 0 THEN 'alert' WHEN 1 THEN 'lethargic' ELSE '{_NS}' END, chr(10), 'Support Needs=', CASE k % 4 WHEN 3 THEN 'cane' ELSE '{_NS}' END) END AS disposition,
  concat('Any Procedure=', CASE k % 5 WHEN 0 THEN 'no' WHEN 2 THEN 'no' WHEN 3 THEN 'yes' ELSE '{_NS}' END, chr(10), 'Surgery=', CASE k % 5 WHEN 0 THEN 'no' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' ELSE '{_NS}' END, chr(10), 'Dialysis=', CASE k % 5 WHEN 0 THEN 'done' WHEN 2 THEN 'no' WHEN 3 THEN 'no' ELSE '{_NS}' END, chr(10), 'Mechanical Ventilation=', CASE k % 5 WHEN 0 THEN 'no' WHEN 2 THEN 'no' WHEN 3 THEN (k % 9)::VARCHAR ELSE '{_NS}' END) AS procedures,
  CASE k % 3 WHEN 0 THEN concat('Sex=female', chr(10), 'Age={_NS}') WHEN 1 THEN concat('Sex={_NS}', chr(10), 'Age=', k % 90) ELSE concat('Sex=male', chr(10), 'Age=', k % 90) END AS demographics FROM (SELECT c_custkey AS k FROM customer) c""")
def stage1_sections(s, d):
    return G1.canonical_sections(A.from_sql(s, d, _SECTION_TEXTS))


@query(f"""WITH {Q.sanitized(A.LINES, 'all')} SELECT hadm_id, coalesce(string_agg(DISTINCT keyword, ',' ORDER BY keyword) FILTER (NOT {Q.strict_ok('cluster', 'keyword')}), '') AS outside, CASE WHEN count(*) FILTER ({Q.within('cluster', list(C.STRICT_KEYWORDS))}) > 0 THEN count(*) FILTER ({Q.within('cluster', list(C.STRICT_KEYWORDS))} AND {Q.strict_ok('cluster', 'keyword')}) / count(*) FILTER ({Q.within('cluster', list(C.STRICT_KEYWORDS))})::DOUBLE ELSE 1.0 END AS compliance FROM clean GROUP BY hadm_id""")
def keyword_report(s, d):
    return G1.keyword_report(S.sanitize(lines(s, d), "all"))


# --- gates, runs and reports -----------------------------------------------------------------------


#: Runs of documents with what the gates look at, one per customer.
_RUNS = """SELECT k AS hadm_id, k % 150 <> 7 AS json_ok, CASE WHEN k % 9 = 0 THEN 'a ___' ELSE 'a' END AS raw_model, CASE WHEN k % 97 = 5 THEN '___' ELSE 'b' END AS raw, CASE WHEN k % 31 = 3 THEN 'x ___' ELSE 'x' END AS summary,
  concat('ADM: Heart Rate=', 50 + k % 90, '; SpO2=', 90 + k % 9, CASE WHEN k % 17 = 2 THEN '%' WHEN k % 19 = 4 THEN ' RA' ELSE '' END, chr(10), 'DC: Respiratory Rate=18') AS vitals, concat('Sodium=', CASE WHEN k % 23 = 1 THEN 'high' ELSE '138' END, '; BUN=Not Stated') AS labs,
  concat('Discharge Disposition=Home', chr(10), 'Mental Status=', CASE k % 5 WHEN 0 THEN 'Alert' WHEN 1 THEN 'confused' WHEN 2 THEN 'not stated' WHEN 3 THEN 'oriented' ELSE CASE WHEN k % 37 = 6 THEN 'odd' ELSE 'lethargic' END END) AS disposition,
  CASE WHEN k % 41 = 8 THEN 0 ELSE 3 END AS n_facts, concat('LABS|Na|1|Past', chr(10), CASE WHEN k % 13 = 0 THEN 'LABS|Na|1|Past' ELSE 'LABS|K|4|Past' END, chr(10), CASE WHEN k % 3 = 0 THEN 'odd|line' ELSE 'VITALS|HR|80|Past' END) AS lines FROM (SELECT c_custkey AS k FROM customer) c"""


@query(f"""WITH r AS ({_RUNS}), p AS (SELECT json_ok AS parse, contains(raw_model, '___') AS model_placeholder, contains(raw, '___') AS placeholder, contains(summary, '___') AS normalized_placeholder, contains(disposition, 'odd') AS bad_mental,
  contains(vitals, '%') OR contains(vitals, ' RA') OR contains(labs, 'high') AS nonnumeric, n_facts > 0 AS success, hadm_id % 13 = 0 AS duplicate FROM r),
a AS (SELECT count(*) AS n_docs, {", ".join(f"round(count(*) FILTER ({c}) / count(*)::DOUBLE, 6) AS {c}_rate" for c in ("parse", "model_placeholder", "placeholder", "normalized_placeholder", "bad_mental", "nonnumeric", "success"))}, count(*) FILTER (duplicate) AS duplicate_docs FROM p)
SELECT *, parse_rate >= 0.99 AS parse_ok, placeholder_rate <= 0 AS placeholder_ok, bad_mental_rate <= 0 AS mental_ok, nonnumeric_rate <= 0 AS numeric_ok, success_rate >= 0.95 AS success_ok, parse_rate >= 0.99 AND placeholder_rate <= 0 AND bad_mental_rate <= 0 AND nonnumeric_rate <= 0 AND success_rate >= 0.95 AS passed FROM a""")
def gates(s, d):
    return G.offline_gates(A.from_sql(s, d, _RUNS).withColumn("lines", F.split("lines", "\n")))


@query(f"""WITH r AS ({_RUNS}) SELECT hadm_id, true AS parse_success, length(disposition) AS input_char_len, (length(vitals) // 4)::INT AS stage1_tokens, 3 AS lines_extracted, CASE WHEN hadm_id % 3 = 0 THEN 'LABS' ELSE 'LABS,VITALS' END AS clusters_present,
  CASE WHEN hadm_id % 3 = 0 THEN 'LABS=2' ELSE 'LABS=2,VITALS=1' END AS cluster_counts, CASE WHEN hadm_id % 3 = 0 THEN 0.666667 ELSE 1.0 END::DOUBLE AS valid_ratio, true AS all_clusters_valid FROM r""")
def run_summary(s, d):
    x = A.from_sql(s, d, _RUNS)
    return G.run_summary(x.select("hadm_id", F.col("disposition").alias("note"), F.col("vitals").alias("summary"), F.split("lines", "\n").alias("lines")))


@query("""WITH w AS (SELECT o_orderkey AS hadm_id FROM orders WHERE o_orderkey % 4 <> 0), a AS (SELECT o_orderkey AS hadm_id, floor(epoch(o_orderdate))::BIGINT AS mtime FROM orders WHERE o_orderkey % 3 = 0),
d AS (SELECT a.* FROM a JOIN w USING (hadm_id)), m AS (SELECT count(*) AS done, count(*) FILTER (mtime > 800000000) AS nw, arg_min(hadm_id, mtime * 10000000 + hadm_id) AS oldest, arg_max(hadm_id, mtime * 10000000 + hadm_id) AS newest, min(mtime) AS f, max(mtime) AS t FROM d), x AS (SELECT m.*, (SELECT count(*) FROM w) AS total, nw / (1000000000.0 - 800000000.0)::DOUBLE * 60 AS rw, done / (1000000000 - f)::DOUBLE * 60 AS ra FROM m)
SELECT total, done, round(done * 100.0 / total, 4) AS percent, oldest, newest, round(1000000000 - t, 4)::DOUBLE AS age, round(rw, 6) AS rate_window, round((total - done) / rw, 4) AS eta_window, round(ra, 6) AS rate_avg, round((total - done) / ra, 4) AS eta_avg FROM x""")
def run_monitor(s, d):
    o = read(s, d, "orders")
    done = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("hadm_id"), F.unix_timestamp("o_orderdate").alias("mtime"))
    return G.monitor(o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("hadm_id")), done, F.lit(1e9), F.lit(8e8))


_OUTPUTS = "SELECT concat('model-', k % 3) AS model, (k % 7)::BIGINT AS seconds, concat(CASE WHEN k % 2 = 0 THEN '# facts' ELSE '```' END, chr(10), 'labs|Na|', k % 50, '|Past', chr(10), CASE WHEN k % 3 = 1 THEN 'prose' ELSE 'VITALS|HR|80|Past' END) AS raw FROM (SELECT c_custkey AS k FROM customer) c"


@query(f"WITH o AS ({_OUTPUTS}) SELECT model, sum(CASE WHEN contains(raw, 'prose') THEN 1 ELSE 2 END)::BIGINT AS fact_count, CASE WHEN model = 'model-1' THEN 'LABS' ELSE 'LABS,VITALS' END AS clusters, sum(seconds)::BIGINT AS seconds, round(sum(CASE WHEN contains(raw, 'prose') THEN 1 ELSE 2 END) / (2.0 * count(*)), 6)::DOUBLE AS format_validity FROM o GROUP BY model")
def model_comparison(s, d):
    return CL.compare(A.from_sql(s, d, _OUTPUTS.replace("(k % 7)::BIGINT", "CAST(k % 7 AS BIGINT)")))


@query("""WITH c AS (SELECT conv_id, turn, text, 'm_1__' || role || '__' || left(md5(role), 8) || '_' || left(md5(text), 8) AS key FROM conversations), e AS (SELECT key, arg_max(raw, n) AS raw FROM (SELECT key, 'r' || text AS raw, conv_id * 1000 + turn AS n FROM c WHERE turn % 2 = 0) x GROUP BY key)
SELECT conv_id, turn, e.raw, e.raw IS NOT NULL AS is_cached FROM c LEFT JOIN e USING (key)""")
def cached_results(s, d):
    x = read(s, d, "conversations").select("conv_id", "turn", F.lit("m.1").alias("model"), F.col("role").alias("case_id"), F.col("role").alias("prompt"), F.col("text").alias("note"))
    cache = CL.cache_entries(x.filter("turn % 2 = 0").withColumn("raw", F.concat(F.lit("r"), "note")), F.col("conv_id") * 1000 + F.col("turn"))
    return CL.with_cache(x, cache).select("conv_id", "turn", "raw", "is_cached")


@query(f"""WITH a AS ({A.LINES}), u AS (SELECT hadm_id, row_number() OVER (PARTITION BY hadm_id ORDER BY s, pos) AS pos, line FROM (SELECT hadm_id, 1 AS s, pos, line FROM a WHERE pos % 3 = 0 UNION ALL SELECT hadm_id, 2, pos, line FROM a WHERE pos % 2 = 0) x), {Q.normalized('SELECT * FROM u')} SELECT {COLS} FROM best""")
def two_stage_union(s, d):
    x = lines(s, d)
    return B.run_stages(x, lambda n: n.filter("pos % 3 = 0"), lambda n: n.filter("pos % 2 = 0")).select(*FACT)


@query(f"WITH {Q.normalized(A.LINES)} SELECT hadm_id, count(*) AS n_facts, count(DISTINCT cluster) AS n_clusters, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters, round(coalesce(count(*) FILTER (cluster IN ('VITALS', 'LABS') AND regexp_full_match(value, '-?[0-9]+(?:\\.[0-9]+)?')) / nullif(count(*) FILTER (cluster IN ('VITALS', 'LABS')), 0)::DOUBLE, 0), 6) AS numeric_rate FROM best GROUP BY hadm_id")
def gate_summary(s, d):
    return G.gate_summary(N.normalize(lines(s, d)))


@query("WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS t FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS t FROM orders WHERE o_orderkey % 7 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'different' END AS kind FROM a FULL JOIN b ON a.id = b.id WHERE a.t IS DISTINCT FROM b.t")
def ab_diff(s, d):
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("t"))
    b = o.filter("id % 7 <> 0").withColumn("t", F.when(F.col("id") % 3 == 0, F.upper("t")).otherwise(F.col("t")))
    return G.ab_diff(o.filter("id % 5 <> 0"), b, ["id"], "t")


@query("""WITH x AS (SELECT count(*) AS n_total, count(*) FILTER (event_type = 'purchase') AS n_done, round((floor(max(epoch(ts)) FILTER (event_type = 'purchase')) - floor(min(epoch(ts)))) / 60.0, 4) AS minutes FROM events)
SELECT n_total, n_done, minutes, round(n_done / minutes, 6) AS rate_per_min, round((n_total - n_done) / (n_done / minutes), 4) AS eta_min FROM x""")
def progress_eta(s, d):
    return G.progress(read(s, d, "events"), F.count("*"), F.col("event_type") == "purchase", F.col("ts"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, (length(text) - 600) // 2 + 1, 600) END AS trimmed FROM documents")
def trim_middle(s, d):
    return read(s, d, "documents").select("doc_id", T.trim_middle(F.col("text"), 600).alias("trimmed"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 250) || chr(10) || chr(10) || right(text, 250) END AS trimmed FROM documents")
def trim_headtail(s, d):
    return read(s, d, "documents").select("doc_id", T.trim_head_tail(F.col("text"), 500).alias("trimmed"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), m AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM l)
SELECT doc_id, pos::INT AS pos, rtrim(left(trim(regexp_replace(replace(line, '|', ' '), '\\s+', ' ', 'g')), 240)) AS evidence FROM m WHERE regexp_matches(line, '[0-9]') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 6""")
def evidence_lines(s, d):
    return T.evidence_lines(read(s, d, "documents"), "[0-9]", 6, "doc_id")


#: One note per customer, of phrases the rule-based extractor knows and some it must not take.
_PH = [
    "CASE WHEN k % 3 = 0 THEN 'female. ' WHEN k % 3 = 1 THEN 'Male. ' ELSE 'unmale. ' END", "CASE WHEN k % 4 <> 0 THEN concat('HR: ', 50 + k % 90, ', ') ELSE 'pulse irregular, ' END", "CASE WHEN k % 5 <> 0 THEN concat('BP ', 90 + k % 70, '/', 50 + k % 40, '; ') ELSE '' END",
    "concat('Temp ', 36 + k % 4, '.', k % 10, ' SpO2=', 85 + k % 15, '% ')", "CASE WHEN k % 2 = 0 THEN concat('Hgb ', 7 + k % 8, ', WBC ', 3 + k % 15, ', Plt ', 80 + k % 300, ', Na ', 128 + k % 20, ', K ', 3 + k % 3, ', Cr ', k % 6, '.', k % 9, '. ') ELSE 'Labs pending. ' END",
    "CASE k % 6 WHEN 0 THEN 'History of CHF and diabetes. ' WHEN 1 THEN 'COPD, hypertension. ' WHEN 2 THEN 'No dyspnea, no Fever. ' WHEN 3 THEN 'Chest Pain with edema. ' WHEN 4 THEN 'On warfarin and insulin; s/p surgery. ' ELSE 'intubated, dialysis started. ' END",
    "CASE k % 5 WHEN 0 THEN 'Discharged home, alert and oriented.' WHEN 1 THEN 'To SNF, confused.' WHEN 2 THEN concat(k % 7, ' prior admissions in 12 months.') WHEN 3 THEN concat('LOS: ', k % 20) ELSE concat(k % 4, ' ED visits in last 6 months') END",
]
NOTES_SQL = f"SELECT k AS hadm_id, concat('Patient is a ', 20 + k % 75, ' year-old ', {', '.join(_PH)}) AS text FROM (SELECT c_custkey AS k FROM customer) c"
_NUMR = " UNION ALL ".join(f"SELECT hadm_id, {i + 1} AS pos, {Q.lit(c)} AS cluster, {Q.lit(k)} AS keyword, nullif(regexp_extract(text, {Q.lit(p)}, {g}, 'i'), '') AS value, {Q.lit(t)} AS ts FROM nt" for i, (c, k, p, g, t) in enumerate(T.NUMBER_RULES))
_WRDR = " UNION ALL ".join(f"SELECT hadm_id, {len(T.NUMBER_RULES) + i + 1}, {Q.lit(c)}, {Q.lit(k)}, CASE {' '.join(f'WHEN regexp_matches(lower(text), {Q.lit(p)}) THEN {Q.lit(v)}' for p, v in rules)} END, {Q.lit(t)} FROM nt" for i, (c, k, rules, t) in enumerate(T.WORD_RULES))
_NOTE_FACTS = f"SELECT hadm_id, pos, cluster, keyword, value, ts FROM (SELECT * FROM ({_NUMR} UNION ALL {_WRDR}) a) b WHERE value IS NOT NULL"


def _notes(s, d):
    return A.from_sql(s, d, NOTES_SQL)


@query(f"WITH nt AS ({NOTES_SQL}) SELECT hadm_id, pos::BIGINT AS pos, 0 AS sub_pos, cluster, keyword, value, ts FROM ({_NOTE_FACTS}) x")
def note_extract(s, d):
    return T.extract(_notes(s, d))


_NOTE_RF = _scored(f"SELECT hadm_id, pos, concat_ws('|', cluster, keyword, value, ts) AS line FROM best")


@query(f"WITH nt AS ({NOTES_SQL}), {Q.normalized(f'SELECT hadm_id, pos, concat_ws(chr(124), cluster, keyword, value, ts) AS line FROM ({_NOTE_FACTS}) x')}, {_RESULT.replace(_RF, _NOTE_RF)} SELECT * FROM result")
def note_risk(s, d):
    """The flagship: notes to facts to canonical facts to risk scores."""
    return R.results(R.parse(N.render(N.normalize(N.render(T.extract(_notes(s, d)))))))


@query("SELECT r AS reduction, sum(n * 0.01) AS readmissions, round(sum(n * 0.01 * r), 6) AS avoided, round(sum(n * 0.01 * r * 15000), 4) AS saved FROM (SELECT count(*)::DOUBLE AS n FROM orders) o, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.08::DOUBLE)) AS v(r) GROUP BY r")
def impact_scenarios(s, d):
    base = read(s, d, "orders").agg(F.count("*").cast("double").alias("discharges")).withColumns({"rate": F.lit(0.01), "cost": F.lit(15000.0)})
    return G.impact(base).select("reduction", "readmissions", F.round("avoided", 6).alias("avoided"), F.round("saved", 4).alias("saved"))


@query("SELECT conv_id, turn, replace(replace('org/model-1.5', '/', '_'), '.', '_') || '__' || role || '__' || left(md5(role), 8) || '_' || left(md5(text), 8) AS cache_key FROM conversations")
def cache_key(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", G.cache_key(F.lit("org/model-1.5"), F.col("role"), F.col("role"), F.col("text")).alias("cache_key"))


@query("SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt_sha256 FROM conversations GROUP BY conv_id")
def prompt_assembly(s, d):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))), lambda x: x["t"]), "\n")
    return read(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sha2(joined, 256).alias("prompt_sha256"))


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_windows(s, d):
    return P.daily_counts(read(s, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sn FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM h GROUP BY user_id, sn""")
def event_sessions(s, d):
    return P.sessions(read(s, d, "events"))


@query("SELECT quality, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 9) AS toxic_rate, count(*) AS n, count(*) FILTER (length(text) > 1000) AS n_long FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def label_metrics(s, d):
    x = read(s, d, "documents").join(read(s, d, "labels"), "doc_id")
    return x.groupBy("quality").agg(F.round(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)), 9).alias("toxic_rate"), F.count("*").alias("n"), F.count_if(F.length("text") > 1000).alias("n_long"))


@query(f"WITH {_RESULT} SELECT hadm_id, composite_score, CASE WHEN n_facts_parsed > 0 THEN probability END AS probability FROM (SELECT * FROM result WHERE n_facts_parsed > 0) r")
def risk_or_none(s, d):
    x = R.results(scored(s, d))
    return R.or_none(x.filter("n_facts_parsed > 0"), x).select("hadm_id", "composite_score", "probability")


from . import files, runs, texts  # noqa: E402, F401 - they add their queries to those above
