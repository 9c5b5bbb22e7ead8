"""Queries of runs: streams, generation, records, rule tables, listings and uploads, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import config as C
from ..operators import concepts as K
from ..operators import evaluate as E
from ..operators import gates as G
from ..operators import generation as L
from ..operators import normalize as N
from ..operators import notes as T
from ..operators import records as D
from ..operators import recover as V
from ..operators import risk as R
from ..operators import rules as U
from ..sources import adapter as A
from ..sources import readers, tables, uploads
from ..streaming import monitor as M
from . import queries as Q
from . import sqltext as X

query, read, lines = Q.query, Q.read, Q.lines


# --- a stream of artifacts ---------------------------------------------------------------------------

#: What an event is to a run, and how many done artifacts end it.
_KIND = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'retry' ELSE 'other' END"
_TOTALS = "SELECT user_id % 16 AS run, CAST(CASE user_id % 16 % 3 WHEN 0 THEN count(*) WHEN 1 THEN count(*) // 2 + 1 ELSE count(*) * 2 END AS BIGINT) AS n_total FROM events WHERE event_type = 'purchase' GROUP BY user_id % 16"
_STALL = 43_200


@query(f"""WITH t AS ({_TOTALS}), e AS (SELECT user_id % 16 AS run, event_id, ts, {_KIND} AS kind FROM events),
o AS (SELECT e.*, n_total, sum((kind = 'done')::INT) OVER (PARTITION BY run ORDER BY ts, event_id) AS upto FROM e JOIN t USING (run)),
k AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY run) AS last FROM o WHERE upto - (kind = 'done')::INT < n_total),
s AS (SELECT run, any_value(n_total) AS n_total, count(*) FILTER (kind = 'done') AS done, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'retry') AS retries, min(ts) AS started, max(ts) AS seen, any_value(last) AS last, min(epoch_us(ts)) AS first,
  count(*) FILTER (kind = 'done' AND epoch_us(ts) // 60000000 > last // 60000000 - {M.WINDOW}) AS recent FROM k GROUP BY run),
r AS (SELECT *, CASE WHEN done >= 2 THEN done / ((last - first) / 60e6) END AS ra, (SELECT max(epoch_us(ts)) FROM events) - 600000000 AS mark FROM s)
SELECT run, n_total, done, errors, retries, started, seen, done >= n_total AS finished, done < n_total AND last // 1000 + {_STALL * 1000} <= mark // 1000 AS stalled, round(ra, 6) AS rate_avg, round(recent / {float(M.WINDOW)}::DOUBLE, 6) AS rate_window, round(CASE WHEN n_total > done THEN (n_total - done) / ra END, 4) AS eta_min FROM r""")
def run_progress(s, d):
    """Events as a stream of artifacts of 16 runs, followed with state and timers into a sink of batches."""
    events = s.read.parquet(f"{d}/events.parquet")
    totals = s.sql(re.sub("count\\(\\*\\) // 2", "count(*) DIV 2", _TOTALS).replace("FROM events", "FROM {events}"), events=events)
    stream = s.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern, since a stream's plain path must be a folder
    artifacts = stream.selectExpr("user_id % 16 AS run", "event_id AS doc", "CAST(ts AS TIMESTAMP) AS ts", f"{_KIND} AS kind")
    place = tables.new_place(s, "progress")
    return M.run_once(M.progress_stream(artifacts, totals, "10 minutes", _STALL), f"{place}/rows", f"{place}/state")


# --- generation --------------------------------------------------------------------------------------

#: Characters of a note in its shorter form.
_SHORT = 300


def _first_client():
    """A stand-in for a server that refuses formats, fails, or answers badly, by the number of the note."""

    def answer(prompt: str, form: str | None) -> str:
        k = int(re.match(r"NOTE (\d+)", prompt)[1]) % 12
        asked = next((n for n, s in L.SUFFIXES.items() if prompt.endswith(s)), None)
        if k == 9 or k == 0 and "(middle)" not in prompt or k == 1 and form == "schema" or k == 2 and form is not None:
            raise RuntimeError(f"refused {form}")
        whole = f'note: {{"A": "x", "B": "{k}"}} end'
        if k == 3 and asked is None or k == 8:
            return whole.replace('"x"', '"___"')
        if k == 4 and asked is None or k == 5 and (asked is None or form is not None) or k == 6 and form != "baseline" or k == 7:
            return f'no object {{"A": "{k}'
        return whole

    return answer


_RAW = """concat('note: {"A": "', CASE k WHEN 8 THEN 'not stated' ELSE 'x' END, '", "B": "', k, '"} end')"""


@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS hadm_id, (conv_id * 1000 + turn) % 12 AS k, CASE WHEN length(text) > {_SHORT} THEN 2 ELSE 1 END AS n FROM conversations),
a AS (SELECT *, k = 9 OR k = 0 AND n = 1 AS lost FROM c)
SELECT hadm_id, CASE WHEN lost THEN NULL WHEN k = 7 THEN 'no object {{"A": "7' ELSE {_RAW} END AS raw, CASE WHEN lost THEN NULL WHEN k = 6 THEN 'baseline' WHEN k = 0 THEN 'middle' ELSE 'full' END AS variant, NOT lost AND k <> 7 AS json_ok,
  CASE k WHEN 0 THEN 2 + n WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 4 WHEN 6 THEN 2 + 3 * n WHEN 7 THEN 2 + 3 * n WHEN 8 THEN 3 WHEN 9 THEN 3 * n ELSE 1 END AS asked,
  k IN (3, 8) AS did_hygiene, k IN (4, 5, 6, 7) AS did_retry, k = 8 AS did_placeholder, k = 6 AS used_baseline FROM a""")
def stage1_generation(s, d):
    """Notes answered by a stand-in that fails on some, each asked as often as its gates say."""
    x = read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("hadm_id"), "text")
    prompt = lambda name, text: F.struct(F.lit(name).alias("name"), F.concat(F.lit("NOTE "), F.col("hadm_id").cast("string"), F.lit(f" ({name}): "), text).alias("prompt"))
    short = F.when(F.length("text") > _SHORT, prompt("middle", T.trim_middle(F.col("text"), _SHORT)))
    prompts = x.select("hadm_id", F.array_compact(F.array(prompt("full", F.col("text")), short)).alias("variants"))
    place = tables.new_place(s, "answers")
    made = L.once_written(prompts, lambda rows: L.first_stage(rows, _first_client, ["A", "B"]), f"{place}/stage1")
    return made.select("hadm_id", "raw", "variant", "json_ok", "asked", "did_hygiene", "did_retry", "did_placeholder", "used_baseline")


def _second_client():
    def answer(prompt: str, form: str | None) -> str:
        k = int(re.match(r"NOTE (\d+)", prompt)[1])
        if k % 6 == 1 or k % 6 == 0 and not prompt.endswith(L.SUFFIXES["failsafe"]):
            return "Here is a plan.\nIt has no facts."
        return f"LABS|Sodium|{100 + k % 50}|Admission\nVITALS|Heart Rate|{50 + k % 90}|Discharge\nEND"

    return answer


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS k FROM conversations)
SELECT k AS hadm_id, CASE WHEN k % 6 = 1 THEN 'Here is a plan.' || chr(10) || 'It has no facts.' ELSE concat('LABS|Sodium|', 100 + k % 50, '|Admission', chr(10), 'VITALS|Heart Rate|', 50 + k % 90, '|Discharge', chr(10), 'END') END AS raw, k % 6 = 0 AS did_retry FROM c""")
def stage2_generation(s, d):
    """Outputs without facts are asked for once more, in a second job over those documents alone."""
    x = read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("hadm_id"), "text")
    prompts = x.select("hadm_id", F.concat(F.lit("NOTE "), F.col("hadm_id").cast("string"), F.lit(": "), "text").alias("prompt"))
    return L.second_stage(prompts, _second_client, V.extract_facts, tables.new_place(s, "answers"))


# --- records -----------------------------------------------------------------------------------------


@query(f"""WITH nt AS ({Q.NOTES_SQL}), f AS ({Q._NOTE_FACTS}), {X.normalized("SELECT hadm_id, pos, concat_ws(chr(124), cluster, keyword, value, ts) AS line FROM f")}
SELECT 'extract' AS stage, (SELECT count(*) FROM nt) AS docs, (SELECT count(*) FROM f) AS rows, (SELECT count(*) FROM f WHERE ts = 'Admission') AS admissions
UNION ALL SELECT 'normalize', (SELECT count(*) FROM f), (SELECT count(*) FROM best), (SELECT count(*) FROM best WHERE ts = 'Admission')""")
def run_records(s, d):
    """What two stages were given and wrote, counted by the jobs that wrote it."""
    stages = [("extract", T.extract), ("normalize", lambda facts: N.normalize(N.render(facts)).select(*Q.FACT))]
    made = D.run_stages(Q._notes(s, d), stages, tables.new_place(s, "run"), {"admissions": F.count_if(F.col("ts") == "Admission")})
    return s.createDataFrame([(r["stage"], r["docs"], r["rows"], r["admissions"]) for r in made], "stage string, docs long, rows long, admissions long")


@query(f"""WITH {Q._details(False, True)}, wt AS (SELECT DISTINCT hadm_id FROM ({Q._TRUTH_SQL}) z), c AS (SELECT hadm_id, {Q._CNT} FROM det WHERE hadm_id IN (SELECT hadm_id FROM wt) GROUP BY hadm_id), m AS (SELECT *, {Q._RAT} FROM c),
x AS (SELECT hadm_id, {' + '.join(f'{w}::DOUBLE * {Q._f1(c)}' for c, w in C.CLUSTER_WEIGHTS.items())} - {C.LAMBDA_FN}::DOUBLE * count(*) FILTER (outcome = 'fn' AND {X.within('cluster', C.CRITICAL_FN)}) - {C.LAMBDA_FP}::DOUBLE * count(*) FILTER (outcome = 'fp' AND {X.within('cluster', C.CRITICAL_FP)}) AS score FROM det GROUP BY hadm_id),
n AS (SELECT hadm_id, count(*) AS stage2_lines FROM best GROUP BY hadm_id)
SELECT m.hadm_id, CASE WHEN m.hadm_id % 7 = 0 THEN 'unknown' WHEN m.hadm_id % 5 <> 0 THEN 'yes' ELSE 'no' END AS stage1_json_ok, stage2_lines, precision, recall, f1, tp, fp, fn, round(score, 9) AS downstream_score_nogate FROM m JOIN x USING (hadm_id) JOIN n USING (hadm_id)""")
def stage2_summary(s, d):
    """The row of each document of a run, as the summary table holds it."""
    facts = tables.kept(N.normalize(Q.lines(s, d)), tables.new_place(s, "facts"))  # a run's facts are a table, which six branches read
    pred, truth = Q._sides(s, d, facts)
    ok = pred.select("hadm_id").distinct().filter("hadm_id % 7 <> 0").withColumn("json_ok", F.col("hadm_id") % 5 != 0)
    return D.stage2_rows(pred, truth, ok, semantic=True).withColumn("downstream_score_nogate", F.round("downstream_score_nogate", 9))


@query(f"""WITH {X.normalized(A.LINES)}, t AS (SELECT cluster, ts, count(*) AS n FROM best GROUP BY ALL)
SELECT '| cluster | ts | n |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT concat('| ', cluster, ' | ', ts, ' | ', n, ' |') FROM t""")
def summary_table(s, d):
    rows = N.normalize(lines(s, d)).groupBy("cluster", "ts").agg(F.count("*").alias("n"))
    return D.table_lines(rows, ["cluster", "ts", "n"], ["cluster", "ts"])


_FIRST5 = "coalesce(array_to_string((list(s ORDER BY pos) FILTER ({0}))[1:5], chr(10)), '')"


@query(f"""WITH l AS (SELECT hadm_id, pos, trim(line) AS s, list_transform(string_split(trim(line), '|'), lambda x: trim(x)) AS p FROM ({A.LINES}) z WHERE trim(line) <> ''),
b AS (SELECT *, lower(s) = 'end' AS e, coalesce(len(p) = 3 AND lower(p[2]) = 'not stated', false) AS u, len(p) = 4 AND len(list_filter(p, lambda x: x = '')) = 0 AS v FROM l)
SELECT hadm_id, count(*) FILTER (NOT e AND NOT u AND NOT v) AS raw_invalid_lines, {_FIRST5.format('NOT e AND NOT u AND NOT v')} AS invalid, {_FIRST5.format('NOT e AND u')} AS unstated FROM b GROUP BY hadm_id""")
def format_examples(s, d):
    x = E.with_examples(lines(s, d))
    return x.select("hadm_id", "raw_invalid_lines", F.array_join("raw_invalid_examples", "\n").alias("invalid"), F.array_join("raw_kvt3_not_stated_examples", "\n").alias("unstated"))


# --- rule tables and concepts ------------------------------------------------------------------------

_RANGED = [(c, k) for c, k, _ in A._SCALED]
_NTH = lambda i: "CASE p_partkey % {0} {1} END".format(len(_RANGED), " ".join(f"WHEN {j} THEN {X.lit(x[i])}" for j, x in enumerate(_RANGED)))
#: Parts as rules: twenty keys, with ranges that overlap.
_RULES = f"SELECT {_NTH(0)} AS cluster, {_NTH(1)} AS keyword, p_partkey AS ord, CAST(p_partkey * 7 % 180 AS DOUBLE) AS lo, CAST(p_partkey * 7 % 180 + p_size % 13 AS DOUBLE) AS hi, CAST(p_partkey % 9 AS INT) AS points FROM part"


@query(f"WITH {Q._RF}, rules AS ({_RULES}) SELECT rf.hadm_id, rf.pos, rf.sub_pos, rf.cluster, rf.keyword, coalesce(arg_min(points, ord), 0) AS points FROM rf LEFT JOIN rules ON rules.cluster = rf.cluster AND rules.keyword = rf.keyword AND value_num BETWEEN lo AND hi WHERE is_numeric GROUP BY ALL")
def rule_points(s, d):
    """Facts scored by rules that a table holds: the first range that holds a value counts."""
    rules = s.sql(_RULES.replace("FROM part", "FROM {part}"), part=s.read.parquet(f"{d}/part.parquet"))
    return U.with_points(Q.scored(s, d).filter("is_numeric"), U.index(rules)).na.fill(0, ["points"]).select("hadm_id", "pos", "sub_pos", "cluster", "keyword", "points")


@query(f"WITH {Q._SCORES} SELECT * FROM cs")
def risk_scores_by_table(s, d):
    """The cluster scores with ranges read from a table and concepts found by one automaton."""
    return R.cluster_scores(Q.scored(s, d), U.index(U.from_config(s)), K.from_config())


@query(Q.SQL["concept_match"])
def concept_automaton(s, d):
    return K.with_groups(Q.scored(s, d).filter("NOT dropped AND cluster IN ('PROBLEMS', 'SYMPTOMS')").select("cluster", "keyword").distinct())


# --- texts and files ---------------------------------------------------------------------------------

_ESCAPED = r"""replace(replace(regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B\x0C\x0E-\x1F]', ' ', 'g'), chr(92), chr(92) || chr(92)), '"', chr(92) || '"')"""
_OBJECT = lambda body: f"""concat('{{"doc_id": ', doc_id, ', "text": "', {body}, '"}}')"""
_BROKEN = f"replace(replace({_ESCAPED}, chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"


@query(f"SELECT doc_id, {_OBJECT(_BROKEN)} AS object FROM documents")
def json_object(s, d):
    """Objects found inside raw output, with line breaks in strings or with more text behind them."""
    x = read(s, d, "documents")
    spark_sql = lambda sql: sql.replace(r"\x", r"\\x").replace(", 'g')", ")")
    raw = f"CASE WHEN doc_id % 2 = 0 THEN concat('answer: ', {_OBJECT(_ESCAPED)}, ' done') ELSE concat('answer: ', {_OBJECT(_BROKEN)}, ' and {{\"b\": 2}}') END AS raw"
    return x.selectExpr("doc_id", spark_sql(raw)).select("doc_id", V.first_json_object(F.col("raw")).alias("object"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def uploaded_files(s, d):
    """Documents as files of five kinds, read back."""
    ending = "CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.json' WHEN 3 THEN '.csv' ELSE '.docx' END"
    named = read(s, d, "documents").selectExpr("coalesce(text, '') AS text", f"concat('u/', doc_id, {ending}) AS name")
    return uploads.texts_of(uploads.packed(named, "name", "text")).selectExpr("CAST(regexp_extract(path, '/([0-9]+)[.]', 1) AS BIGINT) AS doc_id", "text")


@query("SELECT (SELECT count(DISTINCT c_custkey % 50) FROM customer) AS total, count(DISTINCT o_custkey % 40) AS done, round(count(DISTINCT o_custkey % 40) * 100.0 / (SELECT count(DISTINCT c_custkey % 50) FROM customer), 4)::DOUBLE AS percent FROM orders WHERE o_custkey % 40 IN (SELECT c_custkey % 50 FROM customer)")
def artifact_listing(s, d):
    """Orders as artifacts, one file for each of forty documents; names and times alone are read back."""
    root = f"{tables.new_place(s, 'artifacts')}/run"
    rows = read(s, d, "orders").select((F.col("o_custkey") % 40).alias("hadm_id"), F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("value"))
    rows.repartition("hadm_id").write.partitionBy("hadm_id").text(root)
    wanted = read(s, d, "customer").select((F.col("c_custkey") % 50).alias("hadm_id")).distinct()
    return G.monitor(wanted, readers.listing(s, root, "*.txt"), F.lit(2e9), F.lit(1e9)).select("total", "done", "percent")
