"""Rules by hand-written cases, and properties of the normalizer."""

import pytest
from pyspark.sql import functions as F

from factweave import config as C
from factweave.operators import evaluate as E
from factweave.operators import markdown as M
from factweave.operators import normalize as N
from factweave.operators import notes as T
from factweave.operators import risk as R
from factweave.operators import sanitize as S
from factweave.operators import synonyms as Y
from factweave.streaming import progress as P


def frame(spark, lines, doc=1):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(lines)], "hadm_id long, pos long, line string")


def facts(df):
    return [f"{r.cluster}|{r.keyword}|{r.value}|{r.ts}" for r in df.orderBy("pos", "sub_pos").collect()]


@pytest.mark.parametrize(
    "line, out",
    [
        ("VITALS|BP|120/80|Unknown", ["VITALS|Systolic BP|120|Unknown", "VITALS|Diastolic BP|80|Unknown"]),
        ("LABS|Hgb|9.8 g/dL|ADM", ["LABS|Hemoglobin|9.8|Admission"]),
        ("LABS|HGB|9.8|Admission", []),
        ("PROCEDURES|Mechanical Ventilation|yes|Unknown", ["PROCEDURES|Mechanical Ventilation|yes|Admission"]),
        ("SYMPTOMS|Fever|present|", ["SYMPTOMS|Fever|yes|Admission"]),
        ("- **labs**|Na|130|dc", ["LABS|Sodium|130|Discharge"]),
        ("Heart Rate|67|Admission", ["VITALS|Heart Rate|67|Admission"]),
        ("LABS|Sodium|138", ["LABS|Sodium|138|Admission"]),
        ("DISPOSITION|Discharge Disposition|panama|Discharge", ["DISPOSITION|Discharge Disposition|AMA|Discharge"]),
        ("PROBLEMS|CHF|ruled  out|Unknown", ["PROBLEMS|CHF|not exist|Past"]),
        ("", []), ("no pipes", []), ("VITALS|Weight|___|Past", []), ("MEDICATIONS|Statin|10|Past", []),
    ],
)
def test_normalize(spark, line, out):
    assert facts(N.normalize(frame(spark, [line]))) == out


def test_priority_and_losers(spark):
    lines = ["LABS|Na|130|Admission", "LABS|Na|131|Past", "LABS|Na|132|Discharge", "LABS|Na|133|Discharge"]
    assert facts(N.normalize(frame(spark, lines))) == ["LABS|Sodium|132|Discharge"]
    assert N.normalize_stats(frame(spark, lines)).first().dedup_dropped == 2


def test_normalize_is_idempotent(spark, sf):
    from factweave.sources import adapter as A

    once = N.normalize(A.from_sql(spark, sf, A.LINES).filter("hadm_id < 40"))
    twice = N.normalize(N.render(once))
    key = ["hadm_id", "cluster", "keyword", "value"]
    assert once.select(*key).exceptAll(twice.select(*key)).isEmpty() and twice.select(*key).exceptAll(once.select(*key)).isEmpty()


@pytest.mark.parametrize(
    "line, out",
    [
        ("CLUSTER|VITALS|Heart Rate|67|Admission", "VITALS|Heart Rate|67|Admission"),
        ("CLUSTERS|Heart Rate|67|Admission", "VITALS|Heart Rate|67|Admission"),
        ("CLUSTER|Keyword|Value|Timestamp", None),
        ("CLUSTER|gout|chronic|Past", "PROBLEMS|gout|chronic|Past"),
        ("«LABS|Na|1|Past»", "LABS|Na|1|Past"),
    ],
)
def test_recovered_line(spark, line, out):
    assert frame(spark, [line]).select(S.recovered_line(F.col("line"))).first()[0] == out


@pytest.mark.parametrize("line, out", [("A|b|c|d", True), ("k|v|t", False), ("Category|Keyword|Value|Timestamp", False), ("x|y", False), ("A|b (c)|d|e", False), ("A||c|d", False), ("A|any symptom|c|d", False), ("A|b|c|" + "w " * 6, False)])
def test_looks_like_fact(spark, line, out):
    assert frame(spark, [line]).select(S.looks_like_fact(F.col("line"))).first()[0] is out


def test_evaluation_rules(spark):
    p = frame(spark, ["LABS|Na|110|Past", "LABS|K|111|Past", "PROBLEMS|CHF|acute|Past", "PROBLEMS|Gout|acute|Past"])
    t = frame(spark, ["LABS|Na|100|Past", "LABS|K|100|Past", "SYMPTOMS|chf|yes|Past", "LABS|BUN|1|Past"])
    got = {(r.cluster, r.keyword): (r.outcome, r.reason) for r in E.compare(p, t, semantic=True).collect() if r.outcome != "fn"}
    assert got == {("LABS", "Na"): ("tp", None), ("LABS", "K"): ("fp", "value_mismatch"), ("SYMPTOMS", "chf"): ("tp", None), ("PROBLEMS", "Gout"): ("fp", "not_in_gt")}
    assert E.compare(p, t, semantic=True).filter("outcome = 'fn'").count() == 2


def test_risk_rules(spark):
    lines = ["VITALS|Systolic BP|120/80|Admission", "PROBLEMS|Discharge Dx|CHF; COPD|Discharge", "PROBLEMS|PMH: gout|chronic|Past", "VITALS|Heart Rate|130|Past", "VITALS|Heart Rate|90|Past", "# note", "", "VITALS|x", "DEMOGRAPHICS|Age|80 years|Past"]
    rows = R.parse(frame(spark, lines)).orderBy("pos", "sub_pos").collect()
    assert [(r.keyword, r.value, r.dropped) for r in rows if r.cluster == "PROBLEMS"] == [("CHF", "acute", False), ("COPD", "acute", False), ("gout", "chronic", False)]
    assert sum(r.dropped for r in rows) == 3
    got = R.results(R.parse(frame(spark, lines))).first()
    assert got.n_facts_parsed == 5 and got.n_facts_dropped == 3 and got.composite_score == 8 + 6 + 5 + 6
    keys = spark.createDataFrame([("PROBLEMS", k) for k in ("Essential hypertension", "acute CHF", "xchfx", "nothing")], "cluster string, keyword string")
    assert {r.keyword: r.gid for r in R.with_groups(keys).collect()} == {"Essential hypertension": "hypertension", "acute CHF": "heart_failure", "xchfx": None, "nothing": None}


def test_risk_patterns(spark):
    lines = ["VITALS|Heart Rate|120|A", "VITALS|Systolic BP|90|A", "LABS|WBC|15|A", "DISPOSITION|Mental Status|Confused|A"]
    assert {r.pattern for r in R.patterns(R.parse(frame(spark, lines))).collect()} == {"sepsis_pattern", "unstable_discharge"}


def test_markdown(spark):
    md = ["## VITALS", "ADM: Heart Rate=92; Weight=not stated", "Weight=not stated", "## LABS", "not stated", "## MEDICATIONS", "Polypharmacy=yes"]
    assert [r.line for r in M.compact(frame(spark, md)).orderBy("pos").collect()] == ["## VITALS", "ADM: Heart Rate=92", "## MEDICATIONS", "Polypharmacy=yes"]
    obj = spark.createDataFrame([(1, None, "80", {"Weight": "70"}, {}, ["CHF", "chf", " "], [], [], ["a|b"], ["x", "y", "z", "w"], [])], "hadm_id long, sex string, age string, vitals map<string,string>, labs map<string,string>, pmh array<string>, discharge_dx array<string>, complications array<string>, working_dx array<string>, adm_symptoms array<string>, dc_symptoms array<string>")
    lines = [r.line for r in M.domain_markdown(obj).orderBy("pos").collect()]
    assert "Sex=not stated" in lines and "PMH/Comorbidities=CHF" in lines and "ADM symptoms=x, y, z" in lines and "Working Dx=a b" in lines


def test_note_rules(spark):
    note = "Patient is a 75 year-old female. HR: 92, BP 120/80. Sodium 138. Discharged home, alert and oriented. History of CHF."
    got = facts(T.extract(spark.createDataFrame([(1, note), (2, None), (3, "")], "hadm_id long, text string")))
    assert {"DEMOGRAPHICS|Age|75|Admission", "DEMOGRAPHICS|Sex|female|Admission", "VITALS|Systolic BP|120|Admission", "LABS|Sodium|138|Admission", "DISPOSITION|Mental Status|Normal|Discharge", "PROBLEMS|Heart Failure|chronic|Past"} <= set(got)


def test_synonyms(spark):
    row = spark.range(1).select(Y.diagnosis(F.lit(" htn ")), Y.terms_match(F.lit("CHF"), F.lit("heart failure")), Y.icd9(F.lit("42731")), Y.disposition(F.lit("SNF")), Y.symptom(F.lit("SOB"))).first()
    assert tuple(row) == ("Hypertension", True, "Atrial Fibrillation", "SNF/LTC", "Shortness of breath")


def test_stream_resumes(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.filter("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = P.watch(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "), every="1 day")
    for _ in range(2):
        P.run_once(counts, str(tmp_path / "out"), str(tmp_path / "check"))
    first = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert 0 < first <= events.count() / 2


def test_experimental_profile_recovers(spark):
    got = facts(S.sanitize(frame(spark, ["Heart Rate|67|Admission", "PROBLEMS|Discharge Dx|CHF; COPD, CHF|x"]), "all", C.EngineConfig.experimental()))
    assert got == ["VITALS|Heart Rate|67|Admission", "PROBLEMS|CHF|acute|Discharge", "PROBLEMS|COPD|acute|Discharge"]


def test_lines_are_sanitized_once(spark):
    from factweave import config as C

    lines = frame(spark, ["PROBLEMS|Discharge Dx|CHF; COPD|Discharge", "LABS|Na|1|ADM", "LABS|Na|2|Discharge"]).select(F.lit(1).alias("hadm_id"), F.lit(1).alias("pos"), "line")
    made = S.semantic_gate(S.sanitize(lines, "all", C.EngineConfig.experimental()))
    assert made._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1
    assert sorted((r.keyword, r.value) for r in made.collect()) == [("CHF", "acute"), ("COPD", "acute"), ("Na", "2")]
