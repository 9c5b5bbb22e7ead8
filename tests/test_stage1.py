"""Section texts by hand-written cases."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import stage1 as G

NO = "not stated"


@pytest.mark.parametrize(
    "f, text, out",
    [
        (G.demographics, None, f"Sex={NO}\nAge={NO}"), (G.demographics, "F", f"Sex=female\nAge={NO}"), (G.demographics, "Age=70\nx", f"Sex={NO}\nAge=70"), (G.demographics, "Sex=M\nAge=9\nrest", "Sex=male\nAge=9"),
        (G.vitals, "ADM: BP=120/80; Heart Rate=92*; SpO2=97% RA; Foo=1\nDC: Weight=180 lbs 81.6 kg", "ADM: Heart Rate=92; Systolic BP=120; Diastolic BP=80; SpO2=97\nDC: Weight=81.6"),
        (G.vitals, "Diastolic BP=169/99; Temperature=not stated", "Diastolic BP=99"), (G.vitals, "", NO), (G.vitals, "nothing", NO),
        (G.labs, "Hgb=9.8 g; UREA N=30; ASA=NEG; Na=130; Na=131", "Hemoglobin=9.8; Sodium=131; BUN=30"), (G.labs, "dc: K=NEG", NO),
        (G.disposition, "Home w services\nclear", f"Discharge Disposition=Home with Services\nMental Status=alert\nSupport Needs={NO}"), (G.disposition, "Disposition: extended\nmental=Lethargic\nsupport=cane\nDisposition=home", "Discharge Disposition=SNF\nMental Status=lethargic\nSupport Needs=cane"),
        (G.disposition, None, NO), (G.disposition, "Disposition=not stated\nhome", f"Discharge Disposition=Home\nMental Status={NO}\nSupport Needs={NO}"),
        (G.medications, "Medication Count=12 pills\nPolypharmacy=1\nOpioid Therapy=n/a\nOther=2", f"Medication Count=12\nNew Medications Count={NO}\nPolypharmacy=yes\nAnticoagulation={NO}\nInsulin Therapy={NO}\nOpioid Therapy={NO}\nDiuretic Therapy={NO}"),
        (G.procedures, "Surgery=no\nDialysis=1", "Any Procedure=no\nSurgery=no\nDialysis=done\nMechanical Ventilation=no"),
        (G.procedures, "Surgery=no\nDialysis=0", f"Any Procedure={NO}\nSurgery={NO}\nDialysis={NO}\nMechanical Ventilation={NO}"),
        (G.procedures, "s/p appendectomy", "Any Procedure=no\nSurgery=yes\nDialysis=no\nMechanical Ventilation=no"), (G.procedures, "intubated for 3 days", "Any Procedure=yes\nSurgery=no\nDialysis=no\nMechanical Ventilation=3"),
        (G.mental_status, "Clear and coherent", "alert"), (G.mental_status, "A and oriented", "oriented"), (G.mental_status, "?", NO),
    ],
)
def test_sections(spark, f, text, out):
    assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0] == out


def test_evidence_keys_and_contract(spark):
    rows = spark.createDataFrame([("No surgery was needed",), ("s/p CABG",), ("Surgery=no",), ("hernia repair",)], "l string")
    assert [r[0] for r in rows.select(G.surgery_evidence(F.col("l"))).collect()] == [False, True, False, True]
    keys = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1}',), ("x",)], "j string").select(G.has_keys(F.col("j"), ["a", "b"]))
    assert [r[0] for r in keys.collect()] == [True, False, False]
    facts = spark.createDataFrame([(1, "LABS", "Sodium", "1", "Past"), (1, "LABS", "Foo", "x", "20240101"), (2, "PROBLEMS", "CHF", "acute", "x")], "hadm_id long, cluster string, keyword string, value string, ts string")
    assert [r[0] for r in facts.select(G.valid_fact(F.col("cluster"), F.col("ts"), F.col("value"))).collect()] == [True, False, False]
    assert {r.hadm_id: (r.outside, r.compliance) for r in G.keyword_report(facts).collect()} == {1: ("Foo", 0.5), 2: ("", 1.0)}


def test_objective_facts(spark):
    rows = spark.createDataFrame([(1, "VITALS", "ADM: Heart Rate=92; Weight=x\nDC: Heart Rate=80"), (1, "DISPOSITION", "Discharge Disposition=Home\nMental Status=not stated"), (1, "DEMOGRAPHICS", "Sex=male\nAge=70")], "hadm_id long, section string, text string")
    got = {(r.cluster, r.keyword, r.value, r.ts) for r in G.objective_facts(rows).collect()}
    assert got == {("VITALS", "Heart Rate", "92", "Admission"), ("VITALS", "Heart Rate", "80", "Discharge"), ("DISPOSITION", "Discharge Disposition", "Home", "Discharge"), ("DEMOGRAPHICS", "Sex", "male", "Admission"), ("DEMOGRAPHICS", "Age", "70", "Admission")}


def test_windows_and_fill(spark):
    from factweave.operators import notes as T

    text = "a" * 50 + "b" * 100 + "vital" + "c" * 100
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "hadm_id long, text string")
    got = {r.hadm_id: r.trimmed for r in T.trim_windows(rows, 60, ["vital"], around=10, head=20).collect()}
    assert got == {1: "a" * 20 + "\n\n" + "b" * 10 + "vital" + "c" * 10, 2: "short", 3: None}
    text = "h" * 30 + "x" * 30 + "VITAL" + "y" * 5 + "vital" + "z" * 40 + "lab" + "w" * 30
    got = {m: T.trim_windows(spark.createDataFrame([(1, text)], "hadm_id long, text string"), m, ["vital", "lab"], around=10, head=20).first().trimmed for m in (100, 50, 30)}
    assert got == {100: text[:20] + "\n\n" + text[50:85] + "\n\n" + text[105:128], 50: text[:20] + "\n\n" + text[50:80], 30: text[:20] + "\n\n" + text[50:60]}
    cols = "hadm_id long, cluster string, keyword string, value string"
    stated = spark.createDataFrame([(1, "LABS", "Sodium", "Not stated"), (1, "LABS", "BUN", "4")], cols)
    found = spark.createDataFrame([(1, "LABS", "Sodium", "140", 5), (1, "LABS", "Sodium", "138", 2), (1, "LABS", "BUN", "9", 1)], cols + ", pos int")
    assert {r.keyword: r.value for r in T.fill_from_evidence(stated, found).collect()} == {"Sodium": "138", "BUN": "4"}


def test_backends(spark):
    from factweave.operators import backends as B
    from factweave.operators import recover as V
    from factweave.operators import synonyms as Y

    for url in ("http://h:1", "http://h:1/", "http://h:1/v1", "http://h:1/v1/chat/completions"):
        assert B.normalize_url(url) == ("http://h:1", "http://h:1/v1")
    notes = spark.createDataFrame([(1, "HR: 92, Sodium 138")], "hadm_id long, text string")
    assert [r.line for r in V.extract_facts(B.by_rules(notes)).orderBy("pos").collect()] == ["VITALS|Heart Rate|92|Admission", "LABS|Sodium|138|Admission"]
    answers = B.generate(notes.withColumnRenamed("text", "prompt"), lambda: str.upper)
    assert answers.first().raw == "HR: 92, SODIUM 138"
    row = spark.range(1).select(Y.medication_pattern(F.lit("Lasix 40")), Y.procedure_pattern(F.lit("PCI with stent")), Y.sex(F.lit(" F ")), Y.medication_pattern(F.lit("x"))).first()
    assert tuple(row) == ("Loop diuretic", "PCI/stent", "female", None)


def test_strict_facts_raise_on_lines_without_four_parts(spark):
    lines = spark.createDataFrame([(1, 0, "LABS|Sodium|138|Past"), (1, 1, "LABS|Sodium")], "hadm_id long, pos int, line string")
    assert G.strict_facts(lines).count() == 1
    with pytest.raises(Exception, match="Expected 4 parts in line: LABS.Sodium"):
        G.strict_facts(lines, raising=True).collect()


def test_keyword_windows_on_notes_that_need_no_cut(spark):
    from factweave.operators import notes as T

    rows = spark.createDataFrame([(1, "BP 120/80"), (2, None), (3, "")], "hadm_id long, text string")
    for most in (0, 100):
        for last in (False, True):
            assert {r.hadm_id: r.trimmed for r in T.trim_keyword_windows(rows, most, last).collect()} == {1: "BP 120/80", 2: None, 3: ""}
    long = "x" * 3000 + " HGB 9 " + "y" * 3000
    found = T.trim_keyword_windows(spark.createDataFrame([(1, long)], "hadm_id long, text string"), 4000, True).first().trimmed
    assert found == long[:900] + "\n\n" + long[2101:3904]


def test_sections_are_evaluated_once(spark):
    x = spark.range(1).select(*[F.lit("Surgery=yes").alias(n) for n in [*G.SECTIONS, "note"]])
    made = x.select(G.procedures(F.col("procedures"), F.col("note")).alias("p"))
    assert len(made._jdf.queryExecution().analyzed().expressions().toString()) < 20000
    assert made.first().p == "Any Procedure=no\nSurgery=yes\nDialysis=no\nMechanical Ventilation=no"
