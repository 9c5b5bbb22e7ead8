"""Raw model output by branch, and the readers."""

import json

import pytest
from pyspark.sql import functions as F

from factweave.operators import recover as V
from factweave.sources import readers as D

FACT = '{"cluster":"VITALS","keyword":"Heart Rate","value":67,"timestamp":"Admission"}'


@pytest.mark.parametrize(
    "raw, out",
    [
        ("VITALS|Heart Rate|67|Admission\nVITALS|Heart Rate|67|Admission", ["VITALS|Heart Rate|67|Admission"]),
        ("CLUSTER|VITALS|Heart Rate|67|Admission", ["VITALS|Heart Rate|67|Admission"]),
        ("CLUSTERS|Heart Rate|67|Admission", ["VITALS|Heart Rate|67|Admission"]),
        ("CLUSTER|Keyword|Value|Timestamp", []),
        ("LABS|Sodium=138", ["LABS|Sodium|138|Unknown"]),
        ("<unused95>DEMOGRAPHICS|Age|75|Admission", ["DEMOGRAPHICS|Age|75|Admission"]),
        ("thought: let me see\nLABS|K\nVITALS|SpO2|97|Admission\nLABS|Na|1|Past", ["VITALS|SpO2|97|Admission", "LABS|Na|1|Past"]),
        ('[1] - "LABS|Na|130|Past",', ["LABS|Na|130|Past"]),
        (f'{{"facts":[{FACT}]}}', ["VITALS|Heart Rate|67|Admission"]),
        (f"```json\n[{FACT}]\n```", ["VITALS|Heart Rate|67|Admission"]),
        (FACT, ["VITALS|Heart Rate|67|Admission"]),
        ('{"LABS":[{"K":"Creatinine","V":1.2,"T":"Discharge"}]}', ["LABS|Creatinine|1.2|Discharge"]),
        (f'{{"facts":[{FACT},{{"cluster":"LA', ["VITALS|Heart Rate|67|Admission"]),
        ('{"LABS":[{"K":"Na","V":"130","T":"Past"},{"K":', ["LABS|Na|130|Past"]),
        ("see «LABS|Na|130|Past» there", ["LABS|Na|130|Past", "see «LABS|Na|130|Past» there"]),
        ("**Cluster:** labs\n**Keyword:** Na\n**Value:** 130\n**Timestamp:** Past", ["LABS|Na|130|Past"]),
        ("[{'cluster': 'labs', 'keyword': 'Na', 'value': 5, 'timestamp': 'Past'}]", ["LABS|Na|5|Past"]),
        ("", []), (None, []), ("prose | with a pipe", []),
    ],
)
def test_branches(spark, raw, out):
    rows = V.extract_facts(spark.createDataFrame([(1, raw)], "hadm_id long, raw string")).orderBy("pos").collect()
    assert [r.line for r in rows] == out


def test_first_json_object(spark):
    texts = ['note {"a": 1} rest', '{"a": "x"}', "none", '{"a":1} and {"b":2}', '{"a": "x,\ny\r"} z', '{"a": "\\"}", "b": {"c": "{"}} }', '{"a": ', None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(V.first_json_object(F.col("t"))).collect()
    assert [r[0] for r in rows] == ['{"a": 1}', '{"a": "x"}', None, '{"a":1}', '{"a": "x,\\ny\\r"}', '{"a": "\\"}", "b": {"c": "{"}}', None, None, None]


def test_readers(spark, tmp_path):
    for i in ("7", "10", "x"):
        (tmp_path / i).mkdir()
        (tmp_path / i / f"ehr_{i}.txt").write_text(f"note {i}\nline")
    (tmp_path / "10" / "ground_truth_10.json").write_text(json.dumps({"facts": [{"C": "LABS", "K": "BUN", "V": 18, "T": "Admission"}]}))
    root = str(tmp_path)
    assert sorted((r.hadm_id, r.text) for r in D.notes(spark, root).collect()) == [(7, "note 7\nline"), (10, "note 10\nline")]
    assert [r.hadm_id for r in D.notes(spark, root, first=1).collect()] == [10]
    assert [r.hadm_id for r in D.notes(spark, root, with_truth=True).collect()] == [10]
    assert [(r.hadm_id, r.line) for r in D.truth(D.truth_files(spark, root)).collect()] == [(10, "LABS|BUN|18|Admission")]
    (tmp_path / "ids.csv").write_text("hadm_id,y\n7,1\nq,2\n7,3\n")
    (tmp_path / "ids.json").write_text('["7", "a", "10"]')
    (tmp_path / "out.jsonl").write_text('{"hadm_id":"7","completion":"LABS|Na|1|Past"}\n{"hadm_id":"8","completion":""}\n{"completion":"x"}\n')
    assert [r.hadm_id for r in D.ids_from_csv(spark, f"{root}/ids.csv").collect()] == [7]
    assert sorted(r.hadm_id for r in D.ids_from_json(spark, f"{root}/ids.json").collect()) == [7, 10]
    assert [(r.hadm_id, r.raw) for r in D.completions(spark, f"{root}/out.jsonl").collect()] == [("7", "LABS|Na|1|Past"), ("row_2", "x")]
    assert D.completions(spark, f"{root}/out.jsonl", limit=2).count() == 1
    with pytest.raises(ValueError):
        D.ids_from_csv(spark, f"{root}/out.jsonl")
    wanted, have = D.ids_from_json(spark, f"{root}/ids.json"), D.ids_from_csv(spark, f"{root}/ids.csv")
    assert [r.hadm_id for r in D.missing_ids(wanted, have).collect()] == [10]
    (tmp_path / "many").mkdir()
    for part in range(3):
        (tmp_path / "many" / f"{part}.jsonl").write_text('{"completion":"x"}\n' * 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        assert sorted(int(r.hadm_id[4:]) for r in D.completions(spark, f"{root}/many").collect()) == list(range(15))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.hadm_id for r in D.ids_from_list(spark, " 7,10 , 7").collect()] == [7, 10]
    with pytest.raises(ValueError):
        D.ids_from_list(spark, "7,x")
    assert [r.hadm_id for r in D.ids_with_artifacts(spark, root, ["ehr_*.txt"]).orderBy("hadm_id").collect()] == [7, 10]
    assert [r.hadm_id for r in D.ids_with_artifacts(spark, root, ["ehr_*.txt", "ground_truth_*.json"], first=3).collect()] == [10]
    assert [r.hadm_id for r in D.ids_for_run(spark, root, f"{root}/ids.json").orderBy("hadm_id").collect()] == [7, 10]
    assert [r.hadm_id for r in D.ids_for_run(spark, root, names=["ground_truth_*.json"]).collect()] == [10]
    (tmp_path / "claims.json").write_text(json.dumps([{"claim_id": " C1 ", "claim": "x"}]))
    assert D.evidence_claims(spark, f"{root}/claims.json").first().asDict() == {"Claim ID": "C1", "Claim": "x", "Metric": "", "Status": "", "Artifact": ""}


def test_artifacts_are_replaced_by_document(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "hadm_id long, line string")
    path = str(tmp_path / "artifacts")
    D.write_artifacts(rows((1, "a"), (1, "b"), (2, "c")), path, "facts", buckets=2)
    D.write_artifacts(rows((2, "d"), (3, "e")), path, "facts", buckets=2)
    D.write_artifacts(rows((2, "z"),), path, "notes", buckets=2)
    D.write_artifacts(rows((2, "d"), (3, "e")), path, "facts", buckets=2)
    got = sorted((r.kind, r.hadm_id, r.line) for r in spark.read.parquet(path).collect())
    assert got == [("facts", 1, "a"), ("facts", 1, "b"), ("facts", 2, "d"), ("facts", 3, "e"), ("notes", 2, "z")]
    D.write_run(rows((1, "x")), rows((1, "y")), str(tmp_path / "run"))
    assert spark.read.csv(str(tmp_path / "run/timings"), header=True).count() == 1


def test_fact_objects_in_any_order_of_keys(spark):
    raw = '{"LABS": [{"T":"Past","K":"Na","V":130}, {"V":"1.2","K":"Creatinine","T":"Discharge"}, {"K":'
    rows = V.extract_facts(spark.createDataFrame([(1, raw)], "hadm_id long, raw string")).orderBy("pos").collect()
    assert [r.line for r in rows] == ["LABS|Na|130|Past", "LABS|Creatinine|1.2|Discharge"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_outputs_are_read_once(spark):
    raw = spark.createDataFrame([(1, "VITALS|Heart Rate|67|Admission")], "hadm_id long, raw string")
    for df in (V.extract_facts(raw), V.json_mode_facts(raw)):
        plan = plan_of(df)
        assert "Exchange" not in plan and plan.count("ExistingRDD") == 1


def test_told_facts_keep_the_last_value(spark):
    text = "Keyword: lost\nCluster: labs\nValue: 1\nKeyword: Na\nValue: 2\nvalue: 3\nTimestamp: Past\nKeyword: none\nCluster: vitals\nKeyword: HR\nTimestamp: ADM\nValue: 5"
    rows = V.narrative_facts(spark.createDataFrame([(1, text)], "hadm_id long, text string")).orderBy("n").collect()
    assert [r.line for r in rows] == ["LABS|Na|3|Past", "VITALS|HR|5|ADM"]


def test_cases_lie_in_few_files(spark, sf):
    from factweave.plans import files

    assert len(files.cases_read(spark, sf).inputFiles()) == 1


def test_cases_keep_numbers_and_missing_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 7, "text": " x "}, {"id": " ", "text": "y"}]')
    assert [tuple(r) for r in D.cases(spark, str(tmp_path)).collect()] == [("7", None, None, "x")]
