"""Small inputs and the rows that operators must return for them, worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import cloud as C
from factweave.operators import gates as G
from factweave.operators import notes as T
from factweave.operators import objective as O
from factweave.operators import recover as V
from factweave.operators import risk as R
from factweave.operators import stage1 as S
from factweave.operators import synonyms as Y

CASES: dict = {}


def golden(columns: str, want: list[tuple], given: list[tuple], schema: str):
    """Adds a case: rows (``given``, ``schema``) and the rows an operator must return; ``columns`` names and types them."""

    def add(f):
        names = [c.split()[0] for c in columns.split(", ")]
        CASES[f.__name__] = lambda spark: ([tuple(r) for r in f(spark.createDataFrame(given, schema)).select(*names).collect()], want)
        return f

    return add


_RAW = "hadm_id long, raw string"


@golden(
    "hadm_id BIGINT, pos INT, line VARCHAR", [(1, 0, "DEMOGRAPHICS|Age|75|Admission"), (1, 3, "VITALS|HR|80|Admission"), (1, 4, "plain"), (2, 0, "")],
    [(1, "<unused95>DEMOGRAPHICS|Age|75|Admission\nthought\nthe user wants x\nVITALS|HR|80|Admission\nplain"), (2, None)], _RAW,
)
def raw_output_lines(raw):
    return V.raw_lines(raw)


@golden("hadm_id BIGINT, text VARCHAR", [(1, "LABS|Na|1|Past"), (2, "a\nb")], [(1, "START\n```json\nLABS|Na|1|Past\n```\nend"), (2, "a\nb")], _RAW)
def raw_output_text(raw):
    return V.clean_text(raw)


@golden(
    "hadm_id BIGINT, pos BIGINT, line VARCHAR",
    [
        (1, 1, "LABS|Sodium|138|Unknown"), (2, 1, "LABS|Na|130|Past"), (3, 1, "LABS|BUN|18|Past"), (4, 1, "LABS|Na|130|Past"), (4, 2, "LABS|Creatinine|1.2|Discharge"), (5, 1, "VITALS|Heart Rate|67|Admission"),
        (6, 1, "LABS|Na|130|Past"), (7, 1, "VITALS|Heart Rate|67|Admission"),
    ],
    [
        (1, "LABS|Sodium=138"), (2, '[1] - "LABS|Na|130|Past",'), (3, "[{'cluster': 'labs', 'keyword': 'BUN', 'value': 18, 'timestamp': 'Past'}]"), (4, '{"LABS": [{"T":"Past","K":"Na","V":130}, {"V":"1.2","K":"Creatinine","T":"Discharge"}, {"K":'),
        (5, '{"facts":[{"cluster":"VITALS","keyword":"Heart Rate","value":67,"timestamp":"Admission"}]}'), (6, "**Cluster:** labs\n**Keyword:** Na\n**Value:** 130\n**Timestamp:** Past"), (7, "CLUSTER|VITALS|Heart Rate|67|Admission"), (8, "CLUSTER|Keyword|Value|Timestamp"), (9, None),
    ], _RAW,
)
def raw_output_facts(raw):
    return V.extract_facts(raw)


@golden(
    "hadm_id BIGINT, object VARCHAR", [(1, '{"a": 1}'), (2, '{"a":1}'), (3, '{"a": "x,\\ny"}'), (4, '{"a": "\\"}", "b": {"c": "{"}}'), (5, None), (6, None)],
    [(1, 'note {"a": 1} rest'), (2, '{"a":1} and {"b":2}'), (3, '{"a": "x,\ny"} z'), (4, '{"a": "\\"}", "b": {"c": "{"}} }'), (5, '{"a": '), (6, "none")], _RAW,
)
def json_object(raw):
    return raw.select("hadm_id", V.first_json_object(F.col("raw")).alias("object"))


_NOTES = [
    (1, "Chief complaint: none\n\nVITALS:\n  T 98.7 HR 90\n BP 116/77\nno digits\nRR 18, SaO2 96\nmore 1\n"), (2, "exam: 169/68 55 17 99 99% RA\nWBC-12.3* HGB-9.8* HCT-29.1\nURINE WBC-1 RBC-2\nLosartan Potassium 100 mg PO\nGLUCOSE-101 UREA N-22 CREAT-1.3"),
    (3, "Vitals: 98.4 54 141/40 16 94\n___ | Na: 138, K: 4.1, BP ___"), (4, None), (5, "nothing here"),
]


@golden(
    "hadm_id BIGINT, vitals VARCHAR, labs VARCHAR",
    [
        (1, "VITALS:;T 98.7 HR 90;BP 116/77", ""), (2, "exam: 169/68 55 17 99 99% RA", "WBC-12.3* HGB-9.8* HCT-29.1;URINE WBC-1 RBC-2;GLUCOSE-101 UREA N-22 CREAT-1.3"),
        (3, "Vitals: 98.4 54 141/40 16 94;Na: 138, K: 4.1, BP not stated", ""), (4, "", ""), (5, "", ""),
    ], _NOTES, "hadm_id long, text string",
)
def objective_evidence(notes):
    x = O.objective_lines(notes)
    return x.select("hadm_id", F.array_join("vitals", ";").alias("vitals"), F.array_join("labs", ";").alias("labs"))


@golden(
    "hadm_id BIGINT, appendix VARCHAR",
    [
        (1, "OBJECTIVE EVIDENCE EXCERPT (verbatim):\nVITALS:\nVITALS:\nT 98.7 HR 90\nBP 116/77"), (2, "OBJECTIVE EVIDENCE EXCERPT (verbatim):\nVITALS:\nexam: 169/68 55 17 99 99% RA\nLABS:\nWBC-12.3* HGB-9.8* HCT-29.1\nURINE WBC-1 RBC-2\nGLUCOSE-101 UREA N-22 CREAT-1.3"),
        (3, "OBJECTIVE EVIDENCE EXCERPT (verbatim):\nVITALS:\nVitals: 98.4 54 141/40 16 94\nNa: 138, K: 4.1, BP not stated"), (4, ""), (5, ""),
    ], _NOTES, "hadm_id long, text string",
)
def objective_appendix(notes):
    return O.objective_lines(notes).select("hadm_id", O.appendix(F.col("vitals"), F.col("labs")).alias("appendix"))


@golden(
    "hadm_id BIGINT, temperature VARCHAR, heart_rate VARCHAR, systolic_bp VARCHAR, diastolic_bp VARCHAR, respiratory_rate VARCHAR, spo2 VARCHAR, weight VARCHAR",
    [(1, "98.7", "90", "116", "77", "18", "96", None), (2, "99", "55", "169", "68", "17", "99", None), (3, "98.4", "54", "141", "40", "16", "94", None), (4, None, None, None, None, None, None, "71.5"), (5, None, None, None, None, None, None, None)],
    [(1, "T98.7, HR90, RR18, BP116/77, SaO2 96"), (2, "exam: 169/68 55 17 99 99% RA"), (3, "x\nVitals: 98.4 54 141/40 16 94"), (4, "Wt 71.5 kg"), (5, "")], _RAW,
)
def vitals_from_lines(raw):
    return raw.select("hadm_id", O.vital_values(F.split("raw", "\n")).alias("v")).select("hadm_id", "v.*")


@golden(
    "hadm_id BIGINT, wbc VARCHAR, hemoglobin VARCHAR, platelet VARCHAR, sodium VARCHAR, potassium VARCHAR, creatinine VARCHAR, bun VARCHAR, bicarbonate VARCHAR",
    [(1, "12.3", "9.8", None, None, None, "1.3", "22", None), (2, None, None, "210", "138", "4.1", None, None, "24"), (3, None, None, None, None, None, None, None, None)],
    [(1, "WBC-12.3* HGB-9.8* HCT-29.1\nCREAT-1.3 UREA N-22"), (2, "Na: 138, K: 4.1\nPlt Ct: 210 TOTAL CO2-24 HCO3-25"), (3, "URINE WBC-1")], _RAW,
)
def labs_from_lines(raw):
    return raw.select("hadm_id", O.lab_values(F.split("raw", "\n")).alias("v")).select("hadm_id", "v.*")


@golden(
    "hadm_id BIGINT, heart_rate VARCHAR, weight VARCHAR, spo2 VARCHAR", [(1, "90", "80", "not stated"), (2, "not stated", "70", "94")],
    [(1, "Not stated", "80", "not stated", "HR 90"), (2, "not stated", "70", "94", "none")], "hadm_id long, hr string, wt string, ox string, line string",
)
def fill_objective(rows):
    stated = F.create_map(F.lit("heart_rate"), F.col("hr"), F.lit("weight"), F.col("wt"), F.lit("spo2"), F.col("ox"))
    filled = O.fill_map(stated, O.vital_values(F.array("line")), O.VITALS)
    return rows.select("hadm_id", filled.alias("m")).select("hadm_id", *[F.col("m")[n].alias(n) for n in ("heart_rate", "weight", "spo2")])


@golden(
    "hadm_id BIGINT, sex VARCHAR, age VARCHAR, systolic VARCHAR, diastolic VARCHAR, weight VARCHAR, spo2 VARCHAR",
    [(1, "male", "75", "120", "80", "70.5", "97"), (2, "not stated", "unknown", "not stated", "not stated", "155", "not stated"), (3, "female", "not stated", "110", "110", "not stated", "not stated")],
    [(1, "M", "75 years", "120/80", "120/80", "155 lbs (70.5 kg)", "97% RA"), (2, "x", "unknown", "", None, "155 lbs", "low"), (3, " Female", "Not stated", "110", "110", "not stated", "?")],
    "hadm_id long, sex string, age string, sbp string, dbp string, wt string, ox string",
)
def object_profiles(rows):
    part = F.create_map(F.lit("systolic_bp"), F.col("sbp"), F.lit("diastolic_bp"), F.col("dbp"), F.lit("weight"), F.col("wt"), F.lit("spo2"), F.col("ox"))
    made = rows.select("hadm_id", O.demographics_object(F.col("sex"), F.col("age")).alias("d"), O.objective_object(part, "vitals").alias("m"))
    return made.select("hadm_id", "d.sex", "d.age", F.col("m")["systolic_bp"].alias("systolic"), F.col("m")["diastolic_bp"].alias("diastolic"), F.col("m")["weight"].alias("weight"), F.col("m")["spo2"].alias("spo2"))


@golden("hadm_id BIGINT, text VARCHAR, items VARCHAR", [(1, "a b not stated", "x y;z not stated"), (2, "", "")], [(1, "a|b ___", ["x\ny", " ", None, "z|___"]), (2, None, [])], "hadm_id long, text string, items array<string>")
def clean_summary_values(rows):
    return rows.select("hadm_id", O.clean_value(F.col("text")).alias("text"), F.array_join(O.clean_list(F.col("items")), ";").alias("items"))


@golden(
    "mode VARCHAR, name VARCHAR", [("ccde-admission", "CCDE_ADMISSION"), ("Tabular", "READMISSION_TABULAR"), ("pydantic", "READMISSION_STRUCTURED"), ("x", "READMISSION_DISCHARGE"), (None, "READMISSION_DISCHARGE")],
    [("ccde-admission",), ("Tabular",), ("pydantic",), ("x",), (None,)], "mode string",
)
def mode_names(rows):
    return rows.select("mode", C.mode(F.col("mode")).alias("name"))


@golden(
    "hadm_id BIGINT, fact_count INT, cluster_coverage VARCHAR, format_validity DOUBLE", [(1, 3, "LABS,VITALS", 0.75), (2, 0, "", 0.0), (3, 0, "", 0.0)],
    [(1, "```\n# facts\nlabs|Na|138|Past\nVITALS| HR|90 |\nLABS|K|4|Past\nprose\n```"), (2, None), (3, "// a|b|c|d")], _RAW,
)
def cloud_summary(raw):
    return C.summarize(raw)


@golden(
    "term VARCHAR, medication VARCHAR, procedure VARCHAR, sex VARCHAR, diagnosis VARCHAR, symptom VARCHAR, display VARCHAR",
    [("Lasix 40 mg", "Loop diuretic", None, "Lasix 40 mg", "Lasix 40 mg", "Lasix 40 mg", "Lasix 40 mg"), ("s/p PCI", None, "PCI/stent", "s/p PCI", "s/p PCI", "s/p PCI", "s/p PCI"), (" F ", None, None, "female", "F", "F", " F "),
     ("CHF", None, None, "CHF", "Heart Failure", "CHF", "Heart Failure"), ("sob", None, None, "sob", "sob", "Shortness of breath", "sob"), ("afib, new", None, None, "afib, new", "afib, new", "afib, new", "Atrial Fibrillation")],
    [("Lasix 40 mg",), ("s/p PCI",), (" F ",), ("CHF",), ("sob",), ("afib, new",)], "term string",
)
def term_maps(rows):
    t = F.col("term")
    return rows.select("term", Y.medication_pattern(t).alias("medication"), Y.procedure_pattern(t).alias("procedure"), Y.sex(t).alias("sex"), Y.diagnosis(t).alias("diagnosis"), Y.symptom(t).alias("symptom"), Y.problem_display(t).alias("display"))


@golden("a VARCHAR, b VARCHAR, same BOOLEAN", [("CHF", "congestive heart failure", True), ("HTN", "COPD", False), ("x", "X ", True)], [("CHF", "congestive heart failure"), ("HTN", "COPD"), ("x", "X ")], "a string, b string")
def terms_same(rows):
    return rows.select("a", "b", Y.terms_match(F.col("a"), F.col("b")).alias("same"))


@golden(
    "keyword VARCHAR, gid VARCHAR", [("emesis", "gi_symptoms"), ("hematochezia", "gi_symptoms"), ("purpura", "bleeding"), ("pallor", "skin_symptoms"), ("oliguria", "urinary_symptoms"), ("weakness", "neurological_symptoms"), ("severe  rigors", "fever_infection"), ("zzz", None)],
    [("emesis",), ("hematochezia",), ("purpura",), ("pallor",), ("oliguria",), ("weakness",), ("severe  rigors",), ("zzz",)], "keyword string",
)
def symptom_groups(rows):
    return R.with_groups(rows.withColumn("cluster", F.lit("SYMPTOMS"))).select("keyword", "gid")


@golden("value VARCHAR, status VARCHAR", [("Alert and oriented", "alert"), ("A&O", "alert"), ("A/Ox3", "alert"), ("confused ", "confused"), ("", "")], [("Alert and oriented",), ("A&O",), ("A/Ox3",), ("confused ",), ("",)], "value string")
def mental_status_variants(rows):
    return rows.select("value", R.mental_status(F.col("value")).alias("status"))


@golden(
    "hadm_id BIGINT, surgery BOOLEAN, keys BOOLEAN, valid BOOLEAN", [(1, True, True, True), (2, False, False, False), (3, True, False, True), (4, False, False, False)],
    [(1, "s/p CABG", '{"A":1,"B":2}', "LABS", "Past", "1.5"), (2, "Surgery=no", '{"A":1}', "LABS", "Past", "high"), (3, "laparoscopic repair", "x", "SYMPTOMS", "20240101", "yes"), (4, "declined surgery", None, "Odd", "Past", "1")],
    "hadm_id long, line string, json string, cluster string, ts string, value string",
)
def contracts(rows):
    return rows.select("hadm_id", S.surgery_evidence(F.col("line")).alias("surgery"), S.has_keys(F.col("json"), ["A", "B"]).alias("keys"), S.valid_fact(F.col("cluster"), F.col("ts"), F.col("value")).alias("valid"))


@golden(
    "hadm_id BIGINT, vitals_ok BOOLEAN, labs_ok BOOLEAN, mental VARCHAR, total INT, different INT", [(1, True, True, "alert", 3, 2), (2, False, False, "odd", 0, 0), (3, False, True, "", 1, 1)],
    [(1, "ADM: Heart Rate=92; Respiratory Rate=18\nDC: SpO2=not stated", "Na=138", "Discharge Disposition=Home\nMental Status= Alert", "a\n a\nb"), (2, "SpO2=97 RA", "Hgb=9%", "mental status=Odd", ""), (3, "HR=high", None, None, "x\n\n")],
    "hadm_id long, vitals string, labs string, disposition string, lines string",
)
def gate_checks(rows):
    counts = G.repeat_counts(F.split("lines", "\n"))
    return rows.select("hadm_id", G.measured_ok(F.col("vitals"), True).alias("vitals_ok"), G.measured_ok(F.col("labs"), False).alias("labs_ok"), G.told_mental_status(F.col("disposition")).alias("mental"), counts["total"].alias("total"), counts["different"].alias("different"))


@golden(
    "hadm_id BIGINT, trimmed VARCHAR", [(1, "head vi\n\nb vital c\n\nd lab"), (2, "short"), (3, None)],
    [(1, "head vi" + "." * 20 + "b vital c" + "." * 20 + "d lab"), (2, "short"), (3, None)], "hadm_id long, text string",
)
def note_windows(notes):
    return T.trim_windows(notes, 30, ["vital", "lab"], around=2, head=7)


@golden(
    "hadm_id BIGINT, windows VARCHAR, objective VARCHAR",
    [(1, "Note bps.\n\no BP 1\n\nd xray ", "Note bps.\n\no BP 1"), (2, "bps bps bps bps bps bp", "bps bps bps bps bps bp"), (3, ".........\n\n. xray .", "........."), (4, "BP", "BP"), (5, None, None)],
    [(1, "Note bps. hello BP 120 and xray yes no yes no"), (2, "bps bps bps bps bps bps"), (3, "............ xray ....."), (4, "BP"), (5, None)], "hadm_id long, text string",
)
def keyword_windows(notes):
    cut = lambda o: T.trim_windows(notes, 22, ["bp", "xray"], around=2, head=9, objective=o, whole_words=True)
    return cut(None).withColumnRenamed("trimmed", "windows").join(cut(["bp"]).withColumnRenamed("trimmed", "objective"), "hadm_id")


@golden(
    "hadm_id BIGINT, evidence BOOLEAN", [(1, True), (2, False), (3, True), (4, False), (5, False), (6, True)],
    [(1, "Dialysis=started"), (2, "Dialysis=no\nMechanical Ventilation=Not stated\nSurgery=no"), (3, "plain\nwas intubated"), (4, ""), (5, None), (6, "s/p CABG")], "hadm_id long, section string",
)
def any_procedure_evidence(rows):
    return rows.select("hadm_id", S.procedure_evidence(F.split("section", "\n")).alias("evidence"))


@golden(
    "hadm_id BIGINT, pos INT, cluster VARCHAR, keyword VARCHAR, value VARCHAR, ts VARCHAR", [(1, 0, "LABS", "Sodium", "138", "Past")],
    [(1, 0, " LABS | Sodium|138|Past"), (1, 1, "LABS|Sodium|high|Past"), (1, 2, "LABS|Sodium|138"), (1, 3, "  "), (1, 4, None), (2, 0, "ODD|a|b|Past")], "hadm_id long, pos int, line string",
)
def strict_contract(lines):
    return S.strict_facts(lines)


@golden(
    "hadm_id BIGINT, n INT, line VARCHAR", [(1, 1, "VITALS|Heart Rate|54|Admission"), (1, 2, "LABS|Na|130|past"), (1, 3, "LABS|K|4.1|Discharge")],
    [
        (1, '* **VITALS:**\n  pulse -> {"K":"Heart Rate","V":54,"T":"Admission"}\n- **LABS:** {"K":"Na","V":"130","T":"past"} and {"T":"Discharge","K":"K","V":"4.1"}\n{"K":"x","V":"1","T":"Past"}\nz {"K":"y","V":"1","T":"someday"}'),
        (2, 'none {"K":"Heart Rate","V":54,"T":"Admission"}'), (3, None),
    ], "hadm_id long, text string",
)
def inline_items(text):
    return V.inline_facts(text).select("hadm_id", "n", "line")
