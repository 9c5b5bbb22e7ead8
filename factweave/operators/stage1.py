"""Sections of structured summaries: their texts in canonical form, and the facts in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import NUMBER, any_of, first_number, let, lookup, once, strip, words
from .sanitize import key_norm

# Keys of laboratory values in summaries, by normalized name.
LAB_NAMES = {
    "wbc": "WBC", "white blood cell": "WBC", "hemoglobin": "Hemoglobin", "hgb": "Hemoglobin", "hematocrit": "Hematocrit", "hct": "Hematocrit", "platelet": "Platelet", "plt": "Platelet", "sodium": "Sodium", "na": "Sodium", "potassium": "Potassium", "k": "Potassium",
    "creatinine": "Creatinine", "creat": "Creatinine", "bun": "BUN", "urea n": "BUN", "urean": "BUN", "blood urea nitrogen": "BUN", "glucose": "Glucose", "bicarbonate": "Bicarbonate", "hco3": "Bicarbonate", "bicarb": "Bicarbonate", "co2": "Bicarbonate", "total co2": "Bicarbonate",
}
# Discharge dispositions by the words summaries use.
DISPOSITIONS = {
    "Home": ["home"], "Home with Services": ["home with services", "home with service", "home w services", "home w service", "home + services"], "SNF": ["snf", "skilled nursing facility", "extended care", "extended"],
    "Rehab": ["rehab", "rehabilitation"], "LTAC": ["ltac"], "Hospice": ["hospice"], "AMA": ["ama", "left ama"],
}
# Words of surgery, dialysis, ventilation and history.
SURGERY = "surgery|surgical|ectomy|otomy|plasty|arthro|laparotomy|repair|resection|bypass|stent|amputation|transplant"
DIALYSIS, VENTILATION = "dialysis|hemodialysis|cvvh", "ventilation|ventilator|intubat"
MENTION = f"{SURGERY}|{DIALYSIS}|{VENTILATION}|extubat|tracheostom"
HISTORICAL = r"\b(history of|hx of|h/o|s/p|status post|prior|previous)\b"
PROCEDURES = C.STRICT_KEYWORDS["PROCEDURES"]
UNSAID = "not stated"


def text_lines(c: Column) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r]"), lambda x: strip(x)), lambda x: x != "")


def key_of(x: Column) -> Column:
    return strip(F.regexp_extract(x, "^([^=]*)=", 1))


def value_of(x: Column) -> Column:
    return strip(F.regexp_replace(x, "^[^=]*=", ""))


def binary_text(v: Column) -> Column:
    return let(F.lower(strip(v)), lambda low: F.when(low.isin(C.TEXT_PLACEHOLDERS), UNSAID).when(low.isin(C.BINARY_TRUE), "yes").when(low.isin(C.BINARY_FALSE), "no").otherwise(strip(v)))


def mental_status(v: Column) -> Column:
    return let(F.lower(strip(v)), _mental_status)


def _mental_status(low: Column) -> Column:
    return (
        F.when(low.isin("", "...", "…"), UNSAID).when(any_of(low, ["clear", "coherent"]), "alert").when(any_of(low, ["intact", "oriented"]), "oriented").when(low.contains("letharg"), "lethargic").when(low.contains("confus"), "confused")
        .when(low == "alert", "alert").otherwise(UNSAID)
    )


def demographics(c: Column) -> Column:
    """Two lines, sex and age, either of which may be 'not stated'."""
    return let(strip(F.coalesce(c, F.lit(""))), _demographics)


def _demographics(t: Column) -> Column:
    up = F.upper(t)
    fixed = F.replace(F.replace(t, F.lit("Sex=F"), F.lit("Sex=female")), F.lit("Sex=M"), F.lit("Sex=male"))
    found = text_lines(fixed)
    found = F.when(F.lower(fixed).contains("sex="), found).otherwise(F.concat(F.array(F.lit(f"Sex={UNSAID}")), found))
    found = F.when(F.lower(fixed).contains("age="), found).otherwise(F.concat(found, F.array(F.lit(f"Age={UNSAID}"))))
    return F.when(t == "", f"Sex={UNSAID}\nAge={UNSAID}").when(up == "F", f"Sex=female\nAge={UNSAID}").when(up == "M", f"Sex=male\nAge={UNSAID}").otherwise(F.array_join(F.slice(found, 1, 2), "\n"))


def undecorated(c: Column) -> Column:
    """Numbers without stars and percent signs; a pressure pair as its two keys."""
    t = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), rf"({NUMBER})\*", "$1")
    t = F.regexp_replace(t, rf"(?i)\bSpO2\s*=\s*({NUMBER})\s*%?(?:\s*RA)?(?=[;,\s]|$)", "SpO2=$1")
    t = F.regexp_replace(t, rf"(?i)\b(?:Systolic BP|BP)\s*=\s*({NUMBER})\s*/\s*({NUMBER})\b", "Systolic BP=$1; Diastolic BP=$2")
    return F.regexp_replace(t, rf"(?i)\bDiastolic BP\s*=\s*({NUMBER})\s*/\s*({NUMBER})\b", "Diastolic BP=$2")


def _measured(c: Column, keys: list[str], name, pick) -> Column:
    """Lines of canonical pairs in the order of ``keys``, the last of equal keys, with their ADM or DC prefix."""

    def one(x: Column) -> Column:
        prefix = F.upper(F.regexp_extract(x, r"(?i)^(adm|dc)\s*:", 1))
        rest = F.regexp_replace(x, r"(?i)^(adm|dc)\s*:", "")
        found = F.filter(F.transform(F.split(rest, ";"), lambda p: strip(p)), lambda p: p.contains("=") & (F.lower(value_of(p)) != UNSAID))
        found = F.transform(found, lambda p: F.struct(name(key_of(p)).alias("k"), pick(key_of(p), value_of(p)).alias("v")))
        last = let(found, lambda f: F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.try_element_at(F.filter(f, lambda q: (q["k"] == k) & q["v"].isNotNull()), F.lit(-1))))
        kept = F.transform(F.filter(last, lambda q: q.isNotNull()), lambda q: F.concat(q["k"], F.lit("="), q["v"]))
        return let(kept, lambda x: F.when(F.size(x) > 0, F.concat(F.when(prefix != "", F.concat(prefix, F.lit(": "))).otherwise(""), F.array_join(x, "; "))))

    made = F.filter(F.transform(text_lines(undecorated(c)), one), lambda x: x.isNotNull())
    return let(made, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(UNSAID))


def vitals(c: Column) -> Column:
    """Canonical vitals; of several weights the one in kilograms, which comes last."""
    nums = lambda v: F.regexp_extract_all(v, F.lit(f"({NUMBER})"), F.lit(1))
    return _measured(c, C.STRICT_KEYWORDS["VITALS"], lambda k: k, lambda k, v: F.when((k == "Weight") & F.lower(v).contains("kg"), F.try_element_at(nums(v), F.lit(-1))).otherwise(first_number(v)))


def labs(c: Column) -> Column:
    return _measured(c, C.STRICT_KEYWORDS["LABS"], lambda k: lookup(key_norm(k), LAB_NAMES, k), lambda k, v: first_number(v))


def disposition(c: Column) -> Column:
    """Three lines: disposition, mental status and support; the first stated value of each."""
    x = F.transform(text_lines(c), lambda v: F.when(v.contains(":") & ~v.contains("="), F.concat(strip(F.regexp_extract(v, "^([^:]*):", 1)), F.lit("="), strip(F.regexp_replace(v, "^[^:]*:", "")))).otherwise(v))
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))

    def typed(v: Column) -> Column:
        k, val = F.lower(key_of(v)), value_of(v)
        keyed = F.when(k.isin("discharge disposition", "disposition"), pair(F.lit("d"), words(F.lower(val), DISPOSITIONS, val))).when(k.isin("mental status", "mental"), pair(F.lit("m"), mental_status(val))).when(k.isin("support needs", "support"), pair(F.lit("s"), val))
        bare = F.when(words(F.lower(v), DISPOSITIONS).isNotNull(), pair(F.lit("d"), words(F.lower(v), DISPOSITIONS))).when(mental_status(v) != UNSAID, pair(F.lit("m"), mental_status(v)))
        return F.when(v.contains("="), keyed).otherwise(bare)

    stated = lambda found, k: F.coalesce(F.get(F.filter(found, lambda q: (q["k"] == k) & ~F.lower(q["v"]).isin("", UNSAID)), F.lit(0))["v"], F.lit(UNSAID))
    full = let(F.transform(x, typed), lambda f: F.concat_ws("\n", F.concat(F.lit("Discharge Disposition="), stated(f, "d")), F.concat(F.lit("Mental Status="), stated(f, "m")), F.concat(F.lit("Support Needs="), stated(f, "s"))))
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", UNSAID).otherwise(full)


def _last(found: Column, k: str) -> Column:
    return value_of(F.try_element_at(F.filter(found, lambda x: x.contains("=") & (key_of(x) == k)), F.lit(-1)))


def medications(c: Column) -> Column:
    """All seven keys; counts as numbers, flags as yes or no, the last of equal keys."""
    told = lambda found, k: first_number(_last(found, k)) if k.endswith("Count") else binary_text(_last(found, k))
    made = let(text_lines(c), lambda found: F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.coalesce(told(found, k), F.lit(UNSAID))) for k in C.STRICT_KEYWORDS["MEDICATIONS"]]))
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", UNSAID).otherwise(made)


def procedures(c: Column, note: Column | None = None, negatives_unsaid: bool = False, need_evidence: bool = True) -> Column:
    """All four keys, from typed keys where there are any, else from what the lines mention.

    Negatives alone, with no procedure mentioned in the note, are defaults of a model and become 'not stated'.
    """
    names = "asdv"
    four = lambda xs: F.struct(*[x.alias(n) for n, x in zip(names, xs, strict=True)])
    of = lambda q: [q[n] for n in names]

    def explicit(q: Column) -> Column:
        a, s, d, v = of(q)
        dl, vl = F.lower(d), F.lower(v)
        d1 = F.when(d.isNull(), "no").when(dl.isin(C.BINARY_FALSE), "no").when(dl.isin(C.BINARY_TRUE), "done").when(dl.isin("started", "done", "decided", "cancelled"), dl).when(dl.isin(C.TEXT_PLACEHOLDERS), UNSAID).otherwise("done")
        v1 = F.when(v.isNull(), "no").when(vl.isin(C.TEXT_PLACEHOLDERS), UNSAID).when(vl.isin(C.BINARY_FALSE), "no").when(vl.isin(C.BINARY_TRUE), "1").otherwise(F.coalesce(first_number(v), binary_text(v)))
        return four([F.coalesce(binary_text(a), F.lit("no")), F.coalesce(binary_text(s), F.lit("no")), d1, v1])

    def told(x: Column) -> Column:
        val = F.when(x.contains("="), value_of(x)).otherwise(x)
        b = F.lower(binary_text(val))
        present = lambda y: (y["b"] == "yes") | ~(y["b"].isin("yes", "no", UNSAID) | F.lower(y["v"]).isin([*C.TEXT_PLACEHOLDERS, "no"]))
        return let(F.struct(F.replace(x, F.lit("="), F.lit(" ")).alias("t"), val.alias("v"), b.alias("b")), lambda y: F.struct(y["t"].alias("t"), y["v"].alias("v"), y["b"].alias("b"), present(y).alias("p")))

    has = lambda q, p: q["t"].rlike(f"(?i)({p})")

    def free(seen: Column) -> Column:
        state = lambda p: F.try_element_at(F.filter(seen, lambda q: has(q, p) & (q["b"] != UNSAID)), F.lit(-1))
        a = F.when(F.exists(seen, lambda q: q["p"] & ~q["t"].rlike(f"(?i){HISTORICAL}")), "yes").otherwise("no")
        s = F.when(F.exists(seen, lambda q: q["p"] & has(q, SURGERY)), "yes").otherwise("no")
        d = let(state(DIALYSIS), lambda x: F.when(x["b"] == "no", "no").when(x.isNotNull(), "done").otherwise("no"))
        v = let(state(VENTILATION), lambda x: F.when(x["b"] == "no", "no").when(x.isNotNull(), F.coalesce(first_number(x["v"]), F.lit("1"))).otherwise("no"))
        return four([a, s, d, v])

    def unsaid(q: Column) -> Column:
        a, s, d, v = of(q)
        s, d, v = (F.when(x == "no", UNSAID).otherwise(x) for x in (s, d, v))
        return four([F.when((a == "no") & (s == UNSAID) & (d == UNSAID) & (v == UNSAID), UNSAID).otherwise(a), s, d, v])

    def founded(q: Column) -> Column:
        a, s, d, v = of(q)
        positive = (s == "yes") | (a == "yes") | d.isin("started", "done", "decided", "cancelled") | ~v.isin("", "no", UNSAID, "0", "0.0", "false")
        mention = F.coalesce(note, F.lit("")).rlike(f"(?i)({MENTION})") if note is not None else F.lit(False)
        return F.when(positive | mention, q).otherwise(four([F.lit(UNSAID)] * 4))

    def state(found: Column) -> Column:
        typed = F.exists(found, lambda x: x.contains("=") & key_of(x).isin(PROCEDURES))
        return F.when(typed, let(four([_last(found, k) for k in PROCEDURES]), explicit)).otherwise(let(F.transform(found, told), free))

    made = let(text_lines(c), state)
    made = let(made, unsaid) if negatives_unsaid else made
    made = let(made, founded) if need_evidence else made
    out = let(made, lambda q: F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), x) for k, x in zip(PROCEDURES, of(q), strict=True)]))
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", "\n".join(f"{k}={UNSAID}" for k in PROCEDURES)).otherwise(out)


def surgery_evidence(line: Column) -> Column:
    """Whether a line tells of surgery and does not deny it."""
    denied = line.rlike(r"(?i)^\s*(surgery|any procedure)\s*=\s*(no|0|0\.0|false|not stated)\s*$") | line.rlike(r"(?i)^\s*major surgical or invasive procedure\b") | line.rlike(r"(?i)\b(without surgery|no surgery|denies surgery|declined surgery)\b")
    return ~denied & line.rlike(rf"(?i)({SURGERY}|\bs/p\b|\bcabg\b|laparoscopic)")


def procedure_evidence(lines: Column) -> Column:
    """Whether any of a procedure section's lines tells of surgery, dialysis or ventilation and does not deny it; null and no lines tell nothing."""

    def tells(x: Column) -> Column:
        said = F.lower(strip(F.regexp_extract(x, "(?s)=(.*)$", 1)))
        denied = x.contains("=") & said.isin(*C.TEXT_PLACEHOLDERS, "no", "0", "0.0", "false")
        return surgery_evidence(x) | (~denied & x.rlike(f"(?i)({DIALYSIS}|{VENTILATION})"))

    return F.coalesce(F.exists(lines, lambda x: F.coalesce(tells(x), F.lit(False))), F.lit(False))


def strict_facts(lines: DataFrame, raising: bool = False) -> DataFrame:
    """(hadm_id, pos, cluster, keyword, value, ts) of lines (hadm_id, pos, line) that meet the strict contract.

    Empty lines and invalid facts are left out. A line that has not four parts is left out too, or
    ends the query with an error if ``raising``.
    """
    s = strip(F.col("line"))
    rows = once(lines.filter(s != ""), ["hadm_id", "pos", "line"], _p=F.transform(F.split(s, "[|]"), lambda x: strip(x)))
    if raising:
        wrong = F.raise_error(F.concat(F.lit("Expected 4 parts in line: "), "line")).cast("array<string>")
        rows = once(rows, ["hadm_id", "pos"], _p=F.when(F.size("_p") == 4, F.col("_p")).otherwise(wrong))
    part = [F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("cluster", "keyword", "value", "ts"))]
    facts = rows.filter(F.size("_p") == 4).select("hadm_id", "pos", *part)
    return facts.filter(F.coalesce(valid_fact(F.col("cluster"), F.col("ts"), F.col("value")), F.lit(False)))


def objective_facts(sections: DataFrame) -> DataFrame:
    """Facts of canonical section texts (hadm_id, section, text): numbers of vitals, labs and use of care, sex, age and disposition."""
    rows = sections.select("hadm_id", "section", F.posexplode(text_lines(F.col("text"))).alias("n", "line"))
    ts = F.when(F.col("line").startswith("ADM:"), "Admission").when(F.col("line").startswith("DC:"), "Discharge").when(F.col("section") == "DISPOSITION", "Discharge").when(F.col("section") == "UTILIZATION", "Past").otherwise("Admission")
    rows = rows.select("hadm_id", "section", "n", ts.alias("ts"), F.posexplode(F.split(F.regexp_replace("line", "^(ADM|DC):", ""), ";")).alias("m", "_p")).filter(F.col("_p").contains("="))
    k, v = key_of(F.col("_p")), value_of(F.col("_p"))
    rows = rows.select("hadm_id", F.col("n").cast("bigint").alias("pos"), F.col("m").alias("sub_pos"), F.col("section").alias("cluster"), k.alias("keyword"), v.alias("value"), "ts")
    known = F.lit(False)
    for cluster in C.OBJECTIVE_CLUSTERS:
        known = known | ((F.col("cluster") == cluster) & F.col("keyword").isin(C.STRICT_KEYWORDS[cluster]))
    numeric = F.col("cluster").isin(C.NUMERIC_CLUSTERS) | (F.col("keyword") == "Age")
    return rows.filter(known & (F.lower("value") != UNSAID) & (~numeric | F.col("value").rlike(f"^{NUMBER}$")))


def has_keys(c: Column, keys: list[str] | None = None) -> Column:
    """Whether a JSON object has all the top-level keys."""
    return F.coalesce(F.forall(F.array(*[F.lit(k) for k in keys or C.CLUSTERS]), lambda k: F.array_contains(F.json_object_keys(c), k)), F.lit(False))


def valid_fact(cluster: Column, ts: Column, value: Column) -> Column:
    """The strict contract of a fact: cluster, timestamp or eight-digit date, numbers in vitals and labs."""
    return cluster.isin(C.CLUSTERS) & (ts.isin(C.TIMESTAMPS) | ts.rlike("^[0-9]{8}$")) & (~cluster.isin("VITALS", "LABS") | value.rlike(f"^{NUMBER}$"))


def keyword_report(facts: DataFrame) -> DataFrame:
    """Per document: keywords outside the vocabulary of the strict clusters, and the share inside (1 if there are none)."""
    c, k = F.col("cluster"), F.col("keyword")
    inside = F.lit(False)
    for cluster, keywords in C.STRICT_KEYWORDS.items():
        inside = inside | ((c == cluster) & k.isin(keywords))
    strict = c.isin(list(C.STRICT_KEYWORDS))
    return facts.groupBy("hadm_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(strict & ~inside, k))), ",").alias("outside"), F.coalesce(F.try_divide(F.count_if(strict & inside), F.count_if(strict)), F.lit(1.0)).alias("compliance"))


#: The sections of a summary that have a canonical form.
SECTIONS = ["demographics", "vitals", "labs", "medications", "procedures", "disposition"]


def canonical_sections(summaries: DataFrame, note: str | None = None) -> DataFrame:
    """Summaries (hadm_id and texts of ``SECTIONS``) with each section in its canonical form; ``note`` names the column of the note's text, if there is one."""
    made = {"demographics": demographics, "vitals": vitals, "labs": labs, "medications": medications, "disposition": disposition}
    text = None if note is None else F.col(note)
    return summaries.select("hadm_id", *[(procedures(F.col(n), text) if n == "procedures" else made[n](F.col(n))).alias(n) for n in SECTIONS])
