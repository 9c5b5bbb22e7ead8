"""Objective values of notes: evidence lines, the values in them, and objects of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMBER, any_of, first_number, once, squeeze, strip
from .stage1 import UNSAID

# Words of laboratory lines, orders that rule a line out, and keys that a line must show.
LAB_WORDS = [
    "WBC", "HGB", "HCT", "PLT", "HEMOGLOBIN", "HEMATOCRIT", "PLATELET", "SODIUM", "POTASSIUM", "GLUCOSE", "BUN", "UREA N", "UREAN", "CREAT", "CREATININE", "TOTAL CO2", "CO2", "HCO3", "BICARB", "BICARBONATE",
]
ORDERS = r"(?i)\b(PO|IV|BID|TID|DAILY|QHS)\b"
LAB_KEYS = r"(?i)(WBC|HGB|HCT|PLT(\s*(COUNT|CT))?|GLUCOSE|UREA\s*N|UREAN|CREAT|CREATININE|SODIUM|POTASSIUM|TOTAL\s*CO2|HCO3|BICARB|CO2|\bNa|\bK)\s*[-:]"
# Names of laboratory values before a hyphen, then before a colon or equals sign, in the order they are tried.
LAB_NAMES = {
    "wbc": ([r"WBC"], [r"WBC"]), "hemoglobin": ([r"HGB", r"HEMOGLOBIN"], [r"HGB"]), "hematocrit": ([r"HCT", r"HEMATOCRIT"], [r"HCT"]), "platelet": ([r"PLT", r"PLT\s*COUNT", r"PLATELET"], [r"Plt(?:\s*Ct|\s*Count)?"]),
    "sodium": ([r"SODIUM", r"Na"], [r"SODIUM", r"Na"]), "potassium": ([r"POTASSIUM", r"K"], [r"POTASSIUM", r"K"]), "creatinine": ([r"CREAT(?:ININE)?"], [r"Creat(?:inine)?"]), "bun": ([r"BUN", r"UREA\s*N"], [r"BUN", r"UREA\s*N"]),
    "glucose": ([r"GLUCOSE"], [r"Glucose"]), "bicarbonate": ([r"TOTAL\s*CO2", r"HCO3", r"BICARB(?:ONATE)?", r"CO2"], [r"TOTAL\s*CO2", r"HCO3", r"CO2"]),
}
# Labelled vitals.
VITAL_PATTERNS = {
    "temperature": r"(?i)\bT(?:emp(?:erature)?)?\s*[:=]?\s*(\d+(?:\.\d+)?)\b", "heart_rate": r"(?i)\b(?:HR|P|Pulse|Heart Rate)\s*[:=]?\s*(\d+(?:\.\d+)?)\b",
    "respiratory_rate": r"(?i)\b(?:RR|Resp(?:iratory)?\s*Rate|R)\s*[:=]?\s*(\d+(?:\.\d+)?)\b", "spo2": r"(?i)\b(?:SaO2|SpO2|O2\s*sat)\s*[:=]?\s*(\d+(?:\.\d+)?)\b", "weight": r"(?i)\b(\d+(?:\.\d+)?)\s*kg\b",
}
# Pressure pairs, vitals in one line, and what stands behind the name of a laboratory value.
PAIR, LABELLED_PAIR = r"\b(\d{2,3})/(\d{2,3})\b", r"(?i)\bBP\s*[:=]?\s*(\d{2,3})/(\d{2,3})\b"
INLINE = r"(?i)\bvitals:\s*(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)"
LAB_VALUE = r"(\d+(?:\.\d+)?)(?:[*#])?\b"
#: Lines of each kind at most, and lines after a heading that may go on with vitals.
MOST_VITALS, MOST_LABS, FOLLOWING = 3, 6, 5
VITALS = ["temperature", "heart_rate", "systolic_bp", "diastolic_bp", "respiratory_rate", "spo2", "weight"]


def evidence_text(c: Column) -> Column:
    """A line as evidence: single spaces, no pipes, no placeholders, at most 240 characters."""
    t = F.regexp_replace(strip(squeeze(F.replace(c, F.lit("|"), F.lit(" ")))), r"^_+\s*", "")
    t = F.replace(t, F.lit("___"), F.lit(UNSAID))
    return F.coalesce(F.nullif(F.rtrim(F.left(t, F.lit(240))), F.lit("")), F.lit(UNSAID))


def objective_lines(notes: DataFrame, key: str = "hadm_id") -> DataFrame:
    """(key, vitals, labs): the evidence lines of each note, at most three and six, different ones in order.

    A line that names vitals counts with the lines with digits among the five after it; without any,
    lines count that show a pressure pair and a sign of oxygen. Laboratory lines have a known word, a
    digit and a key with a hyphen or colon, and no order of a drug. Notes without text have none.
    """
    found = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), lambda x: strip(x)), lambda x: x != "")
    rows = once(notes, [key], _a=found)
    named = lambda x: F.upper(x).contains("VITALS:") | F.upper(x).contains("VITAL SIGNS")
    follow = lambda i: F.filter(F.slice("_a", i + 2, F.lit(FOLLOWING)), lambda y: y.rlike("[0-9]"))
    headed = F.flatten(F.transform("_a", lambda x, i: F.when(named(x), F.concat(F.array(x), follow(i))).otherwise(F.array().cast("array<string>"))))
    bare = F.filter("_a", lambda x: x.rlike(PAIR) & x.rlike(r"(?i)(%|\bRA\b|SpO2|SaO2)"))
    labs = F.filter("_a", lambda x: any_of(F.upper(x), LAB_WORDS) & x.rlike("[0-9]") & ~x.rlike(ORDERS) & x.rlike(LAB_KEYS))
    clean = lambda a, n: F.slice(F.array_distinct(F.transform(a, evidence_text)), 1, n)
    rows = once(rows, [key], _h=clean(headed, MOST_VITALS), _b=clean(bare, MOST_VITALS), labs=clean(labs, MOST_LABS))
    return rows.select(key, F.when(F.size("_h") > 0, F.col("_h")).otherwise(F.col("_b")).alias("vitals"), "labs")


def appendix(vitals: Column, labs: Column) -> Column:
    """The evidence lines under their headings; empty without any."""
    part = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(a, "\n")))
    return F.when((F.size(vitals) == 0) & (F.size(labs) == 0), "").otherwise(F.concat_ws("\n", F.lit("OBJECTIVE EVIDENCE EXCERPT (verbatim):"), part("VITALS", vitals), part("LABS", labs)))


def _group(c: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def vital_values(lines: Column) -> Column:
    """A struct of vitals read off evidence lines.

    A line that lists them all without labels wins; else labelled values; else, beside a pressure
    pair, the bare numbers of the first line with a pair and four other numbers.
    """
    inline = F.get(F.filter(lines, lambda x: x.rlike(INLINE)), F.lit(0))
    order = ["temperature", "heart_rate", "systolic_bp", "diastolic_bp", "respiratory_rate", "spo2"]
    listed = {n: _group(inline, INLINE, i + 1) for i, n in enumerate(order)}
    text = F.array_join(lines, " ")
    told = {n: _group(text, p) for n, p in VITAL_PATTERNS.items()}
    told |= {n: F.coalesce(_group(text, LABELLED_PAIR, i), _group(text, PAIR, i)) for i, n in enumerate(("systolic_bp", "diastolic_bp"), 1)}
    numbers = lambda x: F.regexp_extract_all(F.regexp_replace(x, r"\b[0-9]{2,3}/[0-9]{2,3}\b", " "), F.lit(r"(?<![A-Za-z])([0-9]+(?:\.[0-9]+)?)(?![A-Za-z])"), F.lit(1))
    bare = F.get(F.filter(F.transform(F.filter(lines, lambda x: x.rlike(PAIR)), numbers), lambda a: F.size(a) >= 4), F.lit(0))
    places = {"heart_rate": 1, "respiratory_rate": 2, "temperature": 3, "spo2": -1}
    paired = told["systolic_bp"].isNotNull()
    full = {n: F.coalesce(v, F.when(paired, F.try_element_at(bare, F.lit(places[n])))) if n in places else v for n, v in told.items()}
    return F.struct(*[(F.when(inline.isNotNull(), listed[n]).otherwise(full[n]) if n in listed else F.when(inline.isNull(), full[n])).alias(n) for n in VITALS])


def lab_values(lines: Column) -> Column:
    """A struct of laboratory values read off evidence lines; lines about urine do not count."""
    text = F.array_join(F.filter(lines, lambda x: ~F.upper(x).contains("URINE")), " ")
    return F.struct(*[F.coalesce(*[_group(text, rf"(?i)\b{n}-{LAB_VALUE}") for n in dash], *[_group(text, rf"(?i)\b{n}\s*[:=]\s*{LAB_VALUE}") for n in colon]).alias(k) for k, (dash, colon) in LAB_NAMES.items()])


def fill_map(stated: Column, found: Column, names: list[str]) -> Column:
    """Values of a map that are not stated, taken from a struct of found ones; keys stay as they are."""
    named = F.create_map(*[x for n in names for x in (F.lit(n), found[n])])
    return F.transform_values(stated, lambda k, v: F.when(F.lower(strip(v)) == UNSAID, F.coalesce(F.try_element_at(named, k), v)).otherwise(v))


def demographics_object(sex: Column, age: Column) -> Column:
    """A struct of sex and age in stable values."""
    low, a = F.lower(strip(F.coalesce(sex, F.lit("")))), strip(F.coalesce(age, F.lit("")))
    said = (a != "") & (F.lower(a) != UNSAID)
    return F.struct(F.when(low.isin("m", "male"), "male").when(low.isin("f", "female"), "female").otherwise(UNSAID).alias("sex"), F.when(said, F.coalesce(first_number(a), a)).otherwise(UNSAID).alias("age"))


def numeric_text(v: Column, second: Column, last_kg: Column) -> Column:
    """A value as a number: a side of a pair, the last number of a weight in kilograms, else the first."""
    s = strip(F.coalesce(v, F.lit("")))
    sides = F.filter(F.split(s, "/"), lambda x: strip(x) != "")
    side = F.when(second, F.get(sides, F.lit(1))).otherwise(F.get(sides, F.lit(0)))
    bare = F.replace(F.replace(F.replace(s, F.lit("%"), F.lit("")), F.lit("RA"), F.lit("")), F.lit("ra"), F.lit(""))
    found = F.when(s.contains("/") & (F.size(sides) >= 2), first_number(side)).when(last_kg & F.lower(s).contains("kg"), F.try_element_at(F.regexp_extract_all(s, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))).otherwise(first_number(bare))
    return F.when((s == "") | (F.lower(s) == UNSAID), UNSAID).otherwise(F.coalesce(found, F.lit(UNSAID)))


def objective_object(part: Column, kind: str) -> Column:
    """A map of vitals or labs with numbers or 'not stated' as values; null gives an empty map."""
    vit = F.lit(kind == "vitals")
    made = F.transform_values(part, lambda k, v: numeric_text(v, vit & k.isin("diastolic_bp", "Diastolic BP"), vit & k.isin("weight", "Weight")))
    return F.coalesce(made, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def clean_value(c: Column) -> Column:
    """A text of a summary without pipes and placeholders."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(" ")), F.lit("___"), F.lit(UNSAID))


def clean_list(a: Column) -> Column:
    """The same of a list of texts, one line each, without empty ones."""
    line = lambda x: F.replace(F.replace(strip(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.transform(F.filter(a, lambda x: strip(F.coalesce(x, F.lit(""))) != ""), lambda x: clean_value(line(x)))
