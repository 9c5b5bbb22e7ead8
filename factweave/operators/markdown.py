"""Markdown summaries: sections, compaction, rendering, and supplements to extracted facts.

Frames have (hadm_id, pos, line); a section's header is a line that begins with ``## ``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import NUMBER, once, squeeze, strip
from .sanitize import key_norm


def sections(md: DataFrame) -> DataFrame:
    """Adds the section each line stands in, its number and whether the line is a header."""
    s = strip(F.col("line"))
    head = s.startswith("## ")
    w = Window.partitionBy("hadm_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = once(md, ["hadm_id", "pos", "line"], is_header=head, _name=F.when(head, F.upper(strip(F.substring(s, 4, 1 << 30)))))
    return rows.withColumns({"section": F.last("_name", ignorenulls=True).over(w), "section_no": F.count("_name").over(w)}).drop("_name")


def filter_sections(md: DataFrame, wanted: list[str]) -> DataFrame:
    return sections(md).filter(F.col("section").isin([w.strip().upper() for w in wanted]))


def drop_not_stated(md: DataFrame) -> DataFrame:
    return md.filter(F.lower(strip(F.col("line"))) != "not stated")


def compact(md: DataFrame) -> DataFrame:
    """Lines without 'not stated' pairs and lines, then without headers of empty sections."""
    s = strip(F.col("line"))
    head = s.startswith("## ")
    up = F.upper(s)
    prefix = F.when(up.startswith("ADM:"), F.substring(s, 1, 4)).when(up.startswith("DC:"), F.substring(s, 1, 3))
    body = strip(F.when(up.startswith("ADM:"), F.substring(s, 5, 1 << 30)).when(up.startswith("DC:"), F.substring(s, 4, 1 << 30)).otherwise(s))
    kept = F.filter(F.transform(F.split(body, ";"), lambda x: strip(x)), lambda x: ~F.lower(x).endswith("=not stated"))
    many = s.contains(";") & s.contains("=")
    joined = F.when(F.size(kept) > 0, F.concat(F.coalesce(F.concat(prefix, F.lit(" ")), F.lit("")), F.array_join(kept, "; ")))
    unsaid = s.contains("=") & (F.lower(strip(F.regexp_replace(s, "^[^=]*=", ""))) == "not stated")
    out = F.when(F.lower(s) == "not stated", F.lit(None)).when(head, F.rtrim("line")).when(many, joined).when(~unsaid, F.rtrim("line"))
    rows = sections(md).drop("line").join(once(md, ["hadm_id", "pos"], line=out), ["hadm_id", "pos"]).filter("line IS NOT NULL")
    filled = F.max((~F.col("is_header") & (strip(F.col("line")) != "")).cast("int")).over(Window.partitionBy("hadm_id", "section_no"))
    return rows.withColumn("_filled", filled).filter("NOT is_header OR _filled = 1").drop("_filled")


def pairs(md: DataFrame) -> DataFrame:
    """(hadm_id, pos, section, key, value) of lines of the form key=value."""
    s = strip(F.col("line"))
    rows = sections(md).filter(~F.col("is_header") & s.contains("="))
    return rows.select("hadm_id", "pos", "section", strip(F.regexp_extract(s, "^([^=]*)=", 1)).alias("key"), strip(F.regexp_replace(s, "^[^=]*=", "")).alias("value"))


def medication_supplement(md: DataFrame) -> DataFrame:
    rows = pairs(md).filter((F.col("section") == "MEDICATIONS") & F.col("key").isin(C.STRICT_KEYWORDS["MEDICATIONS"]) & ~F.lower("value").isin(C.TEXT_PLACEHOLDERS))
    return rows.select("hadm_id", "pos", F.lit(0).alias("sub_pos"), F.lit("MEDICATIONS").alias("cluster"), F.col("key").alias("keyword"), "value", F.lit("Admission").alias("ts"))


#: Aggregate keys of the problem section: value, timestamp.
_PROBLEM_KEYS = {"Discharge Dx": ("acute", "Discharge"), "Working Dx": ("exist", "Discharge"), "Complications": ("acute", "Discharge"), "PMH/Comorbidities": ("chronic", "Past"), "PMH": ("chronic", "Past")}


def problem_supplement(md: DataFrame, limit: int = 12) -> DataFrame:
    """One fact per item of the aggregate lines, ``limit`` per line at most, repeated items kept."""
    rows = pairs(md).filter((F.col("section") == "PROBLEMS") & F.col("key").isin(list(_PROBLEM_KEYS)) & ~F.lower("value").isin(C.TEXT_PLACEHOLDERS))
    found = F.slice(F.filter(F.transform(F.split("value", r"[;\n,]+"), lambda x: squeeze(strip(x))), lambda x: x != ""), 1, limit)
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in _PROBLEM_KEYS.items() for x in (k, v[i])]), F.col("key"))
    return rows.select("hadm_id", "pos", F.posexplode(found).alias("sub_pos", "keyword"), pick(0).alias("value"), pick(1).alias("ts")).select("hadm_id", "pos", "sub_pos", F.lit("PROBLEMS").alias("cluster"), "keyword", "value", "ts")


def objective_supplement(md: DataFrame, policy: str = "admission") -> DataFrame:
    """Numbers of canonical vitals and labs; of several timestamps the policy's first, or with ``both`` each.

    Of equal key and timestamp the last wins. Diastolic pressure takes the second number of a ratio.
    """
    s = strip(F.col("line"))
    up = F.upper(s)
    ts = F.when(up.startswith("ADM:") | up.startswith("ADMISSION:"), "Admission").when(up.startswith("DC:") | up.startswith("DISCHARGE:"), "Discharge").otherwise("Unknown")
    body = F.regexp_replace(s, "(?i)^(ADM|DC|ADMISSION|DISCHARGE):", "")
    rows = sections(md).filter(~F.col("is_header") & F.col("section").isin("VITALS", "LABS"))
    rows = rows.select("hadm_id", "pos", F.col("section").alias("cluster"), ts.alias("ts"), F.posexplode(F.split(body, ";")).alias("sub_pos", "_part")).filter(F.col("_part").contains("="))
    key, value = squeeze(strip(F.regexp_extract("_part", "^([^=]*)=", 1))), strip(F.regexp_replace("_part", "^[^=]*=", ""))
    nums = F.regexp_extract_all("_v", F.lit(f"({NUMBER})"), F.lit(1))
    rows = once(rows, ["hadm_id", "pos", "sub_pos", "cluster", "ts"], keyword=key, _v=value).filter(~F.lower("_v").isin(C.TEXT_PLACEHOLDERS))
    ok = ((F.col("cluster") == "VITALS") & F.col("keyword").isin(C.STRICT_KEYWORDS["VITALS"])) | ((F.col("cluster") == "LABS") & F.col("keyword").isin(C.STRICT_KEYWORDS["LABS"]))
    num = F.when((F.col("keyword") == "Diastolic BP") & F.col("_v").contains("/") & (F.size(nums) >= 2), F.get(nums, F.lit(1))).otherwise(F.get(nums, F.lit(0)))
    rows = rows.filter(ok).withColumn("value", num).filter("value IS NOT NULL")
    by = rows.groupBy("hadm_id", "cluster", "keyword", "ts").agg(F.max_by("value", F.struct("pos", "sub_pos")).alias("value"), F.min("pos").alias("pos"))
    if policy != "both":
        order = {"discharge": ["Discharge", "Admission", "Unknown"]}.get(policy, ["Admission", "Discharge", "Unknown"])
        rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("ts"))
        by = by.groupBy("hadm_id", "cluster", "keyword").agg(F.min_by(F.struct("value", "ts", "pos"), rank).alias("_b")).select("hadm_id", "cluster", "keyword", "_b.*")
    return by.select("hadm_id", "pos", F.lit(0).alias("sub_pos"), "cluster", "keyword", "value", "ts")


def hybrid(base: DataFrame, md: DataFrame, policy: str = "admission") -> DataFrame:
    """Facts, medications and problems of the summary that are not among them as lines, and vitals and labs whose key is missing."""
    cols, names = ["hadm_id", "cluster", "keyword", "value", "ts"], ["base", "supplement", "objective"]
    from_ = lambda rows, k: rows.select(*cols, F.lit(k).alias("_o"))
    rows = from_(base, 0).unionByName(from_(medication_supplement(md), 1)).unionByName(from_(problem_supplement(md), 1)).unionByName(from_(objective_supplement(md, policy), 2))
    # equal facts are one, of the first origin that has it; one partitioning by document serves both steps
    one = rows.repartition("hadm_id").groupBy(*cols).agg(F.min("_o").alias("_o"))
    first = F.min("_o").over(Window.partitionBy("hadm_id", "cluster", "keyword"))
    kept = one.withColumn("_first", first).filter("_o < 2 OR _first = 2")
    return kept.select(*cols, F.get(F.array(*[F.lit(n) for n in names]), F.col("_o")).alias("origin"))


def clean_item(c: Column) -> Column:
    return F.btrim(squeeze(F.regexp_replace(F.replace(c, F.lit("|"), F.lit(" ")), "___", " ")), F.lit(" ,;:-()[]{}"))


def join_items(found: Column, limit: int | None = None) -> Column:
    """Items joined by commas, the first of those of equal normalized key; 'not stated' if there is none."""
    kept = F.filter(F.transform(found, clean_item), lambda x: key_norm(x) != "")
    kept = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, key_norm), key_norm(x)) == i + 1)
    kept = F.slice(kept, 1, limit) if limit else kept
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise("not stated")


def domain_markdown(obj: DataFrame) -> DataFrame:
    """Markdown of typed summaries: sex, age, vitals and labs (map of keyword to number, at admission), the four
    problem lists and the two symptom lists; sections and keys in their fixed order."""
    kv = lambda m, keys: F.array_join(F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(m, k), F.lit("not stated")))), "; ")
    rows = F.array(
        F.lit("## DEMOGRAPHICS"), F.concat(F.lit("Sex="), F.coalesce("sex", F.lit("not stated"))), F.concat(F.lit("Age="), F.coalesce("age", F.lit("not stated"))),
        F.lit("## VITALS"), F.concat(F.lit("ADM: "), kv(F.col("vitals"), C.STRICT_KEYWORDS["VITALS"])), F.lit("## LABS"), F.concat(F.lit("ADM: "), kv(F.col("labs"), C.STRICT_KEYWORDS["LABS"])),
        F.lit("## PROBLEMS"), F.concat(F.lit("PMH/Comorbidities="), join_items(F.col("pmh"))), F.concat(F.lit("Discharge Dx="), join_items(F.col("discharge_dx"))), F.concat(F.lit("Complications="), join_items(F.col("complications"))), F.concat(F.lit("Working Dx="), join_items(F.col("working_dx"))),
        F.lit("## SYMPTOMS"), F.concat(F.lit("ADM symptoms="), join_items(F.col("adm_symptoms"), 3)), F.concat(F.lit("DC symptoms="), join_items(F.col("dc_symptoms"), 1)),
    )
    return obj.select("hadm_id", F.posexplode(rows).alias("pos", "line"))


def summary_markdown(facts: DataFrame) -> DataFrame:
    """One Markdown text per document from its facts, clusters in their fixed order."""
    c = F.col("cluster")
    order = F.array_position(F.array(*[F.lit(x) for x in C.CLUSTERS]), c)
    by = facts.filter(order > 0).groupBy("hadm_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "sub_pos", F.concat(F.col("keyword"), F.lit("="), F.col("value"), F.lit(" ("), F.col("ts"), F.lit(")")).alias("t")))).alias("_l"))
    by = by.withColumn("_t", F.concat(F.lit("## "), c, F.lit("\n"), F.array_join(F.transform("_l", lambda x: x["t"]), "\n"))).withColumn("_o", order)
    return by.groupBy("hadm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n\n").alias("md"))
