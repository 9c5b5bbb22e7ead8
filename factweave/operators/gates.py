"""Gates over runs: quality thresholds, comparison of two runs, progress, caches and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import NUMBER, once, safe_ratio, strip


def cache_key(model: Column, case: Column, prompt: Column, note: Column) -> Column:
    name = F.replace(F.replace(model, F.lit("/"), F.lit("_")), F.lit("."), F.lit("_"))
    return F.concat(name, F.lit("__"), case, F.lit("__"), F.left(F.md5(prompt), F.lit(8)), F.lit("_"), F.left(F.md5(note), F.lit(8)))


def gate_summary(facts: DataFrame) -> DataFrame:
    """Per document: facts, clusters and rates."""
    c = F.col("cluster")
    measured = c.isin("VITALS", "LABS")
    return facts.groupBy("hadm_id").agg(
        F.count("*").alias("n_facts"), F.count_distinct("cluster").alias("n_clusters"), F.array_join(F.array_sort(F.collect_set("cluster")), ",").alias("clusters"),
        F.round(safe_ratio(F.count_if(measured & F.col("value").rlike(f"^{NUMBER}$")), F.count_if(measured)), 6).alias("numeric_rate"),
    )


def measured_ok(section: Column, vitals: bool) -> Column:
    """Whether a section of vitals or labs holds numbers only: no percent sign, no word RA among vitals, no other value."""
    c = F.coalesce(section, F.lit(""))
    rest = F.transform(F.split(c, "\r\n|[\n\r]"), lambda x: F.when(x.contains(":"), F.regexp_replace(x, "^[^:]*:", "")).otherwise(x))
    values = F.transform(F.filter(F.flatten(F.transform(rest, lambda x: F.split(x, ";"))), lambda p: p.contains("=")), lambda p: F.lower(strip(F.regexp_replace(p, "^[^=]*=", ""))))
    fine = F.forall(values, lambda v: (v == "not stated") | v.rlike(f"^{NUMBER}$")) & ~c.contains("%")
    return fine & ~c.rlike(r"(?i)\bRA\b") if vitals else fine


def told_mental_status(section: Column) -> Column:
    """The mental status a section states, lower-cased; empty if it states none."""
    pairs = F.filter(F.split(F.coalesce(section, F.lit("")), "\r\n|[\n\r]"), lambda x: x.contains("=") & (F.lower(strip(F.regexp_extract(x, "^([^=]*)=", 1))) == "mental status"))
    return F.coalesce(F.lower(strip(F.regexp_replace(F.get(pairs, F.lit(0)), "^[^=]*=", ""))), F.lit(""))


def repeat_counts(lines: Column) -> Column:
    """(total, different) of the lines that are not empty."""
    kept = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")
    return F.struct(F.size(kept).alias("total"), F.size(F.array_distinct(kept)).alias("different"))


def offline_gates(runs: DataFrame, *, parse_min: float = 0.99, placeholder_max: float = 0.0, mental_max: float = 0.0, nonnumeric_max: float = 0.0, success_min: float = 0.95) -> DataFrame:
    """One row: the rates of a run over its documents, whether each threshold holds, and whether all do.

    ``runs`` has one row per document: json_ok, raw_model, raw (texts of the first stage before and
    after sanitation), vitals, labs, disposition and summary (its sections and their whole), n_facts
    (normalized facts of the second stage) and lines (its raw lines). Of no documents, parse and
    success rates are 1 and all others 0.
    """
    mark = lambda c: F.coalesce(F.col(c).contains("___"), F.lit(False))
    mental = told_mental_status(F.col("disposition"))
    repeats = repeat_counts(F.coalesce("lines", F.array().cast("array<string>")))
    per = runs.select(
        F.coalesce("json_ok", F.lit(False)).alias("parse"), mark("raw_model").alias("model_placeholder"), mark("raw").alias("placeholder"), mark("summary").alias("normalized_placeholder"),
        ((mental != "") & ~mental.isin(C.MENTAL_STATUS)).alias("bad_mental"), (~(measured_ok(F.col("vitals"), True) & measured_ok(F.col("labs"), False))).alias("nonnumeric"),
        (F.coalesce("n_facts", F.lit(0)) > 0).alias("success"), (repeats["different"] < repeats["total"]).alias("duplicate"),
    )
    rate = lambda c, none: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(none)), 6).alias(f"{c}_rate")
    out = per.agg(F.count("*").alias("n_docs"), *[rate(c, 1.0 if c in ("parse", "success") else 0.0) for c in per.columns if c != "duplicate"], F.count_if("duplicate").alias("duplicate_docs"))
    gates = {"parse_ok": F.col("parse_rate") >= parse_min, "placeholder_ok": F.col("placeholder_rate") <= placeholder_max, "mental_ok": F.col("bad_mental_rate") <= mental_max, "numeric_ok": F.col("nonnumeric_rate") <= nonnumeric_max, "success_ok": F.col("success_rate") >= success_min}
    passed = F.lit(True)
    for g in gates.values():
        passed = passed & g
    return out.withColumns({**gates, "passed": passed})


def run_summary(docs: DataFrame) -> DataFrame:
    """Per document (hadm_id, note, summary, lines): lengths, clusters, their counts and the share of valid lines.

    A line is valid if it has three parts or more; tokens are estimated as a quarter of the characters.
    """
    part = lambda x: strip(F.split_part(x, F.lit("|"), F.lit(1)))
    rows = once(docs, ["hadm_id", "note", "summary", "lines"], _v=F.transform(F.filter("lines", lambda x: F.size(F.split(x, "[|]")) >= 3), part))
    names = F.array_sort(F.array_distinct("_v"))
    counts = F.array_join(F.transform(names, lambda c: F.concat(c, F.lit("="), F.size(F.filter("_v", lambda x: x == c)).cast("string"))), ",")
    return rows.select(
        "hadm_id", (F.size("lines") > 0).alias("parse_success"), F.length("note").alias("input_char_len"), F.floor(F.length("summary") / 4).cast("int").alias("stage1_tokens"), F.size("lines").alias("lines_extracted"),
        F.array_join(names, ",").alias("clusters_present"), counts.alias("cluster_counts"), F.round(safe_ratio(F.size("_v"), F.size("lines")), 6).alias("valid_ratio"), F.forall(names, lambda c: c.isin(C.CLUSTERS)).alias("all_clusters_valid"),
    )


def monitor(wanted: DataFrame, artifacts: DataFrame, now: Column, since: Column) -> DataFrame:
    """One row about a run: documents wanted (hadm_id) and done (hadm_id, mtime in seconds), rates per minute and minutes left.

    The window rate counts what was done after ``since``, the average rate all since the oldest artifact.
    """
    done = artifacts.join(wanted, "hadm_id", "left_semi")
    total = wanted.agg(F.count("*").alias("total"))
    one = done.agg(F.count("*").alias("done"), F.count_if(F.col("mtime") > since).alias("_new"), F.min_by("hadm_id", F.struct("mtime", "hadm_id")).alias("oldest"), F.max_by("hadm_id", F.struct("mtime", "hadm_id")).alias("newest"), F.min("mtime").alias("_from"), F.max("mtime").alias("_to"))
    one = one.crossJoin(F.broadcast(total))
    left = F.col("total") - F.col("done")
    one = one.withColumns({"rate_window": F.col("_new") / F.greatest(now - since, F.lit(1e-6)) * 60, "rate_avg": F.when(F.col("done") >= 2, F.col("done") / F.greatest(now - F.col("_from"), F.lit(1e-6)) * 60)})
    return one.select("total", "done", F.round(F.coalesce(F.try_divide(F.col("done") * 100.0, F.col("total")), F.lit(0.0)), 4).alias("percent"), "oldest", "newest", F.round(now - F.col("_to"), 4).alias("age"), F.round("rate_window", 6).alias("rate_window"), F.round(F.try_divide(left, F.col("rate_window")), 4).alias("eta_window"), F.round("rate_avg", 6).alias("rate_avg"), F.round(F.try_divide(left, F.col("rate_avg")), 4).alias("eta_avg"))


def ab_diff(a: DataFrame, b: DataFrame, key: list[str], text: str) -> DataFrame:
    """Artifacts that differ between two runs, or that one of them lacks."""
    one = a.select(*key, F.sha2(text, 256).alias("sha_a"))
    two = b.select(*key, F.sha2(text, 256).alias("sha_b"))
    kind = F.when(F.col("sha_b").isNull(), "only_a").when(F.col("sha_a").isNull(), "only_b").when(F.col("sha_a") != F.col("sha_b"), "different")
    return one.join(two, key, "full_outer").withColumn("kind", kind).filter("kind IS NOT NULL").select(*key, "kind")


#: What two outputs must share to mean the same, and what the records of two runs are compared by.
SAME_PARTS = ["normalized", "normalization_stats", "format_stats", "prompt_template_id", "prompt_prefix_sha256", "generation_params"]
RUN_KEYS = ["prompt_template_id", "prompt_prefix_sha256", "prompt_prefix_chars", "model", "url", "scope", "output_mode"]


def same_json(a: Column, b: Column, strict: bool = False) -> Column:
    """Whether two JSON texts are equal: byte by byte if ``strict``, else in their ``SAME_PARTS`` alone, whatever the order of keys."""
    if strict:
        return F.sha2(a, 256) == F.sha2(b, 256)
    part = lambda c: F.struct(*[F.to_json(F.try_variant_get(F.try_parse_json(c), f"$.{k}", "variant")).alias(k) for k in SAME_PARTS])
    return part(a) == part(b)


def ab_record(a: DataFrame, b: DataFrame, docs: DataFrame, meta_a: DataFrame, meta_b: DataFrame, json_kinds: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Differences (hadm_id, kind, sha_a, sha_b, note) of the artifacts of two runs, and one row about the comparison.

    Artifacts have (hadm_id, kind, text). Of kinds in ``json_kinds`` the meaning counts (see ``same_json``),
    of others the text. An artifact that one run lacks is missing. The row has the number of documents
    and of differences, and for each of ``RUN_KEYS`` both values of the runs' records (one row of text columns each).
    """
    wanted = lambda x, s: x.join(docs.select("hadm_id"), "hadm_id", "left_semi").select("hadm_id", "kind", F.col("text").alias(f"text_{s}"), F.sha2("text", 256).alias(f"sha_{s}"))
    both = wanted(a, "a").join(wanted(b, "b"), ["hadm_id", "kind"], "full_outer")
    is_json = F.col("kind").isin(json_kinds)
    same = F.when(is_json, same_json(F.col("text_a"), F.col("text_b"), strict)).otherwise(F.col("sha_a") == F.col("sha_b"))
    note = F.when(F.col("sha_a").isNull() | F.col("sha_b").isNull(), "missing_file").when(~same, F.when(is_json, "json_bytes_diff" if strict else "json_semantic_diff").otherwise("content_diff"))
    diffs = both.withColumn("note", note).filter("note IS NOT NULL").select("hadm_id", "kind", F.coalesce("sha_a", F.lit("")).alias("sha_a"), F.coalesce("sha_b", F.lit("")).alias("sha_b"), "note")
    meta = meta_a.select(*[F.col(k).alias(f"{k}_a") for k in RUN_KEYS]).crossJoin(F.broadcast(meta_b.select(*[F.col(k).alias(f"{k}_b") for k in RUN_KEYS])))  # one row each
    one = docs.agg(F.count_distinct("hadm_id").alias("n_hadm")).crossJoin(F.broadcast(diffs.agg(F.count("*").alias("n_diffs")))).crossJoin(F.broadcast(meta))
    return diffs, one


def progress(artifacts: DataFrame, total: Column, done: Column, ts: Column) -> DataFrame:
    """Counts of done work, rate per minute since the first, and the minutes left at that rate."""
    out = artifacts.agg(F.count("*").alias("n_total"), F.count_if(done).alias("n_done"), F.round((F.max(F.when(done, F.unix_timestamp(ts))) - F.min(F.unix_timestamp(ts))) / 60.0, 4).alias("minutes"))
    rate = safe_ratio(F.col("n_done"), F.col("minutes"))
    return out.withColumns({"rate_per_min": F.round(rate, 6), "eta_min": F.round(F.try_divide(F.col("n_total") - F.col("n_done"), F.nullif(rate, F.lit(0.0))), 4)})


def impact(base: DataFrame, reductions: tuple[float, ...] = (0.02, 0.05, 0.08)) -> DataFrame:
    """Readmissions avoided and costs saved under each reduction; ``base`` has discharges, rate and cost."""
    r = F.explode(F.array(*[F.lit(x) for x in reductions]))
    rows = base.withColumn("reduction", r).withColumn("readmissions", F.col("discharges") * F.col("rate"))
    return rows.withColumn("avoided", F.col("readmissions") * F.col("reduction")).withColumn("saved", F.col("avoided") * F.col("cost"))
