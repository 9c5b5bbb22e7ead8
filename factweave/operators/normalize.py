"""From fact lines to canonical facts: parsing, normalization, de-duplication and statistics.

Frames of lines have (hadm_id, pos, line); frames of facts (hadm_id, pos, sub_pos, cluster,
keyword, value, ts). ``pos`` orders the lines of a document, so "first wins" means the lowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import any_of, first_number, line, lookup, once, parts, squeeze, strip, words


def cluster_name(c: Column) -> Column:
    """Upper case, without the emphasis and brackets that models put around names."""
    return F.upper(strip(strip(strip(c), "*<>")))


def category_to_cluster(c: Column) -> Column:
    """Aliases of cluster names; anything else as it is."""
    return lookup(F.lower(strip(c)), C.CATEGORY_ALIASES, strip(c))


def infer_cluster(keyword: Column) -> Column:
    """The cluster of a canonical keyword (exact), null for others."""
    return lookup(strip(keyword), C.KEYWORD_CLUSTER)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Splits lines once into cluster, keyword, value and ts; lines that cannot be facts get null clusters.

    Four parts are a fact with an optional timestamp; three are a fact without a timestamp if the
    first is a cluster, else one without a cluster that its keyword names.
    """
    p = parts(strip(F.regexp_replace(strip(F.col("line")), r"^[-*•]\s+", "")))
    a, b, c, d = (F.get("_p", F.lit(i)) for i in range(4))
    full = (F.size("_p") == 4) & (a != "") & (b != "") & (c != "")
    three = (F.size("_p") == 3) & (a != "") & (b != "") & (c != "")
    guess = cluster_name(a)
    headed = three & guess.isin(C.CLUSTERS)
    inferred = infer_cluster(a)
    pick = lambda x, y, z: F.when(full, x).when(headed, y).when(three & inferred.isNotNull(), z)
    keep = [x for x in lines.columns if x != "line"]
    return once(
        once(lines, keep, _p=p),
        keep,
        cluster=pick(a, guess, inferred),
        keyword=pick(b, b, a),
        value=pick(c, c, b),
        ts=pick(F.when(d == "", "Unknown").otherwise(d), F.lit("Unknown"), c),
    )


def timestamp(c: Column) -> Column:
    return F.when(c.isin(C.TIMESTAMPS), c).when(F.lower(c) == "adm", "Admission").when(F.lower(c) == "dc", "Discharge").otherwise("Unknown")


def filled_timestamp(cluster: Column, value: Column) -> Column:
    """The timestamp that the ontology gives a fact without one."""
    return (
        F.when(cluster == "DISPOSITION", "Discharge")
        .when(cluster == "UTILIZATION", "Past")
        .when(cluster == "PROBLEMS", F.when(F.lower(value) == "acute", "Discharge").otherwise("Past"))
        .otherwise("Admission")
    )


def disposition_value(v: Column) -> Column:
    """Substrings, tried in order; deliberately as loose as stated."""
    return (
        F.when(any_of(v, ["home with", "home w", "services"]), "Home with Services")
        .when((v == "home") | v.startswith("home "), "Home")
        .when(any_of(v, ["snf", "skilled nursing"]), "SNF")
        .when(v.contains("rehab"), "Rehab")
        .when(v.contains("ltac"), "LTAC")
        .when(v.contains("hospice"), "Hospice")
        .when(any_of(v, ["ama", "against medical advice"]), "AMA")
    )


def mental_value(v: Column) -> Column:
    return F.when(v.contains("confus"), "confused").when(v.contains("letharg"), "lethargic").when(v.contains("alert"), "alert").when(v.contains("orient"), "oriented")


def problem_value(v: Column) -> Column:
    return words(squeeze(F.lower(strip(v))), C.PROBLEM_WORDS)


def symptom_value(v: Column) -> Column:
    v = squeeze(F.lower(strip(v)))
    return words(v, C.SYMPTOM_WORDS, F.when(v.contains("severe"), "severe"))


def canonical_value(cluster: Column, keyword: Column, value: Column) -> Column:
    """The canonical value of a fact, null where it has none."""
    low = F.lower(value)
    digits = first_number(value)
    is_any = lambda *ks: keyword.isin(list(ks))
    return (
        F.when(cluster == "DEMOGRAPHICS", F.when(keyword == "Sex", words(low, C.SEX_WORDS)).when(keyword == "Age", digits).otherwise(value))
        .when(cluster.isin(C.NUMERIC_CLUSTERS), digits)
        .when(cluster == "MEDICATIONS", F.when(is_any("Medication Count", "New Medications Count"), digits).when(is_any(*C.LOW_INFO_FLAGS), words(low, C.FLAG_WORDS)).otherwise(value))
        .when(
            cluster == "PROCEDURES",
            F.when(keyword == "Dialysis", words(F.replace(low, F.lit("canceled"), F.lit("cancelled")), C.DIALYSIS_WORDS))
            .when(keyword == "Mechanical Ventilation", F.when(low == "no", "no").otherwise(F.coalesce(digits, F.lit("yes"))))
            .otherwise(words(low, C.PROCEDURE_WORDS)),
        )
        .when(cluster == "DISPOSITION", F.when(keyword == "Discharge Disposition", disposition_value(low)).when(keyword == "Mental Status", mental_value(low)).otherwise(value))
        .when(cluster == "PROBLEMS", problem_value(value))
        .when(cluster == "SYMPTOMS", symptom_value(value))
        .otherwise(value)
    )


def candidates(lines: DataFrame, cfg: C.EngineConfig = C.EngineConfig()) -> DataFrame:
    """Every line with what became of it: ``status`` and, where kept, an array of one or two facts."""
    parsed = once(parse_lines(lines), ["hadm_id", "pos", "cluster", "ts", "keyword"], _c=cluster_name(F.col("cluster")), _v=strip(F.col("value")))
    c, v = F.col("_c"), F.col("_v")
    k = strip(F.col("keyword"))
    k = F.when(c == "VITALS", lookup(k, C.VITAL_ALIASES, k)).when(c == "LABS", lookup(k, C.LAB_ALIASES, k)).otherwise(k)
    parsed = once(parsed, ["hadm_id", "pos", "cluster", "_c", "_v"], _k=k, _t=timestamp(F.col("ts")))
    k, t = F.col("_k"), F.col("_t")
    pair = F.regexp_extract(v, r"([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)", 1), F.regexp_extract(v, r"([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)", 2)
    bp = (c == "VITALS") & (k == "Blood Pressure")
    value = F.when(bp, F.nullif(pair[0], F.lit(""))).otherwise(canonical_value(c, k, v))
    known = F.lit(True)
    for cluster, keywords in C.STRICT_KEYWORDS.items():
        known = known & ((c != cluster) | k.isin(keywords) | bp)
    parsed = once(parsed, ["hadm_id", "pos", "cluster", "_c", "_k", "_v", "_t"], _value=F.when(known, value))
    allowed = c.isin(list(cfg.allowed_clusters)) if cfg.allowed_clusters else F.lit(True)
    status = (
        F.when(F.col("cluster").isNull(), "unparsed").when(~allowed, "disallowed").when(v.isin(C.PLACEHOLDERS), "placeholder").when(F.col("_value").isNull(), "noncanonical").when(bp, "expanded").otherwise("kept")
    )
    out = F.col("_value")
    ts = F.when(F.lit(cfg.fill_unknown) & (t == "Unknown"), filled_timestamp(c, out)).otherwise(t)
    fact = lambda n, kw, val, when: F.struct(F.lit(n).alias("sub_pos"), c.alias("cluster"), kw.alias("keyword"), val.alias("value"), when.alias("ts"))
    facts = F.when(F.col("status") == "expanded", F.array(fact(0, F.lit("Systolic BP"), pair[0], t), fact(1, F.lit("Diastolic BP"), pair[1], t))).when(F.col("status") == "kept", F.array(fact(0, k, out, ts)))
    judged = once(parsed, parsed.columns, status=status)
    return judged.select("hadm_id", "pos", "status", facts.alias("facts"))


def explode_facts(found: DataFrame) -> DataFrame:
    return found.select("hadm_id", "pos", F.inline("facts"))


def priority(ts: Column, order) -> Column:
    out = F.lit(999)
    for rank, name in reversed(list(enumerate(order))):
        out = F.when(ts == name, rank).otherwise(out)
    return out


def dedupe(facts: DataFrame, cfg: C.EngineConfig = C.EngineConfig()) -> DataFrame:
    """One fact per document, cluster and keyword: the best timestamp, then the first."""
    w = Window.partitionBy("hadm_id", "cluster", "keyword").orderBy("_r", "pos", "sub_pos")
    return facts.withColumn("_r", priority(F.col("ts"), cfg.timestamp_priority)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_r")


def losers(facts: DataFrame, cfg: C.EngineConfig = C.EngineConfig()) -> DataFrame:
    """Facts that lose on arrival: an earlier one of their key has at least as good a timestamp."""
    w = Window.partitionBy("hadm_id", "cluster", "keyword").orderBy("pos", "sub_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = facts.withColumn("_r", priority(F.col("ts"), cfg.timestamp_priority)).withColumn("_best", F.min("_r").over(w))
    return ranked.filter("_best IS NOT NULL AND _r >= _best").drop("_r", "_best")


def normalize(lines: DataFrame, cfg: C.EngineConfig = C.EngineConfig()) -> DataFrame:
    return dedupe(explode_facts(candidates(lines, cfg)), cfg)


def normalize_stats(lines: DataFrame, cfg: C.EngineConfig = C.EngineConfig()) -> DataFrame:
    """The counters of a normalization, one row per document.

    Lines are parsed once and meet by document in one exchange, which serves the windows over keys and
    the aggregation alike. A fact is lost on arrival if an earlier one of its key has at least as good
    a timestamp; of each key the best timestamp, then the first fact stays.
    """
    rows = candidates(lines, cfg).repartition("hadm_id").select("hadm_id", "pos", "status", F.inline_outer("facts"))
    key = Window.partitionBy("hadm_id", "cluster", "keyword")
    fact = F.col("cluster").isNotNull()
    rows = rows.withColumn("_r", priority(F.col("ts"), cfg.timestamp_priority))
    rows = rows.withColumn("_before", F.min(F.when(fact, F.col("_r"))).over(key.orderBy("pos", "sub_pos").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.struct("_r", "pos", "sub_pos")
    rows = rows.withColumn("_kept", fact & (place == F.min(F.when(fact, place)).over(key)))
    line, kept, c = F.coalesce(F.col("sub_pos") == 0, F.lit(True)), F.col("_kept"), F.col("cluster")
    strict, ok = kept & c.isin(list(C.STRICT_KEYWORDS)), F.lit(False)
    for cluster, keywords in C.STRICT_KEYWORDS.items():
        ok = ok | ((c == cluster) & F.col("keyword").isin(keywords))
    measured = kept & c.isin("VITALS", "LABS")
    count = lambda x: F.count_if(line & (F.col("status") == x))
    rate = lambda n, d: F.coalesce(F.try_divide(F.count_if(d & n), F.count_if(d)), F.lit(1.0))
    return rows.groupBy("hadm_id").agg(
        F.count_if(line).alias("input_lines"),
        F.count_if(line & (F.col("status") != "unparsed")).alias("parsed_kvt4"),
        count("placeholder").alias("dropped_placeholders"),
        count("noncanonical").alias("dropped_noncanonical"),
        count("disallowed").alias("dropped_by_allowed_clusters"),
        count("expanded").alias("expanded_bp"),
        F.count_if(fact & (F.col("_r") >= F.col("_before"))).alias("dedup_dropped"),
        F.count_if(kept).alias("output_lines"),
        rate(ok, strict).alias("canonical_keyword_rate_strict"),
        rate(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), measured).alias("numeric_only_rate_vitals_labs"),
        F.lit(0).cast("bigint").alias("duplicates_after_dedup"),
    )


def render(facts: DataFrame) -> DataFrame:
    return facts.select("hadm_id", "pos", line(F.col("cluster"), F.col("keyword"), F.col("value"), F.col("ts")).alias("line"))
