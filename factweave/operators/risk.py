"""Rule-based risk scores: parsing, concept groups, cluster scores, patterns, probability and survival.

The rule tables are this project's own (see ``config``); the structure of the score is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import number, once, squeeze, strip
from . import concepts
from . import rules as rule_tables

ACTIVE = ["chronic", "acute", "exist"]


def parse_float(v: Column) -> Column:
    """A number, or the first one in a text; null for ratios."""
    s = strip(v)
    return F.when(~s.contains("/"), F.coalesce(number(s), F.regexp_substr(s, F.lit(r"[-+]?[0-9]+(?:\.[0-9]+)?")).try_cast("double")))


def strip_prefixes(k: Column, prefixes: list[str]) -> Column:
    """Removes each prefix in turn, whatever its case."""
    for p in prefixes:
        k = F.regexp_replace(k, rf"(?i)^{p}\s*", "")
    return k


def mental_status(v: Column) -> Column:
    """alert, where the words or abbreviations say so; else the text itself."""
    low = F.lower(strip(v))
    return F.when((low.contains("alert") & low.contains("orient")) | low.isin(C.ALERT_VARIANTS), "alert").otherwise(strip(v))


def items(v: Column, limit: int = 20) -> Column:
    """The first ``limit`` items of a list value, the first of those alike but for case."""
    found = F.slice(F.filter(F.transform(F.split(strip(v), r"[;\n,]+"), lambda x: strip(squeeze(strip(x)), " -")), lambda x: x != ""), 1, limit)
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1)


def parse(lines: DataFrame) -> DataFrame:
    """Facts for scoring and, as ``dropped`` rows, what was lost; blank and comment lines are neither.

    Columns: hadm_id, pos, sub_pos, cluster, keyword, value, value_num, is_numeric, plausible, ts, dropped.
    """
    s = strip(F.col("line"))
    rows = lines.filter((s != "") & ~s.startswith("#")).select("hadm_id", "pos", F.transform(F.split(s, "[|]"), lambda x: strip(x)).alias("_p"))
    c, k, v, t = (F.get("_p", F.lit(i)) for i in range(4))
    ok = (F.size("_p") == 4) & c.isin(C.CLUSTERS)
    rows = once(rows, ["hadm_id", "pos"], _ok=ok, cluster=c, _k=F.when(c == "PROBLEMS", strip_prefixes(k, C.PROBLEM_PREFIXES)).when(c == "SYMPTOMS", strip_prefixes(k, C.SYMPTOM_PREFIXES)).otherwise(k), _v=v, _t=t)
    low, found = F.lower("_k"), items(F.col("_v"))
    listed = (F.col("cluster") == "PROBLEMS") & (F.size(found) > 0)
    fact = lambda key, val, ts: F.struct(key.alias("keyword"), val.alias("value"), ts.alias("ts"))
    many = lambda val, ts: F.transform(found, lambda x: fact(x, F.lit(val), F.lit(ts)))
    made = F.when(listed & low.isin(C.ACUTE_KEYS), many("acute", "Discharge")).when(listed & low.isin(C.CHRONIC_KEYS), many("chronic", "Past")).otherwise(F.array(fact(F.col("_k"), F.col("_v"), F.col("_t"))))
    rows = rows.select("hadm_id", "pos", "_ok", "cluster", F.posexplode(made).alias("sub_pos", "_f")).select("hadm_id", "pos", "sub_pos", "_ok", "cluster", "_f.*")
    c, k = F.col("cluster"), F.col("keyword")
    ranged = rule_key(c, k).isin([f"{a}|{b}" for a, b in C.RANGES])
    limits = plausible_range(c, k)
    plausible = limits.isNull() | F.col("value_num").between(limits["lo"], limits["hi"])
    must = c.isin(C.NUMERIC_CLUSTERS) | ranged
    mixed = (c == "PROCEDURES") & (k == "Mechanical Ventilation")
    rows = once(rows, ["hadm_id", "pos", "sub_pos", "_ok", "cluster", "keyword", "value", "ts"], value_num=F.when(must | mixed, parse_float(F.col("value"))), _must=must)
    rows = rows.withColumn("_fail", ~F.col("_ok") | (F.col("_must") & F.col("value_num").isNull()))
    # one partitioning by document serves this window and every aggregation by document that follows
    rows = rows.repartition("hadm_id")
    first = Window.partitionBy("hadm_id", "cluster", "keyword", "_fail").orderBy("pos", "sub_pos")
    again = F.col("cluster").isin(C.OBJECTIVE_CLUSTERS) & (F.row_number().over(first) > 1)
    rows = rows.withColumn("dropped", F.coalesce(F.col("_fail") | again, F.lit(True)))
    return rows.withColumns({"is_numeric": F.col("value_num").isNotNull(), "plausible": F.coalesce(plausible, F.lit(True))}).drop("_ok", "_must", "_fail")


def _synonyms(groups: list[tuple[str, int, list[str]]]) -> Column:
    """The synonyms of a configured list of groups as one literal; of a word in two groups the first holds."""
    index: dict[str, tuple[str, int]] = {}
    for gid, weight, synonyms in groups:
        for s in synonyms:
            index.setdefault(s.strip().lower(), (gid, weight))
    # one expression of literals, which the optimizer folds to a constant
    return F.expr("array(" + ", ".join(f'named_struct("s", "{s}", "gid", "{g}", "weight", {w}, "o", {-i})' for i, (s, (g, w)) in enumerate(index.items())) + ")")


def concept(c: Column, low: Column) -> Column:
    """(gid, weight) of a lower-cased keyword of PROBLEMS or SYMPTOMS.

    The group is that of its exact synonym, else of the longest that is whole words of it, else of
    the longest of at least four letters inside it; the first listed wins ties.
    """
    table = F.when(c == "PROBLEMS", _synonyms(C.PROBLEM_GROUPS)).when(c == "SYMPTOMS", _synonyms(C.SYMPTOM_GROUPS))

    def tier(s: Column) -> Column:
        word = F.array_contains(F.split(low, r"[\s,;/\-()]+"), s) | low.startswith(F.concat(s, F.lit(" "))) | low.endswith(F.concat(F.lit(" "), s)) | low.contains(F.concat(F.lit(" "), s, F.lit(" ")))
        return F.when(low == s, 3).when(word, 2).when(F.length(s) >= 4, 1).otherwise(0)

    hits = F.transform(F.filter(table, lambda x: low.contains(x["s"])), lambda x: F.struct(tier(x["s"]).alias("t"), F.length(x["s"]).alias("n"), x["o"].alias("o"), x["gid"].alias("gid"), x["weight"].alias("weight")))
    return F.array_max(F.filter(hits, lambda h: h["t"] > 0))


def with_groups(facts: DataFrame) -> DataFrame:
    """Adds gid and weight to PROBLEMS and SYMPTOMS facts; row by row against literal tables, without a join."""
    rows = once(facts, [f"`{c}`" for c in facts.columns], _h=concept(F.col("cluster"), F.lower(strip(F.col("keyword")))))
    return rows.withColumns({"gid": F.col("_h.gid"), "weight": F.col("_h.weight")}).drop("_h")


def _literal_map(table: dict[str, Column]) -> Column:
    """A map that folds to one literal, so a rule costs a lookup and no code of its own."""
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])


def rule_key(c: Column, k: Column) -> Column:
    return F.concat_ws("|", c, k)


def plausible_range(c: Column, k: Column) -> Column:
    return F.try_element_at(_literal_map({f"{a}|{b}": F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for (a, b), ((lo, hi), _) in C.RANGES.items()}), rule_key(c, k))


def points(c: Column, k: Column, v: Column, n: Column, plausible: Column, hit: Column | None = None) -> Column:
    """Points of a single fact of the clusters that score facts one by one; the first range that holds counts.

    ``hit`` has the points of the ranges where they come from a table, see ``rules``.
    """
    if hit is None:
        table = _literal_map({f"{a}|{b}": F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(p).alias("p")) for lo, hi, p in rs]) for (a, b), (_, rs) in C.RANGES.items()})
        hit = F.get(F.filter(F.try_element_at(table, rule_key(c, k)), lambda r: n.between(r["lo"], r["hi"])), F.lit(0))["p"]
    low = F.lower(strip(v))
    home = low.isin("home with service", "home w service", "home with svc", "home w/ service", "home w services", "home w/ services", "home health", "home health care")
    low = F.when(c != "DISPOSITION", low).when(k == "Mental Status", F.lower(mental_status(v))).when(home, "home with services").when(low.isin("hospice residence", "hospice care"), "hospice").otherwise(low)
    named = F.try_element_at(_literal_map({f"{a}|{b}|{x}": F.lit(p) for (a, b), t in C.VALUES.items() for x, p in t.items()}), F.concat_ws("|", c, k, low))
    vent = (c == "PROCEDURES") & (k == "Mechanical Ventilation")
    held = ~c.isin("VITALS", "LABS") | plausible
    return F.when(vent, F.when((n > 0) | (low != "no"), C.VENTILATION_POINTS).otherwise(0)).otherwise(F.coalesce(F.when(held, hit), named, F.lit(0)))


#: The patterns and what they add.
BONUS = {"sepsis_pattern": 10, "aki_pattern": 8, "decompensated_hf": 8, "frailty_syndrome": 6, "unstable_discharge": 5, "respiratory_failure": 6, "metabolic_crisis": 6, "bleeding_risk": 6}
_MEASURED = {
    "hr": ("VITALS", "Heart Rate"), "sbp": ("VITALS", "Systolic BP"), "rr": ("VITALS", "Respiratory Rate"), "temp": ("VITALS", "Temperature"), "spo2": ("VITALS", "SpO2"), "wbc": ("LABS", "WBC"), "cr": ("LABS", "Creatinine"), "bun": ("LABS", "BUN"),
    "kal": ("LABS", "Potassium"), "na": ("LABS", "Sodium"), "bic": ("LABS", "Bicarbonate"), "hgb": ("LABS", "Hemoglobin"), "glu": ("LABS", "Glucose"), "plt": ("LABS", "Platelet"), "age": ("DEMOGRAPHICS", "Age"),
}
_TOLD = {"mental": ("DISPOSITION", "Mental Status"), "disp": ("DISPOSITION", "Discharge Disposition"), "anticoag": ("MEDICATIONS", "Anticoagulation")}


def documents(facts: DataFrame, rules: DataFrame | None = None, synonyms: list | None = None) -> DataFrame:
    """One row per document, in one aggregation: the score of each cluster, the inputs of the patterns, what it has and factors.

    The largest weight of each group is a column of its own; groups are configured, so they are few.
    ``rules`` (an index of ``rules``) and ``synonyms`` (of ``concepts``) stand in for the literal tables.
    """
    c, k, value = F.col("cluster"), F.col("keyword"), F.col("value")
    low = F.lower(strip(value))
    grouped = with_groups(facts) if synonyms is None else concepts.with_groups(facts, synonyms)
    grouped = grouped if rules is None else rule_tables.with_points(grouped, rules, "value_num", "_hit")
    hit = None if rules is None else F.col("_hit")
    rows = once(grouped, ["hadm_id", "pos", "sub_pos", "cluster", "keyword", "value", "value_num", "is_numeric", "dropped", "gid", "weight"], _pts=points(c, k, value, F.col("value_num"), F.col("plausible"), hit), _low=low)
    kept, low, place, pts, num = ~F.col("dropped"), F.col("_low"), F.struct("pos", "sub_pos"), F.col("_pts"), F.col("value_num")
    of = lambda cl, kw=None: kept & (c == cl) if kw is None else kept & (c == cl) & (k == kw)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, pts)), F.lit(0))
    first = lambda x, cond: F.min_by(F.when(cond, x), F.when(cond, place))
    last = lambda x, cond: F.max_by(F.when(cond, x), F.when(cond, place))
    ever = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    is_any = of("PROCEDURES", "Any Procedure")
    factor = F.when(c == "PROBLEMS", F.when(low.isin(ACTIVE), 1.0)).when(c == "SYMPTOMS", F.when(low == "severe", 1.5).when(low == "yes", 1.0))
    heavy = lambda cl, gid: F.max(F.when(of(cl) & (F.col("gid") == gid), F.col("weight") * factor))
    groups = {"PROBLEMS": [g for g, _, _ in C.PROBLEM_GROUPS], "SYMPTOMS": [g for g, _, _ in C.SYMPTOM_GROUPS]}
    told = F.concat(k, F.lit("="), F.coalesce(value, F.lit("")), F.lit(" (+"), pts.cast("string"), F.lit(")"))
    wide = rows.groupBy("hadm_id").agg(
        *[part(of(cl)).alias(f"_{cl}") for cl in ("DEMOGRAPHICS", "VITALS", "LABS", "MEDICATIONS", "UTILIZATION", "DISPOSITION")], part(of("PROCEDURES") & ~is_any).alias("_special"), F.coalesce(first(pts, is_any), F.lit(0)).alias("_any"),
        last(num, of("MEDICATIONS", "Medication Count")).alias("_med"), ever(of("MEDICATIONS", "Polypharmacy") & (pts > 0)).alias("_poly"), ever(of("DEMOGRAPHICS", "Age") & F.col("is_numeric")).alias("_aged"),
        *[heavy(cl, g).alias(f"_{cl}_{g}") for cl, gs in groups.items() for g in gs], F.count_if(of("SYMPTOMS") & factor.isNotNull()).alias("_active"),
        *[first(num, of(*at) & F.col("is_numeric")).alias(n) for n, at in _MEASURED.items()], *[first(low, of(*at)).alias(n) for n, at in _TOLD.items()],
        F.count_if(kept).alias("n_facts_parsed"), F.count_if(~kept).alias("n_facts_dropped"), F.collect_set(F.when(kept, c)).alias("_have"),
        F.array_sort(F.collect_list(F.when(kept & (pts > 0), F.struct(cluster_order(c).alias("o"), "pos", "sub_pos", told.alias("t"))))).alias("_factors"),
    )
    x = F.col
    sum_of = lambda cl: sum((F.coalesce(x(f"_{cl}_{g}"), F.lit(0.0)) for g in groups[cl]), F.lit(0.0))
    n_of = lambda cl: sum((x(f"_{cl}_{g}").isNotNull().cast("int") for g in groups[cl]), F.lit(0))
    cap = lambda v, cl: F.least(v, F.lit(C.CAPS[cl]))
    scores = {
        "DEMOGRAPHICS": x("_DEMOGRAPHICS") + F.when(x("_aged"), 0).otherwise(C.AGE_MISSING), "VITALS": x("_VITALS"), "LABS": x("_LABS"),
        "PROBLEMS": cap(sum_of("PROBLEMS") + F.greatest(F.least(n_of("PROBLEMS") - 3, F.lit(5)), F.lit(0)), "PROBLEMS"), "SYMPTOMS": cap(F.bround(sum_of("SYMPTOMS") + F.when(x("_active") > 3, 2).otherwise(0)), "SYMPTOMS"),
        "MEDICATIONS": cap(x("_MEDICATIONS") + F.when((x("_med") >= 5) & ~x("_poly"), C.POLYPHARMACY_POINTS).otherwise(0), "MEDICATIONS"), "PROCEDURES": cap(x("_special") + F.when(x("_special") == 0, x("_any")).otherwise(0), "PROCEDURES"),
        "UTILIZATION": cap(x("_UTILIZATION"), "UTILIZATION"), "DISPOSITION": cap(x("_DISPOSITION"), "DISPOSITION"),
    }
    wide = once(wide, ["hadm_id", *_MEASURED, *_TOLD, "n_facts_parsed", "n_facts_dropped", "_have", "_factors"], groups=n_of("PROBLEMS"), hf=x("_PROBLEMS_heart_failure").isNotNull(), edema=x("_SYMPTOMS_edema_fluid").isNotNull(), resp=x("_SYMPTOMS_respiratory_distress").isNotNull(), **{n: v.cast("int") for n, v in scores.items()})
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    altered = yes(x("mental").isin("confused", "lethargic"))
    frail = sum((yes(cond).cast("int") for cond in (x("groups") >= 3, x("hgb") < 10, x("mental").isin("confused", "lethargic"), x("disp").isin("snf", "ltac", "rehab"))), F.lit(0))
    rules = {
        "sepsis_pattern": yes(x("hr") > 100) & (yes(x("sbp") < 100) | yes(x("rr") > 22)) & (yes(x("wbc") > 12) | yes(x("wbc") < 4) | yes(x("temp") > 100.4)),
        "aki_pattern": yes(x("cr") > 1.5) & yes(x("bun") > 30) & (yes(x("kal") > 5.0) | yes(x("na") < 135) | yes(x("bic") < 22)),
        "decompensated_hf": x("hf") & (x("edema") | x("resp") | yes(x("bun") > 40)),
        "frailty_syndrome": yes(x("age") > 75) & (frail >= 2),
        "unstable_discharge": yes(x("disp") == "ama") | (altered & (x("disp").isNull() | yes(x("disp") == "home"))),
        "respiratory_failure": yes(x("spo2") < 92) & (yes(x("rr") > 24) | x("resp")),
        "metabolic_crisis": yes(x("glu") > 300) & (yes(x("bic") < 18) | yes(x("kal") > 5.5)),
        "bleeding_risk": yes(x("hgb") < 8) & (yes(x("plt") < 100) | yes(x("anticoag") == "yes")),
    }
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(BONUS[n]).alias("bonus"), cond.alias("hit")) for n, cond in rules.items()]), lambda r: r["hit"])
    return once(wide, ["hadm_id", *C.CLUSTERS, "n_facts_parsed", "n_facts_dropped", "_have", "_factors"], _patterns=F.transform(found, lambda r: F.struct(r["pattern"].alias("pattern"), r["bonus"].alias("bonus"))))


def cluster_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in C.CLUSTERS]), c).cast("int")


def cluster_scores(facts: DataFrame, rules: DataFrame | None = None, synonyms: list | None = None) -> DataFrame:
    """(hadm_id, cluster, score) of all nine clusters of every document."""
    return documents(facts, rules, synonyms).select("hadm_id", *C.CLUSTERS).unpivot("hadm_id", list(C.CLUSTERS), "cluster", "score")


def patterns(facts: DataFrame) -> DataFrame:
    """(hadm_id, pattern, bonus) of the cross-cluster patterns that a document shows."""
    return documents(facts).select("hadm_id", F.inline("_patterns"))


def factors(facts: DataFrame) -> DataFrame:
    """(hadm_id, risk_factors, top_factors, protective_factors): what adds to the score, the first six of it, and what is in order.

    Factors are the facts with points in the order of clusters and lines, then the patterns.
    """
    d = documents(facts)
    shown = F.concat(F.transform("_factors", lambda f: f["t"]), F.transform("_patterns", lambda p: F.concat(F.lit("[PATTERN] "), p["pattern"], F.lit(" (+"), p["bonus"].cast("string"), F.lit(")"))))
    calm = lambda cl, text: F.when((F.col(cl) == 0) & F.array_contains("_have", cl), text)
    fine = F.array_compact(F.array(calm("VITALS", "Normal vitals at discharge"), calm("LABS", "Normal labs at discharge"), calm("DISPOSITION", "Stable disposition (Home, alert)")))
    return once(d, ["hadm_id"], risk_factors=shown, protective_factors=fine).select("hadm_id", "risk_factors", F.slice("risk_factors", 1, 6).alias("top_factors"), "protective_factors")


def probability(score: Column) -> Column:
    return 1 / (1 + F.exp(-(F.lit(C.ALPHA) + F.lit(C.BETA) * score)))


def category(score: Column) -> Column:
    out = F.lit("Critical")
    for lo, hi, name in reversed(C.BANDS):
        out = F.when(score.between(lo, hi), name).otherwise(out)
    return out


def days(score: Column) -> Column:
    return F.greatest(F.lit(1.0), F.lit(C.D_MAX) * F.exp(F.lit(-C.GAMMA) * score))


def bucket(d: Column) -> Column:
    return F.when(d <= 7, "0-7 days").when(d <= 14, "8-14 days").otherwise("15-30 days")


def survival(score: Column, p: Column, t: int) -> Column:
    """The probability of readmission by day ``t``."""
    k = F.greatest(F.lit(0.5), F.lit(C.K_BASE) + 0.02 * (score - 30))
    return F.round(F.least(F.greatest(p * (1 - F.exp(-k * (t / 30.0))) / (1 - F.exp(-k)), F.lit(0.0)), F.lit(1.0)), 4)


def results(facts: DataFrame) -> DataFrame:
    """One row per document: composite score, probability, category, days, survival, completeness and counts."""
    d = documents(facts)
    bonus = F.aggregate("_patterns", F.lit(0), lambda n, p: n + p["bonus"])
    out = once(d, ["hadm_id", "n_facts_parsed", "n_facts_dropped", "_have"], interaction_bonus=bonus, patterns=F.array_join(F.array_sort(F.transform("_patterns", lambda p: p["pattern"])), ","), base=sum((F.col(c) for c in C.CLUSTERS), F.lit(0)))
    out = once(out, [c for c in out.columns if c != "base"], composite_score=(F.col("base") + F.col("interaction_bonus")).cast("int"))
    s = F.col("composite_score")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in C.CLUSTERS]), F.col("_have")))
    out = out.withColumns({"_p": probability(s), "_d": days(s), "missing_clusters": F.array_join(missing, ","), "_c": 1 - F.size(missing) / len(C.CLUSTERS)})
    return out.select(
        "hadm_id", "composite_score", F.col("interaction_bonus").cast("int").alias("interaction_bonus"), "patterns", F.round("_p", 4).alias("probability"), category(s).alias("risk_category"), F.round("_d", 1).alias("estimated_days"), bucket(F.col("_d")).alias("days_bucket"),
        *[survival(s, F.col("_p"), t).alias(f"p_{t}d") for t in C.HORIZONS], "missing_clusters", F.round("_c", 2).alias("data_completeness"),
        F.when(F.col("_c") >= 0.7, "high").when(F.col("_c") >= 0.5, "medium").otherwise("low").alias("confidence"), "n_facts_parsed", "n_facts_dropped",
    )


def summary(scored: DataFrame) -> DataFrame:
    """Cohort summary; the median is the upper one. Ranks are found by counting scores, which are few, not by sorting rows."""
    hist = scored.groupBy("composite_score").agg(F.count("*").alias("n"))
    ahead = hist.withColumn("upto", F.sum("n").over(Window.orderBy("composite_score"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    median = ahead.filter("upto > floor(`all` / 2)").agg(F.min("composite_score").alias("median_score"))
    one = scored.agg(
        F.count("*").alias("n"), F.round(F.avg("composite_score"), 6).alias("mean_score"), F.min("composite_score").alias("min_score"), F.max("composite_score").alias("max_score"),
        *[F.count_if(F.col("risk_category") == n).alias(f"n_{n.lower()}") for n in ("Low", "Moderate", "High", "Critical")],
    )
    return one.crossJoin(F.broadcast(median))


def or_none(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """The scores of the given documents (hadm_id); those without any fact have nulls."""
    return documents.select("hadm_id").join(scored.filter("n_facts_parsed > 0"), "hadm_id", "left")


def report(scored: DataFrame, clusters: DataFrame) -> DataFrame:
    """(hadm_id, report): score, probability, days, survival and cluster scores as readable lines."""
    share = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
    by = clusters.groupBy("hadm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cluster_order(F.col("cluster")).alias("o"), F.concat(F.lit("  "), "cluster", F.lit(": "), F.col("score").cast("string")).alias("t")))), lambda x: x["t"]), "\n").alias("_c"))
    line = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    missing = F.when(F.col("missing_clusters") != "", F.concat(F.lit("Missing: "), "missing_clusters"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("=== Readmission Risk Report (hadm_id: "), F.col("hadm_id").cast("string"), F.lit(") ===")), line("Risk: ", F.col("risk_category")), line("Probability of 30-day readmission: ", share("probability")), line("Composite score: ", F.col("composite_score")),
        line("Confidence: ", F.col("confidence")), line("Estimated days: ", F.format_number("estimated_days", 0)), line("Bucket: ", F.col("days_bucket")), *[line(f"  by day {t}: ", share(f"p_{t}d")) for t in C.HORIZONS], F.lit("Cluster scores:"), F.col("_c"),
        line("  INTERACTIONS: +", F.col("interaction_bonus")), missing, F.concat(F.lit("Facts parsed: "), F.col("n_facts_parsed").cast("string"), F.lit(", dropped: "), F.col("n_facts_dropped").cast("string")),
    )
    return scored.join(by, "hadm_id").select("hadm_id", text.alias("report"))


def debug_json(scored: DataFrame) -> DataFrame:
    """(hadm_id, json): a result with all its columns."""
    return scored.select("hadm_id", F.to_json(F.struct("*")).alias("json"))
