"""Hygiene of extracted lines before normalization, and the post-filters after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import NUMBER, any_of, any_prefix, first_number, let, lookup, once, parts, squeeze, strip, words
from .normalize import cluster_name, infer_cluster

KEY = ["hadm_id", "cluster", "keyword"]


def valid_line(c: Column) -> Column:
    """Exactly four parts, none empty."""
    p = parts(c)
    return (F.size(p) == 4) & F.forall(p, lambda x: x != "")


def looks_like_fact(c: Column, allow_kvt3: bool = True) -> Column:
    """Whether a line may be a fact: part counts, headers, lengths and word counts."""
    made = let(strip(c), lambda s: let(parts(s), lambda p: F.struct(s.alias("s"), p.alias("p"), F.transform(p, F.lower).alias("low"))))
    return let(made, lambda x: _fact_parts(x["s"], x["p"], x["low"], allow_kvt3))


def _fact_parts(s: Column, p: Column, low: Column, allow_kvt3: bool) -> Column:
    n = F.size(p)
    at = lambda i, a=p: F.coalesce(F.get(a, F.lit(i)), F.lit(""))
    count = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+")))
    header = (
        (F.array_join(low, "|").isin("k|v|t", "category|keyword|value|timestamp"))
        | ((n == 4) & at(0, low).startswith("category") & (at(1, low) == "keyword") & (at(2, low) == "value") & at(3, low).startswith("timestamp"))
        | (at(0, low).contains("format") & (at(1, low) == "keyword") & (at(2, low) == "value"))
        | (any_prefix(at(0, low), ["format", "output format"]) & F.element_at(low, -1).contains("timestamp"))
    )
    told = any_of(at(1, low), ["any diagnosis", "any symptom", "any procedure", "value:"]) | (at(1).contains("(") & at(1).contains(")"))
    short = (F.length(at(0)) <= 80) & (F.length(at(1)) <= 80) & (F.length(at(2)) <= 200) & (F.length(at(3)) <= 40)
    few = (count(at(0)) <= 8) & (count(at(1)) <= 8) & (count(at(2)) <= 14) & (count(at(3)) <= 4)
    right = (n == 4) | ((n == 3) & F.lit(allow_kvt3))
    return F.length(s).between(5, 400) & right & ~header & ~told & short & few & F.forall(p, lambda x: x != "")


def recovered_line(c: Column) -> Column:
    """Repairs of a literal CLUSTER prefix; null for the template header and for lines that stay no facts."""
    return let(F.transform(parts(c), lambda x: strip(x, "«»\"'")), _recovered)


def _recovered(p: Column) -> Column:
    a, k, v, t, e = (F.get(p, F.lit(i)) for i in range(5))
    literal = F.upper(a).isin("CLUSTER", "CLUSTERS")
    low = F.lower(v)
    guess = F.coalesce(infer_cluster(k), F.when(low.isin("acute", "chronic", "exist", "not exist"), "PROBLEMS").when(low.isin("yes", "no", "severe"), "SYMPTOMS"))
    template = (F.lower(k) == "keyword") & (F.lower(v) == "value")
    four = F.when(literal, F.when(~template, let(guess, lambda g: F.when(g.isNotNull(), F.concat_ws("|", g, k, v, t))))).otherwise(F.array_join(p, "|"))
    five = F.when(literal, F.concat_ws("|", k, v, t, e))
    return F.when(F.size(p) == 5, five).when(F.size(p) == 4, four).when(F.size(p) == 3, F.array_join(p, "|"))


def drop_leakage(lines: DataFrame) -> DataFrame:
    """Lines without the marks of prompt text; blank lines go as well."""
    s = F.lower(strip(F.col("line")))
    return lines.filter((s != "") & ~any_prefix(s, C.LEAK_PREFIXES) & ~any_of(s, C.LEAK_SUBSTRINGS)).withColumn("line", strip(F.col("line")))


def drop_consecutive(lines: DataFrame) -> DataFrame:
    """Lines that differ from the one before."""
    w = Window.partitionBy("hadm_id").orderBy("pos")
    return lines.withColumn("_before", F.lag("line").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("line"))).drop("_before")


def split_items(value: Column, limit: int | None = None) -> Column:
    """Items of a list value, cleaned; the first of equal ones stays."""
    found = F.filter(F.transform(F.split(strip(value), r"[;\n,]+"), lambda x: strip(squeeze(strip(x)), " -")), lambda x: x != "")
    found = F.slice(found, 1, limit) if limit else found
    return F.array_distinct(F.filter(found, lambda x: ~F.lower(x).isin([*C.TEXT_PLACEHOLDERS, "nil"])))


def expand_semantic(rows: DataFrame) -> DataFrame:
    """Facts of semantic lines: one per item of aggregate lines, else the line with its canonical value; other lines and columns stay."""
    fixed = ["hadm_id", "pos", "cluster", "keyword", "value", "ts"]
    own = [n for n in rows.columns if n not in fixed]
    base = [*fixed, *own]
    rows = once(rows, base, _kw=F.rtrim(squeeze(strip(F.col("keyword"))), F.lit(" :;,.")), _sq=squeeze(F.lower(strip(F.col("value")))), _items=split_items(F.col("value")))
    c, kw, sq, t = F.col("cluster"), F.col("_kw"), F.col("_sq"), F.col("ts")
    problem = words(sq, C.PROBLEM_WORDS, F.when(F.lower(t).isin("discharge", "dc") & sq.contains("discharg"), "acute").when((F.lower(t) == "past") & any_of(sq, ["hist", "past"]), "chronic"))
    symptom = words(sq, C.SYMPTOM_WORDS, F.when(sq.contains("severe"), "severe"))
    known = ~sq.isin(C.TEXT_PLACEHOLDERS)
    some, low = F.size("_items") > 0, F.lower(kw)
    listed = F.when(some & (c == "PROBLEMS") & low.isin(C.ACUTE_KEYS), F.array(F.lit("acute"), F.lit("Discharge"))).when(some & (c == "PROBLEMS") & low.isin(C.CHRONIC_KEYS), F.array(F.lit("chronic"), F.lit("Past")))
    listed = listed.when(some & (c == "SYMPTOMS") & low.isin(C.ADMISSION_KEYS), F.array(F.lit("yes"), F.lit("Admission"))).when(some & (c == "SYMPTOMS") & low.isin(C.DISCHARGE_KEYS), F.array(F.lit("yes"), F.lit("Discharge")))
    rows = once(rows, [*base, "_kw", "_items"], _single=F.when(known, F.when(c == "PROBLEMS", problem).when(c == "SYMPTOMS", symptom)), _listed=listed)
    single = F.col("_single")
    filled = F.when((c != "PROBLEMS") | (F.lower(t) != "unknown"), t).when(single == "acute", "Discharge").when(single == "chronic", "Past").otherwise("Admission")
    fact = lambda n, k, v, ts: F.struct(n.alias("sub_pos"), c.alias("cluster"), k.alias("keyword"), v.alias("value"), ts.alias("ts"))
    items = F.transform("_items", lambda x, i: fact(i, x, F.get("_listed", F.lit(0)), F.get("_listed", F.lit(1))))
    semantic = c.isin("PROBLEMS", "SYMPTOMS")
    facts = F.when(F.col("_listed").isNotNull(), items).when(~semantic, F.array(fact(F.lit(0), F.col("keyword"), F.col("value"), t))).when(semantic & single.isNotNull(), F.array(fact(F.lit(0), kw, single, filled)))
    return rows.select(*own, "hadm_id", "pos", F.inline(facts)).select("hadm_id", "pos", "sub_pos", "cluster", "keyword", "value", "ts", *own)


def sanitize(lines: DataFrame, scope: str = "all", cfg: C.EngineConfig = C.EngineConfig()) -> DataFrame:
    """Facts of the lines: numeric clusters hold numbers only, objective facts are one per key, semantic ones distinct.

    Scope ``objective`` drops all other clusters and gives objective facts their canonical timestamps.
    """
    if scope not in ("objective", "all"):
        raise ValueError("scope is objective or all")
    lines = once(lines, ["hadm_id", "pos"], _p=parts(F.col("line")))
    p = F.col("_p")
    if cfg.recover_3part:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        guess, inferred = cluster_name(a), infer_cluster(a)
        three = (F.size(p) == 3) & (b != "") & (c != "")
        late = F.when(guess == "DISPOSITION", "Discharge").when(guess == "UTILIZATION", "Past").otherwise("Admission")
        p = F.when(three & guess.isin(C.OBJECTIVE_CLUSTERS + C.SEMANTIC_CLUSTERS), F.array(guess, b, c, late)).when(three & inferred.isNotNull(), F.array(inferred, a, b, c)).otherwise(p)
    rows = once(lines, ["hadm_id", "pos"], _q=p).withColumnRenamed("_q", "_p").filter((F.size("_p") == 4) & F.forall("_p", lambda x: x != ""))
    c, k, v, t = (F.get("_p", F.lit(i)) for i in range(4))
    rows = once(
        rows, ["hadm_id", "pos"], cluster=cluster_name(c), keyword=k, value=F.when(v.startswith("$"), strip(F.ltrim(v, F.lit("$")))).otherwise(v),
        ts=F.when(F.lower(t) == "adm", "Admission").when(F.lower(t) == "dc", "Discharge").otherwise(t),
    )
    rows = rows.filter((F.lower("value") != "not stated") & (~F.col("cluster").isin(C.NUMERIC_CLUSTERS) | F.col("value").rlike(f"^{NUMBER}$")))
    if cfg.reclassify_nonnumeric:
        home = lookup(F.col("keyword"), {k: c for k, c in C.KEYWORD_CLUSTER.items() if c in ("DEMOGRAPHICS", "DISPOSITION")})
        rows = rows.withColumn("cluster", F.when(F.col("cluster").isin(C.SEMANTIC_CLUSTERS) & home.isNotNull(), home).otherwise(F.col("cluster")))
    objective = F.col("cluster").isin(C.OBJECTIVE_CLUSTERS)
    low = F.lower("ts")
    rank = F.when(low == "discharge", 0).when(low == "admission", 1).otherwise(2)
    canonical = F.when(F.col("cluster") == "DISPOSITION", "Discharge").when(F.col("cluster") == "UTILIZATION", "Past").otherwise("Admission")
    one = lambda found, by, order: found.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
    if scope == "all" and not cfg.expand_semantic:
        # objective facts are one per key, the others one per key, value and timestamp: clusters tell them apart, so one window does for both
        rows = rows.withColumns({"sub_pos": F.lit(0), "_o": objective, "_as": F.when(~objective, F.struct("value", "ts"))})
        kept = one(rows, [*KEY, "_as"], [F.when(F.col("_o"), rank).otherwise(0), "pos"]).drop("_as")
        return (kept.withColumn("ts", F.when(F.col("_o"), canonical).otherwise(F.col("ts"))) if cfg.canonical_objective_ts else kept).drop("_o")
    if scope == "objective":
        return one(rows.filter(objective), KEY, [rank, "pos"]).withColumns({"ts": canonical, "sub_pos": F.lit(0)})
    # lines of both kinds go through together, so that they are made once and stay where their document is
    rows = expand_semantic(rows.withColumn("_o", F.when(objective, 0).otherwise(1)))
    first = F.row_number().over(Window.partitionBy(*KEY, "_o").orderBy(rank, "pos", "sub_pos"))
    both = rows.withColumn("_n", first).filter("_o = 1 OR _n = 1").drop("_n")
    if cfg.canonical_objective_ts:
        both = both.withColumn("ts", F.when(F.col("_o") == 0, canonical).otherwise(F.col("ts")))
    return one(both, [*KEY, "value", "ts"], ["_o", "pos", "sub_pos"]).drop("_o")


def binary_flags(facts: DataFrame) -> DataFrame:
    """yes and no for flags; dialysis that is true is done."""
    k, v = F.col("keyword"), F.lower("value")
    value = F.when(k.isin(C.BINARY_FLAG_KEYWORDS) & v.isin(C.BINARY_TRUE), F.when(k == "Dialysis", "done").otherwise("yes")).when(k.isin(C.BINARY_FLAG_KEYWORDS) & v.isin(C.BINARY_FALSE), "no").otherwise(F.col("value"))
    return facts.withColumn("value", value)


def drop_unfounded_negatives(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """Drops MEDICATIONS and PROCEDURES facts of value no whose section the document lacks; ``sections`` has (hadm_id, section)."""
    guarded = F.col("cluster").isin("MEDICATIONS", "PROCEDURES") & (F.lower("value") == "no") & ~((F.col("cluster") == "PROCEDURES") & (F.col("keyword") == "Any Procedure"))
    have = sections.select("hadm_id", F.col("section").alias("cluster")).distinct()
    return facts.filter(~guarded).unionByName(facts.filter(guarded).join(have, ["hadm_id", "cluster"], "left_semi").select(*facts.columns))


def drop_low_information(facts: DataFrame) -> DataFrame:
    """Drops negative flags, specific negative procedures and a count of no new medications."""
    c, k, v = F.col("cluster"), F.col("keyword"), F.lower("value")
    zero = F.coalesce(first_number(F.col("value")).try_cast("double") == 0, F.lit(False))
    gone = ((c == "MEDICATIONS") & ((k.isin(C.LOW_INFO_FLAGS) & (v == "no")) | ((k == "New Medications Count") & zero))) | ((c == "PROCEDURES") & k.isin(C.LOW_INFO_PROCEDURES) & (v == "no"))
    return facts.filter(~gone)


def key_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def semantic_gate(facts: DataFrame) -> DataFrame:
    """One PROBLEMS and SYMPTOMS fact per normalized keyword, fragments of symptoms dropped.

    Of problems the first chronic or past one is preferred, of symptoms the first at admission.
    """
    c, nk = F.col("cluster"), F.col("_nk")
    tokens = F.split(nk, " ")
    places = (F.size(tokens) <= 2) & F.forall(tokens, lambda x: x.isin(C.ANATOMIC + C.DIRECTIONS))
    fragment = (nk == "") | nk.isin(C.FRAGMENTS) | nk.startswith("and ") | nk.startswith("or ") | places
    rows = facts.withColumn("_nk", key_norm(F.col("keyword"))).filter(~((c == "SYMPTOMS") & fragment))
    gated = c.isin("PROBLEMS", "SYMPTOMS")
    prefer = F.when(c == "PROBLEMS", (F.lower("value") == "chronic") | (F.col("ts") == "Past")).otherwise(F.col("ts") == "Admission")
    w = Window.partitionBy("hadm_id", "cluster", "_nk").orderBy(F.when(prefer, 0).otherwise(1), "pos", "sub_pos")
    return rows.withColumn("_n", F.row_number().over(w)).filter(~gated | (gated & (F.col("_n") == 1))).drop("_n", "_nk")


def gate_utilization(facts: DataFrame, md: DataFrame) -> DataFrame:
    """Drops UTILIZATION facts of documents whose UTILIZATION section says nothing; ``md`` has (hadm_id, section, line)."""
    said = F.exists(F.split("line", ";"), lambda x: (strip(x) != "") & ~F.lower(strip(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(x))).isin(C.UTILIZATION_PLACEHOLDERS))
    founded = md.filter((F.col("section") == "UTILIZATION") & said).select("hadm_id").distinct()
    use = F.col("cluster") == "UTILIZATION"
    return facts.filter(~use).unionByName(facts.filter(use).join(founded, "hadm_id", "left_semi"))


def procedure_fallback(facts: DataFrame, typed: DataFrame, default_no: bool = True) -> DataFrame:
    """PROCEDURES facts corrected by what the summary's PROCEDURES section states.

    ``typed`` has (hadm_id, keyword, value, evidence): the section's keys, and whether its text
    tells of surgery. A typed Any Procedure overrides; without positive evidence it is no. A typed
    or evidenced surgery adds a past one. Documents that ``typed`` does not name stay unchanged.
    """
    val = lambda k: F.max(F.when(F.col("keyword") == k, F.lower("value")))
    wide = typed.groupBy("hadm_id").agg(val("Any Procedure").alias("any_v"), val("Surgery").alias("surg_v"), val("Dialysis").alias("dial_v"), val("Mechanical Ventilation").alias("vent_v"), F.max("evidence").alias("evidence"))
    binary = lambda c: F.when(c.isin(C.BINARY_TRUE), "yes").when(c.isin(C.BINARY_FALSE), "no")
    wide = wide.withColumns({"any_v": binary(F.col("any_v")), "surg_v": F.coalesce(binary(F.col("surg_v")), F.when(F.col("evidence"), "yes"))})
    dial = F.coalesce(F.col("dial_v").isin("started", "done", "decided", "cancelled", *C.BINARY_TRUE), F.lit(False))
    vent = F.coalesce(~F.col("vent_v").isin([*C.TEXT_PLACEHOLDERS, *C.BINARY_FALSE]), F.lit(False))
    wide = wide.withColumn("positive", (F.coalesce(F.col("surg_v") == "yes", F.lit(False))) | dial | vent | F.coalesce("evidence", F.lit(False)))
    any_out = F.when(F.col("any_v") == "yes", F.when(F.col("positive"), "yes").otherwise("no")).when(F.col("any_v") == "no", "no").when(~F.col("positive") & F.lit(default_no), "no")
    wide = wide.withColumn("any_out", any_out).select("hadm_id", "any_out", "surg_v", "evidence", "positive")
    joined = facts.join(wide, "hadm_id", "left")
    k, v = F.col("keyword"), F.lower("value")
    proc = F.col("cluster") == "PROCEDURES"
    known = F.col("positive").isNotNull()
    gone = proc & known & (((k == "Any Procedure") & (F.col("any_out").isNotNull() | ((v == "yes") & ~F.col("positive")))) | ((k == "Surgery") & ((F.col("surg_v") == "yes") | ((F.col("surg_v") == "no") & ~F.coalesce("evidence", F.lit(False)) & (v == "yes")))))
    kept = joined.filter(~F.coalesce(gone, F.lit(False))).select(*facts.columns)
    fact = lambda kw, val, ts: F.struct(F.lit(kw).alias("keyword"), val.alias("value"), F.lit(ts).alias("ts"))
    made = F.filter(F.array(fact("Any Procedure", F.col("any_out"), "Admission"), fact("Surgery", F.when(F.col("surg_v") == "yes", "yes"), "Past")), lambda x: x["value"].isNotNull())
    added = wide.select("hadm_id", F.posexplode(made).alias("sub_pos", "_fact")).select("hadm_id", F.lit(1 << 30).cast(facts.schema["pos"].dataType).alias("pos"), F.col("sub_pos"), F.lit("PROCEDURES").alias("cluster"), "_fact.*")
    return kept.unionByName(added.select(*facts.columns))
