"""Evaluation of predicted facts against reference facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import number, once, parts, safe_ratio, squeeze, strip

KEY = ["hadm_id", "cluster", "keyword"]


def as_map(lines: DataFrame) -> DataFrame:
    """One fact per key of complete four-part lines: the last value and timestamp; ``pos`` is that of the first."""
    p = parts(F.col("line"))
    rows = lines.withColumn("_p", p).filter((F.size("_p") == 4) & F.forall("_p", lambda x: x != ""))
    c, k, v, t = (F.get("_p", F.lit(i)) for i in range(4))
    rows = rows.select("hadm_id", "pos", F.upper(c).alias("cluster"), k.alias("keyword"), F.struct(v.alias("value"), t.alias("ts")).alias("_last"))
    return rows.groupBy(*KEY).agg(F.max_by("_last", "pos").alias("_last"), F.min("pos").alias("pos")).select(*KEY, "pos", "_last.value", "_last.ts")


def keyword_norm(k: Column) -> Column:
    return F.lower(squeeze(strip(k)))


def presence(v: Column) -> Column:
    """Whether a PROBLEMS or SYMPTOMS value says present; null if it says neither."""
    low = F.lower(strip(v))
    return F.when(low.isin("acute", "chronic", "exist", "yes", "severe"), True).when(low.isin("not exist", "no"), False)


def values_match(cluster: Column, pred: Column, truth: Column) -> Column:
    """Numbers within 10 % of the truth (0.01 at least), other values alike but for case."""
    p, t = number(strip(pred)), number(strip(truth))
    near = F.abs(p - t) <= F.greatest(F.lit(0.01), F.lit(0.10) * F.abs(t))
    return F.coalesce(F.when(cluster.isin(C.NUMERIC_CLUSTERS), near).otherwise(F.lower(strip(pred)) == F.lower(strip(truth))), F.lit(False))


def _outcome(cluster: Column, keyword: Column, outcome: str, reason: Column | None = None) -> Column:
    why = F.lit(None).cast("string") if reason is None else reason
    return F.struct(cluster.alias("cluster"), keyword.alias("keyword"), F.lit(outcome).alias("outcome"), why.alias("reason"))


def by_key(p: DataFrame, t: DataFrame, require_timestamp: bool) -> DataFrame:
    """The outcomes of facts that match by their key: one join of both sides gives what was found, wrong and missed."""
    a = p.select(*KEY, F.col("value").alias("p_value"), F.col("ts").alias("p_ts"), F.lit(True).alias("told"))
    b = t.select(*KEY, F.col("value").alias("t_value"), F.col("ts").alias("t_ts"), F.lit(True).alias("true"))
    ts_ok = F.col("p_ts") == F.col("t_ts") if require_timestamp else F.lit(True)
    c, k = F.col("cluster"), F.col("keyword")
    reason = F.when(F.col("true").isNull(), "not_in_gt").when(~ts_ok, "timestamp_mismatch").when(~values_match(c, F.col("p_value"), F.col("t_value")), "value_mismatch")
    rows = once(a.join(b, KEY, "full_outer"), [*KEY, "told", "true"], reason=reason)
    right = F.col("told").isNotNull() & F.col("reason").isNull()
    wrong = F.when(F.col("told").isNotNull() & ~right, _outcome(c, k, "fp", F.col("reason")))
    missed = F.when(F.col("true").isNotNull() & ~right, _outcome(c, k, "fn"))
    return rows.select("hadm_id", F.inline(F.array_compact(F.array(F.when(right, _outcome(c, k, "tp")), wrong, missed))))


def by_presence(p: DataFrame, t: DataFrame, require_timestamp: bool) -> DataFrame:
    """The outcomes of problems and symptoms, which match by normalized keyword and presence across both clusters.

    A fold over the predictions of a keyword in their order: each takes the first reference fact that
    is free and agrees. One that finds none says why the last free one did not agree. The facts of a
    document with one normalized keyword differ in cluster, case or white space, so they are few.
    """
    fact = F.struct("pos", "cluster", "keyword", presence(F.col("value")).alias("present"), "ts")
    side = lambda x, name: x.groupBy("hadm_id", keyword_norm(F.col("keyword")).alias("_k")).agg(F.array_sort(F.collect_list(fact)).alias(name))
    both = side(p, "told").join(side(t, "true"), ["hadm_id", "_k"], "full_outer")
    none = F.array().cast(both.schema["true"].dataType)
    both = both.withColumns({"told": F.coalesce("told", none), "true": F.coalesce("true", none)})
    out = "array<struct<cluster:string,keyword:string,outcome:string,reason:string>>"
    begin = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast(out).alias("out"))

    def step(s: Column, x: Column) -> Column:
        same_ts = lambda i: F.get("true", i)["ts"] == x["ts"] if require_timestamp else F.lit(True)
        places = F.when(F.size("true") > 0, F.sequence(F.lit(0), F.size("true") - 1)).otherwise(F.array().cast("array<int>"))
        free = F.array_except(places, s["taken"])
        hit = F.get(F.filter(free, lambda i: F.coalesce((F.get("true", i)["present"] == x["present"]) & same_ts(i), F.lit(False))), F.lit(0))
        last = F.get(free, F.size(free) - 1)
        why = F.when(F.size("true") == 0, "not_in_gt").when(last.isNotNull() & ~same_ts(last), "timestamp_mismatch").otherwise("value_mismatch")
        met = F.get("true", hit)
        made = F.when(hit.isNotNull(), _outcome(met["cluster"], met["keyword"], "tp")).otherwise(_outcome(x["cluster"], x["keyword"], "fp", why))
        return F.struct(F.when(hit.isNotNull(), F.concat(s["taken"], F.array(hit))).otherwise(s["taken"]).alias("taken"), F.concat(s["out"], F.array(made)).alias("out"))

    judged = once(both, ["hadm_id", "true"], s=F.aggregate("told", begin, step))
    missed = F.transform(F.filter("true", lambda x, i: ~F.array_contains("s.taken", i)), lambda x: _outcome(x["cluster"], x["keyword"], "fn"))
    return judged.select("hadm_id", F.inline(F.concat("s.out", missed)))


def compare(pred: DataFrame, truth: DataFrame, *, require_timestamp: bool = False, semantic: bool = False) -> DataFrame:
    """(hadm_id, cluster, keyword, outcome, reason): tp, fp and fn facts, the latter two of one side only.

    With ``semantic``, problems and symptoms match by keyword and presence, see ``by_presence``; a
    true positive then carries the truth's key.
    """
    p, t = as_map(pred), as_map(truth)
    if not semantic:
        return by_key(p, t, require_timestamp)
    shared = F.col("cluster").isin("PROBLEMS", "SYMPTOMS")
    return by_key(p.filter(~shared), t.filter(~shared), require_timestamp).unionByName(by_presence(p.filter(shared), t.filter(shared), require_timestamp))


def counts(details: DataFrame, by: list[str]) -> DataFrame:
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return details.groupBy(*by).agg(of("tp"), of("fp"), of("fn"))


def ratios(table: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return table.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn)})


def per_cluster(details: DataFrame) -> DataFrame:
    """Counts of every cluster, zeros included."""
    names = details.sparkSession.createDataFrame([(c,) for c in C.CLUSTERS], "cluster string")
    return names.join(counts(details, ["cluster"]), "cluster", "left").na.fill(0, ["tp", "fp", "fn"])


def downstream(details: DataFrame, weights: dict[str, float] | None = None, gate: bool = True) -> DataFrame:
    """Weighted F1 less penalties, per document; the score is null where the recall of VITALS fails its gate."""
    return scored(details, weights, gate).drop("tp", "fp", "fn")


def scored(details: DataFrame, weights: dict[str, float] | None = None, gate: bool = True) -> DataFrame:
    """``downstream`` with the counts of outcomes, in one aggregation."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    tp = lambda o, cs: F.count_if((F.col("outcome") == o) & F.col("cluster").isin(cs))
    weighted = F.lit(0.0)
    for c, w in (weights or C.CLUSTER_WEIGHTS).items():
        t, p, n = (tp(o, [c]) for o in ("tp", "fp", "fn"))
        weighted = weighted + F.lit(w) * safe_ratio(2 * t, 2 * t + p + n)
    out = details.groupBy("hadm_id").agg(
        weighted.alias("weighted_f1"), tp("fn", C.CRITICAL_FN).alias("critical_fn"), tp("fp", C.CRITICAL_FP).alias("critical_fp"), safe_ratio(tp("tp", ["VITALS"]), tp("tp", ["VITALS"]) + tp("fn", ["VITALS"])).alias("vitals_recall"),
        *map(count, ("tp", "fp", "fn")),
    )
    out = out.withColumn("gate_passed", (F.col("vitals_recall") >= C.VITALS_MIN_RECALL) | F.lit(not gate))
    score = F.col("weighted_f1") - C.LAMBDA_FN * F.col("critical_fn") - C.LAMBDA_FP * F.col("critical_fp")
    return out.withColumn("score", F.when(F.col("gate_passed"), score))


def format_stats(lines: DataFrame, extracted: bool = False) -> DataFrame:
    """Counters of raw output lines per document; END lines and three-part 'not stated' lines are left out of the rate.

    Outputs that are no lines are judged by their ``extracted`` lines, all of which count, and of which none is a repaired one.
    """
    s = strip(F.col("line"))
    p = parts(s)
    rows = lines.filter(s != "").select("hadm_id", s.alias("_s"), p.alias("_p"))
    end = F.lower("_s") == "end"
    unsaid = (F.size("_p") == 3) & (F.lower(F.get("_p", F.lit(1))) == "not stated")
    full = lambda a: F.forall(a, lambda x: x != "")
    rows = rows.withColumns({"_end": end & ~F.lit(extracted), "_unsaid": unsaid & ~end & ~F.lit(extracted)})
    rows = rows.withColumn("_cand", ~F.col("_end") & ~F.col("_unsaid"))
    rows = rows.withColumn("_valid", F.col("_cand") & (F.size("_p") == 4) & full("_p"))
    rows = rows.withColumn("_rec", ~F.lit(extracted) & F.col("_cand") & (F.size("_p") == 5) & F.upper(F.get("_p", F.lit(0))).isin("CLUSTER", "CLUSTERS") & full(F.slice("_p", 2, 4)))
    out = rows.groupBy("hadm_id").agg(
        F.count_if("_cand").alias("raw_total_lines"), F.count_if("_valid").alias("raw_valid_kvt4_lines"), F.count_if(F.col("_cand") & ~F.col("_valid")).alias("raw_invalid_lines"),
        (F.count_if("_valid") - F.count_distinct(F.when(F.col("_valid"), F.col("_s")))).alias("raw_duplicates_exact"), F.count_if("_rec").alias("raw_recovered_cluster_prefix_lines"),
        F.count_if("_end").alias("raw_end_lines"), F.count_if("_unsaid").alias("raw_kvt3_not_stated_lines"),
    )
    effective = F.col("raw_valid_kvt4_lines") + F.col("raw_recovered_cluster_prefix_lines")
    return out.withColumn("raw_effective_valid_kvt4_lines", effective).withColumn("raw_effective_valid_rate", F.round(safe_ratio(effective, F.col("raw_total_lines")), 6))


def first_lines(lines: DataFrame, keep: Column, name: str, k: int = 5) -> DataFrame:
    """(hadm_id, name): the first ``k`` lines of each document that ``keep`` holds for.

    Ranks are limited to ``k`` before the shuffle as after it, so no task ever holds more of a document.
    """
    place = F.row_number().over(Window.partitionBy("hadm_id").orderBy("pos"))
    few = lines.select("hadm_id", "pos", strip(F.col("line")).alias("_s")).filter(keep).withColumn("_n", place).filter(F.col("_n") <= k)
    return few.groupBy("hadm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_s"))), lambda x: x["_s"]).alias(name))


def with_examples(lines: DataFrame, k: int = 5) -> DataFrame:
    """The counters of ``format_stats`` with up to ``k`` invalid lines and up to ``k`` three-part 'not stated' lines."""
    s = F.col("_s")
    p = parts(s)
    full = (F.size(p) == 4) & F.forall(p, lambda x: x != "")
    unsaid = (F.size(p) == 3) & (F.lower(F.get(p, F.lit(1))) == "not stated")
    said = (s != "") & (F.lower(s) != "end")
    invalid = first_lines(lines, said & ~unsaid & ~full, "raw_invalid_examples", k)
    unstated = first_lines(lines, said & unsaid, "raw_kvt3_not_stated_examples", k)
    out = format_stats(lines).join(invalid, "hadm_id", "left").join(unstated, "hadm_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("raw_invalid_examples", "raw_kvt3_not_stated_examples")})
