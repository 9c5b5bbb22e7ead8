"""Facts of hosted models: their lines, a cache of results, and comparisons between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import once, safe_ratio, strip
from .gates import cache_key
from .stage1 import text_lines


def mode(c: Column) -> Column:
    """The canonical name of a mode; unknown and missing ones are the default."""
    low = F.replace(F.upper(c), F.lit("-"), F.lit("_"))
    out = F.lit(C.DEFAULT_MODE)
    for name, words in reversed(C.MODES.items()):
        out = F.when(low.isin(words), name).otherwise(out)
    return out


def four_part_lines(raw: Column) -> Column:
    """The trimmed lines of exactly four parts, without fences, headings and comments; parts stay as they are."""
    return F.filter(text_lines(raw), lambda x: ~(x.startswith("```") | x.startswith("#") | x.startswith("//")) & (F.size(F.split(x, "[|]")) == 4))


def line_count(raw: Column) -> Column:
    """Lines that are not empty, a fence or a heading."""
    return F.size(F.filter(text_lines(raw), lambda x: ~(x.startswith("```") | x.startswith("#"))))


def coverage(lines: Column) -> Column:
    """The clusters of lines, upper-cased, in the order they are first seen."""
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.upper(strip(F.split_part(x, F.lit("|"), F.lit(1))))), lambda c: c != ""))


def summarize(raw: DataFrame) -> DataFrame:
    """(hadm_id, fact_count, cluster_coverage, format_validity) of raw outputs (hadm_id, raw)."""
    rows = raw.select("hadm_id", four_part_lines(F.col("raw")).alias("_l"), line_count(F.col("raw")).alias("_n"))
    return rows.select("hadm_id", F.size("_l").alias("fact_count"), F.array_join(coverage(F.col("_l")), ",").alias("cluster_coverage"), F.round(safe_ratio(F.size("_l"), F.col("_n")), 6).alias("format_validity"))


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (model, case_id, prompt, note) with the cached raw output, or null where there is none.

    ``cache`` is a table of (cache_key, raw); of several entries of a key the last written, by its column n, counts.
    """
    newest = cache.groupBy("cache_key").agg(F.max_by("raw", "n").alias("raw"))
    keyed = requests.withColumn("cache_key", cache_key(F.col("model"), F.col("case_id"), F.col("prompt"), F.col("note")))
    return keyed.join(newest, "cache_key", "left").withColumn("is_cached", F.col("raw").isNotNull())


def cache_entries(results: DataFrame, n: Column) -> DataFrame:
    """Rows for the cache table of results (model, case_id, prompt, note, raw); append them to it."""
    return results.filter("raw IS NOT NULL").select(cache_key(F.col("model"), F.col("case_id"), F.col("prompt"), F.col("note")).alias("cache_key"), "raw", n.alias("n"))


def compare(outputs: DataFrame) -> DataFrame:
    """Per model: facts, clusters, seconds and format validity of outputs (model, raw, seconds)."""
    rows = outputs.select("model", "seconds", four_part_lines(F.col("raw")).alias("_l"), line_count(F.col("raw")).alias("_n"))
    clusters = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(coverage(F.col("_l")))))), ",")
    return rows.groupBy("model").agg(F.sum(F.size("_l")).alias("fact_count"), clusters.alias("clusters"), F.round(F.sum("seconds"), 6).alias("seconds"), F.round(safe_ratio(F.sum(F.size("_l")), F.sum("_n")), 6).alias("format_validity"))


def display_rows(raw: DataFrame) -> DataFrame:
    """(hadm_id, pos, row): what a display shows of raw outputs (hadm_id, raw).

    A list of JSON objects, or one, alone or in a fence, gives cluster|keyword|value|timestamp of each
    object, whatever the case of its keys (key and time stand in for keyword and timestamp); another
    element of a list is shown as it is, as JSON. Anything else is shown by lines, an empty output as
    one empty row. The words start and end go before JSON is read, wherever they stand.
    """
    text = strip(F.coalesce("raw", F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = strip(F.regexp_replace(F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(fenced)).otherwise(text), r"(?i)(start|end)\s*\n?", ""))
    strict = {"allowSingleQuotes": "false"}
    rows = once(raw, ["hadm_id", "raw"], _b=body, _json=F.try_parse_json(body).isNotNull())
    listed = F.when(F.col("_json") & F.col("_b").startswith("["), F.from_json("_b", "array<string>", strict))
    single = F.when(F.col("_json") & F.col("_b").startswith("{"), F.array("_b"))

    def shown(x: Column) -> Column:
        entries = F.map_entries(F.from_json(x, "map<string,string>", strict))
        of = lambda *names: F.coalesce(*[F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(-1))["value"] for n in names], F.lit(""))  # noqa: B023, E731
        return F.when(x.startswith("{"), F.concat_ws("|", of("cluster"), of("keyword", "key"), of("value"), of("timestamp", "time"))).otherwise(x)

    found = F.transform(F.coalesce(single, listed), shown)
    lines = F.split(F.coalesce("raw", F.lit("")), "\r\n|[\n\r]")
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return rows.select("hadm_id", F.posexplode(F.when(F.size(found) > 0, found).otherwise(lines)).alias("pos", "row"))
