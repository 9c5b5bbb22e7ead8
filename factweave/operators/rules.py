"""Rule tables as data: an interval index of rules that are read at run time, and its lookup.

Rules are rows (cluster, keyword, ord, lo, hi, points); the first rule, by ``ord``, whose closed range
holds a value counts. Plans do not grow with the number of rules.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

KEY = ["cluster", "keyword"]
RULE = "cluster string, keyword string, ord bigint, lo double, hi double, points int"
_INDEX = "cluster string, keyword string, bounds array<double>, at array<int>, after array<int>"


def sweep(rules: list[tuple[int, float, float, int]]) -> tuple[list[float], list[int | None], list[int | None]]:
    """Sorted bounds of ranges (ord, lo, hi, points), the points at each bound and those between it and the next.

    The ranges that are open are kept in a heap by their order, so n ranges take n log n steps.
    """
    rules = [r for r in rules if r[1] is not None and r[2] is not None and r[1] <= r[2]]
    bounds = sorted({b for _, lo, hi, _ in rules for b in (lo, hi)})
    waiting = sorted(rules, key=lambda r: r[1])
    at, after, live, k = [], [], [], 0
    for b in bounds:
        while k < len(waiting) and waiting[k][1] <= b:
            order, _, hi, p = waiting[k]
            heapq.heappush(live, (order, hi, p))
            k += 1
        while live and live[0][1] < b:
            heapq.heappop(live)
        at.append(live[0][2] if live else None)
        while live and live[0][1] <= b:
            heapq.heappop(live)
        after.append(live[0][2] if live else None)
    return bounds, at, after


def index(rules: DataFrame) -> DataFrame:
    """One row per key (cluster, keyword): sorted bounds and the points at and after each. A key's rules are one group."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = sweep(list(frame.sort_values("ord")[["ord", "lo", "hi", "points"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(*key, *found)], columns=[*KEY, "bounds", "at", "after"])

    return rules.groupBy(*KEY).applyInPandas(run, _INDEX)


def position(bounds: Column, x: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``x``, by binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + 1)).cast("int") + 1)
    begin = F.struct(F.lit(0).alias("a"), F.size(bounds).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        low = F.get(bounds, middle) <= x
        done = s["a"] >= s["b"]
        return F.struct(F.when(~done & low, middle + 1).otherwise(s["a"]).alias("a"), F.when(~done & ~low, middle).otherwise(s["b"]).alias("b"))

    return F.aggregate(steps, begin, halve)["a"]


def points_at(x: Column) -> Column:
    """The points of the first rule that holds ``x``, of rows joined with the index; null if none does or ``x`` is null."""
    n = position(F.col("bounds"), x)
    found = F.when(F.get("bounds", n - 1) == x, F.get("at", n - 1)).otherwise(F.get("after", n - 1))
    return F.when(x.isNotNull() & ~F.isnan(x) & (n > 0), found)


def with_points(facts: DataFrame, indexed: DataFrame, value: str = "value_num", name: str = "points") -> DataFrame:
    """``facts`` with the points of the rules of their key. The join is planned by the sizes of both sides."""
    rows = facts.join(indexed.withColumnsRenamed({"bounds": "_bounds", "at": "_at", "after": "_after"}), KEY, "left")
    rows = rows.withColumnsRenamed({"_bounds": "bounds", "_at": "at", "_after": "after"})
    return rows.withColumn(name, points_at(F.col(value).cast("double"))).drop("bounds", "at", "after")


def from_config(spark: SparkSession) -> DataFrame:
    """The configured ranges as a rule table."""
    rows = [(c, k, i, float(lo), float(hi), p) for (c, k), (_, ranges) in C.RANGES.items() for i, (lo, hi, p) in enumerate(ranges)]
    return spark.createDataFrame(rows, RULE)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file: clusters, their keywords, and for each a list ``ranges`` of min, max and score, first match first.

    A missing end is open. Other entries of a keyword are not read here.
    """
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,map<string,struct<ranges:array<struct<min:double,max:double,score:int>>>>>"
    clusters = text.select(F.explode(F.from_json("value", kind)).alias("cluster", "_k"))
    keywords = clusters.select("cluster", F.explode("_k").alias("keyword", "_r")).select("cluster", "keyword", F.posexplode("_r.ranges").alias("ord", "r"))
    low, high = F.coalesce("r.min", F.lit(float("-inf"))), F.coalesce("r.max", F.lit(float("inf")))
    return keywords.select("cluster", "keyword", F.col("ord").cast("bigint").alias("ord"), low.alias("lo"), high.alias("hi"), F.col("r.score").alias("points"))
