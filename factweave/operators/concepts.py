"""Concepts of keywords by one automaton of all synonyms, run on distinct keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import WS

#: Synonyms that are broadcast at once, at most.
MOST = 1_000_000
_WORD_END = re.compile(r"[ \t\n\x0b\f\r,;/\-()]+")


def from_config() -> list[tuple[str, str, str, int]]:
    """(cluster, synonym, group, weight) of the configured groups, in their order."""
    both = (("PROBLEMS", C.PROBLEM_GROUPS), ("SYMPTOMS", C.SYMPTOM_GROUPS))
    return [(cluster, s, gid, weight) for cluster, groups in both for gid, weight, synonyms in groups for s in synonyms]


def from_json(spark: SparkSession, path: str, cluster: str) -> list[tuple[str, str, str, int]]:
    """Groups of a JSON file: a list ``groups`` of id, risk_weight and synonyms."""
    text = spark.read.text(path, wholetext=True)
    kind = "groups array<struct<id:string,risk_weight:int,synonyms:array<string>>>"
    rows = text.select(F.posexplode(F.from_json("value", kind)["groups"]).alias("g", "x")).select("g", "x.id", "x.risk_weight", F.posexplode("x.synonyms").alias("n", "s"))
    found = rows.orderBy("g", "n").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} synonyms")
    return [(cluster, r["s"], r["id"], r["risk_weight"]) for r in found]


class Synonyms:
    """The automaton of the synonyms of a cluster; of a synonym in two groups the first holds."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.automaton = ahocorasick.Automaton()
        for order, (synonym, gid, weight) in enumerate(rows):
            s = synonym.strip().lower()
            if s and s not in self.automaton:
                self.automaton.add_word(s, (s, -order, gid, weight))
        self.automaton.make_automaton()

    def best(self, keyword: str) -> tuple[str, int] | None:
        """(group, weight): of the exact synonym, else the longest that is whole words, else the longest of at least four letters.

        One pass finds all synonyms inside the keyword, whatever their number.
        """
        if not len(self.automaton):
            return None
        words, best = None, None
        for _, (s, order, gid, weight) in self.automaton.iter(keyword):
            if s == keyword:
                tier = 3
            else:
                words = set(_WORD_END.split(keyword)) if words is None else words
                whole = s in words or keyword.startswith(f"{s} ") or keyword.endswith(f" {s}") or f" {s} " in keyword
                tier = 2 if whole else 1 if len(s) >= 4 else 0
            if tier and (best is None or (tier, len(s), order) > best[0]):
                best = (tier, len(s), order), gid, weight
        return best[1:] if best else None


def matched(keywords: DataFrame, synonyms: list[tuple[str, str, str, int]]) -> DataFrame:
    """(cluster, keyword, gid, weight) of distinct (cluster, keyword) that belong to a group."""
    if len(synonyms) > MOST:
        raise ValueError(f"more than {MOST} synonyms")
    shared = keywords.sparkSession.sparkContext.broadcast(synonyms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, list] = {}
        for cluster, *rest in shared.value:
            by.setdefault(cluster, []).append(tuple(rest))
        known = {c: Synonyms(rows) for c, rows in by.items()}
        for frame in frames:
            out = []
            for cluster, keyword in zip(frame["cluster"], frame["keyword"], strict=True):
                if cluster in known and keyword and (hit := known[cluster].best(keyword.strip(WS).lower())):
                    out.append((cluster, keyword, *hit))
            yield pd.DataFrame(out, columns=["cluster", "keyword", "gid", "weight"])

    return keywords.select("cluster", "keyword").mapInPandas(run, "cluster string, keyword string, gid string, weight int")


def with_groups(facts: DataFrame, synonyms: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """``facts`` with gid and weight: distinct keywords are matched once and joined back."""
    synonyms = from_config() if synonyms is None else synonyms
    clusters = sorted({c for c, *_ in synonyms})
    keys = facts.filter(F.col("cluster").isin(clusters)).select("cluster", "keyword").distinct()
    return facts.join(matched(keys, synonyms), ["cluster", "keyword"], "left").select(*[f"`{c}`" for c in facts.columns], "gid", "weight")
