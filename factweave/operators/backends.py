"""Text generation behind an interface: off unless a caller gives a backend; the default extracts by rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .normalize import normalize, render
from .notes import extract


def normalize_url(url: str) -> tuple[str, str]:
    """(root, root with /v1) of a server address, whether or not it names the version."""
    root = (url or "").strip().rstrip("/")
    for tail in ("/chat/completions", "/completions", "/models"):
        root = root.removesuffix(tail)
    root = root.removesuffix("/v1").rstrip("/")
    return root, f"{root}/v1"


def stop_list(args: list[str] | None) -> list[str] | None:
    """Stop sequences of repeated, comma-separated arguments; None if there are none."""
    found = [t for a in args or [] for t in (x.strip() for x in str(a).split(",")) if t]
    return found or None


def prompt_prefix(template: str) -> str:
    """What a prompt template begins with, up to the place of the note; all of it without such a place."""
    return (template or "").strip().split("{EHR_TEXT}", 1)[0]


def response_format(name: str, schema: dict) -> dict:
    """A JSON schema as a server's response format."""
    return {"type": "json_schema", "json_schema": {"name": name, "schema": schema, "strict": True}}


def generate(prompts: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(hadm_id, raw): ``make`` builds one client per task, which answers prompts (hadm_id, prompt) one by one.

    Write the result before using it: a task that runs again asks again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for f in frames:
            yield pd.DataFrame({"hadm_id": f["hadm_id"], "raw": [ask(p) for p in f["prompt"]]})

    return prompts.select("hadm_id", "prompt").mapInPandas(run, "hadm_id bigint, raw string")


def with_formats(ask: Callable[[str, str | None], str], formats: tuple[str | None, ...] = ("schema", "json_object", None)) -> Callable[[str], str]:
    """A client that asks with the strictest response format first and goes on to the next where a server refuses it.

    ``ask`` takes a prompt and a format and raises ValueError if the format is not supported; the
    first format that works is kept for the prompts that follow. Other errors are the caller's.
    """
    left = list(formats)

    def one(prompt: str) -> str:
        while True:
            try:
                return ask(prompt, left[0])
            except ValueError:
                if len(left) == 1:
                    raise
                left.pop(0)

    return one


def with_retries(ask: Callable[[str], str], good: Callable[[str], bool], variants: list[Callable[[str], str]], baseline: Callable[[str], str]) -> Callable[[str], str]:
    """A client that tries variants of a prompt until an answer is good, and falls back to a baseline answer."""

    def one(prompt: str) -> str:
        for vary in variants:
            answer = ask(vary(prompt))
            if good(answer):
                return answer
        return baseline(prompt)

    return one


def run_stages(notes: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(hadm_id, cluster, keyword, value, ts) of both stages: the lines of the first, then those of the second, normalized.

    Either stage gives (hadm_id, pos, line); of equal keys the normalizer's priorities decide, then the first stage.
    """
    one, two = first(notes), second(notes)
    return normalize(union_facts(one, two))


def union_facts(first: DataFrame, second: DataFrame) -> DataFrame:
    """The lines of two stages as one bag (hadm_id, pos, line), those of the first stage first."""
    both = first.select("hadm_id", F.lit(1).alias("_s"), "pos", "line").unionByName(second.select("hadm_id", F.lit(2).alias("_s"), "pos", "line"))
    return both.select("hadm_id", F.row_number().over(Window.partitionBy("hadm_id").orderBy("_s", "pos")).cast("bigint").alias("pos"), "line")


def by_rules(notes: DataFrame) -> DataFrame:
    """The offline backend: raw output made of the lines that the rule-based extractor finds."""
    lines = render(extract(notes))
    return lines.groupBy("hadm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("raw"))
