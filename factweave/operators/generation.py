"""Generation by a caller's client: requests side by side in a task, retries behind gates, answers written once.

A client is a function of a prompt and a response format that returns a text or raises. Clients are
made inside tasks; nothing here opens a connection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables

Client = Callable[[str, str | None], str]

#: Response formats from the strictest on; a server may refuse any but the last.
FORMATS = ("schema", "json_object", None)
PLACEHOLDER, UNSAID = "___", "not stated"
#: What a prompt asks in addition when an answer has not passed a gate.
SUFFIXES = {
    "hygiene": "\n\nCLEAN OUTPUT: answer with the JSON object alone, with all keys; write 'not stated' for what is unknown and never a placeholder.",
    "compact": "\n\nSHORT OUTPUT: answer with the JSON object alone, complete and closed, with the listed keys and no others; write 'not stated' for what is missing.",
    "placeholder": "\n\nNO PLACEHOLDERS: answer with the JSON object alone and write 'not stated' in place of every placeholder.",
    "failsafe": "\n\nLINES ONLY: answer with fact lines alone, CLUSTER|Keyword|Value|Timestamp, one a line.",
}


class Refused(Exception):
    """A client's error, after every format that could be tried."""


def ask_with_formats(client: Client, prompt: str, first: str | None) -> tuple[str, list[str]]:
    """The answer and the formats tried: the given one, then the laxer ones, then none; without a format there is one try."""
    tried: list[str] = []
    left = list(FORMATS[FORMATS.index(first) :]) if first in FORMATS else [first, *FORMATS[1:]]
    for k, form in enumerate(left):
        tried.append(form or "none")
        try:
            return client(prompt, form), tried
        except Exception as e:  # noqa: BLE001 - any error of a client means another format
            if k + 1 == len(left):
                raise Refused(str(e)) from e
    raise Refused("no format")


def first_object(text: str) -> dict | None:
    """The JSON object at a text's first brace, whatever follows it."""
    at = text.find("{")
    if at < 0:
        return None
    try:
        found = json.JSONDecoder(strict=False).raw_decode(text, at)[0]
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


class FirstStage:
    """The retries of the first stage for one document; ``asked`` counts its requests."""

    def __init__(self, client: Client, keys: list[str], baseline: bool):
        self.client, self.keys, self.baseline = client, keys, baseline
        self.asked = 0

    def _ask(self, prompt: str, form: str | None) -> str | None:
        try:
            text, tried = ask_with_formats(self.client, prompt, form)
        except Refused as e:
            self.asked += len(FORMATS) - (FORMATS.index(form) if form in FORMATS else 0)
            self.error = str(e)
            return None
        self.asked += len(tried)
        return text

    def _whole(self, text: str | None) -> bool:
        found = first_object(text) if text else None
        return found is not None and all(k in found for k in self.keys)

    def run(self, variants: list[tuple[str, str]]) -> dict:
        """The answer to the first variant (name, prompt) that is answered, bettered where it fails a gate."""
        self.error, text, name, prompt = None, None, "", ""
        for name, prompt in variants:
            if text := self._ask(prompt, "schema"):
                break
        flags = {"did_hygiene": False, "did_retry": False, "did_placeholder": False, "used_baseline": False}
        if not text:
            return {"raw": None, "variant": None, "json_ok": False, "asked": self.asked, "error": self.error or "empty", **flags}
        good = self._whole(text)
        if good and PLACEHOLDER in text:
            flags["did_hygiene"] = True
            text = self._clean(prompt + SUFFIXES["hygiene"]) or text
        if not good:
            flags["did_retry"] = True
            # the compact form of the prompt that was answered, then of the shorter variants
            for again, shorter in [(name, prompt), *[v for v in variants if v[1] != prompt][:1]]:
                for form in FORMATS:
                    better = self._ask(shorter + SUFFIXES["compact"], form)
                    if good := self._whole(better):
                        text, name, prompt = better, again, shorter
                        break
                if good:
                    break
        if PLACEHOLDER in text:
            flags["did_placeholder"] = True
            if better := self._clean(prompt + SUFFIXES["placeholder"]):
                text, good = better, True
        if not good and self.baseline:
            better = self._ask(prompt, "baseline")
            if self._whole(better):
                text, good, name, flags["used_baseline"] = better, True, "baseline", True
        return {"raw": text.replace(PLACEHOLDER, UNSAID), "variant": name, "json_ok": good, "asked": self.asked, "error": None, **flags}

    def _clean(self, prompt: str) -> str | None:
        better = self._ask(prompt, "schema")
        return better if self._whole(better) and PLACEHOLDER not in better else None


_FIRST = "raw string, variant string, json_ok boolean, asked int, error string, did_hygiene boolean, did_retry boolean, did_placeholder boolean, used_baseline boolean"


def _in_tasks(prompts: DataFrame, one: Callable[[Client, tuple], tuple], make: Callable[[], Client], at_once: int, schema: str) -> DataFrame:
    """Rows answered in the order of their batch, ``at_once`` requests of a task side by side."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        names = [c.split()[0] for c in schema.split(", ")]
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(lambda row: one(client, row), frame.itertuples(index=False, name=None))), columns=names)

    return prompts.mapInPandas(run, schema)


def first_stage(prompts: DataFrame, make: Callable[[], Client], keys: list[str], at_once: int = 8, baseline: bool = True) -> DataFrame:
    """Answers of the first stage; ``prompts`` has (hadm_id, variants array<struct<name, prompt>>), the preferred variant first.

    An answer must hold a JSON object with all ``keys``, and no placeholder. One with a placeholder is
    asked for again; one without the object is asked for in short form in each response format, also of
    the next variant; what is still without it may come from a baseline format. Errors are rows too.
    """
    names = [c.split()[0] for c in _FIRST.split(", ")]

    def one(client: Client, row: tuple) -> tuple:
        hadm_id, variants = row
        made = FirstStage(client, keys, baseline).run([(v["name"], v["prompt"]) for v in variants])
        return (hadm_id, *(made[n] for n in names))

    return _in_tasks(prompts.select("hadm_id", "variants"), one, make, at_once, f"hadm_id bigint, {_FIRST}")


def completions(prompts: DataFrame, make: Callable[[], Client], at_once: int = 8, form: str | None = None) -> DataFrame:
    """(hadm_id, raw, asked, error) of prompts (hadm_id, prompt), each asked once in each format that is left."""

    def one(client: Client, row: tuple) -> tuple:
        try:
            text, tried = ask_with_formats(client, row[1], form)
            return row[0], text, len(tried), None
        except Refused as e:
            return row[0], None, len(FORMATS) - FORMATS.index(form), str(e)

    return _in_tasks(prompts.select("hadm_id", "prompt"), one, make, at_once, "hadm_id bigint, raw string, asked int, error string")


def once_written(wanted: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """The answers of all ``wanted`` documents: those in the table at ``path``, and new ones, which are added to it.

    Only documents without an answer are asked for, so a run that was cut short goes on where its last
    write ended. Answers with an error count as none and are asked for again.
    """
    spark = wanted.sparkSession
    if tables.exists(spark, f"{path}/_SUCCESS"):
        have = spark.read.parquet(path)
        todo = wanted.join(have.filter("error IS NULL").select("hadm_id"), "hadm_id", "left_anti")
    else:
        todo = wanted
    answer(todo).write.mode("append").parquet(path)
    best = F.max_by(F.struct("*"), F.when(F.col("error").isNull(), 1).otherwise(0))
    return spark.read.parquet(path).groupBy("hadm_id").agg(best.alias("x")).select("x.*")


def second_stage(prompts: DataFrame, make: Callable[[], Client], extract: Callable[[DataFrame], DataFrame], path: str, *, at_once: int = 8, min_rate: float = 0.0, min_lines: int = 20) -> DataFrame:
    """(hadm_id, raw, did_retry) of prompts (hadm_id, prompt); ``extract`` turns raw outputs into fact lines.

    Outputs without a fact line, or of at least ``min_lines`` lines with a share of facts under
    ``min_rate``, are asked for once more, and the second output stays if it has facts. Each pass
    is one job over the documents that need it, and its answers are a table.
    """

    def judged(raw: DataFrame) -> DataFrame:
        facts = extract(raw.select("hadm_id", "raw")).groupBy("hadm_id").agg(F.count("*").alias("n_facts"))
        n_lines = F.size(F.filter(F.split(F.coalesce("raw", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
        return raw.select("hadm_id", "raw", n_lines.alias("n_lines")).join(facts, "hadm_id", "left").na.fill(0, ["n_facts"])

    ask = lambda rows: completions(rows, make, at_once)
    first = tables.kept(judged(once_written(prompts, ask, f"{path}/first")), f"{path}/judged")
    poor = (F.col("n_facts") == 0) | ((F.col("n_lines") >= min_lines) & (F.col("n_facts") < F.lit(min_rate) * F.col("n_lines")))
    again = prompts.join(first.filter(poor).select("hadm_id"), "hadm_id", "left_semi").withColumn("prompt", F.concat("prompt", F.lit(SUFFIXES["failsafe"])))
    second = judged(once_written(again, ask, f"{path}/second")).filter("n_facts > 0").select("hadm_id", F.col("raw").alias("_raw"))
    both = first.join(second, "hadm_id", "left")
    return both.select("hadm_id", F.coalesce("_raw", "raw").alias("raw"), F.col("_raw").isNotNull().alias("did_retry"))
