"""A corpus pipeline of five operators: filter, clean, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, works on all rows
it is given and returns a DataFrame; the next stage reads what this one has written. Null and empty
texts, null identifiers, repeated rows and empty tables go through every stage; what each does with
them is stated at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import line_dedup, mixing, near_dedup, packing, quality
from factweave.llm.common import discard, read, scratch, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold; the others go."""
    labels = read(spark, sf_dir, "labels").filter(~quality.held_out())
    model = quality.fit(read(spark, sf_dir, "documents"), labels)
    return quality.score(docs, model, "_score").filter(f"_score >= {quality.THRESHOLD}").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses all its text goes, since all of it is kept elsewhere."""
    return line_dedup.dedup_lines(docs, drop_emptied=True).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8)."""
    return near_dedup.near_dedup(docs, k=5).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by source so that sources get their target weights, in a global shuffle."""
    return mixing.mix(docs).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mix", mix_stage),
    ("packing", pack_stage),
]

#: The stages learn a classifier, compare sets and pack tokens: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next.

    What a stage writes on its way is deleted with it, and its result once the next one is written.
    """
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch_scope(spark):
            before, docs = docs, scratch(stage(spark, docs, sf_dir), keep=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
