"""Exact deduplication by a tree merge of digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, scratch, spread_join

#: Entries that one run holds, about, and runs that meet in a round: there are a power of ``FAN`` of runs.
RUN_ROWS, FAN = 1_000_000, 8
SPACES = r"[\x20\x09-\x0D]+"


KEY = ["_digest", "_bytes", "_check"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text and, of the text without white space, SHA-256 digest, byte length and a second hash."""
    text = F.coalesce("text", F.lit(""))
    body = F.regexp_replace(text, SPACES, "")
    return docs.select("doc_id", F.length(text).cast("long").alias("_size"), body.alias("_body")).select(
        "doc_id", "_size", F.unhex(F.sha2("_body", 256)).alias("_digest"), F.octet_length("_body").alias("_bytes"), F.xxhash64("_body").alias("_check")
    )


def _merged(entries: DataFrame, runs: int) -> DataFrame:
    """Brings each run to one task, sorts it there by digest and merges what is equal, best row first.

    Entries are equal if digest, byte length and second hash are: an entry that only shares the digest is not merged.
    """
    sorted_runs = entries.repartition(runs, "_run").sortWithinPartitions("_run", *KEY)
    return sorted_runs.groupBy("_run", *KEY).agg(F.sum("n").alias("n"), F.min("_best").alias("_best"))


def tree_merge(rows: DataFrame, runs: int, fan: int = FAN) -> DataFrame:
    """Merges sorted digest runs in binomial rounds until each digest has one entry.

    Rows are dealt evenly to ``runs`` runs, ``runs`` being a power of ``fan``; a run is sorted by
    digest and holds one entry per digest: how many rows it stands for and the best of them. In
    round r the ``fan`` runs whose numbers differ in digit r alone exchange entries: each keeps
    those whose digest has its own digit there and merges what the others send. After the last
    round a run holds all entries of its digests. A digest that a third of all rows share is in
    each run once from the start, so no task ever meets more than ``fan`` entries of it.
    """
    best = F.struct((-F.col("_size")).alias("s"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    entries = rows.select(*KEY, F.lit(1).cast("long").alias("n"), best.alias("_best"), F.pmod(F.monotonically_increasing_id(), F.lit(runs)).cast("int").alias("_run"))
    merged, step = _merged(entries, runs), 1
    while step < runs:
        own = F.pmod(F.floor(F.col("_run") / step), F.lit(fan))
        digit = F.pmod(F.floor(F.pmod(F.xxhash64("_digest"), F.lit(runs)) / step), F.lit(fan))
        merged = _merged(merged.withColumn("_run", (F.col("_run") + (digit - own) * step).cast("int")), runs)
        step *= fan
    return merged.select(*KEY, "n", F.col("_best.d").alias("keep_id"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with the identifier of the row that stays of its group.

    Texts are equal if they are the same after deleting ASCII white space; null counts as empty.
    The row with the most code points stays, then the smallest doc_id; a null doc_id comes last.
    Repeated rows are members of their group like any other, and each row whose doc_id is that of
    the row that stays is marked as kept. Empty tables give empty results; other columns are ignored.
    """
    rows = scratch(digests(docs.select("doc_id", "text")))
    runs = FAN**2
    while runs * RUN_ROWS < rows.count():
        runs *= FAN
    groups = scratch(tree_merge(rows, runs))
    return spread_join(rows, groups, KEY).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256")
    )


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""
