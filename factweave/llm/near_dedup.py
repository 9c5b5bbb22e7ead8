"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import flag_keys, list_column, matching, packed, read, scratch, scratch_scope, small_batches, spans, spread_join, unpacked, utf8
from .links import linked_components

#: Two collections of so many band hashes, each of two minima. Each pair of hashes, one from either
#: collection, is a table: 100 tables of four minima each from 40 minima instead of 400. Sets with a
#: similarity of 0.8 share no table with a chance of 2 * 0.36 ** 10, under 1e-4.
COLLECTION, MINIMA = 10, 2
NUM, DEN = 80, 100


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text."""
    data, offs = utf8(texts)
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in spans(offs):
        own, o = K.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends, before = K.words(own, o)
        values, after = K.distinct(*K.shingles(K.word_hashes(own, starts, ends), before, k))
        parts.append(values)
        counts.append(np.diff(after))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, set size, a 128-bit fingerprint of the set and the band hashes of both collections."""

    def run(batches):
        for b in batches:
            values, after = shingle_sets(b.column("text"), k)
            lows = []
            for i, j in spans(8 * after, 1 << 21):
                lows.append(K.minima(values[after[i] : after[j]], after[i : j + 1] - after[i], 2 * COLLECTION * MINIMA, 5))
            low = np.concatenate(lows) if lows else np.zeros((0, 2 * COLLECTION * MINIMA), np.uint64)
            bands = np.zeros((len(low), 2 * COLLECTION), np.uint64)
            for i in range(2 * COLLECTION):
                for m in range(MINIMA):
                    bands[:, i] = K.mix(bands[:, i] + low[:, i * MINIMA + m] + np.uint64(i + 1))
            sums = K.set_sums(values, after)
            cols = [b.column("doc_id"), b.column("_text"), pa.array(np.diff(after)), *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in sums.T], list_column(bands)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "_text", "n_shingles", "f0", "f1", "bands"])

    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))).mapInArrow(run, "doc_id bigint, _text bigint, n_shingles bigint, f0 bigint, f1 bigint, bands array<bigint>")


def table_keys(bands: np.ndarray) -> np.ndarray:
    """Keys of all tables: every pair of one band of either collection."""
    one, other = bands[:, :COLLECTION], K.mix(bands[:, COLLECTION:])
    return K.mix(one[:, :, None] + other[:, None, :]).reshape(len(bands), -1)


def near_groups(docs: DataFrame, k: int = 5, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Words are runs of non-white-space with A-Z lower-cased. Documents are linked if den * size of
    the intersection of their k-word shingle sets >= num * size of the union; a component is named
    by its smallest doc_id, which is kept. Documents of equal sets become one before any key is
    made, so a large group of copies costs one entry: sets are equal if their sizes and two sums over
    hashes of their members are. Candidate pairs come from the tables and are confirmed on the full
    sets of 64-bit shingle hashes; pairs that other links connect already are skipped.

    Texts of fewer than k words have their whole sequence as one shingle; null and wordless texts
    have none and are components of their own. A doc_id is a long. A null doc_id is linked with nothing: its component
    is null and it is kept. Repeated rows are results repeated; different texts of one doc_id are
    linked each on its own. Other columns are ignored.
    """
    with scratch_scope(docs.sparkSession):
        return scratch(_near_groups(docs, k, num, den).drop("_text", "_group"), keep=True)


def _near_groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows of ``near_groups``, the hash of the text and _group, which tells components apart (null: linked with nothing)."""
    # the written table fixes the row numbers; a class of equal sets is named by its first row
    rows = scratch(sketches(docs, k).withColumn("row", F.monotonically_increasing_id()))
    place, kind = ["doc_id", "_text"], ["f0", "f1", "n_shingles"]
    sets = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    again = scratch(sets.groupBy(*kind).agg(F.min("row").alias("id"), F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1"))
    flagged = flag_keys(sets.drop(*place), again, kind)
    heads = flagged.filter("NOT _hit").select("row", "n_shingles", "bands")
    heads = heads.unionByName(spread_join(flagged.filter("_hit").drop("_hit"), again, kind, "left").filter("id IS NULL OR id = row").select("row", "n_shingles", "bands"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).filter("doc_id IS NOT NULL")

    def text_of(ids):
        spots = scratch(matching(sets.select(F.col("row").alias("id"), *place), ids, ["id"]).join(ids, "id"))
        return matching(texts, spots, place).join(spots, place).select("id", "text").dropDuplicates(["id"])

    heads = heads.select(F.col("row").alias("id"), F.col("n_shingles").alias("weight"), "bands")
    named = linked_components(heads, rows.count(), table_keys, COLLECTION**2, text_of, lambda t: shingle_sets(t, k), num, den).withColumnRenamed("node", "id")
    # rows of classes with several, the linked ones that are alone in their class, and the others
    groups = scratch(again.join(named, "id", "left").select(*kind, "n", F.coalesce("component", "id").alias("_group")))
    flagged = flag_keys(sets.select("row", *place, *kind), again, kind)
    several = spread_join(flagged.filter("_hit").drop("_hit"), groups, kind, "left").select("row", *place, "n_shingles", "_group")
    single = flagged.filter("NOT _hit").select("row", *place, "n_shingles", F.lit(None).cast("bigint").alias("_group")).unionByName(several.filter("_group IS NULL"))
    several = scratch(several.filter("_group IS NOT NULL"))
    single = flag_keys(single.drop("_group"), named, ["row"], ["id"])
    linked = scratch(several.unionByName(single.filter("_hit").join(named.withColumnRenamed("id", "row"), "row").select("row", *place, "n_shingles", F.col("component").alias("_group"))))
    least = scratch(linked.groupBy("_group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    met = spread_join(linked, least, ["_group"]).select(*place, "n_shingles", "component_id", "_group")
    free = single.filter("NOT _hit").unionByName(single.filter("_hit").join(named.select(F.col("id").alias("row")), "row", "left_anti"))
    free = free.select(*place, "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("_group"))
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").select(*place, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("_group"))
    return met.unionByName(free).unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "_text", "_group")


def near_dedup(docs: DataFrame, k: int = 5, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one row of each component; all columns pass unchanged.

    Of several rows of the smallest doc_id that of the smallest text hash stays, of equal ones any.
    Rows with a null doc_id and those without words all stay.
    """
    place = ["doc_id", "_text"]
    with scratch_scope(docs.sparkSession):
        groups = scratch(_near_groups(docs, k, num, den).filter("_group IS NOT NULL"))
        several = scratch(groups.filter("kept").groupBy("_group").agg(F.min("doc_id").alias("doc_id"), F.min("_text").alias("_text"), F.count("*").alias("n")).filter("n > 1"))
        others = matching(groups.filter("kept"), several, ["_group"]).select(*place, "_group").join(several.select("_group", F.col("_text").alias("_keep")), "_group").filter("_text <> _keep")
        gone = scratch(groups.filter("NOT kept").select(*place).unionByName(others.select(*place)).distinct(), keep=True)
        once = scratch(several.select(*place), keep=True)
    rows = packed(docs, "doc_id", "text").withColumn("_text", F.xxhash64("text")).drop("text")
    flagged = flag_keys(rows, gone, place)
    rest = flagged.filter("_hit").join(gone, place, "left_anti")
    both = flagged.filter("NOT _hit").select(*place, "_row").unionByName(rest.select(*place, "_row"))
    if not once.isEmpty():
        flagged = flag_keys(both, once, place)
        alike = flagged.filter("_hit").join(once.withColumn("_once", F.lit(True)), place, "left")
        one = alike.filter("_once").select(*place, "_row").dropDuplicates(place)
        both = flagged.filter("NOT _hit").select("_row").unionByName(alike.filter("_once IS NULL").select("_row")).unionByName(one.select("_row"))
    return both.select(*unpacked(both))


def op7_near_dedup(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents"), k=4)
