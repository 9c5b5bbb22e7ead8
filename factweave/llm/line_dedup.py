"""Fuzzy line deduplication: MinHash of character shingles, verified, one line per component kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import byte_column, flag_keys, matching, read, scratch, scratch_scope, small_batches, spans, spread_join, utf8
from .links import linked_components

#: Characters of a shingle. Eight, since shorter ones are common to unrelated lines of a language.
SHINGLE = 8
#: Bands of three minima each; lines with a similarity of 0.8 share none with a chance of 8e-4, of 0.9 with 2e-6.
BANDS, ROWS = 10, 3
NUM, DEN = 8, 10
NEWLINE = 10
#: What makes a class of equal lines: two hashes of the compared form and its number of shingles.
CLASS = ["f0", "f1", "weight"]
#: Where a line is: a document, by its identifier and a hash of its text, and the line's number.
PLACE = ["doc_id", "_text", "line"]

#: A byte in the compared form: A-Z lower-cased, white space as a space.
_FORM = bytes(np.where(K.SPACE, 32, K.LOWER).astype(np.uint8))
#: What the part of a code point above its lowest byte adds to a shingle; nothing where there is none.
_ABOVE = np.concatenate([np.zeros(1, np.uint64), K.constants(0x10FF, 41)])
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in range(SHINGLE)]


def _forms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Of each code point its compared form's lowest byte and what is above (None if nothing), marks of line feeds and of what is not white space."""
    text = data.tobytes().decode("utf-8", "replace")
    try:
        narrow = text.encode("latin-1")
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        low = codes + np.uint32(32) * (codes - np.uint32(65) < 26)
        low[codes - np.uint32(9) < 5] = 32
        return low.astype(np.uint8), (low >> np.uint32(8)).astype(np.uint16), codes == NEWLINE, low != 32
    low = np.frombuffer(narrow.translate(_FORM), np.uint8)
    return low, None, np.frombuffer(narrow, np.uint8) == NEWLINE, low != 32


def line_shingles(data: np.ndarray, offs: np.ndarray):
    """Lines of each text (their count per text), and of each line its length, shingle hashes and fingerprint.

    Lines end at a line feed. A line is compared with A-Z lower-cased, runs of ASCII white space as
    one space and none at its ends; its length is that of this form, in code points. A line shorter
    than a shingle has itself as its one shingle, an empty one has none.

    A shingle is its eight lowest bytes as one number, to which code points over 255 add what is above.
    """
    low, above, feed, solid = _forms(data)
    at = offs if len(low) == len(data) else offs - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offs)
    feeds = np.flatnonzero(feed)
    # a text's lines: one, and one more per line feed
    lines = 1 + np.diff(np.searchsorted(feeds, at))
    a, b = np.sort(np.concatenate([at[:-1], feeds + 1])), np.sort(np.concatenate([feeds, at[1:]]))
    # of a run of white space the first stays, so a line has one space at each end at most
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    gone = np.flatnonzero(~keep)
    if len(gone):
        a, b = a - np.searchsorted(gone, a), b - np.searchsorted(gone, b)
        low, above, solid = low[keep], above if above is None else above[keep], solid[keep]
    n = len(low)
    solid = np.append(solid, True)
    a = a + ((a < b) & ~solid[a])
    b = b - ((a < b) & ~solid[b - 1])
    length = b - a
    full = np.flatnonzero(length > 0)
    made = np.where(length > 0, np.maximum(length - SHINGLE + 1, 1), 0)
    after = np.concatenate([[0], np.cumsum(made)])
    window = np.ndarray(n, "<u8", np.append(low, np.zeros(SHINGLE, np.uint8)), 0, (1,))
    over = None if above is None else _ABOVE[np.append(above, np.zeros(SHINGLE - 1, np.uint16))]
    if over is not None:
        many = over
        for j in (1, 2, 4):
            many = many[:-j] + many[j:] * _STEP[j]
        window = window + many
    place = np.arange(after[-1]) - np.repeat(after[:-1], made)
    values = K.mix(window[place + np.repeat(a, made)])
    short = full[length[full] < SHINGLE]
    if len(short):
        size = length[short].astype(np.uint64)
        own = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            x = np.minimum(a[short] + j, n - 1)
            part = low[x].astype(np.uint64) << np.uint64(8 * j)
            own += np.where(size > j, part if over is None else part + over[x] * _STEP[j], np.uint64(0))
        values[after[short]] = K.mix(K.mix(own) + size)
    prints = np.zeros((len(length), 2), np.uint64)
    if len(full):
        size = length[full].astype(np.uint64)
        prints[full, 1] = K.mix(np.add.reduceat(values, after[full]) + size)
        place *= 2
        place += 1
        prints[full, 0] = K.mix(np.add.reduceat(values * place.view(np.uint64), after[full]) + size)
    return lines, length, values, after, prints


def line_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of single lines."""
    data, offs = utf8(texts)
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in spans(offs):
        _, _, values, after, _ = line_shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        values, after = K.distinct(values, after)
        parts.append(values)
        counts.append(np.diff(after))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))


def line_sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, line number, number of shingles, fingerprint and band hashes of the lines that are not empty.

    Lines shorter than a shingle have no band hashes: they are similar to equal lines alone, which have one fingerprint.
    """

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j in spans(offs, 1 << 17):
                lines, length, values, after, prints = line_shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                low = K.minima(values, after, BANDS * ROWS, 9)
                bands = np.zeros((len(low), BANDS), np.uint64)
                for m in range(ROWS):
                    bands = K.mix(bands + low[:, m::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(after) > 0)
                owner = np.repeat(np.arange(i, j), lines)
                number = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(lines)])[:-1], lines)
                at = pa.array(owner[full])
                longs = [pa.array(np.ascontiguousarray(x[full]).view(np.int64)) for x in prints.T]
                some = length[full] >= SHINGLE
                keys = byte_column(bands[full][some])
                keys = keys.take(pa.array(np.cumsum(some) - 1, mask=~some))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("_text").take(at), pa.array(number[full].astype(np.int32)), pa.array(np.diff(after)[full].astype(np.int32)), *longs, keys], names=[*PLACE, "weight", "f0", "f1", "bands"])

    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("_text", F.xxhash64("text"))
    return small_batches(rows).mapInArrow(run, "doc_id bigint, _text bigint, line int, weight int, f0 bigint, f1 bigint, bands binary")


def band_keys(bands: np.ndarray) -> np.ndarray:
    """Keys of the bands: their hashes already hold the band's number."""
    return bands


def line_groups(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash and ``gone``, the numbers of the lines to remove."""
    # the written table fixes the row numbers; a class of equal lines is named by its first row
    rows = scratch(line_sketches(docs).withColumn("row", F.monotonically_increasing_id()))
    again = scratch(rows.groupBy(*CLASS).agg(F.min("row").alias("id"), F.count("*").alias("n")).filter("n > 1"))
    flagged = flag_keys(rows.filter("bands IS NOT NULL").select("row", "bands", *CLASS), again, CLASS)
    heads = flagged.filter("NOT _hit").select("row", "weight", "bands")
    heads = heads.unionByName(spread_join(flagged.filter("_hit").drop("_hit"), again, CLASS, "left").filter("id IS NULL OR id = row").select("row", "weight", "bands"))
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("_text", F.xxhash64("text"))

    def text_of(ids):
        spots = scratch(matching(rows.select(F.col("row").alias("id"), *PLACE), ids, ["id"]).join(ids, "id"))
        lines = matching(texts, spots, PLACE[:2]).select(*PLACE[:2], F.posexplode(F.split("text", "\n")).alias("line", "text"))
        return matching(lines, spots, PLACE).join(spots, PLACE).select("id", "text").dropDuplicates(["id"])

    named = linked_components(heads.withColumnRenamed("row", "id"), rows.count(), band_keys, BANDS, text_of, line_sets, NUM, DEN).withColumnRenamed("node", "id")
    # lines of classes with several, and the linked ones that are alone in their class
    groups = scratch(again.join(named, "id", "left").select(*CLASS, "n", F.coalesce("component", "id").alias("group")))
    several = spread_join(matching(rows.select(*PLACE, *CLASS), again, CLASS), groups, CLASS).select(*PLACE, "group")
    single = matching(rows.select(F.col("row").alias("id"), *PLACE), named, ["id"]).join(named, "id").join(again.select("id"), "id", "left_anti")
    alike = scratch(several.unionByName(single.select(*PLACE, F.col("component").alias("group"))))
    first = scratch(alike.groupBy("group").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")))
    gone = spread_join(alike, first, ["group"]).filter(F.struct(*PLACE) != F.col("first"))
    return gone.groupBy("doc_id", "_text").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines and n_removed of every row.

    Lines are linked if their sets of 8-character shingles have a Jaccard similarity of at least
    0.8; of each component the line of the smallest doc_id, then smallest line number, stays. Lines
    under 8 characters are linked if they are equal; empty lines always stay. ``n_chars``, where
    there is one, becomes the new length. With ``drop_emptied`` documents that lose all but white
    space go; their lines are all kept elsewhere.

    Null texts stay null with no lines; an empty text has one empty line. Rows with a null doc_id
    pass unchanged and remove nothing; a doc_id is a long. Rows equal in doc_id and text are one
    document and get equal results. Columns named n_lines and n_removed are replaced; all others
    pass unchanged.
    """
    with scratch_scope(docs.sparkSession):
        found = scratch(line_groups(docs), keep=True)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines")
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_row")
    rows = docs.select(rest, "doc_id", "text").withColumn("_text", F.xxhash64("text"))
    flagged = flag_keys(rows, found, ["doc_id", "_text"])
    met = flagged.filter("_hit").join(found, ["doc_id", "_text"], "left").select("_row", "text", "gone")

    def cut(batches):
        for b in batches:
            texts, counts, removed = [], [], []
            for text, gone in zip(b.column("text"), b.column("gone"), strict=True):
                text, gone = text.as_py(), frozenset(gone.as_py() or ())
                texts.append("\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone]) if gone else text)
                counts.append(0 if text is None else text.count("\n") + 1)
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], names=["_row", "_new", "n_lines", "n_removed"])

    changed = small_batches(met).mapInArrow(cut, T.StructType([met.schema["_row"], T.StructField("_new", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())]))
    if drop_emptied:
        changed = changed.filter((F.col("n_removed") == 0) | F.col("_new").rlike(r"\S"))
    length = docs.schema["n_chars"].dataType if "n_chars" in names else None

    def columns(text, removed):
        field = lambda c: F.col("_row").getField(c)
        new = {"text": text}
        if length is not None:
            new["n_chars"] = field("n_chars") if removed is None else F.when(removed > 0, F.length(text).cast(length)).otherwise(field("n_chars"))
        return [(new[c] if c in new else field(c)).alias(c) for c in names]

    same = flagged.filter("NOT _hit").select(*columns(F.col("text"), None), lines, F.lit(0).alias("n_removed"))
    return same.unionByName(changed.select(*columns(F.col("_new"), F.col("n_removed")), "n_lines", "n_removed"))


def op10_line_dedup(spark, sf_dir):
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")
