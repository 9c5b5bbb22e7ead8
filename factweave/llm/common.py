"""Helpers that the operators share: scratch tables, bounded key filters and Arrow access."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; whole texts may be long, and a batch is held by the JVM and by a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches, for the Python stage that follows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where the session names none.

    On a cluster a folder that only the driver sees would give empty tables, so its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The scratch tables of the innermost scope of a thread, and the scope around it.
_scope: ContextVar[tuple[list[str], tuple] | None] = ContextVar("scratch_scope", default=None)


def _place(spark: SparkSession, path: str):
    """The folder's file system and its path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back, which cuts the lineage.

    The table survives the loss of executors. Inside a ``scratch_scope`` it is deleted at the end of
    the scope, one that is to be kept at the end of the scope around that; tables outside of scopes are
    deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave-{uuid.uuid4().hex}"
    scope = _scope.get()
    if keep and scope is not None:
        scope = scope[1]
    if scope is not None:
        scope[0].append(path)
    df.write.option("compression", "zstd").parquet(path)
    if scope is None:
        system, place = _place(spark, path)
        system.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a scratch table that nothing reads any more."""
    if path := getattr(table, "scratch_path", None):
        system, place = _place(table.sparkSession, path)
        system.delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch tables made inside, once what is made of them has been written and kept.

    Scopes belong to the thread that opens them, so queries in other threads keep their tables.
    """
    made: list[str] = []
    before = _scope.set((made, _scope.get()))
    try:
        yield
    finally:
        _scope.reset(before)
        for path in made:
            system, place = _place(spark, path)
            system.delete(place, True)


#: Of the keys that more rows than this have, at most so many, the most frequent ones, are joined apart.
HOT_ROWS, HOT_KEYS = 1000, 1000


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins ``big`` with ``small``, which is unique by ``on`` and counts in ``n`` the rows of ``big`` with a key.

    Rows of the most frequent keys are not shuffled: at most ``HOT_KEYS`` keys, of more than
    ``HOT_ROWS`` rows, are broadcast to them. No other key has more than a thousandth of all rows.
    ``small`` should be a written table, since it is read twice; ``n`` goes to the result.
    """
    hot = scratch(small.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS))
    if hot.isEmpty():
        return big.join(small, on, how)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small, on, how)
    return big.join(F.broadcast(hot), on).unionByName(rest)


def _position(key, bits: int):
    return F.pmod(F.xxhash64(*key), F.lit(bits).cast("bigint"))


def key_bitmap(keys: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """A fixed-size bitmap of hashed keys: at most ``bits / 64`` words of 64 bits, whatever ``keys`` holds."""
    pos = keys.select(_position([F.col(c) for c in cols], bits).alias("_p"))
    return pos.groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_p", F.lit(64)).cast("int"))).alias("_bits"))


def flag_keys(big: DataFrame, keys: DataFrame, cols: list[str], key_cols: list[str] | None = None, bits: int = 1 << 25) -> DataFrame:
    """Adds ``_hit``: false only if the row's key is certainly not in ``keys``.

    The bitmap is the one thing that is broadcast, and its size is bounded by ``bits``: 524,288
    words by default. It saves shuffling rows that a later join would drop; that join stays exact,
    so a full bitmap costs time and never a row. Rows with a null key hash like any other value.
    """
    bitmap = key_bitmap(keys, key_cols or cols, bits)
    placed = big.withColumn("_p", _position([F.col(c) for c in cols], bits))
    joined = placed.withColumn("_word", F.shiftright("_p", 6)).join(F.broadcast(bitmap), "_word", "left")
    hit = F.call_function("shiftright", F.coalesce("_bits", F.lit(0).cast("bigint")), F.pmod("_p", F.lit(64)).cast("int")).bitwiseAND(1) == 1
    return joined.withColumn("_hit", hit).drop("_word", "_bits", "_p")


def matching(big: DataFrame, keys: DataFrame, cols: list[str], key_cols: list[str] | None = None) -> DataFrame:
    return flag_keys(big, keys, cols, key_cols).filter("_hit").drop("_hit")


def packed(df: DataFrame, *cols: str) -> DataFrame:
    """The rows as one column ``_row`` beside the columns needed, so that no name of theirs meets one of ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *cols)


def unpacked(df: DataFrame, **changed) -> list:
    """The columns of ``_row``, some of them changed."""
    return [changed.get(f.name, F.col("_row").getField(f.name)).alias(f.name) for f in df.schema["_row"].dataType]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each (nulls count as empty)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans(offs: np.ndarray, limit: int = 1 << 19):
    """Runs of whole texts of about ``limit`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def list_column(values: np.ndarray) -> pa.Array:
    """A list column from a matrix of longs."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64).reshape(-1)))


def byte_column(values: np.ndarray) -> pa.Array:
    """A binary column from a matrix of longs, whose rows Spark neither takes apart nor encodes by value."""
    rows, width = values.shape
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * np.int32(8 * width)), pa.py_buffer(np.ascontiguousarray(values))])


def field_list(df: DataFrame, cols: list[str]) -> list[str]:
    """Schema entries for columns that a Python function passes on."""
    return [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name in cols]
