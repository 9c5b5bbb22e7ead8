"""Runs followed as their artifacts arrive: state and a timer for each run, and a sink that replays leave as it is."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources import tables

#: Whole minutes that the rate of the window covers.
WINDOW = 60
#: The store that holds the state of runs on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = T.StructType().add("done", "long").add("errors", "long").add("retries", "long").add("total", "long").add("first", "long").add("last", "long").add("minutes", T.ArrayType(T.LongType())).add("counts", T.ArrayType(T.LongType()))
_SHOWN = "run bigint, n_total bigint, done bigint, errors bigint, retries bigint, first bigint, last bigint, recent bigint, finished boolean, stalled boolean"
_COLUMNS = [c.split()[0] for c in _SHOWN.split(", ")]


class RunState(StatefulProcessor):
    """What is known of one run: artifacts done, failed and tried again, first and last, and the done ones of each late minute.

    The run ends with the artifact that makes ``done`` the run's total; what comes later is not
    counted. A run without an artifact for ``stall`` seconds of event time is reported as stalled.
    """

    def __init__(self, stall: int):
        self.stall = stall

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", _STATE)

    def _shown(self, key, s, stalled: bool) -> pd.DataFrame:
        done, errors, retries, total, first, last, _, counts = s
        return pd.DataFrame([(key[0], total, done, errors, retries, first, last, sum(counts), done >= total, stalled)], columns=_COLUMNS)

    def handleInputRows(self, key, rows, timerValues):
        # a batch is bounded by the source's options, and so are a run's rows in it
        batch = pd.concat(list(rows)).sort_values(["at", "doc"], kind="stable")
        total = int(batch["n_total"].iloc[0])
        done, errors, retries, _, first, last, minutes, counts = self.state.get() if self.state.exists() else (0, 0, 0, total, None, None, [], [])
        is_done = (batch["kind"] == "done").to_numpy()
        before = done + is_done.cumsum() - is_done
        batch, is_done = batch[before < total], is_done[before < total]
        if not len(batch):
            return
        at = batch["at"].to_numpy()
        first = int(at[0]) if first is None else min(first, int(at[0]))
        last = int(at[-1]) if last is None else max(last, int(at[-1]))
        late = dict(zip(minutes, counts, strict=True))
        for m, n in pd.Series(at[is_done] // 60_000_000).value_counts().items():
            late[int(m)] = late.get(int(m), 0) + int(n)
        late = {m: n for m, n in sorted(late.items()) if m > last // 60_000_000 - WINDOW}
        s = (done + int(is_done.sum()), errors + int((batch["kind"] == "error").sum()), retries + int((batch["kind"] == "retry").sum()), total, first, last, list(late), list(late.values()))
        self.state.update(s)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s[0] < total:
            self.handle.registerTimer(last // 1000 + self.stall * 1000)
        yield self._shown(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            yield self._shown(key, self.state.get(), True)

    def close(self) -> None:
        pass


def progress_stream(artifacts: DataFrame, totals: DataFrame, late: str = "10 minutes", stall: int = 86_400) -> DataFrame:
    """A row for each run and batch in which something of it arrived or its time ran out.

    ``artifacts`` is a stream of (run, doc, ts, kind): done, error, retry or another; ``totals`` has
    (run, n_total). Artifacts of runs without a total are not counted. ``first`` and ``last`` are
    microseconds, ``recent`` counts what was done in the last ``WINDOW`` minutes up to ``last``.
    """
    rows = artifacts.withWatermark("ts", late).join(totals, "run").select("run", "doc", F.unix_micros("ts").alias("at"), "kind", "n_total", "ts")
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=RunState(stall), outputStructType=_SHOWN, outputMode="Update", timeMode="EventTime")


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each batch is one partition under its number, which a replay of the batch writes anew.

    An empty batch writes nothing, and other batches are never touched.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the sink, the run's history: what happened in a batch before what ran out in it."""
    return spark.read.schema(f"{_SHOWN}, batch_id bigint").parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """One row per run, the last: counts, rates per minute since the first artifact and in the window, and minutes left."""
    last = rows.groupBy("run").agg(F.max_by(F.struct(*_COLUMNS[1:]), F.struct("batch_id", "stalled")).alias("x")).select("run", "x.*")
    minutes = (F.col("last") - F.col("first")) / 60e6
    last = last.withColumns({"rate_avg": F.when(F.col("done") >= 2, F.try_divide(F.col("done"), minutes)), "rate_window": F.col("recent") / F.lit(float(WINDOW))})
    eta = F.when(F.col("n_total") > F.col("done"), F.try_divide(F.col("n_total") - F.col("done"), F.col("rate_avg")))
    return last.select("run", "n_total", "done", "errors", "retries", F.timestamp_micros("first").alias("started"), F.timestamp_micros("last").alias("seen"), "finished", "stalled", F.round("rate_avg", 6).alias("rate_avg"), F.round("rate_window", 6).alias("rate_window"), F.round(eta, 4).alias("eta_min"))


def start(progress: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the rows of ``progress_stream`` to the sink: all that has arrived, or without end at an interval."""
    conf, name = progress.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STORE)  # a query keeps the store it starts with
    try:
        writer = progress.writeStream.foreachBatch(upsert(path)).option("checkpointLocation", checkpoint).outputMode("update")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        conf.set(name, before) if before else conf.unset(name)


def follow(progress: DataFrame, path: str, checkpoint: str, runs: int, every: str = "10 seconds", patience: float = 1.0) -> DataFrame:
    """Follows runs until all of them have ended, then stops the stream; the last row of each run."""
    spark = progress.sparkSession
    query = start(progress, path, checkpoint, every)
    try:
        while not query.awaitTermination(max(1.0, patience)):
            if tables.exists(spark, path) and latest(snapshots(spark, path)).filter("finished").count() >= runs:
                break
    finally:
        query.stop()
    return latest(snapshots(spark, path))


def run_once(progress: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Counts all that has arrived since the last call with this checkpoint; the last row of each run."""
    start(progress, path, checkpoint).awaitTermination()
    return latest(snapshots(progress.sparkSession, path))
