"""Repeated runs as a stream: rates by time window, and a cache of decisions as state.

The batch engine has no event time; these are extensions with the usual watermark semantics.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rates(events: DataFrame, *, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window_start, event_type, frames, total) of rows (ts, event_type, value), for batch frames and streams alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("frames"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "frames", "total")


def cached_decisions(events: DataFrame, *, keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, decision, seen): the latest decided value of each key by event time, as rows (key, decision, ts) come; `undecided` changes nothing.

    Of equal times the decision that sorts last counts. A key's state is dropped once the watermark is `keep` past its last row, so the
    state has the keys of that time and no more.
    """
    hold = int(pd.Timedelta(keep).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        decision, at, last, seen = state.get if state.exists else (None, -1, -1, 0)
        for rows in batches:
            seen += len(rows)
            times = rows["ts"].astype("datetime64[ms]").astype("int64")
            last = max(last, int(times.max()))
            decided = rows["decision"] != "undecided"
            if decided.any():
                at, decision = max((at, decision or ""), max(zip(times[decided].tolist(), rows.loc[decided, "decision"])))
        state.update((decision, at, last, seen))
        state.setTimeoutTimestamp(max(last + hold, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "decision": [decision], "seen": [seen]})

    timed = events.withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(update, "key string, decision string, seen long", "decision string, at long, last long, seen long", "update", GroupStateTimeout.EventTimeTimeout)


def each_iteration(stream: DataFrame, work, checkpoint: str):
    """Starts the stream and calls work(rows, iteration) for each micro-batch."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()


class Stopped(RuntimeError):
    """An iteration of `sustained` failed; no later one was begun."""


def sustained(spark: SparkSession, work: Callable[[int], dict], folder: str, *, iterations: int, interval: str = "0 seconds", timeout: float | None = None) -> DataFrame:
    """Runs work(1) to work(iterations), one after the other, at most one an interval, and returns a row each: iteration, elapsed_micros, error and the work's own fields as JSON.

    The iterations are a rate stream whose batches number them, one a trigger. An iteration's row is written before the next begins, and the stream's checkpoint and rows lie in
    `folder`, so a run that was cut off goes on with the iteration that has no row. The first one that fails has its error in its row, and ends the run with `Stopped`.
    """
    if iterations <= 0:
        raise ValueError("iterations must be greater than zero")
    rows_at = f"{folder.rstrip('/')}/rows"
    kinds = "iteration long, elapsed_micros long, error string, report string"

    def done() -> DataFrame:
        where = spark._jvm.org.apache.hadoop.fs.Path(rows_at)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        return spark.read.schema(kinds).json(rows_at) if there else spark.createDataFrame([], kinds)

    def one(rows: DataFrame, batch: int) -> None:
        """A trigger without new rows is none; one that comes again after a crash finds its row."""
        known = {r["iteration"]: r["error"] for r in done().select("iteration", "error").collect()}
        number = len(known) + 1
        if number > iterations or any(known.values()):
            return
        begun, error, report = time.perf_counter(), None, {}
        try:
            report = work(number)
        except Exception as e:  # noqa: BLE001  whatever the work raises ends the run
            error = f"{type(e).__name__}: {e}"
        row = [(number, int((time.perf_counter() - begun) * 1e6), error, json.dumps(report or {}))]
        spark.createDataFrame(row, kinds).coalesce(1).write.mode("append").json(rows_at)

    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    query = source.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(processingTime=interval).start()
    end = None if timeout is None else time.monotonic() + timeout
    try:
        while query.isActive:
            found = done()
            last = found.agg(F.count("*").alias("n"), F.max("error").alias("error")).first()
            if last["error"] is not None:
                raise Stopped(last["error"])
            if last["n"] >= iterations:
                break
            if end is not None and time.monotonic() > end:
                raise TimeoutError(f"{last['n']} of {iterations} iterations were done")
            query.awaitTermination(1)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return done().orderBy("iteration")
