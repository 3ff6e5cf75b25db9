"""Streams: files, triggers, windows over event time, deduplication, keyed token buckets, change files by micro-batch."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.staging import shared_dir
from ..sources.csv_source import CsvOptions


def csv_stream(spark: SparkSession, folder: str, schema: StructType, options: CsvOptions = CsvOptions(), files_per_trigger: int = 0, flush: Flush | None = None) -> DataFrame:
    """New files of a folder as they come."""
    reader = spark.readStream.schema(schema).options(**options.spark_options(), **(flush.source_options() if flush else {}))
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).csv(folder).na.fill("")


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 0) -> DataFrame:
    """A stored table as a stream; a pattern for the path serves files and folders alike."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")


@dataclass(frozen=True)
class Flush:
    """When a sink is flushed: ``manual`` (what is there, then stop), ``interval`` seconds, ``rows`` a file, ``buffer`` (bytes a batch), or ``mixed``: whichever of the last three comes first."""

    kind: str = "manual"
    interval: float = 5.0
    rows: int = 1000
    size: int = 32 << 10

    def trigger(self) -> dict:
        if self.kind == "manual":
            return {"availableNow": True}
        return {"processingTime": "0 seconds" if self.kind in ("rows", "buffer") else f"{self.interval} seconds"}

    def source_options(self) -> dict[str, str]:
        """For the reader of files: how much a batch takes."""
        return {"maxBytesPerTrigger": str(self.size)} if self.kind in ("buffer", "mixed") else {}

    def sink_options(self) -> dict[str, str]:
        return {"maxRecordsPerFile": str(self.rows)} if self.kind in ("rows", "mixed") else {}


class Controlled:
    """A stream that can be paused and resumed: its checkpoint holds where it was."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self.start, self.query = start, start()

    @property
    def state(self) -> str:
        return "stopped" if self.query is None else "running" if self.query.isActive else "paused"

    def pause(self) -> None:
        """The batch at work is given up and run again on resuming."""
        if self.query is not None:
            self.query.stop()

    def resume(self) -> None:
        if self.query is None:
            raise ValueError("the stream has been stopped")
        if not self.query.isActive:
            self.query = self.start()

    def stop(self) -> None:
        self.pause()
        self.query = None


def write_stream(df: DataFrame, path: str, checkpoint: str, flush: Flush = Flush(), kind: str = "parquet") -> StreamingQuery:
    """To files, exactly once over restarts by the checkpoint."""
    writer = df.writeStream.format(kind).option("checkpointLocation", checkpoint).option("path", path).trigger(**flush.trigger())
    return writer.options(**flush.sink_options()).start()


class RunCounters(StreamingQueryListener):
    """Counters of the runs of streams, told by the engine while they run: no job of their own reads the rows again.

    ``total`` sums what every batch reports: batches with rows, input rows, rows that operators with state dropped as late
    (after they were combined by key in their tasks), and the observed metrics of the query by their names.
    """

    def __init__(self) -> None:
        self.total: dict[str, int] = {"batches": 0, "input_rows": 0, "dropped": 0}
        self.runs: set[str] = set()
        self.ended = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.total["batches"] += p.numInputRows > 0
        self.total["input_rows"] += p.numInputRows
        self.total["dropped"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        for row in p.observedMetrics.values():
            for k, v in row.asDict().items():
                self.total[k] = self.total.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.runs.add(str(event.runId))
            self.ended.notify_all()

    def wait_for(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until everything that the ended run of ``query`` reports has come in; an error if it doesn't."""
        query.awaitTermination()
        with self.ended:
            if not self.ended.wait_for(lambda: str(query.runId) in self.runs, seconds):
                raise TimeoutError("the run's counters didn't come in")


@contextmanager
def counted(spark: SparkSession) -> Iterator[RunCounters]:
    """Counters of all streams that run inside."""
    counters = RunCounters()
    spark.streams.addListener(counters)
    try:
        yield counters
    finally:
        spark.streams.removeListener(counters)


def each_batch(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, flush: Flush = Flush(), mode: str = "append") -> StreamingQuery:
    """Call ``action`` with each micro-batch; raising in it stops the stream."""
    return df.writeStream.outputMode(mode).foreachBatch(action).option("checkpointLocation", checkpoint).trigger(**flush.trigger()).start()


def write_changes(snapshots: DataFrame, base: str, keys: tuple[str, ...], out: str, checkpoint: str, flush: Flush = Flush()) -> StreamingQuery:
    """Each micro-batch holds new versions of keyed rows: its changes against the stored base table go to ``out``/<batch>. Keys that a batch lacks are unchanged."""
    from ..operators.diff import DiffConfig, diff, write_delta

    def action(rows: DataFrame, batch: int) -> None:
        now = rows.select(*rows.sparkSession.read.parquet(base).columns)
        known = rows.sparkSession.read.parquet(base).join(now.select(*keys).distinct(), list(keys), "left_semi").select(*now.columns)
        changes = diff(known, now, DiffConfig("key_based", keys=keys))
        write_delta(changes, f"{out}/{batch}", now.columns, mode="overwrite")  # a batch that is run again after a failure

    return each_batch(snapshots, action, checkpoint, flush)


def windows(events: DataFrame, ts: str, length: str, slide: str | None = None, keys: list[str] = (), late: str | None = None, aggregates: list[Column] = ()) -> DataFrame:
    """Tumbling or sliding windows; rows later than ``late`` are dropped from streams."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if late else timed
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return timed.groupBy(w.alias("w"), *keys).agg(*(aggregates or [F.count("*").alias("n")])).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in _names(aggregates)])


def _names(aggregates: list[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1] for a in aggregates] or ["n"]


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Runs of a key's events with no pause of ``gap``."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if late else timed
    return timed.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first of each key; state is kept for as long as rows may be late."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


@dataclass(frozen=True)
class Bucket:
    """Tokens come at ``rate`` a second up to ``burst``; each event takes ``cost``. After failures a key waits: ``first_delay``, times ``growth`` each time, up to ``most_delay``."""

    rate: float = 1.0
    burst: float = 0.0
    cost: float = 1.0
    first_delay: float = 0.0
    growth: float = 2.0
    most_delay: float = 60.0

    @property
    def capacity(self) -> float:
        return self.burst or max(1.0, 2 * self.rate)

    def step(self, state: tuple[float, float, float], at: float, failed: bool = False) -> tuple[tuple[float, float, float], bool]:
        """State (tokens, last time, delay) after an event, and whether it was admitted."""
        tokens, last, delay = state
        tokens = min(self.capacity, tokens + max(0.0, at - last) * self.rate)
        admitted = tokens >= self.cost and at - last >= delay
        if admitted:
            tokens -= self.cost
        if self.first_delay:
            delay = min(self.most_delay, delay * self.growth if delay else self.first_delay) if failed else 0.0 if delay / 2 < self.first_delay else delay / 2
        return (tokens, max(at, last), delay), admitted


def admit_stream(events: DataFrame, key: str, ts: str, bucket: Bucket, event_id: str) -> DataFrame:
    """``key, event_id, admitted`` with a token bucket for each key in the stream's state; a key's events come in order of time within a batch."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (bucket.capacity, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values([ts, event_id])
        out = []
        for at in rows[ts]:
            now, ok = bucket.step(now, at.timestamp())
            out.append(ok)
        state.update(now)
        yield pd.DataFrame({key: rows[key], event_id: rows[event_id], "admitted": out})

    timed = events.select(key, event_id, F.col(ts).cast("timestamp").alias(ts))
    kinds = dict(timed.dtypes)
    schema = f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, admitted boolean"
    return timed.groupBy(key).applyInPandasWithState(update, schema, "tokens double, last double, delay double", "append", "NoTimeout")


def admit_batch(events: DataFrame, key: str, ts: str, bucket: Bucket, event_id: str) -> DataFrame:
    """The same over a table: partitions are sorted by key and time and walked once, a key's state alone in memory."""
    schema = f"{key} {dict(events.dtypes)[key]}, {event_id} {dict(events.dtypes)[event_id]}, admitted boolean"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for rows in batches:
            out = []
            for k, at in zip(rows[key], rows["_at"], strict=True):
                if k != last:
                    last, state = k, (bucket.capacity, 0.0, 0.0)
                state, ok = bucket.step(state, at)
                out.append(ok)
            yield pd.DataFrame({key: rows[key], event_id: rows[event_id], "admitted": out})

    timed = events.select(key, event_id, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_at"))
    return timed.repartition(key).sortWithinPartitions(key, "_at", event_id).mapInPandas(walk, schema)


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give the rows it wrote: for batches over stored events."""
    import uuid

    base = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        query = write_stream(df, f"{base}/out", f"{base}/state")
    else:
        query = each_batch(df, lambda rows, k: rows.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/state", mode=mode)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")
