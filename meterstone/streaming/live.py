"""Streaming forms: counters, gauges, EWMAs, meters, histograms and spans over unbounded measurements, and publishing of
each batch.

What a trigger brings of one key is put into order of arrival in memory, so bound it where keys are hot: by
maxFilesPerTrigger or maxBytesPerTrigger of the source. State that nothing arrives for goes after idle_ms, if given;
such a stream also runs batches without data, so it ends only when it is stopped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ewma import Average, alpha
from ..sources.sinks import checkpoint_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counters(events: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Running sums; write in update or complete mode."""
    return events.groupBy(*keys).agg(F.sum(value).alias("value"), F.count("*").alias("count"))


def gauges(
    events: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "seq"), value: str = "value"
) -> DataFrame:
    """The value set last; write in update or complete mode."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def windowed_counters(
    events: DataFrame, keys: Sequence[str], ts: str, width: str, late: str, slide: str | None = None, value: str = "value"
) -> DataFrame:
    """Sums by time window; the watermark bounds the state and what comes later is left out. Write in append mode."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(*keys, window.alias("window")).agg(F.sum(value).alias("value"))


class _Processor(StatefulProcessor):
    """Keeps one value of a key's state; subclasses say what a batch, in order of arrival, makes of it."""

    state_schema = ""
    idle_ms: int | None = None
    order: tuple[str, ...] = ("seq",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(list(self.order))
        before = self.state.get() if self.state.exists() else None
        after, out = self.step(key[0], before, batch)
        self.state.update(after)
        yield out

    def step(self, key, state: tuple | None, batch: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _processed(rows: DataFrame, processor: _Processor, output: str, mode: str, idle_ms: int | None) -> DataFrame:
    processor.idle_ms = idle_ms
    time = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(processor, output, mode, time)


def _rows(events: DataFrame, key: str, *columns: str) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), *columns)


class MeterProcessor(_Processor):
    """Per key: one rate for each window, on the grid of intervals, and the total. In order of arrival; rows of an interval
    before the one that is open are late and are dropped, whatever other keys have seen and wherever batches end."""

    state_schema = "first long, bucket long, pending double, total double, rates string, last long"

    def __init__(self, windows: Sequence[int], interval: int):
        self.windows, self.interval = sorted(set(windows)), interval

    def step(self, key, state, batch):
        first, bucket, pending, total, rates, last = state or (None, None, 0.0, 0.0, "", None)
        values = [float(x) for x in rates.split(",")] if rates else None
        for t, v in zip(batch["ts"].tolist(), batch["value"].tolist()):
            k = t // self.interval
            if bucket is not None and k < bucket:
                continue
            if bucket is not None and k > bucket:
                values, pending = self._closed(values, pending, k - bucket), 0.0
            bucket, pending, total = k, pending + v, total + v
            first, last = t if first is None else min(first, t), t if last is None else max(last, t)
        units = (last - first) / self.interval
        shown = values or [pending] * len(self.windows)
        out = {"key": [key] * len(shown), "window_us": self.windows, "rate": shown, "total": total}
        out |= {"mean": total / units if units else total, "last": last}
        out["seq"] = int(batch["seq"].iloc[-1])
        return (first, bucket, pending, total, ",".join(map(repr, values or [])), last), pd.DataFrame(out)

    def _closed(self, values: list[float] | None, pending: float, intervals: int) -> list[float]:
        """The rates once the open interval is whole and further empty ones have gone by."""
        out = []
        for n, w in enumerate(self.windows):
            a = alpha(w, self.interval)
            r = pending if values is None else values[n] + a * (pending - values[n])
            out.append(r * math.pow(1 - a, intervals - 1))
        return out


def meters(events: DataFrame, key: str, windows: Sequence[int], interval: int, idle_ms: int | None = None) -> DataFrame:
    """(key, window_us, rate, total, mean, last, seq) whenever a key gets rows, up to the one that arrived as seq; events
    has key, ts (microseconds), seq, value.

    Like the other stateful ones it needs a state store that knows several columns; running() sets it.
    """
    output = "key string, window_us long, rate double, total double, mean double, last long, seq long"
    rows = _rows(events, key, "ts", "seq", "value")
    return _processed(rows, MeterProcessor(windows, interval), output, "Update", idle_ms)


class EwmaProcessor(_Processor):
    """Per key: the exact fold of ewma_replay(), in order of arrival; marks before the last tick are dropped."""

    state_schema = "last long, rate double, pending double, ticked boolean"

    def __init__(self, window: int, interval: int, start: int):
        self.window, self.interval, self.start = window, interval, start

    def step(self, key, state, batch):
        average = Average(self.window, self.interval, *(state or (self.start, 0.0, 0.0, False)))
        for t, v in zip(batch["ts"].tolist(), batch["value"].tolist()):
            average.mark(t, v)
        after = average.last, average.rate, average.pending, average.ticked
        shown = Average(self.window, self.interval, *after).read(average.last)
        return after, pd.DataFrame({"key": [key], "value": [shown], "seq": [int(batch["seq"].iloc[-1])]})


def ewmas(
    events: DataFrame, key: str, window: int, interval: int, start: int, idle_ms: int | None = None
) -> DataFrame:
    """(key, value, seq) whenever a key gets rows: the rate as read at its last tick, up to the one that arrived as seq."""
    rows = _rows(events, key, "ts", "seq", "value")
    output = "key string, value double, seq long"
    return _processed(rows, EwmaProcessor(window, interval, start), output, "Update", idle_ms)


class HistogramProcessor(_Processor):
    """Per key: how many values there ever were, and the newest `size` of them."""

    state_schema = "count long, ts array<long>, seq array<long>, value array<double>"
    order = ("ts", "seq")

    def __init__(self, size: int):
        self.size = size

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, *columns = self.state.get() if self.state.exists() else (0, [], [], [])
        kept = pd.DataFrame(dict(zip(("ts", "seq", "value"), map(list, columns))))
        for batch in rows:
            count += len(batch)
            kept = pd.concat([kept, batch[["ts", "seq", "value"]]]).sort_values(list(self.order)).tail(self.size)
        whole = [int(x) for x in kept["ts"]], [int(x) for x in kept["seq"]]
        values = [float(x) for x in kept["value"]]
        self.state.update((int(count), *whole, values))
        yield pd.DataFrame({"key": [key[0]], "count": [count], "values": [sorted(values)]})


def histograms(events: DataFrame, key: str, size: int, idle_ms: int | None = None) -> DataFrame:
    """(key, count, values) whenever a key gets rows; its state, and what a task holds, is bounded by size."""
    rows = _rows(events, key, "ts", "seq", "value")
    return _processed(rows, HistogramProcessor(size), "key string, count long, values array<double>", "Update", idle_ms)


class SpanProcessor(_Processor):
    """Per key: a `start` opens a span (again, if one is open), an `end` right after it closes it, anything else drops it."""

    state_schema = "start long"
    order = ("ts", "seq")

    def step(self, key, state, batch):
        begun, out = state[0] if state else None, []
        for ts, what in zip(batch["ts"].tolist(), batch["what"].tolist()):
            if what == "end" and begun is not None:
                out.append((key, begun, ts - begun))
            begun = ts if what == "start" else None
        return (begun,), pd.DataFrame(out, columns=["key", "start", "duration"])


def spans(events: DataFrame, key: str, idle_ms: int | None = None) -> DataFrame:
    """(key, start, duration) of each closed span; events has key, ts, seq and what (start, end or another)."""
    rows = _rows(events, key, "ts", "seq", "what")
    return _processed(rows, SpanProcessor(), "key string, start long, duration long", "Append", idle_ms)


def publish_each(
    df: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"
) -> StreamingQuery:
    """Hands the changed rows of each batch to publish(rows, batch number)."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(publish)
    return writer.trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of (event_type, user_id, ts in microseconds, seq, value, at) from the files at path."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    at = F.col("ts").cast("timestamp")
    seq = F.col("event_id").alias("seq")
    return reader.parquet(f"{path}*").select("event_type", "user_id", F.unix_micros(at).alias("ts"), seq, "value", at.alias("at"))


def dealt(spark: SparkSession, path: str, part: F.Column, parts: int) -> str:
    """A new folder with the rows of a table in `parts` files, one after the other: part n holds those where part is n."""
    folder = checkpoint_path(spark, "dealt")
    for n in range(parts):
        spark.read.parquet(path).where(part == n).coalesce(1).write.mode("append").parquet(folder)
    return folder


@contextmanager
def rocks(spark: SparkSession):
    """The state store that stateful processors need, for the queries started inside; then the session's own again."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_to_end(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all there is and gives its result table, which the driver holds: for small results only."""
    spark = df.sparkSession
    with rocks(spark):
        writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
        writer = writer.option("checkpointLocation", checkpoint_path(spark, name))
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
