"""Exponentially weighted moving averages, meters and their means.

Two modes. grid: measurements are summed per interval and decayed by a closed form, one two-level aggregate without order
or state. replay: the exact fold over the marks and reads of a key in order of arrival, which also follows gaps and
irregular ticks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.paths import sortable
from .basic import KEYS


def alpha(window: int, interval: int) -> float:
    return 1 - math.exp(-interval / (2 * window))


def _buckets(
    events: DataFrame, keys: Sequence[str], interval: int, asof: Column | int, ts: str, value: str
) -> DataFrame:
    """Per key and interval: the sum. The interval that is still open at asof is told by its number."""
    n = F.floor(F.col(ts) / interval).cast("long")
    rows = events.where(F.col(ts) <= asof).groupBy(*keys, n.alias("_k"))
    return rows.agg(F.sum(value).alias("_v"), F.min(ts).alias("_first"))


def _rate(window: int, interval: int, last: Column) -> Column:
    """Aggregate over the buckets of a key: the rate after the last whole interval; what is pending if there is none."""
    a = alpha(window, interval)
    whole = F.col("_k") <= last
    sums = F.sum(F.when(whole, a * F.pow(F.lit(1 - a), last - F.col("_k")) * F.col("_v")))
    first = F.min(F.when(whole, F.struct("_k", "_v")))
    seeded = sums + F.pow(F.lit(1 - a), last - first["_k"] + 1) * first["_v"]
    return F.coalesce(seeded, F.sum("_v"), F.lit(0.0))


def ewma(
    events: DataFrame, window: int, interval: int, asof: int, keys: Sequence[str] = KEYS, ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """(keys, value): rate per interval as read at asof."""
    last = F.lit(asof // interval - 1)
    buckets = _buckets(events, keys, interval, F.lit(asof), ts, value)
    return buckets.groupBy(*keys).agg(_rate(window, interval, last).alias("value"))


def meter(
    events: DataFrame, windows: Sequence[int], interval: int, asof: int, keys: Sequence[str] = KEYS, ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """(keys, mean, rates): rates maps each window (without repeats) to its rate; mean is the total over the intervals since
    the first mark, the total itself if no time has passed."""
    last = F.lit(asof // interval - 1)
    each = (x for w in sorted(set(windows)) for x in (F.lit(w).cast("long"), _rate(w, interval, last)))
    units = (F.lit(asof) - F.min("_first")) / interval
    total = F.sum("_v")
    mean = F.when(units == 0, total).otherwise(total / F.nullif(units, F.lit(0.0)))
    buckets = _buckets(events, keys, interval, F.lit(asof), ts, value)
    return buckets.groupBy(*keys).agg(mean.alias("mean"), F.create_map(*each).alias("rates"))


@dataclass
class Average:
    """The exact state of one key: marks and reads in order of arrival. Times before the last tick are ignored."""

    window: int
    interval: int
    last: int
    rate: float = 0.0
    pending: float = 0.0
    ticked: bool = False

    def mark(self, t: int, x: float) -> None:
        if t >= self.last:
            self.read(t)
            self.pending += x

    def read(self, t: int) -> float:
        """The rate at t. It moves the state on once a whole interval has gone by since the last tick."""
        gone = t - self.last
        if gone < 0:
            return self.rate
        if self.rate == 0 and not self.ticked:
            seed = self.pending
            if gone >= self.interval:
                self.rate, self.pending, self.last, self.ticked = seed, 0.0, t, True
            return seed
        rate = self._decayed(gone)
        if gone >= self.interval:
            self.rate, self.pending, self.last = rate, 0.0, t
        return rate

    def _decayed(self, gone: int) -> float:
        a = alpha(self.window, self.interval)
        rate, missed = self.rate + a * (self.pending - self.rate), gone // self.interval - 1
        if missed <= 0:
            return rate if math.isfinite(rate) else 0.0
        if self.window > self.interval and gone > self.window:
            # Whole windows without a tick draw a rate towards one; of none at all nothing but 1 is left.
            per_window = self.window // self.interval
            whole = missed // per_window
            if not whole:
                rate = 1.0 if rate == 1 else 0.0
            elif rate < 0 and whole > 1:
                rate = 0.0  # no root
            else:
                rate **= 1 / (whole * whole)
            missed -= whole * per_window
        rate *= (1 - a) ** missed
        return rate if math.isfinite(rate) else 0.0


def ewma_replay(
    events: DataFrame, window: int, interval: int, start: int, asof: int, keys: Sequence[str] = KEYS, ts: str = "ts",
    seq: str = "seq", value: str = "value",
) -> DataFrame:
    """(keys, value): the exact fold over each key's marks in order of arrival, then a read at asof. A null value is a read.

    Rows are sorted by key and arrival and folded as they stream by; a task holds one batch and one state, however many
    marks a key has. Use ewma() where the grid will do: it needs no order.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    sort = [c.alias(n) for c, n in zip(sortable(events, keys), names)]
    rows = events.select(*keys, *sort, F.col(ts).cast("long").alias("_t"), F.col(value).cast("double").alias("_x"), seq)
    rows = rows.repartition(*names).sortWithinPartitions(*names, seq)
    rows = rows.select(*keys, *(n for n in names), "_t", "_x")
    n, schema = len(keys), StructType([*(events.schema[k] for k in keys), StructField("value", DoubleType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, row, state = None, None, None  # the key, its first row's columns, its state

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*row, pa.array([state.read(asof)])], [*keys, "value"])

        for batch in batches:
            key = list(zip(*(batch.column(n + i).to_pylist() for i in range(n)))) if n else [()] * batch.num_rows
            for i, (k, t, x) in enumerate(zip(key, batch.column(2 * n).to_pylist(), batch.column(2 * n + 1).to_pylist())):
                if row is None or k != now:
                    if row is not None:
                        yield done()
                    now, row = k, [batch.column(c).slice(i, 1) for c in range(n)]
                    state = Average(window, interval, start)
                if x is None:
                    state.read(t)
                else:
                    state.mark(t, x)
        if row is not None:
            yield done()

    return rows.mapInArrow(run, schema)
