"""Reservoirs, histograms and timers."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.paths import join_on, sortable
from .basic import KEYS
from .ewma import meter

DEFAULT_SIZE = 1024
#: For so many rows of a key, a part has as many rows as all parts together keep.
BALANCED = 1 << 26
#: Of larger row numbers, Spark doesn't limit the rows before a shuffle.
_LIMITED = "spark.sql.optimizer.windowGroupLimitThreshold"


class Reservoir(Protocol):
    """Chooses a bounded part of the rows of each key; anything with this method will do."""

    def choose(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame: ...


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int, newest: bool = False) -> DataFrame:
    """The first `size` rows of each key by order, or the last if newest.

    The rank filter stands right above the window, so that only `size` rows of a key leave each task. Spark itself lets no
    more through before the shuffle, up to a bound on `size`. Beyond it all rows of a key would go to one task, so they
    are ranked in parts first, and the last window ranks what these keep. A row's part is a hash of its order and, since
    orders may be equal, of its partition: the same whenever a task is run again.
    """
    limited = size <= int(rows.sparkSession.conf.get(_LIMITED, "1000"))
    parts = 1 if limited else isqrt(BALANCED // max(size, 1))
    names = [f"_o{n}" for n in range(len(order))] if parts > 1 else []
    if names:
        rows, order = rows.withColumns(dict(zip(names, order))), [F.col(n) for n in names]
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(parts)))
    by = [c.desc() if newest else c for c in order]
    for within in (["_part"], []) if names else ([],):
        n = F.row_number().over(Window.partitionBy(*sortable(rows, keys), *within).orderBy(*by))
        rows = rows.withColumn("_n", n).where(F.col("_n") <= size)
    return rows.drop("_n", "_part", *names)


class LastN:
    """The newest rows of each key."""

    def __init__(self, size: int = DEFAULT_SIZE, order: Sequence[str] = ("ts", "seq")):
        self.size, self.order = size, order

    def choose(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return first_rows(rows, keys, [F.col(c) for c in self.order], self.size, newest=True)


class Uniform:
    """A uniform sample by a hash of the arrival number and a seed; with recency_biased, newer rows are likelier."""

    def __init__(self, size: int = DEFAULT_SIZE, seed: int = 0, seq: str = "seq", recency_biased: bool = False):
        self.size, self.seed, self.seq, self.recency_biased = size, seed, seq, recency_biased

    def choose(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        drawn = F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col(self.seq).cast("string")))
        if not self.recency_biased:
            return first_rows(rows, keys, [drawn, F.col(self.seq)], self.size)
        # Each later row overwrites one of the slots: a row's chance falls by (1 - 1 / size) with each that follows.
        unit = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
        order = F.log(-F.log(unit)) - F.col(self.seq) / float(self.size)
        return first_rows(rows, keys, [order, F.col(self.seq)], self.size)


class Sliding:
    """The newest rows that are not older than the window at asof (the bound is inclusive)."""

    def __init__(self, size: int, window: int, asof: int | Column, order: Sequence[str] = ("ts", "seq")):
        self.size, self.window, self.asof, self.order = size, window, asof, order

    def choose(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        asof = self.asof if isinstance(self.asof, Column) else F.lit(self.asof)
        return LastN(self.size, self.order).choose(rows.where(F.col(self.order[0]) >= asof - self.window), keys)


def sorted_values(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The values of each key in one array: for rows that a reservoir has bounded. For others, stats.exact()."""
    values = F.array_sort(F.collect_list(F.col(value).cast("double")))
    return rows.groupBy(*keys).agg(values.alias("values"))


def histogram(
    events: DataFrame, reservoir: Reservoir | None = None, keys: Sequence[str] = KEYS, value: str = "value"
) -> DataFrame:
    """(keys, values, count): the sorted values of the reservoir, and how many there ever were."""
    counts = events.groupBy(*keys).agg(F.count("*").alias("count"))
    values = sorted_values((reservoir or Uniform()).choose(events, keys), keys, value)
    joined = join_on(counts, values, keys, "left")
    return joined.withColumn("values", F.coalesce("values", F.array().cast("array<double>")))


def summary(
    histograms: DataFrame, keys: Sequence[str] = KEYS, quantiles: Sequence[float] = stats.DEFAULT_QUANTILES
) -> DataFrame:
    """(keys, count, size, mean, min, max, quantiles) of histogram rows."""
    v = F.col("values")
    return histograms.select(
        *keys, "count", F.size(v).alias("size"), stats.mean(v).alias("mean"), stats.least(v).alias("min"),
        stats.greatest(v).alias("max"), stats.quantiles(v, tuple(quantiles)).alias("quantiles"),
    )


def timer(
    durations: DataFrame, windows: Sequence[int], interval: int, asof: int, reservoir: Reservoir | None = None,
    keys: Sequence[str] = KEYS, duration: str = "value", failed: Column | None = None, include_failed: bool = False,
    ts: str = "ts",
) -> DataFrame:
    """(keys, values, count, mean, rates): a histogram of the durations and a meter of the calls.

    Durations of zero are left out, and so are failed calls unless include_failed.
    """
    rows = durations.where(F.col(duration) != 0)
    if failed is not None and not include_failed:
        rows = rows.where(~failed)
    calls = rows.withColumn("_one", F.lit(1.0))
    rates = meter(calls, windows, interval, asof, keys, ts, "_one")
    return join_on(histogram(rows, reservoir, keys, duration), rates, keys)
