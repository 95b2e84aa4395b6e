"""Where queries and their SQL are noted down, and what they share.

ASOF stands for the clock; floating results are rounded, since engines add in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, stats
from ..operators import ewma
from ..sources.events import measurements, micros

#: 2024-01-31 00:00:00 UTC in microseconds: just after the last event.
ASOF = 1_706_659_200_000_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
WINDOWS = (6 * HOUR, DAY, 7 * DAY)

found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        found[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ts, seq = micros(F.col("ts")).alias("ts"), F.col("event_id").alias("seq")
    return e.select("event_type", "user_id", ts, seq, "value", "props")


def metric_events(spark: SparkSession, sf_dir: str, kind: str = "counter", value: Column | None = None) -> DataFrame:
    """The events as measurements of events/<type>, tagged by a third of the users."""
    path = paths.path("events", F.col("event_type"))
    value, as_type = (F.col("value"), "double") if value is None else (value, "double" if kind != "counter" else "long")
    tags = {"group": F.col("user_id") % 3}
    e = events(spark, sf_dir)
    return measurements(e, path, F.col("ts"), F.col("seq"), value, tags, kind, as_type=as_type)


def type_of() -> Column:
    return F.col("path")[1].alias("event_type")


def group_of() -> Column:
    return F.col("tags")["group"].alias("grp")


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


#: The events with times in microseconds and the third that a user belongs to.
E = "e AS (SELECT *, epoch_us(ts) AS t, user_id % 3 AS grp FROM events)"


def quantile_sql(q: str, v: str = "v", n: str = "n") -> str:
    p = f"({q} * ({n} + 1))"
    i = f"floor({p})::BIGINT"
    inner = f"{v}[{i}] + ({p} - {i}) * ({v}[{i} + 1] - {v}[{i}])"
    return f"CASE WHEN {n} = 0 THEN 0 WHEN {i} < 1 THEN {v}[1] WHEN {i} >= {n} THEN {v}[{n}] ELSE {inner} END"


def ewma_sql(window: int, keys: str, bucket: int = HOUR, of: str = "e", value: str = "value") -> str:
    """b and r: the rate of each key as read at ASOF, from the rows of a table with t and a value."""
    a, last = ewma.alpha(window, bucket), ASOF // bucket - 1
    return f"""b AS (SELECT {keys}, floor(t / {float(bucket)})::BIGINT AS k, sum({value}) AS v FROM {of} GROUP BY ALL),
r AS (SELECT {keys}, sum(CASE WHEN k <= {last} THEN {a!r}::DOUBLE * pow({1 - a!r}::DOUBLE, {last} - k) * v END)
  + pow({1 - a!r}::DOUBLE, {last + 1} - min(k)) * arg_min(v, k) AS rate FROM b GROUP BY ALL)"""


def rates_sql(select: str, before: str = E, of: str = "e", value: str = "value") -> str:
    """A query over rates (event_type, grp, window_us, rate)."""
    one = "SELECT event_type, grp, {0}::BIGINT AS window_us, rate FROM (WITH {1} SELECT * FROM r)"
    each = [one.format(w, ewma_sql(w, "event_type, grp", of=of, value=value)) for w in WINDOWS]
    return f"WITH {before}, rates AS ({' UNION ALL '.join(each)}) {select}"


#: Of a sorted list v.
STATS = "len(v) AS size, round(list_avg(v), 6) AS mean, v[1] AS least, v[-1] AS greatest"


def stats_columns() -> list[Column]:
    v = F.col("values")
    ends = stats.least(v).alias("least"), stats.greatest(v).alias("greatest")
    return [F.size(v).cast("long").alias("size"), F.round(stats.mean(v), 6).alias("mean"), *ends]
