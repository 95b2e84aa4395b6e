"""Counters and gauges (A1 to A4) and the selections of a snapshot table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import join_on, sortable

KEYS = ("path", "tags")
WHOLE = ("byte", "short", "int", "long")


def counter(
    events: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", initial: float = 0, as_type: str = "long"
) -> DataFrame:
    """The running sum, with the initial value. Whole numbers are summed as such, so they are exact up to 64 bits."""
    total = F.sum(F.col(value).cast(as_type) if as_type in WHOLE else F.col(value))
    return events.groupBy(*keys).agg((F.coalesce(total, F.lit(0)) + F.lit(initial)).cast(as_type).alias("value"))


def counter_with_resets(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", assign: str = "assign",
    initial: float = 0,
) -> DataFrame:
    """Rows with assign set replace the value, others add to it; the result is the last assignment and what came after.

    One aggregate per key: the last assignment is found by its order, deltas before it are told apart by a join on the key.
    """
    at = F.struct(*order)
    assigned = events.where(F.col(assign)).groupBy(*keys)
    last = assigned.agg(F.max(F.struct(*order, F.col(value).alias("_set"))).alias("_last"))
    after = F.col("_last").isNull() | (at > F.struct(*(F.col(f"_last.{o}") for o in order)))
    sums = join_on(events, last, keys, "left").where(after & ~F.col(assign)).groupBy(*keys)
    every = events.select(*keys).distinct()
    out = join_on(every, last.select(*keys, F.col("_last._set").alias("_set")), keys, "left")
    out = join_on(out, sums.agg(F.sum(value).alias("_sum")), keys, "left")
    return out.select(*keys, (F.coalesce("_set", F.lit(initial)) + F.coalesce("_sum", F.lit(0))).alias("value"))


def gauge(
    events: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts", "seq"), value: str = "value"
) -> DataFrame:
    """The value set last."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def visit(snapshots: DataFrame, kinds: Sequence[str] | None = None, path: Sequence[str] | None = None) -> DataFrame:
    """The rows of a snapshot table, of some kinds or one path."""
    if kinds is not None:
        snapshots = snapshots.where(F.col("kind").isin(list(kinds)))
    return snapshots if path is None else snapshots.where(F.col("path") == F.array(*(F.lit(p) for p in path)))


def has_metric(snapshots: DataFrame, path: Sequence[str]) -> bool:
    return not visit(snapshots, path=path).select("path").isEmpty()


def named_only(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.size("path") > 0)


#: The handlers that each kind of snapshot may go to, the best one first.
HANDLERS = {
    "counter": ("cumulative", "value"), "gauge": ("average", "value"), "ewma": ("average", "value"),
    "meter": ("meter", "average", "value"), "histogram": ("histogram",), "timer": ("timer",),
}

Handler = Callable[[DataFrame], DataFrame]


def dispatch(snapshots: Mapping[str, DataFrame], handlers: Mapping[str, Handler], keys: Sequence[str] = KEYS) -> list:
    """What the handlers make of the snapshot tables: each goes to the first handler that takes its kind.

    A handler of values also takes meters, as their mean. Timers without a handler of their own are split into a histogram
    and a meter, which are dispatched in turn. Kinds that no handler takes are passed over.
    """
    out = []
    for kind, table in snapshots.items():
        name = next((n for n in HANDLERS[kind] if n in handlers), None)
        if name is not None:
            plain = kind == "meter" and name != "meter"
            out.append(handlers[name](table.select(*keys, F.col("mean").alias("value")) if plain else table))
        elif kind == "timer":
            out += dispatch(dict(zip(("histogram", "meter"), split_timers(table, keys))), handlers, keys)
    return out


def split_timers(timers: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """A timer table as a histogram table and a meter table, for handlers that know no timers."""
    return timers.select(*keys, "values", "count"), timers.select(*keys, "mean", "rates")


def span_durations(
    events: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], starts: Column, ends: Column
) -> DataFrame:
    """(keys, start, duration) of every start that the next event of its key ends.

    Rows are sorted by key and order, and each looks at the one after it only: a hot key is one sorted run, which spills.
    """
    w = Window.partitionBy(*sortable(events, keys)).orderBy(*order)
    end, then = F.lead(ends).over(w).alias("_e"), F.lead(ts).over(w).alias("_t")
    rows = events.select(*keys, F.col(ts).alias("start"), starts.alias("_s"), end, then)
    return rows.where("_s AND _e").select(*keys, "start", (F.col("_t") - F.col("start")).alias("duration"))


def gaps(events: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The time from each event of a key to the next."""
    w = Window.partitionBy(*sortable(events, keys)).orderBy(*order)
    duration = (F.lead(ts).over(w) - F.col(ts)).alias("duration")
    return events.select(*keys, *keep, duration).where("duration IS NOT NULL")
