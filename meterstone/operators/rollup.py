"""Roll-ups over the tag sets of a path, each kind by its own rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import join_on
from .histogram import first_rows, sorted_values

#: Values of a merged histogram, at most: a merged reservoir is a reservoir again.
MOST_VALUES = 1 << 16


def cumulative(snapshots: DataFrame, keys: Sequence[str] = ("path",), value: str = "value") -> DataFrame:
    return snapshots.groupBy(*keys).agg(F.sum(value).alias(value))


def average(snapshots: DataFrame, keys: Sequence[str] = ("path",), value: str = "value") -> DataFrame:
    """Every tag set counts once, however many measurements it has; samples counts the tag sets."""
    return snapshots.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("samples"))


def weighted(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Two averages by their samples; 0 where there are none."""
    return F.when(na + nb == 0, 0.0).otherwise((a * na + b * nb) / F.nullif(na + nb, F.lit(0)))


def meters(snapshots: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, mean, samples, rates): averages by window; the tag sets of one path share their windows."""
    each = snapshots.select(*keys, F.explode("rates").alias("_w", "_r")).groupBy(*keys, "_w")
    pairs = F.array_sort(F.collect_list(F.struct("_w", "_r")))
    rates = each.agg(F.avg("_r").alias("_r")).groupBy(*keys).agg(F.map_from_entries(pairs).alias("rates"))
    means = snapshots.groupBy(*keys).agg(F.avg("mean").alias("mean"), F.count("*").alias("samples"))
    return join_on(means, rates, keys)


def merge_meters(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two meter tables (keys, mean, samples, rates): the left's windows stay, those only on the right go."""
    theirs = right.select(*keys, F.col("mean").alias("_m"), F.col("samples").alias("_n"), F.col("rates").alias("_r"))
    joined = join_on(left.withColumnRenamed("samples", "_s"), theirs, keys, "left")
    n, s, rates = F.coalesce("_n", F.lit(0)), F.col("_s"), F.col("_r")

    def one(w: Column, x: Column) -> Column:
        return F.when(rates[w].isNull(), x).otherwise(weighted(x, s, rates[w], n))

    merged = F.when(rates.isNull(), F.col("rates")).otherwise(F.transform_values("rates", one))
    mean = weighted(F.col("mean"), s, F.coalesce("_m", F.lit(0.0)), n)
    return joined.select(*keys, mean.alias("mean"), (s + n).alias("samples"), merged.alias("rates"))


def histograms(snapshots: DataFrame, keys: Sequence[str] = ("path",), most: int = MOST_VALUES) -> DataFrame:
    """(keys, values, count): counts add up; the values are those of all reservoirs together.

    Beyond `most` values they are sampled down again: each value stands for count / size of its histogram's updates, and
    values with more weight are likelier to stay. No task passes on more of a key than that.
    """
    counts = snapshots.groupBy(*keys).agg(F.sum("count").alias("count"))
    weight = F.col("count") / F.nullif(F.size("values"), F.lit(0))
    each = snapshots.select(
        *keys, F.xxhash64("values", "count").alias("_h"), weight.alias("_w"), F.posexplode("values").alias("_p", "value")
    )
    unit = (F.pmod(F.xxhash64("_h", "_p", "value"), F.lit(1 << 52)).cast("double") + 1) / float((1 << 52) + 1)
    kept = first_rows(each, keys, [-F.log(unit) / F.col("_w"), F.col("value")], most)
    joined = join_on(counts, sorted_values(kept, keys), keys, "left")
    return joined.select(*keys, F.coalesce("values", F.array().cast("array<double>")).alias("values"), "count")


def zigzag(left: Column, right: Column) -> Column:
    """The alternative merge of two sorted arrays: steps from one to the other, starting on the right, always to the next
    larger value. Loses and drops values; kept for comparison with published figures only."""
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("out"), F.lit(None).cast("double").alias("now"), F.lit(True).alias("right"))

    def step(s, _):
        def above(v: Column) -> Column:
            return F.get(F.filter(v, lambda x: s["now"].isNull() | (x > s["now"])), F.lit(0))

        here = F.when(s["right"], above(right)).otherwise(above(left))
        there = F.when(s["right"], above(left)).otherwise(above(right))
        value = F.coalesce(here, there)
        out = F.when(value.isNull(), s["out"]).otherwise(F.array_append(s["out"], value))
        return F.struct(out.alias("out"), F.coalesce(value, s["now"]).alias("now"), (~s["right"]).alias("right"))

    steps = F.sequence(F.lit(1), F.greatest(F.size(left) + F.size(right), F.lit(1)))
    return F.aggregate(steps, start, step, lambda s: s["out"])


def timers(snapshots: DataFrame, keys: Sequence[str] = ("path",), most: int = MOST_VALUES) -> DataFrame:
    """(keys, values, count, mean, samples, rates): histograms and meters, each by its rule."""
    return join_on(histograms(snapshots, keys, most), meters(snapshots, keys), keys)
