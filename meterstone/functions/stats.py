"""Order statistics (Q1 to Q9): of a sorted array of values, and of whole groups of rows without an array."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_QUANTILES = (0.5, 0.9, 0.99)
#: What an empty reservoir gives as minimum and maximum.
EMPTY_MIN, EMPTY_MAX = -(1 << 63), (1 << 63) - 1


def quantile(values: Column, q: Column | float) -> Column:
    """Of a sorted array, by rank (n + 1) q with linear interpolation, clamped to the ends; 0 if empty."""
    q = F.lit(float(q)) if not isinstance(q, Column) else q
    n = F.size(values)
    rank = q * (n + 1)
    i = F.floor(rank).cast("int")
    low, high = F.get(values, i - 1), F.get(values, i)
    inner = low + (rank - i) * (high - low)
    ends = F.when(n == 0, F.lit(0.0)).when(i < 1, F.get(values, F.lit(0))).when(i >= n, F.get(values, n - 1))
    return ends.otherwise(inner)


def sample_step(size: Column, n: int) -> Column:
    """The distance of n evenly spaced quantiles over so many values."""
    return F.lit(1.0) / F.least(F.lit(n + 1), F.greatest(size - 1, F.lit(1)))


def sample(values: Column, n: int) -> Column:
    """Up to n evenly spaced quantiles as an array of (key, value), key in percent; ends where the index leaves the array."""
    size = F.size(values)
    step = sample_step(size, n)

    def one(i: Column) -> Column:
        at = F.floor(i * step * (size + 1))
        return F.struct((100 * i * step).alias("key"), quantile(values, i * step).alias("value"), at.alias("at"))

    kept = F.filter(F.transform(F.sequence(F.lit(1), F.lit(n)), one), lambda x: (x["at"] < size) & (x["key"] <= 100))
    plain = F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return F.when(size > 1, plain).otherwise(F.array().cast("array<struct<key:double,value:double>>"))


def quantiles(values: Column, qs: tuple[float, ...] = DEFAULT_QUANTILES) -> Column:
    """An array of (quantile, value), ascending and without repeats."""
    each = (F.struct(F.lit(q).alias("quantile"), quantile(values, q).alias("value")) for q in sorted(set(qs)))
    return F.array(*each)


def exact(
    rows: DataFrame, keys: Sequence[str], value: str = "value", qs: Sequence[float | Callable] = DEFAULT_QUANTILES
) -> DataFrame:
    """(keys, count, mean, least, greatest, quantiles) over all rows of each key, by the same rule as quantile().

    quantiles is an array of (quantile, value) in the order of qs; a q may be a function of the count. Equal values are
    counted before they are ranked, and ranks are running totals over sorted rows, which spill: no key's values ever
    stand in one array.
    """
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    whole = counts.groupBy(*keys).agg(
        F.sum("_n").alias("count"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min("_v").alias("least"), F.max("_v").alias("greatest"),
    )
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    ranked = counts.withColumn("_upto", upto).join(whole, list(keys))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto")), F.col("_v")))

    found = []
    for q in qs:
        q = q(F.col("count")) if callable(q) else F.lit(float(q))
        rank = q * (F.col("count") + 1)
        i = F.least(F.greatest(F.floor(rank), F.lit(1)), F.col("count"))
        part = F.when((rank < 1) | (rank >= F.col("count")), F.lit(0.0)).otherwise(rank - i)
        low, high = at(i), at(F.least(i + 1, F.col("count")))
        found.append(F.struct(F.max(q).alias("quantile"), (low + F.max(part) * (high - low)).alias("value")))
    names = ("count", "mean", "least", "greatest")
    return ranked.groupBy(*keys).agg(*(F.max(c).alias(c) for c in names), F.array(*found).alias("quantiles"))


def mean(values: Column) -> Column:
    """0 if empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.nullif(F.size(values), F.lit(0))).otherwise(F.lit(0.0))


def least(values: Column, sentinel: bool = False) -> Column:
    empty = F.lit(float(EMPTY_MIN)) if sentinel else F.lit(None).cast("double")
    return F.coalesce(F.get(values, F.lit(0)), empty)


def greatest(values: Column, sentinel: bool = False) -> Column:
    empty = F.lit(float(EMPTY_MAX)) if sentinel else F.lit(None).cast("double")
    return F.coalesce(F.get(values, F.size(values) - 1), empty)


def percent(p: float) -> float:
    """99 percent as the quantile 0.99."""
    if not 0 <= p <= 100:
        raise ValueError("percentiles lie between 0 and 100")
    return p / 100
