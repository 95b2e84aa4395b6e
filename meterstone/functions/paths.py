"""Metric paths, tags and the text of the exposition format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def path(*segments: str | Column) -> Column:
    """A path of non-empty segments; empty ones vanish."""
    each = F.array(*(F.lit(s) if isinstance(s, str) else s for s in segments)).cast("array<string>")
    return F.filter(each, lambda s: F.length(s) > 0)


def join(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def render(p: Column, delimiter: str = "/") -> Column:
    return F.array_join(p, delimiter)


def tag_key(tags: Column) -> Column:
    """The same text for equal tag sets, whatever their order; usable as a window key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def sortable(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The keys as windows and joins take them: maps as their tag_key."""
    return [tag_key(F.col(k)) if isinstance(df.schema[k].dataType, MapType) else F.col(k) for k in keys]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), where keys may be maps; the keys of the left stay."""
    names = [f"_key{n}" for n in range(len(keys))]
    left = left.select("*", *(c.alias(n) for c, n in zip(sortable(left, keys), names)))
    rest = (c for c in right.columns if c not in keys)
    right = right.select(*(c.alias(n) for c, n in zip(sortable(right, keys), names)), *rest)
    return left.join(right, names, how).drop(*names)


def sort_unique(values: Sequence) -> list:
    return sorted(set(values))


def mangle(element: Column) -> Column:
    return F.regexp_replace(element, "[^A-Za-z0-9]", "_")


def metric_name(p: Column) -> Column:
    joined = F.array_join(F.transform(p, mangle), ":")
    return F.when(joined.rlike("^[0-9]"), F.concat(F.lit("_"), joined)).otherwise(joined)


def label_value(value: Column, strict: bool = False) -> Column:
    """Quotes are escaped; strict also escapes backslashes and line ends."""
    if strict:
        value = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(value, F.lit('"'), F.lit('\\"'))


def labels(tags: Column, strict: bool = False) -> Column:
    one = lambda e: F.concat(mangle(e["key"]), F.lit('="'), label_value(e["value"], strict), F.lit('"'))
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), one), ",")


def window_label(us: Column) -> Column:
    """The largest unit of which there is one at least, truncated."""
    out = F.concat((us * 1000).cast("long").cast("string"), F.lit("nsec"))
    for unit, size in (("usec", 1), ("msec", 1_000), ("sec", 1_000_000), ("min", 60_000_000), ("hr", 3_600_000_000)):
        out = F.when(us >= size, F.concat(F.floor(us / size).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def number_label(q: Column) -> Column:
    """0.5, 0.99, 1: without a useless fraction."""
    return F.regexp_replace(q.cast("double").cast("string"), r"\.0$", "")


def type_name(raw: Column) -> Column:
    """The bare name of a type: without what encloses it and without parameters, however nested; empty for none."""
    brackets = F.length(raw) - F.length(F.replace(raw, F.lit("<"), F.lit("")))
    # Each step takes the innermost brackets away; what then follows an unclosed one goes too.
    plain = F.aggregate(F.sequence(F.lit(0), brackets), raw, lambda name, _: F.regexp_replace(name, "<[^<>]*>", ""))
    return F.coalesce(F.trim(F.element_at(F.split(F.regexp_replace(plain, "<.*", ""), "::"), -1)), F.lit(""))
