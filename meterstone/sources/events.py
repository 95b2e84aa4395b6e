"""Sources of measurements: rows of (path, tags, kind, ts, seq, value) made from any table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import tag_key

#: ts counts microseconds, seq the order of arrival.
SCHEMA = "path array<string>, tags map<string,string>, kind string, ts long, seq long, value double"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def measurements(
    df: DataFrame, path: Column, ts: Column, seq: Column, value: Column, tags: Mapping[str, Column] | None = None,
    kind: str = "counter", default_tags: Mapping[str, str] | None = None, as_type: str = "double",
) -> DataFrame:
    """Rows of SCHEMA plus tag_key. default_tags are added to every row; a row's own tags win.

    as_type long keeps whole numbers exact that a double can't hold.
    """
    every = {**{k: F.lit(v) for k, v in (default_tags or {}).items()}, **(tags or {})}
    own = [x for k, v in every.items() for x in (F.lit(k), v.cast("string"))]
    made = F.create_map(*own) if own else F.create_map().cast("map<string,string>")
    rows = df.select(
        path.cast("array<string>").alias("path"), made.alias("tags"), F.lit(kind).alias("kind"),
        ts.cast("long").alias("ts"), seq.cast("long").alias("seq"), value.cast(as_type).alias("value"),
    )
    return rows.withColumn("tag_key", tag_key(F.col("tags")))


#: What a pull gauge reads when a snapshot is taken: a function of no arguments, or one value in a table of one row.
Source = Callable[[], float] | tuple[DataFrame, Column]


def pulled(snapshot_keys: DataFrame, source: Source) -> DataFrame:
    """snapshot_keys with the value of a source that is read when the snapshot is: a scalar subquery, without a join.

    A table of several rows raises an error; an empty one gives null.
    """
    if callable(source):
        return snapshot_keys.withColumn("value", F.lit(float(source())))
    table, value = source
    return snapshot_keys.select("*", table.select(value.cast("double")).scalar().alias("value"))
