"""Publishing: snapshots and options to series and to text lines."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.paths import labels, metric_name, number_label, render, window_label
from ..functions.values import scale, show
from ..operators.registry import effective_options

#: How each kind is announced.
TYPES = {
    "counter": "untyped", "gauge": "gauge", "ewma": "gauge", "meter": "gauge", "histogram": "summary", "timer": "summary",
}


def _head(name: Column, tags: Column, suffix: str = "", label: Column | None = None, strict: bool = False) -> Column:
    own = labels(tags, strict)
    inside = own if label is None else F.concat(label, F.when(own == "", "").otherwise(F.concat(F.lit(","), own)))
    return F.concat(name, F.lit(suffix + "{"), inside, F.lit("} "))


def _label(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'{key}="'), value, F.lit('"'))


def _if(flag: str, each: Column) -> Column:
    return F.when(F.col(flag), each).otherwise(F.array().cast("array<string>"))


def lines(
    snapshots: DataFrame, options: DataFrame, kind: str, value_type: str = "double", tick_ns: int = 1000,
    scale_count: bool = True, strict: bool = False,
) -> DataFrame:
    """(path, line_no, tag_text, line) of one kind; line_no 0 is the header of a path, once for all its tag sets.

    counter, gauge, ewma need value; meter mean and rates; histogram values and count; timer all of these, its durations
    counting ticks of tick_ns. Paths without segments are passed over. Order lines by path, line_no, tag_text. The header
    comes with the first tag set of its path, so the snapshots are computed once.
    """
    rows = effective_options(snapshots.where(F.size("path") > 0), options)
    name, tags, factor = metric_name(F.col("path")), F.col("tags"), F.col("scale")

    def head(suffix: str = "", label: Column | None = None) -> Column:
        return _head(name, tags, suffix, label, strict)

    def number(v: Column, kind: str = "double") -> Column:
        return show(scale(v, factor), kind)

    def whole(v: Column, scaled: bool = True) -> Column:
        return F.when(factor.isNull() | F.lit(not scaled), v.cast("string")).otherwise(show(v * factor))

    def windows(suffix: str) -> Column:
        def one(e: Column) -> Column:
            return F.concat(head(suffix, _label("window", window_label(e["key"]))), number(e["value"]))

        mean = F.array(F.concat(head(suffix, _label("window", F.lit("mean"))), number(F.col("mean"))))
        return F.concat(_if("include_mean", mean), F.transform(F.array_sort(F.map_entries("rates")), one))

    def quantiles(value) -> Column:
        def one(q: Column) -> Column:
            return F.concat(head(label=_label("quantile", number_label(q))), value(stats.quantile(F.col("values"), q)))

        return F.transform("quantiles", one)

    if kind in ("counter", "gauge", "ewma"):
        shown = whole(F.col("value")) if value_type == "long" else number(F.col("value"), value_type)
        body = F.array(F.concat(head(), shown))
    elif kind == "meter":
        body = windows("")
    else:
        # Durations are told in whole microseconds.
        value = (lambda v: whole(F.floor(v * tick_ns / 1000).cast("long"))) if kind == "timer" else number
        counts = F.array(F.concat(head("_count"), whole(F.col("count"), scale_count)))
        mean = F.array(F.concat(head("_mean"), value(stats.mean(F.col("values")))))
        body = F.concat(_if("include_count", counts), mean, quantiles(value))
        if kind == "timer":
            body = F.concat(body, _if("include_rates", windows(":rates")))
    announce = [F.concat(F.lit("# TYPE "), name, F.lit(f" {TYPES[kind]}"))]
    if kind == "timer":
        announce = [F.concat(F.lit("# HELP "), name, F.lit(" "), render(F.col("path")), F.lit(" in microseconds")), *announce]

    def line(no: Column, tag_text: Column, text: Column) -> Column:
        return F.struct(no.cast("int").alias("line_no"), tag_text.alias("tag_text"), text.alias("line"))

    first = F.row_number().over(Window.partitionBy("path").orderBy("tag_text")) == 1
    rows = rows.select("path", labels(tags).alias("tag_text"), body.alias("body"), F.array(*announce).alias("header"))
    rows = rows.withColumn("first", first)
    headed = F.transform("header", lambda x, i: line(i + 1 - len(announce), F.lit(""), x))
    told = F.transform("body", lambda x, i: line(i + 1, F.col("tag_text"), x))
    every = F.when(F.col("first"), F.concat(headed, told)).otherwise(told)
    return rows.select("path", F.inline(every))


class Publisher(ABC):
    """Publishes snapshot tables by kind; subclasses decide what a table becomes."""

    def __init__(self, options: DataFrame):
        self.options = options

    @abstractmethod
    def publish(self, snapshots: Mapping[str, DataFrame]) -> DataFrame: ...


class TextPublisher(Publisher):
    """Exposition text of all kinds."""

    def __init__(self, options: DataFrame, **how):
        super().__init__(options)
        self.how = how

    def publish(self, snapshots: Mapping[str, DataFrame]) -> DataFrame:
        out = None
        for kind, df in snapshots.items():
            whole = "long" if kind == "counter" and df.schema["value"].dataType.typeName() == "long" else "double"
            made = lines(df, self.options, kind, value_type=whole, **self.how)
            out = made if out is None else out.unionByName(made)
        return out

    def write(self, snapshots: Mapping[str, DataFrame], path: str) -> None:
        """Text files whose lines stand in order, range-partitioned by path."""
        no = F.col("line_no")
        ordered = self.publish(snapshots).orderBy("path", F.when(no <= 0, "").otherwise(F.col("tag_text")), "line_no")
        ordered.select("line").write.mode("overwrite").text(path)
