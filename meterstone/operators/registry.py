"""The registry: definitions, type checks, aliases, default tags, publish options, and the snapshots of what was measured
(K1 to K5, S2, S3, S8, O1 to O4, O14, O15)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import sort_unique, tag_key
from ..functions.stats import DEFAULT_QUANTILES
from ..sources.events import Source, pulled
from . import basic, ewma, histogram, rollup

KINDS = ("counter", "gauge", "ewma", "meter", "histogram", "timer")
SECOND = 1_000_000


class MetricTypeMismatch(TypeError):
    def __init__(self, path: str, existing: str, desired: str):
        super().__init__(f"{path} is a {existing}, not a {desired}")
        self.existing, self.desired = existing, desired


@dataclass(frozen=True)
class PublishOptions:
    """What of a metric is published. as_distribution is kept but has no effect."""

    scale: float | None = None
    include_mean: bool = True
    include_count: bool = True
    include_rates: bool = True
    quantiles: tuple[float, ...] = DEFAULT_QUANTILES
    as_distribution: bool = False

    def __post_init__(self):
        if any(not 0 <= q <= 1 for q in self.quantiles):
            raise ValueError("quantiles lie between 0 and 1")
        object.__setattr__(self, "quantiles", tuple(sort_unique(self.quantiles)))


OPTIONS = (
    "path array<string>, scale double, include_mean boolean, include_count boolean, include_rates boolean, "
    "quantiles array<double>, as_distribution boolean"
)


def options_table(
    spark: SparkSession, registry: PublishOptions | None = None,
    metrics: Mapping[tuple[str, ...], PublishOptions] | None = None,
) -> DataFrame:
    """One row with a null path for the registry, one for each metric that has its own options."""
    every = [(None, registry or PublishOptions()), *(metrics or {}).items()]
    rows = [
        (
            list(p) if p is not None else None, o.scale, o.include_mean, o.include_count, o.include_rates,
            list(o.quantiles), o.as_distribution,
        )
        for p, o in every
    ]
    return spark.createDataFrame(rows, OPTIONS)


def effective_options(paths: DataFrame, options: DataFrame) -> DataFrame:
    """paths (path, ...) with the options that hold: the metric's own row as a whole, else the registry's.

    Options are set by hand, one row a path, and are joined by path; the registry's row is a scalar subquery, so a second
    one is an error.
    """
    names = [c for c in options.columns if c != "path"]
    own = options.where(F.col("path").isNotNull()).select("path", F.struct(*names).alias("_own"))
    every = options.where(F.col("path").isNull()).select(F.struct(*names)).scalar()
    joined = paths.join(own, "path", "left").select(*paths.columns, F.coalesce("_own", every).alias("_o"))
    return joined.select(*paths.columns, "_o.*")


def type_conflicts(definitions: DataFrame, path: str = "path", kind: str = "kind") -> DataFrame:
    """(path, kinds) of the paths that are defined as more than one type, whatever their tags."""
    found = definitions.groupBy(path).agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
    return found.where(F.size("kinds") > 1)


def check_types(definitions: DataFrame, path: str = "path", kind: str = "kind") -> DataFrame:
    """definitions, or MetricTypeMismatch."""
    bad = type_conflicts(definitions, path, kind).first()
    if bad:
        raise MetricTypeMismatch(str(bad[0]), bad[1][0], bad[1][1])
    return definitions


def _literal_path(path: Sequence[str]) -> Column:
    return F.array(*(F.lit(p) for p in path)).cast("array<string>")


def _literal_tags(tags: Mapping[str, str] | None) -> Column:
    pairs = [F.lit(str(x)) for kv in (tags or {}).items() for x in kv]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")


def _without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows whose (path, tags) taken does not have."""
    keys = taken.select(F.col("path").alias("_path"), tag_key(F.col("tags")).alias("_tags"))
    same = (F.col("path") == F.col("_path")) & (tag_key(F.col("tags")) == F.col("_tags"))
    return rows.join(keys, same, "left_anti")


def register_existing(
    snapshots: DataFrame, source: Column, new_path: Sequence[str], new_tags: Mapping[str, str] | None = None
) -> DataFrame:
    """snapshots and, under new_path and new_tags, the rows of source again, unless that key is taken.

    If snapshots has a column kind and new_path holds rows of another kind than source's, the query raises an error.
    """
    path = _literal_path(new_path)
    alias = snapshots.where(source).withColumn("path", path).withColumn("tags", _literal_tags(new_tags))
    if "kind" in snapshots.columns:
        there = snapshots.where(F.col("path") == path).select(F.min("kind")).scalar()
        wrong = F.concat(F.array_join("path", "/"), F.lit(" is a "), there, F.lit(", not a "), F.col("kind"))
        other = there.isNotNull() & (there != F.col("kind"))
        alias = alias.withColumn("kind", F.when(other, F.raise_error(wrong).cast("string")).otherwise(F.col("kind")))
    return snapshots.unionByName(_without(alias, snapshots))


@dataclass
class Definition:
    """A path's type, and the tag sets that were asked for; sources of pull gauges and first values by tag set."""

    kind: str
    params: tuple
    tags: list[dict[str, str]] = field(default_factory=list)
    initial: list[float] = field(default_factory=list)
    sources: list[Source | None] = field(default_factory=list)


Path = str | Sequence[str]


def _path(path: Path) -> tuple[str, ...]:
    return tuple(s for s in ([path] if isinstance(path, str) else path) if s)


class MetricsRegistry:
    """Definitions by path, get-or-create. snapshots() turns measurements into one table for each kind; publish() hands
    them, by the registry's options, to a publisher.

    Definitions are made by hand and live on the driver, like the options; measurements never do.
    """

    def __init__(self, spark: SparkSession, default_tags: Mapping[str, str] | None = None):
        self.spark, self.default_tags = spark, {k: str(v) for k, v in (default_tags or {}).items()}
        self.metrics: dict[tuple[str, ...], Definition] = {}
        self.aliases: list[tuple[tuple[str, ...], dict[str, str], tuple[str, ...], dict[str, str]]] = []
        self.options = PublishOptions()
        self.metric_options: dict[tuple[str, ...], PublishOptions] = {}
        self.data: dict[tuple, object] = {}

    # Get or create

    def _tags(self, tags: Mapping[str, object] | None) -> dict[str, str]:
        return {**self.default_tags, **{k: str(v) for k, v in (tags or {}).items()}}

    def _define(
        self, kind: str, path: Path, tags: Mapping | None, *params, initial: float = 0, source: Source | None = None
    ) -> Definition:
        """The type of a path is that of its first definition; a tag set's first value and source are those given first."""
        found = self.metrics.setdefault(_path(path), Definition(kind, params))
        if (found.kind, found.params) != (kind, params):
            raise MetricTypeMismatch("/".join(_path(path)), f"{found.kind}{found.params}", f"{kind}{params}")
        own = self._tags(tags)
        if own not in found.tags:
            found.tags.append(own)
            found.initial.append(initial)
            found.sources.append(source)
        return found

    def counter(self, path: Path, tags=None, value_type: str = "long", initial: float = 0) -> Definition:
        return self._define("counter", path, tags, value_type, initial=initial)

    def gauge(self, path: Path, tags=None, aggregation: str = "average", initial: float = 0) -> Definition:
        """A gauge that measurements set."""
        if aggregation not in ("average", "sum"):
            raise ValueError(aggregation)
        return self._define("gauge", path, tags, aggregation, initial=initial)

    def functional_gauge(self, path: Path, read: Callable[[], float], tags=None, aggregation="average") -> Definition:
        """A gauge whose function is called whenever a snapshot is taken."""
        return self._define("gauge", path, tags, aggregation, "function", source=read)

    def referential_gauge(
        self, path: Path, table: DataFrame, value: Column, tags=None, aggregation: str = "average"
    ) -> Definition:
        """A gauge that shows what one row of a table holds when the snapshot is computed."""
        return self._define("gauge", path, tags, aggregation, "reference", source=(table, value))

    def ewma(self, path: Path, window: int, interval: int = SECOND, tags=None) -> Definition:
        return self._define("ewma", path, tags, window, interval)

    def meter(self, path: Path, windows: Sequence[int], interval: int = SECOND, tags=None) -> Definition:
        return self._define("meter", path, tags, tuple(sort_unique(windows)), interval)

    def histogram(self, path: Path, reservoir: str = "uniform", size: int = 1024, window: int = 0, tags=None) -> Definition:
        """reservoir: uniform, last, or sliding with a window."""
        return self._define("histogram", path, tags, reservoir, size, window)

    def timer(
        self, path: Path, windows: Sequence[int], interval: int = SECOND, reservoir: str = "uniform", size: int = 1024,
        window: int = 0, tags=None,
    ) -> Definition:
        return self._define("timer", path, tags, tuple(sort_unique(windows)), interval, reservoir, size, window)

    def register_existing(self, new_path: Path, path: Path, tags=None, new_tags=None) -> bool:
        """The metric of (path, tags) under another key as well. False if there is none, or if that key is taken; an error
        if new_path is of another type."""
        new, old, own, given = _path(new_path), _path(path), self._tags(tags), self._tags(new_tags)
        source = self.metrics.get(old)
        if source is None or own not in source.tags:
            return False
        there = self.metrics.setdefault(new, Definition(source.kind, source.params))
        if (there.kind, there.params) != (source.kind, source.params):
            kinds = f"{there.kind}{there.params}", f"{source.kind}{source.params}"
            raise MetricTypeMismatch("/".join(new), *kinds)
        if given in there.tags or any((new, given) == (p, t) for _, _, p, t in self.aliases):
            return False
        self.aliases.append((old, own, new, given))
        return True

    # Looking at definitions

    def definitions(self) -> DataFrame:
        """(path, tags, kind, params) of every tag set, aliases included."""
        rows = [(list(p), t, d.kind, repr(d.params)) for p, d in self.metrics.items() for t in d.tags]
        for _, _, p, t in self.aliases:
            rows.append((list(p), t, self.metrics[p].kind, repr(self.metrics[p].params)))
        return self.spark.createDataFrame(rows, "path array<string>, tags map<string,string>, kind string, params string")

    def has_metric(self, path: Path) -> bool:
        return _path(path) in self.metrics

    def visit(self, handle: Callable[[tuple[str, ...], Definition], None], path: Path | None = None) -> None:
        """Every path, or one if it is known."""
        for p, definition in list(self.metrics.items()):
            if path is None or p == _path(path):
                handle(p, definition)

    # Snapshots

    def _table(self, rows: list[tuple], more: str = "") -> DataFrame:
        return self.spark.createDataFrame(rows, "path array<string>, tags map<string,string>" + more)

    def _measured(self, kind: str, params: tuple, events: DataFrame, asof: int) -> DataFrame:
        """The snapshot rows of one type, from its measurements."""
        if kind == "counter":
            return basic.counter(events, as_type=params[0])
        if kind == "gauge":
            return basic.gauge(events)
        if kind == "ewma":
            return ewma.ewma(events, *params, asof)
        if kind == "meter":
            return ewma.meter(events, *params, asof)
        *rates, name, size, window = params
        chosen = {
            "uniform": lambda: histogram.Uniform(size), "last": lambda: histogram.LastN(size),
            "sliding": lambda: histogram.Sliding(size, window, asof),
        }[name]()
        if kind == "histogram":
            return histogram.histogram(events, chosen)
        return histogram.timer(events, *rates, asof, chosen)

    def _unmeasured(self, kind: str, params: tuple, named: DataFrame) -> DataFrame:
        """What tag sets show that no measurement came for; named is (path, tags, initial)."""
        none = F.array().cast("array<double>")
        if kind in ("counter", "gauge", "ewma"):
            kept = params[0] if kind == "counter" else "double"
            return named.select("path", "tags", F.col("initial").cast(kept).alias("value"))
        zero = lambda ws: F.create_map(*(F.lit(x) for w in ws for x in (w, 0.0))).cast("map<bigint,double>")
        empty = (none.alias("values"), F.lit(0).cast("long").alias("count"))
        rates = lambda ws: (F.lit(0.0).alias("mean"), zero(ws).alias("rates"))
        more = {"meter": lambda: rates(params[0]), "histogram": lambda: empty, "timer": lambda: (*empty, *rates(params[0]))}
        return named.select("path", "tags", *more[kind]())

    def snapshots(self, events: DataFrame, asof: int) -> dict[str, DataFrame]:
        """kind -> the snapshot table as of then, with path and tags, of the kinds that are defined.

        events has path, tags, ts, seq, value; those of unknown paths are passed over, and each row has the default tags
        unless it has its own. Tag sets that were asked for but not measured show their first values; measured ones need
        not be asked for. Each type is one aggregation over its own paths' measurements.
        """
        rows = events
        if self.default_tags:
            missing = F.map_filter(_literal_tags(self.default_tags), lambda k, _: ~F.map_contains_key("tags", k))
            rows = rows.withColumn("tags", F.map_concat(missing, "tags"))
        types = {}
        for path, d in self.metrics.items():
            types.setdefault((d.kind, d.params), []).append((path, d))
        out: dict[str, DataFrame] = {}
        for (kind, params), defined in types.items():
            table = self._pulled(defined) if params[1:] in (("function",), ("reference",)) and kind == "gauge" else None
            if table is None:
                paths = self.spark.createDataFrame([(list(p),) for p, _ in defined], "path array<string>")
                named = [(list(p), t, float(i)) for p, d in defined for t, i in zip(d.tags, d.initial)]
                named = self._table(named, ", initial double")
                table = self._measured(kind, params, rows.join(paths, "path", "left_semi"), asof)
                if kind == "counter" and any(any(d.initial) for _, d in defined):
                    first = named.groupBy("path", tag_key(F.col("tags")).alias("_t")).agg(F.max("initial").alias("_i"))
                    table = table.withColumn("_t", tag_key(F.col("tags"))).join(first, ["path", "_t"], "left")
                    value = (F.col("value") + F.coalesce("_i", F.lit(0))).cast(params[0])
                    table = table.select("path", "tags", value.alias("value"))
                table = table.unionByName(self._unmeasured(kind, params, _without(named, table)))
            if kind == "gauge":
                table = table.withColumn("aggregation", F.lit(params[0]))
            if kind == "counter":
                table = table.withColumn("value", F.col("value").cast("long" if params[0] in basic.WHOLE else "double"))
            out[kind] = out[kind].unionByName(table) if kind in out else table
        for old, own, new, given in self.aliases:
            kind = self.metrics[old].kind
            source = (F.col("path") == _literal_path(old)) & (tag_key(F.col("tags")) == tag_key(_literal_tags(own)))
            out[kind] = register_existing(out[kind], source, new, given)
        return out

    def _pulled(self, defined: list[tuple[tuple[str, ...], Definition]]) -> DataFrame:
        out = None
        for path, d in defined:
            for tags, source in zip(d.tags, d.sources):
                one = pulled(self._table([(list(path), tags)]), source)
                out = one if out is None else out.unionByName(one)
        return out

    def aggregates(self, snapshots: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """kind -> one row a path: the tag sets of each path rolled up by the kind's rule."""
        out = {}
        for kind, table in snapshots.items():
            if kind == "gauge":
                total = rollup.cumulative(table.where("aggregation = 'sum'")).select("path", F.col("value").cast("double"))
                mean = rollup.average(table.where("aggregation = 'average'")).select("path", "value")
                out[kind] = total.unionByName(mean)
            else:
                rule = {
                    "counter": rollup.cumulative, "ewma": rollup.average, "meter": rollup.meters,
                    "histogram": rollup.histograms, "timer": rollup.timers,
                }[kind]
                out[kind] = rule(table)
        return out

    # Publishing

    def publish(self, events: DataFrame, asof: int, make: Callable[[DataFrame], object]) -> DataFrame:
        """What the publisher that make(options table) gives publishes of the snapshots as of then."""
        return make(self.options_table()).publish(self.snapshots(events, asof))

    def set_options(self, options: PublishOptions, path: Path | None = None) -> bool:
        """Of the registry, or of a path; False, and nothing else, if the path is unknown."""
        if path is None:
            self.options = options
        elif _path(path) in self.metrics:
            self.metric_options[_path(path)] = options
        else:
            return False
        return True

    def options_table(self) -> DataFrame:
        return options_table(self.spark, self.options, self.metric_options)

    def publisher_data(self, publisher: str, make: Callable[[], object], path: Path | None = None) -> object | None:
        """What a publisher keeps at the registry or at a path: made once; None for an unknown path."""
        if path is not None and _path(path) not in self.metrics:
            return None
        key = publisher, None if path is None else _path(path)
        if key not in self.data:
            self.data[key] = make()
        return self.data[key]

    def has_publisher_data(self, publisher: str, path: Path | None = None) -> bool:
        return (publisher, None if path is None else _path(path)) in self.data
