"""Queries: the registry, from definitions to published text, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import basic, ewma, histogram, registry
from ..sources.events import measurements, micros
from ..streaming import live
from . import exposition
from .book import (
    ASOF,
    DAY,
    HOUR,
    STATS,
    E,
    events,
    ewma_sql,
    group_of,
    metric_events,
    query,
    r6,
    read,
    stats_columns,
    type_of,
)
from .text_queries import SCALE, rounded, shown, some_options


@query("""WITH c AS (SELECT event_type AS name, user_id % 3 AS g, count(*) AS value FROM events GROUP BY 1, 2)
SELECT 'events/' || name AS name, g::VARCHAR AS grp, value FROM c
UNION ALL SELECT 'alias/clicks', '', value FROM c WHERE name = 'click' AND g = 0""")
def alias_union(spark, sf_dir):
    c = basic.counter(metric_events(spark, sf_dir, value=F.lit(1))).withColumn("kind", F.lit("counter"))
    source = (F.col("path")[1] == "click") & (F.col("tags")["group"] == "0")
    group = F.coalesce(F.col("tags")["group"], F.lit("")).alias("grp")
    both = registry.register_existing(c, source, ("alias", "clicks"))
    return both.select(paths.render(F.col("path")).alias("name"), group, "value")


@query("""WITH d AS (SELECT o_orderpriority AS path,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '%E%' THEN 'meter' ELSE 'counter' END AS kind FROM orders)
SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM d GROUP BY 1 HAVING count(DISTINCT kind) > 1""")
def type_conflict_report(spark, sf_dir):
    kind = F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").like("%E%"), "meter").otherwise("counter")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("path"), kind.alias("kind"))
    return registry.type_conflicts(o).select("path", F.array_join("kinds", ",").alias("kinds"))


@query(f"""SELECT DISTINCT event_type, {SCALE} AS scale, event_type != 'click' AS include_mean,
  event_type = 'click' AS as_distribution, CASE WHEN event_type = 'click' THEN '0.75' ELSE '0.5,0.9,0.99' END AS quantiles
FROM events""")
def options_effective(spark, sf_dir):
    p = metric_events(spark, sf_dir).select("path").distinct()
    quantiles = F.array_join(F.transform("quantiles", lambda q: q.cast("string")), ",").alias("quantiles")
    found = registry.effective_options(p, some_options(spark))
    return found.select(type_of(), "scale", "include_mean", "as_distribution", quantiles)


@query("""SELECT o_orderpriority AS name, '{"env":"test","status":"' || o_orderstatus || '"}' AS tags, count(*) AS value
FROM orders GROUP BY 1, 2""")
def default_tags(spark, sf_dir):
    o, own = read(spark, sf_dir, "orders"), {"status": F.col("o_orderstatus")}
    path, ts = paths.path(F.col("o_orderpriority")), micros(F.col("o_orderdate"))
    every = {"env": "test", "status": "none"}
    m = measurements(o, path, ts, F.col("o_orderkey"), F.lit(1), own, default_tags=every)
    counts = m.groupBy("path", "tag_key").agg(F.count("*").alias("value"))
    return counts.select(F.col("path")[0].alias("name"), F.col("tag_key").alias("tags"), "value")


@query("SELECT event_type, count(*) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def point_visit(spark, sf_dir):
    """One path of a snapshot table; an unknown one gives nothing."""
    c = basic.counter(metric_events(spark, sf_dir, value=F.lit(1)), ["path"])
    some = [basic.visit(c, path=("events", what)) for what in ("click", "nothing")]
    return some[0].unionByName(some[1]).select(type_of(), "value")


@query("SELECT 'click' AS name, count(*) > 0 AS there FROM events WHERE event_type = 'click' UNION ALL SELECT 'nothing', false")
def metric_exists(spark, sf_dir):
    c = basic.counter(metric_events(spark, sf_dir, value=F.lit(1)))
    rows = [(what, basic.has_metric(c, ("events", what))) for what in ("click", "nothing")]
    return spark.createDataFrame(rows, "name string, there boolean")


@query("""SELECT kind, count(*) AS series, round(sum(value), 4) AS total FROM (
  SELECT 'counter' AS kind, count(*)::DOUBLE AS value FROM events GROUP BY event_type
  UNION ALL SELECT 'gauge', arg_max(value, (ts, event_id)) FROM events GROUP BY event_type) GROUP BY 1""")
def kind_dispatch(spark, sf_dir):
    e = metric_events(spark, sf_dir, "gauge")

    def made(df: DataFrame, kind: str) -> DataFrame:
        return df.select("path", F.lit(kind).alias("kind"), F.col("value").cast("double").alias("value"))

    c, g = made(basic.counter(e.withColumn("value", F.lit(1)), ["path"]), "counter"), made(basic.gauge(e, ["path"]), "gauge")
    snapshots = c.unionByName(g).unionByName(made(basic.counter(e, ["path"]), "timer"))
    by_kind = basic.visit(snapshots, ["counter", "gauge"]).groupBy("kind")
    return by_kind.agg(F.count("*").alias("series"), F.round(F.sum("value"), 4).alias("total"))


_PER_HOUR = f"(({ASOF} - min(t)) / {float(HOUR)})"


@query(f"""WITH {E} SELECT 'counter' AS kind, event_type, count(*)::DOUBLE AS value FROM e GROUP BY 2
UNION ALL SELECT 'meter', event_type, round(sum(value) / {_PER_HOUR}, 6) FROM e GROUP BY 2
UNION ALL SELECT 'timer', event_type, round(count(*) / {_PER_HOUR}, 6) FROM e WHERE value != 0 GROUP BY 2
UNION ALL SELECT 'timer', event_type, count(*) FROM e WHERE value != 0 GROUP BY 2""")
def handler_fallbacks(spark, sf_dir):
    """Handlers of values and histograms alone: meters come as values; timers, which have no handler, come in halves."""
    e = metric_events(spark, sf_dir, "gauge")
    last = histogram.LastN(10)
    snapshots = {
        "counter": basic.counter(e.withColumn("value", F.lit(1)), ["path"]),
        "meter": ewma.meter(e, [DAY], HOUR, ASOF, ["path"]),
        "timer": histogram.timer(e, [DAY], HOUR, ASOF, last, ["path"]),
    }
    out = None
    for kind, table in snapshots.items():

        def told(df: DataFrame, column: str, kind=kind) -> DataFrame:
            value = F.round(F.col(column).cast("double"), 6).alias("value")
            return df.select(F.lit(kind).alias("kind"), type_of(), value)

        handlers = {"value": lambda df: told(df, "value"), "histogram": lambda df: told(df, "count")}
        for one in basic.dispatch({kind: table}, handlers, ["path"]):
            out = one if out is None else out.unionByName(one)
    return out


def a_registry(spark) -> registry.MetricsRegistry:
    """A counter, a gauge and a histogram of clicks, a meter of views, each for every group of users."""
    r = registry.MetricsRegistry(spark, {"env": "test"})
    for group in range(3):
        r.counter(("events", "click"), {"group": group}, initial=5)
        r.gauge(("value", "click"), {"group": group}, "sum")
        r.histogram(("size", "click"), "last", 50, tags={"group": group})
        r.meter(("events", "view"), [7 * DAY, DAY, DAY], HOUR, {"group": group})
    r.meter(("events", "view"), [DAY, 7 * DAY], HOUR, {"group": 0})  # the same
    r.counter(("events", "click"), {"group": "none"}, initial=7)
    r.register_existing(("alias", "click"), ("events", "click"), {"group": 1}, {"copy": "yes"})
    return r


def _registered(spark, sf_dir) -> DataFrame:
    """The measurements of all of a_registry()'s paths, and of others that it doesn't know."""
    e, tags = events(spark, sf_dir), {"group": F.col("user_id") % 3}

    def of(first: str, value) -> DataFrame:
        path = paths.path(first, F.col("event_type"))
        return measurements(e, path, F.col("ts"), F.col("seq"), value, tags)

    some = of("events", F.lit(1)).where("path[1] != 'view'").unionByName(of("events", F.col("value")).where("path[1] = 'view'"))
    return some.unionByName(of("value", F.col("value"))).unionByName(of("size", F.round("value", 2)))


_GROUP = "'env=\"test\",group=\"' || grp || '\"'"


def _publish_sql() -> str:
    def line(source: str, name: str, kind: str, value: str, label: str = "", tags: str = _GROUP, suffix: str = "") -> str:
        head = f"SELECT '# TYPE {name} {kind}' AS line"
        own = f"{label}," if label else ""
        return f"{head} UNION SELECT '{name}{suffix}{{{own}' || {tags} || '}} ' || {value} FROM {source}"

    clicks = "e WHERE event_type = 'click' GROUP BY grp"
    per_hour = f"printf('%.6f', round(sum(value) / {_PER_HOUR}, 6))"
    views = "e WHERE event_type = 'view' GROUP BY grp"
    parts = [
        line(clicks, "events:click", "untyped", "count(*) + 5"),
        "SELECT 'events:click{env=\"test\",group=\"none\"} 7'",
        line("e WHERE event_type = 'click' AND grp = 1", "alias:click", "untyped", "count(*) + 5", tags="'copy=\"yes\",env=\"test\"'"),
        line(clicks, "value:click", "gauge", "printf('%.6f', arg_max(value, (t, event_id)))"),
        line("c", "size:click", "summary", "cnt", suffix="_count"),
        line("h", "size:click", "summary", "printf('%.6f', round(list_sum(v) / len(v), 6))", suffix="_mean"),
        line(views, "events:view", "gauge", per_hour, 'window="mean"'),
    ]
    for w in (DAY, 7 * DAY):
        rates = f"(WITH {ewma_sql(w, 'event_type, grp')} SELECT * FROM r WHERE event_type = 'view')"
        parts.append(line(rates, "events:view", "gauge", "printf('%.6f', round(rate, 6))", f'window="{w // HOUR}hr"'))
    return f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t DESC, event_id DESC) AS n
  FROM e WHERE event_type = 'click'),
h AS (SELECT grp, list(round(value, 2) ORDER BY value) AS v FROM k WHERE n <= 50 GROUP BY 1),
c AS (SELECT grp, count(*) AS cnt FROM k GROUP BY 1)
{' UNION '.join(parts)}"""


@query(_publish_sql())
def registry_publish(spark, sf_dir):
    """From definitions and measurements to text: get-or-create, default tags, first values, an alias, options."""
    r = a_registry(spark)
    r.set_options(registry.PublishOptions(quantiles=()))

    class Rounded(exposition.TextPublisher):
        def publish(self, snapshots):
            plain = {k: rounded(df) if k == "meter" else df for k, df in snapshots.items()}
            return super().publish(plain)

    return r.publish(_registered(spark, sf_dir), ASOF, Rounded).select("line")


@query(f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t DESC, event_id DESC) AS n
  FROM e WHERE event_type = 'click'),
h AS (SELECT list(round(value, 2) ORDER BY value) AS v FROM k WHERE n <= 50)
SELECT 'alias/click' AS name, (count(*) + 5)::DOUBLE AS value FROM e WHERE event_type = 'click' AND grp = 1
UNION ALL SELECT 'events/click', count(*) + 5 * count(DISTINCT grp) + 7 FROM e WHERE event_type = 'click'
UNION ALL SELECT 'value/click', round(sum(v), 4) FROM (SELECT arg_max(value, (t, event_id)) AS v FROM e
  WHERE event_type = 'click' GROUP BY grp)
UNION ALL SELECT 'size/click', len(v) FROM h
UNION ALL SELECT 'events/view', round(avg(m), 4) FROM (SELECT sum(value) / {_PER_HOUR} AS m FROM e
  WHERE event_type = 'view' GROUP BY grp)""")
def registry_aggregates(spark, sf_dir):
    """Every path of the registry rolled up by its kind's rule: one number each."""
    r = a_registry(spark)
    out = None
    up = r.aggregates(r.snapshots(_registered(spark, sf_dir), ASOF))
    shows = {"counter": F.col("value"), "gauge": F.col("value"), "meter": F.col("mean"), "histogram": F.size("values")}
    for kind, value in shows.items():
        name = paths.render(F.col("path")).alias("name")
        one = up[kind].select(name, F.round(value.cast("double"), 4).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT * FROM (VALUES ('alias/click', 'counter', 1), ('events/click', 'counter', 4), ('events/view', 'meter', 3),
  ('size/click', 'histogram', 3), ('value/click', 'gauge', 3)) t(name, kind, tag_sets)""")
def registry_definitions(spark, sf_dir):
    """What get-or-create made: repeated definitions, and windows in another order, make nothing new."""
    d = a_registry(spark).definitions().groupBy(paths.render(F.col("path")).alias("name"), "kind")
    return d.agg(F.count("*").cast("int").alias("tag_sets"))


@query("""SELECT * FROM (VALUES ('first of a path', '10'), ('second of a path', '10'), ('of the registry', '1'),
  ('unknown path', 'none'), ('has it', 'true'), ('has another', 'false')) t(asked, got)""")
def publisher_store(spark, sf_dir):
    """What publishers keep at paths: made once, and nothing at unknown ones."""
    r = a_registry(spark)
    click = ("events", "click")
    got = {
        "first of a path": r.publisher_data("p", lambda: 10, click),
        "second of a path": r.publisher_data("p", lambda: 2000, click),
        "of the registry": r.publisher_data("p", lambda: 1),
        "unknown path": r.publisher_data("p", lambda: 3, ("nothing",)),
        "has it": r.has_publisher_data("p", click), "has another": r.has_publisher_data("q", click),
    }
    rows = [(k, "none" if v is None else str(v).lower()) for k, v in got.items()]
    return spark.createDataFrame(rows, "asked string, got string")


# Streams


def _named(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:8]}"


@query("SELECT event_type, round(sum(value), 4) AS value, count(*) AS count FROM events GROUP BY 1")
def stream_counters(spark, sf_dir):
    df = live.counters(live.read_events(spark, f"{sf_dir}/events.parquet"), ["event_type"])
    out = live.run_to_end(df, _named("stream_counters"), "complete")
    return out.withColumn("value", F.round("value", 4))


#: What the watermark lags behind the newest event.
_LAG = 2 * DAY


@query(f"""WITH e AS (SELECT *, epoch_us(ts) AS t, event_id % 10 AS d FROM events),
m AS (SELECT max(t) FILTER (d > 1) - {_LAG} AS early, max(t) FILTER (d > 0) - {_LAG} AS mid, max(t) - {_LAG} AS late FROM e),
w AS (SELECT event_type, value, d, t // {DAY} * {DAY} + {DAY} AS ends FROM e)
SELECT event_type, make_timestamp(ends - {DAY}) AS day, round(sum(value), 4) AS value
FROM w, m WHERE ends <= late AND (d > 0 OR ends > early) GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    """Three batches in append mode: the third brings rows that are too late by the watermark of the first."""
    n = F.col("event_id") % 10
    part = F.when(n > 1, 0).when(n == 1, 1).otherwise(2)
    folder = live.dealt(spark, f"{sf_dir}/events.parquet", part, 3)
    rows = live.read_events(spark, folder, 1)
    df = live.windowed_counters(rows, ["event_type"], "at", "1 day", f"{_LAG // HOUR} hours")
    out = live.run_to_end(df, _named("stream_windows"), "append")
    day = F.col("window.start").cast("timestamp_ntz").alias("day")
    return out.select("event_type", day, F.round("value", 4).alias("value"))


def _in_arrival(spark, sf_dir, parts: int = 4):
    """A stream of the events in batches by order of arrival."""
    path = f"{sf_dir}/events.parquet"
    last = spark.read.parquet(path).agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * parts / (last + 1))
    return live.read_events(spark, live.dealt(spark, path, part, parts), 1)


def _stream_sql() -> str:
    a = ewma.alpha(DAY, HOUR)
    return f"""WITH e AS (SELECT event_type, value, epoch_us(ts) AS t, floor(epoch_us(ts) / {float(HOUR)})::BIGINT AS k FROM events
  QUALIFY k >= max(k) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT event_type, k, sum(value) AS v FROM e GROUP BY 1, 2), l AS (SELECT event_type, max(k) - 1 AS n FROM b GROUP BY 1),
m AS (SELECT event_type, sum(value) AS total, sum(value) / ((max(t) - min(t)) / {float(HOUR)}) AS mean FROM e GROUP BY 1),
r AS (SELECT event_type, sum({a!r}::DOUBLE * pow({1 - a!r}::DOUBLE, n - k) * v)
  + pow({1 - a!r}::DOUBLE, any_value(n) - min(k) + 1) * arg_min(v, k) AS rate
  FROM b JOIN l USING (event_type) WHERE k <= n GROUP BY 1)
SELECT event_type, round(rate, 6) AS rate, round(total, 4) AS total, round(mean, 6) AS mean
FROM r JOIN m USING (event_type)"""


@query(_stream_sql())
def stream_meter(spark, sf_dir):
    """Four batches; marks of an interval that is closed are late, by key and in order of arrival."""
    df = live.meters(_in_arrival(spark, sf_dir), "event_type", [DAY], HOUR)
    out = live.run_to_end(df, _named("stream_meter"), "update")
    newest = out.groupBy("key").agg(F.max_by(F.struct("rate", "total", "mean"), F.col("seq")).alias("m"))
    rate, mean = F.round("m.rate", 6).alias("rate"), F.round("m.mean", 6).alias("mean")
    return newest.select(F.col("key").alias("event_type"), rate, F.round("m.total", 4).alias("total"), mean)


def _stream_ewma_sql() -> str:
    a = ewma.alpha(7 * DAY, DAY)
    jump = f"(o.d - f.last > 7 AND (o.d - f.last - 1) // 7 = 0)"
    blended = f"(f.rate + {a!r}::DOUBLE * (f.pending - f.rate))"
    return f"""WITH RECURSIVE e AS (SELECT event_type, value, epoch_us(ts) // {DAY} AS d FROM events
  QUALIFY d >= max(d) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT event_type, d, sum(value) AS x, row_number() OVER (PARTITION BY event_type ORDER BY d) AS n FROM e GROUP BY 1, 2),
f AS (SELECT event_type, n, 0.0::DOUBLE AS rate, d AS last, x AS pending FROM m WHERE n = 1
  UNION ALL SELECT f.event_type, o.n, CASE WHEN {jump} THEN 0
    ELSE {blended} * pow({1 - a!r}::DOUBLE, o.d - f.last - 1) END, o.d, o.x
  FROM f JOIN m o ON o.event_type = f.event_type AND o.n = f.n + 1)
SELECT event_type, round({blended.replace('f.', '')}, 6) AS value
FROM f QUALIFY n = max(n) OVER (PARTITION BY event_type)"""


@query(_stream_ewma_sql())
def stream_ewma(spark, sf_dir):
    """The exact average over four batches of daily marks; marks before the last tick are ignored."""
    rows = _in_arrival(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / DAY) * DAY)
    df = live.ewmas(rows, "event_type", 7 * DAY, DAY, ASOF - 60 * DAY)
    out = live.run_to_end(df, _named("stream_ewma"), "update")
    newest = out.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return newest.select(F.col("key").alias("event_type"), r6("value"))


@query(f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n
  FROM events), h AS (SELECT event_type, list(value ORDER BY value) AS v FROM r WHERE n <= 100 GROUP BY 1),
c AS (SELECT event_type, count(*) AS count FROM events GROUP BY 1)
SELECT event_type, count, {STATS} FROM h JOIN c USING (event_type)""")
def stream_histogram(spark, sf_dir):
    df = live.histograms(_in_arrival(spark, sf_dir), "event_type", 100)
    out = live.run_to_end(df, _named("stream_histogram"), "update")
    newest = out.groupBy("key").agg(F.max(F.struct("count", "values")).alias("h"))
    return newest.select(F.col("key").alias("event_type"), "h.*").select("event_type", "count", *stats_columns())
