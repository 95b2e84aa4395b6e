"""Queries: counters, gauges, EWMAs, meters, histograms and timers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, stats
from ..operators import basic, ewma, histogram, registry, rollup
from ..sources.events import measurements, micros
from .book import (
    ASOF,
    DAY,
    HOUR,
    STATS,
    WINDOWS,
    E,
    events,
    ewma_sql,
    group_of,
    metric_events,
    quantile_sql,
    query,
    r6,
    rates_sql,
    read,
    stats_columns,
    type_of,
)

# Counters and gauges


@query("""SELECT event_type, user_id, sum(round(value * 100)::BIGINT)::BIGINT AS total, count(*) AS n
FROM events GROUP BY 1, 2""")
def counter_by_tag(spark, sf_dir):
    path, cents = paths.path("events", F.col("event_type")), F.round(F.col("value") * 100)
    e, tags = events(spark, sf_dir), {"user": F.col("user_id")}
    of = lambda value: measurements(e, path, F.col("ts"), F.col("seq"), value, tags, as_type="long")
    total, n = basic.counter(of(cents)), basic.counter(of(F.lit(1))).withColumnRenamed("value", "n")
    both = paths.join_on(total, n, basic.KEYS)
    user = F.col("tags")["user"].cast("long").alias("user_id")
    return both.select(type_of(), user, F.col("value").alias("total"), "n")


@query("""SELECT event_type, sum(n)::BIGINT AS total
FROM (SELECT event_type, user_id % 3 AS g, 5 + count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def counter_rollup(spark, sf_dir):
    e = metric_events(spark, sf_dir, value=F.lit(1))
    return rollup.cumulative(basic.counter(e, initial=5)).select(type_of(), F.col("value").alias("total"))


@query("""WITH e AS (SELECT user_id, event_id, round(value)::BIGINT AS v,
  event_type = 'purchase' OR event_id % 7 = 0 AS a FROM events),
l AS (SELECT user_id, max(event_id) AS last_id, arg_max(v, event_id) AS s FROM e WHERE a GROUP BY 1)
SELECT e.user_id, coalesce(any_value(s), 10)::BIGINT
  + coalesce(sum(CASE WHEN NOT a AND (last_id IS NULL OR event_id > last_id) THEN v END), 0)::BIGINT AS value
FROM e LEFT JOIN l USING (user_id) GROUP BY 1""")
def counter_reset_segments(spark, sf_dir):
    assign = (F.col("event_type") == "purchase") | (F.col("seq") % 7 == 0)
    e = events(spark, sf_dir).withColumn("assign", assign).withColumn("value", F.round("value").cast("long"))
    made = basic.counter_with_resets(e, ["user_id"], ["seq"], initial=10)
    return made.select("user_id", F.col("value").cast("long").alias("value"))


_LAST = "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2"


@query("SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def gauge_last_value(spark, sf_dir):
    return basic.gauge(events(spark, sf_dir), ["event_type", "user_id"])


@query(f"SELECT event_type, round(avg(v), 6) AS value, count(*) AS samples FROM ({_LAST}) GROUP BY 1")
def gauge_rollup_avg(spark, sf_dir):
    g = basic.gauge(events(spark, sf_dir), ["event_type", "user_id"])
    return rollup.average(g, ["event_type"]).withColumn("value", r6("value"))


@query(f"SELECT event_type, round(sum(v), 4) AS value FROM ({_LAST}) GROUP BY 1")
def gauge_rollup_sum(spark, sf_dir):
    g = basic.gauge(events(spark, sf_dir), ["event_type", "user_id"])
    return rollup.cumulative(g, ["event_type"]).withColumn("value", F.round("value", 4))


@query("""SELECT 'customers/balance' AS name, n_regionkey::VARCHAR AS region, round(sum(c_acctbal), 2) AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey
UNION ALL SELECT 'customers/regions', '', count(*)::DOUBLE FROM region""")
def gauge_pull_source(spark, sf_dir):
    """Gauges that refer to a row of a table, and one whose function is called; both are read with the snapshot."""
    r = registry.MetricsRegistry(spark)
    nations = read(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("c_nationkey"))
    each = read(spark, sf_dir, "customer").join(nations, "c_nationkey").select("n_regionkey", "c_acctbal")
    for region in range(5):
        balance = each.where(F.col("n_regionkey") == region).agg(F.sum("c_acctbal").alias("total"))
        r.referential_gauge(("customers", "balance"), balance, F.col("total"), {"region": region})
    r.functional_gauge(("customers", "regions"), read(spark, sf_dir, "region").count)
    g = r.snapshots(metric_events(spark, sf_dir), ASOF)["gauge"]
    region = F.coalesce(F.col("tags")["region"], F.lit("")).alias("region")
    return g.select(paths.render(F.col("path")).alias("name"), region, F.round("value", 2).alias("value"))


# EWMAs and meters

_BY_USER = f"WITH {E}, {ewma_sql(DAY, 'event_type, user_id')} SELECT event_type"


@query(f"{_BY_USER}, user_id, round(rate, 6) AS value FROM r")
def ewma_grid(spark, sf_dir):
    made = ewma.ewma(events(spark, sf_dir), DAY, HOUR, ASOF, ["event_type", "user_id"])
    return made.withColumn("value", r6("value"))


@query(f"{_BY_USER}, round(avg(rate), 6) AS value, count(*) AS samples FROM r GROUP BY 1")
def ewma_rollup_avg(spark, sf_dir):
    each = ewma.ewma(events(spark, sf_dir), DAY, HOUR, ASOF, ["event_type", "user_id"])
    return rollup.average(each, ["event_type"]).withColumn("value", r6("value"))


_A = ewma.alpha(DAY, DAY)
_BEGIN = ASOF - 31 * DAY


def _replay_sql(marks: str) -> str:
    """The fold over daily marks m (event_type, t, x), in order of time, and a read a day after ASOF."""
    blended = f"(f.rate + {_A!r}::DOUBLE * (f.pending - f.rate)) * pow({1 - _A!r}::DOUBLE, (o.t - f.last) // {DAY} - 1)"
    return f"""WITH RECURSIVE m AS ({marks}),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS n
  FROM (SELECT * FROM m UNION ALL SELECT DISTINCT event_type, {ASOF + DAY}, 0.0 FROM m)),
f AS (SELECT event_type, 1 AS n, 0.0::DOUBLE AS rate, {_BEGIN}::BIGINT AS last, x AS pending, false AS ticked
    FROM o WHERE n = 1 AND t - {_BEGIN} < {DAY}
  UNION ALL SELECT event_type, 1, 0.0::DOUBLE, t, x, true FROM o WHERE n = 1 AND t - {_BEGIN} >= {DAY}
  UNION ALL SELECT f.event_type, o.n, CASE WHEN f.rate = 0 AND NOT f.ticked THEN f.pending ELSE {blended} END, o.t, o.x, true
    FROM f JOIN o ON o.event_type = f.event_type AND o.n = f.n + 1)
SELECT event_type, round(arg_max(rate, n), 6) AS value FROM f GROUP BY 1"""


_DAILY = "SELECT event_type, epoch_us(date_trunc('day', ts)) AS t, sum(value) AS x FROM events GROUP BY 1, 2"


def _daily(spark, sf_dir):
    day = F.unix_micros(F.date_trunc("day", F.timestamp_micros("ts"))).alias("ts")
    return events(spark, sf_dir).groupBy("event_type", day).agg(F.sum("value").alias("value"))


@query(_replay_sql(_DAILY))
def ewma_replay(spark, sf_dir):
    e = _daily(spark, sf_dir).withColumn("seq", F.col("ts"))
    return ewma.ewma_replay(e, DAY, DAY, _BEGIN, ASOF + DAY, ["event_type"]).withColumn("value", r6("value"))


#: Every fifth day's mark arrives two and a half days late.
_LATE = 5 * DAY // 2


@query(_replay_sql(f"""SELECT event_type, t, x
FROM (SELECT *, t + CASE WHEN t // {DAY} % 5 = 0 THEN {_LATE} ELSE 0 END AS seq FROM ({_DAILY}))
QUALIFY t = max(t) OVER (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING)"""))
def ewma_late(spark, sf_dir):
    """Marks before their key's last tick are ignored, in order of arrival."""
    late = F.when(F.floor(F.col("ts") / DAY) % 5 == 0, _LATE).otherwise(0)
    e = _daily(spark, sf_dir).withColumn("seq", F.col("ts") + late)
    return ewma.ewma_replay(e, DAY, DAY, _BEGIN, ASOF + DAY, ["event_type"]).withColumn("value", r6("value"))


def meters(spark, sf_dir):
    return ewma.meter(metric_events(spark, sf_dir, "meter"), WINDOWS, HOUR, ASOF)


@query(rates_sql("SELECT event_type, grp::VARCHAR AS grp, window_us, round(rate, 6) AS rate FROM rates"))
def meter_rates(spark, sf_dir):
    each = meters(spark, sf_dir).select(type_of(), group_of(), F.explode("rates").alias("window_us", "rate"))
    return each.withColumn("rate", r6("rate"))


@query(f"""SELECT event_type, (user_id % 3)::VARCHAR AS grp,
  round(sum(value) / (({ASOF} - min(epoch_us(ts))) / {float(HOUR)}), 6) AS mean FROM events GROUP BY 1, 2""")
def meter_mean(spark, sf_dir):
    return meters(spark, sf_dir).select(type_of(), group_of(), r6("mean"))


@query(rates_sql("SELECT event_type, window_us, round(avg(rate), 6) AS rate, count(*) AS samples FROM rates GROUP BY 1, 2"))
def meter_rollup(spark, sf_dir):
    up = rollup.meters(meters(spark, sf_dir))
    up = up.select(type_of(), "samples", F.explode("rates").alias("window_us", "rate"))
    return up.select("event_type", "window_us", r6("rate"), "samples")


@query(f"""WITH o AS (SELECT o_orderpriority, epoch_us(o_orderdate) AS t FROM orders),
c AS (SELECT max(t) + {DAY} AS now_us FROM o)
SELECT o_orderpriority, count(*) AS n, round(count(*) / ((any_value(now_us) - min(t)) / {float(DAY)}), 6) AS per_day
FROM o, c GROUP BY 1""")
def meter_orders(spark, sf_dir):
    ts = micros(F.col("o_orderdate")).alias("ts")
    o = read(spark, sf_dir, "orders").select("o_orderpriority", ts, F.lit(1.0).alias("value"))
    asof = o.agg(F.max("ts")).first()[0] + DAY
    m = ewma.meter(o, [30 * DAY], DAY, asof, ["o_orderpriority"])
    n = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return m.join(n, "o_orderpriority").select("o_orderpriority", "n", F.round("mean", 6).alias("per_day"))


@query(rates_sql(f"""SELECT l.event_type, l.window_us,
  round(CASE WHEN r.rate IS NULL THEN l.rate ELSE (l.rate + r.rate) / 2 END, 6) AS rate, 2 AS samples
FROM rates l LEFT JOIN rates r
  ON r.event_type = l.event_type AND r.grp = 1 AND r.window_us = l.window_us AND r.window_us != {WINDOWS[0]}
WHERE l.grp = 0"""))
def meter_merge(spark, sf_dir):
    e = metric_events(spark, sf_dir, "meter")

    def one(group: int, windows):
        own = e.where(F.col("tags")["group"] == str(group))
        return ewma.meter(own, windows, HOUR, ASOF, ["path"]).withColumn("samples", F.lit(1))

    merged = rollup.merge_meters(one(0, WINDOWS), one(1, WINDOWS[1:]), ["path"])
    rows = merged.select(type_of(), F.explode("rates").alias("window_us", "rate"), F.col("samples").cast("int"))
    return rows.withColumn("rate", r6("rate"))


# Reservoirs and histograms

_COUNTS = "c AS (SELECT event_type, count(*) AS count FROM events GROUP BY 1)"


def _newest_sql(size: int, where: str = "", more: str = "") -> str:
    return f"""WITH r AS (SELECT event_type, value,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events {where}),
h AS (SELECT event_type, list(value ORDER BY value) AS v FROM r WHERE n <= {size} GROUP BY 1), {_COUNTS}
SELECT event_type, count, {STATS}{more} FROM h JOIN c USING (event_type)"""


@query(_newest_sql(200))
def hist_last_n(spark, sf_dir):
    h = histogram.histogram(events(spark, sf_dir), histogram.LastN(200), ["event_type"])
    return h.select("event_type", "count", *stats_columns())


@query(_newest_sql(100, f"WHERE epoch_us(ts) >= {ASOF - DAY}"))
def hist_sliding(spark, sf_dir):
    h = histogram.histogram(events(spark, sf_dir), histogram.Sliding(100, DAY, ASOF), ["event_type"])
    return h.select("event_type", "count", *stats_columns())


@query(f"""WITH e AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS value,
  l_orderkey * 10 + l_linenumber AS s FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY md5('3:' || s), s) AS n FROM e),
h AS (SELECT l_returnflag, l_linestatus, list(value ORDER BY value) AS v FROM r WHERE n <= 1024 GROUP BY 1, 2),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, count, {STATS} FROM h JOIN c USING (l_returnflag, l_linestatus)""")
def hist_uniform(spark, sf_dir):
    keys, seq = ["l_returnflag", "l_linestatus"], F.col("l_orderkey") * 10 + F.col("l_linenumber")
    li = read(spark, sf_dir, "lineitem").select(*keys, F.col("l_extendedprice").alias("value"), seq.alias("seq"))
    return histogram.histogram(li, histogram.Uniform(1024, seed=3), keys).select(*keys, "count", *stats_columns())


_SORTED = "s AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY 1)"


@query(f"""WITH {_SORTED} SELECT event_type, q AS quantile, round({quantile_sql('q')}, 6) AS value
FROM s, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) t(q)""")
def quantiles_type6(spark, sf_dir):
    x = stats.exact(events(spark, sf_dir), ["event_type"])
    return x.select("event_type", F.inline("quantiles")).withColumn("value", r6("value"))


@query(f"""WITH {_SORTED} SELECT event_type, p AS percentile, round({quantile_sql('(p / 100.0)::DOUBLE')}, 6) AS value
FROM s, (VALUES (0), (10), (95), (100)) t(p)""")
def quantile_percents(spark, sf_dir):
    x = stats.exact(events(spark, sf_dir), ["event_type"], qs=[stats.percent(p) for p in (0, 10, 95, 100)])
    percent = F.round(F.col("quantile") * 100).cast("int").alias("percentile")
    return x.select("event_type", F.inline("quantiles")).select("event_type", percent, r6("value"))


@query(f"""WITH {_SORTED}, p AS (SELECT event_type, v, n, i, i * (1.0::DOUBLE / least(10, n - 1)) AS q
  FROM s, generate_series(1, 9) g(i) WHERE n > 1)
SELECT event_type, round(100 * q, 6) AS key, round({quantile_sql('q')}, 6) AS value
FROM p WHERE floor(q * (n + 1)) < n AND q <= 1""")
def sample_quantiles(spark, sf_dir):
    qs = [lambda n, i=i: i * stats.sample_step(n, 9) for i in range(1, 10)]
    x = stats.exact(events(spark, sf_dir), ["event_type"], qs=qs).where("count > 1")
    each = x.select("event_type", "count", F.inline("quantiles"))
    each = each.where((F.floor(F.col("quantile") * (F.col("count") + 1)) < F.col("count")) & (F.col("quantile") <= 1))
    return each.select("event_type", F.round(100 * F.col("quantile"), 6).alias("key"), r6("value"))


@query(f"""WITH {_SORTED}, p AS (SELECT event_type, v[-30:] AS v FROM s), s2 AS (SELECT *, len(v) AS n FROM p),
q AS (SELECT event_type, v, n, i * (1.0::DOUBLE / least(6, n - 1)) AS q FROM s2, generate_series(1, 5) g(i) WHERE n > 1)
SELECT event_type, round(100 * q, 6) AS key, round({quantile_sql('q')}, 6) AS value
FROM q WHERE floor(q * (n + 1)) < n AND q <= 1""")
def reservoir_sample(spark, sf_dir):
    """Evenly spaced quantiles of a bounded reservoir: the 30 largest values."""
    largest = histogram.LastN(30, order=("value", "seq"))
    h = histogram.histogram(events(spark, sf_dir), largest, ["event_type"])
    each = h.select("event_type", F.inline(stats.sample(F.col("values"), 5)))
    return each.select("event_type", r6("key"), r6("value"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(avg(l_quantity), 6) AS mean,
  min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem GROUP BY 1, 2""")
def hist_mean_min_max(spark, sf_dir):
    keys = ["l_returnflag", "l_linestatus"]
    x = stats.exact(read(spark, sf_dir, "lineitem"), keys, "l_quantity", qs=())
    return x.select(*keys, "count", r6("mean"), "least", "greatest")


def _grouped_sql(size: int) -> str:
    return f"""r AS (SELECT event_type, user_id % 3 AS g, value,
  row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts DESC, event_id DESC) AS n FROM events),
h AS (SELECT event_type, list(value ORDER BY value) AS v FROM r WHERE n <= {size} GROUP BY 1), {_COUNTS}"""


@query(f"""WITH {_grouped_sql(50)} SELECT event_type, count, {STATS},
  round({quantile_sql('0.5::DOUBLE', 'v', 'len(v)')}, 6) AS median FROM h JOIN c USING (event_type)""")
def hist_merge_union(spark, sf_dir):
    h = histogram.histogram(metric_events(spark, sf_dir, "histogram"), histogram.LastN(50))
    median = F.round(stats.quantile(F.col("values"), 0.5), 6).alias("median")
    return rollup.histograms(h).select(type_of(), "count", *stats_columns(), median)


@query(f"""WITH d AS (SELECT lang, list(n_chars::DOUBLE ORDER BY n_chars) AS v, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, n AS count, round({quantile_sql('0.5::DOUBLE')}, 6) AS p50, round({quantile_sql('0.99::DOUBLE')}, 6) AS p99
FROM d""")
def document_sizes(spark, sf_dir):
    x = stats.exact(read(spark, sf_dir, "documents"), ["lang"], "n_chars", (0.5, 0.99))
    at = lambda i, name: F.round(F.col("quantiles")[i]["value"], 6).alias(name)
    return x.select("lang", "count", at(0, "p50"), at(1, "p99"))


# Timers

GAPS = """g AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t,
  lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS d FROM events)"""


def gaps(spark, sf_dir):
    return basic.gaps(events(spark, sf_dir), ["user_id"], "ts", ["ts", "seq"], ["ts", "seq", "event_type"])


@query(f"""WITH {GAPS}, s AS (SELECT user_id, list(d::DOUBLE ORDER BY d) AS v, count(*) AS n, sum(d) AS total
  FROM g WHERE d != 0 GROUP BY 1)
SELECT user_id, n AS count, round(total / n, 3) AS mean, round({quantile_sql('0.9::DOUBLE')}, 3) AS p90 FROM s""")
def timer_user_gaps(spark, sf_dir):
    g = basic.gaps(events(spark, sf_dir), ["user_id"], "ts", ["ts", "seq"]).where("duration != 0")
    x = stats.exact(g, ["user_id"], "duration", (0.9,))
    p90 = F.round(F.col("quantiles")[0]["value"], 3).alias("p90")
    return x.select("user_id", "count", F.round("mean", 3).alias("mean"), p90)


@query("""WITH n AS (SELECT user_id, event_type, epoch_us(ts) AS t, lead(event_type) OVER w AS e2,
  lead(epoch_us(ts)) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS spans, sum(t2 - t)::BIGINT AS total_us
FROM n WHERE event_type = 'click' AND e2 = 'purchase' AND t2 != t GROUP BY 1""")
def timer_span_pairs(spark, sf_dir):
    begun, ended = F.col("event_type") == "click", F.col("event_type") == "purchase"
    s = basic.span_durations(events(spark, sf_dir), ["user_id"], "ts", ["ts", "seq"], begun, ended)
    totals = F.count("*").alias("spans"), F.sum("duration").alias("total_us")
    return s.where("duration != 0").groupBy("user_id").agg(*totals)


def _exclude_sql() -> str:
    calls = f"{GAPS}, c AS (SELECT user_id, t, 1.0::DOUBLE AS one FROM g WHERE d != 0 AND event_type != 'error')"
    mean = f"round(count(*) / (({ASOF} - min(t)) / {float(HOUR)}), 6) AS mean"
    return f"""WITH {calls}, {ewma_sql(DAY, 'user_id', of='c', value='one')},
m AS (SELECT user_id, count(*) AS count, {mean} FROM c GROUP BY 1)
SELECT user_id, count, mean, round(rate, 6) AS rate FROM m JOIN r USING (user_id)"""


@query(_exclude_sql())
def timer_exclude_errors(spark, sf_dir):
    failed = F.col("event_type") == "error"
    chosen = histogram.LastN(10)
    t = histogram.timer(gaps(spark, sf_dir), [DAY], HOUR, ASOF, chosen, ["user_id"], "duration", failed)
    return t.select("user_id", "count", r6("mean"), F.round(F.col("rates")[DAY], 6).alias("rate"))


@query("""WITH d AS (SELECT o_orderpriority AS p, l_orderkey * 10 + l_linenumber AS s,
  date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT p, d, count(*) OVER (PARTITION BY p) AS count, row_number() OVER (PARTITION BY p ORDER BY s DESC, d DESC) AS n
  FROM d WHERE d != 0)
SELECT p AS priority, any_value(count) AS count, round(avg(d), 6) AS mean, min(d) AS least, max(d) AS greatest
FROM r WHERE n <= 500 GROUP BY 1""")
def timer_ship_delay(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    o = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"), "o_orderdate")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    delay = F.datediff("l_shipdate", "o_orderdate").cast("double").alias("value")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    d = li.join(o, "l_orderkey").select("priority", micros(F.col("l_shipdate")).alias("ts"), seq, delay)
    t = histogram.timer(d, [DAY], DAY, ASOF, histogram.LastN(500, order=("seq", "value")), ["priority"])
    return t.select("priority", "count", *stats_columns()).drop("size")


@query(f"""WITH {E}, {GAPS}, d AS (SELECT event_type, user_id % 3 AS grp, t, event_id, d, 1.0::DOUBLE AS one
  FROM g WHERE d != 0),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, grp ORDER BY t DESC, event_id DESC) AS n FROM d),
h AS (SELECT event_type, list(d::DOUBLE ORDER BY d) AS v FROM k WHERE n <= 20 GROUP BY 1),
c AS (SELECT event_type, count(*) AS count, count(DISTINCT grp) AS samples FROM d GROUP BY 1),
{ewma_sql(DAY, 'event_type, grp', of='d', value='one')},
w AS (SELECT event_type, round(avg(rate), 6) AS rate FROM r GROUP BY 1),
m AS (SELECT event_type, round(avg(mean), 6) AS per_hour FROM (
  SELECT event_type, grp, count(*) / (({ASOF} - min(t)) / {float(HOUR)}) AS mean FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT event_type, count, samples, per_hour, rate, {STATS.replace('AS mean', 'AS average')}
FROM h JOIN c USING (event_type) JOIN w USING (event_type) JOIN m USING (event_type)""")
def timer_rollup(spark, sf_dir):
    """The timers of all groups of a path in one: counts add up, reservoirs unite, rates and means are averaged."""
    path = paths.path("gap", F.col("event_type"))
    tags = {"group": F.col("user_id") % 3}
    d = measurements(gaps(spark, sf_dir), path, F.col("ts"), F.col("seq"), F.col("duration"), tags, "timer")
    up = rollup.timers(histogram.timer(d, [DAY], HOUR, ASOF, histogram.LastN(20)))
    size, average, *ends = stats_columns()
    rate = F.round(F.col("rates")[DAY], 6).alias("rate")
    per_hour = F.round("mean", 6).alias("per_hour")
    return up.select(type_of(), "count", "samples", per_hour, rate, size, average.alias("average"), *ends)
