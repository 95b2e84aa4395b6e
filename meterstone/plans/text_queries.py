"""Queries: values, paths and labels, and exposition text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, stats, values
from ..operators import basic, histogram, registry
from ..sources.events import measurements
from ..sources.sinks import checkpoint_path
from . import exposition
from .book import (
    ASOF,
    HOUR,
    WINDOWS,
    E,
    events,
    ewma_sql,
    metric_events,
    quantile_sql,
    query,
    r6,
    read,
    type_of,
)
from .metric_queries import GAPS, gaps, meters

# Values

SCALE = "CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END"


def some_options(spark) -> DataFrame:
    click = registry.PublishOptions(include_mean=False, include_count=False, quantiles=(0.75,), as_distribution=True)
    own = {("events", "click"): click, ("events", "view"): registry.PublishOptions(scale=2.0)}
    return registry.options_table(spark, registry.PublishOptions(scale=0.5), own)


@query(f"""SELECT event_type, round(CASE WHEN {SCALE} IS NULL THEN sum(value) ELSE sum(value) * {SCALE} END, 4) AS value
FROM events GROUP BY event_type""")
def scale_projection(spark, sf_dir):
    c = basic.counter(metric_events(spark, sf_dir, "gauge"), ["path"], as_type="double")
    scaled = F.round(values.scale(F.col("value"), F.col("scale")), 4).alias("value")
    return registry.effective_options(c, some_options(spark)).select(type_of(), scaled)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE round(l_quantity / l_discount, 6) END AS ratio,
  CASE WHEN l_linenumber - 1 = 0 THEN 0 ELSE l_orderkey // (l_linenumber - 1) END AS whole FROM lineitem""")
def safe_divide(spark, sf_dir):
    ratio = F.round(values.divide(F.col("l_quantity"), F.col("l_discount")), 6)
    whole = values.int_divide(F.col("l_orderkey"), F.col("l_linenumber") - 1)
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ratio.alias("ratio"), whole.alias("whole"))


@query("""SELECT o_orderkey, round(o_totalprice)::BIGINT AS whole, coalesce(try_cast(o_orderpriority AS BIGINT), 0) AS parsed,
  printf('%.6f', round(o_totalprice, 2)) AS shown FROM orders""")
def cast_rounding(spark, sf_dir):
    whole = values.to_whole(F.col("o_totalprice")).alias("whole")
    parsed = values.parse_whole(F.col("o_orderpriority")).alias("parsed")
    shown = values.show(F.round("o_totalprice", 2)).alias("shown")
    return read(spark, sf_dir, "orders").select("o_orderkey", whole, parsed, shown)


@query("""SELECT p_partkey, ~p_size::BIGINT AS inverted, -p_retailprice AS negated,
  CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END AS compared, p_brand || p_type AS joined FROM part""")
def bitwise_not(spark, sf_dir):
    size = F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select(
        "p_partkey", values.invert(size).alias("inverted"), values.negate(F.col("p_retailprice")).alias("negated"),
        values.compare(size, F.lit(25)).alias("compared"),
        values.text_add(F.col("p_brand"), F.col("p_type")).alias("joined"),
    )


@query("""SELECT p_partkey, round(p_size + p_retailprice, 6) AS added, p_partkey - p_size AS subtracted,
  round(p_size * p_retailprice, 4) AS multiplied, p_size + coalesce(try_cast(substr(p_brand, 7) AS BIGINT), 0) AS parsed,
  p_brand || '12' AS joined, p_size * 1000 - 60000 AS waited,
  CASE WHEN p_size = 25 THEN 0 ELSE round(p_retailprice / (p_size - 25), 6) END AS divided FROM part""")
def promoted_arithmetic(spark, sf_dir):
    """+ - * / between types: the type of the higher score decides, whichever side it stands on."""
    t = values.Typed
    key, size, price = t(F.col("p_partkey"), "long"), t(F.col("p_size"), "int"), t(F.col("p_retailprice"), "double")
    digits, brand = t(F.substring("p_brand", 7, 9), "string"), t(F.col("p_brand"), "string")
    waited = t(F.col("p_size").cast("long") * 1000, "duration") - t(F.lit(60_000), "int")
    divided = price / t(F.col("p_size") - 25, "int")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.round((size + price).column, 6).alias("added"), (key - size).column.alias("subtracted"),
        F.round((price * size).column, 4).alias("multiplied"), (digits + size).column.cast("long").alias("parsed"),
        (brand + t(F.lit("12"), "string")).column.alias("joined"), waited.column.alias("waited"),
        F.round(divided.column, 6).alias("divided"),
    )


@query("SELECT p_brand, count(DISTINCT p_type) AS hashes, count(DISTINCT p_size) AS numbers FROM part GROUP BY 1")
def value_hashes(spark, sf_dir):
    """Equal values have equal hashes, and different ones here different hashes."""
    hashed = lambda c: F.count_distinct(values.hash_value(F.col(c)))
    part = read(spark, sf_dir, "part").groupBy("p_brand")
    return part.agg(hashed("p_type").alias("hashes"), hashed("p_size").alias("numbers"))


@query("""SELECT event_id, epoch_us(ts) // 60000000 AS minutes, epoch_us(ts) % 60000000 // 1000 AS millis FROM events""")
def period_arithmetic(spark, sf_dir):
    minutes = values.convert(F.col("ts"), "usec", "min").alias("minutes")
    millis = values.convert(F.col("ts") % values.Period.of(1, "min").us, "usec", "msec").alias("millis")
    return events(spark, sf_dir).select(F.col("seq").alias("event_id"), minutes, millis)


# Text


@query("SELECT p_partkey, p_brand || '/' || p_type || '/' || 'size' AS path, 3 AS segments FROM part")
def path_join(spark, sf_dir):
    p = paths.join(paths.path(F.col("p_brand"), F.lit(""), F.col("p_type")), paths.path("size"))
    return read(spark, sf_dir, "part").select("p_partkey", paths.render(p).alias("path"), F.size(p).alias("segments"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_size || p_name, '^[0-9]') THEN '_' ELSE '' END
  || regexp_replace(p_size || p_name, '[^A-Za-z0-9]', '_', 'g') || ':'
  || regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g') AS name FROM part""")
def name_mangle(spark, sf_dir):
    path = paths.path(F.concat(F.col("p_size").cast("string"), "p_name"), F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", paths.metric_name(path).alias("name"))


@query("""SELECT event_id, 'props="' || replace(props, '"', '\\"') || '",user_id="' || user_id || '"' AS labels FROM events""")
def tag_escape(spark, sf_dir):
    tags = F.create_map(F.lit("user-id"), F.col("user_id").cast("string"), F.lit("props"), F.col("props"))
    return events(spark, sf_dir).select(F.col("seq").alias("event_id"), paths.labels(tags).alias("labels"))


@query("""WITH d AS (SELECT DISTINCT l_linenumber, (l_quantity * l_quantity * l_quantity * l_linenumber * 1000)::BIGINT
  * CASE WHEN l_linenumber % 2 = 0 THEN 1000 ELSE 1 END AS us FROM lineitem)
SELECT us, CASE WHEN us >= 3600000000 THEN (us // 3600000000) || 'hr' WHEN us >= 60000000 THEN (us // 60000000) || 'min'
  WHEN us >= 1000000 THEN (us // 1000000) || 'sec' WHEN us >= 1000 THEN (us // 1000) || 'msec' ELSE us || 'usec' END AS label
FROM (SELECT DISTINCT us FROM d)""")
def window_label(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    us = (q * q * q * n * 1000).cast("long") * F.when(n % 2 == 0, 1000).otherwise(1)
    each = read(spark, sf_dir, "lineitem").select(us.alias("us")).distinct()
    return each.select("us", paths.window_label(F.col("us")).alias("label"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Supplier' WHEN 1 THEN 'counter' WHEN 2 THEN 'meter'
  WHEN 3 THEN s_name ELSE '' END AS kind FROM supplier""")
def type_names(spark, sf_dir):
    n, name = F.col("s_suppkey") % 5, F.col("s_name")
    raw = (
        F.when(n == 0, F.concat(F.lit("a::b::Supplier<c::"), name, F.lit(">")))
        .when(n == 1, F.lit("ns<int>::counter<long>"))
        .when(n == 2, F.concat(F.lit("a<b::c<d>>::meter<e::f<"), name, F.lit(", g::h<1>>, 2>")))
        .when(n == 3, name)
    )
    return read(spark, sf_dir, "supplier").select("s_suppkey", paths.type_name(raw).alias("kind"))


# Exposition


def shown(df: DataFrame) -> DataFrame:
    return df.select(paths.render(F.col("path")).alias("path"), "line_no", "tag_text", "line")


def defaults(spark):
    return registry.options_table(spark)


NAME = "'events:' || event_type"
TAG = "'group=\"' || grp || '\"'"


def prom_sql(kind: str, body: str, more: str = "") -> str:
    return f"""WITH {E}{more}, x AS ({body})
SELECT 'events/' || event_type AS path, line_no::INTEGER AS line_no, tag_text, line FROM x
UNION ALL SELECT DISTINCT 'events/' || event_type, 0, '', '# TYPE events:' || event_type || ' {kind}' FROM x"""


def plain_sql(no: int, value: str, source: str, suffix: str = "") -> str:
    """A line without a label of its own."""
    line = f"{NAME} || '{suffix}{{' || {TAG} || '}} ' || {value}"
    return f"SELECT event_type, {no} AS line_no, {TAG} AS tag_text, {line} AS line FROM {source}"


def label_sql(no: str, label: str, value: str, source: str, name: str = NAME) -> str:
    line = f"{name} || '{{{label},' || {TAG} || '}} ' || {value}"
    return f"SELECT event_type, {no} AS line_no, {TAG} AS tag_text, {line} AS line FROM {source}"


def f6(value: str) -> str:
    return f"printf('%.6f', round({value}, 6))"


@query(prom_sql("untyped", plain_sql(1, "count(*)", "e GROUP BY event_type, grp")))
def prom_counter(spark, sf_dir):
    c = basic.counter(metric_events(spark, sf_dir, value=F.lit(1)))
    return shown(exposition.lines(c, defaults(spark), "counter", "long"))


_LAST = "printf('%.6f', arg_max(value, (t, event_id)))"


@query(prom_sql("gauge", plain_sql(1, _LAST, "e GROUP BY event_type, grp")))
def prom_gauge(spark, sf_dir):
    g = basic.gauge(metric_events(spark, sf_dir, "gauge"))
    return shown(exposition.lines(g, defaults(spark), "gauge"))


@query(prom_sql("gauge", plain_sql(1, _LAST, "e WHERE event_type != 'error' GROUP BY event_type, grp")))
def prom_named_only(spark, sf_dir):
    """Paths without segments are not published."""
    path = F.when(F.col("event_type") == "error", F.array().cast("array<string>"))
    path = path.otherwise(paths.path("events", F.col("event_type")))
    e, tags = events(spark, sf_dir), {"group": F.col("user_id") % 3}
    m = measurements(e, path, F.col("ts"), F.col("seq"), F.col("value"), tags, "gauge")
    return shown(exposition.lines(basic.gauge(m), defaults(spark), "gauge"))


def _window_lines(first: int, of: str = "e", value: str = "value", name: str = NAME) -> list[str]:
    """The lines of a meter: its mean, and one for each window."""
    out = []
    mean = f"sum({value}) / (({ASOF} - min(t)) / {float(HOUR)})"
    out.append(label_sql(str(first), 'window="mean"', f6(mean), f"{of} GROUP BY event_type, grp", name))
    for n, w in enumerate(WINDOWS):
        source = f"(WITH {ewma_sql(w, 'event_type, grp', of=of, value=value)} SELECT * FROM r)"
        out.append(label_sql(str(first + n + 1), f'window="{w // HOUR}hr"', f6("rate"), source, name))
    return out


def rounded(m: DataFrame) -> DataFrame:
    return m.withColumn("mean", r6("mean")).withColumn("rates", F.transform_values("rates", lambda k, v: F.round(v, 6)))


@query(prom_sql("gauge", " UNION ALL ".join(_window_lines(1))))
def prom_meter(spark, sf_dir):
    return shown(exposition.lines(rounded(meters(spark, sf_dir)), defaults(spark), "meter"))


_NEWEST = """, rk AS (SELECT *, row_number() OVER (PARTITION BY event_type, grp ORDER BY t DESC, event_id DESC) AS rn FROM e),
h AS (SELECT event_type, grp, list(round(value, 2) ORDER BY value) AS v, count(*) AS n FROM rk WHERE rn <= 100 GROUP BY 1, 2),
c AS (SELECT event_type, grp, count(*) AS cnt FROM e GROUP BY 1, 2)"""


def _histogram_lines() -> list[str]:
    out = [plain_sql(1, "cnt", "c", "_count"), plain_sql(2, f6("list_sum(v) / n"), "h", "_mean")]
    for n, q in enumerate((0.5, 0.9, 0.99)):
        out.append(label_sql(str(n + 3), f'quantile="{q}"', f6(quantile_sql(f"{q}::DOUBLE")), "h"))
    return out


def _histograms(spark, sf_dir):
    e = metric_events(spark, sf_dir, "histogram", F.round("value", 2))
    return histogram.histogram(e, histogram.LastN(100))


@query(prom_sql("summary", " UNION ALL ".join(_histogram_lines()), _NEWEST))
def prom_histogram(spark, sf_dir):
    return shown(exposition.lines(_histograms(spark, sf_dir), defaults(spark), "histogram"))


def _options_sql() -> str:
    """prom_histogram by some_options(): a factor for counts too, no count and one other quantile for clicks."""
    scaled = lambda x: f"round(({x}) * ({SCALE}), 6)"
    some = "event_type != 'click'"
    out = [plain_sql(1, f6(scaled("cnt")), f"c WHERE {some}", "_count")]
    out.append(plain_sql(2, f6(scaled("list_sum(v) / n")), f"h WHERE {some}", "_mean"))
    out.append(plain_sql(1, f6("list_sum(v) / n"), "h WHERE event_type = 'click'", "_mean"))
    for n, q in enumerate((0.5, 0.9, 0.99)):
        value = f6(scaled(quantile_sql(f"{q}::DOUBLE")))
        out.append(label_sql(str(n + 3), f'quantile="{q}"', value, f"h WHERE {some}"))
    click = "h WHERE event_type = 'click'"
    out.append(label_sql("2", 'quantile="0.75"', f6(quantile_sql("0.75::DOUBLE")), click))
    return prom_sql("summary", " UNION ALL ".join(out), _NEWEST)


@query(_options_sql())
def prom_options(spark, sf_dir):
    """Text under options: include flags, a scale, quantiles of one metric's own; as_distribution changes nothing."""
    return shown(exposition.lines(_histograms(spark, sf_dir), some_options(spark), "histogram"))


@query(prom_sql("gauge", " UNION ALL ".join(
    f"SELECT * FROM ({x}) WHERE event_type != 'click' OR line_no > 1" for x in _window_lines(1)
)).replace("line_no::INTEGER", "(line_no - CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::INTEGER"))
def prom_meter_options(spark, sf_dir):
    """No mean line for one metric."""
    own = {("events", "click"): registry.PublishOptions(include_mean=False)}
    options = registry.options_table(spark, None, own)
    return shown(exposition.lines(rounded(meters(spark, sf_dir)), options, "meter"))


def _timers(spark, sf_dir):
    path, tags = paths.path("gap", F.col("event_type")), {"group": F.col("user_id") % 3}
    g = gaps(spark, sf_dir)
    d = measurements(g, path, F.col("ts"), F.col("seq"), F.col("duration"), tags, "timer")
    return histogram.timer(d, WINDOWS, HOUR, ASOF, histogram.LastN(100))


def _timer_sql() -> str:
    name = "'gap:' || event_type"
    before = f"""WITH {E}, {GAPS}, d AS (SELECT event_type, user_id % 3 AS grp, t, event_id, d, 1.0::DOUBLE AS one
  FROM g WHERE d != 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_type, grp ORDER BY t DESC, event_id DESC) AS rn FROM d),
h AS (SELECT event_type, grp, list(d::DOUBLE ORDER BY d) AS v, count(*) AS n FROM rk WHERE rn <= 100 GROUP BY 1, 2)"""
    count = plain_sql(1, "count(*)", "d GROUP BY event_type, grp", "_count").replace(NAME, name)
    mean = plain_sql(2, "floor(list_sum(v) / n)::BIGINT", "h", "_mean").replace(NAME, name)
    out = [count, mean]
    for n, q in enumerate((0.5, 0.9, 0.99)):
        value = f"floor({quantile_sql(f'{q}::DOUBLE')})::BIGINT"
        out.append(label_sql(str(n + 3), f'quantile="{q}"', value, "h", name))
    out += _window_lines(6, "d", "one", f"{name} || ':rates'")
    return f"""{before}, x AS ({' UNION ALL '.join(out)})
SELECT 'gap/' || event_type AS path, line_no::INTEGER AS line_no, tag_text, line FROM x
UNION ALL SELECT DISTINCT 'gap/' || event_type, -1, '', '# HELP ' || {name} || ' gap/' || event_type || ' in microseconds'
  FROM x
UNION ALL SELECT DISTINCT 'gap/' || event_type, 0, '', '# TYPE ' || {name} || ' summary' FROM x"""


@query(_timer_sql())
def prom_timer(spark, sf_dir):
    return shown(exposition.lines(rounded(_timers(spark, sf_dir)), defaults(spark), "timer"))


@query(_timer_sql().replace("SELECT 'gap/' || event_type AS path, line_no::INTEGER", """SELECT 'gap/' || event_type AS path,
  (line_no - 1)::INTEGER""").replace("line FROM x\nUNION", "line FROM x WHERE line_no NOT IN (1, 6, 7, 8, 9)\nUNION"))
def prom_timer_options(spark, sf_dir):
    """Neither counts nor rates."""
    options = registry.options_table(spark, registry.PublishOptions(include_count=False, include_rates=False))
    return shown(exposition.lines(rounded(_timers(spark, sf_dir)), options, "timer"))


_COUNTER_LINES = f"""SELECT event_type, grp, '# TYPE ' || {NAME} || ' untyped' AS head,
  {NAME} || '{{' || {TAG} || '}} ' || count(*) AS line FROM e GROUP BY event_type, grp"""


@query(f"""WITH {E}, x AS ({_COUNTER_LINES}), y AS (SELECT *, lag(line) OVER (PARTITION BY event_type ORDER BY grp) AS before
  FROM x)
SELECT line, coalesce(before, head) AS follows FROM y UNION ALL SELECT DISTINCT head, NULL FROM y""")
def text_sink(spark, sf_dir):
    """Text files as written, each line with the one above it in its path's block."""
    folder = checkpoint_path(spark, "exposition")
    c = basic.counter(metric_events(spark, sf_dir, value=F.lit(1)))
    exposition.TextPublisher(defaults(spark)).write({"counter": c}, folder)
    whole = spark.read.text(folder, wholetext=True)
    each = whole.select(F.split(F.rtrim("value", F.lit("\n")), "\n").alias("v"))
    each = each.select("v", F.posexplode("v").alias("n", "line"))
    above = F.when(~F.col("line").startswith("#"), F.get("v", F.col("n") - 1))
    return each.select("line", above.alias("follows"))
