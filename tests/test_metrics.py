"""The numbers of the reference's own tests, and edge cases, over small tables."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterstone.functions import paths, stats, values
from meterstone.operators import basic, ewma, histogram, registry, rollup
from meterstone.plans import exposition
from meterstone.sources import events

MARKS = "k string, ts long, seq long, value double"


def marks(spark, rows):
    return spark.createDataFrame([("k", t, i, float(v) if v is not None else None) for i, (t, v) in enumerate(rows)], MARKS)


def one(df, column="value"):
    return df.first()[column]


def test_counter_with_resets(spark):
    ops = [(5, False), (1, False), (-16, False), (-1, False), (10, True)]
    for n, want in enumerate((15, 20, 21, 5, 4, 10)):
        rows = spark.createDataFrame([("k", i, float(v), a) for i, (v, a) in enumerate(ops[:n])], "k string, seq long, value double, assign boolean")
        if n:
            assert one(basic.counter_with_resets(rows, ["k"], ["seq"], initial=15)) == want
    assert basic.counter_with_resets(spark.createDataFrame([], "k string, seq long, value double, assign boolean"), ["k"], ["seq"]).count() == 0


def test_counter_rollup(spark):
    rows = spark.createDataFrame([(["c"], {}, 10), (["c"], {"mytag": "tagvalue"}, 45)], "path array<string>, tags map<string,string>, value long")
    each = basic.counter(rows)
    assert each.count() == 2
    assert one(rollup.cumulative(each)) == 55


def test_gauge_takes_the_last(spark):
    assert one(basic.gauge(marks(spark, [(1, 20), (2, 50)]), ["k"])) == 50
    assert one(basic.gauge(marks(spark, [(2, 20), (2, 50), (1, 7)]), ["k"])) == 50


def replay(spark, rows, window, interval, start, asof):
    return one(ewma.ewma_replay(marks(spark, rows), window, interval, start, asof, ["k"]))


def test_ewma_replay(spark):
    assert replay(spark, [(5, 1), (6, 0), (2, 4)], 30, 1, 5, 2) == 1
    assert round(replay(spark, [(t, 7) for t in range(1, 12)], 10, 1, 1, 12)) == 7
    gap = [(t, 7) for t in range(11)] + [(11, None), (111, 1)]
    assert replay(spark, gap, 10, 1, 0, 111) <= 1
    long_run = [(t, 7) for t in range(101)] + [(101, None), (141, 1)]
    assert replay(spark, long_run, 10, 1, 0, 141) <= 1
    assert replay(spark, [(0, 7), (5, 7)], 10, 1, 0, 6) == pytest.approx(7.0)


def test_ewma_grid_decays_the_first_gap(spark):
    assert one(ewma.ewma(marks(spark, [(0, 7), (5, 7)]), 10, 1, 6, ["k"])) == pytest.approx(5.793, abs=1e-3)
    assert one(ewma.ewma(marks(spark, [(0, 7)]), 10, 1, 0, ["k"])) == 7


def test_meter_windows(spark):
    rows = [(t, 10) for t in range(1, 11)]
    m = ewma.meter(marks(spark, rows), [50, 1, 8, 20, 8], 1, 11, ["k"]).first()
    assert m["mean"] == 10
    assert sorted(m["rates"]) == [1, 8, 20, 50]
    assert all(v == pytest.approx(10) for v in m["rates"].values())
    m = ewma.meter(marks(spark, [*rows, (111, 1000)]), [1, 8, 20, 50], 1, 112, ["k"]).first()
    r = m["rates"]
    assert r[1] > r[8] > r[20] > r[50]
    assert m["mean"] == pytest.approx(1100 / 111)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=2, max_size=12), st.integers(2, 15))
def test_grid_equals_replay_without_gaps(spark, xs, window):
    rows = list(enumerate(xs))
    rows[0] = (0, xs[0] + 1.0)
    grid = one(ewma.ewma(marks(spark, rows), window, 1, len(xs), ["k"]))
    assert grid == pytest.approx(replay(spark, rows, window, 1, 0, len(xs)), abs=1e-9)


def reservoir(spark, xs, size=5):
    rows = marks(spark, list(enumerate(xs)))
    return histogram.histogram(rows, histogram.LastN(size), ["k"])


def test_reservoirs(spark):
    for xs in ([10, 15, 30, 40, 45], [200, 10, 13, 10, 15, 30, 40, 45]):
        h = histogram.summary(reservoir(spark, xs), ["k"], (0.6, 0.99)).first()
        assert (h["min"], h["max"], h["mean"], h["count"]) == (10, 45, 28, len(xs))
        assert [q["value"] for q in h["quantiles"]] == pytest.approx([36, 45])
    rows = [(500, 200), (520, 10), (540, 13), (560, 10), (580, 20), (640, 30), (640, 40), (640, 60)]
    h = histogram.summary(histogram.histogram(marks(spark, rows), histogram.Sliding(10, 100, 680), ["k"]), ["k"]).first()
    assert (h["min"], h["max"], h["mean"], h["count"]) == (20, 60, 37.5, 8)


def test_uniform_is_exact_when_small_and_close_when_large(spark):
    assert reservoir(spark, [3, 1, 2]).first()["values"] == [1, 2, 3]
    rows = marks(spark, [(i, 100 + i * 100 / 1000) for i in range(1000)])
    for biased in (False, True):
        h = histogram.histogram(rows, histogram.Uniform(100, recency_biased=biased), ["k"]).first()
        assert h["count"] == 1000 and len(h["values"]) == 100
        if not biased:
            assert abs(sum(h["values"]) / 100 - 150) < 20
        else:
            assert sum(h["values"]) / 100 > 170


def rows_through_the_last_shuffle(df):
    df.collect()
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop(0)
        if node.nodeName() == "Exchange":
            return node.metrics().apply("shuffleRecordsWritten").value()
        within = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan"}.get(node.nodeName())
        children = node.children()
        nodes += [getattr(node, within)()] if within else [children.apply(i) for i in range(children.size())]


@pytest.mark.parametrize("size, passed", ((1000, 8 * 1000), (1024, 4 * 1024)))
def test_few_rows_of_a_key_reach_the_last_window(spark, monkeypatch, size, passed):
    monkeypatch.setattr(histogram, "BALANCED", 4 * 4 * 1024, raising=False)
    tags = F.create_map(F.lit("t"), (F.col("id") % 2).cast("string")).alias("k")
    rows = spark.range(0, 40_000, 1, 8).select(tags, F.col("id").alias("seq"), F.col("id").alias("value"))
    chosen = histogram.Uniform(size, seed=3).choose(rows, ["k"])
    drawn = sorted(range(40_000), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    want = [sorted([i for i in drawn if i % 2 == k][:size]) for k in (0, 1)]
    assert [sorted(r["seq"] for r in chosen.collect() if r["k"]["t"] == k) for k in "01"] == want
    assert chosen.columns == rows.columns and rows_through_the_last_shuffle(chosen) == 2 * passed
    last = histogram.LastN(size, order=("seq", "value")).choose(rows, ["k"])
    assert {r["seq"] for r in last.collect()} == set(range(40_000 - 2 * size, 40_000))
    ties = histogram.Uniform(size).choose(rows.withColumn("seq", F.lit(None).cast("long")), ["k"])
    assert ties.groupBy(F.col("k")["t"]).count().select("count").distinct().first()["count"] == size


def test_timer(spark):
    rows = marks(spark, [(1, 1000), (2, 10), (3, 20), (4, 40), (5, 80), (6, 0)])
    t = histogram.timer(rows, [10], 1, 6, histogram.LastN(4), ["k"]).first()
    want = {0.1: 10, 0.2: 10, 0.4: 20, 0.6: 40, 0.8: 80, 1.0: 80}
    assert t["count"] == 5 and sum(t["values"]) / 4 == 37.5
    got = spark.createDataFrame([(t["values"],)], "v array<double>").select(*(stats.quantile(F.col("v"), q).alias(str(q)) for q in want)).first()
    assert {q: got[str(q)] for q in want} == want
    failed = marks(spark, [(1, 5), (2, 7)])
    only = histogram.timer(failed, [10], 1, 6, histogram.LastN(4), ["k"], failed=F.col("value") == 7).first()
    both = histogram.timer(failed, [10], 1, 6, histogram.LastN(4), ["k"], failed=F.col("value") == 7, include_failed=True).first()
    assert (only["count"], both["count"]) == (1, 2)


def test_merges(spark):
    rows = [("h", {"t": str(k)}, i, i, float(i * k)) for k in (10, 42, 97) for i in range(1, 101)]
    ev = spark.createDataFrame([([a], *r) for a, *r in rows], "path array<string>, tags map<string,string>, ts long, seq long, value double")
    each = histogram.histogram(ev, histogram.LastN(100))
    up = rollup.histograms(each).select("count", stats.quantile(F.col("values"), 0.5).alias("p")).first()
    assert up["count"] == 300 and up["p"] == 1491
    meters = spark.createDataFrame([(["m"], float(v), {50: float(v)}) for v in (1000, 8000, 18000)], "path array<string>, mean double, rates map<long,double>")
    m = rollup.meters(meters).first()
    assert m["mean"] == 9000 and m["rates"] == {50: 9000} and m["samples"] == 3
    z = spark.range(1).select(rollup.zigzag(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(2.0), F.lit(6.0))).alias("z")).first()["z"]
    assert z == [2.0, 5.0, 6.0]


def test_quantiles_at_the_edges(spark):
    df = spark.createDataFrame([([],), ([4.0],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(stats.quantile(F.col("v"), 0.5)).collect()] == [0, 4, 1.5]
    assert [r[0] for r in df.select(F.size(stats.sample(F.col("v"), 9))).collect()] == [0, 0, 0]
    assert [r[0] for r in df.select(stats.mean(F.col("v"))).collect()] == [0, 4, 1.5]
    assert df.select(stats.least(F.col("v"), True)).first()[0] == float(stats.EMPTY_MIN)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_quantile_rises_with_q(spark, xs):
    df = spark.createDataFrame([(sorted(xs),)], "v array<double>")
    got = [q["value"] for q in df.select(stats.quantiles(F.col("v"), (0.1, 0.3, 0.5, 0.7, 1.0))).first()[0]]
    assert all(a <= b + 1e-6 for a, b in zip(got, got[1:])) and got[-1] == max(xs)


def test_values(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert v(values.divide(F.lit(5), F.lit(0))) == 0 and v(values.divide(F.lit(5), F.lit(2))) == 2.5
    assert v(values.int_divide(F.lit(-5), F.lit(2))) == -2 and v(values.int_divide(F.lit(5), F.lit(0))) == 0
    assert v(values.to_whole(F.lit(2.5))) == 3 and v(values.to_whole(F.lit(-2.5))) == -3
    assert v(values.parse_whole(F.lit("12.6"))) == 13 and v(values.parse_whole(F.lit("x"))) == 0
    assert math.isnan(v(values.parse_float(F.lit("x"))))
    assert v(values.add(F.lit(1 << 62), F.lit(1 << 62))) is None
    assert v(values.negate_text(F.lit("12"))) == "-12" and v(values.negate_text(F.lit("-3"))) == "3" and v(values.negate_text(F.lit("ab"))) == "ab"
    assert v(values.show(F.lit(1.5))) == "1.500000" and v(values.invert(F.lit(5))) == -6
    p = values.Period.of(90, "min")
    assert p // values.Period.of(1, "hr") == 1 and (p + p).us == (p * 2).us and p - p == values.Period(0)
    assert [v(paths.window_label(F.lit(us))) for us in (1, 2_000, 3_000_000, 90_000_000, 5_400_000_000)] == ["1usec", "2msec", "3sec", "1min", "1hr"]
    assert v(paths.type_name(F.lit("a::b::counter<a::c<long>>"))) == "counter" and v(paths.type_name(F.lit(None).cast("string"))) == ""


def test_registry(spark):
    r = registry.MetricsRegistry(spark, {"env": "test"})
    r.counter(["my", "", "counter"], {"a": 1})
    r.counter(["my", "counter"], {"a": 1})
    r.counter(["my", "counter"])
    with pytest.raises(registry.MetricTypeMismatch):
        r.counter(["my", "counter"], value_type="short")
    r.meter("m", [50, 8, 8])
    r.meter("m", [8, 50])
    assert r.has_metric(["my", "counter"]) and not r.has_metric("x")
    assert r.definitions().where("kind = 'counter'").count() == 2
    assert not r.set_options(registry.PublishOptions(), ["x"]) and r.set_options(registry.PublishOptions(scale=2.0), ["m"])
    assert r.publisher_data("p", lambda: [1]) == [1] and r.publisher_data("p", lambda: [2]) == [1]
    assert r.publisher_data("p", dict, ["x"]) is None and r.has_publisher_data("p")
    with pytest.raises(registry.MetricTypeMismatch):
        registry.check_types(spark.createDataFrame([("a", "counter"), ("a", "meter")], "path string, kind string"))


def test_options_replace_as_a_whole(spark):
    table = registry.options_table(spark, registry.PublishOptions(scale=0.5, quantiles=(0.9,)), {("a",): registry.PublishOptions(include_count=False)})
    got = {r["path"][0]: r for r in registry.effective_options(spark.createDataFrame([(["a"],), (["b"],)], "path array<string>"), table).collect()}
    assert got["a"]["scale"] is None and not got["a"]["include_count"] and got["a"]["quantiles"] == [0.5, 0.9, 0.99]
    assert got["b"]["scale"] == 0.5 and got["b"]["quantiles"] == [0.9]


def text(df):
    return [r["line"] for r in df.orderBy("path", "line_no", "tag_text").collect()]


EVENTS = "path array<string>, tags map<string,string>, ts long, seq long, value double"


def test_registry_snapshots(spark):
    r = registry.MetricsRegistry(spark, {"env": "test"})
    r.counter(["c"], {"a": 1}, initial=15)
    r.counter(["c"], {"a": 1}, initial=99)  # the first one's value holds
    r.counter(["c"], {"a": 2}, initial=7)
    r.meter("m", [10, 5], 1)
    r.histogram("h", "sliding", 3, 100)
    r.timer("t", [10], 1, "last", 4)
    r.gauge("g")
    r.ewma("e", 10, 1)
    r.functional_gauge("f", lambda: 4.5)
    table = spark.createDataFrame([(923.005,)], "v double")
    r.referential_gauge("r", table, F.col("v"), {"x": 1})
    rows = [("c", 1, 5.0), ("c", 2, -2.0), ("t", 3, 10.0), ("t", 4, 0.0), ("zzz", 5, 1.0)]
    e = spark.createDataFrame([([p], {"a": "1"} if p == "c" else {}, t, t, v) for p, t, v in rows], EVENTS)
    s = r.snapshots(e, 10)
    got = {(x["path"][0], x["tags"].get("a")): x["value"] for x in s["counter"].collect()}
    assert got == {("c", "1"): 18, ("c", "2"): 7} and s["counter"].schema["value"].dataType.typeName() == "long"
    assert {x["tags"]["env"] for x in s["counter"].collect()} == {"test"}
    assert s["meter"].first()["rates"] == {5: 0.0, 10: 0.0} and s["histogram"].first()["count"] == 0
    assert s["timer"].first()["values"] == [10.0] and s["timer"].first()["count"] == 1
    assert {x["path"][0]: x["value"] for x in s["gauge"].collect()} == {"g": 0, "f": 4.5, "r": 923.005}
    assert s["ewma"].first()["value"] == 0
    up = r.aggregates(s)
    assert up["counter"].first()["value"] == 25 and up["gauge"].count() == 3
    two = table.unionByName(table)
    r.referential_gauge("r2", two, F.col("v"))
    with pytest.raises(Exception, match="(?i)more than one row|SCALAR_SUBQUERY"):
        r.snapshots(e, 10)["gauge"].collect()


def test_aliases_of_the_registry(spark):
    r = registry.MetricsRegistry(spark)
    r.counter("c", {"a": 1})
    r.meter("m", [5])
    assert not r.register_existing("x", "nothing") and not r.register_existing("x", "c", {"a": 2})
    assert r.register_existing("c", "c", {"a": 1}, {"b": 1}) and not r.register_existing("c", "c", {"a": 1}, {"b": 1})
    assert not r.register_existing("c", "c", {"a": 1}, {"a": 1})
    with pytest.raises(registry.MetricTypeMismatch):
        r.register_existing("m", "c", {"a": 1})
    e = spark.createDataFrame([(["c"], {"a": "1"}, 1, 1, 4.0)], EVENTS)
    assert sorted(x["value"] for x in r.snapshots(e, 5)["counter"].collect()) == [4, 4]
    seen = []
    r.visit(lambda p, d: seen.append(d.kind))
    r.visit(lambda p, d: seen.append(p), "m")
    r.visit(lambda p, d: seen.append(p), "nothing")
    assert seen == ["counter", "meter", ("m",)]


def test_alias_of_another_kind(spark):
    s = spark.createDataFrame([(["a"], {}, "counter"), (["b"], {}, "meter")], "path array<string>, tags map<string,string>, kind string")
    with pytest.raises(Exception, match="is a meter"):
        registry.register_existing(s, F.col("path")[0] == "a", ["b"], {"x": "y"}).collect()


def test_pull_sources(spark):
    keys = spark.createDataFrame([(["a"],)], "path array<string>")
    told = iter((1.0, 2.0))
    assert [events.pulled(keys, lambda: next(told)).first()["value"] for _ in range(2)] == [1.0, 2.0]
    none = spark.createDataFrame([], "v double")
    assert events.pulled(keys, (none, F.col("v"))).first()["value"] is None


def test_exact_quantiles_equal_those_of_an_array(spark):
    rows = [("a", float(i % 7)) for i in range(40)] + [("b", 3.0)] + [("c", 1.0), ("c", 2.0)]
    df = spark.createDataFrame(rows, "k string, value double")
    qs = (0.0, 0.1, 0.5, 0.77, 0.99, 1.0)
    arrays = histogram.sorted_values(df, ["k"])
    want = {r["k"]: [x["value"] for x in r["q"]] for r in arrays.select("k", stats.quantiles(F.col("values"), qs).alias("q")).collect()}
    got = stats.exact(df, ["k"], qs=qs).collect()
    for r in got:
        assert [x["value"] for x in r["quantiles"]] == pytest.approx(want[r["k"]])
    assert {r["k"]: (r["count"], r["least"], r["greatest"]) for r in got}["a"] == (40, 0, 6)


def test_merged_histograms_are_bounded(spark):
    rows = [(["h"], {"t": str(k)}, [float(k * 100 + i) for i in range(50)], 50 * (1 + 9 * (k == 0))) for k in range(20)]
    h = spark.createDataFrame(rows, "path array<string>, tags map<string,string>, values array<double>, count long")
    whole, few = rollup.histograms(h).first(), rollup.histograms(h, most=200).first()
    assert len(whole["values"]) == 1000 and len(few["values"]) == 200 and few["count"] == whole["count"]
    assert sum(v < 100 for v in few["values"]) > 25  # ten times the weight; a tenth of them without it


def test_merged_timers(spark):
    rows = [(["t"], {"k": "1"}, [1.0, 3.0], 2, 4.0, {5: 1.0}), (["t"], {"k": "2"}, [2.0], 1, 2.0, {5: 3.0})]
    schema = "path array<string>, tags map<string,string>, values array<double>, count long, mean double, rates map<long,double>"
    t = rollup.timers(spark.createDataFrame(rows, schema)).first()
    assert (t["values"], t["count"], t["mean"], t["samples"], t["rates"]) == ([1, 2, 3], 3, 3, 2, {5: 2})


def test_typed_values(spark):
    t, v = values.Typed, lambda x: spark.range(1).select(x.column.alias("x")).first()["x"]
    a, b = t(F.lit(7), "int"), t(F.lit(2.5), "double")
    assert v(a + b) == v(b + a) == 9.5 and v(a - b) == 4.5 and v(a * b) == 17.5 and v(a / b) == 2.8 and v(b / a) == 2.5 / 7
    s, n = t(F.lit("12"), "string"), t(F.lit("x"), "string")
    assert v(s + s) == "1212" and v(a + s) == 19 and v(s + a) == 19 and v(a + n) == 7 and math.isnan(v(b + n)) and v(s * s) == "12"
    assert v(s - s) == "12-12" and v(-s) == "-12" and v(a / t(F.lit(0), "int")) == 0
    tie = t(F.lit(3), "long") + t(F.lit(2.6).cast("float"), "float")  # of equal scores the left one decides
    assert tie.kind == "long" and v(tie) == 6
    assert (t(F.lit(5), "duration") + a).kind == "duration" and (t(F.lit(5), "duration") + b).kind == "double"


def test_dispatch(spark):
    t = spark.createDataFrame([("k", [1.0], 1, 2.0, {5: 3.0})], "k string, values array<double>, count long, mean double, rates map<long,double>")
    got = basic.dispatch({"timer": t, "counter": t}, {"meter": lambda d: d.columns, "histogram": lambda d: d.columns}, ["k"])
    assert got == [["k", "values", "count"], ["k", "mean", "rates"]]
    assert basic.dispatch({"timer": t}, {"timer": lambda d: "whole", "value": lambda d: "half"}, ["k"]) == ["whole"]
    assert basic.dispatch({"timer": t}, {"value": lambda d: d.first()["value"]}, ["k"]) == [2.0]
    assert basic.dispatch({"histogram": t}, {"value": len}, ["k"]) == []


def test_nested_type_names(spark):
    names = {"ns<int>::counter<long>": "counter", "a::b<c::d<e>>::f": "f", "x": "x", "": "", "a::b<": "b", "g<h::i, j<k>>": "g"}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", paths.type_name(F.col("t")).alias("n")).collect()} == names


def test_exposition(spark, tmp_path):
    opts = registry.options_table(spark)
    c = spark.createDataFrame([(['1MyCounter%#@#(@#:]["', "COUNTER"], {"tag_name2^$": 'tag_value"with quotes"', "x2": "123523"}, 1200100), ([], {}, 1)], "path array<string>, tags map<string,string>, value long")
    assert text(exposition.lines(c, opts, "counter", "long")) == ["# TYPE _1MyCounter___________:COUNTER untyped", '_1MyCounter___________:COUNTER{tag_name2__="tag_value\\"with quotes\\"",x2="123523"} 1200100']
    g = spark.createDataFrame([(["MyGauge", "value"], {}, 923.005)], "path array<string>, tags map<string,string>, value double")
    assert text(exposition.lines(g, opts, "gauge")) == ["# TYPE MyGauge:value gauge", "MyGauge:value{} 923.005000"]
    m = spark.createDataFrame([(["M"], {"a": "b"}, 2.0, {60_000_000: 1.0, 1_000_000: 3.0})], "path array<string>, tags map<string,string>, mean double, rates map<long,double>")
    assert text(exposition.lines(m, opts, "meter")) == ["# TYPE M gauge", 'M{window="mean",a="b"} 2.000000', 'M{window="1sec",a="b"} 3.000000', 'M{window="1min",a="b"} 1.000000']
    t = spark.createDataFrame([(["T"], {}, [10.0, 20.0, 40.0, 80.0], 5, 1.0, {10_000_000: 1.0})], "path array<string>, tags map<string,string>, values array<double>, count long, mean double, rates map<long,double>")
    lines = text(exposition.lines(t, opts, "timer"))
    assert lines[:5] == ["# HELP T T in microseconds", "# TYPE T summary", "T_count{} 5", "T_mean{} 37", 'T{quantile="0.5"} 30']
    assert lines[-1] == 'T:rates{window="10sec"} 1.000000'
    few = registry.options_table(spark, registry.PublishOptions(include_count=False, include_rates=False, quantiles=(1.0,), scale=2.0))
    assert text(exposition.lines(t, few, "timer"))[2:] == ["T_mean{} 74.000000", 'T{quantile="1"} 160.000000']
    exposition.TextPublisher(opts).write({"counter": c, "gauge": g}, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_alias(spark):
    s = spark.createDataFrame([(["a"], {}, 1), (["b"], {}, 2)], "path array<string>, tags map<string,string>, value long")
    assert registry.register_existing(s, F.col("path")[0] == "a", ["c"], {"x": "y"}).count() == 3
    assert registry.register_existing(s, F.col("path")[0] == "a", ["b"]).count() == 2
    assert basic.has_metric(s, ["a"]) and not basic.has_metric(s, ["z"])
