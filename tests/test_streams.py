"""Streams over several batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from meterstone.functions import stats
from meterstone.operators import basic, ewma, histogram
from meterstone.streaming import live

HOUR, DAY = 3_600_000_000, 86_400_000_000


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events dealt to four files by time, and a stream that takes one file a batch."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = e.select("event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), "value")
    for n, part in enumerate(rows.repartitionByRange(4, "ts").withColumn("n", F.spark_partition_id()).select("n").distinct().orderBy("n").collect()):
        one = rows.repartitionByRange(4, "ts").where(F.spark_partition_id() == part["n"])
        one.coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.read.parquet(path), stream


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_counters_and_gauges(spark, events):
    batch, stream = events
    got = live.run_to_end(live.counters(stream(), ["event_type"]), "t_counters", "complete")
    want = batch.groupBy("event_type").agg(F.sum("value").alias("value"), F.count("*").alias("count"))
    assert [(a, round(b, 6), c) for a, b, c in rows_of(got)] == [(a, round(b, 6), c) for a, b, c in rows_of(want)]
    got = live.run_to_end(live.gauges(stream(), ["event_type"]), "t_gauges", "complete")
    assert rows_of(got) == rows_of(basic.gauge(batch, ["event_type"]))


def test_meters(spark, events):
    batch, stream = events
    out = live.run_to_end(live.meters(stream(), "event_type", [DAY, HOUR], HOUR), "t_meters", "update")
    newest = {(r["key"], r["window_us"]): r for r in out.orderBy("last").collect()}
    for r in batch.groupBy("event_type").agg(F.max("ts").alias("asof"), F.sum("value").alias("total")).collect():
        own = batch.where(F.col("event_type") == r["event_type"])
        want = ewma.meter(own, [DAY, HOUR], HOUR, r["asof"], ["event_type"]).first()
        for w in (DAY, HOUR):
            got = newest[r["event_type"], w]
            assert got["rate"] == pytest.approx(want["rates"][w]) and got["mean"] == pytest.approx(want["mean"]) and got["total"] == pytest.approx(r["total"])


def test_state_does_not_depend_on_batch_cuts(spark, tmp_path):
    """The same arrivals, some of them late, in one batch and in five."""
    rows = [("k", t * HOUR, n, 1.0) for n, t in enumerate((1, 2, 5, 3, 5, 6, 4, 9, 8, 9, 12))]
    df = spark.createDataFrame(rows, "key string, ts long, seq long, value double")
    want = None
    for n, cuts in enumerate(([11], [2, 4, 6, 9, 11])):
        path = str(tmp_path / str(n))
        for a, b in zip([0, *cuts], cuts):
            df.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(path)
        read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)  # noqa: B023, E731
        m = live.run_to_end(live.meters(read(), "key", [DAY], HOUR), f"t_cut_m{n}", "update").orderBy(F.desc("seq")).first()
        e = live.run_to_end(live.ewmas(read(), "key", DAY, HOUR, 0), f"t_cut_e{n}", "update").orderBy(F.desc("seq")).first()
        got = m["rate"], m["total"], m["mean"], e["value"]
        assert m["total"] == 8  # three came too late
        assert want is None or got == pytest.approx(want)
        want = got
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_state_may_expire(spark, events):
    """Such a stream goes on until it is stopped."""
    with live.rocks(spark):
        df = live.meters(events[1](), "event_type", [DAY], HOUR, idle_ms=3_600_000)
        q = df.writeStream.format("memory").queryName("t_idle").outputMode("update").start()
        q.awaitTermination(20)
    q.stop()
    assert spark.table("t_idle").count() > 0


def test_histograms(spark, events):
    batch, stream = events
    out = live.run_to_end(live.histograms(stream(), "event_type", 20), "t_histograms", "update")
    got = {}
    for r in out.collect():
        got[r["key"]] = max(got.get(r["key"], (0, [])), (r["count"], r["values"]))
    want = {r["event_type"]: (r["count"], r["values"]) for r in histogram.histogram(batch, histogram.LastN(20), ["event_type"]).collect()}
    assert got == want


def test_spans(spark, events):
    batch, stream = events
    what = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "end").otherwise("other")
    got = live.run_to_end(live.spans(stream().withColumn("what", what), "user_id"), "t_spans", "append")
    want = basic.span_durations(batch, ["user_id"], "ts", ["ts", "seq"], F.col("event_type") == "click", F.col("event_type") == "view")
    assert rows_of(got) == rows_of(want.select(F.col("user_id").cast("string"), "start", "duration"))
    assert got.count() > 0


def test_publish_each_batch(spark, events, tmp_path):
    seen = []
    q = live.publish_each(live.counters(events[1](), ["event_type"]), lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"))
    q.awaitTermination()
    assert len(seen) >= 4


def test_small_helpers(spark):
    assert stats.percent(99) == 0.99
    with pytest.raises(ValueError):
        stats.percent(101)
    t = spark.createDataFrame([("k", [1.0], 1, 2.0, {5: 3.0})], "k string, values array<double>, count long, mean double, rates map<long,double>")
    h, m = basic.split_timers(t, ["k"])
    assert h.columns == ["k", "values", "count"] and m.columns == ["k", "mean", "rates"]
