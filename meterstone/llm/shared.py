"""Helpers that several operators of this subpackage share: shared storage, column names, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Edges of a node from which on its rows are joined without a shuffle, at least.
HEAVY = 1000
#: Such nodes at most: their minima are broadcast, some 24 bytes each.
MOST_HEAVY = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that is unset and Spark runs inside this one process (tests), a temporary folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meterstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meterstone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage and survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._meterstone_path = path
    return again


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote; for tables that nothing reads any more."""
    path = getattr(df, "_meterstone_path", None)
    if path:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any] = dict) -> Any:
    """What make() gives, made once by a worker and kept until it is asked for another key.

    Python workers live on from stage to stage. What the stage before had is let go first and its memory is given back to
    the system, so the indexes and memories of stages that follow each other don't add up.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)
        _kept[key] = make()
    return _kept[key]


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        n, tried = 0, name
        while tried.lower() in taken:
            n += 1
            tried = f"{name}_{n}"
        taken.add(tried.lower())
        out.append(tried)
    return out


def mapped(df: DataFrame, run: Callable, *more: StructField) -> DataFrame:
    """df.mapInArrow(run) with df's columns and further ones, whatever the names; run sees the columns in their order."""
    plain = [StructField(f"c{n}", f.dataType) for n, f in enumerate(df.schema.fields)]
    out = df.toDF(*(f.name for f in plain)).mapInArrow(run, StructType([*plain, *more]))
    return out.toDF(*df.columns, *(f.name for f in more))


def without(df: DataFrame, lost: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of df, with its columns as they are, whose keys lost does not hold; nulls are equal to each other.

    keys: a column of lost -> what df has for it. What is lost grows with df, so it is never broadcast: at every size both
    sides are shuffled by the keys, which together differ from row to row, so no group of copies lands in one task.
    """
    own, theirs = fresh(df, *(f"own_{k}" for k in keys)), fresh(df, *(f"lost_{k}" for k in keys))
    wide = df.select("*", *(c.alias(n) for n, c in zip(own, keys.values())))
    renamed = lost.select(*(F.col(k).alias(n) for k, n in zip(keys, theirs)))
    same = F.lit(True)
    for a, b in zip(own, theirs):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return wide.join(renamed.hint("merge"), same, "left_anti").select(*(column(c) for c in df.columns))


def _with_minimum(rows: DataFrame, node: str, least: DataFrame, edges: int) -> DataFrame:
    """rows with m, the minimum of their node; least is (node, m, degree).

    The minima of nodes with very many edges, of which there are at most MOST_HEAVY, are broadcast: their rows need no
    shuffle, so no task gets all rows of a hub. The rows of the other nodes are joined by a shuffle.
    """
    bound = max(HEAVY, 2 * edges // MOST_HEAVY)
    heavy = least.where(F.col("degree") > bound).select(node, F.col("m").alias("heavy_m"))
    tagged = rows.join(F.broadcast(heavy), node, "left")
    light = tagged.where("heavy_m IS NULL").drop("heavy_m").join(least.select(node, "m"), node)
    return light.unionByName(tagged.where("heavy_m IS NOT NULL").withColumnRenamed("heavy_m", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges stay as they are. Every step is a pre-aggregated
    minimum by node and a join with it; nothing reaches the driver but a count and a checksum.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    degree = F.count("*").alias("degree")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), degree).select("u", F.least("u", "m").alias("m"), "degree")
        large = _with_minimum(both.where("v > u"), "u", least, 2 * seen[0])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), degree)
        small = _with_minimum(large, "u", lowest, 2 * seen[0])
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark_new = mark(new)
        forget(now)
        now = new
        if mark_new == seen:
            break
        seen = mark_new
    leaves = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
