"""Exact deduplication against a minimal perfect hash of the distinct digests seen before.

Digests are dealt to shards by their leading bits. In each shard a cascade of bit arrays (each level keeps the digests
that land alone, the others go on to the next level) ranks every digest to its own slot, without gaps. A slot holds the
full digest and the winner of its group. A lookup ranks a digest, compares all its bytes with those in the slot and so
tells members from strangers without error. Strangers are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, fresh, without, written

#: Digests in a shard, on average: bounds what a task holds at once to a few MB.
SHARD_DIGESTS = 4096
#: Bits of each level per digest that reaches it.
GAMMA = 2.0


def normalised(text: Column) -> Column:
    """The text without the six white-space characters of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _positions(digests: np.ndarray, level: int, bits: int) -> np.ndarray:
    """A place in the level's bit array for each digest (n, 32) of bytes; another function for each level."""
    words = digests.view("<u8").reshape(len(digests), 4)
    x = words[:, 1] + words[:, 2] * np.uint64(2 * level + 1) + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, by in ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB))):
        x = (x ^ (x >> shift)) * by
    return ((x ^ (x >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Minimal and perfect over the digests it was built from: rank() gives each its own slot from 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        levels, rest = [], digests
        while len(rest):
            bits = max(64, int(len(rest) * GAMMA))
            at = _positions(rest, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def rank(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for those that no level holds, which are strangers for certain."""
        slot, rest = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for n, level in enumerate(self.levels):
            if not len(rest):
                break
            at = _positions(digests[rest], n, len(level))
            hit = level[at]
            slot[rest[hit]] = self.before[n] + self.ranks[n][at[hit]]
            rest = rest[~hit]
        return slot

    def packed(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpacked(cls, sizes: list[int], data: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            size = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool))
            at += size
        return cls(levels)


INDEX = (
    "shard long, sizes array<int>, bits binary, digests binary, keep_id array<long>, keep_chars array<long>, "
    "members array<long>"
)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_chars, members) of (digest, doc_id, chars): most code points, then smallest doc_id, nulls
    last."""
    best = F.max(F.struct(F.col("chars"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("back")))
    some = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("members"))
    keep = (-F.col("best.back")).alias("keep_id"), F.col("best.chars").alias("keep_chars")
    return some.select("digest", *keep, "members")


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long"), F.lit(shards))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the hash function, and its slots with full digests and winners."""

    def build(rows: pa.Table) -> pa.Table:
        digests = _matrix(rows["digest"].combine_chunks()) if len(rows) else np.zeros((0, 32), np.uint8)
        hash_ = PerfectHash.build(digests)
        order = np.argsort(hash_.rank(digests))
        sizes, bits = hash_.packed()
        take = rows.take(pa.array(order))
        lists = {k: [take[k].to_pylist()] for k in ("keep_id", "keep_chars", "members")}
        return pa.table({
            "shard": [rows["shard"][0].as_py()], "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "bits": pa.array([bits], pa.binary()), "digests": pa.array([digests[order].tobytes()], pa.binary()),
            **{k: pa.array(v, pa.list_(pa.int64())) for k, v in lists.items()},
        })

    sharded = winners(history).withColumn("shard", _shard(F.col("digest"), shards))
    return sharded.groupBy("shard").applyInArrow(build, INDEX)


GROUPS = "digest binary, keep_id long, members long, origin string"


def look_up(candidates: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The groups of the candidates (digest, keep_id, keep_chars, members; one row a digest) and of the index.

    origin: `both` where a slot's bytes equal a candidate's (the better winner stays, members add up), `new` for
    strangers, `old` for slots that no candidate asked for.
    """

    def rank(chars, doc_id):
        return chars, doc_id is not None, -(doc_id or 0)

    def find(rows: pa.Table, shard: pa.Table) -> pa.Table:
        n, held, one = len(rows), np.zeros((0, 32), np.uint8), {}
        wanted = _matrix(rows["digest"].combine_chunks()) if n else np.zeros((0, 32), np.uint8)
        slots = np.full(n, -1, np.int64)
        if len(shard):
            one = {k: shard[k][0].as_py() for k in shard.column_names}
            held = np.frombuffer(one["digests"], np.uint8).reshape(-1, 32)
            slots = PerfectHash.unpacked(one["sizes"], one["bits"]).rank(wanted)
            slots[slots >= 0] = np.where((held[slots[slots >= 0]] == wanted[slots >= 0]).all(1), slots[slots >= 0], -1)
        keep, members, chars = (rows[k].to_pylist() for k in ("keep_id", "members", "keep_chars"))
        asked = slots[slots >= 0]
        for i, s in zip(np.flatnonzero(slots >= 0).tolist(), asked.tolist()):
            members[i] += one["members"][s]
            if rank(one["keep_chars"][s], one["keep_id"][s]) > rank(chars[i], keep[i]):
                keep[i] = one["keep_id"][s]
        left = np.setdiff1d(np.arange(len(held)), asked)
        left_digests = pa.array([x.tobytes() for x in held[left]], pa.binary())
        digests = pa.chunked_array([*rows["digest"].chunks, left_digests], pa.binary())
        origin = np.where(slots >= 0, "both", "new").tolist() + ["old"] * len(left)
        old = {k: [one[k][s] for s in left.tolist()] for k in ("keep_id", "members")} if len(left) else {}
        return pa.table({
            "digest": digests, "keep_id": pa.array(keep + old.get("keep_id", []), pa.int64()),
            "members": pa.array(members + old.get("members", []), pa.int64()), "origin": pa.array(origin, pa.string()),
        })

    dealt = candidates.withColumn("shard", _shard(F.col("digest"), shards))
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(find, GROUPS)


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The lower half of the id range is the history that the perfect hash is built over; the upper half (and null ids) is
    looked up in it. Groups that span both take the better winner of the two; digests the history does not hold are
    grouped among themselves. Texts are equal without their white space; the one with the most code points stays, then
    the smallest doc_id. Nulls count as empty texts, repeated rows of one id as members of the group (all of them are
    kept if that id is the winner); a group whose ids are all null has keep_id null and kept true for all. An empty table
    gives no rows; other columns of docs are not read.
    """
    joined = _grouped(docs, text, id_col)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return joined.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(normalised(column(text)), 256))


def _groups(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, chars) of every row, and (digest, keep_id, members, origin) of every group of several rows."""
    chars = F.coalesce(F.length(column(text)), F.lit(0)).cast("long").alias("chars")
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), _digest(text).alias("digest"), chars)
    rows = written(rows, "digests")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    shards = max(1, n // SHARD_DIGESTS)
    middle = (low + high) // 2 if low is not None else -1
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    groups = look_up(winners(rows.where(~old)), build_index(rows.where(old), shards), shards).where("members > 1")
    return rows, groups


def _grouped(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    rows, groups = _groups(docs, text, id_col)
    keep = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("members", F.lit(1)).alias("group_size")
    return rows.join(groups, "digest", "left").select("doc_id", keep.alias("keep_id"), size, "digest")


def without_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of docs for each different text, with all its columns, whatever their names: the winner by exact_groups()'s
    rule. Of several rows of the winner's id (or without any id) one stays, whichever.

    Nulls count as empty texts; an empty table gives no rows. The losers' ids and digests are taken out of docs by one shuffle
    of the texts, at every size.
    """
    rows, groups = _groups(docs, text, id_col)
    lost = rows.join(groups, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    lost = written(lost.select("doc_id", "digest").distinct(), "lost-copies")
    kept = without(docs, lost, {"doc_id": column(id_col).cast("long"), "digest": _digest(text)})
    again = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    (own,) = fresh(docs, "own_digest")
    kept = kept.withColumn(own, _digest(text)).dropDuplicates([id_col, own])
    return kept.select(*(column(c) for c in docs.columns))


#: The same in DuckDB's SQL.
EXACT_GROUPS_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
  length(coalesce(text, '')) AS chars FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)"""
