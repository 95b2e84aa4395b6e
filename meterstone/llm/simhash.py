"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most one bit of some of three segments. For each
segment and each of its bits, the segment with that bit left out is a signature; such a pair shares one. Fingerprints
with equal signatures meet by an equal-key shuffle, are compared whole, and linked into components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, components, kept, without, written

WORDS = 4
SEED = 42
BITS = 4
#: Shingles whose bits are counted at once: bounds the memory of a task.
AT_ONCE = 1 << 20


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of every run of `words` words (split at ASCII white space, A-Z lower-cased); all of them if there are fewer."""
    split = text.lower().split()
    if not split:
        return []
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    if len(split) <= words:
        return [digest(joined, seed)]
    size = np.fromiter(map(len, split), np.int64, len(split)) + 1
    stop = np.cumsum(size)
    begin = stop - size
    spans = zip(begin[: len(split) - words + 1].tolist(), (stop[words - 1 :] - 1).tolist())
    return [digest(joined[s:e], seed) for s, e in spans]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprints of documents that have counts[i] consecutive hashes each: a bit is 1 if set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        begin = (np.cumsum(counts) - counts)[some]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), begin).astype(np.int64)
            out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long, 0 for texts without words and nulls."""

    def run(batches):
        kept("simhash")  # nothing of the stage before
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            hashes, counts, held, out = [], [], 0, []
            for t in texts:
                h = shingle_hashes((t.as_py() or "").encode())
                hashes.append(np.array(h, np.uint64))
                counts.append(len(h))
                held += len(h)
                if held > AT_ONCE:
                    out.append(majority(np.concatenate(hashes), np.array(counts)))
                    hashes, counts, held = [], [], 0
            if counts:
                out.append(majority(np.concatenate(hashes), np.array(counts)))
            fp = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp)], ["doc_id", "fp"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string")).mapInArrow(run, "doc_id long, fp long")


def segments(bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, end) of the fewest segments so that of pairs that differ in `bits` bits, one differs by at most one."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def signatures(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(sig, fp): 64 rows for each distinct fingerprint."""
    masks = []
    for begin, end in segments(bits):
        whole = ((1 << (end - begin)) - 1) << begin
        masks += [whole & ~(1 << i) for i in range(begin, end)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = F.posexplode(F.array(*(F.lit(m) for m in signed)))
    rows = fps.select("fp", each.alias("n", "mask"))
    return rows.select(F.xxhash64("n", F.col("fp").bitwiseAND(F.col("mask"))).alias("sig"), "fp")


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most `bits` bits connect among fps: a search that visits each once, keeping only
    what it has not reached; a dense group is gone after a few steps."""
    rest, a, b = np.unique(fps), [], []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        root = front[0]
        while front and len(rest):
            near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= bits
            if near.any():
                reached, rest = rest[near], rest[~near]
                a.append(reached)
                b.append(np.full(len(reached), root))
                front += reached.tolist()
                front = [np.int64(x) for x in front]
    return (np.concatenate(a), np.concatenate(b)) if a else (rest[:0], rest[:0])


def links(sigs: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct edges (a, b), a > b, that connect every linked pair of fingerprints. Rows of a signature come together."""

    def pairs(sig: np.ndarray, fp: np.ndarray):
        """Of whole signature groups, in order."""
        cut = np.flatnonzero(np.diff(sig)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(sig)]])
        size = end - begin
        left = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = [left[0]], [left[1]]
        few = np.repeat(size <= 8, size)
        for step in range(1, 8):
            one, two = fp[:-step], fp[step:]
            near = (sig[:-step] == sig[step:]) & few[step:] & (one != two)
            near &= np.bitwise_count((one ^ two).view(np.uint64)) <= bits
            a.append(np.maximum(one[near], two[near]))
            b.append(np.minimum(one[near], two[near]))
        for i in np.flatnonzero(size > 8):
            x, y = _forest(fp[begin[i] : end[i]], bits)
            a.append(np.maximum(x, y))
            b.append(np.minimum(x, y))
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and sig[-1] == held[0][0][-1]:  # still the same one
                held.append((sig, fp))
                continue
            sig, fp = np.concatenate([*(x for x, _ in held), sig]), np.concatenate([*(x for _, x in held), fp])
            last = int(np.searchsorted(sig, sig[-1]))
            if last:
                yield pairs(sig[:last], fp[:last])
            held = [(sig[last:], fp[last:])]
        if held:
            yield pairs(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable).

    Documents of one fingerprint are one component; null and empty texts have fingerprint zero and are linked like any
    other. A component whose ids are all null has a null component_id. Repeated rows each keep a row; an empty table gives
    no rows; other columns of docs are not read.
    """
    rows = written(fingerprints(docs, text, id_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(signatures(distinct, bits), bits)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", fingerprint, "component_id")


def without_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns, whatever their names.

    Rows without an id can't be dropped by it and stay; of repeated rows of one id all stay or none. Null and empty texts
    have fingerprint zero, so one id of all those stays. An empty table gives no rows. The dropped ids are taken out of
    docs by one shuffle of the texts, at every size.
    """
    known = near_duplicates(docs.where(column(id_col).isNotNull()), text, id_col, bits)
    dropped = written(known.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    return without(docs, dropped, {"doc_id": column(id_col).cast("long")})
