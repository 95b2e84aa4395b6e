"""Substring deduplication: paragraphs and passages that documents share, exactly or nearly.

The pieces of a text are its lines of at least LEAST_WORDS words, the paragraphs that hard-wrapped lines make up, and chunks
of CHUNK words that start at minimizers: words with the least hash of some SPAN consecutive ones. A chunk depends on its own
surroundings only, so documents that share CHUNK + SPAN - 1 = 50 words in a row share a chunk, wherever the passage stands in
its line. Chunks are seeds: each is extended left and right as far as its words equal those around the first occurrence, and
the whole run is the passage. Pieces with the same words are one class (a 96-bit id).

Lines are MinHashed over five-word shingles; the bands are tuned so that lines with a Jaccard similarity of SIMILARITY meet
with a chance of at least RECALL. Lines that meet in a band are verified by the exact Jaccard similarity of their shingles,
and what is linked becomes one class by connected components. Of each class that several documents hold, the first occurrence
stays.

Bands of up to MOST_MEMBERS lines are worked off in one task each. In a larger band, members are compared with a hub, not
with each other, which any number of tasks share; the hub goes, and so do members that matched it, unless the triangle
inequality (1 - similarity is a metric) leaves room for a link between them and a member that did not. What three such
rounds leave of a large band is banded anew by other hashes, at most LEVELS times, so that lines which met by a frequent
shingle part again; then more and more hubs a round do the rest. No member is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of
from .shared import column, components, forget, fresh, written

CHUNK, SPAN = 20, 31
SHINGLE = 5
#: Lines with fewer words have no shingle and are no piece.
LEAST_WORDS = SHINGLE
#: A line goes on in the next one if it and the next word fill so much of the longest line up to a blank one, of at most so
#: many code points.
FILLED, MOST_WIDTH = 0.75, 120
SIMILARITY = 0.8
RECALL = 0.995
#: Bytes of text cut up at once: bounds the memory of a task.
AT_ONCE = 2 << 20
#: Lines that a task remembers, so as to put out their bands once, before it starts afresh.
MOST_SEEN = 1 << 18

#: Members of a band that one task works off by itself, and how often what hubs leave of larger ones is banded anew.
MOST_MEMBERS, LEVELS = 2048, 2

PIECES = "id binary, doc_id long, start long, n_chars long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows a band of which few enough bands reach the recall at the similarity, with at
    most 8 bands; else the fewest hashes."""
    best = None
    for rows in range(1, 9):
        meet, bands = similarity**rows, 1
        while 1 - (1 - meet) ** bands < recall:
            bands += 1
        if bands * rows <= most_hashes and (best is None or bands <= 8):
            best = bands, rows
    return best


def _positional(hashes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    n, back = len(hashes) + 1, pow(base, -1, 1 << 64)

    def powers(b: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))

    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base)[:-1])]), powers(back)


def minimizers(hashes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """The places of the words with the least hash (the first of equal ones) among some SPAN words of one document."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 32) - 1)
    value = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    least, width = value, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
    return np.unique(least[document[:n] == document[SPAN - 1 :]] & low).astype(np.int64)


def ids_of(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """12 bytes for the words from first to last, the same wherever they stand."""
    out = np.zeros(len(first), [("key", ">u8"), ("check", ">u4")])
    for name, base in zip(("key", "check"), _BASES):
        total, back = _positional(words, base)
        x = (total[last] - total[first]) * back[first]
        out[name] = x ^ (x >> np.uint64(32)) if name == "key" else x >> np.uint64(32)
    plain = pa.Array.from_buffers(pa.binary(12), len(out), [None, pa.py_buffer(out.tobytes())])
    return plain.cast(pa.binary())


def band_values(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """The bands of several lines, as (line, band): grams holds their shingles' hashes one line after the other."""
    random = np.random.default_rng([11, seed])
    odd = lambda n: random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    turns, mixes = odd(bands * rows), odd(rows + 1)
    out = np.zeros((len(begin), bands), np.uint64)
    for b in range(bands if len(begin) else 0):
        value = np.full(len(begin), np.uint64(b)) * mixes[rows]
        for r in range(rows):
            x = grams * turns[b * rows + r]
            least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), begin)
            value = (value ^ (least ^ (least >> np.uint64(29)))) * mixes[r]
            value ^= value >> np.uint64(32)
        out[:, b] = value
    return out.view(np.int64)


class Pieces:
    """The lines and chunks of several texts (UTF-8), as arrays; spans are in bytes of the joined data."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        begin, end, self.words = words_of(self.data.lower())
        lines = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
        first, last = np.searchsorted(begin, lines), np.searchsorted(begin, np.append(lines[1:], len(raw) + 1))
        ahead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        block = self._wrapped(lines, first, last, ahead, begin, end)
        first, last = np.concatenate([first, block[0]]), np.concatenate([last, block[1]])
        keep = last - first >= LEAST_WORDS
        document = np.searchsorted(self.offsets, begin, "right") - 1
        chunk = minimizers(self.words, document)
        chunk = chunk[chunk + CHUNK <= len(begin)]
        chunk = chunk[document[chunk] == document[chunk + CHUNK - 1]]
        self.first, self.last = np.concatenate([first[keep], chunk]), np.concatenate([last[keep], chunk + CHUNK])
        self.kind = np.repeat([0, 1], [int(keep.sum()), len(chunk)])
        self.begin, self.end = begin[self.first], end[self.last - 1]
        self.doc = np.searchsorted(self.offsets, self.begin, "right") - 1
        self.ids = ids_of(self.words, self.first, self.last)
        of = self.offsets[self.doc]
        self.start, self.chars = ahead[self.begin] - ahead[of], ahead[self.end] - ahead[self.begin]

    def _wrapped(self, lines, first, last, ahead, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) word of each paragraph of several lines. One that is little more than one of its lines is left out:
        that line stands for it."""
        document = np.searchsorted(self.offsets, lines, "right") - 1
        length = ahead[np.append(lines[1:] - 1, len(self.data))] - ahead[lines]
        on = (last > first)[:-1] & (last > first)[1:] & (document[:-1] == document[1:])
        blocks = np.concatenate([[0], np.flatnonzero(~on) + 1])
        width = np.repeat(np.maximum.reduceat(length, blocks), np.diff(np.append(blocks, len(lines))))
        word = np.append(ahead[end] - ahead[begin], 0)[first]
        on &= (length[:-1] + 1 + word[1:] > FILLED * width[:-1]) & (width[:-1] <= MOST_WIDTH)
        low, high = np.concatenate([[0], np.flatnonzero(~on) + 1]), np.append(np.flatnonzero(~on), len(lines) - 1)
        most = np.maximum.reduceat(last - first, low)
        several = (high > low) & (most < SIMILARITY * (last[high] - first[low]))
        return first[low][several], last[high][several]

    def grams(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the shingles of some lines, one after the other, where each line begins)."""
        count = self.last[line] - self.first[line] - SHINGLE + 1
        begin = np.cumsum(count) - count
        n = max(0, len(self.words) - SHINGLE + 1)
        weights = np.random.default_rng(12).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
        every = sum(self.words[i : i + n] * w for i, w in enumerate(weights))
        every = every ^ (every >> np.uint64(31))
        return every[np.repeat(self.first[line] - begin, count) + np.arange(int(count.sum()))], begin


def _chunks(batches, doc: int = 0, text: int = 1) -> Iterator[tuple[list, Pieces]]:
    for b in batches:
        ids, texts, held = [], [], 0
        for doc_id, t in zip(b.column(doc).to_pylist(), b.column(text)):
            t = t.as_buffer()
            ids.append(doc_id)
            texts.append(t.to_pybytes() if t else b"")
            held += len(texts[-1])
            if held > AT_ONCE:
                yield ids, Pieces(texts)
                ids, texts, held = [], [], 0
        if ids:
            yield ids, Pieces(texts)


def pieces(rows: DataFrame) -> DataFrame:
    """PIECES and kind (1 for chunks) of all pieces of (doc_id, text); and grams of lines, the set of their shingles' hashes
    (4 bytes each, ascending), where the task has not put them out before."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for doc_ids, p in _chunks(batches):
            ids, new = p.ids.to_pylist(), []
            for n in np.flatnonzero(p.kind == 0).tolist():
                if ids[n] not in seen:
                    seen.add(ids[n])
                    new.append(n)
            line = np.array(new, np.int64)
            grams, begin = p.grams(line)
            small, ends = (grams >> np.uint64(32)).astype(np.uint32), np.append(begin[1:], len(grams))
            sets = [None] * len(ids)
            for n, a, b in zip(new, begin.tolist(), ends.tolist()):
                sets[n] = np.unique(small[a:b]).tobytes()
            docs = pa.array(doc_ids, pa.int64()).take(pa.array(p.doc))
            columns = p.ids, docs, pa.array(p.start), pa.array(p.chars), pa.array(p.kind.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], [*NAMES, "kind", "grams"])
            if len(seen) > MOST_SEEN:
                seen.clear()

    return rows.mapInArrow(run, f"{PIECES}, kind int, grams binary")


def shared_bands(members: DataFrame) -> DataFrame:
    """(band, id), without repeats, of the bands that several ids share: one shuffle; a task holds one row at a time."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = None  # (band, its first id, whether that has been put out), until another band comes
        last = None  # the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            band, ids = batch.column(0).to_numpy(), batch.column(1)
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            if last is not None:
                new[0] = (int(band[0]), ids[0].as_py()) != last
            last = int(band[-1]), ids[-1].as_py()
            put_band, put_id = [], []
            for b, i in zip(band[new].tolist(), ids.filter(pa.array(new)).to_pylist()):
                if held is None or held[0] != b:
                    held = b, i, False
                    continue
                if not held[2]:
                    put_band.append(b)
                    put_id.append(held[1])
                    held = b, held[1], True
                put_band.append(b)
                put_id.append(i)
            if put_band:
                yield pa.RecordBatch.from_arrays([pa.array(put_band), pa.array(put_id, pa.binary())], ["band", "id"])

    sorted_ = members.select("band", "id").repartition("band").sortWithinPartitions("band", "id")
    return sorted_.mapInArrow(run, "band long, id binary")


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _set(grams: bytes) -> frozenset:
    return frozenset(np.frombuffer(grams, np.uint32).tolist())


def group_edges(ids: list[bytes], sets: list[frozenset], similarity: float) -> list[tuple[bytes, bytes]]:
    """Edges that connect all pairs of a group within reach of each other.

    Members take turns as pivots. A pivot is compared with those that are not yet known to be connected with it, unless
    their distances to an earlier pivot differ by more than a link spans.
    """
    n, span = len(ids), 1 - similarity + 1e-9
    if n == 2:
        return [(ids[0], ids[1])] if 1 - jaccard(*sets) <= span else []
    size, root, edges = np.array([len(s) for s in sets]), np.arange(n), []
    pivots: list[np.ndarray] = []  # distances to earlier pivots; nan where not measured
    for u in range(n):
        others = np.flatnonzero(root != root[u])
        others = others[(others > u) & (1 - np.minimum(size[others], size[u]) / np.maximum(size[others], size[u]) <= span)]
        for p in pivots:
            others = others[~(np.abs(p[others] - p[u]) > span)]  # a nan is never far
        if not len(others):
            continue
        d = np.full(n, np.nan)
        d[u] = 0
        for v in others.tolist():
            if root[v] == root[u]:
                continue
            d[v] = 1 - jaccard(sets[u], sets[v])
            if d[v] <= span:
                edges.append((ids[u], ids[v]))
                root[root == root[v]] = root[u]
        if len(pivots) < 8:
            pivots.append(d)
    return edges


def _edge_table(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*((max(e), min(e)) for e in edges)) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def small_group_edges(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges of bands of at most MOST_MEMBERS ids, each worked off by one task as its rows stream by."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, ids, held, out = None, [], [], []
        for batch in batches:
            for b, i, g in zip(*(c.to_pylist() for c in batch.columns)):
                if b != now:
                    out += group_edges(ids, held, similarity) if len(ids) > 1 else []
                    now, ids, held = b, [], []
                ids.append(i)
                held.append(_set(g))
            if out:
                yield _edge_table(list(set(out)))
                out = []
        yield _edge_table(group_edges(ids, held, similarity) if len(ids) > 1 else [])

    joined = members.join(sets, "id").select("band", "id", "grams").repartition("band").sortWithinPartitions("band", "id")
    return joined.mapInArrow(run, "a binary, b binary").distinct()


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (id, hub) with 1 - the Jaccard similarity of their shingles."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [1 - jaccard(_set(x), _set(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["id", "hub", "distance"])

    hubs = sets.select(F.col("id").alias("hub"), F.col("grams").alias("hub_grams"))
    both = pairs.join(sets, "id").join(hubs, "hub")
    return both.select("id", "hub", "grams", "hub_grams").mapInArrow(run, "id binary, hub binary, distance double")


def banded(lines: DataFrame, bands: int, each: int, level: int = 0) -> DataFrame:
    """(band, id) of lines (id, grams) by the bands of a level; if they have a band already, inside that one."""
    within = "band" in lines.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = [np.frombuffer(g, np.uint32) for g in b.column(1).to_pylist()]
            begin = np.cumsum([0, *map(len, parts)])[:-1]
            values = band_values(np.concatenate(parts).astype(np.uint64), begin, bands, each, level)
            if within:
                values = values ^ (b.column(2).to_numpy() * 0x5851F42D4C957F2D)[:, None]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(parts)), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), ids], ["band", "id"])

    rows = lines.select("id", "grams", *(["band"] if within else []))
    return shared_bands(rows.mapInArrow(run, "band long, id binary"))


def _hub_round(members: DataFrame, sets: DataFrame, hubs: int, span: float) -> tuple[DataFrame, DataFrame]:
    """(edges, members left) after each band's members are compared with some of them."""
    each = (F.min_by("id", F.xxhash64("id", F.lit(i))).alias(f"hub{i}") for i in range(hubs))
    chosen = members.groupBy("band").agg(*each)
    chosen = written(chosen.select("band", F.array_distinct(F.array(*chosen.columns[1:])).alias("hubs")), "hubs")
    asked = members.join(chosen, "band").select("band", "id", F.explode("hubs").alias("hub"), "hubs")
    asked = asked.select("band", "id", "hub", F.array_contains("hubs", F.col("id")).alias("is_hub")).where("id != hub")
    seen = asked.join(distances(asked.select("id", "hub").distinct(), sets), ["id", "hub"])
    seen = written(seen.withColumn("match", F.col("distance") <= span), "distances")
    edges = seen.where("match").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    # How near the members that do not match come to a hub: those that match it and lie further in than that, less what a
    # link spans, have no link to them.
    reach = seen.where("NOT match").groupBy("band", "hub").agg(F.min("distance").alias("nearest"))
    far = F.col("nearest").isNull() | (F.col("nearest") > F.col("distance") + span)
    left = seen.join(reach, ["band", "hub"], "left").groupBy("band", "id")
    left = left.agg(F.max(F.col("is_hub") | (F.col("match") & far)).alias("done")).where("NOT done").select("band", "id")
    again = left.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    return edges, written(left.join(again, "band"), "band-members")


def near_edges(lines: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) that connect the ids of all verified pairs of lines (id, grams) that meet in a band."""
    bands, each = tuned(similarity, recall)
    span = 1 - similarity + 1e-9
    members = written(banded(lines, bands, each), "band-members")
    wanted = members.select("id").distinct()
    sets = written(lines.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("grams").alias("grams")), "line-grams")
    edges, rounds = None, 0
    while True:
        large = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > MOST_MEMBERS).select("band")
        large = written(large, "large-bands")
        some = small_group_edges(members.join(large, "band", "left_anti"), sets, similarity)
        edges = written(some if edges is None else edges.unionByName(some), "near-edges")
        if large.isEmpty():
            forget(members)
            forget(sets)
            return edges
        rest, level = members.join(large, "band", "left_semi"), rounds // 3
        if rounds % 3 == 0 and 0 < level <= LEVELS:
            rest = written(banded(rest.join(sets, "id"), bands, each, level), "band-members")
        hubs = 4 ** (rounds % 3) if level <= LEVELS else 1 << min(rounds - 3 * LEVELS, 10)
        found, left = _hub_round(rest, sets, hubs, span)
        edges = edges.unionByName(found)
        forget(members)
        members, rounds = left, rounds + 1


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of both are equal."""
    n, at, width = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + width)] != b[at : min(n, at + width)])
        if len(differ):
            return at + int(differ[0])
        at, width = at + width, 2 * width
    return n


def runs(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the maximal runs of equal words through the seeds, each CHUNK words at (place in a,
    place in b); seeds whose words differ are passed over, and runs inside another one's place in a are left out."""
    ends: dict[int, int] = {}  # of the last run on each diagonal
    found = []
    for i, j in sorted(seeds):
        if i + CHUNK <= ends.get(i - j, -1) or min(len(a) - i, len(b) - j) < CHUNK:
            continue
        if not np.array_equal(a[i : i + CHUNK], b[j : j + CHUNK]):
            continue
        left, right = _alike(a[:i][::-1], b[:j][::-1]), _alike(a[i:], b[j:])
        ends[i - j] = i + right
        found.append((i - left, j - left, left + right))
    out, reached = [], -1
    for i, j, n in sorted(found, key=lambda r: (r[0], -r[2], r[1])):
        if i + n > reached:
            out.append((i, j, n))
            reached = i + n
    return out


class _Words:
    """A text's word hashes, and the first and last code point of each."""

    def __init__(self, text: bytes):
        begin, end, self.hashes = words_of(text.lower())
        ahead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        self.start, self.stop = ahead[begin], ahead[end]

    def at(self, starts: list[int]) -> list[int]:
        """The words that start there; -1 if none does."""
        found = np.searchsorted(self.start, starts)
        return [int(k) if k < len(self.start) and self.start[k] == s else -1 for k, s in zip(found, starts)]


def spans(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pieces: the runs of equal words around seeds (doc_id, start, keep_doc_id, keep_start), in both of their documents."""
    pairs = seeds.groupBy("doc_id", "keep_doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "keep_start"))).alias("seeds"))
    pairs = written(pairs, "passage-pairs")
    ids = pairs.select("doc_id").unionByName(pairs.select(F.col("keep_doc_id").alias("doc_id"))).distinct()
    texts = written(rows.join(ids, "doc_id", "left_semi"), "passage-texts")  # several of one id, if they are
    keeps = texts.select(F.col("doc_id").alias("keep_doc_id"), F.col("text").alias("keep_text"))

    def run(batches):
        memory: dict = {}  # the last text of either side

        def words(side: int, text) -> _Words:
            text = text.as_buffer().to_pybytes() if text.is_valid and len(text.as_buffer()) else b""
            if memory.get(side, (None,))[0] != text:
                memory[side] = text, _Words(text)
            return memory[side][1]

        for batch in batches:
            for n in range(batch.num_rows):
                doc, keep = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                places = batch.column(2)[n].as_py()
                a, b = words(0, batch.column(3)[n]), words(1, batch.column(4)[n])
                at = zip(a.at([p["start"] for p in places]), b.at([p["keep_start"] for p in places]))
                found = runs(a.hashes, b.hashes, [(i, j) for i, j in at if i >= 0 and j >= 0])
                if not found:
                    continue
                i, j, size = (np.array(c, np.int64) for c in zip(*found))
                ids = ids_of(a.hashes, i, i + size)
                start, kept = a.start[i], b.start[j]
                chars = np.concatenate([a.stop[i + size - 1] - start, b.stop[j + size - 1] - kept])
                places = np.repeat([doc, keep], len(i)), np.concatenate([start, kept]), chars
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids, ids]), *map(pa.array, places)], NAMES)

    both = pairs.join(texts, "doc_id").join(keeps, "keep_doc_id").select("doc_id", "keep_doc_id", "seeds", "text", "keep_text")
    return both.mapInArrow(run, PIECES)


def repeated_passages(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """The pieces that two or more documents share, one row per occurrence: doc_id, start and n_chars (in code points),
    group_id (24 hex digits), keep_doc_id and keep_start (the occurrence that stays: the smallest doc_id, then start), kept.

    A passage inside longer lines is reported whole: the run of words that an occurrence shares with the first one. Where a
    document repeats within itself what others hold too, the chunks are reported. Rows may overlap; those of a group that
    begin inside the occurrence that stays, such as a line of a paragraph like it, stay with it.

    Documents without such a piece have no row. Null and empty texts have no pieces, nor have rows with a null id, which
    can't be told apart; repeated rows of one id count as one document, whose pieces stay in all of its rows. An empty
    table gives no rows; other columns of docs are not read.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = written(pieces(rows), "pieces")
    first = F.min(F.struct("doc_id", "start", (-F.col("n_chars")).alias("less")))
    ends = first.alias("first"), F.max("doc_id").alias("last")
    near = near_edges(found.where("grams IS NOT NULL").select("id", "grams"), similarity, recall)
    roots = components(near)
    roots = written(roots.select(F.col("node").alias("id"), "root"), "passage-roots")
    # A lone class of one document is in no group; only what is left is looked at further.
    some = found.groupBy("id").agg(*ends).join(roots, "id", "left").where("root IS NOT NULL OR first.doc_id != last")
    some = some.select("id", "first", (F.col("first.doc_id") != F.col("last")).alias("shared"))
    held = written(found.drop("grams").join(some, "id"), "passage-pieces")
    forget(near)
    forget(found)
    chunks = held.where("kind = 1 AND shared")
    same = F.col("doc_id") == F.col("first.doc_id")
    keep = F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start")
    seeds = chunks.where(~same).select("doc_id", "start", *keep)
    inside = chunks.where(same & (F.col("start") != F.col("first.start"))).select("id").distinct()
    every = held.where("kind = 0").select(NAMES).unionByName(chunks.join(inside, "id", "left_semi").select(NAMES))
    every = written(every.unionByName(spans(rows, seeds)).distinct(), "passages")
    forget(held)
    some = every.groupBy("id").agg(*ends).join(roots, "id", "left").withColumn("group_id", F.coalesce("root", "id"))
    some = some.where("root IS NOT NULL OR first.doc_id != last").select("id", "group_id", "first", "last")
    best = some.groupBy("group_id").agg(F.min("first").alias("keep"), F.max("last").alias("last"))
    named = some.join(best.where("keep.doc_id != last").drop("last"), "group_id").select("id", "group_id", "keep")
    joined = every.join(named, "id")
    kept = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("start") < F.col("keep.start") - F.col("keep.less"))
    keep = F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), kept.alias("kept")
    return joined.select("doc_id", "start", "n_chars", F.lower(F.hex("group_id")).alias("group_id"), *keep)


def without_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with every repeated passage but the one that stays cut out of its text.

    All rows and columns stay, whatever the columns' names; null texts stay null, rows with a null id and repeated rows of
    the document whose passage stays are left as they are, and an empty table stays empty.
    """
    own, cuts = fresh(docs, "cut_id", "cuts")
    spans_ = F.array_sort(F.collect_set(F.struct("start", "n_chars")))
    cut = repeated_passages(docs, text, id_col).where("NOT kept").groupBy("doc_id").agg(spans_.alias(cuts))
    joined = docs.join(cut.withColumnRenamed("doc_id", own), column(id_col).cast("long") == F.col(own), "left")

    def rest(t):
        # (text so far, where the uncut text goes on); spans come in order and may overlap
        def step(acc, x):
            length = (x["start"] - acc["at"]).cast("int")
            between = F.when(x["start"] > acc["at"], F.substring(t, (acc["at"] + 1).cast("int"), length)).otherwise("")
            at = F.greatest(acc["at"], x["start"] + x["n_chars"])
            return F.struct(F.concat(acc["out"], between).alias("out"), at.alias("at"))

        def end(acc):
            return F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t)))

        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
        return F.aggregate(cuts, start, step, end)

    cut_text = F.when(F.col(cuts).isNull(), column(text)).otherwise(rest(column(text))).alias(text)
    return joined.select(*(cut_text if c == text else column(c) for c in docs.columns))
