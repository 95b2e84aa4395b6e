"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are lower-cased words, a space apart. The random-walk embedding copies the current character at every step and moves
on by a bit that depends on the step and the character; two strings at a small edit distance fall back into step, so their
embeddings are close in Hamming distance. Over a window as long as an item a walk that has lost its step seldom finds it
again, so it is set anew at every word: the embedding of a window is that of its words, one walk after the other. A sample
takes a few coordinates of the walk of one word (which goes on into the next words); a word of the document and one of an
item vote for the window where the item would start if they agree in any of several samples of several walks. Windows of
which enough words vote are candidates, and are verified by the edit distance of the whole item to the best matching stretch
of the document (Myers' bit-parallel algorithm).

How many votes are asked for follows from the item's length: few enough that items at the similarity asked for are found with
a chance of RECALL or more (tests measure it for edits of characters and of words), and more for longer items, whose words
meet more often by chance. Items of fewer than LEAST_WORDS words, where one character decides, are looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .shared import column, kept, mapped

SIMILARITY = 0.8
#: What the votes asked for are tuned to.
RECALL = 0.9
WALKS, SAMPLES = 3, 5
#: Steps that a sample of a word's walk reaches, and its coordinates: for items of fewer than SHORT words, and for others.
NEAR, FAR = (24, 6), (32, 8)
SHORT = 12
STEPS = max(NEAR[0], FAR[0])
#: Shorter items can't be told from chance with an edit; they are looked up as they are.
LEAST_WORDS = 5
#: One vote is asked for so many words of an item.
WORDS_A_VOTE = 4
#: Items, and words of items, that are sent with the tasks at once; more are searched for in further passes.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1 << 20
#: Bytes of text embedded at once: bounds the memory of a task, and keeps it near the processor.
AT_ONCE = 1 << 18

#: Bytes beside a quarter of an item that its place may be out by.
SLACK = 16

_u64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u64(27))) * _u64(0x94D049BB133111EB)
    return x ^ (x >> _u64(31))


_LETTER = np.zeros(256, np.uint64)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _LETTER[_b] = _b
_IS_LETTER = _LETTER != 0
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size, back = 1 << int(n).bit_length(), pow(_BASE, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        _powers = tuple(np.cumprod(np.concatenate([one, np.full(size, b, np.uint64)])) for b in (_BASE, back))
    return _powers


def _alone(raw: np.ndarray) -> np.ndarray:
    """Where a character of a script without spaces begins (kana, Han, Thai, Lao, Khmer): each is a word."""
    lead = (raw >= 0xE3) & (raw <= 0xE9)
    if (raw == 0xE0).any() or (raw == 0xE1).any() or (raw == 0xF0).any():
        after = np.append(raw[1:], 0)
        lead |= (raw == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
        lead |= (raw == 0xE1) & (after >= 0x9E) & (after <= 0x9F)
        lead |= (raw == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
    return np.flatnonzero(lead)


def bounds_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the words in lower-cased UTF-8: runs of letters and digits, all bytes beyond ASCII included; in
    scripts without spaces every character is a word."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], _IS_LETTER[raw], [False]])
    begin = np.flatnonzero(~inside[:-1] & inside[1:])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    single = _alone(raw) if len(raw) and raw.max() >= 0xE0 else ()
    if len(single):
        after = single + np.where(raw[single] >= 0xF0, 4, 3)
        cuts = np.concatenate([single, after])
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])  # inside a run of letters
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
        keep = end > begin
        begin, end = begin[keep], end[keep]
    return begin, end


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the words, as by bounds_of()."""
    begin, end = bounds_of(data)
    x = _LETTER[np.frombuffer(data, np.uint8)]
    up, down = _power_tables(len(x) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])])
    return begin, end, _mixed((total[end] - total[begin]) * down[begin])


class Plain:
    """Several texts as words a space apart; nothing stands between characters that are words. Bytes of zero follow."""

    def __init__(self, texts: list[bytes], hashed: bool = False):
        data = b"\0".join(texts)
        begin, end, self.hashes = words_of(data) if hashed else (*bounds_of(data), None)
        size = end - begin
        gap = np.ones(len(begin), np.int64)
        gap[1:] = begin[1:] > end[:-1]
        after = np.cumsum(size + gap)  # of each word in self.text, which starts with a gap
        self.start = after - size
        self.text = np.full((int(after[-1]) if len(after) else 0) + STEPS + 1, 32, np.uint8)
        place = np.repeat(self.start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        source = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(place))
        self.text[place] = np.frombuffer(data, np.uint8)[source]
        self.end = after
        self.text[int(after[-1]) if len(after) else 0 :] = 0
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(begin, offsets)  # word of each text, and one more

    def cut(self, low: int, high: int) -> str:
        return self.text[max(low, 0) : high].tobytes().decode("utf-8", "ignore")


class Walks:
    """The walks, and the samples of some reach and number of coordinates, the same wherever the seed is the same.

    Each walk gives every byte 64 random bits: the step-th says whether to move on there, all of them go into the keys.
    """

    def __init__(self, reach: int, coordinates: int, walks: int = WALKS, samples: int = SAMPLES, seed: int = 7):
        self.bits = np.random.default_rng(seed).integers(0, 1 << 64, (walks, 256), np.uint64)
        random = np.random.default_rng([seed, reach, coordinates])
        cuts = [reach * i // coordinates for i in range(coordinates + 1)]
        self.at = np.stack([random.integers(a, b, (walks, samples)) for a, b in zip(cuts, cuts[1:])], -1)

    def keys(self, text: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each sample the keys of the words that start there."""
        for bits, samples in zip(self.bits, self.at.tolist()):
            every = bits[text]
            place, sums = starts.copy(), [np.zeros(len(starts), np.uint64) for _ in samples]
            letter, move = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
            for step in range(max(map(max, samples)) + 1):
                np.take(every, place, out=letter, mode="clip")
                for total, steps in zip(sums, samples):
                    if step in steps:
                        total *= _u64(_BASE)
                        total += letter
                np.right_shift(letter, _u64(step), out=move)
                np.bitwise_and(move, _u64(1), out=move)
                place += move.view(np.int64)
            for total in sums:
                total ^= total >> _u64(31)
                total *= _u64(0xBF58476D1CE4E5B9)
                total >>= _u64(1)
                yield total


def votes_asked(words: np.ndarray) -> np.ndarray:
    return np.maximum(1, words // WORDS_A_VOTE)


class ItemIndex:
    """The samples of all words of a block of items; looks up documents."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, exact, texts = [], {}, []
        for item_id, text in items:
            data = _lower(text)
            _, _, hashes = words_of(data)
            if len(hashes) >= LEAST_WORDS:
                texts.append(data)
                self.items.append((item_id, "", len(hashes)))
            elif len(hashes):
                exact.setdefault(len(hashes), []).append((item_id, hashes))
        plain = Plain(texts)
        first, last = plain.first[:-1], plain.first[1:] - 1
        for n, (item_id, _, words) in enumerate(self.items):
            self.items[n] = item_id, plain.cut(int(plain.start[first[n]]), int(plain.end[last[n]])), words
        self.words = np.array([n for *_, n in self.items], np.int64)
        self.size = plain.end[last] - plain.start[first] if self.items else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(self.items)), self.words)
        offset = plain.start - plain.start[first][number] if self.items else number
        self.parts = []  # (walks, an index for each sample)
        for reach, some in ((NEAR, self.words[number] < SHORT), (FAR, self.words[number] >= SHORT)):
            if some.any():
                walks = Walks(*reach)
                keys = walks.keys(plain.text, plain.start[some])
                self.parts.append((walks, [self._filed(k, number[some], offset[some]) for k in keys]))
        self.exact = []  # (words, keys in order, the items' ids)
        for n, some in sorted(exact.items()):
            keys = np.concatenate([self._runs(h, n) for _, h in some])
            order = np.argsort(keys, kind="stable")
            self.exact.append((n, keys[order], [some[i][0] for i in order.tolist()]))

    @staticmethod
    def _filed(keys: np.ndarray, number: np.ndarray, offset: np.ndarray) -> tuple:
        """A filter by the leading bits, and the keys in order with their items and offsets."""
        order = np.argsort(keys, kind="stable")
        bits = min(24, len(keys).bit_length() + 6)
        drop = _u64(63 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[keys >> drop] = True
        return seen, drop, keys[order], number[order].astype(np.int32), offset[order].astype(np.int32)

    @staticmethod
    def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
        """A key for every n words in a row."""
        size = max(0, len(hashes) - n + 1)
        out = np.zeros(size, np.uint64)
        for i in range(n):
            out = _mixed(out * _u64(_BASE) + hashes[i : i + size])
        return out

    def candidates(self, plain: Plain) -> np.ndarray:
        """(item number, byte of the text where the item would start, votes) as three rows."""
        number, start, word = [], [], []
        for walks, filed in self.parts:
            for keys, (seen, drop, known, numbers, offsets) in zip(walks.keys(plain.text, plain.start), filed):
                at = np.flatnonzero(np.take(seen, (keys >> drop).view(np.int64), mode="clip"))
                low, high = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
                count = high - low
                which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                own = np.repeat(at, count)
                number.append(numbers[which].astype(np.int64))
                start.append(plain.start[own] - offsets[which])
                word.append(own)
        if not sum(map(len, number)):
            return np.zeros((3, 0), np.int64)
        number, start, word = (np.concatenate(x) for x in (number, start, word))
        out = []
        for turn in range(2):  # places on either side of a border meet the other time
            width = self.size[number] // 4 + SLACK
            near = (start + turn * (width // 2)) // width
            order = np.lexsort((word, near, number))
            n, b, w, s = number[order], near[order], word[order], start[order]
            new = np.ones(len(n), bool)
            new[1:] = (n[1:] != n[:-1]) | (b[1:] != b[:-1])
            another = new.copy()
            another[1:] |= w[1:] != w[:-1]
            group = np.flatnonzero(new)
            votes = np.add.reduceat(another.astype(np.int64), group)
            middle = s[(group + np.append(group[1:], len(n))) // 2]
            enough = votes >= votes_asked(self.words[n[group]])
            out.append(np.stack([n[group], middle, votes])[:, enough])
        return np.concatenate(out, 1)

    def search(self, ids: list, texts: list[bytes], similarity: float) -> Iterator[tuple]:
        """RESULT's rows of some lower-cased texts."""
        plain = Plain(texts, bool(self.exact))
        if not len(plain.start):
            return
        numbers, starts, votes = self.candidates(plain)
        # the document is the one that holds the middle of where the item would lie
        middle = np.clip(starts + self.size[numbers] // 2, 0, len(plain.text)) if len(numbers) else starts
        docs = np.searchsorted(plain.first, np.searchsorted(plain.start, middle, "right") - 1, "right") - 1
        tried: dict[tuple[int, int], int] = {}  # the least distance
        places: set[tuple[int, int, int]] = set()
        for k in np.argsort(-votes, kind="stable").tolist():
            doc, n, start = max(0, int(docs[k])), int(numbers[k]), int(starts[k])
            slack = int(self.size[n]) // 4 + SLACK
            place = doc, n, start // (slack // 2)
            if place in places or tried.get((doc, n)) == 0:
                continue  # what would be looked at has been
            places.add(place)
            begin, end = plain.start[plain.first[doc]], plain.end[plain.first[doc + 1] - 1]
            low, high = max(start - slack, int(begin)), min(start + int(self.size[n]) + slack, int(end))
            item, stretch = self.items[n][1], plain.cut(low, high)
            d = best_distance(item, stretch) if may_hold(item, stretch, similarity) else len(item)
            tried[doc, n] = min(d, tried.get((doc, n), d))
        for (doc, n), d in tried.items():
            near = 1 - d / len(self.items[n][1])
            if near >= similarity:
                yield ids[doc], self.items[n][0], d, near
        for n, known, items in self.exact:
            keys, hits = self._runs(plain.hashes, n), set()
            for i in np.flatnonzero(np.isin(keys, known)).tolist():
                doc = int(np.searchsorted(plain.first, i, "right")) - 1
                if i + n <= plain.first[doc + 1]:
                    low, high = np.searchsorted(known, keys[i], "left"), np.searchsorted(known, keys[i], "right")
                    hits.update((doc, j) for j in range(int(low), int(high)))
            for doc, j in sorted(hits):
                yield ids[doc], items[j], 0, 1.0


def may_hold(item: str, stretch: str, similarity: float) -> bool:
    """False if so few of the item's runs of three characters stand in the stretch that more edits than the similarity
    allows must lie between: an edit changes three of them at most."""
    edits = int((1 - similarity) * len(item) + 1e-9)
    there = set(map("".join, zip(stretch, stretch[1:], stretch[2:])))
    shared = sum(map(there.__contains__, map("".join, zip(item, item[1:], item[2:]))))
    return shared >= len(item) - 2 - 3 * edits


def best_distance(pattern: str | bytes, text: str | bytes) -> int:
    """The least edit distance of pattern to any stretch of text."""
    if pattern in text:
        return 0
    m = len(pattern)
    top, full = 1 << (m - 1), (1 << m) - 1
    where: dict = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best = score
    for c in text:
        eq = where.get(c, 0)
        x = eq | minus
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus = (minus | ~(zero | plus)) & full
        h_minus = plus & zero
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = (h_minus | ~(x | h_plus)) & full
        minus = h_plus & x
        if score < best:
            best = score
    return best


RESULT = "doc_id long, item_id long, edit_distance long, similarity double"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]


def _lower(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    block, words = [], 0
    for item_id, text in benchmark.toLocalIterator():
        block.append((item_id, text))
        words += len(text or "") // 4 + 1
        if len(block) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def _index_of(block: list[tuple], key: bytes) -> ItemIndex:
    """Made once by each worker, which keeps the last one."""
    return kept(("items", key), lambda: ItemIndex(block))


def _passes(benchmark: DataFrame, text: str) -> Iterator[tuple[list[tuple], bytes]]:
    for block in _blocks(benchmark.select(column("item_id").cast("long"), column(text).cast("string"))):
        yield block, xxhash.xxh3_128_digest(repr(block).encode("utf-8", "replace"))


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, lower-cased texts) of some AT_ONCE bytes at a time."""
    first, held, size = 0, [], 0
    for n, t in enumerate(texts):
        held.append(_lower(t.as_py()))
        size += len(held[-1])
        if size > AT_ONCE:
            yield first, held
            first, held, size = n + 1, [], 0
    if held:
        yield first, held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, item_id, edit_distance, similarity) of every document that holds an item, one row per row of docs and item.

    similarity is 1 - distance / item length, in characters of the lower-cased words a space apart; the item may start and
    end anywhere in the document. Items of fewer than LEAST_WORDS words must stand there word by word. The benchmark is the
    query set: its items are searched for in blocks of BLOCK_ITEMS (or BLOCK_WORDS words), each in one pass over all
    documents, without a shuffle. Null and empty texts hold nothing, and null and empty items are nowhere; null ids and
    repeated rows are searched like any other; empty tables give no rows; other columns are not read.
    """
    rows = docs.select(column(id_col).cast("long"), column(text).cast("string"))
    out = None
    for block, key in _passes(benchmark, "text"):

        def run(batches, block=block, key=key) -> Iterator[pa.RecordBatch]:
            index = _index_of(block, key)
            for batch in batches:
                ids, done = batch.column(0).to_pylist(), []
                for first, texts in _portions(batch.column(1)):
                    done += index.search(ids[first : first + len(texts)], texts, similarity)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _KINDS)], _NAMES)

        found = rows.mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """The rows of docs that hold no item, by contaminated()'s rule, with all their columns, whatever their names.

    No shuffle and no join: null and repeated ids are no matter, and null and empty texts stay. An empty benchmark keeps
    all rows; an empty table gives no rows.
    """
    place = docs.columns.index(text)
    for block, key in _passes(benchmark, "text"):

        def run(batches, block=block, key=key) -> Iterator[pa.RecordBatch]:
            index = _index_of(block, key)
            for batch in batches:
                hit = set()
                for first, texts in _portions(batch.column(place)):
                    hit.update(r[0] for r in index.search(list(range(first, first + len(texts))), texts, similarity))
                yield batch.take(pa.array([n for n in range(batch.num_rows) if n not in hit], pa.int64()))

        docs = mapped(docs, run)
    return docs
