"""Packing of tokenised documents into windows by the sum-of-squares rule.

A document's ids are cut into whole windows and a rest. Rests are placed online: into the fill level (or a new window)
where the sum over all levels of the squared number of partially filled windows at that level grows least. A level is UNIT
ids wide; a window that the rule fills to its last level is topped up with the first ids of the document that comes next, so
nothing is padded. Windows that stay open at the end of a partition, some of the levels, are topped up by cutting the
emptiest, and what is left in the last one is cut at powers of two. The column drained tells these from the rule's own.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import column, kept

WINDOW = 4096
END_ID = 2
#: Ids of a level: so wide that a partition's open windows are few, and so narrow that the last level is soon topped up.
UNIT = 32
#: Distinct words whose ids a worker remembers before it starts afresh.
MOST_WORDS = 150_000


class WholeTokenizer:
    """The ids of a tokenizer file for whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def word_pattern(path: str) -> str | None:
    """The pattern of the pieces that a tokenizer file's texts are cut into, if it works as WordTokenizer does: composed,
    lower-cased, white space dropped, the pieces' bytes as characters, byte-pair merges; else None."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    normal = (said.get("normalizer") or {}).get("normalizers", [])
    space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if normal != [{"type": "NFC"}, space, {"type": "Lowercase"}] or said.get("model", {}).get("type") != "BPE":
        return None
    cut = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if len(cut) != 2 or cut[0].get("type") != "Split" or cut[1].get("type") != "ByteLevel":
        return None
    if (cut[0].get("behavior"), cut[0].get("invert")) != ("Removed", True):
        return None
    if cut[1].get("use_regex") or cut[1].get("add_prefix_space"):
        return None
    pattern = cut[0].get("pattern", {}).get("Regex")
    # No piece may reach over white space, and words of plain letters must be one piece.
    probe = regex.compile(pattern).findall(" a\tb\u3000c d1 e-f ") if pattern else []
    return pattern if probe and not any(c.isspace() for x in probe for c in x) and probe[:3] == ["a", "b", "c"] else None


def tokenizer_of(path: str) -> WholeTokenizer:
    return WordTokenizer(path) if word_pattern(path) else WholeTokenizer(path)


class WordTokenizer(WholeTokenizer):
    """The same, by way of a memory of words.

    The tokenizer works piece by piece, never across white space, so what stands between white space has the same ids
    wherever it stands; new words are cut into pieces here, by the file's pattern, and given to the tokenizer's own model.
    Texts with characters outside the plain ranges below, where another library's character tables could differ, go to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.pieces = regex.compile(word_pattern(path)).findall
        plain = r"\t\n\r\x20-\x7e\xa1-\u012f\u0132-\u0148\u014a-\u017e\u2010-\u2027\u2030-\u205e\u20ac"
        self.odd = re.compile(f"[^{plain}]").search
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: other bytes follow from 256 on
        rest = iter(range(256, 512))
        self.bytes = {b: chr(b if b in plain else next(rest)) for b in range(256)}
        self._afresh()

    def _afresh(self) -> None:
        self.known: dict[str, int] = _Numbered()
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.filled, self.learned = np.zeros(4096, np.uint32), 0, 0

    def _learn(self) -> None:
        """The ids of the words that have got a number but no ids yet."""
        new, n, model = self.known.new, self.learned, self.tokenizer.model
        ids, ends = [], []
        for word in new:
            for piece in (word,) if word.isascii() and word.isalpha() else self.pieces(word):
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1").translate(self.bytes)
                ids += [t.id for t in model.tokenize(piece)]
            ends.append(len(ids))
        while n + len(new) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        begin = np.array([0, *ends[:-1]])
        self.start[n : n + len(new)], self.size[n : n + len(new)] = self.filled + begin, ends - begin
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.learned += len(new)
        self.known.new = []

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as by the tokenizer's encode with add_special_tokens=False."""
        if len(self.known) > MOST_WORDS:
            self._afresh()
        split = [None if self.odd(t) or any(s in t for s in self.special) else t.lower().split() for t in texts]
        counts = [len(w) if w else 0 for w in split]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(w for w in split if w)), np.int64, sum(counts))
        if self.known.new:
            self._learn()
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        begin = 0
        for text, words, stop in zip(texts, split, stops.tolist()):
            if words is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[begin:stop]
            begin = stop


class _Numbered(dict):
    """Gives each new word the next number."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Packer:
    """Takes documents' ids one by one; gives out the pieces of windows as they are finished.

    It holds the ids of open windows only; there are some of each level, whatever the number of documents, where their
    lengths can be packed well, and never more ids than the partition has.
    """

    def __init__(self, window: int = WINDOW, unit: int | None = None):
        self.window, self.unit = window, unit or min(UNIT, max(1, window // 128))
        while window % self.unit:
            self.unit -= 1
        self.top = window // self.unit
        self.levels = np.zeros(self.top + 1, np.int64)  # how many open windows are at each level
        self.open: dict[int, list[tuple[int, list]]] = {}  # level -> (ids in it, pieces (document, start, ids)) of each
        self.waiting: list[tuple[int, list]] = []  # windows at the last level that have room for a few ids
        self.sequence = 0

    def _close(self, pieces: list, drained: bool = False) -> Iterator[tuple]:
        at = 0
        for doc, start, ids in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), self.sequence, at, drained
            at += len(ids)
        self.sequence += 1

    def level_for(self, n: int) -> int:
        """The level whose window n more ids go to, 0 for a new window: where the sum of squares grows least; of equal ones
        the fullest, and a window that is there rather than a new one."""
        levels, up = self.levels, -(-n // self.unit)
        # From level h to h + up: 2 (N[h + up] - N[h]) + 2; a new window adds 2 N[up] + 1, one that reaches the top takes
        # away 2 N[h] - 1.
        cost = 2 * levels[up] + 1 if up < self.top else 0
        there = np.flatnonzero(levels[1 : self.top - up + 1]) + 1
        if not len(there):
            return 0
        to = np.minimum(there + up, self.top - 1)
        change = np.where(there + up == self.top, 1 - 2 * levels[there], 2 * (levels[to] - levels[there]) + 2)
        k = len(there) - 1 - int(np.argmin(change[::-1]))
        return int(there[k]) if change[k] <= cost else 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        ids, at = ids.astype("<u4"), 0
        while self.waiting and at < len(ids):  # tops up windows at the last level
            held, pieces = self.waiting.pop()
            take = min(len(ids) - at, self.window - held)
            pieces.append((doc, at, ids[at : at + take]))
            at += take
            if held + take < self.window:
                self.waiting.append((held + take, pieces))
            else:
                yield from self._close(pieces)
        while len(ids) - at >= self.window:
            yield from self._close([(doc, at, ids[at : at + self.window])])
            at += self.window
        n = len(ids) - at
        if not n:
            return
        level, held, pieces = self.level_for(n), 0, []
        if level:
            held, pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append((doc, at, ids[at:]))
        if held + n == self.window:
            yield from self._close(pieces)
        elif level + -(-n // self.unit) >= self.top:
            self.waiting.append((held + n, pieces))
        else:
            self._put(level + -(-n // self.unit), held + n, pieces)

    def _put(self, level: int, held: int, pieces: list) -> None:
        self.open.setdefault(level, []).append((held, pieces))
        self.levels[level] += 1

    def finish(self) -> Iterator[tuple]:
        """Tops up the fullest windows with what the emptiest hold; the last one is cut at powers of two."""
        windows = sorted((w for some in self.open.values() for w in some), key=lambda w: w[0])
        windows += sorted(self.waiting, key=lambda w: w[0])
        self.open, self.waiting = {}, []
        self.levels[:] = 0
        spare: list = []  # pieces of the window being cut up, last first
        while windows or spare:
            if not windows:
                windows.append((0, []))
            held, pieces = windows.pop()
            while held < self.window and (spare or windows):
                if not spare:
                    spare = windows.pop(0)[1][::-1]
                doc, start, ids = spare.pop()
                take = min(len(ids), self.window - held)
                pieces.append((doc, start, ids[:take]))
                held += take
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:]))
            if held == self.window:
                yield from self._close(pieces, True)
            else:
                yield from self._halved(pieces[::-1], held)

    def _halved(self, rest: list, left: int) -> Iterator[tuple]:
        """Pieces, last first, as windows of powers of two."""
        while left:
            room, pieces = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids = rest.pop()
                take = min(len(ids), room)
                pieces.append((doc, start, ids[:take]))
                room -= take
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:]))
            yield from self._close(pieces, True)


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, drained boolean"
)


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", id_col: str = "doc_id", window: int = WINDOW
) -> DataFrame:
    """The pieces of every document (its ids, then END_ID) in windows of at most `window` ids, one row a piece; drained is
    true in windows that were made of what was open at the end of a partition.

    Each partition is packed by itself as it is read, without a shuffle; sequence_id holds the partition in its high bits.
    Null texts count as empty (one piece with the end id); null ids and repeated rows are packed like any other; an empty
    table gives no rows; other columns of docs are not read.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64()] * (len(names) - 1) + [pa.bool_()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
        tokenizer = kept(("tokenizer", path), lambda: tokenizer_of(path))
        packer, first = Packer(window), TaskContext.get().partitionId() << 40

        def batch(pieces) -> Iterator[pa.RecordBatch]:
            rows = [(doc[0], start, n, crc, doc[1], first + seq, at, end) for doc, start, n, crc, seq, at, end in pieces]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            done: list = []
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 512):
                part = [t or "" for t in texts.slice(at, 512).to_pylist()]
                for doc_id, tokens in zip(ids[at : at + 512], tokenizer.encode(part)):
                    tokens = np.append(tokens, np.uint32(END_ID))
                    done += packer.add((doc_id, len(tokens)), tokens)
            yield from batch(done)
        yield from batch(packer.finish())

    return docs.select(column(id_col).cast("long"), column(text).cast("string")).mapInArrow(run, PIECES)
