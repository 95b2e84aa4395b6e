"""Exact dedup, packing, licence scans, SimHash, passages: against brute force, and at the edges."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from meterstone.llm import exact_dedup, license_scan, license_texts, packing, passages, shared, simhash
from meterstone.llm.shared import components

#: Further columns have names that the operators use inside, or that need quoting.
MORE = (
    "digest string, fp long, key long, score double, members int, `own_digest` string, `OWN_doc_id` long, `lost_doc_id` long, "
    "`lost_digest` string, `cuts` string, `cut_id` long, `_toxicity` double, `_own` string, `a.b` string, `c``d` string, "
    "`pattern_verdict` string"
)
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {MORE}"
VALUES = ("x", 1, 2, 0.5, 3, "own", 4, 5, "lost", "cut", 6, 0.25, "mine", "dot", "tick", "said")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
WHITE = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    """rows: (id, text)."""
    made = [(i, t, "en", "s", None if t is None else len(t), *VALUES) for i, t in rows]
    return spark.createDataFrame(made, SCHEMA)


def untouched(df):
    """Whether the further columns are there, in order, with their values."""
    names = list(docs(df.sparkSession, []).columns)
    return df.columns == names and all(tuple(r)[5:] == VALUES for r in df.collect())


EDGES = [(5, None), (6, ""), (7, " \t\n"), (None, "Alpha beta gamma"), (1, "Alpha beta gamma"), (2, "Alpha  beta gamma"), (3, "alpha beta gamma"), (3, "alpha beta gamma"), (None, None), (9, LONG), (8, LONG), (10, "naïve … \u2003 text 日本語"), (11, "<|endoftext|> Don't ΣΑΣ")]


def random_docs(n, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "lo mi ra te su ne ka".split() for b in "bar den fol gus him jor".split()]
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            w = out[r.randrange(len(out))][1].split(" ")
            for _ in range(r.choice((0, 0, 1, 2))):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((i, " ".join(w)))
        else:
            lines = [" ".join(r.choice(words) for _ in range(r.choice((3, 12, 40)))) + "." for _ in range(r.randint(1, 4))]
            out.append((i, "\n".join(lines)))
    return out


# Exact dedup


def test_perfect_hash_is_minimal_and_knows_strangers():
    make = lambda xs: np.frombuffer(b"".join(hashlib.sha256(str(x).encode()).digest() for x in xs), np.uint8).reshape(-1, 32)
    for n in (0, 1, 2, 500):
        known = make(range(n))
        h = exact_dedup.PerfectHash.build(known)
        assert sorted(h.rank(known).tolist()) == list(range(n))
        again = exact_dedup.PerfectHash.unpacked(*h.packed())
        assert (again.rank(known) == h.rank(known)).all()
    slots = h.rank(make(range(10_000, 11_000)))
    assert slots.max() < 500 and (slots == -1).any()


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in WHITE)].append((i, len(t or "")))
    out = []
    for t, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [EDGES, random_docs(120), [], [(None, "a"), (None, "a")]], ids=["edges", "random", "empty", "nulls"])
def test_exact_groups(spark, rows):
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs(spark, rows)).collect()), key=str)
    assert got == brute_groups(rows)
    left = exact_dedup.without_copies(docs(spark, rows))
    assert untouched(left)
    texts = ["".join(c for c in r["text"] or "" if c not in WHITE) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r[4] for r in got})


# Packing


def check_packing(rows, pieces, window=packing.WINDOW):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    ids = defaultdict(list)
    for i, text in rows:
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        ids[i, len(x)].append(x)
    assert by_doc.keys() == ids.keys()
    for key, copies in ids.items():
        wanted = {(s, n): {zlib.crc32(x[s : s + n].tobytes()) for x in copies} for s, n in {(p["start"], p["length"]) for p in by_doc[key]}}
        assert all(p["ids_crc32"] in wanted[p["start"], p["length"]] for p in by_doc[key])
        assert sum(p["length"] for p in by_doc[key]) == key[1] * len(copies)
        if len(copies) == 1:
            at = 0
            for p in sorted(by_doc[key], key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    padding = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("rows", [EDGES, random_docs(150, 2), []], ids=["edges", "random", "empty"])
def test_pack_round_trip(spark, rows):
    pieces = packing.pack(docs(spark, rows).repartition(2)).collect()
    assert check_packing(rows, pieces) == 0


def brute_level(levels, top, up):
    """Tries every level, and a new window, and counts the whole sum of squares."""
    best = None
    for h in range(top - up + 1):
        if h and not levels[h]:
            continue
        after = list(levels)
        if h:
            after[h] -= 1
        if h + up < top:
            after[h + up] += 1
        rank = sum(x * x for x in after[1:top]), -h
        best = min(best or (rank, h), (rank, h))
    return best[1]


@pytest.mark.parametrize(("window", "unit"), [(64, 1), (4096, 32)])
def test_packer_places_by_the_sum_of_squares(window, unit):
    r = random.Random(31)
    p = packing.Packer(window)
    assert p.unit == unit
    for _ in range(1500):
        n = min(window - 1, int(r.expovariate(4 / window)) + 1)
        assert p.level_for(n) == brute_level(p.levels.tolist(), p.top, -(-n // unit))
        list(p.add(0, np.zeros(n, np.uint32)))


def test_packer_covers_every_id():
    r = random.Random(32)
    for window in (64, 100, 4096):
        p, rows, sizes = packing.Packer(window), [], []
        for n in range(700):
            sizes.append(int(r.expovariate(3 / window)) + 1)
            rows += p.add(n, np.full(sizes[-1], n, np.uint32))
        placed = p.sequence
        rows += p.finish()
        assert (p.sequence - placed) < 0.1 * p.sequence  # what is made of open windows in the end
        assert {x[4] for x in rows if x[6]} == set(range(placed, p.sequence))
        fill, length = defaultdict(int), defaultdict(int)
        for doc, start, n, _, seq, at, _ in rows:
            assert fill[seq] == at and length[doc] == start or doc
            fill[seq] += n
            length[doc] += n
        assert [length[n] for n in range(700)] == sizes
        assert all(f == window or f & (f - 1) == 0 for f in fill.values())


def test_other_tokenizer_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, words = packing.tokenizer_of(path), packing.tokenizer_of(public_tokenizers.path("word_bpe_49k.json"))
    assert type(whole) is packing.WholeTokenizer and type(words) is packing.WordTokenizer
    text = "Some Text, with  CAPITALS\n"
    assert next(iter(whole.encode([text]))).tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.pack(docs(spark, [(1, text)]), path).first()["doc_tokens"] == len(whole.tokenizer.encode(text).ids) + 1


def test_word_tokenizer_forgets(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 10)
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for _, text in EDGES + random_docs(30, 3):
        got = next(iter(t.encode([text or ""])))
        assert got.tolist() == t.tokenizer.encode(text or "", add_special_tokens=False).ids


# Licences


def test_license_variants(spark):
    mit = license_texts.TEXTS[0][1]
    bsd = dict(license_texts.TEXTS)["BSD-3-Clause"]
    gpl = dict(license_texts.TEXTS)["GPL-3.0-or-later"]
    commented = "\n".join(f" * {x}".rstrip() for x in gpl.split("\n"))
    rows = [
        (1, mit), (2, "Copyright (c) 2019 Some One\n\n" + mit.upper()),
        (3, mit.replace("sublicense", "sub-license").replace(" ", "\n  ")),
        (4, bsd.replace("copyright holder", "Copyright Owner").replace(",", "")), (5, mit + " or not"), (6, None), (7, ""),
        (8, "some text\nLicenced under the MIT license\nmore\nAll rights reserved!\nlicensed under the mit licence."), (8, mit),
        (9, "© 2020 X\nThis is free and unencumbered software"),
        (10, f"/*\n * Copyright 2020 Some One\n *\n{commented}\n *\n * Other words\n */\nint main() {{}}\n\n{mit}\n\nend"),
    ]
    got = {tuple(r)[:1] + tuple(r)[2:] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == {
        (1, "MIT", "MIT", ""), (2, "MIT", "MIT", ""), (3, "MIT", "MIT", ""), (4, "BSD-3-Clause", "BSD-3-Clause", ""),
        (5, None, "", ""), (6, None, "", ""), (7, None, "", ""), (8, None, "", "MIT,All-Rights-Reserved"),
        (8, "MIT", "MIT", ""), (9, None, "", ""), (10, None, "GPL-3.0-or-later,MIT", ""),
    }
    assert license_scan.scan(docs(spark, [])).count() == 0
    assert license_scan.scan(docs(spark, [*EDGES, (1, mit), (1, mit), (1, mit + " ")])).count() == len(EDGES) + 3


def test_digests_are_those_of_the_publishers_files(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    folder = "/usr/share/common-licenses"
    found = {k: f"{folder}/{f}" for k, f in names.items() if os.path.exists(f"{folder}/{f}")}
    rows = [(n, open(f, encoding="utf-8").read().replace(",", " ,")) for n, f in enumerate(found.values())]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == dict(enumerate(found))


# SimHash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in WHITE else c for c in lower).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("rows", [EDGES, random_docs(150, 4), [], [(None, "x")]], ids=["edges", "random", "empty", "nulls"])
def test_near_duplicates(spark, rows):
    got = sorted(map(str, simhash.near_duplicates(docs(spark, rows)).collect()))
    fps = [brute_fingerprint(t) for _, t in rows]
    root = roots_of(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        least[root[f]] += [i] if i is not None else []
    want = [(i, f"{f:016x}", min(least[root[f]], default=None)) for (i, _), f in zip(rows, fps)]
    assert got == sorted(f"Row(doc_id={i}, fingerprint={f!r}, component_id={c})" for i, f, c in want)


def test_links_connect_what_brute_force_links(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 6))) for b in base for _ in range(6)]
    fps += [base[0] ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)]  # a dense group
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    edges = simhash.links(simhash.signatures(spark.createDataFrame([(f,) for f in fps], "fp long")))
    got = {x["node"]: x["root"] for x in components(edges).collect()}
    want = roots_of(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {f: got.get(f, f) for f in fps} == want


def test_one_of_each_component_stays(spark):
    rows = random_docs(80, 6)
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(docs(spark, rows)).collect()}
    assert kept == {r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert untouched(simhash.without_near_duplicates(docs(spark, EDGES)))
    assert simhash.without_near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    """Nodes of many edges take the way without a shuffle; the classes are the same."""
    monkeypatch.setattr(shared, "HEAVY", 5)
    r = random.Random(40)
    edges = [(h, r.randrange(1000)) for h in (3, 500, 900) for _ in range(60)] + [(i, i + 1) for i in range(2000, 2030)]
    nodes = sorted({x for e in edges for x in e})
    pairs = {frozenset(e) for e in edges}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots_of(nodes, lambda a, b: frozenset((a, b)) in pairs)


# Passages


def words_of(t):
    return tuple("".join(c if c.isalnum() else " " for c in t.lower()).split())


def pieces_of(text):
    return [w for w in map(words_of, text.split("\n")) if len(w) >= passages.LEAST_WORDS]


def test_every_shared_run_of_50_words_is_found():
    r = random.Random(12)
    for _ in range(200):
        shared = [f"s{r.randrange(40)}" for _ in range(50)]
        around = lambda: [f"a{r.randrange(1000)}" for _ in range(r.randrange(60))]
        keys = []
        for _ in range(2):
            w = [*around(), *shared, *around()]
            keys.append(set(passages.Pieces([b"other text", " ".join(w).encode(), b"more"]).ids.to_pylist()))
        assert keys[0] & keys[1]


def jaccard(a, b):
    x, y = ({p[i : i + 5] for i in range(len(p) - 4)} for p in (a, b))
    return len(x & y) / len(x | y)


def test_bands_meet_at_the_similarity_that_links():
    """Of lines with a Jaccard similarity of just 0.8 or more, whatever their length, nearly all share a band."""
    r, met, some = random.Random(13), 0, 0
    bands, each = passages.tuned()
    for n in [25, 40, 60, 100, 200] * 60:
        a = [f"w{r.randrange(400)}" for _ in range(n)]
        b = list(a)
        while True:
            c = list(b)
            c[r.randrange(n)] = f"x{r.randrange(400)}"
            if jaccard(tuple(a), tuple(c)) < 0.8:
                break
            b = c
        p = passages.Pieces([" ".join(a).encode(), " ".join(b).encode()])
        grams, begin = p.grams(np.flatnonzero(p.kind == 0))
        one, two = passages.band_values(grams >> np.uint64(32), begin, bands, each, 0)
        some, met = some + 1, met + bool((one == two).any())
    assert met >= 0.97 * some


def test_group_edges_against_brute_force():
    r = random.Random(14)
    for _ in range(60):
        base = [frozenset(r.sample(range(60), 30)) for _ in range(3)]
        sets = [frozenset([x for x in r.choice(base) if r.random() > 0.06] + r.sample(range(60), 2)) for _ in range(25)]
        ids = [bytes([n]) for n in range(25)]
        edges = {frozenset(e) for e in passages.group_edges(ids, sets, 0.8)}
        assert all(passages.jaccard(sets[ids.index(a)], sets[ids.index(b)]) >= 0.8 - 1e-9 for a, b in map(tuple, edges))
        want = roots_of(ids, lambda a, b: passages.jaccard(sets[a[0]], sets[b[0]]) >= 0.8 - 1e-9)
        assert roots_of(ids, lambda a, b: frozenset((a, b)) in edges) == want


def test_passages_against_brute_force(spark):
    rows = random_docs(60, 8)
    filler = "filler goes on and on about nothing in particular here"
    shared = "the shared passage runs on for many words so that it can be found in the middle. It has a second sentence that is long enough as well. And then a third one that closes all of it at last, after which some further words follow so that there are fifty of them or a few more than that."
    rows += [(1000, f"opening {filler} one {shared} closing alpha"), (1001, f"start {' '.join(f'other{i}' for i in range(40))} two {shared} ending beta"), (1002, "all of this text stands by itself and nobody else has ever written such words")]
    r = random.Random(11)
    for n in range(12):  # long lines with an edit in the middle or a few at an end
        w = [f"q{r.randrange(300)}" for _ in range(80)]
        rows += [(2000 + 2 * n, " ".join(w)), (2001 + 2 * n, " ".join(w[:40] + ["new"] + w[40 + n % 2 :] + ["end"] * (n % 3)))]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    group = {}
    texts = dict(rows)
    for r in got:
        piece = words_of(texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]])
        assert group.setdefault(piece, r["group_id"]) == r["group_id"]
    holders, lines = defaultdict(set), set()
    for i, t in rows:
        for p in pieces_of(t):
            holders[p].add(i)
            lines.add(p)
    for p, ids in holders.items():
        assert len(ids) < 2 or p in group, p

    lines, close = sorted(lines), 0
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if jaccard(a, b) >= 0.8 and len(holders[a] | holders[b]) > 1:
                close += 1
                assert group.get(a) == group.get(b) is not None
    assert close > 5
    assert {1000, 1001} <= {r["doc_id"] for r in got} and 1002 not in {r["doc_id"] for r in got}
    kept = defaultdict(list)
    for r in got:
        kept[r["group_id"]].append((r["doc_id"], r["start"], r["kept"]))
        assert (r["keep_doc_id"], r["keep_start"]) <= (r["doc_id"], r["start"])
    assert all([k for *_, k in sorted(v)].count(True) == 1 and sorted(v)[0][2] for v in kept.values())
    cut = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs(spark, rows)).collect()}
    assert len(cut) == len(rows) and shared in cut[1000] and shared not in cut[1001] and len(cut[1001]) < len(texts[1001]) - 60 and cut[1001].startswith("start") and cut[1001].endswith("beta")


def test_shared_passages_are_found_whole(spark):
    """Whatever stands around a passage of 50 words or more, all of it is reported in both documents and cut from one."""
    r = random.Random(21)
    rows, want = [], {}
    for n in range(40):
        shared = " ".join(f"s{n}x{i}" for i in range((50, 55, 60, 100, 200)[n % 5]))
        for k in (2 * n, 2 * n + 1):
            before, after = (" ".join(f"{side}{k}y{i}" for i in range(r.randrange(60, 90))) for side in "ab")
            rows.append((k, f"{before} {shared}, {after}"))
            want[k] = before, shared, after
    # An earlier document that holds a part only doesn't shorten what the two others share.
    part = " ".join(want[9][1].split()[70:130])
    rows.append((-1, f"quite another start {part} and another end"))
    got = passages.repeated_passages(docs(spark, rows)).collect()
    texts = dict(rows)
    said = {(x["doc_id"], texts[x["doc_id"]][x["start"] : x["start"] + x["n_chars"]]) for x in got}
    assert all((k, shared) in said for k, (_, shared, _) in want.items())
    cut = {x["doc_id"]: x["text"].replace(",", " ").split() for x in passages.without_repeats(docs(spark, rows)).collect()}
    for k, (before, shared, after) in want.items():
        whole = [*before.split(), *(w for w in shared.split() if k % 2 == 0 and not (k == 8 and w in part.split())), *after.split()]
        assert cut[k] == whole, k


def test_short_lines_and_wrapped_paragraphs(spark):
    words = [f"w{i}" for i in range(70)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    near = [*words[:30], "changed", *words[31:]]
    short = "Five words are a line"
    rows = [(0, f"opening of it\n{short}\n\n{wrap(words, 13)}"), (1, f"{' '.join(words)}\nother end"), (2, f"{wrap(near, 17)}\n\n{short.upper()}!"), (3, f"{short}\nof this document alone")]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    texts = dict(rows)
    said = defaultdict(dict)
    for x in got:
        said[words_of(texts[x["doc_id"]][x["start"] : x["start"] + x["n_chars"]])][x["doc_id"]] = x
    assert {k: v["kept"] for k, v in said[words_of(short)].items()} == {0: True, 2: False, 3: False}
    whole = {**said[tuple(words)], **said[tuple(near)]}
    assert {k: v["kept"] for k, v in whole.items()} == {0: True, 1: False, 2: False}
    assert len({v["group_id"] for v in whole.values()}) == 1
    cut = {x["doc_id"]: words_of(x["text"]) for x in passages.without_repeats(docs(spark, rows)).collect()}
    assert cut == {0: words_of(texts[0]), 1: ("other", "end"), 2: (), 3: ("of", "this", "document", "alone")}


def test_passages_at_the_edges(spark):
    got = passages.repeated_passages(docs(spark, EDGES)).collect()
    assert {r["doc_id"] for r in got} == {8, 9}
    assert passages.repeated_passages(docs(spark, [])).count() == 0
    left = passages.without_repeats(docs(spark, EDGES))
    assert left.count() == len(EDGES) and untouched(left)


def variants(r, families, each, words, changes):
    """Lines of some families, each line a family's base with a few words changed."""
    rows = []
    for f in range(families):
        base = [f"f{f}w{r.randrange(90)}" for _ in range(words)]
        for n in range(each):
            w = list(base)
            for k in r.sample(range(words), r.randint(0, changes)):
                w[k] = f"x{n}y{k}"
            rows.append((1000 * f + n, " ".join(w)))
    return rows


def classes_of(rows, got):
    whole = {r["doc_id"]: r["group_id"] for r in got if r["start"] == 0 and r["n_chars"] == len(dict(rows)[r["doc_id"]])}
    out = defaultdict(set)
    for i, g in whole.items():
        out[g].add(i)
    return sorted(map(sorted, out.values()))


def linked_classes(rows):
    words = {i: tuple(t.split(" ")) for i, t in rows}
    root = roots_of(sorted(words), lambda a, b: a // 1000 == b // 1000 and jaccard(words[a], words[b]) >= 0.8)
    out = defaultdict(set)
    for i, g in root.items():
        out[g].add(i)
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


def test_near_lines_against_brute_force(spark):
    """Many variants of one line, none of them the original, are the classes that all pairs' similarity makes."""
    rows = variants(random.Random(9), 3, 40, 150, 3)
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert classes_of(rows, got) == linked_classes(rows) and len(linked_classes(rows)) >= 3


@pytest.mark.parametrize("levels", [0, 1])
def test_large_bands_go_by_hubs_and_other_bands(spark, monkeypatch, levels):
    """With hardly a band worked off in one task, the classes are the same."""
    rows = variants(random.Random(10), 2, 25, 120, 4)
    monkeypatch.setattr(passages, "MOST_MEMBERS", 2)
    monkeypatch.setattr(passages, "LEVELS", levels)
    assert classes_of(rows, passages.repeated_passages(docs(spark, rows)).collect()) == linked_classes(rows)


def test_bands_are_tuned():
    bands, rows = passages.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= passages.RECALL


def test_written_columns_do_not_leak(spark):
    assert packing.pack(docs(spark, EDGES)).columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    assert docs(spark, EDGES).select(F.count("*")).first()[0] == len(EDGES)
