"""Decontamination, toxicity and the pipeline."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from meterstone.llm import decontaminate, exact_dedup, packing, queries, simhash, toxicity

from .test_documents import EDGES, check_packing, docs, random_docs, untouched

SF = "/root/testdata/sf0.001"


def slow_best(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def plain(t):
    return " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))


def test_best_distance():
    r = random.Random(1)
    for _ in range(300):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randint(n, 12))) for n in (1, 0))
        assert decontaminate.best_distance(p, t) == slow_best(p, t)


def test_word_hashes_do_not_depend_on_the_place():
    _, _, a = decontaminate.words_of("one two, three".encode())
    _, _, b = decontaminate.words_of("xx! three/one két two".encode())
    assert (b[1], b[2], b[4]) == (a[2], a[0], a[1]) and len(set(a.tolist())) == 3
    assert len(decontaminate.words_of(b"")[0]) == 0


@pytest.fixture(scope="module")
def planted():
    r = random.Random(2)
    text = {i: t for i, t in random_docs(40, 10)}
    words = [f"it{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    items = [(n, " ".join(r.choice(words) for _ in range(r.choice((6, 14, 30, 60)))).capitalize() + ".") for n in range(30)]
    for n, (item, t) in enumerate(items[:24]):
        w = t.split()
        for _ in range(len(w) * (n % 3) // 24):
            w[r.randrange(len(w))] = r.choice(words)
        host = text[n].split(" ")
        at = r.randrange(len(host))
        text[n] = " ".join(host[:at] + w + host[at:])
    return list(text.items()), [*items, (90, None), (91, ""), (92, "two words")]


def test_contaminated_against_brute_force(spark, planted):
    rows, items = planted
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    want = {}
    for i, t in rows:
        for n, x in items:
            p = plain(x)
            if len(p.split()) >= decontaminate.LEAST_WORDS:
                d = slow_best(p, plain(t))
                if 1 - d / len(p) >= decontaminate.SIMILARITY:
                    want[i, n] = d
            elif p and f" {p} " in f" {plain(t)} ":
                want[i, n] = 0
    assert len(want) >= 20 and set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)
    assert all(got[k]["edit_distance"] == want[k] for k in got)
    assert all((n, n) in got for n in range(0, 24, 3))  # copies without edits
    left = decontaminate.without_contaminated(docs(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in got} and untouched(left)


def test_blocks_of_items(spark, planted, monkeypatch):
    rows, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), bench).collect())) == whole


def test_contaminated_at_the_edges(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon")], "item_id long, text string")
    rows = [*EDGES, (None, "x alpha  BETA gamma, delta epsilon y"), (4, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon")]
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), r["edit_distance"]) for r in got) == [("4", 0), ("4", 0), ("None", 0)]
    assert decontaminate.without_contaminated(docs(spark, rows), bench).count() == len(EDGES)
    assert decontaminate.contaminated(docs(spark, EDGES), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def edited(r, t, kind, share, words):
    """An item with edits to a share of its characters (half of them substitutions), its words, or one letter of its words."""
    if kind == "char":
        out = []
        for c in t:
            u = r.random() / share
            out.append(c if u >= 1 else r.choice("abcdefgh") if u < 0.5 else c + r.choice("abcdefgh") if u < 0.75 else "")
        return "".join(out)
    w = t.split()
    for at in r.sample(range(len(w)), max(1, round(share * len(w)))):
        letter = r.randrange(len(w[at]))
        w[at] = r.choice(words) if kind == "word" else w[at][:letter] + "z" + w[at][letter + 1 :]
    return " ".join(w)


def recall_at(n, kind, share, items=80, seed=5):
    """Of all items of n words that stand in a text at a similarity of 0.8 or more after such edits, the share found."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}{d}" for a in "bdfghk" for b in "aeiou" for c in "lmnrst" for d in ("", "a", "en", "ion", "ity")]
    words += ["the", "of", "and", "to", "in", "a", "is"] * 60
    known = [(k, " ".join(r.choice(words) for _ in range(n))) for k in range(items)]
    index, texts, want = decontaminate.ItemIndex(known), [], []
    for k, t in known:
        around = [r.choice(words) for _ in range(200)]
        at = r.randrange(200)
        texts.append(" ".join([*around[:at], edited(r, t, kind, share, words), *around[at:]]).encode())
        if 1 - decontaminate.best_distance(t, texts[-1].decode()) / len(t) >= 0.8:
            want.append((k, k))
    got = {(d, i) for d, i, *_ in index.search(list(range(items)), texts, 0.8)}
    return len(want), sum(x in got for x in want) / max(1, len(want))


EDITS = [("char", 0.03), ("char", 0.1), ("char", 0.19), ("typo", 0.2), ("typo", 1.0), ("word", 0.15), ("word", 0.2)]


@pytest.mark.parametrize("n", [5, 6, 8, 11, 23, 47, 95])
@pytest.mark.parametrize(("kind", "share"), EDITS)
def test_recall_of_every_length(n, kind, share):
    some, found = recall_at(n, kind, share)
    assert some > 15 and found >= decontaminate.RECALL


def test_short_items_and_scripts_without_spaces():
    some = [(1, "two words"), (2, "日本語のテキスト"), (3, ""), (4, None), (5, "漢字"), (6, "ni hao 漢字")]
    index = decontaminate.ItemIndex(some)
    texts = ["some two, words here", "これは日本語のテクストです。", "x漢字y", "two other words", "two wordsx"]
    got = sorted(index.search(list(range(5)), [t.encode() for t in texts], 0.8))
    assert got == [(0, 1, 0, 1.0), (1, 2, 1, 0.875), (2, 5, 0, 1.0)]


# Toxicity


def test_swaps_stay_in_kind():
    assert toxicity.swapped("a plain sentence".split(), 0) is None
    for turn in range(4):
        s = toxicity.swapped("the muslim woman spoke".split(), turn)
        assert s[1] in toxicity.IDENTITY["religion"] and s[1] != "muslim"
        assert s[2] in toxicity.IDENTITY["gender"] and s[2] != "woman"


def labelled(spark, n=600, seed=4):
    """Sentences in which insults are toxic, and in which one group is mentioned mostly in toxic ones."""
    r = random.Random(seed)
    plain_words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.4
        w = [r.choice(plain_words) for _ in range(20)]
        if toxic and r.random() < 0.8:
            w[r.randrange(20)] = r.choice(["idiotic", "moronic"])
        if r.random() < (0.6 if toxic else 0.1):
            w[r.randrange(20)] = "muslim"
        elif r.random() < 0.3:
            w[r.randrange(20)] = "christian"
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counterfactuals_even_out_group_mentions(spark, monkeypatch):
    """With the weight as shipped, neutral mentions of the group that toxic texts name most are scored like others, and fewer
    of them are taken for toxic."""
    d, y = labelled(spark)
    gap, wrong = {}, {}
    r = random.Random(6)
    neutral = [" ".join(r.choice([f"word{i}" for i in range(60)]) for _ in range(12)) for _ in range(300)]
    for weight in (0.0, toxicity.CF_WEIGHT):
        monkeypatch.setattr(toxicity, "fit", lambda *a, w=weight, f=fit: f(*a, cf_weight=w))
        score = toxicity.train(d, y).scorer()
        gap[weight] = score("a muslim spoke to us") - score("a christian spoke to us")
        wrong[weight] = sum(score(f"{t} muslim") >= 0.5 for t in neutral)
        assert score("what an idiotic thing") > 0.5
    assert gap[toxicity.CF_WEIGHT] < gap[0.0] / 2 and wrong[toxicity.CF_WEIGHT] < 0.5 * wrong[0.0]


def test_fit_against_a_plain_optimiser():
    """The accelerated steps end where plain gradient descent on the same loss does."""
    r = np.random.default_rng(8)
    rows = [sorted(set(r.integers(0, 12, 4).tolist())) for _ in range(80)]
    labels = np.array([int(0 in x or r.random() < 0.2) for x in rows])
    pairs = [(x, sorted({*x} ^ {1, 2})) for x in rows[:30]]
    got, bias = toxicity.fit(rows, labels, pairs, 12, rounds=3000)
    x, a, b = (np.array([[float(j in q) for j in range(12)] for q in some]) for some in (rows, *zip(*pairs)))
    w, c = np.zeros(12), 0.0
    for _ in range(60_000):
        p, pa_, pb = (1 / (1 + np.exp(-(m @ w + c))) for m in (x, a, b))
        da, db = (s * 2 * toxicity.CF_WEIGHT * (pa_ - pb) * q * (1 - q) for s, q in ((1, pa_), (-1, pb)))
        w -= 0.01 * (x.T @ (p - labels) + a.T @ da + b.T @ db + toxicity.L2 * w)
        c -= 0.01 * ((p - labels).sum() + da.sum() + db.sum())
    assert np.abs(got - w).max() < 0.02 and abs(bias - c) < 0.02


def test_filter_keeps_all_without_evidence(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    only = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for y in (none, only):
        left = toxicity.without_toxic(docs(spark, EDGES), toxicity.train(docs(spark, EDGES), y))
        assert left.count() == len(EDGES) and untouched(left)


fit = toxicity.fit


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(read("labels"), "doc_id").where("held_out").select("score", "predicted", "toxic", F.lit(1)).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got.predicted[got.toxic == 0].mean() < 0.02 and got.score.between(0, 1).all()


def test_toxicity_at_the_edges(spark):
    y = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (99, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, EDGES), y)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.toxicity(docs(spark, []), y.limit(0)).count() == 0


def test_scores_go_beside_columns_of_any_name(spark):
    model = toxicity.Model({"=alpha": 0}, np.array([9.0]), -4.0)
    got = toxicity.scored(docs(spark, EDGES), model)
    assert got.columns[-1] == "score_1" and untouched(got.drop("score_1"))
    left = toxicity.without_toxic(docs(spark, EDGES), model)
    assert untouched(left) and left.count() == len(EDGES) - 5  # those with alpha


def test_fit_of_one_label_or_none():
    assert toxicity.fit([], np.array([]), [], 3)[1] == 0 and toxicity.fit([[0]], np.array([0]), [], 3)[1] < 0


# Pipeline


def test_pipeline_against_its_parts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = toxicity.train(rows, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out())
    score = model.scorer()
    left = [(r["doc_id"], r["text"]) for r in rows.collect() if score(r["text"]) < 0.5]
    best = {}
    for i, t in left:
        key = "".join((t or "").split())
        if key not in best or (-len(t or ""), i) < best[key][0]:
            best[key] = (-len(t or ""), i), t
    left = sorted((k[1], t) for k, t in best.values())
    from .test_documents import brute_fingerprint, roots_of

    fps = {i: brute_fingerprint(t) for i, t in left}
    root = roots_of(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    left = [(i, t) for i, t in left if least[root[fps[i]]] == i]
    items = [plain(t) for _, t in bench]
    held = lambda t: any(p in plain(t) for p in items)
    left = [(i, t) for i, t in left if not held(t)]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in left}
    assert check_packing(left, pieces) == 0


def test_stages_keep_the_columns(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    edges = docs(spark, EDGES).select(*rows.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges, SF)
        assert out.columns == rows.columns, name
        assert 0 < out.count() <= len(EDGES)
        assert stage(spark, edges.limit(0), SF).count() == 0
        assert untouched(stage(spark, docs(spark, EDGES), SF)), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    assert exact_dedup and packing and simhash
