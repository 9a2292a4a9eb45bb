"""Benchmark passages, hard negatives and periodic runs against brute force, planted cases and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import contamination, entries, negatives, runs

ODD = [(900, None), (901, ""), (902, " \n "), (None, "no id but some words here"), (903, "É😀 " * 3), (904, "x" * 50000), (905, "same words five or six here"), (905, "same words five or six here")]


# --------------------------------------------------------------------------- benchmark passages


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, k=10):
    own = plain(text)
    hit, found = set(), set()
    for item, words in ((i, plain(t)) for i, t in items):
        for w in range(max(1, len(words) - k + 1) if words else 0):
            window = words[w : w + k]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    return len(own), sorted(hit), sorted(str(i) for i in found if i is not None)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "ça", "d4", "É", "ff", "g"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 12, 25])))) for i in range(12)] + [(12, None), (13, "!!!"), (3, "Z1 z2"), (None, "only here once"), (14, "Z1, z2")]
    docs = [(i, ", ".join(word() for _ in range(rng.randrange(80)))) for i in range(40)] + ODD
    docs += [(950 + i, f"before ... {t} -- after") for i, t in items if i is not None and t] + [(990, "ONLY-here/once z1 Z2.")]
    return docs, items


@pytest.mark.parametrize("most", [contamination.MOST, 20])
def test_contamination_brute(spark, leaks, most):
    docs, items = leaks
    frame = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, hits int, items string")
    got = contamination.scan(frame, spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert got.columns == ["doc_id", "text", "hits", "items", "n_words", "hits_", "items_"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, found = brute_hits(r["text"], items)
        assert r["n_words"] == n and r["items_"] == found
        assert [i for h in r["hits_"] for i in range(h["first"], h["last"])] == hit
        for h in r["hits_"]:  # code points of the original text
            assert plain(r["text"][h["start"] : h["end"]]) == plain(r["text"])[h["first"] : h["last"]]


def test_contamination_report(spark, leaks):
    docs, items = leaks
    made = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.judge(spark.createDataFrame(docs, "doc_id long, text string"), made)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted((str(d), n, len(h), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(h)) for d, t in docs for n, h, f in [brute_hits(t, items)])
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    left = contamination.without(spark.createDataFrame(docs, "doc_id long, text string"), made)
    assert sorted(str(r[0]) for r in left.collect()) == sorted(str(d) for d, t in docs if not brute_hits(t, items)[1])
    empty = contamination.judge(spark.createDataFrame(docs, "doc_id long, text string"), made.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r["contaminated"] for r in empty)
    assert contamination.judge(spark.createDataFrame([], "doc_id long, text string"), made).count() == 0


# --------------------------------------------------------------------------- hard negatives


def brute_negatives(rows, positives=5, k=10):
    rows = [(i, str(lab), [int(np.floor(x * 256)) for x in v]) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in rows:
        if a % 10:
            continue
        score = lambda u: sum(x * y for x, y in zip(u, v, strict=True))  # noqa: B023, E731
        near = sorted(((-score(u), i) for i, own, u in rows if i != a and own == lab))[:positives]
        far = sorted((-score(u), i) for i, own, u in rows if i != a and own != lab)
        for p, i in near:
            inside = [(n, j) for n, j in far if 30 * -p <= 100 * -n <= 90 * -p][:k]
            out += [(a, i, r, j, -p, -n) for r, (n, j) in enumerate(inside, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    centres = r.standard_normal((4, 6))
    rows = [(i, (centres[i % 4] + 0.7 * r.standard_normal(6)).tolist(), int(r.integers(0, 4)) if i % 3 else i % 4) for i in range(600)]
    rows += [(600 + i, rows[20][1], i % 2) for i in range(200)]  # one very frequent vector
    odd = [(900, None, 1), (910, rows[0][1], None), (920, [float("nan")] * 6, 1), (930, [None] + [1.0] * 5, 2), (940, [0.0] * 6, 1), (950, [1.0], 2)]
    return rows + odd[:5], odd[5]


@pytest.mark.parametrize("block", [negatives.BLOCK, 100])
def test_negatives_brute(spark, vectors, block):
    rows, short = vectors
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, short]], "vec_id long, embedding array<double>, label int, slot string")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_negatives_wide(spark, vectors):
    rows = [(i, [x * (1e6 if i % 20 == 10 else 1) for x in v], lab) for i, v, lab in vectors[0][:60]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0).collect()) == brute_negatives(rows)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_tree_bounds():
    r = np.random.default_rng(1)
    values = np.floor(r.standard_normal((3000, 8)) * 100)
    tree = negatives.Tree(np.arange(3000), values, np.zeros(3000, int))
    asked = negatives.Asked(tree, values[:5])
    for i in range(5):
        score = values @ values[i]
        for node, rows in tree.rows.items():
            assert asked.worst[i, node] <= score[rows].min() and score[rows].max() <= asked.best[i, node]
        every = asked.nearest(i, lambda x: np.ones(len(x), bool), -500, 900)
        inside = [k for k in range(3000) if -500 <= score[k] <= 900]
        assert list(every) == sorted(((k, int(score[k])) for k in inside), key=lambda x: (-x[1], x[0]))


# --------------------------------------------------------------------------- periodic runs


def brute_runs(w, least=runs.LEAST):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        k = 0
        while k < len(w) - q:
            j = k
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > k and j + q - k >= max(least, 3 * q):
                out.setdefault((k, j + q), q)
            k = max(j, k + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def loops(rng, kinds, most):
    out = []
    while len(out) < most:
        unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 9))]
        out += unit * rng.randint(1, 9)
        if rng.random() < 0.4:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(1, 60)]
    return out


def test_runs_brute():
    rng = random.Random(2)
    some = 0
    for _ in range(400):
        w = loops(rng, rng.choice([1, 2, 3, 6]), rng.randrange(150))
        want = brute_runs(w)
        some += len(want)
        assert runs.runs(w) == want
        assert runs.runs_of([" ".join(map(str, w)).encode()]) == [want]  # with the cut before
    assert some > 300


def test_factors():
    rng = random.Random(4)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(rng.randrange(60))]
        at = 0
        for b, e, source in runs.factors(w):
            longest = max((k for s in range(b) for k in [next(j for j in range(len(w) - b + 1) if b + j == len(w) or w[s + j] != w[b + j])]), default=0)
            assert b == at and e - b == max(1, longest)
            assert source < 0 or (source < b and w[source : source + e - b] == w[b:e])
            at = e
        assert at == len(w)


def brute_report(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    got = brute_runs(words)
    gone = {i for s, e, q in got for i in range(s + q, e)}
    best = max(got, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    text = "".join(f"{s},{e - s},{q}\n" for s, e, q in got)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (str(doc), len(got), *head, sha(text), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_report(spark):
    rng = random.Random(9)
    docs = [(i, "\t".join(f"w{x}" for x in loops(rng, rng.choice([2, 4, 40]), rng.randrange(200)))) for i in range(120)] + ODD
    docs += [(i, " ".join(f"u{i}x{k}" for k in range(rng.randrange(400)))) for i in range(200, 260)] + [(300, "a " * 5000), (301, ("b c " * 40 + "d ") * 30)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, runs string")
    got = runs.report(runs.looped(frame))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(((str(r[0]), *r[1:]) for r in got.collect()), key=str) == sorted((brute_report(*d) for d in docs), key=str)
    assert runs.find(frame).columns == ["doc_id", "text", "runs", "runs_", "collapsed"]
    assert runs.report(runs.looped(frame.limit(0))).count() == 0


def test_new_entries_have_sql():
    assert {"op11_aho_corasick", "op12_vantage_negatives", "op13_periodic_runs"} <= set(entries.queries()) & set(entries.oracle_sql())
