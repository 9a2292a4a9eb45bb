"""Goal models by enumeration, grids, studies, text, and streams with state."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodestar import queries, text
from lodestar.operators import grids, splits, stats
from lodestar.plans import goals, search
from lodestar.sources import stored, tables
from lodestar.streaming import folds

DATA = "/root/testdata/sf0.001"


def test_worlds_by_enumeration(spark):
    rig = goals.Rig(spark, queries.goal_model(), ["shipped"], ["fast", "cheap"])
    exact = goals.enumerated(rig.rules, rig.query)
    assert abs(sum(exact.values()) - 1) < 1e-9 and None not in exact
    seen = collections.defaultdict(dict)
    for r in rig.worlds(2000).collect():
        seen[r["world"]][r["atom"]] = r["val"]
    share = collections.Counter(tuple(sorted(w.items())) for w in seen.values())
    assert set(share) == set(exact)
    assert all(abs(n / 2000 - exact[w]) < 0.05 for w, n in share.items())


def test_denial_links_and_replays():
    m = goals.Model()
    a, b, q, r = m.atoms("a b q r")
    a <= b * goals.link("make", q) * goals.link("break", q)  # noqa: B015  contradicts itself: denied, not dead
    assert goals.enumerated(m.rules, "a").keys() == {(("a", "f"),)}
    assert goals.enumerated(m.rules, ("seq", "a", ("is", "a", "t"))).keys() == {None}
    r <= a + b  # noqa: B015
    assert set(goals.enumerated(m.rules, "r")) == {(("a", "f"), ("r", "t")), (("b", "t"), ("r", "t"))}
    assert goals.enumerated(m.rules, "r", {"b": "f"}, True) == {(("b", "f"), ("r", "t")): 1.0}
    loop = goals.Model()
    x, y = loop.atoms("x y")
    x <= y * x  # noqa: B015
    assert goals.sampled(loop.rules, "x", "1") == {"x": "t", "y": "t"}
    assert goals.sampled({}, ("seq", "z", ("is", "z", "f")), "1", patience=3) is None


def test_ddmin_and_keys(spark):
    assert goals.ddmin(lambda sets: [{3, 5} <= set(c) for c in sets], list(range(8))) == [3, 5]
    got = goals.Rig(spark, queries.goal_model(), ["shipped"], ["fast", "cheap"]).run(300, 20)
    assert 0 < got["n_keys"] <= got["candidates"] and got["best"] <= got["mu"] and got["tests"] > 0


def plain_gap(a, b, live, bins):
    known = [abs(a[i] - b[i]) for i in live if a[i] and b[i]]
    return round(sum(known) / ((bins - 1) * len(known)) if known else 1.0, 9)


def test_grids(spark):
    assert grids.row_gap((1, 0, 3), (5, 2, 3), 5) == 0.5 and grids.row_gap((0,), (3,), 5) == 1.0
    items = [tuple(random.Random(i).choices(range(1, 6), k=4)) for i in range(40)]
    rows = spark.createDataFrame([(i, list(x)) for i, x in enumerate(items)], "rid long, codes array<int>")
    gap = lambda codes, lead: grids.code_gap(grids.codes_of([lead])[0], codes, 5)
    cover = {r["rid"]: r["at"] for r in grids.furthest(rows, gap, 0.3).collect()}
    assert set(cover) == set(range(40)) and all(plain_gap(items[i], items[a], range(4), 5) < 0.3 for i, a in cover.items())
    model, leads = grids.Eras(4, 5, 0.25), []
    for i in range(0, 40, 10):
        live = model.live
        for x in items[i : i + 10]:  # one row after another
            if all(plain_gap(x, lead, live, 5) >= 0.25 for lead in leads):
                leads.append(x)
        model.era(rows.where((F.col("rid") >= i) & (F.col("rid") < i + 10)))
        assert model.delegates == leads
    assert sum(model.kin) == 40 and set(model.live) <= set(range(4)) and sorted(j for k in model.constructs.values() for j in k) == [0, 1, 2, 3]
    own = model.assigned(rows)
    for r in own.collect():
        assert r["gap"] == min(plain_gap(items[r["rid"]], e, model.live, 5) for e in leads)
    lines = grids.emit(model, list("abcd"), {0: 0.5}, [(0.5, 0.25, items[0])], eps=0.25)
    back = grids.parse(lines)
    assert back["meta"]["eps"] == "0.25" and len(back["ele"]) == 1 and back["tst"] == [(0.5, 0.25, tuple(items[0][i] for i in model.live))]
    train = spark.createDataFrame([(0, 0.1), (0, 0.3), (1, 0.8)], "delegate int, d double")
    test = spark.createDataFrame([(1, 0, 0.2), (2, 1, 0.1), (3, 2, 0.0)], "rid long, delegate int, d double")
    got = grids.told(train, test, 1).first()
    assert got["best"] == 0.2 and got["mae"] == pytest.approx(0.35) and got["acc"] == 0.5  # nothing is known of delegate 2


def test_sweeps(spark):
    r = random.Random(6)
    rows = [(r.random() * 9, r.random(), r.choice("abc"), r.random(), r.random()) for _ in range(60)]
    rf = tables.from_rows(spark, ["A", "B", "c", "D", "Y-"], [[*x[:2], x[2], "?" if i % 9 == 0 else x[3], x[4]] for i, x in enumerate(rows)])
    every, names = grids.graded(rf)
    codes = {x["rid"]: list(x["codes"]) for x in every.collect()}
    assert names == ["A", "B", "D", "c"] and all(v is None or 0 <= v <= 1 for c in codes.values() for v in c)
    live = [0, 1, 2, 3]

    def gap(a, b):
        known = [(u - v) ** 2 for u, v in zip(a, b, strict=True) if u is not None and v is not None]
        return round((sum(known) / len(known)) ** 0.5 if known else 1.0, 9)

    turned = {i: [codes[j][i] for j in sorted(codes)] for i in live}
    assert grids.column_gaps(every, live) == pytest.approx({(i, j): gap(turned[i], turned[j]) for i in live for j in live if i != j})
    points = grids.anchors(every, live)
    assert 2 <= len(points) <= 4
    mark = dict.fromkeys(codes, 0.0)
    for k, a in enumerate(points):
        for b in points[k + 1 :]:
            c = gap(a["codes"], b["codes"]) + 1e-32
            at = {i: round((gap(v, a["codes"]) ** 2 + c * c - gap(v, b["codes"]) ** 2) / (2 * c), 9) for i, v in codes.items()}
            mid = sorted(at.values())[len(at) // 2]
            for i in at:
                mark[i] += c * abs(at[i] - mid)
    got = {x["rid"]: (x["mark"], x["stays"]) for x in grids.sweep(every, live, points).collect()}
    assert {i: m for i, (m, _) in got.items()} == pytest.approx(mark, abs=1e-6)
    left, columns, spent = grids.squeeze(rf, F.col("`Y-`"), budget=8, least=2, cap=10)
    assert 2 <= left.count() <= 10 and set(columns) <= set(names) and 0 < len(spent) <= 8
    assert {i: spent[i] for i in spent} == {i: rows[i][4] for i in spent}


def test_rest_ranked_by_the_largest_gap(spark):
    r = random.Random(8)
    rows = [("?" if r.random() < 0.2 else r.random(), r.random(), r.random()) for _ in range(70)]
    rf = tables.from_rows(spark, ["A", "B", "Y-"], [list(x) for x in rows])
    _, kept, columns = grids.cells(rf, F.col("`Y-`"), 20)
    every, names = grids.graded(rf)
    codes = {x["rid"]: x["codes"] for x in every.collect()}
    place = [names.index(x["at"]) for x in columns.collect()]
    label = {x["rid"]: x["y"] for x in kept.collect()}
    gap = lambda a, b: round(max((abs(a[i] - b[i]) for i in place if a[i] is not None and b[i] is not None), default=0.0), 12)
    from lodestar.operators.cluster import some

    picked = {x["rid"] for x in some(every, "rid", 20).collect()}
    guess = {i: label[min(label, key=lambda j: (gap(c, codes[j]), j))] for i, c in codes.items() if i not in picked}
    want = sorted(guess, key=lambda i: (round(guess[i], 9), i))[:5]
    got = grids.ranked_rest(rf, F.col("`Y-`"), 20).orderBy("rank").collect()
    assert [x["rid"] for x in got] == want and all(x["guess"] == guess[x["rid"]] for x in got)


def test_prunings_by_tables():
    r = random.Random(1)

    def listed(tree, sums, shapes):
        out = []
        for leaves in tree.prunings(shapes=shapes):
            b = min(leaves, key=lambda i: (tree.stats[i][1], i))
            s, n = sums.get(b, (0.0, 0))
            out.append(((s + tree.stats[b][1]) / (n + 1), len(leaves)))
        return min(out)

    for _ in range(60):
        stats_, cuts = {}, {}

        def grow(i, level, stats_=stats_, cuts=cuts):
            stats_[i] = (5, r.choice([r.random(), 0.5]))
            if level < 3 and r.random() < 0.8:
                cuts[i] = ("x", "<=", 1.0)
                grow(2 * i, level + 1)
                grow(2 * i + 1, level + 1)

        grow(1, 0)
        tree = splits.Tree(cuts, stats_)
        sums = {i: (r.choice([r.random() * 5, 2.0]), r.choice([0, 3, 5])) for i in stats_}
        for shapes in ("all", "spine"):
            got = splits.race(tree, sums, shapes)
            assert got[:2] == listed(tree, sums, shapes) and got[2] in set(tree.prunings(shapes=shapes))
            assert splits.prunings(tree, shapes) == len(list(tree.prunings(shapes=shapes)))
    deep = splits.Tree({i: ("x", "<=", 1.0) for i in range(1, 256)}, {i: (5, r.random()) for i in range(1, 512)})
    assert splits.race(deep, {}, "all")[1] >= 2  # more prunings than could be listed


def test_stored_summaries(spark, tmp_path):
    r = random.Random(3)
    rows = [(i % 5, r.gauss(1e6, 1), r.choice(["x", "y", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v double, s string")
    kept = stored.Summaries(spark, str(tmp_path / "kept"), "k", ["v"], ["s"])
    assert kept.refresh(df.where("k < 3")) == (["0", "1", "2"], []) and kept.refresh(df.where("k < 3")) == ([], [])
    assert kept.refresh(df.where("k <> 1")) == (["3", "4"], ["1"])
    own = [v for k, v, _ in rows if k != 1]
    mu = sum(own) / len(own)
    got = kept.numbers().first()
    assert got["n"] == len(own) and got["mu"] == pytest.approx(mu) and got["sd"] == pytest.approx((sum((v - mu) ** 2 for v in own) / (len(own) - 1)) ** 0.5, rel=1e-6)
    assert {(x["value"], x["n"]) for x in kept.symbols().collect()} == set(collections.Counter(s for k, _, s in rows if k != 1 and s).items())


def test_sessions_and_late_rows(spark, tmp_path):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    files = [[("a", 0, 1.0), ("a", 20, 2.0), ("b", 5, 4.0)], [("a", 45, 8.0), ("b", 300, 16.0), ("a", 600, 32.0)], [("b", 310, 64.0), ("a", 50, 128.0)]]
    for i, rows in enumerate(files):
        made = spark.createDataFrame([(k, at(m), v) for k, m, v in rows], "k string, t string, v double").select("k", F.col("t").cast("timestamp").alias("t"), "v")
        made.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = lambda: spark.readStream.schema("k string, t timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    taken, late = [], []
    part = folds.Late(str(tmp_path / "newest"), "t", "4 HOURS", lambda df, n: taken.extend(r["v"] for r in df.collect()), lambda df, n: late.extend(r["v"] for r in df.collect()))
    q = source().writeStream.foreachBatch(part).option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(late) == [64.0, 128.0] and len(taken) == 6  # older than 10:00 less four hours
    q = folds.sessions(source(), "k", "t", "v", "30 minutes", "4 hours").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["key"], str(r["start"])[11:16], r["n"], r["total"]) for r in spark.table("sessions").collect()}
    # sessions that the watermark has closed, as a batch has them: rows that came late found theirs still open
    every = spark.read.schema("k string, t timestamp, v double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    batch = {(r["key"], str(r["start"])[11:16], r["n"], r["total"]) for r in folds.sessions(every, "k", "t", "v", "30 minutes").collect()}
    assert got == batch - {("a", "10:00", 1, 32.0)} and len(got) == 3


def test_leaders_in_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(5)
    rows = [(r.choice("ab"), i, [r.random() * 3, r.random()]) for i in range(60)]
    put = lambda where, part: spark.createDataFrame(part, "k string, rid long, v array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / where))

    def run(where, cp, name):
        stream = spark.readStream.schema("k string, rid long, v array<double>").parquet(str(tmp_path / where))
        q = folds.kept_leaders(stream, "k", 0.6).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))

    put("twice", rows[:25])
    run("twice", "cp1", "out1")
    put("twice", rows[25:])
    put("once", rows)
    got = run("twice", "cp1", "out1")  # starts again from its checkpoint
    assert got == run("once", "cp2", "out2")
    leads = collections.defaultdict(list)
    want = []
    for k, rid, v in rows:
        d, at = min(((max(abs(a - b) for a, b in zip(v, lead, strict=True)), i) for i, (_, lead) in enumerate(leads[k])), default=(9.0, -1))
        if d > 0.6:
            leads[k].append((rid, v))
            d, at = 0.0, len(leads[k]) - 1
        want.append((k, rid, leads[k][at][0], d))
    assert got == sorted(want)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_mutate_and_synthesize(spark):
    rf = queries.view(spark, DATA, "order")
    new = {r["rid"]: r for r in search.mutated(rf, 1).collect()}
    old = {r["rid"]: r for r in rf.df.collect()}
    assert new.keys() == old.keys() and all(sum(new[i][c] != old[i][c] for c in rf.schema.x) <= 1 for i in new)
    leaf = F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(3)
    made = search.synthesized(rf, leaf, 200).collect()
    assert len(made) == 200 and all((r["c_mktsegment"] == "BUILDING") == (r["leaf"] == 2) for r in made)


def test_text():
    knobs = text.settings("\n  -budget  labels = 50\n  -far  share = .9\n  -quiet  hush = False\n")
    assert knobs == {"budget": 50, "far": 0.9, "quiet": False} and knobs.budget == 50
    assert text.override(knobs, ["-b", "20", "-quiet"]) == {"budget": 20, "far": 0.9, "quiet": True}
    with pytest.raises(ValueError):
        text.merged(knobs, {"far": 1})
    with pytest.raises(ValueError):
        text.override(knobs, ["-zz", "1"])
    assert text.tabulated(["a", "bb"], [("x", 1.5), ("yy", 22.0)]) == ["a      bb", "--  -----", "x    1.50", "yy  22.00"]
    lines = text.tree_lines({1: ("x", "<=", 3.0)}, {1: (9, 0.5), 2: (4, 0.8), 3: (5, 0.2)})
    assert lines[1].startswith("+") and "x > 3" in lines[1] and lines[2].startswith("-") and "x <= 3" in lines[2]
    assert text.frugal_lines([("x", "2", 0.1)], 0.5) == ["if x = 2 then 0.10", "else 0.50"]


def test_running_keys(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), float(r.randrange(20)), r.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    for x in stats.running(df, "v", ["n"], ["k"]).collect():
        assert x["upto_n"] == sum(n for k, v, n in rows if k == x["k"] and v <= x["v"])


def test_prequential_stream(spark, tmp_path):
    """The stateful stream says what the batch says."""
    ev = queries.view(spark, DATA, "event").df.selectExpr("rid", "tX", "Hour", "u", "`event_type!` AS klass").orderBy("tX", "rid").limit(200).coalesce(1)
    rows = [(i, 1, float(r["Hour"]), r["u"], r["klass"]) for i, r in enumerate(ev.collect())]
    spark.createDataFrame(rows, "rid long, tenant int, Hour double, u string, klass string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rid long, tenant int, Hour double, u string, klass string").parquet(str(tmp_path / "in"))
    out = folds.prequential(stream, "tenant", "klass", ["u"], ["Hour"])
    q = out.writeStream.outputMode("append").format("memory").queryName("preq").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = {r["rid"]: r["got"] for r in spark.table("preq").collect()}
    from lodestar.operators import cluster
    from lodestar.roles import RoleFrame

    batch = RoleFrame(spark.createDataFrame([(i, float(i), h, u, k) for i, _, h, u, k in rows], "rid long, tX double, Hour double, u string, `klass!` string"), "rid")
    want = {r["pos"] - 1: r["got"] for r in cluster.prequential(batch, ["tX"]).collect()}
    assert got == want


def test_bucket_stream(spark, tmp_path):
    rf = queries.view(spark, DATA, "part")
    frozen, out = grids.Frozen(rf, 64), {}
    take = folds.buckets(rf.df, frozen, lambda df, n: out.update({(r["bucket"], r["rid"]): r["seen"] for r in df.collect()}), 4)
    take(rf.df.where("rid % 2 = 0"), 0)
    take(rf.df.where("rid % 2 = 1"), 1)
    whole = rf.df.select("rid", frozen.bucket().alias("bucket")).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in whole} == take.seen and all(len(v) == min(4, take.seen[b]) for b, v in take.kept.items())


def test_prequential_in_ranges(spark, monkeypatch):
    """Ranges of few arrivals, unknown cells, equal times, new symbols and classes: the same as one pass in plain Python."""
    import math

    from lodestar.operators import cluster
    from lodestar.roles import RoleFrame

    monkeypatch.setattr(cluster, "ARRIVALS", 20)
    r = random.Random(5)
    rows = [(i, float(i // 3), r.choice([None, float(r.randrange(24))]), r.choice([None, "a", "b", f"s{i // 90}"]), r.choice(["x", "y", None] if i < 200 else ["x", "y", "z"])) for i in range(400)]
    rf = RoleFrame(spark.createDataFrame(rows, "rid long, tX double, Hour double, u string, `klass!` string"), "rid")
    got = {x["pos"]: (x["want"], x["got"], x["like"]) for x in cluster.prequential(rf, ["tX", "rid"]).collect()}
    seen, want = {}, {}
    for pos, (_, _, h, u, c) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1):
        scores = []
        for name, own in seen.items():
            prior = (len(own) + 1) / (pos - 1 + len(seen))
            like = math.log(prior)
            hs = [a for a, _ in own if a is not None]
            if h is not None:
                mu = sum(hs) / max(1, len(hs))
                z = 2 * (max(0.0, sum(a * a for a in hs) - sum(hs) ** 2 / len(hs)) / (len(hs) - 1) if len(hs) > 1 else 0.0) + 1e-32
                p = math.exp(-min(700.0, (h - mu) ** 2 / z)) / math.sqrt(math.pi * z) if (h - mu) ** 2 / z < 700 else 0.0
                like += math.log(p) if p > 0 else 0.0
            if u is not None:
                like += math.log((sum(b == u for _, b in own) + 2 * prior) / (len(own) + 2))
            scores.append((round(-like, 9), name, like))
        if pos > 10 and scores:
            want[pos] = (c, min(scores)[1], max(s[2] for s in scores))
        if c is not None:
            seen.setdefault(c, []).append((h, u))
    assert got.keys() == want.keys()
    for pos, x in want.items():
        assert got[pos][:2] == x[:2] and got[pos][2] == pytest.approx(x[2], abs=1e-6)


def test_ranges_compare_with_few_bounds(spark):
    """A row's range comes from a search among the bounds, not from a sum over all of them."""
    from lodestar.operators import stats

    df = spark.range(1000).select((F.col("id") * 1.0).alias("v"))
    cut = stats.ranges(df, "v", 64)
    n = df.groupBy(cut.alias("p")).count().orderBy("p").collect()
    assert [x["p"] for x in n] == list(range(64)) and max(x["count"] for x in n) <= 20
    depth, most = 0, 0
    for c in cut._jc.toString():
        depth += (c == "(") - (c == ")")
        most = max(most, depth)
    assert "+" not in cut._jc.toString() and most < 40


@pytest.mark.parametrize("spare", [32, -75])
def test_reservoir_orders_few_rows(spark, monkeypatch, spare):
    """Exact, also where the bound of hashes was too small for a bucket."""
    import hashlib

    from lodestar.operators import cluster

    monkeypatch.setattr(cluster, "SPARE", spare)
    df = spark.range(3000).selectExpr("id AS rid", "CASE WHEN id % 7 = 0 THEN 'few' WHEN id < 3 THEN 'three' ELSE 'many' END AS b", "id * 2 AS v")
    by = collections.defaultdict(list)
    for x in df.collect():
        by[x["b"]].append((hashlib.md5(f"1:{x['rid']}".encode()).hexdigest(), x["rid"]))
    got = cluster.reservoir(df, "b", "rid", 50).collect()
    assert {(x["b"], x["rid"], x["seen"]) for x in got} == {(b, rid, len(own)) for b, own in by.items() for _, rid in sorted(own)[:50]}


def test_worlds_and_numbered_rows_are_made_once(spark, monkeypatch):
    """What several jobs read is written; many numbers of a small file are several tasks."""
    from lodestar.roles import RoleFrame

    names = []
    for module in (goals, search):
        monkeypatch.setattr(module, "keep", lambda df, name="rows", own=module.keep: (names.append(name), own(df, name))[1], raising=False)
    r = goals.Rig(spark, queries.goal_model(), ["shipped"], ["fast", "cheap"])
    few = spark.range(50).coalesce(1)
    assert r.worlds(few).rdd.getNumPartitions() >= 4
    r.run(few)
    rf = RoleFrame(spark.range(100).selectExpr("id AS rid", "id * 1.0 AS A", "cast(id % 3 AS string) AS c", "id * 2.0 AS `Y-`"), "rid")
    search.synthesized(rf, F.lit(1), 5).collect()
    assert {"worlds", "numbered"} <= set(names)
