"""Laws and small fixtures of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import cluster, distance, splits, stats, summary
from lodestar.plans import search
from lodestar.roles import RoleFrame, RoleSchema
from lodestar.sources import tables
from lodestar.streaming import folds


def test_roles():
    s = RoleSchema.parse(["Clndrs", "HpX", "origin", "Lbs-", "Mpg+", "sex~", "kind!"])
    assert s.x == ("Clndrs", "origin", "sex~") and s.goals == {"Lbs-": 0, "Mpg+": 1}
    assert s.klass == "kind!" and s.protected == ("sex~",) and "HpX" in s.nums


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("﻿Age, name ,Y-\n1, b , -1e2 # note\n\n?,c,2\n")
    rf = tables.read_csv(spark, str(f))
    assert [tuple(r)[1:] for r in rf.df.orderBy("rid").collect()] == [(1.0, "b", -100.0), (None, "c", 2.0)]


def test_letters(spark):
    df = spark.createDataFrame([(c,) for c in "aaaabbc"], "k string")
    r = summary.centers(summary.symbols(df, ["k"])).first()
    assert r["mode"] == "a" and abs(r["entropy"] - 1.379) < 1e-3


def test_numbers_and_forgetting(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(1, 6)] + [(9.0, 1), (9.0, -1)], "v double, s int")
    r = summary.moments(df, F.col("v"), F.col("s")).first()
    assert (r["n"], r["s"], r["q"]) == (5, 15.0, 55.0)
    one = summary.numbers(df.limit(5), ["v"]).first()
    assert one["mu"] == 3 and abs(one["sd"] - 1.5811) < 1e-4


def test_gaps(spark):
    df = spark.createDataFrame([(None, None), (None, 0.2), (0.9, None), (0.3, 0.7)], "a double, b double")
    got = [r[0] for r in df.select(C.gap_num(F.col("a"), F.col("b"))).collect()]
    assert [round(g, 6) for g in got] == [1.0, 0.8, 0.9, 0.4]


def test_effects(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in xs], "v double") for xs in ((1, 2, 3), (10, 11, 12)))
    r = stats.same(stats.samples(a, b, F.col("v"))).first()
    assert r["cliffs"] == 1 and r["ks"] == 1 and not r["same"]
    assert stats.same(stats.samples(a, a, F.col("v"))).first()["same"]


def test_ranks():
    near = lambda a, b: abs(m[a] - m[b]) < 0.2
    m = {"a": 0.0, "b": 0.05, "c": 2.0, "e": 4.0}
    assert stats.ranks(list(m.items()), near) == {"a": 0, "b": 0, "c": 1, "e": 2}


def test_confusion(spark):
    rows = [("a", "a")] * 3 + [("b", "a")] + [("b", "b")] * 2 + [("a", "b")]
    df = spark.createDataFrame(rows, "got string, want string")
    r = {x["klass"]: x for x in summary.confusion(df, "want", "got").collect()}
    assert r["a"]["pd"] == 0.75 and abs(r["a"]["pf"] - 1 / 3) < 1e-9 and abs(r["b"]["pd"] - 2 / 3) < 1e-9


def frame(spark):
    rows = [(i, float(i % 7), "ab"[i % 2], float((i * 37) % 11)) for i in range(60)]
    return RoleFrame(spark.createDataFrame(rows, "rid long, A double, s string, `Y-` double"), "rid")


def test_tree_and_prunings(spark):
    rf = frame(spark)
    t = splits.grow(rf, distance.disty(rf), depth=3)
    leaf = rf.df.groupBy(t.leaf_column().alias("l")).count().collect()
    assert sum(r["count"] for r in leaf) == 60 and {r["l"] for r in leaf} == set(t.leaves())
    every, spine = set(t.prunings()), set(t.prunings(shapes="spine"))
    assert spine <= every and frozenset(t.leaves()) in every
    sums = {i: (n * m, n) for i, (n, m) in t.stats.items()}
    assert splits.race(t, sums)[0] <= min(t.stats[i][1] for i in t.leaves()) + 1e-9


def test_distances(spark):
    rf = frame(spark)
    c = distance.coded(rf).select(F.struct("n", "s").alias("a"))
    d = c.withColumn("b", F.col("a")).select(distance.distx("a", "b").alias("d"))
    assert d.agg(F.max("d")).first()[0] == 0
    y = rf.df.select(distance.disty(rf).alias("y")).agg(F.min("y"), F.max("y")).first()
    assert 0 <= y[0] <= y[1] <= 1
    h = cluster.halve(rf).groupBy("near").count().collect()
    assert sorted(r["count"] for r in h) == [30, 30]
    assert cluster.kmeans(rf, 3, 1).count() == 60


def test_models(spark):
    p, x = tables.pool(spark, 50, 6), [F.col(f"X{i}") for i in range(1, 7)]
    f = C.dtlz2(x, 3)
    g = sum((F.pow(v - 0.5, F.lit(2)) for v in x[2:]), F.lit(0.0))
    off = p.select(F.abs(f[0] ** 2 + f[1] ** 2 + f[2] ** 2 - (1 + g) ** 2).alias("e")).agg(F.max("e")).first()[0]
    assert off < 1e-9


def test_stream(spark, tmp_path):
    spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "k string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in"))
    q = folds.summary(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = {r["k"]: (r["n"], r["mu"]) for r in spark.table("folded").collect()}
    assert got == {"x": (2, 2.0), "y": (1, 5.0)} and math.isclose(sum(v[1] for v in got.values()), 7)


def test_order_values_and_improvements(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 7.0, None, 4.0, 4.0, 1.0])], "i long, v double")
    assert stats.order_values(df, "v", [0, 0.5, 1]) == [1.0, 4.0, 7.0]
    assert [r["i"] for r in stats.improvements(df, ["i"], "v").orderBy("i").collect()] == [0, 3, 5]


def test_ledger(spark, tmp_path):
    asked = []

    def model(df):
        asked.append(df.count())
        return df.select("rid", (F.col("rid") * 2).alias("label"))

    book = search.Ledger(spark, str(tmp_path / "labels"), model)
    book.label(spark.createDataFrame([(1,), (2,)], "rid long"))
    got = book.label(spark.createDataFrame([(2,), (3,)], "rid long")).orderBy("rid").collect()
    assert asked == [2, 1] and [tuple(r) for r in got] == [(2, 4.0), (3, 6.0)]


def test_cover_and_nodes(spark):
    rf = frame(spark)
    got = cluster.delegates(rf, 0.6).collect()
    assert len(got) == 60 and all(r["d"] < 0.6 for r in got)
    assert cluster.nodes(rf, 2).count() == 60


def test_draws_of_symbols(spark):
    df = spark.range(2000).select(C.roulette(F.col("id"), 1, {"a": 3, "b": 1}).alias("k"), C.gaussian(F.col("id"), 1).alias("z"))
    r = df.agg(F.avg((F.col("k") == "a").cast("int")), F.avg("z"), F.stddev("z"), F.count("k")).first()
    assert abs(r[0] - 0.75) < 0.05 and abs(r[1]) < 0.1 and abs(r[2] - 1) < 0.1 and r[3] == 2000


def test_leaders_join_and_raise(spark):
    out = []
    era = folds.leaders(lambda c, lead: F.abs(F.get(c, F.lit(0)) - lead[0]), 1.0, 3, lambda df, _: out.extend(map(tuple, df.orderBy("rid").collect())))
    rows = lambda *xs: spark.createDataFrame([(i, [float(x)]) for i, x in xs], "rid long, codes array<double>")
    era(rows((1, 0), (2, 0.5), (3, 5)), 0)
    era(rows((4, 4.5), (5, 9), (6, 8)), 1)
    assert out == [(1, 0, 0.0), (2, 0, 0.5), (3, 1, 0.0), (4, 1, 0.5), (5, 2, 0.0), (6, 2, 1.0)]
    with pytest.raises(ValueError):
        era(rows((7, 20)), 2)
    assert [v[0] for v in era.leaders] == [0, 5, 9]
