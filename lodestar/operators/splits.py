"""Split search in one job for all columns and open nodes, trees grown level by level, prunings, rules, frugal trees."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import holds
from ..roles import RoleFrame
from ..storage import drop, keep
from .stats import running


def long_rows(df: DataFrame, rf: RoleFrame, y: Column, keys: list[str]) -> DataFrame:
    """(keys, at, num, x, s, y): one row for each input cell that is known; x for numbers, s for symbols."""
    cells = [F.struct(F.lit(c).alias("at"), F.lit(c in rf.schema.nums).alias("num"), (F.col(f"`{c}`").cast("double") if c in rf.schema.nums else F.lit(None).cast("double")).alias("x"), (F.lit(None).cast("string") if c in rf.schema.nums else F.col(f"`{c}`").cast("string")).alias("s")) for c in rf.schema.x]
    return df.select(*keys, y.cast("double").alias("y"), F.explode(F.array(*cells)).alias("c")).select(*keys, "y", "c.*").where("y IS NOT NULL AND (x IS NOT NULL OR s IS NOT NULL)")


def sides(cells: DataFrame, own: list[str], sums: str) -> DataFrame:
    """(own, x, s, <c>1, <c>): sums of the near side (numbers: up to x; symbols: the value's own) and of the whole column.
    Values of a column go range by range (stats.running), so no task holds a whole continuous column."""
    cells = keep(cells, "cells")
    whole = cells.groupBy(*own).agg(*[F.sum(c).alias(f"{c}_all") for c in sums])
    upto = running(cells, "x", list(sums), own)
    near = [F.when(F.col("num"), F.col(f"upto_{c}")).otherwise(F.col(c)).alias(f"{c}1") for c in sums]
    return upto.join(whole, own).select(*own, "x", "s", *near, *[F.col(f"{c}_all").alias(c) for c in sums])


def candidates(long: DataFrame, keys: list[str], leaf: int = 3) -> DataFrame:
    """(keys, at, op, x, s, n1, n2, cost): numbers between distinct values, symbols one against the rest. The far side is
    the total less the near one. Cells are summed by value before anything is ordered."""
    own = [*keys, "at", "num"]
    cells = long.groupBy(*own, "x", "s").agg(F.count("*").alias("n"), F.sum("y").alias("t"), F.sum(F.col("y") * F.col("y")).alias("q"))
    rows = sides(cells, own, "ntq")
    sd = lambda n, t, q: F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), q - t * t / n) / (n - 1)))
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    cost = (n1 * sd(n1, F.col("t1"), F.col("q1")) + n2 * sd(n2, F.col("t") - F.col("t1"), F.col("q") - F.col("q1"))) / F.col("n")
    return rows.where((n1 >= leaf) & (n2 >= leaf)).select(*keys, "at", F.when(F.col("num"), "<=").otherwise("==").alias("op"), "x", "s", "n1", n2.alias("n2"), cost.alias("cost"))


def best(cands: DataFrame, keys: list[str]) -> DataFrame:
    """The cheapest candidate of each key; ties by column, then value."""
    cut = F.min(F.struct(F.round("cost", 9).alias("c"), "at", "x", "s", "op", "n1", "n2", "cost")).alias("b")
    return (cands.groupBy(*keys).agg(cut) if keys else cands.agg(cut)).select(*keys, "b.at", "b.op", "b.x", "b.s", "b.n1", "b.n2", "b.cost")


def condition(at: str, op: str, value) -> Column:
    return holds(F.col(f"`{at}`"), op, value)


class Tree:
    """nodes: {id: (at, op, value)} of inner nodes and {id: (n, mid)} of all; root 1, yes 2i, no 2i + 1."""

    def __init__(self, cuts: dict, stats: dict) -> None:
        self.cuts, self.stats = cuts, stats

    def leaf_column(self, node: int = 1, depth: int | None = None) -> Column:
        """Leaf number of a row, as one expression: routing needs no join."""
        if node not in self.cuts or depth == 0:
            return F.lit(node)
        less = None if depth is None else depth - 1
        return F.when(condition(*self.cuts[node]), self.leaf_column(2 * node, less)).otherwise(self.leaf_column(2 * node + 1, less))

    def mid_column(self) -> Column:
        leaf = self.leaf_column()
        out = F.lit(None).cast("double")
        for i, (_, mid) in self.stats.items():
            out = F.when(leaf == i, mid).otherwise(out)
        return out

    def leaves(self) -> list[int]:
        return sorted(i for i in self.stats if i not in self.cuts)

    def used(self) -> set[str]:
        return {c[0] for c in self.cuts.values()}

    def prunings(self, node: int = 1, shapes: str = "all") -> Iterator[frozenset[int]]:
        """Sets of leaves: at each cut, each side stops or goes on; with shapes='spine' never both go on."""
        if node not in self.cuts:
            yield frozenset([node])
            return
        go = [[frozenset([k]), *(self.prunings(k, shapes) if k in self.cuts else [])] for k in (2 * node, 2 * node + 1)]
        for a, b in itertools.product(*go):
            if shapes == "all" or a == {2 * node} or b == {2 * node + 1}:
                yield a | b

    def show(self) -> list[str]:
        out = []
        for i in sorted(self.stats, key=lambda i: bin(i)[2:]):
            text = "" if i == 1 else "{} {} {}".format(*self.cuts[i // 2]) if i % 2 == 0 else "not {} {} {}".format(*self.cuts[i // 2])
            out.append(f"{'|.. ' * (i.bit_length() - 1)}{text}  n={self.stats[i][0]} mid={self.stats[i][1]:.3f}")
        return out


def fastmap(rf: RoleFrame, seed: object = 1):
    """A target for grow_by: y is how much farther a row is from one pole of its node than from the other. Poles of all
    nodes of a level are found in the same two passes; they are two rows a node."""
    from ..functions.columns import hashed
    from .distance import coded, distx

    def target(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        own = rows.join(coded(rf).select(rf.rid, F.struct("n", "s").alias("_a")), rf.rid)
        shape = own.schema["_a"].dataType.simpleString()
        start = own.groupBy("_node").agg(F.min_by("_a", F.struct(hashed(F.col(rf.rid), seed), rf.rid)).alias("_b"))

        def farthest(place: DataFrame) -> DataFrame:
            few = F.broadcast(spark.createDataFrame(place.collect(), f"_node int, _b {shape}"))  # a row a node
            return own.join(few, "_node").groupBy("_node").agg(F.max_by("_a", F.struct(F.round(distx("_a", "_b"), 9), -F.col(rf.rid))).alias("_b"))

        east = farthest(start)
        west = farthest(east).withColumnRenamed("_b", "_w")
        both = F.broadcast(east.join(west, "_node"))
        return own.join(both, "_node").withColumn("_y", distx("_a", "_b") - distx("_a", "_w")).drop("_a", "_b", "_w")

    return target


def grow(rf: RoleFrame, y: Column, leaf: int = 3, depth: int = 4) -> Tree:
    """A tree on one target column."""
    return grow_by(rf, lambda rows: rows.withColumn("_y", y), leaf, depth)


def grow_by(rf: RoleFrame, target, leaf: int = 3, depth: int = 4) -> Tree:
    """Level by level: one job finds the best cuts of all open nodes; the driver keeps cuts only (2^depth at most).
    `target` takes the rows of a level, with their `_node`, and adds what to split on, `_y`."""
    cuts: dict = {}
    stats: dict = {}
    df = keep(rf.df, "view")  # a view may be a join of tables
    for level in range(depth + 1):
        tree = Tree(cuts, stats)
        rows = df.withColumn("_node", tree.leaf_column())
        rows = keep(target(rows.where((F.col("_node") >= 2**level) & (F.col("_node") < 2 ** (level + 1)))), "level")
        for r in rows.groupBy("_node").agg(F.count("_y").alias("n"), F.avg("_y").alias("mid")).collect():
            stats[r[0]] = (r[1], r[2] if r[2] is not None else 0.0)
        if level == depth:
            break
        open_nodes = [i for i in stats if 2**level <= i < 2 ** (level + 1) and stats[i][0] >= 2 * leaf]
        if not open_nodes:
            break
        long = long_rows(rows.where(F.col("_node").isin(open_nodes)), rf, F.col("_y"), ["_node"])
        for r in best(candidates(long, ["_node"], leaf), ["_node"]).collect():
            if r["at"] is not None:
                cuts[r["_node"]] = (r["at"], r["op"], r["x"] if r["op"] == "<=" else r["s"])
        drop(rows)
        if not any(i in cuts for i in open_nodes):
            break
    drop(df)
    return Tree(cuts, stats)


def rolled(tree: Tree) -> dict[int, tuple[int, float]]:
    """For each node the number of leaves and the least leaf mean below it."""
    out: dict[int, tuple[int, float]] = {}
    for i in sorted(tree.stats, reverse=True):
        below = [out[k] for k in (2 * i, 2 * i + 1)] if i in tree.cuts else [(1, tree.stats[i][1])]
        out[i] = (sum(n for n, _ in below), min(m for _, m in below))
    return out


def percentile_candidates(rf: RoleFrame, y: Column, bins: int = 8, leaf: int = 3) -> DataFrame:
    """Candidates of numbers at percentile-spaced cut values only; unknown cells are taken to be at the column's middle
    (mean, or most frequent symbol)."""
    from .stats import spaced_cuts
    from .summary import centroid

    mid = centroid(RoleFrame(rf.df.select(*[f"`{c}`" for c in rf.schema.names]), rf.rid, rf.schema)).first()
    df = rf.df
    for c in rf.schema.x:
        df = df.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(mid[c])))
    found = candidates(long_rows(df, rf, y, []), [], leaf)
    cuts = {c: spaced_cuts(rf.df, c, bins) for c in rf.schema.x if c in rf.schema.nums}
    # a cut value that is no value of the imputed column stands for the next smaller one: both part the rows alike
    at = F.lit(False)
    for c, vs in cuts.items():
        at = at | ((F.col("at") == c) & F.col("x").isin(vs))
    return found.where((F.col("op") == "==") | at)


def race(tree: Tree, sums: dict[int, tuple[float, int]], shapes: str = "all") -> tuple[float, int, frozenset[int]]:
    """The pruning whose best-predicted leaf has the lowest mean of actual y (seeded with the leaf's mid), then fewest
    leaves. sums: actual (sum, n) of each node.

    A pruning's score depends on its best-predicted leaf alone. So for each node a table from the bottom up has the fewest
    leaves that a subtree needs if all of them predict worse than that node, and the node's ancestors are opened: work grows
    with the square of the nodes, not with the number of prunings."""
    key = lambda i: (tree.stats[i][1], i)

    def fewest(b: int) -> frozenset[int] | None:
        """Leaves of the smallest pruning whose best-predicted leaf is b."""
        low: dict[int, frozenset[int] | None] = {}

        def least(*some: frozenset[int] | None) -> frozenset[int] | None:
            return min((x for x in some if x is not None), key=lambda x: (len(x), sorted(x)), default=None)

        both = lambda x, y: None if x is None or y is None else x | y
        above = {b >> k for k in range(1, b.bit_length())}
        for i in sorted(tree.stats, reverse=True):  # children come first
            stop = frozenset([i]) if i == b or key(i) > key(b) else None
            if i == b:
                low[i] = stop
                continue
            go = None
            if i in tree.cuts:
                x, y = 2 * i, 2 * i + 1
                if shapes == "all":
                    go = both(low[x], low[y])
                else:  # one side stops at once
                    ends = {k: frozenset([k]) if k == b or (k not in above and key(k) > key(b)) else None for k in (x, y)}
                    go = least(both(ends[x], low[y]), both(low[x], ends[y]))
            low[i] = go if i in above else least(stop, go)
        return low[1]

    out = []
    for b in tree.stats:
        if b == 1 and 1 in tree.cuts:
            continue
        leaves = fewest(b)
        if leaves is not None and (1 not in tree.cuts or len(leaves) > 1):
            s, n = sums.get(b, (0.0, 0))
            out.append(((s + tree.stats[b][1]) / (n + 1), len(leaves), leaves))
    return min(out, key=lambda t: (t[0], t[1], sorted(t[2])))


def prunings(tree: Tree, shapes: str = "all") -> int:
    """How many prunings a tree has, counted from the bottom up."""
    n: dict[int, int] = {}
    for i in sorted(tree.cuts, reverse=True):
        x, y = n.get(2 * i, 0), n.get(2 * i + 1, 0)
        n[i] = (1 + x) * (1 + y) if shapes == "all" else 1 + x + y
    return n.get(1, 1)


def tag_candidates(df: DataFrame, rf: RoleFrame, best: Column, leaf: int = 3) -> DataFrame:
    """(at, op, x, s, n1, n2, cost, keep): cuts by the entropy of best rows against the rest, and whether the near side
    holds the larger share of best ones. Cells are summed by value before anything is ordered."""
    long = long_rows(df, rf, best.cast("double"), [])
    own = ["at", "num"]
    cells = long.groupBy(*own, "x", "s").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    rows = sides(cells, own, "nt")
    ent = lambda n, t: sum((F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0) for k in (t, n - t)), F.lit(0.0))
    n1, t1 = F.col("n1"), F.col("t1")
    n2, t2 = F.col("n") - n1, F.col("t") - t1
    cost = (n1 * ent(n1, t1) + n2 * ent(n2, t2)) / F.col("n")
    return rows.where((n1 >= leaf) & (n2 >= leaf)).select("at", F.when(F.col("num"), "<=").otherwise("==").alias("op"), "x", "s", n1.alias("n1"), n2.alias("n2"), cost.alias("cost"), (t1 / n1 >= t2 / n2).alias("keep"))


def rule_step(df: DataFrame, rf: RoleFrame, tag: str, leaf: int = 3):
    """The cut with the least entropy of best and rest rows, and the side that holds the larger share of best ones."""
    good = tag_candidates(df, rf, F.col(tag) == "best", leaf)
    return good.agg(F.min(F.struct(F.round("cost", 9).alias("c"), "at", "x", "s", "op", "keep", "n1", "cost")).alias("b")).select("b.at", "b.op", "b.x", "b.s", "b.keep", "b.n1", "b.cost")


def matched(rule: list[tuple]) -> Column:
    """How many conjuncts (at, op, value, keep) of a rule a row meets; an unknown value meets them."""
    met = [F.col(f"`{at}`").isNull() | (condition(at, op, v) == F.lit(bool(keep))) for at, op, v, keep in rule]
    return sum((m.cast("int") for m in met), F.lit(0))


def merged_bins(df: DataFrame, code: Column, y: Column) -> DataFrame:
    """(bin, n, mid): runs of bins from the first one on, the last dropped; bins are few, so the window sees few rows."""
    bins = df.select(code.alias("bin"), y.alias("y")).where("bin IS NOT NULL AND y IS NOT NULL").groupBy("bin").agg(F.count("*").alias("k"), F.sum("y").alias("t"))
    w = Window.orderBy("bin")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = bins.select("bin", F.sum("k").over(upto).alias("n"), F.sum("t").over(upto).alias("t"), F.lead("bin").over(w).alias("next"))
    return run.where("next IS NOT NULL").select("bin", "n", (F.col("t") / F.col("n")).alias("mid"))


def roc(df: DataFrame, share: Column, positive: Column, thetas: list[float]) -> DataFrame:
    """(theta, pd, pf): rows whose share of positives (of their leaf) is at least theta are called positive. Rows are
    counted by distinct share first; thetas are a literal array."""
    cells = df.groupBy(share.alias("share")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    rows = cells.select("*", F.explode(F.array(*map(F.lit, thetas))).alias("theta"))
    hit = F.col("share") >= F.col("theta")
    rate = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0)) / F.greatest(F.lit(1), F.sum(c))
    return rows.groupBy("theta").agg(rate("p").alias("pd"), rate("q").alias("pf"))


def grow_rule(rf: RoleFrame, score: Column, conjuncts: int = 2) -> list[tuple]:
    """Conjuncts (at, op, value, keep): tag the sqrt(n) best, cut, keep a side, again."""
    df, out = keep(rf.df.withColumn("_s", score).where("_s IS NOT NULL"), "scored"), []
    for _ in range(conjuncts):
        n = df.count()
        edge = df.select("_s").orderBy("_s").limit(max(1, int(n**0.5))).agg(F.max("_s")).first()[0]
        r = rule_step(df.withColumn("_tag", F.when(F.col("_s") <= edge, "best").otherwise("rest")), rf, "_tag").first()
        if r is None or r["at"] is None:
            break
        cut = (r["at"], r["op"], r["x"] if r["op"] == "<=" else r["s"], r["keep"])
        out.append(cut)
        df = df.where(condition(*cut[:3]) if cut[3] else F.col(f"`{cut[0]}`").isNull() | ~condition(*cut[:3]))
    return out


def frugal(rf: RoleFrame, y: Column, bins: int = 7, depth: int = 4) -> tuple[float, list[tuple]]:
    """Fast-and-frugal tree: each level leaves by the bin range with the lowest or highest mean; all 2^depth bias strings
    are grown together, one job a level, and the one with the least mean absolute error is kept. Returns (error, exits).

    A row's place in the trees still open is an array of bias strings, told by literals; nothing is joined."""
    from .distance import norms

    n = norms(rf, [c for c in rf.schema.x if c in rf.schema.nums])
    codes = {c: (F.floor(bins * n[c]) if c in n else F.col(f"`{c}`")).cast("string") for c in rf.schema.x}
    df = rf.df.select(rf.rid, y.alias("_y"), *[codes[c].alias(f"x{i}") for i, c in enumerate(rf.schema.x)]).where("_y IS NOT NULL")
    df = keep(df, "coded")
    rows, rest = df.agg(F.count("*"), F.avg("_y")).first()
    least, rest = rows**0.33, rest or 0.0
    trees, done = {"": []}, []
    for _ in range(depth):
        stays = [F.when(passes(exits), F.lit(bias)) for bias, exits in trees.items()]
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in range(len(rf.schema.x))]))
        open_rows = df.select("*", F.explode(F.array_compact(F.array(*stays))).alias("bias")).select("bias", "_y", cells.alias("c")).select("bias", "_y", "c.*")
        found = open_rows.where("v IS NOT NULL").groupBy("bias", "i", "v").agg(F.count("*").alias("n"), F.avg("_y").alias("m")).where(F.col("n") > least)
        item = F.struct("i", "v", "m")
        pick = found.groupBy("bias").agg(F.min_by(item, F.struct(F.round("m", 9), "i", "v")).alias("lo"), F.max_by(item, F.struct(F.round("m", 9), -F.col("i"), "v")).alias("hi")).collect()
        got = {r["bias"]: (r["lo"], r["hi"]) for r in pick}  # two exits a tree: 2^depth at most
        done += [exits for bias, exits in trees.items() if bias not in got]
        trees = {bias + b: [*trees[bias], (e["i"], e["v"], e["m"])] for bias, two in sorted(got.items()) for b, e in zip("01", two, strict=True)}
    grown = [*done, *trees.values()]
    errors = []
    for t in grown:
        guess = F.lit(rest)
        for i, v, m in reversed(t):
            guess = F.when(F.col(f"x{i}") == v, m).otherwise(guess)
        errors.append(F.avg(F.abs(F.col("_y") - guess)))
    got = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(errors)]).first()
    k = min(range(len(grown)), key=lambda i: (round(got[i] or 0.0, 9), i))
    return got[k] or 0.0, [(rf.schema.x[i], v, m) for i, v, m in grown[k]]


def passes(exits: list[tuple]) -> Column:
    """Whether a row leaves by none of the exits (column number, value, mean)."""
    out = F.lit(True)
    for i, v, _ in exits:
        out = out & (F.col(f"x{i}").isNull() | (F.col(f"x{i}") != v))
    return out
