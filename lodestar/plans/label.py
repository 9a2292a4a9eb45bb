"""Label-frugal acquisition over whole tables, for many runs at once.

A run is a table, a way to label, a budget and a seed. All runs of all tables go through the same few jobs a round:

- active: a round labels the first `more` unlabelled rows of a run's pool, draws the line between two far labelled rows of
  the pool, better one first, and keeps the `keep` of the pool that lies nearest to it. The cut is the exact k-th place on
  the line (stats.selected). A pool under 2 * leaf rows starts again on all rows in a fresh order, on the line between the
  best and worst label so far.
- random: the first rows of a hashed order.
- centroid, bayes: a warm start, then the row of the whole pool that scores highest by the best square root of the labels
  against the rest, one a turn.

A pool is written once a round and only its survivors go on, so all rounds until a fresh start write about three times the
table. What passes through the driver is labelled rows (a ledger: a run's budget at most). Rows are (file, rid, a, x, y) as
sources.many gives them; rows without y can't be labelled and take no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..operators.distance import distx, ranked
from ..operators.stats import selected
from ..storage import drop, keep

TINY = 1e-32


@dataclass(frozen=True)
class Run:
    """The number of a run, its table, how it labels, how often, and the seed of its draws."""

    run: int
    file: str
    mode: str = "active"
    budget: int = 50
    seed: int = 1


def gap(a, b, p: float = 2.0) -> float:
    """Distance of two labelled rows, as operators.distance.distx has it of columns."""
    far = lambda v: 1.0 if v < 0.5 else 0.0
    gaps = [1.0 if u is None and v is None else abs((far(v) if u is None else u) - (far(u) if v is None else v)) for u, v in zip(a["n"], b["n"], strict=True)]
    gaps += [1.0 if u is None or v is None or u != v else 0.0 for u, v in zip(a["s"], b["s"], strict=True)]
    return (sum(g**p for g in gaps) / len(gaps)) ** (1 / p) if gaps else 0.0


def table_of(runs: Sequence[Run], rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([(r.run, r.file, r.mode, r.budget, str(r.seed)) for r in runs], "run int, file string, mode string, budget int, seed string")


def order(seed: Column, turn: Column | int = 0) -> Column:
    """A hashed place of each row in a run's order: 0 to 1, a fresh one for each turn."""
    return F.conv(F.substring(_hash(seed, turn), 1, 8), 16, 10).cast("long") / 4294967296.0


def _hash(seed: Column, turn: Column | int) -> Column:
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return F.md5(F.concat(seed, F.lit("."), turn.cast("string"), F.lit(":"), F.col("rid").cast("string")))


#: Rows beyond those wanted that `firsts` orders.
SPARE = 32


def firsts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The first k rows of each key by `o`, with their rank. o is a hash, spread evenly over 0 to 1, so the first k of n rows have a
    small one: only rows under a bound are ordered, and keys with too few of those are ordered whole. Keys are few."""
    sizes = {r[0]: r[1] for r in rows.groupBy(key).agg(F.count("*")).collect()}  # a row a key
    kind = rows.schema[key].dataType.simpleString()
    edges = {v: min(2.0, 2.0 if n <= k else (k + 8 * k**0.5 + SPARE) / n) for v, n in sizes.items() if v is not None}
    frame = lambda: F.broadcast(rows.sparkSession.createDataFrame(list(edges.items()), f"{key} {kind}, _edge double"))
    near = rows.join(frame(), key).where(F.col("o") < F.col("_edge")).select(*rows.columns)
    held = {r[0]: r[1] for r in near.groupBy(key).agg(F.count("*")).collect()}  # a row a key
    short = [v for v in edges if held.get(v, 0) < min(k, sizes[v])]
    if short:
        edges |= dict.fromkeys(short, 2.0)
        near = rows.join(frame(), key).where(F.col("o") < F.col("_edge")).select(*rows.columns)
    return ranked(near, [key], [F.col("o"), F.col("rid")], k)


#: Parts of a pool by a hash of its rows.
SLOTS = 256


def slot() -> Column:
    return F.pmod(F.xxhash64(F.col("rid").cast("long")), F.lit(SLOTS)).cast("int")


def slots(rows: DataFrame, k: int, steps: bool = False) -> DataFrame:
    """(run, slot): the slots that can hold the first k rows of a run by (o, rid), exact: k slots have a row not above the k-th least
    o of slots. One hash aggregation, no order of rows. steps: o has few values, and slots are told apart by rid where it is alike."""
    least = rows.groupBy("run", slot().alias("slot"), *(["o"] if steps else [])).agg(F.min("rid" if steps else "o").alias("least"))
    by = [F.col("o").asc_nulls_last()] if steps else []
    place = F.rank().over(Window.partitionBy("run").orderBy(*by, F.col("least").asc_nulls_last()))
    few = least.withColumn("place", place).where(F.col("place") <= k).select("run", "slot").distinct()
    return rows.sparkSession.createDataFrame(few.collect(), few.schema)  # SLOTS a run at most


def acquire(rows: DataFrame, runs: Sequence[Run], more: int = 4, share: float = 0.66, leaf: int = 3, start: int = 20) -> DataFrame:
    """(run, rid, y, turn): what each run labels, and when. A run labels its budget of rows, or all its rows if they are fewer;
    anything beyond it is an error."""
    spark = rows.sparkSession
    known = rows.where("y IS NOT NULL").withColumn("rid", F.col("rid").cast("long"))
    got: list[tuple[int, int, float, int]] = []
    for mode, how in (("random", _random), ("active", _active), ("centroid", _greedy), ("bayes", _greedy)):
        own = [r for r in runs if r.mode == mode]
        if own:
            got += how(known, own, more, share, leaf, start)
    spent: dict[int, int] = {}
    for run, *_ in got:
        spent[run] = spent.get(run, 0) + 1
    if any(spent.get(r.run, 0) > r.budget for r in runs) or len({(g[0], g[1]) for g in got}) != len(got):
        raise AssertionError("a run spent more labels than its budget, or one twice")
    return spark.createDataFrame(got, "run int, rid long, y double, turn int")


def _random(known: DataFrame, runs: list[Run], *_) -> list[tuple]:
    pool = keep(known.select("file", "rid", "y").join(F.broadcast(table_of(runs, known)), "file").select("run", "rid", "y", "budget", order(F.col("seed")).alias("o")), "draws")
    first = firsts(pool, "run", max(r.budget for r in runs)).where("rank <= budget").collect()  # a budget a run
    drop(pool)
    return [(r["run"], r["rid"], r["y"], 0) for r in first]


def _active(known: DataFrame, runs: list[Run], more: int, share: float, leaf: int, _: int) -> list[tuple]:
    spark = known.sparkSession
    ledger: dict[int, dict[int, tuple]] = {r.run: {} for r in runs}  # rid: (y, a, turn)
    lines: dict[int, tuple | None] = dict.fromkeys(ledger)  # anchors of a run that has started again
    turns, budget = dict.fromkeys(ledger, 0), {r.run: r.budget for r in runs}
    base = keep(known.select("file", "rid", "a", "y"), "known")
    sizes = {r["file"]: r["n"] for r in base.groupBy("file").agg(F.count("*").alias("n")).collect()}  # a row a file
    total = {r.run: sizes.get(r.file, 0) for r in runs}
    count = dict(total)  # rows of each pool
    open_ = [r for r in runs if total[r.run]]
    pool, held, round_ = _fresh(base, open_, turns), None, 0
    while open_:
        left = {r.run: min(more, r.budget - len(ledger[r.run])) for r in open_}
        # rows of a pool that are labelled, and the first that are not
        spent = spark.createDataFrame([(k, rid) for k in left for rid in ledger[k]], "run int, rid long")
        tagged = pool.join(F.broadcast(spent.withColumn("old", F.lit(True))), ["run", "rid"], "left").withColumn("old", F.col("old").isNotNull())
        few = slots(tagged.where("NOT old"), more).withColumn("new", F.lit(True))
        near = tagged.withColumn("slot", slot()).join(F.broadcast(few), ["run", "slot"], "left").where("old OR new").select(*tagged.columns)
        first = ranked(near, ["run", "old"], [F.col("o"), F.col("rid")], max(more, *(r.budget for r in open_)))
        seen = first.where(F.col("old") | (F.col("rank") <= more)).select("run", "rid", "o", "a", "y", "old").collect()  # a budget and `more` a run
        here: dict[int, list] = {}
        for r in sorted(seen, key=lambda r: (r["run"], r["o"], r["rid"])):
            k = r["run"]
            if not r["old"]:
                if left[k] <= 0:
                    continue
                left[k] -= 1
                ledger[k][r["rid"]] = (r["y"], r["a"], round_)
            here.setdefault(k, []).append((r["rid"], r["a"], r["y"]))
        open_ = [r for r in open_ if len(ledger[r.run]) < min(budget[r.run], total[r.run])]
        ends, again = [], []
        for r in open_:
            k = r.run
            size = int(max(1, share * count[k]))
            if size < 2 * leaf:
                best, *_, worst = sorted(((y, rid, a) for rid, (y, a, _) in ledger[k].items()), key=lambda t: t[:2])
                lines[k], count[k] = (best[2], worst[2]), total[k]
                turns[k] += 1
                again.append(r)
            else:
                ends.append((k, *(lines[k] or _line(here[k])), size, count[k]))
                count[k] = size
        new, made = None, held
        if ends:
            made, new = _culled(pool, ends, base)
        if again:
            every = _fresh(base, again, turns)
            new = every if new is None else new.unionByName(every)
        if made is not held:
            drop(held)
        pool, held = new, made
        round_ += 1
    drop(held, base)
    return [(k, rid, y, turn) for k, own in ledger.items() for rid, (y, _, turn) in own.items()]


def _fresh(base: DataFrame, runs: list[Run], turns: dict[int, int]) -> DataFrame:
    """(run, rid, a, y, o): all rows of the runs' tables in a fresh order."""
    own = base.sparkSession.createDataFrame([(r.run, r.file, str(r.seed), turns[r.run]) for r in runs], "run int, file string, seed string, turn int")
    return base.join(F.broadcast(own), "file").withColumn("o", order(F.col("seed"), F.col("turn"))).select("run", "rid", "a", "y", "o")


def _line(here: list[tuple]) -> tuple:
    """Two labelled rows of a pool far from each other, better one first: from the first of the pool's order."""
    far = lambda a: max(here, key=lambda r: (round(gap(a, r[1]), 12), -r[0]))
    east = far(here[0][1])
    west = far(east[1])
    return (east[1], west[1]) if east[2] <= west[2] else (west[1], east[1])


def on_line(a, east, west) -> Column:
    ab, ea, wa = distx(east, west) + TINY, distx(a, east), distx(a, west)
    return F.round((ea * ea + ab * ab - wa * wa) / (2 * ab), 9)


def _culled(pool: DataFrame, ends: list[tuple], base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first `size` rows of each run's pool by their place on its line; of ties at the cut the first by a hash. Returns what
    was written, and the pool as a filter of it. ends: (run, east, west, size, rows)."""
    spark, kind = pool.sparkSession, base.schema["a"].dataType.simpleString()
    lines = spark.createDataFrame(ends, f"run int, e {kind}, w {kind}, size int, n int")  # a row a run
    at = keep(pool.join(F.broadcast(lines), "run").select("run", "rid", "a", "y", on_line("a", "e", "w").alias("o")), "line")
    want, most = lines.select("run", (F.col("size") - 1).alias("k")), max(e[4] for e in ends)
    edges = {r["run"]: (r["v"], r["upto"]) for r in selected(at, ["run"], "o", want, most=most).collect()}  # a row a run
    size = {e[0]: e[3] for e in ends}
    over = [k for k, (_, upto) in edges.items() if upto > size[k]]
    last: dict[int, float] = {}
    tie = uniform(F.col("rid"), "tie")
    if over:
        tied = at.join(F.broadcast(spark.createDataFrame([(k, edges[k][0]) for k in over], "run int, edge double")), "run").where("o = edge").withColumn("u", tie)
        sizes = {r["run"]: r["n"] for r in tied.groupBy("run").agg(F.count("*").alias("n")).collect()}
        more = spark.createDataFrame([(k, size[k] - (edges[k][1] - sizes[k]) - 1) for k in over], "run int, k long")
        last = {r["run"]: r["v"] for r in selected(tied, ["run"], "u", more, most=max(sizes.values())).collect()}
    cuts = spark.createDataFrame([(k, v, last.get(k, 1.0)) for k, (v, _) in edges.items()], "run int, edge double, upto double")
    kept = at.join(F.broadcast(cuts), "run").where((F.col("o") < F.col("edge")) | ((F.col("o") == F.col("edge")) & (tie <= F.col("upto"))))
    return at, kept.select("run", "rid", "a", "y", "o")


# --------------------------------------------------------------------------- by a score of the whole pool


def _greedy(known: DataFrame, runs: list[Run], more: int, share: float, leaf: int, start: int) -> list[tuple]:
    spark, kind = known.sparkSession, known.schema["a"].dataType.simpleString()
    pool = keep(known.select("file", "rid", "a", "y").join(F.broadcast(table_of(runs, known)), "file").withColumn("o", order(F.col("seed"))), "pool")
    warm = {r.run: min(start, r.budget) for r in runs}
    first = firsts(pool, "run", max(warm.values())).collect()  # a warm start a run
    ledger: dict[int, list[tuple]] = {r.run: [] for r in runs}
    for r in sorted(first, key=lambda r: (r["run"], r["rank"])):
        if r["rank"] <= warm[r["run"]]:
            ledger[r["run"]].append((r["rid"], r["y"], r["a"], 0))
    halves = {}
    for k, own in ledger.items():
        rows = sorted(own, key=lambda t: (t[1], t[0]))
        edge = max(1, int(len(rows) ** 0.5))
        halves[k] = (rows[:edge], rows[edge:])
    turn = 0
    while True:
        turn += 1
        open_ = [r for r in runs if len(ledger[r.run]) < r.budget and halves[r.run][1]]
        if not open_:
            break
        spent = spark.createDataFrame([(r.run, t[0]) for r in open_ for t in ledger[r.run]], "run int, rid long")
        left = pool.join(F.broadcast(spent), ["run", "rid"], "left_anti")

        def scored(part: DataFrame) -> DataFrame:
            found = None
            for mode in sorted({r.mode for r in open_}):
                own = [r for r in open_ if r.mode == mode]
                some = by_centroid(part, own, halves, kind) if mode == "centroid" else by_bayes(part, own, halves)
                found = some if found is None else found.unionByName(some)
            return found.withColumn("score", F.round("score", 9))

        few = slots(scored(left).select("run", "rid", (-F.col("score")).alias("o")), 1)
        near = left.withColumn("slot", slot()).join(F.broadcast(few), ["run", "slot"]).select(*left.columns)
        item = F.struct("score", (-F.col("rid")).alias("back"))
        top = {r["run"]: r["t"] for r in scored(near).groupBy("run").agg(F.max_by(F.struct("rid", "y", "a"), item).alias("t")).collect()}  # a row a run
        if not top:
            break
        for k, t in top.items():
            new = (t["rid"], t["y"], t["a"], turn)
            ledger[k].append(new)
            best, rest = halves[k]
            best.append(new)
            if len(best) > int(len(ledger[k]) ** 0.5):
                worst = max(best, key=lambda b: (b[1], b[0]))
                best.remove(worst)
                rest.append(worst)
    drop(pool)
    return [(k, rid, y, turn) for k, own in ledger.items() for rid, y, _, turn in own]


def middle(table: list[tuple]) -> tuple[list, list]:
    """Means of numbers, modes of symbols (of equal counts the smallest) of labelled rows."""
    nums = [[v for v in c if v is not None] for c in zip(*(t[2]["n"] for t in table), strict=True)]
    syms = [[v for v in c if v is not None] for c in zip(*(t[2]["s"] for t in table), strict=True)]
    return [sum(c) / len(c) if c else None for c in nums], [min(set(c), key=lambda v: (-c.count(v), v)) if c else None for c in syms]


def by_centroid(pool: DataFrame, runs: list[Run], halves: dict, kind: str) -> DataFrame:
    """Score: how much farther a row is from the centre of the rest than from that of the best."""
    ends = pool.sparkSession.createDataFrame([(r.run, middle(halves[r.run][0]), middle(halves[r.run][1])) for r in runs], f"run int, good {kind}, bad {kind}")
    return pool.join(F.broadcast(ends), "run").select("run", "rid", "y", "a", (distx("a", "bad") - distx("a", "good")).alias("score"))


def by_bayes(pool: DataFrame, runs: list[Run], halves: dict, k: int = 1, m: int = 2) -> DataFrame:
    """Score: log-likelihood among the best less that among the rest; counts, means and spreads come as arrays, symbols as maps."""

    def learnt(table: list[tuple], total: int) -> tuple:
        prior = (len(table) + k) / (total + 2 * k)
        nums = []
        for c in zip(*(t[2]["n"] for t in table), strict=True):
            own = [v for v in c if v is not None]
            mu = sum(own) / len(own) if own else None
            nums.append((mu, 2 * sum((v - mu) ** 2 for v in own) / max(1, len(own) - 1) + TINY if own else None))
        syms = []
        for c in zip(*(t[2]["s"] for t in table), strict=True):
            syms.append({v: math.log((c.count(v) + m * prior) / (len(table) + m)) for v in set(c) if v is not None})
        return math.log(prior), nums, syms, math.log(m * prior / (len(table) + m))

    model = "struct<prior:double,n:array<struct<mu:double,z:double>>,s:array<map<string,double>>,none:double>"
    rows = []
    for r in runs:
        best, rest = halves[r.run]
        rows.append((r.run, learnt(best, len(best) + len(rest)), learnt(rest, len(best) + len(rest))))
    models = F.broadcast(pool.sparkSession.createDataFrame(rows, f"run int, best {model}, rest {model}"))

    def like(name: str) -> Column:
        t = F.col(name)
        dense = lambda v, c: F.coalesce(-F.pow(v - c["mu"], F.lit(2)) / c["z"] - F.log(F.sqrt(F.pi() * c["z"])), F.lit(0.0))
        # densities that underflow take no part
        nums = F.zip_with("a.n", t["n"], lambda v, c: F.when(F.pow(v - c["mu"], F.lit(2)) / c["z"] < 700, dense(v, c)).otherwise(0.0))
        syms = F.zip_with("a.s", t["s"], lambda v, c: F.when(v.isNotNull(), F.coalesce(F.get(F.transform(F.array(v), lambda u: F.try_element_at(c, u)), F.lit(0)), t["none"])).otherwise(0.0))
        return F.aggregate(F.concat(nums, syms), t["prior"], lambda total, v: total + F.coalesce(v, F.lit(0.0)))

    return pool.join(models, "run").select("run", "rid", "y", "a", (like("best") - like("rest")).alias("score"))


# --------------------------------------------------------------------------- trees of all runs, holdouts


def grown(rows: DataFrame, leaf: int = 3, depth: int = 4) -> DataFrame:
    """(run, node, n, mid, at, op, v, s): a regression tree for each run's rows (run, a, x, y), all runs a level at a time;
    root 1, yes 2i, no 2i + 1; leaves have no cut. Inputs are named by their place: n000.. and s000.."""
    from ..operators.splits import best, candidates

    name = lambda kind: lambda v, i: F.struct(F.format_string(f"{kind}%03d", i).alias("at"), F.lit(kind == "n").alias("num"), (v if kind == "n" else F.lit(None)).cast("double").alias("x"), (v if kind == "s" else F.lit(None)).cast("string").alias("s"))
    cells = rows.withColumn("cells", F.concat(F.transform("x", name("n")), F.transform("a.s", name("s")))).select("run", F.lit(1).alias("node"), "y", "cells")
    here, levels = keep(cells, "cells"), []
    for level in range(depth + 1):
        stats = here.groupBy("run", "node").agg(F.count("*").alias("n"), F.avg("y").alias("mid"))
        if level == depth:
            levels.append(stats.withColumns({"at": F.lit(None).cast("string"), "op": F.lit(None).cast("string"), "v": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}))
            break
        large = stats.where(F.col("n") >= 2 * leaf).select("run", "node")
        long = here.join(large, ["run", "node"]).select("run", "node", "y", F.explode("cells").alias("c")).select("run", "node", "y", "c.*").where("x IS NOT NULL OR s IS NOT NULL")
        cuts = best(candidates(long, ["run", "node"], leaf), ["run", "node"]).where("at IS NOT NULL").select("run", "node", "at", "op", F.col("x").alias("v"), "s")
        cuts = keep(stats.join(cuts, ["run", "node"], "left"), "cuts")
        levels.append(cuts)
        split = cuts.where("at IS NOT NULL").select("run", "node", "at", "op", "v", "s")
        last, here = here, keep(here.join(split, ["run", "node"]).select("run", (2 * F.col("node") + F.when(_yes(), 0).otherwise(1)).alias("node"), "y", "cells"), "cells")
        drop(last)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _yes() -> Column:
    """Whether a row of cells goes to the yes side of its node's cut; an unknown value does."""
    own = F.get(F.filter("cells", lambda c: c["at"] == F.col("at")), F.lit(0))
    return F.when(F.col("op") == "<=", F.coalesce(own["x"] <= F.col("v"), F.lit(True))).otherwise(F.coalesce(own["s"] == F.col("s"), F.lit(True)))


def guessed(rows: DataFrame, trees: DataFrame, depth: int = 4) -> DataFrame:
    """(run, rid, y, guess, leaf) of rows (run, rid, a, x, y) by the tree of their run; a run's nodes travel as one map."""
    node = F.struct("at", "op", "v", "s", "mid")
    maps = trees.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("node", node.alias("cut")))).alias("tree"))  # 2^depth nodes a run
    out = rows.join(F.broadcast(maps), "run").withColumn("leaf", F.lit(1))
    for _ in range(depth):
        cut = F.try_element_at("tree", F.col("leaf"))
        place = F.substring(cut["at"], 2, 3).cast("int")
        num = F.coalesce(F.get("x", place) <= cut["v"], F.lit(True))
        sym = F.coalesce(F.get("a.s", place) == cut["s"], F.lit(True))
        out = out.withColumn("leaf", F.when(cut["at"].isNull(), F.col("leaf")).otherwise(2 * F.col("leaf") + F.when(F.when(cut["op"] == "<=", num).otherwise(sym), 0).otherwise(1)))
    return out.select("run", "rid", "y", F.try_element_at("tree", F.col("leaf"))["mid"].alias("guess"), "leaf")


def graded(rows: DataFrame, best: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """(run, win): 100 for the best row of the run's table, 0 for its (upper) median, not under -100. best: (run, y)."""
    known = rows.where("y IS NOT NULL")
    low = known.groupBy("file").agg(F.min("y").alias("lo"), F.floor(F.count("*") / 2).alias("k"))
    mid = selected(known, ["file"], "y", low.select("file", "k")).select("file", F.col("v").alias("mid"))
    win = 100 * (1 - (F.col("y") - F.col("lo")) / (F.col("mid") - F.col("lo") + TINY))
    own = best.join(F.broadcast(table_of(runs, rows).select("run", "file")), "run").join(low, "file").join(mid, "file")
    return own.select("run", F.greatest(F.lit(-100.0), F.least(F.lit(100.0), win)).alias("win"))


def holdout(rows: DataFrame, runs: Sequence[Run], check: int = 5, leaf: int = 3, depth: int = 4, **how) -> DataFrame:
    """(run, win, spent, checked): each run labels half of its table within its budget less `check`, grows a tree of these
    labels, labels the `check` rows of the other half that the tree ranks first, and is graded by the best of them."""
    rows = keep(rows.where("y IS NOT NULL"), "table")
    meta, learns = table_of(runs, rows).select("run", "file", "seed"), _hash(F.col("seed"), -1) < "8"  # order(seed, -1) < 0.5
    # the halves of each run are tables of their own
    train = rows.join(F.broadcast(meta), "file").where(learns).select(F.concat("file", F.lit("#"), F.col("run").cast("string")).alias("file"), "rid", "a", "x", "y")
    own = [Run(r.run, f"{r.file}#{r.run}", r.mode, r.budget - check, r.seed) for r in runs]
    labels = keep(acquire(train, own, leaf=leaf, **how), "labels")
    known = rows.join(F.broadcast(labels.select("run", "rid").join(F.broadcast(meta), "run")), ["file", "rid"]).select("run", "rid", "a", "x", "y")
    trees = keep(grown(known, leaf, depth), "trees")

    def test(part: DataFrame) -> DataFrame:
        return guessed(part.where(~learns).select("run", "rid", "a", "x", "y"), trees, depth).withColumn("o", F.round("guess", 9))

    few = slots(test(rows.join(F.broadcast(meta), "file")), check, steps=True).join(F.broadcast(meta), "run")
    near = test(rows.withColumn("slot", slot()).join(F.broadcast(few), ["file", "slot"]))
    top = keep(ranked(near, ["run"], [F.col("o"), F.col("rid")], check), "top")
    best = top.groupBy("run").agg(F.min("y").alias("y"), F.count("*").alias("checked"))
    spent = labels.groupBy("run").agg(F.count("*").alias("spent"))
    return graded(rows, best.select("run", "y"), runs).join(spent, "run").join(best.select("run", "checked"), "run")


#: The arms of a study: name, how to label, budget.
ARMS = (("active20", "active", 20), ("active50", "active", 50), ("active200", "active", 200), ("random50", "random", 50), ("random200", "random", 200))


def study(rows: DataFrame, arms: Sequence[tuple[str, str, str, int]], seeds: int = 20, cap: int | None = None, **how) -> DataFrame:
    """(run, arm, file, mode, budget, seed, win, spent): holdouts of all arms (arm, file, mode, budget) and seeds together, on all
    rows of each table. cap: only for a study that is meant to be of so many hashed rows of each table."""
    if cap is not None:
        rows = firsts(rows.where("y IS NOT NULL").withColumn("o", order(F.lit("cap"))), "file", cap).drop("rank", "o")
    runs = [(a, Run(i * seeds + k, f, m, b, k + 1)) for i, (a, f, m, b) in enumerate(arms) for k in range(seeds)]
    got = holdout(rows, [r for _, r in runs], **how)
    meta = rows.sparkSession.createDataFrame([(r.run, a, r.file, r.mode, r.budget, r.seed) for a, r in runs], "run int, arm string, file string, mode string, budget int, seed int")
    return got.join(F.broadcast(meta), "run")


def verdicts(runs: DataFrame, one: str, two: str) -> DataFrame:
    """(file, verdict): whether the wins of one arm are better, worse, or not told apart from another's, by all three tests of
    equality (stats.same); a study's runs are few."""
    from ..operators.stats import same

    out = []
    wins = keep(runs.where(F.col("arm").isin(one, two)).select("file", "arm", "win"), "wins")
    means = {(r["file"], r["arm"]): r["m"] for r in wins.groupBy("file", "arm").agg(F.avg("win").alias("m")).collect()}  # a row an arm
    for file in sorted({f for f, _ in means}):
        part = lambda a: F.count_if(F.col("arm") == a)
        counts = wins.where(F.col("file") == file).groupBy(F.col("win").alias("v")).agg(part(one).alias("a"), part(two).alias("b"))
        level = bool(same(counts).first()["same"])
        out.append((file, "tie" if level else "win" if means[file, one] > means[file, two] else "loss"))
    return runs.sparkSession.createDataFrame(out, "file string, verdict string")
