"""Distances to goals and between rows; nearest rows, anomalies, projections, domination, halving."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import capped, gap_num, gap_sym, logistic, minkowski, minmax
from ..roles import RoleFrame
from ..storage import keep



def norms(rf: RoleFrame, cols: list[str], how: str = "logistic", f: float = 0.15) -> dict[str, Column]:
    """0..1 of each number: logistic of its standard score, minmax, or pctl (between the f and 1 - f order values)."""
    from .stats import order_values

    out = {}
    for c in cols:
        s, v = rf.stats()[c], F.col(f"`{c}`").cast("double")
        if how == "pctl":
            lo, hi = order_values(rf.df, c, [f, 1 - f])
            out[c] = capped(v, lo or 0.0, hi or 0.0)
        else:
            out[c] = logistic(v, s["mu"] or 0.0, s["sd"]) if how == "logistic" else minmax(v, s["lo"] or 0.0, s["hi"] or 0.0)
    return out


def disty(rf: RoleFrame, p: float = 2.0, how: str = "logistic") -> Column:
    """Distance of a row to the ideal of all goals; statistics are literals, so no join runs."""
    n = norms(rf, list(rf.schema.goals), how)
    return minkowski([F.abs(n[c] - heaven) for c, heaven in rf.schema.goals.items()], p)


def coded(rf: RoleFrame) -> DataFrame:
    """rid, n (normalized numbers) and s (symbols) of the inputs: what distx needs of a row."""
    if rf.coded is not None:
        return rf.coded
    nums = [c for c in rf.schema.x if c in rf.schema.nums]
    syms = [c for c in rf.schema.x if c not in rf.schema.nums]
    n = norms(rf, nums)
    return rf.df.select(rf.rid, F.array(*[n[c] for c in nums]).cast("array<double>").alias("n"), F.array(*[F.col(f"`{c}`") for c in syms]).cast("array<string>").alias("s"))


def prepared(rf: RoleFrame) -> RoleFrame:
    """The same frame, its coded rows written once for operators that pass them several times."""
    if rf.coded is None:
        rf.coded = keep(coded(rf), "coded")
    return rf


def distx(a: str | Column, b: str | Column, p: float = 2.0, gower: bool = False) -> Column:
    """Between two coded rows in struct columns a and b. With gower, cells that either row lacks take no part."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if gower:
        nums = F.zip_with(a["n"], b["n"], lambda u, v: F.pow(F.abs(u - v), F.lit(p)))
        syms = F.zip_with(a["s"], b["s"], lambda u, v: (u != v).cast("double"))
        every = F.filter(F.concat(nums, syms), lambda g: g.isNotNull())
        return F.when(F.size(every) > 0, F.pow(F.aggregate(every, F.lit(0.0), lambda t, v: t + v) / F.size(every), F.lit(1 / p)))
    nums = F.zip_with(a["n"], b["n"], lambda u, v: F.pow(gap_num(u, v), F.lit(p)))
    syms = F.zip_with(a["s"], b["s"], lambda u, v: gap_sym(u, v))
    every = F.concat(nums, syms)
    return F.pow(F.aggregate(every, F.lit(0.0), lambda t, v: t + v) / F.size(every), F.lit(1 / p))


def chebyshev_x(a: str | Column, b: str | Column) -> Column:
    """The largest gap of two coded rows over the cells that both have."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    nums = F.zip_with(a["n"], b["n"], lambda u, v: F.abs(u - v))
    return F.array_max(F.concat(nums, F.zip_with(a["s"], b["s"], lambda u, v: (u != v).cast("double"))))


def near(rows: DataFrame, probes: DataFrame, k: int, rid: str = "rid", vector: str = "embedding") -> DataFrame:
    """(probe, rank, rid, d): the k rows nearest to each probe by Euclidean distance, ties to the smaller id; a row is
    not its own neighbour. Tiles (operators.boxes) meet in shuffles; nothing passes through the driver."""
    from .boxes import COPIES, Boxes, nearest

    shaped = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(rid).cast("long").alias("rid"), F.struct(F.col(vector).cast("array<double>").alias("n"), F.array().cast("array<string>").alias("s")).alias("a"))
    index = Boxes(shaped(rows), copies=max(COPIES, k + 1))
    return nearest(index, index if probes is rows else Boxes(shaped(probes)), k, "euclid")


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in an order, with their rank; ranks are limited within partitions before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def anomaly(rows: DataFrame, rid: str = "rid", vector: str = "embedding") -> DataFrame:
    """(rid, gap, score): gap to the nearest other row, and its logistic norm among all gaps."""
    gaps = near(rows, rows, 1, rid, vector).select(F.col("probe").alias("rid"), F.col("d").alias("gap"))
    return scored_gaps(gaps)


def scored_gaps(gaps: DataFrame) -> DataFrame:
    """Adds the logistic norm of each gap among all gaps. They are read twice, so they are written first."""
    gaps = keep(gaps, "gaps")
    mu, sd = gaps.agg(F.avg("gap"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0))).first()
    return gaps.withColumn("score", logistic(F.col("gap"), mu or 0.0, sd))


def literal(row) -> Column:
    """A coded row as a constant."""
    return F.struct(F.array(*map(F.lit, row["n"])).cast("array<double>").alias("n"), F.array(*map(F.lit, row["s"])).cast("array<string>").alias("s"))


def around(rf: RoleFrame, row) -> DataFrame:
    """(rid, d): distance of every row to a coded row; one pass, no join."""
    return coded(rf).select(rf.rid, F.struct("n", "s").alias("a"), literal(row).alias("b")).select(rf.rid, distx("a", "b").alias("d"))


def guess(rows: DataFrame, probes: DataFrame, y: str, k: int = 5) -> DataFrame:
    """(probe, guess): mean y of the k nearest rows."""
    return near(rows, probes, k).join(rows.select("rid", y), "rid").groupBy("probe").agg(F.avg(y).alias("guess"))


def pair_mean(rf: RoleFrame, few: int = 64, seed: object = 1) -> float:
    """Mean distance of all pairs of a hashed sample of few rows: a scale for covers."""
    from .cluster import some

    rows = some(coded(rf), rf.rid, min(few, 256), seed).select(F.col(rf.rid).alias("i"), F.struct("n", "s").alias("a"))
    other = F.broadcast(rows.select(F.col("i").alias("j"), F.col("a").alias("b")))  # few rows
    return rows.join(other, F.col("i") < F.col("j")).agg(F.avg(distx("a", "b"))).first()[0] or 0.0


def farthest(rf: RoleFrame, row) -> tuple:
    """The coded row farthest from a coded row, ties to the smaller id."""
    d = coded(rf).select(F.struct("n", "s").alias("a"), literal(row).alias("b"), rf.rid, "n", "s")
    return d.orderBy(F.desc(F.round(distx("a", "b"), 9)), rf.rid).first()


def project(rf: RoleFrame, east, west) -> DataFrame:
    """(rid, at): where each row lies on the line from east to west, by two distances; one pass."""
    c = coded(rf).select(rf.rid, F.struct("n", "s").alias("a"))
    return c.select(rf.rid, on_line(F.col("a"), literal(east), literal(west)).alias("at"))


def on_line(a: Column, east: Column, west: Column) -> Column:
    """Where a lies on the line from east to west."""
    ab, ea, wa = distx(east, west), distx(a, east), distx(a, west)
    return (ea * ea + ab * ab - wa * wa) / (2 * ab + 1e-32)


#: Points of fronts that one task compares; more are merged range by range.
FRONT = 20_000


def pareto(rf: RoleFrame) -> DataFrame:
    """Rows that none dominates. Points are distinct goal values. With two goals, a point must beat the least second goal
    of all points before it in the order of the first. With more, each task keeps the front of its own points (sort by
    the sum of goals: a point can only be dominated by one before it), and the fronts are merged by `fronts`."""
    from .stats import improvements

    goals = list(rf.schema.goals.items())
    signed = [(-F.col(f"`{c}`") if h else F.col(f"`{c}`")).cast("double").alias(f"g{i}") for i, (c, h) in enumerate(goals)]
    rows = rf.df.select(rf.rid, *signed)
    names = [f"g{i}" for i in range(len(goals))]
    points = rows.select(*names).where(" AND ".join(f"{n} IS NOT NULL" for n in names)).distinct()
    if len(names) == 1:
        front = points.orderBy("g0").limit(1)
    elif len(names) == 2:
        front = improvements(points.groupBy("g0").agg(F.min("g1").alias("g1")), ["g0"], "g1")
    else:

        def skyline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = np.empty((0, len(names)))
            for b in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) if b.num_rows else kept[:0]
                x = np.concatenate([kept, x])
                front: list[np.ndarray] = []
                for p in x[np.lexsort((*x.T, x.sum(1)))]:
                    if not front or not (np.array(front) <= p).all(1).any():
                        front.append(p)
                kept = np.array(front).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(len(names))], names=names)

        front = fronts(keep(points.mapInArrow(skyline, points.schema), "front"), names, skyline)
    return rows.join(front, names, "left_semi").select(rf.rid)


def fronts(local: DataFrame, names: list[str], skyline) -> DataFrame:
    """The front of written points, of which most are undominated already. Few points are one task's work. More are ordered by
    the sum of goals and cut into ranges of FRONT points: a point can only be dominated by one of a smaller sum, so each
    range is thinned by itself and then by the ranges before it, one after another as they become final. What is final is
    written; a range meets it in pieces of FRONT points, so no task holds more than two ranges."""
    from .stats import numbered

    if local.count() <= FRONT:
        return keep(local.repartition(1).mapInArrow(skyline, local.schema), "front")
    total = sum((F.col(n) for n in names), F.lit(0.0))
    ranged = keep(numbered(local.withColumn("_sum", total), ["_sum", *names], "_pos").withColumn("_part", F.floor((F.col("_pos") - 1) / FRONT).cast("int")).drop("_pos", "_sum"), "ranged")
    parts, final = ranged.agg(F.max("_part")).first()[0] + 1, None
    for i in range(parts):
        own = ranged.where(F.col("_part") == i).select(*names).repartition(1).mapInArrow(skyline, local.schema)
        if final is not None:
            pieces = [r[0] for r in final.select("_part").distinct().orderBy("_part").collect()]
            for j in pieces:
                own = keep(_undominated(own, final.where(F.col("_part") == j).select(*names), names), "front")
        own = keep(own.withColumn("_part", F.lit(i)), "front")
        final = own if final is None else final.unionByName(own)
    return final.select(*names)


def _undominated(points: DataFrame, others: DataFrame, names: list[str]) -> DataFrame:
    """The points that none of the others (FRONT at most) dominates; others are no worse in their sum and all distinct."""
    few = np.array([[r[n] for n in names] for r in others.collect()]).reshape(-1, len(names))  # FRONT points at most
    shared = points.sparkSession.sparkContext.broadcast(few)

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) if b.num_rows else np.empty((0, len(names)))
            good = np.ones(len(x), bool)
            for at in range(0, len(x), 64):
                good[at : at + 64] = ~(shared.value[None, :, :] <= x[at : at + 64, None, :]).all(2).any(1)
            yield b.filter(pa.array(good))

    return points.mapInArrow(free, points.schema)


def zitzler(a: list[Column], b: list[Column], heavens: list[int]) -> Column:
    """Whether goals a beat goals b by continuous domination (all normalized)."""
    n = len(a)
    loss = lambda u, v: sum((-F.exp((1 if h else -1) * (x - y) / n) for x, y, h in zip(u, v, heavens, strict=True)), F.lit(0.0)) / n
    return loss(a, b) < loss(b, a)
