"""Samples by hashed order, reservoirs, halving, k-means with symbols, pole grids, covers, prequential Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hashed, uniform
from ..roles import RoleFrame
from ..storage import drop, keep
from .distance import coded, disty, distx, farthest, literal, on_line, prepared, project
from .stats import numbered, order_values, ranges, running, selected


def some(df: DataFrame, key: str, k: int, seed: object = 1) -> DataFrame:
    """k rows without replacement: the first in hashed order (top-k, no full sort)."""
    return df.orderBy(hashed(F.col(key), seed), key).limit(k)


def halves(df: DataFrame, key: str, seed: object = 1) -> DataFrame:
    """Adds `train`: about half of the rows by their hash, without ordering them."""
    return df.withColumn("train", F.substring(hashed(F.col(key), seed), 1, 1) < "8")


#: Rows beyond a reservoir's cap that are looked at, for a cap of one.
SPARE = 32


def reservoir(df: DataFrame, bucket: str, key: str, cap: int, seed: object = 1) -> DataFrame:
    """At most cap rows of each bucket by hashed order, with the number seen. Hashes are even, so the first cap of n rows have
    small ones: only rows under a bound are ordered, and a bucket with too few of those is ordered whole."""
    seen = keep(df.groupBy(bucket).agg(F.count("*").alias("seen")), "seen")
    w = Window.partitionBy(bucket).orderBy(hashed(F.col(key), seed), key)
    first = lambda rows: rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    share = (cap + 8 * cap**0.5 + SPARE) / F.col("seen")
    edge = F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex(F.ceil(share * 4294967296).cast("long"))), 8, "0"))  # no digit of a hash reaches g
    near = df.join(seen.withColumn("_edge", edge), bucket).where(hashed(F.col(key), seed) < F.col("_edge"))
    shape = [bucket, *[c for c in df.columns if c != bucket], "seen"]
    kept = keep(first(near).select(*shape), "reservoir")
    short = keep(kept.groupBy(bucket).agg(F.count("*").alias("_n")).join(seen, bucket, "right").where(F.coalesce("_n", F.lit(0)) < F.least("seen", F.lit(cap))).select(bucket, "seen"), "short")
    if short.where(F.col(bucket).isNotNull()).isEmpty():
        return kept
    return kept.join(short, bucket, "left_anti").unionByName(first(df.join(short, bucket)).select(*shape))


def split_half(df: DataFrame, key: str, seed: object = 1) -> DataFrame:
    """Adds `train`: the first half (n // 2 rows) by hashed order, exactly; ranges of the hash are numbered apart."""
    n = df.count()
    rows = df.withColumn("_u", uniform(F.col(key), seed))
    return numbered(rows, ["_u", key], "_pos").withColumn("train", F.col("_pos") <= n // 2).drop("_u", "_pos")


def poles90(rf: RoleFrame, seed: object = 1, share: float = 0.9):
    """Poles that outliers don't draw away: at `share` of the order by distance, from a hashed start and from the first pole."""
    rows = coded(prepared(rf))
    at, out = some(rows, rf.rid, 1, seed).first(), []
    for _ in range(2):
        d = keep(rows.select(rf.rid, "n", "s", F.round(distx(F.struct("n", "s"), literal(at)), 9).alias("d")), "far")
        edge = place(d, "d", int(share * d.count()))
        at = d.where(F.col("d") == edge).orderBy(rf.rid).first()
        out.append(at)
    return out


def poles(rf: RoleFrame, seed: object = 1):
    """Two rows far from each other, from a hashed start."""
    start = some(coded(prepared(rf)), rf.rid, 1, seed).first()
    east = farthest(rf, start)
    return east, farthest(rf, east)


def place(df: DataFrame, value: str, k: int):
    """The value at place k of the ascending order of a written frame."""
    row = selected(df, [], value, df.sparkSession.range(1).select(F.lit(k).alias("k"))).first()
    return row["v"] if row else None


def halve(rf: RoleFrame, seed: object = 1) -> DataFrame:
    """(rid, near): whether a row is in the half by the better pole (the one nearer to the ideal goals)."""
    east, west = poles(rf, seed)
    d = {r[0]: r[1] for r in rf.df.select(rf.rid, disty(rf)).where(F.col(rf.rid).isin(east[rf.rid], west[rf.rid])).collect()}
    if (d.get(west[rf.rid]) or 0) < (d.get(east[rf.rid]) or 0):
        east, west = west, east
    at = keep(project(rf, east, west).withColumn("at", F.round("at", 9)), "at")
    k = max(1, at.count() // 2)
    edge = place(at, "at", k - 1)  # the last value of the near half; of its ties the smallest ids are near
    low, tied = at.agg(F.count_if(F.col("at") < edge), F.count_if(F.col("at") == edge)).first()
    last = place(at.where(F.col("at") == edge), rf.rid, k - 1 - low) if tied > k - low else float("inf")
    return at.select(rf.rid, "at", ((F.col("at") < edge) | ((F.col("at") == edge) & (F.col(rf.rid) <= last))).alias("near"))


def nodes(rf: RoleFrame, depth: int = 3, stop: int = 4, seed: object = 1) -> DataFrame:
    """(rid, node): halving again and again. All nodes of a level find their poles and their middle in the same jobs;
    children are 2i (by the better pole) and 2i + 1, a node of fewer than 2 * stop rows stays. The driver keeps two poles
    a node. Middles are exact (stats.selected), ties at the middle go to the near side. A level's rows are written to the
    shared folder, which takes the place of the level before."""
    spark = rf.df.sparkSession
    rows = keep(coded(rf).join(rf.df.select(rf.rid, disty(rf).alias("y")), rf.rid).select(rf.rid, F.struct("n", "s").alias("a"), "y", F.lit(1).alias("node")), "nodes")
    shape = rows.schema["a"].dataType.simpleString()
    item = F.struct("a", "y")

    def poles_by(place: DataFrame) -> DataFrame:
        return rows_now.join(F.broadcast(place), "node").groupBy("node").agg(F.max_by(item, F.struct(F.round(distx("a", "b"), 9), -F.col(rf.rid))).alias("p")).select("node", "p.*")

    def small(found: DataFrame) -> DataFrame:  # a row a node
        return spark.createDataFrame(found.collect(), f"node int, b {shape}, yb double")

    rows_now = rows
    for level in range(depth):
        here = rows_now.where(F.col("node") >= 2**level)
        start = here.groupBy("node").agg(F.count("*").alias("n"), F.min_by(item, F.struct(hashed(F.col(rf.rid), seed), rf.rid)).alias("p")).where(F.col("n") >= 2 * stop)
        first = start.select("node", F.col("p.a").alias("b"), F.col("p.y").alias("yb"))
        east = small(poles_by(small(first)))
        west = small(poles_by(east))
        if east.isEmpty():
            break
        both = east.join(west.select("node", F.col("b").alias("w"), F.col("yb").alias("yw")), "node")
        flip = F.coalesce(F.col("yw") < F.col("yb"), F.lit(False))
        both = both.select("node", F.when(flip, F.col("w")).otherwise(F.col("b")).alias("e"), F.when(flip, F.col("b")).otherwise(F.col("w")).alias("w"))
        ab, ea, wa = distx("e", "w"), distx("a", "e"), distx("a", "w")
        at = rows_now.join(F.broadcast(both), "node", "left").withColumn("at", F.round((ea * ea + ab * ab - wa * wa) / (2 * ab + 1e-32), 9))
        at = keep(at.select(rf.rid, "a", "y", "node", "at"), "nodes")
        sizes = at.where("at IS NOT NULL").groupBy("node").agg(F.floor((F.count("*") - 1) / 2).alias("k"))  # a row a node
        mid = spark.createDataFrame(selected(at, ["node"], "at", sizes).select("node", "v").collect(), "node int, mid double")
        side = F.when(F.col("mid").isNull(), F.col("node")).otherwise(2 * F.col("node") + (F.col("at") > F.col("mid")).cast("int"))
        last, rows_now = rows_now, keep(at.join(F.broadcast(mid), "node", "left").select(rf.rid, "a", "y", side.alias("node")), "nodes")
        drop(last, at)
    return rows_now.select(rf.rid, "node")


def delegates(rf: RoleFrame, eps: float, most: int = 64, retreat: float = 0.0, seed: object = 1) -> DataFrame:
    """(rid, kin, d): furthest-point cover. The row farthest from all delegates (or the one `retreat` percent short of it)
    becomes one, until all are nearer than eps; rows join their nearest delegate. Each turn is one pass; a cover that
    would need more than `most` delegates is an error, not a cut."""
    near = keep(coded(rf).select(rf.rid, F.struct("n", "s").alias("a"), F.lit(None).cast("struct<d:double,kin:long>").alias("m")), "near")
    new, kept = some(coded(rf), rf.rid, 1, seed).first(), 0
    while new is not None:
        if kept >= most:
            raise ValueError(f"more than {most} delegates for eps {eps}")
        kept += 1
        own = F.struct(distx("a", "b").alias("d"), F.lit(new[rf.rid]).cast("long").alias("kin"))
        last = near
        near = last.withColumn("b", literal(new)).select(rf.rid, "a", F.least("m", own).alias("m"))  # least skips null
        near = keep(near, "near")
        far = near.where(F.col("m.d") >= eps)
        if retreat:
            edge = far.agg(F.percentile_approx("m.d", 1 - retreat / 100, 10_000)).first()[0]
            far = far.where(F.col("m.d") <= edge) if edge is not None else far
        new = far.orderBy(F.desc(F.round("m.d", 9)), rf.rid).select(rf.rid, "a.n", "a.s").first()
        drop(last)
    return near.select(rf.rid, "m.kin", "m.d")


def live_columns(df: DataFrame, bucket: str, cols: list[str], gap: float = 0.3, least: int = 4) -> DataFrame:
    """(at, gap): columns for which some bucket of `least` known values or more is distributed unlike the crowd, by the
    greatest difference of cumulative shares. Values are counted first, so windows see distinct values."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("at"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]))
    counts = df.select(F.col(bucket).alias("b"), cells.alias("c")).select("b", "c.*").where("v IS NOT NULL").groupBy("at", "b", "v").agg(F.count("*").alias("n"))
    crowd = counts.groupBy("at", "v").agg(F.sum("n").alias("n"))
    total = crowd.groupBy("at").agg(F.sum("n").alias("all"))
    crowd = running(crowd, "v", ["n"], ["at"]).join(F.broadcast(total), "at")  # a row a column
    crowd = crowd.select("at", "v", (F.col("upto_n") / F.col("all")).alias("g"), ((F.col("upto_n") - F.col("n")) / F.col("all")).alias("g0"))
    sizes = counts.groupBy("at", "b").agg(F.sum("n").alias("t")).where(F.col("t") >= least)
    own = running(counts.join(sizes, ["at", "b"]), "v", ["n"], ["at", "b"])
    # a bucket's share is flat between its values, so the gap is greatest at one of them or just before it
    both = own.join(crowd, ["at", "v"])
    d = F.greatest(F.abs(F.col("upto_n") / F.col("t") - F.col("g")), F.abs((F.col("upto_n") - F.col("n")) / F.col("t") - F.col("g0")))
    return both.groupBy("at").agg(F.max(d).alias("gap")).where(F.col("gap") >= gap)


def draws(df: DataFrame, key: str, n: int, seed: object = 1) -> DataFrame:
    """(draw, row...): n rows with replacement; row numbers come from ranges, so no task orders all rows."""
    own, total = numbered(df, [key], "_pos"), df.count()
    picks = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.floor(uniform(F.col("id"), seed) * total) + 1).cast("long").alias("_pos"))
    return picks.join(own.withColumn("_pos", F.col("_pos").cast("long")), "_pos").drop("_pos")


def assigned(rows: DataFrame, rid: str, cents: list[tuple]) -> DataFrame:
    """(rid, a, cluster, d): the nearest centroid (cluster, n, s) of each coded row; centroids are literals, nothing moves."""
    d = [F.struct(F.round(distx(F.col("a"), literal({"n": n, "s": s})), 9).alias("d"), F.lit(i).alias("cluster")) for i, n, s in cents]
    m = F.array_min(F.array(*d))
    return rows.select(rid, "a", m.alias("m")).select(rid, "a", "m.cluster", "m.d")


def recentred(own: DataFrame, nn: int, ns: int) -> list[tuple]:
    """Centroids of assigned rows: means of numbers, modes of symbols (of equal counts the smallest), by counted values."""
    means = own.groupBy("cluster").agg(F.count("*").alias("z"), *[F.avg(F.get("a.n", F.lit(i))).alias(f"n{i}") for i in range(nn)]).collect()  # a row a centroid
    modes: dict = {}
    if ns:
        cells = own.select("cluster", F.posexplode("a.s").alias("i", "v")).where("v IS NOT NULL").groupBy("cluster", "i", "v").count()
        for r in cells.groupBy("cluster", "i").agg(F.min_by("v", F.struct(-F.col("count"), "v")).alias("v")).collect():
            modes[r["cluster"], r["i"]] = r["v"]
    return sorted((r["cluster"], [r[f"n{i}"] for i in range(nn)], [modes.get((r["cluster"], i)) for i in range(ns)]) for r in means)


def kmeans(rf: RoleFrame, k: int = 8, iters: int = 3, seed: object = 1, errors: list | None = None) -> DataFrame:
    """(rid, cluster, d): means of numbers, modes of symbols. Only k-row aggregates leave the tasks. `errors`, if given,
    gets the mean distance of each assignment."""
    rows = coded(prepared(rf)).select(rf.rid, F.struct("n", "s").alias("a"))
    start = some(rows, rf.rid, k, seed).collect()
    cents = [(i, r["a"]["n"], r["a"]["s"]) for i, r in enumerate(start)]
    for _ in range(iters):
        own = assigned(rows, rf.rid, cents)
        if errors is not None:
            errors.append(own.agg(F.avg("d")).first()[0])
        cents = recentred(own, len(cents[0][1]), len(cents[0][2])) if cents else []
    if not cents:
        return rows.select(rf.rid, F.lit(0).alias("cluster"), F.lit(None).cast("double").alias("d"))
    own = assigned(rows, rf.rid, cents)
    if errors is not None:
        errors.append(own.agg(F.avg("d")).first()[0])
    return own.drop("a")


def seeds(rf: RoleFrame, k: int, few: int = 32, seed: object = 1) -> list:
    """k-means++: each next seed is drawn from a hashed pool of few rows, by squared distance to the seeds so far; the
    draw is the hashed number of the turn."""
    import hashlib

    rows = coded(prepared(rf))
    out = [some(rows, rf.rid, 1, seed).first()]
    for step in range(1, k):
        pool = some(rows, rf.rid, few, f"{seed}.{step}").withColumn("a", F.struct("n", "s"))
        d = F.least(*[distx(F.col("a"), literal(r)) for r in out], F.lit(9.0))
        got = pool.select(rf.rid, "n", "s", F.round(d * d, 9).alias("w")).orderBy(rf.rid).collect()  # few rows
        u = int(hashlib.md5(f"{seed}:{step}".encode()).hexdigest()[:8], 16) / 4294967296.0 * sum(r["w"] for r in got)
        for r in got:
            u -= r["w"]
            if u <= 0:
                break
        out.append(r)
    return out


def pole_grid(rf: RoleFrame, dims: int = 2, bins: int = 4, seed: object = 1) -> DataFrame:
    """(rid, bucket): digits of the projections on successive lines between poles, cut at exact order values. All
    dimensions are projected in one pass, their cuts are literals."""
    c = coded(prepared(rf)).select(rf.rid, F.struct("n", "s").alias("a"))
    lines = [poles(rf, f"{seed}.{d}") for d in range(dims)]
    at = c.select(rf.rid, *[F.round(on_line(F.col("a"), literal(e), literal(w)), 9).alias(f"p{d}") for d, (e, w) in enumerate(lines)])
    code = F.lit(0)
    for d in range(dims):
        cuts = order_values(at, f"p{d}", [i / bins for i in range(1, bins)])
        code = code * bins + sum(((F.col(f"p{d}") > v).cast("int") for v in cuts if v is not None), F.lit(0))
    return at.select(rf.rid, code.alias("bucket"))


#: Arrivals of a range, about.
ARRIVALS = 100_000


def prequential(rf: RoleFrame, order: list[str], k: int = 1, m: int = 2, wait: int = 10) -> DataFrame:
    """(pos, want, got, like): each row is classified by naive Bayes from the rows before it, then learned from.

    Arrival order is one sequence by definition. It is cut into ranges of about ARRIVALS rows; each range is counted by class and
    by symbol and class, and gets the sums of the ranges before it, so no task holds the sequence. Within a range, sums before
    each row are cumulated. A row moves once. Classes are few.
    """
    sch = rf.schema
    nums = [c for c in sch.x if c in sch.nums]
    syms = [c for c in sch.x if c not in sch.nums]
    spark, total = rf.df.sparkSession, rf.df.count()
    cut = ranges(rf.df, order[0], min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ARRIVALS))))
    n, s, o = ([f"{c}{i}" for i in range(len(names))] for c, names in (("n", nums), ("s", syms), ("o", order)))
    own = [(F.col(f"`{c}`"), x) for c, x in zip(order, o, strict=True)] + [(F.col(f"`{c}`").cast("double"), x) for c, x in zip(nums, n, strict=True)] + [(F.col(f"`{c}`").cast("string"), x) for c, x in zip(syms, s, strict=True)]
    rows = keep(rf.df.select(F.coalesce(cut, F.lit(0)).alias("part"), F.col(f"`{sch.klass}`").alias("want"), *[c.alias(x) for c, x in own]), "arrivals")
    square = [F.sum(F.col(x) * F.col(x)).alias(f"q{x}") for x in n]
    sums = rows.groupBy("part", F.col("want").cast("string").alias("want")).agg(F.count("*").alias("z"), *[F.count(x).alias(f"c{x}") for x in n], *[F.sum(x).alias(f"t{x}") for x in n], *square).collect()  # a row a range and class
    classes = sorted({r["want"] for r in sums if r["want"] is not None})
    names = ["z", *[f"{c}{x}" for x in n for c in "ctq"]]
    parts = sorted({r["part"] for r in sums})
    at, here = {p: i for i, p in enumerate(parts)}, np.zeros((len(parts), len(classes) + 1, len(names)))
    for r in sums:
        here[at[r["part"]], classes.index(r["want"]) if r["want"] is not None else -1] += [r[x] or 0 for x in names]
    before = here.cumsum(0) - here  # of each range, by class (the last: none)
    kinds = [F.count_if(F.col("want").cast("string") == c).alias(f"k{i}") for i, c in enumerate(classes)]
    cells = rows.select("part", "want", F.posexplode(F.array(*s).cast("array<string>")).alias("at", "symbol")).where("symbol IS NOT NULL").groupBy("part", "at", "symbol").agg(F.count("*").alias("k"), *kinds)
    past = Window.partitionBy("at", "symbol").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    known = cells.select(F.col("part").alias("part_"), "at", "symbol", F.array(*[F.coalesce(F.sum(f"k{i}").over(past), F.lit(0)) for i in range(len(classes))]).cast("array<bigint>").alias("seen"))

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"pos": pa.array([], pa.int64()), "want": left.column("want"), "got": pa.array([], pa.string()), "like": pa.array([], pa.float64())})
        left = left.take(pc.sort_indices(left, [(x, "ascending") for x in o], null_placement="at_start"))
        base = before[at[left.column("part")[0].as_py()]]
        pos = int(base[:, 0].sum()) + 1 + np.arange(left.num_rows)
        want = pc.fill_null(pc.index_in(left.column("want").cast(pa.string()), pa.array(classes, pa.string())), -1).to_numpy()
        values = [left.column(x).to_numpy().astype(float) for x in n]
        valid = [left.column(x).is_valid().to_numpy() for x in n]
        until = lambda x: np.cumsum(x) - x
        mine = [want == c for c in range(len(classes))]
        nk = [base[c, 0] + until(mine[c].astype(float)) for c in range(len(classes))]
        nh = sum((x > 0).astype(float) for x in nk) if nk else 0.0
        codes, seen = [], []
        for i, x in enumerate(s):
            d = left.column(x).combine_chunks().dictionary_encode()
            mark = right.filter(pc.equal(right.column("at"), i))
            old = dict(zip(mark.column("symbol").to_pylist(), mark.column("seen").to_pylist(), strict=True))
            codes.append(d.indices.fill_null(-1).to_numpy(zero_copy_only=False))
            seen.append(np.array([old[v] for v in d.dictionary.to_pylist()], float).reshape(-1, len(classes)))
        sorts = [np.argsort(c, kind="stable") for c in codes]
        best, name, top = np.full(left.num_rows, np.inf), np.full(left.num_rows, -1), np.full(left.num_rows, -np.inf)
        with np.errstate(all="ignore"):
            for c in range(len(classes)):
                prior = (nk[c] + k) / (pos - 1 + k * nh)
                like = np.log(prior)
                for i, v in enumerate(values):
                    use = mine[c] & valid[i]
                    w = np.where(use, v, 0.0)
                    z, t, q = (base[c, 1 + 3 * i + j] + until(x) for j, x in enumerate((use.astype(float), w, w * w)))
                    var = np.where(z < 2, 0.0, np.maximum(0.0, q - t * t / z) / (z - 1))
                    wide = 2 * var + 1e-32
                    p = np.exp(-((v - t / np.maximum(z, 1)) ** 2) / wide) / np.sqrt(np.pi * wide)
                    like = like + np.where(valid[i] & (p > 0), np.log(p), 0.0)
                for code, old, by in zip(codes, seen, sorts, strict=True):
                    f = until(mine[c][by].astype(float))
                    f = f - f[np.searchsorted(code[by], code[by])]
                    count = np.empty(len(f))
                    count[by] = f
                    count = count + (old[code, c] if len(old) else 0.0)
                    p = (count + m * prior) / (nk[c] + m)
                    like = like + np.where((code >= 0) & (p > 0), np.log(p), 0.0)
                first = (nk[c] > 0) & (np.round(-like, 9) < best)
                best, name = np.where(first, np.round(-like, 9), best), np.where(first, c, name)
                top = np.where(nk[c] > 0, np.maximum(top, like), top)
        out = (pos > wait) & (name >= 0)
        got = pa.array(classes, pa.string()).take(pa.array(name[out]))
        return pa.table({"pos": pa.array(pos[out].astype(np.int64)), "want": left.column("want").filter(pa.array(out)), "got": got, "like": pa.array(top[out])})

    kind = rows.schema["want"].dataType.simpleString()
    return rows.groupBy("part").cogroup(known.groupBy("part_")).applyInArrow(told, f"pos long, want {kind}, got string, like double")
