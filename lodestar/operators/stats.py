"""Sample statistics on counts of distinct values: running sums, effect sizes, conservative equality, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, keep

#: Ranges that running sums go over at most.
RANGES = 256


def ranges(df: DataFrame, by: str, n: int | None = None) -> Column:
    """The number of a row's range of `by`, of n (by default, one for each shuffle partition): bounds are literals (approximate
    quantiles), so a task that runs again, or a plan that is evaluated twice, puts every row into the same range. A row is
    compared with the logarithm of the number of bounds."""
    n = n or min(RANGES, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.agg(F.percentile_approx(by, [i / n for i in range(1, n)], max(1000, 10 * n))).first()[0] if n > 1 else None
    v, cuts = F.col(by), sorted(set(cuts or []))

    def place(lo: int, hi: int) -> Column:
        """The number of bounds below v, known to be lo to hi."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > F.lit(cuts[mid]), place(mid + 1, hi)).otherwise(place(lo, mid))

    return place(0, len(cuts))


def running(counts: DataFrame, by: str, sums: list[str], keys: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds upto_<s>: the sum of s over rows up to this one in the order of `by` (numbers or times, ties in any order),
    within keys.

    Rows of a key are summed range by range, and each range gets what the ones before it hold, so no task sees all rows
    of a key. `bucket`, if given, is the number of a row's range.
    """
    keys = keys or []
    part = counts.withColumn("_p", F.coalesce(ranges(counts, by) if bucket is None else bucket, F.lit(0)))
    own = Window.partitionBy(*keys, "_p").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy(*keys, "_p").agg(*[F.sum(s).alias(f"_t{i}") for i, s in enumerate(sums)])  # a row a range and key
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))]) if keys else base.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(f"_t{i}").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = part.select("*", *[F.sum(s).over(own).alias(f"_r{i}") for i, s in enumerate(sums)])
    return inner.join(base, same).select(*counts.columns, *[(F.coalesce(F.col(f"_r{i}"), F.lit(0)) + F.col(f"_b{i}")).alias(f"upto_{s}") for i, s in enumerate(sums)])


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Adds the number (from 1) of each row in an order; rows are ranged by the order's first column."""
    part = df.withColumn("_p", F.coalesce(ranges(df, order[0]), F.lit(0)))
    base = part.groupBy("_p").agg(F.count("*").alias("_n"))
    base = base.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a range
    own = part.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return own.join(F.broadcast(base), F.col("_p") == F.col("_q")).select(*df.columns, (F.col("_b") + F.col("_r")).alias(name))


def sliced(df: DataFrame, order: list[str], lo: int, hi: int) -> DataFrame:
    """The rows numbered lo to hi (exclusive, from 0) of an order."""
    return numbered(df, order, "_pos").where(F.col("_pos").between(lo + 1, hi)).drop("_pos")


def kth(df: DataFrame, value: str, k: int):
    """The value at place k (from 0) of the ascending order; exact, on counts of distinct values."""
    counts = keep(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")), "counts")
    return running(counts, "v", ["n"]).agg(F.min(F.when(F.col("upto_n") > k, F.col("v")))).first()[0]


#: Distinct values of a group that one task may order; parts that a pass of `selected` cuts a group into.
FEW, PARTS = 100_000, 256


def selected(df: DataFrame, keys: list[str], value: str, want: DataFrame, few: int = FEW, most: int | None = None) -> DataFrame:
    """(keys, k, v, upto): the value at place k (from 0) of the ascending order of each group, exact, and how many values are
    not above it; want is (keys, k), and a group may ask for several places. Places beyond a group's values give no row.
    most: rows of the largest group, where that is known.

    All groups narrow together: a pass takes approximate percentiles of the values strictly between a group's bounds, counts
    what lies below, at and between the two that enclose the place, and keeps the part that holds it, about a hundredth
    of it. Values at a bound end the search at once, so frequent ones don't stay. What is left, at most `few` rows a
    group, is counted by value and ordered. The number of passes grows with the logarithm of the largest group.
    """
    by, v = [*keys, "k"], F.col("_v")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ask = want.select(*keys, F.col("k").cast("long").alias("k"))
    # _lo, _hi: bounds (exclusive); _r: the place among the values between them
    places = ask.select(*by, F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.col("k").alias("_r"))
    between = (v > F.col("_lo")) & (v < F.col("_hi"))
    found, none = None, F.lit(None).cast("double")
    places = places if most is not None and most <= few else keep(places, "places")
    while most is None or most > few:
        inside = (rows.join(F.broadcast(places), keys) if keys else rows.crossJoin(F.broadcast(places))).where(between)  # places: a row each that is asked for
        steps = F.percentile_approx("_v", [i / PARTS for i in range(PARTS + 1)], 100 * PARTS)
        cuts = keep(inside.groupBy(*by).agg(F.count("*").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_r").alias("_r"), steps.alias("_p")), "cuts")
        if (cuts.agg(F.max("_n")).first()[0] or 0) <= few:
            drop(cuts)
            break
        at = F.col("_r") * PARTS / F.col("_n")
        pick = lambda i: F.get("_p", F.greatest(F.lit(0), F.least(F.lit(PARTS), i)).cast("int"))
        cuts_ = cuts.select(*by, "_lo", "_hi", "_r", pick(F.floor(at) - 1).alias("_a"), pick(F.ceil(at) + 1).alias("_b"))
        near = (rows.join(F.broadcast(cuts_), keys) if keys else rows.crossJoin(F.broadcast(cuts_))).where(between)
        parts = near.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("_lo", "_hi", "_r", "_a", "_b")], F.count_if(v < F.col("_a")).alias("_c0"), F.count_if(v == F.col("_a")).alias("_c1"), F.count_if((v > F.col("_a")) & (v < F.col("_b"))).alias("_c2"), F.count_if((v == F.col("_b")) & (F.col("_b") > F.col("_a"))).alias("_c3"))
        r, upto = F.col("_r"), [sum((F.col(f"_c{i}") for i in range(j)), F.lit(0)) for j in range(5)]
        cases = [(F.col("_lo"), F.col("_a"), none), (none, none, F.col("_a")), (F.col("_a"), F.col("_b"), none), (none, none, F.col("_b")), (F.col("_b"), F.col("_hi"), none)]
        step = F.lit(None).cast("struct<lo:double,hi:double,v:double,r:bigint>")
        for j, (lo, hi, got) in reversed(list(enumerate(cases))):
            # a place that is found keeps in r what makes k - r the number of values up to it
            own = F.struct(lo.alias("lo"), hi.alias("hi"), got.alias("v"), (r - upto[j + 1 if j in (1, 3) else j]).cast("long").alias("r"))
            step = own if j == 4 else F.when(r < upto[j + 1], own).otherwise(step)
        last, parts = places, keep(parts.select(*by, step.alias("s")).select(*by, "s.*"), "parts")
        done = parts.where("v IS NOT NULL").select(*by, "v", (F.col("k") - F.col("r")).alias("upto"))
        found = done if found is None else found.unionByName(done)
        places = keep(parts.where("v IS NULL").select(*by, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("r").alias("_r")), "places")
        drop(last, cuts)
    inside = (rows.join(F.broadcast(places), keys) if keys else rows.crossJoin(F.broadcast(places))).where(between)
    counts = inside.groupBy(*by, "_v", "_r").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    got = counts.withColumn("_u", upto).where("_u > _r").groupBy(*by).agg(F.min("_v").alias("v"), F.min(F.col("_u") - F.col("_r") + F.col("k")).alias("upto"))
    return got if found is None else found.unionByName(got)


def samples(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """(v, a, b): how often each sample has a value."""
    one = a.select(value.cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    two = b.select(value.cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    return one.unionByName(two).where("v IS NOT NULL").groupBy("v").agg(F.sum("x").alias("a"), F.sum("y").alias("b"))


def effects(counts: DataFrame) -> DataFrame:
    """One row: n, m, cliffs (delta), ks, gap in pooled standard deviations (cohen) of two samples' (v, a, b)."""
    counts = keep(counts, "counts")
    upto = running(counts, "v", ["a", "b"])
    total = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    rows = upto.crossJoin(F.broadcast(total))  # one row
    less = F.sum(F.col("a") * (F.col("upto_b") - F.col("b"))).cast("double")  # pairs with b below a
    more = F.sum(F.col("a") * (F.col("m") - F.col("upto_b"))).cast("double")
    ks = F.max(F.abs(F.col("upto_a") / F.col("n") - F.col("upto_b") / F.col("m")))
    mean = lambda s: F.sum(F.col("v") * F.col(s)) / F.sum(s)
    power = lambda s: F.sum(F.col("v") * F.col("v") * F.col(s))
    got = rows.agg(F.max("n").alias("n"), F.max("m").alias("m"), (F.abs(less - more) / F.max("n") / F.max("m")).alias("cliffs"), ks.alias("ks"), mean("a").alias("mu_a"), mean("b").alias("mu_b"), power("a").alias("p_a"), power("b").alias("p_b"))
    var = lambda s, n: F.greatest(F.lit(0.0), F.col(f"p_{s}") - F.col(n) * F.pow(f"mu_{s}", F.lit(2)))
    pooled = F.sqrt((var("a", "n") + var("b", "m")) / F.greatest(F.lit(1), F.col("n") + F.col("m") - 2))
    return got.select("n", "m", "cliffs", "ks", (F.abs(F.col("mu_a") - F.col("mu_b")) / (pooled + 1e-32)).alias("cohen"))


def same(counts: DataFrame, cliff: float = 0.195, conf: float = 1.36, eps: float = 0.35, mode: str = "all") -> DataFrame:
    """Adds `same` to effects: all three tests (or any) call the difference small."""
    e = effects(counts)
    limit = conf * F.sqrt((F.col("n") + F.col("m")) / (F.col("n") * F.col("m")))
    tests = (F.col("cliffs") <= cliff, F.col("ks") <= limit, F.col("cohen") <= eps)
    both = tests[0] & tests[1] & tests[2] if mode == "all" else tests[0] | tests[1] | tests[2]
    return e.withColumn("same", both)


def wins(df: DataFrame, score: str) -> DataFrame:
    """Adds `win`: 100 for the best score, 0 for the (upper) median, not under -100."""
    counts = keep(df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("v")).agg(F.count("*").alias("n")), "counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    row = running(counts, "v", ["n"]).agg(F.min("v"), F.min(F.when(F.col("upto_n") > n // 2, F.col("v")))).first()
    lo, mid = row
    return df.withColumn("win", F.greatest(F.lit(-100.0), F.least(F.lit(100.0), 100 * (1 - (F.col(score) - lo) / (mid - lo + 1e-32)))))


def ranks(means: list[tuple[str, float]], level, big: bool = False) -> dict[str, int]:
    """Ranks of treatments by mean; those that level(a, b) with their rank's champion share it. A fold over few names."""
    out, champion, rank = {}, None, -1
    for name, _ in sorted(means, key=lambda t: (-t[1] if big else t[1], t[0])):
        if champion is None or not level(champion, name):
            champion, rank = name, rank + 1
        out[name] = rank
    return out


def order_values(df: DataFrame, value: str, ranks: list[float]) -> list:
    """The values at floor(rank * n) of the ascending order (the last one for rank 1), exact; nulls take no part."""
    counts = keep(df.where(F.col(f"`{value}`").isNotNull()).groupBy(F.col(f"`{value}`").cast("double").alias("v")).agg(F.count("*").alias("n")), "counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    picks = [F.min(F.when(F.col("upto_n") > min(int(r * n + 1e-9), n - 1), F.col("v"))) for r in ranks]
    return list(running(counts, "v", ["n"]).agg(*picks).first())


def spaced_cuts(df: DataFrame, value: str, bins: int) -> list[float]:
    """At most bins - 1 percentile-spaced cut values, each once."""
    return sorted({v for v in order_values(df, value, [i / bins for i in range(1, bins)]) if v is not None})


def improvements(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Rows whose value is under all values before them in an order. Ranges of the order are scanned apart; each starts
    from the least value of the ranges before it."""
    known = df.where(F.col(value).isNotNull())
    part = known.withColumn("_p", F.coalesce(ranges(known, order[0]), F.lit(0)))
    least = part.groupBy("_p").agg(F.min(value).alias("_v"))  # a row a range
    least = least.select(F.col("_p").alias("_q"), F.min("_v").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    before = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = part.withColumn("_m", F.min(value).over(before)).join(F.broadcast(least), F.col("_p") == F.col("_q"))
    edge = F.least("_m", "_b")  # least skips null
    return rows.where(edge.isNull() | (F.col(value) < edge)).select(*df.columns)


def rank_groups(df: DataFrame, group: str, value: str, big: bool = False) -> dict[str, int]:
    """Ranks of a column's groups by mean value; those that `same` can't tell from their rank's champion share it. Groups
    are few names; each comparison runs on counts of distinct values."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = keep(counts, "counts")
    means = [(r["g"], r["m"]) for r in counts.groupBy("g").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).collect()]

    def level(a: str, b: str) -> bool:
        part = lambda g: F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0))
        return bool(same(counts.where(F.col("g").isin(a, b)).groupBy("v").agg(part(a).alias("a"), part(b).alias("b"))).first()["same"])

    return ranks(means, level, big)


def top_tier(means: list[tuple[str, float]], level, big: bool = False) -> list[str]:
    """The treatments that level with the one of best mean, up to the first that doesn't."""
    names = [n for n, _ in sorted(means, key=lambda t: (-t[1] if big else t[1], t[0]))]
    out = names[:1]
    for n in names[1:]:
        if not level(names[0], n):
            break
        out.append(n)
    return out


def spread_cells(df: DataFrame, a: str, b: str, value: str, eps: float = 0.35) -> DataFrame:
    """(ca, cb, n, spread): points whose a and b differ by less than eps standard deviations share a cell; spread is the
    range of a value inside it."""
    sa, sb = df.agg(F.coalesce(F.stddev_samp(a), F.lit(0.0)), F.coalesce(F.stddev_samp(b), F.lit(0.0))).first()
    code = lambda c, s: F.floor(F.col(c) / (eps * s + 1e-32)).cast("long")
    return df.groupBy(code(a, sa).alias("ca"), code(b, sb).alias("cb")).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread"))
