"""Summaries of columns, mergeable by construction: counts, centers, diversity, centroids, degenerate columns, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..roles import RoleFrame


def numbers(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, col, n, mu, sd) in long form, in one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]))
    long = df.select(*(keys or []), pairs.alias("p")).select(*(keys or []), "p.*")
    return long.groupBy(*(keys or []), "col").agg(F.count("v").alias("n"), F.avg("v").alias("mu"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))


def symbols(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, col, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
    long = df.select(*(keys or []), pairs.alias("p")).select(*(keys or []), "p.*")
    return long.where("value IS NOT NULL").groupBy(*(keys or []), "col", "value").agg(F.count("*").alias("n"))


def centers(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, col, mode, entropy) of symbol counts; of equal counts the smallest value is the mode."""
    by = [*(keys or []), "col"]
    total = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
    return total.select(*by, "mode", (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def merge(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Counts of a and b together, or of a without b."""
    both = a.unionByName(b.withColumn("n", sign * F.col("n")))
    return both.groupBy("col", "value").agg(F.sum("n").alias("n")).where("n > 0")


def moments(df: DataFrame, v: Column, sign: Column | None = None) -> DataFrame:
    """n, sum and square sum; with a sign column (1 or -1), of inserts without deletes."""
    s = F.lit(1) if sign is None else sign
    return df.agg(F.sum(s).alias("n"), F.sum(s * v).alias("s"), F.sum(s * v * v).alias("q"))


def centroid(rf: RoleFrame) -> DataFrame:
    """One row: mean of each number, mode of each symbol (of counted values: no buffer holds a column)."""
    sch = rf.schema
    means = rf.df.agg(*[F.avg(f"`{c}`").alias(c) for c in sch.names if c in sch.nums], F.count("*").alias("_n"))
    modes = {r["col"]: r["mode"] for r in centers(symbols(rf.df, list(sch.syms))).collect()} if sch.syms else {}  # a row a column
    return means.select(*[F.col(f"`{c}`") if c in sch.nums else F.lit(modes.get(c)).cast("string").alias(c) for c in sch.names])


def degenerate(df: DataFrame, cols: list[str], missing: float = 0.5, ids: float = 0.9, most: float = 0.95) -> DataFrame:
    """(col, verdict): missing, id, const or ok."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
    long = df.select(pairs.alias("p")).select("p.*").groupBy("col", "value").agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    got = long.groupBy("col").agg(F.sum("n").alias("rows"), known.alias("known"), F.count("value").alias("kinds"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"))
    verdict = F.when(F.col("rows") - F.col("known") > missing * F.col("rows"), "missing").when(F.col("kinds") > ids * F.col("known"), "id").when(F.col("top") > most * F.col("known"), "const").otherwise("ok")
    return got.select("col", verdict.alias("verdict"))


def confusion(df: DataFrame, want: str, got: str) -> DataFrame:
    """Per class: tn, fn, fp, tp, acc, pd, pf."""
    pairs = df.groupBy(F.col(want).alias("w"), F.col(got).alias("g")).agg(F.count("*").alias("n"))
    classes = pairs.select(F.explode(F.array("w", "g")).alias("klass")).distinct()
    rows = pairs.crossJoin(F.broadcast(classes))  # a row for each pair of classes that occurs, times classes
    w, g, n = F.col("w") == F.col("klass"), F.col("g") == F.col("klass"), F.col("n")
    part = lambda c: F.sum(F.when(c, n).otherwise(0))
    out = rows.groupBy("klass").agg(part(~w & ~g).alias("tn"), part(w & ~g).alias("fn"), part(~w & g).alias("fp"), part(w & g).alias("tp"))
    tn, fn, fp, tp = (F.col(c) for c in ("tn", "fn", "fp", "tp"))
    return out.select("*", ((tn + tp) / (tn + fn + fp + tp)).alias("acc"), (tp / F.greatest(F.lit(1), tp + fn)).alias("pd"), (fp / F.greatest(F.lit(1), fp + tn)).alias("pf"))


def unfairness(df: DataFrame, want: str, got: str, group: str, positive: str) -> DataFrame:
    """max of |pd gap| and |pf gap| between the largest group and the rest."""
    hit, yes = F.col(got) == positive, F.col(want) == positive
    per = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(F.when(yes, hit.cast("double"))).alias("pd"), F.avg(F.when(~yes, hit.cast("double"))).alias("pf"))
    w = Window.orderBy(F.desc("n"), "g")
    first = per.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("pd").alias("pd1"), F.col("pf").alias("pf1"))
    return per.crossJoin(F.broadcast(first)).agg(F.max(F.greatest(F.abs(F.col("pd") - F.col("pd1")), F.abs(F.col("pf") - F.col("pf1")))).alias("gap"))


def musd(df: DataFrame, v: Column) -> DataFrame:
    """Mean and population standard deviation."""
    return df.agg(F.avg(v).alias("mu"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("sd"))


def kept_columns(df: DataFrame, cols: list[str], **limits: float) -> list[str]:
    """The columns that are not degenerate."""
    good = {r["col"] for r in degenerate(df, cols, **limits).collect() if r["verdict"] == "ok"}  # a row a column
    return [c for c in cols if c in good]


def transpose(df: DataFrame, key: str, cols: list[str], most: int = 1000) -> DataFrame:
    """(col, one column for each value of the key): columns become rows. More than `most` rows are an error."""
    names = [r[0] for r in df.select(key).distinct().orderBy(key).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} rows to turn into columns")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols]))
    return df.select(key, cells.alias("c")).select(key, "c.*").groupBy("col").pivot(key, names).agg(F.first("v"))


def node_stats(rows: DataFrame, node: str, goals: dict[str, Column], y: Column, klass: Column | None = None) -> DataFrame:
    """Per node: n, mean of each goal, mean y, and the class that most rows have (ties to the smallest)."""
    out = rows.groupBy(node).agg(F.count("*").alias("n"), *[F.avg(g).alias(c) for c, g in goals.items()], F.avg(y).alias("y"))
    if klass is None:
        return out
    counts = rows.groupBy(node, klass.alias("klass")).agg(F.count("*").alias("m")).where("klass IS NOT NULL")
    return out.join(counts.groupBy(node).agg(F.min_by("klass", F.struct(-F.col("m"), "klass")).alias("klass")), node, "left")
