"""Labels on demand, and synthetic rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import gaussian, hashed, roulette
from ..operators.summary import symbols
from ..roles import RoleFrame
from ..storage import keep


class Ledger:
    """Labels that a model gives on demand, kept in a table (rid, label): only rows that have none are shown the model."""

    def __init__(self, spark: SparkSession, where: str, model: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.where, self.model = spark, where, model

    def known(self) -> DataFrame:
        try:
            return self.spark.read.schema("rid long, label double").parquet(self.where)
        except AnalysisException:  # nothing labelled yet
            return self.spark.createDataFrame([], "rid long, label double")

    def label(self, rows: DataFrame) -> DataFrame:
        """rows with their labels; the model takes rows and returns (rid, label)."""
        self.model(rows.join(self.known().select("rid"), "rid", "left_anti")).select(F.col("rid").cast("long"), F.col("label").cast("double")).write.mode("append").parquet(self.where)
        return rows.join(self.known(), "rid", "left")


# --------------------------------------------------------------------------- synthetic rows


def mutated(rf: RoleFrame, n: int, seed: object = 1) -> DataFrame:
    """(rid, inputs): every row with n input cells drawn anew."""
    syms = [c for c in rf.schema.x if c not in rf.schema.nums]
    counts: dict[str, dict[str, int]] = {}
    for r in symbols(rf.df, syms).collect() if syms else []:  # values of symbols
        counts.setdefault(r["col"], {})[r["value"]] = r["n"]
    return changed(rf, rf.df, rf.rid, n, seed, counts, [rf.rid])


def changed(rf: RoleFrame, rows: DataFrame, key: str, n: int | Column, seed: object, counts: dict[str, dict[str, int]], others: list[str]) -> DataFrame:
    """(others, inputs): rows with n input cells drawn anew: numbers about their old value with the column's spread, kept within
    three of it; symbols by their counts in the view. Which cells, and the draws, are hashed by the key."""
    sch, st = rf.schema, rf.stats()
    k = F.col(key)
    order = F.transform(F.array_sort(F.array(*[F.struct(hashed(k, f"{seed}.{j}").alias("h"), F.lit(j).alias("j")) for j in range(len(sch.x))])), lambda s: s["j"])
    rows = rows.withColumn("_cells", F.slice(order, F.lit(1), n if isinstance(n, Column) else F.lit(n)))
    out = []
    for j, c in enumerate(sch.x):
        v = F.col(f"`{c}`")
        if c in sch.nums:
            mu, sd = st[c]["mu"] or 0.0, st[c]["sd"]
            drawn = gaussian(k, f"{seed}.{j}.v", 0.0, 1.0) * sd + F.coalesce(v, F.lit(mu))
            new = F.greatest(F.lit(mu - 3 * sd), F.least(F.lit(mu + 3 * sd), drawn))
        else:
            new = roulette(k, f"{seed}.{j}.v", counts[c]) if counts.get(c) else v
        out.append(F.when(F.array_contains("_cells", j), new).otherwise(v).alias(c))
    return rows.select(*others, *out)


def synthesized(rf: RoleFrame, leaf, n: int, seed: object = 1, least: int = 3) -> DataFrame:
    """(draw, leaf, inputs): n rows made inside leaves (an expression: a tree's, or a cluster's): of a leaf with `least` rows
    or more, drawn by its size, three rows a, b, c give a + (b - c) / 2 for numbers, wrapped into the column, and a's or
    b's symbol. Draws meet rows by their number within the leaf, by an equi-join."""
    from ..functions.columns import extrapolated, uniform
    from ..operators.stats import numbered

    sch, st = rf.schema, rf.stats()
    rows = rf.df.withColumn("_leaf", leaf).withColumn("_key", F.col("_leaf") + uniform(F.col(rf.rid), seed))
    rows = keep(numbered(rows, ["_key", rf.rid], "_pos"), "numbered")  # read for the sizes and for each of three rows
    sizes = rows.groupBy("_leaf").agg(F.min("_pos").alias("_lo"), F.count("*").alias("_n")).where(F.col("_n") >= least).orderBy("_leaf").collect()  # a row a leaf
    total = sum(r["_n"] for r in sizes)
    draws = rf.df.sparkSession.range(n).withColumnRenamed("id", "draw")
    if not total:
        return draws.limit(0).select("draw", F.lit(None).cast("int").alias("leaf"), *[F.lit(None).alias(c) for c in sch.x])
    u, upto, at = F.floor(uniform(F.col("draw"), f"{seed}.l") * total), 0, F.lit(None).cast("struct<leaf:int,lo:bigint,n:bigint>")
    for r in reversed(sizes):
        upto += r["_n"]
        at = F.when(u < total - upto + r["_n"], F.struct(F.lit(r["_leaf"]).cast("int").alias("leaf"), F.lit(r["_lo"]).cast("bigint").alias("lo"), F.lit(r["_n"]).cast("bigint").alias("n"))).otherwise(at)
    draws = draws.select("draw", at.alias("t")).select("draw", "t.*")
    for k, name in enumerate("abc"):  # three different rows: a hashed start and two hashed steps
        step = F.floor(uniform(F.col("draw"), f"{seed}.{name}") * F.when(F.lit(k == 0), F.col("n")).otherwise((F.col("n") - 1) / 2))
        place = step if k == 0 else (F.col("ia") + 1 + step if k == 1 else F.col("ib") + 1 + step)
        draws = draws.withColumn(f"i{name}", place.cast("bigint"))
    for name in "abc":
        own = rows.select(F.col("_pos").cast("bigint").alias(f"p{name}"), F.struct(*[F.col(f"`{c}`").alias(f"x{j}") for j, c in enumerate(sch.x)]).alias(name))
        draws = draws.withColumn(f"p{name}", F.col("lo") + F.col(f"i{name}") % F.col("n")).join(own, f"p{name}")
    out = []
    for j, c in enumerate(sch.x):
        a, b, z = (F.col(f"{k}.x{j}") for k in "abc")
        out.append((extrapolated(a, b, z, st[c]["mu"] or 0.0, st[c]["sd"]) if c in sch.nums else F.when(uniform(F.col("draw"), f"{seed}.{j}") < 0.5, a).otherwise(b)).alias(c))
    return draws.select("draw", "leaf", *out)
