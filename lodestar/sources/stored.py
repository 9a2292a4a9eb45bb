"""Summaries that are kept and merged: a table's slices leave their counts, means and squared deviations in a folder; new slices
alone are read, and slices that are gone are taken out again, without reading what stays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS, SYMBOLS = "slice string, col string, n long, mean double, m2 double", "slice string, col string, value string, n long"


def parts(df: DataFrame, by: str, nums: list[str], syms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of each slice: (slice, col, n, mean, m2) of numbers, (slice, col, value, n) of symbols; known cells only."""
    own = F.col(f"`{by}`").cast("string").alias("slice")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("v")) for c in nums])) if nums else None
    empty = lambda kind: df.sparkSession.createDataFrame([], kind)
    x = empty(NUMBERS)
    if nums:
        long = df.select(own, cells.alias("c")).select("slice", "c.*").where("v IS NOT NULL")
        x = long.groupBy("slice", "col").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("m2"))
    s = empty(SYMBOLS)
    if syms:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in syms]))
        s = df.select(own, cells.alias("c")).select("slice", "c.*").where("value IS NOT NULL").groupBy("slice", "col", "value").agg(F.count("*").alias("n"))
    return x, s


def combined(numbers: DataFrame, sign: str | None = None) -> DataFrame:
    """(col, n, mu, sd): parts (col, n, mean, m2) together by Chan's formula: deviations of the parts, and of their means from the
    common mean. sign: a column of 1 and -1, for parts to add and to take out."""
    w = F.col("n") * (F.lit(1) if sign is None else F.col(sign))
    total = numbers.groupBy("col").agg(F.sum(w).alias("_n"), F.sum(w * F.col("mean")).alias("_t"))
    mean = F.col("_t") / F.col("_n")
    rows = numbers.join(F.broadcast(total.where("_n > 0")), "col")  # a row a column
    one = F.lit(1) if sign is None else F.col(sign)
    m2 = F.sum(one * F.col("m2") + w * F.pow(F.col("mean") - mean, F.lit(2)))
    got = rows.groupBy("col").agg(F.first("_n").alias("n"), F.first(mean).alias("mu"), m2.alias("m2"))
    return got.select("col", "n", "mu", F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("m2")) / (F.col("n") - 1))).alias("sd"))


class Summaries:
    """The summaries of a sliced table in a folder. A slice doesn't change once it is there; it comes and goes as a whole."""

    def __init__(self, spark: SparkSession, where: str, by: str, nums: list[str], syms: list[str] | None = None) -> None:
        self.spark, self.where, self.by, self.nums, self.syms = spark, where.rstrip("/"), by, nums, syms or []

    def _read(self, name: str, kind: str) -> DataFrame:
        try:
            return self.spark.read.schema(kind).parquet(f"{self.where}/{name}")
        except AnalysisException:  # nothing kept yet
            return self.spark.createDataFrame([], kind)

    def known(self) -> list[str]:
        return [r[0] for r in self._read("seen", "slice string").distinct().collect()]  # a row a slice

    def refresh(self, df: DataFrame) -> tuple[list[str], list[str]]:
        """Brings the folder up to the table: returns the slices that were read and those that were dropped. Slices are told by
        the values of one column, the filter on it reaches the scan of the new ones."""
        own = F.col(f"`{self.by}`")
        here = {r[0] for r in df.select(own.cast("string")).distinct().collect() if r[0] is not None}  # a row a slice
        before = set(self.known())
        new, gone = sorted(here - before), sorted(before - here)
        if gone:
            keep = lambda name, kind: self._read(name, kind).where(~F.col("slice").isin(gone))
            tables = {n: keep(n, k).toArrow() for n, k in (("numbers", NUMBERS), ("symbols", SYMBOLS), ("seen", "slice string"))}  # summaries, not rows
            for name, rows in tables.items():
                self.spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{self.where}/{name}")
        if new:
            rows = df.where(own.isin([_typed(df, self.by, v) for v in new]))
            x, s = parts(rows, self.by, self.nums, self.syms)
            x.write.mode("append").parquet(f"{self.where}/numbers")
            s.write.mode("append").parquet(f"{self.where}/symbols")
            self.spark.createDataFrame([(v,) for v in new], "slice string").write.mode("append").parquet(f"{self.where}/seen")  # last: a slice counts once it is complete
        return new, gone

    def numbers(self) -> DataFrame:
        """(col, n, mu, sd) of all slices that are kept."""
        return combined(self._read("numbers", NUMBERS).join(F.broadcast(self._read("seen", "slice string").distinct()), "slice").drop("slice"))

    def symbols(self) -> DataFrame:
        """(col, value, n)."""
        own = self._read("symbols", SYMBOLS).join(F.broadcast(self._read("seen", "slice string").distinct()), "slice")
        return own.groupBy("col", "value").agg(F.sum("n").alias("n"))


def _typed(df: DataFrame, column: str, value: str):
    """A value of a column, of its type."""
    kind = df.schema[column].dataType.simpleString()
    return F.lit(value).cast(kind)
