"""Readers and writers: header-typed CSV, role views over parquet tables, synthetic pools, sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..roles import RoleFrame, RoleSchema


def path(text: str, data: str = "") -> str:
    """Variables and ~ expanded; a bare name is under `data`."""
    text = os.path.expanduser(os.path.expandvars(text))
    return text if "/" in text or not data else f"{data}/{text}"


def cell(v: Column) -> Column:
    """A number, or null for ? and for what is no number (NaN too)."""
    n = v.try_cast("double")
    return F.when(~F.isnan(n), n)


def read_csv(spark: SparkSession, where: str, comment: str | None = "#", drop_ignored: bool = False, skip_empty: bool = False) -> RoleFrame:
    """First line: names. Cells are stripped, ? is null, what follows a comment sign goes, blank lines and a BOM too."""
    return parse_lines(spark.read.text(where).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("rid")), comment, drop_ignored, skip_empty)


def parse_lines(lines: DataFrame, comment: str | None = "#", drop_ignored: bool = False, skip_empty: bool = False) -> RoleFrame:
    """Lines (rid, line) as a table; the one of smallest rid has the names. drop_ignored: columns whose name ends in X are
    not read. skip_empty: cells with nothing between commas don't count as cells."""
    lines = lines.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))
    if comment:
        lines = lines.withColumn("line", F.regexp_replace("line", comment + ".*$", ""))
    lines = lines.where(F.trim("line") != "")
    header = lines.orderBy("rid").first()
    names = [n.strip() for n in header["line"].split(",")]
    schema = RoleSchema.parse([n for n in names if not (drop_ignored and n.endswith("X"))])
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = lines.where(F.col("rid") != header["rid"]).withColumn("c", F.filter(parts, lambda x: x != "") if skip_empty else parts)
    value = lambda i: F.when(F.get("c", F.lit(i)) != "?", F.get("c", F.lit(i)))
    cols = [(cell(value(i)) if n in schema.nums else value(i)).alias(n) for i, n in enumerate(names) if n in schema.names]
    return RoleFrame(rows.select("rid", *cols), "rid", schema)


def from_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> RoleFrame:
    """A table from a list: numbers by the names' case, others as text; ? is null."""
    schema = RoleSchema.parse(names)
    clean = [(i, *(None if v in ("?", None) else float(v) if n in schema.nums else str(v) for n, v in zip(names, r, strict=True))) for i, r in enumerate(rows)]
    kinds = ", ".join(f"`{n}` {'double' if n in schema.nums else 'string'}" for n in names)
    return RoleFrame(spark.createDataFrame(clean, f"rid long, {kinds}"), "rid", schema)


def warm_up(rf: RoleFrame, n: int) -> RoleFrame:
    """The first n rows by id, for what is frozen before the rest comes."""
    return rf.clone(rf.df.orderBy(rf.rid).limit(n))


def frozen_codes(warm: RoleFrame, bins: int = 5) -> dict[str, Column]:
    """An expression for each input that codes any row by the statistics of the warm-up rows: numbers by normalized bins
    (0: unknown), symbols by their order among the symbols seen (0: not seen)."""
    from ..functions.columns import norm_bin, ordinal
    from ..operators.distance import norms

    n = norms(warm, [c for c in warm.schema.x if c in warm.schema.nums])
    out = {c: norm_bin(v, bins).cast("int") for c, v in n.items()}
    for c in warm.schema.x:
        if c not in n:
            seen = [r[0] for r in warm.df.select(f"`{c}`").distinct().collect() if r[0] is not None]  # of few rows
            out[c] = ordinal(F.col(f"`{c}`"), seen)
    return {c: out[c] for c in warm.schema.x}


def mock64(spark: SparkSession, n: int | DataFrame = 64, width: int = 2, seed: int = 1) -> RoleFrame:
    """Uniform inputs and a class by their sum, for tests."""
    x = pool(spark, n, width, seed)
    total = sum((F.col(f"X{i}") for i in range(1, width + 1)), F.lit(0.0))
    return RoleFrame(x.withColumn("class!", F.when(total < width / 2, "lo").otherwise("hi")), "rid")


def role_view(spark: SparkSession, sf_dir: str, name: str) -> RoleFrame:
    """A table under names that tell roles."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    if name == "part":
        return RoleFrame(t("part").selectExpr("p_partkey AS rid", "p_brand", "p_type", "CAST(p_size AS double) AS `P_size+`", "p_retailprice AS `P_retailprice-`"), "rid")
    if name == "line":
        return RoleFrame(t("lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS rid", "l_quantity AS L_quantity", "l_tax AS L_tax", "l_returnflag", "l_linestatus", "l_extendedprice AS `L_extendedprice-`", "l_discount AS `L_discount+`"), "rid")
    if name == "order":
        joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return RoleFrame(joined.selectExpr("o_orderkey AS rid", "c_acctbal AS C_acctbal", "c_mktsegment", "o_orderpriority", "CAST(n_regionkey AS string) AS n_regionkey", "o_totalprice AS `O_totalprice+`", "o_orderstatus AS `o_orderstatus!`"), "rid")
    if name == "event":
        return RoleFrame(t("events").selectExpr("event_id AS rid", "ts AS tX", "CAST(hour(ts) AS double) AS Hour", "CAST(user_id % 8 AS string) AS u", "value AS `Value-`", "event_type AS `event_type!`"), "rid")
    if name == "doc":
        joined = t("documents").join(t("labels"), "doc_id", "left")
        return RoleFrame(joined.selectExpr("doc_id AS rid", "CAST(n_chars AS double) AS N_chars", "lang", "source", "CAST(quality AS string) AS `quality!`"), "rid")
    if name == "vec":
        e = t("embeddings")
        return RoleFrame(e.select(F.col("vec_id").alias("rid"), "embedding", F.col("label").cast("string").alias("label!")), "rid", RoleSchema(("embedding", "label!"), klass="label!"))
    raise KeyError(name)


def pool(spark: SparkSession, n: int | DataFrame, width: int, seed: int = 1) -> DataFrame:
    """Synthetic rows: rid and uniform X1..Xwidth, the same for the same seed: n of them, or one for each row of a frame (rid)."""
    base = spark.range(n).withColumnRenamed("id", "rid") if isinstance(n, int) else n
    return base.select("rid", *[uniform(F.col("rid"), f"{seed}.{i}").alias(f"X{i}") for i in range(1, width + 1)])


def binned(rf: RoleFrame, bins: int = 5) -> DataFrame:
    """Inputs as codes (numbers by cuts of equal frequency; symbols stay), goals raw."""
    from ..functions.columns import cut_code
    from ..operators.stats import order_values

    cols = [F.col(rf.rid)]
    for c in rf.schema.names:
        v = F.col(f"`{c}`")
        if c in rf.schema.x and c in rf.schema.nums:
            v = F.when(v.isNotNull(), cut_code(v, order_values(rf.df, c, [i / bins for i in range(1, bins)])))
        cols.append(v.alias(c))
    return rf.df.select(*cols)


def write_binned(rf: RoleFrame, where: str, bins: int = 5) -> None:
    binned(rf, bins).drop(rf.rid).write.mode("overwrite").option("header", True).option("nullValue", "?").csv(where)


def write_results(rows: DataFrame, where: str) -> None:
    """A JSON object a line."""
    rows.write.mode("overwrite").json(where)


def histogram(df: DataFrame, value: Column, lo: float, width: float) -> DataFrame:
    """(bin, n)."""
    return df.groupBy(F.floor((value - lo) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, value: str) -> DataFrame:
    """min, quartiles at n//4, n//2, 3n//4 of the order, max; exact. Works on counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    from ..operators.stats import running

    upto = running(counts, "v", ["n"])
    pick = lambda k: F.min(F.when(F.col("upto_n") > k, F.col("v")))
    return upto.agg(F.min("v").alias("lo"), pick(total // 4).alias("q1"), pick(total // 2).alias("q2"), pick(3 * total // 4).alias("q3"), F.max("v").alias("hi"))


def tally(df: DataFrame, delta: Column) -> DataFrame:
    return df.agg(F.count_if(delta > 0).alias("wins"), F.count_if(delta < 0).alias("losses"), F.count_if(delta == 0).alias("ties"))
