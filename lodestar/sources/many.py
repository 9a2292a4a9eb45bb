"""Many tables of different headers as one: rows are (file, rid, cells), columns are a small frame (file, at, name, num, role,
heaven), and statistics, codes, distances to goals and splits of all files come from the same jobs, keyed by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import RoleFrame, RoleSchema
from .tables import cell

#: Columns of all files together: the frame of columns goes out in broadcasts.
MOST = 200_000


class Many:
    """rows: (file, rid, cells array<string>); columns: (file, at, name, num, role, heaven), with the place of a column's cell."""

    def __init__(self, rows: DataFrame, columns: DataFrame) -> None:
        self.rows, self.columns = rows, columns

    @classmethod
    def of(cls, views: dict[str, RoleFrame]) -> Many:
        """Role views under one roof: cells as text (of numbers, the shortest that reads back as the same)."""
        spark, rows, heads = next(iter(views.values())).df.sparkSession, None, []
        for name, rf in views.items():
            own = rf.df.select(F.lit(name).alias("file"), F.col(rf.rid).cast("long").alias("rid"), F.array(*[F.col(f"`{c}`").cast("string") for c in rf.schema.names]).alias("cells"))
            rows = own if rows is None else rows.unionByName(own)
            heads.append((name, list(rf.schema.names)))
        return cls(rows, headed(spark, heads))

    @classmethod
    def read(cls, spark: SparkSession, folder: str, comment: str = "#") -> Many:
        """All CSV files under a folder, the first line of each names its columns. Cells are stripped, ? is null; blank lines
        and what follows a comment sign go. A file without lines has no rows."""
        lines = spark.read.text(folder, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("file"), F.monotonically_increasing_id().alias("rid"), F.col("value").alias("line"))
        lines = lines.withColumn("line", F.trim(F.regexp_replace(F.regexp_replace("line", "^﻿", ""), comment + ".*$", ""))).where("line <> ''")
        first = lines.groupBy("file").agg(F.min(F.struct("rid", "line")).alias("h")).select("file", "h.*")
        heads = first.orderBy("file").limit(MOST + 1).collect()  # a row a file
        columns = headed(spark, [(r["file"], [n.strip() for n in r["line"].split(",")]) for r in heads])
        body = lines.join(F.broadcast(first.select("file", F.col("rid").alias("top"))), "file").where("rid <> top")
        cells = F.transform(F.split("line", ","), lambda c: F.when(F.trim(c) != "?", F.trim(c)))
        return cls(body.select("file", "rid", cells.alias("cells")), columns)

    def long(self, *roles: str) -> DataFrame:
        """(file, rid, at, name, num, role, x, s): a row for each known cell of columns of the roles (x, y, klass, skip); x of
        numbers, s of symbols."""
        cells = self.rows.select("file", "rid", F.posexplode("cells").alias("at", "v")).join(F.broadcast(self.columns), ["file", "at"])
        cells = cells.where(F.col("role").isin(*roles)) if roles else cells
        got = cells.select("file", "rid", "at", "name", "num", "role", "heaven", F.when(F.col("num"), cell(F.col("v"))).alias("x"), F.when(~F.col("num"), F.col("v")).alias("s"))
        return got.where("x IS NOT NULL OR s IS NOT NULL")

    def stats(self) -> DataFrame:
        """(file, at, name, n, mu, sd, lo, hi) of all numbers of all files."""
        x = self.long("x", "y", "klass").where("num")
        return x.groupBy("file", "at", "name").agg(F.count("x").alias("n"), F.avg("x").alias("mu"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"))

    def symbols(self) -> DataFrame:
        """(file, name, value, n)."""
        return self.long("x", "y", "klass").where("NOT num").groupBy("file", "name", F.col("s").alias("value")).agg(F.count("*").alias("n"))

    def coded(self) -> DataFrame:
        """(file, rid, a, x, goals, inputs): a is the row as distances take it (normalized numbers n, symbols s, of the inputs in
        the columns' order), x its raw numbers, goals its normalized ones (v, heaven), inputs its cells by name (at, num, x, s). Statistics come as an array a file, so no
        row moves."""
        st = self.stats().select("file", "at", "mu", "sd")
        dims = self.columns.join(st, ["file", "at"], "left").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "name", "num", "role", "heaven", "mu", "sd"))).alias("c"))  # a row a file
        rows = self.rows.join(F.broadcast(dims), "file")
        own = lambda test: F.filter("c", test)
        value = lambda c: cell(F.get("cells", c["at"]))

        def norm(c):
            v = value(c)
            z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (v - c["mu"]) / (c["sd"] + 1e-32)))
            return F.when(v.isNotNull(), 1 / (1 + F.exp(-1.7 * z)))

        nums, syms = own(lambda c: (c["role"] == "x") & c["num"]), own(lambda c: (c["role"] == "x") & ~c["num"])
        goals = F.transform(own(lambda c: c["role"] == "y"), lambda c: F.struct(norm(c).alias("v"), c["heaven"].alias("heaven")))
        a = F.struct(F.transform(nums, norm).alias("n"), F.transform(syms, lambda c: F.get("cells", c["at"])).alias("s"))
        inputs = F.transform(own(lambda c: c["role"] == "x"), lambda c: F.struct(c["name"].alias("at"), c["num"].alias("num"), F.when(c["num"], value(c)).alias("x"), F.when(~c["num"], F.get("cells", c["at"])).alias("s")))
        return rows.select("file", "rid", a.alias("a"), F.transform(nums, value).alias("x"), goals.alias("goals"), inputs.alias("inputs"))

    def scored(self, p: float = 2.0) -> DataFrame:
        """(file, rid, a, x, inputs, y): coded rows with their distance to the ideal, in one pass after the statistics."""
        known = F.filter("goals", lambda g: g["v"].isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda t, g: t + F.pow(F.abs(g["v"] - g["heaven"]), F.lit(p)))
        return self.coded().select("file", "rid", "a", "x", "inputs", F.when(F.size(known) > 0, F.pow(total / F.size(known), F.lit(1 / p))).alias("y"))

    def splits(self, leaf: int = 3) -> DataFrame:
        """(file, at, op, x, s, n1, n2, cost): each file's best cut for the distance to its ideal."""
        from ..operators.splits import best, candidates

        cells = self.scored().where("y IS NOT NULL").select("file", "y", F.explode("inputs").alias("c")).select("file", "y", "c.*")
        return best(candidates(cells.where("x IS NOT NULL OR s IS NOT NULL"), ["file"], leaf), ["file"])


def headed(spark: SparkSession, heads: list[tuple[str, list[str]]]) -> DataFrame:
    """The frame of columns of (file, names)."""
    out = []
    for name, names in heads:
        sch = RoleSchema.parse(names)
        for i, c in enumerate(names):
            role = "y" if c in sch.goals else "klass" if c == sch.klass else "x" if c in sch.x else "skip"
            out.append((name, i, c, c in sch.nums, role, sch.goals.get(c)))
    if len(out) > MOST:
        raise ValueError(f"{len(out)} columns in all files, {MOST} at most")
    return spark.createDataFrame(out, "file string, at int, name string, num boolean, role string, heaven int")
