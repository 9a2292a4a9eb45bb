"""Nearest rows of mixed kind, and what follows from them: classes, guesses, anomalies, snapping. All go through the index of
boxes (operators.boxes): exact, unknown cells included, in tiles of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import RoleFrame
from .boxes import COPIES, Boxes
from .boxes import nearest as among
from .distance import coded, distx, scored_gaps


def cells(rf: RoleFrame) -> DataFrame:
    """(rid, a): coded rows as a struct."""
    return coded(rf).select(F.col(rf.rid).alias("rid"), F.struct("n", "s").alias("a"))


def nearest(rows: DataFrame, probes: DataFrame, k: int, within: list[str] | None = None, kind: str = "mixed", looked: list | None = None) -> DataFrame:
    """(probe, rank, rid, d): the k rows nearest to each probe, ties to the smaller id; a row is not its own neighbour.
    rows and probes are (rid, a). With `within`, only rows with the same values of those columns (carried by both) count."""
    index = Boxes(rows, within, copies=max(COPIES, k + 1))
    return among(index, index if probes is rows else Boxes(probes, within), k, kind, looked)


def near(rf: RoleFrame, k: int) -> DataFrame:
    """(probe, rank, rid, d) of every row among the others."""
    rows = cells(rf)
    return nearest(rows, rows, k)


def classified(rf: RoleFrame, k: int = 5) -> DataFrame:
    """(probe, got): the class that most of the k nearest others have that have one; ties to the smallest."""
    known = rf.df.select(F.col(rf.rid).alias("rid"), F.col(f"`{rf.schema.klass}`").cast("string").alias("klass")).where("klass IS NOT NULL")
    rows = cells(rf)
    votes = nearest(rows.join(known.select("rid"), "rid", "left_semi"), rows, k).join(known, "rid").groupBy("probe", "klass").agg(F.count("*").alias("n"))
    return votes.groupBy("probe").agg(F.min_by("klass", F.struct(-F.col("n"), "klass")).alias("got"))


def guessed(rf: RoleFrame, y: DataFrame, k: int = 5) -> DataFrame:
    """(probe, guess): mean of y (rid, y) of the k nearest other rows."""
    return near(rf, k).join(y, "rid").groupBy("probe").agg(F.avg("y").alias("guess"))


def anomaly(rf: RoleFrame, within: list[str] | None = None) -> DataFrame:
    """(rid, gap, score): gap to the nearest other row (of the same group, if `within` is given) and its norm among all."""
    rows = cells(rf)
    if within:
        rows = rows.join(rf.df.select(F.col(rf.rid).alias("rid"), *within), "rid")
    return scored_gaps(nearest(rows, rows, 1, within).select(F.col("probe").alias("rid"), F.col("d").alias("gap")))


def snapped(rf: RoleFrame, probes: DataFrame, score: DataFrame) -> DataFrame:
    """(probe, rid, y): the real row nearest to each synthetic one (rid, a), and its score (rid, y)."""
    return nearest(cells(rf), probes, 1).join(score, "rid").select("probe", "rid", "y")


def matrix(rows: DataFrame) -> DataFrame:
    """(i, j, d) of all pairs i < j of a bounded sample (rid, a)."""
    a, b = rows.select(F.col("rid").alias("i"), "a"), F.broadcast(rows.select(F.col("rid").alias("j"), F.col("a").alias("b")))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", distx("a", "b").alias("d"))
