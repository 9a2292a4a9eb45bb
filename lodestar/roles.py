"""Roles of columns, told by their names: an upper-case first letter is a number, else a symbol; a last + or - is a goal
to maximize or minimize, ! the class, X ignored, ~ protected; others are inputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleSchema:
    names: tuple[str, ...]
    nums: tuple[str, ...] = ()
    syms: tuple[str, ...] = ()
    x: tuple[str, ...] = ()
    goals: dict[str, int] = field(default_factory=dict)
    klass: str | None = None
    protected: tuple[str, ...] = ()

    @classmethod
    def parse(cls, names: list[str]) -> RoleSchema:
        num = [n for n in names if n[:1].isupper()]
        roles = [n for n in names if n[-1:] != "X"]
        goals = {n: int(n[-1] == "+") for n in roles if n[-1:] in "+-"}
        klass = next((n for n in roles if n.endswith("!")), None)
        x = [n for n in roles if n not in goals and not n.endswith("!")]
        return cls(tuple(names), tuple(num), tuple(n for n in names if n not in num), tuple(x), goals, klass, tuple(n for n in x if n.endswith("~")))


class RoleFrame:
    """Rows with roles and a stable row id."""

    def __init__(self, df: DataFrame, rid: str, schema: RoleSchema | None = None) -> None:
        self.df, self.rid = df, rid
        self.schema = schema or RoleSchema.parse([c for c in df.columns if c != rid])
        self._stats: dict | None = None
        self.coded: DataFrame | None = None  # written by operators.distance.prepared

    def clone(self, df: DataFrame) -> RoleFrame:
        """The same roles over other rows."""
        return RoleFrame(df, self.rid, self.schema)

    def stats(self) -> dict[str, dict[str, float]]:
        """n, mu, sd, lo, hi of each number, in one aggregation."""
        if self._stats is None:
            aggs = []
            for i, c in enumerate(self.schema.nums):
                v = F.col(f"`{c}`").cast("double")
                aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mu{i}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"sd{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
            row = self.df.agg(*aggs).first() if aggs else None
            self._stats = {c: {k: row[f"{k}{i}"] for k in ("n", "mu", "sd", "lo", "hi")} for i, c in enumerate(self.schema.nums)}
        return self._stats
