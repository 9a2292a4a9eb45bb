"""Optimizers over a surrogate: a candidate's score is that of the real row nearest to it, of all rows of a table.

Populations and steppers are frames (chain, slot, inputs, y). Every generation is one frame, made by hashed draws from the one
before, scored by one scan of the whole table (operators.boxes.against) and written; nothing but a generation's best scores
passes through the driver.

- de: each row's kid blends three rows of its chain and takes the row's place if it scores better.
- ga: all rows change one cell; parents win tournaments of `tour` rows; kids cross over at one point.
- sa, ls, climb, oneplus1: (1+1). A chain draws `ahead` changes of its row at once, all of them are scored in one scan, and the
  first that the chain would accept is taken; those after it are drawn again. So a chain sees what one that goes step by step
  sees, in far fewer scans.

A generation is synchronous: all of its kids see the rows of the generation before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import extrapolated, hashed, uniform
from ..operators.boxes import Boxes, against
from ..operators.distance import coded
from ..operators.stats import improvements
from ..operators.summary import symbols
from ..roles import RoleFrame
from ..storage import drop, keep
from .search import changed

POPULATIONS, STEPPERS = ("de", "ga"), ("sa", "ls", "climb", "oneplus1")


class Surrogate:
    """The rows of a view as an index, with their scores, and what draws need of its columns."""

    def __init__(self, rf: RoleFrame, score: DataFrame) -> None:
        """score: (rid, y); rows without y are no candidates."""
        self.rf, self.names = rf, list(rf.schema.x)
        rf.stats()
        known = score.select(F.col(rf.rid).cast("long").alias("rid"), F.col("y").cast("double").alias("y")).where("y IS NOT NULL")
        self.real = keep(rf.df.select(F.col(rf.rid).cast("long").alias("rid"), *[F.col(f"`{c}`") for c in self.names]).join(known, "rid"), "real")
        own = RoleFrame(self.real.withColumnRenamed("rid", rf.rid), rf.rid, rf.schema)
        own._stats = rf.stats()
        self.index = Boxes(coded(own).select(F.col(rf.rid).alias("rid"), F.struct("n", "s").alias("a")).join(self.real.select("rid", F.col("y").alias("value")), "rid"))
        self.counts: dict[str, dict[str, int]] = {}
        syms = [c for c in self.names if c not in rf.schema.nums]
        for r in symbols(rf.df, syms).collect() if syms else []:  # values of symbols
            self.counts.setdefault(r["col"], {})[r["value"]] = r["n"]

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows (slot, inputs, ...) with the score y of the real row nearest to each, written. Draws are hashed, so rows
        that are made again are the same."""
        own = RoleFrame(rows.select(F.col("slot").alias(self.rf.rid), *[F.col(f"`{c}`") for c in self.names]), self.rf.rid, self.rf.schema)
        own._stats = self.rf.stats()
        probes = coded(own).select(F.col(self.rf.rid).alias("rid"), F.struct("n", "s").alias("a"))
        near = against(self.index, probes).select(F.col("probe").alias("slot"), F.col("value").alias("y"))
        return keep(rows.join(F.broadcast(near), "slot"), "scored")  # a row a probe

    def start(self, chains: list[tuple[str, int]], size: int, seed: object) -> DataFrame:
        """(kind, chain, slot, inputs, y): `size` real rows a chain, by hashed order; the same rows may start several chains."""
        out = None
        for i, (kind, chain) in enumerate(chains):
            first = self.real.orderBy(hashed(F.col("rid"), f"{seed}.{kind}.{chain}"), "rid").limit(size)
            own = first.select(F.lit(kind).alias("kind"), F.lit(chain).alias("chain"), (F.lit(i * size) + F.row_number().over(_by_rid()) - 1).cast("long").alias("slot"), *[F.col(f"`{c}`") for c in self.names], "y")
            out = own if out is None else out.unionByName(own)
        return keep(out, "start")

    def close(self) -> None:
        drop(self.real, self.index.rows)


def _by_rid():
    from pyspark.sql import Window

    return Window.orderBy("rid")  # the `size` rows of a start


def _peers(pop: DataFrame, names: list[str]) -> DataFrame:
    """Adds `peers`: the rows of a chain by slot, as an array (a population's size)."""
    item = F.struct("slot", *[F.col(f"`{c}`") for c in names], "y")
    return pop.join(pop.groupBy("kind", "chain").agg(F.array_sort(F.collect_list(item)).alias("peers")), ["kind", "chain"])


def _drawn(key: Column, seed: str, n: int) -> Column:
    """n different places of an array `peers`, in an order hashed by the key."""
    place = lambda p, i: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit("."), i.cast("string"))).alias("h"), i.alias("i"))
    return F.slice(F.transform(F.array_sort(F.transform("peers", place)), lambda s: s["i"]), 1, n)


def evolved(sur: Surrogate, chains: list[tuple[str, int]], size: int = 20, gens: int = 20, tour: int = 5, seed: object = 1, cr: float = 0.7) -> DataFrame:
    """(kind, chain, generation, best): the best score so far of each chain of de and ga, from its start on."""
    spark, names, st = sur.real.sparkSession, sur.names, sur.rf.stats()
    pop, out = sur.start(chains, size, seed), []
    best: dict[tuple, float] = {}

    def note(rows: DataFrame, gen: int) -> None:
        for r in rows.groupBy("kind", "chain").agg(F.min("y").alias("y")).collect():  # a row a chain
            k = (r["kind"], r["chain"])
            best[k] = min(best.get(k, float("inf")), r["y"])
            out.append((*k, gen, best[k]))

    note(pop, 0)
    for gen in range(1, gens + 1):
        tag = f"{seed}.{gen}"
        # ga's rows change one cell before they are scored and pair
        some = changed(sur.rf, pop.where("kind = 'ga'"), "slot", 1, f"{tag}.m", sur.counts, ["kind", "chain", "slot"])
        old, ga = pop, sur.scored(some) if any(k == "ga" for k, _ in chains) else None
        blended = _kids(_peers(pop.where("kind = 'de'"), names).withColumn("p", _drawn(F.col("slot"), tag, 3)), names, st, tag, cr, sur.rf)
        crossed = _crossed(_peers(ga, names), names, tag, tour) if ga is not None else None
        kids = blended if crossed is None else blended.unionByName(crossed)
        scored = sur.scored(kids)
        fought = old.where("kind = 'de'").join(scored.select("slot", *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(names)], F.col("y").alias("k_y")), "slot")
        wins = F.col("k_y") < F.col("y")
        kept = fought.select("kind", "chain", "slot", *[F.when(wins, F.col(f"k_{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(names)], F.least("y", "k_y").alias("y"))
        pop = keep(kept.unionByName(scored.where("kind = 'ga'").select(*kept.columns)), "generation")
        note(pop if ga is None else pop.unionByName(ga.select(*pop.columns)), gen)
        drop(old, ga, scored)
    drop(pop)
    return spark.createDataFrame(out, "kind string, chain int, generation int, best double")


def _kids(pop: DataFrame, names: list[str], st: dict, tag: str, cr: float, rf: RoleFrame) -> DataFrame:
    """(kind, chain, slot, inputs): de's kids of three peers: a + f (b - c) for numbers, a's or b's symbol, each cell by a chance of
    cr; one column always stays a's."""
    at = lambda i, c: F.get("peers", F.get("p", F.lit(i)))[c]
    stay = F.floor(uniform(F.col("slot"), f"{tag}.k") * len(names))
    cells = []
    for j, c in enumerate(names):
        a, b, z = (at(i, c) for i in range(3))
        new = extrapolated(a, b, z, st[c]["mu"] or 0.0, st[c]["sd"]) if c in rf.schema.nums else F.when(uniform(F.col("slot"), f"{tag}.{j}.s") < 0.5, b).otherwise(a)
        cells.append(F.when((uniform(F.col("slot"), f"{tag}.{j}") < cr) & (stay != j), new).otherwise(a).alias(c))
    # fewer than three rows: the row itself
    few = F.size("peers") < 3
    own = [F.when(few, F.col(f"`{c}`")).otherwise(cell).alias(c) for c, cell in zip(names, cells, strict=True)]
    return pop.select("kind", "chain", "slot", *own)


def _crossed(pop: DataFrame, names: list[str], tag: str, tour: int) -> DataFrame:
    """(kind, chain, slot, inputs): a kid of two winners of tournaments, crossed over at one point."""
    won = lambda side: F.array_min(F.transform(_drawn(F.col("slot"), f"{tag}.{side}", tour), lambda i: F.struct(F.get("peers", i)["y"].alias("y"), i.alias("i"))))["i"]
    two = pop.withColumns({"mum": F.get("peers", won("mum")), "dad": F.get("peers", won("dad")), "cut": F.floor(uniform(F.col("slot"), f"{tag}.cut") * len(names))})
    return two.select("kind", "chain", "slot", *[F.when(F.lit(j) > F.col("cut"), F.col("dad")[c]).otherwise(F.col("mum")[c]).alias(c) for j, c in enumerate(names)])


def stepped(sur: Surrogate, chains: list[tuple[str, int]], steps: int = 300, ahead: int = 32, restart: int = 40, seed: object = 1) -> DataFrame:
    """(kind, chain, evaluation, best): each improvement of chains of sa, ls, climb and oneplus1 over `steps` changes.

    sa takes what is better, or worse by a chance that cools; ls what is better, and begins anew at a real row after `restart`
    steps without a new best; climb and oneplus1 what is no worse, the latter changing each cell by a chance of one over
    their number (one at least).
    """
    spark, names = sur.real.sparkSession, sur.names
    now = sur.start(chains, 1, seed)
    rows = {(r["kind"], r["chain"]): r["y"] for r in now.select("kind", "chain", "y").collect()}  # a row a chain
    state = {k: {"e": y, "best": y, "at": 0, "last": 0, "begun": 0} for k, y in rows.items()}
    trace = [(*k, 1, y) for k, y in rows.items()]
    cells = F.when(F.col("kind") == "oneplus1", F.greatest(F.lit(1), sum(((uniform(F.col("slot"), f"{seed}.w{j}") < 1 / len(names)).cast("int") for j in range(len(names))), F.lit(0)))).otherwise(1)
    while any(s["at"] < steps for s in state.values()):
        # the next changes of each chain's row, by the number of the step
        at = spark.createDataFrame([(*k, s["at"]) for k, s in state.items() if s["at"] < steps], "kind string, chain int, at int")
        wide = now.drop("y").withColumnRenamed("slot", "home").join(F.broadcast(at), ["kind", "chain"])
        wide = wide.withColumn("step", F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + ahead, F.lit(steps)))))
        wide = wide.withColumn("slot", (F.col("home") * (steps + 1) + F.col("step")).cast("long"))
        kids = changed(sur.rf, wide, "slot", cells, f"{seed}.s", sur.counts, ["kind", "chain", "slot", "home", "step"])
        scored = sur.scored(kids)
        seen: dict[tuple, list] = {}
        for r in scored.select("kind", "chain", "step", "slot", "y", uniform(F.col("slot"), f"{seed}.a").alias("u")).orderBy("step").collect():  # `ahead` rows a chain
            seen.setdefault((r["kind"], r["chain"]), []).append(r)
        taken, anew = [], []
        for (kind, chain), rest in seen.items():
            s = state[kind, chain]
            for r in rest:
                s["at"], y = r["step"], r["y"]
                good = y < s["e"] or (kind in ("climb", "oneplus1") and y == s["e"]) or (kind == "sa" and y >= s["e"] and r["u"] < 2.718281828459045 ** ((s["e"] - y) / (1 - s["at"] / steps + 1e-32)))
                if good:
                    s["e"] = y
                    taken.append(r["slot"])
                if y < s["best"]:
                    s["best"], s["last"] = y, s["at"]
                    trace.append((kind, chain, s["at"] + 1, y))
                if kind == "ls" and s["at"] - s["last"] > restart:
                    s["last"], s["begun"] = s["at"], s["begun"] + 1
                    anew.append((kind, chain, s["begun"]))
                    if good:
                        taken.pop()
                    break
                if good:
                    break
        new = scored.where(F.col("slot").isin(taken)).select("kind", "chain", F.col("home").alias("slot"), *[F.col(f"`{c}`") for c in names], "y")
        stay = now.join(F.broadcast(new.select("kind", "chain")), ["kind", "chain"], "left_anti").select(*new.columns)
        for kind, chain, begun in anew:  # few: a chain's fresh start
            home = now.where((F.col("kind") == kind) & (F.col("chain") == chain)).select("slot").first()[0]
            row = sur.real.orderBy(hashed(F.col("rid"), f"{seed}.{kind}.{chain}.{begun}"), "rid").limit(1)
            fresh = row.select(F.lit(kind).alias("kind"), F.lit(chain).alias("chain"), F.lit(home).cast("long").alias("slot"), *[F.col(f"`{c}`") for c in names], "y")
            stay = stay.where(~((F.col("kind") == kind) & (F.col("chain") == chain))).unionByName(fresh)
            state[kind, chain]["e"] = y = row.select("y").first()[0]
            if y < state[kind, chain]["best"]:
                state[kind, chain]["best"] = y
                trace.append((kind, chain, state[kind, chain]["at"] + 1, y))
        if taken or anew:
            last, now = now, keep(new.unionByName(stay), "state")
            drop(last)
        drop(scored)
    drop(now)
    return spark.createDataFrame(trace, "kind string, chain int, evaluation int, best double")


def race(sur: Surrogate, kinds: list[str], chains: int = 2, size: int = 20, gens: int = 20, steps: int = 300, seed: object = 1, **how) -> DataFrame:
    """(optimizer, chain, evaluation, best): the best score so far of every optimizer; a generation counts its kids."""
    names = lambda among: [(k, c) for k in kinds if k in among for c in range(chains)]
    out = None
    if names(POPULATIONS):
        out = evolved(sur, names(POPULATIONS), size, gens, seed=seed).select(F.col("kind").alias("optimizer"), "chain", ((F.col("generation") + 1) * size).cast("int").alias("evaluation"), "best")
    if names(STEPPERS):
        own = stepped(sur, names(STEPPERS), steps, seed=seed, **how).select(F.col("kind").alias("optimizer"), "chain", "evaluation", "best")
        out = own if out is None else out.unionByName(own)
    return out


def merged(times: DataFrame) -> DataFrame:
    """(evaluation, optimizer, best): the steps of a race that beat all optimizers' steps before them."""
    first = times.groupBy("evaluation").agg(F.min(F.struct("best", "optimizer")).alias("m")).select("evaluation", "m.best", "m.optimizer")
    return improvements(first, ["evaluation"], "best").select("evaluation", "optimizer", "best")
