"""Structured Streaming: folds of unbounded rows into summaries, windows and sessions in event time, late rows, leaders in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Mergeable moments of a value for each key; update or complete mode."""
    v = F.col(value).cast("double")
    return stream.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mu"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))


def signed(stream: DataFrame, key: str, value: str, sign: str) -> DataFrame:
    """Summary under inserts and deletes (sign 1 or -1)."""
    v, s = F.col(value).cast("double"), F.col(sign)
    return stream.groupBy(key).agg(F.sum(s).alias("n"), F.sum(s * v).alias("s"), F.sum(s * v * v).alias("q"))


def windows(stream: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event-time windows behind a watermark (also right on a batch)."""
    kept = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return kept.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, key: str, ts: str, value: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, stop, n, total): rows of a key that follow each other within `gap` are one session, which ends `gap` after its
    last row. Behind a watermark, so a stream forgets sessions that no row can reach any more (also right on a batch)."""
    kept = stream.withWatermark(ts, late) if stream.isStreaming else stream
    w = F.session_window(ts, gap).alias("w")
    return kept.groupBy(F.col(key).alias("key"), w).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


class Late:
    """A foreachBatch function that tells late rows apart: rows older than the newest event time of all earlier batches less
    `delay` go to `late`, the others to `take`. The newest time of each batch is kept in a folder, so a query that starts
    again, or a batch that comes again, parts its rows as before."""

    def __init__(self, where: str, ts: str, delay: str, take: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None]) -> None:
        self.where, self.ts, self.delay, self.take, self.late = where, ts, delay, take, late

    def __call__(self, batch: DataFrame, n: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        try:
            newest = spark.read.schema("batch long, newest timestamp").parquet(self.where).where(F.col("batch") < n).agg(F.max("newest")).first()[0]
        except AnalysisException:  # the first batch
            newest = None
        old = F.lit(False) if newest is None else F.col(self.ts) < F.lit(newest) - F.expr(f"INTERVAL {self.delay}")
        self.take(batch.where(~F.coalesce(old, F.lit(False))), n)
        self.late(batch.where(F.coalesce(old, F.lit(False))), n)
        batch.agg(F.lit(n).cast("long").alias("batch"), F.max(self.ts).alias("newest")).write.mode("append").parquet(self.where)


def leaders(gap: Callable, eps: float, most: int = 1000, write: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each row of (rid, codes), in the order of rid, founds a leader, kept in `.leaders`, or joins the
    nearest. gap: from a row's codes to a leader's, as columns.

    `write`, if given, gets (rid, leader, d) of every row of a batch: the number of its leader, of those up to its own place in
    the order. More than `most` leaders are an error. A batch that comes again after an error begins with the leaders
    before it. Rows stay in their tasks (grids.founded), leaders alone are on the driver.
    """
    kept: list[tuple] = []

    def era(batch: DataFrame, n: int) -> None:
        from ..operators.grids import founded
        from ..storage import drop, keep

        rows = keep(batch.select("rid", "codes"), "era")
        found = founded(rows, "rid", kept, lambda c, lead: F.when(gap(c, lead) > eps, 1.0).otherwise(0.0), 1.0, most)
        if write is not None:
            new = {tuple(r["codes"]): r["rid"] for r in rows.where(F.col("codes").isin([F.array(*map(F.lit, v)) for v in found[len(kept) :]])).groupBy("codes").agg(F.min("rid").alias("rid")).collect()} if found[len(kept) :] else {}
            place = [F.lit(None).cast("long") if i < len(kept) else F.lit(new[tuple(v)]) for i, v in enumerate(found)]
            each = F.array(*[F.when(p.isNull() | (p <= F.col("rid")), F.struct(gap(F.col("codes"), v).alias("d"), F.lit(i).alias("leader"))) for i, (p, v) in enumerate(zip(place, found, strict=True))])
            best = F.array_min(F.array_compact(each))
            write(rows.select("rid", best["leader"].alias("leader"), best["d"].alias("d")), n)
        kept[:] = found
        drop(rows)

    era.leaders = kept
    return era


def kept_leaders(stream: DataFrame, key: str, eps: float, ttl_ms: int | None = None) -> DataFrame:
    """(key, rid, leader, d): leader clustering of each key's rows (key, rid, v: array of numbers) with its leaders in the state
    store: a list state of leaders and a value state of how many rows have come. A row joins the nearest leader (largest
    gap of numbers, ties to the first) or, farther than eps from all, founds one. Rows of a batch go by rid. A leader that
    `ttl_ms` leaves unused is forgotten, where it is given. Needs the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Leaders(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            more = {} if ttl_ms is None else {"ttlDurationMs": ttl_ms}
            self.leads = handle.getListState("leads", "rid long, v array<double>", **more)
            self.seen = handle.getValueState("seen", "n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            leads = [(r[0], list(r[1])) for r in self.leads.get()]
            before, out, n = len(leads), [], 0
            for batch in [pd.concat(list(rows)).sort_values("rid")]:
                for rid, v in zip(batch["rid"], batch["v"], strict=True):
                    d, i = min(((max((abs(a - b) for a, b in zip(v, lead, strict=True)), default=0.0), i) for i, (_, lead) in enumerate(leads)), default=(float("inf"), -1))
                    if d > eps:
                        leads.append((int(rid), [float(x) for x in v]))
                        d, i = 0.0, len(leads) - 1
                    out.append((key[0], int(rid), leads[i][0], float(d)))
                    n += 1
            if len(leads) > before:
                self.leads.put([(r, v) for r, v in leads])
            had = self.seen.get() if self.seen.exists() else (0,)
            self.seen.update((had[0] + n,))
            yield pd.DataFrame(out, columns=["key", "rid", "leader", "d"])

        def close(self) -> None:
            pass

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(Leaders(), f"key {kind}, rid long, leader long, d double", "Append", "processingTime" if ttl_ms is not None else "None")


def prequential(stream: DataFrame, tenant: str, klass: str, syms: list[str], nums: list[str], k: int = 1, m: int = 2, wait: int = 10) -> DataFrame:
    """(tenant, want, got): a stateful stream that classifies each row by naive Bayes from its tenant's rows before it, then
    learns it. State: counts and sums per class, however many rows have come. Rows of a batch go by their id `rid`."""
    import json
    import math

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def score(s: dict, c: str, row, total: int, kinds: int) -> float:
        own = s[c]
        prior = (own["n"] + k) / (total + k * kinds)
        out = math.log(prior)
        for i, name in enumerate(nums):
            v, (n, t, q) = getattr(row, name), own["x"][i]
            if v is not None and v == v and n:
                z = 2 * (max(0.0, q - t * t / n) / (n - 1) if n > 1 else 0.0) + 1e-32
                p = math.exp(-((v - t / n) ** 2) / z) / math.sqrt(math.pi * z)
                out += math.log(p) if p > 0 else 0.0
        for i, name in enumerate(syms):
            v = getattr(row, name)
            if v is not None:
                out += math.log((own["s"][i].get(v, 0) + m * prior) / (own["n"] + m))
        return out

    def learn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, total = json.loads(state.get[0]) if state.exists else ({}, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("rid").itertuples():
            want = getattr(row, klass)
            if total >= wait and s:
                got = min(s, key=lambda c: (-round(score(s, c, row, total, len(s)), 9), c))
                out.append((key[0], row.rid, want, got))
            own = s.setdefault(want, {"n": 0, "x": [[0, 0.0, 0.0] for _ in nums], "s": [{} for _ in syms]})
            own["n"] += 1
            total += 1
            for i, name in enumerate(nums):
                v = getattr(row, name)
                if v is not None and v == v:
                    own["x"][i] = [own["x"][i][0] + 1, own["x"][i][1] + v, own["x"][i][2] + v * v]
            for i, name in enumerate(syms):
                v = getattr(row, name)
                if v is not None:
                    own["s"][i][v] = own["s"][i].get(v, 0) + 1
        state.update((json.dumps([s, total]),))
        yield pd.DataFrame(out, columns=[tenant, "rid", "want", "got"])

    kind = stream.schema[tenant].dataType.simpleString()
    return stream.groupBy(tenant).applyInPandasWithState(learn, f"{tenant} {kind}, rid long, want string, got string", "model string", "append", GroupStateTimeout.NoTimeout)


def buckets(stream: DataFrame, frozen, write: Callable[[DataFrame, int], None], cap: int = 16, seed: object = 1) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows (rid, inputs) hashed by what a warm-up froze (operators.grids.Frozen); `write` gets the
    rows that each bucket keeps, with how many it has seen, in `.kept`-wide hashed order so far. At most `cap` rows a bucket
    are held, so the reservoir is as large as the grid, not the stream."""
    held: dict[int, list[tuple[str, int]]] = {}
    seen: dict[int, int] = {}

    def era(batch: DataFrame, n: int) -> None:
        from ..functions.columns import hashed
        from ..operators.cluster import reservoir

        rows = batch.select("rid", frozen.bucket().alias("bucket"))
        few = reservoir(rows, "bucket", "rid", cap, seed).select("bucket", "rid", "seen", hashed(F.col("rid"), seed).alias("o"))
        new_seen: dict[int, int] = {}
        merged = {b: list(v) for b, v in held.items()}
        for r in few.collect():  # at most cap rows a bucket
            merged.setdefault(r["bucket"], []).append((r["o"], r["rid"]))
            new_seen[r["bucket"]] = r["seen"]
        out = [(b, rid, seen.get(b, 0) + new_seen.get(b, 0)) for b, v in merged.items() for _, rid in sorted(v)[:cap]]
        write(batch.sparkSession.createDataFrame(out, "bucket int, rid long, seen long"), n)
        held.update({b: sorted(v)[:cap] for b, v in merged.items()})
        for b, k in new_seen.items():
            seen[b] = seen.get(b, 0) + k

    era.kept, era.seen = held, seen
    return era
