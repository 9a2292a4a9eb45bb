"""Exact top-k by integer inner product over a bit-sliced index.

Each component is an attribute of a row; its quantised values, moved to be non-negative, are kept as bit slices: one
bitmap a bit, one bit a row. A query's score is a weighted sum of attributes: each weight is written in signed binary
digits, so the sum is one of shifted slices, added with bitmap arithmetic (full adders over whole bitmaps, three bitmaps
of one place to two). Negative digits use the complement of an attribute, which shifts the sum by a known amount. The sum's
slices are then read from the most significant downward: rows surely among the k best gather, rows that may still be
narrow down. What is left at the boundary are equal scores, which go to the smallest ids. Scores of the chosen rows are
then computed exactly from their integers.

Spark deals the rows into blocks, each a set of bitmaps, and the queries into slots; each pair of them is a group of its own,
which returns at most k rows a query, and the k best of each query follow. Queries don't pass through the driver.

Cases: as in rabitq, but that zero vectors take part; components are floor(256 x), x as double. Rows and queries
with a component of 16384 or more in size are scored by Python's integers instead of slices; a score among the k best that
passes 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Parts, dealt, forget, plain_schema, save, tiles, vectors_of
from .rabitq import asked, dimensions, top_k, usable

#: Queries of a slot, rows of a block (a bitmap has a bit for each).
SLOT, BLOCK = 16384, 65536
#: Components from this size on are not kept as slices.
WIDE = 16384


def digits(weight: int) -> list[tuple[int, int]]:
    """Signed binary digits (place, sign) of a weight, no two next to each other."""
    out, place = [], 0
    while weight:
        if weight & 1:
            sign = 2 - (weight & 3)
            out.append((place, sign))
            weight -= sign
        weight >>= 1
        place += 1
    return out


class Index:
    """Bit slices of the attributes of rows, which are in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.n = len(ids)
        self.words = -(-self.n // 64)
        self.low = self.values.min(0)
        moved = (self.values - self.low).astype(np.uint64)
        self.full = self.bitmap(np.ones(self.n, bool))
        self.slices: list[list[np.ndarray]] = []
        self.top = []
        for a in range(values.shape[1]):
            bits = int(moved[:, a].max()).bit_length()
            self.slices.append([self.bitmap((moved[:, a] >> np.uint64(b)) & np.uint64(1) == 1) for b in range(bits)])
            self.top.append((1 << bits) - 1)
        self.inverse = [[s ^ self.full for s in own] for own in self.slices]

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, bool)
        out[: self.n] = bits
        return np.packbits(out, bitorder="little").view(np.uint64)

    def add(self, weights: list[int]) -> list[np.ndarray]:
        """Slices, lowest first, of the weighted sum plus a constant that is the same for all rows."""
        places: list[list[np.ndarray]] = []
        for a, w in enumerate(weights):
            for place, sign in digits(w):
                for b, s in enumerate(self.slices[a] if sign > 0 else self.inverse[a]):
                    while len(places) <= place + b + 1:
                        places.append([])
                    places[place + b].append(s)
        out, p = [], 0
        while p < len(places):
            column = places[p]
            if p + 1 >= len(places) and len(column) > 1:
                places.append([])
            while len(column) > 2:
                x, y, z = column.pop(), column.pop(), column.pop()
                t = x ^ y
                column.insert(0, t ^ z)
                t &= z
                t |= x & y
                places[p + 1].append(t)
            if len(column) == 2:
                x, y = column
                column = [x ^ y]
                places[p + 1].append(x & y)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            p += 1
        return out

    def best(self, weights: list[int], k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows with the largest weighted sums, ties to smaller ids; rows with id `without` left out."""
        may = self.full.copy()
        for i in range(np.searchsorted(self.ids, without), np.searchsorted(self.ids, without, "right")):
            may[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        sure, have = np.zeros(self.words, np.uint64), 0
        if int(np.bitwise_count(may).sum()) > k:
            for s in reversed(self.add(weights)):
                both = may & s
                n = have + int(np.bitwise_count(both).sum())
                if n > k:
                    may = both
                elif n < k:
                    sure, have = sure | both, n
                    may = may & ~s
                else:
                    sure, may = sure | both, may & np.uint64(0)
                    have = n
                    break
        rows = self.rows(sure)
        rest = self.rows(may)[: k - len(rows)]  # the boundary: equal sums, smallest ids first
        rows = np.concatenate([rows, rest])
        return self.ids[rows], self.values[rows] @ np.array(weights, np.int64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        word = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[word].view(np.uint8), bitorder="little").reshape(-1, 64)
        at, bit = np.nonzero(bits)
        return word[at] * 64 + bit


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as Python's integers."""
    out = np.empty(vectors.shape, object)
    out.ravel()[:] = [int(x) * 256 if abs(x) >= 2**53 else int(np.floor(x * 256)) for x in vectors.ravel().tolist()]
    return out


def exact(ids: np.ndarray, values: np.ndarray, weights: np.ndarray, k: int, without: int) -> tuple[list[int], list[int]]:
    """What Index.best gives, for integers of any size."""
    score = (values @ weights).tolist()
    own = sorted((-v, i) for v, i in zip(score, ids.tolist(), strict=True) if i != without)[:k]
    return [i for _, i in own], [-v for v, _ in own]


def search(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` holds its k largest integer inner products."""
    spark = df.sparkSession
    dims = dimensions(df, vector_col)
    parts = Parts(spark, "best", plain_schema("query_id long, rank int, vec_id long, score long"))
    if not dims:
        return parts.frame()
    own = df.where(usable(F.col(vector_col), zero=True) & (F.size(vector_col) == dims) & F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks"))
    made = save(own.withColumn("n", F.monotonically_increasing_id()), "rows")
    rows, blocks = dealt(made.drop("asks"), BLOCK, "block")
    asks, slots = asked(made.where("asks").select("id", "vector"), SLOT)

    def answer(block: pa.Table, slot: pa.Table) -> pa.Table:
        keys, values = block.column("id").to_numpy(), vectors_of(block, dims)
        ids, vectors = slot.column("id").to_numpy(), vectors_of(slot, dims)
        narrow, small = (np.abs(vectors) < WIDE).all(1), (np.abs(values) < WIDE).all(1)
        weights = np.floor(vectors[narrow] * 256).astype(np.int64).tolist()
        few = [(q, np.array(w, object)) for q, w in zip(ids[narrow].tolist(), weights, strict=True)]
        many = list(zip(ids[~narrow].tolist(), integers(vectors[~narrow]), strict=True))
        got = []
        if small.any():
            slices = Index(keys[small], np.floor(values[small] * 256).astype(np.int64))
            got += [(q, *slices.best(w, k, q)) for q, w in zip(ids[narrow].tolist(), weights, strict=True)]
        for wide, questions in ((~small, few), (np.ones(len(keys), bool), many)):
            at = np.flatnonzero(wide) if questions else np.empty(0, np.int64)
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                plain = integers(values[some])
                got += [(q, *exact(keys[some], plain, w, k, q)) for q, w in questions]
        columns = [[q for q, i, _ in got for _ in i], [x for _, i, _ in got for x in i], [x for _, _, v in got for x in v]]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    for found in tiles(rows, asks, blocks, slots, answer, plain_schema("query_id long, vec_id long, score long")):
        parts.add(top_k(found, k, "long"))
    forget(made, asks)
    return parts.frame()
