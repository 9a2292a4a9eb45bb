"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

Index: every vector is turned by one random orthogonal matrix and kept as its signs (one bit a dimension, packed), its
norm and the correction scalar <code, direction>. The unbiased estimate of <direction, query> is
<code, query> / <code, direction>, and with e = sqrt((1 - c^2) / c^2 / (D - 1)) the true value lies within
WIDTH * e * |query| of it but for a small chance. Search: queries meet a block of the index in stretches; for each query the
stretches keep a floor, the k-th largest exact product so far; only vectors whose upper bound passes the floor are reranked
with exact double-precision products. The first stretch's floor comes from its best estimates, reranked.

Spark deals the index into blocks and the queries into slots; each pair of them is a group of its own, which returns at most
k rows a query, and the k best of each query follow. Queries don't pass through the driver.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; a vector whose length is
not that of the most frequent length takes none either; equal scores go to the smaller id; repeated vectors are
candidates of their own; repeated ids are told apart by row for candidates and answer once as a query; fewer candidates
than k give all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Parts, dealt, forget, plain_schema, save, tiles, vectors_of

#: Queries of a slot and rows of a block (64 dimensions: 32 MB each), rows that are looked at together, width of the bounds.
SLOT, BLOCK, STRETCH, WIDTH = 65536, 65536, 8192, 1.9


def usable(vector: Column, zero: bool = False) -> Column:
    """Not null, all components finite; not zero unless zero is set."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = vector.isNotNull() & (F.size(vector) > 0) & finite
    return F.coalesce(found if zero else found & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, dims) if len(column) else np.empty((0, dims))


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, norms, <code, direction>) of vectors."""
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def index(df: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, code, norm, c): the code of each usable vector beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            bits, norm, c = codes(matrix(batch.column(1), dims), turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm, pa.float64()), pa.array(c, pa.float64())], names=["id", "vector", "code", "norm", "c"])

    own = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & (F.size(vector_col) == dims))
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.mapInArrow(run, plain_schema("id long, vector array<double>, code binary, norm double, c double"))


class Scan:
    """The k best of a stretch of the index for every query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.turned = (queries @ rotation(queries.shape[1])).astype(np.float32)
        self.size = np.linalg.norm(queries, axis=1)
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.reranked = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, norm: np.ndarray, c: np.ndarray) -> None:
        dims, n = vectors.shape[1], len(ids)
        signs = (np.unpackbits(code, axis=1)[:, :dims].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))
        error = np.sqrt(np.maximum(0, 1 - c * c) / (c * c) / max(1, dims - 1))
        gain, slack = (norm / c).astype(np.float32), (WIDTH * norm * error).astype(np.float32)
        step = max(1, (4 << 20) // max(1, n))  # queries together: 16 MB of estimates
        for at in range(0, len(self.ids), step):
            q = slice(at, at + step)
            guess = (self.turned[q] @ signs.T) * gain
            bound = guess + self.size[q, None].astype(np.float32) * slack
            own = self.ids[q, None] == ids[None, :]
            if n > 4 * self.k and np.isinf(self.best[q]).any():  # floors from the best estimates
                guess[own] = -np.inf
                top = np.argpartition(-guess, self.k, axis=1)[:, : self.k]
                rows = np.repeat(np.arange(top.shape[0]), self.k)
                self.rerank(at, rows, top.ravel(), ids, vectors)
                bound[np.arange(top.shape[0])[:, None], top] = -np.inf
            bound[own] = -np.inf
            floor = self.best[q, -1:]
            rows, cols = np.nonzero((bound >= floor) & (bound > -np.inf))
            if len(rows):
                self.rerank(at, rows, cols, ids, vectors)

    def rerank(self, at: int, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.reranked += len(rows)
        score = np.empty(len(rows))
        for i in range(0, len(rows), 1 << 13):  # what a step gathers stays in the cache
            s = slice(i, i + (1 << 13))
            score[s] = np.einsum("ij,ij->i", self.queries[at + rows[s]], vectors[cols[s]])
        good = score >= self.best[at + rows, -1]
        rows, cols, score = rows[good], cols[good], score[good]
        touched = np.unique(rows)
        row = np.concatenate([rows, np.repeat(touched, self.k)])
        all_score = np.concatenate([score, self.best[at + touched].ravel()])
        all_id = np.concatenate([ids[cols], self.who[at + touched].ravel()])
        order = np.lexsort((all_id, -all_score, row))
        row, all_score, all_id = row[order], all_score[order], all_id[order]
        first = np.searchsorted(row, touched)
        pick = first[:, None] + np.arange(self.k)
        self.best[at + touched], self.who[at + touched] = all_score[pick], all_id[pick]

    def result(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.best > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.who[row, col]), pa.array(self.best[row, col])], names=["query_id", "vec_id", "score"])


def top_k(found: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest scores of each query, ties to the smaller id.

    Ranks within each partition come first, so that one task never gathers more than k rows a partition and query.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(kind).alias("score"))


def dimensions(df: DataFrame, vector_col: str = "embedding") -> int:
    """The most frequent length of the vectors; 0 without any."""
    row = df.where(usable(F.col(vector_col), zero=True)).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row[0] if row else 0


def asked(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(id, vector, slot) of distinct query ids of (id, vector), written, and the number of slots."""
    one = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    made = save(one.withColumn("n", F.monotonically_increasing_id()), "asked")
    out, n = dealt(made, most, "slot")
    out._saved_at = made._saved_at
    return out, n


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row for which `queries` holds."""
    spark = df.sparkSession
    dims = dimensions(df, vector_col)
    parts = Parts(spark, "nearest", plain_schema("query_id long, rank int, vec_id long, score double"))
    if not dims:
        return parts.frame()
    made = save(index(df, dims, id_col, vector_col).withColumn("n", F.monotonically_increasing_id()), "codes")
    rows, blocks = dealt(made, BLOCK, "block")
    own = df.where(queries & usable(F.col(vector_col)) & (F.size(vector_col) == dims) & F.col(id_col).isNotNull())
    asks, slots = asked(own.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), SLOT)

    def answer(block: pa.Table, slot: pa.Table) -> pa.Table:
        scan = Scan(slot.column("id").to_numpy(), vectors_of(slot, dims), k)
        for at in range(0, block.num_rows if slot.num_rows else 0, STRETCH):
            part = block.slice(at, STRETCH)
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            scan.add(part.column("id").to_numpy(), vectors_of(part, dims), code, part.column("norm").to_numpy(), part.column("c").to_numpy())
        return pa.Table.from_batches([scan.result()])

    for found in tiles(rows, asks, blocks, slots, answer, plain_schema("query_id long, vec_id long, score double")):
        parts.add(top_k(found, k, "double"))
    forget(made, asks)
    return parts.frame()
