"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed words, and what a text is made of at a level that carries over between languages and topics: hashed
character trigrams of word shapes, punctuation classes and repetition. Labelled documents (a bounded sample, see FIT) give a term-document
matrix; its truncated singular value decomposition gives the latent space. Labelled vectors and their labels are
broadcast (FIT x RANK floats at most); each document of any size is folded into the space and its exact cosine products
with every labelled vector are computed block by block. The k largest vote, weighted by similarity, and each class's
votes are divided by its share of the labelled set so that a rare label can win.

Labels, language, source and ids are never inputs of a score. The labelled sample is the FIT smallest md5 hashes of ids
among the rows that may teach (crc32 of the id's text mod 4 is not 2), half of them of each label where there are enough.

Cases: a null or empty text is scored like any other (as a text without terms, by the base rate); labels that are null
or of unknown documents teach nothing; repeated label rows count once each document; no labels at all score 0.5; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, clear_name, mix, pieces, texts_of, wider

#: Labelled documents to learn from at most, dimensions of the latent space, neighbours that vote.
FIT, RANK, NEIGHBOURS = 3000, 32, 15
#: Hashed terms: shapes (the last 64 of them for repetition and length), then words, which weigh WORD of a shape.
SHAPES, TERMS, WORD = 2048, 3072, 0.2

_CLASS = np.full(256, 5, np.uint8)  # by byte: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 other, 6 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 6


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def term_rows(texts: list[bytes]) -> np.ndarray:
    """Weighted term counts, one row a text: shares of shape trigrams, punctuation words and repeated lines."""
    out = np.zeros((len(texts), TERMS), np.float32)
    if not texts:
        return out
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) >= 3:
        kind = _CLASS[data].astype(np.int64)
        own = np.where(kind == 5, 8 + data.astype(np.int64), kind)  # punctuation stands for itself
        gram = mix((own[:-2] << 20 | own[1:-1] << 10 | own[2:]).astype(np.uint64)) % np.uint64(SHAPES - 64)
        row = np.repeat(np.arange(len(texts)), sizes)
        inside = row[:-2] == row[2:]
        key = row[:-2][inside] * TERMS + gram[inside].astype(np.int64)
        out += np.bincount(key, minlength=len(texts) * TERMS).reshape(out.shape)
    found = Words(texts, lower=True)
    if len(found.hash):
        key = found.text * (TERMS - SHAPES) + (found.hash % np.uint64(TERMS - SHAPES)).astype(np.int64)
        out[:, SHAPES:] = WORD**2 * np.bincount(key, minlength=len(texts) * (TERMS - SHAPES)).reshape(len(texts), -1)
    out = np.sqrt(out)  # frequent terms weigh less
    number = np.diff(found.first)
    same = np.zeros(len(texts), np.int64)
    if len(found.hash) > 1:
        again = (found.hash[1:] == found.hash[:-1]) & (found.text[1:] == found.text[:-1])
        same = np.bincount(found.text[1:][again], minlength=len(texts))
    for i, t in enumerate(texts):
        words = int(number[i])
        lines = [x for x in t.split(b"\n") if x]
        scale = np.sqrt(len(t) + 1.0)
        again = 1 - len(set(lines)) / len(lines) if lines else 0
        mean = len(t) / words if words else 0
        out[i, SHAPES - 64 + min(15, int(again * 16))] = scale * 0.3
        out[i, SHAPES - 48 + min(7, int(mean / 2))] = scale * 0.1
        out[i, SHAPES - 40 + min(7, int(same[i] / max(1, words) * 24))] = scale * 0.3
        out[i, SHAPES - 32 + min(31, int(np.log2(len(t) + 1) * 2))] = scale * 0.05
    return out


def leading(rows: np.ndarray, rank: int, turns: int = 16) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start: no square matrix of terms is made."""
    space = np.linalg.qr(np.random.default_rng(7).standard_normal((rows.shape[1], rank + 16)))[0]
    for _ in range(turns):
        space = np.linalg.qr((rows.T @ (rows @ space.astype(np.float32))).astype(np.float64))[0]
    _, _, v = np.linalg.svd((rows @ space.astype(np.float32)).astype(np.float64), full_matrices=False)
    return (space @ v[:rank].T).astype(np.float32)


class Space:
    """Latent space of labelled texts' term rows, with their labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.int8)
        n = max(1, len(rows))
        self.idf = np.log1p(n / (1 + (rows > 0).sum(0))).astype(np.float32)
        rows = self.unit(rows * self.idf)
        if len(rows):
            self.basis = leading(rows, RANK)
        else:
            self.basis = np.zeros((TERMS, RANK), np.float32)
        self.vectors = self.unit(rows @ self.basis)

    @staticmethod
    def unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1: the share of the neighbours' weight that label 1 has."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        if len(texts) > 256:  # few rows of terms at a time
            return np.concatenate([self.score(texts[i : i + 256]) for i in range(0, len(texts), 256)])
        vectors = self.unit(self.unit(term_rows(texts) * self.idf) @ self.basis)
        near = vectors @ self.vectors.T  # one block: exact cosine products with every labelled vector
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1).astype(np.float64), 0) ** 8
        share = np.bincount(self.labels, minlength=2) / len(self.labels)
        weight = weight / np.maximum(share[self.labels[top]], 1e-9) + 1e-12
        return (weight * self.labels[top]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """Learns from at most FIT labelled documents; they, and nothing else, come to the driver."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    order = F.md5(F.col("_id").cast("string").cast("binary"))
    chosen = [own.where(F.col("_label") == v).select("_id", "_label", order.alias("_o")).orderBy("_o", "_id").limit(FIT // 2) for v in (0, 1)]
    few = chosen[0].unionByName(chosen[1])  # at most FIT rows by the limits above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            rows = [r.tobytes() for r in term_rows(texts_of(batch, "_text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["_id", "_label", "_row"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")
    got = texts.select("_id", "_label", "_text").mapInArrow(run, few.select("_id", "_label").schema.add("_row", "binary")).collect()
    got = sorted({r[0]: r for r in got}.values())
    rows = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(-1, TERMS)
    return Space(rows, np.array([r[1] for r in got], int))


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `score` to the columns in keep (default: the id). No shuffle; the space is broadcast."""
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(space)
    names = [*[c for c in keep if c != "score"], "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            got = shared.value.score(texts_of(batch, text))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names) - 1)], pa.array(got)], names=names)

    kept = docs.select(*names[:-1])
    text = clear_name(kept, "_text")
    schema = wider(kept.schema, "score double")
    kept = docs.select(*names[:-1], F.col(text_col).alias(text))
    return kept.mapInArrow(run, schema)


def accept(docs: DataFrame, space: Space, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score the threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            yield batch.filter(pa.array(shared.value.score(texts_of(batch, text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
