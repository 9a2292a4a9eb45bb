"""Shared ground of the operators: the shared folder, text hashing in numpy, batching and components."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --------------------------------------------------------------------------- shared folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; it goes when the JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what `save` wrote for frames that nothing will read any more."""
    for df in frames:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Parts:
    """A table in the shared folder that is written part by part, so that no plan holds more than one of them."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType) -> None:
        self.spark, self.schema, self.path, self.some = spark, schema, new_path(spark, name), False

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)
        self.some = True

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.some else self.spark.createDataFrame([], self.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- hashing of words

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLD = 0x9E3779B97F4A7C15
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _BASE_INV)):
            factors = np.full(size, b, np.uint64)
            factors[:1] = 1
            _POWERS[i:] = [np.cumprod(factors, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a list of texts: hash, byte start and end, number of the text.

    first[i]:first[i + 1] are the words of text i; offset[i] is where its bytes begin in data.
    """

    def __init__(self, texts: list[bytes], lower: bool) -> None:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
        white = WHITE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = np.empty(0, np.uint64)
        if len(self.start):
            power, inverse = powers(len(self.data) + 1)
            sums = (_LOWER if lower else _BYTE)[self.data]
            sums *= power[:-1]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.offset)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring words (as if all were one text)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct k-word shingles of text i are hashes[first[i]:first[i + 1]].

    A-Z count as a-z. A text of fewer than k words has its whole sequence as the only shingle, one without words none.
    Equal shingles are told by 64-bit hashes.
    """
    w = Words(texts, lower=True)
    number = np.diff(w.first)
    hashes, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(w.hash) >= k:
        inside = np.flatnonzero(w.text[: len(w.text) - k + 1] == w.text[k - 1 :])
        hashes, owner = grams(w.hash, k)[inside], w.text[inside]
    short = np.flatnonzero((number > 0) & (number < k))
    if len(short):
        more = np.array([grams(w.hash[w.first[i] : w.first[i + 1]], int(number[i]))[0] ^ np.uint64(number[i]) for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, more]), np.concatenate([owner, short])
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


try:  # gives memory that is free back to the system, where the C library can
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):
    _trim = None


def tidy() -> None:
    """Workers are used again, so what a batch leaves behind would stay with them."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece have about `most` bytes (a longer text stands alone)."""
    for batch in batches:
        tidy()
        if not batch.num_rows:
            continue
        place = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto
    tidy()


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A null text is an empty one."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


# --------------------------------------------------------------------------- joins

#: Rows of a key that make it heavy, if they are also more than a thousandth of all rows.
HEAVY = 500


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join (inner or left) of rows with a frame that has one row a key, whatever share of the rows a key holds.

    Keys with more than a thousandth of the rows are fewer than a thousand; their rows meet them in a broadcast, and stay
    where they are. All others are joined as usual. `rows` should be a written table: it is counted first.
    """
    share = max(HEAVY, rows.count() // 1000)
    heavy = rows.groupBy(*keys).count().where(F.col("count") > share).select(*keys).collect()  # fewer than 1000
    if not heavy:
        return rows.join(one, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(heavy, rows.select(*keys).schema))
    ours = F.broadcast(one.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_semi").join(ours, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(one, keys, how))


def clear_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# --------------------------------------------------------------------------- tiles

#: Slots of queries that one job answers (so many copies of the rows it shuffles), shuffle partitions of its tiles at most.
SLOTS, TILES = 64, 16384


def dealt(df: DataFrame, most: int, name: str) -> tuple[DataFrame, int]:
    """A written frame's rows with their number among `n` blocks of about `most` rows (fewer, if cores would idle), and n.
    A row's block is a hash of its place in the written table (`n` of it), so equal rows part and a lost task deals alike."""
    total, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    n = max(-(-total // most), min(cores, total // 1024), 1)
    return df.withColumn(name, F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")).drop("n"), n


def tiles(rows: DataFrame, asks: DataFrame, blocks: int, slots: int, answer: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> Iterator[DataFrame]:
    """Every block of rows meets every slot of queries in a group of its own, which `answer` gets as two tables. A frame for each
    SLOTS slots, so that a job's shuffle stays bounded; nothing passes through the driver, and no task holds more than a tile."""
    for low in range(0, slots, SLOTS):
        high = min(low + SLOTS, slots) - 1
        n = min(TILES, blocks * (high - low + 1))
        many = rows.withColumn("slot", F.explode(F.sequence(F.lit(low), F.lit(high)))).repartition(n, "block", "slot")
        every = asks.where(F.col("slot").between(low, high)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(n, "block", "slot")
        yield many.groupBy("block", "slot").cogroup(every.groupBy("block", "slot")).applyInArrow(answer, schema)


def vectors_of(table: pa.Table, dims: int) -> np.ndarray:
    rows = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks]
    return np.concatenate([np.empty(0), *rows]).reshape(-1, dims)


# --------------------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that links reach. Nodes without a link are absent.

    Alternating large-star and small-star rounds; each is written to the shared folder. Pre-aggregated minima keep
    hot nodes from gathering their neighbours in one task.
    """
    edges = save(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links")
        # large star: larger neighbours point to the smallest node around
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        # small star: a node's smaller neighbours, and itself, point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, edges = (edges, low), save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        forget(*last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)


def wider(schema: T.StructType, text: str) -> T.StructType:
    """A schema with more columns at its end."""
    return T.StructType([*schema.fields, *plain_schema(text).fields])


def plain_schema(text: str) -> T.StructType:
    return T._parse_datatype_string(re.sub(r"\s+", " ", text))
