"""Benchmark passages in a corpus: one Aho-Corasick automaton over the normalised words of test questions and answers.

A-Z count as a-z, words are runs of digits, a-z and anything beyond ASCII. A window is WINDOW consecutive words of an item;
an item of fewer words, but not none, is one window. The automaton's letters are word numbers: its keys are the windows,
so a text is read once, word by word, and every occurrence of every window ends at some word. Word numbers are then mapped
to code points of the original text.

The windows come from Spark as (window, item) pairs and go out in a broadcast, of which MOST pairs bound the size. A larger
set of items is dealt by hash into blocks of at most about MOST pairs, each with an automaton of its own; the texts pass
them one after another, with what was found so far beside them, through the shared folder. So the result doesn't depend
on the number of blocks, however many items share a window. Nothing is shuffled but the windows.

Cases: a null text has no words and no hits; texts and items without words have no windows; repeated items, windows and
documents each count as they stand (an item's id counts once a document; items with a null id hit words, but have no id to be
listed); a document's every row gets a result of its own; a very long text is worked on whole; an empty table of items
hits nothing, an empty table of documents gives no rows; `scan` keeps all columns of the documents, and its own columns
avoid their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_name, forget, pieces, plain_schema, save, texts_of, wider

#: Words of a window; (window, item) pairs of one automaton (10 words each: some 150 MB in a worker).
WINDOW, MOST = 10, 1 << 18

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "array<struct<first:int,last:int,start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window): the windows of all items, as words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text", 1 << 16):
            names, out = [], []
            for item, text in zip(b.column(0).to_pylist(), texts_of(b, "_text"), strict=True):
                own = words(text)
                for i in range(max(1, len(own) - window + 1) if own else 0):
                    names.append(item)
                    out.append(b" ".join(own[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary()).cast(pa.string())], names=["item", "window"])

    own = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(run, plain_schema("item string, window string")).distinct()


class Automaton:
    """Windows of one block: finds their occurrences in a list of words."""

    def __init__(self, pairs: list[tuple[str | None, str]]) -> None:
        self.number: dict[bytes, int] = {}
        keys: dict[tuple[int, ...], list[str]] = {}
        for item, window in pairs:
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.encode().split(b" "))
            own = keys.setdefault(key, [])
            if item is not None:
                own.append(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in keys.items():
            self.machine.add_word(key, (len(key), own))
        if keys:
            self.machine.make_automaton()
        self.empty = not keys

    def find(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs (first word, last word + 1) of hit words in order, and the items whose windows occur."""
        get = self.number.get
        numbers = tuple([get(w, 0) for w in own])
        runs, items = [], set()
        if self.empty or not any(numbers):
            return runs, items
        for end, (size, names) in self.machine.iter(numbers):
            items.update(names)
            runs.append((end + 1 - size, end + 1))
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def placed(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word runs with their code points in the original text (end exclusive)."""
    if not runs:
        return []
    ends = [m.span() for m in _WORD.finditer(text)]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"first": a, "last": b, "start": int(points[ends[a][0]]), "end": int(points[ends[b - 1][1]])} for a, b in runs]


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = MOST) -> DataFrame:
    """The documents with n_words, hits (runs of hit words: first and last word, exclusive, and code points) and items
    (ids as strings, sorted). A name that the documents have gets an underscore."""
    spark = docs.sparkSession
    pairs = save(windows(items, item_col, item_text, window), "windows")
    blocks = -(-pairs.count() // most) or 1
    names = []
    for n in ("n_words", "hits", "items"):
        names.append(clear_name(docs, n))
    kind = wider(docs.schema, f"`{names[0]}` long, `{names[1]}` {HITS}, `{names[2]}` array<string>")
    at, width, last = docs.columns.index(text_col), len(docs.columns), None
    for block in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == block).collect()  # about `most` rows
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, earlier=block > 0) -> Iterator[pa.RecordBatch]:
            machine = Automaton(shared.value)
            for b in pieces(batches, text_col):
                texts = texts_of(b, text_col)
                counts, hits, found = [], [], []
                before = zip(b.column(width + 1).to_pylist(), b.column(width + 2).to_pylist(), strict=True) if earlier else [((), ())] * len(texts)
                for text, (old, known) in zip(texts, before, strict=True):
                    own = words(text)
                    runs, names_ = machine.find(own)
                    counts.append(len(own))
                    hits.append(placed(text, merged(runs + [(h["first"], h["last"]) for h in old])))
                    found.append(sorted(names_.union(known)))
                made = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), *made], names=[*(f"c{i}" for i in range(width)), *names])

        source = docs if last is None else last
        out = source.select(*[F.col(f"`{c}`").cast("string") if i == at else F.col(f"`{c}`") for i, c in enumerate(source.columns)]).mapInArrow(_named(run, kind), kind)
        if block + 1 < blocks:
            written = save(out, "hits")
            if last is not None:
                forget(last)
            last = written
    return out


def _named(run, kind):  # noqa: ANN001, ANN202
    names = [f.name for f in kind.fields]
    return lambda batches: (pa.RecordBatch.from_arrays(b.columns, names=names) for b in run(batches))


def without(docs: DataFrame, items: DataFrame, share: float = 0.0, **names: str) -> DataFrame:
    """The documents, and their columns alone, whose hit words are at most `share` of their words."""
    found = scan(docs, items, **names)
    n, hits = found.columns[len(docs.columns)], found.columns[len(docs.columns) + 1]
    return found.where(hit_words(hits) <= share * F.col(n)).select(*docs.columns)


def hit_words(hits: str):  # noqa: ANN201
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), items)
    n = hit_words("hits")
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (n > 0).alias("contaminated"))
