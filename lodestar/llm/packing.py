"""Vector bin packing of examples into training sequences.

An example takes three resources of a sequence: tokens, segments (one for each piece) and loss-bearing tokens. Whole
stretches of the sequence length stand alone; what remains of each example is an item. Items go to sequences by the
dot-product heuristic: among the items that fit under all three limits, the one whose demand has the largest dot product
with what is left of the sequence, both weighted by how scarce each resource is. Items are kept in classes of like
demand, so a step looks at classes instead of items. Where cutting is allowed, an item is cut to fill what is left, and a
sequence that closes before it is full (no more items, segments or loss-bearing tokens) is cut at powers of two, which
need no padding. Where cutting is not allowed, smaller members of a class are tried when its largest doesn't fit.

Each task packs the rows of its own partition, so there is no shuffle, no group to gather and nothing on the driver; the
pieces of a task follow from its rows and their order alone, and numbers of sequences begin at the partition's number
times 2^32, so a task that runs again gives the same rows. A task holds one block of a bounded number of tokens.

Cases: a null or empty text has only the end id; null ids of documents pass through; repeated rows are packed one by
one; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BPE, Memo, Units
from .common import pieces, plain_schema

#: Examples that a task packs together; more make little difference to the padding.
BLOCK = 4096


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. cut: examples may be cut anywhere (else only where they are too long)."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    cut: bool = True


@dataclass
class Piece:
    example: int
    start: int
    length: int
    sequence: int = -1
    offset: int = 0


def _classes(need: np.ndarray, limits: Limits) -> list[int]:
    """Items of like demand share a class: sixteenths of the token and loss limits."""
    step = [max(1, limits.tokens // 16), max(1, limits.loss_tokens // 16)]
    return (need[:, 0] // step[0] * 64 + need[:, 2] // step[1]).tolist()


def pack(tokens: np.ndarray, loss_from: np.ndarray, limits: Limits) -> tuple[list[Piece], int]:
    """Pieces of examples with `tokens` tokens, whose tokens from loss_from on bear loss; and the number of sequences.

    An example with more loss-bearing tokens than a sequence may have is cut so that each piece keeps the limit.
    """
    out: list[Piece] = []
    items: list[Piece] = []
    count = 0
    stride = limits.tokens

    def loss(p: Piece) -> int:
        return max(0, p.start + p.length - max(p.start, int(loss_from[p.example])))

    for e, total in enumerate(tokens.tolist()):
        at = 0
        while at < total:
            p = Piece(e, at, min(stride, total - at))
            if (over := loss(p) - limits.loss_tokens) > 0:
                p.length -= over
            at += p.length
            if p.length == stride:
                p.sequence, count = count, count + 1
                out.append(p)
            else:
                items.append(p)
    if not items:
        return out, count
    need = np.array([(p.length, 1, loss(p)) for p in items], np.int64)
    size = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    scarce = need.sum(0) / size  # resources that the items use up most weigh most
    weight = scarce / scarce.sum()
    pools: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(need[:, 0], kind="stable").tolist():  # the largest item of a class is at its end
        pools[_classes(need[i : i + 1], limits)[0]].append(i)
    names = list(pools)
    heads = np.array([need[pools[k][-1]] for k in names])
    live = np.ones(len(names), bool)
    left_over = len(items)
    while left_over:
        room, offset, placed = size.astype(np.int64), 0, []
        while left_over and room[0] > 0 and room[1] > 0:
            fits = live & (heads <= room).all(1)
            lower = None if limits.cut or fits.any() else smaller(pools, names, live, need, room)
            if lower is not None:
                k, at = lower
                p = items[pools[names[k]].pop(at)]
                part, rest = p, None
            elif fits.any():
                score = np.where(fits, ((heads / size) * (room / size) * weight).sum(1), -1)
                k = int(score.argmax())
                p = items[pools[names[k]].pop()]
                part, rest = p, None
            elif limits.cut:
                k = int(np.where(live, heads[:, 0], -1).argmax())  # cut what is longest to fill the gap
                i = pools[names[k]].pop()
                p, length = items[i], int(room[0])
                part = Piece(p.example, p.start, length)
                if (over := loss(part) - int(room[2])) > 0:
                    part.length -= over
                if part.length <= 0 or part.length >= p.length:
                    pools[names[k]].append(i)
                    break
                rest = Piece(p.example, p.start + part.length, p.length - part.length)
            else:
                break
            part.sequence, part.offset = count, offset
            placed.append(part)
            offset += part.length
            room -= np.array([part.length, 1, loss(part)])
            if rest is not None:
                items.append(rest)
                own = np.array([(rest.length, 1, loss(rest))])
                name = _classes(own, limits)[0]
                if name not in pools or name not in names:
                    pools[name] = []
                    names.append(name)
                    heads, live = np.vstack([heads, own]), np.append(live, False)
                pools[name].append(len(items) - 1)
                j = names.index(name)
                heads[j], live[j] = own[0], True
                left_over += 1
            left_over -= 1
            if pools[names[k]]:
                heads[k] = need_of(items[pools[names[k]][-1]], loss)
                live[k] = True
            else:
                live[k] = False
        count += 1
        if limits.cut and offset & (offset - 1):
            placed, count = binary(placed, count - 1)
        out += placed
    return out, count


def smaller(pools: dict[int, list[int]], names: list[int], live: np.ndarray, need: np.ndarray, room: np.ndarray) -> tuple[int, int] | None:
    """(class, place) of the largest item that fits where the largest of its class doesn't; items were never cut."""
    best = None
    for k in np.flatnonzero(live).tolist():
        own = need[pools[names[k]]]
        fit = np.flatnonzero((own <= room).all(1))
        if len(fit) and (best is None or own[fit[-1], 0] > best[0]):
            best = (own[fit[-1], 0], k, int(fit[-1]))
    return None if best is None else best[1:]


def need_of(p: Piece, loss) -> tuple[int, int, int]:
    return p.length, 1, loss(p)


def binary(placed: list[Piece], count: int) -> tuple[list[Piece], int]:
    """Cuts one sequence into several whose lengths are powers of two. Returns its pieces and the next number."""
    total, out = sum(p.length for p in placed), []
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    queue, room, offset = list(reversed(placed)), sizes.pop(0), 0
    while queue:
        p = queue.pop()
        take = min(p.length, room)
        out.append(Piece(p.example, p.start, take, count, offset))
        if take < p.length:
            queue.append(Piece(p.example, p.start + take, p.length - take))
        room, offset = room - take, offset + take
        if not room and sizes:
            room, offset, count = sizes.pop(0), 0, count + 1
    return out, count + 1


_MEMOS: dict[str, Memo] = {}


def library_encoder(path: str, bpe: BPE, together: int = 500):
    """Raw words -> bytes of their ids. Words go to the library many at a time, parted by an added token, which it
    takes out of a text before anything else."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    if not bpe.added:
        return lambda words: [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(words, add_special_tokens=False)]
    mark, number = next(iter(bpe.added.items()))

    def encode(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        texts = [mark.join(words[i : i + together]) for i in range(0, len(words), together)]
        for e in library.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, cut = ids.tobytes(), (4 * np.flatnonzero(ids == number)).tolist()
            out += [data[a:b] for a, b in zip([0, *(c + 4 for c in cut)], [*cut, len(data)], strict=True)]
        return out

    return encode


def id_arrays(path: str, texts: pa.Array) -> list[bytes]:
    """Little-endian 32-bit ids of each text, by the tokenizers library; each distinct raw word is encoded once."""
    if path not in _MEMOS:
        bpe = BPE(path)
        _MEMOS[path] = Memo(bpe, encode=library_encoder(path, bpe))
    memo = _MEMOS[path]
    units = Units(texts, memo.bpe)
    data = memo.ids(units.words)
    flat = pa.array(data, pa.binary()).take(pa.array(units.number))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(units.first.astype(np.int32)), flat), b"").to_pylist()


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """Pieces of all documents. A document's ids are its text's and end_id. Its first `prompt_col` tokens bear no loss
    (default, or null: its first one)."""
    end = np.array([end_id], "<u4").tobytes()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[bytes] = []
        free: list[int] = []

        def block() -> pa.RecordBatch:
            nonlocal base
            tokens = np.array([len(x) // 4 for x in ids], np.int64)
            found, count = pack(tokens, np.array(free, np.int64), limits)
            rows = [(keys[p.example], p.start, p.length, zlib.crc32(ids[p.example][4 * p.start : 4 * (p.start + p.length)]), int(tokens[p.example]), base + p.sequence, p.offset) for p in found]
            base += count
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in pieces(batches, "text", 4 << 20):
            keys += batch.column(0).cast(pa.int64()).to_pylist()
            ids += [x + end for x in id_arrays(path, batch.column(1))]
            free += batch.column(2).to_pylist()
            if len(ids) >= BLOCK or sum(map(len, ids)) > 32 << 20:
                yield block()
                keys, ids, free = [], [], []
        if ids:
            yield block()

    prompt = F.lit(1) if prompt_col is None else F.greatest(F.lit(0), F.coalesce(F.col(prompt_col), F.lit(1)))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), prompt.cast("long").alias("prompt")).mapInArrow(run, plain_schema(", ".join(f"{n} long" for n in names)))
