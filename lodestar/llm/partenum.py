"""Similarity join of shingle sets by PartEnum signatures, and the components of its links.

Two sets with Jaccard similarity 3/4 or more differ in at most (n + m) / 7 elements. Sets are parted into bands of size,
[2^c, 2^(c+1)); a band's scheme parts the domain of elements into as many parts as the band is wide, and enumerates the
subsets of one part each: a signature is the content of one part. A set emits signatures in its own band's scheme, and in
the next one's where a partner could be of that band. As each differing element spoils one part at most, two linked sets
share a signature if either has more filled parts than they have differences; only then are empty parts left out. Sets
for which this does not hold emit their empty parts too and so meet each other. Of a set's parts in the order (most
elements first, then hash) the first k + 1 suffice, k the largest number of differences to any partner: those before the
first shared one are all spoiled. Nothing is missed: each link has a common signature.

Sets that share a signature are candidates. In a few turns each is checked with one partner in a turn, the head of most
of its signatures' groups (the smallest id in the first turn, others later); links give components, and members of one
component are not compared again. Turns end when no large group is left. Then only members of different components are compared: a parity sketch (each
element flips one bit) bounds differences from below and drops almost all, the rest are checked exactly. So a group of
copies or near copies costs one check a member, and no pairs within a component are formed.

A node is a set, told by a 64-bit hash as elements are; equal sets are one node, and copies within a batch emit once.

Cases: a null, empty or blank text has an empty set and is linked with nothing; fewer than five words make one shingle;
rows of one id are rows of their own, each with its set's component; rows without an id take the smallest id of their
component, if it has any; an empty table gives no rows; extra columns are ignored (in `keep_one` they are kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, list_array, mix, pieces, plain_schema, save, shingle_sets, texts_of

#: Ids that a semi-join may broadcast; beyond them it shuffles.
BROADCAST_IDS = 1_000_000
#: Turns of one check a member at most, and the group size beyond which another turn is worth it.
STARS, LARGE = 3, 10_000
#: Members of a signature's group that are compared block against block.
GROUP_BLOCK = 2048


def set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def differences(n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The most elements in which a set of n elements and a partner of at most `most` differ."""
    return (n + np.minimum(4 * n // 3, most)) // 7


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set) of all sets."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    band = np.zeros(len(size), np.int64)
    band[size > 0] = np.floor(np.log2(size[size > 0])).astype(np.int64)
    upper = np.zeros(len(size), np.int64)
    upper[size > 0] = np.floor(np.log2(np.maximum(1, 4 * size[size > 0] // 3))).astype(np.int64)
    value = mix(hashes ^ np.uint64(0xA4093822299F31D0))
    sigs, sets = [], []
    for more in (0, 1):
        scheme = band + more
        use = (size > 0) & ((more == 0) | (upper > band))
        parts = np.left_shift(1, scheme + (scheme <= 5))
        k = differences(size, np.left_shift(1, scheme + 1) - 1)  # partners that meet in this scheme are in its band at most
        mine = use[owner]
        own, e, v = owner[mine], hashes[mine], value[mine]
        if not len(own):
            continue
        part = ((e >> np.uint64(20)) & (parts[own] - 1).astype(np.uint64)).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(np.where(use, parts, 0))])
        slot = start[own] + part
        count = np.bincount(slot, minlength=start[-1])
        order = np.argsort(slot, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v[order], dtype=np.uint64)])
        ends = np.cumsum(count)
        content = total[ends] - total[ends - count]
        who = np.repeat(np.arange(len(size)), np.where(use, parts, 0))
        number = np.arange(start[-1]) - start[who]
        sig = mix(content + mix((scheme[who] << 40 | number).astype(np.uint64)) + count.astype(np.uint64))
        filled = np.bincount(who[count > 0], minlength=len(size))
        keep = (count > 0) | (filled <= k)[who]
        sig, who, count = sig[keep], who[keep], count[keep]
        order = np.lexsort((sig, -count, who))
        sig, who = sig[order], who[order]
        begin = np.searchsorted(who, np.arange(len(size)))
        keep = np.arange(len(who)) - begin[who] <= k[who]
        sigs.append(sig[keep] >> np.uint64(16))  # 48 bits: a false meeting costs a comparison, and rows are smaller
        sets.append(who[keep])
    if not sigs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(sigs), np.concatenate(sets)


def sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity sketches: a power of two of bits, 2 to 4 an element and beyond 512 elements 1 to 2, at most 8 KB."""
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        near = 1 << int(max(1, b - a) - 1).bit_length()
        bits = min(1 << 16, max(64, near, min(2 * near, 1024)))
        flips = np.bincount(((hashes[a:b] >> np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(flips.astype(np.uint8)).tobytes())
    return out


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "_text"):
        hashes, first = shingle_sets(texts_of(b, "_text"))
        made = [pa.array(set_ids(hashes, first).view(np.int64)), pa.array(np.diff(first)), pa.array(sketches(hashes, first), pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["id", "key", "node", "n", "sketch"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "_text"):
        hashes, first = shingle_sets(texts_of(b, "_text"))
        node = set_ids(hashes, first)
        sig, who = signatures(hashes, first)
        _, lead = np.unique(node, return_index=True)  # copies within a batch emit once
        keep = np.isin(who, lead)
        doc = b.column(0).fill_null(2**63 - 1).to_numpy()[who[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(node[who[keep]].view(np.int64)), pa.array(doc)], names=["sig", "node", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "_text"):
        hashes, first = shingle_sets(texts_of(b, "_text"))
        yield pa.RecordBatch.from_arrays([pa.array(set_ids(hashes, first).view(np.int64)), list_array(hashes.view(np.int64), first, pa.int64())], names=["node", "set"])


def compare(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one signature's members that may be linked: of different components, of like size, near by sketch."""
    node, comp, n = (group.column(c).to_numpy() for c in ("node", "component", "n"))
    order = np.argsort(n, kind="stable")
    node, comp, n = node[order], comp[order], n[order]
    raw = group.column("sketch").to_pylist()
    bits = min(map(len, raw))
    rows = [folded(raw[i], bits) for i in order]
    sketch = np.stack(rows)
    left, right = [], []
    for at in range(0, len(n), GROUP_BLOCK):
        for to in range(at, len(n), GROUP_BLOCK):
            if 3 * n[to] > 4 * n[min(at + GROUP_BLOCK, len(n)) - 1]:
                break
            for i in range(at, min(at + GROUP_BLOCK, len(n))):
                j0 = max(i + 1, to)
                j1 = min(to + GROUP_BLOCK, int(np.searchsorted(n, 4 * n[i] // 3, side="right")))
                if j0 < j1:
                    js = np.arange(j0, j1)
                    js = js[comp[js] != comp[i]]
                    far = np.bitwise_count(sketch[js] ^ sketch[i]).sum(1, dtype=np.int64)
                    js = js[7 * far <= n[js] + n[i]]
                    left.append(np.full(len(js), node[i]))
                    right.append(node[js])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are in the order of sig; a group may go over several."""
    held: list[pa.RecordBatch] = []

    def answer(part: pa.Table) -> pa.RecordBatch:
        sig = part.column("sig").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
        got = [compare(part.slice(a, b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        a, b = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if held[0].column(0)[0] == b.column(0)[b.num_rows - 1]:
            continue
        sig = b.column(0).to_numpy()
        last = int(np.searchsorted(sig, sig[-1]))
        if last or len(held) > 1:
            yield answer(pa.Table.from_batches([*held[:-1], b.slice(0, last)]).combine_chunks())
        held = [b.slice(last)]
    if held:
        yield answer(pa.Table.from_batches(held).combine_chunks())


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of `size` bytes: bits are numbered by the low end of the hash, so upper halves fold down."""
    s = np.frombuffer(sketch, np.uint64)
    while s.nbytes > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow a link."""
    for b in batches:
        n, m, s, t = (b.column(i).to_pylist() for i in range(2, 6))
        keep = [7 * int(np.bitwise_count(folded(u, k) ^ folded(v, k)).sum()) <= i + j for i, j, u, v in zip(n, m, s, t, strict=True) for k in [min(len(u), len(v))]]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def check(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: by their sketches' bound, then by their sets. Of each set one text is read again."""
    x, y = (nodes.select(F.col("node").alias(c), F.struct("n", "sketch").alias(k)) for c, k in (("a", "x"), ("b", "y")))
    near = pairs.join(x, "a").join(y, "b").where("3 * x.n <= 4 * y.n AND 3 * y.n <= 4 * x.n")
    near = near.select("a", "b", F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.sketch").alias("s"), F.col("y.sketch").alias("t"))
    pairs = save(near.mapInArrow(_bounded, plain_schema("a long, b long")), "near")
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    need = save(need.join(nodes, "node").select("key", F.col("id").alias("_low")), "need")
    few = need.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # broadcast while they are few, else shuffled
    texts = docs.join(F.broadcast(need) if few else need, (F.xxhash64("_text") == F.col("key")) & F.col("_id").eqNullSafe(F.col("_low")), "left_semi")
    sets = save(texts.select("_text").mapInArrow(_sets, plain_schema("node long, set array<long>")), "sets")
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = 100 * both >= 75 * (F.size("x") + F.size("y") - both)
    return pairs.join(a, "a").join(b, "b").where(linked).select("a", "b").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    keyed = docs.select("_id", F.xxhash64("_text").alias("key"), "_text")
    ids = save(keyed.mapInArrow(_identities, plain_schema("id long, key long, node long, n long, sketch binary")), "sets")
    one = F.min(F.struct("id", "key"))
    nodes = ids.where("n > 0").groupBy("node").agg(one.alias("one"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = save(nodes.select("node", "low", F.col("one.id").alias("id"), F.col("one.key").alias("key"), "n", "sketch"), "nodes")

    signed = docs.mapInArrow(_signed, plain_schema("sig long, node long, id long"))
    group = Window.partitionBy("sig")
    ends = [F.min("node").over(group).alias("lo"), F.max("node").over(group).alias("hi"), F.min(F.struct("id", "node")).over(group).alias("head")]
    signed = signed.select("sig", "node", F.lag("node").over(group.orderBy("node")).alias("last"), *ends)
    shared = signed.where("lo <> hi AND (last IS NULL OR last <> node)").select("sig", "node", F.col("head.node").alias("head"))
    shared = save(shared, "shared")

    star, links = shared.where("node <> head"), None
    for turn in range(1, STARS + 1):
        star = star.groupBy("node", "head").count()
        star = star.groupBy(F.col("node").alias("a")).agg(F.max_by("head", F.struct("count", F.xxhash64("head"))).alias("b"))
        new = save(check(save(star, "pairs"), docs, nodes), "found")
        links = new if links is None else links.unionByName(new)
        known = components(links)
        # groups that still have members of several components
        rows = shared.select("sig", "node").join(known, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        rows = rows.select("*", F.min("component").over(group).alias("lo"), F.max("component").over(group).alias("hi"), F.count("*").over(group).alias("m"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "component")).over(group).alias("head"))
        rows = save(rows.where("lo <> hi").select("sig", "node", "component", "m", F.col("head.node").alias("head"), F.col("head.component").alias("c")), "open")
        if (rows.agg(F.max("m")).first()[0] or 0) <= LARGE:
            break
        shared, star = rows, rows.where("component <> c")

    # what is left: members of different components
    rows = rows.join(nodes.select("node", "n", "sketch"), "node")
    rows = rows.select("sig", "node", "component", "n", "sketch").repartition("sig").sortWithinPartitions("sig")
    pairs = save(rows.mapInArrow(_compared, plain_schema("a long, b long")).distinct(), "pairs")
    more = save(check(pairs, docs, nodes), "found")
    known = components(links.unionByName(more))

    ends = nodes.select("node", "low").join(known, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    low = ends.groupBy("component").agg(F.min("low").alias("component_id"))
    of = save(ends.join(low, "component").select("node", "component_id"), "component")
    out = ids.select("id", "node", "n").join(of, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are their component's smallest, with all columns. Rows of one id stay or go together."""
    lead = join(docs, id_col, text_col).where(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("_lead")).distinct()
    return docs.join(lead, docs[id_col].eqNullSafe(lead["_lead"]), "left_semi")
