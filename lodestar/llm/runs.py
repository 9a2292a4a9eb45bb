"""Periodic runs of words by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length max(LEAST, 3 q) or
more that no neighbouring word extends keeping period q. For a sequence of words:

1. LZ factorisation from a suffix automaton: each factor is the longest one that occurs earlier (overlaps allowed), or a
   new word. States keep the end of their first occurrence, which tells where an earlier one is.
2. Main's algorithm finds the runs that cross or touch a border of two factors, from longest matches to both sides of the
   border for each period. Take a run [s, e) of period q. A factor that begins at or after s + q reaches e, since what
   follows occurs q words before. So either one border b lies in [s + q, e), with the factor before it beginning before s + q
   (`left`: period below half of both factors); or none does, and the factor around s + q begins at or after s
   (`right`: period at most half of it), or ends with the run (`left` at its end), or holds the run strictly inside.
3. The last ones are copied from the factor's earlier occurrence, by increasing start, so that overlaps copy from themselves.

All of this is linear in the words for the exponents asked for. Before it, words that no run can hold are cut out: a run of
at least 24 words and three periods has for each of its words a stretch of 16 words of its own around it that occurs q words away as
well. So only stretches of words that are covered by 16 words which repeat in the same text go on; others part them. A neighbour
that extends a run is in a longer run, so it is never cut off.

Words are told apart by 64-bit hashes. Every text is worked on where it is, whole: nothing is shuffled.

Cases: a null text is an empty one, without words and runs; texts of fewer than LEAST words have no runs; runs may overlap or
hold one another; of equal exponents the smallest start, then period, is the greatest; repeated rows each get their result;
a very long text takes memory in proportion; an empty table gives no rows; `find` keeps all columns, and its own avoid their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, clear_name, grams, mix, pieces, plain_schema, texts_of, wider

#: Words of a run at least, and words of a stretch that has to repeat: a run longer than LEAST has two thirds of it twice.
LEAST, GRAM = 24, 16
TIMES = 3


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, begin of an earlier occurrence) of the LZ factors; a new word has -1."""
    link, length, first, after = [-1], [0], [-1], [{}]
    last = 0
    for i, c in enumerate(w):
        now = len(length)
        length.append(i + 1)
        first.append(i)
        after.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                first.append(first[q])
                after.append(after[q].copy())
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            to = after[state][w[j]]
            if first[to] >= j:  # first seen here
                break
            state, j = to, j + 1
        if j == i:
            out.append((i, i + 1, -1))
            i += 1
        else:
            out.append((i, j, first[state] - (j - i) + 1))
            i = j
    return out


def matches(s: list[int]) -> list[int]:
    """Longest common prefix of s and each of its suffixes."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    a = b = 0
    for i in range(1, n):
        k = 0
        if i < b:
            k = z[i - a]
            if k < b - i:
                z[i] = k
                continue
            k = b - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        a, b = i, i + k
    return z


def right(w: list[int], b: int, e: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that begin less than a period before b, or at it, and end in the factor [b, e)."""
    size = e - b
    if 3 * size <= 2 * LEAST:
        return
    ahead = matches(w[b:e])
    most = size // 2
    low = max(0, b - most)
    back = matches([*reversed(w[low:b]), -1, *reversed(w[low : b + most])])[b - low + 1 :]
    for q in range(1, most + 1):
        before, end = back[most - q], b + q + ahead[q]
        if before < q and end - b + before >= max(LEAST, TIMES * q) and not (end == e < len(w) and w[e] == w[e - q]):
            yield b - before, end, q


def left(w: list[int], a: int, b: int, e: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that have at least a period before b, the border of the factors [a, b) and [b, e)."""
    both = e - a
    if 3 * both <= 2 * LEAST:
        return
    most = min((both - 1) // 2, b)
    low = max(0, b - most - (b - a))
    back = matches(w[low:b][::-1])
    ahead = matches([*w[b:e], -1, *w[b - most : e]])[e - b + 1 :]
    for q in range(1, most + 1):
        before = back[q] if q < len(back) else 0
        if before < b - a:
            after = min(ahead[most - q], e - b)
            if before + q + after >= max(LEAST, TIMES * q):
                yield b - q - before, b + after, q


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence of words, by start, then period."""
    found: dict[int, dict[int, int]] = {}

    def keep(s: int, e: int, q: int) -> None:
        own = found.setdefault(s, {})
        own[e] = min(q, own.get(e, q))  # a period's multiples have the same stretch

    parts = factors(w)
    before = 0
    for b, e, source in [*parts, (len(w), len(w), -1)]:
        for r in right(w, b, e):
            keep(*r)
        for r in left(w, before, b, e):
            keep(*r)
        if source >= 0 and e - b > LEAST:
            shift, upto = b - source, source + e - b
            for s in range(source + 1, upto - LEAST):
                for end, q in list(found.get(s, {}).items()):
                    if end < upto:
                        keep(s + shift, end + shift, q)
        before = b
    return sorted(((s, e, q) for s, own in found.items() for e, q in own.items()), key=lambda r: (r[0], r[2]))


def stretches(w: Words) -> Iterator[tuple[int, int, int]]:
    """(text, first word, last word + 1) of the stretches of words that runs can lie in; numbers are those of the batch."""
    if len(w.hash) < LEAST:
        return
    inside = np.flatnonzero(w.text[: len(w.text) - GRAM + 1] == w.text[GRAM - 1 :])
    key = mix(grams(w.hash, GRAM)[inside] ^ mix(w.text[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, inside[twice], 1)
    np.add.at(cover, inside[twice] + GRAM, -1)
    covered = np.cumsum(cover[:-1]) > 0
    label = np.where(covered, w.text, -1)
    edge = np.concatenate([[0], np.flatnonzero(label[1:] != label[:-1]) + 1, [len(label)]])
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if label[a] >= 0 and b - a >= LEAST:
            yield int(label[a]), int(a), int(b)


def runs_of(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of the runs of each text."""
    w = Words(texts, lower=False)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, a, b in stretches(w):
        numbers = np.unique(w.hash[a:b], return_inverse=True)[1].tolist()
        base = a - int(w.first[text])
        out[text] += [(s + base, e + base, q) for s, e, q in runs(numbers)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(text: bytes, own: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks; of each run only its first period stays."""
    words = text.split()
    if own:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, e, q in own:
            gone[s + q] += 1
            gone[e] -= 1
        words = [x for x, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return b" ".join(words)


RUNS = "array<struct<start:long,length:long,period:long>>"


def find(docs: DataFrame, text_col: str = "text", collapse: bool = True) -> DataFrame:
    """The documents with runs (by start, then period) and collapsed, the text without what runs repeat (null if not asked
    for). A name that the documents have gets an underscore."""
    names = [clear_name(docs, n) for n in ("runs", "collapsed")]
    kind = wider(docs.schema, f"`{names[0]}` {RUNS}, `{names[1]}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            texts = texts_of(b, text_col)
            got = runs_of(texts)
            spans = pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in own] for own in got], pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))
            short = pa.array([collapsed(t, own) if collapse else None for t, own in zip(texts, got, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, spans, short], names=[f.name for f in kind.fields])

    return docs.mapInArrow(run, kind)


def greatest(found: str) -> Column:
    """Of runs by start, then period: the one with the greatest exact length / period."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(found, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the greatest run, runs_sha256, collapsed_sha256."""
    found = find(docs.select("doc_id", "text")).withColumn("best", greatest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.expr("best.length * 1000 div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the crc32 of the decimal id and g = floor(h / 10), a text of n > 0 words whose h % 10 is 0 goes
    over from word a = g % n on, where it becomes a loop of 1 + floor((n - a) / (3 + g % 8)) words. Rows without an id stay."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    own = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h")).withColumn("_g", F.expr("_h div 10"))
    kept = own.where("_h IS NULL OR _h % 10 <> 0 OR text IS NULL").select("doc_id", "text")
    tail = own.where("_h % 10 = 0 AND text IS NOT NULL").withColumn("_w", words).withColumn("_n", F.size("_w").cast("long"))
    tail = tail.withColumn("_a", F.expr("if(_n = 0, 0L, _g % _n)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    text = F.expr("array_join(concat(slice(_w, 1, int(_a)), slice(flatten(array_repeat(slice(_w, int(_a) + 1, int(_p)), int(1 + (_n - _a) div _p))), 1, int(_n - _a))), ' ')")
    return kept.unionByName(tail.select("doc_id", text.alias("text")))
