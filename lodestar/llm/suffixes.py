"""Repeated passages by a sparse suffix array.

A passage is a run of WORDS words or more that occurs in two places or more, in one document or several. Of the suffixes
of all texts only those are retained that begin at content-selected minimiser positions: the place of the smallest
GRAM-word hash of each window of WORDS words. Equal windows select the same place, so every repeated passage holds a
retained suffix in each of its occurrences.

1. Sort: retained suffixes are ranged over the tasks and sorted by their first GRAM words, their surroundings (all words
   that a window around the place can reach), and their place. Ranges split groups of equal suffixes, however large.
2. Compare neighbours: a suffix whose beginning neither neighbour has goes. Neighbours with equal surroundings are of one
   class, all of whose windows repeat; the first suffix of a class stands for it. The last and first rows of neighbouring
   ranges (two a range) are compared on the driver.
3. Extend: where a beginning has several classes, the words around the first suffixes are fetched. These are sorted by the
   words to the right, where the longest match with any other is the one with a neighbour; and by the words to the left,
   likewise. A window can repeat only if it lies within both reaches. Such windows are cut out of the matched words and
   grouped, which decides exactly and finds each one's first occurrence; together they are the extended matches.

The join on windows gives those with many rows a broadcast (common.join_one); classes join one row to one. Words, beginnings and windows are
told apart by 64-bit hashes.

The first occurrence of a window is the one with the smallest (id, place); it is kept, all later ones are repeats.

Cases: null or short texts have no passages; a null id counts as -1; rows with equal id and text are one document; ties
go by id and place; a very long text is worked on whole; an empty table gives no rows; extra columns are ignored (in
`cut` they are kept, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, clear_name, grams, join_one, mix, pieces, plain_schema, powers, save, texts_of, wider

WORDS, GRAM = 50, 16
REACH = WORDS - GRAM  # how far a window can begin before its minimiser


class Places:
    """Retained suffixes of a batch: word number `at`, first GRAM words, surroundings, and the windows whose minimiser
    it is (bit b: the window that begins b words before)."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = w = Words(texts, lower=False)
        n = len(w.hash)
        self.at = np.empty(0, np.int64)
        self.mask = np.empty(0, np.int64)
        if n >= WORDS:
            gram = grams(w.hash, GRAM)
            low = np.arange(len(gram))  # place of the smallest of the next `width` grams, leftmost first
            width = 1
            while width < REACH + 1:
                step = min(width, REACH + 1 - width)
                a, b = low[:-step], low[step:]
                low = np.where(gram[b] < gram[a], b, a)
                width += step
            begin = np.flatnonzero(w.text[: n - WORDS + 1] == w.text[WORDS - 1 :])
            place = low[begin]
            if len(begin):
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                self.at = place[first]
                self.mask = np.add.reduceat(np.left_shift(1, place - begin), first)
                self.gram = gram[self.at]
            power, self.inverse = powers(n + 1)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * power[:n], dtype=np.uint64)])
        self.text = w.text[self.at] if n else np.empty(0, np.int64)
        self.number = self.at - w.first[self.text] if len(self.at) else self.at

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a to b (exclusive)."""
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])

    def around(self) -> np.ndarray:
        a = np.maximum(self.at - REACH, self.words.first[self.text])
        b = np.minimum(self.at + WORDS, self.words.first[self.text + 1])
        return mix(self.run(a, b) + mix(((self.at - a) * 128 + b - self.at).astype(np.uint64)))


def identity(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("_text")]


def _retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "_text"):
        p = Places(texts_of(b, "_text"))
        if len(p.at):
            doc, key = (b.column(i).to_numpy()[p.text] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc, key, p.number.astype(np.int32), p.gram.view(np.int64), p.around().view(np.int64), p.mask)], names=["doc", "key", "at", "gram", "around", "mask"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> those with a neighbour of the same beginning, and the ends of the range. prev and next tell
    whether that neighbour is of the same class; null at the ends."""
    held, last = None, None  # the row that waits for its next one, and (gram, around) of the row before it

    def answer(rows: pa.Table, last: tuple | None, end: bool) -> pa.RecordBatch:
        gram, around = rows.column("gram").to_numpy(), rows.column("around").to_numpy()
        same, like = gram[1:] == gram[:-1], (gram[1:] == gram[:-1]) & (around[1:] == around[:-1])
        n = len(gram) - (not end)
        prev = np.concatenate([[last == (gram[0], around[0])], like])[:n]
        near = np.concatenate([[last is None or last[0] == gram[0]], same])[:n]
        after = np.concatenate([like, [False]])[:n]
        near |= np.concatenate([same, [True]])[:n]
        first, final = np.zeros(n, bool), np.zeros(n, bool)
        first[:1], final[-1:] = last is None, end
        near |= first | final
        made = [pa.array(prev, mask=first), pa.array(after, mask=final)]
        out = rows.slice(0, n).append_column("prev", made[0]).append_column("next", made[1]).filter(pa.array(near))
        return out.combine_chunks().to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b] if held is None else [held, b])
        if rows.num_rows > 1:
            yield from answer(rows, last, False)
            last = tuple(rows.column(c)[rows.num_rows - 2].as_py() for c in ("gram", "around"))
        held = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0]
    if held is not None:
        yield from answer(pa.Table.from_batches([held]), last, True)


def in_order(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Rows sorted by `by` over ranges, with the number of the range, and what their neighbours are like."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), *names)
    return ranged.mapInArrow(_neighbours, wider(ranged.schema, "prev boolean, next boolean"))


def joined_ends(rows: DataFrame) -> DataFrame:
    """prev and next at the ends of the ranges, from the ends of the neighbouring ranges: two rows a range."""
    ends = rows.where("prev IS NULL OR next IS NULL").select("part", "prev", "next", "gram", "around").collect()
    first = {r["part"]: (r["gram"], r["around"]) for r in ends if r["prev"] is None}
    final = {r["part"]: (r["gram"], r["around"]) for r in ends if r["next"] is None}
    order = sorted(first)
    pairs = [(p, q) for p, q in zip(order[:-1], order[1:], strict=True) if final[p] == first[q]]
    among = lambda parts: F.col("part").isin(parts) if parts else F.lit(False)
    return rows.withColumns({"prev": F.coalesce("prev", among([q for _, q in pairs])), "next": F.coalesce("next", among([p for p, _ in pairs]))})


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around the wanted places of each text, as hashes: WORDS to the right, REACH to the left, nearest first."""
    for b in pieces(batches, "_text"):
        p = Places(texts_of(b, "_text"))
        wanted = b.column(2)
        text = np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
        if not len(text):
            continue
        place = np.searchsorted(p.at, p.words.first[text] + wanted.flatten().to_numpy())
        at = p.at[place]
        words = np.concatenate([p.words.hash, np.zeros(1, np.uint64)])  # no word: zero
        right, left = at[:, None] + np.arange(WORDS), at[:, None] - 1 - np.arange(REACH)
        right = np.where(right < p.words.first[text + 1][:, None], right, -1)
        left = np.where(left >= p.words.first[text][:, None], left, -1)
        doc, key = (b.column(i).to_numpy()[text] for i in (0, 1))
        fixed = lambda x: pa.array([v.tobytes() for v in words[x]], pa.binary())
        made = [pa.array(v) for v in (doc, key, p.number[place].astype(np.int32), p.gram.view(np.int64)[place], p.around().view(np.int64)[place], p.mask[place])]
        yield pa.RecordBatch.from_arrays([*made, fixed(right), fixed(left)], names=["doc", "key", "at", "gram", "around", "mask", "right", "left"])


def _matched(side: str, most: int, out: str):
    """Sorted rows -> the same with the longest match, in words, that a side has with its neighbour of the same beginning
    (at the ends of a range: as long as can be)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, most

        def lengths(rows: pa.Table) -> np.ndarray:
            words = np.frombuffer(b"".join(rows.column(side).to_pylist()), np.uint64).reshape(rows.num_rows, most)
            gram = rows.column("gram").to_numpy()
            same = words[1:] == words[:-1]
            return np.where(gram[1:] == gram[:-1], np.where(same.all(1), most, same.argmin(1)), 0)

        def answer(rows: pa.Table, reach: np.ndarray) -> list[pa.RecordBatch]:
            return rows.append_column(out, pa.array(reach.astype(np.int32))).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b] if held is None else [held, b])
            near = np.concatenate([[before], lengths(rows)])
            yield from answer(rows.slice(0, rows.num_rows - 1), np.maximum(near[:-1], near[1:]))
            held, before = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0], int(near[-1])
        if held is not None:
            yield from answer(pa.Table.from_batches([held]), np.array([most]))

    return run


def extended(own: DataFrame, leads: DataFrame) -> DataFrame:
    """(gram, around, doc, key, at, mask, all, lead): first suffixes of classes with the windows that other classes have too,
    and those of them that are the first occurrence. Bit b is the window that begins b words before the place."""
    several = in_order(leads, ["gram", "around"], ["gram", "around", "doc", "key", "at"])
    stand = several.groupBy("doc", "key").agg(F.sort_array(F.collect_set("at")).alias("places"))
    texts = own.join(stand, ["doc", "key"]).select("doc", "key", "places", "_text")  # one row of each document; its text moves once
    found = texts.mapInArrow(_around, plain_schema("doc long, key long, at int, gram long, around long, mask long, right binary, left binary"))
    found = save(found, "around")
    for side, most, out, by in (("right", WORDS, "r", ["right", "left"]), ("left", REACH, "l", ["gram", "left", "right"])):
        ranged = found.repartitionByRange(*by).sortWithinPartitions(*by)
        found = save(ranged.mapInArrow(_matched(side, most, out), wider(ranged.schema, f"{out} int")), "matched")
    back = F.filter(F.sequence(F.lit(0), F.lit(REACH)), lambda b: (F.getbit("mask", b) == 1) & (b <= F.col("l")) & (WORDS - b <= F.col("r")))
    windows = found.select("gram", "around", "doc", "key", "at", "mask", "left", "right", F.explode(back).alias("back"))
    cut = F.xxhash64(F.substring("left", F.lit(1), 8 * F.col("back")), F.substring("right", F.lit(1), 8 * (WORDS - F.col("back"))))
    windows = save(windows.select("gram", "around", "back", cut.alias("window"), "doc", "key", "mask", (F.col("at") - F.col("back")).alias("begin")), "windows")
    here = F.struct("doc", "key", "begin")
    shared = windows.groupBy("window").agg(F.min("around").alias("lo"), F.max("around").alias("hi"), F.min(here).alias("lead")).where("lo <> hi").select("window", "lead")
    bit, none = F.expr("shiftleft(1L, back)"), F.lit(0).cast("long")
    own = [F.first(c).alias(c) for c in ("doc", "key", "mask")]
    return join_one(windows, shared, ["window"]).groupBy("gram", "around").agg(*own, F.first(F.col("begin") + F.col("back")).alias("at"), F.bit_or(bit).alias("all"), F.bit_or(F.when(here == F.col("lead"), bit).otherwise(none)).alias("lead"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, at, all, first): retained places with the windows that repeat, and those of them that are first."""
    own = docs.select(*identity(id_col, text_col)).where(F.length("_text") >= 2 * WORDS - 1)
    kept = save(own.mapInArrow(_retained, plain_schema("doc long, key long, at int, gram long, around long, mask long")), "suffixes")
    by = ["gram", "around", "doc", "key", "at"]
    hits = joined_ends(save(in_order(kept, by, [*by, "mask"]), "neighbours"))
    found = save(extended(own, hits.where("NOT prev").select(*by)), "extended")
    none = F.lit(0).cast("long")
    # a suffix that is alone in its class has only what its extension found
    alone = found.select("doc", "key", "at", "all", F.col("lead").alias("first"))
    # a class of several suffixes repeats as a whole; its first suffix leads where no other class has the window before,
    # so it alone asks what the extension found: one row a class on either side
    others = found.select("gram", "around", "all", "lead")
    leads = hits.where("NOT prev AND next").join(others, ["gram", "around"], "left")
    first = F.col("mask").bitwiseAND(F.expr("~coalesce(all, 0L)")).bitwiseOR(F.coalesce("lead", none))
    leads = leads.select("doc", "key", "at", F.col("mask").alias("all"), first.alias("first"))
    later = hits.where("prev").select("doc", "key", "at", F.col("mask").alias("all"), none.alias("first"))
    # the first suffixes of classes of several are in `alone` too: bits meet when a document's places are gathered
    return later.unionByName(leads).unionByName(alone)


def spans_of(places: np.ndarray, every: np.ndarray, first: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, again) word runs of one document: again where a repeat covers a word and no first window does."""
    back = np.arange(REACH + 1)
    n = int(places.max()) + WORDS + 1
    cover = np.zeros((2, n + 1), np.int64)
    for i, mask in enumerate((every, first)):
        row, col = np.nonzero(mask[:, None] >> back & 1)
        begin = np.unique(places[row] - back[col])
        np.add.at(cover[i], begin, 1)
        np.add.at(cover[i], begin + WORDS, -1)
    state = (np.cumsum(cover[0]) > 0).astype(int) + (np.cumsum(cover[1]) > 0)  # 0 free, 1 again, 2 first
    edge = np.flatnonzero(np.diff(state, prepend=0, append=0))
    return [(int(a), int(b), bool(state[a] == 1)) for a, b in zip(edge[:-1], edge[1:], strict=True) if state[a]]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, spans): an array of (start, end, again) word runs for each document with repeated passages."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, as the rows are small
    per = repeated(docs, id_col, text_col).repartition(tasks, "doc", "key").groupBy("doc", "key").agg(F.collect_set(F.struct("at", "all", "first")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(2).to_pylist():
                cols = [np.array([x[k] for x in p], np.int64) for k in ("at", "all", "first")]
                out.append([{"start": s, "end": e, "again": g} for s, e, g in spans_of(*cols)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("again", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["doc", "key", "spans"])

    return per.mapInArrow(run, plain_schema("doc long, key long, spans array<struct<start:int,end:int,again:boolean>>"))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words, again: every run of words that repeats (again: an earlier one has it)."""
    got = spans(docs).select(F.col("doc").alias("doc_id"), F.explode("spans").alias("s"))
    return got.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), (F.col("s.end") - F.col("s.start")).alias("n_words"), F.col("s.again").alias("again"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns; of each repeated passage only the first occurrence stays in the texts."""
    d, k, c = (clear_name(docs, n) for n in ("_doc", "_key", "_cuts"))
    found = spans(docs, id_col, text_col).where(F.exists("spans", lambda s: s["again"]))
    cuts = found.select(F.col("doc").alias(d), F.col("key").alias(k), F.transform(F.filter("spans", lambda s: s["again"]), lambda s: F.array(s["start"], s["end"])).alias(c))

    @F.pandas_udf("string")
    def without(texts, parts):  # noqa: ANN001, ANN202
        out = []
        for text, own in zip(texts, parts, strict=True):
            data = text.encode()
            w = Words([data], lower=False)
            at, kept = 0, []
            for a, b in own:
                kept.append(data[at : w.start[a]])
                at = w.start[b] if b < len(w.start) else len(data)
            out.append(b"".join([*kept, data[at:]]).decode())
        return texts.__class__(out)

    doc, key, _ = identity(id_col, text_col)
    joined = docs.withColumns({d: doc, k: key}).join(cuts, [d, k], "left")
    same = joined.where(F.col(c).isNull()).select(*docs.columns)
    less = joined.where(F.col(c).isNotNull()).withColumn(text_col, without(F.col(text_col), F.col(c))).select(*docs.columns)
    return same.unionByName(less)
