"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the base entities: e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers, found
by expressions in each whole text. Identifier-like tokens (with a digit or an @) are instances. An instance's lexical
patterns are the word before it, the word after it, and both, over any white space, each narrowed by the sort of token
(address, number, word with digits). Where a pattern with the sort has too few seeds, the word before, or both words,
count with any sort; the word after alone never does, and needs twice the seeds.

Instances and patterns form a bipartite graph that is scored over the rounds of FLOORS. A pattern's confidence is the
weighted mean score of its distinct instances; instances that many patterns share weigh less (rarity: 1 / log2(1 + number of
patterns)), and those that nothing is known about weigh UNKNOWN of a known one. Patterns with SUPPORT distinct seeds
or discovered instances or more whose confidence passes the round's floor hand it to their instances; the floor falls from
round to round, so what the surest patterns find supports the next ones, which may know no seed themselves. Seeds hold score 1; tokens that have the form of a base entity but fail its
check hold 0. Tokens at a pattern that passes the last floor are discovered identifiers, of the kind that most of the
pattern's seeds have. They add spans; base spans always stay.

Sums are pre-aggregated per (pattern, instance) and per pattern, so a frequent word before tokens gathers counts, not rows.
Words and tokens of any length and blanks of any number between them count whole (long tokens by their digest).

Cases: a null or empty text has no spans; null or repeated ids keep their rows (spans follow the row's id and text);
equal spans are listed once; an empty table gives no rows; extra columns are ignored. Spans count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, save

#: Distinct seeds that a pattern needs, the confidence it needs in each round, weight of instances not yet known.
SUPPORT, FLOORS, UNKNOWN = 5, (0.95, 0.9, 0.85), 0.25
#: Matches that are put in place together; a longer list goes block by block.
BLOCK = 256
KINDS = ("email", "ip", "card", "phone")

# Each finds what the stated pattern finds, written so that no text makes it slow or deep: runs are taken whole, and a
# match begins where its run begins or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_X = r"[^\s,;!?()\[\]{}<>\"'|]"
#: A run with a digit or an @, without the signs that end a phrase.
TOKEN = rf"(?<!{_X}){_X}*[0-9@](?:{_X}*[^\s,;!?()\[\]{{}}<>\"'|.:])?"
SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches, by the lengths of matches and of what lies between.

    Places are sums within blocks, and of blocks, so that a list of very many matches is not copied for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.split(text, pattern, -1), F.char_length)
    pairs = F.zip_with(found, F.slice(sizes, 1, F.size(found)), lambda v, gap: F.struct(v.alias("value"), gap.alias("gap")))
    number = F.transform(pairs, lambda x, i: F.struct(x["value"].alias("value"), x["gap"].alias("gap"), (i / BLOCK).cast("int").alias("block")))

    def placed(block: Column, begin: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + F.char_length(x["value"])
            return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])

    def whole(all_pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_pairs, b * BLOCK + 1, F.lit(BLOCK)))
        total = lambda block: F.aggregate(block, F.lit(0), lambda t, x: t + x["gap"] + F.char_length(x["value"]))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<block:array<struct<value:string,gap:int,block:int>>,begin:int>>").alias("out"))
        step = lambda s, block: F.struct((s["at"] + total(block)).alias("at"), F.array_append(s["out"], F.struct(block.alias("block"), s["at"].alias("begin"))).alias("out"))
        return F.flatten(F.transform(F.aggregate(blocks, first, step, lambda s: s["out"]), lambda x: placed(x["block"], x["begin"])))

    # the outer transform over a one-element list binds the pairs to a name: they are made once
    bound = F.get(F.transform(F.array(number), lambda p: F.when(F.size(p) > BLOCK, whole(p)).otherwise(placed(p, F.lit(0)))), F.lit(0))
    return F.when(F.size(found) > 0, bound).otherwise(F.array().cast(SPAN))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    n = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.try_to_number(F.concat(F.lit("0"), F.right(p, F.lit(9))), F.lit("9999999999")).between(0, 255) & ((F.char_length(p) <= 9) | F.regexp_like(p, F.lit(r"^0*[0-9]{1,3}$"))))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def judged(n: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), valid(kind, s["value"]).alias("good"), s["value"].alias("value"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash of the text, spans (start, kind number, end), tokens that may be identifiers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    for n, kind in enumerate(KINDS):
        found = F.when(F.regexp_like("text", F.lit(NEEDS[kind])), located(F.col("text"), PATTERNS[kind])).otherwise(F.array().cast(SPAN))
        out = out.withColumn(kind, F.transform(found, judged(n, kind)))
    every = F.concat(*KINDS)
    out = out.withColumn("all", F.array_sort(every)).drop(*KINDS)
    out = out.withColumn("spans", F.transform(F.filter("all", lambda s: s["good"]), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    tokens = F.when(F.regexp_like("text", F.lit("[0-9@]")), located(F.col("text"), TOKEN)).otherwise(F.array().cast(SPAN))
    meets = lambda t: F.exists("all", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    nothing = F.lit(None).cast("int")
    loose = F.transform(F.filter(tokens, lambda t: ~meets(t)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), nothing.alias("kind"), F.lit(False).alias("bad"), t["value"].alias("value")))
    known = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["good"], s["kind"]).alias("kind"), (~s["good"]).alias("bad"), s["value"].alias("value")))
    instances = F.transform(F.concat(known, loose), lambda t: F.struct(t["start"], t["end"], t["kind"], t["bad"], identity(t["value"]).alias("value"), sort_of(t["value"]).alias("sort"), before(t["start"]).alias("left"), after(t["end"]).alias("right")))
    return out.select("id", F.xxhash64("text").alias("hash"), "spans", instances.alias("instances"))


def identity(value: Column) -> Column:
    return F.when(F.char_length(value) <= 64, value).otherwise(F.concat(F.left(value, F.lit(32)), F.lit(" "), F.md5(value.cast("binary"))))


def before(start: Column) -> Column:
    """The word that ends at or before a place of `text`: in a near window if it surely begins there, else in a wider one."""
    text, last = F.col("text"), r"(?<!\S)(\S++)\s*+\z"
    out = F.regexp_extract(F.substring(text, F.lit(1), start), last, 1)
    for n in (1000, 48):
        part = F.substring(text, F.greatest(start - (n - 1), F.lit(1)), F.least(start, F.lit(n)))
        out = F.when((start <= n) | F.regexp_like(part, F.lit(r"\s\S++\s*+\z")), F.regexp_extract(part, last, 1)).otherwise(out)
    return F.lower(out)


def after(end: Column) -> Column:
    """The word that begins at or after a place of `text`."""
    text, first = F.col("text"), r"^\s*+(\S++)"
    out = F.regexp_extract(F.substring(text, end + 1, F.char_length(text)), first, 1)
    for n in (1000, 48):
        part = F.substring(text, end + 1, F.lit(n))
        out = F.when((F.char_length(part) < n) | F.regexp_like(part, F.lit(r"^\s*+\S++\s")), F.regexp_extract(part, first, 1)).otherwise(out)
    return F.lower(out)


def sort_of(token: Column) -> Column:
    """What an instance looks like: an address, a number with its punctuation, or a word with digits."""
    return F.when(F.contains(token, F.lit("@")), "@").when(F.regexp_like(token, F.lit(r"\p{L}")), "a").otherwise("9")


def patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of an instance: (what, words). Words without a letter are no pattern."""
    cue = lambda w: F.regexp_like(w, F.lit(r"\p{L}"))
    made = lambda what, words, good: F.when(good, F.struct(F.lit(what).alias("what"), identity(words).alias("words")))
    return F.array_compact(F.array(made("before", left, cue(left)), made("after", right, cue(right)), made("both", F.concat_ws(" ", left, right), cue(left) & cue(right))))


def strong(graph: DataFrame, floor: float) -> DataFrame:
    """what, words, sort, confidence, as (kind) of the patterns that pass: those with the sort, else those with any sort."""
    counts = [F.sum(((F.col("score") > 0) & (F.col("kind") == n)).cast("long")).alias(k) for n, k in enumerate(KINDS)]
    weight = F.col("rare") * F.when(F.col("fixed") | (F.col("score") > 0), 1.0).otherwise(UNKNOWN)
    own = graph.groupBy("what", "words", "sort").agg(F.sum(F.col("score") * weight).alias("sum"), F.sum(weight).alias("n"), *counts)
    every = own.where("what <> 'after'").groupBy("what", "words").agg(*[F.sum(c).alias(f"all_{c}") for c in ("sum", "n", *KINDS)])

    def state(names: list[str], total: str, n: str, need: Column) -> tuple[Column, Column]:
        seeds = F.array(*[F.coalesce(F.col(x), F.lit(0)) for x in names])
        kind = (F.array_position(seeds, F.array_max(seeds)) - 1).cast("int")
        return F.aggregate(seeds, F.lit(0).cast("long"), lambda a, x: a + x) >= need, F.struct((F.col(total) / F.col(n)).alias("confidence"), kind.alias("as"))

    held, value = state([f"all_{k}" for k in KINDS], "all_sum", "all_n", F.lit(SUPPORT))
    every = every.where(held).select("what", "words", value.alias("any"))
    held, value = state(list(KINDS), "sum", "n", F.when(F.col("what") == "after", 2 * SUPPORT).otherwise(SUPPORT))
    both = own.select("what", "words", "sort", F.when(held, value).alias("own")).join(every, ["what", "words"], "left")
    got = F.coalesce("own", "any")
    return both.select("what", "words", "sort", got["confidence"].alias("confidence"), got["as"].alias("as")).where(F.col("confidence") >= floor)


def discover(found: DataFrame) -> DataFrame:
    """(id, hash, start, kind, end) of tokens that high-confidence patterns make known."""
    rows = found.where(F.size("instances") > 0).select("id", "hash", F.explode("instances").alias("t")).select("id", "hash", "t.*")
    rows = rows.select("*", F.explode(patterns(F.col("left"), F.col("right"))).alias("p")).select("id", "hash", "start", "end", "kind", "bad", "value", "sort", "p.*")
    rows = save(rows, "instances")
    # the graph: one row for each pattern and distinct instance
    graph = rows.groupBy("what", "words", "sort", "value").agg(F.max(F.col("kind").isNotNull()).alias("seed"), F.max("bad").alias("bad"), F.min("kind").alias("kind"))
    fixed = F.when(F.col("seed"), 1.0).when(F.col("bad"), 0.0)
    graph = save(graph.withColumn("score", F.coalesce(fixed, F.lit(0.0))).withColumn("fixed", fixed.isNotNull()), "graph")
    rare = graph.groupBy("value").agg((1 / F.log2(1 + F.count("*"))).alias("rare"))
    last, graph = graph, save(graph.join(rare, "value"), "graph")
    forget(last)
    for floor in FLOORS[:-1]:
        best = graph.where("not fixed").join(strong(graph, floor), ["what", "words", "sort"]).groupBy("value").agg(F.max(F.struct("confidence", (-F.col("as")).alias("as"))).alias("best"))
        last, graph = graph, graph.join(best, "value", "left")
        better = ~F.col("fixed") & (F.col("best.confidence") > F.col("score"))
        kind, score = F.when(better, -F.col("best.as")).otherwise(F.col("kind")), F.when(better, F.col("best.confidence")).otherwise(F.col("score"))
        graph = save(graph.withColumns({"kind": kind, "score": score}).drop("best"), "graph")
        forget(last)
    new = rows.where(F.col("kind").isNull() & ~F.col("bad")).join(strong(graph, FLOORS[-1]), ["what", "words", "sort"])
    new = new.groupBy("id", "hash", "start", "end").agg(F.max(F.struct("confidence", (-F.col("as")).alias("as"))).alias("m"))
    return new.select("id", "hash", "start", (-F.col("m.as")).alias("kind"), "end")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, number of base spans of each kind, base_sha256, spans of every document."""
    found = base(docs, id_col, text_col)
    found = save(found, "entities")
    more = discover(found).groupBy("id", "hash").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    all_spans = F.array_sort(F.array_union("spans", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    more = more.select(F.col("id").alias("i"), F.col("hash").alias("h"), "more")
    plain = found.select("id", "hash", "spans").join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    return plain.select(F.col("id").alias(id_col), *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(spans_text(F.col("spans")).cast("binary"), 256).alias("base_sha256"), spans_text(all_spans).alias("spans"))
