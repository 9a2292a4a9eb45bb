"""The subpackage's queries and their SQL, by the driver's names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, bpe, contamination, negatives, packing, partenum, pii, quality, rabitq, runs, secret_scan, suffixes, urls
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op2(spark: SparkSession, d: str) -> DataFrame:
    return partenum.join(table(spark, d, "documents"))


def op3(spark: SparkSession, d: str) -> DataFrame:
    return rabitq.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


def op4(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), vocabulary())


def op5(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"))


def op6(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(table(spark, d, "documents"), vocabulary())


def op7(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.passages(table(spark, d, "documents"))


def op8(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.scan(table(spark, d, "documents"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages"))


def op10(spark: SparkSession, d: str) -> DataFrame:
    return bitslice.search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


def op11(spark: SparkSession, d: str) -> DataFrame:
    return contamination.judge(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13(spark: SparkSession, d: str) -> DataFrame:
    return runs.report(runs.looped(table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_knn": op1,
        "op2_partenum": op2,
        "op3_one_bit_codes": op3,
        "op4_vector_packing": op4,
        "op5_pii_bootstrap": op5,
        "op6_bpe_rounds": op6,
        "op7_sparse_suffixes": op7,
        "op8_secret_forest": op8,
        "op9_url_trees": op9,
        "op10_bit_sliced": op10,
        "op11_aho_corasick": op11,
        "op12_vantage_negatives": op12,
        "op13_periodic_runs": op13,
    }


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(text=LOWER_SQL)} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), n AS (SELECT doc_id, coalesce(len(sh), 0) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 75 * (a.n + b.n - both_)),
g AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM g UNION SELECT r.x, g.y FROM r JOIN g ON r.y = g.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM n LEFT JOIN m ON x = doc_id
"""

OP7_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, {WORDS_SQL.format(text='text')} AS ws FROM d),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: {{'b': i - 1, 'h': md5(array_to_string(ws[i:i+49], ' '))}})) AS u FROM w WHERE len(ws) >= 50),
c AS (SELECT doc_id, u.b AS b, row_number() OVER (PARTITION BY u.h ORDER BY doc_id, u.b) AS r, count(*) OVER (PARTITION BY u.h) AS n FROM x),
k AS (SELECT doc_id, b + j AS at_, max(CASE WHEN r = 1 THEN 2 ELSE 1 END) AS s FROM c, range(50) t(j) WHERE n > 1 GROUP BY 1, 2),
i AS (SELECT *, at_ - row_number() OVER (PARTITION BY doc_id, s ORDER BY at_) AS run FROM k)
SELECT doc_id, CAST(min(at_) AS INTEGER) AS start_word, CAST(max(at_) + 1 AS INTEGER) AS end_word, CAST(count(*) AS INTEGER) AS n_words, s = 1 AS again
FROM i GROUP BY doc_id, s, run
"""


PLAIN_SQL = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN_SQL} AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) AS w FROM b WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN_SQL} AS ws FROM documents),
l AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {{'i': i, 'w': array_to_string(ws[i:i+n-1], ' ')}})) AS u FROM d, l WHERE len(ws) >= n),
m AS (SELECT r, g.n AS n, u.i AS i, item FROM g JOIN p ON p.n = g.n AND p.w = u.w),
h AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM m, range(10) t(j) WHERE j < n GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

# crc32 of the decimal id, bit by bit; words 16 apart or more that repeat at a distance give stretches with that period
OP13_SQL = f"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text="coalesce(text, '')")} AS ws,
  list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, 8 * len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(CASE WHEN (i - 1) % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[(i + 7) // 8]) ELSE 0 END AS UBIGINT))),
    lambda x, y: CASE WHEN xor(x, y) % 2 = 1 THEN xor(xor(x, y) // 2, CAST(3988292384 AS UBIGINT)) ELSE xor(x, y) // 2 END) AS z FROM documents),
h AS (SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n, CAST(xor(z, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS h FROM c),
a AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
d AS (SELECT r, doc_id, n, CASE WHEN n > 0 AND h % 10 = 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM a),
g AS (SELECT r, unnest(list_transform(range(0, n - 15), lambda i: {{'i': i, 'w': md5(array_to_string(ws[i+1:i+16], ' '))}})) AS u FROM d WHERE n >= 24),
t AS (SELECT r, u.w AS w, array_agg(u.i) AS places FROM g GROUP BY r, u.w HAVING count(*) > 1),
x AS (SELECT r, w, unnest(places) AS i FROM t),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.w = y.w AND x.i < y.i),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS s FROM e),
f AS (SELECT r, min(i) AS s, max(i) + 16 + q - min(i) AS l, q FROM k GROUP BY r, q, k.s),
m AS (SELECT r, s, l, min(q) AS q FROM f WHERE l >= 24 AND l >= 3 * q GROUP BY r, s, l),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) AS best FROM m),
o AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS text, max(CASE WHEN best = 1 THEN s END) AS s, max(CASE WHEN best = 1 THEN l END) AS l, max(CASE WHEN best = 1 THEN q END) AS q FROM b GROUP BY r),
gone AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(s + q, s + l)) AS j FROM m) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(o.text, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: ws[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (r) LEFT JOIN gone USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose rows it can express; the others need trained models, tokenizers or an approximate index."""
    return {"op2_partenum": OP2_SQL, "op7_sparse_suffixes": OP7_SQL, "op10_bit_sliced": OP10_SQL, "op11_aho_corasick": OP11_SQL, "op12_vantage_negatives": OP12_SQL, "op13_periodic_runs": OP13_SQL}
