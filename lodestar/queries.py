"""Catalogue of queries over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import columns as C
from .operators import cluster, distance, splits, stats, summary
from .plans import breed, goals, label
from .roles import RoleFrame
from .sources import tables
from .sources.many import Many
from .storage import keep
from .streaming import folds

R = C.rounded
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return SQL | oracles.SQL


def view(s: SparkSession, d: str, name: str) -> RoleFrame:
    return tables.role_view(s, d, name)


# --------------------------------------------------------------------------- SQL pieces

PART = "part AS (SELECT p_partkey AS rid, p_brand, p_type, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM main.part)"
LOG = "1/(1+exp(-1.7*greatest(-3.0,least(3.0,({v}-{m})/({s}+1e-32)))))"
PS = "s AS (SELECT avg(size) ms, stddev_samp(size) ss, min(size) ls, max(size) hs, avg(price) mp, stddev_samp(price) sp, min(price) lp, max(price) hp FROM part)"
D2H = f"sqrt((power(1-{LOG.format(v='size', m='ms', s='ss')},2)+power({LOG.format(v='price', m='mp', s='sp')},2))/2)"
DIST = f"WITH {PART}, {PS}, d AS (SELECT rid, {D2H} AS d FROM part, s)"


def disty_part(s: SparkSession, d: str) -> DataFrame:
    rf = view(s, d, "part")
    return rf.df.select("rid", distance.disty(rf).alias("d"))


@query("q01_disty_part", f"{DIST} SELECT rid, round(d+1e-9,6) AS d FROM d")
def q01(s, d):
    return disty_part(s, d).select("rid", R(F.col("d")).alias("d"))


@query("q02_best_worst", f"{DIST} SELECT * FROM (SELECT 'best' AS which, rid, round(d+1e-9,6) AS d FROM d ORDER BY round(d,9), rid LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst' AS which, rid, round(d+1e-9,6) AS d FROM d ORDER BY round(d,9) DESC, rid LIMIT 5)")
def q02(s, d):
    rows = disty_part(s, d).withColumn("o", F.round("d", 9))
    pick = lambda w, o: rows.orderBy(o, "rid").limit(5).select(F.lit(w).alias("which"), "rid", R(F.col("d")).alias("d"))
    return pick("best", F.asc("o")).unionByName(pick("worst", F.desc("o")))


LINE = ["L_quantity", "L_tax", "L_extendedprice-", "L_discount+"]
LINE_SQL = {"L_quantity": "l_quantity", "L_tax": "l_tax", "L_extendedprice-": "l_extendedprice", "L_discount+": "l_discount"}


@query("q03_col_summary", " UNION ALL ".join(f"SELECT '{k}' AS col, count({v}) AS n, round(avg({v})+1e-9,4) AS mu, round(stddev_samp({v})+1e-9,4) AS sd FROM lineitem" for k, v in LINE_SQL.items()))
def q03(s, d):
    return summary.numbers(view(s, d, "line").df, LINE).select("col", "n", R(F.col("mu"), 4).alias("mu"), R(F.col("sd"), 4).alias("sd"))


ORDER = "ord AS (SELECT o_orderkey AS rid, c_acctbal AS bal, c_mktsegment, o_orderpriority, CAST(n_regionkey AS VARCHAR) AS n_regionkey, o_totalprice AS price, o_orderstatus FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)"
SYMS = ["c_mktsegment", "o_orderpriority", "n_regionkey"]
COUNTS = "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM ord GROUP BY {c}" for c in SYMS) + ")"


@query("q04_sym_mode_entropy", f"WITH {ORDER}, {COUNTS}, t AS (SELECT col, sum(n) AS t FROM c GROUP BY col), m AS (SELECT col, value AS mode FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) r FROM c) WHERE r=1) SELECT m.col, mode, round(-sum(n/t*log2(n/t))+1e-9,6) AS entropy FROM c JOIN t USING(col) JOIN m USING(col) GROUP BY m.col, mode")
def q04(s, d):
    return summary.centers(summary.symbols(view(s, d, "order").df, SYMS)).select("col", "mode", R(F.col("entropy")).alias("entropy"))


@query("q05_centroid", f"WITH {ORDER}, {COUNTS}, m AS (SELECT col, value FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) r FROM c) WHERE r=1) SELECT round(avg(bal)+1e-9,4) AS bal, round(avg(price)+1e-9,3) AS price, (SELECT value FROM m WHERE col='c_mktsegment') AS segment, (SELECT value FROM m WHERE col='o_orderpriority') AS priority FROM ord")
def q05(s, d):
    return summary.centroid(view(s, d, "order")).select(R(F.col("C_acctbal"), 4).alias("bal"), R(F.col("`O_totalprice+`"), 3).alias("price"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))


@query("q06_degenerate", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_size")) + "), c AS (SELECT col, v, count(*) n FROM t GROUP BY col, v), a AS (SELECT col, sum(n) AS rows_, sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) AS known, count(v) AS kinds, max(CASE WHEN v IS NOT NULL THEN n END) AS top FROM c GROUP BY col) SELECT col, CASE WHEN rows_-known > 0.5*rows_ THEN 'missing' WHEN kinds > 0.9*known THEN 'id' WHEN top > 0.95*known THEN 'const' ELSE 'ok' END AS verdict FROM a")
def q06(s, d):
    return summary.degenerate(s.read.parquet(f"{d}/part.parquet"), ["p_partkey", "p_name", "p_brand", "p_size"])


@query("q07_minmax_disty", f"WITH {PART}, {PS} SELECT rid, round(sqrt((power(1-(size-ls)/(hs-ls+1e-32),2)+power((price-lp)/(hp-lp+1e-32),2))/2)+1e-9,6) AS d FROM part, s")
def q07(s, d):
    rf = view(s, d, "part")
    return rf.df.select("rid", R(distance.disty(rf, how="minmax")).alias("d"))


@query("q09_equal_freq_bins", "WITH c AS (SELECT l_quantity v, count(*) n FROM lineitem GROUP BY 1), u AS (SELECT v, sum(n) OVER (ORDER BY v) u, sum(n) OVER () t FROM c), k AS (SELECT min(CASE WHEN u > t//4 THEN v END) a, min(CASE WHEN u > t//2 THEN v END) b, min(CASE WHEN u > 3*t//4 THEN v END) c FROM u) SELECT 1+CAST(l_quantity>a AS INT)+CAST(l_quantity>b AS INT)+CAST(l_quantity>c AS INT) AS bin, count(*) AS n FROM lineitem, k GROUP BY 1")
def q09(s, d):
    df = view(s, d, "line").df
    five = tables.five_numbers(df, "L_quantity").first()
    return df.groupBy(C.cut_code(F.col("L_quantity"), [five["q1"], five["q2"], five["q3"]]).alias("bin")).agg(F.count("*").alias("n"))


@query("q10_norm_bins", "WITH s AS (SELECT avg(l_quantity) m, stddev_samp(l_quantity) d FROM lineitem) SELECT CAST(1+floor(6*(" + LOG.format(v="l_quantity", m="m", s="d") + ")) AS BIGINT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1")
def q10(s, d):
    rf = view(s, d, "line")
    return rf.df.groupBy(C.norm_bin(distance.norms(rf, ["L_quantity"])["L_quantity"], 7).cast("long").alias("bin")).agg(F.count("*").alias("n"))


VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e, CAST(label AS VARCHAR) label FROM embeddings), p AS (SELECT a.vec_id probe, b.vec_id rid, list_distance(a.e,b.e) d, b.label FROM v a JOIN v b ON a.vec_id<>b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d, rid) rank FROM p)"


@query("q12_knn_vec", f"WITH {VEC} SELECT probe, CAST(rank AS INT) AS rank, rid, round(d+1e-9,6) AS d FROM k WHERE rank<=3")
def q12(s, d):
    rows = view(s, d, "vec").df
    return distance.near(rows, rows, 3).select("probe", "rank", "rid", R(F.col("d")).alias("d"))


@query("q13_knn_classify", f"WITH {VEC}, c AS (SELECT probe, label, count(*) n FROM k WHERE rank<=5 GROUP BY 1,2) SELECT probe, label AS got FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY n DESC, label) r FROM c) WHERE r=1")
def q13(s, d):
    rows = view(s, d, "vec").df
    votes = distance.near(rows, rows, 5).join(rows.select("rid", F.col("`label!`").alias("label")), "rid")
    votes = votes.groupBy("probe", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("probe").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("got"))


@query("q14_anomaly", f"WITH {VEC}, g AS (SELECT probe AS rid, d AS gap FROM k WHERE rank=1), s AS (SELECT avg(gap) m, stddev_samp(gap) sd FROM g) SELECT rid, round(gap+1e-9,6) AS gap, round({LOG.format(v='gap', m='m', s='sd')}+1e-9,5) AS score FROM g, s")
def q14(s, d):
    return distance.anomaly(view(s, d, "vec").df).select("rid", R(F.col("gap")).alias("gap"), R(F.col("score"), 5).alias("score"))


@query("q16_project")
def q16(s, d):
    rf = view(s, d, "order")
    return distance.project(rf, *cluster.poles(rf)).select("rid", R(F.col("at")).alias("at"))


@query("q17_halve")
def q17(s, d):
    return cluster.halve(view(s, d, "order")).groupBy("near").agg(F.count("*").alias("n"))


def split_sql(col: str, y: str, table: str, leaf: int) -> str:
    sd = lambda n, t, q: f"CASE WHEN {n}<2 THEN 0 ELSE sqrt(greatest(0,{q}-{t}*{t}/{n})/({n}-1)) END"
    return f"SELECT '{col}' AS at_, x, n1, n-n1 AS n2, (n1*({sd('n1', 't1', 'q1')})+(n-n1)*({sd('(n-n1)', '(t-t1)', '(q-q1)')}))/n AS cost FROM (SELECT x, sum(n) OVER w n1, sum(t) OVER w t1, sum(q) OVER w q1, sum(n) OVER () n, sum(t) OVER () t, sum(q) OVER () q FROM (SELECT {col} x, count(*) n, sum({y}) t, sum({y}*{y}) q FROM {table} GROUP BY 1) WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)) WHERE n1>={leaf} AND n-n1>={leaf}"


@query("q19_splits_num", "SELECT at_, x, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(cost+1e-9,3) AS cost FROM (" + split_sql("l_quantity", "l_discount*1000", "lineitem", 3) + ")")
def q19(s, d):
    rf = view(s, d, "line")
    c = splits.candidates(splits.long_rows(rf.df, rf, F.col("`L_discount+`") * 1000, []), [])
    return c.where("at = 'L_quantity'").select(F.lit("l_quantity").alias("at_"), "x", "n1", "n2", R(F.col("cost"), 3).alias("cost"))


SYM_SPLIT = "SELECT 'o_orderpriority' AS at_, s, n1, n-n1 AS n2, (n1*CASE WHEN n1<2 THEN 0 ELSE sqrt(greatest(0,q1-t1*t1/n1)/(n1-1)) END+(n-n1)*CASE WHEN n-n1<2 THEN 0 ELSE sqrt(greatest(0,(q-q1)-(t-t1)*(t-t1)/(n-n1))/(n-n1-1)) END)/n AS cost FROM (SELECT s, n1, t1, q1, sum(n1) OVER () n, sum(t1) OVER () t, sum(q1) OVER () q FROM (SELECT o_orderpriority s, count(*) n1, sum(price/1000) t1, sum(price/1000*(price/1000)) q1 FROM ord GROUP BY 1))"


@query("q20_splits_sym", f"WITH {ORDER} SELECT at_, s, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(cost+1e-9,4) AS cost FROM ({SYM_SPLIT})")
def q20(s, d):
    rf = view(s, d, "order")
    c = splits.candidates(splits.long_rows(rf.df, rf, F.col("`O_totalprice+`") / 1000, []), [])
    return c.where("at = 'o_orderpriority'").select(F.lit("o_orderpriority").alias("at_"), "s", "n1", "n2", R(F.col("cost"), 4).alias("cost"))


def order_tree(s: SparkSession, d: str) -> tuple[RoleFrame, splits.Tree]:
    rf = view(s, d, "order")
    return rf, splits.grow(rf, distance.disty(rf), depth=3)


@query("q21_best_split")
def q21(s, d):
    rf = view(s, d, "order")
    got = splits.best(splits.candidates(splits.long_rows(rf.df, rf, distance.disty(rf), []), []), [])
    return got.withColumn("cost", R(F.col("cost")))


@query("q22_tree")
def q22(s, d):
    _, t = order_tree(s, d)
    return s.createDataFrame([(i, n, round(float(m) + 1e-9, 6), i in t.cuts) for i, (n, m) in sorted(t.stats.items())], "node long, n long, mid double, inner boolean")


@query("q23_tree_predict")
def q23(s, d):
    rf, t = order_tree(s, d)
    return rf.df.select("rid", t.leaf_column().alias("leaf"), R(t.mid_column()).alias("guess"))


@query("q26_rule")
def q26(s, d):
    rf = view(s, d, "order")
    return s.createDataFrame([(i, a, o, str(v), k) for i, (a, o, v, k) in enumerate(splits.grow_rule(rf, distance.disty(rf)))], "i int, at string, op string, v string, keep boolean")


@query("q28_frugal_tree")
def q28(s, d):
    rf = view(s, d, "order")
    err, exits = splits.frugal(rf, distance.disty(rf), depth=3)
    return s.createDataFrame([(i, a, v, round(m + 1e-9, 6), round(err + 1e-9, 6)) for i, (a, v, m) in enumerate(exits)], "level int, at string, bin string, mid double, err double")


@query("q29_prunings")
def q29(s, d):
    rf, t = order_tree(s, d)
    sums = {i: (m * n, n) for i, (n, m) in t.stats.items()}
    full, spine = splits.race(t, sums), splits.race(t, sums, "spine")
    return s.createDataFrame([("all", splits.prunings(t), full[1], round(float(full[0]) + 1e-9, 6)), ("spine", splits.prunings(t, "spine"), spine[1], round(float(spine[0]) + 1e-9, 6))], "shapes string, prunings long, leaves long, score double")


@query("q30_wins", f"{DIST}, c AS (SELECT round(d,9) v, count(*) n FROM d GROUP BY 1), u AS (SELECT v, sum(n) OVER (ORDER BY v) u, sum(n) OVER () t FROM c), k AS (SELECT min(v) lo, min(CASE WHEN u > t//2 THEN v END) mid FROM u) SELECT rid, round(greatest(-100,least(100,100*(1-(round(d,9)-lo)/(mid-lo+1e-32))))+1e-9,3) AS win FROM d, k")
def q30(s, d):
    return stats.wins(disty_part(s, d).withColumn("d", F.round("d", 9)), "d").select("rid", R(F.col("win"), 3).alias("win"))


TWO = "c AS (SELECT v, sum(x) a, sum(y) b FROM (SELECT c_acctbal v, 1 x, 0 y FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier) GROUP BY v), u AS (SELECT *, sum(a) OVER w ua, sum(b) OVER w ub, sum(a) OVER () n, sum(b) OVER () m FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"


@query("q31_effects", f"WITH {TWO} SELECT CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, round(abs(sum(a*(ub-b))-sum(a*(m-ub)))/max(n)/max(m)+1e-9,6) AS cliffs, round(max(abs(ua/n-ub/m))+1e-9,6) AS ks FROM u")
def q31(s, d):
    c = stats.samples(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_acctbal").alias("v")), s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_acctbal").alias("v")), F.col("v"))
    return stats.effects(c).select("n", "m", R(F.col("cliffs")).alias("cliffs"), R(F.col("ks")).alias("ks"))


@query("q34_same")
def q34(s, d):
    c = stats.samples(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_acctbal").alias("v")), s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_acctbal").alias("v")), F.col("v"))
    return stats.same(c).select("n", "m", *[R(F.col(x)).alias(x) for x in ("cliffs", "ks", "cohen")], "same")


@query("q36_preq_bayes")
def q36(s, d):
    return cluster.prequential(view(s, d, "event"), ["tX", "rid"]).select("pos", "want", "got", R(F.col("like"), 4).alias("like"))


@query("q37_confusion")
def q37(s, d):
    got = summary.confusion(cluster.prequential(view(s, d, "event"), ["tX", "rid"]), "want", "got")
    return got.select("klass", "tn", "fn", "fp", "tp", *[R(F.col(c)).alias(c) for c in ("acc", "pd", "pf")])


@query("q39_kmeans")
def q39(s, d):
    return cluster.kmeans(view(s, d, "order"), k=5, iters=2).groupBy("cluster").agg(F.count("*").alias("n"), R(F.avg("d")).alias("d"))


@query("q40_kpp_seeds")
def q40(s, d):
    return s.createDataFrame([(i, int(r["rid"])) for i, r in enumerate(cluster.seeds(view(s, d, "order"), 4))], "i int, rid long")


@query("q41_pole_grid")
def q41(s, d):
    return cluster.pole_grid(view(s, d, "order")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("q42_reservoir", "SELECT user_id, event_id, seen FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) seen, row_number() OVER (PARTITION BY user_id ORDER BY md5('1:'||event_id), event_id) r FROM events) WHERE r<=3")
def q42(s, d):
    return cluster.reservoir(s.read.parquet(f"{d}/events.parquet"), "user_id", "event_id", 3).select("user_id", "event_id", "seen")


@query("q44_hash_split", "SELECT substr(md5('1:'||o_orderkey),1,1)<'8' AS train, count(*) AS n, round(sum(o_totalprice)+1e-9,2) AS total FROM orders GROUP BY 1")
def q44(s, d):
    return cluster.halves(s.read.parquet(f"{d}/orders.parquet"), "o_orderkey").groupBy("train").agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("q45_sample", "SELECT o_orderkey FROM orders ORDER BY md5('7:'||o_orderkey), o_orderkey LIMIT 100")
def q45(s, d):
    return cluster.some(s.read.parquet(f"{d}/orders.parquet"), "o_orderkey", 100, 7).select("o_orderkey")


@query("q46_pareto", "SELECT p_partkey AS rid FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size>=a.p_size AND b.p_retailprice<=a.p_retailprice AND (b.p_size>a.p_size OR b.p_retailprice<a.p_retailprice))")
def q46(s, d):
    return distance.pareto(view(s, d, "part"))


@query("q47_sym_counts", f"WITH {ORDER}, {COUNTS} SELECT col, value, n FROM c")
def q47(s, d):
    return summary.symbols(view(s, d, "order").df, SYMS)


U = "(CAST(('0x'||substr(md5('{s}:'||{k}),1,8)) AS BIGINT)/4294967296.0)"


@query("q51_mutate", f"SELECT p_partkey AS rid, CASE WHEN {U.format(s='m', k='p_partkey')}<0.5 THEN round(p_size+10*{U.format(s='d', k='p_partkey')}+1e-9,6) ELSE CAST(p_size AS DOUBLE) END AS size FROM part")
def q51(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    return p.select(k.alias("rid"), F.when(C.uniform(k, "m") < 0.5, R(F.col("p_size") + 10 * C.uniform(k, "d"))).otherwise(F.col("p_size").cast("double")).alias("size"))


def part_keys(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("rid"))


@query("q52_dtlz2", f"WITH x AS (SELECT i AS rid, {', '.join(U.format(s=f'1.{j}', k='i') + f' x{j}' for j in range(1, 7))} FROM (SELECT p_partkey AS i FROM part)), g AS (SELECT *, {'+'.join(f'power(x{j}-0.5,2)' for j in range(2, 7))} g FROM x) SELECT rid, round((1+g)*cos(x1*pi()/2)+1e-9,6) AS f1, round((1+g)*sin(x1*pi()/2)+1e-9,6) AS f2 FROM g")
def q52(s, d):
    p = tables.pool(s, part_keys(s, d), 6)
    f = C.dtlz2([F.col(f"X{i}") for i in range(1, 7)], 2)
    return p.select("rid", R(f[0]).alias("f1"), R(f[1]).alias("f2"))


@query("q52_dtlz_all")
def q52b(s, d):
    p, x = tables.pool(s, part_keys(s, d), 6), [F.col(f"X{i}") for i in range(1, 7)]
    made = [R(v).alias(f"f{n}_{i}") for n in range(1, 8) for i, v in enumerate(getattr(C, f"dtlz{n}")(x, 2))]
    return p.select("rid", *made)


@query("q53_cocomo", "SELECT p_partkey AS rid, round(2.94*power(p_size,0.91+0.01*(3.72+2.0))*1.1*0.9+1e-9,5) AS effort, round((1.0*power(2,p_size%3))/3.73+1e-9,6) AS risk FROM part")
def q53(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("rid"), R(C.effort(F.col("p_size"), [F.lit(1.1), F.lit(0.9)], [F.lit(3.72), F.lit(2.0)]), 5).alias("effort"), R(C.risk([(1.0, F.col("p_size") % 3), (2.0, F.lit(-1))])).alias("risk"))


def whole(s: SparkSession, d: str, *names: str) -> DataFrame:
    """Views as one table of tables, all rows coded and scored: (file, rid, a, x, y)."""
    return keep(Many.of({n: view(s, d, n) for n in names}).scored().drop("inputs"), "scored")


@query("q54_holdout")
def q54(s, d):
    runs = [label.Run(i, "part", m, 30) for i, m in enumerate(("active", "random"))]
    got = label.holdout(whole(s, d, "part"), runs)
    return got.select(F.when(F.col("run") == 0, "active").otherwise("random").alias("mode"), R(F.col("win"), 3).alias("win"), "spent", "checked")


@query("q56_sweep")
def q56(s, d):
    arms = [(f, m, b) for f in ("order", "part") for m, b in (("active", 20), ("active", 50), ("random", 50))]
    runs = label.study(whole(s, d, "order", "part"), [(f"{m}{b}", f, m, b) for f, m, b in arms], 5)
    return runs.groupBy("file", "mode", "budget").agg(R(F.avg("win"), 3).alias("win"), F.max("spent").alias("spent"))


@query("q49_optimizers")
def q49(s, d):
    rf = view(s, d, "order")
    sur = breed.Surrogate(rf, rf.df.select("rid", distance.disty(rf).alias("y")))
    got = breed.race(sur, ["de", "ga", "sa", "ls"], chains=1, size=8, gens=2, steps=16)
    return got.groupBy("optimizer").agg(R(F.min("best")).alias("best"))


def goal_model() -> dict[str, list]:
    """Buy or build: two ways to ship, which help and hurt two qualities."""
    m = goals.Model()
    shipped, bought, coded, tested, vendor, staff, tools, fast, cheap = m.atoms("shipped bought coded tested vendor staff tools fast cheap")
    link = goals.link
    shipped <= tested * (bought + coded)  # noqa: B015
    bought <= vendor * link("help", fast) * link("break", cheap)  # noqa: B015
    coded <= staff * tools * link("hurt", fast) * link("help", cheap)  # noqa: B015
    return m.rules


#: Every world of the model: the way, and a draw from the bag of each of its links.
WORLDS = "WITH way(w, help, other, kind, leaves) AS (VALUES ('bought', 'fast', 'cheap', 'f', 2), ('coded', 'cheap', 'fast', 'fft', 3)), draw AS (SELECT w, leaves, substr('ttf', h, 1) AS helped, substr(kind, CAST(o AS INT), 1) AS hit FROM way, range(1, 4) a(h), range(1, 4) b(o) WHERE o<=length(kind)), ws AS (SELECT DISTINCT w AS way, CASE w WHEN 'bought' THEN helped ELSE hit END AS fast, CASE w WHEN 'bought' THEN hit ELSE helped END AS cheap, leaves FROM draw)"


def customers(s: SparkSession, d: str) -> DataFrame:
    """A world for each customer, numbered by the key."""
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"))


def rig(s: SparkSession) -> goals.Rig:
    return goals.Rig(s, goal_model(), ["shipped"], ["fast", "cheap"])


@query("q57_goal_worlds", f"{WORLDS} SELECT way, fast, cheap FROM ws")
def q57(s, d):
    ws = rig(s).worlds(customers(s, d))
    val = lambda a: F.max(F.when(F.col("atom") == a, F.col("val")))
    rows = ws.groupBy("world").agg(val("bought").alias("b"), val("coded").alias("c"), val("fast").alias("fast"), val("cheap").alias("cheap"))
    return rows.select(F.when(F.col("b") == "t", "bought").when(F.col("c") == "t", "coded").alias("way"), "fast", "cheap").distinct()


@query("q58_goal_benefits", f"{WORLDS}, bf AS (SELECT CAST(fast='t' AS INT)+CAST(cheap='t' AS INT) AS benefit, leaves AS footprint FROM ws), mm AS (SELECT min(benefit) b0, max(benefit) b1, min(footprint) f0, max(footprint) f1 FROM bf) SELECT DISTINCT CAST(benefit AS BIGINT) AS benefit, CAST(footprint AS BIGINT) AS footprint, round(sqrt((power(1-(benefit-b0)/(b1-b0),2)+power((footprint-f0)/(f1-f0),2))/2)+1e-9,6) AS d FROM bf, mm")
def q58(s, d):
    r = rig(s)
    ws = r.worlds(customers(s, d))
    return r.counts(ws).select("benefit", "footprint", R(goals.d2h(r.yardstick(ws))).alias("d")).distinct()


@query("q59_goal_keys")
def q59(s, d):
    return s.createDataFrame(rig(s).run(customers(s, d))["keys"], "atom string, val string")


EDGES = "e(h, r, a) AS (VALUES ('shipped','all','tested'),('shipped','any','bought'),('shipped','any','coded'),('bought','all','vendor'),('bought','link','fast'),('bought','link','cheap'),('coded','all','staff'),('coded','all','tools'),('coded','link','fast'),('coded','link','cheap')), m AS (SELECT h AS a FROM e UNION SELECT a FROM e), q AS (SELECT a FROM e WHERE r='link' EXCEPT SELECT h FROM e)"


@query("q59_goal_statics", f"WITH {EDGES} SELECT 'qualities' AS role, a AS atom FROM q UNION ALL SELECT 'leaves', a FROM (SELECT a FROM m EXCEPT SELECT h FROM e EXCEPT SELECT a FROM q) UNION ALL SELECT 'settable', a FROM ((SELECT a FROM m EXCEPT SELECT h FROM e) UNION SELECT a FROM e WHERE r='any')")
def q59s(s, d):
    found = goals.roles(s, goal_model(), ["shipped", "fast", "cheap"])
    kinds = F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("quality", "qualities"), ("leaf", "leaves"), ("settable", "settable"))])
    return found.select(F.explode(F.array_compact(kinds)).alias("role"), "atom")


@query("q59_goal_rig")
def q59r(s, d):
    got = rig(s).run(customers(s, d))
    names = ["mu", "sd", "best", "mu_keys", "sd_keys", "candidates", "n_keys", "tests", "share"]
    return s.createDataFrame([tuple(float(got[n]) for n in names)], ", ".join(f"{n} double" for n in names))


@query("q60_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value)+1e-9,4) AS total FROM events GROUP BY 1")
def q60(s, d):
    return folds.windows(s.read.parquet(f"{d}/events.parquet"), "ts", "value").select("start", "n", R(F.col("total"), 4).alias("total"))


@query("q61_moments", "SELECT event_type, count(value) AS n, round(avg(value)+1e-9,5) AS mu, round(coalesce(stddev_samp(value),0)+1e-9,5) AS sd FROM events GROUP BY 1")
def q61(s, d):
    return folds.summary(s.read.parquet(f"{d}/events.parquet"), "event_type", "value").select("event_type", "n", R(F.col("mu"), 5).alias("mu"), R(F.col("sd"), 5).alias("sd"))


# --------------------------------------------------------------------------- order values, mixed distances, halving


@query("q08_pctl_disty", f"WITH {PART}, o AS (SELECT *, row_number() OVER (ORDER BY size)-1 rs, row_number() OVER (ORDER BY price)-1 rp, count(*) OVER () n FROM part), b AS (SELECT max(size) FILTER (rs=CAST(floor(0.15*n) AS BIGINT)) ls, max(size) FILTER (rs=CAST(floor(0.85*n) AS BIGINT)) hs, max(price) FILTER (rp=CAST(floor(0.15*n) AS BIGINT)) lp, max(price) FILTER (rp=CAST(floor(0.85*n) AS BIGINT)) hp FROM o) SELECT rid, round(sqrt((power(1-greatest(0,least(1,(size-ls)/(hs-ls+1e-32))),2)+power(greatest(0,least(1,(price-lp)/(hp-lp+1e-32))),2))/2)+1e-9,6) AS d FROM part, b")
def q08(s, d):
    rf = view(s, d, "part")
    return rf.df.select("rid", R(distance.disty(rf, how="pctl")).alias("d"))


DOC = "t AS (SELECT doc_id AS rid, CAST(n_chars AS DOUBLE) n, lang, source, quality FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT avg(n) m, stddev_samp(n) sd FROM t), k AS (SELECT rid, " + LOG.format(v="n", m="m", s="sd") + " v, lang, source, quality FROM t, s), p AS (SELECT * FROM k ORDER BY rid LIMIT 1)"


def mixed(s: SparkSession, d: str) -> RoleFrame:
    """Documents with the quality label as an input that is often unknown."""
    return RoleFrame(view(s, d, "doc").df.withColumnRenamed("quality!", "quality"), "rid")


@query("q15_distx_mixed_missing", f"WITH {DOC} SELECT k.rid, round(sqrt((power(k.v-p.v,2)+CASE WHEN k.lang=p.lang THEN 0 ELSE 1 END+CASE WHEN k.source=p.source THEN 0 ELSE 1 END+CASE WHEN k.quality=p.quality THEN 0 ELSE 1 END)/4)+1e-9,6) AS d FROM k, p")
def q15(s, d):
    rf = mixed(s, d)
    return distance.around(rf, distance.coded(rf).orderBy("rid").first()).select("rid", R(F.col("d")).alias("d"))


@query("q18_nodes")
def q18(s, d):
    return cluster.nodes(view(s, d, "order"), 3).groupBy("node").agg(F.count("*").alias("n"))


@query("q13_knn_guess", f"WITH {VEC} SELECT probe, round(avg(CAST(label AS DOUBLE))+1e-9,6) AS guess FROM k WHERE rank<=5 GROUP BY probe")
def q13b(s, d):
    rows = view(s, d, "vec").df.withColumn("y", F.col("`label!`").cast("double"))
    return distance.guess(rows, rows, "y").select("probe", R(F.col("guess")).alias("guess"))


@query("q65_delegates")
def q65(s, d):
    return cluster.delegates(mixed(s, d), 0.8).groupBy("kin").agg(F.count("*").alias("n"), R(F.max("d")).alias("far"))


@query("q66_pair_mean")
def q66(s, d):
    return s.createDataFrame([(round(float(distance.pair_mean(mixed(s, d))) + 1e-9, 6),)], "eps double")


# --------------------------------------------------------------------------- rules, bins, curves


ENT = "CASE WHEN {t}>0 THEN -({t}/{n})*log2({t}/{n}) ELSE 0 END+CASE WHEN {n}-{t}>0 THEN -(({n}-{t})/{n})*log2(({n}-{t})/{n}) ELSE 0 END"


@query("q24_split_entropy", f"WITH {ORDER}, c AS (SELECT o_orderpriority s, count(*)::DOUBLE n1, count(*) FILTER (o_orderstatus='F')::DOUBLE t1 FROM ord GROUP BY 1), w AS (SELECT *, sum(n1) OVER () n, sum(t1) OVER () t FROM c) SELECT s, CAST(n1 AS BIGINT) AS n1, round((n1*({ENT.format(n='n1', t='t1')})+(n-n1)*({ENT.format(n='(n-n1)', t='(t-t1)')}))/n+1e-9,6) AS cost, t1/n1>=(t-t1)/(n-n1) AS keep FROM w WHERE n1>=3 AND n-n1>=3")
def q24(s, d):
    rf = view(s, d, "order")
    c = splits.tag_candidates(rf.df, rf, F.col("`o_orderstatus!`") == "F")
    return c.where("at = 'o_orderpriority'").select("s", "n1", R(F.col("cost")).alias("cost"), "keep")


@query("q25_rule_step")
def q25(s, d):
    rf = view(s, d, "order")
    df = rf.df.withColumn("_tag", F.when(F.col("`o_orderstatus!`") == "F", "best").otherwise("rest"))
    return splits.rule_step(df, rf, "_tag").select("at", "op", "x", "s", "keep", "n1", R(F.col("cost")).alias("cost"))


@query("q26_rule_matches")
def q26b(s, d):
    rf = view(s, d, "order")
    return rf.df.groupBy(splits.matched(splits.grow_rule(rf, distance.disty(rf))).alias("met")).agg(F.count("*").alias("n"))


@query("q27_merged_bins", f"WITH {PART}, {PS}, b AS (SELECT CAST(floor(7*({LOG.format(v='size', m='ms', s='ss')})) AS BIGINT) bin, price FROM part, s), g AS (SELECT bin, count(*) k, sum(price) t FROM b GROUP BY 1) SELECT bin, CAST(n AS BIGINT) AS n, round(t/n+1e-9,4) AS mid FROM (SELECT bin, sum(k) OVER (ORDER BY bin) n, sum(t) OVER (ORDER BY bin) t, lead(bin) OVER (ORDER BY bin) nx FROM g) WHERE nx IS NOT NULL")
def q27(s, d):
    rf = view(s, d, "part")
    code = F.floor(7 * distance.norms(rf, ["P_size+"])["P_size+"]).cast("long")
    return splits.merged_bins(rf.df, code, F.col("`P_retailprice-`")).select("bin", "n", R(F.col("mid"), 4).alias("mid"))


THETAS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query("q64_roc", f"WITH {ORDER}, l AS (SELECT o_orderstatus='F' y, avg(CASE WHEN o_orderstatus='F' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY o_orderpriority, c_mktsegment) q FROM ord), h AS (SELECT unnest({THETAS}::DOUBLE[]) theta) SELECT theta, round(count(*) FILTER (y AND q>=theta)/greatest(1,count(*) FILTER (y))+1e-9,6) AS pd, round(count(*) FILTER (NOT y AND q>=theta)/greatest(1,count(*) FILTER (NOT y))+1e-9,6) AS pf FROM l, h GROUP BY 1")
def q64(s, d):
    hit = F.col("`o_orderstatus!`") == "F"
    own = view(s, d, "order").df
    leaf = own.groupBy("o_orderpriority", "c_mktsegment").agg(F.avg(hit.cast("double")).alias("share"))
    rows = own.join(leaf, ["o_orderpriority", "c_mktsegment"]).select("share", hit.alias("y"))
    return splits.roc(rows, F.col("share"), F.col("y"), THETAS).select("theta", R(F.col("pd")).alias("pd"), R(F.col("pf")).alias("pf"))


# --------------------------------------------------------------------------- statistics


@query("q33_cohen", "WITH a AS (SELECT count(c_acctbal) n, avg(c_acctbal) m, var_samp(c_acctbal) v FROM customer), b AS (SELECT count(s_acctbal) n, avg(s_acctbal) m, var_samp(s_acctbal) v FROM supplier) SELECT round(abs(a.m-b.m)/(sqrt(((a.n-1)*a.v+(b.n-1)*b.v)/(a.n+b.n-2))+1e-32)+1e-9,6) AS cohen FROM a, b")
def q33(s, d):
    t = lambda n, c: s.read.parquet(f"{d}/{n}.parquet").select(F.col(c).alias("v"))
    return stats.effects(stats.samples(t("customer", "c_acctbal"), t("supplier", "s_acctbal"), F.col("v"))).select(R(F.col("cohen")).alias("cohen"))


@query("q35_ranks")
def q35(s, d):
    return s.createDataFrame(sorted(stats.rank_groups(view(s, d, "order").df, "o_orderpriority", "`O_totalprice+`").items()), "priority string, rank int")


@query("q38_accuracy")
def q38(s, d):
    return cluster.prequential(view(s, d, "event"), ["tX", "rid"]).agg(R(F.avg((F.col("want") == F.col("got")).cast("double"))).alias("acc"))


@query("q43_live_columns")
def q43(s, d):
    rf = view(s, d, "event")
    kept = cluster.reservoir(rf.df.select("rid", "u", "Hour", F.col("`Value-`").alias("Value")), "u", "rid", 64)
    return cluster.live_columns(kept, "u", ["Hour", "Value"], 0.05).select("at", R(F.col("gap")).alias("gap"))


@query("q47_zitzler", f"WITH {PART}, {PS}, k AS (SELECT rid, {LOG.format(v='size', m='ms', s='ss')} x, {LOG.format(v='price', m='mp', s='sp')} y FROM part, s), o AS (SELECT * FROM k ORDER BY rid LIMIT 1) SELECT k.rid, (-exp((k.x-o.x)/2)-exp(-(k.y-o.y)/2))/2 < (-exp((o.x-k.x)/2)-exp(-(o.y-k.y)/2))/2 AS better FROM k, o")
def q47z(s, d):
    rf = view(s, d, "part")
    n = distance.norms(rf, list(rf.schema.goals))
    rows = rf.df.select("rid", *[n[c].alias(f"g{i}") for i, c in enumerate(rf.schema.goals)])
    one = rows.orderBy("rid").first()
    better = distance.zitzler([F.col("g0"), F.col("g1")], [F.lit(one["g0"]), F.lit(one["g1"])], list(rf.schema.goals.values()))
    return rows.select("rid", better.alias("better"))


@query("q48_best_so_far", "SELECT event_id, round(value+1e-9,6) AS value FROM (SELECT event_id, value, min(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM events WHERE value IS NOT NULL) WHERE m IS NULL OR value<m")
def q48(s, d):
    ev = s.read.parquet(f"{d}/events.parquet").select("ts", "event_id", "value")
    return stats.improvements(ev, ["ts", "event_id"], "value").select("event_id", R(F.col("value")).alias("value"))


@query("q62_five_numbers", "WITH o AS (SELECT value v, row_number() OVER (ORDER BY value)-1 r, count(*) OVER () n FROM events WHERE value IS NOT NULL) SELECT round(min(v)+1e-9,6) AS lo, round(max(v) FILTER (r=n//4)+1e-9,6) AS q1, round(max(v) FILTER (r=n//2)+1e-9,6) AS q2, round(max(v) FILTER (r=3*n//4)+1e-9,6) AS q3, round(max(v)+1e-9,6) AS hi FROM o")
def q62(s, d):
    five = tables.five_numbers(s.read.parquet(f"{d}/events.parquet"), "value")
    return five.select(*[R(F.col(c)).alias(c) for c in five.columns])


@query("q63_histogram", "SELECT CAST(floor((value-0)/10) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def q63(s, d):
    return tables.histogram(s.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL"), F.col("value"), 0, 10)


@query("q67_tally", "SELECT count(*) FILTER (c_acctbal>0) AS wins, count(*) FILTER (c_acctbal<0) AS losses, count(*) FILTER (c_acctbal=0) AS ties FROM customer")
def q67(s, d):
    return tables.tally(s.read.parquet(f"{d}/customer.parquet"), F.col("c_acctbal"))


@query("q68_spread_cells", "WITH s AS (SELECT stddev_samp(l_quantity) a, stddev_samp(l_discount) b FROM lineitem) SELECT CAST(floor(l_quantity/(0.35*a+1e-32)) AS BIGINT) AS ca, CAST(floor(l_discount/(0.35*b+1e-32)) AS BIGINT) AS cb, count(*) AS n, round(max(l_tax)-min(l_tax)+1e-9,6) AS spread FROM lineitem, s GROUP BY 1, 2")
def q68(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax")
    return stats.spread_cells(li, "l_quantity", "l_discount", "l_tax").select("ca", "cb", "n", R(F.col("spread")).alias("spread"))


@query("q69_unfairness", f"WITH {ORDER}, g AS (SELECT c_mktsegment g, count(*) n, avg(CASE WHEN o_orderstatus='F' THEN CASE WHEN price>150000 THEN 1.0 ELSE 0 END END) pd, avg(CASE WHEN o_orderstatus<>'F' THEN CASE WHEN price>150000 THEN 1.0 ELSE 0 END END) pf FROM ord GROUP BY 1), f AS (SELECT pd p, pf q FROM g ORDER BY n DESC, g LIMIT 1) SELECT round(max(greatest(abs(pd-p),abs(pf-q)))+1e-9,6) AS gap FROM g, f")
def q69(s, d):
    df = view(s, d, "order").df.withColumn("got", F.when(F.col("`O_totalprice+`") > 150000, "F").otherwise("O"))
    return summary.unfairness(df.withColumnRenamed("o_orderstatus!", "want"), "want", "got", "c_mktsegment", "F").select(R(F.col("gap")).alias("gap"))


# --------------------------------------------------------------------------- synthesis, acquisition, worlds


PAIR = "k AS (SELECT p_partkey rid, CAST(p_size AS DOUBLE) x, p_retailprice y, p_brand z FROM main.part)"


def shifted(s: SparkSession, d: str, by: int) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select((F.col("p_partkey") - by).alias("rid"), F.col("p_size").cast("double").alias(f"x{by}"), F.col("p_retailprice").alias(f"y{by}"), F.col("p_brand").alias(f"z{by}"))


@query("q49_crossover", f"WITH {PAIR}, c AS (SELECT a.*, b.y y1, b.z z1, floor(3*{U.format(s='c', k='a.rid')}) cut FROM k a JOIN k b ON b.rid=a.rid+1) SELECT rid, x, round(CASE WHEN 1>cut THEN y1 ELSE y END+1e-9,4) AS y, CASE WHEN 2>cut THEN z1 ELSE z END AS z FROM c")
def q49x(s, d):
    both = shifted(s, d, 0).join(shifted(s, d, 1), "rid")
    x, y, z = C.crossover([F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}1") for c in "xyz"], F.floor(3 * C.uniform(F.col("rid"), "c")))
    return both.select("rid", x.alias("x"), R(y, 4).alias("y"), z.alias("z"))


@query("q50_de_blend", f"WITH {PAIR}, s AS (SELECT avg(y)-4*stddev_samp(y) lo, avg(y)+4*stddev_samp(y)+1e-32 hi FROM k), v AS (SELECT a.rid, a.y+0.5*(b.y-c.y) v FROM k a JOIN k b ON b.rid=a.rid+1 JOIN k c ON c.rid=a.rid+2) SELECT rid, round(lo+(v-lo)-floor((v-lo)/(hi-lo))*(hi-lo)+1e-9,4) AS y FROM v, s")
def q50(s, d):
    st = view(s, d, "part").stats()["P_retailprice-"]
    rows = shifted(s, d, 0).join(shifted(s, d, 1), "rid").join(shifted(s, d, 2), "rid")
    return rows.select("rid", R(C.extrapolated(F.col("y0"), F.col("y1"), F.col("y2"), st["mu"], st["sd"]), 4).alias("y"))


@query("q51_draws", f"WITH o AS (SELECT p_partkey rid, row_number() OVER (ORDER BY p_partkey) r, count(*) OVER () n FROM part), t AS (SELECT i draw, CAST(1+floor({U.format(s='d', k='i')}*(SELECT max(n) FROM o)) AS BIGINT) r FROM range(50) t(i)) SELECT draw, rid FROM t JOIN o USING (r)")
def q51d(s, d):
    return cluster.draws(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("rid")), "rid", 50, "d").select("draw", "rid")


@query("q55_acquire")
def q55(s, d):
    runs = [label.Run(0, "order", "active", 30), label.Run(1, "order", "bayes", 16), label.Run(2, "order", "centroid", 16)]
    got = label.acquire(whole(s, d, "order"), runs, start=10)
    mode = F.when(F.col("run") == 0, "active").when(F.col("run") == 1, "bayes").otherwise("centroid")
    return got.select(mode.alias("mode"), "rid", R(F.col("y")).alias("d"), "turn")


def hashed_sql(seed: str, turn: str, key: str = "rid") -> str:
    return f"('0x'||substr(md5('{seed}.{turn}:'||{key}),1,8))::BIGINT/4294967296.0"


@query("q55_random_labels", f"{DIST}, o AS (SELECT rid, d, row_number() OVER (ORDER BY {hashed_sql('7', '0')}, rid) r FROM d WHERE d IS NOT NULL) SELECT rid, round(d+1e-9,6) AS y FROM o WHERE r<=40")
def q55r(s, d):
    return label.acquire(whole(s, d, "part"), [label.Run(0, "part", "random", 40, 7)]).select("rid", R(F.col("y")).alias("y"))


#: Both views as files of different headers: the statistics of all numbers.
FILES = {"part": (("P_size+", "p_size"), ("P_retailprice-", "p_retailprice")), "line": (("L_quantity", "l_quantity"), ("L_tax", "l_tax"), ("L_extendedprice-", "l_extendedprice"), ("L_discount+", "l_discount"))}


@query("q114_many_stats", " UNION ALL ".join(f"SELECT '{f}' AS file, '{n}' AS name, count({c}) AS n, round(avg({c})+1e-9,4) AS mu, round(stddev_samp({c})+1e-9,4) AS sd, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM main.{'part' if f == 'part' else 'lineitem'}" for f, cols in FILES.items() for n, c in cols))
def q114(s, d):
    got = Many.of({n: view(s, d, n) for n in ("part", "line")}).stats()
    return got.select("file", "name", "n", R(F.col("mu"), 4).alias("mu"), R(F.col("sd"), 4).alias("sd"), "lo", "hi")


@query("q115_many_disty", f"{DIST}, l AS (SELECT l_orderkey*8+l_linenumber AS rid, l_extendedprice p, l_discount c FROM lineitem), ls AS (SELECT avg(p) mp, stddev_samp(p) sp, avg(c) mc, stddev_samp(c) sc FROM l) SELECT 'part' AS file, rid, round(d+1e-9,6) AS y FROM d UNION ALL SELECT 'line', rid, round(sqrt((power({LOG.format(v='p', m='mp', s='sp')},2)+power(1-{LOG.format(v='c', m='mc', s='sc')},2))/2)+1e-9,6) FROM l, ls")
def q115(s, d):
    return Many.of({n: view(s, d, n) for n in ("part", "line")}).scored().select("file", "rid", R(F.col("y")).alias("y"))


@query("q116_many_splits", oracles.MANY)
def q116(s, d):
    many = Many.of({n: view(s, d, n) for n in ("order", "line")})
    return many.splits().select("file", "at", "op", "x", "s", "n1", "n2", R(F.col("cost")).alias("cost"))


@query("q70_binned")
def q70(s, d):
    return tables.binned(view(s, d, "line")).groupBy("L_quantity").agg(F.count("*").alias("n"))

from . import more  # noqa: E402,F401  (registers its queries)
