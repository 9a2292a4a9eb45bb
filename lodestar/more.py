"""More queries: neighbours over mixed rows, codes, summaries, samples, trees by other targets, grids, studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from .functions import columns as C
from .operators import cluster, distance, grids, neighbours, splits, stats, summary
from .plans import breed, label, search
from .queries import DIST, LOG, PART, R, U, disty_part, mixed, order_tree, part_keys, query, view, whole
from .roles import RoleFrame
from .sources import stored, tables
from .storage import keep, new_folder
from .streaming import folds

# --------------------------------------------------------------------------- neighbours of mixed rows

NEAR = f"WITH {O.DOCS}, p AS (SELECT x.rid AS probe, z.rid, round({O.doc_dist('z', 'x')},12) AS d, z.lang, z.quality, z.n FROM dc x JOIN dc z ON x.rid<>z.rid), k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d, rid) rank FROM p)"


@query("q71_near_mixed", f"{NEAR} SELECT probe, CAST(rank AS INTEGER) AS rank, rid, round(d+1e-9,6) AS d FROM k WHERE rank<=3")
def q71(s, d):
    return neighbours.near(mixed(s, d), 3).select("probe", "rank", "rid", R(F.col("d")).alias("d"))


@query("q72_classify_mixed", f"WITH {O.DOCS}, z AS (SELECT doc_id AS rid, CAST(toxic AS VARCHAR) AS klass FROM labels WHERE toxic IS NOT NULL), p AS (SELECT x.rid AS probe, y.rid, round({O.doc_dist('y', 'x')},12) AS d, klass FROM dc x JOIN dc y ON x.rid<>y.rid JOIN z ON z.rid=y.rid), k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d, rid) rank FROM p), v AS (SELECT probe, klass, count(*) n FROM k WHERE rank<=5 GROUP BY 1, 2) SELECT probe, klass AS got FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY n DESC, klass) r FROM v) WHERE r=1")
def q72(s, d):
    toxic = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("rid"), F.col("toxic").cast("string").alias("toxic!"))
    return neighbours.classified(RoleFrame(mixed(s, d).df.join(toxic, "rid", "left"), "rid"))


@query("q73_guess_mixed", f"{NEAR} SELECT probe, round(avg(n)+1e-9,6) AS guess FROM k WHERE rank<=5 GROUP BY probe")
def q73(s, d):
    rf = mixed(s, d)
    return neighbours.guessed(rf, rf.df.select("rid", F.col("N_chars").alias("y"))).select("probe", R(F.col("guess")).alias("guess"))


@query("q74_anomaly_mixed", f"{NEAR}, g AS (SELECT probe AS rid, d AS gap FROM k WHERE rank=1), st AS (SELECT avg(gap) m, stddev_samp(gap) sd FROM g) SELECT rid, round(gap+1e-9,6) AS gap, round({LOG.format(v='gap', m='m', s='sd')}+1e-9,5) AS score FROM g, st")
def q74(s, d):
    return neighbours.anomaly(mixed(s, d)).select("rid", R(F.col("gap")).alias("gap"), R(F.col("score"), 5).alias("score"))


@query("q74_anomaly_within", f"WITH {O.DOCS}, p AS (SELECT x.rid, min(round({O.doc_dist('z', 'x')},12)) AS gap FROM dc x JOIN dc z ON x.rid<>z.rid AND x.lang=z.lang AND x.source=z.source GROUP BY 1) SELECT rid, round(gap+1e-9,6) AS gap FROM p")
def q74w(s, d):
    return neighbours.anomaly(mixed(s, d), ["lang", "source"]).select("rid", R(F.col("gap")).alias("gap"))


@query("q75_snap", f"WITH {O.DOCS}, q AS (SELECT -rid AS rid, 1-v AS v, source AS lang0, lang, source, quality FROM dc), p AS (SELECT x.rid AS probe, z.rid, round({O.doc_dist('z', 'x')},12) AS d, z.n FROM q x, dc z), k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d, rid) r FROM p WHERE probe<>rid) SELECT probe, rid, round(n+1e-9,4) AS y FROM k WHERE r=1")
def q75(s, d):
    rf = mixed(s, d)
    flipped = neighbours.cells(rf).select((-F.col("rid")).alias("rid"), F.struct(F.transform("a.n", lambda v: 1 - v).alias("n"), F.col("a.s").alias("s")).alias("a"))
    got = neighbours.snapped(rf, flipped, rf.df.select("rid", F.col("N_chars").alias("y")))
    return got.select("probe", "rid", R(F.col("y"), 4).alias("y"))


GOWER = "CASE WHEN {p}.{c} IS NULL OR {q}.{c} IS NULL THEN NULL WHEN {p}.{c}={q}.{c} THEN 0.0 ELSE 1.0 END"
GAPS = "[abs(dc.v-o.v), " + ", ".join(GOWER.format(p="dc", q="o", c=c) for c in ("lang", "source", "quality")) + "]"


@query("q76_gower_chebyshev", f"WITH {O.DOCS}, o AS (SELECT * FROM dc ORDER BY rid LIMIT 1), g AS (SELECT dc.rid, list_filter({GAPS}, lambda x: x IS NOT NULL) AS gs FROM dc, o) SELECT rid, round(sqrt(list_sum(list_transform(gs, lambda x: x*x))/len(gs))+1e-9,6) AS gower, round(list_sum(gs)/len(gs)+1e-9,6) AS city, round(list_max(gs)+1e-9,6) AS cheb FROM g")
def q76(s, d):
    rf = mixed(s, d)
    rows = neighbours.cells(rf)
    one = distance.literal(distance.coded(rf).orderBy("rid").first())
    a = F.col("a")
    return rows.select("rid", R(distance.distx(a, one, gower=True)).alias("gower"), R(distance.distx(a, one, 1.0, True)).alias("city"), R(distance.chebyshev_x(a, one)).alias("cheb"))


@query("q77_matrix", f"WITH {O.DOCS}, f AS MATERIALIZED (SELECT * FROM dc ORDER BY md5('1:'||rid), rid LIMIT 40) SELECT x.rid AS i, z.rid AS j, round({O.doc_dist('x', 'z')}+1e-9,6) AS d FROM f x JOIN f z ON x.rid<z.rid")
def q77(s, d):
    rows = cluster.some(neighbours.cells(mixed(s, d)), "rid", 40)
    return neighbours.matrix(rows).select("i", "j", R(F.col("d")).alias("d"))


# --------------------------------------------------------------------------- codes, readers, summaries


@query("q78_ordinal", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS code, CASE o_orderpriority WHEN '5-LOW' THEN 2 ELSE 4 END AS rated FROM orders")
def q78(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    seen = [r[0] for r in o.select("o_orderpriority").distinct().collect()]
    level = F.when(F.col("o_orderpriority") == "5-LOW", "l").otherwise("h")
    return o.select("o_orderkey", C.ordinal(F.col("o_orderpriority"), seen).alias("code"), (F.array_position(F.array(*map(F.lit, C.RATINGS)), level)).cast("int").alias("rated"))


@query("q79_frozen_codes", f"WITH {PART}, w AS (SELECT * FROM part ORDER BY rid LIMIT 100), br AS (SELECT value, dense_rank() OVER (ORDER BY value) c FROM (SELECT DISTINCT p_brand AS value FROM w)) SELECT p_partkey AS rid, CAST(coalesce(c, 0) AS INTEGER) AS brand FROM main.part LEFT JOIN br ON p_brand=value")
def q79(s, d):
    rf = view(s, d, "part")
    codes = tables.frozen_codes(tables.warm_up(rf, 100))
    return rf.df.select("rid", codes["p_brand"].alias("brand"))


@query("q80_kept_columns", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_size")) + "), c AS (SELECT col, v, count(*) n FROM t GROUP BY col, v), a AS (SELECT col, sum(n) AS rows_, sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) AS known, count(v) AS kinds, max(CASE WHEN v IS NOT NULL THEN n END) AS top FROM c GROUP BY col) SELECT col FROM a WHERE rows_-known<=0.5*rows_ AND kinds<=0.9*known AND top<=0.95*known")
def q80(s, d):
    kept = summary.kept_columns(s.read.parquet(f"{d}/part.parquet"), ["p_partkey", "p_name", "p_brand", "p_size"])
    return s.createDataFrame([(c,) for c in kept], "col string")


@query("q81_transpose", "SELECT 'r_name' AS col, " + ", ".join(f"max(CASE WHEN r_regionkey={i} THEN r_name END) AS r{i}" for i in range(5)) + " FROM region UNION ALL SELECT 'r_regionkey', " + ", ".join(f"max(CASE WHEN r_regionkey={i} THEN CAST(r_regionkey AS VARCHAR) END)" for i in range(5)) + " FROM region")
def q81(s, d):
    r = s.read.parquet(f"{d}/region.parquet").withColumn("k", F.concat(F.lit("r"), F.col("r_regionkey").cast("string")))
    return summary.transpose(r, "k", ["r_name", "r_regionkey"])


@query("q82_musd", "SELECT round(avg(c_acctbal)+1e-9,4) AS mu, round(stddev_pop(c_acctbal)+1e-9,4) AS sd FROM customer")
def q82(s, d):
    return summary.musd(s.read.parquet(f"{d}/customer.parquet"), F.col("c_acctbal")).select(R(F.col("mu"), 4).alias("mu"), R(F.col("sd"), 4).alias("sd"))


@query("q83_baseline", f"{DIST} SELECT round(avg(d)+1e-9,6) AS mu, count(d) AS n FROM d")
def q83(s, d):
    return disty_part(s, d).agg(R(F.avg("d")).alias("mu"), F.count("d").alias("n"))


@query("q84_leaf_stats", f"{O.tree(3)}, g AS (SELECT node AS leaf, count(*) AS n, round(avg(price)+1e-9,3) AS price, round(avg(y)+1e-9,6) AS y FROM t3 GROUP BY 1), m AS (SELECT node, k FROM (SELECT node, k, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, k) r FROM t3 GROUP BY node, k) WHERE r=1) SELECT leaf, n, price, y, k AS klass FROM g JOIN m ON node=leaf")
def q84(s, d):
    rf, t = order_tree(s, d)
    rows = rf.df.withColumn("leaf", t.leaf_column())
    got = summary.node_stats(rows, "leaf", {"price": F.col("`O_totalprice+`")}, distance.disty(rf), F.col("`o_orderstatus!`"))
    return got.select("leaf", "n", R(F.col("price"), 3).alias("price"), R(F.col("y")).alias("y"), "klass")


@query("q85_merge_counts", "SELECT 'p_brand' AS col, p_brand AS value, count(*) AS n FROM part WHERE p_size>10 GROUP BY 2")
def q85(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    count = lambda c: summary.symbols(p.where(c), ["p_brand"])
    every = summary.merge(count("p_size <= 30"), count("p_size > 30"))
    return summary.merge(every, count("p_size <= 10"), -1)


@query("q86_forget", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value)+1e-9,4) AS s FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL GROUP BY 1")
def q86(s, d):
    ev = s.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL")
    rows = ev.withColumn("sign", F.lit(1)).unionByName(ev.where("event_id % 3 = 0").withColumn("sign", F.lit(-1)))
    return folds.signed(rows, "event_type", "value", "sign").select("event_type", "n", R(F.col("s"), 4).alias("s"))


@query("q87_parse_lines", "SELECT p_partkey AS \"Key\", p_brand AS brand, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS \"Size-\" FROM part")
def q87(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    body = p.select(F.col("p_partkey").alias("rid"), F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" ,"), F.col("p_brand"), F.lit(", "), F.when(F.col("p_partkey") % 5 == 0, "?").otherwise(F.col("p_size").cast("string")), F.lit(", junk % a remark")).alias("line"))
    head = s.createDataFrame([(-1, "﻿Key, brand ,Size-,noteX"), (0, "   "), (-2, "% nothing but a remark")], "rid long, line string")
    rf = tables.parse_lines(head.unionByName(body), "%", drop_ignored=True)
    return rf.df.select(F.col("Key").cast("long").alias("Key"), "brand", "`Size-`")


@query("q88_mock64", f"WITH x AS (SELECT i AS rid, {U.format(s='1.1', k='i')} AS x1, {U.format(s='1.2', k='i')} AS x2 FROM (SELECT p_partkey AS i FROM part)) SELECT rid, round(x1+1e-9,6) AS x1, CASE WHEN x1+x2<1 THEN 'lo' ELSE 'hi' END AS klass FROM x")
def q88(s, d):
    return tables.mock64(s, part_keys(s, d)).df.select("rid", R(F.col("X1")).alias("x1"), F.col("`class!`").alias("klass"))


@query("q89_between", "SELECT count(*) AS n FROM events WHERE value IS NULL OR value BETWEEN 20 AND 60")
def q89(s, d):
    return s.read.parquet(f"{d}/events.parquet").where(C.between(F.col("value"), 20, 60)).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- orders, samples, sets


@query("q90_slice", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id)-1 r FROM events) WHERE r>=100 AND r<150")
def q90(s, d):
    return stats.sliced(s.read.parquet(f"{d}/events.parquet").select("ts", "event_id"), ["ts", "event_id"], 100, 150).select("event_id")


@query("q91_spaced_cuts", "WITH o AS (SELECT l_tax v, row_number() OVER (ORDER BY l_tax)-1 r, count(*) OVER () n FROM lineitem WHERE l_tax IS NOT NULL), i AS (SELECT unnest(range(1, 8)) i) SELECT DISTINCT v AS cut FROM o, i WHERE r=CAST(floor(i/8.0*n+1e-9) AS BIGINT)")
def q91(s, d):
    cuts = stats.spaced_cuts(s.read.parquet(f"{d}/lineitem.parquet"), "l_tax", 8)
    return s.createDataFrame([(float(c),) for c in cuts], "cut double")


def hall(n: int) -> str:
    return f"(({'+'.join(U.format(s=f'g.{i}', k='p_partkey') for i in range(n))})-{n / 2})/sqrt({n}/12.0)"


GAUSS = f"greatest(-3.0,least(3.0,sqrt(-2*ln(1-{U.format(s='b.u', k='p_partkey')}))*cos(2*pi()*{U.format(s='b.v', k='p_partkey')})))"


@query("q92_normal_draws", f"SELECT p_partkey AS rid, round({hall(12)}+1e-9,6) AS h12, round({hall(3)}+1e-9,6) AS h3, round({GAUSS}+1e-9,6) AS bm FROM part")
def q92(s, d):
    k = F.col("p_partkey")
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("rid"), R(C.irwin_hall(k, "g", 12)).alias("h12"), R(C.irwin_hall(k, "g", 3)).alias("h3"), R(C.gaussian(k, "b")).alias("bm"))


@query("q93_roulette", f"SELECT p_partkey AS rid, CASE WHEN 10*{U.format(s='r', k='p_partkey')}<2 THEN 'a' WHEN 10*{U.format(s='r', k='p_partkey')}<5 THEN 'b' ELSE 'c' END AS pick FROM part")
def q93(s, d):
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("rid"), C.roulette(F.col("p_partkey"), "r", {"c": 5, "a": 2, "b": 3}).alias("pick"))


@query("q94_split_half", f"SELECT o_orderkey, row_number() OVER (ORDER BY {U.format(s='1', k='o_orderkey')}, o_orderkey)<=count(*) OVER ()//2 AS train FROM orders")
def q94(s, d):
    return cluster.split_half(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey").select("o_orderkey", "train")


@query("q95_membership", "SELECT count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount>0.09)) AS inside, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount>0.09)) AS outside FROM orders")
def q95(s, d):
    o, li = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/lineitem.parquet").where("l_discount > 0.09")
    have = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").agg(F.count("*").alias("inside"))
    lack = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.count("*").alias("outside"))
    return have.crossJoin(lack)  # one row each


@query("q96_poles90", f"WITH {O.OC}, s0 AS (SELECT * FROM oc ORDER BY md5('1:'||rid), rid LIMIT 1), " + ", ".join(f"o{i} AS (SELECT oc.*, round({O.dist('oc', 's' + str(i))},9) AS d, count(*) OVER () AS cnt, row_number() OVER (ORDER BY round({O.dist('oc', 's' + str(i))},9), oc.rid)-1 AS r FROM oc, s{i}), d{i} AS (SELECT d FROM o{i} WHERE r=CAST(floor(0.9*cnt) AS BIGINT)), s{i + 1} AS (SELECT o.* EXCLUDE (d, cnt, r) FROM o{i} o JOIN d{i} ON o.d=d{i}.d ORDER BY rid LIMIT 1)" for i in range(2)) + " SELECT 'east' AS pole, rid FROM s1 UNION ALL SELECT 'west', rid FROM s2")
def q96(s, d):
    east, west = cluster.poles90(view(s, d, "order"))
    return s.createDataFrame([("east", east["rid"]), ("west", west["rid"])], "pole string, rid long")


# --------------------------------------------------------------------------- trees by other means

BELOW = " OR ".join(f"b.node//{2**i}=a.node" for i in range(4))


@query("q97_tree_rollup", f"{O.tree(3)} SELECT CAST(a.node AS BIGINT) AS node, count(*) AS leaves, round(min(b.mid)+1e-9,6) AS best FROM nd a JOIN nd b ON NOT b.inner_ AND ({BELOW}) GROUP BY a.node")
def q97(s, d):
    _, t = order_tree(s, d)
    return s.createDataFrame([(i, n, round(float(m) + 1e-9, 6)) for i, (n, m) in splits.rolled(t).items()], "node long, leaves long, best double")


@query("q98_percentile_splits", "WITH c AS (SELECT l_quantity v, count(*) n FROM lineitem GROUP BY 1), u AS (SELECT v, sum(n) OVER (ORDER BY v) u, sum(n) OVER () t FROM c), k AS (SELECT DISTINCT v FROM (SELECT i, min(v) AS v FROM u, (SELECT unnest(range(1, 4)) i) WHERE u>CAST(floor(i/4.0*t+1e-9) AS BIGINT) GROUP BY i)) SELECT k.v AS x, count(*) FILTER (l_quantity<=k.v) AS n1, count(*) FILTER (l_quantity>k.v) AS n2 FROM lineitem, k GROUP BY 1 HAVING count(*) FILTER (l_quantity<=k.v)>=3 AND count(*) FILTER (l_quantity>k.v)>=3")
def q98(s, d):
    rf = view(s, d, "line")
    got = splits.percentile_candidates(rf, F.col("`L_discount+`"), 4)
    return got.where("at = 'L_quantity'").select("x", "n1", "n2")


@query("q99_fastmap_tree")
def q99(s, d):
    rf = view(s, d, "order")
    t = splits.grow_by(rf, splits.fastmap(rf), depth=2)
    return s.createDataFrame([(i, n, i in t.cuts) for i, (n, _) in sorted(t.stats.items())], "node long, n long, inner boolean")


# --------------------------------------------------------------------------- grids, balls, studies


@query("q100_grid_pipeline")
def q100(s, d):
    kept, live = grids.pipeline(view(s, d, "line"))
    return kept.groupBy("bucket").agg(F.count("*").alias("kept"), F.max("seen").alias("seen"), F.lit(",".join(live)).alias("live"))


def coded_parts(s: SparkSession, d: str) -> tuple[list[str], DataFrame]:
    """Orders as codes 1 to 5 (0: unknown), with their distance to the ideal."""
    rf = view(s, d, "order")
    codes = tables.frozen_codes(rf, 5)
    return list(codes), rf.df.select("rid", F.array(*codes.values()).alias("codes"), distance.disty(rf).alias("d"))


def era_model(s: SparkSession, d: str) -> tuple[list[str], DataFrame, grids.Eras]:
    """All orders, in four eras by a hash of their key."""
    names, rows = coded_parts(s, d)
    rows = keep(rows, "coded")
    model = grids.Eras(len(names), 5, 0.5)
    part = F.floor(C.uniform(F.col("rid"), "era") * 4)
    for i in range(4):
        model.era(rows.where(part == i))
    return names, rows, model


@query("q101_eras")
def q101(s, d):
    _, rows, model = era_model(s, d)
    return model.assigned(rows).groupBy("delegate").agg(F.count("*").alias("n"), R(F.avg("d")).alias("d"), R(F.max("gap")).alias("gap"))


@query("q102_grid_report")
def q102(s, d):
    _, rows, model = era_model(s, d)
    own = model.assigned(rows).withColumn("train", C.uniform(F.col("rid"), "half") < 0.5)
    got = grids.told(own.where("train"), own.where("NOT train"))
    return got.select(R(F.col("acc")).alias("acc"), R(F.col("mae")).alias("mae"), R(F.col("best")).alias("best"))


def graded_orders() -> list[str]:
    """Tables up to g: (rid, v0 to v3), the codes of orders."""
    rank = lambda c: f"r{c} AS (SELECT v, (row_number() OVER (ORDER BY v)-1)/greatest(1,count(*) OVER ()-1) AS x FROM (SELECT DISTINCT {c} AS v FROM ord))"
    out = [O.OC, "bo AS (SELECT bal, row_number() OVER (ORDER BY bal)-1 AS r, count(*) OVER () AS n FROM ord)", "bd AS (SELECT max(bal) FILTER (r=CAST(floor(0.1*n+1e-9) AS BIGINT)) AS lo, max(bal) FILTER (r=CAST(floor(0.9*n+1e-9) AS BIGINT)) AS hi FROM bo)", rank("a"), rank("b"), rank("c")]
    return [*out, "g AS MATERIALIZED (SELECT rid, greatest(0,least(1,(bal-lo)/(hi-lo+1e-32))) AS v0, ra.x AS v1, rb.x AS v2, rc.x AS v3 FROM ord JOIN ra ON a=ra.v JOIN rb ON b=rb.v JOIN rc ON c=rc.v CROSS JOIN bd)"]


def culled_cells(picks: int = 30) -> list[str]:
    """Tables up to kr (rows that keep half of their cells) and kc (columns that do), over the first orders by hash."""
    widest = lambda p, q: f"greatest({','.join(f'abs({p}.v{i}-{q}.v{i})' for i in range(4))})"
    out = [*graded_orders(), f"f AS MATERIALIZED (SELECT g.*, y FROM g JOIN oc USING (rid) ORDER BY md5('1:'||rid), rid LIMIT {picks})"]
    out.append(f"rd AS (SELECT p.rid, avg({widest('p', 'q')}) AS rd FROM f p JOIN f q ON p.rid<>q.rid GROUP BY 1)")
    apart = lambda i: "+".join(f"max(abs(v{i}-v{j}))" for j in range(4) if j != i)
    out.append("cd AS (" + " UNION ALL ".join(f"SELECT {i} AS att, ({apart(i)})/3 AS cd FROM f" for i in range(4)) + ")")
    out.append("ce AS MATERIALIZED (SELECT f.rid, f.y, att, round(1-f.y+rd+cd,9) AS score FROM f JOIN rd USING (rid) CROSS JOIN cd)")
    out.append("cu AS (SELECT score AS cut FROM (SELECT score, row_number() OVER (ORDER BY score)-1 AS r, count(*) OVER () AS n FROM ce) WHERE r=n//2)")
    out += [f"k{x} AS MATERIALIZED (SELECT {by} FROM ce, cu GROUP BY {by} HAVING count(*) FILTER (score<cut)<=count(*)/2)" for x, by in (("r", "rid, y"), ("c", "att"))]
    return out


def sweep_sql() -> str:
    """Codes of orders, four anchors beyond a standard deviation of random pairs, six lines, marks."""
    raw = lambda p, q: f"sqrt(({'+'.join(f'power({p}.v{i}-{q}.v{i},2)' for i in range(4))})/4)"
    gap = lambda p, q: f"round({raw(p, q)},9)"
    out = graded_orders()
    out.append("pr AS (SELECT *, row_number() OVER (ORDER BY md5('1.pairs:'||rid), rid)-1 AS p FROM g QUALIFY p<64)")
    out.append(f"eps AS (SELECT stddev_samp({raw('x', 'y')}) AS e FROM pr x JOIN pr y ON x.p%2=0 AND y.p=x.p+1)")
    for i in range(4):
        far = " AND ".join(f"{gap('g', f'a{j}')}>e" for j in range(i)) or "true"
        out.append(f"a{i} AS MATERIALIZED (SELECT g.* FROM g, eps{''.join(f', a{j}' for j in range(i))} WHERE {far} ORDER BY md5('1:'||g.rid), g.rid LIMIT 1)")
    every = "g, " + ", ".join(f"a{i}" for i in range(4))
    line = lambda i, j: f"SELECT g.rid, {gap(f'a{i}', f'a{j}')}+1e-32 AS c, {4 * i + j} AS l, round((power({gap('g', f'a{i}')},2)+power({gap(f'a{i}', f'a{j}')}+1e-32,2)-power({gap('g', f'a{j}')},2))/(2*({gap(f'a{i}', f'a{j}')}+1e-32)),9) AS att FROM {every}"
    out.append("ln AS MATERIALIZED (" + " UNION ALL ".join(line(i, j) for i in range(4) for j in range(i + 1, 4)) + ")")
    out.append("md AS (SELECT l, att AS mid FROM (SELECT l, att, row_number() OVER (PARTITION BY l ORDER BY att)-1 AS r, count(*) OVER (PARTITION BY l) AS n FROM ln) WHERE r=n//2)")
    out.append("mk AS MATERIALIZED (SELECT rid, round(sum(c*abs(att-mid)),9) AS mark FROM ln JOIN md USING (l) GROUP BY rid)")
    return f"WITH {', '.join(out)}, st2 AS (SELECT rid, mark, mark>=0.5*((SELECT max(mark) FROM mk)+1e-32) OR rid IN ({' UNION '.join(f'SELECT rid FROM a{i}' for i in range(4))}) AS stays FROM mk) SELECT stays, count(*) AS n, round(max(mark)+1e-9,4) AS mark FROM st2 GROUP BY 1"


@query("q103_sweep", sweep_sql())
def q103(s, d):
    rows, names = grids.graded(view(s, d, "order"))
    live = list(range(len(names)))
    marked = grids.sweep(rows, live, grids.anchors(rows, live))
    return marked.groupBy("stays").agg(F.count("*").alias("n"), R(F.max("mark"), 4).alias("mark"))


COLUMN_GAPS = "WITH o AS (SELECT l_quantity q, l_tax t, l_returnflag f, l_linestatus s, row_number() OVER (ORDER BY l_quantity)-1 rq, row_number() OVER (ORDER BY l_tax)-1 rt, count(*) OVER () n FROM lineitem), b AS (SELECT min(q) FILTER (rq=CAST(floor(0.1*n+1e-9) AS BIGINT)) ql, min(q) FILTER (rq=CAST(floor(0.9*n+1e-9) AS BIGINT)) qh, min(t) FILTER (rt=CAST(floor(0.1*n+1e-9) AS BIGINT)) tl, min(t) FILTER (rt=CAST(floor(0.9*n+1e-9) AS BIGINT)) th FROM o), fr AS (SELECT f, (row_number() OVER (ORDER BY f)-1)/greatest(1,count(*) OVER ()-1) AS vf FROM (SELECT DISTINCT f FROM o)), sr AS (SELECT s, (row_number() OVER (ORDER BY s)-1)/greatest(1,count(*) OVER ()-1) AS vs FROM (SELECT DISTINCT s FROM o)), v AS (SELECT greatest(0,least(1,(q-ql)/(qh-ql+1e-32))) a, greatest(0,least(1,(t-tl)/(th-tl+1e-32))) b, vf c, vs d FROM o, b, fr, sr WHERE o.f=fr.f AND o.s=sr.s) " + " UNION ALL ".join(f"SELECT '{x}' AS one, '{y}' AS two, round(sqrt(avg(power({i}-{j},2)))+1e-9,6) AS gap FROM v" for (i, x), (j, y) in (((p, m), (q, n)) for k, (p, m) in enumerate(zip("abcd", ("L_quantity", "L_tax", "l_returnflag", "l_linestatus"))) for q, n in list(zip("abcd", ("L_quantity", "L_tax", "l_returnflag", "l_linestatus")))[k + 1 :]))


@query("q117_column_gaps", COLUMN_GAPS)
def q117(s, d):
    rows, names = grids.graded(view(s, d, "line"))
    got = grids.column_gaps(rows, list(range(len(names))))
    return s.createDataFrame([(names[i], names[j], round(g + 1e-9, 6)) for (i, j), g in got.items() if i < j], "one string, two string, gap double")


@query("q104_squeeze")
def q104(s, d):
    rf = view(s, d, "part")
    left, columns, spent = grids.squeeze(rf, distance.disty(rf), budget=20, most=3, least=2)
    return left.agg(F.count("*").alias("n"), F.lit(len(spent)).alias("labels"), F.lit(",".join(columns)).alias("columns"), R(F.max("mark"), 4).alias("mark"))


@query("q122_sphere_probes")
def q122(s, d):
    rf = view(s, d, "order")
    left, labels = grids.probed(rf, distance.disty(rf), budget=16, wait=4)
    known = s.createDataFrame([(i, y) for i, y in labels.items()], "rid long, label double")
    return left.select("rid").join(F.broadcast(known), "rid", "left").select("rid", R(F.col("label")).alias("label"))


def ranked_rest_sql(check: int = 5) -> str:
    """Orders that nobody picked, by the label of the pick that lives and is nearest by the largest gap over living columns."""
    gap = f"greatest({','.join(f'CASE WHEN {i} IN (SELECT att FROM kc) THEN abs(g.v{i}-p.v{i}) ELSE 0 END' for i in range(4))})"
    near = f"SELECT g.rid, p.rid AS near, kr.y AS guess FROM g CROSS JOIN kr JOIN f p ON p.rid=kr.rid WHERE g.rid NOT IN (SELECT rid FROM f) QUALIFY row_number() OVER (PARTITION BY g.rid ORDER BY round({gap},12), p.rid)=1"
    return f"WITH {', '.join(culled_cells())}, nr AS ({near}) SELECT rid, near, round(guess+1e-9,6) AS guess, CAST(row_number() OVER (ORDER BY round(guess,9), rid) AS INT) AS rank FROM nr ORDER BY 4 LIMIT {check}"


@query("q118_ranked_rest", ranked_rest_sql())
def q118(s, d):
    rf = view(s, d, "order")
    return grids.ranked_rest(rf, distance.disty(rf)).select("rid", "near", R(F.col("guess")).alias("guess"), "rank")


@query("q105_cells", f"WITH {', '.join(culled_cells())} SELECT count(*) AS cells, round(max(score)+1e-9,4) AS best, (SELECT count(*) FROM kr) AS rows, (SELECT count(*) FROM kc) AS cols FROM ce")
def q105(s, d):
    rf = view(s, d, "order")
    scored, rows, cols = grids.cells(rf, distance.disty(rf))
    return scored.agg(F.count("*").alias("cells"), R(F.max("score"), 4).alias("best")).crossJoin(rows.agg(F.count("*").alias("rows"))).crossJoin(cols.agg(F.count("*").alias("cols")))  # one row each


def twins_sql(turns: int = 6) -> str:
    """Parts have symbols only, so twins are equal in both; each turn pairs by a hashed order, till one drops nothing."""
    out = ["t0 AS MATERIALIZED (SELECT p_partkey AS rid, p_brand AS b, p_type AS t FROM part)"]
    for i in range(turns):
        out.append(f"n{i} AS (SELECT *, row_number() OVER (ORDER BY {U.format(s=f'1.{i}', k='rid')}, rid)-1 AS p FROM t{i})")
        out.append(f"h{i} AS MATERIALIZED (SELECT greatest(x.rid,y.rid) AS rid FROM n{i} x JOIN n{i} y ON x.p//2=y.p//2 AND x.p%2=0 AND y.p%2=1 WHERE x.b=y.b AND x.t=y.t" + (f" AND (SELECT count(*) FROM h{i - 1})>0)" if i else ")"))
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE rid NOT IN (SELECT rid FROM h{i}))")
    return f"WITH {', '.join(out)} SELECT count(*) AS n FROM t{turns}"


@query("q106_twins", twins_sql())
def q106(s, d):
    return grids.twins(view(s, d, "part"), 0.4).agg(F.count("*").alias("n"))


def ball_sql(depth: int = 3, pool: int = 64) -> str:
    """Balls of a hashed pool of orders level by level: the longest pair of a node, the pole toward one end of its line, the upper
    median distance to the pole; then all orders take the same turns."""
    out = [O.OC, f"p AS MATERIALIZED (SELECT * FROM oc ORDER BY md5('1:'||rid), rid LIMIT {pool})", f"m AS MATERIALIZED (SELECT x.rid AS i, z.rid AS j, CASE WHEN x.rid=z.rid THEN 0 ELSE round({O.dist('x', 'z')},9) END AS d FROM p x, p z)"]
    out += ["t0 AS MATERIALIZED (SELECT rid AS i, 1 AS node FROM p)", "r0 AS MATERIALIZED (SELECT rid, 1 AS node FROM oc)"]
    for n in range(depth):
        out.append(f"x{n} AS MATERIALIZED (SELECT node, i AS x, j AS y, d+1e-32 AS c FROM (SELECT a.node, m.i, m.j, m.d FROM t{n} a JOIN t{n} b ON a.node=b.node AND a.i<b.i JOIN m ON m.i=a.i AND m.j=b.i WHERE a.node IN (SELECT node FROM t{n} GROUP BY 1 HAVING count(*)>=8) QUALIFY row_number() OVER (PARTITION BY a.node ORDER BY m.d DESC, m.i, m.j)=1))")
        out.append(f"l{n} AS (SELECT t.node, t.i, (u.d*u.d+c*c-w.d*w.d)/(2*c) AS att FROM t{n} t JOIN x{n} USING (node) JOIN m u ON u.i=x AND u.j=t.i JOIN m w ON w.i=y AND w.j=t.i)")
        out.append(f"o{n} AS MATERIALIZED (SELECT node, i AS pole FROM (SELECT node, i, row_number() OVER (PARTITION BY node ORDER BY att, i)-1 AS r, count(*) OVER (PARTITION BY node) AS n FROM l{n}) WHERE r=CAST(floor(0.1*n-1e-9) AS BIGINT))")
        out.append(f"g{n} AS MATERIALIZED (SELECT t.node, t.i, pole, d FROM t{n} t JOIN o{n} USING (node) JOIN m ON m.i=pole AND m.j=t.i)")
        out.append(f"b{n} AS (SELECT node, pole, d AS radius FROM (SELECT node, pole, d, row_number() OVER (PARTITION BY node ORDER BY d)-1 AS r, count(*) OVER (PARTITION BY node) AS n FROM g{n}) WHERE r=n//2)")
        out.append(f"c{n} AS MATERIALIZED (SELECT * FROM b{n} WHERE EXISTS (SELECT 1 FROM g{n} WHERE g{n}.node=b{n}.node AND d>radius))")
        out.append(f"t{n + 1} AS MATERIALIZED (SELECT i, 2*node+CAST(d>radius AS INT) AS node FROM g{n} JOIN c{n} USING (node))")
        out.append(f"r{n + 1} AS MATERIALIZED (SELECT r.rid, CASE WHEN c.node IS NULL THEN r.node ELSE 2*r.node+CAST(round({O.dist('q', 'p')},9)>radius AS INT) END AS node FROM r{n} r JOIN oc q ON q.rid=r.rid LEFT JOIN c{n} c ON c.node=r.node LEFT JOIN p ON p.rid=c.pole)")
    return f"WITH {', '.join(out)} SELECT node AS leaf, count(*) AS n FROM r{depth} GROUP BY 1"


@query("q107_ball_tree", ball_sql())
def q107(s, d):
    rf = view(s, d, "order")
    tree = grids.ball_tree(rf, 3, pool=64)
    return neighbours.cells(rf).groupBy(grids.ball_leaf(tree, F.col("a")).alias("leaf")).agg(F.count("*").alias("n"))


@query("q108_study")
def q108(s, d):
    runs = label.study(whole(s, d, "order", "part"), [(f"{m}20", f, m, 20) for f in ("order", "part") for m in ("active", "random", "centroid")], 3, start=8)
    return runs.groupBy("file", "arm").agg(R(F.avg("win"), 3).alias("win"), F.max("spent").alias("spent"))


@query("q109_versus")
def q109(s, d):
    runs = label.study(whole(s, d, "part"), [(m, "part", m, 20) for m in ("active", "random")], 8)
    return label.verdicts(runs, "active", "random")


MUTATE = (
    f"WITH {O.OC}, cnt AS (SELECT 1 AS j, a AS v, count(*) AS n FROM ord GROUP BY a UNION ALL SELECT 2, b, count(*) FROM ord GROUP BY b UNION ALL SELECT 3, c, count(*) FROM ord GROUP BY c)"
    ", cum AS (SELECT j, v, sum(n) OVER (PARTITION BY j ORDER BY v)-n AS lo, sum(n) OVER (PARTITION BY j ORDER BY v) AS hi, sum(n) OVER (PARTITION BY j) AS t FROM cnt)"
    ", k AS (SELECT ord.*, list_transform(list_slice(list_sort([" + ", ".join(f"{{'h': md5('1.{j}:'||rid), 'j': {j}}}" for j in range(4)) + "]),1,2), lambda x: x.j) AS js, " + ", ".join(f"{U.format(s=f'1.{j}.v', k='rid')} AS u{j}" for j in (1, 2, 3))
    + f", greatest(mb-3*sb,least(mb+3*sb,greatest(-3.0,least(3.0,sqrt(-2*ln(1-{U.format(s='1.0.v.u', k='rid')}))*cos(2*pi()*{U.format(s='1.0.v.v', k='rid')})))*sb+bal)) AS nb FROM ord, st)"
    " SELECT CAST(CAST(list_contains(js,0) AND nb<>bal AS INT)" + "".join(f"+CAST(list_contains(js,{j}) AND c{j}.v<>k.{x} AS INT)" for j, x in ((1, "a"), (2, "b"), (3, "c"))) + " AS INTEGER) AS changed, count(*) AS n FROM k"
    + "".join(f" JOIN cum c{j} ON c{j}.j={j} AND u{j}*c{j}.t>=c{j}.lo AND u{j}*c{j}.t<c{j}.hi" for j in (1, 2, 3)) + " GROUP BY 1"
)


@query("q110_mutate", MUTATE)
def q110(s, d):
    rf = view(s, d, "order")
    got = search.mutated(rf, 2).select("rid", *[F.col(c).alias(f"m_{c}") for c in rf.schema.x]).join(rf.df, "rid")
    changed = sum((~F.col(f"m_{c}").eqNullSafe(F.col(c))).cast("int") for c in rf.schema.x)
    return got.groupBy(changed.alias("changed")).agg(F.count("*").alias("n"))


@query("q111_synthesize")
def q111(s, d):
    rf, t = order_tree(s, d)
    return search.synthesized(rf, t.leaf_column(), 500).groupBy("leaf").agg(F.count("*").alias("n"), R(F.avg("C_acctbal"), 3).alias("bal"))


@query("q112_timeline")
def q112(s, d):
    rf = view(s, d, "part")
    sur = breed.Surrogate(rf, rf.df.select("rid", distance.disty(rf).alias("y")))
    return breed.merged(breed.race(sur, ["climb", "oneplus1"], 1, steps=40)).select("evaluation", "optimizer", R(F.col("best")).alias("best"))


RATED = {"acap": "1+p_size%3", "pcap": "2+p_partkey%3", "prec": "1+p_partkey%2", "apex": "4", "sced": "1+p_size%4", "cplx": "2+p_partkey%4", "tool": "3"}


def risk_sql() -> str:
    """Every pair of drivers, unrated ones at 3."""
    e = lambda x, y, kx, ky, t: f"({kx})*({RATED.get(x, '3')})+({ky})*({RATED.get(y, '3')})-({t})"
    return "+".join(f"CASE WHEN {e(x, y, kx, ky, t)}>=0 THEN {w}*power(2,{e(x, y, kx, ky, t)}) ELSE 0 END" for x, y, w, kx, ky, t in C.RISKS)


def effort_sql() -> str:
    pick = lambda table, n: f"CASE {RATED[n]} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(table[n], 1) if v is not None) + " END" if n in RATED else str(table[n][2])
    return f"2.94*power(p_size,0.91+0.01*({'+'.join(pick(C.SCALES, n) for n in C.SCALES)}))*{'*'.join(pick(C.MULTIPLIERS, n) for n in C.MULTIPLIERS)}"


@query("q113_rated_effort", f"WITH e AS (SELECT p_partkey AS rid, {effort_sql()} AS effort, 0.91+0.01*({'+'.join(str(C.SCALES[n][2]) if n not in RATED else f'CASE {RATED[n]} ' + ' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(C.SCALES[n], 1)) + ' END' for n in C.SCALES)}) AS ex, ({risk_sql()})/3.73 AS risk FROM part) SELECT rid, round(effort+1e-9,5) AS effort, round(3.67*power(effort,0.28+0.2*(ex-0.91))+1e-9,5) AS months, round(risk+1e-9,6) AS risk FROM e")
def q113(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    rating = {n: F.expr(e) for n, e in RATED.items()}
    effort = C.rated_effort(F.col("p_size"), rating)
    return p.select(F.col("p_partkey").alias("rid"), R(effort, 5).alias("effort"), R(C.rated_months(effort, rating), 5).alias("months"), R(C.rated_risk(C.RISKS, rating)).alias("risk"))


@query("q119_stored_summaries", "SELECT 'l_quantity' AS col, count(l_quantity) AS n, round(avg(l_quantity)+1e-9,6) AS mu, round(stddev_samp(l_quantity)+1e-9,6) AS sd FROM lineitem WHERE l_linenumber<>2 UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax)+1e-9,6), round(stddev_samp(l_tax)+1e-9,6) FROM lineitem WHERE l_linenumber<>2")
def q119(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet")
    kept = stored.Summaries(s, new_folder(s, "summaries"), "l_linenumber", ["l_quantity", "l_tax"])
    kept.refresh(rows.where("l_linenumber <= 4"))  # what was there before
    kept.refresh(rows.where("l_linenumber <> 2"))  # slices have come, one has gone
    return kept.numbers().select("col", "n", R(F.col("mu")).alias("mu"), R(F.col("sd")).alias("sd"))


@query("q120_merged_slices", "SELECT p_brand AS col, count(*) AS n, round(avg(p_retailprice)+1e-9,6) AS mu, round(coalesce(stddev_samp(p_retailprice),0)+1e-9,6) AS sd FROM part WHERE p_size % 5 <> 0 GROUP BY 1")
def q120(s, d):
    p = s.read.parquet(f"{d}/part.parquet").withColumn("slice", F.concat_ws(":", "p_brand", (F.col("p_size") % 10).cast("string")))
    own, _ = stored.parts(p, "slice", ["p_retailprice"], [])
    own = own.withColumn("col", F.split("slice", ":")[0])
    out = own.where("slice RLIKE ':(0|5)$'").withColumn("sign", F.lit(-1))
    got = stored.combined(own.withColumn("sign", F.lit(1)).unionByName(out), "sign")
    return got.select("col", "n", R(F.col("mu")).alias("mu"), R(F.col("sd")).alias("sd"))


@query("q121_sessions", "WITH e AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id AS key, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts)+INTERVAL 6 HOUR)) AS BIGINT) AS stop, count(*) AS n, round(sum(value)+1e-9,4) AS total FROM g WHERE ts IS NOT NULL GROUP BY user_id, k")
def q121(s, d):
    ev = s.read.parquet(f"{d}/events.parquet").where("ts IS NOT NULL")
    got = folds.sessions(ev.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value", "6 hours")
    return got.select("key", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "n", R(F.col("total"), 4).alias("total"))
