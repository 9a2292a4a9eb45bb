"""SQL of the queries that take several steps: trees, rules, poles, clusters and sequences, as unrolled common table
expressions. Each text is what DuckDB needs to answer the query of the same name in `queries`."""

from __future__ import annotations

LOG = "1/(1+exp(-1.7*greatest(-3.0,least(3.0,({v}-{m})/({s}+1e-32)))))"
ORD = "ord AS (SELECT o_orderkey AS rid, c_acctbal AS bal, c_mktsegment AS a, o_orderpriority AS b, CAST(n_regionkey AS VARCHAR) AS c, o_totalprice AS price, o_orderstatus AS k FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)"
#: Coded orders: v (normalized number), symbols a, b, c, distance y to the ideal goals.
OC = f"{ORD}, st AS (SELECT avg(bal) mb, stddev_samp(bal) sb, avg(price) mp, stddev_samp(price) sp FROM ord), oc AS MATERIALIZED (SELECT rid, bal, {LOG.format(v='bal', m='mb', s='sb')} AS v, a, b, c, price, k, abs({LOG.format(v='price', m='mp', s='sp')}-1) AS y FROM ord, st)"


def dist(p: str, q: str) -> str:
    """Distance of two coded orders."""
    return f"sqrt((power({p}.v-{q}.v,2)+CASE WHEN {p}.a={q}.a THEN 0 ELSE 1 END+CASE WHEN {p}.b={q}.b THEN 0 ELSE 1 END+CASE WHEN {p}.c={q}.c THEN 0 ELSE 1 END)/4)"


def line(t: str, e: str, w: str) -> str:
    """Where t lies on the line from e to w."""
    return f"((power({dist(t, e)},2)+power({dist(e, w)},2)-power({dist(t, w)},2))/(2*({dist(e, w)})+1e-32))"


def poles(n: str, seed: str) -> str:
    """Tables e<n> and w<n>: the poles of all orders from a hashed start."""
    far = lambda new, old: f"{new} AS (SELECT oc.* FROM oc, {old} ORDER BY round({dist('oc', old)},9) DESC, oc.rid LIMIT 1)"
    return f"s{n} AS (SELECT * FROM oc ORDER BY md5('{seed}:'||rid), rid LIMIT 1), {far(f'e{n}', f's{n}')}, {far(f'w{n}', f'e{n}')}"


PROJECT = f"WITH {OC}, {poles('0', '1')} SELECT oc.rid, round({line('oc', 'e0', 'w0')}+1e-9,6) AS at FROM oc, e0, w0"
HALVE = f"WITH {OC}, {poles('0', '1')}, f AS (SELECT w0.y<e0.y AS flip FROM e0, w0), t AS (SELECT oc.rid, round(CASE WHEN flip THEN {line('oc', 'w0', 'e0')} ELSE {line('oc', 'e0', 'w0')} END,9) AS att FROM oc, e0, w0, f), r AS (SELECT row_number() OVER (ORDER BY att, rid) <= greatest(1, count(*) OVER ()//2) AS near FROM t) SELECT near, count(*) AS n FROM r GROUP BY 1"


def nodes(depth: int, stop: int = 4) -> str:
    out = [OC, "n0 AS MATERIALIZED (SELECT *, 1 AS node FROM oc)"]
    for i in range(depth):
        t = f"n{i}"
        out.append(f"b{i} AS (SELECT node FROM {t} WHERE node>={2**i} GROUP BY node HAVING count(*)>={2 * stop})")
        out.append(f"s{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5('1:'||rid), rid) r FROM {t} SEMI JOIN b{i} USING (node)) WHERE r=1)")
        for new, old in ((f"e{i}", f"s{i}"), (f"w{i}", f"e{i}")):
            out.append(f"{new} AS MATERIALIZED (SELECT * EXCLUDE (r, o) FROM (SELECT t.*, 0 AS o, row_number() OVER (PARTITION BY t.node ORDER BY round({dist('t', 'p')},9) DESC, t.rid) r FROM {t} t JOIN {old} p ON t.node=p.node) WHERE r=1)")
        out.append(f"a{i} AS MATERIALIZED (SELECT t.rid, round(CASE WHEN w.y<e.y THEN {line('t', 'w', 'e')} ELSE {line('t', 'e', 'w')} END,9) AS att FROM {t} t JOIN e{i} e ON t.node=e.node JOIN w{i} w ON t.node=w.node)")
        out.append(f"m{i} AS (SELECT node, quantile_disc(att,0.5) AS mid FROM {t} JOIN a{i} USING (rid) GROUP BY node)")
        out.append(f"n{i + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node), CASE WHEN m.mid IS NULL THEN t.node ELSE 2*t.node+CAST(a.att>m.mid AS INT) END AS node FROM {t} t LEFT JOIN a{i} a USING (rid) LEFT JOIN m{i} m ON t.node=m.node)")
    return f"WITH {', '.join(out)} SELECT node, count(*) AS n FROM n{depth} GROUP BY node"


COLS = (("C_acctbal", "bal"), ("c_mktsegment", "a"), ("o_orderpriority", "b"), ("n_regionkey", "c"))


def cells(table: str, y: str, keys: str) -> str:
    """One row for each input cell: att, x (numbers), s (symbols), y."""
    return " UNION ALL ".join(f"SELECT {keys}'{at}' AS att, {'CAST(bal AS DOUBLE)' if col == 'bal' else 'CAST(NULL AS DOUBLE)'} AS x, {'CAST(NULL AS VARCHAR)' if col == 'bal' else col} AS s, {y} AS y FROM {table}" for at, col in COLS)


def sd(n: str, t: str, q: str) -> str:
    return f"(CASE WHEN {n}<2 THEN 0 ELSE sqrt(greatest(0,{q}-{t}*{t}/{n})/({n}-1)) END)"


def best_cuts(name: str, table: str, y: str = "y", leaf: int = 3, cells_sql: str | None = None) -> str:
    """Table <name>: the cheapest cut of each node of a table with a node column."""
    g = f"SELECT node, att, x, s, count(*) n, sum(y) t, sum(y*y) q FROM ({cells_sql or cells(table, y, 'node, ')}) GROUP BY node, att, x, s"
    up = lambda c: f"CASE WHEN s IS NULL THEN sum({c}) OVER (PARTITION BY node, att ORDER BY x ROWS UNBOUNDED PRECEDING) ELSE {c} END AS {c}1, sum({c}) OVER (PARTITION BY node, att) AS {c}"
    w = f"SELECT node, att, x, s, {', '.join(map(up, 'ntq'))} FROM ({g})"
    cost = f"(n1*{sd('n1', 't1', 'q1')}+(n-n1)*{sd('(n-n1)', '(t-t1)', '(q-q1)')})/n"
    c = f"SELECT node, att, x, s, n1, n-n1 AS n2, {cost} AS cost FROM ({w}) WHERE n1>={leaf} AND n-n1>={leaf}"
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(cost,9), att, x NULLS FIRST, s NULLS FIRST) r FROM ({c})) WHERE r=1)"


VALUE = "CASE c.att WHEN 'C_acctbal' THEN CAST(t.bal<=c.x AS INT) WHEN 'c_mktsegment' THEN CAST(t.a=c.s AS INT) WHEN 'o_orderpriority' THEN CAST(t.b=c.s AS INT) ELSE CAST(t.c=c.s AS INT) END"
BEST = f"WITH {OC}, t0 AS (SELECT *, 1 AS node FROM oc), {best_cuts('c0', 't0')} SELECT att AS at, CASE WHEN s IS NULL THEN '<=' ELSE '==' END AS op, x, s, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(cost+1e-9,6) AS cost FROM c0"


LINE_COLS = (("L_quantity", "l_quantity"), ("L_tax", "l_tax"), ("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus"))
#: The best cut of two tables of different columns, each for its own distance to the ideal.
MANY = (
    f"WITH {OC}, l AS (SELECT *, l_extendedprice p, l_discount c FROM lineitem), ls AS (SELECT avg(p) mp, stddev_samp(p) sp, avg(c) mc, stddev_samp(c) sc FROM l)"
    f", lc AS MATERIALIZED (SELECT l.*, sqrt((power({LOG.format(v='p', m='mp', s='sp')},2)+power(1-{LOG.format(v='c', m='mc', s='sc')},2))/2) AS y FROM l, ls)"
    ", cells AS (" + cells("oc", "y", "'order' AS node, ") + " UNION ALL " + " UNION ALL ".join(f"SELECT 'line' AS node, '{at}' AS att, {'CAST(' + col + ' AS DOUBLE)' if at[0] == 'L' else 'CAST(NULL AS DOUBLE)'} AS x, {'CAST(NULL AS VARCHAR)' if at[0] == 'L' else col} AS s, y FROM lc" for at, col in LINE_COLS) + ")"
    ", " + best_cuts("c0", "cells", cells_sql="SELECT * FROM cells") + " SELECT node AS file, att AS at, CASE WHEN s IS NULL THEN '<=' ELSE '==' END AS op, x, s, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(cost+1e-9,6) AS cost FROM c0"
)


def tree(depth: int, leaf: int = 3) -> str:
    """Tables t<depth> (rows with their last node) and nd (node, n, mid, inner)."""
    out = [OC, "t0 AS MATERIALIZED (SELECT *, 1 AS node FROM oc)"]
    for i in range(depth):
        out.append(f"o{i} AS MATERIALIZED (SELECT * FROM t{i} WHERE node>={2**i} AND node IN (SELECT node FROM t{i} GROUP BY node HAVING count(*)>={2 * leaf}))")
        out.append(best_cuts(f"c{i}", f"o{i}", leaf=leaf))
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node), CASE WHEN c.node IS NULL THEN t.node ELSE 2*t.node+1-{VALUE} END AS node FROM t{i} t LEFT JOIN c{i} c ON t.node=c.node)")
    every = " UNION ".join(f"SELECT node, count(*) AS n, avg(y) AS mid FROM t{i} WHERE node>={2**i} GROUP BY node" for i in range(depth + 1))
    inner = " UNION ALL ".join(f"SELECT node FROM c{i}" for i in range(depth))
    out.append(f"nd AS MATERIALIZED (SELECT e.node, e.n, e.mid, i.node IS NOT NULL AS inner_ FROM ({every}) e LEFT JOIN ({inner}) i ON e.node=i.node)")
    return "WITH " + ", ".join(out)


TREE = f"{tree(3)} SELECT CAST(node AS BIGINT) AS node, n, round(mid+1e-9,6) AS mid, inner_ AS inner FROM nd"
PREDICT = f"{tree(3)} SELECT t3.rid, t3.node AS leaf, round(nd.mid+1e-9,6) AS guess FROM t3 JOIN nd ON nd.node=t3.node"
PRUNE = (
    f"{tree(3)}, k AS (SELECT coalesce(bool_or(inner_) FILTER (node={{}}),false) FROM nd)".split(", k AS")[0]
    + ", i AS (SELECT "
    + ", ".join(f"CAST(coalesce(bool_or(inner_) FILTER (node={j}),false) AS INT) AS i{j}" for j in range(1, 8))
    + " FROM nd), p2 AS (SELECT i1, i2*(1+i4)*(1+i5) AS a2, i3*(1+i6)*(1+i7) AS a3, i2*(1+i4+i5) AS s2, i3*(1+i6+i7) AS s3 FROM i)"
    ", m AS (SELECT node, mid, floor(log2(node)) AS d FROM nd WHERE node>1 OR NOT inner_ ORDER BY round(mid,9), d, node LIMIT 1)"
    " SELECT 'all' AS shapes, CAST(CASE WHEN i1=1 THEN (1+a2)*(1+a3) ELSE 1 END AS BIGINT) AS prunings, CAST(d+1 AS BIGINT) AS leaves, round(mid+1e-9,6) AS score FROM p2, m"
    " UNION ALL SELECT 'spine', CAST(CASE WHEN i1=1 THEN 1+s2+s3 ELSE 1 END AS BIGINT), CAST(d+1 AS BIGINT), round(mid+1e-9,6) FROM p2, m"
)


def entropy(n: str, t: str) -> str:
    part = lambda k: f"CASE WHEN {k}>0 THEN -(({k})/{n})*log2(({k})/{n}) ELSE 0 END"
    return f"({part(t)}+{part(f'({n}-{t})')})"


def rule_cut(name: str, table: str, hit: str, leaf: int = 3) -> str:
    """Table <name>: the cut of least entropy of `hit` rows, with the side to keep."""
    g = f"SELECT att, x, s, CAST(count(*) AS DOUBLE) n, CAST(count(*) FILTER (y) AS DOUBLE) t FROM ({cells(table, hit, '')}) GROUP BY att, x, s"
    up = lambda c: f"CASE WHEN s IS NULL THEN sum({c}) OVER (PARTITION BY att ORDER BY x ROWS UNBOUNDED PRECEDING) ELSE {c} END AS {c}1, sum({c}) OVER (PARTITION BY att) AS {c}"
    cost = f"(n1*{entropy('n1', 't1')}+(n-n1)*{entropy('(n-n1)', '(t-t1)')})/n"
    c = f"SELECT att, x, s, n1, {cost} AS cost, t1/n1>=(t-t1)/(n-n1) AS keep FROM (SELECT att, x, s, {up('n')}, {up('t')} FROM ({g})) WHERE n1>={leaf} AND n-n1>={leaf}"
    return f"{name} AS MATERIALIZED (SELECT * FROM ({c}) ORDER BY round(cost,9), att, x NULLS FIRST, s NULLS FIRST, keep LIMIT 1)"


STEP = f"WITH {ORD}, {rule_cut('c0', 'ord', chr(40) + 'k=' + chr(39) + 'F' + chr(39) + chr(41))} SELECT att AS at, CASE WHEN s IS NULL THEN '<=' ELSE '==' END AS op, x, s, keep, CAST(n1 AS BIGINT) AS n1, round(cost+1e-9,6) AS cost FROM c0"


def rule(turns: int) -> str:
    """Tables c0, c1, ...: the conjuncts of a rule for the sqrt(n) best rows."""
    out = [OC, "r0 AS MATERIALIZED (SELECT * FROM oc)"]
    for i in range(turns):
        out.append(f"g{i} AS (SELECT max(y) AS edge FROM (SELECT y FROM r{i} ORDER BY y LIMIT (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) FROM r{i})))")
        out.append(f"h{i} AS MATERIALIZED (SELECT r{i}.*, y<=edge AS hit FROM r{i}, g{i})")
        out.append(rule_cut(f"c{i}", f"h{i}", "hit"))
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT t.* FROM r{i} t, c{i} c WHERE ({VALUE}=1)=c.keep)")
    return "WITH " + ", ".join(out)


RULE = f"{rule(2)} " + " UNION ALL ".join(f"SELECT {i} AS i, att AS at, CASE WHEN s IS NULL THEN '<=' ELSE '==' END AS op, coalesce(CAST(x AS VARCHAR), s) AS v, keep FROM c{i}" for i in range(2))
MATCHES = f"{rule(2)} SELECT " + "+".join(f"(SELECT CAST(({VALUE}=1)=c.keep AS INT) FROM c{i} c)" for i in range(2)) + " AS met, count(*) AS n FROM oc t GROUP BY 1"


def frugal(depth: int, bins: int = 7) -> str:
    out = [OC, f"fx AS MATERIALIZED (SELECT rid, y, CAST(CAST(floor({bins}*v) AS BIGINT) AS VARCHAR) AS x0, a AS x1, b AS x2, c AS x3 FROM oc)", "lim AS (SELECT power(count(*),0.33) AS least, avg(y) AS rest FROM fx)", "b0 AS MATERIALIZED (SELECT *, '' AS bias FROM fx)"]
    names = ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(COLS))
    for d in range(depth):
        flat = " UNION ALL ".join(f"SELECT bias, {i} AS i, x{i} AS v, y FROM b{d}" for i in range(4))
        out.append(f"f{d} AS MATERIALIZED (SELECT bias, i, v, avg(y) AS m FROM ({flat}) WHERE v IS NOT NULL GROUP BY bias, i, v HAVING count(*)>(SELECT least FROM lim))")
        out.append(f"k{d} AS MATERIALIZED (SELECT bias, '0' AS side, i, v, m FROM (SELECT *, row_number() OVER (PARTITION BY bias ORDER BY round(m,9), i, v) r FROM f{d}) WHERE r=1 UNION ALL SELECT bias, '1', i, v, m FROM (SELECT *, row_number() OVER (PARTITION BY bias ORDER BY round(m,9) DESC, i, v DESC) r FROM f{d}) WHERE r=1)")
        out.append(f"b{d + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (bias), t.bias||k.side AS bias FROM b{d} t JOIN k{d} k ON t.bias=k.bias WHERE CASE k.i WHEN 0 THEN t.x0 WHEN 1 THEN t.x1 WHEN 2 THEN t.x2 ELSE t.x3 END IS DISTINCT FROM k.v)")
    full = " UNION ALL ".join(f"SELECT bias||side AS bias, {d} AS level, i, v, m FROM k{d}" for d in range(depth))
    out.append(f"ex AS MATERIALIZED (SELECT * FROM ({full}))")
    out.append(f"tr AS (SELECT bias FROM ex WHERE length(bias)={depth})")
    guess = "lim.rest"
    for d in reversed(range(depth)):
        guess = f"CASE WHEN CASE e{d}.i WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END=e{d}.v THEN e{d}.m ELSE {guess} END"
    joins = " ".join(f"JOIN ex e{d} ON e{d}.bias=left(tr.bias,{d + 1})" for d in range(depth))
    out.append(f"er AS MATERIALIZED (SELECT tr.bias, avg(abs(y-({guess}))) AS err FROM tr {joins}, fx, lim GROUP BY tr.bias)")
    return f"WITH {', '.join(out)}, wi AS (SELECT * FROM er ORDER BY round(err,9), bias LIMIT 1) SELECT CAST(level AS INTEGER) AS level, n.name AS at, v AS bin, round(m+1e-9,6) AS mid, round(err+1e-9,6) AS err FROM wi JOIN ex ON ex.bias=left(wi.bias, level+1) JOIN (VALUES {names}) n(i, name) ON n.i=ex.i"


TWO = "c AS (SELECT v, sum(x) a, sum(y) b FROM (SELECT c_acctbal v, 1 x, 0 y FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier) GROUP BY v)"


def effects(name: str, counts: str, key: str = "") -> str:
    """Table <name>: n, m, cliffs, ks, cohen of (v, a, b), for each key."""
    by = f"PARTITION BY {key}" if key else ""
    k, g = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    u = f"SELECT *, sum(a) OVER w ua, sum(b) OVER w ub, sum(a) OVER p n, sum(b) OVER p m FROM {counts} WINDOW w AS ({by} ORDER BY v ROWS UNBOUNDED PRECEDING), p AS ({by})"
    pooled = "sqrt((greatest(0,sum(v*v*a)-max(n)*power(sum(v*a)/max(n),2))+greatest(0,sum(v*v*b)-max(m)*power(sum(v*b)/max(m),2)))/greatest(1,max(n)+max(m)-2))"
    return f"{name} AS (SELECT {k}max(n) n, max(m) m, abs(sum(a*(ub-b))-sum(a*(m-ub)))/max(n)/max(m) cliffs, max(abs(ua/n-ub/m)) ks, abs(sum(v*a)/max(n)-sum(v*b)/max(m))/({pooled}+1e-32) cohen FROM ({u}) {g})"


SAME_IF = "cliffs<=0.195 AND ks<=1.36*sqrt((n+m)/(n*m)) AND cohen<=0.35"
SAME = f"WITH {TWO}, {effects('e', 'c')} SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(cliffs+1e-9,6) AS cliffs, round(ks+1e-9,6) AS ks, round(cohen+1e-9,6) AS cohen, {SAME_IF} AS same FROM e"
RANKS = f"""WITH RECURSIVE {ORD}, mu AS (SELECT b, avg(price) mu, row_number() OVER (ORDER BY avg(price), b) pos FROM ord GROUP BY b),
pr AS (SELECT x.pos*1000+z.pos AS pr, price AS v, CAST(count(*) FILTER (ord.b=x.b) AS DOUBLE) a, CAST(count(*) FILTER (ord.b=z.b) AS DOUBLE) b FROM mu x JOIN mu z ON x.pos<z.pos JOIN ord ON ord.b=x.b OR ord.b=z.b GROUP BY 1, 2),
{effects('e', 'pr', 'pr')}, sm AS MATERIALIZED (SELECT pr//1000 AS x, pr%1000 AS z, {SAME_IF} AS same FROM e),
fold(pos, champ, rank) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), 0 UNION ALL SELECT f.pos+1, CASE WHEN s.same THEN f.champ ELSE f.pos+1 END, CASE WHEN s.same THEN f.rank ELSE f.rank+1 END FROM fold f JOIN sm s ON s.x=f.champ AND s.z=f.pos+1)
SELECT mu.b AS priority, CAST(rank AS INTEGER) AS rank FROM fold JOIN mu USING (pos)"""


#: Prequential naive Bayes over events: inputs Hour and u, class event_type.
BAYES = """WITH ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS pos, event_type AS want, CAST(hour(ts) AS DOUBLE) AS h, CAST(user_id % 8 AS VARCHAR) AS u FROM events),
pa AS (SELECT ev.*, k.klass, CASE WHEN want=klass THEN 1 ELSE 0 END AS mine FROM ev, (SELECT DISTINCT event_type AS klass FROM events WHERE event_type IS NOT NULL) k),
ru AS (SELECT *, coalesce(sum(mine) OVER w,0) AS nk, coalesce(sum(CASE WHEN mine=1 THEN h END) OVER w,0) AS t, coalesce(sum(CASE WHEN mine=1 THEN h*h END) OVER w,0) AS q, coalesce(sum(mine) OVER s,0) AS f FROM pa WINDOW w AS (PARTITION BY klass ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY klass, u ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nh AS (SELECT *, sum(CASE WHEN nk>0 THEN 1 ELSE 0 END) OVER (PARTITION BY pos) AS nh FROM ru),
pz AS (SELECT *, (nk+1)/(pos-1+nh) AS prior, 2*CASE WHEN nk<2 THEN 0 ELSE greatest(0,q-t*t/nk)/(nk-1) END+1e-32 AS z FROM nh WHERE pos>10 AND nk>0),
li AS (SELECT pos, want, klass, ln(prior)+CASE WHEN dn>0 THEN ln(dn) ELSE 0 END+ln((f+2*prior)/(nk+2)) AS lk FROM (SELECT *, exp(-power(h-t/greatest(nk,1),2)/z)/sqrt(pi()*z) AS dn FROM pz)),
pq AS MATERIALIZED (SELECT pos, want, klass AS got, mx AS lk FROM (SELECT *, max(lk) OVER (PARTITION BY pos) AS mx, row_number() OVER (PARTITION BY pos ORDER BY round(-lk,9), klass) r FROM li) WHERE r=1)"""
PREQ = f"{BAYES} SELECT pos, want, got, round(lk+1e-9,4) AS \"like\" FROM pq"
CONFUSION = f"{BAYES}, kl AS (SELECT want AS klass FROM pq UNION SELECT got FROM pq), cf AS (SELECT klass, count(*) FILTER (want<>klass AND got<>klass) AS tn, count(*) FILTER (want=klass AND got<>klass) AS fn, count(*) FILTER (want<>klass AND got=klass) AS fp, count(*) FILTER (want=klass AND got=klass) AS tp FROM pq, kl GROUP BY klass) SELECT klass, tn, fn, fp, tp, round((tn+tp)/(tn+fn+fp+tp)+1e-9,6) AS acc, round(tp/greatest(1,tp+fn)+1e-9,6) AS pd, round(fp/greatest(1,fp+tn)+1e-9,6) AS pf FROM cf"
ACCURACY = f"{BAYES} SELECT round(avg(CASE WHEN want=got THEN 1.0 ELSE 0 END)+1e-9,6) AS acc FROM pq"


def kmeans(k: int, iters: int, seed: str = "1") -> str:
    out = [OC, f"k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o, rid)-1 AS cluster, v, a, b, c FROM (SELECT *, md5('{seed}:'||rid) AS o FROM oc ORDER BY o, rid LIMIT {k}))"]
    for i in range(iters + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT rid, v, a, b, c, cluster, d FROM (SELECT t.rid, t.v, t.a, t.b, t.c, p.cluster, round({dist('t', 'p')},9) AS d, row_number() OVER (PARTITION BY t.rid ORDER BY round({dist('t', 'p')},9), p.cluster) r FROM oc t, k{i} p) WHERE r=1)")
        if i < iters:
            mode = lambda s: f"(SELECT cluster, {s} FROM (SELECT cluster, {s}, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {s}) r FROM a{i} GROUP BY cluster, {s}) WHERE r=1) m{s}"
            out.append(f"k{i + 1} AS MATERIALIZED (SELECT g.cluster, g.v, ma.a, mb.b, mc.c FROM (SELECT cluster, avg(v) AS v FROM a{i} GROUP BY cluster) g " + " ".join(f"JOIN {mode(s)} ON m{s}.cluster=g.cluster" for s in "abc") + ")")
    return f"WITH {', '.join(out)} SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(avg(d)+1e-9,6) AS d FROM a{iters} GROUP BY cluster"


def seeds(k: int, few: int = 32, seed: str = "1") -> str:
    out = [OC, f"z0 AS MATERIALIZED (SELECT arg_min(rid, md5('{seed}:'||rid)) AS rid FROM oc)"]
    for i in range(1, k):
        pool = f"(SELECT * FROM oc ORDER BY md5('{seed}.{i}:'||rid), rid LIMIT {few})"
        out.append(f"y{i} AS MATERIALIZED (SELECT * FROM oc WHERE rid IN ({' UNION ALL '.join(f'SELECT rid FROM z{j}' for j in range(i))}))")
        out.append(f"p{i} AS MATERIALIZED (SELECT oc.*, w FROM oc JOIN (SELECT t.rid, round(power(min({dist('t', 'y')}),2),9) AS w FROM {pool} t, y{i} y GROUP BY t.rid) USING (rid))")
        out.append(f"q{i} AS MATERIALIZED (SELECT *, sum(w) OVER (ORDER BY rid) AS upto, sum(w) OVER () AS total FROM p{i})")
        u = f"(CAST(('0x'||substr(md5('{seed}:{i}'),1,8)) AS BIGINT)/4294967296.0)"
        out.append(f"z{i} AS MATERIALIZED (SELECT min(rid) AS rid FROM q{i} WHERE {u}*total-upto<=1e-12)")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT {i} AS i, rid FROM z{i}" for i in range(k))


def grid(bins: int = 4) -> str:
    cut = lambda d: ", ".join(f"max(p{d}) FILTER (r{d}=CAST(floor({i}*n/{bins}.0+1e-9) AS BIGINT)) AS c{d}{i}" for i in range(1, bins))
    code = lambda d: "(" + "+".join(f"CAST(p{d}>c{d}{i} AS INT)" for i in range(1, bins)) + ")"
    return f"WITH {OC}, {poles('0', '1.0')}, {poles('1', '1.1')}, att AS MATERIALIZED (SELECT oc.rid, round({line('oc', 'e0', 'w0')},9) AS p0, round({line('oc', 'e1', 'w1')},9) AS p1 FROM oc, e0, w0, e1, w1), o AS (SELECT *, row_number() OVER (ORDER BY p0)-1 AS r0, row_number() OVER (ORDER BY p1)-1 AS r1, count(*) OVER () AS n FROM att), k AS (SELECT {cut(0)}, {cut(1)} FROM o) SELECT {code(0)}*{bins}+{code(1)} AS bucket, count(*) AS n FROM att, k GROUP BY 1"


LIVE = """WITH t AS (SELECT user_id % 8 AS b, event_id, CAST(hour(ts) AS DOUBLE) AS h, value FROM events),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY md5('1:'||event_id), event_id) r FROM t) WHERE r<=64),
c AS (SELECT att, b, v, count(*) AS n FROM (SELECT 'Hour' AS att, b, h AS v FROM kept UNION ALL SELECT 'Value', b, value FROM kept) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT att, v, sum(n) AS n FROM c GROUP BY 1, 2), w AS (SELECT att, v, sum(n) OVER (PARTITION BY att ORDER BY v)/sum(n) OVER (PARTITION BY att) AS g, (sum(n) OVER (PARTITION BY att ORDER BY v)-n)/sum(n) OVER (PARTITION BY att) AS g0 FROM g),
o AS (SELECT att, v, n, sum(n) OVER (PARTITION BY att, b ORDER BY v) AS u, sum(n) OVER (PARTITION BY att, b) AS t FROM c)
SELECT att AS at, round(max(greatest(abs(u/t-g), abs((u-n)/t-g0)))+1e-9,6) AS gap FROM o JOIN w USING (att, v) WHERE t>=4 GROUP BY att HAVING max(greatest(abs(u/t-g), abs((u-n)/t-g0)))>=0.05"""


def dtlz() -> str:
    """All seven benchmark functions of two objectives over six hashed inputs, from their published definitions."""
    u = lambda j: f"(CAST(('0x'||substr(md5('1.{j}:'||i),1,8)) AS BIGINT)/4294967296.0)"
    rest = [f"x{j}" for j in range(2, 7)]
    sq = "+".join(f"power({x}-0.5,2)" for x in rest)
    rast = "100*(5+" + "+".join(f"power({x}-0.5,2)-cos(20*pi()*({x}-0.5))" for x in rest) + ")"
    root = "+".join(f"power({x},0.1)" for x in rest)
    g7 = "1+9*(" + "+".join(rest) + ")/5"
    f = {1: ("0.5*x1*(1+gr)", "0.5*(1-x1)*(1+gr)"), 7: ("x1", "(1+g7)*(2-x1/(1+g7)*(1+sin(3*pi()*x1)))")}
    for n, g, theta in ((2, "gs", "x1"), (3, "gr", "x1"), (4, "gs", "power(x1,100)"), (5, "gs", "x1"), (6, "gp", "x1")):
        f[n] = (f"(1+{g})*cos({theta}*pi()/2)", f"(1+{g})*sin({theta}*pi()/2)")
    out = ", ".join(f"round({e}+1e-9,6) AS f{n}_{i}" for n in range(1, 8) for i, e in enumerate(f[n]))
    return f"WITH x AS (SELECT i AS rid, {', '.join(f'{u(j)} AS x{j}' for j in range(1, 7))} FROM (SELECT p_partkey AS i FROM part)), g AS (SELECT *, {sq} AS gs, {rast} AS gr, {root} AS gp, {g7} AS g7 FROM x) SELECT rid, {out} FROM g"


#: Coded documents: number v, symbols lang, source, quality (often unknown).
DOCS = f"t AS (SELECT doc_id AS rid, CAST(n_chars AS DOUBLE) n, lang, source, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id)), sd AS (SELECT avg(n) m, stddev_samp(n) s FROM t), dc AS MATERIALIZED (SELECT rid, n, {LOG.format(v='n', m='m', s='s')} v, lang, source, quality FROM t, sd)"


def doc_dist(p: str, q: str) -> str:
    same = lambda c: f"CASE WHEN {p}.{c}={q}.{c} THEN 0 ELSE 1 END"
    return f"sqrt((power({p}.v-{q}.v,2)+{same('lang')}+{same('source')}+{same('quality')})/4)"


PAIR_MEAN = f"WITH {DOCS}, f AS MATERIALIZED (SELECT * FROM dc ORDER BY md5('1:'||rid), rid LIMIT 64) SELECT round(avg({doc_dist('x', 'z')})+1e-9,6) AS eps FROM f x JOIN f z ON x.rid<z.rid"


def delegates(eps: float, most: int) -> str:
    """Furthest-point cover, unrolled `most` times; turns after the cover is complete do nothing."""
    out = [DOCS, "d0 AS MATERIALIZED (SELECT * FROM dc ORDER BY md5('1:'||rid), rid LIMIT 1)", f"m0 AS MATERIALIZED (SELECT dc.*, {doc_dist('dc', 'd0')} AS d, d0.rid AS kin FROM dc, d0)"]
    for i in range(1, most):
        out.append(f"d{i} AS MATERIALIZED (SELECT * FROM m{i - 1} WHERE d>={eps} ORDER BY round(d,9) DESC, rid LIMIT 1)")
        far = doc_dist(f"m{i - 1}", f"d{i}")
        out.append(f"m{i} AS MATERIALIZED (SELECT m{i - 1}.* EXCLUDE (d, kin), CASE WHEN d{i}.rid IS NULL OR {far}>m{i - 1}.d OR ({far}=m{i - 1}.d AND m{i - 1}.kin<=d{i}.rid) THEN m{i - 1}.d ELSE {far} END AS d, CASE WHEN d{i}.rid IS NULL OR {far}>m{i - 1}.d OR ({far}=m{i - 1}.d AND m{i - 1}.kin<=d{i}.rid) THEN m{i - 1}.kin ELSE d{i}.rid END AS kin FROM m{i - 1} LEFT JOIN d{i} ON TRUE)")
    return f"WITH {', '.join(out)} SELECT kin, count(*) AS n, round(max(d)+1e-9,6) AS far FROM m{most - 1} GROUP BY kin"


BINNED = "WITH c AS (SELECT l_quantity v, count(*) n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1), u AS (SELECT v, sum(n) OVER (ORDER BY v) u, sum(n) OVER () t FROM c), k AS (SELECT " + ", ".join(f"min(CASE WHEN u>CAST(floor({i / 5}*t+1e-9) AS BIGINT) THEN v END) k{i}" for i in range(1, 5)) + " FROM u) SELECT 1+" + "+".join(f"CAST(l_quantity>k{i} AS INT)" for i in range(1, 5)) + " AS \"L_quantity\", count(*) AS n FROM lineitem, k GROUP BY 1"

SQL = {
    "q16_project": PROJECT,
    "q17_halve": HALVE,
    "q18_nodes": nodes(3),
    "q21_best_split": BEST,
    "q22_tree": TREE,
    "q23_tree_predict": PREDICT,
    "q25_rule_step": STEP,
    "q26_rule": RULE,
    "q26_rule_matches": MATCHES,
    "q28_frugal_tree": frugal(3),
    "q29_prunings": PRUNE,
    "q34_same": SAME,
    "q35_ranks": RANKS,
    "q36_preq_bayes": PREQ,
    "q37_confusion": CONFUSION,
    "q38_accuracy": ACCURACY,
    "q39_kmeans": kmeans(5, 2),
    "q40_kpp_seeds": seeds(4),
    "q41_pole_grid": grid(),
    "q43_live_columns": LIVE,
    "q52_dtlz_all": dtlz(),
    "q65_delegates": delegates(0.8, 14),
    "q66_pair_mean": PAIR_MEAN,
    "q70_binned": BINNED,
}
