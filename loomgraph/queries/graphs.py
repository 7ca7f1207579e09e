"""Traversal and analytics over graphs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import analytics as A
from loomgraph.operators import models as M
from loomgraph.operators import traverse as T
from loomgraph.operators.components import connected_components
from loomgraph.queries.base import SQL_COPART, SQL_CUSTOMER_PART, SQL_NATIONS, SQL_SUPPLIERS, copart_weights, g_customer_part, g_nations, g_suppliers, query, supplier_edges, supplier_links, t


def start_of(spark, edges):
    return edges.agg(F.min("src").alias("node"))


def sql_bfs(hops: int) -> str:
    """Levels of a breadth-first search over g2u from its smallest node, as chained CTEs."""
    out = ["b0 AS (SELECT min(src) AS node, 0 AS hop FROM g2u)", "s0 AS (SELECT * FROM b0)"]
    for k in range(1, hops + 1):
        out.append(f"b{k} AS (SELECT DISTINCT dst AS node, {k} AS hop FROM b{k - 1} JOIN g2u ON src = node WHERE dst NOT IN (SELECT node FROM s{k - 1}))")
        out.append(f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM b{k})")
    return ", ".join(out)


@query(f"WITH {SQL_COPART} SELECT node, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT a AS node, w FROM cw UNION ALL SELECT b, w FROM cw) GROUP BY 1")
def coparts_degree(spark, d):
    return T.projected_degree(t(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey")


@query(f"WITH {SQL_COPART} SELECT a, b, w FROM cw")
def bipartite_projection(spark, d):
    return copart_weights(spark, d)


@query("WITH k AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS pairs FROM k")
def projection_size(spark, d):
    return T.projection_size(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("via")).distinct(), "x", "via")


@query(f"WITH {SQL_SUPPLIERS} SELECT src AS node, array_to_string(list_sort(list(DISTINCT dst)), ',') AS nbrs FROM g2u GROUP BY 1")
def adjacency(spark, d):
    return T.adjacency(supplier_links(spark, d)).select("node", F.array_join("nbrs", ",").alias("nbrs"))


@query(f"WITH {SQL_SUPPLIERS}, k AS (SELECT src AS node, count(*) AS degree FROM g2u GROUP BY 1) SELECT node, CAST(sum(degree) OVER (ORDER BY node) - degree AS BIGINT) AS start, degree FROM k")
def csr_layout(spark, d):
    return T.csr(supplier_links(spark, d))


@query(f"WITH {SQL_CUSTOMER_PART} SELECT p FROM g1 WHERE c = 7")
def neighbour_lookup(spark, d):
    return g_customer_part(spark, d).where("c = 7").select("p")


@query(f"WITH {SQL_SUPPLIERS}, {sql_bfs(6)} SELECT hop, count(*) AS new, CAST(sum(count(*)) OVER (ORDER BY hop) AS BIGINT) AS reached FROM s6 GROUP BY hop")
def bfs_levels(spark, d):
    e = supplier_links(spark, d)
    return T.bfs_levels(e, start_of(spark, e), 6)


@query(f"WITH {SQL_SUPPLIERS}, {sql_bfs(2)} SELECT count(*) AS at_two_hops FROM b2")
def k_hop_frontier(spark, d):
    e = supplier_links(spark, d)
    return T.bfs(e, start_of(spark, e), 2).where("hop = 2").agg(F.count("*").alias("at_two_hops"))


@query(f"""WITH RECURSIVE {SQL_NATIONS}, r(node, depth) AS (SELECT min(src), 0 FROM g3 UNION SELECT g3.dst, r.depth + 1 FROM r JOIN g3 ON g3.src = r.node WHERE r.depth < 3) SELECT depth, count(*) AS nodes FROM r GROUP BY 1""")
def recursive_reach(spark, d):
    e = g_nations(spark, d).select("src", "dst")
    return T.walk_depths(e, start_of(spark, e), 3).groupBy("depth").agg(F.count("*").alias("nodes"))


@query(f"WITH {SQL_SUPPLIERS}, {sql_bfs(6)} SELECT CAST(max(hop) AS INTEGER) AS length FROM s6 WHERE node = (SELECT max(src) FROM g2u)")
def shortest_path(spark, d):
    e = supplier_links(spark, d)
    a, b = e.agg(F.min("src"), F.max("src")).first()
    return T.shortest_path(e, a, b, 6).select((F.size("path") - 1).alias("length"))


@query(f"WITH {SQL_SUPPLIERS}, {sql_bfs(6)} SELECT CAST(max(hop) AS INTEGER) AS distance FROM s6 WHERE node = (SELECT max(src) FROM g2u)")
def bidirectional_search(spark, d):
    e = supplier_links(spark, d)
    a, b = e.agg(F.min("src"), F.max("src")).first()
    return T.bidirectional_distance(e, a, b, 6).select("distance")


@query("SELECT conv_id * 1000 + turn AS node, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS layer FROM conversations")
def topological_layers(spark, d):
    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn")
    from pyspark.sql import Window

    dep = F.lag("node").over(Window.partitionBy("conv_id").orderBy("turn"))
    deps = c.withColumn("dep", dep).where("dep is not null").select("node", "dep")
    return T.topological_layers(c, deps)


@query("SELECT conv_id, CAST(max(total) AS BIGINT) AS critical FROM (SELECT conv_id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations) GROUP BY 1")
def critical_path(spark, d):
    from pyspark.sql import Window

    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn", F.length("text").cast("long").alias("cost"))
    deps = c.withColumn("dep", F.lag("node").over(Window.partitionBy("conv_id").orderBy("turn"))).where("dep is not null").select("node", "dep")
    total = T.longest_cost(c.select("node", "cost"), deps)
    return total.groupBy(F.floor(F.col("node") / 1000).alias("conv_id")).agg(F.max("total").alias("critical"))


def sql_relax(rounds: int, weight: str, both: bool = False) -> str:
    edges = f"SELECT src, dst, min({weight}) AS w FROM g3 GROUP BY 1, 2"
    if both:
        edges = f"SELECT src, dst, min(w) AS w FROM (SELECT src, dst, {weight} AS w FROM g3 UNION ALL SELECT dst, src, {weight} FROM g3) GROUP BY 1, 2"
    out = [f"e AS ({edges})", "d0 AS (SELECT min(src) AS node, CAST(0 AS DOUBLE) AS dist FROM g3)"]
    for k in range(1, rounds + 1):
        out.append(f"d{k} AS (SELECT node, min(dist) AS dist FROM (SELECT * FROM d{k - 1} UNION ALL SELECT e.dst, dist + e.w FROM d{k - 1} JOIN e ON e.src = node) GROUP BY 1)")
    return ", ".join(out)


@query(f"WITH {SQL_NATIONS}, {sql_relax(12, '1.0 / w', True)} SELECT node, round(dist, 9) AS dist FROM d12")
def dijkstra_strength(spark, d):
    """Weights read as strength: distance 1 / w, undirected."""
    e = g_nations(spark, d)
    first = e.agg(F.min("src")).first()[0]
    return T.shortest_distances(e, first, 30, directed=False, weight=1.0 / F.col("w")).select("node", F.round("dist", 9).alias("dist"))


@query(f"WITH {SQL_NATIONS}, {sql_relax(12, 'w')} SELECT node, round(dist, 9) AS dist FROM d12")
def bellman_ford(spark, d):
    e = g_nations(spark, d)
    first = e.agg(F.min("src")).first()[0]
    return T.shortest_distances(e, first, 30).select("node", F.round("dist", 9).alias("dist"))


@query(f"""WITH RECURSIVE {SQL_NATIONS}, dag AS (SELECT src, dst FROM g3 WHERE src < dst), lo AS (SELECT min(src) AS s FROM dag),
r(node, n, depth) AS (SELECT s, CAST(1 AS HUGEINT), 0 FROM lo UNION ALL SELECT dag.dst, sum(r.n), r.depth + 1 FROM r JOIN dag ON dag.src = r.node WHERE r.depth < 25 GROUP BY dag.dst, r.depth)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS paths FROM r WHERE node = (SELECT max(dst) FROM dag)""")
def count_paths(spark, d):
    e = g_nations(spark, d).where("src < dst").select("src", "dst")
    a, b = e.agg(F.min("src"), F.max("dst")).first()
    return T.count_paths(e, a, b, 25)


@query(f"""WITH {SQL_SUPPLIERS}, {sql_bfs(3)}, goal AS (SELECT max(src) AS g FROM g2u), h AS (SELECT hop FROM s3, goal WHERE node = g)
SELECT CASE WHEN (SELECT hop FROM h) = 1 THEN 1 WHEN (SELECT hop FROM h) = 2 THEN (SELECT count(*) FROM s3 a JOIN g2u e ON e.src = a.node, goal WHERE a.hop = 1 AND e.dst = g)
ELSE (SELECT count(*) FROM s3 a JOIN g2u e ON e.src = a.node AND a.hop = 1 JOIN s3 b ON b.node = e.dst AND b.hop = 2 JOIN g2u f ON f.src = b.node, goal WHERE f.dst = g) END AS paths""")
def all_shortest_paths(spark, d):
    e = supplier_links(spark, d)
    a, b = e.agg(F.min("src"), F.max("src")).first()
    return T.all_shortest_paths(e, a, b, 3).agg(F.count("*").alias("paths"))


@query("""WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS a, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), r(a, b) AS (SELECT a, b FROM p WHERE b IS NOT NULL UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b WHERE p.b IS NOT NULL) SELECT a, b FROM r""")
def transitive_closure(spark, d):
    from pyspark.sql import Window

    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), "conv_id", "turn")
    return T.closure(c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null").select("a", "b"))


@query("""WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS child, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations), s AS (SELECT max(child) AS c FROM p),
r(depth, node) AS (SELECT 1, parent FROM p, s WHERE child = c UNION ALL SELECT depth + 1, p.parent FROM r JOIN p ON p.child = r.node WHERE p.parent IS NOT NULL) SELECT CAST(depth AS INTEGER) AS depth, node FROM r""")
def chain_to_root(spark, d):
    from pyspark.sql import Window

    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("child"), "conv_id", "turn")
    parents = c.withColumn("parent", F.lag("child").over(Window.partitionBy("conv_id").orderBy("turn"))).where("parent is not null").select("child", "parent")
    return T.chain_to_root(parents, c.agg(F.max("child")).first()[0])


@query(f"""WITH RECURSIVE {SQL_NATIONS}, ag(n) AS (SELECT min(src) FROM g3 UNION SELECT dst FROM g3 JOIN ag ON src = n), u AS (SELECT DISTINCT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey IN (SELECT n FROM ag))
SELECT (SELECT count(*) FROM ag) AS agents, count(*) AS resources, CAST(sum(CAST(floor(s_acctbal) AS BIGINT)) AS BIGINT) AS score FROM u""")
def blast_radius(spark, d):
    e = g_nations(spark, d).select("src", "dst")
    s = t(spark, d, "supplier")
    uses = s.select(F.col("s_nationkey").cast("long").alias("agent"), F.col("s_suppkey").alias("resource"))
    values = s.select(F.col("s_suppkey").alias("resource"), F.floor("s_acctbal").cast("long").alias("value"))
    return T.blast_radius(e, uses, values, e.agg(F.min("src")).first()[0], 25).select("agents", "resources", "score")


@query(f"WITH {SQL_SUPPLIERS} SELECT round(avg(abs(src - dst)), 9) AS locality FROM g2u")
def edge_locality(spark, d):
    return T.locality(supplier_edges(spark, d)).select(F.round("locality", 9).alias("locality"))


@query(f"WITH {SQL_SUPPLIERS}, {sql_bfs(6)} SELECT node, row_number() OVER (ORDER BY hop, node) - 1 AS label FROM s6")
def bfs_relabel(spark, d):
    e = supplier_links(spark, d)
    return T.bfs_relabel(e, e.agg(F.min("src")).first()[0], 6)


@query(f"""WITH RECURSIVE {SQL_SUPPLIERS}, r(node, seen) AS (SELECT DISTINCT src, src FROM g2u UNION SELECT r.node, g2u.dst FROM r JOIN g2u ON g2u.src = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def components(spark, d):
    return connected_components(g_suppliers(spark, d), unique=True)


# ANA ----------------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_SUPPLIERS}, k AS (SELECT src AS node, count(*) AS n FROM g2u GROUP BY 1) SELECT node, round(n / (SELECT count(*) - 1 FROM k), 9) AS score FROM k")
def degree_centrality(spark, d):
    return A.degree_centrality(supplier_edges(spark, d)).select("node", F.round("score", 9).alias("score"))


def sql_pairs(hops: int) -> str:
    """All-pairs hops over the undirected nation graph as chained CTEs with path counts."""
    out = ["u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM g3 UNION ALL SELECT dst, src FROM g3))", "p0 AS (SELECT DISTINCT src AS source, src AS node, 0 AS hop, CAST(1 AS DOUBLE) AS sigma FROM u)", "q0 AS (SELECT * FROM p0)"]
    for k in range(1, hops + 1):
        out.append(f"p{k} AS (SELECT source, u.dst AS node, {k} AS hop, sum(sigma) AS sigma FROM p{k - 1} p JOIN u ON u.src = p.node WHERE NOT EXISTS (SELECT 1 FROM q{k - 1} q WHERE q.source = p.source AND q.node = u.dst) GROUP BY 1, 2)")
        out.append(f"q{k} AS (SELECT * FROM q{k - 1} UNION ALL SELECT * FROM p{k})")
    return ", ".join(out)


def nations_both(spark, d):
    return T.undirected(g_nations(spark, d))


@query(f"WITH {SQL_NATIONS}, {sql_pairs(6)} SELECT source AS node, round(coalesce((count(*) - 1) / nullif(sum(hop), 0), 0), 9) AS score FROM q6 GROUP BY 1")
def closeness(spark, d):
    e = nations_both(spark, d)
    return A.closeness(e, e.select(F.col("src").alias("node")).distinct(), 6).select("node", F.round("score", 9).alias("score"))


@query(f"""WITH {SQL_NATIONS}, {sql_pairs(6)}, n AS (SELECT DISTINCT src AS node FROM u),
b AS (SELECT v.node, sum(sv.sigma * vt.sigma / st.sigma) AS score FROM q6 st JOIN q6 sv ON sv.source = st.source JOIN q6 vt ON vt.source = sv.node AND vt.node = st.node JOIN n v ON v.node = sv.node
WHERE st.source <> st.node AND v.node <> st.source AND v.node <> st.node AND sv.hop + vt.hop = st.hop GROUP BY 1)
SELECT n.node, round(coalesce(score, 0), 6) AS score FROM n LEFT JOIN b ON n.node = b.node""")
def betweenness(spark, d):
    e = nations_both(spark, d)
    return A.betweenness(e, e.select(F.col("src").alias("node")).distinct(), 6).select("node", F.round("score", 6).alias("score"))


def sql_eigen(rounds: int) -> str:
    out = ["x0 AS (SELECT DISTINCT src AS node, CAST(1 AS DOUBLE) AS s FROM g2u)"]
    for k in range(1, rounds + 1):
        out.append(f"y{k} AS (SELECT src AS node, sum(s) AS s FROM g2u JOIN x{k - 1} ON dst = node GROUP BY 1)")
        out.append(f"x{k} AS (SELECT node, s / (SELECT max(s) FROM y{k}) AS s FROM y{k})")
    return ", ".join(out)


@query(f"WITH {SQL_SUPPLIERS}, {sql_eigen(5)} SELECT node, round(s, 7) AS score FROM x5")
def eigenvector(spark, d):
    e = supplier_links(spark, d)
    return A.eigenvector(e, rounds=5).select("node", F.round("score", 7).alias("score"))


def sql_pagerank(rounds: int) -> str:
    out = ["nd AS (SELECT src AS node FROM g3 UNION SELECT dst FROM g3)", "c AS (SELECT count(*) AS n FROM nd)", "od AS (SELECT src, count(*) AS o FROM g3 GROUP BY 1)", "r0 AS (SELECT node, 1.0 / n AS s FROM nd, c)"]
    for k in range(1, rounds + 1):
        out.append(f"""r{k} AS (SELECT nd.node, 0.15 / n + 0.85 * (coalesce(i.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM od)) / n) AS s
            FROM nd CROSS JOIN c LEFT JOIN (SELECT dst AS node, sum(s / o) AS s FROM g3 JOIN od USING (src) JOIN r{k - 1} r ON r.node = g3.src GROUP BY 1) i ON i.node = nd.node)""")
    return ", ".join(out)


@query(f"WITH {SQL_NATIONS}, {sql_pagerank(8)} SELECT node, round(s, 9) AS score FROM r8")
def pagerank(spark, d):
    return A.pagerank(g_nations(spark, d), rounds=8, tolerance=0.0).select("node", F.round("score", 9).alias("score"))


def sql_labels(rounds: int) -> str:
    out = ["l0 AS (SELECT DISTINCT src AS node, src AS label FROM g2u)"]
    for k in range(1, rounds + 1):
        out.append(f"l{k} AS (SELECT node, label FROM (SELECT g.src AS node, l.label, row_number() OVER (PARTITION BY g.src ORDER BY count(*) DESC, l.label) AS n FROM g2u g JOIN l{k - 1} l ON l.node = g.dst GROUP BY 1, 2) WHERE n = 1)")
    return ", ".join(out)


@query(f"WITH {SQL_SUPPLIERS}, {sql_labels(4)} SELECT node, label FROM l4")
def label_propagation(spark, d):
    return A.label_propagation(supplier_links(spark, d), rounds=4)


@query(f"""WITH {SQL_SUPPLIERS}, m AS (SELECT count(*) AS m2 FROM g2u), p AS (SELECT src % 4 AS label, count(*) FILTER (src % 4 = dst % 4) AS inside, count(*) AS deg FROM g2u GROUP BY 1)
SELECT round(sum(inside / m2 - (deg / m2) ** 2), 9) AS q FROM p, m""")
def modularity(spark, d):
    e = supplier_links(spark, d)
    labels = e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node") % 4)
    return A.modularity(e, labels).select(F.round("q", 9).alias("q"))


def ring_of_cliques(spark, k: int, size: int):
    """k cliques of `size` nodes in a ring, both ways; by arithmetic on a range."""
    n = spark.range(k * size).select(F.col("id").alias("a"))
    clique = n.select("a", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j")).select("a", (F.col("a") - F.col("a") % size + F.col("j")).alias("b")).where("a < b")
    ring = spark.range(k).select((F.col("id") * size).alias("x"), (((F.col("id") + 1) % k) * size + 1).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    e = clique.union(ring)
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(e.select(F.col("b"), F.col("a")))


@query("SELECT * FROM (VALUES (4, 0.6071, 0.4286), (8, 0.7321, 0.6786), (16, 0.7946, 0.8036), (24, 0.8155, 0.8452), (32, 0.8259, 0.8661)) v(k, q_true, q_merged)")
def resolution_limit(spark, d):
    out = None
    for k in (4, 8, 16, 24, 32):
        e = ring_of_cliques(spark, k, 4)
        nodes = e.select(F.col("src").alias("node")).distinct()
        q = [A.modularity(e, nodes.withColumn("label", F.floor(F.col("node") / s))).select(F.round("q", 4).alias("q")).scalar() for s in (4, 8)]
        row = spark.range(1).select(F.lit(k).alias("k"), q[0].alias("q_true"), q[1].alias("q_merged"))
        out = row if out is None else out.union(row)
    return out


@query(f"""WITH {SQL_SUPPLIERS}, {sql_labels(2)}, tr AS (SELECT l_suppkey AS s, l_returnflag AS o FROM lineitem), c AS (SELECT label, o, count(*) AS n FROM tr JOIN l2 ON node = s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, o) AS r FROM c) SELECT label, (SELECT count(*) FROM l2 x WHERE x.label = r.label) AS members, string_agg(o || ' x' || n, ', ' ORDER BY r) AS causes FROM r WHERE r <= 3 GROUP BY label""")
def community_summary(spark, d):
    labels = A.label_propagation(supplier_links(spark, d), rounds=2)
    triples = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("o"))
    return A.community_summary(labels, triples)


@query(f"""WITH {SQL_NATIONS}, u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM g3 UNION ALL SELECT dst, src FROM g3)), k AS (SELECT src AS via, count(*) AS d FROM u GROUP BY 1)
SELECT x.dst AS a, y.dst AS b, count(*) AS common, round(sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END), 6) AS adamic_adar FROM u x JOIN u y ON x.src = y.src AND x.dst < y.dst JOIN k ON k.via = x.src
WHERE NOT EXISTS (SELECT 1 FROM u z WHERE z.src = x.dst AND z.dst = y.dst) GROUP BY 1, 2""")
def link_prediction(spark, d):
    return A.common_neighbours(nations_both(spark, d)).withColumn("adamic_adar", F.round("adamic_adar", 6))


@query(f"""WITH {SQL_NATIONS}, u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM g3 UNION ALL SELECT dst, src FROM g3)), f AS (SELECT DISTINCT src AS node, CAST(src AS DOUBLE) AS x, CAST(src % 3 AS DOUBLE) AS y FROM u)
SELECT f.node, round(0.5 * f.x + 0.5 * m.x, 3) AS x, round(0.5 * f.y + 0.5 * m.y, 3) AS y FROM f JOIN (SELECT u.src, avg(g.x) AS x, avg(g.y) AS y FROM u JOIN f g ON g.node = u.dst GROUP BY 1) m ON m.src = f.node""")
def message_passing(spark, d):
    e = nations_both(spark, d)
    f = e.select(F.col("src").alias("node")).distinct().select("node", F.array(F.col("node").cast("double"), (F.col("node") % 3).cast("double")).alias("feat"))
    return A.message_passing(f, e).select("node", F.col("feat")[0].alias("x"), F.col("feat")[1].alias("y"))


@query("""WITH k AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT l_orderkey, lines * supps * parts AS nested, least(lines * supps * parts, 100) AS budgeted FROM k""")
def nested_caps(spark, d):
    """Loops inside loops: their caps multiply, unless one budget holds for all."""
    k = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("supps"), F.count_distinct("l_partkey").alias("parts"))
    nested, budgeted = M.nested_calls([F.col("lines"), F.col("supps"), F.col("parts")], F.lit(100))
    return k.select("l_orderkey", nested.alias("nested"), budgeted.alias("budgeted"))


@query("SELECT n, n * (n - 1) // 2 AS mesh, n - 1 AS star, CAST(power(2, n) AS BIGINT) AS paths FROM (SELECT unnest(range(2, 21)) AS n)")
def message_counts(spark, d):
    return spark.range(2, 21).select(F.col("id").alias("n"), F.floor(F.col("id") * (F.col("id") - 1) / 2).alias("mesh"), (F.col("id") - 1).alias("star"), F.pow(F.lit(2), F.col("id")).cast("long").alias("paths"))


@query("""WITH c AS (SELECT user_id, list(DISTINCT event_type) AS caps FROM events GROUP BY 1), r AS (SELECT * FROM (VALUES ('leak', ['view', 'click']), ('fraud', ['purchase', 'error', 'signup'])) v(risk, need))
SELECT user_id, risk FROM c, r WHERE list_has_all(caps, need)""")
def risk_combinations(spark, d):
    caps = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("caps"))
    risks = F.array(F.struct(F.lit("leak").alias("risk"), F.array(F.lit("view"), F.lit("click")).alias("need")), F.struct(F.lit("fraud").alias("risk"), F.array(F.lit("purchase"), F.lit("error"), F.lit("signup")).alias("need")))
    return caps.select("user_id", F.explode(F.filter(risks, lambda r: F.size(F.array_except(r["need"], F.col("caps"))) == 0)).alias("r")).select("user_id", "r.risk")
