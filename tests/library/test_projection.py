"""Projection by lists against plain Python, and traversal and analytics over lists against the same over rows of edges."""

import random
from collections import Counter
from itertools import combinations

import pytest
from loomgraph.operators import analytics as A
from loomgraph.operators import projection as P
from loomgraph.operators import relational as R
from loomgraph.operators import traverse as T
from loomgraph.operators.components import connected_components
from loomgraph.storage import kept, materialize, stored
from pyspark.sql import functions as F


def met(rows):
    members = {}
    for x, v in rows:
        if x is not None and v is not None:
            members.setdefault(v, set()).add(x)
    return Counter(p for m in members.values() for p in combinations(sorted(m), 2))


def table(spark, rows):
    return spark.createDataFrame(rows, "x long, v long")


def drawn(seed, n, sides, vias):
    rng = random.Random(seed)
    return [(rng.choice(sides), rng.choice(vias)) for _ in range(n)]


ODD = {
    "even": drawn(1, 400, range(40), range(30)),
    "repeated rows and nulls": drawn(2, 200, range(12), range(20)) * 3 + [(None, 1), (2, None), (None, None)],
    "one hub": [(i, 0) for i in range(700)] + drawn(3, 100, range(700), range(1, 30)),
    "wide keys": drawn(4, 200, [-(2**63), -(2**40), -1, 0, 1, 255, 256, 2**24, 2**40, 2**63 - 1], [-(2**63), 0, 7, 2**63 - 1, 5, 6]),
    "no meeting": [(i, i) for i in range(5)],
    "empty": [],
}


@pytest.mark.parametrize("kind, heavy", [(k, 4096) for k in ODD] + [("one hub", 5), ("repeated rows and nulls", 5)])
def test_pairs_met(spark, kind, heavy, monkeypatch):
    monkeypatch.setattr(P, "HEAVY", heavy)
    rows, want = ODD[kind], met(ODD[kind])
    assert {(r.a, r.b): r.w for r in T.project_bipartite(table(spark, rows), "x", "v").collect()} == want
    links = P.links_met(table(spark, rows), "x", "v")
    got = links.select("src", F.explode(F.arrays_zip("dst", "w")).alias("e")).select("src", "e.dst", "e.w").collect()
    assert Counter({(r.src, r.dst): r.w for r in got}) == want + Counter({(b, a): w for (a, b), w in want.items()}) and len(got) == 2 * len(want)
    assert all(list(r.dst) == sorted(r.dst) and len(r.dst) <= P.ROW for r in links.collect())


def test_no_row_for_a_meeting(spark):
    """The projection of whole numbers makes no join, and its second step has as many tasks as its meetings need."""
    plan = T.project_bipartite(table(spark, ODD["even"]), "x", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("share", [0.0, 0.85])
def test_heaviest(spark, share):
    rows = ODD["even"]
    w = sorted(met(rows).values())
    at = (len(w) - 1) * share
    cut = w[int(at)] + (at - int(at)) * (w[min(int(at) + 1, len(w) - 1)] - w[int(at)])
    got = P.heaviest(P.links_met(table(spark, rows), "x", "v"), share)
    assert {(r.src, d) for r in got.collect() for d in r.dst} == {q for p, n in met(rows).items() if n >= cut for q in (p, p[::-1])}


@pytest.fixture(scope="module")
def both(spark):
    """The same graph as lists (a hub of 700 among them, whose rows lie apart in the second table) and as rows of edges."""
    rows = drawn(5, 150, range(60), range(90)) + [(i, 1000 + i) for i in range(100, 800)] + [(5, 1000 + i) for i in range(100, 800)]
    links = P.links_met(table(spark, rows), "x", "v")
    apart = materialize(links.withColumn("parts", F.lit(0).cast("long")).repartition(3), "apart")
    edges = materialize(links.select("src", F.explode("dst").alias("dst")), "rows")
    return links, apart, edges


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_lists_apart(spark, both):
    for f in (T.adjacency, lambda e: A.label_propagation(e, 3)):
        assert same(f(both[1]), f(both[2]))


def test_lists_as_rows(spark, both):
    lists, _, edges = both
    starts = edges.agg(F.min("src").alias("node"))
    for f in (
        T.adjacency,
        T.csr,
        lambda e: T.bfs(e, starts, 5),
        lambda e: T.bfs_relabel(e, 0, 5),
        lambda e: T.shortest_path(e, 0, 150, 6),
        lambda e: T.bidirectional_distance(e, 0, 150, 6).select("distance"),
        lambda e: T.all_shortest_paths(e, 0, 150, 6),
        lambda e: R.walk_endpoints(e, F.col("src") == 0, 3),
        lambda e: A.eigenvector(e, 3).select("node", F.round("score", 7)),
        lambda e: A.modularity(e, edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node") % 4)).select(F.round("q", 9)),
        lambda e: A.label_propagation(e, 4),
        lambda e: connected_components(T.edge_rows(e), "src", "dst", unique=True),
    ):
        assert same(f(lists), f(edges))


def test_search_stops_at_the_goal(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert {(r.node, r.hop) for r in T.bfs(e, spark.range(1).withColumnRenamed("id", "node"), 6, goal=2).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_votes_of_far_nodes(spark):
    """Numbers with gaps, and neighbours without a label."""
    links = spark.createDataFrame([(10**12, [5, 7, 10**15], [1, 1, 1], 1), (5, [7, 10**12], [1, 1], 1), (7, [5], [1], 1)], P.LINKS)
    want = A.label_propagation(T.edge_rows(links), 3)
    assert same(A.label_propagation(links, 3), want) and want.count() == 3


def test_least_path_by_order(spark):
    e = spark.createDataFrame([("s", "b"), ("s", "a"), ("a", "y"), ("b", "x"), ("y", "t"), ("x", "t"), ("s", "z")], "src string, dst string")
    row = T.shortest_path(e, "s", "t", 5).first()
    assert list(row.path) == ["s", "a", "y", "t"] and row.visited == 7
    assert T.shortest_path(e, "t", "s", 5).count() == 0
    assert {tuple(r.path) for r in T.all_shortest_paths(e, "s", "t", 5).collect()} == {("s", "a", "y", "t"), ("s", "b", "x", "t")}
    assert {tuple(r.path) for r in T.all_shortest_paths(e, "s", "s", 5).collect()} == {("s",)}


def test_stored_once(spark):
    """What lies in an intermediate table is read, not written again; a join or an aggregate is written."""
    e = materialize(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), "rows")
    assert stored(e) and stored(e.select("dst").where("dst > 2")) and kept(e) is e
    assert not stored(e.distinct()) and not stored(e.join(e.select(F.col("src").alias("dst")), "dst")) and not stored(spark.range(3))
