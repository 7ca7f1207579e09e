"""Small published examples with known answers: traversal, analytics, patterns."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.functions import scalars as S
from loomgraph.operators import analytics as A
from loomgraph.operators import traverse as T
from loomgraph.operators.components import connected_components
from loomgraph.plans import patterns as P
from loomgraph.sources import readers as R
from pyspark.sql import functions as F


def edges(spark, pairs):
    kind = "string" if isinstance(pairs[0][0], str) else "long"
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}" + (", w double" if len(pairs[0]) == 3 else ""))


def test_task_layers_and_cycle(spark):
    deps = [("api", "schema"), ("migration", "schema"), ("test", "api"), ("test", "data"), ("doc", "test"), ("test", "migration")]
    nodes = spark.createDataFrame([(n,) for n in ("schema", "data", "api", "migration", "test", "doc")], "node string")
    d = spark.createDataFrame(deps, "node string, dep string")
    got = {}
    for r in T.topological_layers(nodes, d).collect():
        got.setdefault(r.layer, set()).add(r.node)
    assert got == {0: {"schema", "data"}, 1: {"api", "migration"}, 2: {"test"}, 3: {"doc"}}
    with pytest.raises(T.CycleError):
        T.topological_layers(nodes, d.union(spark.createDataFrame([("schema", "doc")], d.schema)))


def test_bridges(spark):
    e = edges(spark, [("N", "A"), ("N", "A"), ("S", "A"), ("S", "A"), ("N", "B"), ("S", "B"), ("A", "B")])
    deg = e.select(F.col("src").alias("n")).union(e.select("dst")).groupBy("n").count()
    assert {r.n: r["count"] for r in deg.collect()} == {"N": 3, "S": 3, "A": 5, "B": 3}
    odd = deg.agg(F.count_if(F.col("count") % 2 == 1).alias("odd"))
    assert odd.select(S.euler_verdict(F.col("odd"))).first()[0] == "none"


def test_weights_read_two_ways(spark):
    e = edges(spark, [("A", "B", 8.0), ("B", "C", 8.0), ("A", "D", 3.0), ("D", "C", 3.0)])
    near = {r.node: r.dist for r in T.shortest_distances(e, "A", 10, directed=False).collect()}
    strong = {r.node: r.dist for r in T.shortest_distances(e, "A", 10, directed=False, weight=1.0 / F.col("w")).collect()}
    assert near["C"] == 6.0 and math.isclose(strong["C"], 0.25)


def test_negative_weights(spark):
    e = edges(spark, [("A", "B", 2.0), ("A", "C", 5.0), ("B", "D", 2.0), ("C", "B", -10.0)])
    got = {r.node: r.dist for r in T.shortest_distances(e, "A", 10).collect()}
    assert got == {"A": 0.0, "C": 5.0, "B": -5.0, "D": -3.0}
    with pytest.raises(ValueError):
        T.shortest_distances(e.union(spark.createDataFrame([("B", "C", 1.0)], e.schema)), "A", 10)


def test_grid_paths(spark):
    assert T.count_paths(R.grid_dag(spark, 20, 20), 0, 399, 40).first()[0] == math.comb(38, 19) == 35_345_263_800


def test_paths(spark):
    e = T.undirected(edges(spark, [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (6, 7)]))
    assert T.shortest_path(e, 1, 4).first()["path"] == [1, 5, 4]
    assert T.bidirectional_distance(e, 1, 4).first()["distance"] == 2
    assert T.shortest_path(e, 1, 7).collect() == [] and T.bidirectional_distance(e, 1, 7).collect() == []
    assert sorted(r.path for r in T.all_shortest_paths(e, 1, 3, 5).collect()) == [[1, 2, 3]]
    assert {r.node: r.hop for r in T.bfs(e, spark.createDataFrame([(1,)], "node long"), 9).collect()} == {1: 0, 2: 1, 5: 1, 3: 2, 4: 2}


def test_pagerank_mass(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (4, 5)])
    assert math.isclose(A.pagerank(e, rounds=60).agg(F.sum("score")).first()[0], 1.0, abs_tol=1e-9)
    assert A.pagerank(e, rounds=60, fix_sinks=False).agg(F.sum("score")).first()[0] < 0.999


def test_betweenness_and_closeness_of_a_path(spark):
    e = T.undirected(edges(spark, [(1, 2), (2, 3), (3, 4)]))
    nodes = e.select(F.col("src").alias("node")).distinct()
    assert {r.node: r.score for r in A.betweenness(e, nodes).collect()} == {1: 0.0, 2: 4.0, 3: 4.0, 4: 0.0}
    assert {r.node: r.score for r in A.closeness(e, nodes).collect()} == {1: 0.5, 2: 0.75, 3: 0.75, 4: 0.5}


def test_message_passing_layer(spark):
    e = T.undirected(edges(spark, [("A", "B"), ("C", "D")]))
    f = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0]), ("C", [0.0, 3.0]), ("D", [2.0, 1.0])], "node string, feat array<double>")
    assert {r.node: r.feat for r in A.message_passing(f, e).collect()}["D"] == [1.0, 2.0]


def test_greedy_modularity_finds_cliques(spark):
    e = T.undirected(edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]))
    assert {r.node: r.label for r in A.greedy_modularity(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_link_prediction(spark):
    e = T.undirected(edges(spark, [(1, 3), (2, 3), (1, 4), (2, 4), (4, 5)]))
    r = A.common_neighbours(e).where("a = 1 and b = 2").first()
    assert r.common == 2 and math.isclose(r.adamic_adar, 1 / math.log(2) + 1 / math.log(3))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=15))
def test_components_of_any_graph(spark, pairs):
    root = list(range(13))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_components_of_a_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(e)
    assert got.count() == 301 and got.where("component <> 0").isEmpty()


def test_projection_is_symmetric(spark):
    p = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), ("B", "y"), ("C", "x")], "user string, item string")
    assert {(r.a, r.b): r.w for r in T.project_bipartite(p, "user", "item").collect()} == {("A", "B"): 2, ("A", "C"): 1, ("B", "C"): 1}


SHOP = """@prefix : <http://example.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:gaon a :Company ; :name "Gaon" ; :parentOf :naru , :daol ; :founded "2001-05-01"^^xsd:date ; :size 12 .
:naru a :Company ; :parentOf :raon ; :note [ :text "x;y." ] .
"""


def test_turtle_and_sparql(spark):
    rows = R.parse_turtle(SHOP)
    assert (":gaon", ":founded", "2001-05-01", "literal", "xsd:date") in rows and (":gaon", ":size", "12", "literal", "xsd:integer") in rows
    assert len(rows) == 10
    tr = spark.createDataFrame([r[:3] for r in rows], "s string, p string, o string")
    got = P.sparql(tr, "PREFIX : <http://example.org/> SELECT ?a ?b WHERE { ?a :parentOf+ ?b . }").collect()
    assert {tuple(r) for r in got} == {(":gaon", ":naru"), (":gaon", ":daol"), (":gaon", ":raon"), (":naru", ":raon")}


def test_jsonld():
    body = '{"@context": "s", "@type": "Org", "url": "http://u", "employee": {"@type": "Person", "name": "P"}, "rating": {"value": 4.5}}'
    assert R.flatten_jsonld(body) == [("http://u", "a", "Org"), ("http://u", "url", "http://u"), ("http://u", "employee", "_:b1"), ("_:b1", "a", "Person"), ("_:b1", "name", "P"), ("http://u", "rating", "_:b2"), ("_:b2", "value", "4.5")]


def test_cypher(spark):
    people = spark.createDataFrame([("p1", "Kim", 30), ("p2", "Lee", 41), ("p3", "Park", 25)], "id string, name string, age int")
    knows = spark.createDataFrame([("p1", "p2", 2020), ("p2", "p3", 2021)], "a string, b string, since int")
    g = P.GraphView().node("person", people, "id").edge("knows", knows, "a", "b")
    q = lambda s, **k: [tuple(r) for r in P.cypher(g, s, k).collect()]
    assert q("MATCH (a:person)-[k:knows]->(b:person) WHERE k.since > 2020 RETURN a.name AS x, b.name AS y") == [("Lee", "Park")]
    assert q("MATCH (a:person)<-[k:knows]-(b:person) WHERE b.name = $who RETURN a.name AS x", who="Kim") == [("Lee",)]
    assert sorted(q("MATCH (a:person)-[:knows*1..2]->(b:person) RETURN a.name AS x, b.name AS y")) == [("Kim", "Lee"), ("Kim", "Park"), ("Lee", "Park")]
    assert q("MATCH (a:person) WHERE NOT EXISTS { MATCH (a)-[:knows]->(b:person) } RETURN a.name AS x") == [("Park",)]
    assert sorted(q("MATCH (a:person) WHERE a.age > 40 RETURN a.name AS x UNION MATCH (a:person) WHERE a.name STARTS WITH 'L' RETURN a.name AS x")) == [("Lee",)]
    assert q("MATCH (a:person) LET old = a.age > 28 FILTER old RETURN count(*) AS n") == [(2,)]
    with pytest.raises(P.PatternError):
        q("MATCH (a:person), (b:person) RETURN a.name AS x, b.name AS y")


def test_csr_offsets(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 3), (5, 1)])
    assert sorted(tuple(r) for r in T.csr(e).collect()) == [(1, 0, 2), (2, 2, 1), (5, 3, 1)]


def test_generator_is_stable(spark):
    a = R.random_graph(spark, 200, 6, seed=3, groups=4, bridges=0.1, negative=0.05)
    b = R.random_graph(spark, 200, 6, seed=3, groups=4, bridges=0.1, negative=0.05).repartition(3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.where("w < 0").count() > 0
