"""Loading, lookup forms, routing, memory shapes, checkpoints and function surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import extensions as FX
from loomgraph.functions import scalars as S
from loomgraph.operators import analytics as A
from loomgraph.operators import traverse as T
from loomgraph.operators import workflow as W
from loomgraph.queries.base import SQL_NATIONS, g_nations, query, t
from loomgraph.queries.graphs import ring_of_cliques
from loomgraph.sources import readers as SR
from loomgraph.storage import new_path


@query("SELECT o_custkey AS src, count(*) AS n FROM orders WHERE o_custkey IN (3, 7, 11) GROUP BY 1")
def indexed_load(spark, d):
    """Edges laid out by source: a lookup reads the files whose statistics hold the key, not all."""
    path = new_path(spark, "edges")
    t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).repartitionByRange("src").sortWithinPartitions("src").write.parquet(path)
    return spark.read.parquet(path).where(F.col("src").isin(3, 7, 11)).groupBy("src").agg(F.count("*").alias("n"))


@query("SELECT doc_id, strlen(text) AS bytes FROM documents")
def document_table(spark, d):
    path = new_path(spark, "docs")
    t(spark, d, "documents").select("doc_id", "text").write.parquet(path)
    return spark.read.parquet(path).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT 'person' AS label, id, name FROM (VALUES ('p1', 'Kim'), ('p2', 'Lee')) v(id, name) UNION ALL SELECT 'team', id, name FROM (VALUES ('t1', 'Core')) v(id, name)")
def typed_tables(spark, d):
    people = SR.literal(spark, [("p1", "Kim"), ("p2", "Lee")], "id string not null, name string")
    teams = SR.literal(spark, [("t1", "Core")], "id string not null, name string")
    return people.select(F.lit("person").alias("label"), "id", "name").unionByName(teams.select(F.lit("team").alias("label"), "id", "name"))


@query("SELECT 500 AS nodes_at_most, true AS loopless, true AS repeatable")
def random_graph(spark, d):
    a = SR.random_graph(spark, 500, 8, seed=11, skew=2.0)
    b = SR.random_graph(spark, 500, 8, seed=11, skew=2.0).repartition(3)
    top = a.agg(F.greatest(F.max("src"), F.max("dst")).alias("m")).first()["m"]
    from loomgraph.operators.relational import same_rows

    ok = (500 if top < 500 else top + 1, a.where("src = dst").isEmpty(), same_rows(a, b))
    return spark.createDataFrame([ok], "nodes_at_most int, loopless boolean, repeatable boolean")


@query("SELECT doc_id, 'src' AS s, 'in' AS p, source AS o, text AS quote FROM documents")
def scripted_extractor(spark, d):
    docs = t(spark, d, "documents")
    answers = docs.select("doc_id", F.lit("src").alias("s"), F.lit("in").alias("p"), F.col("source").alias("o"), F.col("text").alias("quote"))
    return SR.extractor(docs, answers).select("doc_id", "s", "p", "o", "quote")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def promoted_event_node(spark, d):
    """The same answer as a scan of an edge property, through an event node that is joined by key."""
    e = t(spark, d, "events")
    actor = e.select("event_id", "user_id")
    tag = e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k = 7")
    return actor.join(tag, "event_id").select("event_id", "user_id")


@query("""WITH last AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS ended FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT DISTINCT o.o_custkey AS company FROM orders o JOIN last ON last.o_custkey = o.o_custkey WHERE o.o_orderstatus = 'P' AND o.o_orderkey > ended""")
def step_pipeline(spark, d):
    """out(ended) -> in -> out(signed) -> where, one ended contract kept for each company."""
    o = t(spark, d, "orders")
    ended = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("ended"))
    signed = o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return ended.join(signed, "o_custkey").where("o_orderkey > ended").select(F.col("o_custkey").alias("company")).distinct()


@query("SELECT i AS node, i - i % 4 AS label FROM (SELECT unnest(range(0, 16)) AS i)")
def greedy_modularity(spark, d):
    return A.greedy_modularity(ring_of_cliques(spark, 4, 4)).select("node", "label")


@query(f"""WITH RECURSIVE {SQL_NATIONS}, q AS (SELECT item_id, CASE WHEN regexp_matches(text, 'tion') THEN 'global' WHEN regexp_matches(text, 'ing') THEN 'multihop' ELSE 'fact' END AS route FROM benchmark),
h AS (SELECT DISTINCT b.dst FROM g3 a JOIN g3 b ON a.dst = b.src WHERE a.src = (SELECT min(src) FROM g3))
SELECT item_id, route, CASE route WHEN 'global' THEN (SELECT count(*) FROM g3) WHEN 'multihop' THEN (SELECT count(*) FROM h) ELSE (SELECT count(*) FROM g3 WHERE src = (SELECT min(src) FROM g3)) END AS answer FROM q""")
def routed_answers(spark, d):
    """Questions dealt to three engines by their words, the answers unioned."""
    q = t(spark, d, "benchmark").select("item_id", S.route_question(F.col("text"), ["tion"], ["ing"]).alias("route"))
    g = g_nations(spark, d).select("src", "dst")
    first = g.agg(F.min("src")).first()[0]
    one = g.where(F.col("src") == first)
    two = one.select(F.col("dst").alias("mid")).join(g, F.col("mid") == F.col("src")).select("dst").distinct()
    sizes = [("global", g.count()), ("multihop", two.count()), ("fact", one.count())]
    return q.join(spark.createDataFrame(sizes, "route string, answer long"), "route").select("item_id", "route", "answer")


@query("""SELECT c_custkey, contains(c_name, '7') AS flat, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS keyed, n_name AS graph FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def memory_shapes(spark, d):
    """One question to a flat text, a fixed-slot and a graph memory."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.contains("c_name", F.lit("7")).alias("flat"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("keyed"), F.col("n_name").alias("graph"))


def counter_graph():
    g = W.StateGraph().node("add", lambda df: df.withColumn("x", F.col("x") + 1))
    return g.route("add", F.when(F.col("x") < 3, "add").otherwise(W.END))


@query("SELECT CAST(step AS INTEGER) AS superstep, count(*) AS threads, CAST(sum(step) AS BIGINT) AS total FROM customer, (SELECT unnest(range(0, 4)) AS step) GROUP BY 1")
def checkpoint_history(spark, d):
    """Every superstep's snapshot, and a run resumed from an early one that ends like the first."""
    s = t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.lit(0).alias("x"))
    end, history = counter_graph().invoke(s, "add")
    again, _ = counter_graph().resume(history[1])
    assert again.exceptAll(end).isEmpty()
    out = None
    for k, snap in enumerate(history):
        one = snap.agg(F.count("*").alias("threads"), F.sum("x").alias("total")).select(F.lit(k).alias("superstep"), "threads", "total")
        out = one if out is None else out.union(one)
    return out


@query("SELECT c_custkey AS thread, c_custkey % 3 = 0 AS answered, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS effects FROM customer")
def human_interrupt(spark, d):
    """Threads wait at a node; only those with an answer go on, and the effect comes after the answer, once."""
    s = t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.lit(0).alias("effects"))
    g = W.StateGraph().node("draft", lambda df: df).edge("draft", "ask").node("ask", lambda df: df.withColumn("effects", F.col("effects") + 1), interrupt=True).edge("ask", W.END)
    waiting, _ = g.invoke(s, "draft")
    yes = F.col("thread") % 3 == 0
    done, _ = g.resume(waiting.where(yes), answered=True)
    return done.union(waiting.where(~yes)).select("thread", yes.alias("answered"), "effects")


@query("SELECT user_id, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1")
def aggregate_extension(spark, d):
    """A reducer as an aggregate: built from expressions, so partial sums combine before the shuffle."""
    mean = FX.column_function("mean_of")(lambda c: F.sum(c) / F.count(c))
    return t(spark, d, "events").groupBy("user_id").agg(F.round(mean(F.col("value")), 6).alias("mean"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def table_function_extension(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("tf_nation")
    FX.table_function(spark, "nations_of", "r INT", "id INT, name STRING", "SELECT n_nationkey, n_name FROM tf_nation WHERE n_regionkey = r")
    return spark.sql("SELECT id, name FROM nations_of(2)")


@query("SELECT event_id, length(event_type) * 2 AS twice FROM events")
def vectorised_extension(spark, d):
    twice = FX.vectorised(lambda s: s.str.len() * 2, "long")
    return t(spark, d, "events").select("event_id", twice("event_type").alias("twice"))


@query("SELECT c_custkey AS thread, round(c_acctbal * 2, 4) AS x FROM customer")
def node_function_extension(spark, d):
    double = FX.node_function("double")(lambda df: df.withColumn("x", F.round(F.col("x") * 2, 4)))
    g = W.StateGraph().node("double", double).edge("double", W.END)
    return g.invoke(t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.col("c_acctbal").alias("x")), "double")[0].select("thread", "x")


@query("SELECT user_id, event_type, n, prev, round(n * 1.0 / sum(n) OVER (PARTITION BY user_id, prev), 9) AS p FROM (SELECT user_id, event_type, prev, count(*) AS n FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY 1, 2, 3)")
def transitions(spark, d):
    """Consecutive event types of each user with their share: lag, count, share of a group."""
    e = t(spark, d, "events").withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("prev is not null")
    n = e.groupBy("user_id", "event_type", "prev").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.round(F.col("n") * 1.0 / F.sum("n").over(Window.partitionBy("user_id", "prev")), 9))


@query(f"""WITH {SQL_NATIONS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g3), v AS (SELECT a AS n FROM u UNION ALL SELECT b FROM u), m AS (SELECT src AS n FROM g3 UNION ALL SELECT dst FROM g3)
SELECT v.n AS node, count(*) AS simple, (SELECT count(*) FROM m WHERE m.n = v.n) AS multi FROM v GROUP BY 1""")
def simple_and_multi_degree(spark, d):
    g = g_nations(spark, d).select("src", "dst")
    simple = T.undirected(g).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("simple"))
    multi = g.select(F.col("src").alias("node")).union(g.select("dst")).groupBy("node").agg(F.count("*").alias("multi"))
    return simple.join(multi, "node")
