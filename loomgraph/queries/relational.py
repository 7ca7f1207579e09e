"""Projection, joins, aggregates, windows, top-k, sets and scalars over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import relational as R
from loomgraph.queries.base import SQL_CUSTOMER_PART, SQL_NATIONS, SQL_SUPPLIERS, g_customer_part, g_nations, query, supplier_edges, supplier_links, t


# PRJ ----------------------------------------------------------------------------------------------------------------
@query("SELECT 'nation:' || n_nationkey AS s, 'in_region' AS p, 'region:' || n_regionkey AS o FROM nation WHERE n_regionkey = 2")
def triple_pattern_match(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("s"), F.lit("in_region").alias("p"), F.concat(F.lit("region:"), "n_regionkey").alias("o"))
    return R.match_triples(n, p="in_region", o="region:2")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def edge_property_scan(spark, d):
    return t(spark, d, "events").where(F.get_json_object("props", "$.k").cast("long") == 7).select("event_id", "user_id")


@query("SELECT c_custkey AS node, n_name AS boss FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def directional_lookup(spark, d):
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    return c.join(n.where("n_nationkey = 3"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("node"), F.col("n_name").alias("boss"))


@query("SELECT l_orderkey AS order_id, round(l_extendedprice * (1 - l_discount), 6) AS net, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'")
def computed_columns(spark, d):
    return t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("net"), F.col("l_linenumber").alias("line"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS answer FROM customer")
def closed_world(spark, d):
    facts = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.closed_world(t(spark, d, "customer").select("c_custkey"), facts, "c_custkey")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'known' ELSE 'unknown' END AS answer FROM customer")
def open_world(spark, d):
    facts = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.open_world(t(spark, d, "customer").select("c_custkey"), facts, "c_custkey")


@query("SELECT doc_id, contains(text, 'the') AND contains(text, 'and') AS every_word, contains(text, 'the') OR contains(text, 'and') AS any_word FROM documents")
def word_search(spark, d):
    return t(spark, d, "documents").select("doc_id", R.contains_all_words(F.col("text"), "the and").alias("every_word"), R.contains_any_word(F.col("text"), "the and").alias("any_word"))


@query("""WITH w AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT p_partkey, CAST(sum(CASE WHEN contains(word, 'blu') OR contains('blu', word) OR contains(word, 'ste') OR contains('ste', word) THEN 1 ELSE 0 END) AS BIGINT) AS score FROM w GROUP BY 1""")
def entity_disambiguation(spark, d):
    from loomgraph.operators.retrieval import predicate_overlap

    return predicate_overlap(t(spark, d, "part"), "p_partkey", F.split("p_name", " "), ["blu", "ste"])


@query("SELECT r_regionkey AS slot, r_name AS value FROM region WHERE r_regionkey IN (1, 3)")
def keyed_lookup(spark, d):
    return t(spark, d, "region").where(F.col("r_regionkey").isin(1, 3)).select(F.col("r_regionkey").alias("slot"), F.col("r_name").alias("value"))


@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size BETWEEN 10 AND 20 AND p_type IN (SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 2)")
def prefix_and_lists(spark, d):
    p = t(spark, d, "part")
    kinds = p.select("p_type").distinct().orderBy("p_type").limit(2)
    return p.where(F.col("p_brand").startswith("Brand#1") & F.col("p_size").between(10, 20)).join(kinds, "p_type", "left_semi").select("p_partkey", "p_brand")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND o_totalprice > 1000.0")
def parameterised(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("param_orders")
    return spark.sql("SELECT o_orderkey FROM param_orders WHERE o_custkey = :who AND o_totalprice > :least", args={"who": 42, "least": 1000.0})


@query("SELECT doc_id, regexp_matches(text, 'token|idiot') AS denied, regexp_full_match(trim(text), '[A-Za-z. ]+') AS allowed FROM documents")
def command_gate(spark, d):
    return t(spark, d, "documents").select("doc_id", R.denied(F.col("text"), ["token", "idiot"]).alias("denied"), R.allowed(F.col("text"), ["[A-Za-z. ]+"]).alias("allowed"))


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE regexp_matches(lower(line), 'license|token')""")
def instruction_lines(spark, d):
    return R.marked_lines(t(spark, d, "documents"), "doc_id", "text", ["license", "token"])


# JN -----------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SQL_SUPPLIERS} SELECT x.src AS start, count(DISTINCT z.dst) AS ends FROM g2u x JOIN g2u y ON x.dst = y.src JOIN g2u z ON y.dst = z.src
WHERE x.src = (SELECT min(src) FROM g2u) GROUP BY 1""")
def walk_endpoints(spark, d):
    e = supplier_links(spark, d)
    first = e.agg(F.min("src").alias("m")).first()["m"]
    return R.walk_endpoints(e, F.col("src") == F.lit(first), 3).groupBy("start").agg(F.count("node").alias("ends"))


@query("""SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE l_shipdate < o_orderdate + INTERVAL 10 DAY AND p_size > 20 GROUP BY 1""")
def five_way_theta(spark, d):
    c, n, o, l, p = (t(spark, d, x) for x in ("customer", "nation", "orders", "lineitem", "part"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("o_custkey") == F.col("c_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return j.where((F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")) & (F.col("p_size") > 20)).groupBy("n_name").agg(F.count("*").alias("n"))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS later_id FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'error' AND b.event_type = 'signup' AND b.ts > a.ts AND strftime(a.ts, '%Y-%m-%d') = '2024-01-05'""")
def event_pairs(spark, d):
    e = t(spark, d, "events")
    a = e.where((F.col("event_type") == "error") & F.date_format("ts", "yyyy-MM-dd").startswith("2024-01-05")).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("at"))
    b = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("later_id"), "ts")
    return a.join(b, "user_id").where("ts > at").select("user_id", "first_id", "later_id")


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def cross_product_rewritten(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 400000")
    return c.where("c_acctbal > 0").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def anti_join(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return t(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


SQL_INTERVALS = """iv AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate AS valid_from,
    coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TIMESTAMP '9999-12-31') AS valid_to FROM orders)"""


def order_intervals(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    end = F.coalesce(F.lead("o_orderdate").over(w), F.lit("9999-12-31").cast("timestamp"))
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").alias("valid_from"), end.alias("valid_to"))


@query(f"WITH {SQL_INTERVALS} SELECT o_custkey, o_orderkey FROM iv WHERE valid_from <= TIMESTAMP '1995-06-17' AND TIMESTAMP '1995-06-17' < valid_to")
def interval_half_open(spark, d):
    return R.valid_at(order_intervals(spark, d), F.lit("1995-06-17").cast("timestamp")).select("o_custkey", "o_orderkey")


@query(f"WITH {SQL_INTERVALS} SELECT o_custkey, o_orderkey FROM iv WHERE valid_from <= TIMESTAMP '1995-06-17' AND TIMESTAMP '1995-06-17' <= valid_to")
def interval_closed(spark, d):
    return R.valid_at(order_intervals(spark, d), F.lit("1995-06-17").cast("timestamp"), closed=True).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def time_agnostic_contradictions(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("statuses")).where("statuses > 1")


@query("""SELECT o_custkey AS a, l_suppkey AS b, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) > 2""")
def event_node_join(spark, d):
    o, l = t(spark, d, "orders"), t(spark, d, "lineitem").where("l_returnflag = 'R'")
    j = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"))
    return j.agg(F.count("*").alias("n")).where("n > 2")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'drop' ELSE 'unknown' END AS action FROM events")
def policy_lookup(spark, d):
    policy = spark.createDataFrame([("purchase", "keep"), ("error", "drop")], "event_type string, action string")
    return R.labelled_lookup(t(spark, d, "events").select("event_id", "event_type"), policy, "event_type", "action").select("event_id", "action")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def block_pairs(spark, d):
    return R.block_pairs(t(spark, d, "supplier"), F.col("s_nationkey"), "s_suppkey")


@query("""SELECT event_id, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = user_id AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts)) AS o_orderkey FROM events""")
def as_of_join(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return R.as_of_join(t(spark, d, "events").select("event_id", "user_id", "ts"), o, "user_id", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


# AGG ----------------------------------------------------------------------------------------------------------------
@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) > 100")
def group_having(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty")).where("qty > 100")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS blocked, count(*) FILTER (value > 50 AND user_id % 2 = 0) AS overturned,
round(CASE WHEN count(*) FILTER (value > 50) = 0 THEN 0 ELSE count(*) FILTER (value > 50 AND user_id % 2 = 0) / count(*) FILTER (value > 50) END, 9) AS rate FROM events GROUP BY 1""")
def overturn_rate(spark, d):
    big, even = F.col("value") > 50, F.col("user_id") % 2 == 0
    rate = F.coalesce(F.try_divide(F.count_if(big & even), F.count_if(big)), F.lit(0.0))
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(big).alias("blocked"), F.count_if(big & even).alias("overturned"), F.round(rate, 9).alias("rate"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def count_distinct(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT * FROM c WHERE n = (SELECT max(n) FROM c)")
def most_frequent_with_ties(spark, d):
    return R.most_frequent(t(spark, d, "part"), "p_type")


@query("""SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1) ORDER BY n DESC, first_id LIMIT 3""")
def frequency_top_k(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(3).select("event_type", "n")


@query("WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT min(n) AS k, count(*) FILTER (n = 1) AS singletons, count(*) AS groups FROM g")
def k_anonymity(spark, d):
    return R.k_anonymity(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("""WITH r AS (SELECT event_type AS label, CASE WHEN value > 50 THEN ['k', 'big'] ELSE ['k'] END AS keys FROM events), s AS (SELECT label, count(*) AS rows FROM r GROUP BY 1),
u AS (SELECT label, key, count(*) AS uses FROM (SELECT label, unnest(keys) AS key FROM r) GROUP BY 1, 2), d AS (SELECT * FROM (VALUES ('click', 'k'), ('view', 'k'), ('view', 'url')) v(label, key))
SELECT coalesce(u.label, d.label) AS label, coalesce(u.key, d.key) AS key, s.rows, CASE WHEN d.key IS NULL THEN coalesce(uses, 0) ELSE 0 END AS undeclared, CASE WHEN d.key IS NOT NULL THEN s.rows - coalesce(uses, 0) ELSE 0 END AS missing
FROM u FULL JOIN d ON u.label = d.label AND u.key = d.key JOIN s ON s.label = coalesce(u.label, d.label)""")
def presence_audit(spark, d):
    rows = t(spark, d, "events").select(F.col("event_type").alias("label"), F.when(F.col("value") > 50, F.array(F.lit("k"), F.lit("big"))).otherwise(F.array(F.lit("k"))).alias("keys"))
    declared = spark.createDataFrame([("click", "k"), ("view", "k"), ("view", "url")], "label string, key string")
    return R.presence_audit(declared, rows)


@query(f"WITH {SQL_SUPPLIERS} SELECT src AS node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS strength FROM g2u GROUP BY 1")
def degrees(spark, d):
    return supplier_edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


@query(f"WITH {SQL_SUPPLIERS}, k AS (SELECT src, count(*) AS n FROM g2u GROUP BY 1) SELECT CAST(sum(n * n) AS BIGINT) AS two_hop_cost FROM k")
def two_hop_cost(spark, d):
    k = supplier_edges(spark, d).groupBy("src").agg(F.count("*").alias("n"))
    return k.agg(F.sum(F.col("n") * F.col("n")).alias("two_hop_cost"))


@query("""SELECT o_orderpriority AS kind, round(sum(m.weight * o_totalprice) / sum(m.weight), 4) AS score FROM orders JOIN (VALUES ('P', 1.0), ('O', 2.0), ('F', 3.0)) m(status, weight) ON m.status = o_orderstatus GROUP BY 1""")
def weighted_average(spark, d):
    mix = spark.createDataFrame([("P", 1.0), ("O", 2.0), ("F", 3.0)], "o_orderstatus string, weight double")
    return t(spark, d, "orders").join(mix, "o_orderstatus").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.round(F.sum(F.col("weight") * F.col("o_totalprice")) / F.sum("weight"), 4).alias("score"))


@query("SELECT l_suppkey AS s, l_partkey AS o, count(DISTINCT l_orderkey) AS votes FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2")
def voting(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("o")).agg(F.count_distinct("l_orderkey").alias("votes")).where("votes >= 2")


@query("""SELECT user_id, max(CASE WHEN value > 10 THEN day END) AS last_use, CAST(sum(CASE WHEN day >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS recent, bool_and(value < 99) AS quiet
FROM (SELECT user_id, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events) GROUP BY 1""")
def last_use(spark, d):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    e = t(spark, d, "events").select("user_id", "value", day.alias("day"))
    return e.groupBy("user_id").agg(F.max(F.when(F.col("value") > 10, F.col("day"))).alias("last_use"), F.sum(F.when(F.col("day") >= 20, 1).otherwise(0)).alias("recent"), F.bool_and(F.col("value") < 99).alias("quiet"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share FROM c")
def share_of_total(spark, d):
    c = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return R.share_of_total(c, "n").withColumn("share", F.round("share", 9))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1")
def set_aggregation(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""SELECT user_id, round(greatest(0, 100 * (1 - (10 * count(*) FILTER (event_type = 'error') + 3 * count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view')) / (count(*) / 2.0))), 6) AS composite FROM events GROUP BY 1""")
def composite_quality(spark, d):
    from loomgraph.operators.validate import composite

    of = lambda kind: F.count_if(F.col("event_type") == kind)
    return t(spark, d, "events").groupBy("user_id").agg(F.round(composite(of("error"), of("click"), of("view"), F.count("*")), 6).alias("composite"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping(c_mktsegment) + grouping(c_nationkey) AS INTEGER) AS level FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup_extension(spark, d):
    return t(spark, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), (F.grouping("c_mktsegment") + F.grouping("c_nationkey")).cast("int").alias("level"))


# WIN ----------------------------------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations)
SELECT conv_id, turn, CAST(running AS BIGINT) AS running, CAST(sum(running) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS cumulative FROM r""")
def running_cost(spark, d):
    c = t(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    return R.running_totals(c, ["conv_id"], ["turn"], "n").select("conv_id", "turn", "running", "cumulative")


@query("""SELECT event_id, coalesce(row_number() OVER w > 3 AND value >= min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS stalled
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stall_detection(spark, d):
    return R.stalled(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", "stalled")


@query("""WITH s AS (SELECT user_id, row_number() OVER w AS pos, row_number() OVER w > 3 AND value >= min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS hit
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, min(CASE WHEN hit THEN pos END) AS stalled_at FROM s GROUP BY 1""")
def first_stall(spark, d):
    e = R.stalled(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.withColumn("pos", pos).groupBy("user_id").agg(F.min(F.when(F.col("stalled"), F.col("pos"))).alias("stalled_at"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_per_group(spark, d):
    return R.latest_per_key(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate")], [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER w AS spent, sum(o_totalprice) OVER w - o_totalprice AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey FROM r WHERE prev < 500000 AND spent >= 500000""")
def budget_crossing(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = t(spark, d, "orders").withColumn("spent", F.sum("o_totalprice").over(w)).withColumn("prev", F.col("spent") - F.col("o_totalprice"))
    return r.where("prev < 500000 and spent >= 500000").select("o_custkey", "o_orderkey")


@query("""SELECT a.user_id, a.event_id, date_diff('minute', a.ts, a.next_ts) AS minutes FROM (SELECT user_id, event_id, date_trunc('minute', ts) AS ts, lead(date_trunc('minute', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events) a WHERE next_ts IS NOT NULL""")
def response_minutes(spark, d):
    e = t(spark, d, "events").withColumn("m", F.date_trunc("minute", "ts"))
    nxt = F.lead("m").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("next_ts", nxt).where("next_ts is not null").select("user_id", "event_id", F.expr("timestampdiff(MINUTE, m, next_ts)").alias("minutes"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def tail_turns(spark, d):
    return R.tail(t(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn")


@query("""SELECT o_orderkey, CAST(greatest(0, least(p, 1000000 - before)) AS BIGINT) AS granted FROM (SELECT o_orderkey, p, coalesce(sum(p) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders))""")
def budget_prefix(spark, d):
    o = t(spark, d, "orders").withColumn("p", F.floor("o_totalprice").cast("long"))
    return R.prefix_budget(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "p", F.lit(1_000_000).cast("long")).select("o_orderkey", F.col("granted").cast("long").alias("granted"))


@query("""SELECT o_orderkey, CAST(least(p, floor(1000000 / n)) AS BIGINT) AS granted FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def budget_even(spark, d):
    o = t(spark, d, "orders").withColumn("p", F.floor("o_totalprice").cast("long"))
    return R.even_budget(o, ["o_custkey"], "p", F.lit(1_000_000).cast("long")).select("o_orderkey", F.col("granted").cast("long").alias("granted"))


@query("""SELECT o_orderkey, CAST(1000 + greatest(0, least(p, 1000000 - 1000 * n - before)) AS BIGINT) AS granted FROM (SELECT o_orderkey, p, count(*) OVER (PARTITION BY o_custkey) AS n, coalesce(sum(p) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders))""")
def budget_reserve_first(spark, d):
    o = t(spark, d, "orders").withColumn("p", F.floor("o_totalprice").cast("long")).withColumn("need", F.lit(1000).cast("long"))
    return R.reserve_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "need", "p", F.lit(1_000_000).cast("long")).select("o_orderkey", F.col("granted").cast("long").alias("granted"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS reserve FROM conversations")
def timeout_reserve(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("reserve"))


# SRT ----------------------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def order_by_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 10")
def top_k_larger_index(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_size").orderBy(F.desc("p_size"), F.desc("p_partkey")).limit(10)


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT e FROM q)), 6) AS score FROM embeddings)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 3""")
def cosine_top_k(spark, d):
    e = t(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").select("embedding").first()[0]])
    return e.select("vec_id", F.round(S.cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(3)


@query("SELECT max(o_orderkey) AS newest FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def newest_row(spark, d):
    return t(spark, d, "orders").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents) SELECT round(count(*) FILTER (quality = 1) / 50.0, 6) AS precision_at_50 FROM r JOIN labels USING (doc_id) WHERE rank <= 50""")
def precision_at_n(spark, d):
    top = t(spark, d, "documents").orderBy(F.desc(F.length("text")), "doc_id").limit(50).select("doc_id")
    return top.join(t(spark, d, "labels"), "doc_id").agg(F.round(F.count_if(F.col("quality") == 1) / 50.0, 6).alias("precision_at_50"))


@query("""WITH a AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20), b AS (SELECT o_custkey AS c_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) SELECT count(*) / 20.0 AS overlap FROM a SEMI JOIN b USING (c_custkey)""")
def top_k_overlap(spark, d):
    a = t(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")
    b = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_custkey").limit(20)
    return a.join(b, "c_custkey", "left_semi").agg((F.count("*") / 20.0).alias("overlap"))


# SET ----------------------------------------------------------------------------------------------------------------
@query("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 5000")
def union_distinct(spark, d):
    return t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(t(spark, d, "customer").where("c_acctbal > 5000").select("c_nationkey")).distinct()


@query("""SELECT 'both' AS part, user_id AS id FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup')
UNION ALL SELECT 'only', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup')""")
def intersection_difference(spark, d):
    e = t(spark, d, "events")
    a, b = (e.where(F.col("event_type") == k).select("user_id") for k in ("error", "signup"))
    return a.intersect(b).select(F.lit("both").alias("part"), F.col("user_id").alias("id")).union(a.subtract(b).select(F.lit("only"), "user_id"))


@query("SELECT user_id, len(list_filter(['purchase', 'view'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) = 0 AS covered FROM events GROUP BY 1")
def set_containment(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("has"))
    return e.select("user_id", R.contained(F.array(F.lit("purchase"), F.lit("view")), F.col("has")).alias("covered"))


@query("SELECT true AS same")
def engines_agree(spark, d):
    """One question by joins and by SQL: the answers are the same multiset."""
    o = t(spark, d, "orders")
    a = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey = 3").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    o.createOrReplaceTempView("agree_orders"), t(spark, d, "customer").createOrReplaceTempView("agree_customer")
    b = spark.sql("SELECT o_orderstatus, count(*) AS n FROM agree_orders WHERE o_custkey IN (SELECT c_custkey FROM agree_customer WHERE c_nationkey = 3) GROUP BY 1")
    return spark.createDataFrame([(R.same_rows(a, b),)], "same boolean")


# SCL ----------------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT doc_id, regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g') AS s FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS gram FROM s WHERE length(s) >= 2)
SELECT gram, count(DISTINCT doc_id) AS df FROM g GROUP BY 1""")
def char_ngrams(spark, d):
    g = t(spark, d, "documents").select("doc_id", F.explode(S.char_ngrams(F.col("text"))).alias("gram")).distinct()
    return g.groupBy("gram").agg(F.count("*").alias("df"))


@query("SELECT c_custkey, lower(regexp_replace(c_name, '[\\s.,&()-]', '', 'g')) AS name, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def normalised_names(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.normalize_name(F.col("c_name")).alias("name"), S.digits_only(F.col("c_name")).alias("digits"))


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-01'), '%Y-%m-%d')::DATE AS month FROM orders")
def lenient_dates(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.lenient_date(F.date_format("o_orderdate", "yyyy/M")).alias("month"))


@query("SELECT event_id, 'a=' || event_type || ';b=' || user_id AS dumped FROM events")
def key_value_round_trip(spark, d):
    text = F.concat(F.lit("b="), F.col("user_id"), F.lit(";a="), F.col("event_type"))
    return t(spark, d, "events").select("event_id", S.dump_map(S.key_value_map(text)).alias("dumped"))


@query("SELECT event_id, ('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.25 AS fails FROM events")
def hash_draw(spark, d):
    return t(spark, d, "events").select("event_id", (S.hash_unit(F.col("event_id").cast("string")) < 0.25).alias("fails"))


@query("SELECT item_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), lambda w: list_contains(['the', 'of', 'and'], w)))) AS hits FROM benchmark")
def word_overlap(spark, d):
    return t(spark, d, "benchmark").select("item_id", S.overlap(F.translate("text", "àâäçéèêëîïôöùûüßñáíóú", "                     "), F.lit("the of and")).cast("long").alias("hits"))


@query("SELECT item_id, CASE WHEN regexp_matches(text, 'tion') THEN 'global' WHEN regexp_matches(text, 'ing') THEN 'multihop' ELSE 'fact' END AS route FROM benchmark")
def question_router(spark, d):
    return t(spark, d, "benchmark").select("item_id", S.route_question(F.col("text"), ["tion"], ["ing"]).alias("route"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'see' END AS canonical FROM events")
def canonical_predicates(spark, d):
    return t(spark, d, "events").select("event_id", S.canonical(F.col("event_type"), {"click": "touch", "view": "see"}).alias("canonical"))


@query("SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 7) AS BIGINT) AS batches, CAST(greatest(5, least(l_quantity, 20)) AS BIGINT) AS clamped FROM lineitem")
def numeric_formulas(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.ceil_div(F.col("l_quantity"), F.lit(7)).alias("batches"), F.greatest(F.lit(5), F.least("l_quantity", F.lit(20))).cast("long").alias("clamped"))


@query(f"WITH {SQL_SUPPLIERS}, k AS (SELECT src, count(*) AS n FROM g2u GROUP BY 1) SELECT count(*) FILTER (n % 2 = 1) AS odd, CASE count(*) FILTER (n % 2 = 1) WHEN 0 THEN 'circuit' WHEN 2 THEN 'path' ELSE 'none' END AS verdict FROM k")
def euler_verdict(spark, d):
    k = supplier_edges(spark, d).groupBy("src").agg(F.count("*").alias("n"))
    return k.agg(F.count_if(F.col("n") % 2 == 1).alias("odd")).withColumn("verdict", S.euler_verdict(F.col("odd")))


@query("SELECT o_orderkey, round(o_totalprice * 1350, 2) AS won, round(o_totalprice / 1000 * 0.003, 8) AS token_cost FROM orders")
def unit_conversions(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 1350, 2).alias("won"), F.round(F.col("o_totalprice") / 1000 * 0.003, 8).alias("token_cost"))
