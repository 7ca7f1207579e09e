"""Workflows, cost models, pattern languages, sources and streaming."""

from __future__ import annotations

import uuid
from functools import reduce


from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import extensions as FX
from loomgraph.operators import models as M
from loomgraph.operators import workflow as W
from loomgraph.plans import patterns as P
from loomgraph.queries.base import SQL_NATIONS, g_nations, query, t
from loomgraph.sources import readers as SR
from loomgraph.streaming import windows as ST


# STF ----------------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT c_custkey AS thread, CAST(floor(c_acctbal) AS BIGINT) AS x FROM customer) SELECT thread, CASE WHEN x < 3000 THEN x + 3 * 1000 WHEN x < 4000 THEN x + 2000 WHEN x < 5000 THEN x + 1000 ELSE x END AS x,
CAST(CASE WHEN x < 3000 THEN 3 WHEN x < 4000 THEN 2 WHEN x < 5000 THEN 1 ELSE 0 END + 1 AS INTEGER) AS visits FROM s""")
def state_graph(spark, d):
    """A node that works, a check that routes back below a bound, at most three rounds."""
    s = t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.floor("c_acctbal").alias("x"), F.lit(0).alias("visits"))
    g = W.StateGraph()
    g.node("check", lambda df: df.withColumn("visits", F.col("visits") + 1)).route("check", F.when((F.col("x") < 5000) & (F.col("visits") <= 3), "work").otherwise(W.END))
    g.node("work", lambda df: df.withColumn("x", F.col("x") + 1000)).edge("work", "check")
    return g.invoke(s, "check")[0].select("thread", "x", "visits")


@query("""SELECT user_id AS thread, 'total' AS field, CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) AS value FROM events GROUP BY 1 UNION ALL SELECT user_id, 'latest', arg_max(event_type, event_id) FROM events GROUP BY 1
UNION ALL SELECT user_id, 'best', arg_max(event_type, value * 1e9 - event_id / 1e6) FROM events GROUP BY 1 UNION ALL SELECT user_id, 'tags', string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events GROUP BY 1""")
def reducers(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("thread"), "event_type", F.col("event_id").alias("at"), F.col("value").alias("score"), F.col("event_id").alias("ordinal"))
    w = None
    for f, v in (("total", F.lit("1")), ("latest", F.col("event_type")), ("best", F.col("event_type")), ("tags", F.col("event_type"))):
        part = e.select("thread", F.lit(f).alias("field"), v.alias("value"), "at", "score", "ordinal")
        w = part if w is None else w.union(part)
    return W.reduce_writes(w, {"total": "add", "latest": "keep_latest", "best": "keep_best", "tags": "collect_unique"})


@query("""WITH s AS (SELECT user_id, event_id, value, row_number() OVER w AS n, sum(CAST(floor(value) AS BIGINT)) OVER w AS c, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT user_id, n, CASE WHEN n >= 30 THEN 'rounds' WHEN c >= 400 THEN 'cost' WHEN n * 2 >= 50 THEN 'time' WHEN n > 3 AND value >= best THEN 'stall' END AS why FROM s) SELECT user_id, min(n) FILTER (why IS NOT NULL) AS stopped_at, arg_min(why, n) FILTER (why IS NOT NULL) AS reason FROM r GROUP BY 1""")
def guards(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("cost"), F.lit(2).alias("seconds"), F.col("value").alias("score"))
    return W.guard_reason(e, ["user_id"], ["event_id"], 30, 400, 50, 3).select("user_id", F.col("stopped_at").cast("long").alias("stopped_at"), "reason")


@query("SELECT conv_id, turn, strlen('{\"role\":\"' || role || '\",\"turn\":' || turn || '}') AS bytes FROM conversations")
def state_sizes(spark, d):
    return W.state_sizes(t(spark, d, "conversations"), ["conv_id", "turn"], ["role", "turn"]).select("conv_id", "turn", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT count(*) AS rows, count(DISTINCT text) AS bodies, CAST(sum(strlen(text)) AS BIGINT) AS inline_bytes FROM documents")
def state_by_reference(spark, d):
    state, store = W.by_reference(t(spark, d, "documents").select("doc_id", "text"), "text")
    joined = state.join(store, "text_ref")
    return joined.agg(F.count("*").alias("rows"), F.count_distinct("text_ref").alias("bodies"), F.sum(F.octet_length("text")).alias("inline_bytes"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS effect FROM events")
def idempotency(spark, d):
    e = t(spark, d, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return W.idempotent(e, "key", "event_id").select("event_id", "effect")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'needs_human' END AS status FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def side_effect_log(spark, d):
    e = t(spark, d, "events").where(F.col("event_type").isin("signup", "purchase")).withColumn("phase", F.when(F.col("event_type") == "purchase", "done").otherwise("started"))
    return W.effect_status(e, "user_id")


@query("SELECT event_type, user_id, CASE WHEN user_id % 2 = 0 THEN 'safe to rerun' WHEN user_id % 3 = 0 THEN 'safe by key' WHEN event_type = 'view' THEN 'resume after' ELSE 'needs human' END AS verdict FROM (SELECT DISTINCT event_type, user_id FROM events)")
def recovery_drill(spark, d):
    s = t(spark, d, "events").select("event_type", "user_id").distinct()
    s = s.withColumns({"idempotent": F.col("user_id") % 2 == 0, "has_key": F.col("user_id") % 3 == 0, "checkpointed": F.col("event_type") == "view"})
    return W.drill(s).select("event_type", "user_id", "verdict")


@query("SELECT CAST(floor(w / 0.25) AS BIGINT) AS bucket, count(*) AS n FROM customer, (VALUES (0.5), (1.0), (2.0), (4.0)) v(w) GROUP BY 1")
def retry_buckets(spark, d):
    return W.retry_buckets(t(spark, d, "customer").select(F.col("c_custkey").alias("client")), [0.5, 1.0, 2.0, 4.0])


@query("""WITH w(schedule, wait) AS (VALUES ('fixed', 0.5), ('fixed', 1.0), ('fixed', 1.5), ('fixed', 2.0), ('exponential', 0.5), ('exponential', 1.5), ('exponential', 3.5), ('exponential', 7.5), ('capped', 0.5), ('capped', 1.5), ('capped', 3.0), ('capped', 4.5)),
n AS (SELECT schedule, CAST(floor(wait / 0.25) AS BIGINT) AS bucket, count(*) AS n FROM customer, w GROUP BY 1, 2) SELECT schedule, bucket, n, greatest(n - 100, 0) AS over, max(n) OVER (PARTITION BY schedule) AS peak FROM n""")
def retry_schedules(spark, d):
    """Fixed, exponential and capped waits without jitter: all clients come back at once."""
    schedules = {"fixed": (W.backoff("fixed", 4), False), "exponential": (W.backoff("exponential", 4), False), "capped": (W.backoff("capped", 4, cap=1.5), False)}
    return W.retry_load(t(spark, d, "customer").select(F.col("c_custkey").alias("client")), schedules, capacity=100)


@query("SELECT 'jittered' AS schedule, 4 * count(*) AS retries, true AS flatter FROM customer")
def retry_jitter(spark, d):
    """With jitter the same retries spread: none is lost, and the busiest bucket is below that of the plain schedule."""
    clients = t(spark, d, "customer").select(F.col("c_custkey").alias("client"))
    load = W.retry_load(clients, {"plain": (W.backoff("exponential", 4), False), "jittered": (W.backoff("exponential", 4), True)}, capacity=100)
    per = load.groupBy("schedule").agg(F.sum("n").alias("retries"), F.max("peak").alias("peak"))
    plain = per.where("schedule = 'plain'").select(F.col("peak").alias("plain_peak"))
    return per.where("schedule = 'jittered'").join(F.broadcast(plain)).select("schedule", "retries", (F.col("peak") < F.col("plain_peak")).alias("flatter"))  # one row each


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'P' AS ok, o_orderpriority <> '5-LOW' AS rev, o_orderkey % 5 AS fails, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS f FROM orders),
a AS (SELECT *, CASE WHEN f IS NULL THEN 'done' WHEN o_orderkey < f AND rev THEN 'undone' WHEN o_orderkey < f THEN 'stuck' WHEN o_orderkey = f THEN 'failed' ELSE 'skipped' END AS action FROM s)
SELECT o_orderkey, action, CAST(CASE WHEN action = 'undone' THEN least(fails + 1, 3) ELSE 0 END AS INTEGER) AS undo_tries, CASE WHEN action = 'stuck' THEN 'queue' WHEN action <> 'undone' THEN 'none' WHEN fails < 3 THEN 'compensated' ELSE 'queue' END AS outcome FROM a""")
def compensation_queue(spark, d):
    s = t(spark, d, "orders").withColumns({"ok": F.col("o_orderstatus") != "P", "reversible": F.col("o_orderpriority") != "5-LOW"})
    return W.compensate(W.saga(s, ["o_custkey"], "o_orderkey"), F.col("o_orderkey") % 5).select("o_orderkey", "action", "undo_tries", "outcome")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'P' AS ok, o_orderpriority <> '5-LOW' AS rev, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS f FROM orders)
SELECT o_orderkey, CASE WHEN f IS NULL THEN 'done' WHEN o_orderkey < f AND rev THEN 'undone' WHEN o_orderkey < f THEN 'stuck' WHEN o_orderkey = f THEN 'failed' ELSE 'skipped' END AS action FROM s""")
def saga(spark, d):
    s = t(spark, d, "orders").withColumns({"ok": F.col("o_orderstatus") != "P", "reversible": F.col("o_orderpriority") != "5-LOW"})
    return W.saga(s, ["o_custkey"], "o_orderkey").select("o_orderkey", "action")


@query("SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 5 < 3 THEN 'retry' WHEN event_type = 'error' THEN 'exhausted' WHEN event_type = 'click' THEN 'reject' ELSE 'needs_human' END AS route FROM events")
def dead_letter_triage(spark, d):
    kind = F.when(F.col("event_type") == "error", "transient").when(F.col("event_type") == "click", "permanent").otherwise("unknown")
    return W.triage(t(spark, d, "events").select("event_id", kind.alias("kind"), (F.col("user_id") % 5).alias("tries")), 3).select("event_id", "route")


@query("""SELECT o_orderkey, CASE WHEN h >= 24 THEN 'rejected' ELSE 'waiting' END AS reject, CASE WHEN h < 24 THEN 'waiting' WHEN risk = 'high' OR o_totalprice > 1000 THEN CASE WHEN h >= 72 THEN 'rejected' ELSE 'escalated' END ELSE 'approved' END AS escalate
FROM (SELECT *, o_orderkey % 100 AS h, CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'low' END AS risk FROM orders)""")
def escalation(spark, d):
    h, risk = F.col("o_orderkey") % 100, F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low")
    return t(spark, d, "orders").select("o_orderkey", *[W.escalation(p, h, F.col("o_totalprice"), risk).alias(p) for p in ("reject", "escalate")])


@query("SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (o_totalprice >= th) AS reviewed, round(count(*) FILTER (o_totalprice >= th) * 5.0 / 60, 6) AS hours FROM orders, (VALUES (1000), (100000), (300000)) v(th) GROUP BY 1")
def review_sweep(spark, d):
    return W.review_sweep(t(spark, d, "orders"), "o_totalprice", [1000.0, 100000.0, 300000.0]).select("threshold", "reviewed", F.round("hours", 6).alias("hours"))


@query("""WITH k AS (SELECT o_orderkey, o_custkey, o_orderstatus <> 'P' AS ok FROM orders) SELECT 'all_or_nothing' AS policy, count(*) AS n FROM k WHERE o_custkey IN (SELECT o_custkey FROM k GROUP BY 1 HAVING bool_and(ok)) UNION ALL SELECT 'best_effort', count(*) FROM k WHERE ok UNION ALL SELECT 'degrade', count(*) FROM k""")
def partial_failure(spark, d):
    k = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") != "P").alias("ok"), F.col("o_orderstatus").alias("value"))
    out = None
    for p in ("all_or_nothing", "best_effort", "degrade"):
        one = W.partial_failure(k, ["o_custkey"], p).agg(F.count("*").alias("n")).select(F.lit(p).alias("policy"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""WITH x AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 AS old FROM conversations)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS keep_all, CAST(sum(CASE WHEN old THEN 0 ELSE n END) AS BIGINT) AS last_n, round(sum(CASE WHEN old THEN 0 ELSE n END) + 0.12 * sum(CASE WHEN old THEN n ELSE 0 END), 6) AS summarised, CAST(sum(CASE WHEN old THEN 12 ELSE n END) AS BIGINT) AS offloaded FROM x GROUP BY 1""")
def context_strategies(spark, d):
    c = t(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    return W.context_strategies(c, "conv_id", "turn", "n", keep=3)


@query("""WITH w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 AS old, unnest(list_distinct(string_split(text, ' '))) AS fact FROM conversations), o AS (SELECT conv_id, fact, bool_and(old) AS old FROM w WHERE length(fact) > 6 GROUP BY 1, 2)
SELECT conv_id, count(*) AS facts, count(*) AS keep_all, count(*) FILTER (NOT old) AS last_n, count(*) FILTER (NOT old OR CAST(CAST('0x' || substr(sha256('1|' || fact), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < 0.6) AS summarised, count(*) AS offloaded FROM o GROUP BY 1""")
def fact_retention(spark, d):
    """Long words as the facts of a turn."""
    c = t(spark, d, "conversations").withColumn("facts", F.filter(F.array_distinct(F.split("text", " ")), lambda w: F.length(w) > 6))
    return W.fact_retention(c, "conv_id", "turn", "facts", keep=3)


@query("""WITH h AS (SELECT priority, n / sum(n) OVER () AS hit, row_number() OVER (ORDER BY priority) AS tier FROM (SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1)), r AS (SELECT tier, round(1 - coalesce(sum(hit) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS reached, 5.0 * tier * tier AS ms FROM h)
SELECT round(sum(round(reached * ms, 6)), 4) AS cascade_ms, max(ms) AS together_ms, round(sum(reached), 6) AS cascade_calls, CAST(count(*) AS DOUBLE) AS together_calls FROM r""")
def cascade_or_together(spark, d):
    """Order priorities as tiers, each answering its own share: one after the other, or all asked at once."""
    n = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("all")).scalar()
    tiers = n.select(F.row_number().over(Window.orderBy("o_orderpriority")).alias("tier"), (F.col("n") / every).alias("hit"))
    out = W.all_at_once(tiers.withColumn("ms", 5.0 * F.col("tier") * F.col("tier")))
    return out.select(F.round("cascade_ms", 4).alias("cascade_ms"), "together_ms", F.round("cascade_calls", 6).alias("cascade_calls"), "together_calls")


@query("SELECT * FROM (VALUES (1, 1.0, 5.0), (2, 0.4, 8.0), (3, 0.1, 30.0)) v(tier, reached, expected_ms)")
def tier_cascade(spark, d):
    return W.tier_cascade(spark.createDataFrame([(1, 0.6, 5.0), (2, 0.3, 20.0), (3, 0.1, 300.0)], "tier int, hit double, ms double")).select("tier", "reached", "expected_ms")


# SIM ----------------------------------------------------------------------------------------------------------------
@query("SELECT n, round(((((1 / (1 - n / 20.0)) + 1) / (1 - n / 20.0)) + 1) / (1 - n / 20.0), 9) AS chain, round(3 / (1 - n / 20.0), 9) AS graph FROM (SELECT unnest(range(0, 10)) AS n)")
def chain_vs_graph_cost(spark, d):
    p = F.array_repeat(F.col("id") / 20.0, 3)
    return spark.range(10).select(F.col("id").alias("n"), F.round(M.expected_chain_cost(p), 9).alias("chain"), F.round(M.expected_graph_cost(p), 9).alias("graph"))


@query("SELECT n, CAST(power(2, n) AS BIGINT) AS branches, 2 * n + 1 AS edges FROM (SELECT unnest(range(0, 12)) AS n)")
def complexity_crossover(spark, d):
    b, e = M.complexity(F.col("id"))
    return spark.range(12).select(F.col("id").alias("n"), b.alias("branches"), e.alias("edges"))


@query("SELECT w AS width, round(900 * (1 + 2.5 * (1 - power(0.9, w))) + 900 * (1 - power(0.94, w)), 6) AS wave, ceil(16.0 / w) * 900 + 16 * 120 AS parallel FROM (SELECT unnest(range(1, 17)) AS w)")
def fan_out(spark, d):
    _, par = M.fan_out(F.lit(16), F.col("id"))
    return spark.range(1, 17).select(F.col("id").alias("width"), F.round(M.wave_ms(F.col("id")), 6).alias("wave"), par.cast("double").alias("parallel"))


@query("SELECT n / 10.0 AS accuracy, round(n / 10.0 * (0.7 * 1 + 0.3 * 10) + (1 - n / 10.0) * 5.5, 6) AS cost, round(n / 10.0 * (0.7 * 0.9 + 0.3 * 0.8) + (1 - n / 10.0) * 0.3, 6) AS quality FROM (SELECT unnest(range(5, 11)) AS n)")
def router_trade_off(spark, d):
    a = F.col("id") / 10.0
    c, q = M.routed(a, {"easy": 0.7, "hard": 0.3}, {"easy": 1.0, "hard": 10.0}, {"easy": 0.9, "hard": 0.8}, 0.3)
    return spark.range(5, 11).select(a.alias("accuracy"), F.round(c, 6).alias("cost"), F.round(q, 6).alias("quality"))


@query("""WITH RECURSIVE c AS (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT seg, n / (sum(n) OVER ()) AS h FROM c),
g(gen, seg, h, p) AS (SELECT 0, seg, CAST(h AS DOUBLE), CAST(h AS DOUBLE) FROM s UNION ALL SELECT gen + 1, seg, h, 0.9 * power(p, 1.1) / sum(power(p, 1.1)) OVER () + 0.1 * h FROM g WHERE gen < 5)
SELECT gen, seg, round(p, 9) AS share FROM g""")
def drift(spark, d):
    """Shares of the customer segments over five generations that learn from their own output and a tenth of human data."""
    c = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    s = c.agg(F.array_sort(F.collect_list(F.struct("seg", "n"))).alias("all"), F.sum("n").alias("total"))  # a handful of segments
    s = s.select(F.transform("all", lambda x: x["seg"]).alias("segs"), F.transform("all", lambda x: x["n"] / F.col("total")).alias("start"))
    gens = [s.select("segs", F.lit(k).alias("gen"), (M.drift(F.col("start"), 0.1, F.col("start"), k) if k else F.col("start")).alias("p")) for k in range(6)]
    out = reduce(lambda a, b: a.union(b), gens)
    return out.select("gen", F.posexplode("p").alias("k", "share"), "segs").select("gen", F.get("segs", F.col("k")).alias("seg"), F.round("share", 9).alias("share"))


@query("""WITH RECURSIVE n AS (SELECT c_nationkey, count(*) AS degree FROM customer GROUP BY 1), r(c_nationkey, degree, hop, size, total) AS (SELECT c_nationkey, degree, 0, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM n UNION ALL SELECT c_nationkey, degree, hop + 1, CAST(floor(size * degree * 0.5) AS BIGINT), total + CAST(floor(size * degree * 0.5) AS BIGINT) FROM r WHERE hop < 4)
SELECT c_nationkey, CAST(max(CASE WHEN total <= 5000 THEN hop END) AS INTEGER) AS last_hop, max(CASE WHEN total <= 5000 THEN total END) AS visited FROM r GROUP BY 1""")
def expansion_budget(spark, d):
    """How many hops each nation's expansion may take before it visits more than 5,000 nodes."""
    n = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("degree"))
    sizes = n.withColumn("sizes", M.expansion(F.lit(1), F.col("degree"), F.lit(0.5), 4))
    last = sizes.withColumn("last_hop", M.expansion_stop(F.col("sizes"), F.lit(5000)))
    visited = F.aggregate(F.slice("sizes", 1, F.col("last_hop") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return last.select("c_nationkey", "last_hop", visited.alias("visited"))


@query("""WITH d AS (SELECT source, count(*) AS n, ceil(count(*) / 4.0) AS w FROM documents GROUP BY 1), b AS (SELECT *, n * 2400 + 3200 AS base FROM d)
SELECT source, shape, CAST(ms AS DOUBLE) AS ms, CAST(tokens AS DOUBLE) AS tokens, CAST(messages AS BIGINT) AS messages FROM (
SELECT source, 'pipeline' AS shape, n * 900 + 1800 AS ms, base AS tokens, n AS messages FROM b
UNION ALL SELECT source, 'star', 300 + w * 900 + 1800, base + 400, 2 * n FROM b
UNION ALL SELECT source, 'tree', 300 + w * 1600 + 1800, base + 400 + w * 1100, 2 * n + w FROM b
UNION ALL SELECT source, 'mesh', w * 900 + (n - 1) * 300 + 1800, base + n * (n - 1) * 400, n * (n - 1) FROM b
UNION ALL SELECT source, 'debate', w * 900 + 3600 + 700, base + 3200 + 2200, n + 4 FROM b
UNION ALL SELECT source, 'loop', n * 900 + 3600 + 1400, base + 3200 + 2200, n + 3 FROM b)""")
def topologies(spark, d):
    """One report a source from its documents, on six shapes of agents."""
    n = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", F.explode(M.topologies(F.col("n"), F.lit(4))).alias("x")).select("source", "x.shape", "x.ms", "x.tokens", "x.messages")


@query("SELECT name, round(ms, 6) AS ms FROM (VALUES ('joined', 936.6), ('split', 89.6), ('hybrid', 172.9)) v(name, ms)")
def store_split(spark, d):
    n = spark.createDataFrame([("joined",), ("split",), ("hybrid",)], "name string")
    return n.select("name", F.round(M.store_load(3.0, 220.0, 4.2, 0.35, F.col("name")), 6).alias("ms"))


@query("""WITH c AS (SELECT event_type AS name, count(*) AS calls, CAST(length(event_type) AS DOUBLE) AS unit FROM events GROUP BY 1) SELECT name, calls * unit AS cost, round(calls * unit / sum(calls * unit) OVER (), 9) AS share FROM c""")
def monthly_cost(spark, d):
    c = t(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("calls")).withColumn("unit", F.length("name").cast("double"))
    return M.monthly_cost(c, "calls", "unit").select("name", "cost", F.round("share", 9).alias("share"))


@query("SELECT conv_id, round(count(*) * 40 * 0.003 / 1000, 9) AS cost FROM conversations GROUP BY 1")
def memory_context_cost(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.round(M.context_cost(F.count("*"), 40.0, 0.003), 9).alias("cost"))


@query("SELECT c_mktsegment AS claim, round(avg(c_acctbal), 6) AS survived FROM customer GROUP BY 1")
def claim_averages(spark, d):
    return t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("claim")).agg(F.round(F.avg("c_acctbal"), 6).alias("survived"))


# PAT ----------------------------------------------------------------------------------------------------------------
def shop(spark, d) -> P.GraphView:
    g = P.GraphView()
    g.node("Customer", t(spark, d, "customer"), "c_custkey").node("Nation", t(spark, d, "nation"), "n_nationkey").node("Order", t(spark, d, "orders"), "o_orderkey").node("Region", t(spark, d, "region"), "r_regionkey")
    g.edge("PLACED", t(spark, d, "orders"), "o_custkey", "o_orderkey").edge("LIVES_IN", t(spark, d, "customer"), "c_custkey", "c_nationkey").edge("PART_OF", t(spark, d, "nation"), "n_nationkey", "n_regionkey")
    return g.edge("SENDS", g_nations(spark, d), "src", "dst")


@query("SELECT c_custkey AS who, o_orderkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3) AND o_totalprice > 300000 AND c_acctbal > 0")
def cypher_match(spark, d):
    name = t(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    return P.cypher(shop(spark, d), "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation {n_name: $name}), (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 AND c.c_acctbal > 0 RETURN DISTINCT c.c_custkey AS who, o.o_orderkey AS ord", {"name": name})


@query(f"WITH RECURSIVE {SQL_NATIONS}, r(node, depth) AS (SELECT DISTINCT dst, 1 FROM g3 WHERE src = (SELECT min(src) FROM g3) UNION SELECT g3.dst, depth + 1 FROM r JOIN g3 ON g3.src = r.node WHERE depth < 2) SELECT DISTINCT CAST(node AS BIGINT) AS node FROM r")
def cypher_variable_length(spark, d):
    g = shop(spark, d)
    first = g.edges["SENDS"][0].agg(F.min("src")).first()[0]
    return P.cypher(g, "MATCH (a:Nation {n_nationkey: $first})-[:SENDS*1..2]->(b:Nation) RETURN DISTINCT b.n_nationkey AS node", {"first": first}).select(F.col("node").cast("long").alias("node"))


@query(f"WITH {SQL_NATIONS} SELECT x AS a, y AS b, count(*) AS n FROM (SELECT src AS x, dst AS y FROM g3 UNION ALL SELECT dst, src FROM g3) GROUP BY 1, 2")
def cypher_undirected(spark, d):
    """Without a direction every edge is found from both its ends."""
    return P.cypher(shop(spark, d), "MATCH (a:Nation)-[:SENDS]-(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, count(*) AS n").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


@query(f"WITH {SQL_NATIONS} SELECT x.src AS a, y.dst AS b, count(*) AS n FROM g3 x JOIN g3 y ON x.dst = y.src WHERE NOT (x.src = y.src AND x.dst = y.dst) GROUP BY 1, 2")
def cypher_two_hop_paths(spark, d):
    """A row for each path of exactly two hops: several paths between two nations count each."""
    g = shop(spark, d)
    return P.cypher(g, "MATCH (a:Nation)-[:SENDS*2]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, count(*) AS n").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


@query(f"WITH {SQL_NATIONS} SELECT x.src AS a, y.src AS c, count(*) AS n FROM g3 x JOIN g3 y ON x.dst = y.dst WHERE x.src <> y.src GROUP BY 1, 2")
def cypher_shared_target(spark, d):
    """One relationship is bound once, so a nation is no co-sender of itself."""
    return P.cypher(shop(spark, d), "MATCH (a:Nation)-[:SENDS]->(b:Nation)<-[:SENDS]-(c:Nation) RETURN a.n_nationkey AS a, c.n_nationkey AS c, count(*) AS n").select(F.col("a").cast("long").alias("a"), F.col("c").cast("long").alias("c"), "n")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0), r(a, b) AS (SELECT a, b FROM e UNION ALL SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM r")
def cypher_unbounded_path(spark, d):
    n = t(spark, d, "nation")
    g = P.GraphView().node("Nation", n, "n_nationkey").edge("NEXT", n.where("n_nationkey > 0").select(F.col("n_nationkey").alias("src"), F.floor(F.col("n_nationkey") / 2).alias("dst")), "src", "dst")
    return P.cypher(g, "MATCH (a:Nation)-[:NEXT*]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("SELECT c_custkey AS who FROM customer WHERE c_acctbal > 5000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def cypher_exists(spark, d):
    return P.cypher(shop(spark, d), "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order {o_orderpriority: '1-URGENT'}) } AND c.c_acctbal > 5000 RETURN c.c_custkey AS who")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT -1, 'NEW'")
def cypher_writes(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    c = P.set_property(c, F.col("c_acctbal") < 0, "segment", "DEBT")
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    left, _ = P.delete_nodes(c, "id", e, c.where("id % 10 = 0"))
    return P.create_rows(left.select("id", "segment"), spark.createDataFrame([(-1, "NEW")], "id long, segment string"))


@query("SELECT nation, n FROM (SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) WHERE n > 5 ORDER BY n DESC, nation LIMIT 5")
def gql_chaining(spark, d):
    return P.cypher(shop(spark, d), "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WITH n.n_name AS nation, count(*) AS n FILTER n > 5 RETURN nation, n ORDER BY n DESC, nation LIMIT 5")


def shop_triples(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    cid, nid = F.concat(F.lit("c:"), "c_custkey"), F.concat(F.lit("n:"), "c_nationkey")
    tr = c.select(cid.alias("s"), F.lit("a").alias("p"), F.lit("ex:Customer").alias("o")).union(c.select(cid, F.lit("ex:lives"), nid)).union(c.select(cid, F.lit("ex:balance"), F.col("c_acctbal").cast("string")))
    return tr.union(n.select(F.concat(F.lit("n:"), "n_nationkey"), F.lit("ex:partOf"), F.concat(F.lit("r:"), "n_regionkey"))).union(n.where("n_nationkey > 0").select(F.concat(F.lit("n:"), "n_nationkey"), F.lit("ex:next"), F.concat(F.lit("n:"), F.floor(F.col("n_nationkey") / 2))))


@query("SELECT 'c:' || c_custkey AS who, 'n:' || c_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_acctbal > 4000")
def sparql_select(spark, d):
    return P.sparql(shop_triples(spark, d), 'PREFIX ex: <http://example.org/> SELECT ?who ?nation WHERE { ?who a ex:Customer ; ex:lives ?nation ; ex:balance ?b . ?nation ex:partOf <r:1> . FILTER(?b > 4000) } ORDER BY ?who')


@query("SELECT 'http://example.org/c' || c_custkey AS who, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def sparql_full_iris(spark, d):
    """Prefixed names find full IRIs, as N-Triples hold them."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    iri = lambda kind, x: F.concat(F.lit(f"http://example.org/{kind}"), x)
    tr = c.select(iri("c", "c_custkey").alias("s"), F.lit(P.RDF_TYPE).alias("p"), F.lit("http://example.org/Customer").alias("o"))
    tr = tr.union(c.select(iri("c", "c_custkey"), F.lit("http://example.org/lives"), iri("n", "c_nationkey"))).union(n.select(iri("n", "n_nationkey"), F.lit("http://example.org/name"), "n_name"))
    tr = tr.union(n.select(iri("n", "n_nationkey"), F.lit("http://example.org/partOf"), iri("r", "n_regionkey")))
    return P.sparql(tr, "PREFIX ex: <http://example.org/> SELECT ?who ?name WHERE { ?who a ex:Customer ; ex:lives ?n . ?n ex:partOf ex:r2 ; ex:name ?name . }")


@query("WITH RECURSIVE e AS (SELECT 'n:' || n_nationkey AS a, 'n:' || (n_nationkey // 2) AS b FROM nation WHERE n_nationkey > 0), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, b FROM r WHERE a <> b")
def sparql_path(spark, d):
    return P.sparql(shop_triples(spark, d), "PREFIX ex: <http://example.org/> SELECT DISTINCT ?a ?b WHERE { ?a ex:next+ ?b . }")


@query("SELECT nation, count(*) AS n FROM (SELECT c_custkey AS who, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) GROUP BY nation")
def pgq_graph_table(spark, d):
    return P.graph_table(shop(spark, d), "SELECT nation, count(*) AS n FROM GRAPH_TABLE (shop MATCH (c IS Customer)-[:LIVES_IN]->(n IS Nation) WHERE c.c_acctbal > 0 COLUMNS (c.c_custkey AS who, n.n_name AS nation)) GROUP BY nation")


@query("SELECT false AS nested_loop, true AS joined")
def explain_lint(spark, d):
    df = P.cypher(shop(spark, d), "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS who, o.o_orderkey AS ord")
    return spark.createDataFrame([(bool(P.lint_plan(df)), any("Join" in n for n in P.plan_operators(df)))], "nested_loop boolean, joined boolean")


@query("SELECT true AS same")
def languages_agree(spark, d):
    """One question in Cypher, SPARQL, SQL/PGQ and as joins: the same answer."""
    from loomgraph.operators.relational import same_rows

    a = P.cypher(shop(spark, d), "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:PART_OF]->(r:Region {r_regionkey: 2}) RETURN c.c_custkey AS who")
    b = P.sparql(shop_triples(spark, d), "PREFIX ex: <http://example.org/> SELECT ?c WHERE { ?c ex:lives ?n . ?n ex:partOf <r:2> . }").select(F.regexp_extract("c", "[0-9]+", 0).cast("long").alias("who"))
    c = P.graph_table(shop(spark, d), "SELECT who FROM GRAPH_TABLE (shop MATCH (c IS Customer)-[:LIVES_IN]->(n IS Nation)-[:PART_OF]->(r IS Region) WHERE r.r_regionkey = 2 COLUMNS (c.c_custkey AS who))")
    e = t(spark, d, "customer").join(t(spark, d, "nation").where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("who"))
    return spark.createDataFrame([(same_rows(a, b) and same_rows(b, c) and same_rows(c, e),)], "same boolean")


# SRC ----------------------------------------------------------------------------------------------------------------
@query("SELECT page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return SR.page_links(t(spark, d, "pages"))


@query("SELECT page_id, url AS s, 'a' AS p, 'WebPage' AS o FROM pages UNION ALL SELECT page_id, url, 'author', '_:b1' FROM pages UNION ALL SELECT page_id, '_:b1', 'name', 'A' || page_id FROM pages UNION ALL SELECT page_id, url, 'url', url FROM pages")
def jsonld_triples(spark, d):
    body = F.concat(F.lit('<script type="application/ld+json">{"@context": "x", "@type": "WebPage", "url": "'), F.col("url"), F.lit('", "author": {"name": "A'), F.col("page_id"), F.lit('"}}</script>'))
    return SR.jsonld_triples(t(spark, d, "pages").select("page_id", F.concat("html", body).alias("html"), "url"), "page_id", "html")


@query("SELECT id, id % 7 AS grp FROM (SELECT unnest(range(0, 1000)) AS id)")
def series(spark, d):
    return SR.series(spark, 1000, 7)


@query("SELECT i AS src, i + 1 AS dst FROM (SELECT unnest(range(0, 400)) AS i) WHERE i % 20 < 19 UNION ALL SELECT i, i + 20 FROM (SELECT unnest(range(0, 400)) AS i) WHERE i < 380")
def grid_generator(spark, d):
    return SR.grid_dag(spark, 20, 20)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_bulk_load(spark, d):
    from loomgraph.storage import new_path

    path = new_path(spark, "csv")
    t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path)
    return SR.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT 'http://x/c' || c_custkey AS s, 'http://x/name' AS p, c_name AS o, 'literal' AS o_kind FROM customer")
def ntriples_reader(spark, d):
    from loomgraph.storage import new_path

    path = new_path(spark, "nt")
    line = F.concat(F.lit("<http://x/c"), F.col("c_custkey"), F.lit('> <http://x/name> "'), F.col("c_name"), F.lit('" .'))
    t(spark, d, "customer").select(line.alias("value")).write.text(path)
    return SR.read_ntriples(spark, path).select("s", "p", "o", "o_kind")


@query("SELECT 'ex:n' || n_nationkey AS s, 'ex:region' AS p, CAST(n_regionkey AS VARCHAR) AS o, 'xsd:integer' AS o_datatype FROM nation UNION ALL SELECT 'ex:n' || n_nationkey, 'a', 'ex:Nation', NULL FROM nation")
def turtle_reader(spark, d):
    from loomgraph.storage import new_path

    path = new_path(spark, "ttl")
    line = F.concat(F.lit("ex:n"), F.col("n_nationkey"), F.lit(" a ex:Nation ; ex:region "), F.col("n_regionkey"), F.lit(" ."))
    head = spark.createDataFrame([("@prefix ex: <http://example.org/> .",)], "value string")
    head.union(t(spark, d, "nation").select(line)).coalesce(1).write.text(path)
    return SR.read_turtle(spark, path).select("s", "p", "o", "o_datatype")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def tool_functions(spark, d):
    c = t(spark, d, "customer")
    SR.register_tools(spark, c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"), F.lit(None).cast("string").alias("boss")))
    return spark.sql("SELECT * FROM team_members(:team)", args={"team": c.agg(F.min("c_mktsegment")).first()[0]})


@query("WITH RECURSIVE r(level, id) AS (SELECT 0, max(c_custkey) FROM customer UNION ALL SELECT level + 1, id // 10 FROM r WHERE id // 10 > 0) SELECT level, CAST(id AS VARCHAR) AS id, c_name AS name FROM r JOIN customer ON c_custkey = id")
def chain_of_command(spark, d):
    c = t(spark, d, "customer")
    boss = F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10).cast("string"))
    SR.register_tools(spark, c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"), boss.alias("boss")))
    return spark.sql("SELECT * FROM chain_of_command(:who)", args={"who": str(c.agg(F.max("c_custkey")).first()[0])})


@query("SELECT * FROM (VALUES ('chain_of_command', 'whose', 'STRING'), ('find_person', 'who', 'STRING'), ('team_members', 'which', 'STRING')) v(tool, parameter, type)")
def tool_discovery(spark, d):
    """What a client learns of the tools before it calls one."""
    chain_of_command(spark, d)
    return SR.tool_schemas(spark)


@query("SELECT kind, 2500 AS at_least, true AS in_range FROM (VALUES ('a'), ('b'), ('c')) v(kind)")
def random_rows(spark, d):
    """Ten thousand drawn rows: each of three kinds about equally often, all numbers in their range."""
    r = SR.random_rows(spark, 10_000, {"kind": ["a", "b", "c"], "age": (18, 80)})
    return r.groupBy("kind").agg(F.when(F.count("*") >= 2500, 2500).otherwise(F.count("*")).cast("int").alias("at_least"), ((F.min("age") >= 18) & (F.max("age") < 80)).alias("in_range"))


@query("SELECT 5997 AS links, true AS earlier, true AS skewed")
def preferential_graph(spark, d):
    """2,000 nodes of three links each, all to earlier nodes; the busiest node has far more than the mean of six."""
    e = SR.preferential_graph(spark, 2000, 3)
    deg = e.select(F.col("src").alias("n")).union(e.select("dst")).groupBy("n").agg(F.count("*").alias("deg"))
    return e.agg(F.count("*").cast("int").alias("links"), F.every(F.col("dst") < F.col("src")).alias("earlier")).join(F.broadcast(deg.agg((F.max("deg") > 40).alias("skewed"))))  # one row each


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band FROM events")
def column_extension(spark, d):
    band = FX.column_function("band")(lambda c: F.when(c > 50, "high").otherwise("low"))
    return t(spark, d, "events").select("event_id", band(F.col("value")).alias("band"))


# streaming ----------------------------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    return ST.tumbling_counts(t(spark, d, "events"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def session_window(spark, d):
    return ST.sessions(t(spark, d, "events"))


@query("""SELECT user_id, arg_max(event_type, event_id) <> 'error' AS live, max(event_id) AS seq FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1""")
def streaming_replay(spark, d):
    """The events as a stream, folded by a stateful operator; the last state of each user equals the batch replay."""
    from loomgraph.storage import new_path

    src = new_path(spark, "stream")
    e = t(spark, d, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    e = e.select("user_id", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"))
    e.repartition(2, "event_id").write.parquet(src)
    stream = ST.read_events(spark, src, e.schema)
    out = ST.run_once(ST.stateful_replay(stream), f"replay_{uuid.uuid4().hex}", new_path(spark, "cp"), "update")
    return out.groupBy("user_id").agg(F.max_by("live", "seq").alias("live"), F.max("seq").alias("seq"))


