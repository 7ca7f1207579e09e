"""Time, events, entity resolution, text, validation, lineage and conflicts over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import concurrency as C
from loomgraph.operators import events as E
from loomgraph.operators import lineage as L
from loomgraph.operators import models as M
from loomgraph.operators import relational as R
from loomgraph.operators import resolve as X
from loomgraph.operators import retrieval as Q
from loomgraph.operators import temporal as TM
from loomgraph.operators import validate as V
from loomgraph.queries.base import SQL_SUPPLIERS, query, supplier_links, t
from loomgraph.storage import materialize

# TMP ----------------------------------------------------------------------------------------------------------------
SQL_FACTS = """f AS (SELECT CAST(o_custkey AS VARCHAR) AS s, 'status' AS p, o_orderstatus AS value, CAST(o_orderdate AS DATE) AS valid_from,
    coalesce(CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), DATE '9999-12-31') AS valid_to,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS tx_from, DATE '9999-12-31' AS tx_to FROM orders)"""


def order_facts(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    forever = F.lit(TM.FOREVER).cast("date")
    day = F.col("o_orderdate").cast("date")
    return t(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("value"), day.alias("valid_from"),
        F.coalesce(F.lead(day).over(w), forever).alias("valid_to"), F.date_add(day, (F.col("o_orderkey") % 30).cast("int")).alias("tx_from"), forever.alias("tx_to"),
    )


@query(f"WITH {SQL_FACTS} SELECT s, value, valid_from FROM f WHERE valid_from <= DATE '1996-01-01' AND DATE '1996-01-01' < valid_to AND tx_from <= DATE '1996-01-10' AND DATE '1996-01-10' < tx_to")
def bitemporal_as_of(spark, d):
    return TM.as_of(order_facts(spark, d), "1996-01-01", "1996-01-10").select("s", "value", "valid_from")


@query(f"""WITH {SQL_FACTS}, x AS (SELECT *, s = '7' AND tx_to = DATE '9999-12-31' AND valid_from < DATE '1997-01-01' AND DATE '1997-01-01' < valid_to AS hit FROM f)
SELECT s, value, valid_from, valid_to, tx_from, CASE WHEN hit THEN DATE '1999-01-01' ELSE tx_to END AS tx_to FROM x
UNION ALL SELECT s, value, valid_from, DATE '1997-01-01', DATE '1999-01-01', DATE '9999-12-31' FROM x WHERE hit
UNION ALL SELECT '7', 'X', DATE '1997-01-01', DATE '9999-12-31', DATE '1999-01-01', DATE '9999-12-31'""")
def bitemporal_assert(spark, d):
    return TM.assert_fact(order_facts(spark, d), "7", "status", "X", "1997-01-01", "1999-01-01").select("s", "value", "valid_from", "valid_to", "tx_from", "tx_to")


@query(f"""WITH {SQL_FACTS}, m AS (SELECT min(valid_from) AS v FROM f WHERE s = '7')
SELECT s, value, valid_from, valid_to, tx_from, CASE WHEN s = '7' AND valid_from = v AND tx_to = DATE '9999-12-31' THEN DATE '1999-01-01' ELSE tx_to END AS tx_to FROM f, m
UNION ALL SELECT '7', 'Y', v, DATE '9999-12-31', DATE '1999-01-01', DATE '9999-12-31' FROM m""")
def bitemporal_correct(spark, d):
    f = order_facts(spark, d)
    first = f.where("s = '7'").agg(F.min("valid_from")).first()[0]
    return TM.correct(f, "7", "status", "Y", str(first), "1999-01-01").select("s", "value", "valid_from", "valid_to", "tx_from", "tx_to")


@query(f"WITH {SQL_FACTS} SELECT s, value, tx_from, valid_from FROM f WHERE s IN ('7', '8') AND p = 'status'")
def bitemporal_history(spark, d):
    f = order_facts(spark, d)
    return TM.history(f, "7", "status").union(TM.history(f, "8", "status")).select("s", "value", "tx_from", "valid_from")


@query(f"WITH {SQL_FACTS} SELECT op, count(*) AS n, min(day) AS first_at, max(day) AS last_at FROM (SELECT valid_from AS day, 'add' AS op FROM f UNION ALL SELECT valid_to, 'delete' FROM f WHERE valid_to < DATE '9999-12-31') GROUP BY 1")
def intervals_to_events(spark, d):
    return TM.to_events(order_facts(spark, d)).groupBy("op").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type IN ('purchase', 'error'))
SELECT user_id, ts AS valid_from, coalesce(nxt, TIMESTAMP '9999-12-31') AS valid_to FROM e WHERE event_type = 'purchase'""")
def events_to_intervals(spark, d):
    e = t(spark, d, "events").where(F.col("event_type").isin("purchase", "error")).select("user_id", "event_id", F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "add").otherwise("delete").alias("op"))
    return TM.to_intervals(e, ["user_id"], ["at", "event_id"])


@query("SELECT model, CAST(CASE model WHEN 'current' THEN 1000 * 5 WHEN 'valid' THEN 1000 * 5 + 1000 * 5 * 12 * 10 ELSE 1000 * 5 + 1000 * 5 * 12 * 10 * 1.3 END AS BIGINT) AS n_rows FROM (VALUES ('current'), ('valid'), ('bitemporal')) v(model)")
def storage_growth(spark, d):
    m = spark.createDataFrame([("current",), ("valid",), ("bitemporal",)], "model string")
    return m.select("model", F.round(TM.storage_rows(F.col("model"), F.lit(1000), F.lit(5), F.lit(12), F.lit(10))).cast("long").alias("n_rows"))


@query(f"""WITH {SQL_FACTS}, r AS (SELECT CAST(c_custkey AS VARCHAR) AS s, DATE '1995-06-01' AS read_at FROM customer),
v AS (SELECT r.s, max(CASE WHEN valid_from <= read_at AND read_at < valid_to THEN value END) AS a, max(CASE WHEN valid_from <= DATE '1998-06-01' AND DATE '1998-06-01' < valid_to THEN value END) AS b FROM r JOIN f ON f.s = r.s GROUP BY 1)
SELECT s, CASE WHEN a IS NOT DISTINCT FROM b THEN 'proceed' ELSE 'stop' END AS verdict FROM v""")
def staleness(spark, d):
    reads = t(spark, d, "customer").select(F.lit("run1").alias("run"), F.col("c_custkey").cast("string").alias("s"), F.lit("status").alias("p"), F.lit("1995-06-01").cast("date").alias("read_at"))
    return TM.staleness(reads, order_facts(spark, d), "1998-06-01").select("s", "verdict")


@query("""SELECT event_type AS kind, count(*) AS kept FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') <= CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 10 ELSE 30 END OR CAST(floor(value) AS BIGINT) % 4 >= 2 GROUP BY 1""")
def typed_retention(spark, d):
    m = t(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("at"), (F.floor("value") % 4).alias("uses"))
    return TM.keep_typed(m, {"click": 5, "view": 10}, F.lit("2024-01-31").cast("date")).groupBy("kind").agg(F.count("*").alias("kept"))


# EVT ----------------------------------------------------------------------------------------------------------------
SQL_OPS = """ev AS (SELECT event_id AS seq, user_id, CAST(user_id AS VARCHAR) AS actor, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS value, value / 100 AS conf,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op FROM events WHERE event_type IN ('purchase', 'signup', 'error'))"""


def ops(spark, d):
    e = t(spark, d, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("add")
    return e.select(F.col("event_id").alias("seq"), "user_id", F.col("user_id").cast("string").alias("actor"), (F.floor("value") % 3).cast("string").alias("value"), (F.col("value") / 100).alias("conf"), op.alias("op"))


@query(f"WITH {SQL_OPS} SELECT user_id, value FROM ev WHERE seq <= 7000 GROUP BY 1, 2 HAVING arg_max(op, seq) = 'add'")
def replay_to_cut(spark, d):
    return E.replay(ops(spark, d), ["user_id", "value"], F.col("seq"), F.col("seq") <= 7000)


@query(f"WITH {SQL_OPS} SELECT user_id, value FROM ev GROUP BY 1, 2 HAVING arg_max(op, seq) = 'add'")
def snapshot_and_tail(spark, d):
    e = ops(spark, d)
    snapshot = E.stored_snapshot(e, ["user_id", "value"], "seq", 5000)
    return E.replay_from_snapshot(snapshot, e.where("seq > 5000"), ["user_id", "value"], "seq")


@query(f"WITH {SQL_OPS} SELECT seq, actor, op FROM ev WHERE user_id = 3 AND value = '1'")
def fact_trail(spark, d):
    e = ops(spark, d).withColumn("at", F.lit(""))
    return E.trail(e, (F.col("user_id") == 3) & (F.col("value") == "1")).drop("at")


@query(f"WITH {SQL_OPS} SELECT d.seq FROM ev d WHERE op = 'delete' AND user_id % 2 = 0 AND EXISTS (SELECT 1 FROM ev a WHERE a.op = 'add' AND a.user_id = d.user_id AND a.value = d.value)")
def added_then_deleted(spark, d):
    e = ops(spark, d)
    return E.added_then_deleted(e, ["user_id", "value"], F.lit(True), F.col("user_id") % 2 == 0).select("seq")


@query(f"WITH {SQL_OPS} SELECT user_id, arg_max(value, seq) AS value FROM ev GROUP BY 1 HAVING arg_max(op, seq) <> 'delete'")
def fold_last_write(spark, d):
    return E.last_write_wins(ops(spark, d), "user_id")


@query(f"WITH {SQL_OPS} SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conf DESC, seq) AS n FROM ev WHERE op <> 'delete') WHERE n = 1")
def fold_confidence(spark, d):
    return E.highest_confidence(ops(spark, d), "user_id")


@query(f"""WITH {SQL_OPS}, r AS (SELECT *, CAST(seq % 3 AS INTEGER) AS rk FROM ev), m AS (SELECT *, max(rk) OVER (PARTITION BY user_id ORDER BY seq) AS top FROM r)
SELECT user_id, arg_max(value, seq) AS value FROM m WHERE rk = top GROUP BY 1 HAVING arg_max(op, seq) <> 'delete'""")
def fold_human_rank(spark, d):
    return E.rank_wins(ops(spark, d), "user_id", (F.col("seq") % 3).cast("int"))


@query(f"WITH {SQL_OPS}, l AS (SELECT user_id, value FROM ev GROUP BY 1, 2 HAVING arg_max(op, seq) = 'add') SELECT user_id, string_agg(value, ' / ' ORDER BY value) AS value FROM l GROUP BY 1")
def fold_accumulate(spark, d):
    return E.accumulate(ops(spark, d), "user_id")


SQL_HASH = """substr(sha256('[' || seq || ', "' || day || '", "' || actor || '", "' || op || '", ' || payload || ', "' || prev || '"]'), 1, 16)"""


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS actor, event_type AS op, '{{"k": 1}}' AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, n, {SQL_HASH.replace("prev", "''")} AS hash FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, {SQL_HASH.replace("prev", "c.hash")} FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, count(*) AS links, CAST(0 AS BIGINT) AS faults, arg_max(hash, n) AS head FROM c GROUP BY 1""")
def hash_chain(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("at"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("op"), F.lit('{"k": 1}').alias("payload"))
    chain = materialize(E.build_chain(e, ["user_id"]), "chain")
    faults = E.verify_chain(chain, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("f"))
    heads = chain.groupBy("user_id").agg(F.count("*").alias("links"), F.max_by("hash", "seq").alias("head"))
    return heads.join(faults, "user_id", "left").select("user_id", "links", F.coalesce("f", F.lit(0)).alias("faults"), "head")


@query("""SELECT user_id, event_id, date_diff('minute', date_trunc('minute', ts), date_trunc('minute', answered)) AS minutes FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answered FROM events) WHERE event_type = 'signup'""")
def decision_latency(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    e = t(spark, d, "events").withColumn("answered", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)).where("event_type = 'signup'")
    e = e.select("user_id", "event_id", F.date_trunc("minute", "ts").alias("asked"), F.date_trunc("minute", "answered").alias("answered"))
    return E.decisions(e, ["user_id", "event_id"])


# ENT ----------------------------------------------------------------------------------------------------------------
SQL_BLOCK = """blk AS (SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND (a.s_nationkey = b.s_nationkey OR CAST(floor(a.s_acctbal / 100) AS BIGINT) = CAST(floor(b.s_acctbal / 100) AS BIGINT)))"""


def supplier_keys():
    return {"nation": F.col("s_nationkey").cast("long"), "balance": F.floor(F.col("s_acctbal") / 100).cast("long")}


def supplier_pairs(spark, d):
    s = t(spark, d, "supplier")
    return X.candidate_pairs(s, supplier_keys(), "s_suppkey")


@query(f"WITH {SQL_BLOCK} SELECT a, b FROM blk")
def blocking_union(spark, d):
    return supplier_pairs(spark, d)


SQL_SCORED = f"""{SQL_BLOCK}, sc AS (SELECT blk.a, blk.b, x.s_nationkey = y.s_nationkey AS same,
    round((CASE WHEN x.s_acctbal > 0 AND y.s_acctbal > 0 THEN 2.0 * (CASE WHEN abs(x.s_acctbal - y.s_acctbal) < 500 THEN 1.0 ELSE 0.0 END) ELSE 0.0 END + 1.0 * (CASE WHEN x.s_nationkey % 5 = y.s_nationkey % 5 THEN 1.0 ELSE 0.0 END)) / (CASE WHEN x.s_acctbal > 0 AND y.s_acctbal > 0 THEN 3.0 ELSE 1.0 END), 9) AS score
    FROM blk JOIN supplier x ON x.s_suppkey = blk.a JOIN supplier y ON y.s_suppkey = blk.b)"""


def scored_pairs(spark, d):
    s = t(spark, d, "supplier")
    j = R.met_in_blocks(s, list(supplier_keys().values()), "s_suppkey", ["s_nationkey", "s_acctbal"])
    j = j.select("a", "b", *[F.col(f"{side}.s_{f}").alias(n) for side, f, n in (("x", "nationkey", "na"), ("x", "acctbal", "ba"), ("y", "nationkey", "nb"), ("y", "acctbal", "bb"))])
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = X.weighted_score([(2.0, (F.col("ba") > 0) & (F.col("bb") > 0), one(F.abs(F.col("ba") - F.col("bb")) < 500)), (1.0, F.lit(True), one(F.col("na") % 5 == F.col("nb") % 5))])
    return j.select("a", "b", (F.col("na") == F.col("nb")).alias("same"), score.alias("score"))


@query(f"WITH {SQL_SCORED} SELECT a, b, score, CASE WHEN score >= 0.85 THEN 'auto' WHEN score >= 0.55 THEN 'review' ELSE 'reject' END AS verdict FROM sc")
def pair_scores(spark, d):
    return scored_pairs(spark, d).select("a", "b", "score", X.verdict(F.col("score")).alias("verdict"))


@query(f"""WITH RECURSIVE {SQL_SCORED}, e AS (SELECT a AS x, b AS y FROM sc WHERE score >= 0.85 UNION ALL SELECT b, a FROM sc WHERE score >= 0.85), r(n, m) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.n, e.y FROM r JOIN e ON e.x = r.m)
SELECT n AS s_suppkey, min(m) AS cluster FROM r GROUP BY 1""")
def entity_clusters(spark, d):
    return X.clusters(t(spark, d, "supplier"), scored_pairs(spark, d).where("score >= 0.85").select("a", "b"), "s_suppkey", unique=True)


@query("""WITH RECURSIVE l AS (SELECT s_suppkey AS dropped, CAST(floor(s_suppkey / 2) AS BIGINT) AS kept FROM supplier WHERE s_suppkey % 3 <> 0 AND floor(s_suppkey / 2) >= 1), r(id, root) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION ALL SELECT r.id, l.kept FROM r JOIN l ON l.dropped = r.root)
SELECT id, min(root) AS root FROM r GROUP BY 1""")
def reversible_merge(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    log = s.where("id % 3 <> 0 and floor(id / 2) >= 1").select(F.col("id").alias("seq"), F.floor(F.col("id") / 2).alias("kept"), F.col("id").alias("dropped"), F.lit(False).alias("undone"))
    undone = s.where("id % 3 = 0 and floor(id / 2) >= 1").select(F.col("id").alias("seq"), F.floor(F.col("id") / 2).alias("kept"), F.col("id").alias("dropped"), F.lit(True).alias("undone"))
    return X.apply_merges(s, log.union(undone))


@query(f"""WITH {SQL_SCORED}, th AS (SELECT unnest([0.3, 0.6, 0.9]) AS threshold), c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= threshold AND same) AS tp, count(*) FILTER (score >= threshold AND NOT same) AS fp, count(*) FILTER (score < threshold AND same) AS fn FROM sc, th GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM c""")
def threshold_sweep(spark, d):
    return X.threshold_sweep(scored_pairs(spark, d), [0.3, 0.6, 0.9])


@query("""SELECT o_custkey, arg_max(o_orderstatus, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS latest_status, (SELECT o2.o_orderpriority FROM orders o2 WHERE o2.o_custkey = o.o_custkey ORDER BY length(o2.o_orderpriority) DESC, o2.o_orderkey LIMIT 1) AS longest_priority FROM orders o GROUP BY 1""")
def survivorship(spark, d):
    rules = {"o_orderstatus": ("latest_status", [F.col("o_orderdate"), F.col("o_orderkey")]), "o_orderpriority": ("longest_priority", [F.length("o_orderpriority"), -F.col("o_orderkey")])}
    return X.survivor(t(spark, d, "orders"), ["o_custkey"], rules)


# TXT ----------------------------------------------------------------------------------------------------------------
@query("""WITH b AS (SELECT item_id AS id, regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g') AS s FROM benchmark), g AS (SELECT id, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS gram FROM b WHERE length(s) >= 2), tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2),
idf AS (SELECT gram, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1), w AS (SELECT id, gram, tf * idf AS w FROM tf JOIN idf USING (gram)), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1), v AS (SELECT id, gram, w / n AS w FROM w JOIN n USING (id)),
s AS (SELECT a.id AS query_id, b.id AS item_id, round(sum(a.w * b.w), 6) AS score FROM v a JOIN v b USING (gram) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id DESC) AS INTEGER) AS rank FROM s) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 3""")
def tfidf_top_k(spark, d):
    b = t(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return Q.tfidf_search(b, "item_id", "text", q, "query_id", "q", 3)


@query("""WITH a AS (SELECT c_custkey AS id, 1 AS list_no, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), b AS (SELECT o_custkey AS id, 2 AS list_no, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY 1), u AS (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY 1""")
def rank_fusion(spark, d):
    a = t(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    a = a.select(F.col("c_custkey").alias("id"), F.lit(1).alias("list_no"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))
    b = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(50)
    b = b.select("id", F.lit(2).alias("list_no"), F.row_number().over(Window.orderBy(F.desc("n"), "id")).alias("rank"))
    return Q.reciprocal_rank_fusion(a.union(b), "id").select("id", F.round("score", 9).alias("score"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 45), g AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_tax > 0.07), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM f)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def extraction_quality(spark, d):
    l = t(spark, d, "lineitem")
    out = Q.precision_recall(l.where("l_quantity > 45"), l.where("l_tax > 0.07"), ["l_suppkey", "l_returnflag"])
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT doc_id, CASE WHEN NOT contains(regexp_replace(text, '\\s+', '', 'g'), 'LicensedundertheApacheLicense') THEN 'no evidence' WHEN regexp_matches(substr(text, greatest(strpos(text, 'Licensed under the Apache License') - 20, 1), 33 + 40 + least(strpos(text, 'Licensed under the Apache License') - 1, 20)), 'idiot|maybe') AND strpos(text, 'Licensed under the Apache License') > 0 THEN 'hedged' ELSE 'ok' END AS grounding FROM documents""")
def grounding_checks(spark, d):
    quote = F.lit("Licensed under the Apache License")
    return t(spark, d, "documents").select("doc_id", Q.grounding(F.col("text"), quote, F.lit("Apache"), ["idiot", "maybe"]).alias("grounding"))


@query("""WITH old AS (SELECT l_suppkey % 5 AS doc, l_suppkey AS s, l_linenumber AS p, max(l_partkey) AS o FROM lineitem GROUP BY 1, 2, 3), new AS (SELECT doc, s, p, o + 1 AS o FROM old WHERE doc = 2), man AS (SELECT s, p, o FROM old WHERE p = 1)
SELECT doc, s, p, o FROM old WHERE doc <> 2 UNION SELECT doc, s, p, o FROM old WHERE p = 1 UNION SELECT doc, s, p, o FROM new WHERE p <> 1""")
def careful_re_extraction(spark, d):
    l = t(spark, d, "lineitem")
    old = l.groupBy((F.col("l_suppkey") % 5).alias("doc"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("p")).agg(F.max("l_partkey").alias("o"))
    new = old.where("doc = 2").withColumn("o", F.col("o") + 1)
    return Q.careful_merge(old, new, old.where("p = 1"), 2)[0]


@query("""WITH k AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'see' END AS c FROM events) SELECT c IS NULL AS held, count(*) AS n, count(DISTINCT event_type) AS terms FROM k GROUP BY 1""")
def hold_queue(spark, d):
    k = t(spark, d, "events").select("event_type", S.canonical(F.col("event_type"), {"click": "touch", "view": "see"}).alias("c"))
    return k.groupBy(F.col("c").isNull().alias("held")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("terms"))


@query("SELECT method, CAST(docs * per_doc + communities * per_comm AS BIGINT) AS first_cost FROM (SELECT count(*) AS docs FROM documents), (VALUES ('flat', 1, 0, 0), ('graph', 3, 20, 50)) v(method, per_doc, communities, per_comm)")
def approach_costs(spark, d):
    n = t(spark, d, "documents").agg(F.count("*").alias("docs"))
    m = spark.createDataFrame([("flat", 1, 0, 0), ("graph", 3, 20, 50)], "method string, per_doc int, communities int, per_comm int")
    return m.select("method", (n.select("docs").scalar() * F.col("per_doc") + F.col("communities") * F.col("per_comm")).cast("long").alias("first_cost"))


# VAL ----------------------------------------------------------------------------------------------------------------
@query("""SELECT 'part:' || p_partkey AS node, 'size' AS path, 'Violation' AS severity, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size < 5
UNION ALL SELECT 'part:' || p_partkey, 'brand', 'Warning', p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-4]')
UNION ALL SELECT 'part:' || p_partkey, 'supplier', 'Info', NULL FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def shacl_report(spark, d):
    p = t(spark, d, "part")
    node = F.concat(F.lit("part:"), F.col("p_partkey"))
    tr = p.select(node.alias("s"), F.lit("a").alias("p"), F.lit("Part").alias("o"))
    tr = tr.union(p.select(node, F.lit("size"), F.col("p_size").cast("string"))).union(p.select(node, F.lit("brand"), "p_brand"))
    l = t(spark, d, "lineitem").where("l_quantity > 48").select(F.concat(F.lit("part:"), "l_partkey").alias("s"), F.lit("supplier").alias("p"), F.col("l_suppkey").cast("string").alias("o"))
    shapes = [V.Shape("Part", "size", "Violation", min_count=1, min_inclusive=5), V.Shape("Part", "brand", "Warning", pattern="^Brand#[1-4]"), V.Shape("Part", "supplier", "Info", min_count=1)]
    return V.validate_shapes(tr.union(l), shapes).select("node", "path", "severity", "value")


@query("""SELECT 'c' || c_custkey AS s, kind AS o FROM customer, (VALUES ('Customer'), ('Agent'), ('Thing')) v(kind) UNION SELECT 's' || s_suppkey, kind FROM supplier, (VALUES ('Supplier'), ('Agent'), ('Thing')) v(kind)""")
def rule_closure(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.lit("a").alias("p"), F.lit("Customer").alias("o"))
    s = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("s"), F.lit("a").alias("p"), F.lit("Supplier").alias("o"))
    onto = spark.createDataFrame([("Customer", "subClassOf", "Agent"), ("Supplier", "subClassOf", "Agent"), ("Agent", "subClassOf", "Thing")], "s string, p string, o string")
    return V.rule_closure(c.union(s).union(onto), []).where("p = 'a'").select("s", "o").distinct()


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0), r(a, b) AS (SELECT a, b FROM up UNION SELECT r.a, up.b FROM r JOIN up ON up.a = r.b)
SELECT 'n' || a AS s, 'partOf' AS p, 'n' || b AS o FROM r UNION SELECT 'c' || c_custkey, 'livesIn', 'n' || c_nationkey FROM customer UNION SELECT 'c' || c_custkey, 'a', kind FROM customer, (VALUES ('Person'), ('Agent')) v(kind) UNION SELECT 'n' || c_nationkey, 'a', 'Place' FROM customer""")
def rule_closure_all_rules(spark, d):
    """Transitive predicates, subclasses, domain and range at once; a type that nothing implies is not invented."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation").where("n_nationkey > 0")
    tr = n.select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit("partOf").alias("p"), F.concat(F.lit("n"), F.floor(F.col("n_nationkey") / 2)).alias("o"))
    tr = tr.union(c.select(F.concat(F.lit("c"), "c_custkey"), F.lit("livesIn"), F.concat(F.lit("n"), "c_nationkey")))
    onto = spark.createDataFrame([("livesIn", "domain", "Person"), ("livesIn", "range", "Place"), ("Person", "subClassOf", "Agent")], "s string, p string, o string")
    return V.rule_closure(tr.union(onto), ["partOf"]).where("p in ('partOf', 'livesIn', 'a')").select("s", "p", "o").distinct()


@query("SELECT 'fk' AS rule, l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2 UNION ALL SELECT 'unique', l_orderkey, n FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def relational_constraints(spark, d):
    l = t(spark, d, "lineitem")
    fk = V.foreign_key_violations(l, "l_orderkey", t(spark, d, "orders"), "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    u = V.unique_violations(l, ["l_orderkey", "l_linenumber"])
    return fk.select(F.lit("fk").alias("rule"), F.col("l_orderkey").alias("key"), "n").union(u.select(F.lit("unique"), "l_orderkey", "n"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 1000)) GROUP BY 1")
def all_or_nothing(spark, d):
    return V.all_or_nothing(t(spark, d, "orders"), "o_custkey", F.col("o_totalprice") > 1000).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT event_id, list_contains(f, 'value') AS bad_value, list_contains(f, 'kind') AS bad_kind FROM (SELECT event_id, list_filter([CASE WHEN NOT value < 90 THEN 'value' END, CASE WHEN NOT event_type IN ('click', 'view') THEN 'kind' END], lambda x: x IS NOT NULL) AS f FROM events) WHERE len(f) > 0")
def typed_load_check(spark, d):
    e = V.split_valid(t(spark, d, "events"), {"value": F.col("value") < 90, "kind": F.col("event_type").isin("click", "view")}).where(F.size("failed") > 0)
    return e.select("event_id", F.array_contains("failed", "value").alias("bad_value"), F.array_contains("failed", "kind").alias("bad_kind"))


@query("""WITH k AS (SELECT l_partkey AS node, count(*) AS deg FROM lineitem GROUP BY 1) SELECT 'supernode' AS smell, node FROM k WHERE deg > 1.5 * (SELECT avg(deg) FROM k)
UNION ALL SELECT 'orphan', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'duplicate', min(p_partkey) FROM part GROUP BY p_type, lower(p_name) HAVING count(*) > 1
UNION ALL SELECT 'multi-parent', l_orderkey FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_suppkey) > 6""")
def graph_smells(spark, d):
    l = t(spark, d, "lineitem")
    deg = l.groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("deg"))
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    dup = V.duplicate_names(t(spark, d, "part"), "p_type", F.lower("p_name"), "p_partkey").select(F.lit("duplicate").alias("smell"), F.col("first").alias("node"))
    multi = V.multi_parent(l.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))).where("parents > 6")
    return V.supernodes(deg, 1.5).select(F.lit("supernode").alias("smell"), "node").union(V.orphans(t(spark, d, "customer").select(F.col("c_custkey").alias("node")), o).select(F.lit("orphan"), "node")).union(dup).union(multi.select(F.lit("multi-parent"), "node"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey % 7 AS src, (c_nationkey * 3 + 1) % 11 AS dst FROM customer), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT CAST(a AS BIGINT) AS node FROM r WHERE a = b""")
def cycle_members(spark, d):
    e = t(spark, d, "customer").select((F.col("c_nationkey") % 7).cast("long").alias("src"), ((F.col("c_nationkey") * 3 + 1) % 11).cast("long").alias("dst"))
    return V.nodes_in_cycles(e)


@query("SELECT 'gone' AS change, p_partkey FROM part WHERE p_type LIKE '%E%' EXCEPT SELECT 'gone', p_partkey FROM part WHERE p_type LIKE '%E%' AND p_brand <> 'Brand#11'")
def competency_regression(spark, d):
    p = t(spark, d, "part").where("p_type like '%E%'")
    return V.regression_diff(p.select("p_partkey"), p.where("p_brand <> 'Brand#11'").select("p_partkey")).select("change", "p_partkey")


@query("SELECT p_brand, CASE WHEN f >= 0.7 THEN 'reuse' WHEN f >= 0.4 THEN 'wrap' ELSE 'build' END AS decision FROM (SELECT p_brand, count(*) FILTER (p_size > 20) / count(*) AS f FROM part GROUP BY 1)")
def vocabulary_reuse(spark, d):
    f = t(spark, d, "part").groupBy("p_brand").agg((F.count_if(F.col("p_size") > 20) / F.count("*")).alias("f"))
    return f.select("p_brand", V.reuse_decision(F.col("f")).alias("decision"))


@query("SELECT * FROM (VALUES ('api', 'store', 'skip'), ('store', 'api', 'upward'), ('agent', 'store', 'writer')) v(src, dst, rule)")
def architecture_rules(spark, d):
    layers = spark.createDataFrame([("api", 0), ("agent", 1), ("writer", 1), ("store", 2)], "name string, rank int")
    calls = spark.createDataFrame([("api", "agent"), ("api", "store"), ("store", "api"), ("agent", "store"), ("writer", "store")], "src string, dst string")
    return V.layer_rules(calls, layers, "writer", "store")


@query("SELECT event_type AS field, count(DISTINCT user_id) AS readers FROM events GROUP BY 1")
def breaking_change_readers(spark, d):
    return t(spark, d, "events").groupBy(F.col("event_type").alias("field")).agg(F.count_distinct("user_id").alias("readers"))


# LIN ----------------------------------------------------------------------------------------------------------------
SQL_TURNS = "lk AS (SELECT conv_id * 1000 + turn AS src, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations)"


def turn_links(spark, d):
    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), "conv_id", "turn")
    return c.withColumn("dst", F.lag("src").over(Window.partitionBy("conv_id").orderBy("turn"))).where("dst is not null").select("src", "dst")


@query(f"WITH RECURSIVE {SQL_TURNS}, r(node, hop) AS (SELECT max(src), 0 FROM lk UNION ALL SELECT lk.dst, hop + 1 FROM r JOIN lk ON lk.src = r.node WHERE lk.dst IS NOT NULL AND hop < 4) SELECT node, CAST(hop AS INTEGER) AS hop FROM r WHERE hop > 0")
def lineage_upstream(spark, d):
    last = t(spark, d, "conversations").agg(F.max(F.col("conv_id") * 1000 + F.col("turn")).alias("node"))
    return L.upstream(turn_links(spark, d), last, 4)


@query(f"WITH RECURSIVE {SQL_TURNS}, r(node, hop) AS (SELECT min(src), 0 FROM lk UNION ALL SELECT lk.src, hop + 1 FROM r JOIN lk ON lk.dst = r.node WHERE hop < 4) SELECT node, CAST(hop AS INTEGER) AS hop FROM r WHERE hop > 0")
def lineage_downstream(spark, d):
    first = t(spark, d, "conversations").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("node"))
    return L.downstream(turn_links(spark, d), first, 4)


@query("""WITH f AS (SELECT conv_id * 1000 + turn AS fact, conv_id, turn, role AS source FROM conversations), fd AS (SELECT conv_id, min(turn) AS t FROM f WHERE source = 'system' GROUP BY 1)
SELECT fact, CASE WHEN source = 'system' THEN 'direct' ELSE 'cascade' END AS how FROM f JOIN fd USING (conv_id) WHERE turn >= t""")
def retraction_cascade(spark, d):
    facts = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("fact"), F.col("role").alias("source"))
    return L.retract(facts, turn_links(spark, d).select(F.col("src").alias("fact"), F.col("dst").alias("base")), "system")


@query("SELECT l_suppkey AS entity, count(DISTINCT l_orderkey) AS runs FROM lineitem GROUP BY 1")
def backbone_runs(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.count_distinct("l_orderkey").alias("runs"))


@query("""SELECT 'out' AS direction, l_returnflag AS type, l_partkey AS other, count(*) AS n FROM lineitem WHERE l_suppkey = 7 GROUP BY 2, 3 UNION ALL SELECT 'in', l_returnflag, l_suppkey, count(*) FROM lineitem WHERE l_partkey = 7 GROUP BY 2, 3""")
def deletion_survey(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("dst"))
    return L.incident(e, 7)


@query(f"WITH RECURSIVE {SQL_SUPPLIERS}, r(n, h) AS (SELECT min(src), 0 FROM g2u UNION SELECT dst, h + 1 FROM r JOIN g2u ON src = n WHERE h < 1) SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS person, s_suppkey AS target FROM supplier WHERE s_suppkey IN (SELECT n FROM r)")
def shared_target_cascade(spark, d):
    e = supplier_links(spark, d)
    about = t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("person"), F.col("s_suppkey").alias("target"))
    return L.shared_target(e, about, e.agg(F.min("src")).first()[0], 1)


@query("SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'delete' WHEN 'view' THEN 'mask' ELSE 'unknown' END AS action, true AS stop FROM events")
def deletion_plan(spark, d):
    policy = spark.createDataFrame([("click", "delete"), ("view", "mask")], "kind string, action string")
    return L.deletion_plan(t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")), policy).select("id", "action", "stop")


@query("""WITH g AS (SELECT 1 AS depth, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 2, count(*) FROM customer GROUP BY c_nationkey, c_mktsegment UNION ALL SELECT 3, count(*) FROM customer GROUP BY c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 1000) AS BIGINT))
SELECT depth, min(n) AS k, count(*) FILTER (n = 1) AS singletons, count(*) AS groups FROM g GROUP BY 1""")
def k_anonymity_sweep(spark, d):
    c = t(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 1000))
    return L.k_anonymity_sweep(c, ["c_nationkey", "c_mktsegment", "band"])


@query("""WITH x AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS fresh, CASE WHEN value < 5 THEN 1 ELSE 0 END AS bad FROM events)
SELECT event_id, CAST(sum(fresh) OVER w AS BIGINT) AS nodes, row_number() OVER w AS edges, CAST(sum(1 - fresh) OVER w AS BIGINT) AS duplicates, CAST(sum(bad) OVER w AS BIGINT) AS wrong FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def extraction_growth(spark, d):
    e = t(spark, d, "events").withColumn("bad", F.col("value") < 5)
    return L.extraction_growth(e, ["user_id"], ["event_type"], "event_id", F.col("bad"))


# CON ----------------------------------------------------------------------------------------------------------------
def writes(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value"))


@query("SELECT o_orderkey AS seq, o_orderkey <> max(o_orderkey) OVER (PARTITION BY o_custkey) AS lost FROM orders")
def lost_updates(spark, d):
    return C.lost_updates(writes(spark, d)).select("seq", "lost")


@query("SELECT o_orderkey AS seq, CASE WHEN n <= 5 THEN n END AS tries FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def optimistic_retries(spark, d):
    return C.optimistic_rounds(writes(spark, d), 5).select("seq", F.col("tries").cast("long").alias("tries"))


@query("SELECT o_custkey AS key, o_orderpriority AS field, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1, 2")
def field_level_writes(spark, d):
    return C.field_level(writes(spark, d))


@query("SELECT 'row' AS level, count(*) AS groups FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'field', count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)")
def conflict_granularity(spark, d):
    w = writes(spark, d)
    return C.conflicts_at(w, ["key"]).agg(F.count("*").alias("groups")).select(F.lit("row").alias("level"), "groups").union(C.conflicts_at(w, ["key", "field"]).agg(F.count("*").alias("groups")).select(F.lit("field"), "groups"))


@query("""WITH v AS (SELECT c_custkey, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS base, CAST(CAST(floor(c_acctbal) AS BIGINT) + 10 AS VARCHAR) AS a, CASE WHEN c_custkey % 2 = 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) - 3 AS VARCHAR) ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) + 10 AS VARCHAR) END AS b FROM customer)
SELECT c_custkey, b AS last_wins, a AS source_rank, CASE WHEN a = b THEN a ELSE CAST(CAST(a AS BIGINT) + CAST(b AS BIGINT) - CAST(base AS BIGINT) AS VARCHAR) END AS type_aware FROM v""")
def three_way_merge(spark, d):
    n = F.floor("c_acctbal").cast("long")
    c = t(spark, d, "customer").select("c_custkey", n.cast("string").alias("base"), (n + 10).cast("string").alias("a"), F.when(F.col("c_custkey") % 2 == 0, n - 3).otherwise(n + 10).cast("string").alias("b"))
    args = (F.col("base"), F.col("a"), F.lit("human"), F.col("b"), F.lit("agent"), F.lit("number"), {"human": 2, "agent": 1})
    return c.select("c_custkey", *[C.three_way(p, *args).alias(p) for p in ("last_wins", "source_rank", "type_aware")])


@query("SELECT p / 10.0 AS p, round(1 + p / 10.0 + power(p / 10.0, 2) + power(p / 10.0, 3) + power(p / 10.0, 4) + power(p / 10.0, 5), 9) AS tries FROM (SELECT unnest(range(0, 10)) AS p)")
def lock_cost_curve(spark, d):
    p = spark.range(10).select((F.col("id") / 10.0).alias("p"))
    return p.select("p", F.round(C.expected_tries(F.col("p")), 9).alias("tries"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1), p AS (SELECT o_custkey, CAST(urgent AS DOUBLE) / n AS p FROM c),
k AS (SELECT o_custkey, round(p, 9) AS p, round((12 + 1.5) * (1 + p + p * p + p * p * p + p * p * p * p + p * p * p * p * p), 6) AS optimistic, round(12 + 1.5 + 2.2 + 12 * p, 6) AS pessimistic FROM p)
SELECT *, CASE WHEN optimistic <= pessimistic THEN 'optimistic' ELSE 'pessimistic' END AS cheaper FROM k""")
def lock_crossover(spark, d):
    """Each customer's rate of urgent orders as its conflict rate: which lock costs less."""
    c = t(spark, d, "orders").groupBy("o_custkey").agg((F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double") / F.count("*")).alias("p"))
    optimistic, pessimistic = (F.round(x, 6) for x in C.lock_costs(F.col("p"), hold=12.0, write=1.5, lock=2.2))
    return c.select("o_custkey", F.round("p", 9).alias("p"), optimistic.alias("optimistic"), pessimistic.alias("pessimistic")).withColumn("cheaper", F.when(F.col("optimistic") <= F.col("pessimistic"), "optimistic").otherwise("pessimistic"))


@query("SELECT phase, sum(CASE WHEN old_ok THEN 1 ELSE 0 END) AS old_readers, sum(CASE WHEN new_ok THEN 1 ELSE 0 END) AS new_readers, count(*) AS readers FROM (SELECT phase, o_orderpriority <> '5-LOW' AND phase <> 'contract' AS old_ok, o_orderpriority = '5-LOW' AND phase IN ('copy', 'contract') AS new_ok FROM orders, (VALUES ('start'), ('expand'), ('copy'), ('contract')) v(phase)) GROUP BY 1")
def rename_readers(spark, d):
    """Readers of the old and of the new name that each phase of a rename still serves."""
    readers = t(spark, d, "orders").select(F.when(F.col("o_orderpriority") == "5-LOW", "new").otherwise("old").alias("reads"))
    return C.readers_served(readers, "reads")


@query("SELECT p_type, count(*) AS items, count(*) FILTER (level = 'hide') AS hide, count(*) FILTER (level = 'detach') AS detach, count(*) FILTER (level = 'pseudonym') AS pseudonym, count(*) FILTER (level = 'erase') AS erase, CAST(sum(CASE level WHEN 'hide' THEN 5 WHEN 'detach' THEN 5 WHEN 'pseudonym' THEN 6 ELSE 4 END) AS BIGINT) AS met FROM (SELECT p_type, CASE p_size % 4 WHEN 0 THEN 'hide' WHEN 1 THEN 'detach' WHEN 2 THEN 'pseudonym' ELSE 'erase' END AS level FROM part) GROUP BY 1")
def deletion_levels(spark, d):
    """Parts deleted at four levels: how many of the criteria each type's deletions meet."""
    level = F.element_at(F.array(*map(F.lit, L.LEVELS)), (F.col("p_size") % 4 + 1).cast("int"))
    scored = L.deletion_scores(t(spark, d, "part").select("p_type", level.alias("level")))
    counts = [F.count_if(F.col("level") == x).alias(x) for x in L.LEVELS]
    return scored.groupBy("p_type").agg(F.count("*").alias("items"), *counts, F.sum("met").cast("long").alias("met"))


@query("""WITH c AS (SELECT event_id AS seq, user_id AS s, event_type AS k, CAST(floor(value) AS BIGINT) % 3 AS o, value / 100 AS conf FROM events), e AS (SELECT *, CASE WHEN conf < 0.65 THEN 'confidence' WHEN k NOT IN ('click', 'view', 'purchase') THEN 'schema' END AS early FROM c),
f AS (SELECT *, first_value(o) OVER (PARTITION BY s, k, early IS NULL ORDER BY seq) AS first_o, row_number() OVER (PARTITION BY s, k, o, early IS NULL ORDER BY seq) AS nth FROM e)
SELECT seq, CASE WHEN early IS NOT NULL THEN early WHEN k = 'purchase' AND o <> first_o THEN 'single-value' WHEN nth > 1 THEN 'duplicate' ELSE 'written' END AS outcome FROM f""")
def write_gate(spark, d):
    c = t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("s"), F.col("event_type").alias("k"), (F.floor("value") % 3).cast("string").alias("o"), (F.col("value") / 100).alias("conf"))
    return C.write_gate(c, {}, ["click", "view", "purchase"], ["purchase"]).select("seq", "outcome")


@query("SELECT o_orderkey, o_orderstatus AS state FROM orders")
def expand_contract(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for phase in ("expand", "copy", "contract"):
        o = C.expand_contract(o, "o_orderstatus", "state", phase)
    return o


@query("""SELECT coalesce(a.k, b.k) AS key, coalesce(b.v, a.v) AS merged, a.v IS DISTINCT FROM b.v AS alert FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 3 <> 0) b ON a.k = b.k""")
def dual_read(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("v"))
    new = c.where("key % 3 <> 0").withColumn("v", F.when(F.col("key") % 7 == 0, "NEW").otherwise(F.col("v")))
    return C.dual_read(c.where("key % 5 <> 0"), new, "key", "v").select("key", "merged", "alert")


@query("SELECT 2 AS phase, 'dual-read' AS name")
def migration_gates(spark, d):
    gates = spark.createDataFrame([(1, "expand", True), (2, "dual-read", False), (3, "contract", False)], "phase int, name string, passed boolean")
    return C.first_blocked(gates)


# costs of answering ---------------------------------------------------------------------------------------------------
@query("""WITH q AS (SELECT conv_id, turn, CASE WHEN length(text) < 60 THEN 'fact' WHEN length(text) < 200 THEN 'hop' ELSE 'global' END AS kind FROM conversations), r AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'fact' ELSE kind END AS sent FROM q)
SELECT kind, sent, count(*) AS n, CAST(sum(CASE sent WHEN 'fact' THEN 1.0 WHEN 'hop' THEN 4.0 ELSE 20.0 END) AS DOUBLE) AS cost, round(avg(CASE WHEN kind = sent THEN 0.9 WHEN sent = 'global' THEN 0.7 ELSE 0.2 END), 9) AS quality FROM r GROUP BY 1, 2""")
def forced_misroute(spark, d):
    """Turns as questions, each third one sent to the cheapest engine whatever its kind."""
    n = F.length("text")
    q = t(spark, d, "conversations").withColumn("kind", F.when(n < 60, "fact").when(n < 200, "hop").otherwise("global"))
    q = q.withColumn("sent", F.when(F.col("turn") % 3 == 0, "fact").otherwise(F.col("kind")))
    kinds = ("fact", "hop", "global")
    quality = {(k, e): 0.9 if k == e else 0.7 if e == "global" else 0.2 for k in kinds for e in kinds}
    cost, good = M.forced_route(F.col("kind"), F.col("sent"), {"fact": 1.0, "hop": 4.0, "global": 20.0}, quality)
    return q.groupBy("kind", "sent").agg(F.count("*").alias("n"), F.sum(cost).alias("cost"), F.round(F.avg(good), 9).alias("quality"))


@query("""WITH m AS (SELECT source, count(*) AS total, count(*) FILTER (doc_id % 20 = 0) AS changed FROM documents GROUP BY 1)
SELECT source, total, changed, round(least(changed + floor(changed * 0.01 * total), total) * 2.5, 6) AS incremental, round(total * 2.5, 6) AS rebuilt FROM m""")
def update_costs(spark, d):
    """An update of each source's index: what changed and what that touches, against building it anew."""
    m = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("doc_id") % 20 == 0).alias("changed"))
    some, every = M.incremental_cost(F.col("changed"), F.col("total"), 2.5, 0.01)
    return m.select("source", "total", "changed", F.round(some, 6).alias("incremental"), F.round(every, 6).alias("rebuilt"))


@query("""WITH g AS (SELECT c_custkey, c_mktsegment, c_name FROM customer), x AS (SELECT c_custkey, c_name AS a, c_mktsegment AS b FROM g), y AS (SELECT c_custkey, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS p, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS q FROM x)
SELECT c_custkey, round(CAST(len(list_intersect(p, q)) AS DOUBLE) / len(list_distinct(list_concat(p, q))), 9) AS score FROM y""")
def bigram_similarity(spark, d):
    """Names against segments: Jaccard of character bigrams."""
    return t(spark, d, "customer").select("c_custkey", F.round(S.bigram_jaccard(F.col("c_name"), F.col("c_mktsegment")), 9).alias("score"))
