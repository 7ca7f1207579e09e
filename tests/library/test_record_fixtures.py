"""Small published examples with known answers: time, events, resolution, conflicts, workflows."""

import pytest
from loomgraph.functions import scalars as S
from loomgraph.operators import concurrency as C
from loomgraph.operators import events as E
from loomgraph.operators import lineage as L
from loomgraph.operators import relational as R
from loomgraph.operators import resolve as X
from loomgraph.operators import retrieval as Q
from loomgraph.operators import temporal as TM
from loomgraph.operators import validate as V
from loomgraph.operators import workflow as W
from pyspark.sql import functions as F


def test_bitemporal_answers(spark):
    f = spark.createDataFrame([], TM.FACT)
    f = TM.assert_fact(f, "gaon", "ceo", "Kim", "2020-01-01", "2020-01-05")
    f = TM.assert_fact(f, "gaon", "ceo", "Park", "2024-03-01", "2024-04-10")
    assert f.count() == 3
    at = lambda v, t=None: [r.value for r in TM.as_of(f, v, t).collect()]
    assert at("2023-01-01") == ["Kim"] and at("2019-01-01") == [] and at("2024-03-15") == ["Park"] and at("2024-03-15", "2024-03-20") == ["Kim"]
    g = TM.correct(f, "gaon", "ceo", "Lee", "2024-03-01", "2024-05-01")
    assert [r.value for r in TM.as_of(g, "2024-06-01").collect()] == ["Lee"] and [r.value for r in TM.as_of(g, "2024-06-01", "2024-04-15").collect()] == ["Park"]
    ev = TM.to_events(TM.as_of(g, "2024-06-01"))
    assert [(str(r.at), r.op) for r in ev.collect()] == [("2024-03-01", "add")]


def test_date_strings(spark):
    df = spark.createDataFrame([("2024/3",), ("2024-03-05T10:00",), ("2024",), ("x",), (None,)], "s string")
    assert [str(r[0]) for r in df.select(S.lenient_date(F.col("s"))).collect()] == ["2024-03-01", "2024-03-05", "2024-01-01", "None", "None"]


CHANGES = [(1, "diet", "vegan", "add", .6, "agent"), (2, "diet", "meat", "add", .7, "agent"), (3, "diet", "vegetarian", "add", .95, "user"), (4, "diet", "meat", "delete", .5, "agent"), (5, "diet", "vegan", "add", .8, "agent")]


def test_fold_policies(spark):
    e = spark.createDataFrame(CHANGES, "seq long, key string, value string, op string, conf double, actor string")
    assert E.last_write_wins(e, "key").first()["value"] == "vegan"
    assert E.highest_confidence(e, "key").first()["value"] == "vegetarian"
    assert E.rank_wins(e, "key", F.when(F.col("actor") == "user", 2).otherwise(1)).first()["value"] == "vegetarian"
    assert E.accumulate(e, "key").first()["value"] == "vegan / vegetarian"
    full = E.replay(e, ["key", "value"], F.col("seq"))
    snap = E.replay(e, ["key", "value"], F.col("seq"), F.col("seq") <= 3)
    assert R.same_rows(full, E.replay_from_snapshot(snap, e.where("seq > 3"), ["key", "value"], "seq"))


def test_hash_chain_tampering(spark):
    e = spark.createDataFrame([("c", i, f"2026-01-0{i}", "a", "set", f'{{"v": {i}}}') for i in range(1, 6)], "chain string, seq long, at string, actor string, op string, payload string")
    rows = E.build_chain(e, ["chain"])
    assert E.verify_chain(rows, ["chain"]).isEmpty()
    altered = rows.withColumn("payload", F.when(F.col("seq") == 4, '{"v": 9}').otherwise(F.col("payload")))
    assert [(r.seq, r.fault) for r in E.verify_chain(altered, ["chain"]).collect()] == [(4, "content")]
    assert [(r.seq, r.fault) for r in E.verify_chain(rows.where("seq <> 3"), ["chain"]).collect()] == [(4, "link")]


def test_three_way_merge_counts(spark):
    rows = [("f1", "a", "b", "human", "c", "agent", "text"), ("f2", "a", "a", "agent", "b", "agent", "text"), ("f3", "x", "x,y", "agent", "x,z", "human", "set"), ("f4", "10", "12", "human", "9", "agent", "number")]
    df = spark.createDataFrame(rows, "field string, base string, a string, sa string, b string, sb string, kind string")
    merged = {p: {r.field: r.m for r in df.select("field", C.three_way(p, *[F.col(c) for c in ("base", "a", "sa", "b", "sb", "kind")], {"human": 2, "agent": 1}).alias("m")).collect()} for p in ("last_wins", "source_rank", "type_aware", "always_human")}
    assert merged["last_wins"]["f1"] == "c" and merged["source_rank"] == {"f1": "b", "f2": None, "f3": "x,z", "f4": "12"}
    assert merged["type_aware"] == {"f1": None, "f2": "b", "f3": "x,y,z", "f4": "11"} and set(merged["always_human"].values()) == {None}


def test_write_gate(spark):
    rows = [(1, "Kim", "leads", "T1", .9), (2, "Kim", "leads", "T1", .9), (3, "Kim", "leads", "T2", .9), (4, "Kim", "likes", "T1", .9), (5, "Kim", "leads", "T3", .3), (6, "KIM", "leads", "T1", .9), (7, "Kim", "knows", "Lee", .9)]
    out = C.write_gate(spark.createDataFrame(rows, "seq long, s string, k string, o string, conf double"), {"KIM": "Kim"}, ["leads", "knows"], ["leads"])
    assert [r.outcome for r in out.orderBy("seq").collect()] == ["written", "duplicate", "single-value", "schema", "confidence", "duplicate", "written"]


def test_prefix_budgets(spark):
    df = spark.createDataFrame([("r", 1, 30, 18), ("r", 2, 25, 6), ("r", 3, 21, 0), ("r", 4, 10, 10)], "k string, i int, need int, extra int").withColumn("want", F.col("need") + F.col("extra"))
    greedy = [r.granted for r in R.prefix_budget(df, ["k"], ["i"], "want", F.lit(100)).orderBy("i").collect()]
    assert greedy == [48, 31, 21, 0]
    kept = [r.granted for r in R.reserve_first(df, ["k"], ["i"], "need", "extra", F.lit(100)).orderBy("i").collect()]
    assert kept == [44, 25, 21, 10] and sum(kept) == 100


def test_rank_fusion(spark):
    a, b = ["d02", "d09", "d01", "d05", "d03"], ["d11", "d02", "d09", "d06", "d12"]
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(a)] + [(2, i + 1, x) for i, x in enumerate(b)], "list_no int, rank int, id string")
    got = [r.id for r in Q.reciprocal_rank_fusion(df, "id").orderBy("place").collect()]
    assert got[:3] == ["d02", "d09", "d11"] and len(got) == 8


def test_record_linkage(spark):
    score = lambda rows: X.weighted_score([(3.0, F.lit(True), S.bigram_jaccard(F.lit(rows[0]), F.lit(rows[1]))), (1.0, F.lit(rows[2]), F.lit(0.0))])
    one = spark.range(1)
    assert one.select(score(("gaon", "gaon", False))).first()[0] == 1.0 and one.select(score(("gaon", "gaon", True))).first()[0] == 0.75
    assert one.select(S.bigram_jaccard(F.lit("a"), F.lit("a")), S.bigram_jaccard(F.lit(""), F.lit("a"))).first()[:] == (1.0, 0.0)
    ids = spark.createDataFrame([(i,) for i in range(6)], "id long")
    log = spark.createDataFrame([(1, 1, 4, False), (2, 0, 1, False), (3, 2, 3, False), (4, 2, 3, True)], "seq long, kept long, dropped long, undone boolean")
    assert {r.id: r.root for r in X.apply_merges(ids, log).collect()} == {0: 0, 1: 0, 4: 0, 2: 2, 3: 3, 5: 5}
    rec = spark.createDataFrame([(0, "A", ""), (1, "", "t"), (4, "B", "u")], "id long, name string, tel string")
    view = X.merged_view(rec, spark.createDataFrame([(0, 0), (1, 0), (4, 0)], "id long, root long"), ["name", "tel"]).first()
    assert (view.name, view.tel) == ("B", "u")


def test_shapes(spark):
    tr = spark.createDataFrame([("C1", "a", "Company"), ("C1", "bizno", "123"), ("C2", "a", "Company"), ("C3", "a", "Company"), ("C3", "bizno", "xx"), ("C3", "bizno", "456")], "s string, p string, o string")
    rep = V.validate_shapes(tr, [V.Shape("Company", "bizno", min_count=1, max_count=1, pattern="^[0-9]+$")]).collect()
    assert sorted((r.node, r.value) for r in rep if r.value) == [("C3", "xx")] and sorted(r.node for r in rep if not r.value) == ["C2", "C3"]


def test_cycles_and_retraction(spark):
    e = spark.createDataFrame([("n1", "n2"), ("n2", "n3"), ("n3", "n4"), ("n4", "n5"), ("n5", "n3"), ("n6", "n6")], "src string, dst string")
    assert sorted(r.node for r in V.nodes_in_cycles(e).collect()) == ["n3", "n4", "n5", "n6"]
    facts = spark.createDataFrame([("f1", "s1"), ("f2", "s4"), ("f3", "s2")], "fact string, source string")
    derived = spark.createDataFrame([("f3", "f1"), ("f4", "f2"), ("f5", "f4")], "fact string, base string")
    assert {(r.fact, r.how) for r in L.retract(facts, derived, "s4").collect()} == {("f2", "direct"), ("f4", "cascade"), ("f5", "cascade")}


def test_state_graph_interrupts_and_reducers(spark):
    g = W.StateGraph().node("draft", lambda d: d.withColumn("n", F.col("n") + 1)).edge("draft", "ask")
    g.node("ask", lambda d: d.withColumn("n", F.col("n") + 10), interrupt=True).edge("ask", W.END)
    state, history = g.invoke(spark.createDataFrame([(1, 0), (2, 5)], "thread int, n int"), "draft")
    assert {(r.n, r.at_node) for r in state.collect()} == {(1, "ask"), (6, "ask")} and len(history) == 2
    done, _ = g.resume(state, answered=True)
    assert {(r.n, r.at_node) for r in done.collect()} == {(11, W.END), (16, W.END)}
    w = spark.createDataFrame([(1, "x", "a", 1, 1.0, 1), (1, "x", "b", 2, .5, 2)], "thread int, field string, value string, at int, score double, ordinal int")
    with pytest.raises(W.ConcurrentWrite):
        W.reduce_writes(w, {})
    assert W.reduce_writes(w, {"x": "keep_latest"}).first()["value"] == "b" and W.reduce_writes(w, {"x": "keep_best"}).first()["value"] == "a" and W.reduce_writes(w, {"x": "concat"}).first()["value"] == "a,b"


def test_saga_and_guards(spark):
    s = spark.createDataFrame([("r", 1, True, True), ("r", 2, True, False), ("r", 3, False, True), ("r", 4, True, True)], "run string, i int, ok boolean, reversible boolean")
    assert [r.action for r in W.saga(s, ["run"], "i").orderBy("i").collect()] == ["undone", "stuck", "failed", "skipped"]
    steps = spark.createDataFrame([("r", i, 1.0, 1.0, 5.0) for i in range(1, 9)], "run string, i int, cost double, seconds double, score double")
    assert W.guard_reason(steps, ["run"], ["i"], 99, 99, 99, 2).first()[:] == ("r", 3, "stall") and W.guard_reason(steps, ["run"], ["i"], 2, 99, 99, 2).first()["reason"] == "rounds"


def test_re_extraction_keeps_manual_facts(spark):
    s = "doc int, s string, p string, o string"
    old = spark.createDataFrame([(1, "A", "ceo", "Kim"), (1, "A", "city", "Seoul"), (2, "B", "ceo", "Lee")], s)
    new = spark.createDataFrame([(1, "A", "ceo", "Park"), (1, "A", "city", "Busan")], s)
    merged, conflicts = Q.careful_merge(old, new, old.where("p = 'ceo' and s = 'A'"), 1)
    assert {(r.s, r.p, r.o) for r in merged.collect()} == {("A", "ceo", "Kim"), ("A", "city", "Busan"), ("B", "ceo", "Lee")}
    assert [(r.o, r.manual_o) for r in conflicts.collect()] == [("Park", "Kim")]
    assert Q.naive_replace(old, new, 1).count() == 3
