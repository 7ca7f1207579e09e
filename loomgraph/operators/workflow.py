"""State graphs over many threads at once, reducers, guards, checkpoints, retries, sagas: one row a thread, one job a superstep."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import materialize

END = "END"

#: Reducers of concurrent writes to one field: name -> aggregate over (value, at, score, ordinal).
REDUCERS: dict[str, Callable[[], Column]] = {
    "add": lambda: F.sum(F.col("value").cast("double")).cast("string"),
    "concat": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]), ","),
    "keep_latest": lambda: F.max_by("value", F.struct("at", -F.col("ordinal"))),
    "keep_best": lambda: F.max_by("value", F.struct("score", -F.col("ordinal"))),
    "collect_unique": lambda: F.array_join(F.transform(F.array_sort(F.map_entries(F.map_from_entries(F.collect_set(F.struct("value", "value"))))), lambda e: e["key"]), ","),
}


class ConcurrentWrite(ValueError):
    """Two writes of one superstep met in a field without a reducer."""


def reduce_writes(writes: DataFrame, reducers: dict[str, str]) -> DataFrame:
    """(thread, field, value): writes (thread, field, value, at, score, ordinal) merged by each field's reducer; fields without one
    take a single write, and two raise ConcurrentWrite."""
    plain = writes.where(~F.col("field").isin(*reducers)) if reducers else writes
    twice = plain.groupBy("thread", "field").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ConcurrentWrite(f"concurrent writes without a reducer: {twice.first()}")
    out = plain.select("thread", "field", "value")
    for kind in sorted(set(reducers.values())):
        fields = [f for f, k in reducers.items() if k == kind]
        out = out.union(writes.where(F.col("field").isin(*fields)).groupBy("thread", "field").agg(REDUCERS[kind]().alias("value")))
    return out


class StateGraph:
    """Nodes (DataFrame of ready threads -> the same with new columns), edges and routers; state is one row a thread.

    invoke() runs supersteps: every thread's current node works on all its threads at once, then the edge or router names the next. Each
    superstep is written to the shared folder; history holds the snapshots, and resume() continues from any of them.
    """

    def __init__(self):
        self.nodes: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.next: dict[str, Column] = {}
        self.interrupts: set[str] = set()

    def node(self, name: str, work: Callable[[DataFrame], DataFrame], interrupt: bool = False) -> "StateGraph":
        self.nodes[name] = work
        if interrupt:
            self.interrupts.add(name)
        return self

    def edge(self, name: str, to: str) -> "StateGraph":
        self.next[name] = F.lit(to)
        return self

    def route(self, name: str, to: Column) -> "StateGraph":
        self.next[name] = to
        return self

    def invoke(self, state: DataFrame, start: str, max_supersteps: int = 25) -> tuple[DataFrame, list[DataFrame]]:
        return self.resume(state.withColumn("at_node", F.lit(start)).withColumn("superstep", F.lit(0)), max_supersteps)

    def resume(self, state: DataFrame, max_supersteps: int = 25, answered: bool = False) -> tuple[DataFrame, list[DataFrame]]:
        """Continue from a snapshot; threads that wait at an interrupt go on only if answered, their node starting anew."""
        columns = state.columns
        history = [materialize(state, "state")]
        for _ in range(max_supersteps):
            now = history[-1]
            waiting = F.col("at_node").isin(*self.interrupts) & F.lit(not answered) if self.interrupts else F.lit(False)
            active = now.where((F.col("at_node") != END) & ~waiting)
            if active.isEmpty():
                break
            out = now.where((F.col("at_node") == END) | waiting).select(*columns)
            for name, work in self.nodes.items():
                done = work(active.where(F.col("at_node") == name))
                done = done.withColumn("at_node", self.next[name]).withColumn("superstep", F.col("superstep") + 1)
                out = out.union(done.select(*columns))
            history.append(materialize(out, "state"))
            answered = False
        return history[-1], history


def guard_reason(steps: DataFrame, keys: list[str], order: list[str], rounds: int, cost: float, seconds: float, patience: int) -> DataFrame:
    """(keys, stopped_at, reason): the first step at which rounds, cost, time or a stall stops a run, in this order of reasons; null if none.

    steps: cost, seconds, score (lower is better) per step."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = steps.withColumn("__n", F.row_number().over(w)).withColumn("__c", F.sum("cost").over(upto)).withColumn("__t", F.sum("seconds").over(upto))
    s = s.withColumn("__best", F.min("score").over(w.rowsBetween(-patience, -1)))
    stall = (F.col("__n") > patience) & (F.col("score") >= F.col("__best"))
    why = F.when(F.col("__n") >= rounds, "rounds").when(F.col("__c") >= cost, "cost").when(F.col("__t") >= seconds, "time").when(stall, "stall")
    s = s.withColumn("__why", why)
    first = F.min(F.when(F.col("__why").isNotNull(), F.struct(F.col("__n").alias("n"), F.col("__why").alias("why"))))
    return s.groupBy(*keys).agg(first.alias("f")).select(*keys, F.col("f.n").alias("stopped_at"), F.col("f.why").alias("reason"))


def state_sizes(state: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Bytes of each thread's state as JSON."""
    return state.select(*keys, F.octet_length(F.to_json(F.struct(*fields))).alias("bytes"))


def by_reference(state: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """(state with the body's key instead of the body, store of distinct bodies by key)."""
    key = F.sha2(F.col(body).cast("binary"), 256)
    return state.withColumn(f"{body}_ref", key).drop(body), state.select(key.alias(f"{body}_ref"), body).distinct()


def idempotent(calls: DataFrame, key: str, order: str) -> DataFrame:
    """The first call of each key; a repeat gets its result instead of a new effect. Calls without a key all take effect."""
    first = Window.partitionBy(key).orderBy(order)
    return calls.withColumn("effect", F.col(key).isNull() | (F.row_number().over(first) == 1))


def effect_status(log: DataFrame, key: str) -> DataFrame:
    """(key, status): done, needs_human (started, never finished), from a log of phases."""
    agg = log.groupBy(key).agg(F.bool_or(F.col("phase") == "done").alias("d"))
    return agg.select(key, F.when(F.col("d"), "done").otherwise("needs_human").alias("status"))


def drill(steps: DataFrame) -> DataFrame:
    """steps (name, idempotent, has_key, checkpointed) with what a restart does to them."""
    verdict = F.when(F.col("idempotent"), "safe to rerun").when(F.col("has_key"), "safe by key").when(F.col("checkpointed"), "resume after").otherwise("needs human")
    return steps.withColumn("verdict", verdict)


def retry_buckets(clients: DataFrame, schedule: list[float], width: float = 0.25, jitter: Column | None = None) -> DataFrame:
    """(bucket, n): arrivals of every client's retries in buckets of `width` seconds; jitter scales each wait if given."""
    waits = F.array(*[F.lit(float(x)) for x in schedule])
    at = clients.select("client", F.posexplode(waits).alias("k", "wait"))
    when = F.col("wait") * jitter if jitter is not None else F.col("wait")
    return at.groupBy(F.floor(when / width).alias("bucket")).agg(F.count("*").alias("n"))


def backoff(kind: str, tries: int, base: float = 0.5, factor: float = 2.0, cap: float = 30.0) -> list[float]:
    """Seconds before each retry: 'fixed' (base each), 'exponential' (base * factor^k) or 'capped' (the same, `cap` at most)."""
    if kind not in ("fixed", "exponential", "capped"):
        raise ValueError(f"unknown schedule {kind}")
    waits = [base if kind == "fixed" else base * factor**k for k in range(tries)]
    return [min(w, cap) for w in waits] if kind == "capped" else waits


def retry_load(clients: DataFrame, schedules: dict[str, tuple[list[float], bool]], capacity: int, width: float = 0.25) -> DataFrame:
    """(schedule, bucket, n, over, peak): clients' retries by bucket of `width` seconds since the failure they share, those over
    capacity, and the schedule's busiest bucket. A jittered schedule scales each wait by a draw in [0, 1) hashed from client and try."""
    each = []
    for name, (waits, jitter) in schedules.items():
        at = clients.select("client", F.posexplode(F.array(*map(F.lit, waits))).alias("k", "wait"))
        draw = F.pmod(F.xxhash64(F.lit(name), F.col("client").cast("long"), "k"), F.lit(1_000_003)) / 1_000_003.0
        before = Window.partitionBy("client").orderBy("k")
        moment = F.sum(F.col("wait") * draw if jitter else F.col("wait")).over(before)
        each.append(at.select(F.lit(name).alias("schedule"), F.floor(moment / width).alias("bucket")))
    counts = reduce(DataFrame.union, each).groupBy("schedule", "bucket").agg(F.count("*").alias("n"))
    return counts.withColumn("over", F.greatest(F.col("n") - capacity, F.lit(0))).withColumn("peak", F.max("n").over(Window.partitionBy("schedule")))


def compensate(steps: DataFrame, undo_fails: Column, max_tries: int = 3) -> DataFrame:
    """saga() rows with what becomes of an undo: `undo_fails` is how often it fails first. Within max_tries it is 'compensated' on that try,
    beyond it goes to the 'queue' for people, as do irreversible steps; all other rows are 'none'."""
    tries = F.least(undo_fails + 1, F.lit(max_tries)).cast("int")
    outcome = F.when(F.col("action") == "stuck", "queue").when(F.col("action") != "undone", "none").when(undo_fails < max_tries, "compensated").otherwise("queue")
    return steps.withColumn("undo_tries", F.when(F.col("action") == "undone", tries).otherwise(0)).withColumn("outcome", outcome)


def saga(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, step, action) of steps (ok, reversible): 'done' if nothing fails; after a failure 'undone' for those before it, 'failed',
    'stuck' for irreversible ones before it, 'skipped' after it."""
    w = Window.partitionBy(*keys)
    s = steps.withColumn("__f", F.min(F.when(~F.col("ok"), F.col(order))).over(w))
    before = F.col(order) < F.col("__f")
    action = F.when(F.col("__f").isNull(), "done").when(before & F.col("reversible"), "undone").when(before, "stuck").when(F.col(order) == F.col("__f"), "failed").otherwise("skipped")
    return s.withColumn("action", action).drop("__f")


def triage(jobs: DataFrame, max_tries: int = 3) -> DataFrame:
    """jobs (kind, tries): transient ones retry below the cap, all else goes to people."""
    route = F.when((F.col("kind") == "transient") & (F.col("tries") < max_tries), "retry").when(F.col("kind") == "transient", "exhausted").when(F.col("kind") == "permanent", "reject").otherwise("needs_human")
    return jobs.withColumn("route", route)


def escalation(policy: str, hours: Column, amount: Column, risk: Column) -> Column:
    """What an unanswered approval becomes: wait, reject (after 24 h), approve (after 24 h), or escalate by time, risk and amount."""
    if policy == "wait":
        return F.lit("waiting")
    if policy in ("reject", "approve"):
        return F.when(hours >= 24, policy + "ed" if policy == "reject" else "approved").otherwise("waiting")
    return F.when(hours < 24, "waiting").when((risk == "high") | (amount > 1000), F.when(hours >= 72, "rejected").otherwise("escalated")).otherwise("approved")


def review_sweep(amounts: DataFrame, col: str, thresholds: list[float], minutes: float = 5.0) -> DataFrame:
    """threshold, reviewed, hours of review, amount that passes unseen."""
    each = amounts.select(F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"), F.col(col).alias("x"))
    over = F.col("x") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(over).alias("reviewed"), (F.count_if(over) * F.lit(minutes) / 60).alias("hours"), F.sum(F.when(~over, F.col("x")).otherwise(0.0)).alias("unseen"))


def partial_failure(tasks: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """tasks (ok, value): all_or_nothing keeps only groups without a failure, best_effort the rows that worked, degrade all with a stand-in."""
    if policy == "all_or_nothing":
        return tasks.withColumn("__all", F.bool_and("ok").over(Window.partitionBy(*keys))).where("__all").drop("__all")
    if policy == "best_effort":
        return tasks.where("ok")
    return tasks.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise("unavailable"))


def context_strategies(turns: DataFrame, conv: str, order: str, tokens: str, keep: int = 15, ratio: float = 0.12, index_tokens: int = 12) -> DataFrame:
    """Tokens of each conversation's context by strategy: all, last `keep`, older ones summarised, older ones offloaded to an index."""
    age = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))
    t = turns.withColumn("__old", age > keep)
    new, old = F.sum(F.when(~F.col("__old"), F.col(tokens)).otherwise(0)), F.sum(F.when(F.col("__old"), F.col(tokens)).otherwise(0))
    return t.groupBy(conv).agg(F.sum(tokens).alias("keep_all"), new.alias("last_n"), F.round(new + ratio * old, 6).alias("summarised"), (new + index_tokens * F.count_if("__old")).alias("offloaded"))


def fact_retention(turns: DataFrame, conv: str, order: str, facts: str, keep: int = 15, survival: float = 0.6, seed: int = 1) -> DataFrame:
    """Facts of each conversation still known by strategy: facts (distinct items of the array column), keep_all, last_n, summarised (older ones
    survive with a chance, drawn from a hash of seed and fact), offloaded (older ones found through the index)."""
    age = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))
    each = turns.withColumn("__old", age > keep).select(conv, "__old", F.explode(facts).alias("__fact"))
    # A fact told again in a recent turn is known from there.
    once = each.groupBy(conv, "__fact").agg(F.bool_and("__old").alias("__old"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), "__fact").cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(16**8)
    n, new = F.count("*"), F.count_if(~F.col("__old"))
    return once.groupBy(conv).agg(n.alias("facts"), n.alias("keep_all"), new.alias("last_n"), F.count_if(~F.col("__old") | (draw < survival)).alias("summarised"), n.alias("offloaded"))


def tier_cascade(tiers: DataFrame) -> DataFrame:
    """tiers (tier, hit, ms): share of requests that reach each tier (what earlier ones left) and the expected time spent there."""
    before = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    left = 1 - F.coalesce(F.sum("hit").over(before), F.lit(0.0))
    return tiers.withColumn("reached", F.round(left, 9)).withColumn("expected_ms", F.round(left * F.col("ms"), 9))


def all_at_once(tiers: DataFrame) -> DataFrame:
    """One row to set beside tier_cascade(): every request asks all tiers at a time. cascade_ms, together_ms (the slowest), cascade_calls, together_calls."""
    c = tier_cascade(tiers)
    return c.agg(F.round(F.sum("expected_ms"), 9).alias("cascade_ms"), F.max("ms").alias("together_ms"), F.round(F.sum("reached"), 9).alias("cascade_calls"), F.count("*").cast("double").alias("together_calls"))
