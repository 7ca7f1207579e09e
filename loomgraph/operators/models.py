"""Deterministic cost models as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_chain_cost(fail: Column) -> Column:
    """Expected steps of a chain that restarts from its first step on any failure; fail: array of failure probabilities."""
    return F.aggregate(fail, F.lit(0.0), lambda cost, p: (cost + 1) / (1 - p))


def expected_graph_cost(fail: Column) -> Column:
    """Expected steps if only the failed step is retried."""
    return F.aggregate(fail, F.lit(0.0), lambda cost, p: cost + 1 / (1 - p))


def complexity(conditions: Column) -> tuple[Column, Column]:
    """(branches of nested conditions, edges of a graph) for a number of conditions."""
    return F.pow(F.lit(2), conditions).cast("long"), (2 * conditions + 1).cast("long")


def wave_ms(width: Column, task: float = 900.0, slow: float = 0.1, factor: float = 3.5, fail: float = 0.06) -> Column:
    """Expected time of a wave of `width` parallel tasks: it lasts as its slowest; a failure repeats the task."""
    straggle = 1 - F.pow(F.lit(1 - slow), width)
    again = 1 - F.pow(F.lit(1 - fail), width)
    return task * (1 + (factor - 1) * straggle) + task * again


def fan_out(n: Column, width: Column, merge: float = 120.0, task: float = 900.0) -> tuple[Column, Column]:
    """(serial, parallel) time of n tasks in waves of `width`, each result merged one by one."""
    return n * task, F.ceil(n / width) * task + n * merge


def routed(accuracy: Column, mix: dict[str, float], cost: dict[str, float], quality: dict[str, float], wrong_quality: float) -> tuple[Column, Column]:
    """(cost, quality) of routing questions by kind at some accuracy; misrouted ones cost the mean and get wrong_quality."""
    total = reduce(lambda a, k: a + mix[k] * cost[k], mix, 0.0)
    good = reduce(lambda a, k: a + mix[k] * quality[k], mix, 0.0)
    mean = sum(cost.values()) / len(cost)
    return accuracy * total + (1 - accuracy) * mean, accuracy * good + (1 - accuracy) * wrong_quality


def drift(shares: Column, human: float, start: Column, generations: int, sharpen: float = 1.1) -> Column:
    """Expected shares after generations that learn from their own output (shares ^ sharpen, renormalised) mixed with human data."""

    def one(s: Column, _: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(sharpen)))
        return F.zip_with(F.transform(s, lambda x: F.pow(x, F.lit(sharpen)) / total), start, lambda x, h: (1 - human) * x + human * h)

    return F.aggregate(F.sequence(F.lit(1), F.lit(generations)), shares, one)


def expansion(frontier: Column, degree: Column, keep: Column, hops: int) -> Column:
    """array of frontier sizes by hop, whole numbers cut off: size * degree * keep."""
    step = lambda a, _: F.concat(a, F.array(F.floor(F.element_at(a, -1) * degree * keep).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(hops)), F.array(frontier.cast("long")), step)


def store_load(graph_writes: float, other_writes: float, graph_ms: float, other_ms: float, name: Column) -> Column:
    """Milliseconds a second of three store layouts: all in the graph store, split, or split with references written to both."""
    joined, split = (graph_writes + other_writes) * graph_ms, graph_writes * graph_ms + other_writes * other_ms
    return F.when(name == "joined", joined).when(name == "split", split).otherwise(split + 0.5 * graph_writes * graph_ms + other_writes * other_ms)


def monthly_cost(df: DataFrame, calls: str, unit: str) -> DataFrame:
    """cost and its share, with the running share from the largest."""
    d = df.withColumn("cost", F.col(calls) * F.col(unit))
    every = Window.partitionBy()
    d = d.withColumn("share", F.col("cost") / F.sum("cost").over(every))
    return d.withColumn("running", F.sum("share").over(Window.orderBy(F.desc("cost"), calls).rowsBetween(Window.unboundedPreceding, 0)))


def context_cost(facts: Column, tokens_each: float, price_per_1000: float) -> Column:
    return facts * tokens_each * price_per_1000 / 1000


def topologies(docs: Column, parallel: Column, read: tuple[float, float] = (900.0, 2400.0), write: tuple[float, float] = (1800.0, 3200.0), check: tuple[float, float] = (700.0, 1100.0), route: tuple[float, float] = (300.0, 400.0)) -> Column:
    """array of struct(shape, ms, tokens, messages) of one job, reading `docs` texts and writing a report, on six shapes of agents.

    Each step is (milliseconds, tokens). pipeline: one after the other; star: a router deals readers in waves; tree: as star, one
    merge a wave besides; mesh: readers in waves, and all pairs exchange what they read; debate: two writers and a judge; loop: a check after
    the report and one rewrite.
    """
    waves, n = F.ceil(docs / parallel), docs
    shape = lambda name, ms, tokens, messages: F.struct(F.lit(name).alias("shape"), ms.cast("double").alias("ms"), tokens.cast("double").alias("tokens"), messages.cast("long").alias("messages"))
    base = n * read[1] + write[1]
    return F.array(
        shape("pipeline", n * read[0] + write[0], base, n),
        shape("star", route[0] + waves * read[0] + write[0], base + route[1], 2 * n),
        shape("tree", route[0] + waves * (read[0] + check[0]) + write[0], base + route[1] + waves * check[1], 2 * n + waves),
        shape("mesh", waves * read[0] + (n - 1) * route[0] + write[0], base + n * (n - 1) * route[1], n * (n - 1)),
        shape("debate", waves * read[0] + 2 * write[0] + check[0], base + write[1] + 2 * check[1], n + 4),
        shape("loop", n * read[0] + 2 * write[0] + 2 * check[0], base + write[1] + 2 * check[1], n + 3),
    )


def expansion_stop(sizes: Column, budget: Column) -> Column:
    """Last hop whose running total of frontier sizes stays within the budget; -1 if not even the first does."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).alias("hop"), F.lit(True).alias("open"))

    def step(s: Column, size: Column) -> Column:
        total = s["total"] + size
        fits = s["open"] & (total <= budget)
        return F.struct(total.alias("total"), (s["hop"] + F.when(fits, 1).otherwise(0)).alias("hop"), fits.alias("open"))

    return F.aggregate(sizes, start, step, lambda s: s["hop"])


def forced_route(kind: Column, routed_to: Column, cost: dict[str, float], quality: dict[tuple[str, str], float]) -> tuple[Column, Column]:
    """(cost, quality) of answering questions of a kind with the engine that they were sent to, right or wrong."""
    price = F.create_map(*[F.lit(x) for kv in cost.items() for x in kv])
    worth = F.create_map(*[F.lit(x) for (k, e), q in quality.items() for x in (f"{k}/{e}", q)])
    return F.element_at(price, routed_to), F.coalesce(F.try_element_at(worth, F.concat_ws("/", kind, routed_to)), F.lit(0.0))


def incremental_cost(changed: Column, total: Column, each: float, spread: float) -> tuple[Column, Column]:
    """(incremental, full) cost of an update: what has changed and, for each change, a share `spread` of all else that it touches."""
    touched = F.least(changed + F.floor(changed * spread * total), total)
    return touched * each, total * each


def nested_calls(caps: list[Column], budget: Column) -> tuple[Column, Column]:
    """(calls of loops inside each other, each with a cap; the same under one budget for all)."""
    product = reduce(lambda a, b: a * b, caps)
    return product, F.least(product, budget)
