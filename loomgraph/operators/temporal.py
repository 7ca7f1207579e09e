"""Bitemporal facts (s, p, value, valid_from, valid_to, tx_from, tx_to): half-open intervals, 9999-12-31 for open ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"  # fixed value: the open end
FACT = "s string, p string, value string, valid_from date, valid_to date, tx_from date, tx_to date"


def _day(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def assert_fact(facts: DataFrame, s: str, p: str, value: str, valid_from: str, tx_at: str, valid_to: str = FOREVER) -> DataFrame:
    """facts after asserting one: open facts of (s, p) whose interval strictly holds valid_from are closed in transaction time
    and written again, cut short; equal starts are left alone. A new DataFrame, nothing in place."""
    at, tx = _day(valid_from), _day(tx_at)
    hit = (F.col("s") == s) & (F.col("p") == p) & (F.col("tx_to") == _day(FOREVER)) & (F.col("valid_from") < at) & (at < F.col("valid_to"))
    closed = facts.withColumn("tx_to", F.when(hit, tx).otherwise(F.col("tx_to")))
    again = facts.where(hit).withColumn("valid_to", at).withColumn("tx_from", tx).withColumn("tx_to", _day(FOREVER))
    new = facts.sparkSession.createDataFrame([(s, p, value)], "s string, p string, value string").select("s", "p", "value", at.alias("valid_from"), _day(valid_to).alias("valid_to"), tx.alias("tx_from"), _day(FOREVER).alias("tx_to"))
    return closed.unionByName(again).unionByName(new)


def correct(facts: DataFrame, s: str, p: str, value: str, valid_from: str, tx_at: str) -> DataFrame:
    """facts after a correction: open facts of (s, p) with the same valid_from are closed, the right value is written to FOREVER."""
    at, tx = _day(valid_from), _day(tx_at)
    hit = (F.col("s") == s) & (F.col("p") == p) & (F.col("tx_to") == _day(FOREVER)) & (F.col("valid_from") == at)
    closed = facts.withColumn("tx_to", F.when(hit, tx).otherwise(F.col("tx_to")))
    new = facts.sparkSession.createDataFrame([(s, p, value)], "s string, p string, value string").select("s", "p", "value", at.alias("valid_from"), _day(FOREVER).alias("valid_to"), tx.alias("tx_from"), _day(FOREVER).alias("tx_to"))
    return closed.unionByName(new)


def as_of(facts: DataFrame, valid_at, tx_at=None) -> DataFrame:
    """Facts valid at one day as known at another; without tx_at, as known now (still open)."""
    out = facts.where((F.col("valid_from") <= _day(valid_at)) & (_day(valid_at) < F.col("valid_to")))
    if tx_at is None:
        return out.where(F.col("tx_to") == _day(FOREVER))
    return out.where((F.col("tx_from") <= _day(tx_at)) & (_day(tx_at) < F.col("tx_to")))


def history(facts: DataFrame, s: str, p: str) -> DataFrame:
    return facts.where((F.col("s") == s) & (F.col("p") == p)).orderBy("tx_from", "valid_from")


def to_events(facts: DataFrame, begin: str = "valid_from", end: str = "valid_to", keys: tuple[str, ...] = ("s", "p", "value")) -> DataFrame:
    """(at, op, keys): an add where each interval begins, a delete where it ends; none for open ends."""
    add = F.struct(F.col(begin).alias("at"), F.lit("add").alias("op"))
    gone = F.when(F.col(end) < F.lit(FOREVER), F.struct(F.col(end).alias("at"), F.lit("delete").alias("op")))
    return facts.select(*keys, F.explode(F.array_compact(F.array(add, gone))).alias("e")).select("e.at", "e.op", *keys)


def to_intervals(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, valid_from, valid_to) from adds and deletes: each add lasts to the next event of its key."""
    nxt = F.lead("at").over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("valid_to", F.coalesce(nxt, F.lit(FOREVER).cast(events.schema["at"].dataType))).where("op = 'add'").select(*keys, F.col("at").alias("valid_from"), "valid_to")


def storage_rows(model: Column, entities: Column, fields: Column, changes: Column, years: Column, correction: float = 0.15) -> Column:
    """Rows a versioning model stores: current, valid-time, or bitemporal (each correction adds two)."""
    versions = entities * fields * changes * years
    return F.when(model == "current", entities * fields).when(model == "valid", entities * fields + versions).otherwise(entities * fields + versions * (1 + 2 * correction))


def staleness(reads: DataFrame, facts: DataFrame, now: str) -> DataFrame:
    """reads (run, s, p, read_at) with the value then, the value now and verdict 'proceed' or 'stop'."""
    j = reads.join(facts, ["s", "p"])
    at = lambda day: F.max(F.when((F.col("valid_from") <= day) & (day < F.col("valid_to")), F.col("value")))
    out = j.groupBy("run", "s", "p").agg(at(F.col("read_at")).alias("then"), at(_day(now)).alias("now"))
    return out.withColumn("verdict", F.when(F.col("then").eqNullSafe(F.col("now")), "proceed").otherwise("stop"))


def keep_typed(memory: DataFrame, ttl: dict[str, int], now: Column, default: int = 30, used: int = 2) -> DataFrame:
    """Memories (kind, at, uses) younger than their kind's days, or used often enough."""
    days = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv]), F.col("kind")), F.lit(default))
    return memory.where((F.datediff(now, F.col("at")) <= days) | (F.col("uses") >= used))
