"""Write conflicts, merges and migrations as deterministic folds over the writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def lost_updates(writes: DataFrame) -> DataFrame:
    """writes (key, seq, field, value) that each wrote a whole row read before the others: the last wins, the rest are `lost`."""
    last = Window.partitionBy("key").orderBy(F.desc("seq"))
    return writes.withColumn("lost", F.row_number().over(last) > 1)


def optimistic_rounds(writes: DataFrame, max_rounds: int = 5) -> DataFrame:
    """(key, seq, tries): with a version check, one write of a key succeeds a round, in order; the others try again, up to max_rounds
    (tries null for those that give up). The number of a write among its key's is its round: no loop is needed."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return writes.select("key", "seq", n.alias("n")).select("key", "seq", F.when(F.col("n") <= max_rounds, F.col("n")).alias("tries"))


def field_level(writes: DataFrame) -> DataFrame:
    """The last write of each (key, field)."""
    return writes.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def conflicts_at(ops: DataFrame, granularity: list[str]) -> DataFrame:
    """Groups of operations that block each other if locks cover `granularity`."""
    return ops.groupBy(*granularity).agg(F.count("*").alias("n")).where("n > 1")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def three_way(policy: str, base: Column, a: Column, src_a: Column, b: Column, src_b: Column, kind: Column, rank: dict[str, int]) -> Column:
    """The merged value, null where a person has to decide. Policies: last_wins, source_rank, type_aware, always_human."""
    r = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    ra, rb = F.element_at(r, src_a), F.element_at(r, src_b)
    if policy == "last_wins":
        return b
    if policy == "always_human":
        return F.lit(None).cast("string")
    if policy == "source_rank":
        return F.when(ra > rb, a).when(rb > ra, b)
    both = F.array_join(F.array_sort(F.array_distinct(F.concat(F.split(a, ","), F.split(b, ",")))), ",")
    delta = (_number(a) + _number(b) - _number(base)).cast("long").cast("string")
    return F.when(a == b, a).when(kind == "set", both).when(kind == "number", delta).when(a == base, b).when(b == base, a)


def expected_tries(p: Column, max_tries: int = 6) -> Column:
    """Expected attempts when each conflicts with probability p: sum of p^k, k below max_tries."""
    return reduce(lambda x, k: x + F.pow(p, F.lit(k)), range(1, max_tries), F.lit(1.0))


def lock_costs(p: Column, hold: float, write: float, lock: float, max_tries: int = 6) -> tuple[Column, Column]:
    """(optimistic, pessimistic) milliseconds a write at conflict rate p: repeat the work at each conflict, or lock and wait for the holder."""
    return (hold + write) * expected_tries(p, max_tries), hold + write + lock + hold * p


def readers_served(readers: DataFrame, reads: str) -> DataFrame:
    """readers with the name ('old', 'new') they read: by phase of an expand-copy-contract rename, how many of each find their column filled."""
    phases = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(old).alias("old"), F.lit(new).alias("new")) for p, old, new in (("start", True, False), ("expand", True, False), ("copy", True, True), ("contract", False, True))]))
    counts = readers.groupBy(reads).agg(F.count("*").alias("n")).withColumn("p", phases)
    served = lambda name: F.sum(F.when((F.col(reads) == name) & F.col(f"p.{name}"), F.col("n")).otherwise(0))
    return counts.groupBy("p.phase").agg(served("old").alias("old_readers"), served("new").alias("new_readers"), F.sum("n").alias("readers"))


def write_gate(candidates: DataFrame, aliases: dict[str, str], allowed: list[str], single: list[str], least: float = 0.65) -> DataFrame:
    """candidates (seq, s, k, o, conf) with `outcome`: confidence, schema, single-value, duplicate or written, checked in this order.

    Sequential state becomes windows: of the rows that pass the first two checks, the first object of a single-valued (s, k) stands,
    others conflict; of the rest the first of each (s, k, o) is written.
    """
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    canon = lambda c: F.coalesce(F.element_at(names, c), c) if names is not None else c
    c = candidates.withColumn("s", canon(F.col("s"))).withColumn("o", canon(F.col("o")))
    early = F.when(F.col("conf") < least, "confidence").when(~F.col("k").isin(*allowed), "schema")
    c = c.withColumn("early", early)
    passed = F.col("early").isNull()
    by_sk = Window.partitionBy("s", "k", passed).orderBy("seq")
    first = F.first("o").over(by_sk)
    conflict = passed & F.col("k").isin(*single) & (F.col("o") != first) if single else F.lit(False)
    c = c.withColumn("conflict", conflict)
    nth = F.row_number().over(Window.partitionBy("s", "k", "o", passed).orderBy("seq"))
    outcome = F.when(~passed, F.col("early")).when(F.col("conflict"), "single-value").when(F.col("nth") > 1, "duplicate").otherwise("written")
    return c.withColumn("nth", nth).withColumn("outcome", outcome).drop("early", "conflict", "nth")


def expand_contract(rows: DataFrame, old: str, new: str, phase: str) -> DataFrame:
    """A rename in phases: expand (add new), copy (fill new from old), contract (drop old)."""
    if phase == "expand":
        return rows.withColumn(new, F.lit(None).cast(rows.schema[old].dataType))
    if phase == "copy":
        return rows.withColumn(new, F.coalesce(new, old))
    return rows.drop(old)


def dual_read(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old, new, merged (new, else old), alert (they differ, null-safe)."""
    j = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    return j.withColumn("merged", F.coalesce("new", "old")).withColumn("alert", ~F.col("old").eqNullSafe(F.col("new")))


def first_blocked(gates: DataFrame) -> DataFrame:
    """The first phase of (phase, name, passed) that does not pass; no row if all do."""
    return gates.where("not passed").agg(F.min(F.struct("phase", "name")).alias("x")).where("x is not null").select("x.phase", "x.name")


