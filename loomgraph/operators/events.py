"""Event sourcing: replay, snapshots, fold policies, hash chains, audits over (seq, at, key, obj, op, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomgraph.storage import materialize


def replay(events: DataFrame, keys: list[str], order: Column, cut: Column | None = None) -> DataFrame:
    """The set after adds and deletes: keys whose last operation (by `order`, up to `cut`) is an add. One combined aggregate:
    with set semantics only the last operation of a key matters."""
    e = events if cut is None else events.where(cut)
    return e.groupBy(*keys).agg(F.max_by("op", order).alias("op")).where("op = 'add'").select(*keys)


def replay_from_snapshot(snapshot: DataFrame, tail: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A snapshot (keys) plus the events after it: equal to a full replay, reading only the tail."""
    base = snapshot.select(*keys, F.lit("add").alias("op"), F.lit(None).cast(tail.schema[order].dataType).alias(order))
    return replay(base.unionByName(tail.select(*keys, "op", order)), keys, F.struct(F.col(order).isNotNull(), F.col(order)))


def stored_snapshot(events: DataFrame, keys: list[str], order: str, cut) -> DataFrame:
    """The set up to `cut`, written once, so that replay_from_snapshot() reads it and the tail however often it is asked."""
    return materialize(replay(events, keys, F.col(order), F.col(order) <= cut), "snapshot")


def trail(events: DataFrame, fact: Column) -> DataFrame:
    return events.where(fact).select("seq", "at", "actor", "op").orderBy("seq")


def added_then_deleted(events: DataFrame, keys: list[str], adder: Column, deleter: Column, ordered: bool = False) -> DataFrame:
    """Delete events by `deleter` on facts that `adder` has added; only later ones if ordered."""
    adds = events.where((F.col("op") == "add") & adder).groupBy(*keys).agg(F.min("seq").alias("__first"))
    out = events.where((F.col("op") == "delete") & deleter).join(adds, keys)
    return (out.where("seq > __first") if ordered else out).drop("__first")


def last_write_wins(events: DataFrame, key: str) -> DataFrame:
    last = events.groupBy(key).agg(F.max_by(F.struct("value", "op"), "seq").alias("l"))
    return last.where("l.op <> 'delete'").select(key, F.col("l.value").alias("value"))


def highest_confidence(events: DataFrame, key: str) -> DataFrame:
    """The add of highest confidence, the first of equals; deletes don't count."""
    return events.where("op <> 'delete'").groupBy(key).agg(F.max_by("value", F.struct("conf", -F.col("seq"))).alias("value"))


def rank_wins(events: DataFrame, key: str, rank: Column) -> DataFrame:
    """In order, a write replaces the standing value if its source ranks at least as high; a delete by such a source removes it.

    The last event among those of the running maximum rank decides: a later event of lower rank never counts.
    """
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("__r", rank).withColumn("__top", F.max(rank).over(w)).where("__r = __top")
    last = e.groupBy(key).agg(F.max_by(F.struct("value", "op"), "seq").alias("l"))
    return last.where("l.op <> 'delete'").select(key, F.col("l.value").alias("value"))


def accumulate(events: DataFrame, key: str) -> DataFrame:
    """All values standing, sorted and joined by ' / '."""
    live = replay(events, [key, "value"], F.col("seq"))
    return live.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("value")), " / ").alias("value"))


def json_array(*parts: Column) -> Column:
    """Strings as a JSON array with ', ' between: the digest's fixed form."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))


def digest(seq: Column, at: Column, actor: Column, op: Column, payload: Column, prev: Column) -> Column:
    """First 16 hex digits of SHA-256 of the JSON array [seq, at, actor, op, payload, prev]."""
    rest = json_array(at, actor, op)
    body = F.concat(F.lit("["), seq.cast("string"), F.lit(", "), F.substr(rest, F.lit(2), F.length(rest) - 2), F.lit(", "), payload, F.lit(', "'), prev, F.lit('"]'))
    return F.substring(F.sha2(body.cast("binary"), 256), 1, 16)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _chain_rows(keys: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        chain, last = None, ""
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            prevs, hashes = [], []
            for row in zip(*cols):
                if row[:keys] != chain:
                    chain, last = row[:keys], ""
                seq, at, actor, op, payload = row[keys:]
                body = f'[{seq}, {_quoted(at)}, {_quoted(actor)}, {_quoted(op)}, {payload}, "{last}"]'
                prevs.append(last)
                last = hashlib.sha256(body.encode()).hexdigest()[:16]
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*batch.schema.names, "prev", "hash"])

    return run


def build_chain(events: DataFrame, chain: list[str]) -> DataFrame:
    """events (seq, at, actor, op, payload) of each chain with prev and hash. Each hash needs the one before, so a chain is one task's work
    in order; it streams through, sorted on disk if need be, and only the last hash is held. Chains run side by side."""
    cols = ["seq", "at", "actor", "op", "payload"]
    rows = events.select(*chain, F.col("seq").cast("bigint").alias("seq"), *cols[1:]).repartition(*chain).sortWithinPartitions(*chain, *cols)
    schema = StructType([*rows.schema, StructField("prev", StringType()), StructField("hash", StringType())])
    return rows.mapInArrow(_chain_rows(len(chain)), schema)


def verify_chain(rows: DataFrame, chain: list[str]) -> DataFrame:
    """(chain, seq, fault): 'link' where prev is not the stored hash before it, 'content' where the hash does not fit the row. Parallel."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(*chain).orderBy("seq")), F.lit(""))
    own = digest(F.col("seq"), F.col("at"), F.col("actor"), F.col("op"), F.col("payload"), F.col("prev"))
    fault = F.when(F.col("__before") != F.col("prev"), "link").when(own != F.col("hash"), "content")
    return rows.withColumn("__before", before).select(*chain, "seq", fault.alias("fault")).where("fault is not null")


def decisions(audit: DataFrame, keys: list[str]) -> DataFrame:
    """asked/answered times to minutes waited; null while unanswered."""
    return audit.withColumn("minutes", F.timestamp_diff("MINUTE", F.col("asked"), F.col("answered"))).select(*keys, "minutes")
