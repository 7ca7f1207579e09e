"""Sharding by a two-pass external shuffle: scatter by seeded hash into memory-sized buckets, then Fisher-Yates each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from loomgraph.llm.common import utf8_bytes
from loomgraph.storage import materialize, new_path

#: Bytes of records that one bucket should hold.
BUCKET_BYTES = 24_000_000
ROW_BYTES = 16
#: Rows (of two numbers each) that a broadcast of the table of buckets may have; beyond it the tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _fisher_yates(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("shard_size", "ascending"), ("shard_same", "ascending")])
        bucket = table.column("shard_bucket")[0].as_py()
        n = table.num_rows
        order = np.arange(n)
        rng = np.random.Generator(np.random.PCG64([seed, bucket]))
        picks = np.floor(rng.random(n) * np.arange(n, 0, -1)).astype(np.int64)  # for position i: one of the n - i rows left
        for i, k in enumerate(picks.tolist()):
            order[i], order[i + k] = order[i + k], order[i]
        table = table.take(pa.array(order))
        at = pa.array(np.arange(n, dtype=np.int64) + table.column("bucket_start")[0].as_py() if n else np.zeros(0, np.int64))
        return table.append_column("position", at).drop_columns(["shard_bucket", "bucket_start", "shard_same"])

    return run


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Shuffle whole records and write them as `shards` shards under `path` (Parquet, a folder for each shard).

    Law `rows`: shard sizes differ by one record at most. Pass one deals records by a seeded hash of doc_id to buckets of about
    bucket_bytes (of all columns); a doc_id whose rows would fill a bucket by themselves is dealt by all its columns too, and rows that are
    equal in all by their own number, so a doc_id that a third of all rows share is no hot bucket. Pass two loads one bucket at a time, puts it
    in a fixed order, runs Fisher-Yates on it with a generator seeded by
    (seed, bucket) and writes it. A record's position is its bucket's start (the running sum of bucket counts) plus its place;
    position * shards div records is its shard. Reruns give the same shards (but for the exchange of rows equal in all columns, where one doc_id
    fills a bucket). Returns the written table: the columns doc_id,
    text, those of docs besides (columns of docs named shard, slot, shard_size, text_crc32 or position are replaced), shard_size (UTF-8 bytes
    and 16), text_crc32, shard, slot (gapless from 0 in each shard). Null texts have no bytes. Rows repeating a doc_id are kept
    each; an empty table is returned as it is, with no shards. One record may exceed a bucket's bytes alone.
    """
    spark = docs.sparkSession
    own = ("shard", "slot", "shard_size", "text_crc32", "position", "shard_bucket", "bucket_start", "shard_same", "shard_salt")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    texts = [f.name for f in docs.schema if isinstance(f.dataType, (StringType, BinaryType))]
    record = sum((F.octet_length(F.coalesce(F.col(f"`{c}`").cast("binary"), F.lit(b""))) for c in texts), F.lit(ROW_BYTES * len(docs.columns))).cast("long")
    docs = docs.withColumn("shard_size", (utf8_bytes(F.col("text")) + ROW_BYTES).cast("long"))
    total, n = docs.agg(F.coalesce(F.sum(record), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // bucket_bytes))
    # Fewer than `buckets` numbers can fill a bucket each, so this table is no larger than that of the buckets.
    heavy = materialize(docs.groupBy(F.col("doc_id").alias("heavy_id")).agg(F.sum(record).alias("bytes"), F.count("*").alias("times")).where((F.col("bytes") > bucket_bytes) & (F.col("times") > 1)).select("heavy_id"), "heavy")
    salt, same = F.lit(0).cast("long"), F.lit(0).cast("long")
    if not heavy.isEmpty():
        ids = docs.join(F.broadcast(heavy) if buckets <= BROADCAST_ROWS else heavy, F.col("doc_id").eqNullSafe(F.col("heavy_id")), "left")
        hit = F.col("heavy_id").isNotNull() | (F.col("doc_id").isNull() & F.lit(heavy.where("heavy_id is null").count() > 0))
        docs = ids.withColumn("shard_same", F.when(hit, F.xxhash64(every)).otherwise(same)).withColumn("shard_salt", F.when(hit, F.monotonically_increasing_id()).otherwise(salt)).drop("heavy_id")
        docs = materialize(docs, "salted")
    else:
        docs = docs.withColumn("shard_same", same).withColumn("shard_salt", salt)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "shard_same", "shard_salt"), F.lit(buckets)).cast("long")
    counts = docs.groupBy(bucket.alias("shard_bucket")).agg(F.count("*").alias("n"))
    before = Window.orderBy("shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_start"))
    dealt = docs.withColumn("shard_bucket", bucket).drop("shard_salt").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    # One row a bucket: of known size, and small beside the records it stands for.
    starts = F.broadcast(starts) if buckets <= BROADCAST_ROWS else starts
    dealt = dealt.join(starts, "shard_bucket")
    schema = dealt.drop("shard_bucket", "bucket_start", "shard_same").schema.add("position", "long")
    mixed = dealt.groupBy("shard_bucket").applyInArrow(_fisher_yates(seed), schema)
    shard = F.expr(f"cast(cast(position as decimal(38,0)) * {shards} div {max(n, 1)} as int)")
    first = F.expr(f"cast((cast(shard as decimal(38,0)) * {max(n, 1)} + {shards - 1}) div {shards} as long)")
    out = mixed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).drop("position")
    path = path or new_path(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
