"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import free_names
from loomgraph.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sizes (source, source_size) with `target`: the sources' shares of the sum of all sizes.

    Sources in code point order, null last, weigh weights[0], weights[1], ..., repeating. A share stops at cap times its source's size;
    the excess goes to the others by weight until none is above. That fixed point is min(cap * size, level * weight) for the
    one level that uses up the sum, found from running sums in order of cap * size / weight: one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("weight")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    ratio = F.col("most") / F.col("weight")
    by = Window.orderBy(ratio, F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    # With the first k sources at their cap, the rest share by weight; the right k is the least whose level leaves the next below its cap.
    t = t.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.sum("source_size").over(all_) - F.col("full")) / F.col("open"))
    t = t.withColumn("place", F.row_number().over(by))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    t = t.withColumn("level", F.min(fits).over(all_).getField("level"))
    share = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", F.when(F.col("source_size") > 0, F.coalesce(share, "most")).otherwise(0.0).alias("target"))


def _draw(seed: int) -> Column:
    """One number in [0, 1) a source, from SHA-256 of the seed and the source: its one random offset."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def _copies(offset: Column) -> Column:
    """Whole numbers crossed between a row's two ends in its source's prefix sum of expected copies, shifted by the offset."""
    return (F.floor(F.col("rank") * F.col("rate") + offset) - F.floor((F.col("rank") - 1) * F.col("rate") + offset)).cast("long")


def _hash_order(seed: int) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 16)


def mix_sizes(sized: DataFrame, seed: int = 1, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Systematic sampling of sized (doc_id, source, size, same, row): doc_id, source, size, row, source_size, target and copies.

    A row's expected copies are its source's target over its source's size. Rows of a source are ranked by size, then by a seeded hash
    of doc_id, then by `same` (a hash of the row's content) and `row` (a number of its own, so that rows equal in all else can be
    split too). A copy is emitted for each whole number that the prefix sum of expected copies, rank * expected + the source's one seeded
    offset, crosses. In order of size the words taken differ from the target by less than the source's longest document, whatever the offset: partial
    sums of (copies - expected) stay within 1. The rank is a prefix sum in two levels: rows are range-partitioned by that order,
    counted by partition, and numbered inside it, so a source of any size is spread over tasks.
    """
    plain = materialize(sized.select("doc_id", "source", "size", _hash_order(seed).alias("h"), "same", "row"), "sizes")
    sizes = plain.groupBy("source").agg(F.sum("size").alias("source_size"))
    aim = materialize(targets(sizes, weights, cap), "targets")
    order = ("size", "h", "same", "row")
    dealt = plain.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    counts = dealt.groupBy("part", "source").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.join(aim.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).drop("source2")
    starts = starts.withColumnRenamed("source", "source3").withColumnRenamed("part", "part3")
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("part", "source").orderBy(*order)))
    ranked = ranked.join(starts, (F.col("part") == F.col("part3")) & F.col("source").eqNullSafe(F.col("source3")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ranked = ranked.withColumn("rank", F.col("start") + F.col("k")).withColumn("rate", rate)
    return ranked.select("doc_id", "source", "size", "row", "source_size", "target", _copies(_draw(seed)).alias("copies"))


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The mix's account of docs (doc_id, text, source): doc_id, size (words), source_size, target (its source's), taken (copies * size).

    A null text has size 0; a source of size 0 has target 0 and takes nothing; null is a source of its own, the last. Rows repeating a
    doc_id are rows each; other columns are ignored. copies never exceed cap rounded up. Reruns, also over other partitions, agree (rows equal in doc_id,
    source and text share theirs). An empty table gives no rows.
    """
    size = word_count(F.col("text")).alias("size")
    sized = docs.select("doc_id", "source", size, F.xxhash64("text").alias("same"), F.monotonically_increasing_id().alias("row"))
    out = mix_sizes(sized, seed, weights, cap)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The mix itself: the rows of docs (doc_id, text, source), with all their columns, each as often as mix() accounts for it.

    The rows are written once with a number of their own, by which their copies come back, so equal rows, null doc_ids and hot sources are
    no hot keys. Rows equal in doc_id, source and text are told apart by a hash of all their columns; only rows equal in all are
    interchangeable. Null texts have no words and are never taken; an empty table gives no rows; columns of any name pass unchanged.
    """
    row, whole = free_names(docs.columns, "mix_row", "mix_whole")
    whole_hash = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(whole, whole_hash), "rows")
    size = word_count(F.col("text")).alias("size")
    # mix() orders equal doc_ids by their texts; here the whole row comes after that.
    sized = kept.select("doc_id", "source", size, F.struct(F.xxhash64("text"), F.col(whole)).alias("same"), F.col(row).alias("row"))
    takes = mix_sizes(sized, seed, weights, cap).where("copies > 0 and size > 0").select(F.col("row").alias(row), F.array_repeat(F.lit(1), F.col("copies").cast("int")).alias(whole))
    rows = kept.drop(whole).join(takes, row).withColumn(row, F.explode(whole))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
