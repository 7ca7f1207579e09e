"""Lineage, retraction, erasure and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.traverse import bfs
from loomgraph.storage import materialize


def upstream(links: DataFrame, starts: DataFrame, max_hops: int = 4) -> DataFrame:
    """(node, hop) that the starts derive from, over (src derived from dst)."""
    return bfs(links, starts, max_hops).where("hop > 0")


def downstream(links: DataFrame, starts: DataFrame, max_hops: int = 4) -> DataFrame:
    return bfs(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, max_hops).where("hop > 0")


def retract(facts: DataFrame, derived: DataFrame, source) -> DataFrame:
    """(fact, how): facts (fact, source) of a source die 'direct'; a fact (fact, base) with a dead base dies by 'cascade', to a fixpoint."""
    dead = materialize(facts.where(F.col("source") == source).select("fact").distinct().withColumn("how", F.lit("direct")), "retract")
    new = dead
    while True:
        step = derived.join(new.select(F.col("fact").alias("base")), "base").select("fact").distinct().join(dead.select("fact"), "fact", "left_anti")
        new = materialize(step.withColumn("how", F.lit("cascade")), "retract")
        if new.isEmpty():
            return dead
        dead = dead.union(new)


def incident(edges: DataFrame, who) -> DataFrame:
    """(direction, type, other, n) of a node's edges (src, type, dst)."""
    out = edges.where(F.col("src") == who).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    into = edges.where(F.col("dst") == who).select(F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
    return out.union(into).groupBy("direction", "type", "other").agg(F.count("*").alias("n"))


def residue(nodes: DataFrame, text_col: str, name: str) -> DataFrame:
    """Nodes whose text still holds a name after the node itself is gone."""
    return nodes.where(F.contains(text_col, F.lit(name)))


def shared_target(links: DataFrame, about: DataFrame, start, max_hops: int = 5) -> DataFrame:
    """People tied to what a node leads to: links (src, dst) walked from start, then about (person, target)."""
    starts = links.sparkSession.createDataFrame([(start,)], f"node {links.schema['src'].dataType.simpleString()}")
    return bfs(links, starts, max_hops).select(F.col("node").alias("target")).join(about, "target").select("person", "target").distinct()


def deletion_plan(items: DataFrame, policy: DataFrame) -> DataFrame:
    """items (id, kind) with their action; kinds without a policy are 'unknown', and then every row has stop = true."""
    j = items.join(policy, "kind", "left").withColumn("action", F.coalesce("action", F.lit("unknown")))
    unknown = j.agg(F.count_if(F.col("action") == "unknown").alias("n")).select("n").scalar()
    return j.withColumn("stop", unknown > 0)


def k_anonymity_sweep(df: DataFrame, keys: list[str]) -> DataFrame:
    """(depth, k, singletons, groups) for each prefix of the quasi-identifiers: one pass by rollup, coarser groups from finer counts."""
    flags = [F.grouping(k).cast("int") for k in keys]
    depth = F.lit(len(keys)) - sum(flags[1:], flags[0])
    counts = df.rollup(*keys).agg(F.count("*").alias("n"), depth.alias("depth")).where("depth > 0")
    return counts.groupBy("depth").agg(F.min("n").alias("k"), F.count_if(F.col("n") == 1).alias("singletons"), F.count("*").alias("groups"))


#: Four levels of deletion, weakest first, and by criterion the levels that meet it (fixed values).
LEVELS = ("hide", "detach", "pseudonym", "erase")
CRITERIA = {
    "not shown": "1111",
    "not found by name": "0111",
    "not linked to other data": "0001",
    "aggregates kept": "1110",
    "audit history kept": "1110",
    "histories of others kept": "1110",
    "reversible": "1010",
    "gone from backups": "0001",
}


def deletion_matrix(spark) -> DataFrame:
    """(level, criterion, met): what each level of deletion satisfies and breaks."""
    rows = [(level, c, flags[i] == "1") for c, flags in CRITERIA.items() for i, level in enumerate(LEVELS)]
    return spark.createDataFrame(rows, "level string, criterion string, met boolean")


def deletion_scores(deletions: DataFrame) -> DataFrame:
    """deletions (level, ...) with `met`, the number of criteria that their level satisfies; an unknown level meets none."""
    score = deletion_matrix(deletions.sparkSession).groupBy("level").agg(F.count_if("met").alias("met"))
    return deletions.join(F.broadcast(score), "level", "left").withColumn("met", F.coalesce("met", F.lit(0)))  # four rows


def extraction_growth(facts: DataFrame, keys: list[str], identity: list[str], order: str, wrong) -> DataFrame:
    """Running counts by key in `order`: nodes (first sightings of `identity`), edges (facts), duplicates (sightings after the first), wrong."""
    fresh = F.when(F.row_number().over(Window.partitionBy(*keys, *identity).orderBy(order)) == 1, 1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(order)
    out = facts.withColumn("__fresh", fresh).withColumn("__wrong", F.when(wrong, 1).otherwise(0))
    return out.select(order, F.sum("__fresh").over(w).alias("nodes"), F.row_number().over(w).cast("long").alias("edges"), F.sum(1 - F.col("__fresh")).over(w).alias("duplicates"), F.sum("__wrong").over(w).alias("wrong"))
