"""Connected components by randomised contraction: a few joins and aggregates a round, O(log n) rounds, no collected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import PACKED, discard, materialize, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, unique: bool = False) -> DataFrame:
    """Component of every node that has an edge to another: (node, component), component = the smallest node in it.

    Nulls and self-loops take no part; repeated and reversed edges count once. unique: the caller knows that edges don't repeat, so they
    aren't compared before the first round, nor written again where they lie in an intermediate table. Each round every node takes the
    neighbour (or itself) that comes first in a seeded hash order (in the first two rounds: in the order of the nodes), and the edges are rewritten to the chosen nodes, so
    every component shrinks by a constant factor a round whatever its shape; chains don't cost a round per edge and a
    hub's edges become one. Aggregates combine before the shuffle; the joins back are on one row per node, which
    adaptive execution can split when a hub is hot.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    given = unique and stored(e)
    e = e if given else materialize(e, "edges", **PACKED) if unique else materialize(e.distinct(), "edges")
    kind = e.schema["a"].dataType
    maps: list[DataFrame] = []
    first = n = e.count()
    for turn in range(max_rounds):
        if not n:
            break
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        # Two rounds go by the numbers themselves: a star around its least node, the usual shape here, is one node then.
        key = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("id"))
        if turn > 1:
            to = both.groupBy(F.col("a").alias("node")).agg(F.min(key(F.col("b"))).alias("m"))
            to = to.select("node", F.least(F.col("m"), key(F.col("node"))).getField("id").alias("to"))
        else:  # the least number alone, which is aggregated by hash; a pair would be by sorting all edges
            to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("m", "node").alias("to"))
        to = materialize(to, "hook", n)
        maps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        before = e
        e = e.join(left, "a").join(right, "b").where("x <> y")
        e = materialize(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", n)
        if not given or turn:
            discard(before)
        n = e.count()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    out = maps[0]
    for to in maps[1:]:
        out = out.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    # Written first, so that the join back can be split or broadcast; straight onto the aggregate it would gather a component in one task.
    out = materialize(out, "roots", first) if len(maps) > 1 else out
    least = materialize(out.groupBy("to").agg(F.min("node").alias("component")), "least", first)
    found = materialize(out.join(least, "to").select("node", "component"), "components", first)
    discard(e, out, least, *maps)
    return found
