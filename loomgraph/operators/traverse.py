"""Traversal: adjacency, BFS, paths, closure, layers, projection. Iteration runs on the driver, every round is a Spark job on
tables; rounds are written to the shared folder, so lineage stays short and lost executors cost one round at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loomgraph.operators import projection
from loomgraph.storage import kept, materialize


def has_lists(edges: DataFrame) -> bool:
    """Whether edges are rows (src, dst) or, as projection.LINKS, rows of a node with the list of its neighbours."""
    return isinstance(edges.schema["dst"].dataType, ArrayType)


def edge_rows(edges: DataFrame) -> DataFrame:
    """(src, dst), a row for each edge."""
    return edges.select("src", F.explode("dst").alias("dst") if has_lists(edges) else "dst")


def step_from(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """frontier (node, ...) with dst: a row for each edge that leaves its nodes; lists are opened after the join."""
    met = frontier.join(edges.select("src", "dst"), F.col("node") == F.col("src")).drop("src")
    return met.withColumn("dst", F.explode("dst")) if has_lists(edges) else met


def in_order(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df with its number from 0 in the order of `by`: counts by range partition first, then numbers inside each."""
    dealt = materialize(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return dealt.withColumn("inner", inside).join(F.broadcast(bases), "part").select(*df.columns, (F.col("base") + F.col("inner")).alias(name))


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, distinct, no loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select(F.col("dst"), F.col("src"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """node, nbrs: sorted distinct neighbours. For nodes of bounded degree; joins on edges don't need it."""
    node = F.col("src").alias("node")
    if has_lists(edges):
        return projection.joined(edges)
    return edges.groupBy(node).agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def csr(edges: DataFrame) -> DataFrame:
    """node, start, degree: where each node's neighbours begin in the edge list sorted by (src, dst).

    The running sum is taken over ranges: counts by range partition first, then inside each partition.
    """
    size = F.sum(F.size("dst").cast("long")) if has_lists(edges) else F.count("*")
    deg = edges.groupBy(F.col("src").alias("node")).agg(size.alias("degree"))
    dealt = materialize(deg.repartitionByRange("node").withColumn("part", F.spark_partition_id()), "csr")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.sum("degree").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("inner", F.coalesce(F.sum("degree").over(inside), F.lit(0))).join(starts, "part")
    return out.select("node", (F.col("base") + F.col("inner")).alias("start"), "degree")


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int, goal=None) -> DataFrame:
    """(node, hop): distance from the nearest start, at most max_hops or the goal's. A round joins only the last frontier with the edges."""
    edges = kept(edges.select("src", "dst"), "graph")
    seen = materialize(starts.select("node").distinct().withColumn("hop", F.lit(0)), "bfs")
    frontier = seen
    for hop in range(1, max_hops + 1):
        if goal is not None and not frontier.where(F.col("node") == goal).isEmpty():
            break
        new = step_from(frontier.select("node"), edges).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = materialize(new.withColumn("hop", F.lit(hop)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def bfs_levels(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """hop, new (nodes at exactly that distance), reached (so far)."""
    per = bfs(edges, starts, max_hops).groupBy("hop").agg(F.count("*").alias("new"))
    return per.withColumn("reached", F.sum("new").over(Window.orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)))


def walk_depths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth) pairs of walks from the starts: a node reachable at two depths is there twice. One distinct a level, so
    rows stay below nodes * depth, unlike a recursive UNION ALL."""
    edges = materialize(edges.select("src", "dst"), "graph")
    level = starts.select("node").distinct().withColumn("depth", F.lit(0))
    out = level
    for k in range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(k))
        out = out.union(level)
    return out


def shortest_path(edges: DataFrame, start, goal, max_hops: int = 8) -> DataFrame:
    """One row (path, visited): the least shortest path by node order, none if there is no path within max_hops. A round compares the
    numbers of paths, one number for each edge; only the path chosen for a node is copied."""
    edges = kept(edges.select("src", "dst"), "graph")
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    seen = materialize(spark.createDataFrame([(start, [start], 0)], f"node {kind}, path array<{kind}>, turn long"), "path")
    frontier = seen
    for _ in range(max_hops):
        if not seen.where(F.col("node") == goal).isEmpty():
            break
        new = step_from(frontier.select("node", "turn"), edges).groupBy(F.col("dst").alias("node")).agg(F.min("turn").alias("via"))
        new = in_order(new.join(seen.select("node"), "node", "left_anti"), "turn", "via", "node")
        new = new.join(frontier.select(F.col("turn").alias("via"), F.col("path").alias("upto")), "via")
        frontier = materialize(new.select("node", F.array_append("upto", F.col("node")).alias("path"), "turn"), "path")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    visited = seen.count()
    return seen.where(F.col("node") == goal).select("path", F.lit(visited).alias("visited"))


def bidirectional_distance(edges: DataFrame, start, goal, max_hops: int = 8) -> DataFrame:
    """One row (distance, visited) by two frontiers that grow in turn until they meet: each reaches only half as deep."""
    edges = kept(edges.select("src", "dst"), "graph")
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    back = edge_rows(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    # Written, so that their size is known and a round doesn't move the edges to meet one row.
    sides = [[materialize(spark.createDataFrame([(end, 0)], f"node {kind}, hop int"), "bidi")] * 2 for end in (start, goal)]
    for turn in range(max_hops + 1):
        a, b = sides[0][0], sides[1][0].withColumnRenamed("hop", "hop2")
        met = a.join(b, "node").agg(F.min(F.col("hop") + F.col("hop2")).alias("distance")).first()["distance"]
        if met is not None:
            return spark.createDataFrame([(int(met), a.count() + b.count())], "distance int, visited long")
        side, graph = sides[turn % 2], edges if turn % 2 == 0 else back
        seen, frontier = side
        new = step_from(frontier, graph).select(F.col("dst").alias("node"), (F.col("hop") + 1).alias("hop")).distinct()
        new = materialize(new.join(seen.select("node"), "node", "left_anti"), "bidi")
        if new.isEmpty():
            break
        side[0], side[1] = materialize(seen.union(new), "bidi"), new
    return spark.createDataFrame([], "distance int, visited long")


class CycleError(ValueError):
    """A dependency graph has a cycle."""


def topological_layers(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(node, layer) by Kahn's rounds; deps (node, dep). Raises CycleError if some nodes never become ready."""
    left = materialize(nodes.select("node").distinct(), "topo")
    open_deps = materialize(deps.select("node", "dep").distinct(), "topo")
    done = None
    layer = 0
    while not left.isEmpty():
        ready = materialize(left.join(open_deps.select("node").distinct(), "node", "left_anti").withColumn("layer", F.lit(layer)), "topo")
        if ready.isEmpty():
            raise CycleError("no node is ready: the dependencies have a cycle")
        done = ready if done is None else done.union(ready)
        left = materialize(left.join(ready.select("node"), "node", "left_anti"), "topo")
        open_deps = materialize(open_deps.join(ready.select(F.col("node").alias("dep")), "dep", "left_anti").select("node", "dep"), "topo")
        layer += 1
    return done if done is not None else nodes.select("node").withColumn("layer", F.lit(0)).limit(0)


def longest_cost(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(node, total): own cost plus the largest total among dependencies; the critical path is the largest of all. nodes: (node, cost)."""
    layers = topological_layers(nodes, deps)
    last = layers.agg(F.max("layer").alias("m")).first()["m"] or 0
    have = None
    for k in range(last + 1):
        now = layers.where(F.col("layer") == k).select("node").join(nodes, "node")
        if have is None:
            step = now.select("node", F.col("cost").alias("total"))
        else:
            best = deps.join(have.withColumnRenamed("node", "dep"), "dep").groupBy("node").agg(F.max("total").alias("best"))
            step = now.join(best, "node", "left").select("node", (F.col("cost") + F.coalesce("best", F.lit(0))).alias("total"))
        step = materialize(step, "cost")
        have = step if have is None else have.union(step)
    return have


def shortest_distances(edges: DataFrame, start, max_rounds: int, directed: bool = True, weight: Column | None = None) -> DataFrame:
    """(node, dist) by relaxation rounds over edges (src, dst, w), until nothing changes; w may be negative.

    Raises ValueError if distances still change after max_rounds rounds (a negative cycle, or max_rounds below the longest path).
    """
    e = edges.select("src", "dst", (weight if weight is not None else F.col("w")).cast("double").alias("w"))
    if not directed:
        e = e.union(e.select(F.col("dst"), F.col("src"), "w"))
    e = materialize(e.groupBy("src", "dst").agg(F.min("w").alias("w")), "relax")
    dist = materialize(e.sparkSession.createDataFrame([(start, 0.0)], f"node {e.schema['src'].dataType.simpleString()}, dist double"), "relax")
    changed = dist
    for _ in range(max_rounds):
        reach = changed.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("new"))
        reach = reach.groupBy("node").agg(F.min("new").alias("new"))
        both = materialize(dist.join(reach, "node", "full").select("node", "dist", "new", (F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12)).alias("hit")), "relax")
        changed = both.where("hit").select("node", F.col("new").alias("dist"))
        dist = both.select("node", F.when(F.col("hit"), F.col("new")).otherwise(F.col("dist")).alias("dist"))
        if changed.isEmpty():
            return dist
    raise ValueError("distances do not settle: negative cycle or too few rounds")


def count_paths(edges: DataFrame, start, goal, max_hops: int) -> DataFrame:
    """One row (paths): distinct paths from start to goal in a DAG, summed level by level (never enumerated)."""
    edges = materialize(edges.select("src", "dst"), "graph")
    kind = edges.schema["src"].dataType.simpleString()
    level = edges.sparkSession.createDataFrame([(start, 1)], f"node {kind}, n int").select("node", F.col("n").cast("decimal(38,0)").alias("n"))
    total = 0
    for _ in range(max_hops):
        nxt = level.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        level = materialize(nxt, "paths")
        if level.isEmpty():
            break
        got = level.where(F.col("node") == goal).agg(F.sum("n").alias("n")).first()["n"]
        total += int(got or 0)
    return edges.sparkSession.createDataFrame([(total,)], "paths long")


def all_shortest_paths(edges: DataFrame, start, goal, max_hops: int) -> DataFrame:
    """path: every shortest path from start to goal. The edges that lie on one are found first, level by level back from the goal; only
    those are joined to paths."""
    edges = kept(edges.select("src", "dst"), "graph")
    starts = edges.sparkSession.createDataFrame([(start,)], f"node {edges.schema['src'].dataType.simpleString()}")
    dist = bfs(edges, starts, max_hops, goal)
    hops = dist.where(F.col("node") == goal).select("hop").first()
    paths = dist.where(F.col("node") == goal).select(F.array("node").alias("path"), F.col("node").alias("at"))
    on = materialize(paths.select("at"), "asp")
    for hop in range(hops["hop"] - 1 if hops else -1, -1, -1):
        near = step_from(dist.where(F.col("hop") == hop).select("node"), edges)
        used = materialize(near.join(on.select(F.col("at").alias("dst")), "dst").select("node", "dst"), "asp")
        on = materialize(used.select(F.col("node").alias("at")).distinct(), "asp")
        paths = paths.join(used, F.col("at") == F.col("dst")).select(F.array_prepend("path", F.col("node")).alias("path"), F.col("node").alias("at"))
    return paths.select("path")


def closure(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transitive closure of (a, b), without (x, x): semi-naive, a round joins only the pairs that are new."""
    base = materialize(pairs.select("a", "b").distinct(), "closure")
    known = delta = base
    for _ in range(max_rounds):
        step = delta.join(base.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        delta = materialize(step.join(known, ["a", "b"], "left_anti"), "closure")
        if delta.isEmpty():
            return known.where("a <> b")
        known = known.union(delta)
    raise RuntimeError("closure did not settle")


def chain_to_root(parents: DataFrame, start, max_depth: int = 50) -> DataFrame:
    """(depth, node): the upward chain from start over (child, parent); stops at the root, at max_depth, or where it would repeat."""
    at, out, seen = start, [], {start}
    spark = parents.sparkSession
    for depth in range(1, max_depth + 1):
        row = parents.where(F.col("child") == at).agg(F.min("parent").alias("p")).first()
        if row["p"] is None or row["p"] in seen:
            break
        at = row["p"]
        seen.add(at)
        out.append((depth, at))
    return spark.createDataFrame(out, f"depth int, node {parents.schema['parent'].dataType.simpleString()}")


def blast_radius(calls: DataFrame, uses: DataFrame, values: DataFrame, start, max_hops: int = 8) -> DataFrame:
    """One row (agents, resources, score): agents reachable over calls (src, dst), resources they use (agent, resource), sum of values (resource, value)."""
    starts = calls.sparkSession.createDataFrame([(start,)], f"node {calls.schema['src'].dataType.simpleString()}")
    agents = bfs(calls, starts, max_hops).select(F.col("node").alias("agent"))
    hit = agents.join(uses, "agent").select("resource").distinct().join(values, "resource")
    return hit.agg(F.count("*").alias("resources"), F.coalesce(F.sum("value"), F.lit(0)).alias("score")).withColumn("agents", F.lit(agents.count()))


def locality(edges: DataFrame) -> DataFrame:
    """Mean distance of the ends' numbers: what relabelling in BFS order lowers."""
    return edges.agg(F.avg(F.abs(F.col("src") - F.col("dst"))).alias("locality"))


def bfs_relabel(edges: DataFrame, start, max_hops: int) -> DataFrame:
    """(node, label): numbers in the order (hop, node), of what is reachable."""
    starts = edges.sparkSession.createDataFrame([(start,)], f"node {edges.schema['src'].dataType.simpleString()}")
    return in_order(bfs(edges, starts, max_hops), "label", "hop", "node").select("node", "label")


def project_bipartite(pairs: DataFrame, side: str, via: str) -> DataFrame:
    """(a, b, w), a < b: how many `via` nodes two `side` nodes share. pairs: distinct (side, via).

    Whole numbers meet by lists (projection.pairs_met, for which repeated pairs count once). Keys of other types meet in a self-join on
    `via`, which grows with the square of a via node's degree, as its output does; adaptive execution splits hot keys, and counts are
    combined before the shuffle on (a, b).
    """
    if projection.whole(pairs, side, via):
        return projection.pairs_met(pairs, side, via)
    left = pairs.select(F.col(side).alias("a"), F.col(via).alias("v"))
    right = pairs.select(F.col(side).alias("b"), F.col(via).alias("v"))
    return left.join(right, "v").where("a < b").groupBy("a", "b").agg(F.count("*").alias("w"))


def projection_size(pairs: DataFrame, side: str, via: str) -> DataFrame:
    """Rows that the self-join of project_bipartite would make, known before it is run."""
    deg = pairs.groupBy(via).agg(F.count_distinct(side).cast("long").alias("k"))
    return deg.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("pairs"))


def projected_degree(pairs: DataFrame, side: str, via: str) -> DataFrame:
    """(node, degree): the weighted degree that project_bipartite() would give each `side` node, without making a pair: a node counts
    the others of each of its `via` nodes. Two aggregates and a join by key; nodes without a partner are left out."""
    size = pairs.groupBy(F.col(via).alias("v")).agg((F.count("*") - 1).alias("others"))
    each = pairs.select(F.col(side).alias("node"), F.col(via).alias("v")).join(size.where("others > 0"), "v")
    return each.groupBy("node").agg(F.sum("others").alias("degree"))
