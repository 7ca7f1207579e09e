"""Graph analytics: centrality, PageRank, communities, modularity, link prediction, message passing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import projection
from loomgraph.operators.traverse import bfs, edge_rows, has_lists
from loomgraph.storage import discard, kept, materialize

#: Nodes whose labels are sent to every task as arrays of 16 bytes each (64 MB), and looked up in one of at most 16 more.
VECTOR = 4_000_000


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, score): degree / (n - 1) over both-way distinct edges (src, dst)."""
    deg = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    n = deg.agg(F.count("*").alias("n")).select("n").scalar()
    return deg.select("node", (F.col("deg") / (n - 1)).alias("score"))


def pair_distances(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(source, node, hop) from every source at once: one frontier of pairs a round."""
    edges = materialize(edges.select("src", "dst"), "graph")
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop")), "pairs")
    frontier = seen
    for hop in range(1, max_hops + 1):
        new = frontier.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        frontier = materialize(new.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hop", F.lit(hop)), "pairs")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def closeness(edges: DataFrame, sources: DataFrame, max_hops: int = 64) -> DataFrame:
    """(node, score): (reached - 1) / sum of distances, 0 for an isolated node. All pairs: choose sources on large graphs."""
    d = pair_distances(edges, sources, max_hops).groupBy("source").agg(F.count("*").alias("n"), F.sum("hop").alias("s"))
    return d.select(F.col("source").alias("node"), F.coalesce(F.try_divide(F.col("n") - 1, F.col("s")), F.lit(0.0)).alias("score"))


def betweenness(edges: DataFrame, sources: DataFrame, max_hops: int = 64) -> DataFrame:
    """(node, score): Brandes over the given sources, unnormalised, ordered pairs (each pair twice if all nodes are sources).

    Forward levels keep the number of shortest paths for each (source, node); dependencies flow back level by level.
    """
    edges = materialize(edges.select("src", "dst"), "graph")
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop"), F.lit(1.0).alias("sigma")), "brandes")
    frontier, last = seen, 0
    for hop in range(1, max_hops + 1):
        new = frontier.join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = new.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(hop).alias("hop"), "sigma")
        frontier = materialize(new, "brandes")
        if frontier.isEmpty():
            break
        seen, last = seen.union(frontier), hop
    seen = materialize(seen, "brandes")
    delta = None
    for hop in range(last, 0, -1):
        child = seen.where(F.col("hop") == hop).select("source", F.col("node").alias("child"), F.col("sigma").alias("cs"))
        if delta is None:
            child = child.withColumn("cd", F.lit(0.0))
        else:
            child = child.join(delta.select("source", F.col("node").alias("child"), F.col("delta").alias("cd")), ["source", "child"], "left").fillna(0.0, ["cd"])
        up = child.join(edges, F.col("child") == F.col("dst")).select("source", F.col("src").alias("node"), "cs", "cd")
        up = up.join(seen.where(F.col("hop") == hop - 1).select("source", "node", "sigma"), ["source", "node"])
        now = up.groupBy("source", "node").agg(F.sum(F.col("sigma") / F.col("cs") * (1 + F.col("cd"))).alias("delta"))
        now = materialize(now, "brandes")
        delta = now
        done = now if hop == last else done.union(now)
    nodes = edges.select(F.col("src").alias("node")).distinct()
    if last == 0:
        return nodes.withColumn("score", F.lit(0.0))
    score = done.where("source <> node").groupBy("node").agg(F.sum("delta").alias("score"))
    return nodes.join(score, "node", "left").fillna(0.0, ["score"])


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """(node, score): power iteration, scaled to a largest score of 1."""
    nodes, edges = edges.select(F.col("src").alias("node")).distinct(), kept(edge_rows(edges), "graph")
    x = materialize(nodes.withColumn("score", F.lit(1.0)), "eigen")
    for _ in range(rounds):
        y = edges.join(x, F.col("dst") == F.col("node")).groupBy("src").agg(F.sum("score").alias("y"))
        top = y.agg(F.max("y").alias("m")).select("m").scalar()
        both = materialize(x.join(y.select(F.col("src").alias("node"), (F.col("y") / top).alias("y")), "node"), "eigen")
        change = both.agg(F.max(F.abs(F.col("y") - F.col("score"))).alias("c")).first()["c"]
        x = both.select("node", F.col("y").alias("score"))
        if change is None or change < tolerance:
            break
    return x


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-10, fix_sinks: bool = True) -> DataFrame:
    """(node, score) over directed (src, dst); parallel edges count each. Mass of nodes without out-edges is dealt to all, or
    lost if fix_sinks is false. Out-degrees are joined once; a round is one join and one combined aggregate by node."""
    edges = materialize(edges.select("src", "dst"), "graph")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    nodes = materialize(nodes, "pagerank")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    e = materialize(edges.select("src", "dst").join(out, "src"), "pagerank")
    x = materialize(nodes.join(out, F.col("node") == F.col("src"), "left").select("node", F.lit(1.0 / n).alias("score"), F.col("out").isNull().alias("sink")), "pagerank")
    lost = x.where("sink").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("m")).first()["m"] if fix_sinks else 0.0
    for k in range(rounds):
        got = e.join(x, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("out")).alias("in"))
        new = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("in", F.lit(0.0)) + F.lit(lost / n))
        both = materialize(x.join(got, "node", "left").select("node", new.alias("score"), "sink", F.abs(new - F.col("score")).alias("c")), "pagerank")
        # The change and the next round's lost mass come from one aggregate.
        change, lost = both.agg(F.sum("c"), F.coalesce(F.sum(F.when(F.col("sink"), F.col("score"))), F.lit(0.0))).first()
        lost = lost if fix_sinks else 0.0
        discard(x)
        x = both.select("node", "score", "sink")
        if change < tolerance:
            break
    return x.select("node", "score")


def label_propagation(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """(node, label): synchronous rounds, each node takes its neighbours' most frequent label, ties to the smallest. Stops early when
    nothing changes. (An asynchronous order is not reproducible over partitions; this form is.)

    Where edges come as lists and a label for each node fits an array (VECTOR nodes, 16 bytes each), every task gets all labels and counts
    the votes of a whole node at a time; a round moves one row for each node. Otherwise edges and labels are joined, and votes are moved."""
    if has_lists(edges) and projection.whole(edges, "src"):
        nodes = materialize(edges.select(F.col("src").alias("node")).distinct(), "lpa")
        if nodes.count() <= VECTOR:
            return _vote_by_lists(edges, nodes, rounds)
    edges = edge_rows(edges)
    edges = materialize(edges.select("src", "dst"), "graph")
    x = materialize(edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "lpa")
    for _ in range(rounds):
        votes = edges.join(x, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.col("n"), F.col("label").alias("label"))).getField("label").alias("new"))
        both = materialize(x.join(best, "node"), "lpa")
        x = both.select("node", F.col("new").alias("label"))
        if both.where("label <> new").isEmpty():
            break
    return x


def _vote_by_lists(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    sc = nodes.sparkSession.sparkContext
    x = nodes.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        known = x.toArrow()
        node, label = (known.column(c).to_numpy().astype(np.int64) for c in ("node", "label"))
        order = np.argsort(node)
        node, label = node[order], label[order]
        sent = sc.broadcast((node, label))
        votes = materialize(edges.select("src", "dst", "parts").mapInArrow(_voter(sent), "node long, label long, n long, apart boolean"), "votes")
        sent.destroy()
        # A node whose neighbours lie together has chosen in its task; the votes of one whose rows lie apart are added first.
        parts = votes.where("apart").groupBy("node", "label").agg(F.sum("n").alias("n"))
        parts = parts.groupBy("node").agg(F.min(F.struct(-F.col("n"), F.col("label").alias("label"))).getField("label").alias("label"))
        last, x = x, materialize(votes.where("not apart").select("node", "label").union(parts), "lpa")
        if x.join(last.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            break
    return x


def _voter(sent):
    """Rows of lists -> (node, label, n, apart): the most frequent label of a node's neighbours, or all votes where its rows lie apart."""

    def vote(batches):
        node, label = sent.value
        dense = len(node) and int(node[-1]) - int(node[0]) < 2 * len(node)
        if dense:
            place = np.full(int(node[-1]) - int(node[0]) + 1, -1, np.int64)
            place[node - node[0]] = np.arange(len(node))
        for src, length, dst, _, complete in projection.nodes_of(batches, weights=False):
            row = np.repeat(np.arange(len(src)), length)
            if dense:
                inside = (dst >= node[0]) & (dst <= node[-1])
                at = np.where(inside, place[np.where(inside, dst - node[0], 0)], -1)
            else:
                at = np.minimum(np.searchsorted(node, dst), len(node) - 1)
                at = np.where(node[at] == dst, at, -1)
            row, voted, n = projection.tally(row[at >= 0], label[at[at >= 0]])
            if not len(row):
                continue
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            most = np.repeat(np.maximum.reduceat(n, start), np.diff(np.append(start, len(row))))
            top = np.flatnonzero(n == most)
            best = top[np.concatenate(([True], row[top][1:] != row[top][:-1]))]  # labels rise in a row, so ties go to the least
            out = np.union1d(best[complete[row[best]]], np.flatnonzero(~complete[row]))
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (src[row], voted, n, ~complete[row])], ["node", "label", "n", "apart"])

    return vote


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row q: sum over communities of edges inside / m - gamma * (degree / 2m)^2; edges both ways."""
    labels = kept(labels.select("node", "label"), "labels")  # written, so that their size is known: labels that can be sent don't move the edges
    edges = edge_rows(edges)
    a = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("la")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("lb")), "dst")
    per = a.groupBy(F.col("la").alias("label")).agg(F.count_if(F.col("la") == F.col("lb")).alias("inside"), F.count("*").alias("deg"))
    two_m = F.sum("deg").over(Window.partitionBy())
    per = per.withColumn("q", F.col("inside") / two_m - gamma * (F.col("deg") / two_m) ** 2)
    return per.agg(F.sum("q").alias("q"))


def greedy_modularity(edges: DataFrame, max_rounds: int = 200, gamma: float = 1.0) -> DataFrame:
    """(node, label): merge the pair of communities of largest gain until none gains; ties to the smallest labels. For small graphs."""
    edges = materialize(edges.select("src", "dst"), "graph")
    labels = materialize(edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "greedy")
    two_m = edges.count()
    for _ in range(max_rounds):
        a = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        deg = a.groupBy("a").agg(F.count("*").alias("deg"))
        pair = a.where("a < b").groupBy("a", "b").agg(F.count("*").alias("e"))
        gain = pair.join(deg.withColumnRenamed("deg", "da"), "a").join(deg.select(F.col("a").alias("b"), F.col("deg").alias("db")), "b")
        gain = gain.withColumn("gain", F.round(2 * (F.col("e") / two_m - gamma * F.col("da") * F.col("db") / (two_m * two_m)), 15))
        best = gain.orderBy(F.desc("gain"), "a", "b").select("a", "b", "gain").first()
        if best is None or best["gain"] <= 1e-12:
            break
        labels = materialize(labels.withColumn("label", F.when(F.col("label") == best["b"], F.lit(best["a"])).otherwise(F.col("label"))), "greedy")
    return labels


def common_neighbours(edges: DataFrame, min_common: int = 1) -> DataFrame:
    """(a, b, common, adamic_adar) of unlinked pairs a < b with a shared neighbour; Adamic-Adar sums 1 / ln(degree) of shared neighbours."""
    deg = edges.groupBy(F.col("src").alias("via")).agg(F.count("*").alias("d"))
    e = edges.select(F.col("src").alias("via"), F.col("dst").alias("x")).join(deg, "via")
    pair = e.select("via", "d", F.col("x").alias("a")).join(e.select("via", F.col("x").alias("b")), "via").where("a < b")
    score = pair.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.when(F.col("d") > 1, 1 / F.ln("d")).otherwise(0.0)).alias("adamic_adar"))
    return score.where(F.col("common") >= min_common).join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")


def message_passing(features: DataFrame, edges: DataFrame, w_self: float = 0.5, w_nbr: float = 0.5) -> DataFrame:
    """(node, feat): one layer, w_self * own + w_nbr * mean of neighbours (zeros without any), rounded to 3 places."""
    f = features.select("node", F.posexplode("feat").alias("i", "x"))
    mean = edges.join(f, F.col("dst") == F.col("node")).groupBy("src", "i").agg(F.avg("x").alias("m"))
    new = f.join(mean.withColumnRenamed("src", "node"), ["node", "i"], "left")
    new = new.select("node", "i", F.round(w_self * F.col("x") + w_nbr * F.coalesce("m", F.lit(0.0)), 3).alias("x"))
    return new.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("feat"))


def community_summary(labels: DataFrame, triples: DataFrame, top: int = 3) -> DataFrame:
    """(label, members, causes): the most frequent objects of each community's triples (s, p, o), 'o xN' joined, ties to the smaller."""
    size = labels.groupBy("label").agg(F.count("*").alias("members"))
    counts = triples.join(labels.withColumnRenamed("node", "s"), "s").groupBy("label", "o").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "o"))
    best = counts.withColumn("r", rank).where(F.col("r") <= top)
    text = best.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "o", "n"))), lambda x: F.concat_ws(" x", x["o"], x["n"])), ", ").alias("causes"))
    return size.join(text, "label")


__all__ = ["bfs", "betweenness", "closeness", "common_neighbours", "community_summary", "degree_centrality", "eigenvector", "greedy_modularity", "label_propagation", "message_passing", "modularity", "pagerank", "pair_distances"]
