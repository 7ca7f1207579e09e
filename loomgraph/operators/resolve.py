"""Entity resolution: blocking, weighted scores, clusters, reversible merges, survivorship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.relational import met_in_blocks
from loomgraph.storage import materialize


def candidate_pairs(records: DataFrame, keys: dict[str, Column], id_col: str = "id") -> DataFrame:
    """Distinct pairs (a, b) of the union of several blocking keys."""
    return met_in_blocks(records, list(keys.values()), id_col).select("a", "b")


def missed_pairs(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.select("a", "b").join(pairs, ["a", "b"], "left_anti")


def weighted_score(fields: list[tuple[float, Column, Column]]) -> Column:
    """fields: (weight, both sides present, similarity). Absent fields drop out and the weights are renormalised; 9 places."""
    top = reduce(lambda x, y: x + y, [F.when(there, w * sim).otherwise(0.0) for w, there, sim in fields])
    base = reduce(lambda x, y: x + y, [F.when(there, F.lit(float(w))).otherwise(0.0) for w, there, _ in fields])
    return F.round(F.coalesce(F.try_divide(top, base), F.lit(0.0)), 9)


def verdict(score: Column, high: float = 0.85, low: float = 0.55) -> Column:
    return F.when(score >= high, "auto").when(score >= low, "review").otherwise("reject")


def clusters(ids: DataFrame, accepted: DataFrame, id_col: str = "id", unique: bool = False) -> DataFrame:
    """(id, cluster) over accepted pairs (a, b); the cluster is its least id, a lone record its own. unique: as for components."""
    comp = connected_components(accepted, unique=unique)
    return ids.select(F.col(id_col).alias("node")).join(comp, "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("cluster"))


def apply_merges(ids: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, root) after a log (seq, kept, dropped, undone): a pointer table from merges that stand, then pointer jumping: log2 of the
    longest chain of merges rounds. Merges that lead in a circle are an error."""
    last = log.groupBy("dropped").agg(F.max_by(F.struct("kept", "undone"), "seq").alias("l")).where("not l.undone")
    at = materialize(ids.select(F.col(id_col).alias("id")).join(last.select(F.col("dropped").alias("id"), F.col("l.kept").alias("kept")), "id", "left").select("id", F.coalesce("kept", "id").alias("root")), "merge")
    for _ in range(64):
        hop = at.join(at.select(F.col("id").alias("root"), F.col("root").alias("next")), "root").select("id", F.col("root").alias("old"), F.col("next").alias("root"))
        hop = materialize(hop, "merge")
        if hop.where("old <> root").isEmpty():
            return hop.select("id", "root")
        at = hop.select("id", "root")
    raise ValueError("the merges that stand lead in a circle")


def merged_view(records: DataFrame, roots: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """One row a root: each field from the richest record (most non-empty fields, then least id) that has it."""
    rich = reduce(lambda x, y: x + y, [F.when(F.length(f) > 0, 1).otherwise(0) for f in fields])
    j = records.withColumn("__rich", rich).join(roots, id_col)
    pick = lambda f: F.max_by(F.when(F.length(f) > 0, F.col(f)), F.when(F.length(f) > 0, F.struct(F.col("__rich"), -F.col("__n")))).alias(f)
    j = j.withColumn("__n", F.row_number().over(Window.partitionBy("root").orderBy(id_col)))
    return j.groupBy("root").agg(*[pick(f) for f in fields])


def threshold_sweep(scored: DataFrame, thresholds: list[float], score: str = "score", truth: str = "same") -> DataFrame:
    """threshold, tp, fp, fn, precision, recall over scored pairs: one pass and one row of counts; none for no pairs."""
    same, aggs, rows = F.col(truth), [], []
    for i, t in enumerate(dict.fromkeys(thresholds)):
        yes = F.col(score) >= F.lit(t)
        aggs += [F.count_if(yes & same).alias(f"tp{i}"), F.count_if(yes & ~same).alias(f"fp{i}"), F.count_if(~yes & same).alias(f"fn{i}")]
        rows.append(F.struct(F.lit(t).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn")]))
    counts = scored.agg(F.count("*").alias("n"), *aggs).where("n > 0")
    out = counts.select(F.inline(F.array(*rows)))
    return out.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 9)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 9))


def survivor(df: DataFrame, keys: list[str], rules: dict[str, tuple[str, list[Column]]]) -> DataFrame:
    """One row a key: each field by its rule, (name of the output, order columns, best last), empties removed first.

    rules: field -> (output, [columns that rank a row; the largest wins, then the first by the last column])."""
    picks = [F.max_by(F.when(F.length(f) > 0, F.col(f)), F.when(F.length(f) > 0, F.struct(*order))).alias(out) for f, (out, order) in rules.items()]
    return df.groupBy(*keys).agg(*picks)
