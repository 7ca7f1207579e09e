"""Constraint validation and graph-quality checks: violations are rows of a query, never exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite(blocking: Column, warning: Column, info: Column, n: Column) -> Column:
    """max(0, 100 * (1 - (10 b + 3 w + i) / (n / 2)))."""
    return F.greatest(F.lit(0.0), 100 * (1 - (10 * blocking + 3 * warning + info) / (n / 2.0)))


SEVERITIES = ("Violation", "Warning", "Info")  # fixed values, in order


class Shape:
    """One property constraint of a class of focus nodes."""

    def __init__(self, target: str, path: str, severity: str = "Violation", message: str = "", inverse: bool = False, min_count: int | None = None, max_count: int | None = None, pattern: str | None = None, one_of: list | None = None, min_length: int | None = None, min_inclusive: float | None = None, datatype: str | None = None):
        self.target, self.path, self.severity, self.message, self.inverse = target, path, severity, message, inverse
        self.min_count, self.max_count, self.pattern, self.one_of = min_count, max_count, pattern, one_of
        self.min_length, self.min_inclusive, self.datatype = min_length, min_inclusive, datatype

    def bad_value(self, v: Column) -> Column:
        """Whether a present value breaks a value constraint."""
        tests = [F.lit(False)]
        if self.pattern is not None:
            tests.append(~v.rlike(self.pattern))
        if self.one_of is not None:
            tests.append(~v.isin(*self.one_of))
        if self.min_length is not None:
            tests.append(F.length(v) < self.min_length)
        if self.min_inclusive is not None:
            tests.append(F.coalesce(v.try_cast("double") < self.min_inclusive, F.lit(True)))
        if self.datatype is not None:
            tests.append(v.try_cast(self.datatype).isNull())
        return reduce(lambda a, b: a | b, tests)


def validate_shapes(triples: DataFrame, shapes: list[Shape], type_predicate: str = "a") -> DataFrame:
    """Report (node, path, severity, message, value) over triples (s, p, o). A missing value only breaks min_count; other constraints
    are tested value by value. Each shape is one aggregate over the triples of its path."""
    parts = []
    for shape in shapes:
        focus = triples.where((F.col("p") == type_predicate) & (F.col("o") == shape.target)).select(F.col("s").alias("node")).distinct()
        ends = ("o", "s") if shape.inverse else ("s", "o")
        values = triples.where(F.col("p") == shape.path).select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("value"))
        got = focus.join(values, "node", "left").withColumn("n", F.count("value").over(Window.partitionBy("node")))
        first = F.row_number().over(Window.partitionBy("node").orderBy("value")) == 1
        got = got.withColumn("first", first)
        count_bad = F.lit(False)
        if shape.min_count is not None:
            count_bad = count_bad | (F.col("n") < shape.min_count)
        if shape.max_count is not None:
            count_bad = count_bad | (F.col("n") > shape.max_count)
        label = [F.lit(shape.path).alias("path"), F.lit(shape.severity).alias("severity"), F.lit(shape.message).alias("message")]
        parts.append(got.where(F.col("first") & count_bad).select("node", *label, F.lit(None).cast("string").alias("value")))
        parts.append(got.where(F.col("value").isNotNull() & shape.bad_value(F.col("value"))).select("node", *label, "value"))
    return reduce(DataFrame.union, parts)


def rule_closure(triples: DataFrame, transitive: list[str], max_rounds: int = 64) -> DataFrame:
    """triples plus what follows from transitive predicates, subClassOf on types, domain and range. Absent values are not invented."""
    from loomgraph.operators.traverse import closure

    out = triples.select("s", "p", "o")
    for p in [*transitive, "subClassOf"]:
        more = closure(triples.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b")), max_rounds)
        out = out.union(more.select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o")))
    sub = out.where("p = 'subClassOf'").select(F.col("s").alias("c"), F.col("o").alias("sup"))
    rules = {k: triples.where(F.col("p") == k).select(F.col("s").alias("p"), F.col("o").alias("cls")) for k in ("domain", "range")}
    by_domain = out.join(rules["domain"], "p").select("s", F.lit("a").alias("p"), F.col("cls").alias("o"))
    by_range = out.join(rules["range"], "p").select(F.col("o").alias("s"), F.lit("a").alias("p"), F.col("cls").alias("o"))
    typed = out.where("p = 'a'").union(by_domain).union(by_range)
    up = typed.join(sub, F.col("o") == F.col("c")).select("s", "p", F.col("sup").alias("o"))
    return out.union(by_domain).union(by_range).union(up).distinct()


def foreign_key_violations(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with `failed`: names of the checks each row fails (null counts as failed)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return rows.withColumn("failed", failed)


def all_or_nothing(rows: DataFrame, batch: str, valid: Column) -> DataFrame:
    """Rows of batches all of whose rows are valid."""
    ok = rows.groupBy(batch).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("__ok")).where("__ok").select(batch)
    return rows.join(ok, batch, "left_semi")


def supernodes(degree: DataFrame, factor: float = 5.0) -> DataFrame:
    """(node, deg) above factor times the mean degree of nodes that have edges."""
    mean = degree.agg(F.avg("deg").alias("m")).select("m").scalar()
    return degree.where(F.col("deg") > factor * mean)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return nodes.join(ends, "node", "left_anti")


def duplicate_names(nodes: DataFrame, label: str, name: Column, node: str = "node") -> DataFrame:
    """Groups of nodes of equal label and normalised name: label, name, nodes (least first), n."""
    g = nodes.groupBy(F.col(label).alias("label"), name.alias("name")).agg(F.count("*").alias("n"), F.min(node).alias("first"))
    return g.where("n > 1")


def multi_parent(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("parents")).where("parents > 1")


def nodes_in_cycles(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Nodes that reach themselves over (src, dst): those left when nodes without a successor or without a predecessor among the
    rest are peeled off, and that lie on a closed walk within their remaining component."""
    from loomgraph.storage import materialize

    e = materialize(edges.select("src", "dst").distinct(), "cycle")
    for _ in range(max_rounds):
        live = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        live = materialize(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "cycle")
        if live.count() == e.count():
            break
        e = live
    from loomgraph.operators.traverse import closure

    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    reach = closure(pairs, max_rounds)
    back = reach.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).select(F.col("a").alias("node"))
    return loops.union(back).distinct()


def regression_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """change ('gone' or 'new') and the row, of two answers to the same question."""
    return before.exceptAll(after).withColumn("change", F.lit("gone")).union(after.exceptAll(before).withColumn("change", F.lit("new")))


def reuse_decision(fit: Column, threshold: float = 0.7, partial: float = 0.4) -> Column:
    return F.when(fit >= threshold, "reuse").when(fit >= partial, "wrap").otherwise("build")


def layer_rules(calls: DataFrame, layers: DataFrame, sole_writer: str, store: str) -> DataFrame:
    """calls (src, dst) against layers (name, rank): 'upward' calls, calls that 'skip' a layer, writes to `store` by others than `sole_writer`."""
    j = calls.join(layers.select(F.col("name").alias("src"), F.col("rank").alias("ra")), "src").join(layers.select(F.col("name").alias("dst"), F.col("rank").alias("rb")), "dst")
    broken = F.when(F.col("rb") < F.col("ra"), "upward").when(F.col("rb") - F.col("ra") > 1, "skip").when((F.col("dst") == store) & (F.col("src") != sole_writer), "writer")
    return j.select("src", "dst", broken.alias("rule")).where("rule is not null")
