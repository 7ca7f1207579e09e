"""Projection, join, aggregation, window, top-k and set operators as DataFrame -> DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.traverse import edge_rows, step_from
from loomgraph.storage import kept, materialize


# -- projection and filter -------------------------------------------------------------------------------------------
def match_triples(triples: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """Triples with the bound parts; unbound parts match anything. Filters reach the scan."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == F.lit(value))
    return triples


def closed_world(asked: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """answer true or false: what is not recorded is false."""
    return asked.join(facts.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left").withColumn("answer", F.col("__hit").isNotNull()).drop("__hit")


def open_world(asked: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """answer 'known' or 'unknown', never false: what is not recorded may still hold."""
    return closed_world(asked, facts, key).withColumn("answer", F.when(F.col("answer"), "known").otherwise("unknown"))


def contains_all_words(text: Column, query: str) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in query.split()], F.lit(True))


def contains_any_word(text: Column, query: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in query.split()], F.lit(False))


def allowed(command: Column, patterns: list[str]) -> Column:
    """Allow list: the whole trimmed command matches a pattern."""
    return F.trim(command).rlike("|".join(f"^(?:{p})$" for p in patterns))


def denied(command: Column, patterns: list[str]) -> Column:
    """Deny list: a pattern occurs anywhere."""
    return command.rlike("|".join(patterns))


def marked_lines(docs: DataFrame, id_col: str, text_col: str, markers: list[str]) -> DataFrame:
    """Lines (numbered from 0) that hold any marker, in any case."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return lines.where(F.lower("line").rlike("|".join(markers)))


# -- joins -----------------------------------------------------------------------------------------------------------
def walk_endpoints(edges: DataFrame, start: Column, hops: int) -> DataFrame:
    """End nodes of walks of exactly `hops` steps from each start (revisits count, as in a chain of self-joins), distinct."""
    edges = kept(edges.select("src", "dst"), "graph")
    # A step's ends are written: their number is known then, and few of them don't move the edges.
    out = materialize(edge_rows(edges.where(start)).select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct(), "walks")
    for _ in range(hops - 1):
        out = materialize(step_from(out, edges).select("start", F.col("dst").alias("node")).distinct(), "walks")
    return out


def valid_at(df: DataFrame, at: Column, begin: str = "valid_from", end: str = "valid_to", closed: bool = False) -> DataFrame:
    """Rows whose interval holds `at`: half-open [begin, end), or closed [begin, end]."""
    upper = (at <= F.col(end)) if closed else (at < F.col(end))
    return df.where((F.col(begin) <= at) & upper)


def point_in_interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, begin: str, end: str) -> DataFrame:
    """Points with the intervals of the same key that hold them, [begin, end). Keyed: an equi-join with a residual, never a cross join."""
    return points.join(intervals, key).where((F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end)))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before it: union, sort, last value. One shuffle by key, linear."""
    l = left.withColumn("__at", F.col(left_at)).withColumn("__side", F.lit(1))
    r = right.select(key, F.col(right_at).alias("__at"), F.struct(*values).alias("__v")).withColumn("__side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(*left.columns, *[F.col("__last")[v].alias(v) for v in values])


def labelled_lookup(df: DataFrame, policy: DataFrame, key: str, value: str, unknown: str = "unknown") -> DataFrame:
    """Left join into a small policy table; rows without a policy are flagged, not dropped."""
    return df.join(policy, key, "left").withColumn(value, F.coalesce(value, F.lit(unknown)))


def block_pairs(df: DataFrame, key: Column, id_col: str = "id") -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows that share a block key; null keys make no block."""
    return met_in_blocks(df, [key], id_col).select("a", "b")


#: Rows of a block that meet as many others in one cell, and pairs that one task makes.
CELL, CELL_PAIRS = 2_048, 8_000_000


def met_in_blocks(records: DataFrame, keys: list[Column], id_col: str = "id", fields: list[str] | None = None) -> DataFrame:
    """(a, b, x, y): distinct pairs a < b of records that share any key, with their fields as structs; null keys make no block.

    The pairs are the square of a block, so they are made once and never compared or moved: a block is cut into runs of CELL ids, every
    two runs are a cell of their own, and tasks are as many as the pairs need. A pair that shares several keys is left to the first.
    Only ids that stand in several rows are made distinct afterwards; their pairs come for each two rows, as a join on the id would give.
    """
    named = {f"k{i}": k for i, k in enumerate(keys)}
    rows = records.select(F.col(id_col).alias("id"), *[k.alias(n) for n, k in named.items()], F.struct(F.lit(1).alias("__"), *(fields or [])).alias("f")).where("id is not null")
    rows = materialize(rows.withColumn("many", F.count("*").over(Window.partitionBy("id")) > 1), "records")
    once = rows.where("not many")
    found = []
    for i, k in enumerate(named):
        block = Window.partitionBy(k)
        runs = once.where(F.col(k).isNotNull()).withColumn("run", F.floor((F.row_number().over(block.orderBy("id")) - 1) / CELL))
        runs = materialize(runs.withColumn("last", F.max("run").over(block)), "runs")
        met = runs.groupBy(k).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / 2).first()[0] or 0.0
        tasks = int(met // CELL_PAIRS) + 1
        left = runs.withColumn("other", F.explode(F.sequence("run", "last"))).select(*[F.col(n).alias(f"a_{n}") for n in named], F.col("id").alias("a"), F.col("f").alias("x"), F.col("run").alias("p"), F.col("other").alias("q"))
        right = runs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("run")))).select(*[F.col(n).alias(f"b_{n}") for n in named], F.col("id").alias("b"), F.col("f").alias("y"), F.col("other").alias("p2"), F.col("run").alias("q2"))
        cell = (F.col(f"a_{k}") == F.col(f"b_{k}")) & (F.col("p") == F.col("p2")) & (F.col("q") == F.col("q2"))
        pairs = left.repartition(tasks, f"a_{k}", "p", "q").join(right.repartition(tasks, f"b_{k}", "p2", "q2"), cell).where("a < b")
        for before in list(named)[:i]:
            pairs = pairs.where(~F.coalesce(F.col(f"a_{before}") == F.col(f"b_{before}"), F.lit(False)))
        found.append(pairs.select("a", "b", "x", "y"))
    again = rows.where("many")
    if not again.isEmpty():
        each = [again.select(k, F.col("id").alias("i")).join(rows.select(k, F.col("id").alias("j")), k).where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")) for k in named]
        pairs = reduce(DataFrame.union, each).distinct()
        if fields is None:
            found.append(pairs.select("a", "b", F.struct(F.lit(1).alias("__")).alias("x"), F.struct(F.lit(1).alias("__")).alias("y")))
        else:
            found.append(pairs.join(rows.select(F.col("id").alias("a"), F.col("f").alias("x")), "a").join(rows.select(F.col("id").alias("b"), F.col("f").alias("y")), "b").select("a", "b", "x", "y"))
    return reduce(DataFrame.union, found)


# -- aggregates and windows ------------------------------------------------------------------------------------------
def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """The most frequent values with their count; all, if tied."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") == counts.agg(F.max("n").alias("m")).select("m").scalar())


def k_anonymity(df: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest group, groups of one, groups: one row."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("k"), F.count_if(F.col("n") == 1).alias("singletons"), F.count("*").alias("groups"))


def share_of_total(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """col over its sum. The sum is a scalar subquery, so rows stay where they are (an empty window would gather them in one task)."""
    return df.withColumn(name, F.col(col) / df.agg(F.sum(col).alias("__sum")).select("__sum").scalar())


def running_totals(df: DataFrame, keys: list[str], order: list[str], col: str) -> DataFrame:
    """`running` (sum so far) and `cumulative` (sum of the running sums: cost of resending all that came before)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(col).over(w)).withColumn("cumulative", F.sum("running").over(w))


def stalled(df: DataFrame, keys: list[str], order: list[str], score: str, patience: int) -> DataFrame:
    """`stalled`: the score is no better (not lower) than the best of the `patience` before it; false while there are fewer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    past = F.min(score).over(w.rowsBetween(-patience, -1))
    return df.withColumn("stalled", F.coalesce((F.row_number().over(w) > patience) & (F.col(score) >= past), F.lit(False)))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], tie: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order, *tie)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prefix_budget(df: DataFrame, keys: list[str], order: list[str], want: str, total: Column) -> DataFrame:
    """`granted`: each row gets what it wants while the budget lasts, in order. Closed form of the sequential loop."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(want).over(w), F.lit(0))
    return df.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(want), total - used)))


def even_budget(df: DataFrame, keys: list[str], want: str, total: Column) -> DataFrame:
    """`granted`: every row the same whole share of the total, no more than it wants; what others leave is not dealt again."""
    share = F.floor(total / F.count("*").over(Window.partitionBy(*keys)))
    return df.withColumn("granted", F.least(F.col(want), share))


def reserve_first(df: DataFrame, keys: list[str], order: list[str], need: str, extra: str, total: Column) -> DataFrame:
    """Every row's need is set aside first; extras are granted in order from what is left."""
    every = Window.partitionBy(*keys)
    left = total - F.sum(need).over(every)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("granted", F.col(need) + F.greatest(F.lit(0), F.least(F.col(extra), left - F.coalesce(F.sum(extra).over(before), F.lit(0)))))


def tail(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def presence_audit(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """Declared (label, key) against the keys present in rows (label, keys): rows of each label, undeclared key uses, missing key uses."""
    size = rows.groupBy("label").agg(F.count("*").alias("rows"))
    seen = rows.select("label", F.explode("keys").alias("key")).groupBy("label", "key").agg(F.count("*").alias("uses"))
    both = seen.join(declared.withColumn("declared", F.lit(True)), ["label", "key"], "full").join(size, "label")
    undeclared = F.when(F.col("declared").isNull(), F.col("uses"))
    return both.select("label", "key", "rows", F.coalesce(undeclared, F.lit(0)).alias("undeclared"), F.when(F.col("declared"), F.col("rows") - F.coalesce("uses", F.lit(0))).otherwise(0).alias("missing"))


# -- sets ------------------------------------------------------------------------------------------------------------
def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def contained(need: Column, granted: Column) -> Column:
    return F.size(F.array_except(need, granted)) == 0
