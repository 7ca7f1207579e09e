"""Text retrieval: TF-IDF over character bigrams, rank fusion, extraction quality, grounding, re-extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import char_ngrams


def predicate_overlap(df: DataFrame, id_col: str, keys: Column, words: list[str]) -> DataFrame:
    """score: pairs (query word, key) of which either contains the other."""
    pairs = df.select(id_col, F.explode(keys).alias("k"))
    any_hit = None
    for w in words:
        hit = F.contains(F.col("k"), F.lit(w)) | F.contains(F.lit(w), F.col("k"))
        any_hit = hit if any_hit is None else any_hit | hit
    return pairs.select(id_col, any_hit.alias("any")).groupBy(id_col).agg(F.sum(F.when(F.col("any"), 1).otherwise(0)).alias("score"))


def term_weights(docs: DataFrame, id_col: str, text_col: str, n: int = 2, by_count: bool = False) -> tuple[DataFrame, DataFrame]:
    """(weights: id, gram, w) L2-normalised tf-idf rows, and (idf: gram, idf) with idf = ln((docs + 1) / (df + 1)) + 1.

    df counts documents, or with by_count all occurrences.
    """
    tf = docs.select(id_col, F.explode(char_ngrams(F.col(text_col), n)).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count("*").alias("n")).select("n").scalar()
    df = tf.groupBy("gram").agg((F.sum("tf") if by_count else F.count("*")).alias("df"))
    idf = df.select("gram", (F.ln((total + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = tf.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "gram", (F.col("w") / norm).alias("w")), idf


def tfidf_search(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_text: str, k: int, by_count: bool = False) -> DataFrame:
    """Top k documents of each query by cosine of tf-idf vectors, ties to the larger id: query_id, id, score, rank."""
    weights, idf = term_weights(docs, id_col, text_col, by_count=by_count)
    q = queries.select(query_id, F.explode(char_ngrams(F.col(query_text))).alias("gram")).groupBy(query_id, "gram").agg(F.count("*").alias("tf")).join(idf, "gram")
    q = q.withColumn("qw", F.col("tf") * F.col("idf"))
    q = q.select(query_id, "gram", (F.col("qw") / F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy(query_id)))).alias("qw"))
    score = q.join(weights, "gram").groupBy(query_id, id_col).agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.desc(id_col)))
    return score.withColumn("rank", rank).where(F.col("rank") <= k)


def reciprocal_rank_fusion(ranked: DataFrame, id_col: str, k: int = 60) -> DataFrame:
    """ranked: (list_no, rank, id). Sum of 1 / (k + rank), ties to the first appearance (list, then rank)."""
    s = ranked.groupBy(id_col).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first"))).select(id_col, "score", "place")


def precision_recall(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two sets of rows."""
    f, g = found.select(*keys).distinct().withColumn("f", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    c = f.join(g, keys, "full").agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def grounding(text: Column, quote: Column, obj: Column, hedges: list[str], before: int = 20, after: int = 40) -> Column:
    """'no evidence', 'not in quote', 'hedged' or 'ok', in this order of checks. Blanks are ignored; the object counts by its first two
    characters without digits and hyphens; hedges are looked for around the quote."""
    t, q = F.regexp_replace(text, r"\s+", ""), F.regexp_replace(quote, r"\s+", "")
    bare = F.regexp_replace(obj, "[0-9-]", "")
    core = F.substring(F.when(F.length(bare) > 0, bare).otherwise(obj), 1, 2)
    at = F.position(quote, text)
    begin = F.greatest(at - before, F.lit(1))
    window = F.substr(text, begin, F.length(quote) + after + F.least(at - 1, F.lit(before)))
    return (
        F.when(~F.contains(t, q), "no evidence").when(~F.contains(quote, core), "not in quote").when((at > 0) & window.rlike("|".join(hedges)), "hedged").otherwise("ok")
    )


def careful_merge(old: DataFrame, new: DataFrame, manual: DataFrame, doc) -> tuple[DataFrame, DataFrame]:
    """Re-extraction of one document: facts (doc, s, p, o) of `doc` are replaced by the new ones, but what people set by hand (s, p)
    stays, and new facts that differ from a manual one are returned as conflicts. (merged, conflicts)"""
    mine = old.join(manual.select("s", "p"), ["s", "p"], "left_semi").select("doc", "s", "p", "o")
    kept = old.where(F.col("doc") != doc).select("doc", "s", "p", "o")
    fresh = new.join(manual.select("s", "p"), ["s", "p"], "left_anti").select("doc", "s", "p", "o")
    conflicts = new.join(manual.select("s", "p", F.col("o").alias("manual_o")), ["s", "p"]).where("o <> manual_o")
    return kept.union(mine).union(fresh).distinct(), conflicts.select("s", "p", "o", "manual_o")


def naive_replace(old: DataFrame, new: DataFrame, doc) -> DataFrame:
    return old.where(F.col("doc") != doc).select("doc", "s", "p", "o").union(new.select("doc", "s", "p", "o"))
