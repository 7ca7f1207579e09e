"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import exact_topk, language_id, license_scan, media, mixing, near_dedup, packing, pii, sharding, token_counts
from loomgraph.llm.common import read_table


#: The key of the pseudonyms in the registered query and the pipeline; a deployment passes its own secret.
PII_KEY = "loomgraph demonstration key"


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.identify(docs, docs.where(~language_id.held_out(F.col("doc_id"))))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.texts_to_media(read_table(spark, sf_dir, "documents"))
    return media.with_feature(media.media_digests(stored, side=32, tile=16))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read_table(spark, sf_dir, "documents"), tokens=4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_under_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best fit where every capacity binds: pieces of 1,024 at most, 12 to a sequence, attention cost of three and a half full pieces.

    Columns besides: the sequence's tokens, pieces and attention cost.
    """
    out = packing.best_fit_pack(read_table(spark, sf_dir, "documents"), tokens=4096, longest=1024, documents=12, attention=3.5 * 1024**2, weights=(1.0, 1.0, 1.0))
    own = Window.partitionBy("sequence_id")
    out = out.withColumn("sequence_tokens", F.sum("length").over(own)).withColumn("sequence_pieces", F.count("*").over(own)).withColumn("sequence_cost", F.sum(F.col("length") * F.col("length")).over(own))
    return out.select("doc_id", "piece", "length", "sequence_id", "offset", "sequence_tokens", "sequence_pieces", "sequence_cost")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40, seed=1)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", F.col("shard_size").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), seed=1)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("found")


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_language_id, op3_pii, op4_media_columns, op5_best_fit_packing, packing_under_capacities, op6_near_dedup, op7_token_counts, op8_sharding, op9_mixing, op10_license_scan)}

ORACLE = {
    "op1_exact_topk": """
        WITH t AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM t q JOIN t c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_near_dedup": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN sh ON sh.doc_id = d.doc_id GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen)
        SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
    """,
    "op9_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                          substr(sha256('1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS most FROM s),
        x AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place,
                     (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
              FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(most, weight * (SELECT arg_min(level, place) FROM x WHERE level * weight <= most)) ELSE 0.0 END AS target,
                     CAST(CAST('0x' || substr(sha256('1|' || coalesce('=' || source, 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS draw FROM x),
        k AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.draw, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY d.size, h) AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST((floor(rank * rate + draw) - floor((rank - 1) * rate + draw)) * size AS BIGINT) AS taken FROM k
    """,
}
