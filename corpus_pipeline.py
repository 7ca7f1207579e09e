"""The corpus pipeline: from raw documents to packed training sequences, each stage written and reread as the next one's input.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import language_id, mixing, near_dedup, packing, pii
from loomgraph.llm.common import free_names
from loomgraph.llm.queries import PII_KEY
from loomgraph.storage import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (null texts, texts without a letter)."""
    return language_id.keep_identified(docs, docs.where(~language_id.held_out(F.col("doc_id"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def pseudonymize_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to format-preserving pseudonyms; n_chars follows."""
    (kinds,) = free_names(docs.columns, "pii_kinds")
    out = pii.pseudonymize(docs, key=PII_KEY, found_col=kinds).drop(kinds)
    changed = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return out.withColumn("n_chars", changed).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks for."""
    return mixing.mix_documents(docs, seed=1)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return packing.best_fit_pack(docs, tokens=4096)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_copies),
    ("PII", pseudonymize_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID and sketches cannot be written in SQL; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
