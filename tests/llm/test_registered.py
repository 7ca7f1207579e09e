"""Every registered query on small tables of all odd kinds: the contract's columns, a row for each, and the figures that texts give."""

import random
import zlib

import pytest
from loomgraph.llm import license_scan
from loomgraph.llm.queries import QUERIES

COLUMNS = {
    "op1_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_pii": ["doc_id", "text", "n_replaced", "kinds"],
    "op4_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op5_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "packing_under_capacities": ["doc_id", "piece", "length", "sequence_id", "offset", "sequence_tokens", "sequence_pieces", "sequence_cost"],
    "op6_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_token_counts": ["doc_id", "file", "ordinal", "n_tokens"],
    "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op10_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
}


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(230)] + [(900, None), (1000, [1.0, None])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_all_are_here():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, tables, rows, name):
    out = QUERIES[name](spark, tables)
    assert out.columns == COLUMNS[name]
    got = out.collect()
    if name == "op1_exact_topk":
        assert len(got) == 30 and {r.query_id for r in got} == {0, 100, 200}
        return
    pieces = name in ("op5_best_fit_packing", "packing_under_capacities")
    assert len(got) == len(rows) if not pieces else len(got) >= len(rows)
    assert {r.doc_id for r in got} == {i for i, *_ in rows}
    if name == "packing_under_capacities":
        assert all(r.sequence_tokens <= 4096 and r.sequence_pieces <= 12 and r.sequence_cost <= 3.5 * 1024**2 and r.length <= 1024 for r in got)
        assert max(r.sequence_pieces for r in got) == 12 and max(r.sequence_cost for r in got) > 3 * 1024**2
    if name == "op8_sharding":
        sizes = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
        assert sorted((r["size"], r.text_crc32) for r in got) == sizes and {r.law for r in got} == {"rows"} and {r.shard for r in got} == set(range(40))


def test_a_long_text(spark, monkeypatch):
    """One text of 12 MB beside short ones, through the operators that read whole texts."""
    from loomgraph.llm import language_id, mixing, near_dedup

    rng = random.Random(2)
    words = ["the", "and", "license", "word", "über", "an"] + [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(2_000_000))
    rows = [(1, long, "en", "s"), (2, "a short text of some words", "en", "s"), (3, long + " and", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 85).collect()}
    assert near[3][1] == near[1][1] == 1 and near[2][1] == 2 and near[1][0] > 1_900_000
    assert {r.lang_pred for r in language_id.identify(df, df).collect()} == {"en"}
    assert {r.doc_id: r["size"] for r in mixing.mix(df).collect()} == {1: 2_000_000, 2: 6, 3: 2_000_001}
    n = {r.doc_id: r.n_words for r in df.select("doc_id", license_scan.count_words(df.text).alias("n_words")).collect()}
    assert n == {1: 2_000_000, 2: 6, 3: 2_000_001}


def test_word_counts_both_ways(spark, rows, monkeypatch):
    texts = [t or "" for _, t, *_ in rows] + [" a", "a ", "--", "-a-b-", "é--ü", "© 2020"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.n for r in df.select("doc_id", license_scan.count_words(df.text).alias("n")).collect()}
    monkeypatch.setattr(license_scan, "LONG", 0)
    assert plain == {r.doc_id: r.n for r in df.select("doc_id", license_scan.count_words(df.text).alias("n")).collect()}
