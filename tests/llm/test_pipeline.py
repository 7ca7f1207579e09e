import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute
from test_tokens import ids
from test_topk_shard_mix import level, words

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def test_stages(spark, docs):
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "near-dedup", "PII", "mixing", "packing"]
    table = docs.select(*COLUMNS)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, table, "unused")
        assert out.columns == table.columns, name
        table = out.cache()
    assert table.where("text is null").count() == 0
    packed = pipeline.STAGES[-1][1](spark, table, "unused")
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.agg(F.max("n")).first()[0] <= 4096


def drawn(key):
    return int(hashlib.sha256(key.encode()).hexdigest()[:12], 16) / 16**12


def test_run_against_plain_python(spark, rows, tmp_path):
    """Every stage in plain Python on texts without personal data: which documents stay, how often each is taken, and all token pieces."""
    once = list({r[0]: r for r in rows if r[0] is not None}.values())
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in once], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    lettered = [r for r in once if any(c.isalpha() for c in r[1] or "")]
    comp = brute(lettered, 80)
    kept = [r for r in lettered if comp[r[0]][1] == r[0]]
    sizes: dict = {}
    for _, text, _, source in kept:
        sizes[source] = sizes.get(source, 0) + words(text)
    target, want = level(sizes), Counter()
    for source in sizes:
        mine = sorted((r for r in kept if r[3] == source), key=lambda r: (words(r[1]), hashlib.sha256(f"1|{r[0]}".encode()).hexdigest()[:16]))
        rate, draw = target[source] / sizes[source], drawn("1|null" if source is None else f"1|={source}")
        for k, (i, text, *_) in enumerate(mine, 1):
            times = math.floor(k * rate + draw) - math.floor((k - 1) * rate + draw)
            whole = [*ids(text), 1]
            for piece, at in enumerate(range(0, len(whole), 4096)):
                part = np.array(whole[at : at + 4096], "<u4")
                want[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += times
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    for rs in {r.sequence_id: [x for x in got if x.sequence_id == r.sequence_id] for r in got}.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_empty_table(spark, no_docs, tmp_path):
    no_docs.select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark, docs):
    """Columns named as the stages name their own pass through unchanged."""
    names = ["pii_kinds", "pii_matches", "mix_row", "node", "root", "set1", "rank", "copies", "h"]
    table = docs.select(*COLUMNS, *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in pipeline.STAGES[:-1]:
        table = stage(spark, table, "unused").cache()
        assert table.columns == [*COLUMNS, *names], name
        assert all(r[n] == f"own {n}" for r in table.select(*names).distinct().collect() for n in names), name


def test_python_gets_bounded_batches(spark):
    from loomgraph.storage import materialize

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    long_ = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('x', 5000) as text")
    assert max(r.n for r in materialize(long_.mapInArrow(sizes, "n long")).collect()) < 8_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_small_graphs_take_few_tasks(spark):
    from loomgraph.operators.components import connected_components

    edges = spark.range(0, 300, 1, 30).selectExpr("id as a", "id - id % 10 as b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = connected_components(edges)
        assert {(r.node, r.component) for r in found.collect()} == {(i, i - i % 10) for i in range(300)}
        assert len(found.inputFiles()) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
