import math
import zlib
from collections import Counter

import numpy as np
from loomgraph.llm import exact_topk, mixing, sharding
from pyspark.sql import functions as F


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "SLICE", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]
    rows += [(i, [x + 1 for x in rows[i][1]]) for i in (0, 7, 100)]
    bad = [(400, None), (500, [1.0, None]), (600, [float("nan")] * 64), (700, [float("inf")] * 64), (800, []), (None, rows[0][1]), (900, [1.0, 2.0]), (901, [3.0, 1.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows + bad], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in exact_topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    m = {}
    for i, v in rows + [(900, [1.0, 2.0]), (901, [3.0, 1.0])]:
        w = np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64)
        m[i] = min(m.get(i, w), w, key=list)
    want = {}
    for q in [i for i in m if i % 100 == 0]:
        s = sorted((-int(m[q] @ v), i) for i, v in m.items() if i != q and len(v) == len(m[q]))[:10]
        want[q] = [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_large_components(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.5])], "vec_id long, embedding array<float>")
    got = exact_topk.exact_top_k(df, F.col("vec_id") == 0, k=10).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]
    empty = df.where("vec_id > 9")
    assert exact_topk.exact_top_k(empty, F.col("vec_id") == 0).collect() == []


def test_shards(docs, no_docs, rows):
    out = sharding.shuffle_into_shards(docs, shards=7, seed=3, bucket_bytes=20_000)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
        text = (r.text or "").encode()
        assert r.shard_size == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1 and len(sizes) == 7
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    again = sharding.shuffle_into_shards(docs.repartition(3), shards=7, seed=3, bucket_bytes=20_000).collect()
    key = lambda rs: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.shard, r.slot) for r in rs)
    assert key(got) == key(again)
    assert sharding.shuffle_into_shards(no_docs, shards=7).collect() == []


def test_fisher_yates_against_plain_python(spark):
    """Each bucket's order by the swaps themselves, all buckets end to end."""
    rows = [(i, f"text {i} " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.shard, r.slot, r.doc_id) for r in sharding.shuffle_into_shards(df, shards=3, seed=9, bucket_bytes=3_000).collect())
    total = sum(len(t) + 32 for _, t in rows)
    n = -(-total // 3_000)
    dealt = {r.doc_id: r.b for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(9), "doc_id", F.lit(0).cast("long"), F.lit(0).cast("long")), F.lit(n)).alias("b")).collect()}
    order = []
    for b in range(n):
        mine = sorted(i for i in dealt if dealt[i] == b)
        u = np.random.Generator(np.random.PCG64([9, b])).random(len(mine))
        for i in range(len(mine)):
            j = i + int(u[i] * (len(mine) - i))
            mine[i], mine[j] = mine[j], mine[i]
        order += mine
    assert [i for *_, i in got] == order


def test_one_number_for_all_rows(spark):
    """A doc_id (or none) that all rows share is dealt over buckets; every row is kept."""
    for one in (7, None):
        rows = [(one, "same text", 1)] * 300 + [(one, f"own {i}", i) for i in range(100)] + [(i, "x", 0) for i in range(20)]
        df = spark.createDataFrame(rows, "doc_id long, text string, shard_salt int").repartition(4)
        got = sharding.shuffle_into_shards(df, shards=5, seed=1, bucket_bytes=2_000).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in sizes.items())


def words(text):
    return len((text or "").encode().split())


def level(sizes):
    """Targets by the iteration itself: share by weight, cap, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, fixed, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weight[s] / w for s in open_}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            open_.discard(s)
    return fixed


def test_mix(docs, no_docs, rows):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    want = level(sizes)
    got = mixing.mix(docs, seed=4).collect()
    assert len(got) == len(rows)
    by = {}
    source_of = {(i, words(t)): s for i, t, _, s in rows}
    for r in got:
        s = source_of[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s] if sizes[s] else 0.0, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[s] = by.get(s, 0) + r.taken
    longest = {s: max(words(t) for _, t, _, x in rows if x == s) for s in sizes}
    assert all(abs(by[s] - (want[s] if sizes[s] else 0)) <= longest[s] + 1 for s in sizes)
    key = lambda rs: sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(2), seed=4).collect())
    mixed = mixing.mix_documents(docs, seed=4)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    assert sum(words(r.text) for r in out) == sum(r.taken for r in got)
    taken = sum((Counter({(r.doc_id, r.size): r.taken}) for r in got), Counter())
    assert taken == sum((Counter({(r.doc_id, words(r.text)): words(r.text)}) for r in out), Counter())
    again = mixing.mix_documents(docs.repartition(3), seed=4).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(no_docs).collect() == [] and mixing.mix_documents(no_docs).collect() == []


def test_mix_of_repeated_rows_and_clashing_columns(spark):
    """Rows without a number, repeated rows and rows equal but for another column; what is written is what is accounted for."""
    rows = [(None, "a b c", "s", i % 2, 7) for i in range(40)] + [(5, "a b c d", "s", 1, 1)] * 30 + [(i, "x " * (i % 9), "t", 0, 0) for i in range(50)] + [(None, None, None, 0, 0)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_row int, copies int").repartition(6)
    got, out = mixing.mix(df, seed=2).collect(), mixing.mix_documents(df, seed=2).collect()
    taken = sum((Counter({(r.doc_id, r.size): r.taken}) for r in got), Counter())
    assert len(got) == len(rows) and taken == sum((Counter({(r.doc_id, words(r.text)): words(r.text)}) for r in out), Counter())
    for source, longest in (("s", 4), ("t", 8)):
        mine = [r for r in out if r.source == source]
        target = next(r.target for r in got if r.source_size == sum(words(x[1]) for x in rows if x[2] == source))
        assert abs(sum(words(r.text) for r in mine) - target) <= longest
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_documents(df.repartition(2), seed=2).collect()))


def test_targets_match_the_iteration(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, n))} | {None: 3}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = level(sizes)
        for r in mixing.targets(df).collect():
            assert math.isclose(r.target, want[r.source], abs_tol=1e-6)
