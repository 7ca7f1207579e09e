import itertools
import random

import numpy as np
import pyarrow as pa
from loomgraph.llm import near_dedup as N


def brute(rows, percent):
    sets = {}
    for i, text, *_ in rows:
        if i is None:
            continue
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_against_all_pairs(docs, rows):
    for percent in (80, 85):
        want = brute(rows, percent)
        got = N.near_duplicates(docs, percent).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Chunks, hubs and cut buckets: a family larger than a chunk whose members are not all linked with one hub."""
    monkeypatch.setattr(N, "CHUNK", 16)
    monkeypatch.setattr(N, "BUCKET", 24)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, 85).collect()} == want


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    limit = N.sketch_limit(0.85)
    missed = 0
    for _ in range(200):
        common = rng.integers(0, 2**63, 500, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 40, dtype=np.uint64)])) for _ in range(2))
        bits = N.odd_sketches(np.stack([N.min_samples(a), N.min_samples(b)]))
        missed += int(np.bitwise_count(bits[0] ^ bits[1]).sum()) > limit
    assert missed == 0
    far = N.odd_sketches(np.stack([N.min_samples(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2)]))
    assert int(np.bitwise_count(far[0] ^ far[1]).sum()) > limit


def test_drop_keeps_one_of_each(docs, no_docs, rows):
    left = N.drop_near_duplicates(docs, 80)
    assert left.columns == docs.columns
    want = {c for _, c in brute(rows, 80).values()}
    got = [r.doc_id for r in left.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert N.near_duplicates(no_docs).collect() == [] and N.drop_near_duplicates(no_docs).collect() == []


def test_repeated_ids_with_unlike_texts(spark):
    """Rows under one number are one node; dropping judges each row by its own text."""
    a, b, c = ("one two three four five six seven eight", "other words stand here in another order now", "a third text of its own that is like none")
    rows = [(5, a), (5, b), (3, a), (7, b), (9, c), (9, c), (9, None), (11, ""), (11, b)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, n_shingles int, root string").repartition(4)
    got = {(r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df, 85).collect()}
    assert got == {(5, 3, False), (3, 3, True), (7, 3, False), (11, 3, False), (9, 9, True)}
    left = sorted((r.doc_id, r.text or "") for r in N.drop_near_duplicates(df, 85).collect())
    assert left == sorted([(3, a), (5, b), (9, c), (9, ""), (11, "")])
    assert N.drop_near_duplicates(df, 85).columns == df.columns


def test_family_of_parts(spark, monkeypatch):
    """Unjoined parts of a large family: the prefix filter finds the links between them."""
    monkeypatch.setattr(N, "CHUNK", 8)
    monkeypatch.setattr(N, "BUCKET", 16)
    monkeypatch.setattr(N, "CHUNK_SHINGLES", 3000)
    rng = random.Random(11)
    for words, percent in ((40, 80), (90, 85), (200, 90)):
        rows = []
        bases = [[f"w{rng.randrange(10**6)}" for _ in range(words)] for _ in range(3)]
        for i in range(120):
            w = list(rng.choice(bases))
            if rng.random() < 0.3:
                w = w[: words // 2] + bases[0][words // 2 :]
            for _ in range(rng.choice([0, 0, 1, 2, 3, words // 25])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
            if rng.random() < 0.2:
                w += bases[1][: rng.randint(1, words // 8)]
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, percent).collect()} == brute(rows, percent)


def test_long_words_hash_alike_in_blocks(monkeypatch):
    from loomgraph.llm import common

    rng = np.random.default_rng(5)
    raw = rng.integers(97, 123, 5000, dtype=np.uint8)
    starts = np.array([0, 10, 40, 900, 3000, 4990])
    ends = np.array([9, 40, 41, 3000, 4980, 5000])
    whole = common.span_hashes(raw, starts, ends)
    monkeypatch.setattr(common, "HASH_BLOCK", 64)
    assert (common.span_hashes(raw, starts, ends) == whole).all()


def test_what_a_worker_keeps_is_bounded():
    from loomgraph.llm import common

    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, 7, dtype=np.uint8)) for _ in range(4000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, len(words), 60_000)).decode() for _ in range(10)]
    run = N._sketch_rows(85)
    out = pa.Table.from_batches(run(iter([pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["doc_id", "text"])])))
    assert out.num_rows == 10 and out.column("n_shingles").to_pylist() == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in map(str.split, texts)]
    assert common._POW.nbytes + common._POW_INV.nbytes <= 4_000_000


def test_numbers_of_few_classes_take_few_tasks(spark, monkeypatch):
    from loomgraph import storage

    written, rng = {}, random.Random(4)
    real = storage.materialize

    def counted(df, tag="step", *a, **k):
        out = real(df, tag, *a, **k)
        written.setdefault(tag, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(N, "materialize", counted)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(40))) for i in range(60)]
    rows += [(100 + i, t + " z") for i, t in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), 85).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 85)
    assert {max(written[tag]) for tag in ("near", "sizes", "wanted", "named", "roots")} == {1}
