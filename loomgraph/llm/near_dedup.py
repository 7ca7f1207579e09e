"""Near-duplicate groups by MinHash: odd sketches choose, in LSH buckets, the pairs worth checking on full shingle sets.

1. One pass over the texts gives every document its set of word shingles, K MinHash samples, one 64-bit key for each band of
   samples (as many rows and bands as layout() derives from the similarity), and the odd sketch: a bitmap in which every sample flips one bit. Two sketches' XOR
   population count estimates how many samples differ, hence the similarity, most precisely where it is high.
2. Documents of equal sets (a 128-bit digest of the whole set) form one class; one row per class goes on. A class may hold
   any share of all rows: it is a partial aggregate.
3. Class rows meet in range partitions of (band key, document), so that even a hot bucket is dealt over tasks. In a bucket
   the sketches of all members are compared in numpy; only a spanning forest of the pairs that may be similar leaves the
   task, never all pairs. Very large buckets, and those cut by a partition's edge, are tied together whole instead; that
   proposes more, it drops nothing. Components of these proposals hold every link that any bucket has seen.
4. Inside each such component the full shingle sets are compared exactly: small components at once; large ones first in
   hashed chunks (bounded in documents and in shingles), each with a hub text. That joins nearly all of a family of copies. Where parts
   are left unjoined, a link between two of them needs a shingle that both texts hold among their rarest ones (the prefix filter,
   with the shingles that are common in the component last and the least size that a partner can have); texts without such a shingle are
   done, the others are grouped by these shingles and compared, small groups at once, large ones chunk by chunk wherever two chunks are not
   yet known to be connected. Each task is bounded and returns a spanning forest of its true links. No link is lost in this step.
5. Components of the true links are the answer.

The chance that a pair of similarity J shares no band is (1 - J^rows)^bands: at a threshold of 0.80 (5 rows, 28 bands) 1.5e-5 for a
pair just there and 2.3e-6 at 0.82, at one of 0.85 (6 rows, 24 bands) 1.2e-5 and 3.1e-7 at 0.88; a pair is lost only if, besides, no
chain of links joins it. No threshold from 0.08 up has more than MISS. The sketch's margin is MARGIN standard errors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from loomgraph.llm.common import LOWER, forest, free_names, groups, mix64, slices_by_bytes, span_hashes, text_buffer, word_spans
from loomgraph.operators.components import connected_components
from loomgraph.storage import materialize

SHINGLE = 5
#: MinHash samples, the most of them in a band, and the chance of sharing no band that a pair at the threshold may have.
K = 144
ROWS = 6
MISS = 1.5e-5
SKETCH_BITS = 256
MARGIN = 4.5
#: Buckets above this many classes are tied together whole rather than compared by sketch.
BUCKET = 2048
#: Bytes of texts whose shingles are made at a time (one text may exceed that alone).
SLICE_BYTES = 1_000_000
#: Texts of a chunk in the exact check, and the shingles that these hold together (one text may exceed that alone).
CHUNK = 128
CHUNK_SHINGLES = 2_000_000
#: A shingle that one in so many of a component's texts hold is common there.
COMMON = 16

_R = np.random.Generator(np.random.PCG64(77))
_A = _R.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, K, dtype=np.uint64)
_M = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _R.integers(0, 2**63, K, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The set of word shingles of each row as sorted 64-bit hashes. Words: [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    low = LOWER[raw]
    starts, ends, rows = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    n = len(words)
    every = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        every += words[k : n - size + 1 + k] * _M[k] if len(every) else every
    every = mix64(every)
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(every[lo : hi - size + 1]))
        elif hi > lo:
            part = words[lo:hi]
            out.append(mix64(np.array([(part * _M[8 : 8 + len(part)]).sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_samples(items: np.ndarray) -> np.ndarray:
    """K MinHash samples of a set, in blocks of bounded size."""
    best = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(items), 4096):
        np.minimum(best, (items[lo : lo + 4096, None] * _A + _B).min(axis=0), out=best)
    return best


def layout(percent: int) -> tuple[int, int]:
    """Rows of a band and bands: the longest bands by which a pair at the threshold is missed with a chance of MISS at most."""
    for rows in range(ROWS, 1, -1):
        if (1 - (percent / 100) ** rows) ** (K // rows) <= MISS:
            return rows, K // rows
    return 1, K


def band_keys(samples: np.ndarray, percent: int) -> np.ndarray:
    """(rows, K) samples to (rows, bands) keys; a band's number is part of its key."""
    rows, bands = layout(percent)
    cut = samples[:, : rows * bands].reshape(len(samples), bands, rows)
    key = np.zeros((len(samples), bands), np.uint64)
    for k in range(rows):
        key = mix64(key + cut[:, :, k] * _M[16 + k])
    return mix64(key + np.arange(1, bands + 1, dtype=np.uint64) * _M[40])


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(rows, K) samples to (rows, SKETCH_BITS / 8) bytes: every sample flips one bit."""
    bit = (mix64(samples + _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = (bit + np.arange(len(samples))[:, None] * SKETCH_BITS).ravel()
    return np.packbits((np.bincount(flat, minlength=len(samples) * SKETCH_BITS) & 1).reshape(-1, SKETCH_BITS).astype(np.uint8), axis=1)


def sketch_limit(similarity: float) -> int:
    """Pairs whose sketches differ in more bits than this are below `similarity`, MARGIN standard errors considered."""
    least = max(0.0, similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / K))
    flips = 2 * K * (1 - least)
    expected = SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS))
    return min(SKETCH_BITS, math.ceil(expected + 1.5 * math.sqrt(SKETCH_BITS / 4 * (1 - math.exp(-4 * flips / SKETCH_BITS)))))


def _sketch_rows(percent: int):
    bands = layout(percent)[1]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in slices_by_bytes(offsets, SLICE_BYTES):
                a, b = offsets[lo], offsets[hi]
                sets = shingle_sets(raw[a:b], offsets[lo : hi + 1] - a)
                n = np.array([len(s) for s in sets], np.int64)
                samples = np.stack([min_samples(s) for s in sets])
                once, twice = digests(sets)
                keys = band_keys(samples, percent).view(np.int64)
                bits = odd_sketches(samples)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n),
                        pa.array(once),
                        pa.array(twice),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in bits], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set1", "set2", "bands", "sketch"],
                )

    return run


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (set1, set2), band keys and odd sketch of every document."""
    return docs.select("doc_id", "text").mapInArrow(_sketch_rows(percent), "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sketch binary")


def _bucket_pairs(bits: np.ndarray, n: np.ndarray, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j in one bucket that sizes and sketches allow."""
    left, right = [], []
    words = bits.view(np.uint64)
    for i in range(0, len(n), 256):
        a, na = words[i : i + 256], n[i : i + 256]
        far = np.bitwise_count(a[:, None, :] ^ words[None, i:, :]).sum(axis=2, dtype=np.int32)
        small, large = np.minimum(na[:, None], n[None, i:]), np.maximum(na[:, None], n[None, i:])
        x, y = np.nonzero((far <= limit) & (100 * small >= percent * large))
        keep = x < y
        left.append(x[keep] + i)
        right.append(y[keep] + i)
    return np.concatenate(left), np.concatenate(right)


def _propose(percent: int):
    limit = sketch_limit(percent / 100)
    out_names = ["a", "b", "band"]

    def run(batches):
        a: list = []
        b: list = []
        edge: list = []

        def handle(table: pa.Table, cut: bool) -> None:
            ids = table.column("doc_id").to_numpy()
            if cut or len(ids) > BUCKET:
                least = int(ids.min())
                a.extend([least] * len(ids))
                b.extend(ids.tolist())
                edge.extend([None] * len(ids))
                if cut:
                    a.append(least), b.append(least), edge.append(table.column("band")[0].as_py())
                return
            if len(ids) < 2:
                return
            bits = np.frombuffer(table.column("sketch").combine_chunks().buffers()[2], np.uint8)
            first = table.column("sketch").combine_chunks()
            bits = np.frombuffer(b"".join(first.to_pylist()), np.uint8).reshape(len(ids), -1) if len(bits) != len(ids) * SKETCH_BITS // 8 else bits.reshape(len(ids), -1)
            for x, y in forest(len(ids), *_bucket_pairs(bits, table.column("n_shingles").to_numpy(), percent, limit)):
                a.append(int(ids[x])), b.append(int(ids[y])), edge.append(None)

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(edge, pa.int64())], names=out_names)
            a.clear(), b.clear(), edge.clear()
            return batch

        held, first = None, True
        for table in groups(batches, "band"):
            if held is not None:
                handle(held, first)
                first = False
            held = table
            if len(a) > 50_000:
                yield out()
        if held is not None:
            handle(held, True)
        yield out()

    return run


def proposals(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair of classes that shares a band and may be similar enough."""
    dealt = classes.select("doc_id", "n_shingles", "sketch", F.explode("bands").alias("band")).repartitionByRange("band", "doc_id").sortWithinPartitions("band", "doc_id")
    found = materialize(dealt.mapInArrow(_propose(percent), "a long, b long, band long"), "proposals")
    cut = found.where("band is not null")
    least = cut.groupBy("band").agg(F.min("a").alias("b"))
    tied = cut.select("a", "band").join(least, "band").select("a", "b")
    return found.where("band is null").select("a", "b").union(tied).where("a <> b").distinct()


def _exact_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j with 100 * intersection >= percent * union, by a product of 0/1 matrices over shared shingles."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        hit = bool(n.min()) and 100 * both >= percent * (n.sum() - both)
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.concatenate([[True], items[1:] != items[:-1]]) if len(items) else np.zeros(0, bool)
    which = np.cumsum(new) - 1
    shared = np.bincount(which) > 1 if len(which) else np.zeros(0, bool)
    keep = shared[which] if len(which) else np.zeros(0, bool)
    owner, which = owner[keep], (np.cumsum(shared) - 1)[which[keep]]
    both = np.zeros((m, m), np.int64)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(which, [lo, lo + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[owner[a:b], which[a:b] - lo] = 1
        both += (part @ part.T).astype(np.int64)
    hit = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1) & (n[:, None] > 0)
    return np.nonzero(hit)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set of shingles, in two columns."""
    once = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    twice = np.array([mix64(s * _M[50]).sum(dtype=np.uint64) for s in sets], np.uint64)
    return once.view(np.int64), twice.view(np.int64)


def _confirm(percent: int):
    def run(batches):
        for table in groups(batches, "task"):
            nodes, set1 = table.column("node").to_numpy(), table.column("set1").to_numpy()
            sets = shingle_sets(*text_buffer(table.column("text")))
            # A doc_id that repeats brings texts of other sets along; a hub may come twice.
            own = np.flatnonzero(digests(sets)[0] == set1)
            own = own[np.unique(nodes[own], return_index=True)[1]]
            nodes, sets = nodes[own], [sets[i] for i in own]
            kept = forest(len(nodes), *_exact_pairs(sets, percent))
            yield pa.RecordBatch.from_arrays([pa.array([int(nodes[x]) for x, _ in kept], pa.int64()), pa.array([int(nodes[y]) for _, y in kept], pa.int64())], names=["a", "b"])

    return run


def confirm(tasks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """True links (a spanning forest for each task) among the texts of each task; tasks: (task, node); texts: (node, set1, text)."""
    dealt = tasks.join(texts, "node").select("task", "node", "set1", "text").repartition("task").sortWithinPartitions("task")
    return materialize(dealt.mapInArrow(_confirm(percent), "a long, b long"), "links")


def _chunks(texts, shingles) -> F.Column:
    return F.greatest(F.ceil(texts / CHUNK), F.ceil(shingles / CHUNK_SHINGLES)).cast("long")


def _sets_of(batch):
    """Slices of a batch of (set1, text, ...): row range and, row by row, the shingle set, empty where a repeated doc_id brought another text."""
    set1 = batch.column(0).to_numpy()
    raw, offsets = text_buffer(batch.column(1))
    for lo, hi in slices_by_bytes(offsets, SLICE_BYTES):
        sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        right = digests(sets)[0] == set1[lo:hi]
        yield lo, hi, [s if r else s[:0] for s, r in zip(sets, right)]


def _count_shingles(batches):
    """How many of a slice's texts of each component hold each shingle: near, texts, s, n."""
    for batch in batches:
        near, texts = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for lo, hi, sets in _sets_of(batch):
            for one in np.unique(near[lo:hi]):
                own = np.flatnonzero(near[lo:hi] == one)
                s, n = np.unique(np.concatenate([sets[i] for i in own]), return_counts=True)
                cols = [np.full(len(s), one), np.full(len(s), texts[lo + own[0]]), s.view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["near", "texts", "s", "n"])


def prefix_length(n: int, least: int, percent: int) -> int:
    """How many of a text's n shingles, from the front of a common order, must hold one that a linked text of at least `least` has in front too."""
    partner = max(least, -(-n * percent // 100))
    need = -(-(n + partner) * percent // (100 + percent))
    return max(0, n - need + 1)


def _prefix_rows(percent: int):
    def run(batches):
        for batch in batches:
            near, part, node, least = (batch.column(i).to_numpy() for i in range(2, 6))
            common = batch.column(6)
            for lo, hi, sets in _sets_of(batch):
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i, s in zip(range(lo, hi), sets):
                    many = np.asarray(common[i].values if common[i].is_valid else [], np.int64).view(np.uint64)
                    order = np.argsort(many)
                    at = order[np.minimum(np.searchsorted(many, s, sorter=order), max(0, len(many) - 1))] if len(many) else np.zeros(0, np.int64)
                    held = many[at] == s if len(many) else np.zeros(len(s), bool)
                    last = many[np.sort(at[held])] if len(many) else s[:0]
                    first = np.concatenate([s[~held], last])[: prefix_length(len(s), int(least[i]), percent)]
                    for c, v in zip(out, (near[i], part[i], node[i])):
                        c.append(np.full(len(first), v))
                    out[3].append(first.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["near", "part", "node", "s"])

    return run


def cross_groups(large: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Texts of large (node, near, part, n_shingles) that may be linked with a text of another part, and the groups in which: (node, group).

    The prefix filter: of two texts with n and m shingles and 100 * intersection >= percent * union, the intersection has at least
    need = percent * (n + m) / (100 + percent) shingles. In any order of the component's shingles, the first n - need + 1 of the one and the
    first m - need + 1 of the other therefore share one; m is at least percent * n / 100 and the component's least size. Here the
    shingles that one in COMMON of the component's texts hold come last (there are at most COMMON times as many of them as a text has shingles on average),
    rarest first, the others before them by hash. Only rows of prefixes are shuffled and joined; counts are aggregated before they are.
    """
    size = materialize(large.groupBy("near").agg(F.count("*").alias("texts"), F.min("n_shingles").alias("least")), "sizes")
    open_ = materialize(large.join(size, "near").join(texts, "node").select("set1", "text", "near", "texts", "part", "node", "least"), "open")
    counts = open_.select("set1", "text", "near", "texts").mapInArrow(_count_shingles, "near long, texts long, s long, n long")
    counts = counts.groupBy("near", "texts", "s").agg(F.sum("n").alias("n")).where(F.col("n") * COMMON >= F.col("texts"))
    common = materialize(counts.groupBy("near").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("common")), "common")
    rows = open_.join(common, "near", "left").select("set1", "text", "near", "part", "node", "least", "common")
    first = materialize(rows.mapInArrow(_prefix_rows(percent), "near long, part long, node long, s long"), "prefixes")
    shared = first.groupBy("near", "s").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("node").alias("hub")).where("lo <> hi")
    edges = first.join(materialize(shared.select("near", "s", "hub"), "shared"), ["near", "s"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return connected_components(edges).select("node", F.col("component").alias("group"))


def links_of(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes whose components are those of all true links; classes: node, least (a doc_id that has it), set1, n_shingles, bands, sketch."""
    near = connected_components(proposals(classes.withColumnRenamed("node", "doc_id"), percent)).select("node", F.col("component").alias("near"))
    rows = classes.count()
    near = materialize(near.join(classes.select("node", "least", "set1", "n_shingles"), "node"), "near", rows)
    # Sizes are written first: a join straight onto an aggregate would gather a hot component's rows by its key in one task, while
    # a join of two tables can be split or broadcast at run time.
    size = materialize(near.groupBy("near").agg(_chunks(F.count("*"), F.sum("n_shingles")).alias("chunks")), "sizes", rows)
    near = materialize(near.join(size, "near"), "near", rows)
    # The texts that take part are picked by their numbers alone, a table small enough to be sent along at most sizes.
    texts = docs.select(F.col("doc_id").alias("least"), "text").join(materialize(near.select("least").distinct(), "wanted", rows), "least", "left_semi")
    texts = materialize(texts, "texts")
    texts = materialize(texts.join(near.select("least", "node", "set1"), "least").drop("least"), "texts")
    h = F.xxhash64("node")
    first = near.select("node", "near", "chunks", F.xxhash64("near", F.pmod(h, F.col("chunks"))).alias("task"))
    hubs = first.where("chunks > 1").select(F.col("near").alias("node"), "task").distinct()
    links = confirm(first.select("task", "node").union(hubs.select("task", "node")).distinct(), texts, percent)
    large = near.where("chunks > 1")
    if large.isEmpty():
        return links
    part = connected_components(links)
    large = large.join(part, "node", "left").select("node", "near", "n_shingles", F.coalesce("component", "node").alias("part"))
    large = materialize(large, "parts", rows)
    open_ = materialize(large.groupBy("near").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("near"), "open", rows)
    large = materialize(large.join(open_, "near"), "parts", rows)
    if large.isEmpty():
        return links
    large = materialize(large.join(cross_groups(large, texts, percent), "node").select("node", "group", "part", "n_shingles"), "groups", rows)
    if large.isEmpty():
        return links
    size = materialize(large.groupBy("group", "part").agg(F.count("*").alias("k")), "sizes", rows)
    large = large.join(size, ["group", "part"]).withColumn("pure", F.when(F.col("k") >= CHUNK // 2, F.col("part")))
    pool = large.groupBy(F.col("group").alias("group2"), F.col("pure").alias("pure2")).agg(_chunks(F.count("*"), F.sum("n_shingles")).alias("chunks"))
    pool = materialize(pool, "sizes", rows)
    large = large.join(pool, (F.col("group") == F.col("group2")) & F.col("pure").eqNullSafe(F.col("pure2")))
    large = materialize(large.select("node", "group", "pure", F.xxhash64("group", F.coalesce("pure", F.lit(-1)), F.pmod(h, F.col("chunks"))).alias("chunk")), "chunks", rows)
    one = large.select("group", "chunk", "pure").distinct()
    other = one.select("group", F.col("chunk").alias("chunk_b"), F.col("pure").alias("pure_b"))
    pairs = one.join(other, "group").where("chunk <= chunk_b and not (pure is not null and pure_b is not null and pure = pure_b)")
    pairs = pairs.select("chunk", "chunk_b", F.xxhash64("group", "chunk", "chunk_b").alias("task"))
    tasks = pairs.select("task", "chunk").union(pairs.select("task", F.col("chunk_b").alias("chunk"))).distinct()
    return links.union(confirm(tasks.join(large.select("chunk", "node"), "chunk").select("task", "node"), texts, percent))


def _roots(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the smallest doc_id in the node's component."""
    comp = classes.select("node", "least").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = classes.count()
    comp = materialize(comp, "named", rows)
    least = materialize(comp.groupBy("component").agg(F.min("least").alias("root")), "roots", rows)
    return comp.join(least, "component").select("node", "root")


def _solve(docs: DataFrame, percent: int):
    """Rows (doc_id, n_shingles, set1, set2, node), classes, links between them, and the doc_ids of more than one row (None if there are none)."""
    all_ = materialize(sketches(docs, percent), "sketches")
    live = all_.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # a number of its own, fixed once written
    links = links_of(classes, docs, percent)
    rows = all_.select("doc_id", "n_shingles", "set1", "set2").join(classes.select("set1", "set2", "n_shingles", "node"), ["set1", "set2", "n_shingles"], "left")
    twice = materialize(all_.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id"), "repeated")
    return rows, classes, links, None if twice.isEmpty() else twice


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * |A & B| >= percent * |A | B| over sets of 5-word shingles.

    docs needs doc_id (long) and text; other columns are ignored, whatever their names. Returns one row per input row:
    doc_id, n_shingles (size of its row's set), component_id (smallest doc_id reachable over links), kept (doc_id =
    component_id). Null, empty or white-space texts have an empty set and are linked with nothing. With fewer than five words the
    whole sequence is the one shingle. Rows repeating a doc_id are one node, which has the links of all its texts. A null doc_id takes no
    part: component_id is null and kept is true. Equal texts have equal components; an empty table gives an empty result. A text of any length
    is read whole; a task holds one chunk (CHUNK texts, CHUNK_SHINGLES shingles) or the one text that exceeds it.
    """
    rows, classes, links, twice = _solve(docs, percent)
    if twice is not None:
        ties = materialize(rows.where("node is not null").join(twice, "doc_id").select("doc_id", "node").distinct(), "ties")
        hub = materialize(ties.groupBy("doc_id").agg(F.min("node").alias("b")), "hubs")
        links = links.union(ties.withColumnRenamed("node", "a").join(hub, "doc_id").where("a <> b").select("a", "b"))
    out = rows.join(_roots(classes, links), "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    if twice is not None:  # a row without words under a doc_id that has others: the node's component
        out = materialize(out, "rows")
        whole = materialize(out.join(twice, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least")), "whole")
        out = out.join(whole, "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _digest_rows(text_at: int):
    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(text_at))
            for lo, hi in slices_by_bytes(offsets, SLICE_BYTES):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                extra = [*map(pa.array, digests(sets)), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[str(i) for i in range(len(part.columns) + 3)])

    return run


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, one of each group of near-duplicates: the row of its smallest doc_id.

    Groups are those of near_duplicates(), but for a doc_id that repeats: its rows are judged each by its own text, so that unlike texts under
    one number stay; of a group's rows under its smallest doc_id the one of the smallest text stays. Rows of null doc_id
    and rows without words stay.
    """
    rows, classes, links, twice = _solve(docs, percent)
    roots = _roots(classes, links)
    gone = rows.join(roots, "node").where("doc_id <> root").select("doc_id")
    if twice is None:
        return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(gone.join(twice, "doc_id", "left_anti").union(twice), "doc_id", "left_anti").select(*docs.columns)
    many = docs.join(twice, "doc_id", "left_semi").select(*docs.columns)
    set1, set2, n, whole = free_names(docs.columns, "set1", "set2", "n_shingles", "whole")
    schema = many.schema
    for c in (set1, set2, n):
        schema = StructType([*schema, StructField(c, LongType())])
    many = many.mapInArrow(_digest_rows(docs.columns.index("text")), schema)
    named = classes.join(roots, "node").where("root is not null").select(F.col("set1").alias(set1), F.col("set2").alias(set2), F.col("n_shingles").alias(n), F.col("root").alias(whole))
    many = many.join(named, [set1, set2, n], "left")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # The least row by a partial aggregate, so that a number which a third of all rows repeat is no hot task.
    own = many.where(F.col(whole) == F.col("doc_id")).groupBy(F.col(whole).alias("root")).agg(F.min_by(every, F.struct("text", F.xxhash64(F.to_json(every)))).alias("row")).select("row.*")
    return once.unionByName(own).unionByName(many.where(F.col(whole).isNull()).select(*docs.columns))
