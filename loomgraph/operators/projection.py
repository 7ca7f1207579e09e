"""Projection of a bipartite table whose keys are whole numbers, without a row a meeting on the wire.

Two nodes that share a `via` node meet there, and meetings outnumber the input by a via node's degree. So they never travel as rows: a node
gets, for each of its via nodes, the list of the other members as differences of one to eight bytes, and counts its partners in the one task
that holds it. Both steps hold a bounded number of meetings at a time; what a task keeps is its different pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from loomgraph.storage import PACKED, discard, materialize

#: Rows (via, side) of one task, meetings counted in one task, and meetings held at a time.
PAIRS, MEETINGS, BLOCK = 1_000_000, 4_000_000, 1_000_000
#: A via node of more members than this is dealt to several tasks, each of which sends the lists of its share of them.
HEAVY = 4_096
#: Neighbours in one row of links: Spark's reader holds 4,096 rows at a time, whatever their length.
ROW = 512

_WHOLE = (ST.ByteType, ST.ShortType, ST.IntegerType, ST.LongType)
#: A node's neighbours: dst in rising order with w beside it, in `parts` rows one after another (0: some may lie apart).
LINKS = "src long, dst array<long>, w array<long>, parts long"


def whole(pairs: DataFrame, *cols: str) -> bool:
    return all(isinstance(pairs.schema[c].dataType, _WHOLE) for c in cols)


def tally(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (a, b) in rising order and the sum of n, or the number of rows."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    low, span = int(b.min()), int(b.max()) - int(b.min()) + 1
    first = int(a.min())
    if (int(a.max()) - first + 1) * span < 1 << 62:
        key = (a - first) * span + (b - low)
        order = None if n is None else np.argsort(key, kind="stable")
        key = np.sort(key) if n is None else key[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        a, b = key[at] // span + first, key[at] % span + low
        rows = len(key)
    else:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rows = len(a)
        a, b = a[at], b[at]
    return a, b, np.diff(np.append(at, rows)) if n is None else np.add.reduceat(n[order], at)


def runs(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in names]


def _sender(upper: bool):
    """(v, x, share, shares) of whole via nodes -> (a, base, width, rest): for each member a, the others' list as base and the differences."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        size = 0

        def compact() -> None:
            for shares, parts in kept.items():
                v, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                share = np.concatenate([p[2] for p in parts])
                if shares == 1:
                    v, x, _ = tally(v, x)
                    kept[shares] = [(v, x, np.zeros(len(v), np.int64))]
                else:
                    rows = np.unique(np.stack([v, share, x], 1), axis=0)
                    kept[shares] = [(rows[:, 0], rows[:, 2], rows[:, 1])]

        for batch in batches:
            v, x, share, shares = _columns(batch, "v", "x", "share", "shares")
            for s in np.unique(shares):
                at = shares == s
                kept.setdefault(int(s), []).append((v[at], x[at], share[at]))
            size += len(v)
            if size > 4 * PAIRS:
                compact()
                size = sum(len(p[0]) for parts in kept.values() for p in parts)
                size = size if size < 2 * PAIRS else 0
        compact()
        for shares, parts in kept.items():
            v, x, share = parts[0]
            new = np.concatenate(([True], (v[1:] != v[:-1]) | (share[1:] != share[:-1]))) if len(v) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(v)))
            step = np.where(new, 0, np.diff(x, prepend=x[:1])).astype(np.uint64)
            top = np.maximum.reduceat(step, start) if len(start) else step
            width = sum((top >= (1 << 8 * i)).astype(np.int64) for i in range(1, 8)) + 1
            for w in np.unique(width):
                mine = np.flatnonzero((width == w) & (length > 1))
                yield from emit(x, step, start[mine], length[mine], share[start[mine]], shares, int(w))

    def emit(x, step, start, length, share, shares, width) -> Iterator[pa.RecordBatch]:
        done = 0
        cost = np.cumsum(length * length // shares + length)
        while done < len(start):
            upto = max(done + 1, int(np.searchsorted(cost, (cost[done - 1] if done else 0) + BLOCK)))
            s, k = start[done:upto], length[done:upto]
            turn = runs(k)
            owner = np.repeat(np.arange(len(s)), k)
            at = np.flatnonzero(turn % shares == share[done:upto][owner])
            if upper:
                at = at[turn[at] < k[owner[at]] - 1]
            done = upto
            # A list begins at the member itself, or at the least one; the differences that follow it are sent.
            member = s[owner] + turn
            head = member if upper else s[owner]
            tail = s[owner] + k[owner]
            for part in np.array_split(at, max(1, int((tail[at] - head[at]).sum()) // BLOCK)):
                lengths = tail[part] - head[part] - 1
                flat = step[np.repeat(head[part] + 1, lengths) + runs(lengths)]
                data = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                offsets = np.concatenate(([0], np.cumsum(lengths * width))).astype(np.int32)
                rest = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(x[member[part]]), pa.array(x[head[part]]), pa.array(np.full(len(part), width, np.int8)), rest], ["a", "base", "width", "rest"])

    return send


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the lists of a batch, the members first of their lists among them."""
    a, base, width = _columns(batch, "a", "base", "width")
    rest = batch.column("rest").cast(pa.binary())
    offsets = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64)
    data = np.frombuffer(rest.buffers()[2], np.uint8)
    yield a, base
    size = np.diff(offsets)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, int(size[rows].sum()) // (int(w) * BLOCK))):
            count = size[part] // w
            if not count.sum():
                continue
            if len(part) == len(width):
                raw = data[offsets[0] : offsets[-1]]
            else:
                raw = data[np.repeat(offsets[part], size[part]) + runs(size[part])]
            wide = np.zeros((int(count.sum()), 8), np.uint8)
            wide[:, :w] = raw.reshape(-1, w)
            total = np.cumsum(wide.view("<i8").ravel())
            ends = np.cumsum(count)
            before = np.where(ends > count, total[np.maximum(ends - count - 1, 0)], 0)
            yield np.repeat(a[part], count), total + np.repeat(base[part] - before, count)


def _pairs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, meetings) of all lists of a task, in rising order."""
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def close() -> None:
        if fresh:
            counted.append(tally(*(np.concatenate([f[i] for f in fresh]) for i in (0, 1))))
            fresh.clear()
        if len(counted) > 1 and sum(len(c[0]) for c in counted[1:]) > len(counted[0][0]):
            counted[:] = [tally(*(np.concatenate([c[i] for c in counted]) for i in range(3)))]

    for batch in batches:
        for a, b in _lists(batch):
            other = a != b
            fresh.append((a[other], b[other]))
            held += len(a)
        if held > 2 * BLOCK:
            close()
            held = 0
    close()
    if not counted:
        return (np.zeros(0, np.int64),) * 3
    return counted[0] if len(counted) == 1 else tally(*(np.concatenate([c[i] for c in counted]) for i in range(3)))


def _to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, w = _pairs(batches)
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (a, b, w)], ["a", "b", "w"])


def _to_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, w = _pairs(batches)
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    yield from link_rows(a[start], np.diff(np.append(start, len(a))), b, w, np.ones(len(start), bool))


def link_rows(src: np.ndarray, length: np.ndarray, dst: np.ndarray, w: np.ndarray, complete: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of LINKS of nodes and their neighbours one after another, batches of about BLOCK neighbours."""
    rows = -(-length // ROW)
    node = np.repeat(np.arange(len(src)), rows)
    start = (np.cumsum(length) - length)[node] + runs(rows) * ROW
    ends = np.append(start[1:], len(dst))
    parts = np.where(complete, rows, 0)[node]
    done = 0
    while done < len(start):
        upto = max(done + 1, int(np.searchsorted(ends, start[done] + BLOCK, "right")))
        lo, hi = start[done], ends[upto - 1]
        offsets = pa.array(np.append(start[done:upto], hi) - lo, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[lo:hi])) for c in (dst, w)]
        yield pa.RecordBatch.from_arrays([pa.array(src[node[done:upto]]), *lists, pa.array(parts[done:upto])], ["src", "dst", "w", "parts"])
        done = upto


def nodes_of(batches: Iterator[pa.RecordBatch], weights: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(src, length, dst, w, complete) of the rows of LINKS of a task, a node's rows joined; not complete: others may lie elsewhere.
    A node of more than BLOCK neighbours comes in several pieces."""
    held = None

    def close(src, parts, size, dst, w):
        start = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
        return src[start], np.add.reduceat(size, start), dst, w, np.diff(np.append(start, len(src))) == parts[start]

    for batch in batches:
        if not len(batch):
            continue
        src, parts = _columns(batch, "src", "parts")
        dst = batch.column("dst")
        size = dst.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        dst = dst.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        w = batch.column("w").flatten().to_numpy(zero_copy_only=False) if weights else dst
        now = (src, parts, size, dst, w)
        now = now if held is None else tuple(np.concatenate([h, n]) for h, n in zip(held, now, strict=True))
        src, size = now[0], now[2]
        other = np.flatnonzero(src != src[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if size[last:].sum() > BLOCK:
            last = len(src)
        at = int(size[:last].sum())
        if last:
            yield close(*(c[:last] for c in now[:3]), *(c[:at] for c in now[3:]))
        held = (*(c[last:] for c in now[:3]), *(c[at:] for c in now[3:])) if last < len(src) else None
    if held is not None:
        yield close(*held)


def _lists_sent(pairs: DataFrame, side: str, via: str, upper: bool) -> tuple[DataFrame, int]:
    """The lists of every member, and the number of tasks that count them."""
    p = pairs.select(F.col(via).cast("long").alias("v"), F.col(side).cast("long").alias("x")).where("v is not null and x is not null")
    light = F.when(F.col("n") <= HEAVY, F.col("n") * (F.col("n") - 1)).otherwise(0)
    sizes = p.groupBy("v").agg(F.count("*").alias("n"))
    rows, meetings, most = (x or 0 for x in sizes.agg(F.sum("n"), F.sum(light), F.max("n")).first())
    p = p.withColumn("share", F.lit(0).cast("long")).withColumn("shares", F.lit(1).cast("long"))
    if most > HEAVY:
        heavy = p.join(F.broadcast(p.groupBy("v").count().where(F.col("count") > HEAVY).select("v")), "v", "left_semi").groupBy("v").agg(F.count_distinct("x").alias("k"))
        heavy = materialize(heavy.select("v", "k", F.ceil(F.col("k") / HEAVY).cast("long").alias("m")), "heavy", 1)
        meetings += int(heavy.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0])
        p = p.join(F.broadcast(heavy.select("v", "m")), "v", "left").withColumn("shares", F.coalesce("m", F.lit(1).cast("long")))
        p = p.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select("v", "x", "share", "shares")
    tasks = max(1, -(-rows // PAIRS), meetings // (16 * MEETINGS))
    dealt = p.repartition(tasks, "v", "share")
    return dealt.mapInArrow(_sender(upper), "a long, base long, width byte, rest binary"), meetings // ((2 if upper else 1) * MEETINGS) + 1


def pairs_met(pairs: DataFrame, side: str, via: str) -> DataFrame:
    """(a, b, w), a < b: how many via nodes two side nodes share; repeated pairs count once, nulls don't."""
    lists, tasks = _lists_sent(pairs, side, via, True)
    return lists.repartition(tasks, "a").mapInArrow(_to_rows, "a long, b long, w long")


def links_met(pairs: DataFrame, side: str, via: str) -> DataFrame:
    """LINKS of the same projection both ways, written once: a node's neighbours lie together in one file."""
    lists, tasks = _lists_sent(pairs, side, via, False)
    return store_links(lists.repartition(tasks, "a").mapInArrow(_to_links, LINKS), "links")


def store_links(links: DataFrame, tag: str) -> DataFrame:
    """Rising numbers are written as packed differences, about a byte a neighbour where plain Parquet takes eight."""
    return materialize(links, tag, **PACKED)


def at_least(links: DataFrame, cut: float) -> DataFrame:
    """LINKS with the neighbours of w >= cut alone, written; nodes left without any are dropped."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, length, dst, w, complete in nodes_of(batches):
            on = w >= cut
            left = np.add.reduceat(on, np.cumsum(length) - length, dtype=np.int64)
            yield from link_rows(src[left > 0], left[left > 0], dst[on], w[on], complete[left > 0])

    return store_links(links.mapInArrow(keep, LINKS), "links")


def joined(links: DataFrame) -> DataFrame:
    """(node, nbrs): the whole sorted list of each node; only nodes whose rows lie apart are moved."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, length, dst, _, complete in nodes_of(batches, weights=False):
            offsets = np.concatenate(([0], np.cumsum(length)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(dst))
            yield pa.RecordBatch.from_arrays([pa.array(src), lists, pa.array(complete)], ["node", "nbrs", "complete"])

    lists = links.select("src", "dst", "parts").mapInArrow(join, "node long, nbrs array<long>, complete boolean")
    # Lists that lie apart are rare; they are told by rows alone, so that whole lists pass straight through.
    apart = lists.where("not complete").groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
    return lists.where("complete").select("node", "nbrs").union(apart)


def heaviest(links: DataFrame, share: float) -> DataFrame:
    """links with w at or above the exact quantile (interpolated) of the weights of a < b, each of which stands in links twice. Where that
    is the least weight, nothing is dropped and nothing written again."""
    counts = links.select(F.explode("w").alias("w")).groupBy("w").agg((F.count("*") / 2).cast("long").alias("n"))
    cut, least = counts.agg(F.percentile("w", F.lit(share), F.col("n")), F.min("w")).first()
    if cut is None or cut <= least:
        return links
    kept = at_least(links, cut)
    discard(links)
    return kept
