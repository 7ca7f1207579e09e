"""Exact top-k search by inner product: columnar branch and bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block (held by a task), candidates of a slice (streamed through it), dimensions of a step.
QUERY_BLOCK, SLICE, STEP = 32_768, 32_768, 16
#: Bytes of a query block's vectors, as doubles; long vectors make smaller blocks.
BLOCK_BYTES = 128_000_000
_EXACT = 2**53


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dims).astype(np.float64)


class BlockSearch:
    """The k best candidates so far of each query of one block; add() streams candidates in vertical layout."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.cuts = [*range(0, vectors.shape[1], STEP), vectors.shape[1]]
        self.rest = self._rest(vectors)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def _rest(self, v: np.ndarray) -> np.ndarray:
        """Norm of what lies beyond each step: the remaining mass. Rounded up, so that a bound never falls short."""
        sq = np.stack([(v[:, c:] ** 2).sum(axis=1) for c in self.cuts[1:]])
        return np.sqrt(sq) * (1 + 1e-9)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        big = max(np.abs(self.q).max(initial=0), np.abs(vectors).max(initial=0))
        if big * big * max(1, vectors.shape[1]) >= _EXACT:
            return self._add_plain(ids, vectors)
        cols = np.ascontiguousarray(vectors.T)
        rest = self._rest(vectors)
        first = self.cuts[1]
        for lo in range(0, len(self.ids), 128):
            part = self.q[lo : lo + 128, :first] @ cols[:first]
            bound = part + self.rest[0][lo : lo + 128, None] * rest[0][None, :] + 0.5
            for i in range(lo, min(lo + 128, len(self.ids))):
                alive = np.flatnonzero(bound[i - lo] >= self.floor[i])
                sums = part[i - lo, alive]
                for s in range(1, len(self.cuts) - 1):
                    if not len(alive):
                        break
                    a, b = self.cuts[s], self.cuts[s + 1]
                    sums = sums + self.q[i, a:b] @ cols[a:b, alive]
                    keep = sums + self.rest[s][i] * rest[s][alive] + 0.5 >= self.floor[i]
                    alive, sums = alive[keep], sums[keep]
                self._merge(i, ids[alive], sums)

    def _add_plain(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Components too large for exact doubles: whole-number products, scores held to the range of a long."""
        cols = vectors.astype(object).T
        for i in range(len(self.ids)):
            sums = np.clip((self.q[i].astype(object) @ cols).astype(object), -(2**63), 2**63 - 1)
            self._merge(i, ids, sums)

    def _merge(self, i: int, ids: np.ndarray, sums: np.ndarray) -> None:
        own = ids != self.ids[i]
        ids, sums = ids[own], sums[own]
        if not len(ids):
            return
        sums, ids = np.concatenate([self.best[i][0], sums]), np.concatenate([self.best[i][1], ids])
        order = np.lexsort((ids, -sums))[: self.k] if sums.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (-sums[j], ids[j]))[: self.k])
        self.best[i] = (sums[order], ids[order])
        if len(order) == self.k:
            self.floor[i] = float(sums[order[-1]])

    def rows(self):
        for i, (sums, ids) in enumerate(self.best):
            for s, v in zip(sums.tolist(), ids.tolist()):
                yield int(self.ids[i]), int(v), int(s)


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        key, block, ids, vectors, last = None, None, [], [], None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block.rows())] or [pa.array([], pa.int64())] * 3, names=names)

        for batch in batches:
            n = batch.num_rows
            part = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            is_query = batch.column(3).to_numpy()
            change = np.flatnonzero((part[1:] != part[:-1]).any(axis=1) | (is_query[1:] != is_query[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), n]):
                now = tuple(part[lo].tolist())
                if now != key:
                    if block is not None:
                        yield done()
                    key, block, ids, vectors = now, None, [], []
                own = batch.column(4).to_numpy()[lo:hi]
                v = _matrix(batch.column(5).slice(lo, hi - lo), now[0])
                begins = np.concatenate([[(key, int(is_query[lo]), int(own[0])) != last], own[1:] != own[:-1]])  # rows sorted by id, then vector
                last = (key, int(is_query[lo]), int(own[-1]))
                own, v = own[begins], v[begins]
                if is_query[lo] == 0:
                    ids.append(own), vectors.append(v)
                elif ids or block is not None:
                    if block is None:
                        block = BlockSearch(np.concatenate(ids), np.concatenate(vectors), k)
                        ids, vectors = [], []
                    block.add(own, v)
        if block is not None:
            yield done()

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """For every row of `vectors` (vec_id, embedding) where the column is_query holds, the k other rows of highest inner product.

    Components x count as floor(scale * x). Ties go to the smaller vec_id; a query with fewer than k partners returns all. Rows
    whose vector is null, empty, or holds null or non-finite components, or whose vec_id is null, take no part; vectors of different length are
    not compared. vec_id is a key: of rows repeating one with vectors of one length, the smallest vector counts (they meet, sorted, in
    the task that searches them, so no shuffle is spent on it). Returns query_id, rank (from 1), vec_id, score.

    Queries are dealt to blocks of at most about QUERY_BLOCK, candidates to hashed slices; each task holds one query block and streams one
    slice past it, pruning by remaining-mass bounds against the k-th best so far, and returns k rows a query. No side is
    broadcast or collected; slices and blocks grow in number, not in size.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    rows = clean.select("vec_id", is_query.alias("is_q"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    n, nq, longest = clean.agg(F.count("*"), F.count_if(is_query), F.max(F.size("embedding"))).first()
    rows_held = max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * (longest or 1))))
    blocks, slices = max(1, -(-nq // rows_held)), max(1, -(-n // SLICE))
    dims, b, s = F.size("v").cast("long").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(slices))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = rows.where("is_q").select(dims, b.cast("long").alias("block"), every(slices).alias("slice"), F.lit(0).alias("kind"), "vec_id", "v")
    others = rows.select(dims, every(blocks).alias("block"), s.cast("long").alias("slice"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = queries.union(others).repartition("dims", "block", "slice").sortWithinPartitions("dims", "block", "slice", "kind", "vec_id", "v")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
