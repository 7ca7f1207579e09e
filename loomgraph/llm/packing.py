"""Best-fit packing of token sequences under several capacities at once (vector best-fit)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import text_buffer
from loomgraph.llm.tokens import WordTokenizer, default_tokenizer
from loomgraph.storage import materialize

#: Pieces packed together by one task: enough that its last, part-filled bins don't matter, few enough to stay quick.
GROUP_PIECES = 16_384


def _piece_rows(tokenizer: str, end_id: int, limit: int, with_ids: bool):
    def run(batches):
        words = WordTokenizer.at(tokenizer)
        row = 0
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi, ids, offs in words.encode(raw, offsets):
                who, piece, start, length, crc, salt, held = [], [], [], [], [], [], []
                for r in range(hi - lo):
                    one = np.append(ids[offs[r] : offs[r + 1]], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(one), limit)):
                        part = one[at : at + limit].tobytes()
                        who.append(lo + r), piece.append(k), start.append(at), length.append(len(part) // 4)
                        crc.append(zlib.crc32(part)), salt.append(row)
                        if with_ids:
                            held.append(part)
                    row += 1
                cols = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                if with_ids:
                    cols, names = [*cols, pa.array(held, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, limit: int = 4096, with_ids: bool = False) -> DataFrame:
    """The identifiers of every document, with end_id after them, cut into pieces of at most `limit`.

    doc_id, piece, start, length, ids_crc32 (little-endian unsigned 32-bit identifiers), salt (the row's number in its task, to
    tell apart rows that repeat a doc_id) and, if asked for, ids (binary). A null text counts as empty: one piece of one identifier.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_piece_rows(tokenizer or default_tokenizer(), end_id, limit, with_ids), schema)


class Bins:
    """Open bins as parallel arrays of residual capacities; the bin for a piece is chosen by one vector expression."""

    def __init__(self, capacity: np.ndarray, weights: np.ndarray, rule: str):
        self.capacity, self.weights, self.rule = capacity, weights, rule
        self.left = np.zeros((3, 1024))
        self.number = np.zeros(1024, np.int64)
        self.n = self.made = 0

    def place(self, demand: np.ndarray) -> int:
        """The number of the bin that takes a piece: a fitting open bin by the rule, else a new one."""
        left = self.left[:, : self.n]
        fits = np.flatnonzero((left[0] >= demand[0]) & (left[1] >= demand[1]) & (left[2] >= demand[2]))
        if len(fits):
            some = left[:, fits] / self.capacity[:, None]
            want = (demand / self.capacity)[:, None]
            if self.rule == "norm":
                score = -(self.weights[:, None] * (some - want) ** 2).sum(axis=0)
            else:
                score = (self.weights[:, None] * some * want).sum(axis=0)
            at = int(fits[np.argmax(score)])
        else:
            if self.n == len(self.number):
                self.left = np.concatenate([self.left, np.zeros_like(self.left)], axis=1)
                self.number = np.concatenate([self.number, np.zeros_like(self.number)])
            at = self.n
            self.left[:, at] = self.capacity
            self.number[at] = self.made
            self.n += 1
            self.made += 1
        self.left[:, at] -= demand
        return at

    def close(self, least: float) -> None:
        """Drop bins that can't take even the smallest piece left."""
        keep = np.flatnonzero((self.left[0, : self.n] >= least) & (self.left[1, : self.n] >= 1) & (self.left[2, : self.n] >= least * least))
        self.left[:, : len(keep)] = self.left[:, keep]
        self.number[: len(keep)] = self.number[keep]
        self.n = len(keep)


def vector_best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, pieces taken from the longest.

    A bin has three residual capacities: tokens, documents, and attention cost (a piece of n tokens costs n * n). A piece goes
    to a bin in which it fits by all three: with rule "norm" to the one that it leaves with the least weighted residual
    norm, with "dot" to the one with the largest weighted dot product of demand and residual; ties to the older bin.
    """
    bins = Bins(np.array([tokens, documents, attention], float), np.array(weights, float), rule)
    order = np.argsort(-lengths, kind="stable")
    least = float(lengths.min()) if len(lengths) else 0.0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if len(lengths) and (least * least > attention or lengths.max() > tokens or float(lengths.max()) ** 2 > attention):
        raise ValueError("a piece exceeds the capacity of an empty bin")
    for k, i in enumerate(order):
        n = float(lengths[i])
        at = bins.place(np.array([n, 1.0, n * n]))
        where[i] = bins.number[at]
        offset[i] = tokens - bins.left[0, at] - n
        if k % 64 == 63:
            bins.close(least)
    return where, offset


def _pack_group(tokens: int, documents: int, attention: float, weights, rule: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        where, offset = vector_best_fit(table.column("length").to_numpy(), tokens, documents, attention, weights, rule)
        number = table.column("pack_group").to_numpy().astype(np.int64) * (1 << 32) + where
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return run


def best_fit_pack(docs: DataFrame, tokens: int = 4096, documents: int | None = None, attention: float | None = None, weights=(1.0, 1e-3, 1e-3), rule: str = "norm", tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False, longest: int | None = None) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `tokens` identifiers.

    Longer documents are cut into pieces of `longest` (by default `tokens`), the last shorter. `documents` and `attention` bound the pieces of a sequence and
    the sum of their squared lengths; by default neither binds (pieces that fill `tokens` exceed neither), and the choice is best fit by tokens.
    Pieces are dealt by
    hash to groups of about GROUP_PIECES, packed apart; each leaves a part-filled bin or two. Returns doc_id, piece, start, length,
    ids_crc32, sequence_id (unique over groups), offset (gapless within a sequence), and ids if asked for.
    Null texts are one piece holding only end_id; rows repeating a doc_id are packed each; other columns are ignored; an empty table gives no
    rows. A text of any length is cut into pieces as it is tokenized; a capacity that a single piece exceeds is an error.
    """
    pieces = materialize(token_pieces(docs, tokenizer, end_id, min(tokens, longest or tokens), with_ids), "pieces")
    n = max(1, round(pieces.count() / GROUP_PIECES))
    group = F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(n))
    dealt = pieces.withColumn("pack_group", group)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    limits = (tokens, documents or tokens, float(attention or tokens * tokens), tuple(weights), rule)
    return dealt.groupBy("pack_group").applyInArrow(_pack_group(*limits), schema).drop("salt")
