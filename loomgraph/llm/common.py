"""Helpers shared by the training-data operators: reading tables, Arrow columns as byte arrays, rows by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of the columns'."""
    used, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string (or binary) column end to end, and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        empty = "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b""
        col = col.fill_null(empty)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices_by_bytes(offsets: np.ndarray, limit: int):
    """Row ranges (lo, hi) whose bytes stay below limit (one row may exceed it alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 16)
_POW_INV = _powers(_BASE_INV, 1 << 16)


def _pow_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _POW_INV
    if len(_POW) <= n:
        _POW, _POW_INV = _powers(_BASE, n + n // 2), _powers(_BASE_INV, n + n // 2)
    return _POW, _POW_INV


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Bytes hashed at a time; only memory depends on it: a worker keeps 16 bytes of powers for each, and needs as much again meanwhile.
HASH_BLOCK = 1 << 16


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span raw[start:end] (spans ascending, disjoint), by differences of one running polynomial sum."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + HASH_BLOCK, "right")))
        stop = int(ends[hi - 1])
        if stop - base <= HASH_BLOCK:
            pow_, inv = _pow_table(stop - base)
            run = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(_BYTE_CODE[raw[base:stop]] * pow_[: stop - base], out=run[1:])
            out[lo:hi] = (run[ends[lo:hi] - base] - run[starts[lo:hi] - base]) * inv[starts[lo:hi] - base]
        else:  # one span longer than a block
            pow_, _ = _pow_table(HASH_BLOCK)
            for at in range(base, stop, HASH_BLOCK):
                part = _BYTE_CODE[raw[at : min(stop, at + HASH_BLOCK)]]
                shift = np.full(1, pow(int(_BASE), at - base, 2**64), np.uint64)
                out[lo : lo + 1] += (part * pow_[: len(part)]).sum(keepdims=True, dtype=np.uint64) * shift
        lo = hi
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: ASCII white space of the word contracts: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the row offsets of the words [^\\x20\\x09-\\x0D]+ of every row."""
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[cut > 0] - 1
    last[cut] = solid[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def groups(batches, key: str):
    """Tables of the rows of each key, from batches sorted by key; holds one group and one batch at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and keys[lo] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.concat_tables(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The pairs among (left, right) that first join two parts of 0..n-1: n - 1 of them at most, same parts as all pairs."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(left.tolist(), right.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept
