"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles with difference hashes."""

from __future__ import annotations

import functools
import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices_by_bytes, text_buffer
from loomgraph.storage import materialize

#: Bytes of media handled at a time by a task.
SLICE_BYTES = 8_000_000

_FIELD = re.compile(rb"(?:[ \t\n\r\x0b\f]|#[^\n\r]*[\n\r])*([0-9]+)")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Raw Netpbm (P5 for height x width, P6 for height x width x 3) of 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP of height x width x 3 8-bit samples."""
    h, w = pixels.shape[:2]
    stride = (3 * w + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: height x width (x 3 for P3, P6) of the stored samples; bitmaps give 0 for black, 1 for white."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not Netpbm")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    top = fields[2] if len(fields) == 3 else 1
    if not (0 < top < 65536) or w < 1 or h < 1:
        raise ValueError("broken Netpbm header")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if kind in (b"P4", b"P5", b"P6"):
        at += 1
        if kind == b"P4":
            row = (w + 7) // 8
            bits = np.frombuffer(data, np.uint8, h * row, at).reshape(h, row)
            flat = 1 - np.unpackbits(bits, axis=1)[:, :w]
        else:
            flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
    else:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        if kind == b"P1":
            digits = np.frombuffer(body, np.uint8)
            flat = 1 - (digits[(digits == 48) | (digits == 49)][:n] - 48)
        else:
            flat = np.array(body.split()[:n], np.int64).astype(np.uint8 if top < 256 else np.uint16)
        if flat.size != n:
            raise ValueError("short Netpbm body")
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits: height x width x 3."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)
    rows = rows if h < 0 else rows[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :w]]
    step = bits // 8
    return rows[:, : w * step].reshape(abs(h), w, step)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def gray(pixels: np.ndarray) -> np.ndarray:
    if pixels.ndim == 2:
        return pixels.astype(np.int64)
    return (pixels.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target pixel's area, exactly, by an integral image read at fractional corners; whole-number arithmetic."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=total[1:, 1:])

    def cut(sums: np.ndarray, n: int, parts: int) -> np.ndarray:
        whole, rest = np.divmod(np.arange(parts + 1) * n, parts)
        lower, upper = sums[whole], sums[np.minimum(whole + 1, n)]
        rest = rest[:, None]
        return np.diff(lower * (parts - rest) + upper * rest, axis=0)

    both = cut(cut(total, h, height).T, w, width).T
    return (2 * both + h * w) // (2 * h * w)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means is darker than the one to its right."""
    small = area_resize(image, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


@functools.lru_cache(maxsize=64)
def _npy_head(shape: tuple, kind: str) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
    return out.getvalue()


def to_npy(tile: np.ndarray) -> bytes:
    return _npy_head(tile.shape, np.lib.format.dtype_to_descr(tile.dtype)) + tile.tobytes()


def tiles(image: np.ndarray, side: int = 64, tile: int = 32) -> list[tuple[int, int, bytes, int]]:
    """The image, area-resized to side x side, as (row, column, NPY bytes, difference hash) of tile x tile squares."""
    small = area_resize(image, side, side)
    out = []
    for y in range(0, side, tile):
        for x in range(0, side, tile):
            part = np.ascontiguousarray(small[y : y + tile, x : x + tile])
            out.append((y // tile, x // tile, to_npy(part.astype(np.uint8) if part.max(initial=0) < 256 else part.astype(np.uint16)), difference_hash(part)))
    return out


def hash_hex(h: int) -> str:
    return f"{h:016x}"


TILE = "struct<tile_row:int,tile_col:int,npy:binary,dhash:string>"


def _media_rows(side: int, tile: int):
    def run(batches):
        kind = pa.struct([("tile_row", pa.int32()), ("tile_col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())])
        for batch in batches:
            for lo, hi in slices_by_bytes(text_buffer(batch.column(1))[1], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                rows, ids = {"height": [], "width": [], "dhash": [], "tiles": [], "error": []}, part.column(0)
                for data in part.column(1).to_pylist():
                    try:
                        image = gray(decode(data))
                        got = [{"tile_row": r, "tile_col": c, "npy": npy, "dhash": hash_hex(h)} for r, c, npy, h in tiles(image, side, tile)]
                        values = (*image.shape, hash_hex(difference_hash(image)), got, None)
                    except (ValueError, TypeError, struct.error) as e:
                        values = (None, None, None, None, "no media" if data is None else str(e) or "broken")
                    for k, v in zip(rows, values):
                        rows[k].append(v)
                types = [pa.int32(), pa.int32(), pa.string(), pa.list_(kind), pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(rows.values(), types))], names=["media_id", *rows])

    return run


def media_tiles(media: DataFrame, id_col: str = "media_id", media_col: str = "media", side: int = 64, tile: int = 32) -> DataFrame:
    """Decode a binary column; return media_id, height, width, dhash, tiles (array of NPY tiles with their hashes), error.

    Null, empty, truncated or unknown bytes give null features and a text in `error`. Equal bytes give equal features; rows
    repeating an id are decoded each; other columns are ignored; an empty table gives no rows.
    """
    kind = dict(media.dtypes)[id_col]
    slim = media.select(F.col(id_col).alias("media_id"), F.col(media_col).alias("media"))
    return slim.mapInArrow(_media_rows(side, tile), f"media_id {kind}, height int, width int, dhash string, tiles array<{TILE}>, error string")


WIDTH, UNIT = 64, 192


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


ENCODERS = {"netpbm": encode_netpbm, "bmp": encode_bmp}


def _text_media_rows(form: str):
    encode = ENCODERS[form]

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in slices_by_bytes(offsets, SLICE_BYTES):
                data, offs = raw[offsets[lo] : offsets[hi]].tobytes(), (offsets[lo : hi + 1] - offsets[lo]).tolist()
                media = [encode(np.frombuffer(payload_of(data[a:b]), np.uint8).reshape(-1, WIDTH, 3)) for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def texts_to_media(docs: DataFrame, form: str = "netpbm") -> DataFrame:
    """Store every text as an image, and return the stored table: doc_id, n_bytes (UTF-8 bytes of the text), media.

    The text, padded by spaces to whole rows of 64 pixels of 3 samples, is the image's pixels: form "netpbm" (P6) or "bmp" (24 bits). The table
    is written to the shared folder (Parquet, zstd), and what is returned reads it from there. A null text is empty; equal texts give
    equal bytes; rows repeating a doc_id are stored each; an empty table gives no rows; other columns are ignored. A text may have any length
    that a binary value can hold (about 2 GB); a task holds SLICE_BYTES of texts, or the one that exceeds it.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_text_media_rows(form), "doc_id long, n_bytes long, media binary")
    return materialize(rows, "media", compression="zstd")


def _digest_rows(side: int, tile: int):
    def run(batches):
        kind = pa.struct([("tile_row", pa.int32()), ("tile_col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())])
        for batch in batches:
            for lo, hi in slices_by_bytes(text_buffer(batch.column(2))[1], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                cols: list[list] = [[] for _ in range(7)]
                for media in part.column(2).to_pylist():
                    pixels = decode(media)
                    payload, image = pixels.tobytes(), gray(pixels)
                    made = [{"tile_row": r, "tile_col": c, "npy": npy, "dhash": hash_hex(h)} for r, c, npy, h in tiles(image, side, tile)]
                    values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), hash_hex(difference_hash(image)), made)
                    for c, v in zip(cols, values):
                        c.append(v)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(kind)]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tiles"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return run


def media_digests(media: DataFrame, side: int = 64, tile: int = 32) -> DataFrame:
    """From stored doc_id, n_bytes, media: what reading the bytes back gives (payload, digests), and the image's NPY tiles, written likewise.

    Returns the stored table of payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, dhash (difference hash of the image) and
    tiles: the image, area-resized to side x side, as tile x tile squares in NPY bytes with their difference hashes. Equal bytes give
    equal values, ties in a difference hash count as not darker, rows repeating a doc_id are read each, an empty table gives no rows.
    """
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tiles array<{TILE}>"
    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(_digest_rows(side, tile), schema), "tiles", compression="zstd")


def _tile_rows(batches):
    """A string for each row's stored tiles: every tile's hash, and a digest of all their samples as numpy reads them."""
    for batch in batches:
        out = []
        for row in batch.column(0).to_pylist():
            arrays = [np.load(io.BytesIO(t["npy"]), allow_pickle=False) for t in row]
            out.append("-".join([*(t["dhash"] for t in row), f"{zlib.crc32(b''.join(a.tobytes() for a in arrays)):08x}"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], names=[*batch.schema.names[1:], "tile_feature"])


def with_feature(digests: DataFrame) -> DataFrame:
    """media_digests() with its stored tiles read back: feature is the image's difference hash, those of its tiles, and a checksum of the tiles' samples."""
    rest = [c for c in digests.columns if c != "tiles"]
    schema = ", ".join(f"{c} {digests.schema[c].dataType.simpleString()}" for c in rest) + ", tile_feature string"
    read = digests.select("tiles", *rest).mapInArrow(_tile_rows, schema)
    return read.withColumn("feature", F.concat_ws("-", "dhash", "tile_feature")).drop("dhash", "tile_feature")
