"""Media columns: images in a binary column as Netpbm or BMP, decoded to numpy arrays, resized by area through integral
images, and written as NPY tiles with difference hashes.

Edge cases: a null or empty payload is an image of one row of zero bytes; equal payloads give equal values in every
column; neighbours of equal brightness give a hash bit of 0; repeated rows are treated each; further columns are dropped; an empty table gives an empty result; a payload of any length is one image, as
high as it needs. A file that is neither Netpbm nor BMP raises ValueError.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Samples in a row of a stored payload.
ROW = 64
#: Height and width of the tile that is kept of an image; a difference hash needs one column more than bits.
TILE = (8, 9)
_NETPBM = re.compile(rb"P([1-6])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:(?:\s+|#[^\n]*\n)+(\d+))?")


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def encode_ppm(a: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """Grey (8 bits with a palette) from two dimensions, true colour (24 bits) from three."""
    h, w = a.shape[:2]
    grey = a.ndim == 2
    rows = a if grey else a[:, :, ::-1].reshape(h, -1)
    padded = np.zeros((h, -(-rows.shape[1] // 4) * 4), np.uint8)
    padded[:, : rows.shape[1]] = rows[::-1]  # the lowest row first
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + padded.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, padded.size, 2835, 2835, 256 * grey, 0)
    return head + palette.tobytes() + padded.tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6: height x width, or height x width x 3 for pixmaps; bitmaps give 0 and 1, with 1 for black."""
    m = _NETPBM.match(raw)
    if not m:
        raise ValueError("not Netpbm")
    kind, w, h = int(m[1]), int(m[2]), int(m[3])
    bits, colour = kind in (1, 4), kind in (3, 6)
    end, top = (m.end(3), 1) if bits else (m.end(4), int(m[4]))
    shape = (h, w, 3) if colour else (h, w)
    n = h * w * (3 if colour else 1)
    if kind == 1:
        return np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", raw[end:])[:n], np.uint8).reshape(shape) - 48
    if kind < 4:
        return np.array(re.sub(rb"#[^\n]*", b"", raw[end:]).split()[:n], np.uint16 if top > 255 else np.uint8).reshape(shape)
    if kind == 4:
        rows = np.frombuffer(raw, np.uint8, h * -(-w // 8), end + 1).reshape(h, -1)
        return np.unpackbits(rows, axis=1)[:, :w]
    return np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, end + 1).reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed, 8 bits with a palette, 24 or 32 bits: height x width where all colours are grey, else with 3 channels."""
    if raw[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if bits not in (8, 24, 32) or packing not in (0, 3):
        raise ValueError(f"BMP of {bits} bits, compression {packing}")
    up, h = h > 0, abs(h)
    deep = bits // 8
    rows = np.frombuffer(raw, np.uint8, h * (-(-w * deep // 4) * 4), start).reshape(h, -1)[:, : w * deep]
    rows = rows[::-1] if up else rows
    if deep > 1:
        return rows.reshape(h, w, deep)[:, :, 2::-1]
    (used,) = struct.unpack_from("<I", raw, 46)
    palette = np.zeros((256, 3), np.uint8)
    palette[: used or 256] = np.frombuffer(raw, np.uint8, 4 * (used or 256), 14 + head).reshape(-1, 4)[:, 2::-1]
    out = palette[rows]
    return out[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else out


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new sample is the mean of the old ones under its area, parts of samples counted in proportion. The sums
    come from the integral image, read between its points by linear interpolation, so that the cost is that of one
    cumulative sum, whatever the factor."""
    table = np.zeros((a.shape[0] + 1, a.shape[1] + 1, *a.shape[2:]))
    np.cumsum(np.cumsum(a, 0, dtype=np.float64), 1, out=table[1:, 1:])

    def between(t: np.ndarray, axis: int, n: int) -> np.ndarray:
        at = np.arange(n + 1) * ((t.shape[axis] - 1) / n)
        low = np.minimum(at.astype(int), t.shape[axis] - 2)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(t.ndim)])
        return t.take(low, axis) * (1 - part) + t.take(low + 1, axis) * part

    table = between(between(table, 0, height), 1, width)
    sums = table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]
    return sums / (a.shape[0] / height * (a.shape[1] / width))


def difference_hash(tile: np.ndarray) -> str:
    """Hexadecimal: a bit for each sample but a row's last, 1 where its right neighbour is brighter."""
    bits = tile[:, 1:] > tile[:, :-1] + 1e-9
    return np.packbits(bits).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def image_tiles(images: DataFrame, id_col: str, image_col: str, tile: tuple[int, int] = TILE) -> DataFrame:
    """id, height, width, the tile as NPY (uint8), its difference hash."""
    schema = f"{id_col} {images.schema[id_col].dataType.simpleString()}, height int, width int, tile binary, dhash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, image_col):
            got = [tile_of(x, tile) for x in batch.column(image_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *(pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))],
                [id_col, "height", "width", "tile", "dhash"],
            )

    return common.pick(images, id_col, image_col).mapInArrow(run, schema)


def tile_of(raw: bytes, tile: tuple[int, int] = TILE) -> tuple[int, int, bytes, str]:
    a = grey(decode(raw))
    small = area_resize(a, *tile)
    return a.shape[0], a.shape[1], npy(np.clip(np.rint(small), 0, 255).astype(np.uint8)), difference_hash(small)


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (binary): each text's UTF-8 bytes, with zeros to a positive multiple of 64, as rows of 64
    grey samples. The format is chosen by the payload alone: BMP where its CRC-32 is odd, else PGM."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary"

    def one(raw: bytes) -> bytes:
        padded = raw + bytes(-len(raw) % ROW or ROW * (not raw))
        a = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
        return encode_bmp(a) if zlib.crc32(padded) & 1 else encode_pgm(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, text_col):
            raw = [(x or "").encode() for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(x) for x in raw], pa.int64()), pa.array([one(x) for x in raw], pa.binary())], [id_col, "n_bytes", "media"])

    return common.pick(docs, id_col, text_col).mapInArrow(run, schema)


def features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the stored bytes, read back: the payload's digests, those of the stored form, the tile as NPY, its difference hash, and
    a digest of both (feature)."""
    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, dhash string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def one(media: bytes) -> tuple:
        a = decode(media)
        payload, (_, _, tile, dhash) = a.tobytes(), tile_of(media)
        feature = f"{dhash}:{hashlib.sha256(tile).hexdigest()[:16]}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature, tile, dhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "media"):
            got = zip(*map(one, batch.column("media").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(got, kinds, strict=True))], names)

    return stored.mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images are a table in the shared folder, from which the features are read back."""
    return features(common.materialize(store_payloads(common.table(spark, sf_dir, "documents")), compression="zstd"))
