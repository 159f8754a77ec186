"""Media columns: Netpbm and BMP images, decoded with numpy, resized by area and kept as NPY tiles."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from proseplane.functions.batches import of_texts
from proseplane.llm.common import packed_rows

UNIT = 576
TAIL = 32
#: Tiles have this many rows and columns; the difference hash compares columns, so it has TILE * (TILE - 1) bits.
TILE = 9
_HEAD = re.compile(rb"P([1-6])(?:\s|#[^\n\r]*[\n\r])+(\d+)(?:\s|#[^\n\r]*[\n\r])+(\d+)")
_GAP = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])+(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (rows, columns) or (rows, columns, 3), 8 or 16 bits; bit maps are 0 and 255."""
    head = _HEAD.match(data)
    if not head:
        raise ValueError("not a Netpbm image")
    kind, width, height = int(head[1]), int(head[2]), int(head[3])
    at, top = head.end(), 1
    if kind not in (1, 4):
        gap = _GAP.match(data, at)
        if not gap or not 0 < int(gap[1]) < 65536:
            raise ValueError("bad Netpbm maximum")
        top, at = int(gap[1]), gap.end()
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if kind == 4:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        return ((1 - np.unpackbits(raw, axis=1)[:, :width]) * 255).astype(np.uint8)
    if kind == 1:
        bits = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n]
        return ((1 - (np.frombuffer(bits, np.uint8) - 48)) * 255).astype(np.uint8).reshape(shape)
    if kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64)
        return _full_range(values.astype(np.uint8 if top < 256 else np.uint16).reshape(shape), top)
    sample = np.dtype(np.uint8 if top < 256 else ">u2")
    return _full_range(np.frombuffer(data, sample, n, at + 1).reshape(shape), top)


def _full_range(pixels: np.ndarray, top: int) -> np.ndarray:
    """Samples from 0 to the image's maximum, stretched to all of 8 or 16 bits; unchanged where it is theirs."""
    most = 255 if top < 256 else 65535
    if top == most:
        return pixels
    return np.minimum((pixels.astype(np.int64) * most + top // 2) // top, most).astype(np.uint8 if top < 256 else np.uint16)


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Binary grey map of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, 24 or 32 bits, as (rows, columns, 3) in red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    offset, size, width, height, _, bits, packed = struct.unpack_from("<I4x", data, 10)[:1] + struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32) or (packed == 3 and bits != 32):
        raise ValueError("unsupported BMP")
    if packed == 3 and struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF):
        raise ValueError("unsupported BMP masks")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of an array (rows, columns, 3)."""
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the area under each target pixel, from an integral image; grey, float64.

    Rows are taken in blocks, so an image of any height needs memory for a block and the target alone.
    """
    grey = pixels if pixels.ndim == 2 else None
    height, width = pixels.shape[:2]
    cuts_y, cuts_x = np.linspace(0, height, rows + 1), np.linspace(0, width, columns + 1)

    def between(integral: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        low = np.minimum(cuts.astype(np.int64), len(integral) - 1)
        high = np.minimum(low + 1, len(integral) - 1)
        part = (cuts - low).reshape(-1, *[1] * (integral.ndim - 1))
        return integral[low] * (1 - part) + integral[high] * part

    lines = np.zeros((height + 1, columns))  # along y: sums of whole rows above; along x: sums under target columns
    for at in range(0, height, 4096):
        block = (grey[at : at + 4096] if grey is not None else pixels[at : at + 4096].mean(axis=2)).astype(np.float64)
        along = np.zeros((width + 1, len(block)))
        np.cumsum(block.T, axis=0, out=along[1:])
        sums = np.diff(between(along, cuts_x), axis=0).T
        lines[at + 1 : at + 1 + len(block)] = lines[at] + np.cumsum(sums, axis=0)
    return np.diff(between(lines, cuts_y), axis=0) / ((height / rows) * (width / columns))


def difference_hash(tile: np.ndarray) -> str:
    """Bits that say whether a pixel is brighter than its left neighbour, as hex, row by row."""
    return np.packbits(np.diff(tile, axis=1) > 0).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def pack(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text and the PGM that holds them, padded with 255 to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))
    return len(raw), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, UNIT // 24))


@F.arrow_udf(T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for texts in of_texts(batch):
            sizes: list[int] = []

            def stored(texts: pa.Array = texts, sizes: list[int] = sizes) -> Iterator[bytes]:
                for t in texts:
                    n, data = pack(t.as_py())
                    sizes.append(n)
                    yield data

            media = pa.array(stored(), pa.binary(), size=len(texts))  # one image at a time beside the array itself
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), media], ["n_bytes", "media"])


_FEATURES = [("width", pa.int32()), ("height", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("dhash", pa.string()), ("tile", pa.binary()), ("error", pa.string())]


def features(data: bytes | None, tile: int = TILE) -> dict:
    """What the stored bytes hold; only `error` for bytes that are no image that can be read, nothing for null.

    An image whose header claims more pixels than its bytes hold is one that can't be read; nothing is reserved for it.
    """
    if data is None:
        return {}
    try:
        pixels = decode(data)
        if not pixels.size:
            raise ValueError("no pixels")
        samples = np.ascontiguousarray(pixels).tobytes()
        small = area_resize(pixels, tile, tile)
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return {"error": str(e)[:200]}
    return {
        "width": pixels.shape[1], "height": pixels.shape[0], "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-TAIL:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "dhash": difference_hash(small), "tile": npy(small.astype(np.float32)),
    }


@F.arrow_udf(from_arrow_type(pa.struct(_FEATURES)))
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for media in of_texts(batch):
            yield pa.array([features(m.as_py()) for m in media], pa.struct(_FEATURES))


def store_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media: each whole text (null: empty) as a PGM of 24 columns, 8 bits a sample.

    Columns of these names are replaced. Equal texts give equal bytes.
    """
    stored = packed_rows(docs, _packed(F.col(text)).alias("_stored"))
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "media")]
    return stored.select(*own, F.col("_stored.n_bytes").alias("n_bytes"), F.col("_stored.media").alias("media"))


def media_features(images: DataFrame, media: str = "media") -> DataFrame:
    """images with the struct `features` read back from the stored bytes, with the NPY tile and difference hash.

    Bytes that are no image give the field `error` alone, null bytes a struct of nulls; equal images equal features.
    Repeated rows stay, no rows give no rows, a column `features` is replaced, other columns are kept.
    """
    return images.withColumn("features", _features(F.col(media)))


def write_tiles(found: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes (key, dhash, tile) of the images that could be read; a tile is a whole .npy file."""
    f = F.col("features")
    found.where(f["tile"].isNotNull()).select(key, f["dhash"].alias("dhash"), f["tile"].alias("tile")).write.mode("overwrite").parquet(path)


def read_tile(tile: bytes) -> np.ndarray:
    return np.load(io.BytesIO(bytes(tile)), allow_pickle=False)
