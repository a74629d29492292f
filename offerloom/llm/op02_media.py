"""Media columns: Netpbm and BMP to numpy arrays, area resize by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stored

#: A row of the pictures that hold payloads: 64 pixels of red, green and blue.
ROW_BYTES = 192


class MediaError(ValueError):
    """Bytes that are no picture of a known kind."""


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers after a Netpbm magic, past white space and comments, and where the samples begin."""
    out, at = [], 2
    while len(out) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at or end - at > 9:
            raise MediaError("a number is missing in the header or too large")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as (height, width, channels) of 8-bit samples, 16-bit ones where the maximum is over 255; and the maximum."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("no Netpbm magic")
    bits = kind in (b"P1", b"P4")
    numbers, at = _header(data, 2 if bits else 3)
    width, height, most = numbers[0], numbers[1], 255 if bits else numbers[2]
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not (0 < width and 0 < height and 0 < most < 65536):
        raise MediaError("a size or maximum is out of range")
    n = width * height * channels
    if kind == b"P4":
        row = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, offset=min(at, len(data)))[: row * height]
        if len(packed) < row * height:
            raise MediaError("samples are missing")
        return ((1 - np.unpackbits(packed.reshape(height, row), axis=1)[:, :width]) * 255).reshape(height, width, 1), 255
    if kind in (b"P1", b"P2", b"P3"):
        text = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        found = [b - 48 for b in text if b in b"01"] if bits else text.split()[:n]
        if len(found) < n or not (bits or all(x.isdigit() and len(x) <= 5 for x in found)):
            raise MediaError("samples are missing or no numbers")
        values = np.array(found[:n], np.int64)
        if bits:
            return ((1 - values) * 255).astype(np.uint8).reshape(height, width, 1), 255
        if values.max() > most:
            raise MediaError("a sample is over the maximum")
        return values.astype(np.uint16 if most > 255 else np.uint8).reshape(height, width, channels), most
    kind_of = np.dtype(">u2" if most > 255 else "u1")
    if len(data) - at < n * kind_of.itemsize:
        raise MediaError("samples are missing")
    return np.frombuffer(data, kind_of, n, at).astype(kind_of.newbyteorder("=")).reshape(height, width, channels), most


#: Where 32-bit pixels have their colours if the header doesn't say: blue, green, red from the lowest byte.
PLAIN_MASKS = (0xFF0000, 0xFF00, 0xFF)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, also with bit fields of whole bytes, as (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("no BMP header")
    start, head = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    rows = abs(height)
    if bits not in (8, 24, 32) or packing not in ((0, 3) if bits == 32 else (0,)) or width <= 0 or not rows:
        raise MediaError("this kind of BMP is not supported")
    row = (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + row * rows:
        raise MediaError("samples are missing")
    a = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)[:, : width * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        if colours > 256 or len(data) < 14 + head + colours * 4:
            raise MediaError("the palette is too large or missing")
        table = np.zeros((256, 4), np.uint8)
        table[:colours] = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)
        a = table[a][:, :, 2::-1]
    else:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 and len(data) >= 66 else PLAIN_MASKS
        places = [next((k for k in range(bits // 8) if mask == 0xFF << 8 * k), None) for mask in masks]
        if None in places:
            raise MediaError("bit fields that are no whole bytes are not supported")
        a = a.reshape(rows, width, bits // 8)[:, :, places]
    return np.ascontiguousarray(a[::-1] if height > 0 else a)


def decode(data: bytes) -> np.ndarray:
    """The samples of a picture as they are stored."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)[0]


def decode_scaled(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The samples as they are stored, and scaled so that the maximum is 255."""
    if data[:2] == b"BM":
        a = decode_bmp(data)
        return a, a
    a, most = decode_netpbm(data)
    return a, a if most == 255 else a * (255 / most)


def encode_ppm(a: np.ndarray) -> bytes:
    height, width, _ = a.shape
    return b"P6\n%d %d\n255\n" % (width, height) + a.astype(np.uint8).tobytes()


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target pixel's area in the source, parts of pixels in proportion, from one integral image.

    The integral image has exact 64-bit sums; between its points it is linear.
    """
    a = a.reshape(a.shape[0], a.shape[1], -1)
    h, w = a.shape[:2]
    sums = np.zeros((h + 1, w + 1, a.shape[2]))
    sums[1:, 1:] = a.cumsum(0, dtype=np.int64 if a.dtype.kind in "ui" else np.float64).cumsum(1)

    def at(total: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), total.shape[axis] - 2)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(3)])
        return np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part

    grid = at(at(sums, np.linspace(0, h, height + 1), 0), np.linspace(0, w, width + 1), 1)
    return (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / (h * w / (height * width))


def difference_hash(a: np.ndarray, side: int = 8) -> str:
    """side * side bits in hex: whether each pixel of a (side, side + 1) grey copy is darker than the one right of it."""
    grey = area_resize(a, side, side + 1).mean(2)
    return np.packbits((grey[:, :-1] < grey[:, 1:] - 1e-9).ravel()).tobytes().hex()


def npy_tile(a: np.ndarray, side: int = 32) -> bytes:
    """A side by side copy of 8-bit samples in NPY form."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(a, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (a binary PPM whose samples are the text's UTF-8 bytes and blanks to full rows).

    A null text counts as empty and becomes one row of blanks. Other columns are not read. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def paint(batches):
        for batch in slices(batches, "text"):
            data = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            media = [encode_ppm(np.frombuffer(x.ljust(max(1, -(-len(x) // ROW_BYTES)) * ROW_BYTES, b" "), np.uint8).reshape(-1, ROW_BYTES // 3, 3)) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(paint, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", tile: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the keep columns, then payload_bytes, payload_sha256, tail_crc32 (of the samples as bytes, the
    last 16 for the crc), media_bytes, media_sha256, feature (difference hash), tile (NPY) and error. The hash and the tile
    are of samples scaled to a maximum of 255.

    Media that are null, empty, or no picture this module knows, have error set and null for all that needs the samples;
    the run goes on. Repeated rows are worked on each. Other columns are not read. An empty table gives an empty result.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def features(batches):
        for batch in slices(batches, "media"):
            out = []
            for data in batch.column("media").to_pylist():
                try:
                    if data is None:
                        raise MediaError("no media")
                    a, scaled = decode_scaled(data)
                    payload = a.tobytes()
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(scaled), npy_tile(scaled, tile), None))
                except MediaError as e:
                    size, digest = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                    out.append((None, None, None, size, digest, None, None, str(e)))
            columns = list(zip(*out)) or [()] * 8
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in keep), *map(pa.array, columns, types)], names=["id", *keep, *names])

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "error"]
    source = rows.select(F.col(id_col).alias("id"), *keep, F.col(media_col).alias("media"))
    schema = f"id {kind}{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string"
    return source.mapInArrow(features, schema).withColumnRenamed("id", id_col)


def write_tiles(features: DataFrame, path: str, id_col: str = "doc_id") -> str:
    """Write the NPY tiles of media_features as Parquet (id, tile); media with an error have none. Returns the path."""
    features.where("tile is not null").select(id_col, "tile").write.parquet(path)
    return path


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is stored as a picture in a table of the shared folder, read back and described."""
    media = stored(texts_as_media(documents(spark, sf_dir)), "media", compression="zstd")
    return media_features(media, keep=("n_bytes",)).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile", "error")
