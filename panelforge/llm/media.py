"""Media columns: Netpbm and BMP pictures decoded to arrays, area-resized, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import stage

#: Payloads are padded to whole squares of this many bytes (24 x 24 samples).
SIDE = 24
UNIT = SIDE * SIDE
#: Pictures that travel between Spark and Python together.
ROWS = 512

TILE_SCHEMA = "height int, width int, channels int, tile_npy binary, dhash string"


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary PGM (8 bits a sample) of a 2-d uint8 array."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, rows bottom-up and padded to four bytes."""
    h, w = samples.shape
    row = -(-w // 4) * 4
    rows = np.zeros((h, row), np.uint8)
    rows[:, :w] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    grey[:, 3] = 0
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + grey.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, fields, at = data[1:2], [], 2
    need = 2 if kind in b"14" else 3
    while len(fields) < need:  # header fields, with comments between them
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields[0], fields[1], (fields[2] if need == 3 else 1)
    if not 0 < top < 65536 or w < 1 or h < 1:
        raise ValueError("bad header")
    bands = 3 if kind in b"36" else 1
    n = w * h * bands
    if kind in b"123":
        text = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        a = np.array(list(b"".join(text.split())[:n]) if kind == b"1" else text.split()[:n], dtype=np.int64)
        a = a - 48 if kind == b"1" else a
    elif kind == b"4":
        row = -(-w // 8)
        a = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        a = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if a.size != n:
        raise ValueError("too few samples")
    if kind in b"14":
        a = 255 * (1 - a.astype(np.int64))  # 1 is black
    elif top != 255:
        a = (a.astype(np.int64) * 255 + top // 2) // top
    return np.ascontiguousarray(a, dtype=np.uint8).reshape((h, w, 3) if bands == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    at, size, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed or bits not in (1, 4, 8, 24, 32) or w < 1 or h == 0:
        raise ValueError("bad header")
    n = abs(h)
    row = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, row * n, at).reshape(n, row)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(n, w, bits // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    index = rows
    if bits < 8:
        index = np.unpackbits(rows, axis=1).reshape(n, -1, bits)
        index = (index << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    index = index[:, :w]
    grey = (palette == palette[:, :1]).all()
    return np.ascontiguousarray(palette[:, 0][index] if grey else palette[index])


def decode(data: bytes) -> np.ndarray:
    """Picture as (height, width) or (height, width, 3) uint8; ValueError if it is neither Netpbm nor plain BMP."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, ValueError, OverflowError) as e:
        raise ValueError(f"undecodable picture: {e}") from None
    raise ValueError("unknown format")


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average of each target cell, fractional edges included, from one integral image (float64) read between its entries at the cells' corners."""
    h, w = a.shape[:2]
    total = np.zeros((h + 1, w + 1, *a.shape[2:]))
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def corners(x: np.ndarray, n: int) -> np.ndarray:
        """x, along its first axis, at n + 1 places spread evenly over it."""
        edges = np.arange(n + 1) * ((len(x) - 1) / n)
        low = np.minimum(edges.astype(np.int64), len(x) - 1)
        part = (edges - low).reshape(-1, *[1] * (x.ndim - 1))
        return x[low] + part * (x[np.minimum(low + 1, len(x) - 1)] - x[low])

    at = corners(corners(total, height).swapaxes(0, 1), width).swapaxes(0, 1)
    return np.diff(np.diff(at, axis=0), axis=1) * (height * width / (h * w))


def dhash(a: np.ndarray) -> str:
    """64-bit difference hash: is each cell of the 8 x 9 grey picture darker than its right neighbour?"""
    grey = a @ np.array([0.299, 0.587, 0.114]) if a.ndim == 3 else a
    small = np.rint(area_resize(grey, 8, 9) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def tile(a: np.ndarray, side: int = SIDE) -> bytes:
    """NPY bytes of the picture area-resized to side x side."""
    return npy(np.rint(area_resize(a, side, side)).astype(np.uint8))


def media_tiles(df: DataFrame, media: str, side: int = SIDE, samples: bool = False) -> DataFrame:
    """df with height, width, channels, tile_npy (side x side, NPY) and dhash of the pictures in a binary column.

    samples: also the decoded samples themselves, row by row, as binary. Null, empty and undecodable media give
    nulls in all of these. Columns of these names are replaced. Rows are independent: nothing is shuffled, repeated
    rows give repeated results, an empty table none. A task holds one batch of pictures and, of the one at work, a
    few float64 copies; pictures of any size up to that are decoded and resized in whole.
    """
    names = ["height", "width", "channels", "tile_npy", "dhash"] + ["samples"] * samples
    df = df.drop(*[c for c in names if c != media])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + TILE_SCHEMA + ", samples binary" * samples
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()] + [pa.binary()] * samples

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                out = []
                for x in b.column(b.schema.get_field_index(media)):
                    try:
                        a = decode(x.as_py() or b"")
                        out.append((a.shape[0], a.shape[1], 3 if a.ndim == 3 else 1, tile(a, side), dhash(a), *[a.tobytes()] * samples))
                    except ValueError:
                        out.append((None,) * len(names))
                columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(b.columns + columns, names=b.schema.names + names)

    return df.mapInArrow(run, schema)


def encode_text(text: str | None) -> bytes:
    """A text as a picture: its UTF-8 bytes, padded with 255, 24 samples a row; PGM or BMP by the content's CRC."""
    data = (text or "").encode("utf-8", "surrogatepass")
    payload = data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    return encode_bmp(samples) if zlib.crc32(payload) & 1 else encode_pgm(samples)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of docs (doc_id, text): each whole text as a picture. Null texts are empty."""

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([encode_text(t.as_py()) for t in b.column(2)], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def op3_media_tiles(spark, sf_dir: str) -> DataFrame:
    """Every document's whole text stored as a picture, read back from its table, tiled and described.

    Two tables are written to the shared folder: the pictures, and their tiles as NPY with hashes. The result is
    read from the second. Null and empty texts are a picture of padding; repeated rows repeat; empty tables give
    none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = stage(text_media(docs), "media", compression="zstd")
    tiles = media_tiles(stored, "media", samples=True).select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.col("dhash").alias("feature"), F.when(F.substring("media", 1, 2) == F.lit(b"BM"), "bmp").otherwise("pgm").alias("media_format"), "height", "width", "tile_npy",
    )
    tiles = stage(tiles, "tiles", compression="zstd")
    return tiles.select(*[c for c in tiles.columns if c not in ("height", "width", "tile_npy")], F.sha2("tile_npy", 256).alias("tile_sha256"))
