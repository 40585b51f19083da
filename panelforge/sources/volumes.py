"""NIfTI-1 and MGH volumes (plain or gzipped) as rows: shape, voxel-to-world matrix, values; and their writers."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.contracts import ContractError

#: Type codes of the two formats.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
MGH_TYPES = {0: ">u1", 1: ">i4", 3: ">f4", 4: ">i2"}
VOLUME = "path string, format string, shape array<int>, affine array<double>, values array<double>"


def encode_nifti(values: np.ndarray, affine: np.ndarray, packed: bool = True) -> bytes:
    """Single-file NIfTI-1 of an array, with the affine as its sform."""
    kind = next(k for k, t in NIFTI_TYPES.items() if np.dtype(t) == values.dtype)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, kind, values.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), *[1] * 4)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    data = bytes(head) + values.tobytes(order="F")
    return gzip.compress(data, 1, mtime=0) if packed else data


def encode_mgh(values: np.ndarray, affine: np.ndarray, packed: bool = True) -> bytes:
    """MGH of an array; its header keeps sizes, direction cosines and the world position of the grid's middle."""
    kind = next(k for k, t in MGH_TYPES.items() if np.dtype(t) == values.dtype.newbyteorder(">"))
    size = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
    middle = affine[:3, :3] @ (np.array(values.shape[:3]) / 2) + affine[:3, 3]
    frames = values.shape[3] if values.ndim == 4 else 1
    head = struct.pack(">7ih", 1, *values.shape[:3], frames, kind, 0, 1) + struct.pack(">15f", *size, *(affine[:3, :3] / size).T.ravel(), *middle)
    data = head.ljust(284, b"\0") + values.astype(values.dtype.newbyteorder(">")).tobytes(order="F")
    return gzip.compress(data, 1, mtime=0) if packed else data


def decode(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """(format, values, 4 x 4 affine) of a volume file's bytes; ValueError if it is neither format or cut short."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    try:
        for order in "<>":
            if data[344:347] in (b"n+1", b"ni1") and struct.unpack_from(f"{order}i", data)[0] == 348:
                return "nifti", *_nifti(data, order)
        if struct.unpack_from(">i", data)[0] == 1:
            return "mgh", *_mgh(data)
    except (struct.error, KeyError) as e:
        raise ValueError(f"undecodable volume: {e}") from None
    raise ValueError("neither NIfTI-1 nor MGH")


def _array(data: bytes, kind: str, shape: list[int], at: int) -> np.ndarray:
    return np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape, order="F")


def _nifti(data: bytes, order: str) -> tuple[np.ndarray, np.ndarray]:
    dims = struct.unpack_from(f"{order}8h", data, 40)
    values = _array(data, order + NIFTI_TYPES[struct.unpack_from(f"{order}h", data, 70)[0]], list(dims[1 : dims[0] + 1]), int(struct.unpack_from(f"{order}f", data, 108)[0]))
    slope, inter = struct.unpack_from(f"{order}2f", data, 112)
    if slope not in (0.0, 1.0) or (slope == 1.0 and inter):
        values = values * np.float64(slope) + inter
    affine = np.eye(4)
    if struct.unpack_from(f"{order}h", data, 254)[0]:
        affine[:3] = np.reshape(struct.unpack_from(f"{order}12f", data, 280), (3, 4))
    else:
        affine[[0, 1, 2], [0, 1, 2]] = struct.unpack_from(f"{order}3f", data, 80)
    return values, affine


def _mgh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x, y, z, frames, kind, _, good = struct.unpack_from(">6ih", data, 4)
    values = _array(data, MGH_TYPES[kind], [x, y, z] if frames == 1 else [x, y, z, frames], 284)
    affine = np.eye(4)
    if good:
        numbers = np.array(struct.unpack_from(">15f", data, 30), float)
        affine[:3, :3] = numbers[3:12].reshape(3, 3).T * numbers[:3]
        affine[:3, 3] = numbers[12:]
        affine[:3, 3] -= affine[:3, :3] @ (np.array([x, y, z]) / 2)
    return values, affine


def volumes(files: DataFrame) -> DataFrame:
    """(path, format, shape, affine, values) of volume files (path, content), values row-major; a file that can't be decoded raises."""

    def run(parts):
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                kind, values, affine = decode(content)
                out.append((path, kind, list(values.shape), affine.ravel().tolist(), values.astype(np.float64).ravel().tolist()))
            yield pd.DataFrame(out, columns=["path", "format", "shape", "affine", "values"])

    return files.select("path", "content").mapInPandas(run, VOLUME)


def gate_report(scans: DataFrame) -> DataFrame:
    """(path, n_dims, n_fractional, is_label_volume) of volumes: label volumes have three axes and whole numbers only."""
    broken = F.size(F.filter("values", lambda v: F.isnan(v) | (v != F.floor(v))))
    return scans.select("path", F.size("shape").alias("n_dims"), broken.alias("n_fractional"), ((F.size("shape") == 3) & (broken == 0)).alias("is_label_volume"))


def label_volumes(scans: DataFrame) -> DataFrame:
    """The volumes with labels (array<int>) for values; raises unless all are label volumes."""
    bad = [r.path for r in gate_report(scans).where("NOT is_label_volume").select("path").orderBy("path").limit(5).collect()]
    if bad:
        raise ContractError(f"not three-dimensional label volumes: {', '.join(bad)}")
    return scans.withColumn("labels", F.col("values").cast("array<int>")).drop("values")
