"""Blocks of vectors as compact binaries.

A shuffle of single vectors pays for every row header and compresses badly.
Many vectors travel as one binary instead: bytes of equal significance are
laid side by side and compressed with zstd, without loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_codec = None


def _zstd() -> pa.Codec:
    global _codec
    if _codec is None:
        _codec = pa.Codec("zstd", compression_level=1)
    return _codec


def pack(values: np.ndarray) -> bytes:
    """Binary of a one- or two-dimensional array; see :func:`unpack`."""
    values = np.ascontiguousarray(values)
    planes = values.reshape(-1).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return bytes(_zstd().compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)) if values.size else b""


def unpack(data: bytes, dtype, count: int) -> np.ndarray:
    """The ``count`` values that :func:`pack` took."""
    dtype = np.dtype(dtype)
    if not count:
        return np.empty(0, dtype)
    raw = np.frombuffer(_zstd().decompress(data, decompressed_size=count * dtype.itemsize), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, count).T).view(dtype).reshape(-1)


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and float32 matrix of the usable vectors in a list column.

    Usable: exactly ``dim`` finite numbers, not all zero. Everything else
    (null, wrong length, null or non-finite members, zero vectors) is left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    valid = np.asarray(column.is_valid())
    offsets = np.asarray(column.offsets)
    right = valid & (np.diff(offsets) == dim)
    rows = np.nonzero(right)[0]
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    values = column.values
    flat = np.asarray(values.cast(pa.float32()).fill_null(float("nan")) if values.null_count else values.cast(pa.float32()), dtype=np.float32)
    if len(rows) == len(column):
        matrix = flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    else:
        matrix = flat[offsets[rows][:, None] + np.arange(dim)]
    good = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
    return rows[good], matrix[good]


def unit(matrix: np.ndarray, dtype=np.float32) -> np.ndarray:
    """Rows scaled to length one, computed in float64 so that no scale overflows."""
    wide = matrix.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    wide /= np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
    return wide.astype(dtype, copy=False)
