"""Integer arrays as one compressed binary value: each in the narrowest width, byte planes apart."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_KINDS = [np.dtype(f"<i{w}") for w in (1, 2, 4, 8)]


def pack(*arrays: np.ndarray) -> bytes:
    """Signed 64-bit integer arrays of any lengths."""
    parts = [struct.pack("<I", len(arrays))]
    for array in arrays:
        low, high = (int(array.min()), int(array.max())) if len(array) else (0, 0)
        width = next(i for i, kind in enumerate(_KINDS) if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max)
        narrow = np.ascontiguousarray(array, dtype=_KINDS[width])
        parts += [struct.pack("<BQ", width, len(array)), narrow.view(np.uint8).reshape(len(array), 1 << width).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, narrow: bool = False) -> list[np.ndarray]:
    """The arrays, as 64-bit integers or in the widths they were stored in."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    (count,), at, arrays = struct.unpack_from("<I", raw), 4, []
    for _ in range(count):
        width, n = struct.unpack_from("<BQ", raw, at)
        at += 9
        planes = np.frombuffer(raw, np.uint8, n << width, at).reshape(1 << width, n)
        array = np.ascontiguousarray(planes.T).reshape(-1).view(_KINDS[width])
        arrays.append(array if narrow else array.astype(np.int64))
        at += n << width
    return arrays
