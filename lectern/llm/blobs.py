"""Arrays of numbers as compressed bytes, to be shuffled as one value each."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Byte planes under zstandard."""
    import zstandard

    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers, by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def dealt(shard: np.ndarray):
    """Each shard that occurs and the places it occurs at, in order."""
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    for s, places in zip(names.tolist(), np.split(order, first[1:]), strict=True):
        yield s, places
