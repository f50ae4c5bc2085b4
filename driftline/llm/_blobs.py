"""Packing of number arrays for shuffles: a row holds what one chunk of input sends to one bucket."""

from __future__ import annotations

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each as the smallest unsigned type that holds it."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
        out += [np.array([np.dtype(kind).itemsize, len(a)], dtype=np.int64).tobytes(), a.astype(kind).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        width, n = np.frombuffer(data, dtype=np.int64, count=2, offset=at)
        at += 16
        out.append(np.frombuffer(data, dtype=f"u{width}", count=n, offset=at))
        at += int(width * n)
    return out


def zigzag(a: np.ndarray) -> np.ndarray:
    """Signed to unsigned, small to small."""
    return ((a << 1) ^ (a >> 63)).view(np.uint64)


def unzigzag(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint64)
    return ((a >> np.uint64(1)) ^ (np.uint64(0) - (a & np.uint64(1)))).view(np.int64)


def pack_ids(ids: np.ndarray) -> np.ndarray:
    """Ids as zigzag differences."""
    return zigzag(np.diff(ids, prepend=np.int64(0)))


def unpack_ids(a: np.ndarray) -> np.ndarray:
    return np.cumsum(unzigzag(a), dtype=np.int64)


def hash_bytes(h: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of hashes, as one byte array."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def bytes_hash(a: np.ndarray, width: int) -> np.ndarray:
    full = np.zeros((len(a) // width, 8), dtype=np.uint8)
    full[:, :width] = a.reshape(-1, width)
    return full.view("<u8").reshape(-1)
