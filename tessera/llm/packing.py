"""Arrays of unsigned integers as compressed bytes."""

from __future__ import annotations

import numpy as np
import zstandard


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned integers, their bytes by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def expand(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return raw.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.uint64), dtype=np.uint64)
