"""Words of Arrow text columns as codes of a batch vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import give_back, mix64

#: Text of one step of work, in bytes; longer single texts are steps of their own.
STEP_BYTES = 3 << 20


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` of bounded size, so that memory follows neither batches nor partitions."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + step_bytes, side="right")))
        yield at, to
        at = to
    give_back()


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all words in a row, the offsets of each text in them, and the vocabulary.

    Words are runs of anything but ASCII white space, A-Z in lower case. Null
    texts have none.
    """
    # A copy, as the kernel for lower case misreads the offsets of some slices.
    own = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))
    split = pc.ascii_split_whitespace(pc.ascii_lower(own))
    offsets = np.asarray(split.offsets, dtype=np.int64)
    flat = split.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    kept = np.concatenate([[0], np.cumsum(full)])
    words = flat.filter(pa.array(full)).dictionary_encode()
    return np.asarray(words.indices, dtype=np.int64), kept[offsets - offsets[0]], words.dictionary.to_pylist()


def word_hashes(vocabulary: list[str]) -> np.ndarray:
    """A fixed 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words, from the words' hashes; position i holds words i to i+n-1."""
    length = len(words) - n + 1
    if length <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(length, dtype=np.uint64)
    for k in range(n):
        h = mix64(h + words[k : k + length] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
    return h
