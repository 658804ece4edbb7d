"""Hashes of word shingles and their SimHash fingerprint."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
SHINGLE = 3


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles of a text in UTF-8, in order, repeats included; none if it has no word."""
    words = data.lower().split()  # bytes: A to Z only, and the six white space characters only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((h(view[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of shingle hashes; zero if there are none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))
