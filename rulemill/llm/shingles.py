"""Word shingles of texts, and fingerprints of them: what near-dedup works on."""

from __future__ import annotations

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at a time.
_STEP = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles, in order, repeats included; the whole text if it has fewer words."""
    import xxhash

    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), "<u8", n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        counts += np.unpackbits(hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])
