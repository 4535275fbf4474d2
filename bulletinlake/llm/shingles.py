"""Word and shingle helpers shared by the text operators (numpy inside tasks only)."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is the rule wanted.
    A null text has no words. Lone surrogates can't reach here: Arrow strings are UTF-8.
    """
    return (text or "").encode("utf-8").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included, words joined by one space.

    Fewer than k words: one shingle of all of them; none: empty.
    """
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= k:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([h(line[a:b], SEED) for a, b in spans], np.uint64)
