"""Words, shingles and their hashes on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from xxhash import xxh64_intdigest


def lower_words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at the six white-space bytes; null: none. bytes.lower and split do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(items: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, items, repeat(seed)), np.uint64, len(items))


def shingle_hashes(words: list[bytes], n: int, seed: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of the n-word shingles, repeats included, in blocks; fewer words: of the whole sequence; none: nothing."""
    if not words:
        return
    if len(words) < n:
        yield hashes([b" ".join(words)], seed)
        return
    for i in range(0, len(words) - n + 1, block):
        part = words[i : i + block + n - 1]
        yield hashes(list(map(b" ".join, zip(*[part[k:] for k in range(n)]))), seed)
