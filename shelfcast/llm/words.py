"""Word and shingle hashes of a batch of texts, as NumPy arrays over all its bytes at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

SLICE_BYTES = 1_000_000  # texts hashed at once; a longer text makes a slice of its own
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word in order: the position of its text, and its hash. Words are the longest runs of
    letters, digits and characters beyond ASCII, in lower case."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    buffer = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = _IN_WORD[buffer]
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    up, down = _powers(1 << int(len(buffer) + 1).bit_length())
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=total[1:])
    hashes = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    first = 1 + np.cumsum([0, *(len(r) + 1 for r in raw[:-1])]) if raw else np.zeros(0, np.int64)
    return np.searchsorted(first, begin, side="right") - 1, hashes


def shingle_hashes(owner: np.ndarray, words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of `size` words of a text, with its text. A text of fewer words has one
    shingle, all of them; a text without words has none."""
    n = len(words)
    if not n:
        return owner, words
    padded_owner = np.r_[owner, np.full(size, -1)]
    padded = np.r_[words, np.zeros(size, np.uint64)]
    value = np.zeros(n, np.uint64)
    for k in range(size):
        same = padded_owner[k : k + n] == owner
        value = value * np.uint64(_BASE) + np.where(same, padded[k : k + n], np.uint64(0))
    whole = padded_owner[size - 1 : size - 1 + n] == owner
    first = np.r_[True, owner[1:] != owner[:-1]]
    count = np.bincount(owner)
    use = whole | (first & (count[owner] < size))
    return owner[use], mixed(value[use])


def counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often each occurs: text, hash, count."""
    by = np.argsort(hashes, kind="stable")
    by = by[np.argsort(owner[by], kind="stable")]
    owner, hashes = owner[by], hashes[by]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]) if len(owner) else np.zeros(0, int)
    return owner[new], hashes[new], np.diff(np.r_[new, len(owner)])


def sliced(frames: Iterator[pd.DataFrame], column: str, most_rows: int = 1024) -> Iterator[pd.DataFrame]:
    """Runs of rows of about SLICE_BYTES characters and `most_rows` rows at most."""
    for frame in frames:
        ends = frame[column].str.len().fillna(0).cumsum() // SLICE_BYTES
        for _, part in frame.groupby(ends, sort=False):
            for at in range(0, len(part), most_rows):
                yield part.iloc[at : at + most_rows]
