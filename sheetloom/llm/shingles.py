"""Sets of word shingles as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import numpy as np

from .suffix_core import Hashes, mixed

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles, ascending, text after text, and where each text's begin (and the end).

    Words are what stands between spaces and the characters U+0009 to U+000D, A-Z in lower case. A text of fewer words
    than a shingle has the whole sequence as its only one; a text without words has none.
    """
    raw = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    word = Hashes(LOWER[raw]).of(starts, stops)
    of = np.searchsorted(ends, starts, side="right")
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    hashes, owner = [], []
    for count in range(1, words + 1):  # texts with exactly `count` words, or at least that many if it is the full shingle
        if count == words:
            at = np.flatnonzero(np.arange(len(word)) + count <= (first + n)[of])
        else:
            at = first[n == count]
        if not len(at):
            continue
        h = np.full(len(at), U(count))
        for k in range(count):
            h = mixed(h * U(0x9E3779B97F4A7C15) + word[at + k])
        hashes.append(h)
        owner.append(of[at])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, of = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))
