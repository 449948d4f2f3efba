"""Array work of the suffix-array operator: sampled positions, suffix order, longest previous factors.

Everything here works on the bytes of texts laid end to end, and never lets a match run over a text's end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))


@functools.lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (ODD, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash's base and of its inverse, modulo 2**64."""
    return _powers(1 << max(n - 1, 1).bit_length())


class Hashes:
    """Prefix sums of a text's bytes times powers; the hash of any stretch follows from two of them."""

    def __init__(self, raw: np.ndarray):
        self.power, self.inverse = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * self.power[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def each(self, size: int) -> np.ndarray:
        """The hashes of all stretches of one size."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def sampled(h: np.ndarray, wide: int) -> np.ndarray:
    """For each `wide` neighbouring positions the leftmost of their least.

    h: hashes of k-mers, under 2**44, of fewer than 2**20 places. The choice in a window depends on what stands in it
    only, so that equal windows choose the same place in them.
    """
    n = len(h) - wide + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the least of each window: of the rest of its block of `wide`, and of the beginning of the next
    blocks = -(-len(h) // wide)
    top = np.full(blocks * wide, U(2**64 - 1))
    top[: len(h)] = (h << U(20)) | np.arange(len(h), dtype=np.uint64)
    table = top.reshape(blocks, wide)
    onward = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], onward[wide - 1 : wide - 1 + n]) & U(2**20 - 1)).astype(np.int64)


def slabs(texts: list[bytes], size: int, limit: int = 1 << 18) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text's number, place in it, bytes) of stretches that hold all windows of `size` bytes, each once, in lists of
    some `limit` bytes, so that memory doesn't depend on how long a text is."""
    held: list[tuple[int, int, bytes]] = []
    n = 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw) - size + 1, limit):
            held.append((i, at, raw[at : at + limit + size - 1]))
            n += len(held[-1][2])
            if n >= limit:
                yield held
                held, n = [], 0
    if held:
        yield held


def neighbourhoods(texts: list[bytes], size: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, h, text, place, low, high) of the anchors of all windows: the anchor's hash, the hash of the bytes its windows
    cover, the number of its text, its place there, and how far before it its last and its first window start."""
    for held in slabs(texts, size):
        lengths = np.array([len(x[2]) for x in held])
        raw = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        own = np.repeat(np.arange(len(held)), lengths)
        sums = Hashes(raw)
        each = sums.each(k)
        window = np.flatnonzero(own[: len(raw) - size + 1] == own[size - 1 :])  # those within one text
        place = sampled(each >> U(20), size - k + 1)[window]
        change = np.flatnonzero((place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)) + 1
        first = window[np.concatenate([[0], change])]
        last = window[np.concatenate([change - 1, [len(window) - 1]])]
        place = place[np.concatenate([[0], change])]
        low, high = place - last, place - first
        of = own[place]
        texts_of, at = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        base = np.cumsum(lengths) - lengths
        yield each[place], sums.of(first, last + size) ^ (high * 1024 + low).astype(np.uint64), texts_of[of], place - base[of] + at[of], low, high


def nearest(position: np.ndarray, lcp: np.ndarray, least: int, same: bool = False) -> np.ndarray:
    """Of suffixes in suffix order: the common prefix with the nearest one up the order whose position is smaller (with
    same: not smaller, for positions turned round), 0 where that is under `least`.

    lcp[i]: the common prefix of the suffixes i - 1 and i. All suffixes look up at once: one that meets a position that
    won't do goes on from where that one has got to, for all between them won't do either.
    """
    at = np.arange(len(position)) - 1
    common = lcp.copy()
    common[:1] = 0
    todo = np.flatnonzero(common >= least)
    while len(todo):
        there = position[at[todo]]
        go = todo[there > position[todo] if same else there >= position[todo]]
        further, through = at[at[go]], np.minimum(common[go], common[at[go]])
        at[go], common[go] = further, through
        todo = go[through >= least]
    common[common < least] = 0
    return common


def longest_factors(position: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in suffix order, by their positions in the text: the lengths of the longest match that starts earlier
    (the longest previous factor), and of the longest one that doesn't (the longest next factor).

    Both are with the nearest suffix, up or down the order, whose position is smaller, or isn't; lengths under `least`
    are given as 0.
    """
    turned = np.concatenate([[0], lcp[1:][::-1]])[: len(lcp)]
    previous = np.maximum(nearest(position, lcp, least), nearest(position[::-1], turned, least)[::-1])
    following = np.maximum(nearest(-position, lcp, least, True), nearest(-position[::-1], turned, least, True)[::-1])
    return previous, following


class Least:
    """The least of any stretch of an array, from those of stretches of lengths 2**i."""

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.int32)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.int32)
        level = np.frexp(last - first + 1)[1] - 1
        for x in np.unique(level):
            i = np.flatnonzero(level == x)
            out[i] = np.minimum(self.levels[x][first[i]], self.levels[x][last[i] - (1 << int(x)) + 1])
        return out


def factors(bucket: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, raw: np.ndarray, base: np.ndarray, size: int) -> np.ndarray:
    """kind[i, d]: whether the window of neighbourhood i that starts d bytes before its anchor has a longest previous
    factor of at least `size` (2), else a longest next one (1), or neither (0).

    Neighbourhoods i lie at base[i] of raw, from `high` bytes before their anchor to `size` after the window that starts
    `low` before it; those of a bucket share the anchor. Windows of a bucket can only be equal at the same distance from
    the anchor. What stands right of the anchors is put into suffix order by comparing bytes; the order of the suffixes
    that start one byte further left follows from it by that byte (induced sorting), and the common prefix of
    neighbours with as many bytes left of the anchor alike is that number and the least common prefix between them.
    rank: the order of the neighbourhoods' places in the input, equal for repeated rows.
    """
    n = len(bucket)
    start, right = base + high, size - low
    padded = np.concatenate([raw, np.zeros(size, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, size)[start]
    rows[np.arange(size) >= right[:, None]] = 0
    order = np.argsort(rows.view(f"S{size}").ravel(), kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    rows, bucket, rank, high, start, right = (x[order] for x in (rows, bucket, rank, high, start, right))
    differ = np.ones((n, size + 1), bool)
    differ[1:, :size] = rows[1:] != rows[:-1]
    lcp = differ.argmax(axis=1)
    lcp[1:] = np.where(bucket[1:] == bucket[:-1], np.minimum(lcp[1:], np.minimum(right[1:], right[:-1])), 0)
    lcp[:1] = 0
    del rows, differ
    least = Least(lcp)
    kind = np.zeros((n, int(high.max(initial=0)) + 1), np.uint8)
    at = np.arange(n)  # suffixes that start d bytes before the anchors, in suffix order
    opens = np.concatenate([[True], bucket[1:] != bucket[:-1]])  # not alike the one before in what stands left of the anchor
    for d in range(kind.shape[1]):
        inner = np.flatnonzero(~opens)
        common = np.zeros(len(at), np.int64)
        common[inner] = d + least.of(at[inner - 1] + 1, at[inner])
        hit = common >= size
        if hit.any():
            some = np.flatnonzero(hit | np.append(hit[1:], False))
            previous, following = longest_factors(rank[at[some]], np.where(hit[some], common[some], 0), size)
            kind[at[some], d] = np.where(previous >= size, 2, following >= size)
        group = np.cumsum(opens)
        on = high[at] > d
        at, group = at[on], group[on]
        key = bucket[at] * 256 + raw[start[at] - d - 1]
        order_here = np.argsort(key, kind="stable")
        at, group, key = at[order_here], group[order_here], key[order_here]
        opens = np.ones(len(at), bool)
        opens[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        alone = opens & np.append(opens[1:], True)
        at, opens = at[~alone], opens[~alone]
        if not len(at):
            break
    out = np.empty_like(kind)
    out[order] = kind
    return out


def stretches(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance of the first, of the last, kind) of the runs of windows of one kind but 0, by row and place."""
    n, wide = kind.shape
    padded = np.zeros((n, wide + 2), np.uint8)
    padded[:, 1:-1] = kind[:, ::-1]  # by place: the furthest from the anchor comes first
    row, column = np.nonzero(padded[:, 1:] != padded[:, :-1])
    value = padded[row, column + 1]
    some = np.flatnonzero(value)
    return row[some], wide - 1 - column[some], wide - column[some + 1], value[some]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of the maximal runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))
