"""Likeness of all pairs of two lists of texts, for many lists at once, in arrays: what a pair costs is a few bytes' worth
of vector instructions, and pairs that are equally alike are given out together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are looked at together, so that their arrays stay in the processor's cache.
BLOCK = 1 << 16
FAR = 5


def edits(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Levenshtein distances: a and b have an array for each character, of all pairs."""
    n, kind = len(a[0]), np.uint8 if max(len(a), len(b)) < 255 else np.uint32
    above = [np.full(n, j, kind) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        corner, above[0] = above[0], np.full(n, i, kind)
        for j, y in enumerate(b, 1):
            least = np.minimum(above[j], above[j - 1])
            least += 1
            np.minimum(least, corner + (x != y), out=least)
            corner, above[j] = above[j], least
    return above[-1]


def within(short: list[np.ndarray], long: list[np.ndarray]) -> np.ndarray:
    """Whether the one text is somewhere in the other."""
    found = np.zeros(len(long[0]), bool)
    for o in range(len(long) - len(short) + 1):
        here = np.ones(len(found), bool)
        for k, x in enumerate(short):
            here &= x == long[o + k]
        found |= here
    return found


class Texts:
    """Texts of a batch as numbers: each text's length and where its characters begin."""

    def __init__(self, *columns: pa.Array) -> None:
        every = pa.concat_arrays([c.cast(pa.string()).fill_null("") for c in columns])
        offsets, data = np.frombuffer(every.buffers()[1], np.int32)[: len(every) + 1].astype(np.int64), every.buffers()[2]
        letters = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        if len(letters) and letters.max() > 127:
            length = pc.utf8_length(every).to_numpy().astype(np.int64)
            offsets = np.append(0, np.cumsum(length))
            known, letters = np.unique(np.frombuffer("".join(every.to_pylist()).encode("utf-32-le"), np.uint32), return_inverse=True)
            letters = letters.astype(np.uint8 if len(known) <= 256 else np.uint32)
        self.letters = np.append(letters, np.zeros(1, letters.dtype))
        ends = np.cumsum([len(c) for c in columns])[:-1]
        self.lengths, self.starts = np.split(np.diff(offsets), ends), np.split(offsets[:-1], ends)

    def characters(self, column: int, of: slice, length: int, pairs: np.ndarray) -> list[np.ndarray]:
        start, last = self.starts[column][of], len(self.letters) - 1
        return [self.letters[np.minimum(start + k, last)][pairs] for k in range(length)]


def alike(texts: Texts, left: slice, right: slice, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[float | None]]:
    """Of pairs i, j of texts of both columns a number, and what likeness from 0 to 1 each number is: as `similarity.likeness`
    a hundredth of it; none where a text is empty."""
    out, values = np.zeros(len(i), np.int64), [None]
    a, b = texts.lengths[0][left], texts.lengths[1][right]
    lengths = [(x, y) for x in np.unique(a).tolist() for y in np.unique(b).tolist()]
    for x, y in lengths:
        if not x or not y:
            continue
        some = slice(None) if len(lengths) == 1 else np.flatnonzero((a[i] == x) & (b[j] == y))
        first, second = texts.characters(0, left, x, i[some]), texts.characters(1, right, y, j[some])
        longest = max(x, y)
        number = edits(first, second).astype(np.int64) if abs(x - y) <= FAR else np.full(len(first[0]), longest)
        if x != y:
            number[within(*sorted((first, second), key=len))] = longest + 1
        out[some] = number + len(values)
        values += [100.0 * (1 - d / longest) / 100.0 if d < longest else 0.0 for d in range(longest + 1)] + [0.8]
    return out, values


def flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def grouped(kept: pa.RecordBatch, where: np.ndarray, lists: list[pa.Array], likeness: np.ndarray, values: list[float | None], schema: pa.Schema) -> pa.RecordBatch:
    """A row for each run of equal `where` and `likeness`, with its part of the lists."""
    begin = np.flatnonzero(np.diff(where, prepend=-1) | np.diff(likeness, prepend=-1))
    offsets = pa.array(np.append(begin, len(where)).astype(np.int32))
    columns = kept.take(pa.array(where[begin])).columns
    columns.append(pa.array([values[x] for x in likeness[begin].tolist()], pa.float64()))
    columns += [pa.ListArray.from_arrays(offsets, x) for x in lists]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def met(left: tuple[str, str], right: tuple[str, str], counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow. left and right: columns of ids and of their texts, lists as long as each other, ids of the right in order.
    For each row and each likeness that pairs of its lists have, a row: all other columns, the likeness, and as lists the ids of
    the pairs' both sides; or, if they are counted, each left id that has such pairs, how many, and the first of its right ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (lo, ids), (ro, others) = flat(batch.column(left[0])), flat(batch.column(right[0]))
            texts = Texts(flat(batch.column(left[1]))[1], flat(batch.column(right[1]))[1])
            kept = batch.select([c for c in batch.schema.names if c not in (*left, *right)])
            fields = [*kept.schema, pa.field("likeness", pa.float64()), pa.field("ids", pa.list_(ids.type)), *[pa.field("n", pa.list_(pa.int64()))] * counted, pa.field("others", pa.list_(others.type))]
            done, upto = np.cumsum(np.diff(lo) * np.diff(ro)), 0
            while upto < batch.num_rows:
                begin, before = upto, done[upto - 1] if upto else 0
                upto = max(begin + 1, int(np.searchsorted(done, before + BLOCK, "right")))
                if done[upto - 1] > before:
                    yield block(begin, upto, lo, ro, ids, others, texts, kept, pa.schema(fields))

    def block(begin: int, end: int, lo: np.ndarray, ro: np.ndarray, ids: pa.Array, others: pa.Array, texts: Texts, kept: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        first, second = slice(lo[begin], lo[end]), slice(ro[begin], ro[end])
        row = np.repeat(np.arange(begin, end), np.diff(lo[begin : end + 1]))  # of each left text
        width = np.diff(ro)[row]
        i = np.repeat(np.arange(len(row)), width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width - (ro[row] - ro[begin]), width)
        number, values = alike(texts, first, second, i, j)
        if counted:
            key = i * len(values) + number
            n = np.bincount(key, minlength=len(row) * len(values))
            least = np.zeros(len(n), np.int64)
            least[key[::-1]] = j[::-1]  # of equal keys the last, so the least, stays
            found = np.flatnonzero(n)
            n, j, i, number = n[found], least[found], found // len(values), found % len(values)
        order = (row[i] - begin) * len(values) + number
        order = np.argsort(order.astype(np.uint16) if (end - begin) * len(values) < 1 << 16 else order, kind="stable")
        i, j, number = i[order], j[order], number[order]
        lists = [ids.take(pa.array(i + lo[begin])), *[pa.array(n[order])] * 1] if counted else [ids.take(pa.array(i + lo[begin]))]
        return grouped(kept, row[i], [*lists, others.take(pa.array(j + ro[begin]))], number, values, schema)

    return run
