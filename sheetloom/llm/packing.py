"""Packing of token sequences by minimum bin slack.

`place` fills one window after the other. A window starts with the longest piece left; a subset-sum dynamic
program over a bitset (an integer whose bit s says that a fill of s can be reached) then finds which of the
remaining lengths fill the rest most closely, and walking back through the bitsets gives how often each length
is used. Lengths are offered from the longest, and the program ends as soon as the window is full, so that short
pieces stay for later windows. What was found is used again for as many windows as the counts allow.

Over a cluster, pieces are dealt into shards by a hash of their key and start, which no key can make uneven, and
every shard is packed by itself; a shard holds a fixed number of pieces on average, whatever the input's size, and
leaves one window or two half empty. Nulls count as empty texts, which have one piece, the closing id. Texts of any
length are cut into whole windows and a rest. Repeated rows are packed as often as they occur.
Columns other than doc_id and text aren't looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, PLAIN, byte_letters
from .shared import only

CAPACITY, END_ID = 2048, 1
#: Pieces that are packed together, on average.
SHARD = 12_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Ids:
    """A tokenizer's ids: by the tiktoken library's merges where every library cuts a text alike, else by tokenizers."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, self.path, self.full = byte_letters(), path, None
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.plain = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> np.ndarray:
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not PLAIN.search(text):
            return self.plain.encode_to_numpy(text, allowed_special="all").astype("<u4")
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
            self.full.no_padding()
            self.full.no_truncation()
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")


_LOADED: dict[str, Ids] = {}


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each whole window of a document's ids and for the rest: doc_id, start, length, ids_crc32, doc_tokens."""
    source = only(docs, doc_id="long", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Ids(path)
        ids_of = _LOADED[path].of
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(ids) // 4
                rows += [(doc, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split(" ")[0] for x in PIECES.split(", ")])

    return source.mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length, at most as often as it is there, so that the sum comes closest to room from below."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
            if reach & full:
                break
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= length * times
    return used


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, by its length, its window (from 0, without gaps) and its place there."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("a piece must have from 1 to capacity tokens")
    order = np.argsort(lengths, kind="stable")
    values, first, number = np.unique(lengths[order], return_index=True, return_counts=True)
    counts = dict(zip(values.tolist(), number.tolist(), strict=True))
    next_of = dict(zip(values.tolist(), first.tolist(), strict=True))
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            used = fill(counts, capacity - longest)
            counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(counts[x] // n for x, n in used.items())
            at = 0
            for x in sorted(used, reverse=True):
                n = used[x]
                rows = order[next_of[x] : next_of[x] + n * times]
                window[rows] = made + np.repeat(np.arange(times), n)
                offset[rows] = at + x * np.tile(np.arange(n), times)
                next_of[x] += n * times
                counts[x] -= n * times
                at += n * x
            made += times
    return window, offset


def packed(pieces: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; sequence ids are unique, those of a shard stand together."""
    names = pieces.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(names, kind="stable")
        window, offset = place(group["length"].to_numpy(), capacity)
        return group[names].assign(sequence_id=group["shard"].to_numpy() * 2**32 + window, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(1, shards))))
    return dealt.groupBy("shard").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    shards = -(-docs.count() // SHARD)
    return packed(pieces_of(docs, path, capacity, end_id), shards, capacity)
