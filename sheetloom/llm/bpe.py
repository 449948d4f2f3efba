"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut where the pre-tokenizer always cuts; each distinct piece is encoded once for a while and
remembered. The merges of a piece are found by a segment tree whose leaf i holds the rank of the pair that
starts at symbol i (joined with i, so that equal ranks order from the left) and whose root therefore names
the leftmost pair of lowest rank. A merge changes three leaves, each followed by a logarithmic walk to the
root; when the root holds no rank, nothing can be merged. Short pieces go through as many trees side by side
as numpy arrays, long ones through a tree of their own, so that a piece of n bytes takes O(n log n).

Nulls count as empty texts, which have no ids; a text may be of any length. Repeated rows give repeated
results.
Columns other than doc_id and text aren't looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import only, slices

#: The tokenizer's published pre-tokenization pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of at most so many bytes are encoded side by side.
WIDE = 64
#: So many remembered chunks per worker at most, and characters looked at together.
REMEMBERED, TOGETHER = 500_000, 4_000_000
NONE = np.int32(2**31 - 1)
#: Every character of a text is below this point in the plain way; there the classes of all libraries agree.
PLAIN = regex.compile("[^\x00-\x1b\x20-ɏ]")
ODD_SPACES = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class PairRanks:
    """Ranks of pairs of ids, for arrays of them: buckets of four under a multiplicative hash."""

    BITS = 17

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        for odd in range(0x9E3779B97F4A7C15, 2**64, 2 * 0x1234567):
            self.odd = np.uint64(odd)
            at = self.bucket(keys)
            order = np.argsort(at, kind="stable")
            nth = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            if not len(at) or nth.max() < 4:
                break
        self.keys = np.full((1 << self.BITS, 4), np.uint64(2**64 - 1))
        self.ranks = np.full((1 << self.BITS, 4), NONE)
        self.keys[at[order], nth] = keys[order]
        self.ranks[at[order], nth] = order

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.odd) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids below 0 stand for no symbol; such pairs, as those without a merge, have the rank NONE."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        at = self.bucket(keys)
        out = np.where(self.keys[at] == keys[:, None], self.ranks[at], NONE).min(axis=1)
        out[(left < 0) | (right < 0)] = NONE
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = PairRanks(self.left, self.right)
        self.rank_of = {(a, b): i for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))}
        self.first = np.full(256, -1, np.int32)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.digits = [str(i) for i in range(size)]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretoken = regex.compile(PATTERN)
        self.slow: object = None
        self.path = path
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    # -- merges ---------------------------------------------------------------------------------------------

    def merge_wide(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit numbers, of pieces of at most WIDE bytes each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        width = 2
        while width <= WIDE:
            rows = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            for at in range(0, len(rows), 20_000):
                self.merge_block([pieces[i] for i in rows[at : at + 20_000]], rows[at : at + 20_000], width, out)
            width *= 2
        return out

    def merge_block(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width + 2), -1, np.int32)  # column width: after the last; width + 1: before the first
        ids[:, :width] = np.where(np.arange(width) < sizes[:, None], self.first[raw], -1)
        after = np.tile(np.arange(1, width + 3, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int64), (n, 1))
        before[:, 0] = width + 1
        after[:, width - 1] = width
        tree = np.full((n, 2 * width), NONE)
        live = np.flatnonzero(sizes > 1)
        ranks = self.ranks.of(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(ranks != NONE, ranks * width + np.arange(width - 1, dtype=np.int32), NONE)
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        flat, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        wide, deep = width + 2, 2 * width

        def put(leaf: np.ndarray, value: np.ndarray) -> None:
            base, node = live * deep, leaf + width
            flat[base + node] = value
            while width > 1:
                node = node >> 1
                if not node[0]:
                    break
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        while True:
            live = live[flat[live * deep + 1] != NONE]
            if not len(live):
                break
            root = flat[live * deep + 1]
            rank, i = root // width, (root % width).astype(np.int64)
            at = live * wide
            j = flat_after[at + i]
            k, h = flat_after[at + j], flat_before[at + i]
            flat_ids[at + i], flat_ids[at + j] = self.merged[rank], -1
            flat_after[at + i], flat_before[at + k] = k, i
            put(j, np.full(len(live), NONE))
            new = self.ranks.of(flat_ids[at + i], flat_ids[at + k])
            put(i, np.where(new != NONE, new * width + i, NONE).astype(np.int32))
            new = self.ranks.of(flat_ids[at + h], flat_ids[at + i])
            put(np.where(h < width, h, j), np.where((h < width) & (new != NONE), new * width + h, NONE).astype(np.int32))
        kept = ids[:, :width] >= 0
        whole, ends = ids[:, :width][kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        start = 0
        for row, end in zip(rows.tolist(), ends.tolist(), strict=True):
            out[row] = whole[start:end]
            start = end

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        width = 1 << max(1, (n - 1).bit_length())
        none = (1 << 62, 0)
        rank_of, merged = self.rank_of, self.merged.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := rank_of.get((ids[i], ids[i + 1]))) is not None:
                tree[width + i] = (rank, i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int) -> None:
            j = after[i]
            rank = rank_of.get((ids[i], ids[j])) if ids[i] >= 0 and j < n else None
            node = width + i
            tree[node] = none if rank is None else (rank, i)
            while node > 1:
                node >>= 1
                new = min(tree[2 * node], tree[2 * node + 1])
                if new == tree[node]:
                    break
                tree[node] = new

        while tree[1] is not none and tree[1] != none:
            rank, i = tree[1]
            j = after[i]
            ids[i], ids[j] = merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    # -- texts ----------------------------------------------------------------------------------------------

    def split(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if not PLAIN.search(chunk):
            return self.pretoken.findall(chunk)
        if self.slow is None:  # where libraries' character classes may differ, the tokenizers library itself cuts
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path).pre_tokenizer
        return [chunk[a:b] for _, (a, b) in self.slow.pre_tokenize_str(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks and remembers them."""
        cut = {c: self.split(c) for c in chunks}
        new = list({p for parts in cut.values() for p in parts} - self.pieces.keys())
        raw = [p.encode() for p in new]
        short = [i for i, p in enumerate(raw) if len(p) <= WIDE]
        for i, ids in zip(short, self.merge_wide([raw[i] for i in short]), strict=True):
            self.pieces[new[i]] = ids
        for i, p in enumerate(raw):
            if len(p) > WIDE:
                self.pieces[new[i]] = self.merge_long(p)
        pieces = self.pieces
        for c, parts in cut.items():
            self.known[c] = b"".join([pieces[p] for p in parts])
        if len(pieces) > REMEMBERED:
            self.pieces = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Parts that are encoded independently: before a single space or a single line end between
        other characters, and after such a line end, the pre-tokenizer always cuts."""
        if not text:
            return []
        if not (text.isascii() or not PLAIN.search(text)) or text[0].isspace() or text[-1].isspace() or any(x in text for x in ODD_SPACES):
            return [text]
        parts = text.replace("\n", " \n ").split(" ")
        return parts

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        for start, end in slices(texts, TOGETHER):
            split: list[list[list[str] | bytes]] = []
            wanted: set[str] = set()
            for text in texts[start:end]:
                parts: list[list[str] | bytes] = []
                for k, part in enumerate(self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]):
                    if k % 2:
                        parts.append(np.array([self.special[part]], "<u4").tobytes())
                        continue
                    pieces = self.chunks(part)
                    if len(pieces) > 1:  # all but the first and those at a line's start take the space along
                        line = True
                        keyed = []
                        for p in pieces:
                            if p == "\n":
                                line = True
                                keyed.append(p)
                            else:
                                keyed.append(p if line else " " + p)
                                line = False
                        pieces = keyed
                    wanted.update(pieces)
                    parts.append(pieces)
                split.append(parts)
            missing = wanted - self.known.keys()
            if len(self.known) + len(missing) > REMEMBERED:
                self.known = {c: self.known[c] for c in wanted if c in self.known}
            self.learn(missing)
            known = self.known
            for parts in split:
                yield b"".join([p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p)) for p in parts])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """A worker's tokenizer; the file is read where the task runs."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each row's text."""
    source = only(docs, **{key: "long", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return source.mapInArrow(run, f"{key} long, ids array<int>")


def decoded(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text that each row's ids stand for; null ids give an empty text."""
    source = only(rows, **{key: "long", ids: "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, f"{key} long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass."""
    source = only(docs, doc_id="long", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = hashlib.sha256
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, a, b = [], [], []
            for raw in bpe.encode(texts):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                a.append(sha(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
