"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers, by their hashes, stands first or last
in it. Whether a k-mer is chosen depends on its own characters only, so a text's anchors stay where an edit
elsewhere moves them, and two texts that share a passage share its anchors: `anchors` gives them with their
places, `shared_runs` lines up those of two texts, `longest_runs` those of many pairs. A fingerprint keeps the SKETCH
smallest hashes of the distinct chosen k-mers; `likeness` estimates from two fingerprints the Jaccard similarity of the
two sets (1 for equal ones).

Null texts count as empty; empty texts have the empty fingerprint, which is like itself only. A text shorter than
a k-mer has one anchor, the whole of it. Texts of any length are read whole. Rows are ordered by descending
doc_id (null last), rows of the same doc_id by their text; each has its own result. Further columns, of whatever
name, take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, slices

K, S = 16, 8
SKETCH = 64
#: Characters that are hashed together, and rows in a range of doc_ids, on average.
TOGETHER, RANGE, RANGES = 1_000_000, 3000, 200_000
ODD, ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODDER
    return x ^ (x >> np.uint64(29))


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the closed syncmers of all texts: the text's number, the place of the first character, the hash (below 2**32)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    places = np.zeros(0, np.int64)
    hashes = np.zeros(0, np.uint64)
    if len(code) >= K:
        h = mixed((code + np.uint64(1)) * ODD)
        step = 1
        while step < S:
            h = mixed(h[:-step] * ODD + h[step:])
            step *= 2
        n, middle = len(h) - (K - S), (K - S) // 2
        whole = mixed(h[:n] * ODD + h[middle : middle + n] * ODDER + h[K - S :])
        least, wide = h, 1
        while wide * 2 <= K - S + 1:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < K - S + 1:
            least = np.minimum(least[: len(whole)], least[K - S + 1 - wide :][: len(whole)])
        places = np.flatnonzero((h[: len(whole)] == least) | (h[K - S :] == least))
        hashes = whole[places] >> np.uint64(32)
    of = np.searchsorted(ends, places, side="right")
    inside = places + K <= ends[of] if len(places) else np.zeros(0, bool)
    of, places, hashes = of[inside], places[inside], hashes[inside]
    short = [i for i in range(len(texts)) if 0 < sizes[i] < K]
    if short:
        own = [int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") for i in short]
        of, places, hashes = np.append(of, short), np.append(places, (ends - sizes)[short]), np.append(hashes, np.array(own, np.uint64))
        order = np.argsort(of, kind="stable")
        of, places, hashes = of[order], places[order], hashes[order]
    # a text of one repeated k-mer has its only hash many times; a long text without any anchor can't be: its least s-mer stands at an edge of some k-mer
    return of, places - (ends - sizes)[of], hashes


Anchors = tuple[np.ndarray, np.ndarray, np.ndarray]


def fingerprints(texts: list[str], size: int = SKETCH) -> list[str]:
    """For each text the hexadecimal digits, eight for each hash, of the least distinct hashes in ascending order."""
    return fingerprints_and_anchors(texts, size)[0]


def fingerprints_and_anchors(texts: list[str], size: int = SKETCH) -> tuple[list[str], Anchors]:
    out: list[str] = []
    found: list[Anchors] = []
    for start, end in slices(texts, TOGETHER):
        of, places, hashes = anchors(texts[start:end])
        found.append((of + start, places, hashes))
        keys = np.unique((of.astype(np.uint64) << np.uint64(32)) | hashes)
        doc = (keys >> np.uint64(32)).astype(np.int64)
        first = np.searchsorted(doc, np.arange(end - start))
        kept = keys[np.arange(len(keys)) - first[doc] < size]
        raw = (kept & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
        last = np.cumsum(np.bincount((kept >> np.uint64(32)).astype(np.int64), minlength=end - start)) * 8
        at = 0
        for to in last.tolist():
            out.append(raw[at:to])
            at = to
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return out, tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else empty


def longest_runs(a: Anchors, b: Anchors, sizes: np.ndarray) -> np.ndarray:
    """Positional matching of many pairs of texts: the characters of the longest stretch that shared_runs finds for each;
    sizes: the characters of the first texts."""

    def once(x: Anchors) -> tuple[np.ndarray, np.ndarray]:
        keys, first, n = np.unique((x[0].astype(np.uint64) << np.uint64(32)) | x[2], return_index=True, return_counts=True)
        return keys[n == 1], x[1][first[n == 1]]

    (ka, pa_), (kb, pb) = once(a), once(b)
    both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    of, p, q = (both >> np.uint64(32)).astype(np.int64), pa_[i], pb[j]
    order = np.lexsort((p, of))
    of, p, q = of[order], p[order], q[order]
    out = np.zeros(len(sizes), np.int64)
    if len(of):
        opens = np.concatenate([[True], (of[1:] != of[:-1]) | (q[1:] - p[1:] != q[:-1] - p[:-1]) | (p[1:] > p[:-1] + K)])
        first, last = np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:] - 1, len(of) - 1)
        np.maximum.at(out, of[first], np.minimum(p[last] + K, sizes[of[first]]) - p[first])
    return out


def likeness(a: str, b: str, size: int = SKETCH) -> float:
    """Estimated Jaccard similarity of what two fingerprints were made from."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    least = sorted(x | y)[:size]
    return sum(h in x and h in y for h in least) / len(least)


def shared_runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """Positional matching: (place in a, place in b, characters) of the stretches that common anchors, each the only
    one of its hash in either text, tie together on one diagonal."""
    ends = []
    for text in (a, b):
        _, places, hashes = anchors([text])
        values, first, n = np.unique(hashes, return_index=True, return_counts=True)
        ends.append(dict(zip(values[n == 1].tolist(), places[first[n == 1]].tolist(), strict=True)))
    pairs = sorted((p, ends[1][h]) for h, p in ends[0].items() if h in ends[1])
    runs: list[list[int]] = []
    for p, q in pairs:
        if runs and runs[-1][1] - runs[-1][0] == q - p and p <= runs[-1][0] + runs[-1][2]:
            runs[-1][2] = p + K - runs[-1][0]
        else:
            runs.append([p, q, min(K, len(a) - p, len(b) - q)])
    return [(p, q, n) for p, q, n in runs]


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) of every row, without a shuffle."""
    source = only(docs, **{key: "long", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(fingerprints(texts), pa.string())], names=[key, "n_chars", "fingerprint"])

    return source.mapInArrow(run, f"{key} long, n_chars long, fingerprint string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_run long"
LEAST = -(2**63)


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document by descending doc_id;
    edited_run: the characters of the longest stretch that the anchors of both texts show to be in the edited text, too.

    The rows are dealt into ranges of doc_ids (one shuffle of the texts); the first row of each range also goes to
    the range before it, as the next of that range's last row, and the first of all to the last range. Sent to the
    driver: one id for each range.
    """
    source = only(docs, doc_id="long", text="string").withColumn("order_id", F.coalesce("doc_id", F.lit(LEAST)))
    n = source.count()
    parts = max(1, min(RANGES, n // RANGE))
    cuts = sorted(set(map(int, source.select(F.col("order_id").cast("double")).approxQuantile("order_id", [i / parts for i in range(1, parts)], 0.2 / parts)))) if parts > 1 else []
    return _compared(source, cuts)


def _compared(source: DataFrame, cuts: list[int]) -> DataFrame:
    edges = np.array(cuts, np.int64)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("order_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, ids, side="right"), pa.int64()), batch.column("order_id")], names=["bucket", "order_id"])

    tops = {r["bucket"]: r["top"] for r in source.select("order_id").mapInArrow(ranged, "bucket long, order_id long").groupBy("bucket").agg(F.max("order_id").alias("top")).collect()}
    filled = sorted(tops)
    goes = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}  # where the first row of a range also goes: to the range above it; from the highest to the lowest

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("order_id").to_numpy(zero_copy_only=False)
            own = np.searchsorted(edges, ids, side="right")
            first = np.flatnonzero([tops[b] == i for b, i in zip(own.tolist(), ids.tolist(), strict=True)])
            whole = pa.Table.from_batches([batch]).append_column("bucket", pa.array(own, pa.int64())).append_column("guest", pa.array(np.zeros(len(own), bool)))
            guests = pa.Table.from_batches([batch]).take(pa.array(first)).append_column("bucket", pa.array([goes[b] for b in own[first].tolist()], pa.int64())).append_column("guest", pa.array(np.ones(len(first), bool)))
            yield from whole.to_batches()
            if len(first):
                yield from guests.to_batches()

    rows = source.mapInArrow(dealt, "doc_id long, text string, order_id long, bucket long, guest boolean")
    rows = rows.repartition(max(1, len(filled)), "bucket").sortWithinPartitions("bucket", "guest", F.desc("order_id"), F.asc_nulls_first("text"))

    def results(docs_of: list, texts: list[str], prints: list[str], own_anchors: list, after: list[int], asked: list[int]) -> pa.RecordBatch:
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in zip(asked, after, strict=True)]
        new, new_anchors = fingerprints_and_anchors(edited)
        own = [prints[i] for i in asked]
        held = [own_anchors[i] for i in asked]
        whose = np.repeat(np.arange(len(asked)), [len(x) for x, _ in held])
        runs = longest_runs((whose, *(np.concatenate(x) for x in zip(*held, strict=True))), new_anchors, np.array([len(texts[i]) for i in asked]))
        columns = [
            pa.array([docs_of[i] for i in asked], pa.int64()),
            pa.array([len(texts[i]) for i in asked], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array(own, pa.string()),
            pa.array(new, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
            pa.array([likeness(a, prints[j]) for a, j in zip(own, after, strict=True)], pa.float64()),
            pa.array(runs, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far, whose next is still to come: doc, text, fingerprint, range, guest, anchors
        for batch in batches:
            ids, texts, where, guest = (batch.column(x).to_pylist() for x in ("doc_id", "text", "bucket", "guest"))
            texts = [t or "" for t in texts]
            for start, end in slices(texts, 2 * TOGETHER):
                prints, (of, places, hashes) = fingerprints_and_anchors(texts[start:end])
                edge = np.searchsorted(of, np.arange(end - start + 1)).tolist()
                by_text = [(places[s:e], hashes[s:e]) for s, e in zip(edge, edge[1:], strict=False)]
                rows = list(zip(ids[start:end], texts[start:end], prints, where[start:end], guest[start:end], by_text, strict=True))
                if held:
                    rows.insert(0, held)
                asked = [i for i in range(len(rows) - 1) if not rows[i][4] and rows[i + 1][3] == rows[i][3]]
                held = None if rows[-1][4] else rows[-1]
                if asked:
                    yield results([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[5] for r in rows], [i + 1 for i in asked], asked)

    return rows.mapInArrow(run, RESULT)
