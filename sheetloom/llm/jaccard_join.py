"""Exact similarity join of texts by the Jaccard similarity of their word shingles, with count vectors in an R-tree.

Two texts link if they share at least PERCENT per cent of the union of their distinct shingles. Shingles are hashed
into groups; a text's number of shingles in each group makes it a point. Two texts can't share more shingles than the
sum of the lesser coordinates of their points, and a node of the tree, which knows the greatest coordinates and the
least size beneath it, bounds that for all of them at once. What survives is verified on the sets themselves.

All pairs can't be put into one tree, so texts are brought together by shingles, without loss:

1. Texts with equal sets become one. A text can only link if at least so many of its shingles occur in another text,
   too, that at most 1 - PERCENT per cent don't; that is counted for the shingles below a hash, in blobs dealt by hash
   ranges, and again for all shingles of the texts that are left.
2. Blocks of texts with a common least shingle are searched by R-tree; pairs already in one component are skipped, so
   that a large group of near copies costs about as many comparisons as it has members. The heads of the components
   so found meet again.
3. Two texts that link have a common shingle among the first 1 - PERCENT per cent (and one) by hash. Each such shingle
   whose texts are in more than one component has its texts searched by R-tree for pairs between components; large
   ones in pairs of blocks. A pair is put forward only where its least common shingle is seen, then verified.

Null texts count as empty. A text without words has no shingle and links with nothing. Rows alike are linked (unless
they have no words). A component's id is its least doc_id; rows without a doc_id don't count for it.
Columns other than doc_id and text aren't looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import apart, groups, only, slices, staged
from .shingles import shingle_sets

PERCENT, WORDS = 80, 5
GROUPS, FINE, FAN, HEAD = 64, 512, 16, 8
#: Texts hashed together (characters), share of the hashes counted first, hashes in a range, texts of a block.
TOGETHER, SHARE, RANGE, BLOCK = 1_000_000, 0.4, 2_000_000, 512
#: Characters of a text for each of its shingles, about; it sets how many ranges there are, nothing else.
LETTERS = 6
U = np.uint64


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least number of common shingles with which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def points(sets: list[np.ndarray]) -> np.ndarray:
    """The number of shingles by group (the low bits of their hashes) of each set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), sizes)
    low = (np.concatenate(sets).view(np.uint64) % U(GROUPS)).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    return np.bincount(row * GROUPS + low, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS).astype(np.int32)


class RTree:
    """Points in leaves of FAN, packed by size and then by their widest coordinate; every node knows the greatest
    coordinates and the least size beneath it."""

    def __init__(self, counts: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        size = counts.sum(axis=1)
        widest = counts[:, counts.var(axis=0).argmax()] if len(counts) else size
        self.order = np.lexsort((widest, size))
        top, least = counts[self.order], size[self.order]
        self.levels = [(top, least)]
        while len(top) > FAN:
            at = np.arange(0, len(top), FAN)
            top, least = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((top, least))

    def near(self, point: np.ndarray) -> np.ndarray:
        """Numbers of the points that may share enough with this one."""
        n = int(point.sum())
        found = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            bound = np.minimum(top[found], point).sum(axis=1)
            ok = (bound >= needed(n, least[found], self.percent)) & (100 * n >= self.percent * least[found])
            found = found[ok]
            if depth:
                found = (found[:, None] * FAN + np.arange(FAN)).ravel()
                found = found[found < len(self.levels[depth - 1][0])]
        return self.order[found]


def set_of(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, doc_id, n, hashes) of each row of texts: its set, and a hash of the set."""
    source = only(texts, doc_id="long", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in slices(said, TOGETHER):
                h, at = shingle_sets(said[start:end], words)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(h, at)), batch.column(0).slice(start, end - start), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=["key", "doc_id", "n", "hashes"])

    return source.mapInArrow(run, "key long, doc_id long, n long, hashes array<long>")


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    z = h * U(0xD6E8FEB86659FD93)
    z = (z ^ (z >> U(29))) * U(0xA0761D6478BD642F)
    sums = np.concatenate([[U(0)], np.cumsum(z ^ (z >> U(32)))])
    total = sums[at[1:]] - sums[at[:-1]]
    n = np.diff(at).astype(np.uint64)
    total = (total ^ (total >> U(31)) ^ (n << U(17))) * U(0xE7037ED1A0B428DB)
    return (total ^ (total >> U(30))).view(np.int64)


#: Of a chunk of texts: rows of its texts, with their place in it and how many hashes are counted; and its hashes in
#: each range, as 32 bits of the place there, with whose they are as pairs of 16 bits (text, how many).
COUNTED = "doc_id long, key long, n long, chunk long, place int, had int, range long, whose binary, hashes binary"
CHUNK = 4000


def counted(ids: pa.Array, h: np.ndarray, at: np.ndarray, keys: np.ndarray, share: float, ranges: int) -> Iterator[pa.RecordBatch]:
    """COUNTED rows of texts (at most CHUNK): the hashes below `share` of the largest, in equal ranges."""
    chunk, total = int.from_bytes(os.urandom(7), "big"), len(keys)
    limit = U(min(2**64 - 1, int(share * 2**64)))
    own = np.repeat(np.arange(total), np.diff(at))
    low = h < limit
    h, own = h[low], own[low]
    had = np.bincount(own, minlength=total)
    step = limit // U(ranges) + U(1)
    where = h // step
    order = np.argsort(where, kind="stable")
    h, own, where = h[order], own[order], where[order]
    filled, first = np.unique(where, return_index=True)
    shift = U(max(0, int(step).bit_length() - 32))
    out = []
    for r, start, end in zip(filled.tolist(), first.tolist(), [*first.tolist(), len(h)][1:], strict=True):
        text, n = np.unique(own[start:end], return_counts=True)
        while len(text) and n.max() > 65_535:  # longer runs in parts
            text, n = np.concatenate([text, text[n > 65_535]]), np.concatenate([np.minimum(n, 65_535), n[n > 65_535] - 65_535])
            again = np.argsort(text, kind="stable")
            text, n = text[again], n[again]
        out.append((r, np.column_stack([text, n]).astype("<u2").tobytes(), ((h[start:end] - U(r) * step) >> shift).astype("<u4").tobytes()))
    k = len(out)
    columns = [pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(k, pa.int64())])]
    columns += [pa.array([*c.tolist(), *[None] * k], t) for c, t in ((keys, pa.int64()), (np.diff(at), pa.int64()))]
    columns += [pa.array([chunk] * (total + k), pa.int64()), pa.array([*range(total), *[None] * k], pa.int32()), pa.array([*had.tolist(), *[None] * k], pa.int32())]
    columns += [pa.array([*[None] * total, *(x[i] for x in out)], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
    yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in COUNTED.split(", ")])


def maybe_linked(rows: DataFrame, percent: int) -> DataFrame:
    """The text rows among COUNTED rows (staged) of whose counted hashes so many occur in another text, too, that it may link."""

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(group["hashes"]), "<u4")
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        sums = np.concatenate([[0], np.cumsum(again)])
        chunks, out, end = [], [], 0
        for chunk, whose in zip(group["chunk"], group["whose"], strict=True):
            text, n = np.frombuffer(whose, "<u2").reshape(-1, 2).astype(np.int64).T
            ends = end + np.cumsum(n)
            found = sums[ends] - sums[ends - n]
            end = int(ends[-1])
            if found.any():
                chunks.append(chunk)
                out.append(np.column_stack([text[found > 0], found[found > 0]]).astype("<u2").tobytes())
        return pd.DataFrame({"chunk": np.array(chunks, np.int64), "whose": out})

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        text, n = np.frombuffer(b"".join(group["whose"]), "<u2").reshape(-1, 2).astype(np.int64).T
        total = np.bincount(text, weights=n).astype(np.int64)
        place = np.flatnonzero(total)
        return pd.DataFrame({"chunk": int(group["chunk"].iat[0]), "place": place.astype(np.int32), "shared": total[place]})

    blobs = rows.where("range is not null").select("range", "chunk", "whose", "hashes")
    counts = blobs.groupBy("range").applyInPandas(shared, "chunk long, whose binary").groupBy("chunk").applyInPandas(summed, "chunk long, place int, shared long")
    texts = rows.where("range is null and n > 0").join(counts, ["chunk", "place"], "left")
    return texts.where(F.coalesce("shared", F.lit(0)) >= F.col("had") - unshared(percent))


def unshared(percent: int) -> Column:
    """At most so many of the n shingles of a text that links are not the other text's."""
    return F.floor((100 - percent) * F.col("n") / 100).cast("long")


def linked_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    if not 0 < percent < 100:
        raise ValueError("percent must be above 0 and below 100")
    source = only(docs, doc_id="long", text="string")
    characters = source.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    ranges = max(4, -(-int(characters / LETTERS * SHARE) // RANGE))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in slices(said, 2 * TOGETHER):
                for s in range(start, end, CHUNK):
                    part = said[s : min(end, s + CHUNK)]
                    h, at = shingle_sets(part, words)
                    yield from counted(batch.column(0).slice(s, len(part)), h, at, set_keys(h, at), SHARE, ranges)

    both = staged(source.mapInArrow(first, COUNTED), "shingles")
    texts = both.where("range is null").select("doc_id", "n", "key")
    classes = texts.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    left = maybe_linked(both, percent).select("key").distinct().join(classes, "key").select("key", "least")
    found = source.join(left.select(F.col("least").alias("of")).distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    sets = staged(set_of(found, words).join(left.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("key", "n", "hashes"), "sets")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())]).astype(np.int64)
            h, keys = batch.column(1).flatten().to_numpy().view(np.uint64), batch.column(0).to_numpy()
            for s in range(0, len(keys), CHUNK):
                e = min(len(keys), s + CHUNK)
                yield from counted(pa.nulls(e - s, pa.int64()), h[at[s] : at[e]], at[s : e + 1] - at[s], keys[s:e], 1.0, ranges)

    kept = maybe_linked(staged(sets.select("key", "hashes").mapInArrow(again, COUNTED), "shingles"), percent).select("key")
    sets = staged(sets.join(kept.hint("merge"), "key", "left_semi"), "sets")

    # large groups of near copies fall together in blocks by their least shingles
    edges = staged(near_edges(sets, 2, percent, block), "links")
    heads = components(edges)
    chosen = sets.join(heads.where("node = root").select(F.col("node").alias("key")), "key", "left_semi")
    edges = staged(edges.unionAll(near_edges(chosen, 2, percent, block)), "links")
    roots = staged(components(edges), "roots")
    edges = edges.unionAll(between(sets, roots, percent, block))
    roots = components(staged(edges, "links"))

    labels = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(apart(least, "root").hint("merge"), "root").select("key", "component_id")
    out = texts.join(labels, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs, all columns, with one row of each component: that of its least doc_id. Rows alike are one; texts without
    words stay. Of a component whose rows have no doc_id, all texts stay."""
    found = linked_components(docs, percent, words)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stays")).distinct()
    return docs.join(stay.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col("__stays")), "left_semi").dropDuplicates(["doc_id", "text"])


def near_edges(sets: DataFrame, keys: int, percent: int, block: int) -> DataFrame:
    """(a, b): links that tie together what links within blocks of texts with a common one of their least shingles."""
    heads = sets.select("key", F.explode(F.slice("hashes", 1, keys)).alias("token"))
    often = heads.groupBy("token").count().where("count > 1").select("token", F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    # sorted by hash, so that blocks of one shingle are alike in size whatever the keys are
    places = heads.join(often, "token").select("key", F.struct("token", F.pmod(F.xxhash64("key", "token"), F.col("blocks")).alias("block")).alias("at"))
    dealt = sets.join(places.groupBy("key").agg(F.collect_list("at").alias("at")).hint("merge"), "key").select("key", "hashes", F.explode("at").alias("at")).select("key", "hashes", "at.token", "at.block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "token", "block"):
            if len(group) > 1:
                a, b = tied(group["key"].to_numpy(), [np.asarray(x, np.int64) for x in group["hashes"]], percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition("token", "block").sortWithinPartitions("token", "block", "key").mapInArrow(run, "a long, b long").distinct()


def tied(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """A forest of true links that has the components of all links among these sets."""
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    parts = [number[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    counts = points(sets)
    tree = RTree(counts, percent)
    root = np.arange(len(sets))
    mark = np.zeros(len(values), np.int64)
    a, b = [], []
    for i in range(len(sets)):
        near = tree.near(counts[i])
        near = near[root[near] != root[i]]
        if not len(near):
            continue
        mark[parts[i]] = 1
        for j in near.tolist():
            if root[j] != root[i] and mark[parts[j]].sum() >= needed(int(sizes[i]), int(sizes[j]), percent):
                root[root == root[j]] = root[i]
                a.append(int(keys[i]))
                b.append(int(keys[j]))
        mark[parts[i]] = 0
    return a, b


def between(sets: DataFrame, roots: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): the links between components found so far."""
    # the first shingles by hash, of which a linked set must share one
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    own = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "hashes", F.coalesce("root", "key").alias("root"))
    first = own.select("key", "root", F.explode(F.slice("hashes", F.lit(1), reach.cast("int"))).alias("token"))
    mixed = first.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token", F.ceil(F.col("n") / (2 * block)).cast("long").alias("blocks"))
    places = first.join(mixed, "token").select("key", F.struct("token", "blocks").alias("at")).groupBy("key").agg(F.collect_list("at").alias("at"))
    asked = own.join(places.hint("merge"), "key")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "one", "two", "block", "key", "root", "head", "point"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            ends = np.cumsum(batch.column("hashes").value_lengths().to_numpy())
            flat = batch.column("hashes").flatten().to_numpy()
            for row, end, start in zip(batch.select(["key", "root", "at"]).to_pylist(), ends, np.concatenate([[0], ends]), strict=False):
                h = flat[start:end]
                head, point = h[:HEAD].tobytes(), points([h])[0].tobytes()
                for at in row["at"]:
                    own_block = (row["key"] * 0x9E3779B97F4A7C15 >> 20) % at["blocks"]
                    for other in range(at["blocks"]):
                        out.append((at["token"], min(own_block, other), max(own_block, other), own_block, row["key"], row["root"], head, point))
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "token", "one", "two"):
            a, b = crossing(group, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = asked.select("key", "root", "hashes", "at").mapInArrow(deal, "token long, one long, two long, block long, key long, root long, head binary, point binary")
    pairs = dealt.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "key").mapInArrow(search, "a long, b long").distinct()
    pairs = closer(sets, pairs, percent)
    x, y = (sets.select(F.col("key").alias(k), F.col("hashes").alias(f"of_{k}")) for k in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    total = F.size("of_a") + F.size("of_b")
    return pairs.join(x, "a").join(y, "b").where((100 + percent) * common >= percent * total).select("a", "b")


def closer(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that still may link by points of FINE coordinates, a fraction of the sets in size, so that hardly any but
    linked pairs have whole sets brought together. Sets with over 255 shingles in a group pass."""

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("hashes").value_lengths().to_numpy()
            low = (batch.column("hashes").flatten().to_numpy().view(np.uint64) % U(FINE)).astype(np.int64)
            counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * FINE + low, minlength=len(sizes) * FINE).reshape(len(sizes), FINE)
            points = [c.astype(np.uint8).tobytes() if c.max() < 256 else None for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(points, pa.binary())], names=["key", "n", "fine"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "fine_a", "fine_b"))
            blank = bytes(FINE)
            common = np.minimum(*[np.frombuffer(b"".join(p or blank for p in side), np.uint8).reshape(-1, FINE) for side in (x, y)]).sum(axis=1, dtype=np.int64)
            some = np.array([p is None or q is None for p, q in zip(x, y, strict=True)], bool)
            ok = some | (common >= needed(np.array(n, np.int64), np.array(m, np.int64), percent))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(ok))

    points = staged(sets.select("key", "hashes").mapInArrow(fine, "key long, n long, fine binary"), "points")
    x, y = (points.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("fine").alias(f"fine_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").mapInArrow(bound, "a long, b long")


def crossing(group: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shingle's texts that are in different components, may share enough, and whose least common shingle,
    as far as the first HEAD of both tell, is this one."""
    keys, roots, blocks = (group[c].to_numpy() for c in ("key", "root", "block"))
    none = np.zeros(0, np.int64)
    if len(group) < 2 or (roots == roots[0]).all():
        return none, none
    token = np.array([group["token"].iat[0]], np.int64).view(np.uint64)[0]
    across = group["one"].iat[0] != group["two"].iat[0]
    counts = np.frombuffer(b"".join(group["point"]), np.int32).reshape(len(group), GROUPS)
    heads = np.full((len(group), HEAD), U(2**64 - 1))
    for i, h in enumerate(group["head"]):
        heads[i, : len(h) // 8] = np.frombuffer(h, np.uint64)
    heads = np.where(heads < token, heads, U(2**64 - 1))
    tree = RTree(counts, percent)
    a, b = [], []
    for i in range(len(group)):
        near = tree.near(counts[i])
        near = near[(roots[near] != roots[i]) & (keys[near] > keys[i])]
        if across:
            near = near[blocks[near] != blocks[i]]
        if len(near):
            mine = heads[i][heads[i] != U(2**64 - 1)]
            if len(mine):
                near = near[~np.isin(heads[near], mine).any(axis=1)]
            a.append(np.full(len(near), keys[i]))
            b.append(keys[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)
