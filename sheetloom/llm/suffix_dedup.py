"""Removal of long repeated passages by suffix order and longest previous factors, over all documents.

A passage counts if `size` bytes of it (UTF-8) also start somewhere else. A suffix array of all documents at once
fits no machine, so the suffixes are dealt into buckets that hold all matches of theirs:

1. Each window of `size` bytes names the place of its least-hashed k-mer, its anchor; equal windows have equal
   anchors at equal places. The windows that share an anchor are neighbours: the anchor's neighbourhood. Anchors that
   occur once in all documents have no matches.
2. Copies of a neighbourhood, bytes and all, are counted by hash (128 bits together) before the shuffle; its first and
   its last occurrence are put into suffix order for all of them. The first one's windows have the earlier matches that
   they have outside the copies; all other copies have the first one as an earlier match, as the last one has.
3. These are brought together by anchor. Blocks of whole buckets are put into suffix order; longest previous and next
   factors, by previous and next smaller positions in it, tell the windows that start elsewhere, earlier or not.
4. A bucket of more than `limit` unlike neighbourhoods, as a large group of near copies makes it, is dealt again: its
   windows' range of distances from the anchor is halved, and each half's windows have more bytes in common, by which
   they are dealt. That goes on while one is too large; a single distance has one content, and so fits.

Matches never cross documents. With keep="none" every occurrence of a repeated passage goes, with keep="first" all
but the first by (doc_id, place). Null texts count as empty; texts of under `size` bytes, and empty ones, stay as they
are, and an empty table gives no rows. A null doc_id comes before all others. Rows alike in doc_id and text count as
occurrences of each other, and with keep="first" stay or go together. Further columns, of whatever name, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import flagged, small_batches, staged
from .suffix_core import Hashes, factors, mixed, neighbourhoods, runs, stretches

SIZE, K = 400, 128
#: Bytes put into one suffix order, but for a bucket that is larger by itself.
BLOCK = 4 << 20
#: Unlike neighbourhoods that a bucket may hold before it is dealt again.
LIMIT = 4096


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, rid, by which a row is found again, and the other columns as `rest`."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns if c not in ("doc_id", "text")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), rest.alias("rest")).withColumn("rid", F.xxhash64("doc_id", "text"))


def shrunk(rows: DataFrame) -> DataFrame:
    """rows with the text compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            packed = [pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(list(map(len, raw)), pa.int64()), pa.array(packed, pa.binary()), *[batch.column(c) for c in rest]], names=["doc_id", "rid", "n_bytes", "packed", *rest])

    rest = [c for c in rows.columns if c == "rest"]
    schema = T.StructType().add("doc_id", "long").add("rid", "long").add("n_bytes", "long").add("packed", "binary")
    for c in rest:
        schema = schema.add(rows.schema[c])
    return rows.select("doc_id", "rid", "text", *rest).mapInArrow(run, schema)


def among(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """The compressed texts of the rows whose rid is in needed, and few others: only these are shuffled."""
    return shrunk(flagged(rows, "rid", needed).where("maybe").drop("maybe"))


def opened(packed: bytes, n: int) -> bytes:
    return pa.decompress(packed, decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def anchored(rows: DataFrame, size: int, k: int) -> DataFrame:
    """(a, h, doc_id, rid, place, low, high) of each anchor: its hash, its neighbourhood's, its place, and how far before
    it its last and its first window start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for a, h, of, place, low, high in neighbourhoods(texts, size, k):
                own = batch.select(["doc_id", "rid"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(h.view(np.int64)), own.column(0), own.column(1), pa.array(place, pa.int32()), pa.array(low, pa.int16()), pa.array(high, pa.int16())], names=["a", "h", "doc_id", "rid", "place", "low", "high"])

    return rows.select("doc_id", "rid", "text").mapInArrow(run, "a long, h long, doc_id long, rid long, place int, low short, high short")


def halved(texts: DataFrame, found: DataFrame, size: int, wide: int) -> DataFrame:
    """found with each neighbourhood cut at the multiples of `wide`, its distances from the anchor being ranges of those,
    and dealt by the bytes that all windows of a range have in common."""
    asked = found.groupBy("rid").agg(F.collect_list(F.struct("a", "place", "low", "high", F.col("doc_id").alias("doc"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, n, packed, at in zip(*(batch.column(x).to_pylist() for x in ("rid", "n_bytes", "packed", "at")), strict=True):
                sums = Hashes(np.frombuffer(opened(packed, n), np.uint8))
                cut = [(x["a"], x["doc"], x["place"], max(x["low"], c * wide), min(x["high"], c * wide + wide - 1), c) for x in at for c in range(x["low"] // wide, x["high"] // wide + 1)]
                a, place, low, high, c = (np.array([x[i] for x in cut], np.int64) for i in (0, 2, 3, 4, 5))
                common = sums.of(place - c * wide, place - (c * wide + wide - 1) + size)
                key = mixed(common ^ a.view(np.uint64) ^ mixed(c.astype(np.uint64) + np.uint64(1024 * wide)))
                h = sums.of(place - high, place - low + size) ^ (high * 1024 + low).astype(np.uint64)
                columns = [key.view(np.int64), h.view(np.int64), [x[1] for x in cut], np.full(len(cut), rid), place, low, high]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["a", "h", "doc_id", "rid", "place", "low", "high"])

    one = texts.dropDuplicates(["rid"])
    return one.join(asked.withColumnRenamed("rid", "of"), F.col("rid") == F.col("of")).select("rid", "n_bytes", "packed", "at").mapInArrow(run, "a long, h long, doc_id long, rid long, place int, low short, high short")


def solved(texts: DataFrame, kinds: DataFrame, size: int) -> DataFrame:
    """(a, h, one, ones, others): of each neighbourhood its first occurrence, and the windows that match elsewhere there and
    in its other occurrences, as [distance of the first, of the last, 1 if they start earlier, too, else 0, ...]."""
    roles = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("role"), F.col("one.*")), F.struct(F.lit(1).alias("role"), F.col("other.*")))).otherwise(F.array(F.struct(F.lit(0).alias("role"), F.col("one.*"))))
    asked = kinds.select("a", "h", F.explode(roles).alias("x")).select("a", "h", "x.*")
    asked = asked.groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.struct("a", "h", "role", "doc_id", "place", "low", "high")).alias("at"))
    fields = {"a": pa.int64(), "h": pa.int64(), "role": pa.int32(), "doc_id": pa.int64(), "rid": pa.int64(), "place": pa.int32(), "low": pa.int16(), "high": pa.int16(), "raw": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbourhoods' bytes."""
        for batch in batches:
            held: list[dict] = []
            for rid, n, packed, at in zip(*(batch.column(x).to_pylist() for x in ("rid", "n_bytes", "packed", "at")), strict=True):
                raw = opened(packed, n)
                held += [x | {"rid": rid, "raw": raw[x["place"] - x["high"] : x["place"] - x["low"] + size]} for x in at]
                while len(held) > 4000:
                    yield pa.RecordBatch.from_pylist(held[:4000], pa.schema(fields))
                    held = held[4000:]
            yield pa.RecordBatch.from_pylist(held, pa.schema(fields))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffix order of blocks of whole buckets; the rows come sorted by bucket."""
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            held.append(batch)
            weight += batch.nbytes
            if weight < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            a = rows["a"].to_numpy()
            ends = np.flatnonzero(a[1:] != a[:-1]) + 1  # the last bucket may go on
            if len(ends):
                yield block(rows.slice(0, int(ends[-1])))
                held = rows.slice(int(ends[-1])).to_batches()
                weight = 0
        if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield block(rows)

    def block(rows: pa.Table) -> pa.RecordBatch:
        a, h, role, rid, place, low, high = (rows[x].to_numpy().astype(np.int64) for x in ("a", "h", "role", "rid", "place", "low", "high"))
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1]) | (role[1:] != role[:-1])])  # a row that occurs twice was cut twice
        rows = rows.filter(pa.array(once))
        a, h, role, rid, place, low, high = (x[once] for x in (a, h, role, rid, place, low, high))
        raw = rows["raw"].combine_chunks()
        lengths = high - low + size
        doc = rows["doc_id"].combine_chunks()
        known, doc = ~np.asarray(doc.is_null()), np.asarray(doc.fill_null(0))
        order = np.lexsort((place, rid, doc, known))
        alike = np.concatenate([[False], np.all([x[order][1:] == x[order][:-1] for x in (place, rid, doc, known)], axis=0)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(~alike)
        bucket = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]).astype(np.int64)]))
        kind = factors(bucket, rank, low, high, np.frombuffer(b"".join(raw.to_pylist()), np.uint8), np.cumsum(lengths) - lengths, size)
        row, first, last, value = stretches(kind)
        spans: list[list[int]] = [[] for _ in a]
        for r, *span in zip(row.tolist(), first.tolist(), last.tolist(), (value == 2).astype(int).tolist(), strict=True):
            spans[r] += span
        new = np.flatnonzero(role == 0)
        others = [spans[i + 1] if i + 1 < len(role) and role[i + 1] else [] for i in new.tolist()]
        taken = [(i, x) for i, x in zip(new.tolist(), others, strict=True) if x or spans[i]]
        at = np.array([i for i, _ in taken], np.int64)
        own = rows.select(["doc_id", "rid", "place", "low", "high"]).take(pa.array(at)).combine_chunks()
        one = pa.StructArray.from_arrays([own[c].combine_chunks() if own.num_rows else pa.array([], own[c].type) for c in own.column_names], names=own.column_names)
        kinds = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(h[at]), one, pa.array([spans[i] for i, _ in taken], kinds), pa.array([x for _, x in taken], kinds)], names=["a", "h", "one", "ones", "others"])

    pieces = texts.join(asked, F.col("rid") == F.col("of")).select("rid", "n_bytes", "packed", "at").mapInArrow(cut, "a long, h long, role int, doc_id long, rid long, place int, low short, high short, raw binary")
    out = T.StructType().add("a", "long").add("h", "long").add(T.StructField("one", kinds.schema["one"].dataType)).add("ones", T.ArrayType(T.IntegerType())).add("others", T.ArrayType(T.IntegerType()))
    return pieces.repartition("a").sortWithinPartitions("a", "h", "role").mapInArrow(ordered, out)


def repeated(docs: DataFrame, size: int = SIZE, k: int = K, limit: int = LIMIT) -> DataFrame:
    """(rid, spans): of each row with any, the windows that start elsewhere, too, as [place of the anchor, spans of
    distances from it as solved() gives them]; the rows are those of keyed(docs)."""
    if not 0 < k <= size or size - k >= 1024:
        raise ValueError("an anchor must be shorter than the windows, by less than 1024 bytes")
    rows = keyed(docs).drop("rest")
    anchors = staged(anchored(rows, size, k), "suffix_anchors")
    wide, out = size - k + 1, []
    while True:
        # tables, not sums, are joined: Spark splits a hot key's rows then
        shared = staged(anchors.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "suffix_shared")
        found = staged(anchors.join(shared.hint("merge"), "a"), "suffix_found")
        place = F.struct("doc_id", "rid", "place", "low", "high")
        kinds = staged(found.groupBy("a", "h").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other")), "suffix_kinds")
        large = staged(kinds.groupBy("a").count().where(F.col("count") > limit).select("a"), "suffix_large")
        some = wide > 1 and not large.isEmpty()
        fits = kinds.join(large, "a", "left_anti") if some else kinds
        spans = staged(solved(among(rows, fits.select(F.explode(F.array("one.rid", "other.rid")))), fits, size), "suffix_spans")
        met = found.join(spans.hint("merge"), ["a", "h"])
        out.append(met.select("rid", F.struct("place", F.when(place.eqNullSafe(F.col("one")), F.col("ones")).otherwise(F.col("others")).alias("spans")).alias("span")).where(F.size("span.spans") > 0))
        if not some:
            break
        wide = -(-wide // 2)
        wider = found.join(large, "a")
        anchors = staged(halved(among(rows, wider.select("rid")), wider, size, wide), "suffix_anchors")
    every = out[0]
    for more in out[1:]:
        every = every.unionAll(more)
    return staged(every.groupBy("rid").agg(F.collect_list("span").alias("spans")), "suffix_rows")


def covered(spans: list, n: int, size: int, keep: str) -> np.ndarray:
    """Which of n bytes go."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        x = np.array([y for s in spans for y in s["spans"]], np.int64).reshape(-1, 3)
        place = np.repeat([s["place"] for s in spans], [len(s["spans"]) // 3 for s in spans])
        some = (x[:, 2] > 0) | (keep == "none")
        np.add.at(edge, (place - x[:, 0])[some], 1)
        np.add.at(edge, (place - x[:, 1])[some] + size, -1)
    return np.cumsum(edge[:n]) > 0


def cleaned(docs: DataFrame, size: int = SIZE, keep: str = "none", k: int = K, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, rest) of each row; kept: the bytes that stay, in order; rest: a struct
    of the columns besides doc_id and text, their names after c_."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spans = repeated(docs, size, k, limit).withColumnRenamed("rid", "of")
    rows = flagged(keyed(docs), "rid", spans.select("of"))
    some, none = (shrunk(rows.where(x).drop("maybe")) for x in ("maybe", "not maybe"))
    texts = some.join(spans, F.col("rid") == F.col("of"), "left").select("doc_id", "n_bytes", "packed", "spans", "rest")
    joined = texts.unionAll(none.select("doc_id", "n_bytes", "packed", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, n_spans, left = [], [], []
            for n, packed, spans in zip(*(batch.column(x).to_pylist() for x in ("n_bytes", "packed", "spans")), strict=True):
                raw = opened(packed, n)
                gone = covered(spans or [], n, size, keep) if spans else np.zeros(0, bool)
                n_removed.append(int(gone.sum()))
                n_spans.append(len(runs(gone)))
                left.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if n_spans[-1] else raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(left, pa.binary()), batch.column("rest")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    schema = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary").add(texts.schema["rest"])
    return joined.mapInArrow(run, schema)


def first_kept(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """docs, all columns, with all but the first occurrence of each repeated passage removed. A character that a cut
    went through goes, too; n_chars, if there, is counted anew."""

    out = cleaned(docs, size, "first", k)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), batch.column("rest")], names=["doc_id", "text", "rest"])

    out = out.select("doc_id", "kept", "rest").mapInArrow(read, T.StructType().add("doc_id", "long").add("text", "string").add(out.schema["rest"]))
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`c_{c}`").alias(c) for c in docs.columns]
    out = out.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text), with every occurrence of a repeated passage removed; text: the
    bytes that stay, read as UTF-8, with U+FFFD for what is left of a character that a cut went through."""
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return cleaned(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)
