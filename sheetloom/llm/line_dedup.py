"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Every line of at least EXACT_CHARS characters, that is, every line that isn't empty, is held against equal ones: equal
lines are one. Two lines of at least MIN_CHARS characters within `edits` edits of each other link:

- A line is split into edits + 1 segments of nearly equal length. Of two lines within that many edits, the longer has,
  as a substring, a segment of the shorter unchanged, at a place shifted by few characters. Each line is indexed by
  its segments, with its length; and each probes the indexes of its own and of shorter lengths with the substrings
  that may be met there, whose shifts follow from the segment's number and the difference in length.
- Keys that an indexed line and another line have are found by sums over all keys. Only lines with such a key meet.
- Pairs that meet are verified from their first different character on: a bit-parallel automaton keeps, for each
  number of edits, one bit for each diagonal in the band of 2 * edits + 1 around the main one, and takes a character
  of the shorter line at a time. Those whose automaton dies within the first characters need no more.

Components of linked lines are classes; of a class the occurrence with the least doc_id (and in that document the
first) stays, all others go. Lines are told apart by 64-bit hashes (n lines: odds of one wrong pair n*n / 2**65).

Equal lines become one by sums that begin before the shuffle, so a line that stands in a third of all documents is
sent once a task; so are the sums over keys. Null texts count as empty; empty texts and texts of one line are no special
case. Rows with the same doc_id count as one document, its lines being the first of their class in each of them;
rows without a doc_id come after all others. Columns besides doc_id, text and n_chars are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import apart, small_batches, staged

EDITS, MIN_CHARS, EXACT_CHARS = 2, 40, 1
#: Characters after the first difference that a pair is held against first.
GLANCE = 12
LAST = 2**63 - 1
#: Bits of the table by which keys are filtered: 4 MB, whatever the input.
FILTER = 1 << 25


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, pos, line, lid): the lines that count, with their place; lid is a hash of the line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return split.where(F.length("line") >= min_chars).withColumn("lid", F.xxhash64("line"))


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a line: the last ones are a character longer where they don't divide."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    before = F.greatest(F.lit(0), longer - (parts - i + 1)).cast("int")  # longer ones before this
    return (F.lit(1) + base * (i - 1) + before).cast("int"), (base + F.when(F.lit(parts - i) < longer, 1).otherwise(0)).cast("int")


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, difference in length, shift): where a longer line may hold a segment of a shorter one unchanged.

    i - 1 segments stand before segment i and edits + 1 - i after it; if segment i is the first unchanged one, or the
    last, edits before it and after it are at least, or at most, so many.
    """
    out = []
    for difference in range(edits + 1):
        for i in range(1, edits + 2):
            for shift in range(-(i - 1), i):
                if abs(shift - difference) <= edits + 1 - i:
                    out.append((i, difference, shift))
    return out


def keys_of(lines: DataFrame, edits: int, *keep: str) -> DataFrame:
    """(key, indexed) and the columns kept, of lines (line, size): each line's keys, those it is indexed by and those it
    only probes with.

    A key is a hash of the segment's number and its characters; a line's own segments are probes, too, and probes of
    several lengths that begin and end alike are one.
    """
    n = F.col("size")  # read, not counted anew for each key
    own = [F.xxhash64(F.lit(i), F.col("line").substr(*segment(n, i, edits))) for i in range(1, edits + 2)]
    more = []
    for i, difference, shift in probes(edits):
        if difference or shift:
            start, size = segment(n - difference, i, edits)
            more.append(F.xxhash64(F.lit(i), F.col("line").substr(start + shift, size)))
    both = lines.select(*keep, F.array(*own).alias("_own"), F.array(*more).alias("_more"))
    return both.select(*keep, F.posexplode(F.concat("_own", F.array_except("_more", "_own"))).alias("_at", "key")).select(*keep, "key", (F.col("_at") <= edits).alias("indexed"))


def automaton(a: Column, b: Column, start: Column, stop: Column, state: Column, edits: int) -> Column:
    """The state after characters start to stop of b (arrays of characters, a the longer): for each number of edits a
    word whose bit d tells whether so many edits lead to place (characters taken of b) + d - edits of a."""
    band = 2 * edits + 1
    all_bits = (1 << band) - 1

    def moved(s: Column, match: Column) -> Column:
        new: list[Column] = []
        for e in range(edits + 1):
            now = s[f"r{e}"].bitwiseAND(match)
            if e:
                now = now.bitwiseOR(s[f"r{e - 1}"]).bitwiseOR(F.shiftright(s[f"r{e - 1}"], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1)).bitwiseAND(F.lit(all_bits))
            new.append(now)
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(new)])

    def step(s: Column, i: Column) -> Column:
        c = F.get(b, i - 1)
        match = reduce(lambda x, y: x.bitwiseOR(y), [F.when((i - 1 + (d - edits) >= 0) & (F.get(a, i - 1 + (d - edits)) == c), F.lit(1 << d)).otherwise(0) for d in range(band)])
        return let(match, lambda m: moved(s, m))

    return F.aggregate(F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>")), state, step)


def let(value: Column, use) -> Column:
    """use(value), with the value found once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def begun(edits: int) -> Column:
    """Before any character: e edits lead to places 0 to e of a."""
    return F.struct(*[F.lit(sum(1 << (edits + d) for d in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)])


def within(x: Column, y: Column, edits: int, glance: int = GLANCE) -> Column:
    """Whether two lines are within so many edits of each other."""

    def letters(c: Column, at: Column, most: Column | None = None) -> Column:
        part = F.substring(c, at, F.length(c)) if most is None else F.substring(c, at, most)
        return F.filter(F.split(part, ""), lambda letter: letter != "")

    def common(p: Column) -> Column:
        """The length of the common beginning, by halving steps."""
        n = F.length(p["b"])
        steps = F.reverse(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")))

        def longer(at: Column, e: Column) -> Column:
            size = F.call_function("shiftleft", F.lit(1), e)
            equal = F.substring(p["a"], at + 1, size) == F.substring(p["b"], at + 1, size)
            return at + F.when((at + size <= n) & equal, size).otherwise(0)

        return F.aggregate(steps, F.lit(0), longer)

    def held(p: Column, at: Column) -> Column:
        """Equal beginnings take no edits: the automaton starts at the first difference, and goes on after a glance."""
        extra = F.length(p["a"]) - F.length(p["b"])
        left = F.length(p["b"]) - at
        cut = F.least(left, F.lit(glance))
        near = F.struct(letters(p["a"], at + 1, F.lit(glance + edits)).alias("a"), letters(p["b"], at + 1, F.lit(glance)).alias("b"))
        early = let(near, lambda q: automaton(q["a"], q["b"], F.lit(1), cut, begun(edits), edits))
        whole = F.struct(letters(p["a"], at + 1).alias("a"), letters(p["b"], at + 1).alias("b"))
        ended = lambda t: F.call_function("shiftright", t[f"r{edits}"], extra + edits).bitwiseAND(F.lit(1)) == 1
        rest = lambda s: F.when(left <= glance, ended(s)).otherwise(let(whole, lambda q: let(automaton(q["a"], q["b"], cut + 1, left, s, edits), ended)))
        return let(early, lambda s: F.when(s[f"r{edits}"] == 0, False).otherwise(rest(s)))

    first = F.length(x) >= F.length(y)
    pair = F.struct(F.when(first, x).otherwise(y).alias("a"), F.when(first, y).otherwise(x).alias("b"))
    return F.when(F.abs(F.length(x) - F.length(y)) <= edits, let(pair, lambda p: let(common(p), lambda at: held(p, at)))).otherwise(False)


def marked(keys: DataFrame, live: DataFrame) -> DataFrame:
    """keys without most of those that aren't in live: by a bit table of fixed size (FILTER bits, so at most FILTER / 64
    words are broadcast), which lets through all live ones and, the more there are, some others."""
    place = lambda: F.col("key").bitwiseAND(F.lit(FILTER - 1))  # noqa: E731  a key is a hash
    at = live.select(place().alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("_bits"))
    found = keys.withColumn("_at", place()).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word")
    return found.where(F.expr("shiftright(_bits, cast(_at % 64 as int)) & 1 = 1")).drop("_at", "_word", "_bits")


def near_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """(x, y): linked lines, x below y, of lines (lid, line, size) that are all different. Keys with an indexed line and another one are found first, by sums; only their
    lines then come together, and pairs are verified where they meet, so that none but the linked are put out."""
    met = keys_of(lines, edits, "lid").groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.max("indexed").alias("indexed"))
    live = staged(met.where("indexed and lo != hi").select("key"), "line_keys")
    if live.count() <= FILTER // 8:
        rows = marked(keys_of(lines, edits, "lid", "line", "size"), live)
    else:  # the table of bits would let most keys through: keys meet without their lines, which follow
        held = keys_of(lines, edits, "lid").join(live.hint("merge"), "key")
        rows = held.join(lines.hint("merge"), "lid")
    rows = staged(rows, "line_rows")
    index = rows.where("indexed").select("key", F.col("lid").alias("x"), F.col("line").alias("x_line"), F.col("size").alias("x_size"))
    probe = rows.select("key", F.col("lid").alias("y"), F.col("line").alias("y_line"), F.col("size").alias("y_size"))
    longer = F.col("y_size") - F.col("x_size")
    # of lines of one length either may probe for the other
    fits = (F.col("x") != F.col("y")) & (longer >= 0) & (longer <= edits) & within(F.col("x_line"), F.col("y_line"), edits)
    pairs = index.join(probe, (index["key"] == probe["key"]) & fits)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def doomed(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, pos, class): the lines to remove; class is the least hash of the lines linked with them. Lines of
    exact_chars characters (min_chars, if not given) or more link if they are equal, of min_chars or more if they are alike."""
    small_batches(docs.sparkSession)
    lines = lines_of(docs, min_chars if exact_chars is None else min(exact_chars, min_chars))
    # each line once, with the least doc_id it stands in; what follows works on these
    own = staged(lines.groupBy("lid", "line").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).withColumn("size", F.length("line")), "lines")
    if edits:
        roots = components(near_pairs(own.where(F.col("size") >= min_chars).select("lid", "line", "size"), edits), "x", "y")
        tagged = own.join(roots.withColumnRenamed("node", "lid"), "lid", "left").where("n > 1 or root is not null").select("lid", F.coalesce("root", "lid").alias("class"), "owner")
    else:
        tagged = own.where("n > 1").select("lid", F.col("lid").alias("class"), "owner")
    tagged = staged(tagged, "line_classes")
    owners = tagged.groupBy("class").agg(F.min("owner").alias("owner"))
    classes = tagged.select("lid", "class").join(apart(owners, "class").hint("merge"), "class")
    places = marked(lines.select("doc_id", "pos", F.col("lid").alias("key")), tagged.select(F.col("lid").alias("key"))).withColumnRenamed("key", "lid")
    found = places.join(classes, "lid").select("doc_id", "pos", "class", "owner")
    first = found.where("doc_id = owner").groupBy("doc_id", "class").agg(F.min("pos").alias("first"))
    found = found.join(first, ["doc_id", "class"], "left").where("first is null or pos != first")
    return found.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "pos", "class")


def removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the lines in `gone` (doc_id, pos), with __removed, their number; n_chars, if there, is counted anew."""
    # a document's places as bits, 32 to a word, so that a line is looked up in one step however many go
    bits = gone.groupBy("doc_id", F.expr("pos div 32").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 32))").alias("bits"), F.count_distinct("pos").alias("n"))
    words = bits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"), F.max("word").alias("top"), F.sum("n").alias("n_removed"))
    words = words.select(F.col("doc_id").alias("__of"), F.transform(F.sequence(F.lit(0), "top"), lambda w: F.coalesce(F.element_at("held", w), F.lit(0).cast("long"))).alias("__held"), F.col("n_removed").alias("__taken"))
    joined = docs.join(words.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col("__of")), "left")
    stays = lambda line, i: F.coalesce(F.get("__held", F.floor(i / 32).cast("int")), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 32)) == 0
    text = F.when(F.col("__held").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = joined.select(*columns, F.coalesce("__taken", F.lit(0)).cast("long").alias("__removed"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def line_report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each row's text without its repeated lines."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    out = removed(docs.select("doc_id", "text", n.alias("n_lines")), doomed(docs, edits, min_chars, exact_chars))
    return out.select("doc_id", "n_lines", F.col("__removed").alias("n_removed"), "text")
