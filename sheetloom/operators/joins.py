"""Joins by key, by range, by neighbourhood, by shared token, and the best few by likeness; all of them equi-joins
inside, so that none of them compares every row with every row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..session import reachable


def filtered(df: DataFrame, **values: list | None) -> DataFrame:
    """Rows whose columns are among the given values; None is no condition, an empty list fits no row."""
    for name, wanted in values.items():
        if wanted is not None:
            df = df.where(F.col(name).isin(wanted)) if wanted else df.where(F.lit(False))
    return df


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def lookup_chain(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(row_id, entry_ord, via): the plan entry of each row. Of the entries with its order number the best: 8 points for the
    model, 4 for the sales order, 2 for the client and 1 for each measure within its tolerance, then the smaller sum of
    differences, then the plan's order. If that one contradicts the row's sales order and its model, or there is none,
    the entries with its sales order and model count, if they are one order's with one designation.

    rows: row_id, of, ov, cliente, modelo, comp, lbase, ltopo; entries: entry_ord, of, ov, cliente, designacao and the
    measures. Models match where one holds the other, letters and digits alone.
    """
    tolerance = {"comp": 50.0, "lbase": 30.0, "ltopo": 30.0}  # fixed values
    r = rows.select("row_id", text.order_number_loose(F.col("of")).alias("r_of"), F.trim("ov").alias("r_ov"), text.compact(F.col("modelo")).alias("r_model"), text.compact(F.col("cliente")).alias("r_client"), *[F.col(c).alias(f"r_{c}") for c in tolerance])
    e = entries.select("entry_ord", text.order_number_loose(F.col("of")).alias("e_of"), F.trim("ov").alias("e_ov"), text.compact(F.col("designacao")).alias("e_model"), text.compact(F.col("cliente")).alias("e_client"), *[F.col(c).alias(f"e_{c}") for c in tolerance])
    known = lambda a: F.col(a).isNotNull() & (F.col(a) != "")
    model = F.coalesce(known("r_model") & known("e_model") & (F.contains("e_model", "r_model") | F.contains("r_model", "e_model")), F.lit(False))
    same_ov = F.coalesce(known("r_ov") & (F.col("r_ov") == F.col("e_ov")), F.lit(False))
    client = F.coalesce(known("r_client") & (F.col("r_client") == F.col("e_client")), F.lit(False))
    off = {c: F.abs(F.col(f"r_{c}") - F.col(f"e_{c}")) for c in tolerance}
    points = reduce(lambda a, b: a + b, [model.cast("int") * 8, same_ov.cast("int") * 4, client.cast("int") * 2, *[F.coalesce((off[c] <= t).cast("int"), F.lit(0)) for c, t in tolerance.items()]])
    apart = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in off.values()])
    against = known("r_ov") & known("r_model") & ~F.coalesce(F.col("r_ov") == F.col("e_ov"), F.lit(False)) & ~model
    met = r.join(e, F.col("r_of") == F.col("e_of"))
    best = met.groupBy("row_id").agg(F.max_by(F.struct("entry_ord", against.alias("against")), F.struct(points.alias("p"), (-apart).alias("d"), (-F.col("entry_ord")).alias("o"))).alias("b"))
    direct = best.where("not b.against").select("row_id", F.col("b.entry_ord").alias("entry_ord"), F.lit("of").alias("via"))
    rest = r.where(known("r_ov") & known("r_model")).join(direct.select("row_id"), "row_id", "left_anti")
    # only the sales order and the model decide here: each pair of them that is written meets each that is planned, once
    planned = e.where(known("e_ov") & known("e_model")).groupBy("e_ov", "e_model").agg(F.min("entry_ord").alias("entry_ord"), F.min(F.coalesce("e_of", F.lit(""))).alias("least"), F.max(F.coalesce("e_of", F.lit(""))).alias("most"))
    near = rest.select("r_ov", "r_model").distinct().join(planned, F.col("r_ov") == F.col("e_ov")).where(model)
    one = near.groupBy("r_ov", "r_model").agg(F.min("entry_ord").alias("entry_ord"), F.count("*").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).where("n = 1 and least = most")
    unique = rest.join(one, ["r_ov", "r_model"]).select("row_id", "entry_ord", F.lit("ov").alias("via"))
    return direct.unionAll(unique)


def substrings(c: Column, least: int = 1) -> Column:
    """All parts of a text of at least so many characters, each once."""
    n = F.length(c)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda size: F.substring(c, i, size)))))


def within(parts: DataFrame, part: str, wholes: DataFrame, whole: str, least: int = 1) -> DataFrame:
    """(part, whole): distinct values of which one holds the other, by a join with the parts of the longer: for labels, not texts."""
    p = parts.select(part).distinct().where(F.length(part) >= least)
    w = wholes.select(whole).distinct().select(whole, F.explode(substrings(F.col(whole), least)).alias(part))
    return w.join(p, part).select(part, whole)


def first_of(rows: DataFrame, key: str, *tiers: DataFrame) -> DataFrame:
    """rows with `value` from the first tier (key, value) that has its key, and the tier's number as `tier`."""
    out = rows
    for i, tier in enumerate(tiers):
        out = out.join(tier.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    value = F.coalesce(*[F.col(f"_v{i}") for i in range(len(tiers))])
    number = reduce(lambda acc, i: F.when(F.col(f"_v{i}").isNotNull(), i + 1).otherwise(acc), range(len(tiers) - 1, -1, -1), F.lit(None).cast("int"))
    return out.select(*rows.columns, value.alias("value"), number.alias("tier"))


def unique_containing(labels: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(label, code): names (name, code) that a label holds or that hold it, where all such names have one code."""
    ab = within(names, "name", labels, "label", least)
    ba = within(labels, "label", names, "name", least)
    met = ab.unionByName(ba.select("name", "label")).distinct().join(names.select("name", "code"), "name")
    return met.groupBy("label").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").select("label", "code")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with |a - b| <= tolerance: both sides in cells as wide as the tolerance, the right in its own and both next."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    r = right.withColumn("_cell", F.explode(F.sequence(cell(b) - 1, cell(b) + 1)))
    return left.withColumn("_cell", cell(a)).join(r, ["_cell", *(on or [])]).where(F.abs(F.col(a) - F.col(b)) <= tolerance).drop("_cell")


def grid_join(left: DataFrame, right: DataFrame, axes: list[tuple[str, str]], width: int, keep: list[str] | None = None, block: int = 8192, share: int = 8192) -> DataFrame:
    """Pairs whose values lie in the same cell or in neighbouring ones on every axis, with the right's columns (`keep`: those
    of them). What the right has in a cell among `block` rows goes as one array, so that a left row meets arrays and not
    rows; each `share` arrays of a cell go to a task of their own, where its left rows are sent, too."""
    keys = [f"_g{i}" for i in range(len(axes))]
    right = right.withColumn("_b", F.floor(F.monotonically_increasing_id() / block))
    for g, (a, b) in zip(keys, axes, strict=True):
        left = left.withColumn(g, F.floor(F.col(a) / width))
        right = right.withColumn(g, F.explode(F.sequence(F.floor(F.col(b) / width) - 1, F.floor(F.col(b) / width) + 1)))
    held = right.groupBy(*keys, "_b").agg(F.collect_list(F.struct(*(keep or [c for c in right.columns if c not in ("_b", *keys)]))).alias("_e"))
    shares = right.groupBy(*keys).agg(F.ceil(F.count("*") / share).alias("_n"))
    dealt = held.join(shares, keys).withColumn("_s", F.pmod("_b", "_n")).drop("_b", "_n")
    sent = left.join(shares, keys).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    return sent.join(dealt.hint("merge"), [*keys, "_s"]).select(*[c for c in left.columns if c not in keys], F.inline("_e"))


def token_join(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 50, least: int = 5) -> DataFrame:
    """(a, b, shared): pairs with a common token; tokens (arrays in _tokens) of more than `most` entries tell nothing and are left out."""
    t = right.select(b, F.explode(F.array_distinct("_tokens")).alias("_t")).where(F.length("_t") >= least)
    rare = t.groupBy("_t").agg(F.count_distinct(b).alias("_n")).where(F.col("_n") <= most)
    t = t.join(rare.drop("_n"), "_t")
    return left.select(a, F.explode(F.array_distinct("_tokens")).alias("_t")).join(t, "_t").groupBy(a, b).agg(F.count_distinct("_t").alias("shared"))


def top_like(written: DataFrame, known: DataFrame, key: str, value: str, score, k: int = 10, floor: float = 0.0, apart: int = 5) -> DataFrame:
    """(key, value, score, place): for each distinct written key the k known values most like it by a score of edits that is
    0 where lengths differ by more than `apart`, unless one holds the other. So values meet by length, and by being
    parts of each other; nothing else can have a score."""
    a, b = written.select(key).distinct(), known.select(value).distinct()
    lengths = b.withColumn("_n", F.explode(F.sequence(F.greatest(F.length(value) - apart, F.lit(0)), F.length(value) + apart)))
    near = a.withColumn("_n", F.length(key)).join(lengths, "_n").select(key, value)
    held = within(a, key, b, value).select(key, value).unionByName(within(b, value, a, key).select(key, value)).where(F.abs(F.length(key) - F.length(value)) > apart)
    pairs = near.unionByName(held).withColumn("score", score(F.col(key), F.col(value))).where((F.col("score") >= floor) & (F.col("score") > 0))
    order = Window.partitionBy(key).orderBy(F.desc("score"), value)
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def edit_keys(codes: DataFrame, column: str, edits: int) -> DataFrame:
    """(column, code): of each code, case aside, what is left of it after some characters were hidden and some taken out, at
    most `edits` in all if one taken out counts twice. Two codes of one length are at most so many edits apart if and only if
    they share such a code: where they differ both have a hidden character, or each lacks one that the other has."""
    reachable()
    ways = [(hidden, out) for out in range(edits // 2 + 1) for hidden in range(edits - 2 * out + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[str] = []
            of: list[str] = []
            for value, upper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set()
                for hidden, out in ways:
                    for gone in combinations(range(len(upper)), out):
                        left = [c for i, c in enumerate(upper) if i not in gone] if gone else list(upper)
                        for at in combinations(range(len(left)), hidden):
                            x = left.copy()
                            for i in at:
                                x[i] = "\0"
                            own.add(f"{out}{''.join(x)}")
                held += own
                of += [value] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(held, pa.string())], names=[column, "code"])

    return codes.select(column, F.upper(column).alias("upper")).mapInArrow(run, f"`{column}` string, code string")


def top_codes(written: DataFrame, known: DataFrame, key: str, value: str, k: int = 10, apart: int = 5) -> DataFrame:
    """(key, value, score): as top_like by likeness, for short codes of which very many have one length. Those of one length
    meet by the codes that they share with two edits. Of all known codes with a shared one the k first are enough: all are
    so near, and order decides among them. A key whose k-th value isn't nearer than three edits is looked up
    again with three, and one that isn't nearer than four then, among all codes of its length."""
    n = lambda c: F.length(F.upper(c))
    a, b = written.select(key).distinct().where(n(key) > 0), known.select(value).distinct().where(n(value) > 0)
    scored = lambda pairs: pairs.select(key, similarity.likeness(F.col(key), F.col(value)).alias("score"), value).where("score > 0")
    first = lambda df, by, *order: df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= k).drop("_place")
    # codes of unlike lengths, which have edits of their own or are within each other
    lengths = b.withColumn("_n", F.explode(F.sequence(F.greatest(n(value) - apart, F.lit(1)), n(value) + apart))).where(F.col("_n") != n(value))
    unlike = a.withColumn("_n", n(key)).join(lengths, "_n").select(key, value)
    for part, parts, whole, wholes in ((key, a, value, b), (value, b, key, a)):
        long = wholes.where(n(whole) > parts.agg(F.min(n(part))).scalar() + apart)
        unlike = unlike.unionByName(within(parts, part, long, whole).select(key, value).where(n(whole) - n(part) > apart))
    unlike = first(scored(unlike), key, F.desc("score"), value)

    def best(pairs: DataFrame) -> DataFrame:
        """(key, top): the k best of all pairs found."""
        found = F.collect_set(F.struct((-F.col("score")).alias("s"), F.col(value).alias("v")))
        return pairs.groupBy(key).agg(F.slice(F.sort_array(found), 1, k).alias("top"))

    out, rest = [], a
    for edits in (2, 3):
        near = first(edit_keys(b, value, edits), "code", value)
        top = best(scored(edit_keys(rest, key, edits).join(near, "code").select(key, value)).unionByName(unlike.join(rest, key, "left_semi") if out else unlike))
        # the most that a code of the same length can have which wasn't found
        more = F.lit(100.0) * (1 - F.lit(edits + 1) / n(key))
        settled = (more <= 0) | F.coalesce(-F.get("top", F.lit(k - 1))["s"] > more, F.lit(False))
        out.append(top.where(settled))
        rest = rest.join(top.where(settled).select(key), key, "left_anti")
    all_alike = rest.withColumn("_n", n(key)).join(b.withColumn("_n", n(value)), "_n").select(key, value)
    out.append(best(first(scored(all_alike), key, F.desc("score"), value).unionByName(unlike.join(rest, key, "left_semi"))))
    return reduce(DataFrame.unionByName, out).select(key, F.explode("top").alias("t")).select(key, F.col("t.v").alias(value), (-F.col("t.s")).alias("score"))


def nearest_values(written: DataFrame, known: DataFrame, key: str, value: str, tolerance: float, k: int = 10) -> DataFrame:
    """(key, value, score, place): for each distinct written number the k known numbers nearest to it, and how like they are.
    Each written number is put among the known ones, and looks k of them back and k on."""
    a = written.select(F.col(key).cast("double").alias("_x"), key).distinct().where("_x is not null")
    b = known.select(F.col(value).cast("double").alias("_x")).distinct().where("_x is not null")
    every = a.select("_x", F.col(key).alias("_k"), F.lit(None).cast("double").alias("_v")).unionByName(b.select("_x", F.lit(None).cast(a.schema[key].dataType).alias("_k"), F.col("_x").alias("_v")))
    by = Window.orderBy("_x")  # distinct measures: some thousands
    back = F.collect_list("_v").over(by.rangeBetween(Window.unboundedPreceding, 0))
    on = F.collect_list("_v").over(by.rangeBetween(0, Window.unboundedFollowing))
    sides = every.select("_x", "_k", F.slice(F.reverse(back), 1, k).alias("_b"), F.slice(on, 1, k).alias("_o")).where("_k is not null")
    near = sides.select("_x", F.col("_k").alias(key), F.explode(F.array_union("_b", "_o")).alias(value))
    order = Window.partitionBy(key).orderBy(F.abs(F.col("_x") - F.col(value)), value)
    out = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return out.select(key, value, F.round(similarity.number_likeness(F.array("_x"), F.col(value), tolerance) * 100, 6).alias("score"), "place")


def cascade(written: DataFrame, known: DataFrame, key: str, value: str, score, floor: float = 85.0) -> DataFrame:
    """(key, value, tier): each distinct written value's known one: the equal one (exact), the only one that holds it or that
    it holds (unique), the only one an edit away (edit), else the most like from a floor on (like)."""
    a, b = written.select(key).distinct().where(F.col(key) != ""), known.select(value).distinct().where(F.col(value) != "")
    tier = lambda df, n, name: df.select(key, F.struct(F.lit(n).alias("n"), value, F.lit(name).alias("tier")).alias("t"))
    one = lambda pairs: pairs.distinct().groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias(value)).where("n = 1")
    exact = a.join(b, F.upper(key) == F.upper(value)).groupBy(key).agg(F.min(value).alias(value))
    unique = one(within(a, key, b, value, 3).select(key, value).unionByName(within(b, value, a, key, 3).select(key, value)))
    # an edit apart: alike but for one character left out of either
    less = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    met = a.withColumn("_l", F.explode(less(F.col(key)))).join(b.withColumn("_l", F.explode(less(F.col(value)))), "_l").where(F.levenshtein(key, value) == 1)
    edit = one(met.select(key, value))
    found = tier(exact, 0, "exact").unionByName(tier(unique, 1, "unique")).unionByName(tier(edit, 2, "edit")).groupBy(key).agg(F.min("t").alias("t")).select(key, f"t.{value}", "t.tier")
    rest = a.join(found.select(key), key, "left_anti")
    return found.unionByName(top_like(rest, b, key, value, score, 1, floor).select(key, value, F.lit("like").alias("tier")))


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], padded: bool = False) -> DataFrame:
    """Rows at the same place of two tables: up to the shorter's end, or padded with empty texts up to the longer's."""
    if not padded:
        return left.join(right, keys)
    out = left.join(right, keys, "full")
    return out.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns if c not in keys])


def replaced_by(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """All rows of new, and those of old whose key new hasn't."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def survival(outcomes: DataFrame, human: DataFrame, keys: list[str]) -> DataFrame:
    """outcomes with survived: whether no human edit has their keys."""
    touched = human.select(*keys).distinct().withColumn("_touched", F.lit(True))
    return outcomes.join(touched, keys, "left").withColumn("survived", F.col("_touched").isNull().cast("int")).drop("_touched")


def status_changes(base: DataFrame, now: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Counts of (before, after) over cells of both, '-' where one side lacks a cell."""
    a, b = base.select(*keys, F.col(status).alias("before")), now.select(*keys, F.col(status).alias("after"))
    both = a.join(b, keys, "full").select(F.coalesce("before", F.lit("-")).alias("before"), F.coalesce("after", F.lit("-")).alias("after"))
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))
