"""Likeness of texts and numbers: column expressions where Spark has the parts, Arrow functions elsewhere."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reachable
from . import text

FAR = 999


def edits(a: Column, b: Column, most: int = 5) -> Column:
    """Levenshtein distance; FAR where the lengths differ by more than `most`."""
    return F.when(F.abs(F.length(a) - F.length(b)) > most, F.lit(FAR)).otherwise(F.levenshtein(a, b))


def likeness(a: Column, b: Column) -> Column:
    """0 to 100, case aside: equal 100, one within the other 80, without a common character (both longer than 3) 0, else
    by edits, which count as FAR where the lengths differ by more than 5."""
    return _likeness(F.upper(a), F.upper(b))


def _likeness(a: Column, b: Column) -> Column:
    # without a common character every one of the longest is an edit: that needs no check of its own
    longest = F.greatest(F.length(a), F.length(b))
    distance = edits(a, b)
    by_edits = F.when((F.abs(F.length(a) - F.length(b)) > 5) | (distance >= longest), 0.0).otherwise(F.lit(100.0) * (1 - distance / longest))
    none = F.coalesce((F.length(a) == 0) | (F.length(b) == 0), F.lit(True))
    return F.when(none, 0.0).when(a == b, 100.0).when(F.contains(a, b) | F.contains(b, a), 80.0).otherwise(by_edits)


def best_likeness(pairs: list[tuple[Column, Column]]) -> Column:
    """The likeness of the most alike of several pairs of forms of the same two values."""
    return F.greatest(*[likeness(a, b) for a, b in pairs], F.lit(0.0))


def name_likeness(a: Column, b: Column, words) -> Column:
    """Of two names: as written, or of their words (a function from a text to its words) without what is between them."""
    whole = lambda c: F.array_join(words(c), "")
    return best_likeness([(text.fold(a), text.fold(b)), (whole(a), whole(b))])


def model_likeness(a: Column, b: Column) -> Column:
    """Of two model codes: as written, or of their letters and digits alone."""
    return best_likeness([(F.trim(a), F.trim(b)), (text.compact_model(a), text.compact_model(b))])


def identifier_likeness(a: Column, b: Column, padded: bool = False) -> Column:
    """0 to 1, of the letters and digits: 1 if a choice of 0 and O makes them equal, else the best of the choices."""
    x, y = (text.compact_number(c) if padded else text.compact(c) for c in (a, b))
    left, right = text.zero_choices(x), text.zero_choices(y)
    best = F.array_max(F.flatten(F.transform(left, lambda v: F.transform(right, lambda w: likeness(v, w)))))
    return F.when((x == "") | (y == ""), 0.0).when(F.arrays_overlap(left, right), 1.0).otherwise(F.coalesce(best, F.lit(0.0)) / 100.0)


def number_likeness(a: Column, b: Column, tolerance: float) -> Column:
    """0 to 1, of a number and the least distant of several (an array): 1 within a tolerance, then falling to 0 over as much
    again, at least 1."""
    off = F.array_min(F.transform(a, lambda v: F.abs(v - b)))
    return F.coalesce(F.when(off <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (off - tolerance) / max(tolerance, 1.0))), F.lit(0.0))


def number_nearness(a: Column, b: Column, most: float) -> Column:
    """0 to 100, of two numbers: 100 within a tenth of `most`, 0 from `most` on, between them by their distance."""
    off = F.abs(a - b)
    return F.coalesce(F.when(off >= most, 0.0).when(off <= most / 10, 100.0).otherwise(F.lit(100.0) * (1 - off / most)), F.lit(0.0))


def numbers_match(a: Column, b: Column, most: float) -> Column:
    """Whether one of several numbers (an array) is within a distance of another."""
    return F.coalesce(F.exists(a, lambda v: F.abs(v - b) <= most), F.lit(False))


def number_variants(c: Column) -> Column:
    """A two-digit thickness may lack its comma: the number, and a tenth of it where that is from 0.5 to 15."""
    return F.array_compact(F.array(c, F.when((c >= 10) & (c < 100) & (c == F.floor(c)) & (c / 10).between(0.5, 15), c / 10)))


def swapped_digit(a: Column, b: Column) -> Column:
    """Equal length, one character apart."""
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 1)


def zero_tolerant(a: Column, b: Column) -> Column:
    """Equal, or equal after one 0 is taken from the longer."""
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    places = F.sequence(F.lit(1), F.greatest(F.length(longer), F.lit(1)))
    one_less = F.exists(places, lambda i: (F.substring(longer, i, F.lit(1)) == "0") & (F.concat(F.substring(longer, F.lit(1), i - 1), F.substring(longer, i + 1, F.length(longer))) == shorter))
    return (a == b) | ((F.length(longer) == F.length(shorter) + 1) & one_less)


def confused_edits(costs: dict[str, dict[str, float]], most: float = 1.0):
    """An Arrow function: edits from one text to another where a substitution that is read so in more than a tenth of the
    cases (costs: character -> what it is read as -> share) counts half; null where lengths tell that there are more."""
    reachable()

    @F.pandas_udf(T.DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _confused(x, y, costs, most) for x, y in zip(a, b, strict=True)], dtype="float64")

    return distance


def _confused(a: str, b: str, costs: dict[str, dict[str, float]], most: float) -> float | None:
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > int(most) + 1:
        return None
    half = {(x, y): 0.5 for x, read in costs.items() for y, share in read.items() if share > 0.10}
    return aligned(a, b, 1.0, half)[0]


def replaced_letters(a: Column, b: Column) -> Column:
    """(expected, found) of the characters that stand for each other where stretches of two texts were replaced, as far as
    both stretches go; what was put in or left out gives nothing."""
    reachable()
    kind = T.ArrayType(T.StructType().add("expected", "string").add("found", "string"))
    return F.pandas_udf(_replaced, kind)(a, b)


def _replaced(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        pairs = []
        if x and y:
            for tag, i, i2, j, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                if tag == "replace":
                    pairs += [{"expected": p, "found": q} for p, q in zip(x[i:i2], y[j:j2], strict=False) if p != q]
        out.append(pairs)
    return pd.Series(out)


def relatedness(written: Column, final: Column) -> Column:
    """0 to 1: how much a final value has to do with what was written. Nothing written, or one within the other: 1; else
    the best ratio with the value, its part before a dash, or one of its words; letters and digits alone count."""
    reachable()
    a, whole = text.compact(written), text.compact(final)
    parts = F.concat(F.array(whole, text.compact(F.get(F.split(final, " - "), F.lit(0)))), F.transform(F.split(F.replace(final, F.lit(" - "), F.lit(" ")), " "), text.compact))
    within = (F.length(a) >= 3) & (F.contains(whole, a) | F.contains(a, whole))
    return F.when(F.coalesce(a, F.lit("")) == "", 1.0).when(within, 1.0).otherwise(F.pandas_udf(_best_ratio, T.DoubleType())(a, F.array_distinct(parts)))


def _best_ratio(a: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([max((difflib.SequenceMatcher(None, x, p).ratio() for p in (ps if ps is not None else ()) if p), default=0.0) if x else 1.0 for x, ps in zip(a, parts, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all, by longest matching blocks."""
    reachable()
    return F.pandas_udf(_ratio, T.DoubleType())(a, b)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sorted_ratio(a: Column, b: Column) -> Column:
    """In hundredths, of the texts with their words in order: twice the longest common subsequence over both lengths."""
    reachable()
    return F.pandas_udf(_sorted_ratio, T.DoubleType())(a, b)


def _sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 100 * indel(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def aligned(a: str, b: str, gap: float = 1.0, costs: dict[tuple[str, str], float] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """Cost and pairs of the cheapest global alignment; '' stands for a gap; an unknown substitution costs 1."""
    costs = costs or {}
    cost = lambda x, y: 0.0 if x == y else costs.get((x, y), 1.0)
    table = [[j * gap for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i * gap]
        for j, y in enumerate(b, 1):
            row.append(min(table[-1][j - 1] + cost(x, y), table[-1][j] + gap, row[-1] + gap))
        table.append(row)
    pairs, i, j = [], len(a), len(b)
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + cost(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j]))
        elif i and table[i][j] == table[i - 1][j] + gap:
            i -= 1
            pairs.append((a[i], ""))
        else:
            j -= 1
            pairs.append(("", b[j]))
    return table[-1][-1], pairs[::-1]


def alignment(a: Column, b: Column) -> Column:
    """The pairs of `aligned` as an array of structs."""
    reachable()
    kind = T.ArrayType(T.StructType().add("expected", "string").add("found", "string"))
    return F.pandas_udf(_alignment, kind)(a, b)


def _alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [{"expected": p, "found": q} for p, q in aligned(x, y)[1]] for x, y in zip(a, b, strict=True)])


def channel_cost(costs: dict[tuple[str, str], float], gap: float = 1.0):
    """An Arrow function: the alignment's cost under known substitution costs (a bounded table of character pairs)."""

    reachable()

    @F.pandas_udf(T.DoubleType())
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else aligned(x, y, gap, costs)[0] for x, y in zip(a, b, strict=True)], dtype="float64")

    return cost
