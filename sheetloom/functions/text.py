"""Text normalisation as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the letters they are written on.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def fold(c: Column) -> Column:
    """Upper case without accents; other letters outside ASCII go."""
    return F.upper(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[^\\x00-\\x7F]", ""))


def fold_lower(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, ACCENTED, PLAIN)))


def comparable(c: Column) -> Column:
    """For comparing a cell: lower case without accents, trimmed, the day and the month of a date with two digits."""
    return F.regexp_replace(F.regexp_replace(fold_lower(c), r"^([0-9])([-/.])([0-9]{1,2})([-/.][0-9]{4})$", "0$1$2$3$4"), r"^([0-9]{2}[-/.])([0-9])([-/.][0-9]{4})$", "$10$2$3")


def compact(c: Column) -> Column:
    """Only the letters and digits, upper case."""
    return F.regexp_replace(fold(c), "[^A-Z0-9]", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def missing(c: Column) -> Column:
    """Null, blank, or question marks among separators; separators alone are not missing."""
    return c.isNull() | (F.trim(c) == "") | (c.rlike(r"^[\s\-_.:/\\?]*$") & c.contains("?"))


def tokens(c: Column, stop: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> Column:
    """Folded words without stop words, some read as others."""
    words = F.filter(F.split(F.regexp_replace(fold(c), "[^A-Z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")
    if not aliases:
        return words
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))


def order_number(c: Column, width: int = 6) -> Column:
    """Digits alone are padded with zeros; all else is kept trimmed, blanks as null."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)).when(t != "", t)


def order_number_loose(c: Column, width: int = 6) -> Column:
    """As order_number, and numbers with a zero fraction as their whole part."""
    return order_number(F.regexp_replace(F.trim(c), r"^([0-9]+)[.,]0+$", "$1"), width)


def zero_variants(c: Column, places: int = 3, most: int = 8) -> Column:
    """The text with each choice of O for 0 and 0 for O among its first few such places; itself first."""
    def both(k: int):
        return lambda v: F.array(v, swap(v, F.lit(k)))

    out = F.array(c)
    for k in range(1, places + 1):
        out = F.flatten(F.transform(out, both(k)))
    return F.slice(F.array_distinct(out), 1, most)


def zero_choices(c: Column, places: int = 3, most: int = 8) -> Column:
    """The text, and where it has from one to `places` zeros and letters O, each choice of 0 and O for them."""
    n = F.length(c) - F.length(F.regexp_replace(c, "[0Oo]", ""))
    return F.when((n >= 1) & (n <= places), zero_variants(F.translate(c, "o", "O"), places, most)).otherwise(F.array(c))


#: What a letter among digits may have been.
LETTER_TO_DIGITS = {
    "F": ("6", "8", "5", "7", "E"), "P": ("0", "8", "D", "B"), "S": ("5", "8", "2"), "B": ("8", "6", "3"), "O": ("0", "D", "Q"), "D": ("0", "O", "B"), "I": ("1", "L", "T"),
    "L": ("1", "I"), "T": ("1", "7"), "Z": ("2", "7"), "G": ("6", "0", "C"), "E": ("3", "B"), "Y": ("7", "V"), "Q": ("0", "9"),
}


def digit_choices(c: Column, most: int = 32) -> Column:
    """The text with each choice of what its letters may have been, itself first; at most so many."""
    known = F.create_map(*[x for k, v in LETTER_TO_DIGITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    options = lambda x: F.concat(F.array(x), F.coalesce(F.try_element_at(known, x), F.array().cast("array<string>")))
    grown = lambda held, x: F.slice(F.flatten(F.transform(held, lambda p: F.transform(options(x), lambda o: F.concat(p, o)))), 1, most)
    return F.aggregate(letters, F.array(F.lit("")), grown)


def compact_number(c: Column, width: int = 6) -> Column:
    """Only the letters and digits, digits alone padded with zeros."""
    t = compact(c)
    return F.when(t.rlike("^[0-9]+$") & (F.length(t) < width), F.lpad(t, width, "0")).otherwise(t)


def compact_model(c: Column) -> Column:
    """Only the letters and digits of a model code, its number marks (Nº 2, NO 2) read as N2."""
    marked = F.regexp_replace(c, "(?i)\\bN[º°]\\s*(?=[0-9])", "N")
    return F.regexp_replace(F.regexp_replace(fold(marked), "\\bNO\\s*(?=[0-9])", "N"), "[^A-Z0-9]+", "")


def names_model(written: Column, designation: Column, least: int = 4) -> Column:
    """Whether a designation is of the model written: holds it, as written or in letters and digits alone, with any choice
    of 0 and O, or has it before its first dash."""
    return model_named(model_written(written), model_designated(designation, least), least)


def model_written(c: Column) -> Column:
    """What `model_named` takes of a model as written."""
    model = F.upper(F.trim(c))
    return F.struct(model.alias("model"), zero_choices(model).alias("choices"), zero_choices(compact_model(c)).alias("bare"))


def model_designated(c: Column, least: int = 4) -> Column:
    """What `model_named` takes of a designation."""
    whole = F.upper(F.trim(c))
    first = before_dash(whole)
    hay = F.filter(F.array(compact_model(c), compact_model(first)), lambda h: F.length(h) >= least)
    return F.struct(whole.alias("whole"), first.alias("first"), hay.alias("hay"))


def model_named(written: Column, designated: Column, least: int = 4) -> Column:
    """names_model of both sides, each made ready by itself."""
    model, whole, first = written["model"], designated["whole"], designated["first"]
    inside = F.exists(written["bare"], lambda v: (F.length(v) >= least) & F.exists(designated["hay"], lambda h: F.contains(h, v)))
    known = (F.length(model) >= least) & (whole != "")
    return F.coalesce(known & (F.contains(whole, model) | ((first != "") & F.array_contains(written["choices"], first)) | inside), F.lit(False))


def swap(c: Column, k: Column) -> Column:
    """The text with its k-th 0 or O turned into the other; unchanged if it has fewer."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1)).isin("0", "O"))
    at = F.get(places, k - 1)
    letter = F.substring(c, at, F.lit(1))
    other = F.when(letter == "0", "O").otherwise("0")
    return F.when(at.isNull(), c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), other, F.substring(c, at + 1, F.length(c))))


def zero_key(c: Column) -> Column:
    """Equal for texts that differ by 0 and O only."""
    return F.translate(F.upper(c), "O", "0")


def code_tokens(c: Column) -> Column:
    """Words of four characters or more with a digit and a letter."""
    return F.filter(F.regexp_extract_all(fold(c), F.lit("[A-Z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & w.rlike("[A-Z]") & w.rlike("[0-9]"))


def before_dash(c: Column) -> Column:
    return F.trim(F.get(F.split(c, " - "), F.lit(0)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def label(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A sector's or machine's label: folded, separators as one space, some words read as others."""
    text = F.trim(F.regexp_replace(fold(c), r"[\s\-_/.]+", " "))
    return reduce(lambda x, pair: F.regexp_replace(x, rf"\b{pair[0]}\b", pair[1]), (aliases or {}).items(), text)


#: Tools that a cell may name.
TOOLS = ("CONI", "TORRES", "OCT", "CIL", "CIO", "CIB")


def tool(c: Column) -> Column:
    """A tool's name or number as it is kept: known names without punctuation, numbers as written, decimals with a comma;
    empty for nothing, null for anything else."""
    t = F.trim(F.coalesce(c, F.lit("")))
    decimal = r"^([0-9]{1,3})\s*[.,]\s*([0-9]{1,2})$"
    token = compact(t)
    return F.when(t.rlike(decimal), F.regexp_replace(t, decimal, "$1,$2")).when((token == "") | token.rlike("^[0-9]+$") | token.isin(*TOOLS), token)


def personnel_number(code: Column) -> Column:
    """The eight digits of a short code: 1000 and the code in four digits; longer codes as they are, 0 and others null."""
    n = F.regexp_replace(F.trim(code), "^0+", "").try_cast("long")
    return F.when((n > 0) & (n < 10_000), F.concat(F.lit("1000"), F.lpad(n.cast("string"), 4, "0"))).when(n > 0, n.cast("string"))


def number(c: Column) -> Column:
    """A cell's number, with a decimal comma or point."""
    return F.trim(F.replace(c, F.lit(","), F.lit("."))).try_cast("double")


def _time(c: Column, rest: Column, full: bool) -> Column:
    """Hours and minutes on both sides of a colon or else the first blank, digits alone; else `rest`."""
    h, m = (F.regexp_extract(c, "^([0-9]+)[: ]([0-9]+)$", i) for i in (1, 2))
    hours, minutes = h.try_cast("int"), m.try_cast("int")
    fine = (minutes < 60) & ((hours < 24) | ((hours == 24) & (minutes == 0) if full else F.lit(False)))
    return F.when(c.rlike("[: ]"), F.coalesce(fine, F.lit(False))).otherwise(rest)


def fits(kind: str, c: Column) -> Column:
    """Whether a cell that isn't empty has the form of its kind."""
    t = F.trim(c)
    n = number(t)
    if kind == "priority":
        fine = ~t.rlike("^[0-9]{6}$") & (F.upper(t).rlike("^[A-Z]$") | F.upper(t).rlike(r"^([A-Z]?[0-9]{1,3}|P\.?[0-9]|REP\.?\s?C?[0-9]+)$"))
    elif kind == "count":
        fine = t.rlike("^[0-9]{1,4}$")
    elif kind == "operator":
        fine = t.rlike("^[0-9]{1,5}$")
    elif kind == "machine":
        fine = F.upper(t).rlike("^M[0-9]{3}$")
    elif kind == "amount":
        fine = F.coalesce(n >= 0, F.lit(False))
    elif kind == "whole":
        fine = F.coalesce((n >= 0) & (F.abs(n - F.round(n)) <= 1e-9), F.lit(False))
    elif kind == "mark":
        fine = F.upper(t) == "X"
    elif kind == "digit":
        fine = t.rlike("[0-9]")
    elif kind == "time":
        fine = _time(t, F.lit(False), False)
    elif kind == "yes_no":
        fine = F.upper(F.translate(t, ACCENTED, PLAIN)).isin("SIM", "S", "NAO", "N", "YES", "Y", "NO") | t.isin("✓", "✔", "✗")
    elif kind == "hours":
        bare = F.trim(F.regexp_replace(t, "[hH]+$", ""))
        h, m = F.regexp_extract(bare, "^([0-9]{1,2})[0-9]{2}$", 1).try_cast("int"), F.regexp_extract(bare, "^[0-9]{1,2}([0-9]{2})$", 1).try_cast("int")
        clock = F.coalesce((m < 60) & ((h < 24) | ((h == 24) & (m == 0))), F.lit(False))
        fine = (bare != "") & _time(bare, clock | F.coalesce(number(bare).between(0, 24), F.lit(False)), True)
    elif kind == "date":
        part = lambda p, i: F.regexp_extract(t, p, i)
        day_first, year_first = r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})$", r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$"
        iso = F.when(t.rlike(day_first), F.concat_ws("-", part(day_first, 4), F.lpad(part(day_first, 3), 2, "0"), F.lpad(part(day_first, 1), 2, "0"))).when(t.rlike(year_first), F.concat_ws("-", part(year_first, 1), F.lpad(part(year_first, 3), 2, "0"), F.lpad(part(year_first, 4), 2, "0")))
        fine = iso.try_cast("date").isNotNull()
    else:
        raise ValueError(kind)
    return F.coalesce((t != "") & fine, F.lit(False))


def formatted(field: str, c: Column) -> Column:
    """A cell's value as it is kept: thickness in up to six significant digits with a comma, other measures as the nearest
    whole number (halves to the even one), texts trimmed."""
    t, n = F.trim(F.coalesce(c, F.lit(""))), number(c)
    if field == "esp":
        digits = F.regexp_replace(F.regexp_replace(F.round(n, 4).cast("decimal(18,4)").cast("string"), "0+$", ""), r"\.$", "")
        return F.when((t != "") & n.isNotNull(), F.replace(digits, F.lit("."), F.lit(","))).otherwise(t)
    if field in ("comp_mm", "larg_mm", "lbase", "ltopo", "dbase", "dtopo", "qtd"):
        return F.when((t != "") & n.isNotNull(), F.bround(n, 0).cast("long").cast("string")).otherwise(t)
    return t


def neutral(c: Column, sheet: bool = False) -> Column:
    """A cell that a spreadsheet won't take for a formula: what could begin one gets an apostrophe before it."""
    return F.when(c.rlike("^=" if sheet else "^[=+\\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def leaf(path: Column) -> Column:
    """The last part of a path; the path itself if it has one part."""
    return F.substring_index(path, ".", -1)


def general_path(path: Column) -> Column:
    """rows[3].x as rows[].x."""
    return F.regexp_replace(path, r"\[[0-9]+\]", "[]")


def row_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^rows\[([0-9]+)\]", 1).try_cast("int")


def swap_columns(pri: Column, of: Column) -> Column:
    """(pri, of, flags): an order number written in the priority's place and the reverse are put right; a number in
    either place that doesn't fit is flagged."""
    long_pri, short_of = pri.rlike("^[0-9]{5,6}$"), of.rlike("^[0-9]{1,3}$")
    swapped = F.coalesce(long_pri & (short_of | of.isNull() | (F.trim(of) == "")), F.lit(False))
    flags = F.array_compact(F.array(F.when(swapped, "swapped"), F.when(~swapped & long_pri, "priority_like_order"), F.when(~swapped & short_of, "order_like_priority")))
    return F.struct(F.when(swapped, of).otherwise(pri).alias("pri"), F.when(swapped, pri).otherwise(of).alias("of"), flags.alias("flags"))
