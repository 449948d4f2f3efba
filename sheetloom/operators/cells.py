"""Decisions cell by cell: local rules, the winner's value, lots, head and foot of a sheet, learnt spellings, bits of codes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import likeness, numbers_match

NUMBERS = ("comp_mm", "larg_mm", "lbase", "ltopo", "esp", "dbase", "dtopo")
#: How far a measure may be off before it is shown as very different, and where texts are.
VERY_DIFFERENT = {"comp_mm": 200.0, "larg_mm": 50.0, "lbase": 30.0, "ltopo": 30.0, "esp": 0.5, "dbase": 30.0, "dtopo": 30.0}
VERY_DIFFERENT_TEXT = 50.0
#: The form that the cells of a field must have where no reference tells.
LOCAL = {"pri": "priority", "qtd": "count", "qtd_metros": "amount", "m2": "amount", "sobras": "amount", "sucata": "amount", "fecho": "mark", "cesta_n": "digit", "inicio": "time", "fim": "time", "duracao": "hours", "resolvido": "yes_no"}


def cell(value: Column, status: Column | str, source: str, kind: Column | None = None, reason: Column | None = None) -> Column:
    """(value, status, source, kind, reason) as one struct."""
    none = F.lit(None).cast("string")
    status = F.lit(status) if isinstance(status, str) else status
    return F.struct(value.alias("value"), status.alias("status"), F.lit(source).alias("source"), (none if kind is None else kind).alias("kind"), (none if reason is None else reason).alias("reason"))


def local(field: str, written: Column, has_winner: Column) -> Column:
    """The cell of a field that no reference has: confirmed if its form is right, or a row's winner stands for it (but for a
    mark, which is X or nothing); an empty one is right beside a winner, and tells nothing without."""
    t = F.trim(F.coalesce(written, F.lit("")))
    fine = text.fits(LOCAL[field], t) if field in LOCAL else F.lit(True)
    forced = has_winner & F.lit(field != "fecho")
    empty = F.when(has_winner, cell(t, "confirmed", "syntax", F.lit("RULE"))).otherwise(cell(t, "NA", "written"))
    return F.when(t == "", empty).when(fine, cell(t, "confirmed", "syntax", F.lit("RULE"))).when(forced, cell(t, "confirmed", "syntax", F.lit("RULE_FORCED"))).otherwise(cell(t, "very_different", "syntax"))


def very_different(field: str, written: Column, proposed: Column) -> Column:
    """Whether a proposal is so far from what was written that someone has to look."""
    if field in NUMBERS:
        a, b = text.number(written), text.number(proposed)
        far = F.abs(a - b) > VERY_DIFFERENT[field]
        if field == "esp":
            lost = F.array_compact(F.array(a, F.when(F.trim(written).rlike("^[0-9]{2}$") & (a / 10).between(0.5, 15), a / 10)))
            far = far & ~numbers_match(lost, b, 0.05)
        out = F.coalesce(far, F.lit(False))
    elif field == "modelo":
        out = ~text.names_model(written, proposed) & (likeness(text.compact_model(written), text.compact_model(proposed)) < VERY_DIFFERENT_TEXT)
    else:
        out = likeness(written, proposed) < VERY_DIFFERENT_TEXT
    return F.coalesce((F.trim(written) != "") & (F.trim(proposed) != "") & out, F.lit(False))


def finished(field: str, written: Column, proposed: Column, source: str = "plan") -> Column:
    """The cell of a concrete proposal, whose value always takes the written one's place: confirmed if they are alike as
    they are kept, very_different if far apart, else snapped, also where only the case differs or nothing was written."""
    a, b = text.formatted(field, written), text.formatted(field, proposed)
    cased = (a != "") & (b != "") & (F.lower(a) == F.lower(b))
    status = F.when((a != "") & (a == b), "confirmed").when(cased | (a == ""), "snapped").when(very_different(field, written, proposed), "very_different").otherwise("snapped")
    return cell(b, status, source, reason=F.when(cased & (a != b), "canonical_case"))


def decided(field: str, written: Column, proposed: Column, has_winner: Column, has_reference: Column, ambiguous: Column, elsewhere: Column, sibling: Column, likely: Column) -> Column:
    """The cell of a field that references have. Without winner or proposal the written value stays, to be looked at, and an
    empty cell tells nothing; a winner without a value for the field confirms what is written. A proposal takes the
    cell; it is very_different where sibling entries or rivals would give another value, or the written number is another
    entry's."""
    t, p = F.trim(F.coalesce(written, F.lit(""))), F.trim(F.coalesce(proposed, F.lit("")))
    shown = text.formatted(field, p)
    conflict = elsewhere if field in ("of", "ov") else F.lit(False)
    unsure = sibling if field == "modelo" else F.lit(False)
    to_check = lambda why: cell(shown, "very_different", "plan", reason=why)
    none = F.when(t == "", cell(t, "NA", "written")).otherwise(cell(t, "very_different", "written"))
    no_value = F.when(t == "", cell(t, "confirmed", "syntax", F.lit("RULE"))).otherwise(cell(text.formatted(field, t), "confirmed", "syntax", F.lit("FORCED_WITHOUT_VALUE")))
    return (
        F.when(~has_winner & (~has_reference | (p == "")), none)
        .when(p == "", no_value)
        .when(has_winner & unsure, to_check(F.lit("ambiguous_sibling")))
        .when(has_winner & ambiguous & (F.coalesce(likely, F.lit(0.0)) < 1.0), to_check(F.lit("ambiguous_rival")))
        .when(has_winner & (t != "") & conflict, to_check(F.lit("identifier_conflict")))
        .otherwise(finished(field, t, p))
    )


def declared(written: Column, reference: Column, kind: str, tolerance: float = 0.0) -> Column:
    """A declared column held against what was written: never written back, its status only tells whether they agree."""
    t, r = F.trim(F.coalesce(written, F.lit(""))), F.trim(F.coalesce(reference, F.lit("")))
    if kind == "num":
        got, want = text.number(t), text.number(r)
        status = F.when(want.isNull(), "NA").when(F.coalesce(F.abs(got - want) <= tolerance, F.lit(False)), "confirmed").otherwise("very_different")
    else:
        a, b = text.fold(t), text.fold(r)
        status = F.when((a == b) | (likeness(a, b) >= 55.0), "confirmed").otherwise("very_different")
    return cell(t, F.when((t == "") | (r == ""), "NA").otherwise(status), "declared_plan")


# -- what is written elsewhere in the references --------------------------------------------------------------------


def points_elsewhere(rows: DataFrame, plan: DataFrame, field: str) -> DataFrame:
    """rows (row_id, written, proposed) with elsewhere: the written number isn't the proposed one, but another entry's."""
    form = (lambda c: text.compact_number(F.col(c))) if field == "of" else (lambda c: text.compact(F.col(c)))
    known = plan.select(form(field).alias("_k")).where("_k != ''").distinct().withColumn("_known", F.lit(True))
    out = rows.withColumns({"_w": form("written"), "_p": form("proposed")}).join(known, F.col("_w") == F.col("_k"), "left")
    same = F.arrays_overlap(text.zero_choices(F.col("_w")), text.zero_choices(F.col("_p")))
    return out.withColumn("elsewhere", F.coalesce(F.col("_known") & (F.col("_p") != "") & ~same, F.lit(False))).drop("_w", "_p", "_k", "_known")


def reference_pool(plan: DataFrame, stock: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, available, source): whether there is anything a field's cells can be held against, and where; fields: written
    field -> the plan's column, or "lot" for lots. One pass over each table."""
    in_plan = [f for f, c in fields.items() if c != "lot"]
    counts = plan.agg(*[F.count(F.when(F.trim(F.col(fields[f]).cast("string")) != "", 1)).alias(f) for f in in_plan])
    lots = stock.agg(F.count("*").alias("lot"))
    both = counts.crossJoin(F.broadcast(lots))  # one row each
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (F.col("lot" if c == "lot" else f) > 0).alias("available"), F.lit("stock" if c == "lot" else "plan").alias("source")) for f, c in fields.items()])
    return both.select(F.inline(rows))


def lots(rows: DataFrame, stock: DataFrame) -> DataFrame:
    """rows (row_id, lote, larg, esp: an array of readings) with lot, stock_larg, stock_esp, divergences and how: the lot as
    written or with its prefix M (exact); one that begins with H read as M if no measure on the row is far from that
    lot's (corrected), else only to be looked at (rejected); else none."""
    s = stock.select(F.upper(F.trim("lote")).alias("_lot"), F.col("larg").alias("_larg"), F.col("esp").alias("_esp"))
    raw = F.upper(F.trim(F.coalesce("lote", F.lit(""))))
    names = F.array_compact(F.array(F.struct(F.lit(0).alias("tier"), raw.alias("n")), F.when(raw.rlike("^[0-9]{2}B"), F.struct(F.lit(1).alias("tier"), F.concat(F.lit("M"), raw).alias("n"))), F.when(raw.rlike("^H."), F.struct(F.lit(2).alias("tier"), F.concat(F.lit("M"), F.substring(raw, 2, 1000)).alias("n")))))
    met = rows.select("row_id", F.inline(names)).join(s, F.col("n") == F.col("_lot"))
    best = met.groupBy("row_id").agg(F.min(F.struct("tier", "n", "_larg", "_esp")).alias("b"))
    out = rows.join(best, "row_id", "left")
    off = lambda near, field: F.coalesce(near > VERY_DIFFERENT[field], F.lit(False))
    wide = off(F.abs(F.col("larg") - F.col("b._larg")), "larg_mm")
    thick = off(F.array_min(F.transform("esp", lambda v: F.abs(v - F.col("b._esp")))), "esp")
    apart = F.array_compact(F.array(F.when(wide, "larg_mm"), F.when(thick, "esp")))
    how = F.when(F.col("b").isNull(), "none").when(F.col("b.tier") < 2, "exact").when(F.size(apart) == 0, "corrected").otherwise("rejected")
    return out.withColumns({"how": how, "lot": F.col("b.n"), "divergences": F.concat_ws(",", apart)}).withColumns({"stock_larg": F.when(F.col("how").isin("exact", "corrected"), F.col("b._larg")), "stock_esp": F.when(F.col("how").isin("exact", "corrected"), F.col("b._esp"))}).drop("b")


def footer_total(rows: DataFrame, written: DataFrame) -> DataFrame:
    """(sheet_id, total, derived): the number of pieces at a sheet's foot, or where it is blank the sum of its rows' whole
    quantities, if any is one."""
    n = text.number(F.col("qtd"))
    fine = F.when((n >= 0) & (F.abs(n - F.round(n)) <= 1e-9), F.round(n).cast("long"))
    sums = rows.groupBy("sheet_id").agg(F.sum(fine).alias("_sum"))
    own = F.when(F.trim("total") != "", F.trim("total"))
    return written.join(sums, "sheet_id", "left").select("sheet_id", F.coalesce(own, F.col("_sum").cast("string")).alias("total"), (own.isNull() & F.col("_sum").isNotNull()).alias("derived"))


def heads(sheets: DataFrame, people: DataFrame, machines: DataFrame) -> DataFrame:
    """(sheet_id, operator_status, machine_status, date_status): a sheet's head held against people (pernr, name), machines
    (code) and the form of dates. The short code counts as the end of the long one."""
    p = people.select(F.regexp_replace(F.trim("pernr"), "^1000", "").try_cast("int").alias("_code"), text.fold(F.trim("name")).alias("_name"))
    out = sheets.withColumn("_c", F.regexp_replace(F.trim("code"), "^(1000(?=[0-9]{4}$)|0+)", "").try_cast("int")).join(p, F.col("_c") == F.col("_code"), "left")
    out = out.join(machines.select(F.upper(F.trim("machine")).alias("_m")).distinct(), F.upper(F.trim("machine")) == F.col("_m"), "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    person = F.when(blank("code") & blank("name"), "NA").when(F.col("_code").isNull(), "very_different").when(text.fold(F.trim("name")) == F.col("_name"), "confirmed").otherwise("snapped")
    machine = F.when(blank("machine"), "NA").when(F.col("_m").isNotNull(), "confirmed").otherwise("very_different")
    date = F.when(blank("date"), "NA").when(text.fits("date", F.col("date")), "confirmed").otherwise("very_different")
    return out.select("sheet_id", person.alias("operator_status"), machine.alias("machine_status"), date.alias("date_status"))


def learnt_case(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (row_id, template, field, value) with canonical: the learnt spelling of a value that is equal but for case, by a
    rule (scope, field, folded, canonical) of the template, else by one of all templates (*)."""
    out = rows.withColumn("_f", F.lower(F.trim("value")))
    for i, scope in enumerate((F.col("template"), F.lit("*"))):
        r = rules.groupBy(F.col("scope").alias(f"_s{i}"), F.col("field").alias(f"_n{i}"), F.col("folded").alias(f"_k{i}")).agg(F.min("canonical").alias(f"_c{i}"))
        out = out.join(r, (scope == F.col(f"_s{i}")) & (F.col("field") == F.col(f"_n{i}")) & (F.col("_f") == F.col(f"_k{i}")), "left")
    return out.select(*rows.columns, F.coalesce("_c0", "_c1").alias("canonical"))


# -- bits of model codes ----------------------------------------------------------------------------------------------

#: Pairs of characters that are read for each other, and the most that such a substitution costs.
GLYPHS = ("0O", "1I", "1L", "17", "38", "5S", "8B", "6G", "2Z", "7T", "4A", "9G", "0D", "65", "94", "35", "27", "14", "MH", "EF")
GLYPH_BITS = 7.0
#: By which identity fields agree together, how often they are all written right.
JOINT_M = {"of": 0.694, "ov": 0.469, "cliente": 0.387, "of+ov": 0.411, "of+cliente": 0.276, "ov+cliente": 0.258, "of+ov+cliente": 0.219}
JOINT_U = {"of": 0.0002, "ov": 0.00068, "cliente": 0.02264}


def glyph_cost(a: Column, b: Column, cost: Column) -> Column:
    """A cost in bits, at most GLYPH_BITS if two codes differ in one character that is read for the other."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.get(places, F.lit(0))
    pair = F.concat(F.substring(a, first, F.lit(1)), F.substring(b, first, F.lit(1)))
    known = pair.isin(*GLYPHS, *[g[::-1] for g in GLYPHS])
    return F.when((cost > GLYPH_BITS) & (F.length(a) == F.length(b)) & (F.size(places) == 1) & known, F.least(cost, F.lit(GLYPH_BITS))).otherwise(cost)


def neighbours(cores: DataFrame, tokens: DataFrame) -> DataFrame:
    """(core, token): codes of which one may be the other misread: lengths at most 2 apart, and the first or the last two
    characters alike. cores (core), tokens (token), distinct."""
    ends = lambda c: F.array(F.concat(F.lit("P"), F.substring(c, 1, 2)), F.concat(F.lit("S"), F.substring(c, -2, 2)))
    a = cores.select("core", F.explode(ends("core")).alias("_e"))
    b = tokens.select("token", F.explode(ends("token")).alias("_e"))
    return a.join(b, "_e").where(F.abs(F.length("core") - F.length("token")) <= 2).select("core", "token").distinct()


def channel_likeness(cost: Column, span: float = 25.0, cap: float = 0.25, top: float = 0.80) -> Column:
    """The likeness of a code read as another at a cost in bits: from 0.55 to at most `top`, 0 from `span` on."""
    gain = F.greatest(F.lit(0.0), F.least(F.lit(cap), 1 - cost / span))
    return F.when(gain > 0, F.least(F.lit(top), 0.55 + gain)).otherwise(0.0)


def code_bits(cores: DataFrame, tokens: DataFrame, plan_size: int, cost, span: float = 25.0, alpha: float = 1.0, m: float = 0.524, cap: float = 15.0, floor: float = -1.1, smallest: int = 1000) -> DataFrame:
    """(core, token, bits) of the written codes and the codes of the plan (token, n: entries) that may be meant: log2 of how
    likely the code is written so over how likely any entry's would be: log2(m) - cost - log2(u), where u sums
    2 ** -cost over the code's neighbours, each times its entries, and `alpha` for unknown ones, over the plan's size."""
    met = neighbours(cores, tokens.select("token")).join(tokens, "token").withColumn("cost", cost(F.col("token"), F.col("core"))).withColumn("cost", glyph_cost(F.col("token"), F.col("core"), F.col("cost"))).where(F.col("cost") <= span)
    w = Window.partitionBy("core")
    u = (F.sum(F.pow(F.lit(2.0), -F.col("cost")) * F.col("n")).over(w) + alpha) / float(max(plan_size, smallest))
    bits = F.log2(F.lit(m)) - F.col("cost") - F.log2(u)
    return met.withColumn("bits", F.greatest(F.least(bits, F.lit(cap)), F.lit(floor))).select("core", "token", F.round("bits", 6).alias("bits"))


def joint_support(agreeing: list[tuple[str, Column]], common: Column, size: Column) -> Column:
    """Bits of identity fields that agree together: log2 of how often they are written right together over how common their
    values are together, that at least the product of what they are by chance."""
    names = F.concat_ws("+", *[F.when(c, F.lit(f)) for f, c in agreeing])
    known = F.create_map(*[x for k, v in JOINT_M.items() for x in (F.lit(k), F.lit(v))])
    floor = reduce(lambda a, b: a * b, [F.when(c, F.lit(JOINT_U[f])).otherwise(1.0) for f, c in agreeing])
    return F.when(names != "", F.log2(F.coalesce(F.try_element_at(known, names), F.lit(0.2)) / F.greatest(common / size, floor)))


def row_denominator(rows: DataFrame, plan: DataFrame, m: dict[str, float], smallest: int = 1000) -> DataFrame:
    """(row_id, bits): log2 of how likely a row's written identity fields are for any entry: over the entries that share one of
    them, the product of m where a field is equal and of (1 - m) times chance where not, over the plan's size; at least
    the product of chances."""
    fields = list(m)
    written = lambda f: F.coalesce(F.col(f) != "", F.lit(False))
    every = [c for n in range(1, len(fields) + 1) for c in combinations(fields, n)]
    # entries equal in all fields of a set, counted once for each combination of values, then those equal in no others
    held = rows
    for i, c in enumerate(every):
        counts = plan.groupBy(*[F.col(f).alias(f"_e_{f}") for f in c]).agg(F.count("*").alias(f"_c{i}"))
        equal = reduce(lambda a, b: a & b, [(F.col(f) == F.col(f"_e_{f}")) & written(f) for f in c])
        held = held.join(counts, equal, "left").drop(*[f"_e_{f}" for f in c])
    equal_in = {c: F.coalesce(f"_c{i}", F.lit(0)) for i, c in enumerate(every)}
    alone = {c: reduce(lambda a, b: a + b, [(-1) ** (len(x) - len(c)) * equal_in[x] for x in every if set(c) <= set(x)]) for c in every}
    k = lambda f, c: F.when(~written(f), 1.0).otherwise(m[f] if f in c else (1 - m[f]) * JOINT_U[f])
    total = reduce(lambda a, b: a + b, [alone[c] * reduce(lambda a, b: a * b, [k(f, c) for f in fields]) for c in every])
    size = plan.agg(F.greatest(F.count("*"), F.lit(smallest)).cast("double").alias("_n"))
    floor = reduce(lambda a, b: a * b, [F.when(F.coalesce(F.col(f) != "", F.lit(False)), m[f] * JOINT_U[f]).otherwise(1.0) for f in fields])
    out = held.crossJoin(F.broadcast(size))  # one row
    return out.select("row_id", F.round(F.log2(F.greatest(total / F.col("_n"), floor, F.lit(1e-30))), 6).alias("bits"))


def variant(label: str) -> tuple[str, frozenset[str]]:
    """A variant's label as its base and its features: base+feature+feature; without a base, the one in use."""
    base, *features = label.strip().split("+")
    return base or "current", frozenset(f for f in features if f)
