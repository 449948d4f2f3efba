"""Each function that reads or compares cells, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, similarity, text
from ..operators import evaluation, formula, linkage, ordered, templates, workorders
from .evaluation_queries import CASES, RUNS, cases, runs
from .registry import query
from .tables import FACT, LIKE, SHEET, facts, read, sheets


def picked(values: tuple[str, ...], key: str) -> Column:
    """One of some values by a key."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def over_part(*values: tuple[str, ...]) -> tuple[str, Callable[[SparkSession, str], DataFrame]]:
    """(SQL of a table (k, t, t1) of values picked for each part, the same as a function)."""
    keys = dict(zip(("t", "t1"), ("p_partkey", "p_size"), strict=False))
    asked = list(zip(keys.items(), values, strict=False))
    quoted = lambda v: ", ".join("'" + x.replace("'", "''") + "'" for x in v)
    sql = ", ".join(f"([{quoted(v)}])[{key} % {len(v)} + 1] AS {name}" for (name, key), v in asked)
    return f"s AS (SELECT p_partkey AS k, {sql} FROM part)", lambda spark, d: read(spark, d, "part").select(F.col("p_partkey").alias("k"), *[picked(v, key).alias(name) for (name, key), v in asked])


WORDS = ("Açúcar é bom", "  CLIENT-A  ", "a-1 é/2", "ÀÉÎÕÜ ç ñ", "", "x_y.z 12", "9-4-2026", "09/4/2026", "9.12.2026", "Pav. 4 - MTG2", "AB12 - CC4H1 x9", "100001", " 123 ", "12a", "123.0")
SQL, SOURCE = over_part(WORDS)
FOLD = "upper(regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g'))"


@query("x1_fold", f"WITH {SQL} SELECT k, {FOLD} AS folded, regexp_replace({FOLD}, '[^A-Z0-9]', '', 'g') AS compact FROM s")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return SOURCE(spark, d).select("k", text.fold(F.col("t")).alias("folded"), text.compact(F.col("t")).alias("compact"))


@query("x2_comparable", f"WITH {SQL} SELECT k, CASE t WHEN '9-4-2026' THEN '09-04-2026' WHEN '09/4/2026' THEN '09/04/2026' WHEN '9.12.2026' THEN '09.12.2026' ELSE lower(trim(strip_accents(t))) END AS c FROM s")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return SOURCE(spark, d).select("k", text.comparable(F.col("t")).alias("c"))


@query("x4_tokens", f"WITH {SQL} SELECT k, array_to_string(list_transform(list_filter(string_split(regexp_replace({FOLD}, '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w <> 'E'), lambda w: CASE WHEN w = 'BOM' THEN 'BOA' ELSE w END), ' ') AS tokens FROM s")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return SOURCE(spark, d).select("k", F.array_join(text.tokens(F.col("t"), ("E",), {"BOM": "BOA"}), " ").alias("tokens"))


@query("x5_order_number", f"WITH {SQL} SELECT k, CASE WHEN regexp_matches(trim(t), '^\\d+$') AND length(trim(t)) < 6 THEN lpad(trim(t), 6, '0') WHEN trim(t) <> '' THEN trim(t) END AS strict, CASE WHEN t = '123.0' THEN '000123' WHEN regexp_matches(trim(t), '^\\d+$') AND length(trim(t)) < 6 THEN lpad(trim(t), 6, '0') WHEN trim(t) <> '' THEN trim(t) END AS loose FROM s")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return SOURCE(spark, d).select("k", text.order_number(F.col("t")).alias("strict"), text.order_number_loose(F.col("t")).alias("loose"))


@query("x6_zero_variants", "WITH v AS (SELECT p_partkey AS k, p_partkey % 2 AS a, p_size % 2 AS b FROM part) SELECT k, string_agg(DISTINCT x || '1' || y || 'Z', ',' ORDER BY x || '1' || y || 'Z') AS variants FROM v, (SELECT unnest(['0', 'O']) AS x), (SELECT unnest(['0', 'O']) AS y) GROUP BY k")
def x6(spark: SparkSession, d: str) -> DataFrame:
    letter = lambda c: F.when(c % 2 == 0, "0").otherwise("O")
    t = F.concat(letter(F.col("p_partkey")), F.lit("1"), letter(F.col("p_size")), F.lit("Z"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.array_sort(text.zero_choices(t)), ",").alias("variants"))


PAIRS = "v AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part UNION SELECT DISTINCT p_name, replace(p_name, 'e', '') FROM part)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).union(p.select("p_name", F.replace("p_name", F.lit("e"), F.lit("")))).distinct()


@query("x8_edits", f"WITH {PAIRS} SELECT a, b, CASE WHEN abs(length(a) - length(b)) > 5 THEN 999 ELSE levenshtein(a, b) END AS edits FROM v")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("a", "b", similarity.edits(F.col("a"), F.col("b")).alias("edits"))


@query("x9_likeness", f"WITH {PAIRS} SELECT a, b, {LIKE.format(a='a', b='b')} AS likeness FROM v")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("a", "b", similarity.likeness(F.col("a"), F.col("b")).alias("likeness"))


@query("x11_channel_cost", f"WITH {PAIRS} SELECT a, b, levenshtein(a, b)::DOUBLE AS cost FROM v")
def x11(spark: SparkSession, d: str) -> DataFrame:
    """Without known substitutions each edit costs one."""
    return pairs(spark, d).select("a", "b", similarity.channel_cost({})(F.col("a"), F.col("b")).alias("cost"))


@query("x14_ratio")
def x14(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("a", "b", F.round(similarity.ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("x15_one_character", "WITH v AS (SELECT DISTINCT p_name AS a, translate(p_name, 'q', 'k') AS b FROM part) SELECT a, length(a) - length(replace(a, 'q', '')) = 1 AS one FROM v")
def x15(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_name").alias("a")).distinct().select("a", similarity.swapped_digit(F.col("a"), F.translate("a", "q", "k")).alias("one"))


@query("x16_sorted_ratio")
def x16(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("a", "b", F.round(similarity.sorted_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("x18_code_tokens", f"WITH {SQL} SELECT k, array_to_string(list_filter(regexp_extract_all({FOLD}, '[A-Z0-9]+'), lambda w: length(w) >= 4 AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]')), ' ') AS codes, trim(split_part(t, ' - ', 1)) AS first FROM s")
def x18(spark: SparkSession, d: str) -> DataFrame:
    """Code tokens (X18), and what stands before a dash."""
    return SOURCE(spark, d).select("k", F.array_join(text.code_tokens(F.col("t")), " ").alias("codes"), text.before_dash(F.col("t")).alias("first"))


@query("x22_label", f"WITH {SQL} SELECT k, regexp_replace(trim(regexp_replace({FOLD}, '[\\s\\-_/.]+', ' ', 'g')), '\\bPAV\\b', 'PAVILHAO', 'g') AS label, regexp_replace(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM s")
def x22(spark: SparkSession, d: str) -> DataFrame:
    """Labels (X22) and slugs."""
    return SOURCE(spark, d).select("k", text.label(F.col("t"), {"PAV": "PAVILHAO"}).alias("label"), text.slug(F.col("t")).alias("slug"))


SWAP_SQL, SWAP = over_part(("123456", "A1", "12345", "7", ""), ("12", "100001", "", "999", "P.3"))


@query("x23_swapped", f"WITH {SWAP_SQL}, f AS (SELECT *, regexp_matches(t, '^\\d{{5,6}}$') AND (regexp_matches(t1, '^\\d{{1,3}}$') OR trim(t1) = '') AS sw FROM s) SELECT k, CASE WHEN sw THEN t1 ELSE t END AS pri, CASE WHEN sw THEN t ELSE t1 END AS of, concat_ws(',', CASE WHEN sw THEN 'swapped' END, CASE WHEN NOT sw AND regexp_matches(t, '^\\d{{5,6}}$') THEN 'priority_like_order' END, CASE WHEN NOT sw AND regexp_matches(t1, '^\\d{{1,3}}$') THEN 'order_like_priority' END) AS flags FROM f")
def x23(spark: SparkSession, d: str) -> DataFrame:
    s = SWAP(spark, d).select("k", text.swap_columns(F.col("t"), F.col("t1")).alias("x"))
    return s.select("k", "x.pri", "x.of", F.concat_ws(",", "x.flags").alias("flags"))


@query("m2_finished", "SELECT p_partkey, round_even(p_size / 7, 2) AS plain, CASE WHEN p_size % 5 <> 0 THEN CAST(round_even((p_size % 5) / 2, 0) AS BIGINT) END AS whole, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE round_even(p_size / 3, 2) END AS filled FROM part")
def m2(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    half = F.when(size % 5 != 0, (size % 5) / 2)
    return read(spark, d, "part").select("p_partkey", formula.finished(size / 7).alias("plain"), formula.finished(half, 0).alias("whole"), formula.finished(F.when(size % 3 != 0, size / 3), 2, fallback=0.0).alias("filled"))


@query("m3_slices", "WITH v AS (SELECT p_partkey, p_retailprice AS w, p_size * 10.0::DOUBLE AS b, p_size * 8.0::DOUBLE AS t, p_partkey % 3 = 0 AS longer FROM part) SELECT p_partkey, CASE WHEN w > b * 3 + t * 3 THEN 6 WHEN w > b * 3 + t * 2 THEN 5 WHEN w > b * 2 + t * 2 THEN 4 WHEN w > b * 2 + t THEN 3 WHEN w > b + t THEN 2 WHEN w > b AND longer THEN 2 WHEN w > b THEN 1 ELSE 0 END AS n FROM v")
def m3(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    wanted = F.when(F.col("p_partkey") % 3 == 0, 800.0).otherwise(950.0)
    return read(spark, d, "part").select("p_partkey", workorders.slices_of(F.col("p_retailprice"), size * 10.0, size * 8.0, F.lit(1000.0), wanted).alias("n"))


@query("m4_piece_weight", "WITH v AS (SELECT p_partkey, (p_partkey % 9)::DOUBLE AS n, p_size * 50.0::DOUBLE AS b, p_size * 40.0::DOUBLE AS t, p_retailprice * 15 AS l, p_size / 4 AS e FROM part) SELECT p_partkey, CASE WHEN n > 0 AND b <= 2000 AND t <= 2000 AND l <= 20000 AND e >= 0.5 THEN ROUND(n * ((b + t) / 2 * l * e * 7.85e-6::DOUBLE), 3) ELSE 0 END::DOUBLE AS kg FROM v")
def m4(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", F.round(workorders.piece_weight((F.col("p_partkey") % 9).cast("double"), size * 50.0, size * 40.0, F.col("p_retailprice") * 15, size / 4), 3).alias("kg"))


@query("m7_number_likeness", "WITH v AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 50 / 10)::DOUBLE AS b FROM part), o AS (SELECT *, LEAST(abs(a - b), CASE WHEN a >= 10 AND a / 10 BETWEEN 0.5 AND 15 THEN abs(a / 10 - b) ELSE abs(a - b) END) AS off FROM v) SELECT p_partkey, CASE WHEN off <= 0.05 THEN 1.0 ELSE ROUND(GREATEST(0.0, 1 - (off - 0.05) / 1.0), 6) END::DOUBLE AS likeness, CASE WHEN abs(a - b) >= 20 THEN 0.0 WHEN abs(a - b) <= 2 THEN 100.0 ELSE ROUND(100.0 * (1 - abs(a - b) / 20), 6) END::DOUBLE AS nearness FROM o")
def m7(spark: SparkSession, d: str) -> DataFrame:
    """Both likenesses of numbers (M7), with the readings that a lost comma leaves (M6)."""
    a, b = F.col("p_size").cast("double"), F.col("p_partkey") % 50 / 10
    return read(spark, d, "part").select("p_partkey", F.round(similarity.number_likeness(similarity.number_variants(a), b, 0.05), 6).alias("likeness"), F.round(similarity.number_nearness(a, b, 20.0), 6).alias("nearness"))


@query("m9_logistic", "WITH v AS (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size / 5 END AS m, p_partkey % 30 / 2 AS b FROM part), p AS (SELECT p_partkey, 1 / (1 + pow(2.0, -LEAST(COALESCE(m, 99.0), b - 4) / 3)) AS p FROM v) SELECT p_partkey, ROUND(p, 9) AS p, ROUND(1 / (1 + exp(-(0.8 * ln(LEAST(GREATEST(p, 1e-6), 1 - 1e-6) / (1 - LEAST(GREATEST(p, 1e-6), 1 - 1e-6))) + 0.1))), 9) AS calibrated FROM p")
def m9(spark: SparkSession, d: str) -> DataFrame:
    p = linkage.logistic(F.when(F.col("p_size") % 4 != 0, F.col("p_size") / 5), F.col("p_partkey") % 30 / 2)
    return read(spark, d, "part").select("p_partkey", F.round(p, 9).alias("p"), F.round(linkage.platt(p, 0.8, 0.1), 9).alias("calibrated"))


@query("m13_wald", f"WITH {SHEET} SELECT status, ROUND(ln(0.99 / 0.05), 6) AS upper, ROUND(ln(0.01 / 0.95), 6) AS lower FROM sheet GROUP BY status")
def m13(spark: SparkSession, d: str) -> DataFrame:
    upper, lower = ordered.wald_bounds()
    return sheets(spark, d).groupBy("status").agg(F.round(F.lit(upper), 6).alias("upper"), F.round(F.lit(lower), 6).alias("lower"))


@query("m15_consolidated", f"WITH {SHEET} SELECT sheet_id, CASE WHEN status = 'pending' OR custkey % 3 = 0 THEN 'pending' WHEN status = 'extracted' OR custkey % 3 = 1 THEN 'extracted' ELSE 'validated' END AS status FROM sheet")
def m15(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("custkey") % 3
    other = F.when(c == 0, "pending").when(c == 1, "extracted").otherwise("validated")
    return sheets(spark, d).select("sheet_id", workorders.consolidated([F.col("status"), other], ("pending", "extracted", "validated")).alias("status"))


HOUR_SQL, HOURS = over_part(("8:30", "5,5", "6 H", "0", "10100", "24", "x", "", "7H15", "24,5", "0.25"))


@query("d8_hours", f"WITH {HOUR_SQL} SELECT k, CASE t WHEN '8:30' THEN 8.5 WHEN '5,5' THEN 5.5 WHEN '6 H' THEN 6 WHEN '24' THEN 24 WHEN '7H15' THEN 7.25 WHEN '0.25' THEN 0.25 END::DOUBLE AS hours FROM s")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return HOURS(spark, d).select("k", dates.hours(F.col("t")).alias("hours"))


CLOCK_SQL, CLOCKS = over_part(("23:30", "00:30", "9h15", "1430", "08:00", "11h", "9+15", "25:00"), ("00:15", "23:00", "11h", "15.00", "08:00", "x"))
MINUTES = "CASE {0} WHEN '23:30' THEN 1410 WHEN '00:30' THEN 30 WHEN '9h15' THEN 555 WHEN '08:00' THEN 480 WHEN '00:15' THEN 15 WHEN '23:00' THEN 1380 WHEN '15.00' THEN 900 {1} END"
LOOSE = "WHEN '1430' THEN 870 WHEN '11h' THEN 660 WHEN '9+15' THEN 555"


@query(
    "d9_clocks",
    f"""WITH {CLOCK_SQL}, m AS (SELECT k, {MINUTES.format("t", "")} AS a, {MINUTES.format("t1", "")} AS b, {MINUTES.format("t", LOOSE)} AS la, {MINUTES.format("t1", LOOSE)} AS lb FROM s), n AS (SELECT *, (b - a + 1440) % 1440 AS x, (lb - la + 1440) % 1440 AS y FROM m)
 SELECT k, a AS strict, la AS loose, CASE WHEN x <= 720 THEN x END AS minutes, CASE WHEN y IS NULL OR y = 0 THEN '' ELSE lpad(CAST(y // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(y % 60 AS VARCHAR), 2, '0') END AS length FROM n""",
)
def d9(spark: SparkSession, d: str) -> DataFrame:
    """Both clocks (D9, D10) and both lengths of time."""
    a, b = F.col("t"), F.col("t1")
    strict, loose = dates.clock_strict, dates.clock_loose
    return CLOCKS(spark, d).select("k", strict(a).alias("strict"), loose(a).alias("loose"), dates.minutes_between(strict(a), strict(b)).alias("minutes"), dates.length_between(loose(a), loose(b)).alias("length"))


LENGTH_SQL, LENGTHS = over_part(("1:30", "1h30", "2h", "45", "45 min", "x", "", "0:05"), ("sim", "Não", "X", "0", "talvez", ""))


@query("d13_lengths", f"WITH {LENGTH_SQL} SELECT k, CASE t WHEN '1:30' THEN 90 WHEN '1h30' THEN 90 WHEN '2h' THEN 120 WHEN '45' THEN 45 WHEN '45 min' THEN 45 WHEN '0:05' THEN 5 END AS minutes, CASE WHEN t1 IN ('sim', 'X') THEN TRUE WHEN t1 IN ('Não', '0') THEN FALSE END AS yes FROM s")
def d13(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of time as text (D13), and yes or no."""
    return LENGTHS(spark, d).select("k", dates.minutes_text(F.col("t")).alias("minutes"), dates.yes_no(F.col("t1")).alias("yes"))


@query("d15_strict_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def d15(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "d-M-yy"))
    return read(spark, d, "orders").select("o_orderkey", dates.date_strict(shown).alias("iso"))


@query("d18_capture_day", "SELECT event_id, CAST(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS DATE) AS day FROM events")
def d18(spark: SparkSession, d: str) -> DataFrame:
    """A zone without summer time, so that SQL can add its hours."""
    return read(spark, d, "events").select("event_id", dates.capture_day(F.col("ts"), "Asia/Kolkata").alias("day"))


PHASES = "v AS (SELECT p_partkey, p_size, [p_size, p_partkey % 50, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size - 20 END] AS q FROM part)"


def phased(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    phase = lambda name, qty: F.struct(F.lit(name).alias("phase"), qty.cast("double").alias("qty"))
    return read(spark, d, "part").select("p_partkey", size.cast("double").alias("planned"), F.array(phase("cut", size), phase("bend", k % 50), phase("weld", F.when(k % 4 != 0, size - 20))).alias("phases"), F.when(k % 3 == 0, " Sim ").when(k % 3 == 1, "nao").alias("fechado"))


@query("z17_phases", f"WITH {PHASES} SELECT p_partkey, COALESCE(q[2] <> p_size, FALSE) OR COALESCE(q[3] <> p_size, FALSE) AS incomplete, GREATEST(COALESCE(q[3], q[2]), 0)::DOUBLE AS last, GREATEST(q[2], 0)::DOUBLE AS bent, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS closed FROM v")
def z17(spark: SparkSession, d: str) -> DataFrame:
    """Whether a phase is behind (Z17), what was made in one or in the last (Z18), whether a line is closed."""
    behind = F.coalesce(workorders.phase_incomplete("phases", "planned"), F.lit(False))
    return phased(spark, d).select("p_partkey", behind.alias("incomplete"), workorders.produced_in("phases").alias("last"), workorders.produced_in("phases", "bend").alias("bent"), workorders.closed(F.col("fechado")).alias("closed"))


MISSING_SQL, MISSING = over_part(("?", "-?-", "-", " ", "", "x", "? ?", "a?"), ("1001", "101", "0101", "11", "10010"))


@query("z40_missing", f"WITH {MISSING_SQL} SELECT k, trim(t) = '' OR (regexp_matches(t, '^[\\s\\-_.:/\\\\?]*$') AND contains(t, '?')) AS missing, t1 IN ('1001', '101', '10010', '0101') AND t1 <> '0101' AS tolerant FROM s")
def z40(spark: SparkSession, d: str) -> DataFrame:
    """Missing values (Z40); sales orders equal but for a zero."""
    return MISSING(spark, d).select("k", text.missing(F.col("t")).alias("missing"), similarity.zero_tolerant(F.col("t1"), F.lit("1001")).alias("tolerant"))


@query("z41_identifiers", f"WITH v AS (SELECT p_partkey AS k, lpad(CAST(p_partkey % 977 AS VARCHAR), 6, '0') AS a, lpad(CAST((p_partkey + p_size) % 977 AS VARCHAR), 6, '0') AS b FROM part) SELECT k, CASE WHEN a = b THEN 1.0 ELSE {LIKE.format(a='a', b='b')} / 100.0 END::DOUBLE AS likeness FROM v WHERE length(regexp_replace(a, '[^0]', '', 'g')) > 3 AND length(regexp_replace(b, '[^0]', '', 'g')) > 3")
def z41(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of order numbers with more zeros than there are choices of."""
    k = F.col("p_partkey")
    v = read(spark, d, "part").select(k.alias("k"), (k % 977).cast("string").alias("a"), ((k + F.col("p_size")) % 977).cast("string").alias("b"))
    zeros = lambda c: F.length(F.regexp_replace(F.lpad(c, 6, "0"), "[^0]", "")) > 3
    return v.where(zeros("a") & zeros("b")).select("k", similarity.identifier_likeness(F.col("a"), F.col("b"), True).alias("likeness"))


@query("z59_canonical_fields", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'of' WHEN p_size % 3 = 1 THEN 'cliente' ELSE regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') END AS field FROM part")
def z59(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    label = F.when(size % 3 == 0, " Ordem ").when(size % 3 == 1, "CLIENTE").otherwise(F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", templates.canonical(label, {"of": ["ordem", "o.f."], "cliente": ["client"]}).alias("field"))


@query("w8_isotonic", "WITH b AS (SELECT LEAST(p_size // 10, 4) AS ord, AVG(p_retailprice) AS v, COUNT(*) AS n FROM part GROUP BY 1), r AS (SELECT j.ord AS j, k.ord AS k, (SELECT SUM(v * n) / SUM(n) FROM b x WHERE x.ord BETWEEN j.ord AND k.ord) AS m FROM b j JOIN b k ON j.ord <= k.ord), t AS (SELECT i.ord, j, MAX(m) AS m FROM b i JOIN r ON j <= i.ord AND k >= i.ord GROUP BY ALL) SELECT ord, ROUND(MIN(m), 6) AS value FROM t GROUP BY ord")
def w8(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "part").groupBy(F.least(F.floor(F.col("p_size") / 10), F.lit(4)).alias("ord")).agg(F.avg("p_retailprice").alias("value"), F.count("*").alias("weight"))
    return ordered.isotonic(b, "ord", "value", "weight").select("ord", F.round("value", 6).alias("value"))


@query("l9_coherent", f"WITH {FACT}, f AS (SELECT sheet_id, row_index, MIN(of) AS of, CASE WHEN MIN(qtd) % 3 = 0 THEN 'strong' ELSE 'weak_guess' END AS mode FROM fact GROUP BY ALL), s AS (SELECT *, CASE WHEN mode = 'strong' THEN of END AS s FROM f) SELECT sheet_id, row_index, CASE WHEN mode <> 'strong' THEN COALESCE(lag(s) OVER w, lead(s) OVER w) END AS bias FROM s WINDOW w AS (PARTITION BY sheet_id ORDER BY row_index)")
def l9(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).groupBy("sheet_id", "row_index").agg(F.min("of").alias("of"), F.when(F.min("qtd") % 3 == 0, "strong").otherwise("weak_guess").alias("mode"))
    return linkage.coherent(f).select("sheet_id", "row_index", "bias")


@query("l10_downgraded", f"WITH {FACT}, f AS (SELECT sheet_id, of % 2 AS of, modelo LIKE '%TIN' AS modelo, qtd % 3 AS core, qtd % 2 = 0 AS exact FROM fact), c AS (SELECT *, COUNT(DISTINCT core) OVER (PARTITION BY sheet_id, of, modelo) AS n FROM f) SELECT sheet_id, CASE WHEN n > 1 AND NOT exact THEN 'weak_guess' ELSE 'strong' END AS mode, COUNT(*) AS n FROM c GROUP BY ALL")
def l10(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("sheet_id", (F.col("of") % 2).alias("of"), F.col("modelo").like("%TIN").alias("modelo"), (F.col("qtd") % 3).alias("core"), (F.col("qtd") % 2 == 0).alias("exact"), F.lit("strong").alias("mode"))
    return linkage.downgraded(f).groupBy("sheet_id", "mode").agg(F.count("*").alias("n"))


@query("r10_shadow_run", f"WITH {CASES}, {RUNS} SELECT kind, severity, COUNT(*) AS n FROM diff GROUP BY ALL")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """A second way of deciding beside the one in use, over the same input."""
    rows = cases(spark, d)
    return evaluation.shadowed(rows, lambda _: runs(spark, d)[0], lambda _: runs(spark, d)[1]).groupBy("kind", "severity").agg(F.count("*").alias("n"))
