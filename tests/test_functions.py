import pytest
from pyspark.sql import functions as F

from sheetloom.functions import dates, similarity, text


def one(spark, f, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*[F.col(n) for n in names])).collect()[0][0]


@pytest.mark.parametrize(
    "value,parts,numeric",
    [("09-04-2026", "2026-04-09", "2026-04-09"), ("9.4.2026", "2026-04-09", "2026-04-09"), ("9/4/26", "2026-04-09", "2026-04-09"), ("9 4 2026", "2026-04-09", None), ("09-04-2026.", None, "2026-04-09"), ("31-02-2026", "2026-02-31", "2026-02-31"), ("09-13-2026", None, None), ("", None, None), (None, None, None)],
)
def test_dates(spark, value, parts, numeric):
    assert one(spark, dates.date_parts, value) == parts
    assert one(spark, dates.date_numeric, value) == numeric


@pytest.mark.parametrize("value,hours", [("8:30", 8.5), ("5,5", 5.5), ("6 H", 6.0), ("0", None), ("10100", None), ("24", 24.0), ("x", None), (None, None)])
def test_hours(spark, value, hours):
    assert one(spark, dates.hours, value) == hours


@pytest.mark.parametrize("start,end,strict,loose", [("23:30", "00:15", 45, "00:45"), ("00:30", "23:00", None, "22:30"), ("9h15", "11h", None, "01:45"), ("1430", "15.00", None, "00:30"), ("08:00", "08:00", 0, "")])
def test_clock(spark, start, end, strict, loose):
    assert one(spark, lambda a, b: dates.minutes_between(dates.clock_strict(a), dates.clock_strict(b)), start, end) == strict
    assert one(spark, lambda a, b: dates.length_between(dates.clock_loose(a), dates.clock_loose(b)), start, end) == loose


def test_text(spark):
    assert one(spark, text.fold, "Açúcar é bom") == "ACUCAR E BOM"
    assert one(spark, text.compact, "a-1 é/2") == "A1E2"
    assert one(spark, text.order_number, " 123 ") == "000123"
    assert one(spark, text.order_number, "12a") == "12a"
    assert one(spark, text.order_number_loose, "123.0") == "000123"
    assert one(spark, text.neutral, "=1+1") == "'=1+1"
    assert one(spark, text.leaf, "rows[3].modelo") == "modelo"
    assert one(spark, text.general_path, "rows[3].modelo") == "rows[].modelo"
    assert sorted(one(spark, text.zero_variants, "A0O")) == sorted(["A0O", "AOO", "A00", "AO0"])
    assert one(spark, text.code_tokens, "ab 12 AB12 x1y2z") == ["AB12", "X1Y2Z"]
    assert [one(spark, text.missing, v) for v in (None, " ", "?", "-?-", "-", "x")] == [True, True, True, True, False, False]
    swapped = one(spark, text.swap_columns, "123456", "12")
    assert (swapped.pri, swapped.of, swapped.flags) == ("12", "123456", ["swapped"])


def test_likeness(spark):
    assert one(spark, similarity.likeness, "abc", "abc") == 100
    assert one(spark, similarity.likeness, "abcd", "xabcdx") == 80
    assert one(spark, similarity.likeness, "abcd", "wxyz") == 0
    assert one(spark, similarity.likeness, "abcd", "abce") == 75
    assert one(spark, similarity.edits, "a", "abcdefgh") == similarity.FAR
    assert one(spark, similarity.zero_tolerant, "1001", "101") is True
    assert one(spark, similarity.sorted_ratio, "b a", "a b") == 100.0
    assert one(spark, similarity.ratio, "abcd", "bcde") == 0.75
    # lengths over 5 apart count as 999 edits; case doesn't count; nothing in common only where both are longer than 3
    assert one(spark, similarity.likeness, "ABCDEFGHIJKLMNOPQRST", "ABCDEFXHIJKLM") == 0
    assert one(spark, similarity.likeness, "AbCd", "aBcE") == 75 and one(spark, similarity.likeness, "abc", "abd") == pytest.approx(66.6666667)
    assert one(spark, similarity.likeness, "", "a") == 0 and one(spark, similarity.likeness, None, "a") == 0
    assert [(p.expected, p.found) for p in one(spark, similarity.replaced_letters, "1O3X", "103Y")] == [("O", "0"), ("X", "Y")]
    assert one(spark, similarity.replaced_letters, "abc", "abcd") == []
    related = lambda a, b: one(spark, similarity.relatedness, a, b)
    assert related("", "x") == 1.0 and related("BELUX", "STOCK BELUX") == 1.0 and related("AB12", "AB13 - CC") == 0.75 and related("zz", "abc") == 0.0
    confused = similarity.confused_edits({"1": {"4": 0.2}, "7": {"1": 0.05}})
    assert [one(spark, confused, *p) for p in (("11", "14"), ("7", "1"), ("a", "a"), ("a", "abcd"))] == [0.5, 1.0, 0.0, None]


def test_readings(spark):
    assert one(spark, text.digit_choices, "26F") == ["26F", "266", "268", "265", "267", "26E"]
    assert [one(spark, lambda c: text.fits("hours", c), v) for v in ("8:30", "24:00", "24:01", "830", "2460", "25", "8,5 h", "x", "")] == [True, True, False, True, False, False, True, False, False]
    assert [one(spark, lambda c: text.fits("priority", c), v) for v in ("A", "P.3", "REP C1", "123456", "1234")] == [True, True, True, False, False]
    assert [one(spark, text.tool, v) for v in ("OCT.", "13 , 7", "abc", "", "12")] == ["OCT", "13,7", None, "", "12"]
    assert [one(spark, text.personnel_number, v) for v in ("95", "10003261", "0", "x")] == ["10000095", "10003261", None, None]
    assert [one(spark, lambda c: text.formatted("esp", c), v) for v in ("2.60", "10", "x")] == ["2,6", "10", "x"]
    assert [one(spark, lambda c: text.formatted("comp_mm", c), v) for v in ("1226.5", "1227,5")] == ["1226", "1228"]
    assert one(spark, text.names_model, "0641-S-515", "X 0641S515 - Y") is True and one(spark, text.names_model, "CA06F18D N1", "CAO6F18D - Nº1 Z") is True
    assert one(spark, text.names_model, "ABC", "ABC 1") is False and one(spark, text.names_model, "AB12", "CD34") is False
    assert one(spark, lambda a, b: similarity.identifier_likeness(a, b, True), "1O1234", "101234") == 1.0
    assert similarity.aligned("abc", "axc")[1] == [("a", "a"), ("b", "x"), ("c", "c")]
    assert one(spark, similarity.channel_cost({("1", "4"): 0.2}), "10", "40") == pytest.approx(0.2)
