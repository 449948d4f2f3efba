import pytest
from pyspark.sql import functions as F

from sheetloom.operators import channel, ordered, templates


def test_templates(spark):
    t = templates.Template("coil", {"of": "text", "qtd": "integer", "esp": "decimal"}, ["COIL FORM"], ["of"])
    df = spark.createDataFrame([('{"of": " 1 ", "qtd": "5", "esp": "2,6"}',), ('{"qtd": "x"}',)], "j string").select(F.from_json("j", t.row_type()).alias("r"))
    assert [tuple(r) for r in df.select(*t.typed("r")).collect()] == [("1", 5, 2.6), (None, None, None)]
    r = templates.Registry()
    r.add(t)
    with pytest.raises(templates.Invalid):
        r.add(templates.Template("other", {"of": "text"}, ["coil form"]))
    assert [tuple(x) for x in r.aliases(spark).collect()] == [("COIL FORM", "coil")]
    for bad in (("Bad Name", {"a": "text"}), ("ok", {}), ("ok", {"a": "blob"}), ("ok", {"A b": "text"})):
        with pytest.raises(templates.Invalid):
            templates.Template(*bad)
    with pytest.raises(templates.Invalid):
        templates.Template("ok", {"a": "text"}, checked=["b"])


def test_labels_and_charts(spark):
    df = spark.createDataFrame([(" Quantidade ",), ("Côr final",)], "l string")
    assert [x[0] for x in df.select(templates.canonical(F.col("l"), {"qtd": ["quantidade", "qty"]})).collect()] == ["qtd", "cor_final"]
    rows = [{"x": "a", "y": 1}, {"x": "b", "y": 2}]
    assert templates.chart({"x": "x", "y": ["y"]}, rows)["series"] == {"y": [1, 2]}
    for bad in (rows[:1], [{"x": "a", "y": 1}, {"x": "b", "y": None}]):
        with pytest.raises(templates.Invalid):
            templates.chart({"x": "x", "y": ["y"]}, bad)


def test_calendar(spark):
    c = templates.calendar(spark, {"holidays": ["2026-07-03", "2026-07-02"], "worked": ["2026-07-04", "2026-07-02"]})
    days = spark.createDataFrame([("2026-07-04",), ("2026-07-05",), ("2026-07-06",), ("2026-07-03",)], "day string").withColumn("day", F.to_date("day"))
    got = {str(r.day): str(r.previous) for r in ordered.previous_workday(days, c).collect()}
    assert got == {"2026-07-04": "2026-07-02", "2026-07-05": "2026-07-04", "2026-07-06": "2026-07-04", "2026-07-03": "2026-07-02"}
    with pytest.raises(templates.Invalid):
        templates.calendar(spark, {"holidays": ["tomorrow"]})


def test_channel(spark):
    pairs = spark.createDataFrame([("1234", "1434")] * 3 + [("1111", "4111"), ("AB", "A"), (None, "x")], "new_value string, old_value string")
    n = {(r.gold, r.ocr): r.n for r in channel.substitutions(pairs).collect()}
    assert n["2", "4"] == 1 and n["1", "4"] == 1 and n["B", ""] == 1
    assert all(channel.LEAST <= r.bits <= channel.MOST for r in channel.costs(channel.substitutions(pairs)).collect())
