import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import similarity
from sheetloom.operators import documents, formula, joins, kpis, linkage, ordered, quality, sqlguard, workorders


def test_day_summary_counts_a_sheets_hours_once(spark):
    day = datetime.date(2026, 7, 1)
    rows = [(1, 0, "W1", day, 4.0, 100001, "A", "M1", 12, "validated"), (1, 1, "W1", day, 4.0, 100002, "A", "M2", 3, "validated"), (2, 0, "W2", day, 4.0, 100001, "B", "M1", 5, "pending")]
    f = spark.createDataFrame(rows, "sheet_id long, row_index int, operador string, iso_date date, hours double, of long, cliente string, modelo string, qtd long, status string")
    r = kpis.day_summary(f, "2026-07-01").collect()[0]
    assert (r.qty, r.n_sheets, r.n_rows, r.n_of, r.hours, r.n_validated) == (20, 2, 3, 2, 8.0, 1)
    assert kpis.day_summary(f, "2026-07-02").collect()[0].qty == 0


def loop(rows, pool):
    """One after the other, as it is defined."""
    out, seen = [], 0
    for need, closed, produced in rows:
        if produced is None or need is None and not closed:
            out.append(None)
            continue
        if closed:
            out.append(0.0)
            continue
        seen += 1
        want = need - max(produced, 0)
        take = pool if seen == len(rows) else min(max(want, 0), pool)
        pool -= take
        out.append(want - take)
    return out


def test_waterfall_equals_the_loop(spark):
    r = random.Random(4)
    groups, flat = {}, []
    for g in range(80):
        rows = [(None if r.random() < 0.1 else float(r.randint(0, 20)), r.random() < 0.1, None if r.random() < 0.1 else float(r.randint(-5, 12))) for _ in range(r.randint(1, 6))]
        pool = float(r.choice([0, 3, 12, 25, 60]))
        groups[g] = loop(rows, pool)
        flat += [(g, i, *x, pool) for i, x in enumerate(rows)]
    df = spark.createDataFrame([(g, i, q, p, c, pool) for g, i, q, c, p, pool in flat], "g int, i int, quanttrp double, produced double, closed boolean, pool double")
    got = {(x.g, x.i): x.remaining for x in ordered.waterfall(df, ["g"], "i").collect()}
    assert all(got[g, i] == v for g, vs in groups.items() for i, v in enumerate(vs))


@pytest.mark.parametrize("case,pool,expected", [([(10.0, False, 0.0)] * 3, 12.0, [0, 8, 10]), ([(10.0, False, 0.0)] * 2, 4.0, [6, 10]), ([(10.0, False, 0.0)] * 2, 25.0, [0, -5]), ([(10.0, False, 0.0), (None, True, 0.0), (10.0, False, 0.0)], 25.0, [0, 0, 0])])
def test_waterfall_cases(case, pool, expected):
    assert loop(case, pool) == expected


def test_fill_down(spark):
    df = spark.createDataFrame([(0, "100001", "A"), (1, '"', "?"), (2, '"', '"'), (3, "", "B"), (4, '"', '"')], "i int, of string, c string").withColumn("k", F.lit(1))
    got = [(r.of, r.c) for r in ordered.fill_down(df, ["of", "c"], ["k"], "i").orderBy("i").collect()]
    assert got == [("100001", "A"), ("100001", "?"), ("100001", "A"), ("", "B"), ("100001", "B")]


def test_cusum_and_bounds(spark):
    r = random.Random(1)
    z = [r.random() * 2 - 0.9 for _ in range(200)]
    s, expected = 0.0, []
    for x in z:
        s = max(0.0, s + x - 0.1)
        expected.append(s)
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(z)], "k int, i int, z double")
    got = [x.s for x in ordered.cusum(df, ["k"], "i", F.col("z"), 0.1, 5.0).orderBy("i").collect()]
    assert got == pytest.approx(expected, abs=1e-6)
    assert ordered.wald_bounds() == pytest.approx((2.986, -4.554), abs=1e-3)
    assert ordered.pooled([(1, 1), (3, 1), (2, 2)]) == pytest.approx([2.0, 2.0, 2.0])


def test_formulas(spark):
    df = spark.createDataFrame([(12.0, 4.0, None)], "qtd double, horas double, none double")
    names = {c: F.col(c) for c in df.columns}
    value = lambda f: df.select(formula.compiled(f, names)).collect()[0][0]
    assert value("qtd / horas") == 3.0
    assert value("qtd / (horas - 4)") is None
    assert value("max(none, horas)") is None
    assert value("round(qtd / 7, 2)") == 1.71
    assert value("-min(qtd, horas) + abs(-2)") == -2.0
    for bad in ("qtd ** 2", "qtd.x", "lambda: 1", "qtd < 1", "1" * 201, "other + 1", "True", "min(qtd, horas=1)", "__import__('os')", "'a'"):
        with pytest.raises(formula.FormulaError):
            formula.compiled(bad, names)


def test_guarded_sql(spark):
    t = {"facts": spark.range(300).withColumnRenamed("id", "k")}
    assert sqlguard.asked(spark, "SELECT k FROM facts WHERE k > 5 LIMIT 10000", t).count() == 100
    assert sqlguard.asked(spark, "WITH x AS (SELECT k FROM facts) SELECT count(*) AS n FROM x LIMIT 1", t).collect()[0].n == 300
    for bad in ("SELECT 1", "SELECT k FROM facts", "SELECT k FROM secrets LIMIT 1", "DROP TABLE facts", "SELECT k FROM facts LIMIT 0", "SELECT k FROM facts LIMIT 20000", "SELECT k FROM facts LIMIT 1; DROP TABLE facts", "INSERT INTO facts SELECT 1 LIMIT 1", "SELECT * FROM (SELECT * FROM (SELECT * FROM (SELECT * FROM (SELECT k FROM facts)))) LIMIT 1"):
        with pytest.raises(sqlguard.Refused):
            sqlguard.asked(spark, bad, t)
    assert sqlguard.asked(spark, "SELECT 'drop; table' AS x FROM facts LIMIT 1", t).collect()[0].x == "drop; table"
    assert sqlguard.asked(spark, "SELECT k % 3 AS g, COUNT(DISTINCT k) AS n, upper('a') AS u, CASE WHEN MAX(k) > 5 THEN 1 END AS c FROM facts f WHERE k BETWEEN 1 AND 200 AND EXISTS (SELECT 1 FROM facts x WHERE x.k = f.k) GROUP BY 1 HAVING COUNT(*) > 2 ORDER BY n DESC LIMIT 5", t).count() == 3


@pytest.mark.parametrize(
    "bad",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS h FROM facts LIMIT 1",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS h FROM facts LIMIT 1",
        "SELECT `reflect`('a', 'b') AS h FROM facts LIMIT 1",
        "SELECT 'a\\'', reflect('x', 'y') AS h, '\\'' FROM facts LIMIT 1",
        "WITH q AS (SELECT reflect('a', 'b') AS z FROM facts) SELECT * FROM q LIMIT 1",
        "SELECT k FROM facts WHERE k IN (SELECT java_method('a', 'b') FROM facts) LIMIT 1",
        "SELECT * FROM range(5) LIMIT 1",
        "SELECT k FROM facts WHERE k IN (SELECT id FROM range(5)) LIMIT 1",
        "SELECT * FROM facts, explode(array(1)) LIMIT 1",
        "SELECT k FROM facts LATERAL VIEW explode(array(1)) t AS z LIMIT 1",
        "SELECT * FROM VALUES (1) LIMIT 1",
        "SELECT * FROM parquet.`/etc` LIMIT 1",
        "SELECT k FROM facts WHERE k = (SELECT MAX(k) FROM hidden) LIMIT 1",
        "WITH hidden AS (SELECT k FROM facts) SELECT * FROM hidden LIMIT 1",
    ],
)
def test_guarded_sql_refuses(spark, bad):
    spark.range(1).withColumnRenamed("id", "k").createOrReplaceTempView("hidden")
    with pytest.raises(sqlguard.Refused):
        sqlguard.asked(spark, bad, {"facts": spark.range(3).withColumnRenamed("id", "k")})


def test_documents_to_facts(spark):
    doc = {"header": {"operador": "WORKER ONE", "data": "3-7-2026"}, "rows": [{"of": "100001", "modelo": "AB12C34", "cliente": "CLIENT A", "qtd": "5", "esp": "2,6"}, {"of": "", "modelo": "", "cliente": "", "qtd": ""}], "footer": {"horas_trabalhadas": "8:30"}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}"), (3, None)], "sheet_id long, doc string")
    r = documents.row_facts(documents.parsed(df)).collect()
    assert len(r) == 1 and (r[0].sheet_iso_date, r[0].sheet_hours, r[0].esp, r[0].qtd) == ("2026-07-03", 8.5, 2.6, 5)


def test_linkage_cases(spark):
    plan = spark.createDataFrame([(0, "100001", "55", "CLIENT A", "AB12C34"), (1, "100002", "56", "CLIENT B", "ZZ99Y11"), (2, "100003", "57", "CLIENT C", "QQ11W22")], "plan_ord long, of string, ov string, cliente string, modelo string")
    rows = spark.createDataFrame([(0, "100001", "55", "CLIENT A", "AB12C34"), (1, "100002", "56", "CLIENT B", ""), (2, "999999", "", "NOBODY", "")], "row_id long, of string, ov string, cliente string, modelo string")
    pool = linkage.candidates(rows, plan, [["of"], ["ov"]])
    w = {r.row_id: r for r in linkage.winners(linkage.evidence(rows, plan, pool)).collect()}
    assert w[0].plan_ord == 0 and w[0].mode == "strong" and w[1].plan_ord == 1 and 2 not in w
    p = {r.row_id: r for r in linkage.posterior(linkage.evidence(rows, plan, pool), 3).collect()}
    assert all(0 <= r.p_of <= 1 and r.p_of + r.p_null <= 1.000001 for r in p.values()) and p[0].p_of > 0.9
    cells = spark.createDataFrame([("a", "a"), ("abcdef", "abcdeg"), ("abcdef", "zzz"), ("", "x"), ("", None), ("x", None)], "w string, p string")
    assert [r[0] for r in cells.select(linkage.cell(F.col("w"), F.col("p"))).collect()] == ["confirmed", "snapped", "very_different", "snapped", "NA", "very_different"]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "row_id long, of string, ov string, cliente string, modelo string")
    plan = spark.createDataFrame([], "plan_ord long, of string, ov string, cliente string, modelo string")
    assert linkage.winners(linkage.evidence(rows, plan, linkage.candidates(rows, plan, [["of"]]))).count() == 0
    pairs = spark.createDataFrame([(0.5, 1.0)], "p double, y double")
    assert quality.murphy(pairs).collect()[0].brier is None
    assert joins.band_join(spark.createDataFrame([], "a double"), spark.createDataFrame([(1.0,)], "b double"), "a", "b", 1.0).count() == 0


def test_murphy_adds_up(spark):
    r = random.Random(3)
    df = spark.createDataFrame([((i % 10 + 0.5) / 10, float(r.random() < (i % 10 + 0.5) / 10)) for i in range(2000)], "p double, y double")
    m = quality.murphy(df).collect()[0]
    assert m.brier == pytest.approx(m.reliability - m.resolution + m.uncertainty, abs=1e-5)


def test_weights(spark):
    """By hand: ladder, trapezoid, guards, and which source each measure and weight comes from."""
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    lit = lambda *v: [F.lit(x).cast("double") for x in v]
    assert [one(workorders.slices_of(*lit(w, 200, 150))) for w in (1051, 1050, 900, 700, 550, 350, 200, None)] == [6, 5, 4, 3, 2, 1, 0, 0]
    assert [one(workorders.slices_of(*lit(210, 200, 150, length, 1000))) for length in (1101, 1100)] == [2, 1]
    assert one(workorders.piece_weight(*lit(2, 200, 150, 5000, 2.5))) == pytest.approx(2 * 175 * 5000 * 2.5 * 7.85e-6)
    assert [one(workorders.piece_weight(*lit(*v))) for v in ((2, 200, 150, 5000, 31), (2, 2001, 150, 5000, 2), (2, 200, 150, 20001, 2), (0, 200, 150, 5000, 2), (2, None, 150, 5000, 2))] == [0.0] * 5
    columns = "qtd comp lbase ltopo esp larg plan_comp plan_lbase plan_ltopo plan_esp plan_unit_kg plan_pieces lot_esp lot_larg".split()
    base = dict.fromkeys(columns) | {"qtd": 10.0, "comp": 5000.0, "lbase": 200.0, "ltopo": 150.0, "esp": 9.0, "larg": 900.0, "plan_comp": 4000.0, "plan_esp": 3.0, "lot_esp": 2.5, "plan_unit_kg": 7.0}
    cases = [(base, True, []), (base, False, []), (base | {"plan_unit_kg": None}, False, []), (base, True, ["comp_mm", "esp"]), (base | {"qtd": 0.0}, True, []), (base | {"larg": 100.0}, True, []), (base | {"plan_pieces": 2.0}, True, [])]
    rows = [(*[v[c] for c in columns], direct, human, True, False) for v, direct, human in cases]
    schema = ", ".join(f"{c} double" for c in columns) + ", direct boolean, human array<string>, in_plan boolean, in_lot boolean"
    got = workorders.row_weights(spark.createDataFrame(rows, schema)).collect()
    kg = lambda comp, esp: 10 * 175 * comp * esp * 7.85e-6
    assert got[0].produced_kg == pytest.approx(kg(4000, 2.5)) and got[0].produced_source == "geometry" and got[0].n_slices == 3  # four to a slice
    assert got[0].consumed_kg == pytest.approx(3 * 900 * 4000 * 2.5 * 7.85e-6) and got[0].wasted_pct == pytest.approx(100 * (1 - 10 * 175 / 2700)) and got[0].consumption_source == "plan_lot"
    assert (got[1].produced_kg, got[1].produced_source, got[1].consumed_kg) == (70.0, "plan", None)
    assert got[2].produced_source == "geometry" and got[3].produced_kg == pytest.approx(kg(5000, 9.0))
    assert (got[4].produced_kg, got[4].n_slices, got[5].n_slices, got[6].n_slices) == (None, None, None, 5)


def test_top_codes_are_those_of_all_pairs(spark):
    """short codes by the codes they share, against all pairs by top_like; lengths, case and containment mixed."""
    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    known = [word(6, "0123") for _ in range(400)] + [word(rng.randint(1, 14), "01aA") for _ in range(150)] + ["ab12", "AB12", "7", ""]
    written = [word(6, "0127") for _ in range(40)] + [word(6, "789") for _ in range(10)] + [word(rng.randint(1, 13), "0aB") for _ in range(40)] + ["ab12", "zzzzzz", "", None]
    w, k = spark.createDataFrame([(x,) for x in written], "w string"), spark.createDataFrame([(x,) for x in known], "k string")
    for n in (1, 10):
        expected = joins.top_like(w, k, "w", "k", similarity.likeness, n).select("w", "k", "score")
        assert sorted(map(tuple, joins.top_codes(w, k, "w", "k", n).select("w", "k", "score").collect())) == sorted(map(tuple, expected.collect()))


def test_edit_keys_hide_or_take_out(spark):
    """what is left of a code with up to two edits."""
    pairs = joins.edit_keys(spark.createDataFrame([("ab",)], "v string"), "v", 2).select("code").collect()
    assert sorted(x.code for x in pairs) == sorted(["0AB", "0\0B", "0A\0", "0\0\0", "1A", "1B"])


def test_grid_join_sends_arrays_of_a_cells_rows(spark):
    """a hot cell dealt in shares, nulls, and all pairs none the less."""
    left = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 5, 29, 31, -1, 95, 61] * 3)] + [(99, None)], "a long, x double")
    right = spark.createDataFrame([(i if i % 9 else None, float(i % 4), i) for i in range(200)] + [(500, 95.0, 7), (501, None, 8)], "b long, y double, z int").repartition(3)
    pairs = lambda df: sorted(map(repr, df.collect()))
    expected = left.join(right, F.abs(F.floor(F.col("x") / 30) - F.floor(F.col("y") / 30)) <= 1)
    found = joins.grid_join(left, right, [("x", "y")], 30, block=16, share=50)
    assert found.columns == expected.columns and pairs(found) == pairs(expected)
    plan = joins.grid_join(left, right, [("x", "y")], 30, ["b"])
    assert plan.columns == ["a", "x", "b"] and pairs(plan) == pairs(expected.select("a", "x", "b"))
    assert "Generate inline" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_met_by_kinds_are_all_of_them(spark):
    """Pairs of equal first alone, and kinds of the others with all their entries, against the plain candidates."""
    rng = random.Random(5)
    make = lambda n: [(i, rng.choice("abcd"), rng.choice(["x", "y", None]), rng.choice("pq")) for i in range(n)]
    rows, plan = spark.createDataFrame(make(60), "row_id long, of string, ov string, modelo string"), spark.createDataFrame(make(80), "plan_ord long, of string, ov string, modelo string")
    expected = sorted(map(tuple, linkage.candidates(rows, plan, [["of"], ["ov", "modelo"]]).collect()))
    r, e = rows.withColumnsRenamed({c: f"k_{c}" for c in ("of", "ov", "modelo")}), plan.withColumnsRenamed({c: f"e_{c}" for c in ("of", "ov", "modelo")})
    single, kinds = linkage.met_by_kinds(r, e, "of", ["ov", "modelo"], [], [F.collect_list("plan_ord").alias("held")], lambda df: df)
    assert kinds.count() == rows.where("ov is not null").count()  # a row a kind, not a row a pair
    pairs = single.select("row_id", "plan_ord").unionAll(kinds.select("row_id", F.explode("held")))
    assert sorted(map(tuple, pairs.collect())) == expected


@pytest.mark.parametrize("name", ["l11_work_complete", "l22_halves_score", "l21_match_score"])
def test_scored_queries_meet_kinds_of_entries(spark, name):
    """Entries that are compared alike are one row before they are met, and no text is made ready for a pair."""
    from sheetloom.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    over = plan[: plan.index("Join Inner, ((k_ov")]
    assert "regexp_replace" not in over.split("Union")[0] and "Aggregate [e_ov" in plan and "Distinct" not in plan


def test_work_complete_ignores_entries_without_a_point(spark):
    """one sum a row; rows without eligible entries are not complete."""
    pool = spark.createDataFrame([(1, 0, False), (1, 2, True), (2, 0, True), (3, 1, True), (3, 1, False)], "row_id long, score int, phase_full boolean")
    out = linkage.work_complete(pool)
    assert sorted(map(tuple, out.collect())) == [(1, True), (2, False), (3, False)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
