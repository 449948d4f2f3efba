"""Queries over whole tables against brute force, on the smallest tables."""

from sheetloom.plans import catalogue
from sheetloom.plans.tables import edits, facts, read, sheets

SF = "/root/testdata/sf0.001"


def test_grid_join_takes_all_customers(spark):
    c = read(spark, SF, "customer").select("c_custkey", "c_acctbal", "c_nationkey").collect()
    p = read(spark, SF, "part").select("p_partkey", "p_retailprice", "p_size").collect()
    near = lambda a, b: abs(a // 30 - b // 30) <= 1
    expected = sorted((k, q) for k, money, nation in c for q, price, size in p if near(money, price) and near(nation, size))
    assert any(k % 10 for k, _ in expected)
    assert sorted(map(tuple, catalogue.queries()["j16_grid_join_whole"](spark, SF).collect())) == expected


def test_ordered_union_takes_all_facts(spark):
    first = {}
    for x in facts(spark, SF).select("sheet_id", "operador", "row_index", "of", "suppkey", "qtd").collect():
        own = first.setdefault(x[0], {})
        own[x[1]] = min(own.get(x[1], x[2:]), x[2:])
    expected = {k: ",".join(sorted(own, key=own.get)) for k, own in first.items()}
    assert dict(map(tuple, catalogue.queries()["u6_ordered_union_whole"](spark, SF).collect())) == expected


def test_windowed_counts_take_the_newest_sheets(spark):
    n = {}
    for x in edits(spark, SF).where("source = 'human'").select("sheet_id").collect():
        n[x[0]] = n.get(x[0], 0) + 1
    newest = sorted((x[0] for x in sheets(spark, SF).select("sheet_id").collect()), reverse=True)[:120]
    mean = lambda ids: round(sum(n.get(i, 0) for i in ids) / len(ids), 6)
    assert newest[-1] >= 120
    assert [tuple(x) for x in catalogue.queries()["j10_windowed_counts_whole"](spark, SF).select("recent", "before").collect()] == [(mean(newest[:20]), mean(newest[20:]))]


def test_replay_takes_all_sheets(spark):
    last, cells = {}, set()
    for x in edits(spark, SF).orderBy("id").collect():
        cells.add((x.sheet_id, x.field_path))
        if x.source in ("human", "wizard"):
            last[x.sheet_id, x.field_path] = x.new_value
    found = catalogue.queries()["r4_replay_whole"](spark, SF).select("sheet_id", "path", "value").collect()
    assert sorted(map(tuple, found)) == sorted((*c, last.get(c, "-")) for c in cells)
