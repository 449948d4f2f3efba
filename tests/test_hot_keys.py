"""Values that many rows share: the queries' operators count them, and don't meet every row with every row."""

import math

import duckdb
import pytest

from sheetloom.operators import cells, linkage
from sheetloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def most_rows(spark, df):
    """The rows of df, and how many the largest of its steps gave out."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    while todo:
        node = todo.pop()
        children, metric = node.children(), node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [children.apply(i) for i in range(children.length())]
    return rows, most


def test_row_denominator_counts_shared_values(spark):
    m = {"of": 0.693, "cliente": 0.562}
    rows = spark.range(500).selectExpr("id as row_id", "case when id % 5 = 0 then '' when id % 7 = 0 then null else cast(id as string) end as of", "case when id % 11 = 0 then 'y' else 'x' end as cliente")
    plan = spark.range(400).selectExpr("id as plan_ord", "case when id % 9 = 0 then '' else cast(id - id % 2 as string) end as of", "case when id % 3 = 0 then null else 'x' end as cliente")
    found, most = most_rows(spark, cells.row_denominator(rows, plan, m))
    entries = plan.collect()
    for r in found:
        w = next(x for x in rows.where(f"row_id = {r.row_id}").collect()) if r.row_id < 12 else None
        if w is None:
            continue
        met = [e for e in entries if any(getattr(w, f) and getattr(w, f) == getattr(e, f) for f in m)]
        k = lambda f, e: 1.0 if not getattr(w, f) else m[f] if getattr(w, f) == getattr(e, f) else (1 - m[f]) * cells.JOINT_U[f]
        floor = math.prod(m[f] * cells.JOINT_U[f] if getattr(w, f) else 1.0 for f in m)
        assert r.bits == pytest.approx(math.log2(max(sum(math.prod(k(f, e) for f in m) for e in met) / 1000, floor)), abs=2e-6)
    assert len(found) == 500 and most < 2000


@pytest.mark.parametrize("name", ["k8_migration", "j11_lookup_chain"])
def test_keys_of_more_digits(spark, tmp_path, name):
    """Keys as large as those of sixty copies of sf0.1."""
    duck = duckdb.connect()
    shift = {"supplier": ("s_suppkey + 59000",), "part": ("p_partkey + 1180000",), "orders": ("o_orderkey",), "lineitem": ("l_suppkey + 59000", "l_partkey + 1180000")}
    for t, columns in shift.items():
        duck.execute(f"COPY (SELECT * REPLACE ({', '.join(f'{c} AS {c.split()[0]}' for c in columns)}) FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_candidates_that_score_alike_are_counted(spark):
    """The winners, shares and evidence of whole pools, as from all pairs; what is counted is far less than the pairs."""
    plan = spark.range(120).selectExpr("id as plan_ord", "cast(1000 + id div 2 as string) as of", "'7' as ov", "case when id % 3 = 0 then 'alpha' else 'beta' end as cliente", "case when id % 40 = 0 then 'other' else 'model' end as modelo", "cast(id % 4 as double) as comp")
    rows = spark.range(60).selectExpr("id as row_id", "case when id % 4 = 0 then '' else cast(1000 + id as string) end as of", "'7' as ov", "'alpha' as cliente", "'model' as modelo", "case when id % 5 > 0 then cast(id % 4 as double) end as comp")
    by = [["of"], ["ov", "modelo"]]
    linked = linkage.Linked(rows, plan, by, ("comp",))
    pairs = linkage.evidence(rows, plan, linkage.candidates(rows, plan, by), ("comp",))
    assert sorted(map(repr, linked.scored.collect())) == sorted(map(repr, pairs.collect()))
    assert sorted(map(repr, linked.winners().collect())) == sorted(map(repr, linkage.winners(pairs).collect()))
    close = lambda df: sorted((r.row_id, *[pytest.approx(x, abs=2e-6) for x in r[1:]]) for r in df.collect())
    assert [tuple(r) for r in sorted(linked.posterior(120).collect())] == close(linkage.posterior(pairs, 120))
    assert linked.classes.count() * 3 < pairs.count()
