"""Candidates are met kind by kind: what likeness pairs have, and the winners' queries on tables whose entries repeat."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetloom.functions import pairwise
from sheetloom.functions.similarity import likeness
from sheetloom.plans import catalogue
from tests.test_hot_keys import most_rows

SF = "/root/testdata/sf0.001"
WORDS = ["100234", "100243", "10O234", "234", "", None, "ÇÃO 12", "ção 12", "ÃO", "x" * 300, "x" * 299 + "y", "9", "99999999999", "𝟙2345", "12345"]


def test_pairs_of_lists_are_as_alike_as_pairs_of_texts(spark):
    texts = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "i int, w string")
    pairs = texts.join(texts.select(F.col("i").alias("j"), F.col("w").alias("v")), F.lit(True)).select("i", "j", F.when((F.col("w") != "") & (F.col("v") != ""), likeness(F.col("w"), F.col("v")) / 100.0).alias("s"))
    expected = {(r.i, r.j): r.s for r in pairs.collect()}
    upper = [w and w.upper() for w in WORDS]
    n = len(WORDS)
    batch = pa.RecordBatch.from_pydict({"k": ["a", "b", "c"], "l": [list(range(n)), [0], []], "lt": [upper, upper[:1], []], "r": [list(range(n)), list(range(1, n)), [3]], "rt": [upper, upper[1:], upper[3:4]]})
    whole, counted = {"a": {}, "b": {}, "c": {}}, {}
    for b in pairwise.met(("l", "lt"), ("r", "rt"), False)([batch]):
        for r in b.to_pylist():
            for p in zip(r["ids"], r["others"], strict=True):
                assert p not in whole[r["k"]]
                whole[r["k"]][p] = r["likeness"]
    assert whole["a"] == expected and whole["b"] == {k: s for k, s in expected.items() if k[0] == 0 and k[1]} and not whole["c"]
    for b in pairwise.met(("l", "lt"), ("r", "rt"), True)([batch.slice(0, 1)]):
        for r in b.to_pylist():
            for i, m, first in zip(r["ids"], r["n"], r["others"], strict=True):
                held = counted.setdefault((i, r["likeness"]), [0, n])
                held[:] = held[0] + m, min(held[1], first)
    for (i, s), held in counted.items():
        own = [j for j in range(n) if expected[i, j] == s]
        assert held == [len(own), own[0]]
    assert sum(m for m, _ in counted.values()) == n * n


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Twenty copies of the parts, with shifted keys; and their pairs."""
    d, duck = tmp_path_factory.mktemp("copies"), duckdb.connect()
    duck.execute(f"COPY (SELECT p.* REPLACE (p_partkey + 200 * c AS p_partkey) FROM '{SF}/part.parquet' p, range(20) t(c)) TO '{d}/part.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    return str(d), duck, duck.execute("SELECT sum(n * n) FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_size)").fetchone()[0]


@pytest.mark.parametrize("name", ["l12_cells", "l8_posterior", "l16_row_cells", "l7_winners", "w11_marginals"])
def test_winners_meet_kinds(spark, copies, name):
    d, duck, pairs = copies
    df = catalogue.queries()[name](spark, d)
    found, most = most_rows(spark, df)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert len(found) == 4000 and most < pairs // 2


def test_bits_of_all_pairs_by_kinds(spark, copies):
    """All pairs come out, and order numbers are not compared a pair at a time."""
    d, duck, pairs = copies
    df = catalogue.queries()["l5_bits"](spark, d)
    found = df.collect()
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()['l5_bits']})").fetchall()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want)) and len(found) >= pairs
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
