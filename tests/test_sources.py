import json

import pytest
from pyspark.sql import functions as F

from sheetloom.sources import imports, tables


def test_rows_keep_their_files_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("OF;Nome\n" + "".join(f"{i};n{i}\n" for i in range(300)))
    (tmp_path / "b.csv").write_text('﻿OF;Nome\n7;"x;y"\n;\n9;z\n', encoding="utf-8")
    rows = tables.sheet_rows(spark, str(tmp_path))
    got = sorted((r.file.rsplit("/", 1)[1], r.ord, r.of, r.nome) for r in rows.collect())
    assert got[:2] == [("a.csv", 1, "0", "n0"), ("a.csv", 2, "1", "n1")] and got[299][1:] == (300, "299", "n299")
    assert [g[1:] for g in got[300:]] == [(1, "7", "x;y"), (2, None, None), (3, "9", "z")]
    b = rows.where(F.col("file").endswith("b.csv"))
    assert [r.of for r in tables.until_blank(b, "of").collect()] == ["7"]


def test_plan_by_its_header(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("of;ov;cliente;quanttrp;corte;solda;esp\n100001;5;A;10;4;;2,5\nx;6;B;1;1;1;1\n")
    r = tables.plan(tables.sheet_rows(spark, str(tmp_path))).collect()
    assert len(r) == 1 and (r[0].of, r[0].quanttrp, r[0].esp) == ("100001", 10.0, 2.5)
    assert [(p.phase, p.qty) for p in r[0].fases] == [("corte", 4.0), ("solda", None)]


def test_one_row_for_each_key(spark):
    people = spark.createDataFrame([("7", "B", 2), ("07", "A", 1), ("8", "C", 3)], "cod string, nome string, ord int")
    got = tables.keyed(people, F.col("cod").try_cast("int"), F.col("ord")).collect()
    assert sorted((r.key, r.nome) for r in got) == [(7, "A"), (8, "C")]


def test_newest_file_of_each_kind(spark, tmp_path):
    for i, (name, text) in enumerate((("a.csv", "of;ov"), ("b.csv", "of;ov;x"), ("c.csv", "lote;qtd"), ("d.txt", "?"))):
        (tmp_path / name).write_text(text)
        import os

        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    head = F.decode(F.substring("content", 1, 100), "UTF-8")
    kind = F.when(head.startswith("of;"), "plan").when(head.startswith("lote;"), "stock")
    got = {r.kind: r.path.rsplit("/", 1)[1] for r in tables.newest_files(spark, str(tmp_path), kind).collect()}
    assert got == {"plan": "b.csv", "stock": "c.csv"}


def test_blocks_in_two_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h;1\n\n1;x,y\n2;b\n\nf;9\n")
    (tmp_path / "b.csv").write_text("1,a\n2,b\n")
    got = {(r.file.rsplit("/", 1)[1], r.block, r.place): r.cells for r in tables.read_blocks(spark, str(tmp_path), None).collect()}
    assert got[("a.csv", 1, 0)] == ["1", "x,y"] and got[("a.csv", 2, 0)] == ["f", "9"] and got[("b.csv", 0, 1)] == ["2", "b"]


def test_documents_and_records(spark, tmp_path):
    docs, log = tmp_path / "docs", tmp_path / "log"
    docs.mkdir()
    log.mkdir()
    (docs / "1.json").write_text(json.dumps({"a": 1, "b": "x"}, indent=1))
    (docs / "2.json").write_text("{broken")
    (log / "l.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": 2, "b": "y"}\n')
    got = tables.documents(spark, str(docs), "a long, b string").collect()
    assert [(r.a, r.b) for r in got] == [(1, "x")] and got[0].file.endswith("1.json")
    assert sorted(r.a for r in tables.records(spark, str(log), "a long, b string").collect()) == [1, 2]


def test_snapshots_keep_the_last_good_one(spark, tmp_path):
    path = str(tmp_path / "s")
    assert tables.latest(spark, path) is None
    tables.snapshot(spark.range(3).toDF("k"), path, "001")
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("k"))
    with pytest.raises(Exception, match="no"):
        tables.snapshot(bad, path, "002")
    assert tables.latest(spark, path).count() == 3
    tables.snapshot(spark.range(4).toDF("k"), path, "003")
    assert tables.latest(spark, path).count() == 4
    tables.write_json(spark.range(2), str(tmp_path / "j"), "001")
    assert spark.read.json(str(tmp_path / "j" / "001")).count() == 2


def test_imports(spark, tmp_path, monkeypatch):
    path, day = str(tmp_path / "refs"), lambda df: df.agg(F.max("day")).collect()[0][0]
    rows = lambda *days: spark.createDataFrame([(i, d) for i, d in enumerate(days)], "k long, day string")
    assert imports.imported(spark, rows("2026-01-02"), path, "1", day).outcome == "taken"
    assert imports.imported(spark, rows("2026-01-02"), path, "2", day).outcome == "same"
    assert imports.imported(spark, rows("2026-01-01", "2025-01-01"), path, "3", day).outcome == "older"
    assert imports.imported(spark, rows("2026-01-02").limit(0), path, "4", day).outcome == "empty"
    assert imports.imported(spark, rows("2026-01-02", "2026-01-03"), path, "5", day).outcome == "taken"
    whole = tables.snapshot
    monkeypatch.setattr(tables, "snapshot", lambda df, p, s: whole(df.limit(1), p, s))  # a writing that loses rows
    assert imports.imported(spark, rows("2026-01-04", "2026-01-05"), path, "6", day).outcome == "mismatch"
    assert day(tables.latest(spark, path)) == "2026-01-03"


def test_watched_references(spark):
    at = {"now": 0.0, "seen": 1, "n": 2, "fail": False}

    def read():
        if at["fail"]:
            raise OSError("gone")
        return spark.range(at["n"])

    w = imports.Watched(read, lambda: at["seen"], 10.0, lambda: at["now"])
    assert w.get().count() == 2
    at |= {"n": 5, "seen": 2}
    assert w.get().count() == 2  # not asked again yet
    at["now"] = 11.0
    assert w.get().count() == 5
    at |= {"now": 30.0, "seen": 3, "fail": True}
    assert w.get().count() == 5 and "gone" in w.failed
    at |= {"now": 50.0, "fail": False, "n": 7}
    assert w.get().count() == 7 and w.failed is None


def test_kept_results(spark):
    now, made = {"t": 0.0}, []
    kept = imports.Kept(30, lambda: now["t"])

    def make():
        made.append(1)
        return spark.range(len(made))

    assert [kept.get("a", 1, make).count(), kept.get("a", 1, make).count(), kept.get("a", 2, make).count()] == [1, 1, 2]
    now["t"] = 31.0
    assert kept.get("a", 2, make).count() == 3
