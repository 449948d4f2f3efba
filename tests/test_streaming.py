import json

from sheetloom.operators import documents
from sheetloom.streaming import events


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_event_fold_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"version": i, "type": ["accepted", "rejected", "promoted", "odd"][i % 4], "payload": f"v{i}"} for i in range(40)]
    write(src / "a.json", rows[:20])
    write(src / "b.json", rows[20:])
    schema = "version long, type string, payload string"
    q = events.folded(events.files(spark, str(src), schema, at_once=1)).writeStream.outputMode("complete").format("memory").queryName("fold").start()
    q.processAllAvailable()
    q.stop()
    got = {r.type: (r.n, r.version, r.payload) for r in spark.sql("SELECT * FROM fold").collect()}
    assert got["accepted"] == (10, 36, "v36") and got["promoted"] == (10, 38, "v38")
    batch = documents.folded(spark.createDataFrame([(r["version"], r["type"], r["payload"]) for r in rows], schema)).collect()[0]
    assert (batch.n_accepted, batch.n_rejected, batch.version, batch.active) == (10, 10, 39, "v38")


def test_replacement_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    put = events.replaced(path, "sheet_id", parts=4)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sheet_id long, v string")
    second = spark.createDataFrame([(2, "B"), (4, "d")], "sheet_id long, v string")
    put(first, 0)
    put(second, 1)
    put(second, 1)
    assert sorted((r.sheet_id, r.v) for r in events.current(spark, path).collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]


def test_cusum_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "a.json", [{"line": 0, "seq": i, "z": 1.0} for i in range(4)])
    write(src / "b.json", [{"line": 0, "seq": 4 + i, "z": 1.0} for i in range(4)])
    s = events.files(spark, str(src), "line long, seq long, z double", at_once=1)
    q = events.cusum_stream(s, 0.5, 2.9).writeStream.outputMode("update").format("memory").queryName("cusum").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT * FROM cusum").orderBy("n").collect()[-1]
    assert (last.n, last.s, last.alarm) == (8, 4.0, 5)


def test_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "a.json", [{"event_date": "2026-01-05T00:00:00", "of": "1", "qtd": 3}, {"event_date": "2025-12-01T00:00:00", "of": "1", "qtd": 9}])
    s = events.files(spark, str(src), "event_date timestamp, of string, qtd long")
    q = events.consumption(s, "2026-01-01").writeStream.outputMode("update").format("memory").queryName("late").start()
    q.processAllAvailable()
    q.stop()
    assert [r.used for r in spark.sql("SELECT * FROM late").collect()] == [3]
