import json

from pyspark.sql import functions as F

from tessera.operators import profiles
from tessera.streaming import logs


def op(i, op_, key="worship.style", vals=("a",), sid="s"):
    return {"session_id": sid, "id": i, "op": op_, "key": key, "vals": list(vals), "stance": "want", "strength": 0.5, "conf": 0.9, "src": "stated", "ts": f"2024-01-01T00:00:{i:02d}Z"}


def test_stream_of_beliefs_ends_where_the_batch_does(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    files = [[op(1, "assert"), op(2, "assert", "women.preach")], [op(5, "retract", "women.preach"), op(3, "assert", vals=("late",)), op(4, "revise", vals=("b",))], [op(2, "assert", "women.preach")]]
    for n, rows in enumerate(files):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = logs.current_beliefs_stream(logs.read_log_stream(spark, str(folder), files_per_trigger=1))
    out = str(tmp_path / "out")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(logs.upsert_latest(out, ["session_id", "key"], "id")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session_id"], r["key"]): r["vals"] for r in logs.latest(spark.read.parquet(out), ["session_id", "key"], "id").filter("not removed").collect()}
    batch = spark.read.schema("session_id string, id long, op string, key string, vals array<string>").json(str(folder))
    want = {(r["session_id"], r["key"]): r["vals"] for r in profiles.current_beliefs(batch).collect()}
    assert got == want == {("s", "worship.style"): ["b"]}


def test_repeated_delivery_is_dropped_and_windows_close(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    rows = [(1, 0), (1, 0), (2, 1), (3, 200)]
    (folder / "a.json").write_text("\n".join(json.dumps({"id": i, "ts": f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z", "task": "t", "model": "m", "ok": True, "ms": 5}) for i, m in rows))
    s = spark.readStream.schema("id long, ts timestamp, task string, model string, ok boolean, ms long").json(str(folder))
    q = logs.once_each(s, late="1 hour").writeStream.format("memory").queryName("once_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once_rows").count() == 3
    q = logs.call_stats_stream(s).writeStream.format("memory").queryName("call_windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["calls"] for r in spark.table("call_windows").collect()] == [3]      # the window of the last call is still open
