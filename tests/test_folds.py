"""Streams against the batch operators at every border of random batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import jobs, profiles
from tessera.streaming import folds

LOG = "session_id string, id long, op string, key string, vals array<string>, stance string, strength double, conf double, src string, ev string"


def step(stream, out, checkpoint):
    with folds.rocks_state(stream.sparkSession):
        q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
            lambda b, epoch: b.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return q.lastProgress


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_the_log_gives_the_batch_states(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("st"), i, rng.choice(["assert", "assert", "confirm", "revise", "retract"]), rng.choice(["a.b", "c.d", "location"]), rng.sample(["x", "y", "z", "w"], rng.randint(0, 3)),
             rng.choice(["want", "want", "avoid", "neutral"]), i / 100, 0.5, "stated", f"said {i}") for i in range(60)]
    rng.shuffle(rows)
    folder, out, seen = tmp_path / "log", str(tmp_path / "out"), []
    folder.mkdir()
    cuts = sorted(rng.sample(range(1, 60), 3))
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60])):
        spark.createDataFrame(rows[a:b], LOG).coalesce(1).write.mode("append").parquet(str(folder))
        seen += rows[a:b]
        step(folds.preference_states_stream(spark.readStream.schema(LOG).parquet(str(folder))), out, str(tmp_path / "cp"))
        changes = spark.read.parquet(out)
        cols = ["session_id", "key", "stance", "vals", "strength", "conf", "src", "ev", "id"]
        got = {tuple(map(str, r)) for r in folds.standing(changes).select(*cols).collect()}
        want = {tuple(map(str, r)) for r in profiles.preference_states(spark.createDataFrame(seen, LOG)).select(*cols).collect()}
        assert got == want, n


def test_timers_keep_what_the_purge_keeps(spark, tmp_path):
    """Now is the watermark; a row renewed in a later batch stays, and rows leave while nothing comes for them."""
    start, rng = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), random.Random(4)
    schema = "row_key string, scope string, at timestamp, seen_at timestamp"
    folder, out, seen = tmp_path / "rows", str(tmp_path / "out"), {}
    folder.mkdir()
    for n in range(5):
        now = start + dt.timedelta(days=100 * n)
        rows = [(f"k{rng.randint(0, 25)}", rng.choice(["medium", "deep"]), now - dt.timedelta(days=rng.choice([0, 10, 50, 90, 91, 200, 365, 366])), now) for _ in range(12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for r in rows:
            seen[r[0]] = max(seen.get(r[0], r), r, key=lambda x: (x[2], x[1]))
        progress = step(folds.retention_stream(spark.readStream.schema(schema).parquet(str(folder)), "seen_at"), out, str(tmp_path / "cp"))
        mark = progress["eventTime"]["watermark"]
        assert mark.startswith(now.strftime("%Y-%m-%d"))
        got = {r.row_key for r in folds.standing(spark.read.parquet(out), ["row_key"]).collect()}
        want = {r.row_key for r in jobs.purge(spark.createDataFrame(list(seen.values()), schema), F.lit(mark).cast("timestamp"), "at").collect()}
        assert got == want and got


def test_rows_of_an_old_generation_never_appear(spark, tmp_path):
    """The generation moves between batches; late rows of the old one are shut out, and those written before go with the move."""
    folder, state, out = tmp_path / "rows", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()
    rows = lambda *r: spark.createDataFrame(r, "session_id string, generation int, n int").coalesce(1).write.mode("append").parquet(str(folder))
    move = lambda s, g, v: spark.createDataFrame([(s, g, v)], "session_id string, generation int, version int").write.mode("append").parquet(state)

    def run():
        stream = spark.readStream.schema("session_id string, generation int, n int").parquet(str(folder))
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(folds.fenced_writer(state, out)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        table = spark.read.parquet(out)
        return {(r.session_id, r.n) for r in table.collect()}, {(r.session_id, r.n) for r in folds.fenced_rows(table, spark.read.parquet(state)).collect()}
    move("s", 0, 0)
    move("t", 0, 0)
    rows(("s", 0, 1), ("t", 0, 1), ("t", 1, 2))
    assert run() == ({("s", 1), ("t", 1)}, {("s", 1), ("t", 1)})
    move("s", 1, 1)
    rows(("s", 0, 2), ("s", 1, 3), ("t", 0, 4), ("u", 0, 1))
    written, seen = run()
    assert ("s", 2) not in written and seen == {("s", 3), ("t", 1), ("t", 4)}
    since = spark.createDataFrame([("s", 0), ("t", 1)], "session_id string, since int")
    assert {(r.session_id, r.n) for r in folds.poll(spark.read.parquet(out), spark.read.parquet(state), since).collect()} == {("s", 3), ("t", 4)}


def test_many_keys_cost_a_few_calls_to_the_state():
    """One read, one write and one timer for all rows of a bucket, however many keys they have."""
    calls, store = [], []

    class Handle:
        def getListState(self, *_): return self
        def get(self): calls.append("get"); return iter(list(store))
        def put(self, rows): calls.append("put"); store[:] = rows
        def listTimers(self): calls.append("list"); return iter([])
        def registerTimer(self, t): calls.append("register")
        def getCurrentWatermarkInMs(self): return 0

    p, at = folds._Retention({"medium": 90}, 365), dt.datetime(2020, 1, 1)
    p.init(Handle())
    out = list(p.handleInputRows((0,), iter([Row(row_key=f"k{i}", scope="deep", at=at) for i in range(100)]), Handle()))
    assert len(out) == 100 and calls == ["get", "put", "list", "register"]
