"""Folds of append-only logs and retention as streams that end, at every batch border, where the batch operators do.

State lives in the state store (RocksDB), one small entry per key, and survives lost executors with the
checkpoint. Logs may arrive in any order and in any split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.operators import profiles
from tessera.session import stage_root

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which list and map states and timers need."""
    old = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, old)


# ---------------------------------------------------------------- preferences
_ROW = "id long, op string, vals array<string>, stance string, strength double, conf double, src string, ev string"
STATE_ROW = "session_id {kind}, key string, stance string, vals array<string>, strength double, conf double, src string, ev string, id long, version long, gone boolean"


class _Preferences(StatefulProcessor):
    """Per (session, key): the id of the last clearing row, the rows that still count, and which stances were shown."""

    def init(self, handle) -> None:
        self.clear = handle.getValueState("clear", "id long")
        self.rows = handle.getListState("rows", _ROW)
        self.shown = handle.getMapState("shown", "stance string", "version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clear = self.clear.get()[0] if self.clear.exists() else None
        live = [tuple(r) for r in self.rows.get()]
        for r in rows:
            if r.op == "retract" or r.stance == "neutral":
                clear = r.id if clear is None else max(clear, r.id)
            else:
                live.append((r.id, r.op, r.vals, r.stance, r.strength, r.conf, r.src, r.ev))
        live = [r for r in live if clear is None or r[0] > clear]
        start = {}
        for r in live:
            if r[1] == "revise":
                start[r[3]] = max(r[0], start.get(r[3], r[0]))
        live = sorted((r for r in live if r[3] not in start or r[0] >= start[r[3]]), key=lambda r: r[0])
        if clear is not None:
            self.clear.update((clear,))
        if live:
            self.rows.put(live)
        else:
            self.rows.clear()
        known = {k[0]: v[0] for k, v in self.shown.iterator()}
        version = max(known.values(), default=0) + 1
        by_stance = {}
        for r in live:
            by_stance.setdefault(r[3], []).append(r)
        for stance in {*known, *by_stance}:
            own = by_stance.get(stance, [])
            vals = list(dict.fromkeys(v for r in own for v in r[2] or ()))
            self.shown.updateValue((stance,), (version,))
            if not vals:
                yield Row(session_id=key[0], key=key[1], stance=stance, vals=None, strength=None, conf=None, src=None, ev=None, id=None, version=version, gone=True)
                continue
            last = own[-1]
            yield Row(session_id=key[0], key=key[1], stance=stance, vals=vals, strength=last[4], conf=last[5], src=last[6], ev=last[7], id=last[0], version=version, gone=False)

    def close(self) -> None:
        pass


def preference_states_stream(log: DataFrame) -> DataFrame:
    """Changes of the standing values per (session, key, stance). `version` grows with every change of a key.

    The newest version per (session, key, stance) that isn't `gone` is what `profiles.preference_states` gives
    for all rows seen so far (see `standing`). Ids are unique within a session and key.
    """
    kind = log.schema["session_id"].dataType.simpleString()
    d = log.filter(~F.col("key").isin("location", "for_whom")).select(
        "session_id", "key", F.col("id").cast("long").alias("id"), "op", "vals", "stance", F.col("strength").cast("double").alias("strength"),
        F.col("conf").cast("double").alias("conf"), "src", "ev")
    return d.groupBy("session_id", "key").transformWithState(_Preferences(), STATE_ROW.format(kind=kind), "Update", "None")


def standing(changes: DataFrame, keys=("session_id", "key", "stance")) -> DataFrame:
    """The newest version per key, without what is gone."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return last.select(*keys, "_r.*").filter(~F.col("gone")).drop("version", "gone")


def profiles_of_changes(changes: DataFrame, features: DataFrame) -> DataFrame:
    """Profiles from the table of streamed changes."""
    return profiles.profiles_of_states(standing(changes), features)


# ---------------------------------------------------------------- retention
RETENTION_BUCKETS = 4096


class _Retention(StatefulProcessor):
    """Per bucket of row keys: the newest row of each, and a timer at the earliest end of a retention.

    A call to the state store is a message, so a bucket's rows are read and written together.
    """

    def __init__(self, days: dict[str, int], otherwise: int):
        self.days, self.otherwise = days, otherwise

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "row_key string, scope string, at long, version long, gone boolean")

    def _deadline(self, scope, at: int) -> int:
        # kept while at >= now - days, so gone once now is a millisecond later
        return at // 1000 + self.days.get(scope, self.otherwise) * 86_400_000 + 1

    def _keep(self, held: dict, fired: bool) -> None:
        """Writes the rows and leaves one timer, for the row that goes next."""
        self.held.put(list(held.values()))
        following = min((self._deadline(r[1], r[2]) for r in held.values() if not r[4]), default=None)
        timers = [] if fired else list(self.handle.listTimers())
        for t in timers:
            if t != following:
                self.handle.deleteTimer(t)
        if following is not None and following not in timers:
            self.handle.registerTimer(following)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, held, changed = timerValues.getCurrentWatermarkInMs(), {r[0]: tuple(r) for r in self.held.get()}, {}
        for r in rows:
            at, old = _micros(r.at), held.get(r.row_key)
            if old is not None and (old[2], old[1] or "") >= (at, r.scope or ""):
                continue
            first = changed.get(r.row_key)
            version = first[0] if first else 1 if old is None else old[3] + 1
            held[r.row_key] = (r.row_key, r.scope, at, version, self._deadline(r.scope, at) <= now)
            changed[r.row_key] = (version, r.at)
        if changed:
            self._keep(held, False)
        for k, (version, at) in changed.items():
            yield Row(row_key=k, scope=held[k][1], at=at, version=version, gone=held[k][4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = timerValues.getCurrentWatermarkInMs(), {r[0]: tuple(r) for r in self.held.get()}
        out = [r for r in held.values() if not r[4] and self._deadline(r[1], r[2]) <= now]
        for k, scope, at, version, _ in out:
            held[k] = (k, scope, at, version + 1, True)
        if out:
            self._keep(held, True)
        for k, scope, at, version, _ in out:
            yield Row(row_key=k, scope=scope, at=datetime.fromtimestamp(at // 1_000_000).replace(microsecond=at % 1_000_000), version=version + 1, gone=True)

    def close(self) -> None:
        pass


def _micros(at: datetime) -> int:
    return int(at.replace(microsecond=0).timestamp()) * 1_000_000 + at.microsecond


def retention_stream(rows: DataFrame, seen_at: str, late: str = "0 seconds", days: dict[str, int] | None = None, otherwise: int = 365) -> DataFrame:
    """Changes of the set of rows inside their retention: 90 days for medium, 365 otherwise, as in `jobs.purge`.

    `rows`: row_key (string), scope, at (timestamp of the check), and the event-time column `seen_at`. Now is the watermark.
    A row leaves by an event-time timer, also when nothing new comes for it; a newer row with its key renews it.
    """
    d = rows.withWatermark(seen_at, late).select(F.col("row_key").cast("string").alias("row_key"), "scope", "at", seen_at)
    return d.withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(RETENTION_BUCKETS))).groupBy("bucket").transformWithState(_Retention(days or {"medium": 90}, otherwise), "row_key string, scope string, at timestamp, version long, gone boolean", "Update", "EventTime")


# ---------------------------------------------------------------- generations
def fenced_writer(state: str, out: str):
    """foreachBatch writer: rows of a session's current generation only, by the versioned state table as it is when the batch runs.

    `state`: folder of append-only rows session_id, generation, version; each batch reads it anew. Replays of a batch overwrite it.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        now = current_generations(batch.sparkSession.read.parquet(state))
        live = profiles.live_rows(batch, now)
        live.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return write


def current_generations(state: DataFrame) -> DataFrame:
    return state.groupBy("session_id").agg(F.max_by("generation", "version").alias("generation"))


def fenced_rows(out: DataFrame, state: DataFrame) -> DataFrame:
    """What a reader sees: rows written so far whose generation is still the current one."""
    return profiles.live_rows(out, current_generations(state))


def poll(out: DataFrame, state: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of current generations that are numbered above what each session has read. `seen`: session_id, since."""
    return profiles.messages_after(fenced_rows(out, state), seen)


# ---------------------------------------------------------------- running
def run_to_end(stream: DataFrame, name: str = "fold", mode: str = "update", writer=None) -> DataFrame:
    """Runs a stream over all there is now and returns its changes as a table in the shared folder."""
    spark = stream.sparkSession
    root = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    put = writer or (lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{root}/rows/epoch={epoch}"))
    with rocks_state(spark):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
        q.awaitTermination()
    if writer is not None:
        return None
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
