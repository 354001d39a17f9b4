"""The same folds over streams of append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import schemas as S


def read_log_stream(spark: SparkSession, folder: str, schema: str = S.MEMORY_LOG, files_per_trigger: int | None = None) -> DataFrame:
    """JSON log files as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(folder)


def once_each(rows: DataFrame, at: str = "ts", key: str = "id", late: str = "1 day") -> DataFrame:
    """Drop rows delivered twice; ids are remembered only as long as late rows may come."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


BELIEF_STATE = "id long, op string, vals array<string>, stance string, strength double, conf double, src string"
BELIEF_ROW = "session_id string, key string, id long, op string, vals array<string>, stance string, strength double, conf double, src string, removed boolean"


def current_beliefs_stream(log: DataFrame) -> DataFrame:
    """Standing value per (session, key) as updates: the newest row by id wins, a retraction removes.

    State is one row per key. A late row older than the stored one changes nothing.
    """
    cols = ["id", "op", "vals", "stance", "strength", "conf", "src"]

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState):
        best = state.get if state.exists else None
        start = None if best is None else best[0]
        for pdf in batches:
            top = pdf.loc[pdf["id"].idxmax()]
            if best is None or top["id"] > best[0]:
                best = tuple([int(top["id"])] + [list(top[c]) if c == "vals" and top[c] is not None else top[c] for c in cols[1:]])
        if best is None or best[0] == start:
            return
        state.update(best)
        yield pd.DataFrame([[key[0], key[1], *best, best[1] == "retract"]], columns=["session_id", "key", *cols, "removed"])
    return log.select("session_id", "key", *cols).groupBy("session_id", "key").applyInPandasWithState(
        fold, BELIEF_ROW, BELIEF_STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_latest(path: str, keys: list[str], order: str):
    """foreachBatch writer: append the batch, readers take the newest row per key (see `latest`). Replays are harmless."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(path)
    return write


def latest(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def call_stats_stream(calls: DataFrame, at: str = "ts", every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls, errors and total time per (task, model) and window; a window closes once no late row can change it."""
    return (calls.withWatermark(at, late).groupBy(F.window(at, every), "task", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum("ms").alias("total_ms"))
        .select(F.col("window.start").alias("start"), "task", "model", "calls", "errors", "total_ms"))
