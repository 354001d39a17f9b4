"""Registered queries that run a stream over a whole given table to its end. Each must give the rows of its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.columns import rounded
from tessera.queries import facts as T
from tessera.queries.records import NOW, job_table_of
from tessera.queries.registry import SQL, query, table, table_stream
from tessera.session import stage_root
from tessera.streaming import folds


@query("stream_preferences", SQL["oplog_preferences"])
def stream_preferences(spark, sf):
    """The preference fold over the log as a stream."""
    changes = folds.run_to_end(folds.preference_states_stream(T.oplog_of(table_stream(spark, sf, "events"))), "preferences")
    return folds.standing(changes).select("session_id", "key", "stance", F.array_join("vals", ",").alias("vals"), "id",
                                          rounded(F.col("strength"), 4).alias("strength"), rounded(F.col("conf"), 4).alias("conf"), "src")


@query("stream_profiles", SQL["oplog_profiles"])
def stream_profiles(spark, sf):
    """Profiles from the streamed changes."""
    changes = folds.run_to_end(folds.preference_states_stream(T.oplog_of(table_stream(spark, sf, "events"))), "preferences")
    p = folds.profiles_of_changes(changes, T.features(spark, sf))
    return p.select("session_id", "feature", F.array_join("want", ",").alias("want"), F.array_join("avoid", ",").alias("avoid"), "weight")


@query("stream_retention", SQL["retention_purge"])
def stream_retention(spark, sf):
    """Rows left by event-time timers once the watermark stands at the time of the purge."""
    d = job_table_of(table_stream(spark, sf, "orders")).select(F.col("job_id").cast("string").alias("row_key"), F.col("kind").alias("scope"), F.col("started_at").alias("at"),
                                                               F.lit(NOW).cast("timestamp").alias("seen_at"))
    changes = folds.run_to_end(folds.retention_stream(d, "seen_at"), "retention")
    return folds.standing(changes, ["row_key"]).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("stream_job_expiry", SQL["job_expiry"])
def stream_job_expiry(spark, sf):
    """Results of finished jobs that timers have let expire; jobs left running are errors."""
    done = job_table_of(table_stream(spark, sf, "orders")).filter("status = 'complete'")
    d = done.select(F.col("job_id").cast("string").alias("row_key"), F.col("kind").alias("scope"), F.coalesce("verified_at", "finished_at").alias("at"), F.lit(NOW).cast("timestamp").alias("seen_at"))
    changes = folds.run_to_end(folds.retention_stream(d, "seen_at"), "expiry")
    kept = folds.standing(changes, ["row_key"]).select(F.col("row_key").cast("long").alias("job_id"), F.lit(True).alias("kept"))
    jobs = job_table_of(table(spark, sf, "orders")).join(kept, "job_id", "left")
    new = F.when((F.col("status") == "complete") & F.col("kept").isNull(), "expired").when(F.col("status").isin("pending", "running"), "error").otherwise(F.col("status"))
    return jobs.groupBy("kind", "status", new.alias("new_status")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_fence", SQL["generation_fence"])
def stream_fence(spark, sf):
    """Rows of current generations, checked batch by batch against a versioned state table."""
    root = f"{stage_root(spark)}/fence-{uuid.uuid4().hex}"
    sessions = table(spark, sf, "events").select(F.col("user_id").alias("session_id")).distinct()
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), ((F.col("session_id") + 2 + v) % 3).alias("generation")) for v in (0, 1)]))
    sessions.select("session_id", versions.alias("_v")).select("session_id", "_v.version", "_v.generation").write.parquet(f"{root}/state")
    rows = table_stream(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", (F.get_json_object("props", "$.k").cast("long") % 3).alias("generation"))
    folds.run_to_end(rows, "fence", "append", folds.fenced_writer(f"{root}/state", f"{root}/rows"))
    out = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    return folds.fenced_rows(out, spark.read.parquet(f"{root}/state")).select("session_id", "event_id")
