"""Job and message tables: latest, guarded status, retention, reuse, numbering, cascade delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.columns import in_turn
from tessera.operators.ordering import first_per_group, ordered_rank

TERMINAL = ("complete", "error", "cancelled", "expired")


def job_states(events: DataFrame) -> DataFrame:
    """Status per job from its change log: the first terminal state stands, later changes are void; else the last one.

    `events`: (job_id, seq, status).
    """
    end = F.col("status").isin(*TERMINAL)
    d = events.groupBy("job_id").agg(F.min_by("status", F.when(end, F.col("seq"))).alias("_end"), F.max_by("status", "seq").alias("_last"),
                                     F.count_if(end).alias("_n"))
    return d.select("job_id", F.when(F.col("_n") > 0, F.col("_end")).otherwise(F.col("_last")).alias("status"))


def latest_jobs(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """Latest visible job of the current generation per (session, church, kind), with percent done."""
    live = jobs.filter("visible").join(state.select("session_id", "generation"), ["session_id", "generation"], "left_semi")
    last = first_per_group(live, ["session_id", "church_id", "kind"], [-F.unix_micros(F.col("started_at")), -F.col("job_id")])
    pct = F.when(F.col("status") == "complete", 100).otherwise(F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total")).cast("int")))
    return last.withColumn("pct", pct)


def reusable_jobs(jobs: DataFrame, now: Column, version: int = 5) -> DataFrame:
    """Latest finished job per (church, kind) and whether its result may be reused: fresh (7 or 30 days) and, for medium, of this version."""
    done = jobs.filter("status = 'complete'")
    last = first_per_group(done, ["church_id", "kind"], [-F.unix_micros(F.col("finished_at")), -F.col("job_id")])
    at = F.coalesce("verified_at", "finished_at")
    fresh = R.fresh_within(at, now, F.when(F.col("kind") == "medium", 7).otherwise(30))
    return last.withColumn("reusable", fresh & ((F.col("kind") != "medium") | F.coalesce(F.col("research_version") == version, F.lit(False))))


def purge(rows: DataFrame, now: Column, at: str = "checked_at", scope: str = "scope") -> DataFrame:
    """Rows still inside their retention (90 days for medium, 365 for deep)."""
    return rows.filter(R.fresh_within(F.col(at), now, F.when(F.col(scope) == "medium", 90).otherwise(365)))


def expire_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Finished jobs past retention lose their result and become expired; jobs left running become errors."""
    old = (F.col("status") == "complete") & ~R.fresh_within(F.coalesce("verified_at", "finished_at"), now, F.when(F.col("kind") == "medium", 90).otherwise(365))
    orphan = F.col("status").isin("pending", "running")
    return jobs.withColumn("new_status", in_turn([(old, "expired"), (orphan, "error")], F.col("status")))


def number_messages(messages: DataFrame, block: Column) -> DataFrame:
    """Sequence number per session by time and id."""
    return ordered_rank(messages, ["session_id"], [F.col("ts"), F.col("message_id")], block, "n")


def last_checked(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("church_id").agg(F.count(F.lit(1)).alias("rows"), F.max("checked_at").alias("last_checked"))


def state_versions(log: DataFrame) -> DataFrame:
    """Version counters per session: accepted preference rows, and every change of its table."""
    return log.groupBy("session_id").agg(F.count_if(F.col("kind") == "memory").alias("memory_version"), F.count(F.lit(1)).alias("table_version"))


def delete_sessions(sessions: DataFrame, links: DataFrame, church_tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the chosen sessions and without churches nobody else uses.

    `links`: (session_id, church_id) from all tables that tie them. Shared churches stay.
    """
    gone = links.join(sessions, "session_id", "left_semi").select("church_id").distinct()
    kept = links.join(sessions, "session_id", "left_anti").select("church_id").distinct()
    unshared = gone.join(kept, "church_id", "left_anti")
    out = {name: t.join(unshared, "church_id", "left_anti") for name, t in church_tables.items()}
    out["links"] = links.join(sessions, "session_id", "left_anti")
    return out


def distinct_questions(questions: DataFrame) -> DataFrame:
    """First question per (session, church) and wording, compared on words only."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"(?U)[^\w]+", " "))
    d = first_per_group(questions.withColumn("_n", norm), ["session_id", "church_id", "_n"], [F.col("id")])
    return d.drop("_n")


def merge_places(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two place lists by id; the first list wins."""
    return first.unionByName(second.join(first.select("church_id"), "church_id", "left_anti"), allowMissingColumns=True)
