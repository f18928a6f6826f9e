"""The event stream of crawls: status folding, terminal actions, bounded history, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.safety import is_terminal

#: Events that are kept.
LAST = 500


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """Events of the Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each event once, whatever was delivered twice; a stream forgets ids older than ``late`` behind its newest event."""
    if events.isStreaming and late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def latest_status(events: DataFrame) -> DataFrame:
    """(job_id, status, ts): the newest status of each job; ties go to the larger event id."""
    st = events.where("status is not null and job_id is not null")
    return st.groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("v")).select("job_id", "v.status", "v.ts")


def active(events: DataFrame) -> DataFrame:
    """Jobs whose newest status is not terminal."""
    return latest_status(events).where(~is_terminal(F.col("status")))


def fold_status(events: DataFrame) -> DataFrame:
    """(job_id, status, active) as a stream: a state per job that newer events replace, late ones do not."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        ts, eid, status = state.get if state.exists else (pd.Timestamp.min.value // 1000, -1, None)
        for f in frames:
            for t, e, s in zip(f["ts"], f["event_id"], f["status"]):
                v = t.value // 1000
                if s is not None and (v, e) > (ts, eid):
                    ts, eid, status = v, int(e), s
        state.update((ts, eid, status))
        if status is not None:
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "active": [status.lower() not in ("completed", "failed", "cancelled")]})

    rows = events.where("job_id is not null and status is not null and ts is not null").select("job_id", "event_id", "ts", "status")
    return rows.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, active boolean", "ts long, event_id long, status string", "update", GroupStateTimeout.NoTimeout)


def last_events(events: DataFrame, n: int = LAST) -> DataFrame:
    """The newest ``n`` events (a bounded report)."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def last_per_job(events: DataFrame, n: int = LAST) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def on_terminal(events: DataFrame, action: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that hands each job that ends to ``action`` once (at least once if the action itself fails half-way)."""
    ended = events.where(is_terminal(F.col("status")) & F.col("job_id").isNotNull()).dropDuplicates(["job_id"])
    return ended.writeStream.foreachBatch(lambda df, _: action(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, events) in windows of equal size."""
    e = events.withWatermark("ts", late) if events.isStreaming and late else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(job_id, start, stop, events): runs of events of a job with gaps below ``gap``."""
    return events.where("job_id is not null").groupBy("job_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events")).select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "events")


def to_json(events: DataFrame) -> DataFrame:
    """(event_id, json): events as they go out in camel case, nulls left out."""
    p, g = F.col("progress"), F.col("page")
    progress = F.when(p.isNotNull(), F.struct(p["pages_crawled"].alias("pagesCrawled"), p["page_limit"].alias("pageLimit"), p["current_url"].alias("currentUrl"), p["depth"].alias("depth"), p["max_depth"].alias("maxDepth"), p["start_time"].alias("startTime")))
    page = F.when(g.isNotNull(), F.struct(g["url"].alias("url"), g["title"].alias("title"), g["status"].alias("status"), g["links_count"].alias("linksCount")))
    return events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("job_id").alias("jobId"), F.col("batch_id").alias("batchId"), "status", "level", "message", "kind", progress.alias("progress"), page.alias("page"), F.col("current_index").alias("currentIndex"), "total", F.col("current_job_id").alias("currentJobId"))).alias("json"))


def auto_export(events: DataFrame, export: Callable[[str], None], checkpoint: str):
    """Start a query that exports each job when it completes for the first time (job ids of a micro-batch come to the driver, exports run there)."""
    done = events.where("lower(status) = 'completed' and job_id is not null").select("job_id", "event_id").dropDuplicates(["job_id"])

    def each(df: DataFrame, _: int) -> None:
        for r in df.select("job_id").toLocalIterator():
            export(r["job_id"])

    return done.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
