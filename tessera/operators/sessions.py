"""Reviews, chats, tasks and attempts: ordered state of a key, as batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import ranked

#: Rejections after which a review ends without approval.
MAX_ROUNDS = 5


def review_states(events: DataFrame) -> DataFrame:
    """The state of each review session from its decisions (session_key, ts, id, decision).

    Approval or change ends a session; a rejection opens the next round, and the
    fifth ends it unapproved, the status before it staying. What comes after
    the end counts for nothing. Only where sessions end decides, so a session's
    events need no fold: the first ending decision and the rejections before it
    tell the state.
    """
    order = Window.partitionBy("session_key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rejected = (F.col("decision") == "REJECTED").cast("int")
    good = F.col("decision").isin("APPROVED", "MODIFIED")
    rows = events.filter("decision <> 'PENDING'").withColumns({"rejects": F.sum(rejected).over(order), "goods": F.sum(good.cast("int")).over(order)})
    # events up to and with the ending one: no good decision before, and not beyond the last round
    live = rows.filter(((F.col("goods") == 0) & (F.col("rejects") <= MAX_ROUNDS)) | (good & (F.col("goods") == 1) & (F.col("rejects") < MAX_ROUNDS)))
    state = live.groupBy("session_key").agg(
        F.max("rejects").cast("int").alias("round"), F.bool_or(good).alias("approved"),
        F.max_by("decision", F.when(F.col("rejects") < MAX_ROUNDS, F.struct("ts", "id"))).alias("last_status"),
    )
    every = events.select("session_key").distinct().join(state, "session_key", "left")
    rows = every.select("session_key", F.coalesce("round", F.lit(0)).alias("round"), F.coalesce("approved", F.lit(False)).alias("approved"), F.coalesce("last_status", F.lit("PENDING")).alias("last_status"))
    return rows.withColumn("terminated", F.col("approved") | (F.col("round") >= MAX_ROUNDS))


def latest_states(rows: DataFrame) -> DataFrame:
    """Per session the stored state of the highest round, the later id among equals."""
    return rows.groupBy("session_key").agg(F.max_by(F.struct("id", "round", "decision"), F.struct("round", "id")).alias("r")).select("session_key", "r.*")


def context(messages: DataFrame, last: int = 8, cut: int = 300) -> DataFrame:
    """The last messages of each conversation, oldest first, each cut: (conv_id, context)."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))
    rows = messages.withColumn("rn", rn).filter(F.col("rn") <= last)
    listed = F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("rn", "role", F.substring("text", 1, cut).alias("text"))))), lambda x: F.concat(x.role, F.lit(": "), x.text))
    return rows.groupBy("conv_id").agg(F.array_join(listed, "\n").alias("context"))


def titles(messages: DataFrame, cut: int = 18) -> DataFrame:
    """A title per conversation: its first user text, white space collapsed, cut."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return first.select("conv_id", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, cut).alias("title"))


def ordered(messages: DataFrame) -> DataFrame:
    """Newest conversations first, messages by turn."""
    return messages.orderBy(F.desc("conv_id"), "turn", "text")


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with the places that ``ordered`` shows them at: that of their conversation (``session``), newest first, and theirs in it (``nth``)."""
    newest = ranked(messages.select("conv_id").distinct(), [], [F.desc("conv_id")], "session")
    return ranked(messages, ["conv_id"], ["turn", "text", "role"]).join(newest, "conv_id")


def without_sessions(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages whose conversation is not deleted."""
    return messages.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def first_failure(stages: DataFrame, failed: Column) -> DataFrame:
    """Per run the first failing stage: stages (run_id, pos, node, message)."""
    return stages.filter(failed).groupBy("run_id").agg(F.min_by(F.struct("node", "message"), "pos").alias("f"), F.min("pos").alias("pos")).select("run_id", "pos", "f.*")


def outcomes(attempts: DataFrame, retries: int = 2) -> DataFrame:
    """Per request: SUCCESS if one of the first retries + 1 attempts succeeds, else DEGRADED if any does, else FAILED."""
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("ts", "id"))
    rows = attempts.withColumn("nth", nth).groupBy("request_id").agg(F.bool_or(F.col("ok") & (F.col("nth") <= retries + 1)).alias("soon"), F.bool_or("ok").alias("ever"), F.count(F.lit(1)).alias("attempts"))
    return rows.select("request_id", "attempts", F.when(F.col("soon"), "SUCCESS").when(F.col("ever"), "DEGRADED").otherwise("FAILED").alias("outcome"))


def over_limit(requests: DataFrame, width: str = "1 second", limit: int = 100) -> DataFrame:
    """Windows in which a route gets more requests than allowed: requests (route, ts)."""
    return requests.groupBy(F.window("ts", width), "route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(F.col("window.start").alias("start"), "route", "n")


def cache_writes(lookups: DataFrame, seconds: int = 3600) -> DataFrame:
    """Look-ups (key, ts, id) that write an entry: the key's first, and the first later than ``seconds`` after the last write.

    A key's look-ups pass through a task in order; only the time of its last
    write is held.
    """
    schema = T.StructType([lookups.schema[c] for c in ("key", "ts", "id")])
    rows = lookups.select("key", "ts", "id").repartition("key").sortWithinPartitions("key", "ts", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = written = None
        for batch in batches:
            keep = []
            for key, ts in zip(batch["key"], batch["ts"], strict=True):
                new = written is None or key != held or ts - written > pd.Timedelta(seconds=seconds)
                if new:
                    held, written = key, ts
                keep.append(new)
            yield batch[keep]

    return rows.mapInPandas(run, schema)


def task_states(events: DataFrame) -> DataFrame:
    """The state of each task from its events (task_id, ts, id, event): RUNNING, SUCCESS or FAILED by the last one, with start and end."""
    order = F.struct("ts", "id")
    done = F.col("event").isin("SUCCESS", "FAILED")
    rows = events.groupBy("task_id").agg(
        F.max_by("event", order).alias("status"), F.min("ts").alias("started_at"), F.max(F.when(done, F.col("ts"))).alias("finished_at"), F.count(F.lit(1)).alias("events"),
    )
    return rows.withColumn("progress", F.when(F.col("status") == "SUCCESS", 100).when(F.col("status") == "FAILED", 0).otherwise(50))


def listing(projects: DataFrame, user: Column | None = None, status: str = "READY") -> DataFrame:
    """Projects (status, owner, created_at, others) that are ready, newest first; with a user above 0 those of that user and those of nobody."""
    rows = projects.filter(F.col("status") == status)
    if user is not None:
        rows = rows.filter((user <= 0) | (F.col("owner") == user) | F.col("owner").isNull())
    return rows.orderBy(F.desc("created_at"))
