"""Streams of tasks, requests, look-ups, reviews and issues.

State of a key is held by ``transformWithState`` and ends: events wait in it
until the watermark has passed them and are then applied in order of time and
id, so a stream gives what the batch operator gives however events within the
delay arrive; an event that comes twice is applied once; what is older than the
watermark counts for nothing; and a key leaves the state a given time after its
last event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import MAX_ROUNDS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def messages(spark: SparkSession, source: str, schema: str, form: str = "json", **options: str) -> DataFrame:
    """Task messages: JSON lines of files that arrive in the folder ``source``, or with ``form`` kafka the JSON values of a topic of that name."""
    if form == "json":
        return spark.readStream.schema(schema).options(**options).json(source)
    rows = spark.readStream.format(form).options(**options).option("subscribe", source).load()
    return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def table(spark: SparkSession, path: str, schema, most_files: int = 8) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def requests_over_limit(requests: DataFrame, width: str = "1 second", limit: int = 100, late: str = "10 seconds") -> DataFrame:
    """Windows in which a route (route, ts) gets more requests than allowed."""
    counts = requests.withWatermark("ts", late).groupBy(F.window("ts", width), "route").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > limit).select(F.col("window.start").alias("start"), "route", "n")


def live_counts(issues: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Issues by window, project and level."""
    counts = issues.withWatermark("ts", late).groupBy(F.window("ts", width), "project_id", "risk_level").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "project_id", "risk_level", "n")


@dataclass(frozen=True)
class Fold:
    """How a key's events make its state: ``begin`` is the state before the first, ``step`` (state, time, event) gives the next, ``tells`` what is put out of it."""

    begin: tuple
    state: str
    step: Callable[[tuple, int, str | None], tuple]


class Ordered(StatefulProcessor):
    """Applies a key's events (us, id, event) in order once the watermark has passed them, and forgets it ``keep`` milliseconds after the last."""

    def __init__(self, fold: Fold, keep: int, key: str, each: bool):
        self.fold, self.keep, self.key, self.each = fold, keep, key, each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, id long, event string")
        self.now = handle.getValueState("now", self.fold.state)
        self.last = handle.getValueState("last", "us long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.held.appendValue((r.us, r.id, r.event))
            self.handle.registerTimer(max(-(-r.us // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted((tuple(x) for x in self.held.get()), key=lambda x: x[:2]) if self.held.exists() else []
        due = [x for x in held if x[0] <= at * 1000]
        state = tuple(self.now.get()) if self.now.exists() else self.fold.begin
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for us, id_, event in due:
            if last is None or (us, id_) > last:
                state, last = self.fold.step(state, us, event), (us, id_)
                if self.each:
                    out.append(Row(**{self.key: key[0]}, us=us, id=id_, **dict(zip(self.names, state, strict=True))))
        if due:
            self.held.clear()
            if held[len(due) :]:
                self.held.put(held[len(due) :])
            if last is not None:
                self.now.update(state)
                self.last.update(last)
                self.handle.registerTimer(max(last[0] // 1000 + self.keep + 1, at + 1))
            if not self.each:
                out.append(Row(**{self.key: key[0]}, **dict(zip(self.names, state, strict=True))))
        elif not held and last is not None and at > last[0] // 1000 + self.keep:
            self.now.clear()
            self.last.clear()
        return iter(out)

    @property
    def names(self) -> list[str]:
        return [f.strip().split()[0] for f in self.fold.state.split(",")]

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, event: str | None, fold: Fold, keep: int, late: str, each: bool = False) -> DataFrame:
    """The state of each key after every time that events of it were applied, or with ``each`` after each event: events (key, ts, id, event)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # which this kind of state needs
    name = F.col(event) if event else F.lit(None).cast("string")
    rows = events.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("us"), F.col("id").cast("long").alias("id"), name.alias("event"))
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, us long, id long, {fold.state}" if each else f"{key} {kind}, {fold.state}"
    return rows.groupBy(key).transformWithState(Ordered(fold, keep, key, each), out, "Append" if each else "Update", "EventTime")


def cache_writes(lookups: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Look-ups (key, ts, id) that write an entry, each valid so long after it is written; an entry leaves the state when it has ended."""

    def step(state: tuple, us: int, _: str | None) -> tuple:
        written = state[0]
        new = written < 0 or us - written > seconds * 1_000_000
        return (us if new else written, new)

    rows = folded(lookups, "key", None, Fold((-1, False), "written long, is_new boolean", step), seconds * 1000, late, each=True)
    return rows.filter("is_new").select("key", F.timestamp_micros("us").alias("ts"), "id")


def review_states(events: DataFrame, keep_days: int = 30, late: str = "10 minutes") -> DataFrame:
    """The state of review sessions whenever events (session_key, ts, id, decision) were applied; a session is forgotten so long after its last event."""

    def step(state: tuple, _: int, decision: str | None) -> tuple:
        rounds, approved, ended, last = state
        if ended or decision == "PENDING":
            return state
        if decision == "REJECTED":
            ended = rounds + 1 >= MAX_ROUNDS
            return (rounds + 1, approved, ended, last if ended else "REJECTED")
        return (rounds, True, True, decision)

    begin = (0, False, False, "PENDING")
    return folded(events, "session_key", "decision", Fold(begin, "round int, approved boolean, terminated boolean, last_status string", step), keep_days * 86_400_000, late)


def task_states(events: DataFrame, keep_days: int = 7, late: str = "10 minutes") -> DataFrame:
    """The state of tasks whenever events (task_id, ts, id, event) were applied: status, events, progress, start and end; a task is forgotten so long after its last event."""

    def step(state: tuple, us: int, event: str | None) -> tuple:
        _, n, _, started, finished = state
        done = event in ("SUCCESS", "FAILED")
        return (event, n + 1, {"SUCCESS": 100, "FAILED": 0}.get(event, 50), us if started < 0 else started, us if done else finished)

    fold = Fold((None, 0, 0, -1, -1), "status string, events long, progress int, started_us long, finished_us long", step)
    rows = folded(events, "task_id", "event", fold, keep_days * 86_400_000, late)
    ended = F.when(F.col("finished_us") >= 0, F.timestamp_micros("finished_us"))
    return rows.select("task_id", "status", F.timestamp_micros("started_us").alias("started_at"), ended.alias("finished_at"), "events", "progress")


def intake(tasks: DataFrame, status: DataFrame, sink: Callable[[DataFrame], None], actions: tuple[str, ...], checkpoint: str, late: str = "1 day"):
    """Start a query that hands each task (task_id, action, ts) of a known action that is PENDING by ``status`` (task_id, status) to ``sink`` once.

    Messages without a task or of other actions are left out. A task that is
    delivered again within ``late`` is dropped by its id, in the same batch, in
    a later one or after a restart, since what was seen is part of the query's
    checkpoint. ``status`` is joined as a table, which Spark reads anew for
    each batch. The sink gets the number of the batch in ``batch``: one that
    replaces that batch's rows makes a batch that is repeated after a failure
    count once too.
    """
    known = tasks.filter(F.col("action").isin(*actions) & F.col("task_id").isNotNull())
    once = known.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id"])
    fresh = once.join(status.filter("status = 'PENDING'").select("task_id").distinct(), "task_id", "left_semi")

    def take(batch: DataFrame, nth: int) -> None:
        sink(batch.withColumn("batch", F.lit(nth).cast("long")))

    return fresh.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()


def replacing_batches(path: str) -> Callable[[DataFrame], None]:
    """A sink that keeps each batch in a part of its own, so that writing a batch again replaces it."""

    def write(batch: DataFrame) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write
