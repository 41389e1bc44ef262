"""Streams of reviews and job updates; each has a batch form that gives the same rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opinara.operators.ingest import ingest_reviews
from opinara.operators.ranges import running_sums
from opinara.sources.files import shared_path

TERMINAL = ["completed", "failed", "cancelled"]


def run_available(stream: DataFrame, mode: str, *, keys: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream over what is available; its rows, or with keys the latest batch's row of each key."""
    spark = stream.sparkSession
    out = path or shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")  # a batch that is tried again replaces itself

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").drop("batch")
    if not keys:
        return rows.drop("batch_number")
    last = rows.groupBy(*keys).agg(F.max("batch_number").alias("batch_number"))
    return rows.join(last, [*keys, "batch_number"]).drop("batch_number")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files, or one file: a stream's source takes that only as a pattern."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def ingest_stream(stream: DataFrame, store: str, *, order: str, score: Callable[[DataFrame], DataFrame] | None = None, state: str | None = None) -> list[dict]:
    """Ingests every micro-batch into the store; a batch that is tried again stores nothing twice. Counts of each batch."""
    counts: list[dict] = []

    def one(batch: DataFrame, number: int) -> None:
        counts.append({"batch": number} | ingest_reviews(batch, store, order=order, score=score))

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", state or shared_path(stream.sparkSession, "ingest")).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts


def dedupe_stream(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def latest_status(updates: DataFrame, job: str = "job_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Each job's newest update up to its first terminal one, which ends its feed.

    Two aggregates that combine before the shuffle; no job's history is gathered.
    """
    end = updates.where(F.col("status").isin(TERMINAL)).groupBy(job).agg(F.min(F.struct(time, order)).alias("end"))
    live = updates.join(end, job, "left").where(F.col("end").isNull() | (F.struct(time, order) <= F.col("end")))
    return live.groupBy(job).agg(F.max_by("status", F.struct(time, order)).alias("status"), F.max(time).alias(time), F.count(F.lit(1)).alias("updates"))


def latest_status_stream(stream: DataFrame, delay: str = "60 days", keep_hours: int = 24) -> DataFrame:
    """The same as a stream of (job_id, event_id, status, ts): state per job is its latest update, and whether it has ended.

    Updates of one micro-batch are put in order; those that come in a later batch than a terminal one are ignored, as long as
    the job is remembered: state goes when the watermark, `delay` behind the newest update, has passed the job's latest one by `keep_hours`.
    Updates later than the watermark are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, at, n, ended = state.get if state.exists else (None, None, 0, False)
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for row in pdf.itertuples():
            if ended:
                break
            status, at, n = row.status, row.ts, n + 1
            ended = status in TERMINAL
        state.update((status, at, n, ended))
        state.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000) + keep_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "ts": [at], "updates": [n]})

    return stream.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, ts timestamp, updates long", "status string, ts timestamp, updates long, ended boolean", "update", GroupStateTimeout.EventTimeTimeout)


def job_transitions(updates: DataFrame, job: str = "job_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Each update with the status before and whether the step is allowed."""
    w = Window.partitionBy(job).orderBy(time, order)
    before = F.lag("status").over(w)
    allowed = F.when(before.isNull(), F.col("status") == "pending").when(before == "pending", F.col("status").isin("in_progress", "cancelled")).when(before == "in_progress", F.col("status").isin(TERMINAL)).otherwise(F.lit(False))
    return updates.withColumns({"previous": before, "allowed": allowed})


def job_durations(updates: DataFrame, job: str = "job_id", time: str = "ts") -> DataFrame:
    """Created, started and completed (the first of each), seconds from start to end, and the time to show."""
    first = lambda *s: F.min(F.when(F.col("status").isin(*s), F.col(time)))
    d = updates.groupBy(job).agg(F.min(time).alias("created_at"), first("in_progress").alias("started_at"), first("completed", "failed").alias("completed_at"))
    seconds = F.expr("timestampdiff(SECOND, started_at, completed_at)")
    return d.withColumns({"seconds": seconds, "shown_at": F.coalesce("completed_at", "started_at", "created_at")})


def request_rate(events: DataFrame, key: str, time: str, seconds: int, limit: int) -> DataFrame:
    """Each event with the key's events in the last `seconds` (the far end not included) and whether the limit is reached before it."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("flagged", F.col("recent") > limit)


def pieces(events: DataFrame, key: str, time: str, order: str, seconds: int) -> DataFrame:
    """The events with `at` (microseconds) and `piece`: the key's gaps of `seconds` or more before them are counted.

    What stands before an event, and how many gaps do, is found by ranges of (key, time), so no key is one task.
    """
    rows = events.withColumn("at", F.unix_micros(F.col(time).cast("timestamp")))
    rows = running_sums(rows, [key], [F.desc("at"), F.desc(order)], {}, ahead={"before": "at"}, name="gaps")
    gap = F.coalesce(F.col("at") - F.col("before") >= seconds * 1_000_000, F.lit(False)).cast("long")
    return running_sums(rows.withColumn("gap", gap).drop("before"), [key], [F.asc("at"), F.asc(order)], {"piece": "gap"}, name="pieces").drop("gap")


def admitted(events: DataFrame, key: str, time: str, order: str, seconds: int, limit: int) -> DataFrame:
    """(key, time, order, admitted): an event is refused if `limit` admitted ones lie in the last `seconds`; refused ones don't count.

    Where a key has no event for `seconds`, nothing is left to remember: there its history is cut, and the pieces are judged
    apart, so a key of many events is spread over tasks. Pieces are sorted within partitions and read as a stream, with `limit` times kept: one
    without such a gap takes time, but no memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = object(), deque()
        for pdf in frames:
            flags = []
            for k, at in zip(zip(pdf[key], pdf["piece"], strict=True), pdf["at"], strict=True):
                if k != current:
                    current, recent = k, deque()
                while recent and recent[0] <= at - seconds * 1_000_000:
                    recent.popleft()
                flags.append(len(recent) < limit)
                if flags[-1]:
                    recent.append(at)
            yield pdf.drop(columns=["at", "piece"]).assign(admitted=flags)

    rows = pieces(events.select(key, time, order), key, time, order, seconds).repartition(key, "piece").sortWithinPartitions(key, "piece", "at", order)
    kinds = dict(events.dtypes)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {time} {kinds[time]}, {order} {kinds[order]}, admitted boolean")


def admitted_stream(stream: DataFrame, key: str, order: str, seconds: int, limit: int, delay: str = "60 days") -> DataFrame:
    """The same as a stream with a column ts: state per key is the admitted times of the last `seconds`, `limit` at most.

    State goes when the watermark, `delay` behind the newest event, has passed its last admitted time by `seconds`: a key that stays away
    costs nothing. Events later than the watermark are dropped. Of a key, a micro-batch's times are put in order together, 16 bytes each; the source's limit on files bounds them.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(frames)).sort_values(["at", order])
        flags = []
        for at in pdf["at"]:
            while recent and recent[0] <= at - seconds * 1_000_000:
                recent.popleft()
            flags.append(len(recent) < limit)
            if flags[-1]:
                recent.append(int(at))
        state.update((list(recent),))
        state.setTimeoutTimestamp(max((recent[-1] if recent else int(at)) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], order: pdf[order], "admitted": flags})

    rows = stream.withWatermark("ts", delay).select(key, order, "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, admitted boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_metrics(stream: DataFrame, time: str, delay: str, length: str = "1 day") -> DataFrame:
    """Reviews, average rating and score of each product and window."""
    day: Column = F.window(time, length)
    g = stream.withWatermark(time, delay).groupBy("product_name", day).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("rating"), 6).alias("average_rating"), F.round(F.avg("sentiment_score"), 6).alias("average_score"))
    return g.select("product_name", F.col("window.start").cast("date").alias("date"), "total", "average_rating", "average_score")
