"""Structured Streaming jobs. Each reads a file stream, runs to the end of what is there, and keeps its place.

Every job has a checkpoint folder; started again on the same folder it goes on where it stopped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotext.operators.activity import take_token
from chronotext.operators.catalog import sync_summary
from chronotext.sources import snapshots


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def _drain(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_log(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append telemetry or feedback rows to a parquet log; the sink's own log makes a replayed batch harmless."""
    _drain(stream.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)


def write_batch(out: str) -> Callable[[DataFrame, int], None]:
    """A sink that owns one folder per batch and overwrites it when the batch is replayed."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def upsert_stream(stream: DataFrame, keys: Sequence[str], version: Sequence[Column], table: str, checkpoint: str,
                  buckets: int = snapshots.BUCKETS) -> None:
    """Keep the newest row per key in a table of whole commits; a replayed batch changes nothing."""
    _drain(stream.writeStream.foreachBatch(snapshots.upsert_sink(table, keys, version, buckets)), checkpoint)


def dedup_ids(stream: DataFrame, ids: Sequence[str], ts: str, lateness: str, out: str, checkpoint: str) -> None:
    """Pass each id once; an id is forgotten once the watermark is ``lateness`` past it, which bounds the state."""
    once = stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(ids))
    _drain(once.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)


def live_stats(stream: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], out: str, checkpoint: str,
               interval: str | None = None) -> StreamingQuery | None:
    """Keep running totals per key. With ``interval`` (say "30 seconds") the job stays up and refreshes at that pace;
    the running query is returned.

    Every refresh is written whole to its own folder, so readers never see half of one.
    """
    totals = stream.groupBy(*keys).agg(*aggregates)
    writer = totals.writeStream.outputMode("complete").foreachBatch(write_batch(out))
    if interval is None:
        return _drain(writer, checkpoint)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def read_latest_batch(spark: SparkSession, out: str) -> DataFrame:
    """The last refresh written by ``live_stats``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(root)
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    newest = max(done, key=lambda p: int(p.getName().split("=")[1]))
    return spark.read.parquet(newest.toString())


Verdicts = Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]


def _stateful(stream: DataFrame, client: str, fn: Verdicts, state: T.StructType, idle_ms: int | None) -> DataFrame:
    """``idle_ms``: a client's state is dropped after so long without requests; None keeps it for ever."""
    def judge(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        yield from fn(key, parts, group)
        if idle_ms is not None:
            group.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = T.StructType([*stream.schema.fields, T.StructField("allowed", T.BooleanType()),
                        T.StructField("remaining_or_retry", T.LongType())])
    return stream.groupBy(client).applyInPandasWithState(judge, out, state, "append", timeout)


def _in_order(parts: Iterator[pd.DataFrame], at_us: str, seq: str) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values([at_us, seq], ignore_index=True)


def token_bucket_stream(stream: DataFrame, client: str, at_us: str, seq: str, per_minute: float = 30,
                        burst: int = 10, idle_ms: int | None = None) -> DataFrame:
    """Token-bucket verdicts with the bucket as state. A request older than the state adds no tokens.

    For a live stream ``idle_ms`` of burst / rate or more bounds the state without changing a verdict: a bucket that
    was left alone so long is full, as that of an unseen client is. A replay runs faster than its clock; leave it out.
    """
    rate = per_minute / 60.0
    columns = stream.columns

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _in_order(parts, at_us, seq)
        bucket = tuple(state.get) if state.exists else None
        ok, left = [], []
        for at in pdf[at_us].to_numpy():
            tokens, allowed, rest = take_token(bucket, int(at), rate, burst)
            bucket = (tokens, max(int(at), bucket[1]) if bucket else int(at))
            ok.append(allowed)
            left.append(rest)
        state.update(bucket)
        yield pdf[columns].assign(allowed=ok, remaining_or_retry=left)

    return _stateful(stream, client, judge, T.StructType([
        T.StructField("tokens", T.DoubleType()), T.StructField("at", T.LongType())]), idle_ms)


def sliding_limit_stream(stream: DataFrame, client: str, at_us: str, seq: str, max_requests: int = 30,
                         window_us: int = 60_000_000, retry_sec: int = 10, idle_ms: int | None = None) -> DataFrame:
    """Sliding-log verdicts; the state is the newest ``max_requests`` request times of the client's last window.

    Older ones can't change a verdict. ``idle_ms`` of the window or more also drops silent clients of a live stream.
    """
    columns = stream.columns

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _in_order(parts, at_us, seq)
        recent = list(state.get[0]) if state.exists else []
        ok, left = [], []
        first = 0
        for at in pdf[at_us].to_numpy():
            at = int(at)
            while first < len(recent) and recent[first] <= at - window_us:
                first += 1
            prior = len(recent) - first
            ok.append(prior < max_requests)
            left.append(max_requests - prior if prior < max_requests else retry_sec)
            recent.append(at)
        state.update((recent[max(first, len(recent) - max_requests):],))
        yield pdf[columns].assign(allowed=ok, remaining_or_retry=left)

    return _stateful(stream, client, judge, T.StructType([T.StructField("times", T.ArrayType(T.LongType()))]), idle_ms)


def incremental_sync(stream: DataFrame, marks: DataFrame, process: Callable[[DataFrame], DataFrame], out: str,
                     status_out: str, checkpoint: str, marks_out: str | None = None) -> None:
    """Ingest what is new per channel.

    ``stream``: video_id, channel_id, upload_date. ``marks``: channel_id, last_synced_at. Rows from before the day of
    the last sync are skipped; the rest go through ``process``, which returns video_id, channel_id, status, error.
    Each batch writes its results and its sync_status rows, with the times it began and ended, to folders of its own.
    When all is read, the marks of the channels that have no video whose newest attempt failed move to the end of their
    last batch and are written to ``marks_out``, for the next run. All batches since a channel's mark are judged, those
    of a run that ended before it wrote its marks included. Marks stand still during a run, whose batches belong
    together.
    """
    def handle(df: DataFrame, batch_id: int) -> None:
        began = dt.datetime.now(dt.timezone.utc)
        write_batch(out)(process(new_since(df, marks)), batch_id)
        results = df.sparkSession.read.parquet(f"{out}/batch_id={batch_id}").withColumn("run_id", F.lit(batch_id))
        write_batch(status_out)(sync_summary(results).withColumns({
            "last_sync_started_at": F.lit(began), "last_sync_completed_at": F.lit(dt.datetime.now(dt.timezone.utc))}),
            batch_id)

    _drain(stream.writeStream.foreachBatch(handle), checkpoint)
    if marks_out:
        spark = stream.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status_out)
        any_batch = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        moved = synced_marks(marks, spark.read.parquet(out), spark.read.parquet(status_out)) if any_batch else marks
        moved.write.mode("overwrite").parquet(marks_out)


def synced_marks(marks: DataFrame, results: DataFrame, status: DataFrame) -> DataFrame:
    """Marks after the batches that began at or after each channel's mark.

    ``results``: batch_id, video_id, channel_id, error. ``status``: batch_id, channel_id and the times of the batch. A
    channel with a video whose newest attempt failed keeps its mark, whatever its other batches did.
    """
    since = status.join(marks, "channel_id", "left").where(
        F.col("last_synced_at").isNull() | (F.col("last_sync_started_at") >= F.col("last_synced_at"))).select(
        "channel_id", "batch_id", "last_sync_completed_at")
    tries = results.select("channel_id", "batch_id", "video_id", F.col("error").isNotNull().alias("failed")).join(
        since.select("channel_id", "batch_id"), ["channel_id", "batch_id"], "left_semi")
    newest = tries.groupBy("channel_id", "video_id").agg(F.max_by("failed", F.struct("batch_id", "failed")).alias("failed"))
    return advance_marks(marks, since.join(newest.where("failed").select("channel_id"), "channel_id", "left_anti"))


def new_since(found: DataFrame, marks: DataFrame) -> DataFrame:
    """The batch form of the same rule."""
    return found.join(marks, "channel_id", "left").where(
        F.col("last_synced_at").isNull() | F.col("upload_date").isNull()
        | (F.col("upload_date") >= F.to_date("last_synced_at"))).drop("last_synced_at")


def advance_marks(marks: DataFrame, done: DataFrame) -> DataFrame:
    """Channel marks after a run: the completion time of the newest sync, else the old mark."""
    newest = done.groupBy("channel_id").agg(F.max("last_sync_completed_at").alias("_at"))
    return marks.join(newest, "channel_id", "full").select(
        "channel_id", F.greatest("last_synced_at", "_at").alias("last_synced_at"))
