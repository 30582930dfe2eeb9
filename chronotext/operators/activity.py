"""Per-client and per-conversation sequences: rate limits, retries and recent history.

A client or conversation may hold a large share of all rows, so no window here spans a whole key: rows are cut into
slices of time or position, and each slice also gets the few preceding rows that its first rows look back on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.sources.tables import null_safe, numbered


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the session time zone must be UTC for a zone-less timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def time_slices(events: DataFrame, at: str, slice_us: int, look_back_us: int) -> DataFrame:
    """Assign rows to time slices; rows within ``look_back_us`` of a slice's end also open the next one (not own)."""
    if look_back_us > slice_us:
        raise ValueError("a slice must be at least as long as the look-back")
    home = F.floor(F.col(at) / slice_us)
    spills = F.col(at) - home * slice_us >= slice_us - look_back_us
    copies = F.when(spills, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.withColumn("_copy", F.explode(copies)).withColumn("_slice", home + F.col("_copy")).withColumn(
        "_own", F.col("_copy") == 0).drop("_copy")


def sliding_limit(events: DataFrame, client: str, at_us: str, seq: str, max_requests: int = 30,
                  window_us: int = 60_000_000, slice_us: int | None = None, retry_sec: int = 10) -> DataFrame:
    """Requests of the client in the ``window_us`` before each one; rejected requests count as well.

    Adds prior, allowed and remaining_or_retry.
    """
    slice_us = slice_us or 60 * window_us
    cut = time_slices(events, at_us, slice_us, window_us)
    part = Window.partitionBy(client, "_slice")
    place = F.row_number().over(part.orderBy(at_us, seq))
    expired = F.count(F.lit(1)).over(
        part.orderBy(at_us).rangeBetween(Window.unboundedPreceding, -window_us))
    counted = cut.withColumn("prior", place - 1 - expired).where("_own").drop("_own", "_slice")
    allowed = F.col("prior") < max_requests
    return counted.withColumn("allowed", allowed).withColumn(
        "remaining_or_retry", F.when(allowed, F.lit(max_requests) - F.col("prior")).otherwise(F.lit(retry_sec)))


def take_token(state: tuple[float, int] | None, at_us: int, rate: float, burst: int) -> tuple[float, bool, int]:
    """New token count, whether the request passes, and what is left or how many seconds to wait."""
    if state is None:
        return burst - 1.0, True, int(burst - 1)
    tokens, last = state
    tokens = min(float(burst), tokens + max(0, at_us - last) / 1e6 * rate)
    if tokens >= 1.0:
        return tokens - 1.0, True, int(tokens - 1.0)
    return tokens, False, int((1.0 - tokens) / rate) + 1


def quiet_runs(events: DataFrame, client: str, at_us: str, seq: str, gap_us: int, slice_us: int) -> DataFrame:
    """Add ``run``: the time of the last request that came at least ``gap_us`` after the one before it."""
    cut = time_slices(events, at_us, slice_us, gap_us)
    in_slice = Window.partitionBy(client, "_slice").orderBy(at_us, seq)
    before = F.lag(at_us).over(in_slice)
    starts = F.when(before.isNull() | (F.col(at_us) - before >= gap_us), F.col(at_us))
    own = cut.withColumn("_start", starts).where("_own")
    own = own.withColumn("_local", F.last("_start", ignorenulls=True).over(
        in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per client and slice: where its last run began
    ends = own.groupBy(client, "_slice").agg(F.max("_start").alias("_s"))
    earlier = Window.partitionBy(client).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(client, "_slice", F.last("_s", ignorenulls=True).over(earlier).alias("_carried"))
    return null_safe(own, ends, [client, "_slice"]).withColumn(
        "run", F.coalesce("_local", "_carried")).drop("_own", "_slice", "_start", "_local", "_carried")


def token_bucket(events: DataFrame, client: str, at_us: str, seq: str, per_minute: float = 30, burst: int = 10,
                 slice_us: int | None = None) -> DataFrame:
    """Token-bucket verdict for every request, in time order per client.

    After a quiet time of burst / rate the bucket is full again whatever came before, so a client's log is cut
    there and the runs are independent. A task streams through its sorted runs and keeps one number per run.
    Adds allowed and remaining_or_retry. Clients may be of any type; all rows with a null client share one bucket.
    """
    rate = per_minute / 60.0
    cols = events.columns
    if burst >= 1:
        gap_us = int(burst / rate * 1e6) + 2
        runs = quiet_runs(events, client, at_us, seq, gap_us, slice_us or max(24 * gap_us, 3_600_000_000))
    else:
        runs = events.withColumn("run", F.lit(0).cast("bigint"))
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType()),
                           T.StructField("remaining_or_retry", T.LongType())])
    where_client, where_at, names = cols.index(client), cols.index(at_us), schema.names

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = (), None  # no client yet; a null client is one as well
        for batch in batches:
            ok, left = [], []
            *given, runs = batch.columns
            clients, times = given[where_client].to_pylist(), given[where_at].to_pylist()
            for c, run, at in zip(clients, runs.to_pylist(), times, strict=True):
                if (c, run) != key:
                    key, state = (c, run), None
                tokens, allowed, rest = take_token(state, at, rate, burst)
                state = (tokens, at)
                ok.append(allowed)
                left.append(rest)
            yield pa.RecordBatch.from_arrays([*given, pa.array(ok, pa.bool_()), pa.array(left, pa.int64())], names=names)

    return (
        runs.select(*cols, "run").repartition(client, "run").sortWithinPartitions(client, "run", at_us, seq)
        .mapInArrow(stream, schema)
    )


def retry_queue(log: DataFrame, item: str, failed: Column, order: Sequence[Column], max_retries: int = 3,
                base_sec: float = 2.0) -> DataFrame:
    """Per failed item: attempts so far, next back-off, and whether it recovered or failed for good.

    Only failures since the last success count. Two plain aggregates, both combined before the shuffle.
    """
    marked = log.select(item, F.struct(*order).alias("_at"), failed.alias("_failed"))
    last_ok = marked.groupBy(item).agg(
        F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_ok"), F.count_if("_failed").alias("failures"),
        F.max_by("_failed", "_at").alias("_last_failed"))
    since = null_safe(marked, last_ok, [item]).groupBy(item).agg(
        F.count_if(F.col("_failed") & (F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))).alias("attempts"),
        F.first("failures").alias("failures"), F.first("_last_failed").alias("_last_failed"))
    status = (
        F.when(~F.col("_last_failed"), "recovered")
        .when(F.col("attempts") >= max_retries, "failed")
        .otherwise("retry")
    )
    return since.where(F.col("failures") > 0).select(
        item, "failures", "attempts", status.alias("status"),
        F.when(status == "retry", base_sec * F.pow(F.lit(2.0), F.col("attempts") - 1)).alias("backoff_sec"))


def recent_history(messages: DataFrame, conversation: str, turn: str, n: int = 4, block: int = 1024) -> DataFrame:
    """For each user message, the up to ``n`` messages before it as ``role: text`` lines."""
    placed = numbered(messages, [F.col(turn)], F.floor(F.col(turn) / block), [conversation], "_rn")
    home = F.floor((F.col("_rn") - 1) / block)
    spills = (F.col("_rn") - 1) % block >= block - n
    cut = placed.withColumn("_copy", F.explode(
        F.when(spills, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn(
        "_block", home + F.col("_copy"))
    w = Window.partitionBy(conversation, "_block").orderBy("_rn").rowsBetween(-n, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return cut.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n")).where(
        (F.col("_copy") == 0) & (F.col("role") == "user")).drop("_copy", "_block", "_rn")
