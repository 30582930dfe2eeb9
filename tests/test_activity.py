import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.operators import activity, catalog
from chronotext.session import new_dir
from chronotext.streaming import jobs

S = 1_000_000


@pytest.fixture(scope="module")
def requests(spark):
    """One client sends a third of everything, and many requests share a time."""
    rnd = random.Random(5)
    rows = [(i, "hot" if rnd.random() < 0.34 else f"c{rnd.randrange(9)}", rnd.randrange(0, 40_000) * S // 10)
            for i in range(3000)]
    return rows, spark.createDataFrame(rows, "seq int, client string, at_us bigint").repartition(5)


def buckets_by_hand(rows, rate, burst):
    out, state = {}, {}
    for seq, client, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if client not in state:
            state[client] = (burst - 1.0, at)
            out[seq] = (True, burst - 1)
            continue
        tokens, last = state[client]
        tokens = min(float(burst), tokens + (at - last) / 1e6 * rate)
        ok = tokens >= 1
        out[seq] = (ok, int(tokens - 1) if ok else int((1 - tokens) / rate) + 1)
        state[client] = (tokens - ok, at)
    return out


def windows_by_hand(rows, limit, width):
    out, seen = {}, {}
    for seq, client, at in sorted(rows, key=lambda r: (r[2], r[0])):
        times = seen[client] = [t for t in seen.get(client, []) if t > at - width]
        out[seq] = (len(times) < limit, limit - len(times) if len(times) < limit else 10)
        times.append(at)
    return out


def verdicts(df):
    return {r.seq: (r.allowed, r.remaining_or_retry) for r in df.collect()}


@pytest.mark.parametrize("per_minute,burst", [(30, 3), (6, 2), (60, 1), (30, 0)])
def test_token_bucket(requests, per_minute, burst):
    rows, df = requests
    got = activity.token_bucket(df, "client", "at_us", "seq", per_minute, burst, 60 * S)
    assert verdicts(got) == buckets_by_hand(rows, per_minute / 60, burst)


def test_third_call_is_blocked(spark):
    df = spark.createDataFrame([(i, "a", i) for i in range(3)], "seq int, client string, at_us bigint")
    got = verdicts(activity.token_bucket(df, "client", "at_us", "seq", 2, 2))
    assert [got[i][0] for i in range(3)] == [True, True, False]


@pytest.mark.parametrize("slice_us", [60 * S, 600 * S])
def test_sliding_limit(requests, slice_us):
    rows, df = requests
    got = activity.sliding_limit(df, "client", "at_us", "seq", 8, 60 * S, slice_us)
    assert verdicts(got) == windows_by_hand(rows, 8, 60 * S)


def test_sliding_limit_wants_long_slices(requests):
    with pytest.raises(ValueError):
        activity.sliding_limit(requests[1], "client", "at_us", "seq", 8, 60 * S, 30 * S)


def in_files(spark, rows, schema, n=4):
    """The rows as n files in time order, so that a stream sees them in n batches."""
    folder = new_dir(spark, "in")
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for i in range(n):
        part = ordered[i * len(ordered) // n:(i + 1) * len(ordered) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_streams_equal_batch(spark, requests):
    rows, _ = requests
    schema = "seq int, client string, at_us bigint"
    folder = in_files(spark, rows, schema)
    source = lambda: jobs.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    out = new_dir(spark, "b")
    jobs.append_log(jobs.token_bucket_stream(source(), "client", "at_us", "seq", 6, 2), out, new_dir(spark, "k"))
    assert verdicts(spark.read.parquet(out)) == buckets_by_hand(rows, 0.1, 2)
    out = new_dir(spark, "w")
    jobs.append_log(jobs.sliding_limit_stream(source(), "client", "at_us", "seq", 8, 60 * S), out, new_dir(spark, "k"))
    assert verdicts(spark.read.parquet(out)) == windows_by_hand(rows, 8, 60 * S)


def test_stream_goes_on_where_it_stopped(spark):
    folder, out, kept, ck = (new_dir(spark, x) for x in ("in", "out", "stats", "ck"))
    schema = "id int, ts timestamp, kind string"
    put = lambda rows: spark.createDataFrame(rows, "id int, ts string, kind string").withColumn(
        "ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
    src = lambda: jobs.file_stream(spark, folder, spark.read.parquet(folder).schema)
    put([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:05", "a"), (2, "2024-01-01 00:01:00", "b")])
    for _ in range(2):
        jobs.dedup_ids(src(), ["id"], "ts", "1 hour", out, ck)
        jobs.live_stats(src(), ["kind"], [F.count(F.lit(1)).alias("n")], kept, ck + "s")
        put([(2, "2024-01-01 00:02:00", "b"), (3, "2024-01-01 00:03:00", "c")])
    jobs.dedup_ids(src(), ["id"], "ts", "1 hour", out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert {r.kind: r.n for r in jobs.read_latest_batch(spark, kept).collect()} == {"a": 2, "b": 2, "c": 1}
    assert schema


def test_incremental_sync(spark):
    folder, out, status, ck = (new_dir(spark, x) for x in ("in", "out", "st", "ck"))
    put = lambda rows: spark.createDataFrame(rows, "video_id string, channel_id string, d string").select(
        "video_id", "channel_id", F.to_date("d").alias("upload_date")).coalesce(1).write.mode("append").parquet(folder)
    marks = spark.createDataFrame([("a", "2024-01-10 15:00:00")], "channel_id string, t string").select(
        "channel_id", F.to_timestamp("t").alias("last_synced_at"))
    process = lambda df: df.select(
        "video_id", "channel_id", F.lit("success").alias("status"),
        F.when(F.col("video_id") == "bad", "no audio").alias("error"))
    put([("old", "a", "2024-01-09"), ("same", "a", "2024-01-10"), ("new", "a", "2024-01-11"), ("x", "b", "2020-01-01")])
    run = lambda: jobs.incremental_sync(jobs.file_stream(spark, folder, spark.read.parquet(folder).schema), marks,
                                        process, out, status, ck)
    run()
    put([("bad", "b", "2024-01-01"), ("undated", "a", None)])
    run()
    assert sorted(r.video_id for r in spark.read.parquet(out).collect()) == ["bad", "new", "same", "undated", "x"]
    got = {(r.channel_id, r.run_id): (r.videos_found, r.videos_ingested, r.status) for r in spark.read.parquet(status).collect()}
    assert got == {("a", 0): (2, 2, "completed"), ("b", 0): (1, 1, "completed"), ("a", 1): (1, 1, "completed"),
                   ("b", 1): (0, 0, "failed")}
    done = spark.createDataFrame([("b", "2024-02-01 00:00:00")], "channel_id string, t string").select(
        "channel_id", F.to_timestamp("t").alias("last_sync_completed_at"))
    assert jobs.advance_marks(marks, done).count() == 2


def test_marks_move_and_the_next_run_takes_only_what_is_new(spark):
    folder, out, status, moved = (new_dir(spark, x) for x in ("in", "out", "st", "marks"))
    today = F.current_date()
    days = [("old", "a", F.date_sub(today, 30)), ("bad", "b", today)]
    put = lambda name, ch, day: spark.range(1).select(F.lit(name).alias("video_id"), F.lit(ch).alias(
        "channel_id"), day.alias("upload_date")).coalesce(1).write.mode("append").parquet(folder)
    for d in days:
        put(*d)
    marks = spark.createDataFrame([], "channel_id string, last_synced_at timestamp")
    process = lambda df: df.select("video_id", "channel_id", F.lit("success").alias("status"), F.when(
        F.col("video_id") == "bad", "no audio").alias("error"))
    jobs.incremental_sync(jobs.file_stream(spark, folder, spark.read.parquet(folder).schema), marks, process, out, status,
                          new_dir(spark, "ck"), moved)
    after = spark.read.parquet(moved)
    assert [r.channel_id for r in after.collect()] == ["a"]  # the failed channel keeps its place
    row = spark.read.parquet(status).where("channel_id = 'a'").first()
    assert row.last_sync_started_at <= row.last_sync_completed_at
    put("new", "a", F.date_add(today, 1))
    again = new_dir(spark, "out2")
    jobs.incremental_sync(jobs.file_stream(spark, folder, spark.read.parquet(folder).schema), after, process, again,
                          new_dir(spark, "st2"), new_dir(spark, "ck2"))
    assert sorted(r.video_id for r in spark.read.parquet(again).collect()) == ["bad", "new"]


def test_marks_judge_all_batches_and_newest_attempts(spark):
    marks = spark.createDataFrame([("a", "2024-01-01"), ("c", "2024-01-05")], "channel_id string, t string").select(
        "channel_id", F.to_timestamp("t").alias("last_synced_at"))
    status = spark.createDataFrame(
        [(b, c, f"2024-01-0{b + 2}") for b in range(3) for c in "abd"] + [(0, "c", "2024-01-02")],
        "batch_id int, channel_id string, t string").select("batch_id", "channel_id", F.to_timestamp("t").alias(
            "last_sync_started_at"), F.to_timestamp("t").alias("last_sync_completed_at"))
    results = spark.createDataFrame(
        [(0, "x", "a", "bad"), (1, "y", "a", None),                        # failed, then another video
         (0, "x", "b", "bad"), (2, "x", "b", None),                        # failed, then tried again
         (0, "v", "d", None), (0, "v", "c", "bad")],                       # c failed before its mark
        "batch_id int, video_id string, channel_id string, error string")
    got = {r.channel_id: r.last_synced_at.day for r in jobs.synced_marks(marks, results, status).collect()}
    assert got == {"a": 1, "b": 4, "c": 5, "d": 4}


def test_state_of_idle_clients_is_dropped():
    class State:
        def __init__(self, timed_out):
            self.hasTimedOut, self.removed, self.idle = timed_out, False, None

        def remove(self):
            self.removed = True

        def setTimeoutDuration(self, ms):
            self.idle = ms

    seen = []

    class Stream:
        schema = T.StructType([T.StructField("c", T.StringType())])

        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, fn, *rest):
            seen.append((fn, rest[-1]))

    jobs._stateful(Stream(), "c", lambda k, parts, state: iter(["verdicts"]), T.StructType(), 20_000)
    fn, kind = seen[0]
    assert kind == jobs.GroupStateTimeout.ProcessingTimeTimeout
    gone, live = State(True), State(False)
    assert list(fn(("a",), iter([]), gone)) == [] and gone.removed
    assert list(fn(("a",), iter([]), live)) == ["verdicts"] and live.idle == 20_000


def test_recent_history(spark):
    rows = [(c, 3 * t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in range(2) for t in range(40)]
    df = spark.createDataFrame(rows, "c int, turn int, role string, text string")
    got = {(r.c, r.turn): r.history for r in activity.recent_history(df, "c", "turn", 4, 8).collect()}
    line = lambda t: ("user" if t % 2 == 0 else "assistant") + f": m{t}"
    assert got == {(c, 3 * t): "\n".join(line(i) for i in range(max(0, t - 4), t)) for c in range(2) for t in range(0, 40, 2)}


def test_retry_queue(spark):
    log = [("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 1, True), ("c", 2, True), ("c", 3, True),
           ("d", 1, False), ("e", 1, True), ("e", 2, False), ("e", 3, True)]
    df = spark.createDataFrame(log, "item string, n int, bad boolean")
    got = {r.item: (r.attempts, r.status, r.backoff_sec) for r in activity.retry_queue(
        df, "item", F.col("bad"), [F.col("n")]).collect()}
    assert got == {"a": (2, "retry", 4.0), "b": (0, "recovered", None), "c": (3, "failed", None), "e": (1, "retry", 2.0)}


def test_empty_evaluation_groups(spark):
    df = spark.createDataFrame([(False, True, ["a"], 10), (False, False, [], 20)],
                               "should_refuse boolean, is_grounded boolean, channels array<string>, latency_ms int")
    r = catalog.eval_metrics(df, "a", "b").first()
    assert (r.overall_hit_rate, r.refusal_accuracy, r.false_positive_rate, r.false_negative_rate,
            r.channel_balance_ratio, r.average_latency_ms) == (0.5, 1.0, 0.0, 0.5, 1.0, 15.0)


def test_null_clients_and_items_are_kept(spark):
    rows = [(None, 0, 1), (None, 1_000_000, 2), ("a", 5, 3)]
    df = spark.createDataFrame(rows, "c string, at long, seq long")
    got = activity.token_bucket(df, "c", "at", "seq", per_minute=2, burst=1).collect()
    assert sorted((r["seq"], r["allowed"]) for r in got) == [(1, True), (2, False), (3, True)]
    log = spark.createDataFrame([(None, 1, True), (None, 2, True), ("x", 1, False)], "i string, t long, bad boolean")
    queue = activity.retry_queue(log, "i", F.col("bad"), [F.col("t")]).collect()
    assert [(r["i"], r["attempts"]) for r in queue] == [(None, 2)]
    turns = spark.createDataFrame([(None, 1, "user", "hi"), (None, 2, "user", "again")],
                                  "conv string, turn long, role string, text string")
    seen = activity.recent_history(turns, "conv", "turn").collect()
    assert sorted(r["history"] for r in seen) == ["", "user: hi"]
