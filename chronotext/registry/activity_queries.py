"""Catalog statistics, relational upkeep, sequences and streams on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.operators import activity, catalog
from chronotext.registry.base import Registry, table
from chronotext.session import cut_lineage, new_dir
from chronotext.sources import feeds, snapshots, tables
from chronotext.sources.tables import null_safe
from chronotext.streaming import jobs

R = Registry()


# ---- relational upkeep

@R.add("skip_existing", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def skip_existing(spark, sf):
    stored = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.skip_existing(table(spark, sf, "orders").select("o_orderkey"), stored, "o_orderkey")


@R.add("new_ids", """
select distinct l_partkey from lineitem except select p_partkey from part where p_type = 'ECONOMY'""")
def new_ids(spark, sf):
    stored = table(spark, sf, "part").where("p_type = 'ECONOMY'").select("p_partkey")
    return table(spark, sf, "lineitem").select("l_partkey").subtract(stored)


@R.add("ensure_parents", """
select s_suppkey, s_name, s_nationkey from supplier
union all select distinct user_id, 'stub ' || user_id, null from events
where user_id not in (select s_suppkey from supplier)""")
def ensure_parents(spark, sf):
    parents = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    children = table(spark, sf, "events").select(F.col("user_id").alias("s_suppkey"))
    return tables.ensure_parents(children, parents, "s_suppkey", {
        "s_name": F.concat(F.lit("stub "), F.col("s_suppkey"))})


@R.add("latest_wins", """
select user_id, event_type, event_id, value from events
qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def latest_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return tables.latest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@R.add("merge_feeds", """
select key % 5000 as key, min(feed) as feed, arg_min(o_orderdate, (feed, o_orderdate, key)) as o_orderdate,
  arg_min(key, (feed, o_orderdate, key)) as first_key from (
  select *, o_orderkey as key, 0 as feed from orders where o_orderpriority = '2-HIGH'
  union all select *, o_orderkey, 1 from orders where o_orderstatus = 'F'
  union all select *, o_orderkey, 2 from orders) group by 1""")
def merge_feeds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    parts = [o.where("o_orderpriority = '2-HIGH'"), o.where("o_orderstatus = 'F'"), o]
    # ids repeat within a feed as well as across feeds
    merged = feeds.merge_feeds([p.select((F.col("o_orderkey") % 5000).alias("key"), "o_orderdate", F.col(
        "o_orderkey").alias("first_key")) for p in parts], "key", [F.col("o_orderdate"), F.col("first_key")])
    return merged.select("key", "feed", "o_orderdate", "first_key")


def _undated():
    """Order dates, unknown for one order in 17."""
    return F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("o_orderdate")


@R.add("paged_scan", """
with o as (select o_orderkey, case when o_orderkey % 17 <> 0 then o_orderdate end as d from orders),
p as (select o_orderkey, row_number() over (order by d nulls first, o_orderkey) as position from o)
select (position - 1) // 100 + 1 as page, count(*) as n, arg_min(o_orderkey, position) as first_id,
       arg_max(o_orderkey, position) as last_id from p group by 1""")
def paged_scan(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _undated())
    paged = feeds.pages_of(o, [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderdate"), 100)
    return paged.groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("o_orderkey", "position").alias("first_id"),
        F.max_by("o_orderkey", "position").alias("last_id"))


@R.add("latest_videos", """
select o_orderkey, substr('Order ' || o_orderkey || ' ' || o_orderpriority, 1, 60) as title, o_orderdate
from orders order by o_orderdate desc, o_orderkey limit 10""")
def latest_videos(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(
        " ", F.lit("Order"), "o_orderkey", "o_orderpriority").alias("title"), "o_orderdate")
    return catalog.latest_videos(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")])


@R.add("round_robin", """
with o as (select o_orderkey, case when o_orderkey % 17 <> 0 then o_orderdate end as d,
             case when o_orderkey % 23 <> 0 then o_orderpriority end as p from orders),
r as (select o_orderkey, coalesce(cast(p[1] as integer), 99) as channel_rank,
             row_number() over (partition by p order by d nulls first, o_orderkey) as channel_position
           from o)
select o_orderkey, channel_position, (channel_position - 1) // 10 + 1 as round,
  row_number() over (order by (channel_position - 1) // 10, channel_rank, channel_position) as position from r""")
def round_robin(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _undated(), F.when(
        F.col("o_orderkey") % 23 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    out = feeds.round_robin(o, "o_orderpriority", F.coalesce(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(99)),
                            [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderdate"))
    return out.select("o_orderkey", "channel_position", "round", "position")


# ---- statistics

@R.add("catalog_stats", """
with c as (select l_orderkey as video_id, count(*) as n, count(*) filter (where l_returnflag <> 'R') as active
           from lineitem group by 1)
select coalesce(o_orderpriority, 'ALL') as channel_id, count(*) as total_videos,
  count(*) filter (where o_orderstatus <> 'P') as canonical_videos,
  count(*) filter (where o_orderstatus = 'P') as duplicate_videos,
  cast(coalesce(sum(n), 0) as bigint) as total_chunks, cast(coalesce(sum(active), 0) as bigint) as active_chunks,
  count(n) as videos_with_chunks
from orders left join c on video_id = o_orderkey group by rollup (o_orderpriority)""")
def catalog_stats(spark, sf):
    v = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("channel_id"),
        (F.col("o_orderstatus") == "P").alias("is_duplicate"))
    c = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), (F.col("l_returnflag") == "R").alias("is_duplicate"))
    return catalog.catalog_stats(v, c)


@R.add("count_chunks", """
select l_returnflag as channel_id, count(*) as n_chunks from lineitem group by 1
union all select 'ALL', count(*) from lineitem union all select 'A only', count(*) from lineitem where l_returnflag = 'A'""")
def count_chunks(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel_id"))
    tag = lambda df, name: df.select(F.lit(name).alias("channel_id"), "n_chunks")
    return catalog.count_chunks_by_channel(c).unionByName(tag(catalog.count_chunks(c), "ALL")).unionByName(
        tag(catalog.count_chunks(c, "A"), "A only"))


@R.add("usage_stats", """
with e as (select *, case when event_id % 13 <> 0 then event_type end as llm_provider from events),
q as (select cast(ts as date) as day, llm_provider, count(*) as total_queries,
     round(avg(cast(value < 30 as int)), 6) as answered_share,
     round(avg(cast(floor(value * 100) as integer)), 6) as average_latency_ms,
     max(cast(floor(value * 100) as integer)) as max_latency_ms from e group by all),
f as (select cast(ts as date) as day, llm_provider, count(*) as total_feedback,
     count(*) filter (where cast(json_extract_string(props, '$.k') as integer) % 2 = 0) as flagged_feedback
     from e where event_type in ('error', 'click') group by all)
select q.day, q.llm_provider, total_queries, answered_share, average_latency_ms, max_latency_ms,
  coalesce(total_feedback, 0) as total_feedback, coalesce(flagged_feedback, 0) as flagged_feedback
from q left join f on q.day = f.day and q.llm_provider is not distinct from f.llm_provider""")
def usage_stats(spark, sf):
    e = table(spark, sf, "events").select(
        F.to_date("ts").alias("day"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("llm_provider"),
        F.col("event_type"), (F.col("value") < 30).alias("answered"),
        F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("flagged"))
    return catalog.usage_stats(e, e.where("event_type in ('error', 'click')"))


@R.add("usage_percentiles", """
with e as (select case when event_id % 13 <> 0 then event_type end as llm_provider, cast(ts as date) as day from events),
d as (select min(day) + 1 as lo, max(day) - 1 as hi from e)
select llm_provider, count(*) as n, true as p50_ok, true as p90_ok, true as p99_ok
from e, d where day between lo and hi group by llm_provider""")
def usage_percentiles(spark, sf):
    """From stored sketches of days; each percentile's exact rank in the logs is within 1 % of the rows."""
    logs = table(spark, sf, "events").select(
        F.to_date("ts").alias("day"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("llm_provider"),
        F.floor(F.col("value") * 100).cast("int").alias("latency_ms"))
    span = logs.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(
        F.date_add("lo", 1), F.date_sub("hi", 1)).first()
    days = F.lit(span[0]), F.lit(span[1])
    stored = cut_lineage(catalog.latency_sketches(logs), "sketches")
    found = catalog.usage_percentiles(stored, *days)
    at = lambda p, op: F.count_if(F.col("latency_ms") <= F.col(p) if op == "le" else F.col("latency_ms") < F.col(p))
    ranked = null_safe(logs.where(F.col("day").between(*days)), found, ["llm_provider"]).groupBy("llm_provider").agg(
        F.first("n").alias("n"), *[at(p, op).alias(f"{p}_{op}") for p in ("p50", "p90", "p99") for op in ("lt", "le")])
    ok = lambda p, r: ((F.col(f"{p}_lt") <= (r + 0.01) * F.col("n")) & (F.col(f"{p}_le") >= (r - 0.01) * F.col("n")))
    return ranked.select("llm_provider", "n", *[
        ok(p, r).alias(f"{p}_ok") for p, r in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


_SYNC = """select event_type as channel_id, cast(ts as date) as run_id,
  case when value < 15 then 'success' when value < 30 then 'duplicate_video' else 'no_transcript' end as status,
  case when value > 100 then 'too large: ' || event_id end as error from events"""


def _results(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("channel_id"), F.to_date("ts").alias("run_id"),
        F.when(v < 15, "success").when(v < 30, "duplicate_video").otherwise("no_transcript").alias("status"),
        F.when(v > 100, F.concat(F.lit("too large: "), F.col("event_id"))).alias("error"))


@R.add("sync_summary", f"""with r as ({_SYNC}),
g as (select channel_id, run_id, count(error) > 0 as failed, count(*) as n,
        count(*) filter (where status in ('success', 'duplicate_video')) as ok, min(error) as error_message
      from r group by all)
select channel_id, run_id, case when failed then 0 else n end as videos_found,
  case when failed then 0 else ok end as videos_ingested,
  case when failed then 'failed' else 'completed' end as status, error_message from g""")
def sync_summary(spark, sf):
    return catalog.sync_summary(_results(spark, sf))


# ---- sequences

WINDOW_US, MAX_REQUESTS = 86_400_000_000, 3


def _requests(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", activity.micros(F.col("ts")).alias("at_us"))


_PRIOR = f"""
p as (select event_id, user_id, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1
  - count(*) over (partition by user_id order by epoch_us(ts) range between unbounded preceding and {WINDOW_US} preceding)
  as prior from events)"""
_LIMIT_SQL = f"""with {_PRIOR}
select event_id, prior < {MAX_REQUESTS} as allowed,
  case when prior < {MAX_REQUESTS} then {MAX_REQUESTS} - prior else 10 end as remaining_or_retry from p"""


@R.add("sliding_rate_limit", _LIMIT_SQL)
def sliding_rate_limit(spark, sf):
    out = activity.sliding_limit(_requests(spark, sf), "user_id", "at_us", "event_id", MAX_REQUESTS, WINDOW_US,
                                 2 * WINDOW_US)
    return out.select("event_id", "allowed", F.col("remaining_or_retry").cast("bigint").alias("remaining_or_retry"))


PER_MINUTE, BURST = 1 / 360, 2
_BUCKET_SQL = f"""
with recursive r as (select event_id, user_id, epoch_us(ts) as at_us,
    row_number() over (partition by user_id order by epoch_us(ts), event_id) as rn from events),
b as (
  select event_id, user_id, rn, at_us, {BURST} - 1.0::double as tokens, true as allowed, {BURST - 1}::bigint as rest
  from r where rn = 1
  union all
  select event_id, user_id, rn, at_us, case when t >= 1 then t - 1 else t end, t >= 1,
    case when t >= 1 then cast(floor(t - 1) as bigint) else cast(floor((1 - t) / ({PER_MINUTE!r}::double / 60)) as bigint) + 1 end
  from (select r.event_id, r.user_id, r.rn, r.at_us,
          least({BURST}::double, b.tokens + greatest(0, r.at_us - b.at_us) / 1e6 * ({PER_MINUTE!r}::double / 60)) as t
        from b join r on r.user_id = b.user_id and r.rn = b.rn + 1))
select event_id, allowed, rest as remaining_or_retry from b"""


@R.add("token_bucket", _BUCKET_SQL)
def token_bucket(spark, sf):
    return activity.token_bucket(_requests(spark, sf), "user_id", "at_us", "event_id", PER_MINUTE, BURST).select(
        "event_id", "allowed", "remaining_or_retry")


_ANY_CLIENT_SQL = _BUCKET_SQL.replace(
    "from events)", "from (select event_id, ts, case when user_id % 50 <> 0 then user_id + 9007199254740992 end as user_id"
    " from events))").replace("r.user_id = b.user_id", "r.user_id is not distinct from b.user_id")


@R.add("token_bucket_any_client", _ANY_CLIENT_SQL)
def token_bucket_any_client(spark, sf):
    """Requests without a client id, and ids beyond the integers that a double holds."""
    wide = F.when(F.col("user_id") % 50 != 0, F.col("user_id") + F.lit(1 << 53))
    return activity.token_bucket(_requests(spark, sf).withColumn("user_id", wide), "user_id", "at_us", "event_id",
                                 PER_MINUTE, BURST).select("event_id", "allowed", "remaining_or_retry")


@R.add("retry_queue", """
with e as (select user_id, row_number() over (order by ts, event_id) as place, event_type = 'error' as failed from events),
s as (select user_id, max(place) filter (where not failed) as ok, count(*) filter (where failed) as failures,
        arg_max(failed, place) as last_failed from e group by user_id),
n as (select e.user_id, count(*) filter (where failed and (ok is null or place > ok)) as attempts,
        any_value(failures) as failures, any_value(last_failed) as last_failed from e join s using (user_id) group by 1)
select user_id, failures, attempts,
  case when not last_failed then 'recovered' when attempts >= 3 then 'failed' else 'retry' end as status,
  case when last_failed and attempts < 3 then 2.0 * pow(2.0, attempts - 1) end as backoff_sec
from n where failures > 0""")
def retry_queue(spark, sf):
    e = table(spark, sf, "events")
    return activity.retry_queue(e, "user_id", F.col("event_type") == "error", [F.col("ts"), F.col("event_id")])


@R.add("recent_history", """
with h as (select conv_id, turn, role, string_agg(role || ': ' || text, E'\\n') over (
    partition by conv_id order by turn rows between 4 preceding and 1 preceding) as history from conversations)
select conv_id, turn, coalesce(history, '') as history from h where role = 'user'""")
def recent_history(spark, sf):
    return activity.recent_history(table(spark, sf, "conversations"), "conv_id", "turn").select(
        "conv_id", "turn", "history")


# ---- streams: each runs to the end of the table and must equal its batch form

def _stream(spark, sf, name="events"):
    return jobs.file_stream(spark, sf, table(spark, sf, name).schema, f"{name}.parquet")


@R.add("incremental_sync", """
with m as (select event_type as channel_id, cast(min(ts) as date) + 10 as mark from events where event_type <> 'view' group by 1),
n as (select e.*, event_type as channel_id from events e left join m on m.channel_id = event_type
      where mark is null or cast(ts as date) >= mark)
select channel_id, count(*) as videos_found, count(*) filter (where value < 30) as videos_ingested,
  'completed' as status from n group by 1""")
def incremental_sync(spark, sf):
    e = table(spark, sf, "events")
    marks = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("channel_id")).agg(
        F.date_add(F.to_date(F.min("ts")), 10).cast("timestamp").alias("last_synced_at"))
    found = _stream(spark, sf).select(
        F.col("event_id").alias("video_id"), F.col("event_type").alias("channel_id"),
        F.to_date("ts").alias("upload_date"), "value")
    status = F.when(F.col("value") < 30, "success").otherwise("no_transcript")
    process = lambda df: df.select("video_id", "channel_id", status.alias("status"),
                                   F.lit(None).cast("string").alias("error"))
    out, status_out = new_dir(spark, "synced"), new_dir(spark, "status")
    jobs.incremental_sync(found, marks, process, out, status_out, new_dir(spark, "ckpt"))
    done = spark.read.parquet(status_out)
    return done.groupBy("channel_id").agg(
        F.sum("videos_found").alias("videos_found"), F.sum("videos_ingested").alias("videos_ingested"),
        F.max("status").alias("status"))


def _in_files(spark, sf, n=4):
    """Events dealt to ``n`` files, which a stream reads one a batch."""
    folder = new_dir(spark, "events")
    e = table(spark, sf, "events")
    e.repartition(n, F.pmod("event_id", F.lit(n))).sortWithinPartitions("event_id").write.parquet(folder)
    return jobs.file_stream(spark, folder, e.schema, files_per_batch=1)


@R.add("incremental_sync_marks", """
select event_type as channel_id, count(*) filter (where event_type in ('error', 'click') and event_id % 100 = 7) = 0 as moved
from events group by 1""")
def incremental_sync_marks(spark, sf):
    """Channels whose marks move: one that failed in any batch keeps its place, though others of its batches are fine."""
    e = table(spark, sf, "events")
    marks = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("channel_id")).agg(
        F.min("ts").cast("timestamp").alias("last_synced_at"))
    found = _in_files(spark, sf).select(F.col("event_id").alias("video_id"), F.col("event_type").alias("channel_id"),
                                        F.to_date("ts").alias("upload_date"))
    bad = F.col("channel_id").isin("error", "click") & (F.col("video_id") % 100 == 7)
    process = lambda df: df.select("video_id", "channel_id", F.lit("success").alias("status"),
                                   F.when(bad, "no audio").alias("error"))
    marks_out = new_dir(spark, "marks")
    jobs.incremental_sync(found, marks, process, new_dir(spark, "synced"), new_dir(spark, "status"),
                          new_dir(spark, "ckpt"), marks_out)
    before = marks.select("channel_id", F.col("last_synced_at").alias("was"))
    after = e.select(F.col("event_type").alias("channel_id")).distinct().join(
        spark.read.parquet(marks_out), "channel_id", "left").join(before, "channel_id", "left")
    return after.select("channel_id", (F.col("last_synced_at").isNotNull() & ~F.col("last_synced_at").eqNullSafe(
        F.col("was"))).alias("moved"))


@R.add("upsert_stream", """
select case when user_id % 50 <> 0 then user_id end as user_id, event_type, event_id, value from events
qualify row_number() over (partition by case when user_id % 50 <> 0 then user_id end, event_type
                           order by ts desc, event_id desc) = 1""")
def upsert_stream(spark, sf):
    """The newest event per user and type, one batch a file; then the first batch comes once more."""
    stream = _in_files(spark, sf).select(
        F.when(F.col("user_id") % 50 != 0, F.col("user_id")).alias("user_id"), "event_type", "event_id", "value", "ts")
    kept, newest = new_dir(spark, "kept"), [F.col("ts"), F.col("event_id")]
    jobs.upsert_stream(stream, ["user_id", "event_type"], newest, kept, new_dir(spark, "ckpt"), 16)
    again = spark.createDataFrame([], stream.schema).unionByName(table(spark, sf, "events").select(
        "user_id", "event_type", "event_id", (F.col("value") + 1).alias("value"), (F.col("ts") + F.expr(
            "interval 1 day")).alias("ts")))
    snapshots.upsert_sink(kept, ["user_id", "event_type"], newest)(again, 0)
    return snapshots.read_snapshot(spark, kept, stream.schema).drop("ts")


@R.add("stream_dedup", "select distinct user_id, event_type from events")
def stream_dedup(spark, sf):
    out = new_dir(spark, "once")
    # one lateness for the whole table, so that an id is never forgotten here
    jobs.dedup_ids(_stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "at",
                   "3650 days", out, new_dir(spark, "ckpt"))
    return spark.read.parquet(out).select("user_id", "event_type")


def _request_stream(spark, sf):
    return _stream(spark, sf).select("event_id", "user_id", activity.micros(F.col("ts")).alias("at_us"))


@R.add("token_bucket_stream", _BUCKET_SQL)
def token_bucket_stream(spark, sf):
    out = new_dir(spark, "bucket")
    judged = jobs.token_bucket_stream(_request_stream(spark, sf), "user_id", "at_us", "event_id", PER_MINUTE, BURST)
    jobs.append_log(judged, out, new_dir(spark, "ckpt"))
    return spark.read.parquet(out).select("event_id", "allowed", "remaining_or_retry")


@R.add("sliding_log_stream", _LIMIT_SQL)
def sliding_log_stream(spark, sf):
    out = new_dir(spark, "limit")
    judged = jobs.sliding_limit_stream(_request_stream(spark, sf), "user_id", "at_us", "event_id", MAX_REQUESTS,
                                       WINDOW_US)
    jobs.append_log(judged, out, new_dir(spark, "ckpt"))
    return spark.read.parquet(out).select("event_id", "allowed", "remaining_or_retry")


@R.add("log_sink", "select event_id, user_id, event_type, value from events")
def log_sink(spark, sf):
    out = new_dir(spark, "log")
    jobs.append_log(_stream(spark, sf).select("event_id", "user_id", "event_type", "value"), out,
                    new_dir(spark, "ckpt"))
    return spark.read.parquet(out)


@R.add("live_stats", "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def live_stats(spark, sf):
    out = new_dir(spark, "stats")
    jobs.live_stats(_stream(spark, sf), ["event_type"], [
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")], out, new_dir(spark, "ckpt"))
    return jobs.read_latest_batch(spark, out)
