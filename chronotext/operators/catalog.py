"""Catalog, evaluation and usage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalog_stats(videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per channel and in total: videos, canonical and duplicate videos, chunks and active chunks.

    ``videos``: video_id, channel_id, is_duplicate. ``chunks``: video_id, is_duplicate. Chunks are first reduced to
    one row per video, so the join moves videos and not chunks.
    """
    per_video = chunks.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_chunks"), F.count_if(~F.col("is_duplicate")).alias("_active"))
    joined = videos.join(per_video, "video_id", "left")
    stats = joined.rollup("channel_id").agg(
        F.grouping("channel_id").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("total_videos"),
        F.count_if(~F.col("is_duplicate")).alias("canonical_videos"),
        F.count_if(F.col("is_duplicate")).alias("duplicate_videos"),
        F.coalesce(F.sum("_chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("_active"), F.lit(0)).alias("active_chunks"),
        F.count("_chunks").alias("videos_with_chunks"))
    return stats.withColumn("channel_id", F.when(F.col("is_total") == 1, "ALL").otherwise(F.col("channel_id"))).drop(
        "is_total")


def count_chunks(chunks: DataFrame, channel: str | None = None) -> DataFrame:
    if channel is not None:
        chunks = chunks.where(F.col("channel_id") == channel)
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"))


def count_chunks_by_channel(chunks: DataFrame) -> DataFrame:
    """The count for every channel filter in one pass."""
    return chunks.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def visible(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_duplicate"))


def latest_videos(videos: DataFrame, order: Sequence[Column], n: int = 10, title_chars: int = 60) -> DataFrame:
    return videos.orderBy(*order).limit(n).withColumn("title", F.substring("title", 1, title_chars))


def ingest_summary(chunk_verdicts: DataFrame, video_verdicts: DataFrame) -> DataFrame:
    """Per video: status, chunks in total, indexed and suppressed."""
    per_video = chunk_verdicts.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_t"), F.count_if("is_duplicate").alias("_d"))
    j = video_verdicts.select("video_id", F.col("is_duplicate").alias("_dup")).join(per_video, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "video_id",
        F.when(F.col("_dup"), "duplicate_video").otherwise("success").alias("status"),
        F.when(F.col("_dup"), F.lit(0)).otherwise(zero("_t")).alias("total_chunks"),
        F.when(F.col("_dup"), F.lit(0)).otherwise(zero("_t") - zero("_d")).alias("chunks_indexed"),
        F.when(F.col("_dup"), F.lit(0)).otherwise(zero("_d")).alias("duplicate_chunks"))


def ingest_totals(summary: DataFrame) -> DataFrame:
    dup = F.col("status") == "duplicate_video"
    return summary.agg(
        F.count(F.lit(1)).alias("videos_scanned"), F.count_if(dup).alias("duplicate_videos"),
        F.count_if(~dup).alias("canonical_videos"),
        F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("chunks_indexed"), F.lit(0)).alias("chunks_indexed"),
        F.coalesce(F.sum("duplicate_chunks"), F.lit(0)).alias("duplicate_chunks"))


def eval_items(cases: DataFrame) -> DataFrame:
    """Verdict per case from should_refuse and is_grounded; optional checks where their columns are present."""
    out = cases.withColumn("hit", F.col("should_refuse") | F.col("is_grounded")).withColumn(
        "refusal_correct", ~F.col("should_refuse") | ~F.col("is_grounded"))
    if {"expected_channel", "channels"} <= set(cases.columns):
        out = out.withColumn("channel_ok", F.array_contains("channels", F.col("expected_channel")))
    if {"expected_answer_contains", "answer"} <= set(cases.columns):
        out = out.withColumn("answer_ok", F.forall(
            "expected_answer_contains", lambda t: F.col("answer").contains(t)))
    return out


def eval_metrics(cases: DataFrame, first_channel: str, second_channel: str) -> DataFrame:
    """Rates over a set of cases (should_refuse, is_grounded, channels, latency_ms); empty groups give 1 or 0."""
    refuse, grounded = F.col("should_refuse"), F.col("is_grounded")
    share = lambda a, b, empty: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(empty)), 3)
    cited = lambda ch: F.coalesce(F.sum(F.size(F.filter("channels", lambda x: x == ch))), F.lit(0))
    totals = cases.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(~refuse).alias("_in"), F.count_if(~refuse & grounded).alias("_hit"),
        F.count_if(refuse).alias("_off"), F.count_if(refuse & ~grounded).alias("_refused"),
        cited(first_channel).alias("first_channel_citations"),
        cited(second_channel).alias("second_channel_citations"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("average_latency_ms"))
    c = F.col
    return totals.select(
        "total_tests",
        share(c("_hit"), c("_in"), 1.0).alias("overall_hit_rate"),
        share(c("_refused"), c("_off"), 1.0).alias("refusal_accuracy"),
        share(c("_off") - c("_refused"), c("_off"), 0.0).alias("false_positive_rate"),
        share(c("_in") - c("_hit"), c("_in"), 0.0).alias("false_negative_rate"),
        "first_channel_citations", "second_channel_citations",
        share(c("first_channel_citations"), c("second_channel_citations"), 1.0).alias("channel_balance_ratio"),
        "average_latency_ms")


def usage_stats(logs: DataFrame, feedback: DataFrame, group: Sequence[str] = ("day", "llm_provider")) -> DataFrame:
    """Per group: queries, share answered, latency, and feedback and flags of the same group.

    Two aggregates side by side and one more over both, so that groups with null keys meet as well.
    """
    keys = list(group)
    q = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.round(F.avg(F.col("answered").cast("int")), 6).alias("answered_share"),
        F.round(F.avg("latency_ms"), 6).alias("average_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
    f = feedback.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_feedback"), F.count_if("flagged").alias("flagged_feedback"))
    both = q.unionByName(f, allowMissingColumns=True)
    names = [*(c for c in q.columns if c not in keys), "total_feedback", "flagged_feedback"]
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names]).na.fill(
        0, ["total_queries", "total_feedback", "flagged_feedback"])


def latency_sketches(logs: DataFrame, group: Sequence[str] = ("day", "llm_provider"), k: int = 800) -> DataFrame:
    """One mergeable quantile sketch of latency_ms per group, to be stored: a few kilobytes whatever the group's size.

    Null latencies are not counted; a group that has nothing else has no row.
    """
    return logs.where(F.col("latency_ms").isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), k).alias("sketch"))


def usage_percentiles(sketches: DataFrame, start: Column, end: Column, by: Sequence[str] = ("llm_provider",),
                      ranks: Sequence[float] = (0.5, 0.9, 0.99), k: int = 800) -> DataFrame:
    """Latency percentiles over the days from ``start`` to ``end`` (both included) from stored sketches alone.

    A percentile is a latency whose rank is off by no more than about 3 / k of the rows. Days outside are pruned
    where the sketches are stored by day; the logs are not read again.
    """
    merged = sketches.where(F.col("day").between(start, end)).groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    return merged.select(*by, "n", *[
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(r))).alias(f"p{r * 100:g}") for r in ranks])


def sync_summary(results: DataFrame) -> DataFrame:
    """One sync_status row per channel and run from per-video results (channel_id, run_id, status, error)."""
    ok = F.col("status").isin("success", "duplicate_video")
    failed = F.count_if(F.col("error").isNotNull()) > 0
    return results.groupBy("channel_id", "run_id").agg(
        F.when(failed, F.lit(0)).otherwise(F.count(F.lit(1))).cast("bigint").alias("videos_found"),
        F.when(failed, F.lit(0)).otherwise(F.count_if(ok)).cast("bigint").alias("videos_ingested"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.min("error").alias("error_message"))
