"""Discovery listings: tab-separated lines of id, title, upload date, duration and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.sources.tables import numbered


def read_feed(spark: SparkSession, path: str, url_prefix: str = "https://www.youtube.com/watch?v=") -> DataFrame:
    return parse_feed(spark.read.text(path), url_prefix=url_prefix)


def parse_feed(lines: DataFrame, value: str = "value",
               url_prefix: str = "https://www.youtube.com/watch?v=") -> DataFrame:
    """Lines without a tab are dropped; ``NA`` and malformed fields become null (date) or 0 (numbers)."""
    line = F.rtrim(F.col(value), F.lit("\r\n"))
    parts = F.split(line, "\t")
    field = lambda i: F.get(parts, F.lit(i))
    known = lambda i: F.when(field(i) != "NA", field(i))
    day = F.when(F.length(known(2)) == 8, F.try_to_timestamp(known(2), F.lit("yyyyMMdd")).cast("date"))
    duration = F.when(known(3).rlike(r"^(\d+\.?\d*|\.\d+)$"), F.floor(known(3).try_cast("double")).try_cast("int"))
    views = F.when(known(4).rlike(r"^\d+$"), known(4).try_cast("bigint"))
    return lines.where(F.col(value).contains("\t")).select(
        field(0).alias("video_id"),
        F.coalesce(field(1), F.lit("Unknown")).alias("title"),
        F.concat(F.lit(url_prefix), field(0)).alias("url"),
        day.alias("upload_date"),
        F.coalesce(duration, F.lit(0)).alias("duration_seconds"),
        F.coalesce(views, F.lit(0)).cast("bigint").alias("view_count"),
    )


def parse_playlists(lines: DataFrame, value: str = "value",
                    url_prefix: str = "https://www.youtube.com/playlist?list=") -> DataFrame:
    parts = F.split(F.col(value), "\t")
    pid = F.trim(F.get(parts, F.lit(0)))
    return lines.where(F.col(value).contains("\t")).select(
        pid.alias("playlist_id"), F.trim(F.get(parts, F.lit(1))).alias("title"),
        F.concat(F.lit(url_prefix), pid).alias("url"))


def merge_feeds(feeds: Sequence[DataFrame], key: str, order: Sequence[Column], cap: int = 0) -> DataFrame:
    """All listings together, each video once, from the first feed that has it; ``cap`` = 0 keeps everything."""
    tagged = None
    for i, feed in enumerate(feeds):
        one = feed.withColumn("feed", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    # the first feed wins, and within it the first row in order; a minimum combines before the shuffle
    rest = [c for c in tagged.columns if c != key]
    first = tagged.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("feed", *order)).alias("_row")).select(
        key, "_row.*").select(*tagged.columns)
    if cap <= 0:
        return first
    return first.orderBy("feed", *order).limit(cap)


def pages_of(df: DataFrame, order: Sequence[Column], slices: Column, page_size: int, keys: Sequence[str] = (),
             scan_limit: int = 0) -> DataFrame:
    """Number the rows of a listing and the page each falls on; ``scan_limit`` stops a scan, 0 never."""
    out = numbered(df, order, slices, keys, "position")
    out = out.withColumn("page", F.floor((F.col("position") - 1) / page_size) + 1)
    if scan_limit:
        # pages are fetched while their first position is within the limit
        out = out.where((F.col("page") - 1) * page_size + 1 <= scan_limit)
    return out


def page(df: DataFrame, order: Sequence[Column], slices: Column, start: int, n: int,
         keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``start`` to ``start + n - 1`` of a listing."""
    out = numbered(df, order, slices, keys, "position")
    return out.where(F.col("position").between(start, start + n - 1))


def round_robin(df: DataFrame, channel: str, channel_rank: Column, order: Sequence[Column], slices: Column,
                batch: int = 10, cap: int = 0) -> DataFrame:
    """Interleave channels in batches; ``cap`` limits a channel, 0 does not."""
    ranked = numbered(df, order, slices, [channel], "channel_position")
    if cap > 0:
        ranked = ranked.where(F.col("channel_position") <= cap)
    ranked = ranked.withColumn("round", F.floor((F.col("channel_position") - 1) / batch) + 1).withColumn(
        "channel_rank", channel_rank)
    # many rounds per slice: the slice counts are summed up in one place and must stay few
    return numbered(ranked, [F.col("round"), F.col("channel_rank"), F.col("channel_position")],
                    F.floor(F.col("round") / 1024), name="position")
