"""Test tables as the engine sees them, and the same views in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.session import spread

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            @wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return fn(spark, sf_dir)

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is heavy per row."""
    return spread(table(spark, sf_dir, "documents"))


def upload_date(doc_id: Column) -> Column:
    return F.when(doc_id % 17 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (doc_id % 365).cast("int")))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as videos: the source is the channel."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.col("source").alias("channel_id"),
        upload_date(F.col("doc_id")).alias("upload_date"), "text")


UPLOAD_SQL = "case when doc_id % 17 <> 0 then date '2023-01-01' + cast(doc_id % 365 as integer) end"
WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def clock_sql(s: str) -> str:
    return (f"case when {s} >= 3600 then printf('%02d:%02d:%02d', ({s}) // 3600, (({s}) % 3600) // 60, ({s}) % 60) "
            f"else printf('%02d:%02d', ({s}) // 60, ({s}) % 60) end")
