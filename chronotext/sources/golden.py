"""Evaluation set and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext import schemas


def read_golden(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array, or with ``multi_line`` off one object per line, which Spark can split."""
    return spark.read.option("multiLine", multi_line).schema(schemas.GOLDEN_SET).json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def nested_report(items: DataFrame, summary: DataFrame, key: str = "test_id", part_items: int = 1000) -> DataFrame:
    """Summary and items in one object: the summary's columns, ``part``, ``parts`` and ``results``, items by ``key``.

    An evaluation of up to ``part_items`` items is one object. A larger one is dealt by its keys to as many parts as
    keep them near that size, each with the summary, so that no row grows with the evaluation. Items with a null key
    are dealt by their content; without items there is one part without results.
    """
    name = F.xxhash64(F.when(F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(
        F.to_json(F.struct(*items.columns))))
    head = summary.withColumn("parts", F.greatest(F.ceil(F.col("total_tests") / part_items), F.lit(1)).cast("long"))
    parts = head.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # the summary is one row
    dealt = items.withColumn("_item", F.struct(F.col(key).alias("_key"), F.struct(*items.columns).alias("item"))).select(
        "_item", name.alias("_name")).join(F.broadcast(head.select("parts")), F.lit(True)).select(
        F.pmod("_name", "parts").alias("part"), "_item").groupBy("part").agg(
        F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["item"]).alias("results"))
    empty = F.array().cast(dealt.schema["results"].dataType)
    return parts.join(dealt, "part", "left").withColumn("results", F.coalesce("results", empty))
