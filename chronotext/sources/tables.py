"""Catalog tables: read with fixed schemas, upsert, and write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_catalog(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One of the six catalog tables below ``root``."""
    return read_table(spark, f"{root.rstrip('/')}/{table}", schemas.CATALOG[table])


def latest(updates: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The last write per key.

    A maximum over structs combines before the shuffle, so a key that is updated very often costs one row per task.
    """
    rest = [c for c in updates.columns if c not in keys]
    picked = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*updates.columns)


def without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not in ``other``; a null key equals a null key."""
    taken = other.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(taken[f"_r_{k}"])
    return rows.join(taken, same, "left_anti")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: Sequence[Column],
           ignore_existing: bool = False) -> DataFrame:
    """Insert or replace by key; with ``ignore_existing`` rows already stored win. A null key is a key like others."""
    fresh = latest(updates, keys, version)
    if ignore_existing:
        return target.unionByName(without(fresh, target, keys))
    return without(target, fresh, keys).unionByName(fresh)


def write_upsert(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str],
                 version: Sequence[Column], partition: str, ignore_existing: bool = False) -> None:
    """Upsert into a partitioned parquet table, rewriting only the partitions that the updates touch.

    ``partition`` must be a function of the keys (the channel of a video, say), so a key never moves.
    """
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jpath):
        stored = spark.read.schema(updates.schema).parquet(path)
        touched = stored.join(updates.select(partition).distinct(), partition, "left_semi")
        out = upsert(touched, updates, keys, version, ignore_existing)
    else:
        out = latest(updates, keys, version)
    # no repartition by channel here: a channel with a third of all rows is then written by many tasks
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def ensure_parents(children: DataFrame, parents: DataFrame, key: str, stub: dict[str, Column]) -> DataFrame:
    """Parents plus a stub row for every parent that only the children mention."""
    missing = children.select(key).distinct().join(parents.select(key), key, "left_anti")
    stubs = missing.select(*[
        F.col(key) if c == key else stub.get(c, F.lit(None)).cast(parents.schema[c].dataType).alias(c)
        for c in parents.columns
    ])
    return parents.unionByName(stubs)


def skip_existing(found: DataFrame, stored: DataFrame, key: str, force: bool = False) -> DataFrame:
    return found if force else found.join(stored.select(key), key, "left_anti")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def numbered(df: DataFrame, order: Sequence[Column], slices: Column, keys: Sequence[str] = (),
             name: str = "rn", nulls_last: bool = False) -> DataFrame:
    """1-based position in ``order`` within ``keys``, without sorting a whole key in one task.

    ``slices`` is a coarse value that never decreases along ``order``: rows are ranked inside a slice and shifted
    by the number of rows in earlier slices, which comes from one small count per slice. Null keys are a key like
    others. Rows with a null slice come first, as nulls do in an ascending ``order``; with ``nulls_last`` they come
    last, as in a descending one.
    """
    cut = [*keys, "_slice"]
    d = df.withColumn("_slice", slices)
    counts = d.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    along = F.col("_slice").asc_nulls_last() if nulls_last else F.col("_slice").asc_nulls_first()
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = d.withColumn("_local", F.row_number().over(Window.partitionBy(*cut).orderBy(*order)))
    return (
        null_safe(ranked, shifts, cut)
        .withColumn(name, F.col("_shift") + F.col("_local"))
        .drop("_slice", "_shift", "_local")
    )
