"""A keyed table that is replaced one commit at a time: readers see a whole commit or none of it.

Rows lie in buckets by a hash of the key, a folder for each bucket and commit. A commit rewrites the buckets that its
rows touch below a new folder, and then creates one small manifest that names the folder of every bucket. The manifest
is the commit: until it exists nobody reads the new folders, and it can be created only once. It also holds the id of
the batch that was committed, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.sources.tables import latest

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest_manifest(spark: SparkSession, path: str) -> dict:
    """The last commit: its number, its batch and the folder of each bucket."""
    folder, fs = _fs(spark, f"{path}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    if not numbers:
        return {"commit": 0, "batch": None, "buckets": {}}
    return json.loads(spark.read.text(f"{path}/commits/{max(numbers):012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write aside and rename to a name that must be free: of two writers one fails, and no reader meets half a file."""
    aside, fs = _fs(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    target, _ = _fs(spark, f"{path}/commits/{manifest['commit']:012d}.json")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        raise RuntimeError(f"commit {manifest['commit']} of {path} was made by another writer")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as of its last commit; later commits don't change what this DataFrame reads."""
    return _read(spark, path, schema, newest_manifest(spark, path)["buckets"])


def _read(spark: SparkSession, path: str, schema: T.StructType, buckets: dict[str, str]) -> DataFrame:
    folders = [f"{path}/data/{folder}/_bucket={b}" for b, folder in sorted(buckets.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_batch(spark: SparkSession, path: str, updates: DataFrame, batch: int, keys: Sequence[str],
                 version: Sequence[Column], buckets: int = BUCKETS) -> bool:
    """Commit one batch; False if it is committed already.

    The row of a key with the greatest version stays, stored or new, so late batches and repeated rows do no harm.
    A null key is a key like others. The number of buckets is fixed by the first commit.
    """
    seen = newest_manifest(spark, path)
    if seen["batch"] is not None and batch <= seen["batch"]:
        return False
    n = seen.get("of", buckets)
    fresh = latest(updates, keys, version).withColumn(
        "_bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).persist()
    try:
        touched = {str(r[0]) for r in fresh.select("_bucket").distinct().collect()}
        old = _read(spark, path, updates.schema, {b: f for b, f in seen["buckets"].items() if b in touched})
        rows = latest(old.unionByName(fresh.drop("_bucket")), keys, version).withColumn(
            "_bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
        folder = f"{seen['commit'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
    finally:
        fresh.unpersist()
    _commit(spark, path, {"commit": seen["commit"] + 1, "batch": batch, "of": n,
                          "buckets": seen["buckets"] | dict.fromkeys(touched, folder)})
    return True


def upsert_sink(path: str, keys: Sequence[str], version: Sequence[Column],
                buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``. A table belongs to one stream: its batch ids order the commits."""
    def write(df: DataFrame, batch_id: int) -> None:
        upsert_batch(df.sparkSession, path, df, batch_id, keys, version, buckets)
    return write
