"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.session import new_dir


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Working column names that clash with none of the input's (Spark resolves names without regard to case)."""
    low = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone, so that a repeated task draws it again."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) + F.lit(0.5)) * F.lit(2.0 ** -53)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an expression named twice is else computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let whole texts reach Python some thousand at a time: a session setting, which is lowered only."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(setting, ARROW_ROWS)


def tidy(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` over the batches of a task; then ``forget`` is called and free memory goes back to the system.

    Workers are used again by later tasks, and what each keeps would add up beside the executor's own memory.
    """
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for drop in forget:
                drop()
            give_back()

    return task


def give_back() -> None:
    """Return memory that is free inside this process to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Scratch:
    """Tables of one run below the shared folder; those that a later one replaces can be dropped."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, new_dir(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back: the lineage ends at files that outlive any executor."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root) with the smallest node of each.

    Alternating large-star and small-star steps. Each is a minimum per node, combined before the shuffle, and a join
    on the node; the number of rounds is logarithmic in the longest path. A star's centre never gathers its
    neighbours in one place. Nodes without an edge to another are not returned; null ends are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = scratch.write(e, "edges")
    state = _digest(now)
    for _ in range(max_rounds):
        if not state[0]:
            return _star_rows(now)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        # large star: every larger neighbour of a hangs on a's smallest neighbour
        large = now.select(F.col("b").alias("x"), F.col("a")).join(low, "a").select(
            F.col("m").alias("a"), F.col("x").alias("b")).where("a < b").distinct()
        # small star: the smaller neighbours of b, and b, hang on b's smallest
        small = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b").select("m", "a", "b")
        step = small.select(F.col("m").alias("a"), F.col("b")).unionByName(
            small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        nxt = scratch.write(step, "edges")
        before, state = state, _digest(nxt)
        scratch.drop(now)
        now = nxt
        if state == before:  # stars stay as they are, anything else moves
            return _star_rows(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _star_rows(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple[int, int, int]:
    """Count and two order-free hash sums of a set of edges."""
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 40)), F.lit(0)),
                  F.coalesce(F.sum(F.shiftright(F.xxhash64("b", "a"), 40)), F.lit(0))).first()
    return r[0], r[1], r[2]
