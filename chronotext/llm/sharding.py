"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

A uniformly random permutation of N rows that sit in P partitions, cut into S shards, sends A[p, s] rows from
partition p to shard s. A has fixed row sums (the partitions) and column sums (the shards), and its law under the
uniform permutation is a multivariate hypergeometric one. So the matrix is drawn first; each partition then orders
its rows at random and deals out A[p, s] of them, rows move once, and each shard orders what it got at random.
Everything is DataFrame code: the draws are SQL expressions over hashes of a seed, so a repeated task draws the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch, fresh, let, unit

FAN_OUT = 64
CHUNK_ROWS = 16_384
TAIL = 12.0


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """The number of good ones among ``drawn`` out of ``total``, by inversion of the exact law at ``u`` in (0, 1).

    The weights follow from their ratio w(k+1) / w(k), starting with 1 at the mode, so no factorial is needed. They
    are summed over the mode and twelve standard deviations to both sides; what lies beyond is below the precision
    of a double.
    """
    def up(p: Column, x: Column) -> Column:  # w(x) / w(x - 1)
        return (p["k"] - x + 1) * (p["d"] - x + 1) / (x * (p["n"] - p["k"] - p["d"] + x))

    def down(p: Column, x: Column) -> Column:  # w(x) / w(x + 1)
        return (x + 1) * (p["n"] - p["k"] - p["d"] + x + 1) / ((p["k"] - x) * (p["d"] - x))

    def span(a: Column, b: Column, step: int) -> Column:
        inside = (a <= b) if step > 0 else (a >= b)
        return F.when(inside, F.sequence(a.cast("long"), b.cast("long"), F.lit(step).cast("long"))).otherwise(
            F.array().cast("array<long>"))

    def mass(p: Column, xs: Column, ratio: Callable) -> Column:
        return F.aggregate(
            xs, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda s, x: let(s["w"] * ratio(p, x.cast("double")), lambda w: F.struct(
                w.alias("w"), (s["sum"] + w).alias("sum"))))["sum"]

    def reached(p: Column, xs: Column, ratio: Callable, goal: Column) -> Column:
        """The first x along xs at which the running sum reaches the goal (null: never)."""
        return F.aggregate(
            xs, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at")),
            lambda s, x: let(s["w"] * ratio(p, x.cast("double")), lambda w: F.struct(
                w.alias("w"), (s["sum"] + w).alias("sum"),
                F.when(s["at"].isNull() & (s["sum"] + w >= goal), x.cast("double")).otherwise(s["at"]).alias("at"))))[
            "at"]

    def picked(p: Column) -> Column:
        ups, downs = span(p["mode"] + 1, p["last"], 1), span(p["mode"] - 1, p["first"], -1)
        sums = F.struct(mass(p, ups, up).alias("above"), mass(p, downs, down).alias("below"))
        # the mode first, then upwards, then downwards: any fixed order of the outcomes inverts the same law
        return let(sums, lambda m: let(u * (1 + m["above"] + m["below"]), lambda goal: F.when(
            goal <= 1.0, p["mode"]).when(
            goal <= 1 + m["above"], F.coalesce(reached(p, ups, up, goal - 1), p["last"])).otherwise(
            F.coalesce(reached(p, downs, down, goal - 1 - m["above"]), p["first"]))))

    def bounded(p: Column) -> Column:
        n, k, d = p["n"], p["k"], p["d"]
        low, high = F.greatest(F.lit(0.0), d - (n - k)), F.least(k, d)
        mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
        sd = F.sqrt(F.greatest(F.lit(0.0), d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))))
        reach = F.ceil(F.lit(TAIL) * sd + 16).cast("double")
        full = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), mode.alias("mode"), F.greatest(
            low, mode - reach).alias("first"), F.least(high, mode + reach).alias("last"))
        return F.when(low == high, low).otherwise(let(full, picked))

    given = F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"), drawn.cast("double").alias("d"))
    return F.when((drawn <= 0) | (good <= 0), F.lit(0)).otherwise(let(given, bounded)).cast("long")


def deal(children: Column, shards: Column, seed: int, level: int) -> Column:
    """Split the shard counts of a node over its children (id, rows), one child after the other."""

    def child(state: Column, c: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            have = F.get(state["left"], j)
            drawn = hypergeometric(s["pool"], have, s["need"], unit(seed, F.lit(level), c["id"], j))
            return let(drawn, lambda take: F.struct(
                (s["pool"] - have).alias("pool"), (s["need"] - take).alias("need"),
                F.concat(s["out"], F.array(take)).alias("out")))

        pool = F.aggregate(state["left"], F.lit(0).cast("long"), lambda a, x: a + x)
        row = F.aggregate(
            F.sequence(F.lit(0), F.size(shards) - 1),
            F.struct(pool.alias("pool"), c["rows"].alias("need"), F.array().cast("array<long>").alias("out")),
            one)["out"]
        return let(row, lambda r: F.struct(
            F.zip_with(state["left"], r, lambda a, b: a - b).alias("left"),
            F.concat(state["out"], F.array(F.struct(c["id"].alias("id"), r.alias("shards")))).alias("out")))

    return F.aggregate(
        children,
        F.struct(shards.alias("left"), F.array().cast("array<struct<id:long,shards:array<long>>>").alias("out")),
        child)["out"]


def communication_matrix(counts: DataFrame, sizes: list[int], seed: int, scratch: Scratch) -> DataFrame:
    """Rows (part, shards array) of the matrix for ``counts`` (part, rows).

    A tree of fan-out 64 over the partitions: the root holds the shard sizes, each node deals its counts to its
    children, and the nodes of a level do so in parallel.
    """
    placed = scratch.write(counts.withColumn("idx", F.row_number().over(Window.orderBy("part")).cast("long") - 1),
                           "parts")
    parts = placed.count()
    depth = 1
    while FAN_OUT ** depth < parts:
        depth += 1
    nodes = counts.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("node"), F.array(*[F.lit(s).cast("long") for s in sizes]).alias("shards"))
    for level in range(depth - 1, -1, -1):
        width = FAN_OUT ** level
        below = placed.groupBy(F.floor(F.col("idx") / width).cast("long").alias("id")).agg(
            F.sum("rows").alias("rows"))
        below = below.groupBy(F.floor(F.col("id") / FAN_OUT).cast("long").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("id", "rows"))).alias("children"))
        dealt = nodes.join(below, "node").select(
            F.inline(deal(F.col("children"), F.col("shards"), seed, level)))
        nodes = scratch.write(dealt.withColumnRenamed("id", "node"), "nodes")
    return nodes.withColumnRenamed("node", "idx").join(placed.select("idx", "part"), "idx").select("part", "shards")


def uniform_shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Deal all rows into shards 0 to n_shards - 1 by a uniformly random permutation; sizes differ by one at most.

    Returns key, size (UTF-8 bytes of the text and 8), text_crc32, shard and slot (gapless from 0 in each shard).
    A null text counts as no bytes (size 8, crc 0); null and repeated keys and repeated rows are rows like others,
    and equal rows are interchangeable. An empty table gives an empty result. Other columns are not looked at; the
    payload can be joined afterwards and moves once. The small columns are written with their input partition first,
    so that counts and rows are those of one reading whatever executors are lost.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = scratch.write(docs.select(
        F.col(key), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.spark_partition_id().alias("_part")), "rows")
    counts = scratch.write(rows.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("rows")), "counts")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    if not total:
        return rows.select(key, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    matrix = communication_matrix(counts, sizes, seed, scratch)
    matrix = matrix.select(F.col("part").alias("_part"), F.transform(
        F.sequence(F.lit(1), F.lit(n_shards)),
        lambda i: F.aggregate(F.slice("shards", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)).alias("_ends"))
    drawn = [F.col(key), F.col("text_crc32"), F.col("size")]
    local = rows.withColumn("_place", F.row_number().over(
        Window.partitionBy("_part").orderBy(unit(seed + 1, *drawn), *drawn)))
    sent = local.join(matrix, "_part").select(
        key, "size", "text_crc32", F.size(F.filter("_ends", lambda e: e < F.col("_place"))).alias("shard"),
        unit(seed + 2, *drawn, F.col("_part"), F.col("_place")).alias("_u"))
    chunks = max(1, total // (n_shards * CHUNK_ROWS))
    sent = scratch.write(sent.withColumn("_chunk", F.floor(F.col("_u") * chunks).cast("long")), "sent")
    # the order by _u within a shard, cut into chunks of bounded size: no task sorts a whole shard
    before = sent.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_base", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_chunk").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = sent.withColumn("_in", F.row_number().over(
        Window.partitionBy("shard", "_chunk").orderBy("_u", key, "text_crc32")))
    return ranked.join(before, ["shard", "_chunk"]).select(
        key, "size", "text_crc32", F.col("shard").cast("int"),
        (F.col("_base") + F.col("_in") - 1).cast("long").alias("slot"))


def join_payload(placed: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents with their shard and slot; keys must be unique and not null for this."""
    shard, slot = fresh(docs.columns, "shard", "slot")
    return docs.join(placed.select(key, F.col("shard").alias(shard), F.col("slot").alias(slot)), key)
