"""Pack token sequences into windows: repeat counts of length combinations by non-negative least squares.

Documents longer than a window give whole windows first. What remains of each is shorter than a window, so the corpus
is a histogram of at most ``window - 1`` lengths, whatever its size. Shallow combinations of lengths that fill a
window exactly are enumerated, and non-negative repeat counts are fitted to the histogram; they are rounded down and
the documents left over are poured into windows one behind the other, cut where a window ends. Which document goes
where then follows from its rank among those of its length, so no task sees more than a bounded share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch, small_batches, tidy
from chronotext.llm.tokens import encoder, forget_words, narrowest, pack

GROUP_ROWS = 1024
BATCH_BYTES = 16 << 20


def combinations(hist: np.ndarray, window: int, spread: int = 10, copies: int = 6) -> list[tuple[int, ...]]:
    """Multisets of lengths that occur and that fill the window: pairs, triples, quadruples and repeats of one.

    The free members of a combination are spread evenly over the lengths that occur; the last one closes it.
    """
    have = np.flatnonzero(hist)
    if not len(have):
        return []
    have = have[have > 0]
    top = have[np.argsort(-hist[have], kind="stable")[:spread]]
    free = sorted({int(x) for x in have[np.linspace(0, len(have) - 1, spread).astype(int)]} | {int(x) for x in top})
    found: set[tuple[int, ...]] = set()

    def close(*parts: int) -> None:
        rest = window - sum(parts)
        if rest == 0:
            found.add(tuple(sorted(parts)))
        elif 0 < rest < len(hist) and hist[rest]:
            found.add(tuple(sorted((*parts, rest))))

    for a in map(int, have):
        for k in range(1, copies + 1):
            close(*[a] * k)
        for b in free:
            close(a, b)
            close(a, a, b)
            for c in free[::3]:
                close(a, b, c)
    return sorted(found)


def fit(patterns: list[tuple[int, ...]], hist: np.ndarray, steps: int = 40_000) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared misfit of sum(x * pattern) to the histogram.

    Coordinate descent: the pattern whose best step gains most moves first, and only the gradients of patterns that
    share a length with it change. The counts stay sparse, so that rounding them loses little.
    """
    depth = max(map(len, patterns))
    members = np.full((len(patterns), depth), len(hist), dtype=np.int64)
    for i, p in enumerate(patterns):
        members[i, :len(p)] = p
    norm = np.array([sum(p.count(v) ** 2 for v in set(p)) for p in patterns], dtype=float)
    users = [np.empty(0, dtype=np.int64)] * (len(hist) + 1)
    flat, rows = members.ravel(), np.repeat(np.arange(len(patterns)), depth)
    by = np.argsort(flat, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(flat[by])) + 1):
        users[flat[part[0]]] = rows[part]
    left = np.append(hist.astype(float), 0.0)
    gradient = left[members].sum(axis=1)
    x = np.zeros(len(patterns))
    root = np.sqrt(norm)
    for _ in range(steps):
        step = np.maximum(gradient / norm, -x)
        best = int(np.argmax(np.abs(step) * root))
        move = step[best]
        if abs(move) < 0.25:
            break
        x[best] += move
        for v in members[best]:
            if v < len(hist):
                left[v] -= move
                np.subtract.at(gradient, users[v], move)
    return x


def plan_windows(hist: np.ndarray, window: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, repeats) and how many documents of each length they use, never more than there are."""
    patterns = combinations(hist, window)
    used = np.zeros_like(hist)
    plan = []
    if patterns:
        x = fit(patterns, hist)
        for i in np.argsort(-x, kind="stable"):
            p = patterns[i]
            repeats = min([int(x[i] + 1e-6), *((hist[v] - used[v]) // p.count(v) for v in set(p))])
            if repeats > 0:
                plan.append((p, int(repeats)))
                for v in p:
                    used[v] += repeats
    return plan, used


def tail_cuts(size: int) -> list[int]:
    """A part-filled last window as powers of two, which need no padding: ends of its sequences."""
    ends, at = [], 0
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def token_table(docs: DataFrame, tokenizer: str, end_id: int, code: str, key: str, text: str) -> DataFrame:
    """(row, key, n, ids): ids of every text with its end id as little-endian bytes, 2 or 4 per id.

    ``row`` numbers the rows of this reading, so the result must be stored before it is used twice.
    """
    end, width = pack([end_id], code), {"H": 2, "I": 4}[code]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, code)
        for batch in batches:
            rows, keys, out, size = batch.column(0), batch.column(1), [], 0
            for words in batch.column(2).to_pylist():
                out.append(encode(words) + end)
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield emit(rows, keys, out)
                    rows, keys, out, size = rows[len(out):], keys[len(out):], [], 0
            yield emit(rows, keys, out)

    def emit(rows: pa.Array, keys: pa.Array, out: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [rows[:len(out)], keys[:len(out)], pa.array([len(b) // width for b in out], pa.int64()),
             pa.array(out, pa.binary())], names=["row", "key", "n", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"),
        F.col(text).alias("text")).mapInArrow(tidy(run, forget_words), "row long, key long, n long, ids binary")


def place(lengths: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(row, pieces): for each row of (row, n) its pieces (start, length, sequence_id, offset)."""
    spark = lengths.sparkSession
    rest = (F.col("n") % window).alias("rest")
    # at most ``window`` rows come back, whatever the corpus
    stats = lengths.groupBy(rest).agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    stats = {r["rest"]: (r["c"], r["full"]) for r in stats.collect()}
    hist = np.zeros(window, dtype=np.int64)
    for v, (c, _) in stats.items():
        hist[v] = c
    hist[0] = 0
    plan, used = plan_windows(hist, window)
    # sequence ids: whole windows of long documents, then the fitted patterns, then the poured rest
    full_base, at = {}, 0
    for v in sorted(stats):
        full_base[v] = at
        at += int(stats[v][1])
    segments: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken = np.zeros(window, dtype=np.int64)
    for p, repeats in plan:
        offset = 0
        for v in sorted(set(p)):
            m = p.count(v)
            segments.setdefault(v, []).append(
                (int(taken[v]), int(taken[v] + m * repeats), m, at, offset))
            taken[v] += m * repeats
            offset += m * v
        at += repeats
    pour_at, line, pour_base = at, 0, {}
    for v in range(window - 1, 0, -1):
        pour_base[v] = line
        line += int(hist[v] - used[v]) * v
    bounds = [line - line % window + e for e in tail_cuts(line % window)]
    last_full = line // window
    per_length = [(v, int(stats[v][0] // GROUP_ROWS + 1), full_base[v], int(used[v]), pour_base.get(v, 0),
                   segments.get(v, [])) for v in sorted(stats)]
    # one row per length: bounded by the window
    table = spark.createDataFrame(
        per_length or [(0, 1, 0, 0, 0, [])],
        "rest long, groups long, full_base long, used long, pour long, "
        "segs array<struct<a:long,b:long,m:long,seq:long,off:long>>")
    rows = lengths.select("row", "n", rest).join(F.broadcast(table), "rest").withColumn(
        "g", F.pmod(F.xxhash64("row"), F.col("groups"))).withColumn("full", F.floor(F.col("n") / window))
    group = Window.partitionBy("rest", "g").orderBy("row")
    ranked = rows.withColumn("rn", F.row_number().over(group) - 1).withColumn(
        "fulls", F.sum("full").over(group.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = rows.groupBy("rest", "g").agg(F.count(F.lit(1)).alias("gc"), F.sum("full").alias("gf"))
    before = Window.partitionBy("rest").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("rest", "g", F.coalesce(F.sum("gc").over(before), F.lit(0)).alias("gc"),
                         F.coalesce(F.sum("gf").over(before), F.lit(0)).alias("gf"))
    r = ranked.join(sizes, ["rest", "g"]).withColumn("rank", F.col("gc") + F.col("rn")).withColumn(
        "first_full", F.col("full_base") + F.col("gf") + F.coalesce("fulls", F.lit(0)))

    def piece(start, length, seq, off):
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"),
                        seq.cast("long").alias("sequence_id"), off.cast("long").alias("offset"))

    whole = F.when(F.col("full") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("full") - 1),
        lambda i: piece(i * window, F.lit(window), F.col("first_full") + i, F.lit(0)))).otherwise(F.array())
    start = F.col("full") * window
    seg = F.get(F.filter("segs", lambda s: (s["a"] <= F.col("rank")) & (F.col("rank") < s["b"])), 0)
    fitted = F.array(piece(
        start, F.col("rest"), F.col("seg.seq") + F.floor((F.col("rank") - F.col("seg.a")) / F.col("seg.m")),
        F.col("seg.off") + (F.col("rank") - F.col("seg.a")) % F.col("seg.m") * F.col("rest")))
    # poured rows lie on one line; it is cut at windows, and its last window at powers of two
    begin = F.col("pour") + (F.col("rank") - F.col("used")) * F.col("rest")
    end = begin + F.col("rest")
    ends = F.array_distinct(F.array(
        F.least(end, (F.floor(begin / window) + 1) * window), end,
        *[F.greatest(begin, F.least(end, F.lit(b))) for b in bounds]))
    ends = F.filter(F.array_sort(ends), lambda e: e > begin)
    tail_from = F.array(*[F.lit(b).cast("long") for b in [line - line % window, *bounds[:-1]]])

    def poured(e, i):
        a = F.when(i == 0, begin).otherwise(F.get(F.col("ends"), i - 1))
        in_tail = F.size(F.filter(tail_from, lambda b: b <= a))
        base = F.when(a < last_full * window, F.floor(a / window) * window).otherwise(
            F.get(tail_from, F.greatest(in_tail - 1, F.lit(0))))
        seq = F.when(a < last_full * window, F.floor(a / window)).otherwise(last_full + in_tail - 1)
        return piece(start + a - begin, e - a, pour_at + seq, a - base)

    placed = r.withColumn("seg", seg).withColumn("ends", ends)
    remainder = F.when(F.col("rest") == 0, F.array()).when(F.col("seg").isNotNull(), fitted).otherwise(
        F.transform("ends", poured))
    return placed.select("row", F.concat(whole, remainder).alias("pieces"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """All texts as pieces of sequences of at most ``window`` tokens.

    Returns key, start, length, doc_tokens, sequence_id, offset and ids (the piece, little-endian; 16 bits an id if
    the vocabulary allows, else 32). Every id lies in one piece; sequences are gapless from 0 and filled to the
    window, but for the last part-filled one, which is split into powers of two. A null or empty text is its end id
    alone. Null and repeated keys and repeated rows are documents of their own. An empty table gives no rows. Other
    columns are not looked at.

    The ids are stored once. Ranks come from windows over groups of about 1,000 rows of one length and sums over
    those groups, so a length that a third of the documents share is many groups.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    code = "I" if end_id >= 1 << 16 else narrowest(tokenizer)
    width = {"H": 2, "I": 4}[code]
    tokens = scratch.write(token_table(docs, tokenizer, end_id, code, key, text), "tokens")
    pieces = place(tokens.select("row", "n"), window, scratch)
    joined = tokens.join(pieces, "row").select(
        F.col("key").alias(key), F.col("n").alias("doc_tokens"), "ids", F.explode("pieces").alias("p"))
    return joined.select(
        key, "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset",
        F.substring("ids", (F.col("p.start") * width + 1).cast("int"), (F.col("p.length") * width).cast("int")).alias(
            "ids"))


def wide_crc(ids: Column, length: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit numbers, however they are stored."""
    @F.pandas_udf("long")
    def run(ids: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(b if len(b) == 4 * n else np.frombuffer(b, "<u2").astype("<u4"))
                          for b, n in zip(ids, length, strict=True)], dtype="int64")

    return run(ids, length)
