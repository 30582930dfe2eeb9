"""Removal of repeated passages by overlapping windows of three lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import fresh, let

WINDOW = 3


def window_hashes(text: Column) -> Column:
    """One (h1, h2, pos) per three consecutive lines that hold more than white space; pos counts from 0."""
    return let(F.split(text, "\n", -1), _window_hashes)


def _window_hashes(lines: Column) -> Column:
    def one(i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(1), *part).alias("h2"), i.alias("pos"),
                        (F.regexp_instr(F.concat(*part), F.lit(r"\S")) > 0).alias("full"))

    n = F.size(lines)
    spans = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(spans, one), lambda w: w["full"])


def without(lines: Column, starts: Column) -> Column:
    """The lines that no window covers, for sorted distinct window starts; linear in the number of lines."""
    m, n = F.size(starts), F.size(lines)

    def gap(i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + WINDOW)
        end = F.when(i == m, n).otherwise(F.get(starts, i))
        return F.slice(lines, begin + 1, F.greatest(F.lit(0), end - begin))

    return F.flatten(F.transform(F.sequence(F.lit(0), m), gap))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every occurrence of three consecutive lines after the first one, in order of (key, position), is removed.

    All lines that a later occurrence covers go; overlapping windows merge. The same lines stay at the first place,
    so no line disappears from the corpus altogether. Returns all columns with the text replaced, and n_lines and
    n_removed (counts of lines). Texts of fewer than three lines, null texts (0 lines) and windows of white space
    alone stay as they are. Null keys come last in the order; rows with equal key and text are one document, and
    each keeps its first occurrences; equal keys with different texts are ordered by a hash of the text.

    Windows are 16 bytes of hashes. First places are a minimum combined before the shuffle, so a passage that a third
    of all documents share costs a row per task; the join that finds the later places is one that Spark can split.
    """
    cols = docs.columns
    lines, h, starts, k = fresh(cols, "_lines", "_hash", "_starts", "_k")
    base = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()))
    windows = base.select(F.col(key).alias("k"), F.col(h).alias("h"), F.inline(
        window_hashes(F.col(text)))).drop("full")
    place = F.struct(F.col("k").isNull().alias("none"), "k", "h", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(first.drop("n"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    cover = later.groupBy(F.col("k").alias(k), F.col("h").alias("_h")).agg(
        F.sort_array(F.collect_set("pos")).alias(starts))
    joined = base.join(cover, base[key].eqNullSafe(cover[k]) & (base[h] == cover["_h"]), "left").drop(k, "_h")
    split = F.split(F.col(text), "\n", -1)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(split))
    kept = F.when(F.col(starts).isNotNull(), let(split, lambda a: without(a, F.col(starts))))
    joined = joined.withColumn(lines, kept)
    n_out, r_out = fresh(cols, "n_lines", "n_removed")
    return joined.select(
        *[(F.when(F.col(lines).isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text)).alias(c)
           if c == text else F.col(c)) for c in cols],
        n_lines.cast("long").alias(n_out),
        F.when(F.col(lines).isNotNull(), n_lines - F.size(lines)).otherwise(0).cast("long").alias(r_out))


SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as a from documents),
w as (select doc_id, a, unnest(range(1, len(a) - 1)) as p from d where len(a) >= 3),
v as (select doc_id, p, a[p] || chr(10) || a[p + 1] || chr(10) || a[p + 2] as s from w),
f as (select s, min(struct_pack(d := doc_id, p := p)) as first from v
      where regexp_matches(s, '\S') group by s having count(*) > 1),
later as (select doc_id, p from v join f using (s) where struct_pack(d := doc_id, p := p) <> first),
cov as (select distinct doc_id, q from (select doc_id, unnest([p, p + 1, p + 2]) as q from later)),
l as (select doc_id, unnest(range(1, len(a) + 1)) as q, unnest(a) as line from d),
k as (select l.doc_id, string_agg(line, chr(10) order by l.q) filter (cov.q is null) as t,
             count(*) as n_lines, count(cov.q) as n_removed
      from l left join cov on l.doc_id = cov.doc_id and l.q = cov.q group by l.doc_id)
select d.doc_id, case when n_removed = 0 then d.text else coalesce(t, '') end as text,
       cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed
from d left join k using (doc_id)
"""
