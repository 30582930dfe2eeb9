"""Collocations of two to five words per language, scored from sorted count streams that are joined in lockstep.

Counting. Words, then pairs, then longer phrases are counted. A pair can be frequent only if its words are, a longer
phrase only if its pairs are, so each pass counts phrases whose parts pass a bitmap of the frequent ones. The bitmap has
a fixed size and lets some others through, never fewer; all counts are exact and the threshold decides.

Scoring. The counts are put in prefix order (by first word, second word, ...) and in suffix order (by last word, the
one before, ...). In prefix order a phrase follows all its own beginnings, so one walk with a stack of the open
beginnings gives each phrase the counts of its left parts and each beginning the largest count of its extensions by a
word to the right; the walk in suffix order gives right parts and extensions to the left. Both walks yield the same
phrases, which are merge-joined. Range partitions are walked in parallel: a partition opens with the beginnings of
its first phrase, looked up in the partitions before, so a word that starts most phrases is split like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch, small_batches, tidy

LONGEST, LEAST, KEPT = 5, 100, 2000
BITMAP_BITS = 1 << 26
CHUNK_BYTES = 1 << 20
COMBINED, SLICE = 1 << 18, 1 << 17
# fixed values: what parts pieces and words
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
# inside keys a tab stands between words, so no byte of a word may sort before it; ESCAPE is no byte of a word either
BETWEEN, ESCAPE = 0x09, 0x0A
_PIECE_END = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]")
COUNTS = "lang string, phrase string, f long"


class Words:
    """The words of some texts of one language in one buffer: a tab after each, places, and the end of each's piece."""

    KIND = np.zeros(256, np.uint8)
    KIND[list(WORD_ENDS)] = 1
    KIND[list(PIECE_ENDS)] = 2
    LOWER = np.arange(256, dtype=np.uint8)
    LOWER[65:91] += 32

    def __init__(self, texts: bytes) -> None:
        raw = np.frombuffer(texts, np.uint8)
        if raw.size and raw.min() < BETWEEN:  # rare: control characters
            raw, marked = self.escaped(raw)
            kind = np.where(marked, np.uint8(0), self.KIND[raw])
        else:
            kind = self.KIND[raw]
        inside = kind == 0
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = inside.copy()
        keep[last[last < raw.size]] = True
        flat = self.LOWER[raw]
        flat[~inside] = BETWEEN
        self.bytes = np.append(flat[keep], np.uint8(BETWEEN))
        length = last - first
        self.start = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
        self.end = self.start + length
        piece = np.cumsum(kind == 2)[first] if first.size else first
        # words left in the piece, from each word on
        last_of = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if first.size else first
        self.left = np.repeat(last_of, np.diff(last_of, prepend=-1)) - np.arange(first.size) + 1

    @staticmethod
    def escaped(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes below the tab as ESCAPE and another; the second array marks both, which are no separators."""
        low = raw < BETWEEN
        out = np.repeat(raw, np.where(low, 2, 1))
        at = np.flatnonzero(low) + np.arange(low.sum())
        mark = np.zeros(out.size, bool)
        mark[at] = mark[at + 1] = True
        out[at], out[at + 1] = ESCAPE, raw[low] + 0x10
        return out, mark

    def __len__(self) -> int:
        return self.start.size

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that start at the given words."""
        begin, size = self.start[at], self.end[at + n - 1] - self.start[at]
        offsets = np.zeros(at.size + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        index = np.repeat((begin - offsets[:-1]).astype(np.int32), size) + np.arange(offsets[-1], dtype=np.int32)
        return pa.Array.from_buffers(pa.string(), at.size, [None, pa.py_buffer(offsets), pa.py_buffer(
            self.bytes[index])])

    def reach(self, lang: str, table: np.ndarray, n: int) -> np.ndarray:
        """Words from each word on that may form a frequent phrase: within the piece, all phrases of n in the bitmap."""
        if len(self) < n:
            return np.zeros(len(self), np.int64)
        at = bits(self.bytes, self.start[:len(self) - n + 1], self.end[n - 1:], lang)
        passed = (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        stops = np.flatnonzero(np.append(passed == 0, True))
        place = np.arange(len(self) - n + 1)
        runs = stops[np.searchsorted(stops, place)] - place
        out = np.zeros(len(self), np.int64)
        out[:place.size] = np.where(runs > 0, np.minimum(self.left[:place.size], runs + n - 1), 0)
        return out


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out, dtype=np.uint64)


_P = 0x9E3779B97F4A7C15
_P_BACK = pow(_P, -1, 1 << 64)


def bits(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, lang: str) -> np.ndarray:
    """Places in the bitmap of slices of a buffer; equal slices of a language have equal places, wherever they are."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
        (buffer.astype(np.uint64) + np.uint64(1)) * _powers(buffer.size, _P)[:-1], dtype=np.uint64)))
    h = (sums[end] - sums[start]) * _powers(buffer.size, _P_BACK)[start]
    h ^= np.uint64(hash_of(lang))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) & np.uint64(BITMAP_BITS - 1)


def hash_of(lang: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(lang.encode())


def chunks(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[str, bytes]]:
    """About CHUNK_BYTES of text of one language at a time; a longer text is cut where a piece ends.

    Memory follows the longest piece, not the longest text.
    """
    waiting: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    texts = texts.cast(pa.binary())
    for i, lang in enumerate(langs.to_pylist()):
        lang = "und" if lang is None else lang
        at, text = 0, texts[i].as_py() or b""
        while at < len(text):
            end = len(text)
            if end - at > CHUNK_BYTES:
                found = _PIECE_END.search(text, at + CHUNK_BYTES)
                end = found.end() if found else end
            waiting.setdefault(lang, []).append(text[at:end])
            held[lang] = held.get(lang, 0) + end - at
            at = end
            if held[lang] >= CHUNK_BYTES:
                yield lang, b"\n".join(waiting.pop(lang))
                held[lang] = 0
    for lang, parts in waiting.items():
        yield lang, b"\n".join(parts)


class Combiner:
    """Counts of phrases that a task has seen, passed on whenever many different ones have gathered."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, lang: str, phrases: pa.Array) -> None:
        counts = phrases.value_counts()
        self.tables.append(pa.table({
            "lang": pa.repeat(lang, len(counts)), "phrase": counts.field("values"), "f": counts.field("counts")}))
        self.rows += len(counts)

    def passed_on(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.rows or not last and self.rows < 4 * COMBINED:
            return
        whole = pa.concat_tables(self.tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        whole = whole.rename_columns(["lang", "phrase", "f"])
        self.tables, self.rows = [whole], len(whole)
        if last or self.rows >= COMBINED:
            yield from whole.combine_chunks().to_batches(max_chunksize=50_000)
            self.tables, self.rows = [], 0


def counted(docs: DataFrame, lengths: range, bitmap=None) -> DataFrame:
    """Exact counts (lang, phrase, f) of phrases of these lengths; with a bitmap, if their parts one word shorter than
    the shortest length pass it.

    Where words are counted, a null phrase stands for the number of words of the language. Counts are summed in the
    task, then by key.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals = Combiner(), {}
        table = np.frombuffer(bitmap.value, np.uint64) if bitmap is not None else None
        for batch in batches:
            for lang, texts in chunks(batch.column(0), batch.column(1)):
                words = Words(texts)
                totals[lang] = totals.get(lang, 0) + len(words)
                run = words.left if table is None else words.reach(lang, table, lengths.start - 1)
                for n in lengths:
                    at = np.flatnonzero(run >= n)
                    for i in range(0, at.size, SLICE):
                        seen.add(lang, words.phrases(at[i:i + SLICE], n))
                yield from seen.passed_on()
        yield from seen.passed_on(last=True)
        if totals and 1 in lengths:
            yield pa.RecordBatch.from_pydict({"lang": list(totals), "phrase": pa.nulls(len(totals), pa.string()),
                                              "f": pa.array(list(totals.values()), pa.int64())})

    return docs.mapInArrow(tidy(count), COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def marked(phrases: DataFrame) -> bytes:
    """The bitmap of all (lang, phrase) given; at most BITMAP_BITS / 64 rows reach the driver."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            phrases = batch.column(1).cast(pa.binary()).to_pylist()
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(langs, phrases, strict=True):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, some in by_lang.items():
                ends = np.cumsum([len(p) for p in some])
                b = bits(np.frombuffer(b"".join(some), np.uint8), np.concatenate(([0], ends[:-1])), ends, lang)
                yield pa.RecordBatch.from_arrays([
                    pa.array((b >> np.uint64(6)).astype(np.int64)),
                    pa.array((np.uint64(1) << (b & np.uint64(63))).view(np.int64))], ["at", "mask"])

    rows = phrases.select("lang", "phrase").mapInArrow(places, "at long, mask long").groupBy("at").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(BITMAP_BITS // 64, np.int64)
    table[rows["at"].to_numpy()] = rows["mask"].to_numpy()
    return table.tobytes()


def walked(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """One pass over counts (lang, key, f) in the order of their keys, words of a key parted by tabs.

    Gives (lang, key, f, parts, ext) for keys of two words and more: the counts of all proper beginnings, shortest
    first, and the largest count of a key that goes on by one word (0: none).
    """
    ranged = scratch.write(grams.repartitionByRange("lang", "key").withColumn("part", F.spark_partition_id()), "order")
    first = ranged.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("s")).select("part", "s.*")
    words = F.split("key", "\t")
    begins = first.select("part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.lit(LONGEST - 1)), lambda k: F.when(
        k < F.size(words), F.array_join(F.slice(words, 1, k), "\t")))).alias("key")).where("key is not null")
    opened = ranged.select("lang", "key", "f").join(F.broadcast(begins), ["lang", "key"]).select(
        "lang", "key", "f", "part", F.lit(True).alias("again"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []  # open beginnings: [lang, words, f, parts, ext, again]
        out: list[tuple] = []

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                lang, key, f, parts, ext, again = stack.pop()
                if len(parts) or again:
                    out.append((lang, "\t".join(key), f, parts, ext, again))

        def passed_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip(("lang", "key", "f", "parts", "ext", "again"), r, strict=True))
                                               for r in out], pa.schema([
                ("lang", pa.string()), ("key", pa.string()), ("f", pa.int64()), ("parts", pa.list_(pa.int64())),
                ("ext", pa.int64()), ("again", pa.bool_())]))
            out.clear()
            return made

        for batch in batches:
            for part, lang, key, f, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = key.split("\t")
                depth = 0
                if at == (part, lang):
                    while depth < len(stack) and depth < len(words) - 1 and stack[depth][1][-1] == words[depth]:
                        depth += 1
                at = (part, lang)
                close(depth)
                if depth != len(words) - 1:
                    raise RuntimeError(f"a beginning of {words} has no count")
                if stack:
                    stack[-1][4] = max(stack[-1][4], f)
                stack.append([lang, words, f, [s[2] for s in stack], 0, again])
            if len(out) > 20_000:
                yield passed_on()
        close(0)
        yield passed_on()

    both = ranged.select("part", "lang", "key", "f", F.lit(False).alias("again")).unionByName(opened)
    rows = scratch.write(both.repartition("part").sortWithinPartitions("part", "lang", "key").select(
        "part", "lang", "key", "f", "again").mapInArrow(walk, "lang string, key string, f long, parts array<long>, "
                                                              "ext long, again boolean"), "walked")
    # a beginning that was still open where a partition ended may be extended in later ones
    later = rows.where("again").groupBy("lang", "key").agg(F.max("ext").alias("_more"))
    return rows.where("not again and size(parts) > 0").join(F.broadcast(later), ["lang", "key"], "left").select(
        "lang", "key", "f", "parts", F.greatest("ext", "_more").alias("ext"))


def turned(key: Column) -> Column:
    """A key with its words in reverse order."""
    return F.array_join(F.reverse(F.split(key, "\t")), "\t")


def plain(key: Column) -> Column:
    """The words as they are in the texts, a blank between them."""
    spaced = F.replace(key, F.lit("\t"), F.lit(" "))
    back = spaced
    for b in range(BETWEEN):
        back = F.replace(back, F.lit(chr(ESCAPE) + chr(b + 0x10)), F.lit(chr(b)))
    return F.when(spaced.contains(chr(ESCAPE)), back).otherwise(spaced)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, kept: int = KEPT) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Words and pieces as in the module's fixed values, A-Z in lower case, a null language as ``und``. Phrases of 2 to 5
    words that occur at least ``least`` times, without those inside a longer one that is as frequent; the score is the
    smallest floor(1000 a n / (l r)) of all cuts, in exact integers. The first ``kept`` of each language by score, a and
    the bytes of the phrase. Null and empty texts have no words; a language without a phrase and an empty table give no
    rows; equal rows count as often as they stand there. Other columns are not read.

    Hot words cost a row per task and a range partition or more of their own. What reaches the driver is the bitmap;
    broadcast are the bitmap and at most four beginnings for each range partition.
    """
    if least < 1:
        raise ValueError("least must be positive")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    small_batches(spark)
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def pass_over(lengths: range, parts: DataFrame | None = None) -> DataFrame:
        bitmap = None if parts is None else spark.sparkContext.broadcast(marked(parts))
        out = counted(docs, lengths, bitmap).where(F.col("phrase").isNull() | (F.col("f") >= least))
        return scratch.write(out, f"phrases{lengths.start}")

    words = pass_over(range(1, 2))
    totals = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    words = words.where("phrase is not null")
    pairs = pass_over(range(2, 3), words)
    grams = words.unionByName(pairs).unionByName(pass_over(range(3, LONGEST + 1), pairs))
    left = walked(grams.select("lang", F.col("phrase").alias("key"), "f"), scratch).select(
        "lang", "key", F.col("f").alias("a"), F.col("parts").alias("ls"), F.col("ext").alias("e1"))
    right = walked(grams.select("lang", turned(F.col("phrase")).alias("key"), "f"), scratch).select(
        "lang", turned(F.col("key")).alias("key"), F.reverse("parts").alias("rs"), F.col("ext").alias("e2"))
    both = left.join(right.hint("merge"), ["lang", "key"]).where(F.col("a") > F.greatest("e1", "e2")).join(
        totals, "lang")

    def score(l: Column, r: Column) -> Column:
        above = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(17,0)")
        return F.call_function("div", above, l.cast("decimal(18,0)") * r.cast("decimal(18,0)"))

    cuts = F.transform(F.arrays_zip("ls", "rs"), lambda x, k: F.struct(
        score(x["ls"], x["rs"]).alias("score"), k.alias("k"), x["ls"].alias("l"), x["rs"].alias("r")))
    best = both.withColumn("cut", F.array_min(cuts)).select(
        "lang", plain(F.col("key")).alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = " union all ".join(
    f"select lang, unnest(list_transform(range(1, len(a) - {n} + 2), lambda i: a[i:i + {n - 1}])) as w from words"
    for n in range(1, LONGEST + 1))
SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as a from pieces),
n as (select lang, sum(len(a)) as n from words group by lang),
f as (select lang, w, count(*) as f from ({_GRAMS}) group by lang, w having count(*) >= {LEAST}),
c as (select * from f where len(w) > 1),
inside as (
  select distinct c.lang, s.w from (
    select lang, f, w, unnest(flatten(list_transform(range(2, len(w)), lambda m: list_transform(
      range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) as part from c where len(w) > 2) c
  join c s on s.lang = c.lang and s.w = c.part and 100 * c.f >= 100 * s.f),
cuts as (select lang, w, f as a, unnest(range(1, len(w))) as k from c anti join inside using (lang, w)),
scored as (
  select cuts.*, p.f as l, q.f as r, n.n, cast(1000 as hugeint) * a * n.n // (cast(p.f as hugeint) * q.f) as score
  from cuts join f p on p.lang = cuts.lang and p.w = cuts.w[1:k]
  join f q on q.lang = cuts.lang and q.w = cuts.w[k + 1:len(cuts.w)] join n on n.lang = cuts.lang),
best as (select * from scored qualify row_number() over (partition by lang, w order by score, k) = 1),
ranked as (select *, array_to_string(w, ' ') as phrase from best)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
       a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {KEPT}
"""
