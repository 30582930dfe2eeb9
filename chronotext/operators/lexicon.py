"""Dictionary replacement with the dictionary as a table of any size.

A small table goes to the tasks as a lookup, behind a check of its size. Of a larger one each text gets only the entries
whose words it holds, by a join on word sequences. Either way a text is walked once per word, whatever the number of
entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions.text import WORD_CHAR, squeeze, strip
from chronotext.session import cut_lineage, small_batches

SEND_BYTES = 8 << 20  # characters of a dictionary that is sent to the tasks, at most: about 150 MB in each
TEXTS_AT_ONCE = 500   # texts with their own entries in a batch of Python's


def is_word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


Lookup = tuple[dict[str, str], dict[str, list[int]]]


def lookup_of(entries: Iterable[tuple[str, str]]) -> Lookup:
    """Native forms by term, and by a term's first two characters the lengths that occur.

    Two flat tables: a tree of characters takes ten times the memory.
    """
    natives: dict[str, str] = {}
    terms = {term: natives.setdefault(native, native) for term, native in entries}
    lengths: dict[str, set[int]] = {}
    for term in terms:
        lengths.setdefault(term[:2], set()).add(len(term))
    return terms, {head: sorted(found) for head, found in lengths.items()}


def replace_longest(text: str, lookup: Lookup) -> str:
    """Entries that stand between word edges, the longest of all first; ties by term, then from the left."""
    terms, lengths = lookup
    found = []
    for start in range(len(text)):
        if start and is_word(text[start - 1]):
            continue
        for head in {text[start:start + 1], text[start:start + 2]}:
            for length in lengths.get(head, ()):
                stop = start + length
                if stop > len(text):
                    break
                if (stop == len(text) or not is_word(text[stop])) and (native := terms.get(text[start:stop])) is not None:
                    found.append((-length, text[start:stop], start, native))
    taken: dict[int, tuple[int, str]] = {}
    covered = bytearray(len(text))
    for minus, _, start, native in sorted(found):
        if not any(covered[start:start - minus]):
            covered[start:start - minus] = b"\x01" * -minus
            taken[start] = (start - minus, native)
    out, done = [], 0
    for start in sorted(taken):
        stop, native = taken[start]
        out += [text[done:start], " ", native, " "]
        done = stop
    return "".join([*out, text[done:]])


def _word_key(words: Column) -> Column:
    return F.array_join(words, "\x1f")


def _words_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"([{WORD_CHAR}]+)"), F.lit(1))


def replace_terms_by_table(texts: DataFrame, lexicon: DataFrame, text: str = "text", out: str = "normalized",
                           send_bytes: int = SEND_BYTES) -> DataFrame:
    """``texts`` with ``out``: lower-cased text in which the terms of ``lexicon`` (term, native) are replaced.

    Same rows as ``replace_terms`` for terms that begin and end with a word character and whose native forms hold no
    term: the longest term goes first, each hit is set off by spaces, and what was put in is not read again. Terms
    are trimmed and lower-cased; of several native forms the smallest is taken; entries with a null or empty term or a
    null native form are ignored. A null text stays null, repeated rows stay, and all other columns stay.
    """
    term = strip(F.lower("term"))
    entries = lexicon.select(term.alias("term"), "native").where("term <> '' and native is not null").groupBy(
        "term").agg(F.min("native").alias("native"))
    entries = cut_lineage(entries, "lexicon")
    size = entries.agg(F.sum(F.length("term") + F.length("native"))).first()[0] or 0
    low = strip(F.lower(text))
    if size <= send_bytes:
        sent = texts.sparkSession.sparkContext.broadcast(lookup_of((r.term, r.native) for r in entries.toLocalIterator()))

        @F.pandas_udf("string")
        def by_lookup(part: pd.Series) -> pd.Series:
            return part.map(lambda t: replace_longest(t, sent.value), na_action="ignore")

        return texts.withColumn(out, squeeze(by_lookup(low)))

    @F.pandas_udf("string")
    def by_own(part: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t if e is None else replace_longest(
            t, lookup_of((x["term"], x["native"]) for x in e)) for t, e in zip(part, own, strict=True)], dtype=object)

    small_batches(texts.sparkSession, TEXTS_AT_ONCE)
    keyed = entries.withColumn("_words", _words_in(F.col("term")))
    longest = keyed.agg(F.max(F.size("_words"))).first()[0] or 0
    keyed = keyed.select(_word_key(F.col("_words")).alias("_key"), "term", "native")
    # texts that are equal are looked up once; of a text only its name and its word sequences are dealt
    name = F.md5("_low")
    distinct = texts.select(low.alias("_low")).where("_low is not null").select(
        name.alias("_name"), _words_in(F.col("_low")).alias("_w")).dropDuplicates(["_name"])
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"))).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.size("_w") - i + 1)),
        lambda m: _word_key(F.slice("_w", i, m))))))
    own = distinct.select("_name", F.explode(grams).alias("_key")).join(keyed, "_key").groupBy("_name").agg(
        F.collect_list(F.struct("term", "native")).alias("_own"))
    joined = texts.withColumn("_low", low).withColumn("_md5", name).join(own, F.col("_md5") == F.col("_name"), "left")
    return joined.withColumn(out, squeeze(by_own("_low", "_own"))).drop("_low", "_md5", "_name", "_own")
