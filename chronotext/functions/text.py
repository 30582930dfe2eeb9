"""Column functions on text. All are native expressions except Unicode NFC, which Spark does not offer."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext import fixed_values as fixed

# White space as Unicode sees it, plus the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
# A letter, digit or underscore; combining marks are not part of it.
WORD_CHAR = r"\p{L}\p{N}_"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE + "+", " "))


def words(c: Column) -> Column:
    """Non-empty whitespace tokens."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda texts: [unicodedata.normalize("NFC", t) for t in texts], na_action="ignore")


def _escape(term: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" or ord(ch) > 127 else "\\" + ch for ch in term)


def _literal(replacement: str) -> str:
    """A replacement text in which nothing refers to a group."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _longest_first(terms: Iterable[str]) -> list[str]:
    return sorted(terms, key=len, reverse=True)


def drop_brackets(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?d)\[.*?\]", " "), r"(?d)\(.*?\)", " ")


def collapse_stutters(c: Column) -> Column:
    """A word said three or more times in a row is kept once."""
    return F.regexp_replace(c, r"(?U)\b(\w+)(?:\s+\1\b){2,}", "$1")


def drop_fillers(c: Column, fillers: Sequence[str] = tuple(fixed.FILLERS)) -> Column:
    if not fillers:
        return c
    any_filler = "|".join(_escape(f) for f in _longest_first(fillers))
    return F.regexp_replace(c, rf"(?iU)(?<![^\s।,?!])(?:{any_filler})(?![^\s।,?!])", " ")


def tighten(c: Column) -> Column:
    one_space = F.regexp_replace(c, SPACE + "+", " ")
    return strip(F.regexp_replace(one_space, r"(?U)\s*([।,?!])", "$1"))


def normalize_transcript(c: Column, fillers: Sequence[str] = tuple(fixed.FILLERS), stutters: bool = True,
                         unicode_form: bool = True) -> Column:
    """Spoken text to clean text: NFC, bracketed sound notes, stutters, fillers, spacing."""
    out = F.coalesce(c, F.lit(""))
    if unicode_form:
        out = nfc(out)
    out = drop_brackets(out)
    if stutters:
        out = collapse_stutters(out)
    return tighten(drop_fillers(out, fillers))


def estimate_tokens(c: Column) -> Column:
    return F.size(words(c)) + F.floor(F.length(c) / 8).cast("int")


def format_timestamp(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    two = lambda v: F.when(v < 100, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    hours, minutes, secs = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    tail = F.concat(two(minutes), F.lit(":"), two(secs))
    return F.when(hours > 0, F.concat(two(hours), F.lit(":"), tail)).otherwise(tail)


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    native = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    plain = "".join(str(unicodedata.decimal(ch)) for ch in native)
    return F.translate(c, "".join(native), plain)


def parse_timestamp(ts: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` to seconds, in digits of any script; anything else is null."""
    parts = F.split(ascii_digits(strip(ts)), ":")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return (
        F.when(F.size(parts) == 2, part(0) * 60 + part(1))
        .when(F.size(parts) == 3, part(0) * 3600 + part(1) * 60 + part(2))
    )


def normalize_punct(c: Column) -> Column:
    spaces = F.regexp_replace(c, r"[\u00a0\u202f\u2000-\u200b\ufeff]", " ")
    return F.regexp_replace(spaces, r"[\u2010-\u2015\u2212]", "-")


def screen_reason(query: Column, override: Sequence[str] = tuple(fixed.OVERRIDE_PATTERNS),
                  off_topic: Sequence[str] = tuple(fixed.OFF_TOPIC_PATTERNS)) -> Column:
    """Why a query is rejected before retrieval, or null if it may proceed."""
    q = F.coalesce(query, F.lit(""))
    return (
        F.when(F.length(strip(q)) < 2, "too_short")
        .when(q.rlike("(?idU)" + "|".join(override)), "jailbreak")
        .when(q.rlike("(?idU)" + "|".join(off_topic)), "off_topic")
    )


def case_category(query: Column, taxonomy: Sequence[tuple] = tuple(fixed.TAXONOMY)) -> Column:
    """First category, in taxonomy order, with a pattern that occurs in the query."""
    q = strip(query)
    return F.coalesce(*[
        F.when(q.rlike("(?idU)" + "|".join(entry[2])), F.lit(entry[0])) for entry in taxonomy
    ])


def script_of(text: Column, english_words: Sequence[str] = tuple(fixed.ENGLISH_WORDS)) -> Column:
    """``english``, ``romanised`` or ``native``."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    hits = F.size(F.filter(latin, lambda w: w.isin(list(english_words))))
    letters = F.regexp_replace(text, rf"[^{WORD_CHAR}]|\p{{Nd}}", "")
    ascii_letters = F.length(F.regexp_replace(letters, "[^a-zA-Z]", ""))
    return (
        F.when((F.size(latin) > 0) & (F.try_divide(hits, F.size(latin)) >= fixed.ENGLISH_SHARE), "english")
        .when((F.length(letters) > 0) & (F.try_divide(ascii_letters, F.length(letters)) >= fixed.ROMANISED_SHARE), "romanised")
        .otherwise("native")
    )


def _at_word_edges(body: str) -> str:
    return rf"(?iu)(?<![{WORD_CHAR}])(?:{body})(?![{WORD_CHAR}])"


def replace_terms(c: Column, lexicon: dict[str, str], phrases: Sequence[tuple[str, str]] = ()) -> Column:
    """Dictionary terms, longest first, then phrase patterns; each hit is set off by spaces."""
    out = strip(F.lower(c))
    for term in _longest_first(lexicon):
        out = F.regexp_replace(out, _at_word_edges(_escape(term)), f" {_literal(lexicon[term])} ")
    for pattern, native in phrases:
        out = F.regexp_replace(out, _at_word_edges(pattern.replace(r"\b", "")), f" {_literal(native)} ")
    return squeeze(out)


def normalize_query(c: Column, lexicon: dict[str, str] | None = None,
                    phrases: Sequence[tuple[str, str]] | None = None,
                    english_words: Sequence[str] = tuple(fixed.ENGLISH_WORDS)) -> Column:
    """English passes through, romanised text goes through the lexicon, native text is only put in NFC."""
    lexicon = fixed.LEXICON if lexicon is None else lexicon
    phrases = fixed.PHRASES if phrases is None else phrases
    text = F.coalesce(c, F.lit(""))
    script = script_of(text, english_words)
    return (
        F.when(script == "english", strip(text))
        .when(script == "romanised", replace_terms(text, lexicon, phrases))
        .otherwise(strip(nfc(text)))
    )


def contains_any(columns: Sequence[Column], needle: Column, tags: Column | None = None) -> Column:
    """Case-insensitive substring in any column or any tag; an empty needle matches everything."""
    q = F.lower(strip(needle))
    hit = q == ""
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    if tags is not None:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(q)), F.lit(False))
    return hit


def highlight(c: Column, needle: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    if not needle:
        return c
    return F.regexp_replace(c, "(?iu)" + _escape(needle), f"{before}$0{after}")


def strip_echoed_question(c: Column, labels: Sequence[str] = tuple(fixed.QUESTION_LABELS)) -> Column:
    """Drop a question that an answer repeats at its start, and a rule left at the top."""
    label = rf"\A\s*\*{{0,2}}(?:{'|'.join(_escape(x) for x in labels)})\s*[:：]\*{{0,2}}"
    # the block ends at a rule or blank line that is followed by visible text
    out = strip(F.regexp_replace(strip(c), rf"(?iU){label}[\s\S]*?(?:-{{3,}}\s*|\n{{2,}})(?=\S)", ""))
    quoted = "[\"“'‘][^\"”'’\\n]+[\"”'’]"
    out = strip(F.regexp_replace(out, rf"(?iU){label}\s*{quoted}\s*(?:-{{3,}}\s*|\n+)", ""))
    return strip(F.regexp_replace(out, r"(?U)\A\s*-{3,}\s*\n+", ""))


def is_refusal(answer: Column, phrases: Sequence[str] = tuple(fixed.REFUSAL_PHRASES)) -> Column:
    """No section heading, and some phrase that says the sources do not cover it."""
    said = F.lit(False)
    for phrase in phrases:
        said = said | answer.contains(phrase)
    return ~answer.contains("###") & said


def video_id_of(ref: Column) -> Column:
    clean = strip(ref)
    found = F.regexp_extract(clean, r"(?:v=|/|youtu\.be/)([0-9A-Za-z_-]{11})", 1)
    return F.when(found != "", found).otherwise(clean)


def channel_by_rules(name: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First rule whose needle occurs in the lower-cased name."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(needle), F.lit(ch)) for needle, ch in rules], F.lit(default))


def title_case(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
