"""Quality rules: text statistics and a decision list learned from labels by sequential covering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import fresh, give_back, small_batches

SAMPLE_DOCS = 4000      # labelled documents per class that the rules are learned from, at most
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper",
         "n_digits", "n_stops"]


def statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in STATS for a whole text; all are 0 for a null text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    repeat = 0
    if len(counts) < len(windows):
        covered = 0  # words before this place are counted or passed
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeat += i + 3 - max(covered, i)
                covered = i + 3
    chars = len(text) - sum(map(text.count, BLANKS))
    return (n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, lines, len(set(words)),
            sum(map(str.isupper, text)), sum(map(text.count, "0123456789")), sum(map(text.count, ".!?")))


def stats_column(text: Column) -> Column:
    """A struct of STATS, computed over whole texts in Arrow batches."""
    @F.pandas_udf(", ".join(f"{s} long" for s in STATS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=STATS, dtype="int64")
        give_back()

    return run(text)


def base_failed(s: Callable[[str], Column]) -> Column:
    return (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > MAX_REPEAT_PERCENT * s("n_words"))


# what conditions may test: the same arithmetic on numbers, arrays and columns; nothing divides by zero
FEATURES: dict[str, Callable] = {
    "words": lambda s: s("n_words") * 1.0,
    "chars_per_word": lambda s: s("word_chars") * 1.0 / (s("n_words") + 1),
    "symbols_per_word": lambda s: s("n_symbols") * 1.0 / (s("n_words") + 1),
    "repeated_lines": lambda s: s("n_dup_lines") * 1.0 / (s("n_lines") + 1),
    "repeated_words": lambda s: s("n_repeat_words") * 1.0 / (s("n_words") + 1),
    "distinct_words": lambda s: s("n_distinct") * 1.0 / (s("n_words") + 1),
    "words_per_line": lambda s: s("n_words") * 1.0 / (s("n_lines") + 1),
    "upper_per_char": lambda s: s("n_upper") * 1.0 / (s("word_chars") + 1),
    "digits_per_char": lambda s: s("n_digits") * 1.0 / (s("word_chars") + 1),
    "stops_per_word": lambda s: s("n_stops") * 1.0 / (s("n_words") + 1),
}

Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold
Rule = list[Condition]


def holds(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for feature, op, at in rule:
        out &= values[feature] <= at if op == "<=" else values[feature] > at
    return out


def grow(values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, depth: int) -> Rule:
    """Add the condition with the best information gain until the rule is pure."""
    rule: Rule = []
    inside = np.ones(len(bad), dtype=bool)
    for _ in range(depth):
        p0, all0 = weight[inside & bad].sum(), weight[inside].sum()
        if not p0 or p0 / all0 > 0.999:
            break
        best, chosen = 1e-9, None
        for name, column in values.items():
            x = column[inside]
            order = np.argsort(x, kind="stable")
            x, w, b = x[order], weight[inside][order], bad[inside][order]
            total, hits = np.cumsum(w), np.cumsum(w * b)
            cut = np.flatnonzero(x[1:] > x[:-1])
            if len(cut) > 400:
                cut = cut[np.linspace(0, len(cut) - 1, 400).astype(int)]
            for op in ("<=", ">"):
                p, t = (hits[cut], total[cut]) if op == "<=" else (hits[-1] - hits[cut], total[-1] - total[cut])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2((p + 1e-9) / t) - np.log2(p0 / all0)), 0)
                if len(gain) and gain.max() > best:
                    i = cut[int(gain.argmax())]
                    best, chosen = float(gain.max()), (name, op, float((x[i] + x[i + 1]) / 2))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= holds([chosen], values, len(bad))
    return rule


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[Rule, float, float]:
    """The beginning of the rule that does best on rows it was not grown on; its precision and weight there."""
    best: tuple[float, Rule, float, float] = (-2.0, [], 0.0, 0.0)
    for k in range(len(rule), 0, -1):
        hit = holds(rule[:k], values, len(bad))
        p, t = weight[hit & bad].sum(), weight[hit].sum()
        worth = (2 * p - t) / t if t else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p / t if t else 0.0, t)
    return best[1], best[2], best[3]


def learn(values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, fold: np.ndarray,
          precision: float = 0.9, max_rules: int = 12, depth: int = 3) -> list[Rule]:
    """Rules for bad texts, in order: grow on two thirds, prune on the rest, drop what is covered, repeat.

    A rule is kept if it is right for ``precision`` of the held-out weight that it covers; the first one that is not
    ends the list. ``weight`` restores the shares of the classes where they were sampled unequally.
    """
    rules: list[Rule] = []
    open_rows = np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules and (open_rows & bad).sum() >= 10:
        g, h = open_rows & (fold != 2), open_rows & (fold == 2)
        rule = grow({k: v[g] for k, v in values.items()}, bad[g], weight[g], depth)
        rule, right, covered = prune(rule, {k: v[h] for k, v in values.items()}, bad[h], weight[h])
        if not rule or right < precision or not covered:
            break
        rules.append(rule)
        open_rows &= ~holds(rule, values, len(bad))
    return rules


def keeps(rules: list[Rule], s: Callable[[str], Column]) -> Column:
    """The list as one ordered conditional expression: the first rule that fires rejects, else the text is kept."""
    out = None
    for rule in rules:
        fires = F.lit(True)
        for feature, op, at in rule:
            v = FEATURES[feature](s)
            fires = fires & (v <= at if op == "<=" else v > at)
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> list[Rule]:
    """Learn the list from (key, label 0 / 1) rows: per class the SAMPLE_DOCS with the smallest hashes of the key.

    Null keys and labels are ignored. Without labels, or without bad ones, the list is empty and keeps all texts.
    """
    h = F.xxhash64(F.lit(10), F.col(key))
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(key).alias("k"), F.col(label).cast("int").alias("y"), h.alias("h"))
    totals = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    sample = usable.where("y = 0").orderBy("h", "k").limit(SAMPLE_DOCS).unionByName(
        usable.where("y = 1").orderBy("h", "k").limit(SAMPLE_DOCS))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")
    rows = rows.select("k", "y", "h", stats_column(F.col("t")).alias("s")).select("k", "y", "h", "s.*").toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(["h", "k", *STATS], ignore_index=True)
    bad = rows["y"].to_numpy() == 0
    share = {c: totals.get(c, 0) / max(int((rows["y"] == c).sum()), 1) for c in (0, 1)}
    values = {k: np.asarray(f(lambda c: rows[c].to_numpy(dtype=float))) for k, f in FEATURES.items()}
    fold = (rows["h"].to_numpy() % 3).astype(int)
    return learn(values, bad, np.where(bad, share[0], share[1]), fold)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All columns of the documents and the statistics, base_failed and kept, under free names where they clash.

    A text fails the base rules with under MIN_WORDS words (null and empty ones do) or if more than half of its words
    lie in repeated three-word windows. Nothing is shuffled; rows are judged one by one, so repeated rows, null keys
    and an empty table need no rule of their own.
    """
    small_batches(docs.sparkSession)
    held, *names = fresh(docs.columns, "_stats", *STATS, "base_failed", "kept")
    with_stats = docs.withColumn(held, stats_column(F.col(text)))

    def stat(c: str) -> Column:
        return F.col(f"{held}.{c}")

    failed = base_failed(stat)
    return with_stats.select(*docs.columns, *[stat(s).alias(n) for s, n in zip(STATS, names, strict=False)],
                             failed.alias(names[-2]), (~failed & keeps(rules, stat)).alias(names[-1]))
