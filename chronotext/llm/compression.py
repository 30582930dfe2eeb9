"""Quality score from compression: how much better a text compresses against good than against bad writing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICTIONARY_BYTES = 4_000_000  # per class: whole texts, unless they have more than 6,666 bytes on average
TEXT_BYTES = 110_000          # of one text, from all places of it
PIECE = 160             # bytes of a text that enter a dictionary together
DICTIONARY_DOCS = 600   # per class, at most
CALIBRATION_DOCS = 3000  # per class, at most
LEVEL = 9


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the logistic curve over the size difference."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0


@lru_cache(maxsize=4)
def packers(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    out = []
    for content in (good, bad):
        args = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if content:
            args["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            args["dict_data"].precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(**args))
    return tuple(out)


def difference(model: Model, text: str | None) -> float:
    """(bad - good) / (bad + good) of the compressed sizes; above 0 the good dictionary helps more."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    good, bad = (len(p.compress(raw)) for p in packers(model.good, model.bad))
    return (bad - good) / (bad + good)


def differences(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([difference(model, t) for t in texts], dtype="float64")

    return run(text)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Weighted logistic regression on one number by Newton's method with a small ridge."""
    scale = float(x.std()) or 1.0
    a = np.column_stack([x / scale, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def pieces(text: str | None) -> list[bytes]:
    """The whole text in pieces, in the order of a hash, so that the first ones come from any place of it.

    Of a text longer than TEXT_BYTES so much is returned.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    cut = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]
    order = sorted(range(len(cut)), key=lambda i: xxhash.xxh3_64_intdigest(cut[i], seed=i))
    return [cut[i] for i in order[:-(-TEXT_BYTES // PIECE)]]


def dictionary(texts: list[list[bytes]]) -> bytes:
    """One piece of each text in turn, then a second of each, and so on: shares grow where texts are few or short."""
    return b"\n".join(p for turn in zip_longest(*texts) for p in turn if p)[:DICTIONARY_BYTES]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Build dictionaries and curve from (key, label 0 / 1) rows.

    The labelled rows are halved by a hash of the key: one half gives the dictionaries, the other, which they have
    not seen, the curve. Of each half and class the rows with the smallest hashes are taken, up to DICTIONARY_DOCS and
    CALIBRATION_DOCS. A dictionary has up to DICTIONARY_BYTES, in pieces drawn from all places of its texts, and the
    driver holds up to TEXT_BYTES of each text. Null keys and labels are ignored. Without any
    label the curve is flat and every score is 0.5; where only one class occurs, scores lean to it.
    """
    h = F.xxhash64(F.lit(5), F.col(key))
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(key).alias("k"), F.col(label).cast("int").alias("y"), h.alias("h"),
        (F.pmod(h, F.lit(2)) == 0).alias("first"))
    picked, totals = [], {}
    for y in (0, 1):
        for first, most in ((True, DICTIONARY_DOCS), (False, CALIBRATION_DOCS)):
            picked.append(usable.where((F.col("y") == y) & (F.col("first") == first)).orderBy("h", "k").limit(most))
    for r in usable.where(~F.col("first")).groupBy("y").count().collect():
        totals[r["y"]] = r["count"]
    sample = picked[0]
    for p in picked[1:]:
        sample = sample.unionByName(p)
    cut = F.udf(pieces, "array<binary>")
    # at most 2 * (DICTIONARY_DOCS + CALIBRATION_DOCS) keys
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")
    seeds = rows.where("first").select("y", "h", "k", cut(F.col("t")).alias("t")).toPandas()
    seeds = seeds.sort_values(["h", "k"])
    model = Model(*[dictionary(list(seeds["t"][seeds["y"] == y])) for y in (1, 0)])
    seen = rows.where(~F.col("first")).select("y", differences(model, F.col("t")).alias("x")).toPandas()
    if not len(seen):
        return model
    y = seen["y"].to_numpy(dtype=float)
    counts = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    weight = np.array([totals.get(int(c), 1) / counts[int(c)] for c in y])
    slope, offset = fit_curve(seen["x"].to_numpy(dtype=float), y, weight * len(y) / weight.sum())
    return Model(model.good, model.bad, slope, offset)


def score(model: Model, text: Column) -> Column:
    """The probability that a text is good, for whole texts; null and empty texts get the score of no difference."""
    z = F.lit(model.slope) * differences(model, text) + F.lit(model.offset)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
