"""Language of words and texts by a linear-chain conditional random field over code-switched text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import fresh, give_back, small_batches

SAMPLE_DOCS = 300     # documents per language that the model is fitted on, at most
TOTAL_DOCS = 24_000   # documents it is fitted on, at most: of more than 80 languages each has an equal share
LEXICON = 400         # frequent words per language that are features of their own
BUCKETS = 1 << 16
CHAIN, CHAINS, STEPS = 40, 64, 160
REMEMBERED = 50_000
CELLS = 1 << 20      # words times labels of a batch of chains, with padding
BATCH_CHARS = 2 << 20
NONE = "und"
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Labels, weights of hashed features, transition scores, and the lexicon's words with their feature numbers."""

    labels: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, tuple[int, ...]]


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(LETTERS.findall(word))


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, and the place of the word that each belongs to.

    Prefixes of one to three letters, suffixes of one to four, two- and three-letter sequences with the word's ends,
    all hashed by polynomials over the letters' code points, and the word's entries in the lexicon. A word without
    letters has none.
    """
    spelled = [letters_of(w) for w in words]
    size = np.array([len(w) for w in spelled], dtype=np.int64)
    code = np.frombuffer("".join(f"^{w}$" for w in spelled).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = code.astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size + 2)[:-1]]).astype(np.int64) if len(words) else size
    owner = np.repeat(np.arange(len(words)), size + 2)
    place = np.arange(len(code)) - first[owner]
    numbers, owners = [], []

    def add(kind: int, starts: np.ndarray, n: int, of: np.ndarray) -> None:
        h = np.full(len(starts), np.uint64(kind + 1))
        with np.errstate(over="ignore"):
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[starts + i]
            h ^= h >> np.uint64(29)
            h = h * np.uint64(0xBF58476D1CE4E5B9)
        numbers.append(((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(of)

    for n in (2, 3):
        pick = np.flatnonzero((place + n <= size[owner] + 2) & (size[owner] > 0))
        add(n, pick, n, owner[pick])
    for n in (1, 2, 3, 4):
        long = np.flatnonzero(size >= n)
        if n < 4:
            add(10 + n, first[long] + 1, n, long)
        add(20 + n, first[long] + 1 + size[long] - n, n, long)
    extra = [(i, f) for i, w in enumerate(spelled) for f in lexicon.get(w, ())]
    numbers.append(np.array([f for _, f in extra], dtype=np.int64))
    owners.append(np.array([i for i, _ in extra], dtype=np.int64))
    return np.concatenate(numbers), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Scores of each word for each label: its features' weights over the root of their number; 0 without letters."""
    flat, owner = features(words, model.lexicon)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(words)), 1))
    return np.stack([np.bincount(owner, weights=model.weights[flat, y], minlength=len(words)) * scale
                     for y in range(len(model.labels))], axis=1)


def forward_backward(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Posterior of each label at each place for chains (place, chain, label), the longest chain first.

    Values are scaled every few steps only: what a step can lose is bounded by the scores. Past a chain's end the
    result has no meaning.
    """
    steps, chains, _ = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(trans - trans.max())
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains that reach beyond each place
    fwd = np.ones_like(e)
    fwd[0] = e[0]
    for t in range(1, steps):
        n = active[t]
        f = fwd[t, :n]
        np.matmul(fwd[t - 1, :n], a, out=f)
        f *= e[t, :n]
        if t % 4 == 0:
            f /= f.sum(axis=1, keepdims=True)
    b = np.ones((chains, e.shape[2]), dtype=e.dtype)
    back = np.ascontiguousarray(a.T)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        b[:n] = (e[t + 1, :n] * b[:n]) @ back
        if t % 4 == 0:
            b[:n] /= b[:n].sum(axis=1, keepdims=True)
        fwd[t] *= b
    return fwd / fwd.sum(axis=2, keepdims=True)


def fit(texts: list[tuple[str, str]], seed: int = 3) -> Model:
    """Fit on (text, label) pairs: chains of spans from texts of different labels, so that switches are learned.

    Stochastic gradient of the chain likelihood: expected minus observed features from forward-backward.
    """
    labels = tuple(sorted({y for _, y in texts}))
    docs = [(w, labels.index(y)) for t, y in texts if (w := words_of(t))]
    counts = [Counter() for _ in labels]
    for w, y in docs:
        counts[y].update(map(letters_of, w))
    lexicon: dict[str, list[int]] = {}
    for y, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if w:
                lexicon.setdefault(w, []).append(BUCKETS + y)
    frozen = {w: tuple(v) for w, v in lexicon.items()}
    k = len(labels)
    weights, trans = np.zeros((BUCKETS + k, k)), np.zeros((k, k))
    model = Model(labels, weights, trans, frozen)
    if not docs or k < 2:
        return model
    rng = np.random.default_rng(seed)
    by = [[w for w, y in docs if y == c] for c in range(k)]
    by = [b for b in by if b]
    names = sorted({y for _, y in docs})
    square_w, square_t = np.full_like(weights, 1e-3), np.full_like(trans, 1e-3)
    for _ in range(STEPS):
        words, gold = [], np.empty((CHAIN, CHAINS), dtype=int)
        for c in range(CHAINS):
            t = 0
            while t < CHAIN:
                y = int(rng.integers(len(by)))
                doc = by[y][int(rng.integers(len(by[y])))]
                n = min(int(rng.integers(4, 30)), len(doc), CHAIN - t)
                at = int(rng.integers(len(doc) - n + 1))
                words.extend(doc[at:at + n])
                gold[t:t + n, c] = names[y]
                t += n
        flat, row = features(words, frozen)
        root = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(words)), 1))
        emit = np.zeros((len(words), k))
        np.add.at(emit, row, weights[flat])
        emit = (emit * root[:, None]).reshape(CHAINS, CHAIN, k).transpose(1, 0, 2)
        post, pair = _expected(emit, trans)
        post -= np.eye(k)[gold]
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        delta = post.transpose(1, 0, 2).reshape(len(words), k) * root[:, None] / CHAINS
        grad = np.zeros_like(weights)
        np.add.at(grad, flat, delta[row])
        square_w += grad ** 2
        weights -= 0.3 * grad / np.sqrt(square_w)
        grad_t = (pair - seen) / CHAINS
        square_t += grad_t ** 2
        trans -= 0.1 * grad_t / np.sqrt(square_t)
    return model


def _expected(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label posteriors and expected transition counts of full chains."""
    steps, chains, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(trans - trans.max())
    fwd, bwd = np.empty_like(e), np.ones_like(e)
    fwd[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        f = (fwd[t - 1] @ a) * e[t]
        fwd[t] = f / f.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (e[t + 1] * bwd[t + 1]) @ a.T
        bwd[t] = b / b.sum(axis=1, keepdims=True)
    post = fwd * bwd
    post /= post.sum(axis=2, keepdims=True)
    both = fwd[:-1, :, :, None] * a * (e[1:] * bwd[1:])[:, :, None, :]
    both /= both.sum(axis=(2, 3), keepdims=True)
    return post, both.sum(axis=(0, 1))


class Tagger:
    """Posteriors for whole texts; words' scores are remembered, a fixed number of them."""

    def __init__(self, model: Model) -> None:
        self.model, self.index, self.scores = model, {}, np.zeros((0, len(model.labels)), dtype=np.float32)

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.index, self.scores = {}, self.scores[:0]
        new = list({w for d in docs for w in d if w not in self.index})
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            parts = [emissions(new[i:i + 5_000], self.model).astype(np.float32) for i in range(0, len(new), 5_000)]
            self.scores = np.concatenate([self.scores, *parts])
        return [np.fromiter(map(self.index.__getitem__, d), dtype=np.int64, count=len(d)) for d in docs]

    def label_mass(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, over its words with letters, the mean posterior of each label and the mean of the largest one.

        Both are 0 where it has no words.
        """
        k = len(self.model.labels)
        out, sure = np.zeros((len(texts), k)), np.zeros(len(texts))
        docs = [words_of(t) for t in texts]
        rows = self.rows(docs)
        order = sorted((i for i in range(len(docs)) if docs[i]), key=lambda i: -len(docs[i]))
        at = 0
        while at < len(order):
            longest = len(docs[order[at]])
            part = order[at:at + max(1, min(256, CELLS // (longest * k)))]
            at += len(part)
            emit = np.zeros((longest, len(part), k), dtype=np.float32)
            lengths = np.array([len(rows[i]) for i in part])
            for c, i in enumerate(part):
                emit[:lengths[c], c] = self.scores[rows[i]]
            mask = np.arange(longest)[:, None] < lengths[None, :]
            post = forward_backward(emit, self.model.transitions.astype(np.float32), lengths)
            lettered = mask & (emit != 0).any(axis=2)
            lettered |= mask & ~lettered.any(axis=0)  # words whose scores are all 0: count every word
            mass = (post * lettered[:, :, None]).sum(axis=0) / lettered.sum(axis=0)[:, None]
            out[part] = mass
            sure[part] = np.where(lettered, post.max(axis=2), 0).sum(axis=0) / lettered.sum(axis=0)
        return out, sure


def predict(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score, confidence) of a text: the label with the largest mean posterior over its words, that
    mean, and the mean over the words of each one's own largest posterior, which is high in mixed texts as well.

    ``und`` with score and confidence 0 for null texts and texts without a letter, and where no label was learned.
    """
    model = replace(model, weights=model.weights.astype(np.float32))

    @F.pandas_udf("lang_pred string, score double, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for texts in batches:
            names, scores, sure = [NONE] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            while lettered and model.labels:
                n = held = 0
                while n < len(lettered) and held < BATCH_CHARS:
                    held += len(texts.iloc[lettered[n]])
                    n += 1
                part, lettered = lettered[:n], lettered[n:]
                for i, m, c in zip(part, *tagger.label_mass([texts.iloc[i] for i in part]), strict=True):
                    names[i] = model.labels[int(m.argmax())]
                    scores[i], sure[i] = min(1.0, float(m.max())), min(1.0, float(c))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "confidence": sure})
        del tagger
        give_back()

    return run(text)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit from labelled documents: of each label those with the smallest hashes of the key.

    Every label that occurs is learned, from SAMPLE_DOCS documents, or from an equal share of TOTAL_DOCS where there
    are many labels; the driver holds no more, and more labels than TOTAL_DOCS are refused. Null labels, keys and texts
    are ignored; one label alone, or none, gives a model without preferences.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    labels = usable.select(lang).distinct().limit(TOTAL_DOCS + 1).count()
    if not labels:
        return fit([])
    if labels > TOTAL_DOCS:
        raise ValueError(f"more than {TOTAL_DOCS} labels")
    h = F.xxhash64(F.lit(3), F.col(key))
    first = Window.partitionBy("y").orderBy("h", "k")
    sample = usable.select(F.col(key).alias("k"), h.alias("h"), F.col(lang).alias("y")).withColumn(
        "place", F.row_number().over(first)).where(F.col("place") <= min(SAMPLE_DOCS, TOTAL_DOCS // labels)).drop("place")
    rows = usable.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("y")).join(
        F.broadcast(sample.dropDuplicates(["k", "y"])), ["k", "y"]).toPandas()
    rows = rows.sort_values(["h", "k", "y", "t"])
    return fit(list(zip(rows["t"], rows["y"], strict=True)))


def tag(docs: DataFrame, model: Model, text: str = "text", confidence: bool = False) -> DataFrame:
    """All columns of the documents with lang_pred and score, and confidence if asked for; nothing shuffles.

    New columns get free names where they clash.
    """
    small_batches(docs.sparkSession)
    made = ["lang_pred", "score", *(["confidence"] if confidence else [])]
    held, *names = fresh(docs.columns, "_tag", *made)
    return docs.withColumn(held, predict(model, F.col(text))).select(
        *docs.columns, *[F.col(f"{held}.{c}").alias(n) for c, n in zip(made, names, strict=True)])
