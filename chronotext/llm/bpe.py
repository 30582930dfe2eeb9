"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.tokens import pack

REMEMBERED = 200_000
NO_PAIR = 1 << 62
BATCH_CHARS = 2 << 20


def merge(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until no adjacent pair can be merged.

    ``pairs`` gives rank and result by ``left << 32 | right``. A segment tree holds the minimum over the pairs' keys
    rank * n + place, so that its root, at index 1, is the leftmost pair of the lowest rank. A symbol keeps the place
    of its left part; places that are merged away drop out of the linked order. A merge changes at most three leaves,
    and an update climbs to the first ancestor that stays as it is: n log n steps in all.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    find = pairs.get
    half = 1 << (n - 2).bit_length()
    tree = [NO_PAIR] * (2 * half)
    left = symbols[0]
    for i in range(n - 1):
        right = symbols[i + 1]
        hit = find(left << 32 | right)
        if hit is not None:
            tree[half + i] = hit[0] * n + i
        left = right
    for i in range(half - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != NO_PAIR:
        i = top % n
        j = after[i]
        symbols[i] = find(symbols[i] << 32 | symbols[j])[1]
        k = after[i] = after[j]
        changed = [(j, NO_PAIR)] if j < n - 1 else []
        if k < n:
            before[k] = i
            hit = find(symbols[i] << 32 | symbols[k])
            changed.append((i, NO_PAIR if hit is None else hit[0] * n + i))
        else:
            changed.append((i, NO_PAIR))
        h = before[i]
        if h >= 0:
            hit = find(symbols[h] << 32 | symbols[i])
            changed.append((h, NO_PAIR if hit is None else hit[0] * n + h))
        for at, key in changed:
            at += half
            tree[at] = key
            while at > 1:
                other = tree[at ^ 1]
                low = other if other < key else key
                at >>= 1
                if tree[at] == low:
                    break
                tree[at] = key = low
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class Merges:
    """Pair ranks as arrays, and ``merge`` for many short words at once: one segment tree per row."""

    def __init__(self, pairs: dict[int, tuple[int, int]]) -> None:
        self.pairs = pairs
        keys = np.array(list(pairs), dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(NO_PAIR))
        self.ranks = np.append(np.array([r for r, _ in pairs.values()], dtype=np.int64)[order], np.int64(-1))
        self.results = np.zeros(len(pairs), dtype=np.int64)
        self.results[self.ranks[:-1]] = np.array([i for _, i in pairs.values()], dtype=np.int64)[order]

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Keys of pairs; NO_PAIR where a symbol is missing (negative) or the pair has no merge."""
        want = left << 32 | right
        at = np.searchsorted(self.keys, want)
        hit = (self.keys[at] == want) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at] * width + place, NO_PAIR)

    def merge_rows(self, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Merge each row of ``sym`` (its first ``n`` symbols, then -1) in place; returns what is left as a mask."""
        rows, width = sym.shape
        half = width - 1
        places = np.arange(width)
        tree = np.full((rows, 2 * half), NO_PAIR, dtype=np.int64)
        tree[:, half:] = self.leaf(sym[:, :-1], sym[:, 1:], places[:-1], width)
        h = half // 2
        while h:
            tree[:, h:2 * h] = np.minimum(tree[:, 2 * h:4 * h:2], tree[:, 2 * h + 1:4 * h:2])
            h //= 2
        after = np.broadcast_to(places + 1, sym.shape).copy()
        before = np.broadcast_to(places - 1, sym.shape).copy()
        alive = places < n[:, None]
        live = np.arange(rows)
        while True:
            top = tree[live, 1]
            live, top = live[top != NO_PAIR], top[top != NO_PAIR]
            if not len(live):
                return alive
            i = top % width
            j = after[live, i]
            k = after[live, j]
            merged = self.results[top // width]
            sym[live, i] = merged
            alive[live, j] = False
            after[live, i] = k
            inner = k < n[live]
            before[live[inner], k[inner]] = i[inner]
            right = np.where(inner, sym[live, np.minimum(k, half)], -1)
            back = before[live, i]
            left = np.where(back >= 0, sym[live, np.maximum(back, 0)], -1)
            last = j < half
            self.update(tree, live[last], j[last], np.full(int(last.sum()), NO_PAIR))
            self.update(tree, live, i, self.leaf(merged, right, i, width))
            has = back >= 0
            self.update(tree, live[has], back[has], self.leaf(left, merged, back, width)[has])

    @staticmethod
    def update(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
        at = place + tree.shape[1] // 2
        tree[rows, at] = key
        while at.size and at[0] > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """``merge`` of every word; words of like length share an array, long ones are merged one by one."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        low = 1
        for half in (4, 8, 16, 32):
            pick = np.flatnonzero((sizes >= low) & (sizes <= half + 1))
            low = half + 2
            for part in np.array_split(pick, len(pick) // 4096 + 1):
                if len(part):
                    sym = np.full((len(part), half + 1), -1, dtype=np.int64)
                    inside = np.arange(half + 1) < sizes[part][:, None]
                    sym[inside] = [i for w in part for i in words[w]]
                    alive = self.merge_rows(sym, sizes[part])
                    flat, ends = sym[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
                    begin = 0
                    for w, end in zip(part.tolist(), ends, strict=True):
                        out[w] = flat[begin:end]
                        begin = end
        for w in np.flatnonzero(sizes >= low):
            out[w] = merge(words[w], self.pairs)
        return out


# fixed value: how the pre-tokenizer cuts a lower-case text of plain letters
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"
PLAIN_WORD = r"[!-;=-~À-ÖØ-öø-ÿ]+"


class Memory(dict):
    """A dictionary that forgets what two generations in a row did not ask for."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def __contains__(self, key: str) -> bool:
        return dict.__contains__(self, key) or key in self.old

    def __missing__(self, key: str):
        value = self[key] = self.old[key]
        return value

    def age(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Encode and decode with the merges of a tokenizers file that splits at white space.

    The file's own normaliser and pre-tokenizer cut a text into pieces; the merging is this module's. As white space
    never survives them, each word between blanks or newlines is worked out once and remembered, as long as it comes
    up among a fixed number of later ones. Words of plain Latin letters are cut by the same pattern directly.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, base = spec["model"], Tokenizer.from_file(path)
        self.normalise, self.pre = base.normalizer, base.pre_tokenizer
        cut = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        norm = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        if model["type"] != "BPE" or norm != ["NFC", "Replace", "Lowercase"] or not (cut and cut[0] and cut[0].endswith(
                r"[^\s\p{L}\p{N}]+")) or model.get("unk_token") or spec.get("decoder"):
            raise ValueError("not a word-level BPE file of the expected kind")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.spell = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges({self.vocab[a] << 32 | self.vocab[b]: (r, self.vocab[a + b])
                              for r, (a, b) in enumerate(merges)})
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.plain, self.pieces = re.compile(PLAIN_WORD), re.compile(PLAIN_PIECES)
        letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in letters]
        self.letter = {b: chr(b) for b in letters} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.remembered = remembered
        self.words = Memory(remembered)
        self.merged = Memory(remembered)

    def symbols(self, spelled: str) -> list[int]:
        vocab = self.vocab
        return [vocab[c] for c in [*spelled[:-1], spelled[-1] + self.suffix] if c in vocab]

    def cut(self, word: str) -> list[str | int]:
        """The pre-tokens of a word in byte letters; the id of a special token where one is spelled out."""
        if self.plain.fullmatch(word):
            letter = self.letter
            return [p if p.isascii() else "".join([letter[b] for b in p.encode()])
                    for p in self.pieces.findall(word.lower())]
        out, at = [], 0
        for hit in [*self.cut_special.finditer(word), None]:
            part = word[at:hit.start() if hit else len(word)]
            if part:
                out += [p for p, _ in self.pre.pre_tokenize_str(self.normalise.normalize_str(part))]
            if hit:
                out.append(self.special[hit.group()])
                at = hit.end()
        return out

    def learn(self, words: set[str]) -> None:
        """Work out unknown words: cut them, and merge all pieces that are unknown, many at once."""
        cuts = {w: self.cut(w) for w in words}
        new = list({p for c in cuts.values() for p in c if isinstance(p, str) and p not in self.merged})
        for p, ids in zip(new, self.merges.merge_all([self.symbols(p) for p in new]), strict=True):
            self.merged[p] = pack(ids), self.decode(ids).encode()
        for w, c in cuts.items():
            found = [self.merged[p] if isinstance(p, str) else (pack([p]), self.spell[p].encode()) for p in c]
            self.words[w] = found[0] if len(found) == 1 else (
                b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[1]]))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids as little-endian unsigned 32-bit numbers, and the decoded text in UTF-8."""
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        known = self.words
        new = {w for w in set().union(*cut) if w not in known}
        self.learn(new)
        out = []
        for words in cut:
            found = [known[w] for w in words]
            out.append((b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[1]])))
        known.age()
        self.merged.age()
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library decodes where a file names no decoder: the tokens, joined by blanks."""
        return " ".join([self.spell[i] for i in ids])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_words(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 digest: bool = False) -> DataFrame:
    """(key, n_tokens, ids array, decoded) of every whole text; with ``digest`` SHA-256 sums in place of the two.

    A null text is empty: no ids and an empty decoded text. Null and repeated keys and repeated rows give a row each.
    An empty table gives no rows. Other columns are not looked at. Nothing is shuffled; batches are bounded in bytes.
    """
    def emit(keys: list[int | None], rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        ids, plain = zip(*rows, strict=True)
        cols = [pa.array(keys, pa.int64()), pa.array([len(b) // 4 for b in ids], pa.int64())]
        if digest:
            cols += [pa.array([hashlib.sha256(b).hexdigest() for b in part]) for part in (ids, plain)]
        else:
            cols += [pa.array([array("I", b).tolist() for b in ids], pa.list_(pa.int64())),
                     pa.array([b.decode() for b in plain])]
        return pa.RecordBatch.from_arrays(cols, names=names)

    names = [key, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer).encode
        for batch in batches:
            keys, texts, size = [], [], 0
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(doc)
                texts.append(words.as_py())
                size += len(texts[-1] or "")
                if size > BATCH_CHARS:
                    yield emit(keys, encode(texts))
                    keys, texts, size = [], [], 0
            if keys:
                yield emit(keys, encode(texts))

    kinds = "string, decoded_sha256 string" if digest else "array<long>, decoded string"
    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(
        run, f"`{key}` long, n_tokens long, {names[2]} {kinds}")
