"""Ids of whole texts by the tokenizers library, remembered by word."""

from __future__ import annotations

import json
import os
import re
import sys
import weakref
from array import array
from functools import lru_cache

REMEMBERED_BYTES = 64 << 20  # of words and their ids, with what Python needs to hold them
ENTRY_BYTES = 160
# fixed value: how the byte-level pre-tokenizer cuts a text
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str) -> str:
    """Where the public vocabulary file is installed on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def pack(ids: list[int], code: str = "I") -> bytes:
    """Ids as little-endian unsigned numbers of 32 bits, or of 16 with code H."""
    out = array(code, ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies spell bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def plain_merges(spec: dict):
    """The same merges in tiktoken, which applies them to a word several times faster; None if they don't carry over.

    They do where ids follow the order of the merges, so that the lowest id is the first merge.
    """
    import tiktoken

    letters = byte_letters()
    added = {t["content"] for t in spec.get("added_tokens") or []}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    order = [vocab.get("".join(m), -1) for m in merges]
    if spec["model"].get("end_of_word_suffix") or spec["model"].get("ignore_merges") or order != sorted(order) or any(
            c not in letters for t in vocab for c in t) or len(vocab) != len(set(order)) + 256:
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("merges", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: weakref.WeakSet[TextEncoder] = weakref.WeakSet()


def forget_words() -> None:
    """Empty the memories of all encoders of this process; their vocabularies stay."""
    for e in _ENCODERS:
        e.forget()


class TextEncoder:
    """Encode texts with a tokenizer file; the result is the library's, at several times its speed.

    With the byte-level pre-tokenizer a single blank or newline between two characters that are no white space
    always ends a pre-token, whatever stands around it. So a text is cut there, each distinct word is encoded once,
    and the ids are joined. A word of plain letters is merged by tiktoken from the merges of the same file, any other
    by the library itself. Texts with other white space, and tokenizers of another kind, are encoded whole by it. The
    memory of words is bounded in bytes and emptied when full.
    """

    def __init__(self, path: str, code: str = "I", remembered: int = REMEMBERED_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread: Spark fills the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = code
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space") and all(
                            not (t["lstrip"] or t["rstrip"] or t["single_word"] or {" ", "\n"} & set(t["content"]))
                            for t in spec.get("added_tokens") or []))
        starts = "".join({t["content"][0] for t in spec.get("added_tokens") or []})
        self.plain = re.compile(f"(?:(?![{re.escape(starts)}])[!-~\u00c0-\u017f])+" if starts else "[!-~\u00c0-\u017f]+")
        self.merges = plain_merges(spec) if self.by_word else None
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        _ENCODERS.add(self)
        self.newline = pack(self.tokenizer.encode("\n", add_special_tokens=False).ids, code)
        self.remembered, self.held = remembered, 0

    def forget(self) -> None:
        self.first.clear()
        self.later.clear()
        self.held = 0

    def learn(self, words: list[str], known: dict[str, bytes | None], lead: str) -> None:
        """Add the unknown words; None marks one that can't stand alone, for want of a safe edge."""
        code, plain, merge = self.code, self.plain.fullmatch, self.merges and self.merges.encode_ordinary
        for w in words:
            if w not in known:
                if merge and plain(w):
                    known[w] = pack(merge(lead + w), code)
                elif w and w[0].isprintable() and w[-1].isprintable():
                    known[w] = pack(self.tokenizer.encode(lead + w, add_special_tokens=False).ids, code)
                else:
                    known[w] = None
                self.held += ENTRY_BYTES + 2 * len(w) + len(known[w] or b"")

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.by_word and text:
            if self.held > self.remembered:
                self.forget()
            lines = [line.split(" ") for line in text.split("\n")]
            heads = [line.pop(0) for line in lines]
            for retry in (False, True):
                try:
                    return self.newline.join([
                        self.first[head] + b"".join(map(self.later.__getitem__, rest))
                        for head, rest in zip(heads, lines, strict=True)])
                except KeyError:  # at least one new word: learn all of the text's at once
                    if not retry:
                        self.learn(heads, self.first, "")
                        self.learn([w for line in lines for w in line], self.later, " ")
                except TypeError:  # a word that can't stand alone
                    break
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids, self.code)


@lru_cache(maxsize=4)
def encoder(path: str, code: str = "I") -> TextEncoder:
    """One encoder per worker and file; the words it remembers are dropped after each task: see ``tidy``."""
    return TextEncoder(path, code)


def narrowest(path: str) -> str:
    """The code that holds every id of a tokenizer file: H (16 bits) or I (32)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    last = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])])
    return "H" if last < 1 << 16 else "I"
