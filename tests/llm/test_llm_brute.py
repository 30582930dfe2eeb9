"""Queries and stages that SQL can't express, row by row against plain Python on the smallest tables."""

import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from chronotext.llm import compression, rules
from chronotext.llm.queries import QUERIES
from chronotext.registry.base import table


def test_quality_scores(spark, sf_dir):
    """Dictionaries, curve and scores of op5_quality worked out again from the texts of its training rows."""
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in texts}
    labels = table(spark, sf_dir, "labels").withColumn("h", F.xxhash64(F.lit(5), "doc_id")).collect()
    known = sorted((r.h, r.doc_id, r.quality) for r in labels if r.quality is not None and not held[r.doc_id])
    compressors = []
    for label in (1, 0):
        of_texts = []
        for _, d, _ in [k for k in known if k[0] % 2 == 0 and k[2] == label][:compression.DICTIONARY_DOCS]:
            raw = (texts[d] or "").encode()
            cut = [raw[i:i + compression.PIECE] for i in range(0, len(raw), compression.PIECE)]
            of_texts.append([p for _, _, p in sorted(
                (xxhash.xxh3_64_intdigest(p, seed=i), i, p) for i, p in enumerate(cut))])
        assert sum(map(len, sum(of_texts, []))) < compression.DICTIONARY_BYTES
        longest = max(map(len, of_texts))
        content = b"\n".join(t[i] for i in range(longest) for t in of_texts if i < len(t))
        compressors.append(zstandard.ZstdCompressor(
            level=compression.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))

    def difference(text):
        good, bad = (len(c.compress((text or "").encode())) for c in compressors)
        return (bad - good) / (bad + good)

    # at so few rows no class is sampled, so all weights are one
    seen = [(difference(texts[d]), y) for h, d, y in known if h % 2]
    x, y = np.array(seen, dtype=float).T
    scale, w = x.std(), np.zeros(2)
    a = np.column_stack([x / scale, np.ones_like(x)])
    for _ in range(20_000):  # plain gradient ascent on the penalised likelihood
        w += 0.02 * (a.T @ (y - 1 / (1 + np.exp(-a @ w))) - 1e-3 * w)
    got = QUERIES["op5_quality"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = 1 / (1 + np.exp(-(w[0] * difference(texts[r.doc_id]) / scale + w[1])))
        assert r.held_out == held[r.doc_id] and r.predicted == int(r.score >= 0.5)
        assert r.score == pytest.approx(want, abs=1e-3)


def test_quality_rules_kept(spark, sf_dir):
    """``kept`` of op10_quality_rules by an interpreter that reads the learned rules one after another."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = rules.train(docs.select("doc_id", "text"), labels)
    assert learned
    want = {}
    for r in rules.judge(docs.select("doc_id", "text"), learned).collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        thirds = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        twice = {t for t in thirds if thirds.count(t) > 1} if len(thirds) < 4000 else None
        if twice is not None:
            inside = {j for i, t in enumerate(thirds) if t in twice for j in (i, i + 1, i + 2)}
            assert r.n_repeat_words == len(inside)
        failed = len(ws) < 50 or 100 * r.n_repeat_words > 50 * len(ws)
        verdict = not failed
        for rule in learned if verdict else []:
            values = [(float(np.asarray(rules.FEATURES[f](lambda c, r=r: np.float64(r[c])))), op, at) for f, op, at in rule]
            if all(v <= at if op == "<=" else v > at for v, op, at in values):
                verdict = False
                break
        want[r.doc_id] = (failed, verdict)
    got = {r.doc_id: (r.base_failed, r.kept) for r in QUERIES["op10_quality_rules"](spark, sf_dir).collect()}
    assert got == want and {k for _, k in got.values()} == {True, False}


def test_near_duplicates_stage(spark, sf_dir):
    """The stage keeps the smallest id of every group linked at 0.8 of five-word shingles, and only those."""
    docs = table(spark, sf_dir, "documents")
    sets = {}
    for r in docs.collect():
        low = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[r.doc_id] = {tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = sorted(d for d in sets if find(d) == d)
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns and len(want) < len(sets)
    assert sorted(r.doc_id for r in got.collect()) == want
