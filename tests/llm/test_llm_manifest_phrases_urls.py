"""The Merkle manifest, collocations and URL rules against plain versions of the same definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronotext.llm import merkle, phrases, url_rules


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, arity):
    """Root and, for each leaf, the list of (left, right) digests from the leaf up."""
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(place):
            run = level[i - i % arity:i - i % arity + arity]
            paths[k].append(("".join(run[:i % arity]), "".join(run[i % arity + 1:])))
            place[k] = i // arity
        level = [sha("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def plain_manifest(rows, arity):
    """rows of (doc_id, source, leaf) -> multiset of (doc_id, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for doc, source, leaf in rows:
        groups[source].append((doc is not None, doc or 0, leaf, doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])], arity) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names], arity)
    out = Counter()
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(sorted(groups[s], key=lambda r: r[:3]), trees[s][1], strict=True):
            out[r[3], r[2], trees[s][0], root, "".join(a + b for a, b in path + top)] += 1
    return out


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest(spark, many_partitions, arity):
    draw = random.Random(arity)
    rows = [(i, draw.choice(["a", "a", "a", "é", "Z", "zz"]), f"t{i}") for i in range(60)]
    rows += [(None, "a", "n"), (5, None, "x"), (7, "a", "t7"), (7, "a", "t7"), (7, "a", "other"), (1, "", "e"),
             (2, "only", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, path int, _g int")
    df = df.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("text"))).repartition(5)
    got = merkle.manifest(df, "source", ["doc_id"], "leaf", arity)
    assert got.columns == ["doc_id", "source", "text", "path", "_g", "leaf", "subroot", "root", "_path"]
    made = got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("_path")).alias("p"),
                      merkle.fold(F.col("leaf"), F.col("_path")).alias("f"),
                      merkle.fold(F.lit(sha("changed")), F.col("_path")).alias("w")).collect()
    assert all(r["f"] == r["root"] != r["w"] for r in made)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = plain_manifest([(d, s, sha(field(d) + field(t))) for d, s, t in rows], arity)
    assert Counter(tuple(r)[:5] for r in made) == want


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(1, "a", sha("x"))], "doc_id long, source string, leaf string")
    row = merkle.manifest(one, "source", ["doc_id"], "leaf").first()
    assert row["subroot"] == row["root"] == sha("x") and row["path"] == []
    assert merkle.manifest(one.limit(0), "source", ["doc_id"], "leaf").count() == 0


def plain_collocations(docs, least, kept):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i:i + n])] += 1
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        lost = {q[i:i + m] for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)
                if 100 * b >= 100 * f[q[i:i + m]]}
        rows = []
        for p in found.keys() - lost:
            best = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((best[0], f[p], " ".join(p), f[p[:best[1]]], f[p[best[1]:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out |= {(lang, i + 1, r[2], r[1], r[3], r[4], totals[lang], r[0]) for i, r in enumerate(rows[:kept])}
    return out


@pytest.mark.parametrize("least, kept", [(1, 50), (3, 2000), (12, 2000)])
def test_collocations(spark, many_partitions, monkeypatch, least, kept):
    draw = random.Random(least)
    words = ["the", "The", "of", "a", "a", "xü", "b\x01", "b", "b\x08c", "\x00", "z", "a\x0e", "\u00a0", "日本", "-", "q,", "r.", "s\n",
             "t\t", "u \t", "'"]
    docs = [(draw.choice(["en", "en", "en", "de", None, "und", ""]), " ".join(draw.choices(words, k=draw.randrange(60))))
            for _ in range(150)]
    docs += [("en", None), ("en", ""), ("fr", " \t\n"), ("en", "the of " * 400), ("en", "the of " * 400),
             ("en", "x x x x x x x x"), (None, "the the the")]
    df = spark.createDataFrame([(*d, i, "y") for i, d in enumerate(docs)], "lang string, text string, rank int, key string")
    got = phrases.collocations(df.repartition(6), least=least, kept=kept)
    assert {tuple(r) for r in got.collect()} == plain_collocations(docs, least, kept)


def test_words_of_long_texts_are_cut_at_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
    text = "one two three four, five six seven eight nine ten; " * 5 + "eleven " * 30
    parts = list(phrases.chunks(pa.array(["en", "en", None]), pa.array([text, "a b", None])))
    assert {lang for lang, _ in parts} == {"en"} and len(parts) > 3
    seen = Counter()
    for _, part in parts:
        w = phrases.Words(part)
        for n in (1, 3):
            seen.update(str(p) for p in w.phrases((w.left >= n).nonzero()[0], n))
    want = Counter()
    for whole in (text, "a b"):
        for piece in re.split("[,;]", whole):
            ws = piece.split()
            want.update("\t".join(ws[i:i + n]) for n in (1, 3) for i in range(len(ws) - n + 1))
    assert seen == want


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(empty, least=0)


def plain_verdict(url, rules):
    tail = url.split("://", 1)[1] if url is not None and "://" in url else None
    m = re.match(r"([^/?#]*)([^?#]*)(.*)", tail or "", re.S)
    host = "".join(c.lower() if c.isascii() else c for c in m[1])
    held = []
    for name, pattern, verdict, tier in rules:
        body = pattern[2:] if pattern.startswith("||") else pattern
        rx = "".join(".*" if c == "*" else "(?:[^A-Za-z0-9]|$)" if c == "^" else re.escape(c) for c in body)
        if pattern.startswith("||"):
            hit = re.search(r"\A//(?:[^/?#]*\.)?" + rx, "//" + host + m[2], re.S)
        else:
            hit = re.search(rx, "//" + host + m[2] + m[3], re.S | re.I | re.A)
        if hit and tail is not None:
            held.append((-tier, -len(pattern), verdict, pattern, name or ""))
    if not held:
        return host, m[2], None, None, "allow"
    best = min(held)
    return host, m[2], best[4] or None, best[3], best[2]


RULES = [("org/", "||org/", "allow", 1), ("example.org/en/1", "||example.org/en/1", "block", 1),
         ("b.example.org/", "||b.example.org/", "block", 1), ("com/Fr/", "||com/Fr/", "allow", 1),
         (None, "^pills^", "block", 0), (None, "-cheap-pills.", "allow", 0), (None, "/ads/*/id=", "block", 0),
         (None, "^free^*^bets^", "block", 0), (None, "||x+y.net/(a)", "block", 0), (None, "^pills^", "block", 0),
         (None, "||never.seen/", "block", 2), ("tie", "^free^casino", "allow", 0), ("tie", "^casino^win", "block", 0)]
URLS = [None, "", "example.org/en/1", "http://example.org", "http://example.org/", "HTTP://B.Example.ORG/en/12?x#y",
        "http://notexample.org/en/1", "http://a.b.example.org/en/1", "x://y.org://z/", "http://a.com/Fr/", "http://a.com/fr/",
        "http://best-cheap-pills.net/a", "http://pills.com", "http://a.com/q?z=pills", "http://a.net/ads/12/k?id=4",
        "http://a.net/adsx/12/k?id=4", "http://free.net/a/BETS", "http://x+y.net/(a)b", "http://x+y.net/a", "://", "http://",
        "http:///org/", "http://org?", "http://a.\u212Aills.net/", "http://pills\n.net/", "http://free.casino.win/", "http://é.org/"]


def test_urls(spark, many_partitions):
    rules = url_rules.rule_table(spark, RULES)
    rows = [(i, u, "h", 1) for i, u in enumerate(URLS)] + [(99, URLS[5], "h", 1)] * 3 + [(None, URLS[6], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _best int")
    got = url_rules.judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "host", "_best", "_host", "path", "rule", "pattern", "verdict"]
    want = Counter((*r, *plain_verdict(r[1], RULES)) for r in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_many_rules_against_many_urls(spark, many_partitions):
    draw = random.Random(1)
    labels = ["a", "bb", "ccc", "d1", "e", "shop", "www", "news"]
    urls = [f"http://{'.'.join(draw.choices(labels, k=3))}/{'/'.join(draw.choices(labels, k=2))}?{draw.choice(labels)}=1"
            for _ in range(300)]
    rules = [(f"r{i}", "||" + ".".join(draw.choices(labels, k=draw.choice([1, 2]))) + "/" + draw.choice(
        ["", draw.choice(labels) + "/"]), draw.choice(["allow", "block"]), 1) for i in range(60)]
    rules += [(None, draw.choice(["^{}^", "/{}/*e", "^{}=1", ".{}.*^"]).format(draw.choice(labels)), draw.choice(
        ["allow", "block"]), 0) for _ in range(30)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Counter(tuple(r) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == Counter((u, *plain_verdict(u, rules)) for u in urls)


@pytest.mark.parametrize("pattern", ["*ads*", "ads", "||ad", "^*^"])
def test_rules_without_a_whole_token_are_refused(spark, pattern):
    pages = spark.createDataFrame([("http://ads.net/",)], "url string")
    with pytest.raises(Exception, match="no whole literal token"):
        url_rules.judge_urls(pages, url_rules.rule_table(spark, [(None, pattern, "block", 0)])).collect()
