"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import collections
import hashlib
import io
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotext.llm import (bpe, compression, language, line_dedup, ngram_join, packing, rules, sharding, token_files,
                            vectors)
from chronotext.llm.common import Scratch, components
from chronotext.llm.tokens import TextEncoder, default_path, pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, kept string, _part int"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["a  b", " x", "x ", "\n", "a\n\nb", "a \n b", "", "don't WE'LL 12 3a", "x<|endoftext|> y <|endoftext|>\nz",
       "é İI ß ſªº", "日本 語 ǅ ŉ", "a\tb\x1c\x85d", "́ x", "ab" * 3000, "\U0001f600‍ ok", "١٢ ⅷ", None]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(
        rng.randrange(40)) for _ in range(n))


def rows_with_edges(seed=1, n=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 90)) for _ in range(n)] + ["", None, " \n\t", words(rng, 9000), *ODD]
    texts += [texts[0], texts[0], "one two", "one two"]
    out = [(i, t, "en", "s", 0, i, "k", 3) for i, t in enumerate(texts)]
    out += [(None, "one two three four five", None, None, None, None, None, None)] * 2
    out += [(5, texts[5], "en", "s", 0, 5, "k", 3), (5, "another text with id five", "en", "s", 0, 5, "k", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_with_edges(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(25)]
    edges += [(None, 3), (7, 7)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    seen = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in seen}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_hypergeometric_law(spark):
    p = spark.range(4000).select(sharding.hypergeometric(
        F.lit(50), F.lit(20), F.lit(15), (F.col("id") + 0.5) / 4000).alias("x")).toPandas()["x"]
    rng = np.random.default_rng(1).hypergeometric(20, 30, 15, 400_000)
    for k in range(0, 16):
        assert abs((p == k).mean() - (rng == k).mean()) < 0.004
    edge = spark.range(1).select(*[sharding.hypergeometric(*map(F.lit, a), F.lit(0.7)) for a in (
        (10, 10, 4), (10, 0, 4), (10, 3, 0), (10, 3, 10), (1, 1, 1))]).first()
    assert list(edge) == [4, 0, 0, 3, 1]


def test_shards(docs, none):
    got = sharding.uniform_shards(docs, 7).toPandas()
    want = docs.toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(want) and sizes.max() - sizes.min() <= 1 and set(sizes.index) == set(range(7))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    raw = [(t or "").encode() for t in want["text"]]
    assert sorted(zip(got["size"], got["text_crc32"])) == sorted((len(b) + 8, zlib.crc32(b)) for b in raw)
    assert sharding.uniform_shards(none, 7).count() == 0
    few = sharding.uniform_shards(docs.limit(3), 7).toPandas()
    assert sorted(few["slot"]) == [0, 0, 0] and few["shard"].nunique() == 3


def test_matrix_has_exact_sums(spark):
    counts = spark.createDataFrame([(i, 3 + i % 11) for i in range(150)], "part long, rows long")
    total = sum(3 + i % 11 for i in range(150))
    sizes = [total // 5 + (s < total % 5) for s in range(5)]
    m = sharding.communication_matrix(counts, sizes, 1, Scratch(spark, "t")).collect()
    assert {r["part"]: sum(r["shards"]) for r in m} == {i: 3 + i % 11 for i in range(150)}
    assert [sum(r["shards"][s] for r in m) for s in range(5)] == sizes
    assert min(min(r["shards"]) for r in m) >= 0


def test_text_encoder_equals_library():
    path = default_path(BYTE)
    library = Tokenizer.from_file(path)
    for code in "IH":
        encode = TextEncoder(path, code, remembered=50)
        for t in ODD + [words(random.Random(i), 40) for i in range(30)]:
            assert encode(t) == pack(library.encode(t or "", add_special_tokens=False).ids, code)


def check_pieces(got, want, window):
    cover, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        cover[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, want))
    assert sorted(seqs) == list(range(len(seqs)))
    padded = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    assert padded == 0


def test_packing(docs, none):
    path, window = default_path(BYTE), 64
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 1, window).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in docs.toPandas()["text"]]
    check_pieces(got, ids, window)
    left = collections.Counter(tuple(x) for x in ids)
    by = collections.defaultdict(list)
    for r in docs.collect():
        by[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    for r in got:  # each piece is what its document has there
        part = list(struct.unpack(f"<{r['length']}H", r["ids"]))
        assert any(x[r["start"]:r["start"] + r["length"]] == part for x in by[r["doc_id"]])
    assert left and packing.pack_documents(none, path, 1, window).count() == 0


def test_packing_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(0)
    for n in (0, 5, 3000):
        hist = np.bincount(rng.integers(1, 128, n), minlength=128)
        hist[100] += 2000
        plan, used = packing.plan_windows(hist, 128)
        assert (used <= hist).all() and all(sum(p) == 128 for p, _ in plan)
        again = np.zeros_like(hist)
        for p, k in plan:
            for v in p:
                again[v] += k
        assert (again == used).all()
    assert used[:100].sum() > 0.5 * hist[:100].sum()  # most documents stay whole


def test_wide_crc(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<3H", 1, 2, 60000)), 3), (bytearray(struct.pack(
        "<2I", 1, 70000)), 2)], "ids binary, n long")
    got = [r[0] for r in df.select(packing.wide_crc(F.col("ids"), F.col("n"))).collect()]
    assert got == [zlib.crc32(struct.pack("<3I", 1, 2, 60000)), zlib.crc32(struct.pack("<2I", 1, 70000))]


def test_token_files(spark, docs, none):
    path = default_path(BYTE)
    library = Tokenizer.from_file(path)
    scratch = Scratch(spark, "t")
    files = scratch.write(token_files.write_token_files(docs, f"{scratch.root}/f", path, 2), "m")
    got = token_files.read_token_files(files).collect()
    want = collections.Counter((r["doc_id"], pack(library.encode(r["text"] or "", add_special_tokens=False).ids + [2]))
                               for r in docs.collect())
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    known = [i for i in ordered if i is not None]
    assert known == sorted(known) and ordered[-1] is None
    some = token_files.read_token_files(files, [5, 7]).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 5, 5, 7]
    assert token_files.round_trip(spark, none, path, 2).count() == 0


def test_token_file_frames():
    store = io.BytesIO()
    w = token_files.Writer(store, frame_bytes=40)
    docs = [(i, pack(list(range(i)))) for i in range(12)] + [(None, b"")]
    for d in docs:
        w.add(*d)
    w.close()
    raw = store.getvalue()
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    assert [(d, b) for d, _, b in reader.documents()] == docs

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counting.taken += 1
            return super().read(n)

    few = token_files.Reader(Counting(raw), len(raw))
    Counting.taken = 0
    assert [d for d, *_ in few.documents([9, 9, 400])] == [9] and Counting.taken == 1
    bad = bytearray(raw)
    bad[12] ^= 255
    with pytest.raises(Exception):
        list(token_files.Reader(io.BytesIO(bytes(bad)), len(bad)).documents())


def test_bpe(spark, docs, none):
    path = default_path(WORD)
    library = Tokenizer.from_file(path)
    got = collections.Counter(map(tuple, bpe.encode_words(docs, path, digest=True).collect()))
    want = collections.Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(pack(ids)).hexdigest(), hashlib.sha256(
            library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_words(none, path).count() == 0
    one = bpe.encode_words(spark.createDataFrame([(1, "Low lower", 1)], "doc_id long, text string, ids int"), path)
    r = one.first()
    assert r["ids"] == library.encode("Low lower").ids and r["decoded"] == library.decode(r["ids"])


def test_merge_is_leftmost_lowest():
    rng = random.Random(2)
    for _ in range(200):
        pairs = {}
        for rank in range(rng.randrange(1, 12)):
            pairs.setdefault(rng.randrange(4) << 32 | rng.randrange(6), (rank, 4 + rng.randrange(4)))
        pairs = {k: (r, v) for r, (k, (_, v)) in enumerate(pairs.items())}
        word = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        plain = list(word)
        while True:
            hits = [(pairs[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << 32 | b in pairs]
            if not hits:
                break
            i = min(hits)[1]
            plain[i:i + 2] = [pairs[plain[i] << 32 | plain[i + 1]][1]]
        assert bpe.merge(list(word), pairs) == plain
        assert bpe.Merges(pairs).merge_all([list(word), [1]]) == [plain, [1]]


def brute_lines(rows):
    """Later occurrences of three-line windows, over rows in order of (id, position)."""
    places = collections.defaultdict(list)
    for i, t in rows:
        a = (t or "").split("\n")
        for p in range(len(a) - 2):
            if "".join(a[p:p + 3]).strip():
                places[tuple(a[p:p + 3])].append((i, p))
    gone = collections.defaultdict(set)
    for where in places.values():
        for i, p in sorted(where)[1:]:
            gone[i] |= {p, p + 1, p + 2}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) if gone[i] else t
            for i, t in rows}


def test_line_dedup(spark, none):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(7)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n\n"), (104, "a\nb"), (105, "x\n" * 3000)]
    df = spark.createDataFrame([(i, t, i, "h", 0) for i, t in rows],
                               "doc_id long, text string, _hash long, n_lines string, _k int").repartition(4)
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute_lines([r for r in rows if r[1] is not None])
    assert {i: r["text"] for i, r in got.items()} == {**want, 100: None}
    for i, r in got.items():
        n = len((dict(rows)[i] or "").split("\n")) if dict(rows)[i] is not None else 0
        kept = 0 if r["n_removed"] == n else len(r["text"].split("\n")) if r["text"] is not None else 0
        assert r["_n_lines"] == n and r["n_removed"] == n - kept
    assert line_dedup.drop_repeated_lines(none).count() == 0
    # repeated rows are one document; null ids come last
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((r["text"] for r in line_dedup.drop_repeated_lines(twice).collect())) == ["a\nb\nc", "a\nb\nc", "d"]


def brute_groups(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            p, q = sets[a][1], sets[b][1]
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k][1]), min(ids, default=None)) for k in members]
    return collections.Counter(out)


def near_rows(seed, n=40, variants=50):
    rng = random.Random(seed)
    rows = [(100 + i, words(rng, rng.randrange(1, 40))) for i in range(n)]
    base = words(rng, 60).split(" ")
    for i in range(variants):  # a cloud of near copies, some of them near each other only
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        rows.append((500 + i, " ".join(w)))
    for i in range(30):  # short ones, at the light end
        w = words(random.Random(seed * 100 + i // 3), 6 + i // 3 % 9).split(" ")
        if i % 3:
            w.append(f"tail{i % 3}")
        rows.append((700 + i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "One two"), (906, "Éa"),
             (907, "éa"), (None, "one"), (None, "only null here"), (100, rows[0][1]), (100, "other text"),
             (908, words(rng, 5000))]
    return rows


@pytest.mark.parametrize("setup", [(4, 85, {}), (5, 80, {}), (4, 85, {
    "COMMON": 3, "SHORT_LIST": 2, "BLOCK": 8, "ROUNDS": 1}), (3, 60, {"SEND_IDS": 0, "ROUNDS": 0, "COMMON_KEPT": 0}), (4, 85, {
        "COMMON": 2, "SHORT_LIST": 1, "BLOCK": 4, "BLOCK_ITEMS": 200, "ROUNDS": 0}), (5, 80, {
            "COMMON": 1 << 20, "SHORT_LIST": 1, "BLOCK": 5, "ROUNDS": 1})])
def test_ngram_join(spark, monkeypatch, setup):
    width, percent, changed = setup
    for k, v in changed.items():
        monkeypatch.setattr(ngram_join, k, v)
    rows = near_rows(width)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, n string")
    got = ngram_join.near_duplicates(df.repartition(4), width, percent).collect()
    assert collections.Counter(map(tuple, got)) == brute_groups(rows, width, percent)


def test_light_sets_with_too_small_an_overlap(spark):
    """Ten words and another last word: 6 of 8 shingles. Such texts link only through a common base of nine words."""
    rng = np.random.default_rng(12)
    for width, percent in ((4, 85), (5, 80)):
        rows = []
        for n in range(width + 1, 20):
            base = [f"x{v}" for v in rng.integers(0, 10 ** 9, n)]
            for text in (base[:-1] + ["one"], base[:-1] + ["two"], base[:-2] + ["three"], ["four"] + base[1:]):
                rows.append((len(rows), " ".join(text)))
            if n % 3 == 0:
                rows.append((len(rows), " ".join(base[:-1])))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert collections.Counter(map(tuple, ngram_join.near_duplicates(df, width, percent).collect())) == (
            brute_groups(rows, width, percent))
    two = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")]
    df = spark.createDataFrame(two, "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.near_duplicates(df).collect()} == {(1, 7, 1), (2, 7, 2)}


def test_ngram_join_keeps_one(spark, none):
    rows = near_rows(9)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    named = {(i, c) for i, _, c in brute_groups(rows, 5, 80)}
    assert {r["doc_id"] for r in out.collect()} == {i for i, c in named if i == c}
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.keep_one(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "A b c d e f")], "doc_id long, text string")
    assert [r["doc_id"] for r in ngram_join.keep_one(twice).collect()] == [1]


def test_light_boundary_and_overlaps():
    for a in range(1, 40):
        for b in range(1, 40):
            o = ngram_join.least_overlap(a, b, 85)
            assert 100 * o >= 85 * (a + b - o) and not 100 * (o - 1) >= 85 * (a + b - o + 1)
    assert ngram_join.light_boundary(1.0, 85) <= ngram_join.light_boundary(50.0, 85) <= ngram_join.LIGHT_MAX


def brute_vectors(rows, least):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    links = {k: [j for j in ok if j != k and ok[k] @ ok[j] >= least] if k in ok else [] for k in range(len(rows))}
    out, seen = collections.Counter(), {}
    for k in range(len(rows)):
        if k not in seen:
            todo, comp = [k], set()
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += links[x]
            seen |= {x: comp for x in comp}
        c = min((rows[x][0] for x in seen[k] if rows[x][0] is not None), default=None)
        out[rows[k][0], len(links[k]), c, rows[k][0] is not None and rows[k][0] == c] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_vectors(spark, monkeypatch, small):
    if small:
        for k, v in {"BLOCK": 7, "SEEK_BLOCK": 11, "CELL_ROWS": 9, "FIT_ROWS": 60}.items():
            monkeypatch.setattr(vectors, k, v)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.3).tolist()) for i in range(220)]
    rows += [(300, rows[0][1]), (301, [3 * x for x in rows[0][1]]), (302, None), (303, [0.0] * 8), (304, [1.0, None] * 4),
             (305, [float("nan")] * 8), (306, [float("inf")] + [0.0] * 7), (307, [1.0, 2.0]), (308, []),
             (None, rows[1][1]), (7, rows[3][1]), (309, [1e200] * 8), (310, [1e-200] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = vectors.near_vectors(df.repartition(3)).collect()
    want = brute_vectors(rows, 0.95)
    extreme = {309, 310}  # brute force over- or underflows there; both point the same way
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] in extreme} == {309: 309, 310: 309}
    assert collections.Counter(tuple(r) for r in got if r["vec_id"] not in extreme) == collections.Counter(
        {k: n for k, n in want.items() if k[0] not in extreme})
    none = spark.createDataFrame([], df.schema)
    assert vectors.near_vectors(none).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(df.where("vec_id = 302")).collect()] == [(302, 0, 302, True)]


def test_statistics_by_hand():
    s = dict(zip(rules.STATS, rules.statistics("a b c a b c\na b c a b c\n\nx# 1&\n")))
    assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"]) == (14, 16, 2, 1)
    rng = random.Random(3)
    for _ in range(100):
        w = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {i + d for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for d in range(3)}
        assert rules.statistics(" ".join(w))[4] == len(cover)
    assert set(rules.statistics(None)) == {0} and set(rules.statistics("")) == {0}


def test_rules(spark, docs, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(rng, 120) if not bad else " ".join(["#$%"] * 30 + words(rng, 60).split(" "))
        rows.append((i, text))
        labels.append((i, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    learned = rules.train(df, lab)
    got = {r["doc_id"]: r["kept"] for r in rules.judge(df, learned).collect()}
    assert learned and sum(got[i] == bool(q) for i, q in labels) > 0.97 * len(labels)
    judged = rules.judge(docs, learned)
    assert judged.columns[:len(docs.columns)] == docs.columns and judged.columns[-1] == "_kept"
    assert judged.count() == docs.count() and judged.where("text is null and not base_failed").count() == 0
    assert rules.judge(none, learned).count() == 0
    assert rules.train(df, lab.limit(0)) == [] and rules.train(none, lab) == []
    assert rules.judge(df, []).where("kept").count() == 400


def test_compression(spark, docs, none):
    rng = random.Random(8)
    rows = [(i, words(rng, 80) if i % 3 else " ".join(["buy now", "click"][rng.randrange(2)] for _ in range(60)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(None, 1), (4, None)],
                                "doc_id long, quality int")
    model = compression.train(df, lab)
    got = {r[0]: r[1] for r in df.select("doc_id", compression.score(model, F.col("text"))).collect()}
    unseen = range(1, 300, 2)
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in unseen]) > 0.95
    scores = [r[0] for r in docs.select(compression.score(model, F.col("text"))).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    flat = compression.train(df, lab.limit(0))
    assert {r[0] for r in df.select(compression.score(flat, F.col("text"))).collect()} == {0.5}
    assert none.select(compression.score(model, F.col("text"))).count() == 0


def test_compression_learns_from_whole_texts(spark, monkeypatch):
    """Bad texts that begin with clean prose, which alone fills their share of the dictionary."""
    monkeypatch.setattr(compression, "DICTIONARY_BYTES", 8000)
    rng = random.Random(9)
    bad = [" ".join(f"{rng.choice('qxz')}{rng.randrange(10 ** 6)}" for _ in range(6)) for _ in range(10)]
    rows = [(i, words(rng, 60) + " " + (words(rng, 120) if i % 2 else " ".join(rng.choices(bad, k=20))))
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i, _ in rows if i < 300], "doc_id long, quality int")
    model = compression.train(df, lab)
    assert any(b.encode() in model.bad for b in bad) and len(model.bad) <= 8000
    scores = df.where("doc_id >= 300").select("doc_id", compression.score(model, F.col("text"))).collect()
    assert sum((s >= 0.5) == bool(i % 2) for i, s in scores) >= 0.9 * len(scores)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    k, n = 3, 7
    emit, trans = rng.normal(size=(n, 2, k)), rng.normal(size=(k, k))
    got = language.forward_backward(emit, trans, np.array([n, 3]))
    for c, length in ((0, n), (1, 3)):
        total, by = 0.0, np.zeros((length, k))
        for path in np.ndindex(*[k] * length):
            p = np.exp(sum(emit[t, c, y] for t, y in enumerate(path)) + sum(
                trans[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                by[t, y] += p
        assert np.allclose(got[:length, c], by / total)


def test_language(spark, docs, none):
    rng = random.Random(5)
    vocab = {"en": ["the", "and", "thing", "where", "other"], "fr": ["le", "eau", "quelle", "notre", "étaient"],
             "de": ["der", "und", "schön", "zwischen", "heit"]}
    rows = [(i, " ".join(rng.choice(vocab[y]) for _ in range(30)), y) for i, y in enumerate(list(vocab) * 60)]
    df = spark.createDataFrame([*rows, (None, "x", "en"), (900, None, "fr"), (901, "le", None)],
                               "doc_id long, text string, lang string")
    model = language.train(df)
    got = {r["doc_id"]: r for r in language.tag(df, model).collect()}
    assert all(got[i]["lang_pred"] == y for i, _, y in rows)
    mixed = ["the and thing where other " * 3 + "le eau quelle notre étaient " * 3]
    post = language.forward_backward(language.emissions(mixed[0].split(), model)[:, None], model.transitions,
                                     np.array([30]))[:, 0].argmax(axis=1)
    names = [model.labels[i] for i in post]
    assert names[:12] == ["en"] * 12 and names[18:] == ["fr"] * 12  # words of a code-switched text
    odd = language.tag(docs.withColumnRenamed("source", "score"), model)
    assert odd.columns[-2:] == ["lang_pred", "_score"] and odd.count() == docs.count()
    for r in odd.collect():
        assert 0 <= r["_score"] <= 1
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["_score"]) == ("und", 0.0)
    assert language.tag(none, model).count() == 0
    empty = language.train(none)
    assert {r["lang_pred"] for r in language.tag(df, empty).collect()} == {"und"}
    assert json.dumps(model.labels)


@pytest.mark.parametrize("dim, leading, cosine, decay", [
    (64, 64, 0.951, 0.0), (64, 2, 0.951, 0.5), (384, 384, 0.951, 0.7), (384, 4, 0.951, 0.7), (384, 4, 0.97, 0.7),
    (768, 1, 0.951, 0.7)])
def test_vectors_lose_no_link_in_any_direction(spark, monkeypatch, dim, leading, cosine, decay):
    """Pairs a little above the threshold, displaced in the leading directions of a falling spectrum."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    rng = np.random.default_rng(dim + leading)
    spectrum = np.arange(1, dim + 1.0) ** -decay
    x = rng.normal(size=(400, dim)) * spectrum
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape) * spectrum * (np.arange(dim) < leading)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine ** 2) * off])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df).collect()}
    want = (s >= 0.95).sum(axis=1)
    assert want.min() >= 1 and got == dict(enumerate(want.tolist()))


def test_vectors_of_several_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.1]), (5, [1.0]), (6, [3.0]),
            (7, [-1.0]), (8, []), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_vectors_recall_with_many_cells(spark, monkeypatch):
    """Against brute force: links just above the threshold, in directions of their own."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 15)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(150, 64))
    x = np.repeat(centres, 4, axis=0)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + rng.normal(size=x.shape) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df).agg(F.sum("n_links")).first()[0]
    want = int((s >= 0.95).sum())
    assert want > 1000 and 0.9 * want <= got <= want


def test_token_files_keep_the_smallest_id(spark, tmp_path):
    rows = [(-(1 << 63), "one two"), (None, "none"), ((1 << 63) - 1, ""), (0, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = default_path("byte_bpe_50k.json")
    files = token_files.write_token_files(df.repartition(3), f"file://{tmp_path}/files", path, 2).collect()
    stored = spark.createDataFrame(files, "part long, file string, docs long, tokens long")
    got = token_files.read_token_files(stored)
    assert got.rdd.getNumPartitions() == len(files)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect())) == sorted(
        (i is None, i or 0) for i, _ in rows)
    assert {r["doc_id"] for r in token_files.read_token_files(stored, [0, -(1 << 63)]).collect()} == {0, -(1 << 63)}
