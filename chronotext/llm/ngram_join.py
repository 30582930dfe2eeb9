"""Size-aware heavy-light join of word n-gram sets by Jaccard similarity, and its connected components.

Light sets (few shingles) enumerate subsets: two sets share a subset of c elements if and only if they overlap in c.
A set emits the sizes c that any partner may need, so an equal subset is a link only where c is enough for the sizes
of the two; then nothing else has to be verified. What is enough for two members of a group is also enough for each
of them with its smallest member, so links to the smallest member lose none. Heavy sets scan inverted lists. Of each set only its first
shingles in one global order stand in the lists, as many as the threshold requires, and shingles that many documents
hold come last in that order. The size between light and heavy is where enumerating starts to cost more than scanning.

Only components are asked for, so lists are not turned into all their pairs. In each round a list offers its members
one partner, a leader; what links is contracted, and lists whose members all lie in one component are done. What is
then left of short lists is compared pair by pair, and long lists are compared block by block inside tasks that
return a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch, components

COMMON = 32            # shingles that so many documents hold come last in the order
COMMON_KEPT = 1 << 20  # of them at most so many are sent to the tasks, the most frequent ones: 8 MB
VERIFY_COST = 4        # a scanned entry against an enumerated subset
LIGHT_MAX = 18
SHORT_LIST = 48
BLOCK, BLOCK_ITEMS = 2048, 1 << 20  # sets of a long list, and shingles, that a task compares with as many, about
TILE = 512
ROUNDS = 3
SEND_IDS = 2_000_000   # ids broadcast at most; more are joined by a shuffle
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest overlap o of sets of sizes a and b with 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """The overlaps that a set of n elements may need with its possible partners."""
    return sorted({least_overlap(n, m, percent)
                   for m in range(-(-percent * n // 100), 100 * n // percent + 1)} & set(range(1, n + 1)))


def light_boundary(mean_list: float, percent: int) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning lists of that mean length."""
    size = 0
    for n in range(1, LIGHT_MAX + 1):
        if sum(comb(n, c) for c in subset_sizes(n, percent)) > prefix_length(n, percent) * mean_list * VERIFY_COST:
            break
        size = n
    return size


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * MIX[1]
        h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: A-Z lower-cased, words between ASCII white space.

    With fewer words than ``width`` the whole sequence is the one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(width, len(one))
    with np.errstate(over="ignore"):
        h = np.full(len(one) - k + 1, np.uint64(k))
        for i in range(k):
            h = h * MIX[0] + one[i:len(one) - k + 1 + i]
    return np.unique(mixed(h))


def node_of(s: np.ndarray) -> int:
    """Equal sets are one node, named by a hash of the set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def first_in_order(s: np.ndarray, common: np.ndarray, size: int) -> np.ndarray:
    """The first elements in the global order: rare ones by hash, then common ones by hash."""
    if not len(common):
        return s[:size]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    often = common[at] == s
    return np.concatenate([s[~often], s[often]])[:size]


def lists_of(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"),
                       F.xxhash64(F.col(text).cast("string")).alias("mark"))


def base_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, n, node, sample): set size, node, and as many smallest hashes as a prefix has, to count shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) for s in sets], pa.int64()),
                lists_of([s[:prefix_length(len(s), percent)] for s in sets]), batch.column(2)],
                names=["doc", "n", "node", "sample", "mark"])

    return docs.mapInArrow(run, "doc long, n long, node long, sample array<long>, mark long")


def signatures(docs: DataFrame, common, width: int, percent: int, light: int) -> DataFrame:
    """(kind, token, node, n): subsets of light sets (kind = their size) and list entries (kind 0) of the others.

    Light sets that a heavy one could match stand in the lists as well.
    """
    least_listed = -(-percent * (light + 1) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value
        for batch in batches:
            kinds, tokens, nodes, sizes = [], [], [], []

            def put(kind: int, part: np.ndarray, node: int, n: int) -> None:
                kinds.append(np.full(len(part), kind, dtype=np.int32))
                tokens.append(part.view(np.int64))
                nodes.append(np.full(len(part), node, dtype=np.int64))
                sizes.append(np.full(len(part), n, dtype=np.int64))

            for t in batch.column(1):
                s = shingles(t.as_py(), width)
                n = len(s)
                if not n:
                    continue
                node = node_of(s)
                if n <= light:
                    for c in subset_sizes(n, percent):
                        put(c, np.array([xxhash.xxh3_64_intdigest(s[list(p)].tobytes())
                                         for p in combinations(range(n), c)], dtype=np.uint64), node, n)
                if n >= least_listed:
                    put(0, first_in_order(s, often, prefix_length(n, percent)), node, n)
            if kinds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (kinds, tokens, nodes, sizes)],
                    names=["kind", "token", "node", "n"])

    return docs.mapInArrow(run, "kind int, token long, node long, n long")


def sets_of(docs: DataFrame, base: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, items) for the wanted nodes, worked out again from the texts of one document each."""
    want = base.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc").alias("doc"))
    few = want.count() <= SEND_IDS
    ids = want.select("doc").distinct().withColumnRenamed("doc", "wanted")
    chosen = docs.join(F.broadcast(ids) if few else ids, F.col("doc").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "items"])

    found = chosen.mapInArrow(run, "node long, n long, items binary")
    return found.join(want.select("node"), "node", "left_semi").dropDuplicates(["node"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold, by their exact overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(
        run, "a long, b long")


def plausible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and shared list entries allow the threshold.

    Whichever prefix ends first in the order, all shared shingles up to its end are entries of both; so the overlap
    is at most the shared entries and what the larger set has past its prefix.
    """
    x = heads.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("tokens").alias("x"))
    y = heads.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    most = F.greatest("n", "m")
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent) - 1e-9)
    past = F.ceil(F.lit(percent) * most / F.lit(100) - 1e-9) - 1
    return pairs.join(x, "a").join(y, "b").where(
        (100 * F.least("n", "m") >= percent * most) & (F.size(F.array_intersect("x", "y")) + past >= need)).select(
        "a", "b")


def forest(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links among the sets of one cell that join different components; a spanning forest of them is enough."""
    nodes, comp = rows["node"].to_numpy(), rows["comp"].to_numpy()
    sets = [np.frombuffer(b, dtype=np.uint64) for b in rows["items"]]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, right = rows["left"].to_numpy(), rows["right"].to_numpy()
    # shingles of one set alone can't overlap
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    met = times[code] > 1
    codes, owner = (np.cumsum(times > 1) - 1)[code[met]], owner[met]
    width = int((times > 1).sum())
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    step = max(1, (1 << 22) // len(sets))
    rows_left = np.flatnonzero(left)
    for tile in (rows_left[i:i + TILE] for i in range(0, len(rows_left), TILE)):
        both = np.zeros((len(tile), len(sets)), dtype=np.float32)
        for at in range(0, width, step):  # overlaps by products of bounded pieces of the incidence matrix
            inside = (codes >= at) & (codes < at + step)
            part = np.zeros((len(sets), min(step, width - at)), dtype=np.float32)
            part[owner[inside], codes[inside] - at] = 1
            both += part[tile] @ part.T
        hit = 100 * both >= percent * (sizes[tile, None] + sizes[None, :] - both)
        hit &= (comp[tile, None] != comp[None, :]) & right[None, :]
        for i, j in zip(*np.nonzero(hit), strict=True):
            a, b = find(int(comp[tile[i]])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(nodes[tile[i]]), int(nodes[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row: components of the links with 100 * intersection >= percent * union.

    The component is named by its smallest key. Null and empty texts and texts without words have no shingles and
    link with nothing (component: their own key). Repeated rows and equal keys with different texts are rows of their
    own; null keys take part and never name a component unless all of its keys are null (then it is null). An empty
    table gives no rows. Other columns are not looked at. No link is lost: all steps before the exact check are
    lossless filters, and the order of shingles and the constants above change cost only.
    """
    return _grouped(docs, width, percent, key, text).select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """(doc, n, component_id, mark) per row; mark is a hash of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = texts(docs, key, text)
    base = scratch.write(base_table(docs, width, percent), "base")
    counts = scratch.write(base.select(F.explode("sample").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "counts")
    stats = counts.agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    entries = base.agg(F.sum(F.size("sample"))).first()[0] or 0
    light = light_boundary(1.0 + ((stats[0] or 0) - (stats[1] or 0)) / max(entries, 1), percent)
    top = counts.where(F.col("c") >= COMMON).orderBy(F.desc("c"), "token").limit(COMMON_KEPT).select("token")
    often = np.sort(top.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))
    marks = scratch.write(signatures(docs, spark.sparkContext.broadcast(often), width, percent, light), "marks")
    entry = marks.where("kind = 0").select("token", "node", "n")
    met = entry.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    lists = scratch.write(entry.join(met, "token").distinct(), "lists")
    heads = scratch.write(lists.groupBy("node", "n").agg(F.collect_list("token").alias("tokens")), "heads")
    parts = scratch.write(components(_subset_links(marks.where("kind > 0"), percent, scratch), scratch), "parts")
    tried = scratch.write(spark.createDataFrame([], "a long, b long"), "pairs")
    sets = scratch.write(spark.createDataFrame([], "node long, n long, items binary"), "sets")

    def check(pairs: DataFrame) -> DataFrame:
        """Links among new pairs; the sets of nodes that were not needed before are fetched."""
        nonlocal tried, sets
        new = scratch.write(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(new)
        close = scratch.write(plausible(new, heads, percent), "close")
        sets = fetch(close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))))
        return linked(close, sets, percent)

    def fetch(nodes: DataFrame) -> DataFrame:
        fresh_nodes = scratch.write(nodes.distinct().join(sets.select("node"), "node", "left_anti"), "wanted")
        return sets if fresh_nodes.isEmpty() else sets.unionByName(
            scratch.write(sets_of(docs, base, fresh_nodes, width), "sets"))

    def merged(links: DataFrame) -> DataFrame:
        grown = parts.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return scratch.write(components(grown.unionByName(links), scratch), "parts")

    for turn in range(ROUNDS + 1):
        named = lists.join(parts, "node", "left").select(
            "token", "node", "n", F.coalesce("root", "node").alias("comp"))
        # a list is open while its members lie in two components; its leader changes from round to round
        open_lists = named.groupBy("token").agg(
            F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("k"),
            F.min(F.struct(F.xxhash64(F.lit(turn), "comp"), "n", "node", "comp")).alias("lead")).where("c1 <> c2")
        rows = scratch.write(named.join(open_lists.select("token", "k", "lead"), "token").select(
            "token", "node", "n", "comp", "k", F.col("lead.node").alias("leader"), F.col("lead.comp").alias("other")),
            "open")
        if rows.isEmpty():
            break
        if turn < ROUNDS:
            links = check(rows.where(F.col("comp") != F.col("other")).select(
                F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")))
        else:
            links = check(_short_pairs(rows, percent))
            many = rows.where(F.col("k") > SHORT_LIST)
            if not many.isEmpty():
                sets = fetch(many.select("node"))
                links = links.unionByName(_long_links(many, sets, percent))
        parts = merged(scratch.write(links, "links"))
    named = base.where("n > 0").select("doc", "n", "node", "mark").join(parts, "node", "left").withColumn(
        "comp", F.coalesce("root", "node"))
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    whole = named.join(least, "comp").select("doc", "n", "component_id", "mark")
    return whole.unionByName(base.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"), "mark"))


def _subset_links(subset: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of light sets to the smallest set that holds the same subset, where its size is enough for both."""
    several = subset.groupBy("kind", "token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where(
        "x <> y").select("kind", "token")
    shared = scratch.write(subset.join(several, ["kind", "token"]), "shared")
    least = shared.groupBy("kind", "token").agg(F.min(F.struct("n", "node")).alias("least"))
    return shared.join(least, ["kind", "token"]).where(
        100 * F.col("kind") >= percent * (F.col("n") + F.col("least.n") - F.col("kind"))).select(
        F.col("node").alias("a"), F.col("least.node").alias("b"))


def _short_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in short open lists: at most SHORT_LIST partners per entry."""
    short = rows.where(F.col("k") <= SHORT_LIST)
    x = short.select("token", F.col("node").alias("a"), "n", F.col("comp").alias("p"))
    y = short.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("q"))
    return x.join(y, "token").where("a < b and p <> q").where(
        100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b")


def _long_links(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in long open lists, compared in cells of two blocks of sets.

    A group of similar texts stands in many lists with nearly the same members. Members with the same lowest token
    among their long lists meet in the list of that token, so in no other one. In each list the largest such group,
    or the largest component if that has more members, is sent to the blocks of the others but not to its own.
    """
    # a node has as many rows as long lists, no more than its prefix is long
    many = many.select("token", "node", "n", "comp", F.min("token").over(Window.partitionBy("node")).alias("low"))
    whole = many.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("items"))

    def main(rows: DataFrame, by: str, out: str) -> DataFrame:
        return rows.groupBy("token", by).agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(
            F.max(F.struct("size", F.col(by).alias("of"))).alias(out))

    plan = whole.join(main(many, "comp", "c"), "token").join(main(many.where("low < token"), "low", "l"), "token", "left")
    by_low = F.coalesce(F.col("l.size") > F.col("c.size"), F.lit(False))
    size = F.when(by_low, F.col("l.size")).otherwise(F.col("c.size"))

    def blocks(n: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, n * F.col("items") / F.col("k") / BLOCK_ITEMS))

    plan = plan.select("token", by_low.alias("by_low"), F.when(by_low, F.col("l.of")).otherwise(F.col("c.of")).alias("of"),
                       blocks(size).alias("mains"), blocks(F.col("k") - size).alias("others")).where("others > 0")
    cut = many.join(plan, "token")
    inside = F.when(F.col("by_low"), F.col("low") == F.col("of")).otherwise(F.col("comp") == F.col("of"))
    h = F.xxhash64("node", "token")
    cut = cut.withColumn("own", F.when(inside, F.col("others") + F.pmod(h, F.col("mains"))).otherwise(
        F.pmod(h, F.col("others"))))
    last = F.col("others") + F.when(inside, 0).otherwise(F.col("mains")) - 1
    cell = cut.select("token", "node", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("with"))
    cell = cell.select("token", "node", "comp", F.least("own", "with").alias("i"), F.greatest("own", "with").alias(
        "j"), (F.col("own") <= F.col("with")).alias("left"), (F.col("own") >= F.col("with")).alias("right"))
    return cell.join(sets.select("node", "items"), "node").groupBy("token", "i", "j").applyInPandas(
        lambda pdf: forest(pdf, percent), "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of ``docs`` that name their component, one row each; all columns stay.

    Rows without words link with nothing and stay. Of rows with equal key and text one stays; rows that share a key
    but not the text are judged one by one. Rows with a null key stay only where their component has no other key,
    one of each text.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    groups = scratch.write(_grouped(docs, width, percent, key, text), "groups")
    kept = groups.where(F.col("doc").eqNullSafe(F.col("component_id"))).groupBy(
        F.col("doc").alias("_kept"), F.col("mark").alias("_mark")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = scratch.write(kept, "kept")
    out = docs.join(kept, docs[key].eqNullSafe(kept["_kept"]) & (
        F.xxhash64(docs[text].cast("string")) == kept["_mark"]), "left_semi")
    # only repeated keys can hold repeated rows, and only then the texts are compared
    return out if kept.where("_rows > 1").isEmpty() else out.dropDuplicates([key, text])


SQL = r"""
with recursive t as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])
      end) as g from t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
      group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
r as (select doc_id as d, doc_id as c from t union select e.b as d, r.c from r join e on e.a = r.d)
select t.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id
from t left join n using (doc_id) join (select d, min(c) as c from r group by d) m on m.d = t.doc_id
"""
