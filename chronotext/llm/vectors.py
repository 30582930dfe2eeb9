"""Near-duplicate vectors by product quantisation over coarse inverted lists, with an exact rerank.

Unit vectors are assigned to the nearest of some coarse centres; the residual is cut into subspaces and each part is
coded by the nearest of 256 sub-centres. A vector then looks for partners in the lists that may hold one. Two partners
within distance r that lie in different lists stand on either side of the bisector of the two centres, so the depths
of both add up to at most r, and one of them is within r / 2 of it: each vector visits the lists whose bisector is that
near, and a link counts for both ends even if one end alone visits the other. No link is lost, whatever the directions
of the vectors. In those lists distances are read from tables (asymmetric: the vector as it is, its partner as coded),
and since the coding error of each partner is stored, the triangle inequality turns a table distance into a bound that
loses nothing. What is left is compared by its exact cosine in double precision.

Vectors of different dimensions have no cosine; each dimension has centres and lists of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch, components, unit

FIT_ROWS = 40_000    # vectors that the quantisers are fitted on, at most (one per dimension at least)
CELL_ROWS = 200      # coarse centres: one per so many vectors of the table, up to MAX_CELLS
MAX_CELLS = 4096
CODES = 256
PARTS = 8
BLOCK = 1024         # members of a cell that are compared at once
SEEK_BLOCK = 8192    # visitors of a cell that one task reads, about
SLACK = 1e-5         # for rounding in single precision; candidates only, the rerank is exact


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres ** 2).sum(axis=1)[None, :]
    return np.concatenate([np.empty(0, dtype=np.int64), *[
        np.argmin(square - 2 * (x[i:i + 2048] @ centres.T), axis=1) for i in range(0, len(x), 2048)]])


class Quantiser:
    """Coarse centres and the sub-centres of the residuals."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, min(MAX_CELLS, len(sample) // 4 + 1, rows // CELL_ROWS + 1), rng)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(self.dim), min(PARTS, self.dim))
        self.books = [kmeans(residual[:, c], CODES, rng) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes, and the distance from the vector to its coded form."""
        cell = nearest(x, self.coarse)
        residual = x - self.coarse[cell]
        codes = np.stack([nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return cell, codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
        """For each vector the cells whose bisector with its own is within half the radius, and its own cell."""
        square = (self.coarse ** 2).sum(axis=1)
        d = square[None, :] - 2 * (x @ self.coarse.T)
        own = d[np.arange(len(x)), cell][:, None]
        home = self.coarse[cell]
        apart = np.sqrt(np.maximum(square[cell][:, None] + square[None, :] - 2 * (home @ self.coarse.T), 0))
        past = (d - own) / (2 * np.maximum(apart, 1e-12))
        out = (past <= radius / 2 + SLACK) | (apart < SLACK)
        out[np.arange(len(x)), cell] = True
        return out

    def table_squares(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from the coded members of one cell (rows) to vectors, summed from a table per subspace.

        A table holds the products of a subspace; the squares of both sides are added once.
        """
        r = x - self.coarse[cell]
        square = sum((b ** 2).sum(axis=1)[codes[:, i]] for i, b in enumerate(self.books))
        out = square[:, None].astype(np.float32) + (r ** 2).sum(axis=1)[None, :].astype(np.float32)
        r = r.astype(np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = (-2 * b).astype(np.float32) @ r[:, c].T
            out += table[codes[:, i]]  # whole rows of the table
        return out


def unit_rows(column: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None where there is none: null, empty, zero or not finite."""
    rows = column.to_pylist()
    out: list[bytes | None] = [None] * len(rows)
    for at in by_length([len(v) if v is not None and None not in v else 0 for v in rows]).values():
        x = np.array([rows[i] for i in at], dtype=np.float64)
        ok = np.isfinite(x).all(axis=1)
        x[~ok] = 0
        big = np.abs(x).max(axis=1)
        ok &= big > 0
        x[ok] /= big[ok, None]  # no overflow in the squares
        x[ok] /= np.sqrt((x[ok] ** 2).sum(axis=1))[:, None]
        for i, v, good in zip(at, floats(x), ok, strict=True):
            out[i] = v if good else None
    return out


def by_length(lengths: list[int]) -> dict[int, list[int]]:
    """Places of the rows of each length above zero."""
    out: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        if n:
            out.setdefault(n, []).append(i)
    return out


def floats(x: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in np.ascontiguousarray(x, dtype=np.float64)]


def compare(pdf: pd.DataFrame, quantisers: dict[int, Quantiser], least: float) -> pd.DataFrame:
    """One block of a cell and one slice of its visitors: searching rows against the members stored there.

    Returns per searching node its number of links (weighted by copies) into the block, per member that of its links
    to visitors whose own cell it does not visit, and a spanning forest of the links, as rows (a, b, links) with b
    null for counts. At most two rows per row read.
    """
    member, seeking = pdf[pdf["member"]], pdf[~pdf["member"]]
    out_a, out_b, out_n = [], [], []
    if len(member):
        radius = np.sqrt(max(0.0, 2 - 2 * least))
        ids, copies = member["node"].to_numpy(), member["copies"].to_numpy(dtype=np.int64)
        y = np.frombuffer(b"".join(member["vec"]), dtype=np.float64).reshape(len(member), -1)
        codes = np.frombuffer(b"".join(member["codes"]), dtype=np.uint8).reshape(len(member), -1)
        error = member["error"].to_numpy(dtype=np.float64)
        cell, quantiser = int(member["probe"].iloc[0]), quantisers[int(member["dim"].iloc[0])]
        visits = np.zeros((len(member), len(quantiser.coarse)), dtype=bool)
        for i, cells in enumerate(member["probes"]):
            visits[i, cells] = True
        unseen = np.zeros(len(member), dtype=np.int64)
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        for at in range(0, len(seeking), BLOCK):
            seek = seeking.iloc[at:at + BLOCK]
            mine = seek["node"].to_numpy()
            x = np.frombuffer(b"".join(seek["vec"]), dtype=np.float64).reshape(len(seek), -1)
            close = quantiser.table_squares(x, cell, codes) <= ((radius + error) ** 2 + SLACK)[:, None]
            hit = np.zeros((len(seek), len(member)), dtype=bool)
            j, i = np.nonzero(close)
            for k in range(0, len(i), 1 << 18):
                p, q = i[k:k + (1 << 18)], j[k:k + (1 << 18)]
                hit[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= least
            hit &= mine[:, None] != ids[None, :]
            if not hit.any():
                continue
            n = hit @ copies
            one_sided = hit & ~visits[:, seek["cell"].to_numpy(dtype=np.int64)].T
            unseen += seek["copies"].to_numpy(dtype=np.int64) @ one_sided
            for a in np.flatnonzero(n):
                out_a.append(int(mine[a]))
                out_b.append(None)
                out_n.append(int(n[a]))
                for b in np.flatnonzero(hit[a]):
                    u, v = find(int(mine[a])), find(int(ids[b]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        out_a.append(int(mine[a]))
                        out_b.append(int(ids[b]))
                        out_n.append(0)
        for b in np.flatnonzero(unseen):
            out_a.append(int(ids[b]))
            out_b.append(None)
            out_n.append(int(unseen[b]))
    return pd.DataFrame({"a": pd.array(out_a, "Int64"), "b": pd.array(out_b, "Int64"), "n": pd.array(out_n, "Int64")})


def near_vectors(rows: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) per row: links are pairs with cosine >= ``least`` in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, their own
    component, kept. Vectors link with others of their own dimension, whichever that is. Equal unit vectors are one node that stands for its copies, so
    copies cost nothing and count as links of each other. Null keys take part as rows but never name a component
    unless all its keys are null (then component_id is null and kept is false); rows with equal keys are separate
    vectors. An empty table gives no rows. Other columns are not looked at.

    A cell's members are cut into blocks of about BLOCK rows and its visitors into slices of about SEEK_BLOCK. A task
    compares one slice with one block and returns counts and a forest of its links, never its pairs.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "pq")
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(unit_rows(batch.column(1)), pa.binary())], names=["id", "vec"])

    base = rows.mapInArrow(normal, "id long, vec binary").withColumn("node", F.xxhash64("vec"))
    base = scratch.write(base, "base")
    nodes = base.where(F.col("vec").isNotNull()).groupBy("node").agg(
        F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies")).withColumn(
        "dim", (F.length("vec") / 8).cast("int"))
    nodes = scratch.write(nodes, "nodes")
    # one row per dimension
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    if sizes:
        links = scratch.write(_links(nodes, _fit(nodes, sizes), least, scratch), "links")
        parts = components(links.where("b is not null").select("a", "b"), scratch)
        counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        nodes = nodes.select("node", "copies").join(counts, "node", "left").join(parts, "node", "left")
    else:
        nodes = nodes.select("node", "copies", F.lit(0).alias("n"), F.col("node").alias("root"))
    named = base.where(F.col("vec").isNotNull()).select("id", "node").join(nodes, "node").select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    out = named.join(names, "root").select("id", "n_links", "component_id").unionByName(
        base.where(F.col("vec").isNull()).select("id", F.lit(0).cast("long").alias("n_links"),
                                                 F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _fit(nodes: DataFrame, sizes: dict[int, int]) -> dict[int, Quantiser]:
    """A quantiser per dimension, from a bounded sample; every vector is indexed and searched."""
    share = max(1, FIT_ROWS // len(sizes))
    table = F.broadcast(nodes.sparkSession.createDataFrame(list(sizes.items()), "dim int, n long"))
    # twice the share at first, so that one task ranks few rows
    drawn = nodes.join(table, "dim").withColumn("u", unit(1, F.col("node"))).where(
        F.col("u") * F.col("n") <= 2 * share + 100)
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("dim").orderBy("u", "node"))).where(
        F.col("at") <= share).select("dim", "vec").toPandas()
    return {int(dim): Quantiser(np.frombuffer(b"".join(part["vec"]), dtype=np.float64).reshape(len(part), -1),
                                sizes[int(dim)]) for dim, part in drawn.groupby("dim")}


def _links(nodes: DataFrame, quantisers: dict[int, Quantiser], least: float, scratch: Scratch) -> DataFrame:
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    cell_of = ["dim", "probe"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in by_length(batch.column(3).to_pylist()).items():
                part, quantiser = batch.take(pa.array(at)), quantisers[dim]
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.float64).reshape(len(at), dim)
                cell, codes, error = quantiser.encode(x)
                probes = [np.flatnonzero(p).tolist() for i in range(0, len(x), 1024)
                          for p in quantiser.probes(x[i:i + 1024], cell[i:i + 1024], radius)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(error), pa.array(probes, pa.list_(pa.int32()))],
                    names=["node", "vec", "copies", "dim", "cell", "codes", "error", "probes"])

    stored = scratch.write(nodes.select("node", "vec", "copies", "dim").mapInArrow(
        index, "node long, vec binary, copies long, dim int, cell int, codes binary, error double, probes array<int>"),
        "index")
    # members and visitors per cell: one row per coarse centre, at most MAX_CELLS for a dimension
    members = {(r["dim"], r["cell"]): r["count"] for r in stored.groupBy("dim", "cell").count().collect()}
    visits = stored.select("dim", F.explode("probes").alias("probe")).groupBy(*cell_of).count().collect()
    grid = [(r["dim"], r["probe"], members.get((r["dim"], r["probe"]), 0) // BLOCK + 1, r["count"] // SEEK_BLOCK + 1)
            for r in visits]
    table = F.broadcast(scratch.spark.createDataFrame(grid, "dim int, probe int, blocks int, slices int"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(n: str, seed: int):
        return F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")

    seek = stored.select("node", "vec", "copies", "dim", "cell", F.explode("probes").alias("probe")).join(
        table, cell_of).select(
        "node", "vec", "copies", "cell", F.lit(None).cast("binary").alias("codes"),
        F.lit(None).cast("double").alias("error"), F.lit(None).cast("array<int>").alias("probes"), *cell_of,
        every("blocks").alias("block"), one("slices", 1).alias("slice"), F.lit(False).alias("member"))
    held = stored.withColumn("probe", F.col("cell")).join(table, cell_of).select(
        "node", "vec", "copies", "cell", "codes", "error", "probes", *cell_of, one("blocks", 2).alias("block"),
        every("slices").alias("slice"), F.lit(True).alias("member"))
    return seek.unionByName(held).groupBy(*cell_of, "block", "slice").applyInPandas(
        lambda pdf: compare(pdf, quantisers, least), "a long, b long, n long")


SQL = r"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
ok as (select vec_id, e from v where e is not null and not list_contains(list_transform(e, lambda x:
       x is null or not isfinite(x)), true) and list_sum(list_transform(e, lambda x: x * x)) > 0),
l as (select x.vec_id as a, y.vec_id as b from ok x join ok y on x.vec_id <> y.vec_id
      where list_cosine_similarity(x.e, y.e) >= 0.95),
r as (select vec_id as d, vec_id as c from v union select l.b as d, r.c from r join l on l.a = r.d),
m as (select d, min(c) as c from r group by d)
select v.vec_id, coalesce(n.n, 0) as n_links, m.c as component_id, v.vec_id = m.c as kept
from v join m on m.d = v.vec_id left join (select a, count(*) as n from l group by a) n on n.a = v.vec_id
"""
