"""A Merkle manifest of a table: a tree per group of rows, a tree over the groups, and a proof for every row.

Each level is one table (g, i, d): the group, the position in the level, and the digest. A level joins itself on
computed sibling positions, arity - 1 times: the position with its lowest bit flipped in a binary tree, else the slots
behind one's own, taken round the run. Then each node has its siblings to the left and to the right beside it, and
the node of slot zero emits the parent. Going down again, a node takes over the siblings of its parent, so a row has
all siblings up to the root after one join per level, and tables triple from level to level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch, fresh
from chronotext.llm.numbering import numbered

ARITY = 3
PATH = "array<struct<l:binary,r:binary>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else the count of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def spelled(digests: Column) -> Column:
    """Binary digests as lowercase hex text."""
    return F.lower(F.hex(digests))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (g, i, n, d) with l and r: the digests of the run's other nodes to the left and to the right."""
    slot = F.col("i") % arity
    out = nodes
    for shift in range(1, arity):
        at = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("i") - slot + (slot + shift) % arity
        other = nodes.select("g", F.col("i").alias("_at"), F.col("d").alias(f"_d{shift}"))
        out = out.withColumn("_at", at).join(other, ["g", "_at"], "left").drop("_at")
    none = F.lit(b"")

    def side(left: bool) -> Column:
        # the k-th shift wraps round to the left where slot + k reaches the arity
        return F.concat(none, *[F.when((slot + k >= arity) if left else (slot + k < arity), F.coalesce(
            F.col(f"_d{k}"), none)).otherwise(none) for k in range(1, arity)])

    return out.select("g", "i", "n", "d", side(True).alias("l"), side(False).alias("r"))


def grow(leaves: DataFrame, arity: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Trees over the leaves (g, i, n, d), n of them per g: the roots (g, root), and the paths (g, i, path) of leaves.

    A path is the array of (l, r) from the leaf up. The leaf of a tree of one is the root, and has no row in paths.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, roots = [], leaves, []
    while True:
        roots.append(nodes.where("n = 1").select("g", F.col("d").alias("root")))
        if most <= 1:
            break
        levels.append(scratch.write(with_siblings(nodes.where("n > 1"), arity), "level"))
        run = F.concat(spelled(F.col("d")), spelled(F.col("r")))
        nodes = levels[-1].where(F.col("i") % arity == 0).select(
            "g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.unhex(F.sha2(run, 256)).alias("d"))
        most = -(-most // arity)
    own = F.array(F.struct("l", "r")).cast(PATH)
    paths = leaves.limit(0).select("g", "i", F.array().cast(PATH).alias("path"))
    for nodes in reversed(levels):
        above = paths.select("g", F.col("i").alias("_up"), F.col("path").alias("_path"))
        paths = nodes.withColumn("_up", F.expr(f"i div {arity}")).join(above, ["g", "_up"], "left").select(
            "g", "i", F.concat(own, F.coalesce(F.col("_path"), F.array().cast(PATH))).alias("path"))
    return reduce(DataFrame.unionByName, roots), paths


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest (hex text) and the siblings on its path."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(spelled(x["l"]), acc, spelled(x["r"])), 256))


def proof(path: Column) -> Column:
    """All siblings of a path as hex text, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(spelled(x["l"]), spelled(x["r"]))), "")


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str, arity: int = ARITY) -> DataFrame:
    """All rows and columns with the digests ``subroot`` and ``root`` as hex text, and ``path``, the siblings of the leaf.

    ``leaf`` names the column of the rows' digests (hex text, not null). Leaves of a group ascend by ``order`` (nulls
    first) and by the leaf where that ties; groups ascend by their bytes, a null group first. A lone leaf is its
    group's subroot, a lone subroot the root. Fully equal rows take neighbouring places in either order. An empty
    table gives no rows. Names that the table already has are given a leading ``_``.

    A group that holds most rows is spread over tasks at every level: places come from counts per partition, and
    levels join on (group, place), which no two rows share.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    sub, root, path = fresh(rows.columns, "subroot", "root", "path")
    g, i, n = fresh([*rows.columns, sub, root, path], "_g", "_i", "_n")
    keyed = rows.withColumn(
        g, F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))))
    ascending = [*[F.col(c).asc_nulls_first() for c in order], F.col(leaf).asc()]
    placed = scratch.write(numbered(keyed, g, ascending, scratch, i, n), "leaves")
    subroots, low = grow(placed.select(F.col(g).alias("g"), F.col(i).alias("i"), F.col(n).alias("n"), F.unhex(
        leaf).alias("d")), arity, scratch)
    tops = scratch.write(numbered(scratch.write(subroots.withColumn("top", F.lit("")), "subroots"), "top", [
        F.col("g")], scratch), "tops")
    roots, high = grow(tops.select(F.col("top").alias("g"), "i", "n", F.col("root").alias("d")), arity, scratch)
    upper = tops.join(high.select("i", F.col("path").alias("_high")), "i", "left").join(
        roots.select(F.col("g").alias("top"), F.col("root").alias("_root")), "top")
    upper = scratch.write(upper.select(F.col("g").alias(g), F.col("root").alias("_sub"), "_root", "_high"), "upper")
    low = low.select(F.col("g").alias(g), F.col("i").alias(i), F.col("path").alias("_low"))
    empty = F.array().cast(PATH)
    return placed.join(low, [g, i], "left").join(upper, g).select(
        *rows.columns, spelled(F.col("_sub")).alias(sub), spelled(F.col("_root")).alias(root),
        F.concat(F.coalesce("_low", empty), F.coalesce("_high", empty)).alias(path))


def _sql_field(x: str) -> str:
    return f"case when {x} is null then '-' else strlen(cast({x} as varchar)) || ':' || {x} end"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_BIT = "xor(a >> 1, 3988292384 * (a & 1))"
SQL = f"""
with recursive c as (
  select *, 4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''),
         lambda x: cast(ascii(x) as bigint))), lambda s, b: list_reduce([xor(s, b), 1, 1, 1, 1, 1, 1, 1, 1],
         lambda a, z: {_BIT})) as crc from documents),
h as (select *, {_sql_leaf("text")} as leaf, {_sql_leaf("replace(text, chr(10), '')")} as other,
             coalesce('=' || source, '') as g from c),
d as (select doc_id, g, leaf, case when crc % 2 = 0 then other else leaf end as given,
             row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from h),
low(l, g, i, h) as (
  select 0, g, i, leaf from d union all
  select l + 1, g, i // {ARITY}, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over (partition by g) as n from low) where n > 1 group by l, g, i // {ARITY}),
sub as (select g, arg_max(h, l) as subroot, row_number() over (order by g) - 1 as i from low where i = 0 group by g),
top(l, i, h) as (
  select 0, i, subroot from sub union all
  select l + 1, i // {ARITY}, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over () as n from top) where n > 1 group by l, i // {ARITY}),
nodes as (select 0 as t, l, g, i, h, count(*) over (partition by l, g) as n from low union all
          select 1, l, '', i, h, count(*) over (partition by l) from top),
sides as (select t, l, g, i,
  coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as lft,
  coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as rgt
  from nodes where n > 1 window w as (partition by t, l, g, i // {ARITY} order by i)),
steps as (
  select d.g, d.i, t, l, lft, rgt from d join sides s on t = 0 and s.g = d.g and s.i = d.i // cast({ARITY} ** l as bigint)
  union all
  select d.g, d.i, t, l, lft, rgt from d join sub using (g)
  join sides s on t = 1 and s.i = sub.i // cast({ARITY} ** l as bigint)),
paths as (select g, i, sha256(string_agg(lft || rgt, '' order by t, l)) as proof,
                 list(lft || '|' || rgt order by t, l) as path from steps group by g, i),
o as (select doc_id, leaf, subroot, (select arg_max(h, l) from top where i = 0) as root,
             coalesce(proof, sha256('')) as proof_sha256, list_reduce(list_prepend(given, coalesce(path, [])),
               lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root
      from d join sub using (g) left join paths p on p.g = d.g and p.i = d.i)
select *, folded_root = root as verified from o
"""
