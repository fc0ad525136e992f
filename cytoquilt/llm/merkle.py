"""Merkle manifest of a table by slot pivot (operator 13), with built-in functions only.

Rows are leaves, ordered within their group. A node's parent is its place divided
by the fanout, its slot the remainder. One grouped aggregate per level spreads the
children of a parent into one column per slot; the hash of the columns after each
other is the parent, and the columns without a child's own are the child's
siblings. Roots of the groups form a second tree of the same kind. Proofs go down
from the root: a child's is its siblings, then its parent's proof.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, quoted
from cytoquilt.operators.ordering import grouped_row_number, ranged
from cytoquilt.session import materialize


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of all fields after each other."""
    return F.sha2(F.concat(*map(field_text, values)), 256)


def group_key(group: Column) -> Column:
    """Text that tells groups apart and sorts as they do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def slots(fanout: int) -> list[str]:
    return [f"_s{j}" for j in range(fanout)]


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level of every tree that still has several nodes, with its children's digests in slot columns."""
    pivot = [F.max(F.when(F.col("_pos") % fanout == j, F.col("_digest"))).alias(s) for j, s in enumerate(slots(fanout))]
    up = nodes.where("_n > 1").groupBy("_tree", F.expr(f"_pos div {fanout}").alias("_pos")).agg(F.max("_n").alias("_n"), *pivot)
    # empty slots of a last, shorter run add nothing
    return up.withColumn("_n", F.expr(f"(_n + {fanout - 1}) div {fanout}")).withColumn("_digest", F.sha2(F.concat(*[F.coalesce(s, F.lit("")) for s in slots(fanout)]), 256))


def siblings(slot: Column, columns: Sequence[str]) -> Column:
    """The parent's slot columns before and after the child's own, each side as one text."""

    def side(keep) -> Column:
        return F.concat(*[F.when(keep(F.lit(j)), F.coalesce(s, F.lit(""))).otherwise("") for j, s in enumerate(columns)])

    return F.struct(side(lambda j: j < slot).alias("left"), side(lambda j: j > slot).alias("right"))


@dataclass(frozen=True)
class Manifest:
    """Levels of all trees, leaves first: ``_tree``, ``_pos``, ``_n`` (nodes of the tree at this level), ``_digest``, slots from level 1 on."""

    levels: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """One row per tree: ``_tree``, ``_digest`` and the level at which it came down to one node."""
        tops = [nodes.where("_n = 1").select("_tree", "_digest", F.lit(k).alias("_level")) for k, nodes in enumerate(self.levels)]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out

    def leaves(self, above: DataFrame) -> DataFrame:
        """Leaves with ``_path``: siblings of each level up to the tree's root, then the path in ``above``.

        ``above`` has one row per tree: ``_tree``, ``_level``, ``_path`` and columns that every leaf of the tree takes along.
        """
        extra = [c for c in above.columns if c not in ("_tree", "_level", "_path")]
        found = None
        for k in reversed(range(len(self.levels))):
            nodes = self.levels[k]
            own = [c for c in nodes.columns if c != "_tree"]
            tops = nodes.where("_n = 1").join(above.where(F.col("_level") == k).drop("_level"), "_tree").select("_tree", *own, "_path", *extra)
            if found is not None:
                wide = [f"_up{s}" for s in slots(self.fanout)]
                slot_columns = [F.col(s).alias(w) for s, w in zip(slots(self.fanout), wide)]
                up = found.select("_tree", F.col("_pos").alias("_up"), *slot_columns, F.col("_path").alias("_above"), *extra)
                below = nodes.where("_n > 1").withColumn("_up", F.expr(f"_pos div {self.fanout}")).join(up, ["_tree", "_up"])
                step = F.array(siblings(F.col("_pos") % self.fanout, wide))
                tops = tops.unionByName(below.withColumn("_path", F.concat(step, F.col("_above"))).select("_tree", *own, "_path", *extra))
            found = tops
            # small levels only: the plan stays short, and the levels below have their own
            if k and k % 3 == 0:
                found = materialize(found)
        return found


def trees(leaves: DataFrame, fanout: int) -> Manifest:
    """All levels over ``leaves`` (``_tree``, ``_pos`` from 0, ``_digest``, further columns stay with the leaves).

    Each level is written once; it has a ``fanout``-th of the rows below, and the
    number of levels is the logarithm of the largest tree.
    """
    sizes = leaves.groupBy("_tree").agg(F.count(F.lit(1)).alias("_n"))
    levels = [materialize(leaves.join(sizes, "_tree"))]
    most = levels[0].agg(F.max("_n")).first()[0] or 0
    while most > 1:
        levels.append(materialize(parents(levels[-1], fanout)))
        most = -(-most // fanout)
    return Manifest(levels, fanout)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_pos`` from 0 within ``_tree``, in ranges of about equal size however the rows fall to trees."""
    laid = ranged(rows, ["_tree", *order], "_part")
    numbered = grouped_row_number(laid, ["_tree"], [F.asc(c) for c in order], F.col("_part"), "_pos")
    return numbered.withColumn("_pos", F.col("_pos") - 1).drop("_part")


def build(leaves: DataFrame, fanout: int = 3) -> tuple[Manifest, Manifest, DataFrame]:
    """(trees of the groups, tree of their roots, group table) over ``leaves``: ``_tree``, ``_id``, ``_digest``, more.

    The group table has one row per group: ``_tree``, ``_level``, ``_path`` from the group's root to the top, ``_subroot``, ``_root``.
    """
    if fanout < 2:
        raise ValueError("the fanout must be 2 at least")
    # ranges are sampled first: the texts are hashed once
    inner = trees(placed(materialize(leaves), ["_id", "_digest"]), fanout)
    tops = materialize(inner.roots())
    above = placed(tops.select(F.lit("").alias("_tree"), F.col("_tree").alias("_group"), "_digest"), ["_group"])
    outer = trees(above, fanout)
    top = outer.roots().select("_tree", "_level", F.array().cast("array<struct<left:string,right:string>>").alias("_path"), F.col("_digest").alias("_root"))
    paths = outer.leaves(top).select(F.col("_group").alias("_tree"), "_path", "_root")
    groups = materialize(tops.join(paths, "_tree").withColumnRenamed("_digest", "_subroot"))
    return inner, outer, groups


def fold(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and the siblings of its proof."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(
    df: DataFrame, id_col: str, group_col: str, fields: Sequence[str], claimed: dict[str, Column] | None = None, fanout: int = 3,
    paths: bool = False,
) -> DataFrame:
    """Id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    ``claimed`` replaces fields by what is to be verified against the manifest of
    ``df``; without it every row verifies. ``paths`` adds ``proof``, the siblings
    left and right of the way up, level by level.

    Leaves ascend by id in their group, null ids first; repeated ids ascend by
    their leaf, and equal rows are leaves side by side. A null group is a group of its
    own, the first. Null fields and empty texts differ. A group of one row has its
    leaf as its root, and a table of one row needs no proof. Other columns are left
    out; an id column named as one of these gets them under a name with ``_``
    behind. An empty table comes out empty.
    """
    names = fresh(df.select(quoted(id_col)), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")
    leaf = leaf_hash([quoted(c) for c in fields])
    now = leaf_hash([(claimed or {}).get(c, quoted(c)) for c in fields]) if claimed else leaf
    rows = df.select(quoted(id_col).alias("_id"), group_key(quoted(group_col)).alias("_tree"), leaf.alias("_digest"), now.alias("_now"))
    inner, _, groups = build(rows, fanout)
    found = inner.leaves(groups)
    folded = fold(F.col("_now"), F.col("_path"))
    out = found.select(
        F.col("_id").alias(id_col), F.col("_digest").alias(names[0]), F.col("_subroot").alias(names[1]), F.col("_root").alias(names[2]),
        proof_hash(F.col("_path")).alias(names[3]), folded.alias(names[4]), F.col("_path").alias(names[6]),
    )
    out = out.withColumn(names[5], quoted(names[4]) == quoted(names[2]))
    return out.select(quoted(id_col), *names[:6], *names[6:][: int(paths)])


DOCUMENT_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Tampering for a test of the manifest: texts of every other id, by its checksum, lose their line ends."""
    even = F.crc32(quoted(id_col).cast("string").cast("binary")) % 2 == 0
    return {text_col: F.when(even, F.translate(quoted(text_col), "\n", "")).otherwise(quoted(text_col))}


def oracle(table: str = "documents", fanout: int = 3, levels: int = 16, group_levels: int = 10) -> str:
    """The same rows in DuckDB's SQL; ``levels`` bound the trees this text can express (fanout ** levels rows a group)."""

    def text(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    def h(last: str) -> str:
        return "sha256(" + " || ".join([*(text(c) for c in ("doc_id", "source", "lang", "n_chars")), text(last)]) + ")"

    # crc32 of the id's digits, bit by bit: each byte is mixed in, then shifted out in eight steps
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[]"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"

    def up(name: str, depth: int) -> list[str]:
        out = []
        for k in range(depth):
            # a tree of one node takes no further step
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT t, p, any_value(n) AS n, CASE WHEN max(many) THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM (SELECT t, pos // {fanout} AS p, pos, d, n > 1 AS many, CASE WHEN n > 1 THEN (n + {fanout - 1}) // {fanout} ELSE 1 END AS n FROM {name}{k}_) GROUP BY t, p),
{name}{k + 1}_ AS (SELECT t, p AS pos, n, d FROM {name}{k + 1})""")
        return out

    def down(rows: str, name: str, depth: int, key: str) -> list[str]:
        out, last = [], rows
        for k in range(depth):
            # own node's siblings at level k, folded over what has come so far
            out.append(f"""{rows}{name}{k} AS MATERIALIZED (SELECT r.* EXCLUDE (pos, proof, cur), r.pos // {fanout} AS pos, r.proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof,
  CASE WHEN s.many THEN sha256(coalesce(s.l, '') || r.cur || coalesce(s.r, '')) ELSE r.cur END AS cur FROM {last} r JOIN {name}s{k} s ON s.t = r.{key} AND s.pos = r.pos)""")
            last = f"{rows}{name}{k}"
        return out

    def sides(name: str, depth: int) -> list[str]:
        return [
            f"""{name}s{k} AS (SELECT a.t, a.pos, a.n > 1 AS many, string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS l, string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS r
  FROM {name}{k}_ a LEFT JOIN {name}{k}_ b ON b.t = a.t AND b.pos // {fanout} = a.pos // {fanout} AND b.pos <> a.pos GROUP BY a.t, a.pos, a.n)"""
            for k in range(depth)
        ]

    ctes = [
        f"docs AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '-') AS t, {h('text')} AS leaf, {h('now')} AS cur FROM (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM {table}))",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM docs)",
        "a0_ AS (SELECT t, pos, n, leaf AS d FROM a0)",
        *up("a", levels),
        *sides("a", levels),
        f"b0_ AS MATERIALIZED (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n, d, t AS g FROM a{levels})",
        *up("b", group_levels),
        *sides("b", group_levels),
        "rows AS (SELECT doc_id, t, leaf, cur, pos, '' AS proof FROM a0)",
        *down("rows", "a", levels, "t"),
        f"mid AS (SELECT r.doc_id, r.leaf, r.cur, r.proof, '' AS t, b.pos, b.d AS subroot FROM rowsa{levels - 1} r JOIN b0_ b ON b.g = r.t)",
        *down("mid", "b", group_levels, "t"),
    ]
    return (
        "WITH " + ",\n".join(ctes)
        + f"\nSELECT doc_id, leaf, subroot, (SELECT d FROM b{group_levels}) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT d FROM b{group_levels}) AS verified FROM midb{group_levels - 1}"
    )
