"""A Merkle manifest of a dataset: leaf, authentication path, roots and a check of every row.

H is the lowercase hex SHA-256 of its inputs, concatenated. A leaf is H of the fields of a row, each as its UTF-8 byte
count, a colon and its value, or ``-``. The leaves of a language stand in ascending order of id; runs of two nodes
become their H (a last run of one too) while there are several. The subroots of the languages likewise give the root.

A tree is cut into aligned blocks of 2^BLOCK_LEVELS leaves, and the roots of its blocks are the leaves of the tree above,
cut in the same way until one block is left. So no task and no group holds more than a block, and nothing but row counts
of ranges comes to the driver. Within a block the authentication paths advance leaf by leaf: a stack per level computes
the next node of that level by treehash, two steps a leaf, so a level is ready when it is needed and no more nodes are
held than the square of the levels. The upper path, that all leaves of a block share, is then appended.

Only leaves (about 150 bytes a row) are shuffled; texts are read once, in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block holds 2^BLOCK_LEVELS leaves, and the path inside it as many digests at most.
BLOCK_LEVELS = 12
#: Rows whose id's CRC-32 is divisible by this are checked against a leaf with one added to ``n_chars``.
TAMPER_EVERY = 7


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")).cast("binary")


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


class Treehash:
    """The root of the subtree of 2^level leaves from ``start``, by a stack that takes one leaf or joins two nodes a step.

    Leaves from ``n`` on don't exist: a last node without a partner is hashed alone. ``node`` is None while the subtree
    isn't done, and stays so if it has no leaf.
    """

    def __init__(self, leaves: list[str], start: int, level: int):
        self.leaves, self.at, self.end, self.level = leaves, start, min(start + (1 << level), len(leaves)), level
        self.stack: list[tuple[int, str]] = []
        self.done = start >= len(leaves)

    def step(self) -> None:
        if self.done:
            return
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, right = stack.pop()
            stack.append((level + 1, h(stack.pop()[1], right)))
        elif self.at < self.end:
            stack.append((0, self.leaves[self.at]))
            self.at += 1
        elif stack[-1][0] < self.level:
            level, node = stack.pop()
            stack.append((level + 1, h(node)))
        self.done = self.at >= self.end and len(stack) == 1 and stack[0][0] == self.level

    @property
    def node(self) -> str | None:
        return self.stack[0][1] if self.done and self.stack else None

    def finish(self) -> str | None:
        while not self.done:
            self.step()
        return self.node


def block_root(leaves: list[str], levels: int) -> str:
    return Treehash(leaves, 0, levels).finish()  # type: ignore[return-value]


def paths(leaves: list[str], levels: int) -> Iterator[list[str | None]]:
    """The authentication path of each leaf in turn, from the bottom: a sibling a level, None where there is none."""
    path: list[str | None] = [Treehash(leaves, 1 << k, k).finish() for k in range(levels)]
    coming = [Treehash(leaves, 0, k) for k in range(levels)]
    for k in range(levels):
        coming[k].finish()  # the left neighbour of the second subtree
    for i in range(len(leaves)):
        yield list(path)
        for k in range(levels):
            if (i + 1) % (1 << k) == 0:
                path[k] = coming[k].finish()
                coming[k] = Treehash(leaves, (i + 1 + (1 << k)) ^ (1 << k), k)
        for t in coming:
            t.step()
            t.step()


def folded(node: str, position: int, path: list[str | None]) -> str:
    """The root that a leaf at ``position`` and its path give."""
    for sibling in path:
        node = h(node) if sibling is None else h(sibling, node) if position & 1 else h(node, sibling)
        position >>= 1
    return node


def levels_of(n: int, cap: int) -> int:
    """Levels of a block: all of them where its tree has several blocks, else as many as ``n`` leaves need."""
    return min(cap, max(0, (n - 1).bit_length()))


def _positioned(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (columns ``tree``, those of ``order`` and others) with ``pos`` in its tree and ``n``, the leaves of its tree.

    The rows are cut into ranges that are written once; offsets are one row a range and tree, so a tree that holds most of all rows
    is many ranges.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    written = staged(ranged.withColumn("m", F.monotonically_increasing_id()), name)
    part = F.shiftright("m", 33)
    counts = staged(written.groupBy("tree", part.alias("p")).agg(F.count("*").alias("rows"), F.min("m").alias("least")), f"{name}_counts")
    by_tree = Window.partitionBy("tree")
    placed = counts.select(
        F.col("tree").alias("of_tree"), F.col("p").alias("of_p"), "least", F.coalesce(F.sum("rows").over(by_tree.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("rows").over(by_tree).alias("n"),
    )
    return written.join(placed, (F.col("tree").eqNullSafe(F.col("of_tree"))) & (part == F.col("of_p"))).withColumn("pos", F.col("m") - F.col("least") + F.col("before")).drop("m", "of_tree", "of_p", "least", "before")


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, pos, n, node``: the root of each block of ``tree, pos, n, node``, as a leaf of the tree above."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        n = rows["n"][0].as_py()
        root = block_root(rows["node"].to_pylist(), levels_of(n, levels))
        above = -(-n >> levels) if n > 1 << levels else 1
        return pa.table({"tree": rows["tree"][:1], "pos": pa.array([rows["pos"][0].as_py() >> levels], pa.int64()), "n": pa.array([above], pa.int64()), "node": pa.array([root], pa.string())})

    keyed = nodes.select("tree", "pos", "n", "node", F.shiftright("pos", levels).alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, n long, node string")


def _with_paths(nodes: DataFrame, upper: DataFrame | None, levels: int, kept: str) -> DataFrame:
    """``nodes`` (``tree, pos, n, node`` and the columns of DDL ``kept``) with ``path`` and ``path_root``.

    ``upper`` has ``tree, pos, path, path_root`` of the blocks, None where each tree is one block. A sibling that isn't there is an empty string.
    """
    names = [c.split()[0] for c in kept.split(", ")] if kept else []
    schema = ", ".join(["tree string", "pos long", "node string", *([kept] if kept else []), "path array<string>", "path_root string"])

    def run(table: pa.Table, above: pa.Table | None) -> pa.Table:
        rows = table.sort_by("pos")
        leaves, own = rows["node"].to_pylist(), levels_of(rows["n"][0].as_py(), levels)
        if above is None:
            rest, root = [], block_root(leaves, own)
        else:
            rest, root = above["path"][0].as_py(), above["path_root"][0].as_py()
        found = [[x or "" for x in p] + rest for p in paths(leaves, own)]
        columns = {c: rows[c] for c in ("tree", "pos", "node", *names)}
        return pa.table(columns | {"path": pa.array(found, pa.list_(pa.string())), "path_root": pa.array([root] * len(leaves), pa.string())})

    keyed = nodes.select("tree", "pos", "n", "node", *names, F.shiftright("pos", levels).alias("block"))
    if upper is None:
        return keyed.groupBy("tree", "block").applyInArrow(lambda t: run(t, None), schema)
    blocks = upper.select("tree", F.col("pos").alias("block"), "path", "path_root")
    return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(lambda t, a: run(t, a), schema)


def tree_tops(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The written block roots above ``nodes``, level by level, until every tree has one node; the last holds the roots."""
    tops, many = [nodes], True
    while many:
        tops.append(staged(_roots(tops[-1], levels), f"{name}_{len(tops)}"))
        many = not tops[-1].where("n > 1").isEmpty()
    return tops[1:]


def upper_paths(tops: list[DataFrame], levels: int) -> DataFrame:
    """``tree, pos, path, path_root`` of the block roots of the leaves."""
    above = tops[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"), F.col("node").alias("path_root"))
    for top in reversed(tops[:-1]):
        above = staged(_with_paths(top, above, levels, "").select("tree", "pos", "path", "path_root"), "upper")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars", tamper_every: int = TAMPER_EVERY, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof and check of every row.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, position``, one row for each input row.
    Nulls are fields of their own (``-``), not empty strings; null groups are a tree of their own, before all others;
    null ids stand before all others of their group and are never tampered with, as they have no CRC-32. Rows that repeat
    an id stand in order of their leaf, equal rows side by side. A tampered null count stays null, so that row verifies.
    A single row has no siblings: its proof is H of nothing, or of the other subroots. Texts of any length, also broken
    UTF-8, are hashed by their bytes. Further columns aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession

    def found() -> DataFrame:
        added = F.col(count_col) + F.lit(1).cast("long")
        tampered = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % tamper_every == 0, F.lit(False)) & F.col(count_col).isNotNull()
        shown = leaf([F.col(c) for c in fields])
        # The second digest of a text is made for tampered rows only.
        altered = F.when(tampered, leaf([added if c == count_col else F.col(c) for c in fields]))
        leaves = docs.select(F.col(group_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("doc_id"), shown.alias("node"), altered.alias("altered"))
        # Equal rows share a leaf, so their order makes no difference; the number only parts them into ranges.
        leaves = staged(leaves.withColumn("nth", F.monotonically_increasing_id()), "leaves")
        nodes = staged(_positioned(leaves, ["doc_id", "node", "nth"], "placed").drop("nth"), "nodes")
        tops = tree_tops(nodes, levels, "top")
        # The subroots are the leaves of one tree, in order of their group.
        sub = tops[-1].select(F.lit("").alias("tree"), F.col("tree").alias("grp"), "node")
        sub = staged(_positioned(sub, ["grp"], "groups"), "subroots")
        sub_tops = tree_tops(sub, levels, "sub")
        placed = _with_paths(sub, upper_paths(sub_tops, levels), levels, "grp string")
        above = staged(placed.select(F.col("grp").alias("tree"), F.col("node").alias("subroot"), F.col("pos").alias("group_pos"), F.col("path").alias("group_path"), F.col("path_root").alias("root")), "above")
        inner = upper_paths(tops, levels)
        joined = inner.join(above.withColumnRenamed("tree", "of_tree"), F.col("tree").eqNullSafe(F.col("of_tree"))).drop("of_tree")
        return _checked(nodes, joined, levels)

    return lasting(spark, "manifest", found)


def _checked(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """The result rows: each block of leaves meets the one row of its upper path."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        leaves, altered, places = (rows[c].to_pylist() for c in ("node", "altered", "pos"))
        rest, subroot, root, group_path, group_pos = (above[c][0].as_py() for c in ("path", "subroot", "root", "group_path", "group_pos"))
        shared = [x or None for x in rest]
        over = [x or None for x in group_path]
        tail = "".join(rest) + "".join(group_path)
        proofs, folds = [], []
        for node, other, pos, path in zip(leaves, altered, places, paths(leaves, levels_of(rows["n"][0].as_py(), levels)), strict=True):
            proofs.append(h("".join(x for x in path if x) + tail))
            folds.append(folded(folded(other or node, pos, path + shared), group_pos, over))
        n = len(leaves)
        return pa.table({
            "doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folds, pa.string()), "verified": pa.array([x == root for x in folds], pa.bool_()), "position": rows["pos"],
        })

    keyed = nodes.select("tree", "doc_id", "pos", "n", "node", "altered", F.shiftright("pos", levels).alias("block"))
    blocks = upper.withColumnRenamed("pos", "block")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"
    return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema)


ORACLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b,
    coalesce(strlen(lang) || ':' || lang, '-') AS c, coalesce(strlen(text) || ':' || text, '-') AS e,
    list_transform(range(1, 1 + coalesce(strlen(doc_id::VARCHAR), 0)), lambda k: ascii(substring(doc_id::VARCHAR, k, 1))::BIGINT) AS digits
  FROM documents),
d AS (
  SELECT doc_id, lang, sha256(a || b || c || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || e) AS leaf,
    sha256(a || b || c || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || e) AS more,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, digits), lambda crc, byte:
      list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 7 = 0 AND doc_id IS NOT NULL AS tampered
  FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
nodes AS (
  SELECT lang, 0 AS lvl, pos, leaf AS node FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1 GROUP BY lang, lvl, pos // 2),
tops AS (SELECT lang, lvl, node AS subroot FROM nodes QUALIFY lvl = max(lvl) OVER (PARTITION BY lang)),
subs AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tops),
above AS (
  SELECT 0 AS lvl, pos, subroot AS node FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY lvl, pos // 2),
root AS (SELECT node AS root, lvl FROM above QUALIFY lvl = max(lvl) OVER ()),
lower_steps AS (
  SELECT l.lang, l.pos, list((CASE WHEN s.node IS NULL THEN 'N' WHEN (l.pos >> t.g) & 1 = 1 THEN 'L' || s.node ELSE 'R' || s.node END) ORDER BY t.g) AS steps
  FROM leaves l JOIN (SELECT lang, subroot, unnest(range(lvl)) AS g FROM tops) t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = t.g AND s.pos = xor(l.pos >> t.g, 1) GROUP BY l.lang, l.pos),
upper_steps AS (
  SELECT u.lang, list((CASE WHEN s.node IS NULL THEN 'N' WHEN (u.pos >> t.g) & 1 = 1 THEN 'L' || s.node ELSE 'R' || s.node END) ORDER BY t.g) AS steps
  FROM subs u, (SELECT unnest(range(lvl)) AS g FROM root) t LEFT JOIN above s ON s.lvl = t.g AND s.pos = xor(u.pos >> t.g, 1) GROUP BY u.lang),
walked AS (
  SELECT l.doc_id, l.leaf, u.subroot, root.root, l.pos AS position, coalesce(w.steps, []) || coalesce(v.steps, []) AS steps, CASE WHEN l.tampered THEN l.more ELSE l.leaf END AS shown
  FROM leaves l JOIN subs u ON l.lang IS NOT DISTINCT FROM u.lang CROSS JOIN root
  LEFT JOIN lower_steps w ON w.lang IS NOT DISTINCT FROM l.lang AND w.pos = l.pos LEFT JOIN upper_steps v ON v.lang IS NOT DISTINCT FROM l.lang),
folds AS (
  SELECT *, sha256(list_aggregate(list_transform(steps, lambda s: substring(s, 2)), 'string_agg', '')) AS proof,
    list_reduce(list_prepend(shown, steps), lambda x, s: sha256(CASE substring(s, 1, 1) WHEN 'L' THEN substring(s, 2) || x WHEN 'R' THEN x || substring(s, 2) ELSE x END)) AS folded
  FROM walked)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified, position FROM folds"""
