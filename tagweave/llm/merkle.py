"""A Merkle manifest of a dataset that keeps every few levels only and recomputes the others when a proof is wanted.

Each tree (one for each value of a column) has the rows as leaves, in order; a run of ``fanout`` neighbours becomes one
node a level up, until one node, the subroot, is left. The subroots are in turn the leaves of the tree whose top is the
root. Stored are the leaves and each ``every``-th level. For a proof an aligned subtree of ``fanout ** every`` stored nodes
is read as one group, its interior nodes are computed again, the siblings are given out, and the nodes are forgotten.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.ordering import global_rank
from tagweave.llm.common import discard, stage

#: Levels from one stored level to the next: 256 leaves a subtree at a fan-out of two.
EVERY = 8

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: of each value ``-`` if it is null, else its length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path: at each level the leaf's node stands between its siblings."""
    return F.reduce(path, leaf, lambda node, level: digest(level["before"], node, level["after"]))


def path_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""))


@dataclass
class Manifest:
    """``stored[k]`` has the nodes of level ``k * every``: ``tree, pos, n`` (nodes of this tree at this level) and ``digest``;
    the leaves also have ``row``. The last has one node a tree. ``top`` is the same for the tree of the subroots."""

    stored: list[DataFrame]
    top: list[DataFrame]
    fanout: int
    every: int

    def proofs(self) -> DataFrame:
        """``row``, ``leaf``, ``path`` (an array of ``before``, ``after``), ``subroot`` and ``root`` of every leaf."""
        roots = self.top[-1].select("tree", "pos", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
        for level in reversed(self.top[:-1]):
            roots = self._opened(level, roots, ["root"])
        roots = roots.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root") \
            if len(self.top) > 1 else self._lone(roots)
        for level in reversed(self.stored[:-1]):
            roots = self._opened(level, roots, ["subroot", "root"])
        if len(self.stored) == 1:  # every tree is one leaf
            roots = self.stored[0].join(roots.drop("pos"), "tree")
        return roots.select("row", F.col("digest").alias("leaf"), "path", "subroot", "root")

    def _lone(self, roots: DataFrame) -> DataFrame:
        """The only tree's subroot is the root."""
        only = self.top[0].select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"))
        return only.withColumn("root", F.col("subroot")).withColumn("path", F.array().cast(PATH))

    def _opened(self, level: DataFrame, above: DataFrame, also: list[str]) -> DataFrame:
        """The nodes of a stored level with their paths: siblings in the subtree, then the path of the subtree's top."""
        whole = _subtrees(level, self.fanout, self.every)
        grown = whole.withColumn("levels", _regenerated(F.col("nodes.digest"), F.col("alone"), self.fanout, self.every))
        met = grown.join(above.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), *also), ["tree", "block"])
        nodes = F.transform("nodes", lambda node, at: F.struct(node.alias("node"), _siblings(F.col("levels"), at, self.fanout).alias("inner")))
        out = met.select("tree", "rest", *also, F.explode(nodes).alias("one"))
        columns = [F.col(f"one.node.{c}") for c in level.columns if c not in ("tree", "n")]
        return out.select("tree", *columns, F.concat("one.inner", "rest").alias("path"), *also)

    def discard(self) -> None:
        discard(*self.stored, *self.top)


PATH = "array<struct<before:string,after:string>>"


def _subtrees(level: DataFrame, fanout: int, every: int) -> DataFrame:
    """One row for each aligned subtree: ``tree, block, nodes`` in order, and whether it is its tree's only one."""
    size = fanout**every
    node = F.struct("pos", *[c for c in level.columns if c not in ("tree", "pos", "n")])
    grouped = level.groupBy("tree", F.floor(F.col("pos") / size).cast("long").alias("block"))
    return grouped.agg(F.array_sort(F.collect_list(node)).alias("nodes"), (F.max("n") <= size).alias("alone"), F.max("n").alias("n"))


def _regenerated(nodes: Column, alone: Column, fanout: int, every: int) -> Column:
    """The levels of a subtree from its stored nodes up; a tree's only subtree ends with its one top node."""

    def next_level(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / fanout).cast("int"))
        grown = F.transform(runs, lambda j: digest(F.array_join(F.slice(last, j * fanout + 1, fanout), "")))
        return F.when(alone & (F.size(last) == 1), levels).otherwise(F.concat(levels, F.array(grown)))

    return F.reduce(F.sequence(F.lit(1), F.lit(every)), F.array(nodes).cast("array<array<string>>"), next_level)


def _siblings(levels: Column, at: Column, fanout: int) -> Column:
    """Of the node ``at`` of the lowest level: what stands before and after its ancestors in their runs, level by level."""

    def siblings(k: Column) -> Column:
        row = F.element_at(levels, k + 1)
        place = F.floor(at / F.pow(F.lit(fanout), k)).cast("int")
        first = (place - place % fanout).cast("int")
        before, after = F.slice(row, first + 1, place - first), F.slice(row, place + 2, first + (fanout - 1) - place)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), siblings)).otherwise(F.array().cast(PATH))


def _stored_levels(leaves: DataFrame, fanout: int, every: int) -> list[DataFrame]:
    """The leaves and each ``every``-th level above them, until every tree has one node."""
    stored = [leaves]
    while (stored[-1].agg(F.max("n")).first()[0] or 0) > 1:
        below, size = stored[-1].select("tree", "pos", "n", "digest"), fanout**every
        levels = _regenerated(F.col("nodes.digest"), F.col("alone"), fanout, every)
        tops = _subtrees(below, fanout, every).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"),
            F.element_at(F.element_at(levels, -1), 1).alias("digest"),
        )
        stored.append(stage(tops, "nodes"))
    return stored


def merkle_manifest(docs: DataFrame, tree: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS,
                    carried: Mapping[str, Column] | None = None, fanout: int = 2, every: int = EVERY) -> Manifest:
    """The manifest of ``docs``: one tree for each value of ``tree`` (null is one, the first), its rows by ``order``.

    Rows of one ``order`` value (null comes first) follow by digest; equal rows are leaves of their own. Nulls and empty
    values are told apart by the digest. ``carried`` names values to go with each leaf in ``row``, beside ``order``. An empty
    table has no tree and no proof. Other columns are ignored. Texts are read once; what is sorted and stored are digests.
    """
    column = lambda name: F.col(f"`{name}`")
    row = F.struct(column(order).alias(order), *[value.alias(name) for name, value in (carried or {}).items()])
    named = F.coalesce(F.concat(F.lit("="), column(tree).cast("string")), F.lit(""))  # null before all values, the others bytewise
    hashed = stage(docs.select(named.alias("tree"), leaf_digest([column(f) for f in fields]).alias("digest"), row.alias("row")), "leaves")
    ranked = global_rank(hashed, ["tree", f"row.`{order}`", "digest"], "place", "leaf_order")
    trees = hashed.groupBy("tree").agg(F.count("*").alias("n"))
    first = ranked.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    leaves = ranked.join(first, "tree").select("tree", (F.col("place") - F.col("first")).alias("pos"), "n", "digest", "row")
    stored = _stored_levels(stage(leaves, "leaves"), fanout, every)
    discard(hashed)
    subroots = global_rank(stored[-1].select(F.col("tree").alias("name"), "digest"), ["name"], "pos", "subroots")
    n = stored[-1].count()
    tops = stage(subroots.select(F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("n"), "digest", "name"), "subroots")
    return Manifest(stored, _stored_levels(tops, fanout, every), fanout, every)


def manifest_digests(docs: DataFrame, fanout: int = 2, every: int = EVERY) -> DataFrame:
    """The contract's columns, each leaf's proof checked against the root; where 7 divides the CRC-32 of the id, a row
    whose ``n_chars`` is one more is presented with the original siblings. A null id is never tampered with."""
    changed = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = merkle_manifest(docs, carried={"shown": F.when(tampered, leaf_digest(changed))}, fanout=fanout, every=every)
    folded = fold(F.coalesce("row.shown", "leaf"), F.col("path"))
    out = manifest.proofs().select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


#: The CRC-32 bit by bit: DuckDB has no function for it.
_SQL_CRC = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("CAST(n_chars AS VARCHAR)")} AS leaf,
    CASE WHEN {_SQL_CRC} % 7 = 0 THEN {_sql_leaf("CAST(n_chars + 1 AS VARCHAR)")} END AS shown
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
steps AS (
  SELECT p.doc_id, p.tree, p.leaf, p.shown, p.pos, l.level AS place,
    CASE WHEN s.digest IS NULL THEN '' WHEN s.pos > (p.pos >> l.level) THEN '>' || s.digest ELSE '<' || s.digest END AS step
  FROM placed p JOIN heights h USING (tree), LATERAL (SELECT unnest(range(h.height)) AS level) l
  LEFT JOIN nodes s ON s.tree = p.tree AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.doc_id, p.tree, p.leaf, p.shown, p.pos, 1000 + l.level,
    CASE WHEN s.digest IS NULL THEN '' WHEN s.pos > (r.pos >> l.level) THEN '>' || s.digest ELSE '<' || s.digest END
  FROM placed p JOIN subroots r USING (tree), LATERAL (SELECT unnest(range((SELECT max(level) FROM tops))) AS level) l
  LEFT JOIN tops s ON s.level = l.level AND s.pos = xor(r.pos >> l.level, 1)),
paths AS (
  SELECT p.tree, p.pos, any_value(p.doc_id) AS doc_id, any_value(p.leaf) AS leaf, any_value(p.shown) AS shown,
    coalesce(list(step ORDER BY place) FILTER (step IS NOT NULL), []) AS path
  FROM placed p LEFT JOIN steps s ON s.tree = p.tree AND s.pos = p.pos GROUP BY p.tree, p.pos),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce([coalesce(shown, leaf)] || path,
      lambda a, s: sha256(CASE WHEN s[1] = '<' THEN s[2:] || a WHEN s[1] = '>' THEN a || s[2:] ELSE a END)) AS folded_root
  FROM paths)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree), (SELECT digest AS root FROM tops WHERE n = 1)
"""
