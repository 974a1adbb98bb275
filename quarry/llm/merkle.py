"""A Merkle manifest of a table: a digest for every row, one for the table, and a proof for each row.

Rows are the leaves of one tree for each group (``source``), in the order of their
key; the trees' roots, in the order of their groups, are the leaves of the tree of
the whole table. In a tree, every ARITY consecutive nodes (the last run may be
shorter, even one node) become the digest of their concatenation, until one is left.

Leaves are dealt out in aligned blocks of BLOCK (ARITY ** LEVELS) consecutive ones.
One pass over the blocks gives their roots, which are the leaves of the tree above;
that is done again until every tree has one node. Then paths go down: a block gets
the path of its root, once for all its rows, and :func:`traverse` walks its leaves
in order, advancing the authentication path from leaf to leaf. A treehash stack on
each level takes one leaf a step and has the level's next run ready when the walk
enters it, so that the walk holds ARITY nodes for each pair of levels and not the
block's tree. What is above the block is appended to each path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, fresh, join_by_size, materialise, ranked

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
_SHIFT = BLOCK.bit_length() - 1
#: Characters of a digest.
WIDTH = 64
#: What a leaf holds of a row, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Up to so many groups are sent to all executors; more are joined.
FEW_TREES = 100_000

_PATH = "array<struct<run:string,at:int>>"


def digest(content: str) -> str:
    return sha256(content.encode()).hexdigest()


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: of each value ``-`` if null, else its byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` of them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """The nodes of a level over leaves that come one by one; below it fewer than ARITY wait on each level."""

    def __init__(self, level: int):
        self.level = level
        self.waiting: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, node: str) -> None:
        at = 0
        self.waiting[0].append(node)
        while at < self.level and len(self.waiting[at]) == ARITY:
            self.raise_run(at)
            at += 1

    def raise_run(self, at: int) -> None:
        self.waiting[at + 1].append(digest("".join(self.waiting[at])))
        self.waiting[at] = []

    def close(self) -> list[str]:
        """The nodes of the level; what still waits below is the tree's end."""
        for at in range(self.level):
            if self.waiting[at]:
                self.raise_run(at)
        return self.waiting[self.level]


def block_root(leaves: Sequence[str], levels: int) -> str:
    stack = Treehash(levels)
    for node in leaves:
        stack.push(node)
    return stack.close()[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[list[str]]]:
    """For each leaf in turn the run of nodes around its ancestor on every level, from its own level up.

    The ancestor of leaf ``i`` is node ``i // ARITY ** level % ARITY`` of its run.
    The lists are the walk's own: they hold until the next leaf is asked for.
    """
    spans = [ARITY ** (level + 1) for level in range(levels)]
    runs, ahead = [], [Treehash(level) for level in range(levels)]
    for level, span in enumerate(spans):
        first = Treehash(level)
        for node in leaves[:span]:
            first.push(node)
        runs.append(first.close())
    for i in range(len(leaves)):
        yield runs
        for level, span in enumerate(spans):
            if i + span < len(leaves):
                ahead[level].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[level], ahead[level] = ahead[level].close(), Treehash(level)


def _without(run: str, at: int) -> str:
    return run[: WIDTH * at] + run[WIDTH * (at + 1) :]


def fold(node: str, path: Sequence[tuple[str, int]]) -> str:
    """The root above ``node``: on each level it takes its place in the run and becomes the run's digest."""
    for run, at in path:
        node = digest(run[: WIDTH * at] + node + run[WIDTH * (at + 1) :])
    return node


def siblings(path: Sequence[tuple[str, int]]) -> str:
    """What proves a leaf: the other nodes of its runs, level by level, left to right."""
    return "".join(_without(run, at) for run, at in path)


def walk(leaves: Sequence[str], levels: int, above: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    """The path of each leaf of a block: its own levels, then the block's path ``above``."""
    path = [("", 0)] * levels
    for i, runs in enumerate(traverse(leaves, levels)):
        for level in range(levels):
            step = ARITY**level
            if i % step == 0:  # else this level's ancestor is still the same
                run = path[level][0] if i % (step * ARITY) else "".join(runs[level])
                path[level] = (run, i // step % ARITY)
        yield path + above


def _above(row: dict) -> list[tuple[str, int]]:
    return [(p["run"], p["at"]) for p in row["path"]]


def _levels(n: int) -> int:
    return min(LEVELS, height(n))


def block_roots(nodes: DataFrame) -> DataFrame:
    """From (tree, pos, n, node) the roots of all blocks, as the leaves above: the same columns."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])

    def roots(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block, n = (k.as_py() for k in key)
        leaves = rows.sort_by("pos")["node"].to_pylist()
        return pa.Table.from_pydict({"tree": [tree], "pos": [block], "n": [-(-n // BLOCK)], "node": [block_root(leaves, _levels(n))]}, schema)

    dealt = nodes.select("tree", F.shiftright("pos", _SHIFT).alias("block"), "n", "pos", "node")
    return dealt.groupBy("tree", "block", "n").applyInArrow(roots, "tree string, pos long, n long, node string")


def node_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The path (tree, pos, path) of each node (tree, pos, n, node), given those of the blocks' roots."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("run", pa.string()), ("at", pa.int32())])))])

    def paths(key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("pos")
        walked = walk(rows["node"].to_pylist(), _levels(rows["n"][0].as_py()), _above(blocks.to_pylist()[0]))
        found = [[{"run": run, "at": at} for run, at in path] for path in walked]
        return pa.Table.from_pydict({"tree": rows["tree"].to_pylist(), "pos": rows["pos"].to_pylist(), "path": found}, schema)

    dealt = nodes.select("tree", F.shiftright("pos", _SHIFT).alias("block"), "n", "pos", "node").groupBy("tree", "block")
    return dealt.cogroup(above.select("tree", F.col("pos").alias("block"), "path").groupBy("tree", "block")).applyInArrow(paths, f"tree string, pos long, path {_PATH}")


def climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """``nodes`` and what is above them, block by block, until each tree has one node."""
    rounds = [nodes]
    while largest > 1:
        rounds.append(materialise(block_roots(rounds[-1]), "nodes"))
        largest = -(-largest // BLOCK)
    return rounds


def place(leaves: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """``leaves`` (with ``tree``) with their place ``pos`` in the tree and its size ``n``; and the largest size."""
    rows = ranked(leaves, [F.col("tree"), *order], "pos")
    trees = rows.groupBy("tree").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    trees = materialise(trees, "trees")
    count, total, largest = trees.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    joined = rows.join(F.broadcast(trees), "tree") if count <= FEW_TREES else join_by_size(rows, trees, ["tree"], "n", total)
    return joined.withColumn("pos", F.col("pos") - F.col("first")).drop("first"), largest or 0


def manifest(docs: DataFrame, tampered: Column | None = None, columns: Sequence[str] = COLUMNS, group: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per row: its key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the row's siblings from its leaf to the root.
    ``folded_root`` is what these siblings and a leaf lead to: the leaf of
    ``tampered`` (a digest, as :func:`leaf` makes) where that isn't null, and
    else the row's own; ``verified`` says whether it is the root.

    Nulls in any column have a leaf of their own (``-``); a null group is a tree,
    before all others, and null keys come first in a tree. Rows that repeat a key
    are leaves in the order of their digests; rows that are the same in all
    columns take turns. Empty and long texts are digested whole. A table of one row
    is its own root, with the digest of nothing as proof; an empty one gives an empty
    result. Other columns aren't read, whatever their names.
    """
    (tie,) = fresh(docs, "tie")
    own = leaf([F.col(c) for c in columns])
    other = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("key"),
        own.alias("node"), other.alias("other"), F.monotonically_increasing_id().alias(tie),
    )
    leaves = materialise(leaves, "leaves")  # texts are read once
    rows, largest = place(leaves, [F.col("key").asc_nulls_first(), F.col("node"), F.col(tie)])
    discard(leaves)
    rows = rows.drop(tie)
    trees = climb(rows.select("tree", "pos", "n", "node"), largest)
    subroots = trees[-1].select(F.col("tree").alias("of"), "node", F.lit("").alias("tree"))
    placed, count = place(subroots, [F.col("of")])
    forest = climb(placed.select("tree", "pos", "n", "node"), count)
    root = forest[-1].select("tree", "pos", F.array().cast(_PATH).alias("path"))
    above = root
    for nodes in forest[-2::-1]:
        above = node_paths(nodes, above)
    above = placed.select("of", "pos", F.col("node").alias("subroot")).join(above.select("pos", "path"), "pos").crossJoin(F.broadcast(forest[-1].select(F.col("node").alias("root"))))  # one row
    tops = materialise(above.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"), "tops")
    above = tops.select("tree", "pos", "path")
    for nodes in trees[-2:0:-1]:
        above = node_paths(nodes, above)
    above = above.join(tops.select("tree", "subroot", "root"), "tree")
    kind = docs.schema[key].dataType.simpleString()
    return _proofs(rows, above, kind).withColumnRenamed("key", key)


def _proofs(rows: DataFrame, above: DataFrame, kind: str) -> DataFrame:
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def prove(key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        rows, block = rows.sort_by("pos"), blocks.to_pylist()[0] if blocks.num_rows else None
        found: dict[str, list] = {"leaf": rows["node"].to_pylist(), "subroot": [], "root": [], "proof_sha256": [], "folded_root": []}
        if block:
            above, levels = _above(block), _levels(rows["n"][0].as_py())
            shared = siblings(above)
            for node, other, path in zip(found["leaf"], rows["other"].to_pylist(), walk(found["leaf"], levels, above), strict=True):
                found["proof_sha256"].append(digest(siblings(path[:levels]) + shared))
                found["folded_root"].append(fold(other or node, path))
            for name in ("subroot", "root"):
                found[name] = [block[name]] * rows.num_rows
        return pa.table([rows["key"], *[pa.array(found[n], pa.string()) for n in names]], ["key", *names])

    dealt = rows.select("tree", F.shiftright("pos", _SHIFT).alias("block"), "pos", "n", "key", "node", "other").groupBy("tree", "block")
    paths = above.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    out = dealt.cogroup(paths).applyInArrow(prove, f"key {kind}, " + ", ".join(f"{n} string" for n in names))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
