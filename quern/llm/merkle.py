"""Merkle manifest of a dataset as a postorder append log.

A leaf is the digest of a row's fields. Per group the leaves, in order, are the bottom of a tree of three children a node;
the group roots, in order of the groups, are the leaves of one more such tree, whose root names the dataset.

Every tree is cut into aligned blocks of 3**HEIGHT leaves. One builder takes a block and appends its nodes in the order of
their completion, that is in postorder, to its segment of the log; the last nodes of a ragged end complete together,
lowest first. The roots of the blocks are the leaves of the next round, until a tree has one block. As all blocks before
it are full, a segment starts at block * (nodes of a full block), and a node's place in it follows from the sizes of the
subtrees that are complete before it (`position`), so proofs are read out of the log by address, without a search.

Memory is bounded by a block. Ranks come from range partitions, so a group may hold any share of the rows. Paths above a
block are read once for each block.

Null fields are `-`. A null group is a group of its own and comes first; null ids come first in their group. Rows of one
id follow each other in the order of their leaves; equal rows are leaves of their own. Empty texts are values of 0 bytes,
very long ones are hashed whole. An empty table has no rows and no root. Columns with clashing names do no harm: only the
named ones are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, materialise

#: Children of a node, levels of a block above its leaves, characters of a digest.
ARITY, HEIGHT, WIDE = 3, 6, 64
BLOCK = ARITY**HEIGHT


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def position(level: int, index: int, leaves: int) -> int:
    """Place of the node `index` of `level` in the postorder of a tree with so many leaves, from 0.

    The node completes with its last leaf. By then every level up to its own has completed as many nodes as that many
    leaves need, itself the last of them, and every higher level only those that ended before.
    """
    end = min(leaves, (index + 1) * ARITY**level)
    place, size = -1, 1
    for k in range(HEIGHT + 1):
        place += -(-end // size) if k <= level else (end - 1) // size
        size *= ARITY
    return place


def append(digests: list[str]) -> list[str]:
    """The nodes over these leaves (at most BLOCK) in the order of their completion; levels as in a whole block if it is one of many."""
    return _append(digests, height(len(digests)))


def _append(digests: list[str], levels: int) -> list[str]:
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]
    for k, node in enumerate(digests):
        log.append(node)
        waiting[0].append(node)
        for level in range(levels):
            if len(waiting[level]) < ARITY and k < len(digests) - 1:
                break
            log.append(H("".join(waiting[level])))
            waiting[level].clear()
            waiting[level + 1].append(log[-1])
    return log


def _paths(segment: str, leaves: int, levels: int, above: list[str]) -> list[list[str]]:
    """For each leaf of a segment the siblings left and right of its path, level by level, and then those above."""

    def nodes(level: int, lo: int, hi: int) -> str:
        return "".join(segment[WIDE * p : WIDE * (p + 1)] for p in (position(level, j, leaves) for j in range(lo, hi)))

    paths = [above]
    for level in reversed(range(levels)):
        n, below = -(-leaves // ARITY**level), []
        for i in range(n):
            run = i - i % ARITY
            below.append([nodes(level, run, i), nodes(level, i + 1, min(run + ARITY, n)), *paths[i // ARITY]])
        paths = below
    return paths


def leaf_digest(*fields: F.Column) -> F.Column:
    """SHA-256 in hex of the fields in turn: `-` if null, else the number of UTF-8 bytes, `:` and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, which have a column `tree`, with rank (from 0, by `keys` within the tree) and size (rows of the tree)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["part int, own long"])
    names = [*rows.columns, "part", "own"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(names.index("tree")), run_end_type=pa.int64())
            ends = runs.run_ends.to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            own = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
            if runs.values[0].as_py() == last:
                own[: ends[0]] += seen
            last, seen = runs.values[-1].as_py(), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part), pa.int32()), pa.array(own, pa.int64())], names)

    ordered = rows.repartitionByRange("tree", *keys).sortWithinPartitions("tree", *keys)
    numbered = materialise(ordered.mapInArrow(number, schema), "ranked")
    counts = numbered.groupBy("tree", "part").agg((F.max("own") + 1).alias("n"))
    tree = Window.partitionBy("tree")
    before = counts.select("tree", "part", F.sum("n").over(tree.orderBy("part")).alias("upto"), "n", F.sum("n").over(tree).alias("size"))
    # One row for each tree and partition, so no key has more rows than a partition.
    out = numbered.join(before.hint("merge"), ["tree", "part"])
    return out.select(*rows.columns, (F.col("own") + F.col("upto") - F.col("n")).alias("rank"), "size")


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The log over leaves (tree, rank, size, digest), a table a round: tree, block, size (leaves of the tree in that round), segment."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        size = int(block["size"].iloc[0])
        log = _append(block["digest"].tolist(), min(HEIGHT, height(size)))
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "block": [block["rank"].iloc[0] // BLOCK], "size": [size], "segment": ["".join(log)]})

    rounds: list[DataFrame] = []
    while True:
        blocks = leaves.select("tree", "rank", "size", "digest").groupBy("tree", F.expr(f"rank div {BLOCK}"))
        rounds.append(materialise(blocks.applyInPandas(build, "tree string, block long, size long, segment string"), "log"))
        most = rounds[-1].agg(F.max("size")).first()[0]
        if most is None or most <= BLOCK:
            return rounds
        leaves = rounds[-1].filter(F.col("size") > BLOCK).select("tree", F.col("block").alias("rank"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), F.substring("segment", -WIDE, WIDE).alias("digest"))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree: the last node of its last round."""
    last = [r.filter(F.col("size") <= BLOCK).select("tree", F.substring("segment", -WIDE, WIDE).alias("digest")) for r in rounds]
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return out


def _extract(members: DataFrame, segments: DataFrame, above: DataFrame) -> DataFrame:
    """members (tree, rank, ...) with their path through their block's segment and the path and subroot above the block."""
    names = members.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema] + ["path array<string>, subroot string"])
    kinds = pa.schema([("path", pa.list_(pa.string())), ("subroot", pa.string())])

    def read(own: pa.Table, segment: pa.Table) -> pa.Table:
        ranks = own.column("rank").to_numpy()
        row = segment.to_pylist()[0] if segment.num_rows else None
        if not len(ranks) or row is None:
            raise ValueError(f"the log has no segment for {len(ranks)} leaves, or no leaves for a segment")
        first = row["block"] * BLOCK
        n = min(BLOCK, row["size"] - first)
        paths = _paths(row["segment"], n, min(HEIGHT, height(row["size"])), row["path"])
        found = [pa.array([paths[k - first] for k in ranks.tolist()], kinds[0].type), pa.array([row["subroot"]] * len(ranks), kinds[1].type)]
        return pa.Table.from_arrays([*(own.column(c) for c in names), *found], names=[*names, "path", "subroot"])

    of = F.expr(f"rank div {BLOCK}")
    right = segments.join(above, ["tree", "block"])
    return members.groupBy("tree", of).cogroup(right.groupBy("tree", "block")).applyInArrow(read, schema)


def _above(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, block, path, subroot) above each block of the first round; tops: (tree, path, subroot) above each tree."""
    known: DataFrame | None = None
    for k in reversed(range(len(rounds))):
        found = rounds[k].filter(F.col("size") <= BLOCK).select("tree", "block").join(tops, "tree")
        if known is not None:
            open_ = rounds[k].filter(F.col("size") > BLOCK).select("tree", F.col("block").alias("rank"))
            found = found.unionByName(_extract(open_, rounds[k + 1], known).withColumnRenamed("rank", "block"))
        known = materialise(found, "paths")
    return known


class Manifest(NamedTuple):
    """root of the dataset (None if empty); leaves (tree, rank, size, digest and the columns that were kept); the log of the groups and of the tree over them."""

    root: str | None
    leaves: DataFrame
    groups: list[DataFrame]
    top: list[DataFrame]
    ordered: DataFrame


def build(rows: DataFrame) -> Manifest:
    """rows: tree (group as text, sorts as its groups do), id, digest, and columns to keep."""
    written = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = materialise(ranked(written, ["id", "digest", "row"]).drop("row"), "leaves")
    discard(written)
    groups = grow(leaves)
    named = roots(groups).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    ordered = materialise(ranked(named, ["name"]), "roots")
    top = grow(ordered)
    root = roots(top).first()
    return Manifest(root[1] if root else None, leaves, groups, top, ordered)


def prove(manifest: Manifest) -> DataFrame:
    """The leaves with path (siblings left and right of each step up, level by level to the dataset's root) and subroot."""
    empty = manifest.ordered.sparkSession.createDataFrame([("", [], None)], "tree string, path array<string>, subroot string")
    over = _above(manifest.top, empty)
    steps = _extract(manifest.ordered.select("tree", "rank", "name", "digest"), manifest.top[0], over)
    tops = materialise(steps.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "paths")
    return _extract(manifest.leaves, manifest.groups[0], _above(manifest.groups, tops))


def fold(leaf: F.Column, path: F.Column) -> F.Column:
    """The root that a leaf's digest and a path give."""
    steps = F.sequence(F.lit(1), F.size(path), F.lit(2))
    up = F.aggregate(steps, leaf, lambda d, k: F.sha2(F.concat(F.element_at(path, k), d, F.element_at(path, k + 1)).cast("binary"), 256))
    return F.when(F.size(path) > 0, up).otherwise(leaf)


def group_key(col: F.Column) -> F.Column:
    """Text that is never null and sorts as the groups do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def brute_force(rows: list[tuple], tampered: list[tuple]) -> list[tuple]:
    """Reference for tests over rows (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root of each, by (source, doc_id, leaf)."""

    def leaf(row: tuple) -> str:
        return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def climb(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
        steps = []
        for level in tree[:-1]:
            lo = i // 3 * 3
            steps.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
            i //= 3
        return steps

    by: dict[str | None, list] = {}
    for row, other in zip(rows, tampered, strict=True):
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0], leaf(other)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([r[2] for r in sorted(by[s])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(sorted(by[s])):
            steps, folded = climb(trees[s], i) + climb(top, k), r[4]
            for a, b in steps:
                folded = H(a + folded + b)
            out.append((r[3], r[2], trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), folded))
    return out
