"""SimHash near-duplicates through a binary trie joined with itself.

Every document gets a 64-bit fingerprint of its 3-word shingles. The different fingerprints form a binary trie. Pairs
of trie nodes are traversed together from the root, differing bits are added up, and a pair is dropped as soon as
they exceed the budget. The top of the traversal runs as Spark joins over nodes, a few bits a round, until a node
holds at most `leaf` fingerprints; crowded prefixes simply go deeper. Each pair of leaves is then one row, whose
traversal goes on inside a task. Linked pairs leave a task as spanning edges, never as all pairs of a group.

Whole texts are hashed, in stretches of bounded memory however long they are. Null texts and texts without words have
fingerprint 0, linked like any other. Ids are numbers; rows with a null id take part and have a null id in the result; a
component of null ids only has a null component_id. Repeated rows are each returned. Other columns are not read, but
`representatives` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NULL_ID, components, hot_keys, join_hot, materialise, small_batches, star_edges

_CHUNK = 65_536


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -width] + 1]).tolist()
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def fingerprint(text: str | None) -> int:
    """The bits that are set in more than half of the shingle hashes."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), _CHUNK):
        total += np.unpackbits(h[lo : lo + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text) and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["doc_id", "_h", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h")).mapInArrow(run, "doc_id long, _h long, fp long")


def linked(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of sorted unsigned fingerprints within `budget` bits: node pairs are traversed level by level.

    Above `depth` each side's fingerprints agree among themselves. A pair of nodes is its two ranges.
    """
    err = 0 if depth == 0 or not len(a) or not len(b) else (int(a[0]) >> (64 - depth) ^ int(b[0]) >> (64 - depth)).bit_count()
    if err > budget or not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.array([[0, len(a), 0, len(b), err]])
    out_i, out_j = [], []

    def middle(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
        ones = np.concatenate([[0], np.cumsum((x >> bit) & np.uint64(1))]).astype(np.int64)
        return hi - (ones[hi] - ones[lo])  # within a node, fingerprints with the bit stand last

    for level in range(depth, 65):
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= (16 if level < 64 else 1 << 62)
        for_now, pairs = pairs[small], pairs[~small]
        if len(for_now):
            na, nb = for_now[:, 1] - for_now[:, 0], for_now[:, 3] - for_now[:, 2]
            n = na * nb
            own = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = for_now[own, 0] + k // nb[own], for_now[own, 2] + k % nb[own]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            out_i.append(i[near])
            out_j.append(j[near])
        if not len(pairs) or level == 64:
            break
        bit = np.uint64(63 - level)
        ma, mb = middle(a, pairs[:, 0], pairs[:, 1], bit), middle(b, pairs[:, 2], pairs[:, 3], bit)
        a0, a1, b0, b1, e = pairs.T
        nxt = np.concatenate([np.stack(x, 1) for x in ((a0, ma, b0, mb, e), (ma, a1, mb, b1, e), (a0, ma, mb, b1, e + 1), (ma, a1, b0, mb, e + 1))])
        alive = (nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)
        if same:  # of two different nodes, one order is enough
            alive &= nxt[:, 0] <= nxt[:, 2]
        pairs = nxt[alive]
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def trie_edges(codes: DataFrame, budget: int = 2, leaf: int = 2048, step: int = 4) -> DataFrame:
    """Spanning edges (a, b) of the pairs of different codes (column fp, distinct) within `budget` differing bits."""
    codes = codes.select("fp")
    prefix = lambda depth: F.shiftrightunsigned("fp", 64 - depth)
    spark = codes.sparkSession
    nodes = spark.createDataFrame([(0, 0, False)], "d int, p long, leaf boolean")  # the root is always an inner node
    depth, placed, open_codes = step, None, codes
    while True:  # grow the trie until every leaf is small
        count = materialise(open_codes.groupBy(prefix(depth).alias("p")).agg(F.count(F.lit(1)).alias("n")), "nodes")
        level = count.select(F.lit(depth).alias("d"), "p", (F.col("n") <= leaf).alias("leaf"))
        nodes = nodes.unionByName(level)
        tagged = open_codes.withColumn("p", prefix(depth)).join(count, "p")
        here = tagged.filter(F.col("n") <= leaf).select(F.lit(depth).alias("d"), "p", "fp")
        placed = here if placed is None else placed.unionByName(here)
        if count.filter(F.col("n") > leaf).isEmpty():
            break
        open_codes = materialise(tagged.filter(F.col("n") > leaf).select("fp"), "open")
        depth += step
    deepest = depth
    nodes = materialise(nodes, "trie")
    child = nodes.select((F.col("d") - step).alias("pd"), F.shiftrightunsigned("p", step).alias("pp"), "d", "p", "leaf")
    pairs = nodes.filter("d = 0").select(F.col("d").alias("da"), F.col("p").alias("pa"), F.col("leaf").alias("la"), F.col("d").alias("db"), F.col("p").alias("pb"), F.col("leaf").alias("lb"))
    done = None
    for _ in range(0, deepest + step, step):  # traverse node pairs together; inner nodes give way to their children
        ended = pairs.filter("la and lb")
        done = ended if done is None else done.unionByName(ended)
        go = pairs.filter("not (la and lb)")
        for x in "ab":
            c = child.select(F.col("pd").alias(f"d{x}"), F.col("pp").alias(f"p{x}"), F.col("d").alias("_d"), F.col("p").alias("_p"), F.col("leaf").alias("_l"))
            stay = go.filter(f"l{x}").select("*", F.col(f"d{x}").alias("_d"), F.col(f"p{x}").alias("_p"), F.col(f"l{x}").alias("_l"))
            down = go.filter(f"not l{x}").join(c, [f"d{x}", f"p{x}"]).select(*stay.columns)
            go = stay.unionByName(down).drop(f"d{x}", f"p{x}", f"l{x}").withColumnsRenamed({"_d": f"n_d{x}", "_p": f"n_p{x}", "_l": f"n_l{x}"})
        go = go.withColumnsRenamed({f"n_{c}{x}": f"{c}{x}" for x in "ab" for c in "dpl"})
        common = F.least("da", "db")
        cut = lambda x: F.expr(f"shiftrightunsigned(p{x}, d{x} - least(da, db))")  # noqa: E731, B023
        differ = F.bit_count(cut("a").bitwiseXOR(cut("b"))) <= budget
        # of two different nodes one order is enough: order by prefix at the common depth, then by depth
        order = (cut("a") < cut("b")) | ((cut("a") == cut("b")) & ((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("pa") <= F.col("pb")))))
        pairs = materialise(go.filter(differ & order & (common >= 0)), "pairs")
        if pairs.isEmpty():
            break
    else:
        done = done.unionByName(pairs.filter("la and lb"))
    blocks = materialise(placed.groupBy("d", "p").agg(F.collect_list("fp").alias("codes")), "leaves")  # at most `leaf` codes each
    both = done.join(blocks.select(F.col("d").alias("da"), F.col("p").alias("pa"), F.col("codes").alias("a")), ["da", "pa"]).join(blocks.select(F.col("d").alias("db"), F.col("p").alias("pb"), F.col("codes").alias("b")), ["db", "pb"])
    both = both.select(F.least("da", "db").alias("depth"), ((F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))).alias("same"), "a", "b")
    both = both.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for d, s, x, y in zip(*batch.columns, strict=True):
                a, b = (np.sort(v.values.to_numpy(zero_copy_only=False).view(np.uint64)) for v in (x, y))
                i, j = linked(a, b, d.as_py(), budget, s.as_py())
                left.append(a[i].view(np.int64))
                right.append(b[j].view(np.int64))
            p, q = star_edges(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _groups(classes: DataFrame, budget: int, leaf: int) -> DataFrame:
    """classes (distinct fp, least, perhaps more) with root, the same for linked fingerprints."""
    classes = materialise(classes, "classes")
    roots = components(trie_edges(classes, budget, leaf))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, budget: int = 2, leaf: int = 2048) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of its linked group) of every row."""
    prints = materialise(fingerprints(docs).drop("_h"), "prints")
    whole = _groups(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), budget, leaf)
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialise(whole.join(least, "root").select("fp", "n", "component_id"), "labels")
    return join_hot(prints, labels.drop("n"), "fp", hot_keys(labels, "fp"), ["doc_id"]).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, budget: int = 2, leaf: int = 2048) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (null ids last), then the smallest hash of its text.

    Rows equal in id and text are one document, of which one row stays; unlike texts under one id, or without id, are
    documents of their own.
    """
    prints = materialise(fingerprints(docs), "prints")
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("least"))
    found = _groups(least, budget, leaf).groupBy("root").agg(F.min("least").alias("least"))
    found = found.select(F.coalesce("least.doc_id", F.lit(NULL_ID)).alias("_id"), F.col("least._h").alias("_h"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_h"))
    return rows.join(found, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select("_row.*")


def brute_force(texts: list[tuple[int, str | None]], budget: int = 2) -> dict[int, tuple[str, int]]:
    """Reference for tests: fingerprint and component of each document from all pairs."""
    fp = [fingerprint(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= budget and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {d: (f"{fp[i]:016x}", min(texts[k][0] for k in range(len(texts)) if group[k] == group[i])) for i, (d, _) in enumerate(texts)}

