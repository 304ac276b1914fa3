"""Extendible hashing: a directory indexed by hash-prefix bits in which only oversized buckets split on another bit.

Rows are keyed by the first 60 bits of md5(id). The directory starts as one bucket; a bucket over the byte limit
splits on its next bit until it fits. A bucket without rows is not listed. Byte sums are pre-aggregated by prefix, so no row moves while the directory
grows, and each later round reads only the rows still in oversized buckets. A bucket whose rows share all 60 bits
(repeats of one id, or one row over the limit) cannot be split; it stays and is flagged.

Null texts weigh 0 bytes; very long texts weigh all their bytes; null ids hash as the empty string; repeated rows are rows
of their own in one bucket; an empty table has no shards. Other columns are kept, but columns named as those that are
added are replaced. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, materialise

BITS = 60


def key_bits(col: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(depth, prefix, bytes, rows, oversized) of the buckets for rows (key, bytes); each round goes `step` bits deeper."""
    found, depth, open_rows = None, 0, sized
    while True:
        deep = min(BITS, depth + step)
        fine = open_rows.groupBy(F.shiftrightunsigned("key", BITS - deep).alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"), "p", "b", "n")
        # shiftrightunsigned takes a fixed distance; integer division by a power of two takes a column.
        levels = levels.withColumn("prefix", F.expr(f"p div shiftleft(1L, {deep} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("bytes"), F.sum("n").alias("rows"))
        sums = materialise(sums, "directory")
        # A bucket exists if its parent (within this round) is over the limit; below fitting buckets nothing splits.
        parent = sums.filter(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        live = sums.withColumn("up", F.expr("prefix div 2")).join(parent, ["depth", "up"], "left_semi").unionByName(sums.filter(F.col("depth") == depth).withColumn("up", F.expr("prefix div 2")))
        live = live.drop("up").dropDuplicates(["depth", "prefix"])
        done = live.filter((F.col("bytes") <= limit) | (F.col("depth") == BITS)).withColumn("oversized", F.col("bytes") > limit)
        found = done if found is None else found.unionByName(done)
        over = live.filter((F.col("bytes") > limit) & (F.col("depth") == deep)).select(F.col("prefix").alias("_p"))
        if deep == BITS or over.isEmpty():
            return materialise(found, "directory")
        open_rows = open_rows.withColumn("_p", F.shiftrightunsigned("key", BITS - deep)).join(over, "_p", "left_semi").drop("_p")
        found = found.filter(F.col("depth") <= deep)
        depth = deep


def middle_depth(buckets: dict[int, int]) -> int:
    """The greatest depth at which buckets (their number by depth), listed under each of their prefixes of that depth, are at most doubled."""
    entries = lambda middle: sum(n << max(0, middle - depth) for depth, n in buckets.items())
    middle = min(buckets, default=0)
    while middle < BITS and entries(middle + 1) <= 2 * sum(buckets.values()):
        middle += 1
    return middle


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and shard (prefix bits as text), shard_depth, shard_bytes, shard_rows, oversized.

    Buckets partition the key space. Rows meet them on the prefix of a middle depth: deeper buckets are listed under their
    own prefix of that depth, shallower ones under each of theirs, and the key's range decides. The middle is the greatest
    depth at which that list is no more than twice the number of buckets, which are at most the rows.
    """
    sized = docs.select(key_bits(F.col(id_col)).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    buckets = directory(sized, limit)
    middle = middle_depth({r["depth"]: r["count"] for r in buckets.groupBy("depth").count().collect()})  # at most 61 rows
    first = F.expr(f"shiftleft(shiftrightunsigned(prefix, depth - least(depth, {middle})), {middle} - least(depth, {middle}))")
    listed = buckets.select(
        F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {middle} - least(depth, {middle})) - 1"))).alias("near"),
        F.expr(f"shiftleft(prefix, {BITS} - depth)").alias("from"), F.expr(f"shiftleft(prefix + 1, {BITS} - depth)").alias("to"),
        F.struct(
            F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).alias("shard"),
            F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "oversized",
        ).alias("found"),
    )
    added = ("shard", "shard_depth", "shard_bytes", "shard_rows", "oversized")
    kept = [c for c in docs.columns if c.lower() not in added]
    key, near, low, high, found = fresh(docs, "key", "near", "from", "to", "found")
    rows = docs.select(*[f"`{c}`" for c in kept], key_bits(F.col(id_col)).alias(key))
    rows = rows.withColumn(near, F.shiftrightunsigned(key, BITS - middle))
    listed = listed.toDF(near, low, high, found)
    return rows.join(listed, near).filter((F.col(key) >= F.col(low)) & (F.col(key) < F.col(high))).select(*[f"`{c}`" for c in kept], f"{found}.*")
