"""Exact and near duplicates by 64-bit codes, leakage audits and content hashes."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import number


def word_simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, code) over the distinct lower-case letter words of each text: a bit is set in more word hashes than not.

    One aggregate of 32 sums, each of two counters side by side, which is partial before the shuffle.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(text_col), r"[^\p{L}]+"), lambda w: w != ""))
    long = docs.select(F.col(id_col).alias("id"), F.explode_outer(words).alias("w"))
    long = long.select("id", F.conv(F.substring(F.sha2("w", 256), 1, 16), 16, -10).cast("long").alias("h"))
    pair = F.lit(0x0000000100000001).cast("long")
    counts = long.groupBy("id").agg(F.count("h").alias("n"), *[F.coalesce(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair)), F.lit(0)).alias(f"c{i}") for i in range(32)])
    code = F.lit(0).cast("long")
    for i in range(64):
        ones = F.shiftrightunsigned(f"c{i - 32}", 32) if i >= 32 else F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        code = code.bitwiseOR(F.when(ones * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counts.select("id", code.alias("code"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masks(threshold: int) -> list[int]:
    """Signed 64-bit masks such that two codes within `threshold` bits agree under one at least.

    The bits are cut into threshold + k blocks, of which k at least hold no differing bit: a mask for every choice of k.
    Three blocks, of 32 bits together at threshold 3, keep the classes of equal masked codes small; two do beyond it.
    """
    k = 3 if threshold <= 3 else 2
    edges = [round(64 * i / (threshold + k)) for i in range(threshold + k + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    chosen = (sum(c) for c in itertools.combinations(blocks, k))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def near_pairs(codes: DataFrame, threshold: int) -> DataFrame:
    """(a, b, dist) of pairs of different codes within `threshold` bits, exactly: equi-joins on masked codes, then verification.

    codes: distinct `code`. Each pair comes from the first mask under which its codes agree, so none is repeated. Codes are
    keyed by every mask, many times their size as a file, by which Spark would broadcast them; so they are merged by hint.
    """
    own = [F.lit(m).cast("long") for m in masks(threshold)]
    keyed = codes.select("code", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("code").bitwiseAND(m).alias("value")) for i, m in enumerate(own)])).alias("k")).select("code", "k.*")
    x, y = keyed.select(F.col("code").alias("a"), "mask", "value"), keyed.select(F.col("code").alias("b"), "mask", "value")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = x.join(y.hint("merge"), ["mask", "value"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= threshold))
    first = F.coalesce(*[F.when(differ.bitwiseAND(m) == 0, i) for i, m in enumerate(own)])
    return pairs.filter(F.col("mask") == first).select("a", "b", F.bit_count(differ).alias("dist"))


def content_hash(df: DataFrame, order: list[str], line: Column, fan: int = 1024) -> DataFrame:
    """One row: a sha256 of the lines in order, and the number of rows.

    A tree of three levels: the sha256 of each `fan` newline-joined lines, of each `fan` of those digests, and of what then
    is left. Null lines are left out; the digest is null if there is none. Lines of equal order come in their own order.
    """
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    keys = [*order, "_line"]
    level = number(df.select(*order, line.alias("_line")).filter("_line is not null"), keys, "_i").select("_i", "_line")

    def digest(rows: DataFrame, *by: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda x: x["_line"]), "\n")
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sha2(joined, 256).alias("_line"))

    for _ in range(2):
        level = digest(level.withColumn("_b", F.expr(f"(_i - 1) div {fan}")), "_b").select((F.col("_b") + 1).alias("_i"), "_line")
    top = digest(level).select(F.when(F.col("_n") > 0, F.col("_line")).alias("dataset_sha256"))
    return top.crossJoin(F.broadcast(total))  # one row each


def crossing(df: DataFrame, key: str, split: str) -> DataFrame:
    """Non-empty keys that occur in more than one split, with the sorted splits."""
    t = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return t.filter(F.size("splits") > 1)
