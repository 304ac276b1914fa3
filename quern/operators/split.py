"""Group-safe splitting and deterministic sampling. Random order is the order of a hash, so every result can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordered import number, number_within, running_total


def hashed(*keys) -> Column:
    """Order of chance: md5 of the keys as text, joined by colons."""
    return F.md5(F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary"))


def group_split(groups: DataFrame, share: float = 0.15) -> DataFrame:
    """(grp, split) for rows (grp, cls, n): whole groups in test, validation and train.

    The largest group of each class (ties: the smallest name) is its anchor and stays in train, so no class leaves train.
    The others come in the order of their hash: while the rows before a group are under the share of all rows, it is
    test; while they are under twice that, validation; then train. Each held-out part exceeds its share by less than its last group.
    """
    anchors = groups.groupBy("cls").agg(F.min_by("grp", F.struct(-F.col("n"), "grp")).alias("grp")).select("grp").distinct().withColumn("anchor", F.lit(True))
    sizes = groups.groupBy("grp").agg(F.sum("n").alias("n")).join(anchors, "grp", "left").withColumn("h", hashed("grp"))
    target = sizes.agg(F.greatest(F.lit(1), F.bround(F.lit(share) * F.sum("n"))).cast("long").alias("target"))
    placed = running_total(sizes.filter("anchor is null"), ["h", "grp"], "n").crossJoin(F.broadcast(target))  # one row
    split = F.when(F.col("before") < F.col("target"), "test").when(F.col("before") < 2 * F.col("target"), "validation").otherwise("train")
    return placed.select("grp", split.alias("split")).unionByName(sizes.filter("anchor").select("grp", F.lit("train").alias("split")))


def legacy_split(keys: DataFrame, label: str, key: str) -> DataFrame:
    """(label, key, split) per label 70/15/15 by distinct keys in hashed order; small labels keep one key at least in train."""
    rows = number_within(keys.select(label, key).distinct().withColumn("_h", hashed(label, key)), [label], ["_h", key], "_k")
    count = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    train = F.when(n < 3, F.greatest(F.lit(1), n - 1)).otherwise(F.least(F.greatest(F.lit(1), F.bround(n * F.lit(0.7))), n - 2))
    held = n - train
    validation = F.when(n < 3, F.lit(0)).otherwise(F.least(F.greatest(F.lit(1), F.bround(n * F.lit(0.15))), held - 1))
    split = F.when(F.col("_k") <= train, "train").when(F.col("_k") <= train + validation, "validation").otherwise("test")
    return rows.join(count, label).select(label, key, split.alias("split"))


def cut(df: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """df with `held`: true for the first `share` of the rows (rounded down) in hashed order of the key."""
    rows = number(df.withColumn("_h", hashed(key)), ["_h", key], "_n")
    total = rows.agg((F.count(F.lit(1)) * F.lit(share)).cast("long").alias("_most"))
    return rows.crossJoin(F.broadcast(total)).withColumn("held", F.col("_n") <= F.col("_most")).drop("_h", "_n", "_most")  # one row


def stratified(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k rows of each class with the smallest md5 of the key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(hashed(key), key))).filter(F.col("_r") <= k).drop("_r")


def weighted_without_replacement(df: DataFrame, by: list[str], weight: str, uniform: str, k: int) -> DataFrame:
    """Efraimidis-Spirakis: the k rows of each group with the smallest exponential times, from a uniform column in (0, 1]."""
    race = -F.ln(F.col(uniform)) / F.col(weight)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(race))).filter(F.col("_r") <= k).drop("_r")


def episodes(rows: DataFrame, label: str, key: str, parent: str, count: int, ways: int, shots: int, queries: int, seed: int = 2026) -> DataFrame:
    """(episode, label, key, role): `count` episodes of `ways` classes, with `shots` support and `queries` query rows each.

    Rows of a class come from different parents while there are enough; what then is missing is drawn again from the class.
    """
    spark, need = rows.sparkSession, shots + queries
    drawn = rows.select(label).distinct().crossJoin(F.broadcast(spark.range(1, count + 1).toDF("episode")))
    drawn = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("episode").orderBy(hashed(F.lit(seed), "episode", label), label))).filter(F.col("_r") <= ways).drop("_r")
    own = drawn.join(rows.select(label, key, parent), label)
    one = own.withColumn("_r", F.row_number().over(Window.partitionBy("episode", label, parent).orderBy(hashed(F.lit(seed), "episode", key), key))).filter("_r = 1")
    first = one.withColumn("_k", F.row_number().over(Window.partitionBy("episode", label).orderBy(hashed(F.lit(seed), "episode", parent), parent))).filter(F.col("_k") <= need)
    have = first.groupBy("episode", label).agg(F.count(F.lit(1)).alias("_have"))
    spare = own.withColumn("_k", F.row_number().over(Window.partitionBy("episode", label).orderBy(hashed(F.lit(seed), F.lit("again"), "episode", key), key))).filter(F.col("_k") <= need)
    again = spare.join(have, ["episode", label]).filter(F.col("_k") <= need - F.col("_have")).withColumn("_k", F.col("_k") + F.col("_have"))
    out = first.select("episode", label, key, "_k").unionByName(again.select("episode", label, key, "_k"))
    return out.select("episode", label, key, F.when(F.col("_k") <= shots, "support").otherwise("query").alias("role"))
