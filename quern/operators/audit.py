"""Validation of prediction rows, alignment of two models, and audits that roll up to PASS or FAIL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for every rule; a rule is a boolean that must hold, null counts as broken. One pass over the rows."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def misaligned(a: DataFrame, b: DataFrame, key: list[str], signature: list[str]) -> DataFrame:
    """Keys whose signatures differ between two tables, or that only one has."""
    x = a.select(*key, F.struct(*signature).alias("sa"), F.lit(True).alias("ia"))
    y = b.select(*key, F.struct(*signature).alias("sb"), F.lit(True).alias("ib"))
    return x.join(y, key, "full").filter(F.col("ia").isNull() | F.col("ib").isNull() | ~F.col("sa").eqNullSafe(F.col("sb"))).select(*key)


def roll_up(checks: DataFrame) -> DataFrame:
    """checks (check, ok, detail): per check whether all hold, how many fail, and the first failed detail; null counts as failed."""
    ok = F.coalesce("ok", F.lit(False))
    return checks.groupBy("check").agg(F.bool_and(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.min(F.when(~ok, F.col("detail"))).alias("first"))
