"""Row numbers and running totals over a whole table without a task that sees all of it.

Rows are dealt into ranges of the order and sorted there; a row's place within its range and the totals of the ranges
before it add up. The table of ranges has one row a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import materialise

_PLACES = (1 << 33) - 1


def _ranges(df: DataFrame, order: list, value) -> tuple[DataFrame, DataFrame]:
    """Rows with _part, _place and _value, and (_part, _before): the total of the ranges before."""
    rows = df.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(rows, "ordered").withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit(_PLACES))}).drop("_at")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = rows.groupBy("_part").agg(F.sum("_value").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    return rows, before


def number(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """df with the 1-based number of each row in the order, which should have no ties."""
    rows, before = _ranges(df, order, F.lit(1).cast("long"))
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before", "_value")


def running_total(df: DataFrame, order: list, value: str, name: str = "before") -> DataFrame:
    """df with the sum of `value` (whole numbers) over all rows that come earlier in the order."""
    rows, before = _ranges(df, order, F.col(value).cast("long"))
    own = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(own), F.lit(0))).drop("_part", "_place", "_before", "_value")


def number_within(df: DataFrame, by: list[str], order: list, name: str = "idx") -> DataFrame:
    """df with the 1-based number of each row within its group, also where one group holds most rows."""
    rows = number(df, [*by, *order], "_n")
    first = rows.groupBy(*by).agg((F.min("_n") - 1).alias("_first"))
    return rows.join(first, by).withColumn(name, F.col("_n") - F.col("_first")).drop("_n", "_first")
