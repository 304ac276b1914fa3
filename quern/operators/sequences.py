"""Runs, smoothing, peaks, interpolation and ranks along an order."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive integers per group: first, last, n."""
    w = Window.partitionBy(*by).orderBy(at)
    t = df.select(*by, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(w))
    return t.groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def hann(radius: int) -> list[float]:
    n = 2 * radius + 3
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(1, n - 1)]
    return [x / sum(w) for x in w]


def smooth(df: DataFrame, by: list[str], at: str, value: str, radius: int) -> DataFrame:
    """Hann-smoothed value, zero beyond the ends."""
    w = Window.partitionBy(*by).orderBy(at)
    total = F.lit(0.0)
    for k, weight in zip(range(-radius, radius + 1), hann(radius), strict=True):
        total = total + F.lit(weight) * F.coalesce(F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k > 0 else F.col(value), F.lit(0.0))
    return df.withColumn("smoothed", total)


def local_maxima(df: DataFrame, by: list[str], at: str, value: str, threshold) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at)
    low = F.lit(float("-inf"))
    t = df.withColumn("_p", F.coalesce(F.lag(value).over(w), low)).withColumn("_n", F.coalesce(F.lead(value).over(w), low))
    return t.filter((F.col(value) >= F.col("_p")) & (F.col(value) > F.col("_n")) & (F.col(value) >= threshold)).drop("_p", "_n")


def suppress(peaks: DataFrame, by: list[str], at: str, value: str, gap: float | str) -> DataFrame:
    """Greedy non-maximum suppression per group, highest first, ties to the smaller place; gap: a number, or a column that is
    the same within a group. A group is one page's or series' peaks. What is kept is filed by gaps, so each peak looks at three files."""
    columns = peaks.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        least = float(pdf[gap].iloc[0]) if isinstance(gap, str) else gap
        kept: dict[int, list] = {}
        rows = []
        pdf = pdf.sort_values([value, at], ascending=[False, True])
        for i, x in enumerate(pdf[at].tolist()):
            file = math.floor(x / least)
            if all(abs(x - k) >= least for f in (file - 1, file, file + 1) for k in kept.get(f, ())):
                kept.setdefault(file, []).append(x)
                rows.append(i)
        return pdf.iloc[rows][columns]

    return peaks.groupBy(*by).applyInPandas(run, peaks.schema)


def interpolate(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Linear interpolation of null values; the ends carry the nearest value."""
    back = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    a0, a1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
    line = v0 + (v1 - v0) * F.try_divide(F.col(at) - a0, F.nullif(a1 - a0, F.lit(0)))
    return df.withColumn("filled", F.coalesce(F.col(value), line, v0, v1))


def descending_average_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn("avg_rank", F.rank().over(w) + (ties - 1) / F.lit(2.0))


def suppress_edges(cells: DataFrame, by: list[str], at: str, value: str, interior, margin: int, least: int) -> DataFrame:
    """cells with value 0 within `margin` of the first and last interior cell of each line, or on the whole line if it has
    fewer than `least` interior cells."""
    inside = cells.filter(interior).groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.count(F.lit(1)).alias("_n"))
    t = cells.join(inside, by, "left")
    keep = (F.col("_n") >= least) & F.col(at).between(F.col("_a") + margin, F.col("_b") - margin)
    return t.withColumn(value, F.when(keep, F.col(value)).otherwise(0.0)).drop("_a", "_b", "_n")


def strips(pixels: DataFrame, image: str, height: int, edge: tuple[int, int], long_run: int, edge_run: int, ink: int, band: int) -> DataFrame:
    """(image, y, x0, x1): runs of set pixels (image, y, x) that belong to a horizontal strip.

    A row is a strip row if its longest run or its ink is long; rows near an edge (y up to edge[0], from edge[1]) need
    less. Strip rows form bands; bands higher than `band` count near an edge only. Long runs of a band, and of the rows
    next to it, are its strips.
    """
    near = lambda y: (F.col(y) <= edge[0]) | (F.col(y) >= edge[1])
    runs = islands(pixels, [image, "y"], "x")
    rows = runs.groupBy(image, "y").agg(F.max("n").alias("longest"), F.sum("n").alias("ink"))
    strip = rows.filter((F.col("longest") >= long_run) | (near("y") & (F.col("longest") >= edge_run)) | (F.col("ink") >= ink))
    bands = islands(strip, [image], "y").filter((F.col("n") <= band) | (F.col("first") <= edge[0]) | (F.col("last") + 1 >= edge[1]))
    reach = bands.select(image, F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - 1), F.least(F.lit(height - 1), F.col("last") + 1))).alias("y")).distinct()
    cutoff = F.when(near("y"), edge_run).otherwise(long_run)
    return runs.join(reach, [image, "y"]).filter(F.col("n") >= cutoff).select(image, "y", F.col("first").alias("x0"), F.col("last").alias("x1"))


def link(peaks: DataFrame, by: list[str], at: str, value: str, drift: float, reach: float) -> DataFrame:
    """(by, track, n, first, last, mean): stretches of one peak a window in which each lies within `reach` of its
    predecessor plus `drift`; windows without a peak do not break a track."""
    w = Window.partitionBy(*by).orderBy(at)
    step = F.col(value) - F.lag(value).over(w) - drift
    t = peaks.withColumn("_new", (step.isNull() | (F.abs(step) > reach)).cast("long")).withColumn("track", F.sum("_new").over(w))
    return t.groupBy(*by, "track").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.avg(value).alias("mean"))
