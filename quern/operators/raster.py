"""Rasters as tables: morphology on runs, local background from a summed-area table, moments and kinds of components.

Set pixels are runs (image, y, x0, x1), inclusive and disjoint within a row; values are dense cells (image, y, x, value);
`sizes` holds (image, height, width). Images meet by key only, so any number of them passes in parallel, and the largest
thing that one task holds in order is a row or a column of one image.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import metrics, sequences
from quern.operators.graph import components


def merged(runs: DataFrame) -> DataFrame:
    """Runs that cover the same pixels, disjoint and not adjacent."""
    row = Window.partitionBy("image", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    t = runs.withColumn("_new", (F.coalesce(F.col("x0") > reach + 1, F.lit(True))).cast("int"))
    t = t.withColumn("_g", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("image", "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def widened(runs: DataFrame, by: int) -> DataFrame:
    """Every pixel within `by` rows and columns of a set one, without bounds."""
    rows = runs.select("image", F.explode(F.sequence(F.col("y") - by, F.col("y") + by)).alias("y"), (F.col("x0") - by).alias("x0"), (F.col("x1") + by).alias("x1"))
    return merged(rows)


def clipped(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    t = runs.join(sizes, "image").filter((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x1") >= 0) & (F.col("x0") < F.col("width")))
    return t.select("image", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("width") - 1).alias("x1"))


def complement(runs: DataFrame, sizes: DataFrame, margin: int = 0) -> DataFrame:
    """What is not set on the canvas of each image, which reaches `margin` beyond its sides. Runs must be merged."""
    rows = sizes.select("image", "width", F.explode(F.sequence(F.lit(-margin), F.col("height") - 1 + margin)).alias("y"))
    before = rows.select("image", "y", F.lit(-margin - 1).alias("x0"), F.lit(-margin - 1).alias("x1"), "width")
    t = before.unionByName(runs.join(rows, ["image", "y"]).select("image", "y", "x0", "x1", "width"))
    following = F.lead("x0").over(Window.partitionBy("image", "y").orderBy("x0"))
    gaps = t.select("image", "y", (F.col("x1") + 1).alias("x0"), (F.coalesce(following, F.col("width") + margin) - 1).alias("x1"))
    return gaps.filter("x0 <= x1")


def dilated(runs: DataFrame, sizes: DataFrame, by: int = 1) -> DataFrame:
    return clipped(widened(runs, by), sizes)


def eroded(runs: DataFrame, sizes: DataFrame, by: int = 1) -> DataFrame:
    """Pixels whose whole neighbourhood is set; nothing is set beyond the sides."""
    return complement(clipped(widened(complement(merged(runs), sizes, by), by), sizes), sizes)


def closed(runs: DataFrame, sizes: DataFrame, by: int = 1) -> DataFrame:
    return eroded(dilated(runs, sizes, by), sizes, by)


def opened(runs: DataFrame, sizes: DataFrame, by: int = 1) -> DataFrame:
    return dilated(eroded(runs, sizes, by), sizes, by)


def _along(df: DataFrame, by: list[str], at: str) -> Window:
    return Window.partitionBy(*by).orderBy(at)


def box_sums(cells: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """cells with the sum of `value` over the square of so many cells to each side, as far as it lies in the image.

    Prefix sums along rows and then columns give the table of sums over all cells above and to the left; the square is the
    difference of its four corners. Images are dense: no cell is absent.
    """
    x, y = _along(cells, ["image", "y"], "x"), _along(cells, ["image", "x"], "y")
    every = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)

    def difference(c: str, w: Window) -> Column:
        return F.coalesce(F.lead(c, radius).over(w), F.last(c).over(every(w))) - F.coalesce(F.lag(c, radius + 1).over(w), F.lit(0.0))

    t = cells.repartition("image")  # serves rows and columns alike
    t = t.withColumn("_r", F.sum(F.col(value).cast("double")).over(upto(x))).withColumn("_s", F.sum("_r").over(upto(y)))
    t = t.withColumn("_d", difference("_s", y)).withColumn(out, difference("_d", x))
    return t.drop("_r", "_s", "_d")


def box_means(cells: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    t = box_sums(cells, value, radius, "_sum")
    t = box_sums(t.withColumn("_one", F.lit(1.0)), "_one", radius, "_count")
    return t.withColumn(out, F.col("_sum") / F.col("_count")).drop("_sum", "_count", "_one")


def box_max(cells: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """The greatest value in the square of so many cells to each side: rows, then columns."""
    frame = lambda w: w.rangeBetween(-radius, radius)
    t = cells.withColumn("_m", F.max(value).over(frame(_along(cells, ["image", "y"], "x"))))
    return t.withColumn(out, F.max("_m").over(frame(_along(cells, ["image", "x"], "y")))).drop("_m")


def relative_depth(cells: DataFrame, value: str, reach: int, smooth: int, floor: float = 0.08, power: float = 0.85) -> DataFrame:
    """cells with `background`, the brightest value within reach, smoothed by a box, and `depth`, how far the value lies below it as a share of it."""
    t = box_means(box_max(cells.repartition("image"), value, reach, "_bright"), "_bright", smooth, "background").drop("_bright")
    share = (F.col("background") - F.col(value)) / F.greatest("background", F.lit(floor))
    return t.withColumn("depth", F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(power)))


def stretched(cells: DataFrame, value: str, mask: Column, low: float = 0.28, high: float = 0.992, out: str = "stretched") -> DataFrame:
    """cells with `value` stretched so that two quantiles of the image's masked cells become 0 and 1; images without masked cells become 0."""
    inked = cells.filter(mask)
    a, b = (metrics.quantile(inked, ["image"], value, q).withColumnRenamed("quantile", name) for q, name in ((low, "_low"), (high, "_high")))
    t = cells.join(a.join(b, "image"), "image", "left")
    share = (F.col(value) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-6))
    return t.withColumn(out, F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(0.0))).drop("_low", "_high")


def composed(ground: Column, ink: Column, alpha: Column) -> Column:
    """The ground where alpha is 0, the ink (1 is dark) where it is 1."""
    return ground * (1 - alpha) + (1 - ink) * alpha


def difference_hash(cells: DataFrame, sizes: DataFrame, value: str, rows: int = 8, columns: int = 8) -> DataFrame:
    """(image, hash): 64 bits in hex, row by row, 1 where a field is brighter than its right neighbour, of images averaged down to
    8 rows of 9 fields. Images with fewer rows or columns have no hash."""
    t = cells.join(sizes, "image").filter((F.col("height") >= rows) & (F.col("width") > columns))
    field = t.select("image", F.floor(F.col("y") * rows / F.col("height")).alias("r"), F.floor(F.col("x") * (columns + 1) / F.col("width")).alias("c"), F.col(value).alias("v"))
    mean = field.groupBy("image", "r", "c").agg(F.round(F.avg("v"), 9).alias("v"))
    packed = mean.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda s: s["v"]).alias("m"))
    bit = lambda i: F.when(F.element_at("m", i + 1) > F.element_at("m", i + 2), "1").otherwise("0")
    places = F.array(*[F.lit(r * (columns + 1) + c) for r in range(rows) for c in range(columns)])
    bits = F.array_join(F.transform(places, bit), "")
    return packed.select("image", F.lower(F.lpad(F.conv(bits, 2, 16), rows * columns // 4, "0")).alias("hash"))


def labelled_runs(pixels: DataFrame, value: str | None = None) -> DataFrame:
    """(image, component, y, x0, x1, total) of 8-connected components of set pixels (image, y, x); total: sum of `value` in the run."""
    place = Window.partitionBy("image", "y").orderBy("x")
    t = pixels.withColumn("_g", F.col("x") - F.row_number().over(place))
    runs = t.groupBy("image", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum(F.col(value).cast("double") if value else F.lit(0.0)).alias("total")).drop("_g")
    runs = runs.withColumn("node", F.xxhash64("image", "y", "x0"))
    up = runs.select("image", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("up"))
    edges = runs.join(up, ["image", "y"]).filter((F.col("u0") <= F.col("x1") + 1) & (F.col("u1") >= F.col("x0") - 1)).select(F.col("node").alias("a"), F.col("up").alias("b"))
    return runs.join(components(edges), "node", "left").select("image", F.coalesce("root", "node").alias("component"), "y", "x0", "x1", "total")


def moments(runs: DataFrame) -> DataFrame:
    """One row a component of labelled runs: area, box, mean of the values, centre, elongation and angle of its main axis in degrees.

    Sums of x and its square over a run have closed forms, so no pixel is visited.
    """
    n = F.col("x1") - F.col("x0") + 1
    squares = lambda k: k * (k + 1) * (2 * k + 1) / F.lit(6.0)
    sx = (F.col("x0") + F.col("x1")) * n / F.lit(2.0)
    sums = {"area": n, "sx": sx, "sy": F.col("y") * n, "sxx": squares(F.col("x1")) - squares(F.col("x0") - 1), "syy": F.col("y") * F.col("y") * n, "sxy": F.col("y") * sx, "sv": F.col("total")}
    box = [F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1")]
    t = runs.groupBy("image", "component").agg(*[F.sum(c).alias(k) for k, c in sums.items()], *box)
    t = t.withColumns({"cx": F.col("sx") / F.col("area"), "cy": F.col("sy") / F.col("area"), "mean": F.col("sv") / F.col("area")})
    t = t.withColumns({"_a": F.col("sxx") / F.col("area") - F.col("cx") ** 2, "_b": F.col("syy") / F.col("area") - F.col("cy") ** 2, "_c": F.col("sxy") / F.col("area") - F.col("cx") * F.col("cy")})
    half = (F.col("_a") + F.col("_b")) / 2
    root = F.sqrt(F.greatest(half * half - (F.col("_a") * F.col("_b") - F.col("_c") ** 2), F.lit(0.0)))
    t = t.withColumn("elongation", F.sqrt(F.greatest(half + root, F.lit(1e-5)) / F.greatest(half - root, F.lit(1e-5))))
    t = t.withColumn("angle", F.abs(F.degrees(F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b") + 1e-9) / 2)))
    return t.drop("sx", "sy", "sxx", "syy", "sxy", "sv", "_a", "_b", "_c")


@dataclass(frozen=True)
class KindLimits:
    """Limits of the kinds of components. Areas in pixels, each with the share of the image that it grows with; the defaults
    are fixed values for scans, `scaled` adapts the pixels to smaller images."""

    strip_edge: float = 0.035
    strips: tuple[tuple[float, float, float], ...] = ((0.34, 0.18, 0.0), (0.16, 0.14, 4.0))  # over of the width, below of the height, side ratio from
    line_ratio: float = 4.2
    line_share: float = 0.045
    speckle: tuple[float, float, float] = (8.0, 0.00008, 0.38)  # area, share, and the depth below which it counts
    faint: tuple[float, float, float] = (18.0, 0.0002, 0.24)
    detached: tuple[float, float] = (1400.0, 0.0045)
    detached_edge: float = 1.6
    dot: tuple[float, float] = (90.0, 0.00013)
    dot_most: tuple[float, float] = (2600.0, 0.009)
    dot_shape: tuple[float, float, float, float] = (2.35, 2.7, 0.55, 0.255)  # side ratio, elongation, at most; fill and depth, at least
    dot_reach: tuple[float, float] = (58.0, 0.052)  # pixels, share of the width
    major: tuple[float, float] = (2600.0, 0.009)

    def scaled(self, by: float) -> KindLimits:
        area = {k: (v[0] * by * by, *v[1:]) for k in ("speckle", "faint", "detached", "dot", "dot_most", "major") for v in [getattr(self, k)]}
        return replace(self, **area, dot_reach=(self.dot_reach[0] * by, self.dot_reach[1]))


def touching(boxes: DataFrame, others: DataFrame, reach: Column, cell: int = 64) -> DataFrame:
    """(image, component) of boxes that a box of `others` of another component comes near: sides within `reach`, a column of others.

    Boxes are listed under the grid cells that they cover, so only near ones meet.
    """
    part = lambda c: F.floor(c / F.lit(cell))

    def listed(df: DataFrame, by: Column, names: list[str]) -> DataFrame:
        t = df.select("image", *names, F.explode(F.sequence(part(F.col(names[1]) - by), part(F.col(names[3]) + by))).alias("_i"), (F.col(names[2]) - by).alias("_lo"), (F.col(names[4]) + by).alias("_hi"))
        return t.select("image", *names, "_i", F.explode(F.sequence(part(F.col("_lo")), part(F.col("_hi")))).alias("_j"))

    names = ["component", "x0", "y0", "x1", "y1"]
    far = others.select("image", reach.alias("_reach"), *[F.col(c).alias(f"o_{c}") for c in names])
    far = listed(far.withColumns({"o_x0": F.col("o_x0") - F.col("_reach"), "o_y0": F.col("o_y0") - F.col("_reach"), "o_x1": F.col("o_x1") + F.col("_reach"), "o_y1": F.col("o_y1") + F.col("_reach")}), F.lit(0), [f"o_{c}" for c in names])
    meet = listed(boxes, F.lit(0), names).join(far, ["image", "_i", "_j"])
    apart = (F.col("x1") < F.col("o_x0")) | (F.col("x0") > F.col("o_x1")) | (F.col("y1") < F.col("o_y0")) | (F.col("y0") > F.col("o_y1"))
    return meet.filter(~apart & (F.col("component") != F.col("o_component"))).select("image", "component").distinct()


def kinds(shapes: DataFrame, sizes: DataFrame, limits: KindLimits | None = None) -> DataFrame:
    """moments with `kind`: strip, line, speckle or keep. Small round marks near a major component are kept before size counts."""
    lim = limits or KindLimits()
    page = F.col("height") * F.col("width")
    at_least = lambda pair: F.greatest(F.lit(float(pair[0])), page * pair[1])
    t = shapes.join(sizes, "image").withColumns({"w": F.col("x1") - F.col("x0") + 1, "h": F.col("y1") - F.col("y0") + 1})
    t = t.withColumns({"ratio": F.greatest("w", "h") / F.least("w", "h"), "fill": F.col("area") / (F.col("w") * F.col("h"))})
    reach = F.greatest(F.lit(float(lim.dot_reach[0])), F.col("width") * lim.dot_reach[1])
    near = touching(t, t.filter(F.col("area") >= at_least(lim.major)), reach).withColumn("_near", F.lit(True))
    t = t.join(near, ["image", "component"], "left")
    edge = lambda low, high, size: (F.col(low) <= F.col(size) * lim.strip_edge) | (F.col(high) >= F.col(size) * (1 - lim.strip_edge))
    at_edge = edge("x0", "x1", "width") | edge("y0", "y1", "height")
    strip = F.lit(False)
    for w, h, ratio in lim.strips:
        strip = strip | ((F.col("w") > F.col("width") * w) & (F.col("h") < F.col("height") * h) & (F.col("ratio") >= ratio))
    ratio, elongation, fill, depth = lim.dot_shape
    dot = F.col("_near") & F.col("area").between(at_least(lim.dot), at_least(lim.dot_most)) & (F.col("ratio") <= ratio) & (F.col("elongation") <= elongation) & (F.col("fill") >= fill) & (F.col("mean") >= depth)
    small = F.col("area") < at_least(lim.detached) * F.when(at_edge, lim.detached_edge).otherwise(1.0)
    slanted = F.col("angle").between(15.0, 75.0) & (F.col("elongation") >= lim.line_ratio) & (F.col("area") < page * lim.line_share)
    thin = (F.col("ratio") >= lim.line_ratio * 1.6) & (F.col("area") < page * 0.04)
    faint = F.lit(False)
    for limit in (lim.speckle, lim.faint):
        faint = faint | ((F.col("area") < at_least(limit)) & (F.col("mean") < limit[2]))
    kind = F.when(at_edge & strip, "strip").when(F.coalesce(dot, F.lit(False)), "keep").when(small, "speckle").when(slanted | thin, "line").when(faint, "speckle").otherwise("keep")
    return t.withColumn("kind", kind).drop("_near", "height", "width")


def suggested(runs: DataFrame, shapes: DataFrame, sizes: DataFrame, least_area: int = 24, least_height: int = 8, unit: float = 80.0, dense: int = 500) -> DataFrame:
    """One row an image that has glyphs: limits for cutting it up, from the median height of its glyphs and the gaps of its text lines.

    The line projection is the sum of run lengths by row, smoothed; lines are its highest rows, at least 1.5 glyph heights apart.
    """
    h = F.col("y1") - F.col("y0") + 1
    tall = shapes.join(sizes, "image").filter((F.col("area") >= least_area) & (h >= F.greatest(F.lit(least_height), F.bround(F.col("height") * F.lit(0.02)))))
    glyph = tall.groupBy("image").agg(F.percentile(h, F.lit(0.5)).alias("glyph"))
    many = shapes.groupBy("image").agg((F.count(F.lit(1)) >= dense).alias("dense"))
    ink = runs.groupBy("image", "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("double").alias("ink"))
    rows = sizes.select("image", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    profile = sequences.smooth(rows.join(ink, ["image", "y"], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0))), ["image"], "y", "ink", math.ceil(8 * unit / 80.0))
    profile = profile.withColumn("smoothed", F.round("smoothed", 9))
    high = profile.join(profile.groupBy("image").agg(F.max("smoothed").alias("_most")), "image").filter(F.col("smoothed") >= F.col("_most") * F.lit(0.18)).join(glyph, "image")
    high = high.withColumn("gap", F.greatest(F.lit(20.0 * unit / 80.0), F.bround(F.col("glyph") * 1.5)) + 1)
    lines = sequences.suppress(high.select("image", "y", "smoothed", "gap"), ["image"], "y", "smoothed", "gap")
    step = lines.withColumn("_d", F.col("y") - F.lag("y").over(Window.partitionBy("image").orderBy("y"))).groupBy("image").agg(F.percentile("_d", F.lit(0.5)).alias("between"), F.count(F.lit(1)).alias("lines"))
    t = glyph.join(many, "image").join(step, "image", "left")
    size = F.col("glyph")
    line_step = F.when(F.col("dense"), size * 1.3125).otherwise(F.coalesce("between", size * 1.4))
    whole = lambda c: F.bround(c).cast("long")
    least = lambda n, c: F.greatest(F.lit(n), whole(c))
    return t.select("image", size.alias("glyph_height"), "lines", least(12, least_area * (size / unit) ** 2).alias("min_area"), least(least_height, size * 0.35).alias("min_height"), whole(size * 1.65).alias("max_height"), whole(size * 1.5).alias("max_width"), whole(line_step).alias("line_step"), "dense")
