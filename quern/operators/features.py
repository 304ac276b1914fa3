"""Feature channels of rasters, evidence pooled on a grid, crops fitted onto a canvas, faded views, completed tokens.

Rasters are dense cells (image, y, x, value) with values from 0 (dark) to 1, sizes (image, height, width), as in `raster`.
Windows run by row and by column: cells dealt by image, as `raster.relative_depth` leaves them, serve all without a shuffle.
Everything meets by image, so any number of images passes in parallel; what one task holds in order is a row or a
column of one image. Cells of images without a size are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import metrics, raster
from quern.operators.graph import materialise

EVIDENCE = {"darkness": 0.30, "contrast": 0.20, "alpha": 0.35, "gradient": 0.15}  # fixed shares


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def gaussian(sigma: float) -> list[float]:
    """Weights of the offsets from 0 up to three sigmas; the other side is the same."""
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(math.ceil(3 * sigma) + 1)]


def _blur_along(cells: DataFrame, value: str, w: Window, weights: list[float], out: str) -> DataFrame:
    """Weighted mean over the neighbours that exist: at the sides the weights are divided by their sum there."""
    total, mass = F.col(value) * F.lit(weights[0]), F.lit(weights[0])
    for k, weight in enumerate(weights[1:], 1):
        for c in (F.lag(value, k).over(w), F.lead(value, k).over(w)):
            total = total + F.coalesce(c * F.lit(weight), F.lit(0.0))
            mass = mass + F.when(c.isNull(), F.lit(0.0)).otherwise(F.lit(weight))
    return cells.withColumn(out, total / mass)


def blurred(cells: DataFrame, value: str, sigma: float, out: str) -> DataFrame:
    """cells with `value`, which has no nulls, blurred by a Gaussian along rows, then along columns."""
    weights = gaussian(sigma)
    rows, columns = (Window.partitionBy("image", a).orderBy(b) for a, b in (("y", "x"), ("x", "y")))
    t = _blur_along(cells, value, rows, weights, "_b")
    return _blur_along(t, "_b", columns, weights, out).drop("_b")


def gradient(cells: DataFrame, value: str, out: str) -> DataFrame:
    """cells with the length of the 3 x 3 Sobel gradient; beyond a side the image is mirrored at its outermost cells."""
    rows, columns = (Window.partitionBy("image", a).orderBy(b) for a, b in (("y", "x"), ("x", "y")))

    def around(c: str, w: Window) -> tuple[Column, Column]:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(before, after, F.col(c)), F.coalesce(after, before, F.col(c))

    left, right = around(value, rows)
    t = cells.withColumns({"_dx": right - left, "_sx": left + 2 * F.col(value) + right})
    up, down = around("_dx", columns)
    above, below = around("_sx", columns)
    return t.withColumn(out, F.sqrt(F.pow(up + 2 * F.col("_dx") + down, F.lit(2.0)) + F.pow(below - above, F.lit(2.0)))).drop("_dx", "_sx")


def scaled(cells: DataFrame, values: list[str], q: float = 0.99, least: float = 1e-4) -> DataFrame:
    """cells with each of the values divided by the image's exact quantile of it, at least `least`, and clamped to 0 and 1.

    The cells are written once, as their quantiles take two more passes each."""
    t = cells = materialise(cells, "channels")
    for value in values:
        high = metrics.quantile(cells, ["image"], value, q).withColumnRenamed("quantile", "_high")
        t = t.join(high, "image").withColumn(value, clamped(F.col(value) / F.greatest("_high", F.lit(least)))).drop("_high")
    return t


def channels(cells: DataFrame, value: str, reach: int = 10, smooth: int = 3, sigma: float = 2.0, power: float = 0.72) -> DataFrame:
    """cells with four channels beside the grey value: darkness (depth below the local background), contrast (distance from
    the blurred image), alpha (a power of the darkness) and gradient. Contrast and gradient are scaled by their 99th percentile.
    """
    t = raster.relative_depth(cells, value, reach, smooth).drop("background").withColumnRenamed("depth", "darkness")
    t = blurred(t, value, sigma, "_mean").withColumn("contrast", F.abs(F.col(value) - F.col("_mean"))).drop("_mean")
    t = gradient(t, value, "gradient").withColumn("alpha", F.pow("darkness", F.lit(power)))
    return scaled(t, ["contrast", "gradient"])


def evidence(shares: dict[str, float] | None = None) -> Column:
    return clamped(sum((F.col(c) * F.lit(w) for c, w in (shares or EVIDENCE).items()), F.lit(0.0)))


def pooled(cells: DataFrame, sizes: DataFrame, value: str, grid: int, average: float = 0.35) -> DataFrame:
    """(image, gy, gx, pooled): `average` of the mean and the rest of the maximum of each field of a grid over the image.

    Field i of n cells covers those from floor(i * n / grid) up to before ceil((i + 1) * n / grid): fields overlap by a cell
    where the grid does not divide the image, and repeat cells where it is finer than the image. Sums are partial first.
    """
    t = cells.join(sizes, "image")
    fields = lambda at, n: F.sequence(F.expr(f"{at} * {grid} div {n}").cast("int"), F.expr(f"(({at} + 1) * {grid} - 1) div {n}").cast("int"))
    t = t.select("image", F.col(value).alias("_v"), F.explode(fields("y", "height")).alias("gy"), fields("x", "width").alias("_gx"))
    t = t.select("image", "_v", "gy", F.explode("_gx").alias("gx"))
    blend = F.avg("_v") * F.lit(average) + F.max("_v") * F.lit(1 - average)
    return t.groupBy("image", "gy", "gx").agg(clamped(blend).alias("pooled"))


def ink_bounds(cells: DataFrame, sizes: DataFrame, depth: str, share: float = 0.20, least: float = 0.035, q: float = 0.95) -> DataFrame:
    """(image, x0, y0, x1, y1), the last two exclusive: the box of cells deeper than a share of the image's 95th percentile.
    Without such a cell it is the whole image. The depths are written once, for three passes."""
    cells = materialise(cells.select("image", "y", "x", depth), "depths")
    limit = metrics.quantile(cells, ["image"], depth, q).select("image", F.greatest(F.lit(least), F.col("quantile") * F.lit(share)).alias("_limit"))
    deep = cells.join(limit, "image").filter(F.col(depth) > F.col("_limit"))
    box = deep.groupBy("image").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    t = sizes.join(box, "image", "left")
    return t.select("image", F.coalesce("x0", F.lit(0)).alias("x0"), F.coalesce("y0", F.lit(0)).alias("y0"), F.coalesce("x1", "width").alias("x1"), F.coalesce("y1", "height").alias("y1"))


def crop_plan(bounds: DataFrame, sizes: DataFrame, side: int, fill: float = 0.78, pad: float = 0.10, least_pad: int = 4) -> DataFrame:
    """(image, cx, cy, cw, ch, w, h, left, top): the padded crop in the image, its size on a square canvas of `side`, and its
    place there. The crop keeps its proportions and fills `fill` of the canvas along its longer side."""
    t = bounds.join(sizes, "image")
    margin = F.greatest(F.lit(least_pad), F.floor(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * F.lit(pad)).cast("int"))
    t = t.withColumn("_p", margin)
    t = t.withColumns({"cx": F.greatest(F.lit(0), F.col("x0") - F.col("_p")), "cy": F.greatest(F.lit(0), F.col("y0") - F.col("_p"))})
    t = t.withColumns({"cw": F.least("width", F.col("x1") + F.col("_p")) - F.col("cx"), "ch": F.least("height", F.col("y1") + F.col("_p")) - F.col("cy")})
    scale = F.least(F.lit(side * fill) / F.greatest("cw", F.lit(1)), F.lit(side * fill) / F.greatest("ch", F.lit(1)))
    size = lambda c: F.greatest(F.lit(4), F.floor(F.col(c) * scale).cast("int"))
    t = t.withColumns({"w": size("cw"), "h": size("ch")})
    place = lambda c: F.floor((F.lit(side) - F.col(c)) / 2).cast("int")
    return t.select("image", "cx", "cy", "cw", "ch", "w", "h", place("w").alias("left"), place("h").alias("top"))


def fitted(cells: DataFrame, plan: DataFrame, value: str, side: int, ground: float = 1.0) -> DataFrame:
    """(image, y, x, value) of the canvases: each crop resampled between its four nearest cells, `ground` around it.

    A canvas cell asks for its (up to) four source cells by key; nothing else of the image travels to it.
    """
    axis = F.sequence(F.lit(0), F.lit(side - 1))
    t = plan.select("*", F.explode(axis).alias("y")).select("*", F.explode(axis).alias("x"))
    inside = F.col("x").between(F.col("left"), F.col("left") + F.col("w") - 1) & F.col("y").between(F.col("top"), F.col("top") + F.col("h") - 1)

    def source(at: str, start: str, n: str, length: str, place: str) -> Column:
        u = (F.col(at) - F.col(place) + F.lit(0.5)) * F.col(length) / F.col(n) - F.lit(0.5)
        return F.least(F.greatest(u, F.lit(0.0)), F.col(length) - F.lit(1.0))

    own = t.filter(inside).select("image", "y", "x", "cx", "cy", "cw", "ch", source("x", "cx", "w", "cw", "left").alias("_u"), source("y", "cy", "h", "ch", "top").alias("_t"))

    def two(at: str, start: str, length: str) -> Column:
        low = F.floor(at).cast("int")
        part = F.col(at) - low
        pair = lambda k, weight: F.struct((F.col(start) + F.least(low + k, F.col(length) - 1)).alias("at"), weight.alias("weight"))
        return F.array(pair(0, 1 - part), pair(1, part))

    own = own.select("image", "y", "x", F.explode(two("_t", "cy", "ch")).alias("_a"), two("_u", "cx", "cw").alias("_b")).select("image", "y", "x", "_a", F.explode("_b").alias("_b"))
    own = own.select("image", "y", "x", F.col("_a.at").alias("_sy"), F.col("_b.at").alias("_sx"), (F.col("_a.weight") * F.col("_b.weight")).alias("_w"))
    grey = cells.select("image", F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value).alias("_v"))
    drawn = own.join(grey, ["image", "_sy", "_sx"]).groupBy("image", "y", "x").agg(F.sum(F.col("_v") * F.col("_w")).alias(value))
    return drawn.unionByName(t.filter(~inside).select("image", "y", "x", F.lit(ground).alias(value)))


def uniform(key: Column, name: str, low: float, high: float) -> Column:
    """A number between low and high that depends on the key and the name alone, so that repeated tasks agree."""
    digest = F.sha2(F.concat_ws(":", key.cast("string"), F.lit(name)), 256)
    return F.lit(low) + F.lit(high - low) * F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def faded(cells: DataFrame, sizes: DataFrame, light: str, dark: list[str]) -> DataFrame:
    """cells whose ink fades softly around one random place of each image: no cell is cut off by a threshold.

    `light` (1 is ground) rises towards 1, the channels `dark` (0 is ground) fall towards 0, by the same share.
    """
    key = F.col("image")
    spot = sizes.select("image", *[(F.col(n) * uniform(key, f"{n} {what}", low, high)).alias(f"_{what}_{n}") for n in ("width", "height") for what, low, high in (("centre", 0.20, 0.80), ("sigma", 0.12, 0.30))], uniform(key, "strength", 0.25, 0.70).alias("_strength"))
    off = lambda at, n: F.pow((F.col(at) - F.col(f"_centre_{n}")) / F.col(f"_sigma_{n}"), F.lit(2.0))
    keep = 1 - F.col("_strength") * F.exp(F.lit(-0.5) * (off("x", "width") + off("y", "height")))
    t = cells.join(spot, "image").withColumn("_keep", keep)
    t = t.withColumns({light: clamped(1 - (1 - F.col(light)) * F.col("_keep")), **{c: clamped(F.col(c) * F.col("_keep")) for c in dark}})
    return t.drop("_keep", *[c for c in spot.columns if c != "image"])


@dataclass(frozen=True)
class DotLimits:
    """Limits of dots that are brought back: areas and reach in pixels with the share of the image or width that they grow
    with. The defaults are fixed values for scans."""

    depth: float = 0.24
    mean: float = 0.255
    area: tuple[float, float] = (90.0, 0.00013)
    most: tuple[float, float] = (2600.0, 0.009)
    ratio: float = 2.25
    elongation: float = 2.55
    fill: float = 0.55
    reach: tuple[float, float] = (54.0, 0.048)
    major: tuple[float, float] = (5000.0, 0.009)
    alpha: float = 0.82
    gain: float = 1.65


def painted(runs: DataFrame) -> DataFrame:
    return runs.select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def with_dots(cells: DataFrame, sizes: DataFrame, alpha: str, depth: str, threshold: float, limits: DotLimits | None = None) -> DataFrame:
    """cells whose `alpha` is raised on dark, round, small marks near a major component of the alpha, which a model of strokes
    tends to lose. Images without a major component stay as they are."""
    lim = limits or DotLimits()
    share = lambda pair, size: F.greatest(F.lit(float(pair[0])), size * F.lit(float(pair[1])))
    page, w, h = F.col("height") * F.col("width"), F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    where = lambda c: cells.filter(c).select("image", "y", "x", depth)
    major = raster.moments(raster.labelled_runs(where(F.col(alpha) >= threshold), depth)).join(sizes, "image").filter(F.col("area") >= share(lim.major, page))
    major = major.withColumn("component", F.xxhash64("component"))  # names of another kind: a dot may start where a component does
    runs = materialise(raster.labelled_runs(where(F.col(depth) >= lim.depth), depth), "dots")
    dots = raster.moments(runs).join(sizes, "image").filter(F.col("area").between(share(lim.area, page), share(lim.most, page)))
    dots = dots.filter((F.greatest(w, h) / F.least(w, h) <= lim.ratio) & (F.col("elongation") <= lim.elongation) & (F.col("area") / (w * h) >= lim.fill) & (F.col("mean") >= lim.mean))
    near = raster.touching(dots, major, share(lim.reach, F.col("width")))
    marks = painted(runs.join(near, ["image", "component"], "left_semi")).withColumn("_dot", F.lit(True))
    raised = F.greatest(F.col(alpha), F.lit(lim.alpha), clamped(F.col(depth) * lim.gain))
    return cells.join(marks, ["image", "y", "x"], "left").withColumn(alpha, F.when(F.col("_dot"), raised).otherwise(F.col(alpha))).drop("_dot")


def cleaned_alpha(cells: DataFrame, sizes: DataFrame, alpha: str, depth: str, threshold: float, limits: raster.KindLimits | None = None, sigma: float = 0.75, floor: float = 0.035) -> DataFrame:
    """cells with `kind`, that of the component of cells from `threshold` that the cell belongs to (else null), and `clean`: the
    alpha near components that are kept, falling off softly beyond their edge by a cell, and 0 below `floor` and elsewhere."""
    runs = materialise(raster.labelled_runs(cells.filter(F.col(alpha) >= threshold).select("image", "y", "x", depth), depth), "alpha_runs")
    kind = raster.kinds(raster.moments(runs), sizes, limits).select("image", "component", "kind")
    own = runs.join(kind, ["image", "component"])
    kept = painted(raster.dilated(raster.merged(own.filter("kind = 'keep'").select("image", "y", "x0", "x1")), sizes, 1)).withColumn("_kept", F.lit(1.0))
    marks = own.select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "kind")
    t = cells.join(marks, ["image", "y", "x"], "left").join(kept, ["image", "y", "x"], "left").withColumn("_kept", F.coalesce("_kept", F.lit(0.0)))
    t = blurred(t, "_kept", sigma, "_soft").withColumn("clean", clamped(F.col(alpha) * F.col("_soft")))
    return t.withColumn("clean", F.when(F.col("clean") >= floor, F.col("clean")).otherwise(0.0)).drop("_kept", "_soft")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it, also inside other functions of arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def completed(token: Column, reliability: Column, prior: Column, presence: Column) -> Column:
    """struct(token, reliability, gate): a token repaired from the prior tokens of its class.

    The token attends to the prior tokens by a softmax of their scaled products; what it lacks in reliability is filled
    with the prior so attended, as far as that is present. `prior` is an array of vectors, `presence` one number for each.
    A token whose mixture is zero stays zero.
    """
    scale = F.sqrt(F.size(token).cast("double"))
    scores = F.transform(prior, lambda p: V.dot(token, p) / scale)
    weighted = lambda attention: F.zip_with(prior, attention, lambda p, a: F.transform(p, lambda x: x * a))
    aligned = lambda attention: F.aggregate(weighted(attention), F.array_repeat(F.lit(0.0), F.size(token)), lambda s, p: F.zip_with(s, p, lambda x, y: x + y))

    def mixed(q: Column) -> Column:
        gate = (1 - reliability) * q["there"]
        return F.struct(F.zip_with(token, q["aligned"], lambda a, b: (1 - gate) * a + gate * b).alias("mixed"), (reliability + gate).alias("reliability"), gate.alias("gate"))

    def unit(m: Column) -> Column:
        return F.struct(bound(F.greatest(V.norm(m["mixed"]), F.lit(1e-12)), lambda n: F.transform(m["mixed"], lambda x: x / n)).alias("token"), m["reliability"], m["gate"])

    attended = lambda a: F.struct(aligned(a).alias("aligned"), V.dot(a, presence).alias("there"))
    return bound(scores, lambda s: bound(V.softmax(s), lambda a: bound(attended(a), lambda q: bound(mixed(q), unit))))
