"""Rules over connected components: boxes with area, mean depth and mean alpha, one row each.

A table of components has image, id, x0, y0, x1, y1 (inclusive), area, depth, alpha, and the size of its image, page_w and
page_h. Rules are boolean expressions over those and the derived columns of `measured`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.geometry import near_centres


@dataclass(frozen=True)
class Limits:
    """Sizes are in pixels, depths and alphas between 0 and 1. Defaults are fixed values."""

    main_area: int = 24
    dot_area: int = 8
    mark_area: int = 10
    depth: float = 0.065
    dot_depth: float = 0.085
    alpha: float = 0.10
    largest_area: int = 8500
    largest_w: int = 210
    largest_h: int = 180
    #: Neighbours within (x, y) support a small component: each by its score up to the first value, enough at the second.
    support_reach: tuple[int, int] = (90, 58)
    support: tuple[float, float] = (24.0, 42.0)
    attach_reach: tuple[int, int] = (58, 42)
    #: Specks a megapixel at which noise is 0 and 1.
    noise: tuple[float, float] = (350.0, 1800.0)
    #: Sparse strokes.
    sparse_depth: float = 0.035
    sparse_mark: int = 24
    sparse_dust: int = 9


#: A rule holds if all its clauses do; a clause is a choice, of which one measure must reach its value.
Clause = dict[str, float | tuple[float, float]]

# Fixed values. "measure:limit" counts from a limit: areas are pixels beyond it, the rest shares of it. A pair is a value and
# what full noise adds to it. "most_side" and "quiet" are upper bounds, of the longer side and of noise; "near" takes no value.
RESCUED: list[Clause] = [{"alpha:alpha": 1}, {"depth:depth": 0.65}, {"area": 14}, {"side": 6}]
CLEAR: list[Clause] = [{"depth:depth": 1, "area": 70}]
LARGE: list[Clause] = [{"area:main_area": 0}, {"h": 5}, {"w": 3}]
SURE: list[Clause] = [{"area": 90, "alpha:alpha": 1, "support": 1}, {"area": 70, "side": 9, "support": 1}]
DOT: list[Clause] = [{"area:dot_area": 0}, {"depth:dot_depth": 1}, {"roundness": 0.35}, {"most_side": 32}]
NO_SPECK: list[Clause] = [{"area:mark_area": 0, "side": 9, "alpha:alpha": 0.7}]
SEEN: list[Clause] = [{"depth:depth": 0.35}]
STROKE: list[Clause] = [
    {"area:sparse_mark": 0, "side": 8, "depth:sparse_depth": 1.4, "alpha": 0.45},
    {"area:sparse_dust": 0, "depth:sparse_depth": 2},
    {"area:sparse_mark": 0, "side": 9, "alpha": 0.35, "depth:sparse_depth": 1.8},
]
NOT_WEAK: list[Clause] = [{"area:mark_area": 0, "side": 7, "depth:depth": 1.15, "alpha:alpha": 1}]
RECALL: list[list[Clause]] = [
    [{"area:mark_area": 0}, {"depth:depth": 0.58}],
    [{"area:mark_area": -5}, {"side": 7}, {"depth:depth": 0.42}],
    [{"area:mark_area": -6}, {"alpha:alpha": 0.35}],
    [{"area:dot_area": 0}, {"depth:dot_depth": 0.55}, {"most_side": 46}],
]
#: For each mode the reach of a main component, as shares of its width and height, and the rules of which one must hold.
POST: dict[str, tuple[float, float, list[list[Clause]]]] = {
    "strict": (0.55, 0.75, [
        [{"area:main_area": 0}, {"side": 8, "area": 70}, {"depth:depth": 0.72}, {"density": 0.035}],
        [{"area:main_area": 0}, {"side": 8, "area": 70}, {"alpha:alpha": 1.2}],
        [{"near": 1}, {"area": 12}, {"depth:dot_depth": 0.82}, {"roundness": 0.32}, {"most_side": 34}],
    ]),
    "light": (0.75, 0.85, [
        [{"area:main_area": 0}, {"side": 10, "area": 42}, {"depth:depth": 0.72}, {"density": 0.04}, {"alpha:alpha": 0.35, "area": 46}],
        [{"near": 1}, {"area": 9}, {"depth:dot_depth": 0.78}, {"roundness": 0.28}, {"most_side": 36}, {"alpha:alpha": 0.25, "depth:dot_depth": 1}],
    ]),
    "floor": (0.85, 0.95, [
        [{"area:mark_area": -3}, {"side": 7}, {"depth:depth": 0.58}, {"density": 0.018}],
        [{"near": 1, "quiet": 0.28, "side": 13}, {"area:mark_area": (0, 6)}, {"depth:depth": (0.58, 0.26)}, {"density": (0.025, 0.035)}],
        [{"near": 1}, {"area:mark_area": (0, 6)}, {"depth:dot_depth": (0.62, 0.16)}, {"most_side": 42}],
    ]),
}


def reaches(measure: str, value: float | tuple[float, float], limits: Limits) -> Column:
    column, _, limit = measure.partition(":")
    if column == "near":
        return F.col("near")
    if column == "quiet":
        return F.col("noise") < value
    if column == "most_side":
        return F.col("side") <= value
    base, slope = value if isinstance(value, tuple) else (value, 0)
    unit = getattr(limits, limit) if limit else None
    if column == "area":
        return F.col("area") >= (unit or 0) + base + (F.bround(F.col("noise") * slope) if slope else F.lit(0))
    if slope:
        return F.col(column) >= F.lit(1.0 if unit is None else unit) * (base + F.col("noise") * slope)
    return F.col(column) >= (base if unit is None else round(unit * base, 12))


def meets(rule: list[Clause], limits: Limits) -> Column:
    return reduce(and_, [reduce(or_, [reaches(m, v, limits) for m, v in clause.items()]) for clause in rule])


def meets_any(rules: list[list[Clause]], limits: Limits) -> Column:
    return reduce(or_, [meets(rule, limits) for rule in rules])


def measured(comps: DataFrame) -> DataFrame:
    """With width w, height h, longer side, fill density, side ratio, centre (x, y) and a strength score."""
    t = comps.withColumns({"w": F.col("x1") - F.col("x0") + 1, "h": F.col("y1") - F.col("y0") + 1})
    t = t.withColumns({"side": F.greatest("w", "h"), "density": F.col("area") / (F.col("w") * F.col("h")), "roundness": F.least("w", "h") / F.greatest("w", "h"), "x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})
    return t.withColumn("score", F.col("area") * F.greatest(F.lit(0.03), "depth") * F.greatest(F.lit(0.4), "density"))


def at_border(margin: int) -> Column:
    """Within `margin` pixels of an edge, and over 18 % of the page long."""
    edge = (F.col("x0") <= margin) | (F.col("y0") <= margin) | (F.col("x1") >= F.col("page_w") - 1 - margin) | (F.col("y1") >= F.col("page_h") - 1 - margin)
    return edge & ((F.col("w") > F.col("page_w") * F.lit(0.18)) | (F.col("h") > F.col("page_h") * F.lit(0.18)))


def border_or_strip() -> Column:
    """At the border, or more than ten times as long as thick and at most eight pixels thick."""
    thick = F.least("w", "h")
    return at_border(2) | ((F.col("side") > thick * 10) & (thick <= 8))


def classified(comps: DataFrame, limits: Limits | None = None) -> DataFrame:
    """measured comps with `kind`: main, dot or rejected. Small mains need the support of neighbours that are not rejected outright."""
    limits = limits or Limits()
    too_large = (F.col("area") > limits.largest_area) | (F.col("w") > limits.largest_w) | (F.col("h") > limits.largest_h)
    faint = ~meets(CLEAR, limits) & ~meets(RESCUED, limits)
    t = measured(comps).withColumn("_out", too_large | border_or_strip() | (F.col("density") < 0.025) | faint)
    open_ = t.filter("not _out").select("image", "id", "x", "y", "score")
    near = near_centres(open_, open_, ["image"], *limits.support_reach).filter("id <> o_id")
    each, enough = limits.support
    support = near.groupBy("image", "id").agg((F.sum(F.least("o_score", F.lit(each))) / enough).alias("support"))
    t = t.join(support, ["image", "id"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    large = F.when(meets(SURE, limits), "main").otherwise("rejected")
    kind = F.when(F.col("_out"), "rejected").when(meets(LARGE, limits), large).when(meets(DOT, limits), "dot").otherwise("rejected")
    return t.withColumn("kind", kind).drop("_out", "support")


def noise(comps: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(image, speckles, per_mpix, noise): how many specks a megapixel, and that between the low and the high mark as 0 to 1."""
    limits = limits or Limits()
    low, high = limits.noise
    speck = ~meets(NO_SPECK, limits) & meets(SEEN, limits)
    per = measured(comps).groupBy("image").agg(F.count_if(speck).alias("speckles"), (F.max(F.col("page_w") * F.col("page_h")) / 1e6).alias("_mpix"))
    per = per.withColumn("per_mpix", F.col("speckles") / F.greatest("_mpix", F.lit(1e-6))).drop("_mpix")
    return per.withColumn("noise", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("per_mpix") - low) / (high - low))))


def sparse_kept(limits: Limits | None = None) -> Column:
    """Keeps strokes; rejects long ones at the border, tiny weak ones and dust."""
    return ~at_border(1) & meets(STROKE, limits or Limits())


def recall_kept(limits: Limits | None = None) -> Column:
    limits = limits or Limits()
    return ~border_or_strip() & meets(NOT_WEAK, limits) & meets_any(RECALL, limits)


def post_kept(comps: DataFrame, mains: DataFrame, mode: str, level: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """measured comps with `kept` by the rules of a mode. `near`: within a main's reach, which grows with the main's size.

    level: (image, noise), 0 where it is not given. No main is larger than the limits' largest, which bounds the reach.
    """
    limits = limits or Limits()
    by_w, by_h, rules = POST[mode]
    far_x, far_y = limits.attach_reach
    t = measured(comps)
    m = measured(mains).select("image", "id", "x", "y", "w", "h")
    pairs = near_centres(t.select("image", "id", "x", "y"), m, ["image"], max(far_x, by_w * limits.largest_w), max(far_y, by_h * limits.largest_h))
    reach = (F.abs(F.col("x") - F.col("o_x")) <= F.greatest(F.lit(float(far_x)), F.col("o_w") * by_w)) & (F.abs(F.col("y") - F.col("o_y")) <= F.greatest(F.lit(float(far_y)), F.col("o_h") * by_h))
    near = pairs.filter(reach).select("image", "id").distinct().withColumn("near", F.lit(True))
    t = t.join(near, ["image", "id"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    t = t.join(level.select("image", "noise"), "image", "left") if level is not None else t.withColumn("noise", F.lit(0.0))
    return t.withColumn("noise", F.coalesce("noise", F.lit(0.0))).withColumn("kept", meets_any(rules, limits))


def attached_dots(classes: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(image, id, main, cost) of dots with the cheapest main: distance beyond half its size or the reach, rows 1.4 times."""
    limits = limits or Limits()
    far_x, far_y = limits.attach_reach
    dots, mains = classes.filter("kind = 'dot'"), classes.filter("kind = 'main'").select("image", "id", "x", "y", "w", "h")
    pairs = near_centres(dots.select("image", "id", "x", "y"), mains, ["image"], 2 * far_x + limits.largest_w / 2, far_y + far_x / 1.4 + limits.largest_h / 2)
    beyond = lambda c, size, reach: F.greatest(F.lit(0.0), F.abs(F.col(c) - F.col(f"o_{c}")) - F.greatest(F.col(f"o_{size}") / 2, F.lit(float(reach))))
    cost = beyond("x", "w", far_x) + beyond("y", "h", far_y) * F.lit(1.4)
    return pairs.withColumn("cost", cost).filter(F.col("cost") <= far_x).groupBy("image", "id").agg(F.min_by("o_id", F.struct("cost", "o_id")).alias("main"), F.min("cost").alias("cost"))


def prompts(comps: DataFrame, fragments: DataFrame, step: float, limits: Limits | None = None) -> DataFrame:
    """(image, id, line, x0, y0, x1, y1): boxes of comps widened once by the fragments whose centre lies about them."""
    limits = limits or Limits()
    t, f = measured(comps), measured(fragments).select("image", "id", "x", "y", "x0", "y0", "x1", "y1")
    t = t.withColumns({"ex": F.greatest(F.lit(18), F.floor(F.col("h") * F.lit(0.55))), "ey": F.greatest(F.lit(14), F.floor(F.col("h") * F.lit(0.48)))})
    pairs = near_centres(t, f, ["image"], limits.largest_w / 2 + limits.largest_h, limits.largest_h * 1.5)
    inside = F.col("o_x").between(F.col("x0") - F.col("ex"), F.col("x1") + 1 + F.col("ex")) & F.col("o_y").between(F.col("y0") - F.col("ey"), F.col("y1") + 1 + F.col("ey"))
    got = pairs.filter(inside).groupBy("image", "id").agg(F.min("o_x0").alias("a0"), F.min("o_y0").alias("b0"), F.max("o_x1").alias("a1"), F.max("o_y1").alias("b1"))
    t = t.join(got, ["image", "id"], "left")
    return t.select("image", "id", (F.bround(F.col("y") / step, 0) + 1).cast("long").alias("line"), F.least("x0", "a0").alias("x0"), F.least("y0", "b0").alias("y0"), F.greatest("x1", "a1").alias("x1"), F.greatest("y1", "b1").alias("y1"))


def present(comps: DataFrame, weights: dict[str, float], bias: float, step: float, cut: float = 0.55) -> DataFrame:
    """measured comps whose presence score, the logistic of a weighted sum of their measures, reaches `cut`: with score, line and their
    number within the image by line and left edge."""
    total = F.lit(bias)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(name).cast("double")
    t = measured(comps).withColumn("presence", 1 / (1 + F.exp(-total))).filter(F.col("presence") >= cut)
    t = t.withColumn("line", (F.bround(F.col("y") / step, 0) + 1).cast("long"))
    return t.withColumn("number", F.row_number().over(Window.partitionBy("image").orderBy("line", "x0", "id")))
