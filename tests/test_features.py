"""Feature channels, pooling, crops, fading and completed tokens against numpy; sheets, routers, keys and records of runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import features, governance, metrics, raster, similarity


def grids(seed=3):
    rng = np.random.default_rng(seed)
    return {k: rng.random(s) for k, s in enumerate([(9, 13), (1, 7), (12, 1), (20, 20), (1, 1)])} | {9: np.ones((6, 5))}


def tables(spark, images):
    rows = [(k, y, x, float(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    size = spark.createDataFrame([(k, *m.shape) for k, m in images.items()], "image int, height int, width int")
    return spark.createDataFrame(rows, "image int, y int, x int, v double").repartition(3), size


def drawn(df, images, value, shape=None):
    out = {k: np.full(shape or m.shape, np.nan) for k, m in images.items()}
    n = 0
    for r in df.collect():
        out[r.image][r.y, r.x] = r[value]
        n += 1
    assert n == sum(m.size for m in out.values())
    return out


def blur(m, sigma):
    half = features.gaussian(sigma)
    kernel = np.array(half[:0:-1] + half)

    def along(row):
        return np.array([sum(kernel[j - i + len(half) - 1] * row[j] for j in range(len(row)) if abs(i - j) < len(half)) / sum(kernel[j - i + len(half) - 1] for j in range(len(row)) if abs(i - j) < len(half)) for i in range(len(row))])

    return np.apply_along_axis(along, 0, np.apply_along_axis(along, 1, m))


def sobel(m):
    p = np.pad(m, [(1, 1) if n == 1 else (0, 0) for n in m.shape], "edge")
    p = np.pad(p, [(0, 0) if n == 1 else (1, 1) for n in m.shape], "reflect")
    h, w = m.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return np.sqrt(gx**2 + gy**2)


def test_blur_and_gradient_equal_numpy(spark):
    images = grids()
    cells, _ = tables(spark, images)
    soft = drawn(features.blurred(cells, "v", 0.75, "b"), images, "b")
    edge = drawn(features.gradient(cells, "v", "g"), images, "g")
    for k, m in images.items():
        assert soft[k] == pytest.approx(blur(m, 0.75), abs=1e-12)
        assert edge[k] == pytest.approx(sobel(m), abs=1e-12)


def test_channels_stay_in_range_and_scale_by_the_percentile(spark):
    images = grids()
    cells, _ = tables(spark, images)
    t = features.channels(cells.withColumn("note", F.lit("kept")), "v", 2, 1).cache()
    assert "note" in t.columns
    got = {c: drawn(t, images, c) for c in ("contrast", "gradient", "darkness", "alpha")}
    for k, m in images.items():
        contrast = np.abs(m - blur(m, 2.0))
        assert got["contrast"][k] == pytest.approx(np.clip(contrast / max(np.percentile(contrast, 99), 1e-4), 0, 1), abs=1e-6)
        assert got["gradient"][k] == pytest.approx(np.clip(sobel(m) / max(np.percentile(sobel(m), 99), 1e-4), 0, 1), abs=1e-9)
        assert got["alpha"][k] == pytest.approx(got["darkness"][k] ** 0.72, abs=1e-12)
    assert not got["gradient"][9].any() and not got["darkness"][9].any()
    assert features.channels(cells.limit(0), "v").count() == 0


@pytest.mark.parametrize("grid", [1, 3, 8, 25])
def test_pooling_covers_every_field(spark, grid):
    images = grids(4)
    cells, size = tables(spark, images)
    got = {(r.image, r.gy, r.gx): r.pooled for r in features.pooled(cells, size, "v", grid).collect()}
    assert len(got) == len(images) * grid * grid
    for k, m in images.items():
        h, w = m.shape
        for i in range(grid):
            for j in range(grid):
                part = m[i * h // grid : math.ceil((i + 1) * h / grid), j * w // grid : math.ceil((j + 1) * w / grid)]
                assert got[k, i, j] == pytest.approx(0.35 * part.mean() + 0.65 * part.max(), abs=1e-12)


def test_bounds_and_canvas(spark):
    images = {0: np.zeros((30, 40)), 1: np.zeros((9, 9)), 2: np.random.default_rng(5).random((25, 11))}
    images[0][7:12, 20:33] = 0.9
    cells, size = tables(spark, images)
    box = {r.image: (r.x0, r.y0, r.x1, r.y1) for r in features.ink_bounds(cells, size, "v").collect()}
    assert box[0] == (20, 7, 33, 12) and box[1] == (0, 0, 9, 9)
    limit = max(0.035, np.percentile(images[2], 95) * 0.2)
    ys, xs = np.nonzero(images[2] > limit)
    assert box[2] == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
    side = 24
    plan = features.crop_plan(features.ink_bounds(cells, size, "v"), size, side)
    canvas = drawn(features.fitted(cells, plan, "v", side), images, "v", (side, side))
    for r in plan.collect():
        m, (x0, y0, x1, y1) = images[r.image], box[r.image]
        pad = max(4, int(max(x1 - x0, y1 - y0) * 0.10))
        crop = m[max(0, y0 - pad) : y1 + pad, max(0, x0 - pad) : x1 + pad]
        assert (r.ch, r.cw) == crop.shape
        scale = side * 0.78 / max(crop.shape)
        assert abs(r.w - max(4, crop.shape[1] * scale)) < 1 and abs(r.h - max(4, crop.shape[0] * scale)) < 1
        want = np.ones((side, side))
        for y in range(r.h):
            for x in range(r.w):
                u, v = min(max((x + 0.5) * r.cw / r.w - 0.5, 0), r.cw - 1), min(max((y + 0.5) * r.ch / r.h - 0.5, 0), r.ch - 1)
                a, b = int(u), int(v)
                top, low = ((1 - u + a) * crop[k, a] + (u - a) * crop[k, min(a + 1, r.cw - 1)] for k in (b, min(b + 1, r.ch - 1)))
                want[r.top + y, r.left + x] = (1 - v + b) * top + (v - b) * low
        assert canvas[r.image] == pytest.approx(want, abs=1e-9)


def test_fading_is_soft_repeatable_and_the_same_for_all_channels(spark):
    images = {k: m for k, m in grids().items() if m.size > 20}
    cells, size = tables(spark, images)
    t = features.faded(cells.withColumn("d", 1 - F.col("v")).withColumn("was", F.col("v")), size, "v", ["d"])
    rows = t.collect()
    assert {(r.image, r.y, r.x): r.v for r in rows} == {(r.image, r.y, r.x): r.v for r in t.repartition(5).collect()}
    for r in rows:
        assert r.was <= r.v <= 1 and r.v + r.d == pytest.approx(1)
    assert any(r.v - r.was > 0.05 for r in rows)


def test_dots_return_near_major_strokes_and_specks_go(spark):
    alpha, depth = np.full((40, 60), 0.05), np.full((40, 60), 0.1)
    alpha[5:20, 5:30] = depth[5:20, 5:30] = 0.9  # a major stroke
    depth[23:27, 10:14] = 0.5  # a dot under it, lost in the alpha
    depth[33:37, 52:56] = 0.5  # the same, far from it
    depth[23:25, 18:28] = 0.5  # near, but long
    alpha[30, 40] = depth[30, 40] = 0.8  # a speck
    far = np.full((9, 9), 0.5)  # no major component at all
    images = {0: (alpha, depth), 1: (far, far)}
    rows = [(k, y, x, float(a[y, x]), float(d[y, x])) for k, (a, d) in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    cells = spark.createDataFrame(rows, "image int, y int, x int, a double, d double").repartition(4)
    size = spark.createDataFrame([(0, 40, 60), (1, 9, 9)], "image int, height int, width int")
    limits = features.DotLimits(area=(9.0, 0.0), most=(40.0, 0.0), reach=(6.0, 0.0), major=(200.0, 0.0))
    t = features.with_dots(cells, size, "a", "d", 0.5, limits)
    got = drawn(t, {0: alpha, 1: far}, "a")
    want = alpha.copy()
    want[23:27, 10:14] = 0.825
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(far)
    kinds = raster.KindLimits(detached=(10.0, 0.0), dot=(1e6, 0.0), dot_most=(1e7, 0.0), major=(200.0, 0.0), speckle=(4.0, 0.0, 0.9), faint=(0.0, 0.0, 0.0))
    clean = features.cleaned_alpha(t.filter("image = 0"), size, "a", "d", 0.5, kinds)
    mask = np.zeros_like(alpha)
    mask[4:21, 4:31] = mask[22:28, 9:15] = 1  # kept components, a cell wider
    soft = want * blur(mask, 0.75)
    assert drawn(clean.filter("image = 0"), {0: alpha}, "clean")[0] == pytest.approx(np.where(soft >= 0.035, soft, 0), abs=1e-9)
    found = {(r.y, r.x): r.kind for r in clean.filter("kind is not null").collect()}
    assert found[30, 40] == "speckle" and found[10, 10] == found[25, 12] == "keep" and len(found) == 15 * 25 + 16 + 1


def test_chosen_router_is_the_first_best_and_is_judged_on_other_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(int(t), int(a), int(b), int(s), float(m)) for t, a, b, s, m in zip(rng.integers(0, 3, 300), rng.integers(0, 3, 300), rng.integers(0, 3, 300), rng.integers(1, 9, 300), rng.random(300).round(2), strict=True)]
    schema, grid = "truth int, ta int, da int, shots int, margin double", [(a, b) for a in (0, 2, 4, 4, 8) for b in (0.0, 0.5, 2.0)]

    def answer(r, a, b):
        return r[1] if r[3] <= a and r[4] >= b else r[2]

    score = [sum(r[0] == answer(r, a, b) for r in rows[:150]) for a, b in grid]
    a, b = grid[score.index(max(score))]
    best = similarity.best_router(spark.createDataFrame(rows[:150], schema), grid)
    chosen = best.collect()
    assert len(chosen) == 1 and (chosen[0].max_shots, chosen[0].min_margin) == (a, b) and chosen[0].validation_accuracy == pytest.approx(max(score) / 150)
    got = similarity.evaluated(spark.createDataFrame(rows[150:], schema), best).collect()
    for r in got:
        own = [x for x in rows[150:] if x[0] == r.truth]
        assert (r.n, r.transport_right, r.direct_right, r.routed_right, r.routed) == (len(own), sum(x[0] == x[1] for x in own), sum(x[0] == x[2] for x in own), sum(x[0] == answer(x, a, b) for x in own), sum(x[3] <= a and x[4] >= b for x in own))
    assert sum(r.n for r in got) == 150


def test_sheets_show_the_first_samples_of_the_most_frequent_pairs(spark):
    rows = [(k, k % 4, (k * 7) % 3) for k in range(200)] + [(k, 9, 9) for k in range(200, 230)]
    got = metrics.confusion_sheets(spark.createDataFrame(rows, "k int, truth int, pred int").repartition(7), "k", 3, 5, 2).collect()
    pairs = {}
    for k, t, p in rows:
        if t != p:
            pairs.setdefault((t, p), []).append(k)
    want = set()
    for i, (pair, keys) in enumerate(sorted(pairs.items(), key=lambda x: (-len(x[1]), x[0]))[:3], 1):
        want |= {(f"P{i:02d}-S{s:02d}", *pair, k, len(keys), (s - 1) % 2, (s - 1) // 2) for s, k in enumerate(sorted(keys)[:5], 1)}
    assert {(r.tile, r.truth, r.pred, r.k, r.n, r.column, r.row) for r in got} == want and len(got) == 15


def test_report_escapes_and_orders(spark):
    df = spark.createDataFrame([("a|b", 12345, 1.0), ("c", None, 2.0)], "name string, n long, v double")
    got = [r.text for r in metrics.markdown(df, "T", {"name": F.col("name"), "n": metrics.thousands("n"), "v": metrics.spread("v", "v")}, [F.desc("v")]).orderBy("line").collect()]
    assert got == ["# T", "", "| name | n | v |", "| --- | --- | --- |", "| c | - | 2.0000 +/- 2.0000 |", "| a\\|b | 12,345 | 1.0000 +/- 1.0000 |"]


@pytest.mark.parametrize(("path", "key"), [("x\\Word_9_Col_3_P12_aug_4.PNG", "col_3_p12"), ("d/diff_ka_p7.png", "diff_ka_p7"), ("d/diff_k_a_p7.png", "p7"), ("A_seed12_aug_3_0001.png", "a"), ("A_12.png", "a_12"), ("A_1234_x.png", "a_1234_x"), ("v1.2.png", "v1.2"), (".p", ".p")])
def test_legacy_source_keys(spark, path, key):
    assert spark.range(1).select(text.legacy_source_key(F.lit("L"), F.lit(path)).alias("k")).first().k == f"L::{key}"


def test_records_of_runs(spark):
    runs = spark.createDataFrame([("a", 1, 1, "h"), ("b", None, 1, None), ("c", 1, 2, "x"), ("d", None, None, "h"), ("z", 1, 1, "h")], "run string, s int, t int, h string")
    expected = spark.createDataFrame([(r, 1, "h") for r in "abcde"], "run string, seed int, digest string")
    got = {(r.run, r.field): r.status for r in governance.recorded(runs, expected, "run", {"seed": ["s", "t"], "digest": ["h"]}, ("digest",)).collect()}
    assert got == {("a", "seed"): "match", ("b", "seed"): "match", ("c", "seed"): "mismatch", ("d", "seed"): "missing", ("e", "seed"): "missing", ("a", "digest"): "match", ("b", "digest"): "absent", ("c", "digest"): "mismatch", ("d", "digest"): "match", ("e", "digest"): "absent"}


def test_completion_equals_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=6).tolist(), float(r), rng.normal(size=(3, 6)).tolist(), rng.random(3).tolist()) for k, r in enumerate([0.0, 1.0, 0.4, 0.7])]
    rows.append((9, [0.0] * 6, 1.0, rows[0][3], rows[0][4]))
    df = spark.createDataFrame(rows, "k int, t array<double>, r double, p array<array<double>>, w array<double>")
    for row in df.select("*", features.completed(F.col("t"), F.col("r"), F.col("p"), F.col("w")).alias("c")).collect():
        t, p, w = np.array(row.t), np.array(row.p), np.array(row.w)
        a = np.exp(p @ t / math.sqrt(6))
        a /= a.sum()
        gate = (1 - row.r) * (a @ w)
        mixed = (1 - gate) * t + gate * (a @ p)
        assert row.c.gate == pytest.approx(gate) and row.c.reliability == pytest.approx(row.r + (1 - row.r) * (a @ w))
        assert row.c.token == pytest.approx((mixed / max(np.linalg.norm(mixed), 1e-12)).tolist())
