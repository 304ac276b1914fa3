"""Rasters, tiles and tracks against sequential brute force, beyond what the registered queries meet."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import geometry, metrics, raster, sequences, similarity, tracks


def pictures(seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.random(shape) < p for k, (shape, p) in enumerate([((9, 13), 0.4), ((1, 7), 0.5), ((12, 5), 0.8), ((6, 6), 0.0), ((5, 8), 1.0), ((20, 20), 0.3)])}


def tables(spark, images):
    pixels = [(k, int(y), int(x)) for k, m in images.items() for y, x in zip(*np.nonzero(m), strict=True)]
    size = spark.createDataFrame([(k, *m.shape) for k, m in images.items()], "image int, height int, width int")
    return spark.createDataFrame(pixels, "image int, y int, x int").repartition(3), size


def painted(runs, images):
    out = {k: np.zeros(m.shape, bool) for k, m in images.items()}
    n = 0
    for r in runs.collect():
        assert r.x0 <= r.x1 and not out[r.image][r.y, r.x0 : r.x1 + 1].any()
        out[r.image][r.y, r.x0 : r.x1 + 1] = True
        n += 1
    rows = sum(int((np.diff(np.pad(m[y].astype(int), 1)) == 1).sum()) for m in out.values() for y in range(len(m)))
    assert n == rows  # runs are maximal
    return out


def grow(m, by):
    out = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m), strict=True):
        out[max(0, y - by) : y + by + 1, max(0, x - by) : x + by + 1] = True
    return out


def shrink(m, by):
    p = np.pad(m, by)
    return np.array([[p[y : y + 2 * by + 1, x : x + 2 * by + 1].all() for x in range(m.shape[1])] for y in range(m.shape[0])], bool).reshape(m.shape)


@pytest.mark.parametrize("by", [0, 1, 3])
def test_morphology_equals_pixels(spark, by):
    images = pictures()
    pixels, size = tables(spark, images)
    runs = geometry.runs_of(pixels).repartition(4)
    want = {"dilated": lambda m: grow(m, by), "eroded": lambda m: shrink(m, by), "closed": lambda m: shrink(grow(m, by), by), "opened": lambda m: grow(shrink(m, by), by)}
    for name, f in want.items():
        got = painted(getattr(raster, name)(runs, size, by), images)
        for k, m in images.items():
            assert (got[k] == f(m)).all(), (name, k)
    again = raster.merged(runs.unionByName(runs.withColumn("x1", F.col("x0"))))  # overlaps
    assert all((painted(again, images)[k] == m).all() for k, m in images.items())


@pytest.mark.parametrize("radius", [0, 1, 4, 30])
def test_box_means_and_maxima(spark, radius):
    rng = np.random.default_rng(1)
    images = {k: rng.random(shape) for k, shape in enumerate([(9, 13), (1, 7), (12, 1), (6, 6)])}
    cells = spark.createDataFrame([(k, y, x, float(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])], "image int, y int, x int, v double").repartition(3)
    t = raster.box_max(raster.box_means(cells, "v", radius, "mean"), "v", radius, "most")
    for r in t.collect():
        box = images[r.image][max(0, r.y - radius) : r.y + radius + 1, max(0, r.x - radius) : r.x + radius + 1]
        assert r.mean == pytest.approx(box.mean()) and r.most == box.max()
    d = raster.relative_depth(cells, "v", radius, 1).agg(F.min("depth"), F.max("depth"), F.count(F.lit(1))).first()
    assert 0 <= d[0] <= d[1] <= 1 and d[2] == sum(m.size for m in images.values())


def test_moments_and_kinds(spark):
    m = np.zeros((60, 60), bool)
    m[20:40, 20:40] = True  # a major block
    m[43:46, 30:33] = True  # a dot beneath it
    m[5:8, 50:53] = True  # the same far away
    for k in range(14):
        m[44 + k, 2 + k] = m[44 + k, 3 + k] = True  # a slanted line
    m[0:2, 5:50] = True  # a strip along the edge
    pixels, size = tables(spark, {0: m})
    value = {(y, x): (y * 7 + x * 3) % 10 / 10 for y in range(60) for x in range(60)}
    v = spark.createDataFrame([(0, y, x, u) for (y, x), u in value.items()], "image int, y int, x int, v double")
    runs = raster.labelled_runs(pixels.join(v, ["image", "y", "x"]), "v")
    shapes = raster.moments(runs)
    by = {(r.x0, r.y0): r for r in shapes.collect()}
    assert set(by) == {(20, 20), (30, 43), (50, 5), (2, 44), (5, 0)}
    for (x0, y0), r in by.items():
        ys, xs = np.nonzero(m[r.y0 : r.y1 + 1, r.x0 : r.x1 + 1])
        ys, xs = ys + y0, xs + x0
        if (x0, y0) == (20, 20):
            assert r.area == 400
        c = np.cov(xs, ys, bias=True)
        low, high = np.linalg.eigvalsh(c)
        assert r.area == len(xs) and r.cx == pytest.approx(xs.mean()) and r.cy == pytest.approx(ys.mean())
        assert r.elongation == pytest.approx(np.sqrt(max(high, 1e-5) / max(low, 1e-5)), rel=1e-6)
        assert r.mean == pytest.approx(np.mean([value[y, x] for y, x in zip(ys, xs, strict=True)]))
    limits = raster.KindLimits(detached=(30.0, 0.0), dot=(5.0, 0.0), dot_most=(50.0, 0.0), dot_reach=(6.0, 0.0), major=(300.0, 0.0), dot_shape=(2.35, 2.7, 0.55, 0.0))
    kinds = {(r.x0, r.y0): r.kind for r in raster.kinds(shapes, size, limits).collect()}
    assert kinds == {(20, 20): "keep", (30, 43): "keep", (50, 5): "speckle", (2, 44): "speckle", (5, 0): "strip"}
    longer = raster.KindLimits(detached=(10.0, 0.0), dot=(5.0, 0.0), dot_most=(50.0, 0.0), dot_reach=(6.0, 0.0), major=(300.0, 0.0), dot_shape=(2.35, 2.7, 0.55, 0.0))
    assert {(r.x0, r.y0): r.kind for r in raster.kinds(shapes, size, longer).collect()}[(2, 44)] == "line"


@pytest.mark.parametrize("cell", [1, 7, 64])
def test_touching_equals_brute_force(spark, cell):
    rng = random.Random(cell)
    boxes = [(k % 3, k, x, y, x + rng.randrange(9), y + rng.randrange(9)) for k in range(60) for x, y in [(rng.randrange(80), rng.randrange(80))]]
    df = spark.createDataFrame(boxes, "image int, component long, x0 int, y0 int, x1 int, y1 int")
    large = [b for b in boxes if b[1] % 4 == 0]
    got = {(r.image, r.component) for r in raster.touching(df, df.filter("component % 4 = 0"), F.lit(3), cell).collect()}
    assert got == {(a[0], a[1]) for a in boxes for b in large if a[0] == b[0] and a[1] != b[1] and a[2] <= b[4] + 3 and a[4] >= b[2] - 3 and a[3] <= b[5] + 3 and a[5] >= b[3] - 3}


@pytest.mark.parametrize("width,step", [(5, 2), (4, 4), (7, 3), (1, 1), (50, 10)])
def test_tiles_cover_and_end_with_the_end(spark, width, step):
    for length in (1, 4, 5, 9, 23, 50, 51):
        t = spark.range(length).withColumn("n", F.lit(length))
        got = {r.id: set(r.t) for r in t.select("id", tracks.tiles_at(F.col("id"), F.col("n"), width, step).alias("t")).collect()}
        starts = t.select(tracks.tile_starts(F.col("n"), width, step).alias("s")).first().s
        want = list(range(0, max(1, length - width + 1), step))
        want += [length - width] if want[-1] + width < length else []
        assert starts == want
        assert got == {p: {s for s in want if s <= p < s + width} for p in range(length)}
        assert all(got.values()) or step > width


def test_suppression_by_files_equals_greedy(spark):
    rng = random.Random(3)
    rows = [(g, rng.uniform(-50, 50), float(rng.randrange(20)), 1.0 + g) for g in range(6) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, at double, v double, gap double")
    for gap in (2.5, "gap"):
        got = sorted((r.g, r.at) for r in sequences.suppress(df, ["g"], "at", "v", gap).collect())
        want = []
        for g in range(6):
            kept = []
            for _, at in sorted((-v, at) for h, at, v, _ in rows if h == g):
                if all(abs(at - k) >= (gap if gap != "gap" else 1.0 + g) for k in kept):
                    kept.append(at)
            want += [(g, at) for at in kept]
        assert got == sorted(want)


def follow(seeds, windows, radius, bend, share, inner, seed_share):
    """The seeded fold as a loop."""
    out = {}
    for seed, base in seeds:
        y, turn, picks = float(seed), 0.0, []
        for centre, p in windows:
            aim = max(seed - bend, min(seed + bend, y + turn))
            low, high = max(0, round(aim - radius)), min(len(p), round(aim + radius + 1))
            if high <= low or max(p) <= 0:
                continue
            best = low + int(np.argmax(p[low:high]))
            if p[best] < max(max(p) * share, base * seed_share) or not len(p) * inner[0] <= best <= len(p) * inner[1]:
                continue
            if picks:
                turn = max(-radius * 0.45, min(radius * 0.45, best - y))
            y = float(best)
            picks.append((centre, y, p[best]))
        if picks:
            out[seed] = picks
    return out


def test_seeded_tracks_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    pages, seeds = [], []
    for k in range(4):
        slope = rng.uniform(-1.5, 1.5, 3)
        for i in range(9):
            p = rng.random(60) * 0.3
            for j, s in enumerate(slope):
                p[int(np.clip(12 + 18 * j + s * i, 0, 59))] += 1.0 - 0.9 * (rng.random() < 0.2)
            pages.append((k, 10 * i, [float(x) for x in p]))
        seeds += [(k, 12 + 18 * j, 1.0) for j in range(3)] + [(k, 0, 30.0)]
    got = tracks.seeded_tracks(spark.createDataFrame(seeds, "image int, seed int, score double"), spark.createDataFrame(pages, "image int, centre long, profile array<double>").repartition(3), 4, 10, 0.5, (0.05, 0.95))
    found = {(r.image, r.seed): [tuple(p) for p in r.picks] for r in got.collect()}
    want = {(k, float(s)): v for k in range(4) for s, v in follow([(s, b) for i, s, b in seeds if i == k], [(c, p) for i, c, p in pages if i == k], 4, 10, 0.5, (0.05, 0.95), 0.035).items()}
    assert found == want and max(len(v) for v in found.values()) >= 7


def test_linking_takes_each_peak_once(spark):
    rng = random.Random(6)
    peaks = [(k, 10 * i, y, float(y)) for k in range(5) for i in range(12) if (k, i) != (2, 5) for y in sorted({rng.randrange(40) for _ in range(rng.randrange(7))})]
    t = tracks.linked(spark.createDataFrame(peaks, "image int, x long, y long, score double").repartition(4), reach=6, step=10, alive=3).collect()
    assert sorted((r.image, r.x, r.y) for r in t) == sorted(p[:3] for p in peaks)
    by = {}
    for r in t:
        by.setdefault((r.image, r.track), []).append((r.x, r.y))
    assert all(len({x for x, _ in v}) == len(v) for v in by.values())
    for v in by.values():
        v.sort()
        for i in range(1, len(v)):
            lead = v[i - 1][1] + ((v[i - 1][1] - v[i - 3][1]) / min(3, i - 1) if i >= 3 else 0)
            assert abs(v[i][1] - lead) <= 6 and v[i][0] - v[i - 1][0] <= 40


def test_disjoint_choice_equals_greedy(spark):
    rng = random.Random(9)
    triples = [(*t, rng.randrange(40) / 10) for t in combinations(range(16), 3) if rng.random() < 0.5] + [(100 + i, 101 + i, 102 + i, float(i)) for i in range(24)]
    used, want = set(), []
    for s, i, j, k in sorted((s, i, j, k) for i, j, k, s in triples):
        if not used & {i, j, k}:
            used |= {i, j, k}
            want.append((i, j, k, s))
    df = spark.createDataFrame(triples, "i int, j int, k int, score double").repartition(5)
    assert sorted(map(tuple, tracks.disjoint_best(df, ["i", "j", "k"], "score").collect())) == sorted(want)
    assert tracks.disjoint_best(df.limit(0), ["i", "j", "k"], "score").count() == 0


def test_disjoint_triples_equal_greedy(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), rng.choice([rng.randrange(60) / 10, 2.0, 3 + rng.random() / 5000, 40.0 + 3 * rng.randrange(9)])) for i in rng.sample(range(1000), 130)] + [(2000, None, 1.0), (2001, 1, None)]
    known = [r for r in rows if None not in r]
    t = [(*sorted((a[0], b[0], c[0])), float(max(a[2], b[2], c[2]) - min(a[2], b[2], c[2]))) for a, b, c in combinations(known, 3) if a[1] == b[1] == c[1] and max(a[2], b[2], c[2]) - min(a[2], b[2], c[2]) <= 4]
    every = spark.createDataFrame(t, "i long, j long, k long, d double").select("i", "j", "k", F.round("d", 4).alias("score"))
    used, want = set(), []
    for s, *m in sorted((r.score, r.i, r.j, r.k) for r in every.collect()):
        if not used & set(m):
            used |= set(m)
            want.append((*m, s))
    got = tracks.disjoint_triples(spark.createDataFrame(rows, "key long, size int, price double").repartition(3), "size", "key", "price", 4.0)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30
    copies = spark.range(3000).select(F.col("id").alias("key"), F.lit(1).alias("size"), F.lit(9.9).alias("price"))  # 4.5 billion triples
    assert sorted(map(tuple, tracks.disjoint_triples(copies, "size", "key", "price", 4.0).collect())) == [(i, i + 1, i + 2, 0.0) for i in range(0, 3000, 3)]


@pytest.mark.parametrize("whole", [0, 100, 100_000])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantile_is_exact(spark, whole, q):
    rng = np.random.default_rng(2)
    groups = {"many": rng.normal(size=30_000), "ties": rng.integers(0, 5, 25_000).astype(float), "few": rng.normal(size=101), "one": np.array([7.0]), "same": np.full(4000, 3.0)}
    if whole == 0:  # brackets are for large groups
        groups = {k: v for k, v in groups.items() if len(v) >= 25_000}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r["quantile"] for r in metrics.quantile(df, ["g"], "v", q, whole).collect()}
    assert got == {k: pytest.approx(np.quantile(v, q), abs=1e-12) for k, v in groups.items()}
    every = np.concatenate(list(groups.values()))
    assert metrics.quantile(df, [], "v", q, whole).first()["quantile"] == pytest.approx(np.quantile(every, q), abs=1e-12)


def test_prototypes_are_counted_before_they_travel(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_CLASSES", 2)
    protos = spark.createDataFrame([(i, [1.0] * 8) for i in range(3)], "cls int, proto array<double>")
    v = spark.createDataFrame([(1, [1.0] * 8)], "id int, embedding array<double>")
    with pytest.raises(ValueError, match="3 classes"):
        similarity.token_transport(v, protos, "embedding", 4)
    with pytest.raises(ValueError, match="3 classes"):
        similarity.ranked_classes(v, protos)


def test_stretch_and_difference_hash(spark):
    rng = np.random.default_rng(8)
    images = {0: rng.random((16, 27)), 1: rng.random((8, 9)), 2: rng.random((7, 30)), 3: np.zeros((9, 10))}
    cells = spark.createDataFrame([(k, y, x, float(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])], "image int, y int, x int, v double").repartition(3)
    size = spark.createDataFrame([(k, *m.shape) for k, m in images.items()], "image int, height int, width int")
    got = {r.image: r.hash for r in raster.difference_hash(cells, size, "v").collect()}
    assert set(got) == {0, 1, 3} and got[3] == "0" * 16
    for k in (0, 1):
        m = images[k]
        f = m.reshape(8, m.shape[0] // 8, 9, m.shape[1] // 9).mean((1, 3))
        assert got[k] == f"{int(''.join('1' if f[r, c] > f[r, c + 1] else '0' for r in range(8) for c in range(8)), 2):016x}"
    t = raster.stretched(cells, "v", F.col("v") > 0.2)
    for r in t.collect():
        inked = images[r.image][images[r.image] > 0.2]
        low, high = np.quantile(inked, [0.28, 0.992]) if inked.size else (0, 1e9)
        assert r.stretched == pytest.approx(np.clip((r.v - low) / max(high - low, 1e-6), 0, 1), abs=1e-9)
