"""Queries over rasters, tiles and tracks. Pages are 64 columns of vectors of `embeddings`, their positions the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import geometry, raster, sequences, tracks
from quern.plans.registry import query, table

SIDE = 64
CELLS_SQL = f"c AS (SELECT vec_id // {SIDE} AS image, i - 1 AS y, vec_id % {SIDE} AS x, v, least(1.0::DOUBLE, greatest(0.0::DOUBLE, v + 0.5)) AS u FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)), z AS (SELECT image, max(y) + 1 AS height, max(x) + 1 AS width FROM c GROUP BY image)"
RUNS = "SELECT image, y, min(x) AS x0, max(x) AS x1 FROM (SELECT image, y, x, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM {0}) GROUP BY image, y, g"


def cells(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("y", "v"))
    v = F.col("v").cast("double")
    return e.select(F.expr(f"vec_id div {SIDE}").alias("image"), "y", (F.col("vec_id") % SIDE).cast("int").alias("x"), v.alias("v"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + 0.5)).alias("u"))


def sizes(c: DataFrame) -> DataFrame:
    return c.groupBy("image").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


_NINE = "(SELECT a.a, b.b FROM range(-1, 2) a(a), range(-1, 2) b(b)) o"


@query(f"""WITH {CELLS_SQL}, p AS (SELECT image, y, x FROM c WHERE v > 0.12),
d AS (SELECT DISTINCT image, y + a AS y, x + b AS x FROM p JOIN z USING (image), {_NINE} WHERE y + a BETWEEN 0 AND height - 1 AND x + b BETWEEN 0 AND width - 1),
e AS (SELECT image, y + a AS y, x + b AS x FROM p, {_NINE} GROUP BY ALL HAVING count(*) = 9),
k AS (SELECT image, y + a AS y, x + b AS x FROM d, {_NINE} GROUP BY ALL HAVING count(*) = 9),
n AS (SELECT DISTINCT image, y + a AS y, x + b AS x FROM e JOIN z USING (image), {_NINE} WHERE y + a BETWEEN 0 AND height - 1 AND x + b BETWEEN 0 AND width - 1)
SELECT 'dilated' AS step, * FROM ({RUNS.format("d")}) UNION ALL SELECT 'eroded', * FROM ({RUNS.format("e")}) UNION ALL SELECT 'closed', * FROM ({RUNS.format("k")}) UNION ALL SELECT 'opened', * FROM ({RUNS.format("n")})""")
def closed_runs(spark, sf):
    c = cells(spark, sf)
    size = sizes(c)
    runs = geometry.runs_of(c.filter("v > 0.12").select("image", "y", "x"))
    out = None
    for step in (raster.dilated, raster.eroded, raster.closed, raster.opened):
        own = step(runs, size, 1).select(F.lit(step.__name__).alias("step"), "image", "y", "x0", "x1")
        out = own if out is None else out.unionByName(own)
    return out


def _box(n: int, axis: str) -> str:
    across = "x" if axis == "y" else "y"
    return f"(PARTITION BY image, {across} ORDER BY {axis} RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING)"


@query(f"""WITH {CELLS_SQL}, m AS (SELECT image, y, x, u, max(m) OVER {_box(2, "y")} AS m FROM (SELECT *, max(u) OVER {_box(2, "x")} AS m FROM c)),
g AS (SELECT image, y, x, u, sum(s) OVER {_box(1, "y")} / sum(n) OVER {_box(1, "y")} AS g FROM (SELECT *, sum(m) OVER {_box(1, "x")} AS s, count(*) OVER {_box(1, "x")} AS n FROM m))
SELECT image, y, x, round(g, 6) AS background, round(pow(least(1, greatest(0, (g - u) / greatest(g, 0.08::DOUBLE))), 0.85::DOUBLE), 6) AS depth FROM g""")
def local_background(spark, sf):
    t = raster.relative_depth(cells(spark, sf), "u", reach=2, smooth=1)
    return t.select("image", "y", "x", F.round("background", 6).alias("background"), F.round("depth", 6).alias("depth"))


TILE, OVERLAP = 24, 8


def _hann(at: str, n: str) -> str:
    return f"greatest(0.05::DOUBLE, 0.5::DOUBLE - 0.5::DOUBLE * cos({2 * math.pi!r}::DOUBLE * ({n} // 2 + {at}) / (greatest(4, 2 * {n}) - 1)))"


_STARTS = "list_distinct(range(0, greatest(0, {0} - {1}) + 1, {2}) || [greatest(0, {0} - {1})])"


@query(f"""WITH {CELLS_SQL}, t AS (SELECT image, least({TILE}, height) AS th, least({TILE}, width) AS tw, unnest({_STARTS.format("height", TILE, TILE - OVERLAP)}) AS ty, xs FROM (SELECT *, {_STARTS.format("width", TILE, TILE - OVERLAP)} AS xs FROM z)),
u AS (SELECT image, th, tw, ty, unnest(xs) AS tx FROM t),
s AS (SELECT c.image, y, x, c.u, ty, tx, {_hann("(y - ty)", "th")} * {_hann("(x - tx)", "tw")} AS w, min(c.u) OVER q AS low, max(c.u) OVER q AS high FROM c JOIN u ON u.image = c.image AND y BETWEEN ty AND ty + th - 1 AND x BETWEEN tx AND tx + tw - 1 WINDOW q AS (PARTITION BY c.image, ty, tx))
SELECT image, y, x, round(sum((u - low) / greatest(high - low, 1e-6::DOUBLE) * w) / sum(w), 6) AS score, count(*) AS tiles FROM s GROUP BY image, y, x""")
def blended_tiles(spark, sf):
    c = cells(spark, sf)
    t = tracks.tiled(c.select("image", "y", "x", "u"), sizes(c), TILE, OVERLAP)
    lim = t.groupBy("image", "ty", "tx").agg(F.min("u").alias("low"), F.max("u").alias("high"))
    t = t.join(lim, ["image", "ty", "tx"]).withColumn("score", (F.col("u") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6)))
    return tracks.blended(t, "score").join(t.groupBy("image", "y", "x").agg(F.count(F.lit(1)).alias("tiles")), ["image", "y", "x"]).withColumn("score", F.round("score", 6))


@query(f"WITH d AS (SELECT user_id, max(floor(epoch(ts) / 3600)::BIGINT) - min(floor(epoch(ts) / 3600)::BIGINT) + 1 AS n FROM events GROUP BY user_id), t AS (SELECT user_id, n, unnest({_STARTS.format('n', 500, 120)}) AS x0 FROM d) SELECT user_id, x0::INT AS x0, least(n, x0 + 500)::BIGINT AS x1, (x0 + least(n, x0 + 500)) // 2 AS centre FROM t")
def window_plan(spark, sf):
    h = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    d = table(spark, sf, "events").groupBy("user_id").agg((F.max(h) - F.min(h) + 1).alias("n"))
    t = d.select("user_id", "n", F.explode(tracks.tile_starts(F.col("n"), 500, 120)).alias("x0")).withColumn("x1", F.least("n", F.col("x0") + 500))
    return t.select("user_id", "x0", "x1", F.floor((F.col("x0") + F.col("x1")) / 2).alias("centre"))


WIN, STEP, INTERIOR = 24, 12, -0.05


def _smoothed(value: str, radius: int) -> str:
    return " + ".join(f"{w!r}::DOUBLE * coalesce({'lag' if k < 0 else 'lead'}({value}, {abs(k)}) OVER w, 0)" for k, w in zip(range(-radius, radius + 1), sequences.hann(radius), strict=True))


WINDOWS_SQL = f"""w0 AS (SELECT image, width, unnest({_STARTS.format("width", WIN, STEP)}) AS x0 FROM z),
w1 AS (SELECT c.image, w0.x0, c.y, any_value(least({WIN}, width)) AS tw, sum(u) / sqrt(greatest(count(*) FILTER (v > {INTERIOR}), 1)) AS s, count(*) FILTER (v > {INTERIOR}) AS n FROM c JOIN w0 ON w0.image = c.image AND c.x BETWEEN w0.x0 AND w0.x0 + {WIN} - 1 GROUP BY ALL),
w2 AS (SELECT *, round({_smoothed("s", 2)}, 9) AS sm FROM w1 WINDOW w AS (PARTITION BY image, x0 ORDER BY y)),
win AS (SELECT image, x0, x0 + any_value(tw) // 2 AS centre, list(sm ORDER BY y) AS profile, max(sm) AS most FROM w2 GROUP BY image, x0 HAVING max(n) >= greatest(8, any_value(tw) * 0.14::DOUBLE))"""
SEEDS_SQL = f"""g0 AS (SELECT image, y, sum(u) / sqrt(greatest(count(*) FILTER (v > {INTERIOR}), 1)) AS s FROM c GROUP BY ALL),
g1 AS (SELECT *, round({_smoothed("s", 3)}, 9) AS sm FROM g0 WINDOW w AS (PARTITION BY image ORDER BY y)),
g2 AS (SELECT *, max(sm) OVER (PARTITION BY image) AS most, lag(sm) OVER w AS p, lead(sm) OVER w AS q FROM g1 WINDOW w AS (PARTITION BY image ORDER BY y)),
g3 AS (SELECT * FROM g2 WHERE sm >= coalesce(p, -1) AND sm > coalesce(q, -1) AND sm >= most * 0.5::DOUBLE),
seeds AS (SELECT image, unnest(list_reduce(list([y] ORDER BY sm DESC, y), lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(k - b[1]) < 5)) > 0 THEN a ELSE list_concat(a, b) END)) AS y FROM g3 GROUP BY image),
seed AS (SELECT g3.image, g3.y, g3.sm FROM g3 JOIN seeds USING (image, y))"""


def page_windows(c: DataFrame) -> DataFrame:
    return tracks.window_profiles(c, sizes(c), "u", F.col("v") > INTERIOR, WIN, STEP, smooth=2)


def page_seeds(c: DataFrame) -> DataFrame:
    rows = c.groupBy("image", "y").agg((F.sum("u") / F.sqrt(F.greatest(F.count_if(F.col("v") > INTERIOR).cast("double"), F.lit(1.0)))).alias("s"))
    t = sequences.smooth(rows, ["image"], "y", "s", 3).withColumn("score", F.round("smoothed", 9))
    t = t.join(t.groupBy("image").agg(F.max("score").alias("most")), "image")
    high = sequences.local_maxima(t, ["image"], "y", "score", F.col("most") * F.lit(0.5))
    return sequences.suppress(high.select("image", "y", "score"), ["image"], "y", "score", 5)


@query(f"""WITH RECURSIVE {CELLS_SQL}, {WINDOWS_SQL}, {SEEDS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY centre) AS k FROM win),
f AS (SELECT image, y AS seed, sm AS base, 0::BIGINT AS k, y::DOUBLE AS pos, 0.0::DOUBLE AS turn, []::STRUCT(x BIGINT, y DOUBLE, s DOUBLE)[] AS picks FROM seed
 UNION ALL SELECT image, seed, base, k, CASE WHEN ok THEN best ELSE pos END, CASE WHEN ok AND len(picks) >= 1 THEN greatest(-2.7::DOUBLE, least(2.7::DOUBLE, best - pos)) ELSE turn END, CASE WHEN ok THEN list_append(picks, {{'x': centre, 'y': best, 's': top}}) ELSE picks END
 FROM (SELECT *, most > 0 AND high > low AND top >= greatest(most * 0.6::DOUBLE, base * 0.035::DOUBLE) AND best BETWEEN h * 0.05::DOUBLE AND h * 0.95::DOUBLE AS ok
 FROM (SELECT *, list_max(near) AS top, (low + list_position(near, list_max(near)) - 1)::DOUBLE AS best FROM (SELECT *, profile[low + 1:high] AS near FROM
 (SELECT f.image, seed, base, o.k, pos, turn, picks, centre, profile, most, len(profile) AS h, greatest(0, round_even(aim - 6, 0)::INT) AS low, least(len(profile), round_even(aim + 7, 0)::INT) AS high
 FROM (SELECT *, greatest(seed - 12, least(seed + 12, pos + turn)) AS aim FROM f) f JOIN o ON o.image = f.image AND o.k = f.k + 1)))) q),
t AS (SELECT f.image, seed, picks, len(picks) AS n FROM f JOIN (SELECT image, max(k) AS k FROM o GROUP BY image) USING (image, k) WHERE len(picks) > 0),
l AS (SELECT image, seed, n, picks[1].x AS x0, picks[-1].x AS x1, round(list_sum(list_transform(picks, lambda p: p.y)) / n, 9) AS mean, round(list_median(list_transform(picks, lambda p: p.s)), 9) AS score FROM t WHERE n >= 2 AND picks[-1].x - picks[1].x >= 12),
b AS (SELECT image, list_reduce(list([mean] ORDER BY score DESC, mean), lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(k - b[1]) < 3)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM l GROUP BY image)
SELECT image, seed::DOUBLE AS seed, n::INT AS n, x0, x1, round(mean, 6) AS mean, round(score, 6) AS score FROM l JOIN b USING (image) WHERE list_contains(kept, mean) QUALIFY row_number() OVER (PARTITION BY image, l.mean ORDER BY l.score DESC, l.seed) = 1""")
def seeded_line_tracks(spark, sf):
    c = cells(spark, sf)
    t = tracks.seeded_tracks(page_seeds(c).withColumnRenamed("y", "seed"), page_windows(c), radius=6, bend=12, share=0.6, inner=(0.05, 0.95))
    return tracks.track_lines(t, least=2, span=12, apart=3).withColumns({"mean": F.round("mean", 6), "score": F.round("score", 6)})


PEAKS_SQL = """pk AS (SELECT image, centre AS x, y - 1 AS y, profile[y] AS s FROM (SELECT *, unnest(range(1, len(profile) + 1)) AS y FROM win) WHERE profile[y] >= most * 0.75::DOUBLE AND profile[y] >= CASE WHEN y > 1 THEN profile[y - 1] ELSE -1 END AND profile[y] > CASE WHEN y < len(profile) THEN profile[y + 1] ELSE -1 END)"""


@query(f"""WITH RECURSIVE {CELLS_SQL}, {WINDOWS_SQL}, {PEAKS_SQL},
o AS (SELECT image, x, ys, row_number() OVER (PARTITION BY image ORDER BY x) AS k, lag(x) OVER (PARTITION BY image ORDER BY x) AS before FROM (SELECT image, x, list(y ORDER BY y) AS ys FROM pk GROUP BY image, x)),
f AS (SELECT image, k, 1::BIGINT AS i, 1::BIGINT AS n, ys AS free, x, before, []::STRUCT(x BIGINT[], y BIGINT[])[] AS tr FROM o WHERE k = 1
 UNION ALL SELECT q.image, CASE WHEN last THEN o.k ELSE q.k END, CASE WHEN last THEN 1 ELSE i + 1 END, CASE WHEN last THEN len(after) ELSE n END, CASE WHEN last THEN o.ys ELSE rest END, CASE WHEN last THEN o.x ELSE q.x END, CASE WHEN last THEN o.before ELSE q.before END, after
 FROM (SELECT *, CASE WHEN last THEN list_concat(now, list_transform(rest, lambda y: {{'x': [x], 'y': [y]}})) ELSE now END AS after FROM
 (SELECT *, i >= n AS last, CASE WHEN hit IS NULL THEN free ELSE list_filter(free, lambda y: y <> hit) END AS rest, CASE WHEN hit IS NULL THEN tr ELSE list_concat(tr[1:i - 1], [{{'x': list_append(t.x, x), 'y': list_append(t.y, hit)}}], tr[i + 1:]) END AS now FROM
 (SELECT *, CASE WHEN t.x[-1] >= before - 36 THEN list_filter(free, lambda y: abs(y - lead) <= 4 AND abs(y - lead) = list_min(list_transform(free, lambda k: abs(k - lead))))[1] END AS hit FROM
 (SELECT *, tr[i] AS t, tr[i].y[-1] + CASE WHEN len(tr[i].y) >= 3 THEN (tr[i].y[-1] - tr[i].y[-3]) / least(3, len(tr[i].y) - 1) ELSE 0 END AS lead FROM f)))) q LEFT JOIN o ON o.image = q.image AND o.k = q.k + 1 WHERE NOT last OR o.k IS NOT NULL),
e AS (SELECT image, after AS tr FROM (SELECT *, CASE WHEN i >= n THEN 1 END AS z FROM f JOIN (SELECT image, max(k) AS k FROM o GROUP BY image) USING (image, k)) f0, LATERAL (SELECT
 CASE WHEN hit IS NULL THEN list_concat(tr, list_transform(free, lambda y: {{'x': [x], 'y': [y]}})) ELSE list_concat(tr[1:i - 1], [{{'x': list_append(t.x, x), 'y': list_append(t.y, hit)}}], tr[i + 1:], list_transform(list_filter(free, lambda y: y <> hit), lambda y: {{'x': [x], 'y': [y]}})) END AS after FROM
 (SELECT t, CASE WHEN t.x[-1] >= before - 36 THEN list_filter(free, lambda y: abs(y - lead) <= 4 AND abs(y - lead) = list_min(list_transform(free, lambda k: abs(k - lead))))[1] END AS hit FROM
 (SELECT tr[i] AS t, tr[i].y[-1] + CASE WHEN len(tr[i].y) >= 3 THEN (tr[i].y[-1] - tr[i].y[-3]) / least(3, len(tr[i].y) - 1) ELSE 0 END AS lead))) WHERE z = 1)
SELECT image, j::BIGINT AS track, unnest(tr[j].x) AS x, unnest(tr[j].y) AS y FROM (SELECT *, unnest(range(1, len(tr) + 1)) AS j FROM e)""")
def linked_page_tracks(spark, sf):
    w = page_windows(cells(spark, sf)).withColumn("most", F.array_max("profile"))
    rows = w.select("image", F.col("centre").alias("x"), "most", F.posexplode("profile").alias("y", "score"))
    peaks = sequences.local_maxima(rows, ["image", "x"], "y", "score", F.col("most") * F.lit(0.75))
    return tracks.linked(peaks.withColumn("y", F.col("y").cast("long")), reach=4, step=STEP).select("image", "track", "x", "y")


TRIPLES_SQL = "n AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size = b.p_size AND abs(a.p_retailprice - b.p_retailprice) <= 4), t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN n z ON z.a = x.b AND z.b = y.b), s AS (SELECT t.*, round(greatest(a.p_retailprice, b.p_retailprice, c.p_retailprice) - least(a.p_retailprice, b.p_retailprice, c.p_retailprice), 4) AS score FROM t JOIN part a ON a.p_partkey = i JOIN part b ON b.p_partkey = j JOIN part c ON c.p_partkey = k)"


@query(f"WITH {TRIPLES_SQL}, g AS (SELECT list_reduce(list([i, j, k] ORDER BY score, i, j, k), lambda a, b: CASE WHEN list_has_any(a, b) THEN a ELSE list_concat(a, b) END) AS m FROM s), u AS (SELECT m[3 * q + 1] AS i, m[3 * q + 2] AS j, m[3 * q + 3] AS k FROM (SELECT m, unnest(range(0, len(m) // 3)) AS q FROM g)) SELECT i, j, k, score FROM u JOIN s USING (i, j, k)")
def disjoint_triples(spark, sf):
    return tracks.disjoint_triples(table(spark, sf, "part"), "p_size", "p_partkey", "p_retailprice", 4.0)


def _components(where: str) -> str:
    """Components by flooding: every pixel learns the smallest number that it reaches."""
    return f"""p AS (SELECT image, y, x, u FROM c WHERE {where}),
r AS (SELECT image, y, x, y * {SIDE} + x AS m FROM p UNION SELECT q.image, q.y, q.x, r.m FROM r JOIN p q ON q.image = r.image AND q.y BETWEEN r.y - 1 AND r.y + 1 AND q.x BETWEEN r.x - 1 AND r.x + 1),
k AS (SELECT image, y, x, min(m) AS m FROM r GROUP BY ALL),
a AS (SELECT image, m, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, avg(u) AS mean, var_pop(x::DOUBLE) AS vx, var_pop(y::DOUBLE) AS vy, covar_pop(x::DOUBLE, y::DOUBLE) AS cv, any_value(height) AS height, any_value(width) AS width FROM k JOIN p USING (image, y, x) JOIN z USING (image) GROUP BY image, m)"""


LIMITS = raster.KindLimits().scaled(0.05)
_L = LIMITS
_AT = lambda pair: f"greatest({pair[0]!r}, height * width * {pair[1]!r}::DOUBLE)"


SHAPES_SQL = f"""b AS (SELECT *, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, (vx + vy) / 2 AS half, sqrt(greatest(0, ((vx + vy) / 2) ** 2 - (vx * vy - cv ** 2))) AS root FROM a),
d AS (SELECT *, greatest(w, h) / least(w, h) AS ratio, area / (w * h) AS fill, sqrt(greatest(half + root, 1e-5::DOUBLE) / greatest(half - root, 1e-5::DOUBLE)) AS el, abs(degrees(atan2(2 * cv, vx - vy + 1e-9::DOUBLE) / 2)) AS an, greatest({_L.dot_reach[0]!r}, width * {_L.dot_reach[1]!r}::DOUBLE) AS reach,
 x0 <= width * {_L.strip_edge!r}::DOUBLE OR x1 >= width * {1 - _L.strip_edge!r}::DOUBLE OR y0 <= height * {_L.strip_edge!r}::DOUBLE OR y1 >= height * {1 - _L.strip_edge!r}::DOUBLE AS edge FROM b),
g AS (SELECT *, EXISTS (SELECT 1 FROM d o WHERE o.image = d.image AND o.m <> d.m AND o.area >= {_AT(_L.major)} AND d.x1 >= o.x0 - o.reach AND d.x0 <= o.x1 + o.reach AND d.y1 >= o.y0 - o.reach AND d.y0 <= o.y1 + o.reach) AS near FROM d)"""
KIND_SQL = f"""CASE WHEN edge AND ((w > width * 0.34::DOUBLE AND h < height * 0.18::DOUBLE) OR (w > width * 0.16::DOUBLE AND h < height * 0.14::DOUBLE AND ratio >= 4)) THEN 'strip'
 WHEN near AND area BETWEEN {_AT(_L.dot)} AND {_AT(_L.dot_most)} AND ratio <= {_L.dot_shape[0]!r}::DOUBLE AND el <= {_L.dot_shape[1]!r}::DOUBLE AND fill >= {_L.dot_shape[2]!r}::DOUBLE AND mean >= {_L.dot_shape[3]!r}::DOUBLE THEN 'keep'
 WHEN area < {_AT(_L.detached)} * CASE WHEN edge THEN {_L.detached_edge!r}::DOUBLE ELSE 1 END THEN 'speckle'
 WHEN (an BETWEEN 15 AND 75 AND el >= {_L.line_ratio!r}::DOUBLE AND area < height * width * {_L.line_share!r}::DOUBLE) OR (ratio >= {_L.line_ratio * 1.6!r}::DOUBLE AND area < height * width * 0.04::DOUBLE) THEN 'line'
 WHEN (area < {_AT(_L.speckle)} AND mean < {_L.speckle[2]!r}::DOUBLE) OR (area < {_AT(_L.faint)} AND mean < {_L.faint[2]!r}::DOUBLE) THEN 'speckle' ELSE 'keep' END"""


@query(f'WITH RECURSIVE {CELLS_SQL}, {_components("v > 0.12")},\n{SHAPES_SQL}\nSELECT image, area, x0, y0, x1, y1, round(mean, 6) AS mean, round(el, 4) AS elongation, {KIND_SQL} AS kind FROM g')
def component_kinds(spark, sf):
    c = cells(spark, sf)
    shapes = raster.moments(raster.labelled_runs(c.filter("v > 0.12").select("image", "y", "x", "u"), "u"))
    t = raster.kinds(shapes, sizes(c), LIMITS)
    return t.select("image", "area", "x0", "y0", "x1", "y1", F.round("mean", 6).alias("mean"), F.round("elongation", 4).alias("elongation"), "kind")


@query(f"""WITH RECURSIVE {CELLS_SQL}, {_components("v > 0.1")},
q AS (SELECT image, quantile_cont(y1 - y0 + 1, 0.5) AS glyph FROM a WHERE area >= 6 AND y1 - y0 + 1 >= greatest(4, round_even(height * 0.02::DOUBLE, 0)) GROUP BY image),
s AS (SELECT image, count(*) >= 90 AS dense FROM a GROUP BY image),
i0 AS (SELECT image, y, count(*)::DOUBLE AS ink FROM p GROUP BY ALL), i1 AS (SELECT z.image, t.y, coalesce(ink, 0) AS ink FROM z, LATERAL (SELECT unnest(range(0, height)) AS y) t LEFT JOIN i0 ON i0.image = z.image AND i0.y = t.y),
i2 AS (SELECT image, y, round({_smoothed("ink", 1)}, 9) AS sm FROM i1 WINDOW w AS (PARTITION BY image ORDER BY y)),
i3 AS (SELECT i2.image, y, sm, greatest(2.0, round_even(glyph * 1.5, 0)) + 1 AS gap FROM i2 JOIN q USING (image) WHERE sm >= 0.18::DOUBLE * (SELECT max(sm) FROM i2 j WHERE j.image = i2.image)),
i4 AS (SELECT image, list_reduce(list([y::DOUBLE, gap::DOUBLE] ORDER BY sm DESC, y), lambda a, b: CASE WHEN len(list_filter(range(1, len(a), 2), lambda n: abs(a[n] - b[1]) < b[2])) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM i3 GROUP BY image),
i5 AS (SELECT image, y, y - lag(y) OVER (PARTITION BY image ORDER BY y) AS d FROM (SELECT image, kept[n] AS y FROM (SELECT *, unnest(range(1, len(kept), 2)) AS n FROM i4))),
i6 AS (SELECT image, quantile_cont(d, 0.5) AS between_, count(*) AS lines FROM i5 GROUP BY image)
SELECT image, glyph::DOUBLE AS glyph_height, lines, greatest(12, round_even(6 * (glyph / 8.0) ** 2, 0)::BIGINT) AS min_area, greatest(4, round_even(glyph * 0.35::DOUBLE, 0)::BIGINT) AS min_height, round_even(glyph * 1.65::DOUBLE, 0)::BIGINT AS max_height, round_even(glyph * 1.5, 0)::BIGINT AS max_width, round_even(CASE WHEN dense THEN glyph * 1.3125 ELSE coalesce(between_, glyph * 1.4::DOUBLE) END, 0)::BIGINT AS line_step, dense FROM q JOIN s USING (image) LEFT JOIN i6 USING (image)""")
def suggested_limits(spark, sf):
    c = cells(spark, sf)
    runs = raster.labelled_runs(c.filter("v > 0.1").select("image", "y", "x"))
    return raster.suggested(runs, raster.moments(runs), sizes(c), least_area=6, least_height=4, unit=8.0, dense=90)


@query(f"""WITH {CELLS_SQL}, q AS (SELECT image, quantile_cont(v, 0.28) AS low, quantile_cont(v, 0.992) AS high FROM c WHERE v > 0 GROUP BY image),
s AS (SELECT image, y, x, u, least(1.0::DOUBLE, greatest(0.0::DOUBLE, v * 4)) AS alpha, coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v - low) / greatest(high - low, 1e-6::DOUBLE))), 0) AS t FROM c LEFT JOIN q USING (image))
SELECT image, y, x, round(t, 6) AS stretched, round(u * (1 - alpha) + (1 - t) * alpha, 6) AS composed FROM s""")
def stretched_pages(spark, sf):
    t = raster.stretched(cells(spark, sf), "v", F.col("v") > 0)
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") * 4))
    return t.select("image", "y", "x", F.round("stretched", 6).alias("stretched"), F.round(raster.composed(F.col("u"), F.col("stretched"), alpha), 6).alias("composed"))


@query(f"""WITH {CELLS_SQL}, f AS (SELECT image, y * 8 // height AS r, x * 9 // width AS k, round(avg(u), 9) AS m FROM c JOIN z USING (image) WHERE height >= 8 AND width >= 9 GROUP BY ALL), b AS (SELECT image, list(m ORDER BY r, k) AS m FROM f GROUP BY image),
n AS (SELECT image, list_transform(range(0, 16), lambda h: list_sum(list_transform(range(0, 4), lambda j: CASE WHEN m[(4 * h + j) // 8 * 9 + (4 * h + j) % 8 + 1] > m[(4 * h + j) // 8 * 9 + (4 * h + j) % 8 + 2] THEN (8 >> j::INT)::INT ELSE 0 END))) AS n FROM b)
SELECT image, array_to_string(list_transform(n, lambda d: substr('0123456789abcdef', d::INT + 1, 1)), '') AS hash FROM n""")
def page_difference_hashes(spark, sf):
    c = cells(spark, sf)
    return raster.difference_hash(c, sizes(c), "u")
