"""Queries of component rules, strips and windows, over components derived from `part` and sign maps of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import sequences, shapes
from quern.plans.registry import query, table

# Parts as components, 400 on a page of 1000 by 700 pixels. Expressions of both engines.
COMPS = {
    "image": "(p_partkey - p_partkey % 400)", "id": "p_partkey", "x0": "(p_partkey * 37) % 930", "y0": "(p_partkey * 91) % 640",
    "x1": "(p_partkey * 37) % 930 + (p_partkey * 7) % 60", "y1": "(p_partkey * 91) % 640 + (p_partkey * 11) % 50",
    "area": "CAST(greatest(1, floor((1 + (p_partkey * 7) % 60) * (1 + (p_partkey * 11) % 50) * CAST(2 + (p_partkey * 13) % 97 AS DOUBLE) / 200)) AS BIGINT)",
    "depth": "CAST((p_partkey * 17) % 100 AS DOUBLE) / 500", "alpha": "CAST((p_partkey * 29) % 100 AS DOUBLE) / 400", "page_w": "1000", "page_h": "700",
}
COMPS_SQL = f"""c0 AS (SELECT {", ".join(f"{e} AS {c}" for c, e in COMPS.items())} FROM part),
c1 AS (SELECT *, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM c0),
c2 AS (SELECT *, greatest(w, h) AS side, least(w, h) AS thick, area / (w * h) AS density, least(w, h) / greatest(w, h) AS roundness FROM c1),
c3 AS (SELECT *, area * greatest(0.03, depth) * greatest(0.4, density) AS score FROM c2)"""
EDGE = "((x0 <= {0} OR y0 <= {0} OR x1 >= page_w - 1 - {0} OR y1 >= page_h - 1 - {0}) AND (w > page_w * 0.18::DOUBLE OR h > page_h * 0.18::DOUBLE))"
STRIP = f"({EDGE.format(2)} OR (w > h * 10 AND h <= 8) OR (h > w * 10 AND w <= 8))"
CLASS_SQL = f"""{COMPS_SQL}, c4 AS (SELECT *, area > 8500 OR w > 210 OR h > 180 OR {STRIP} OR density < 0.025 OR (depth < 0.065 AND area < 70 AND NOT (alpha >= 0.10 AND depth >= 0.04225 AND area >= 14 AND side >= 6)) AS bad FROM c3),
sup AS (SELECT a.id, sum(least(b.score, 24)) AS s FROM c4 a JOIN c4 b ON a.image = b.image AND a.id <> b.id AND NOT a.bad AND NOT b.bad AND abs(a.x - b.x) <= 90 AND abs(a.y - b.y) <= 58 GROUP BY a.id),
kinds AS (SELECT c4.*, CASE WHEN bad THEN 'rejected' WHEN area >= 24 AND h >= 5 AND w >= 3 THEN CASE WHEN area >= 90 OR (alpha >= 0.10 AND (side >= 9 OR area >= 70)) OR coalesce(s, 0) >= 42 THEN 'main' ELSE 'rejected' END WHEN area >= 8 AND depth >= 0.085 AND roundness >= 0.35 AND side <= 32 THEN 'dot' ELSE 'rejected' END AS kind FROM c4 LEFT JOIN sup USING (id))"""
NOISE_SQL = "nz AS (SELECT image, count(*) FILTER (area < 10 AND side <= 8 AND alpha < 0.07 AND depth >= 0.02275) AS speckles, count(*) FILTER (area < 10 AND side <= 8 AND alpha < 0.07 AND depth >= 0.02275) / 0.7 AS per FROM c3 GROUP BY image), nl AS (SELECT *, least(1.0, greatest(0.0, (per - 350) / 1450)) AS noise FROM nz)"


def comps(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(*[F.expr(e).alias(c) for c, e in COMPS.items()])


@query(f"WITH {CLASS_SQL} SELECT id, kind FROM kinds")
def component_classes(spark, sf):
    return shapes.classified(comps(spark, sf)).select("id", "kind")


@query(f"WITH {CLASS_SQL}, cost AS (SELECT d.id, m.id AS main, greatest(0, abs(d.x - m.x) - greatest(m.w / 2, 58)) + 1.4 * greatest(0, abs(d.y - m.y) - greatest(m.h / 2, 42)) AS cost FROM kinds d JOIN kinds m ON d.image = m.image AND d.kind = 'dot' AND m.kind = 'main') SELECT id, arg_min(main, (cost, main)) AS main, round(min(cost), 6) AS cost FROM cost WHERE cost <= 58 GROUP BY id")
def attached_dots(spark, sf):
    return shapes.attached_dots(shapes.classified(comps(spark, sf))).select("id", "main", F.round("cost", 6).alias("cost"))


@query(f"WITH {COMPS_SQL}, {NOISE_SQL} SELECT image, speckles, round(per, 6) AS per_mpix, round(noise, 6) AS noise FROM nl")
def noise_profile(spark, sf):
    return shapes.noise(comps(spark, sf)).select("image", "speckles", F.round("per_mpix", 6).alias("per_mpix"), F.round("noise", 6).alias("noise"))


SPARSE_SQL = f"NOT {EDGE.format(1)} AND NOT (area < 24 AND side <= 7 AND depth < 0.049 AND alpha < 0.45) AND NOT (area <= 8 AND depth < 0.07) AND (area >= 24 OR side >= 9 OR alpha >= 0.35 OR depth >= 0.063)"
RECALL_SQL = f"NOT {STRIP} AND NOT (area < 10 AND side <= 6 AND depth < 0.07475 AND alpha < 0.10) AND ((area >= 10 AND depth >= 0.0377) OR (area >= 5 AND side >= 7 AND depth >= 0.0273) OR (area >= 4 AND alpha >= 0.035) OR (area >= 8 AND depth >= 0.04675 AND side <= 46))"


@query(f"WITH {COMPS_SQL} SELECT id, {SPARSE_SQL} AS sparse, {RECALL_SQL} AS recall FROM c3")
def kept_components(spark, sf):
    t = shapes.measured(comps(spark, sf))
    return t.select("id", shapes.sparse_kept().alias("sparse"), shapes.recall_kept().alias("recall"))


POST_SQL = {
    "strict": "(area >= 24 AND depth >= 0.0468 AND density >= 0.035 AND (side >= 8 OR area >= 70)) OR (area >= 24 AND alpha >= 0.12 AND (side >= 8 OR area >= 70)) OR (near AND area >= 12 AND depth >= 0.0697 AND roundness >= 0.32 AND side <= 34)",
    "light": "(area >= 24 AND (side >= 10 OR area >= 42) AND depth >= 0.0468 AND density >= 0.04 AND (alpha >= 0.035 OR area >= 46)) OR (near AND area >= 9 AND depth >= 0.0663 AND roundness >= 0.28 AND side <= 36 AND (alpha >= 0.025 OR depth >= 0.085))",
    "floor": "(side >= 7 AND area >= 7 AND depth >= 0.0377 AND density >= 0.018) OR ((near OR noise < 0.28 OR side >= 13) AND area >= 10 + round_even(noise * 6, 0) AND depth >= 0.065 * (0.58 + noise * 0.26) AND density >= 0.025 + noise * 0.035) OR (near AND area >= 10 + round_even(noise * 6, 0) AND depth >= 0.085 * (0.62 + noise * 0.16) AND side <= 42)",
}


def _post(mode: str, a: float, b: float) -> str:
    near = f"EXISTS (SELECT 1 FROM kinds m WHERE m.kind = 'main' AND m.image = c3.image AND abs(c3.x - m.x) <= greatest(58, m.w * {a}::DOUBLE) AND abs(c3.y - m.y) <= greatest(42, m.h * {b}::DOUBLE))"
    return f"SELECT id, '{mode}' AS mode, {POST_SQL[mode]} AS kept FROM (SELECT c3.*, {near} AS near, nl.noise FROM c3 JOIN nl USING (image))"


@query(f"WITH {CLASS_SQL}, {NOISE_SQL} {_post('strict', 0.55, 0.75)} UNION ALL {_post('light', 0.75, 0.85)} UNION ALL {_post('floor', 0.85, 0.95)}")
def post_filter_modes(spark, sf):
    c = comps(spark, sf)
    mains = shapes.classified(c).filter("kind = 'main'").select(*COMPS)
    level = shapes.noise(c)
    one = lambda mode: shapes.post_kept(c, mains, mode, level).select("id", F.lit(mode).alias("mode"), "kept")
    return one("strict").union(one("light")).union(one("floor"))


@query(f"WITH {COMPS_SQL}, k AS (SELECT *, greatest(18, floor(h * 0.55::DOUBLE)) AS ex, greatest(14, floor(h * 0.48::DOUBLE)) AS ey FROM c3 WHERE area >= 60), f AS (SELECT * FROM c3 WHERE area < 60 AND side <= 30) SELECT k.id, (round_even(k.y / 44.0::DOUBLE, 0) + 1)::BIGINT AS line, least(k.x0, min(f.x0)) AS x0, least(k.y0, min(f.y0)) AS y0, greatest(k.x1, max(f.x1)) AS x1, greatest(k.y1, max(f.y1)) AS y1 FROM k LEFT JOIN f ON f.image = k.image AND f.x BETWEEN k.x0 - k.ex AND k.x1 + 1 + k.ex AND f.y BETWEEN k.y0 - k.ey AND k.y1 + 1 + k.ey GROUP BY k.id, k.y, k.x0, k.y0, k.x1, k.y1")
def prompt_boxes(spark, sf):
    c = comps(spark, sf)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
    return shapes.prompts(c.filter("area >= 60"), c.filter((F.col("area") < 60) & (side <= 30)), 44.0).drop("image")


GRID_SQL = "p AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def grid(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


@query(f"WITH {GRID_SQL}, s AS (SELECT vec_id, x, min(y) AS a, max(y) AS b, count(*) AS n FROM p WHERE v > -0.1 GROUP BY ALL) SELECT p.vec_id, p.y, p.x, round(CASE WHEN n >= 4 AND y >= a + 1 AND y <= b - 1 THEN v ELSE 0 END, 6) AS v FROM p LEFT JOIN s USING (vec_id, x)")
def interior_edges_suppressed(spark, sf):
    t = sequences.suppress_edges(grid(spark, sf), ["vec_id", "x"], "y", "v", F.col("v") > -0.1, margin=1, least=4)
    return t.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {GRID_SQL}, r AS (SELECT vec_id, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM (SELECT vec_id, y, x, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS g FROM p WHERE v > 0) GROUP BY vec_id, y, g),
w AS (SELECT vec_id, y, max(n) AS longest, sum(n) AS ink FROM r GROUP BY vec_id, y), s AS (SELECT vec_id, y FROM w WHERE longest >= 5 OR ((y <= 1 OR y >= 6) AND longest >= 4) OR ink >= 6),
b AS (SELECT vec_id, min(y) AS y0, max(y) AS y1 FROM (SELECT vec_id, y, y - row_number() OVER (PARTITION BY vec_id ORDER BY y) AS g FROM s) GROUP BY vec_id, g),
k AS (SELECT * FROM b WHERE y1 - y0 + 1 <= 2 OR y0 <= 1 OR y1 + 1 >= 6) SELECT DISTINCT r.vec_id, r.y, r.x0, r.x1 FROM r JOIN k ON k.vec_id = r.vec_id AND r.y BETWEEN k.y0 - 1 AND k.y1 + 1 WHERE r.n >= CASE WHEN r.y <= 1 OR r.y >= 6 THEN 4 ELSE 5 END""")
def strip_rows(spark, sf):
    return sequences.strips(grid(spark, sf).filter("v > 0"), "vec_id", height=8, edge=(1, 6), long_run=5, edge_run=4, ink=6, band=2)


@query("WITH h AS (SELECT event_type, floor(epoch(ts) / 86400)::BIGINT AS d, count(*)::DOUBLE AS n FROM events GROUP BY ALL), w AS (SELECT *, min(d) OVER (PARTITION BY event_type) AS d0 FROM h), p AS (SELECT event_type, (d - d0) // 7 AS win, arg_max(d, (n, -d)) AS y FROM w GROUP BY event_type, win), t AS (SELECT *, (y - lag(y) OVER o) AS step FROM p WINDOW o AS (PARTITION BY event_type ORDER BY win)), g AS (SELECT *, sum((step IS NULL OR abs(step - 7) > 3)::INT) OVER (PARTITION BY event_type ORDER BY win) AS track FROM t) SELECT event_type, track::BIGINT AS track, count(*) AS n, min(win) AS first, max(win) AS last, round(avg(y), 6) AS mean FROM g GROUP BY event_type, track")
def linked_tracks(spark, sf):
    h = table(spark, sf, "events").groupBy("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = h.groupBy("event_type").agg(F.min("d").alias("d0"))
    peaks = h.join(first, "event_type").withColumn("win", F.floor((F.col("d") - F.col("d0")) / 7)).groupBy("event_type", "win").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("y"))
    t = sequences.link(peaks, ["event_type"], "win", "y", drift=7, reach=3)
    return t.select("event_type", "track", "n", "first", "last", F.round("mean", 6).alias("mean"))


PRESENCE = {"depth": 9.0, "alpha": 4.0, "density": 1.5, "side": 0.02}


@query(f"WITH {COMPS_SQL}, s AS (SELECT *, 1 / (1 + exp(-({' + '.join(f'{w!r}::DOUBLE * {c}' for c, w in PRESENCE.items())} - 3.0::DOUBLE))) AS presence, (round_even(y / 44.0::DOUBLE, 0) + 1)::BIGINT AS line FROM c3) SELECT image, id, line, round(presence, 6) AS presence, row_number() OVER (PARTITION BY image ORDER BY line, x0, id)::INT AS number FROM s WHERE presence >= 0.55::DOUBLE")
def presence_filtered(spark, sf):
    t = shapes.present(comps(spark, sf), PRESENCE, -3.0, 44.0)
    return t.select("image", "id", "line", F.round("presence", 6).alias("presence"), "number")
