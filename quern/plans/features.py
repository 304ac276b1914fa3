"""Queries over feature channels, grids and canvases of pages, completed tokens, sheets, keys, records of runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import features, governance, metrics, raster, similarity
from quern.plans.pages import CELLS_SQL, KIND_SQL, LIMITS, SHAPES_SQL, _box, _components, cells, sizes
from quern.plans.registry import E_SQL, P_SQL, ROUTE_SQL, pred, query, r6, routed, table

REACH, SMOOTH, SIGMA, GRID, SIDE, SHARE = 2, 1, 1.0, 7, 48, 1.3
_W = features.gaussian(SIGMA)
_ROWS, _COLUMNS = "(PARTITION BY image, y ORDER BY x)", "(PARTITION BY image, x ORDER BY y)"
_CLAMP = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
DARK_SQL = f"""{CELLS_SQL}, m AS (SELECT image, y, x, u, max(m) OVER {_box(REACH, "y")} AS m FROM (SELECT *, max(u) OVER {_box(REACH, "x")} AS m FROM c)),
g AS (SELECT image, y, x, u, sum(s) OVER {_box(SMOOTH, "y")} / sum(n) OVER {_box(SMOOTH, "y")} AS g FROM (SELECT *, sum(m) OVER {_box(SMOOTH, "x")} AS s, count(*) OVER {_box(SMOOTH, "x")} AS n FROM m)),
dark AS (SELECT image, y, x, u, pow({_CLAMP.format("(g - u) / greatest(g, 0.08::DOUBLE)")}, 0.85::DOUBLE) AS darkness FROM g)"""
# The blurred image by all pairs of near cells, the gradient by its eight neighbours.
CHANNELS_SQL = f"""{DARK_SQL}, soft AS (SELECT image, y, x, sum(u * k) / sum(k) AS s FROM (SELECT a.image, a.y, a.x, b.u, exp(-0.5::DOUBLE * ((a.y - b.y) ** 2 + (a.x - b.x) ** 2) / {SIGMA * SIGMA!r}::DOUBLE) AS k FROM c a JOIN c b ON a.image = b.image AND b.y BETWEEN a.y - {len(_W) - 1} AND a.y + {len(_W) - 1} AND b.x BETWEEN a.x - {len(_W) - 1} AND a.x + {len(_W) - 1}) GROUP BY ALL),
side AS (SELECT image, y, x, u, coalesce(lag(u) OVER w, lead(u) OVER w, u) AS l, coalesce(lead(u) OVER w, lag(u) OVER w, u) AS r FROM c WINDOW w AS {_ROWS}),
edge AS (SELECT image, y, x, sqrt((coalesce(lag(r - l) OVER w, lead(r - l) OVER w, r - l) + 2 * (r - l) + coalesce(lead(r - l) OVER w, lag(r - l) OVER w, r - l)) ** 2 + (coalesce(lead(l + 2 * u + r) OVER w, lag(l + 2 * u + r) OVER w, 0) - coalesce(lag(l + 2 * u + r) OVER w, lead(l + 2 * u + r) OVER w, 0)) ** 2) AS gradient FROM side WINDOW w AS {_COLUMNS}),
raw AS (SELECT image, y, x, darkness, pow(darkness, 0.72::DOUBLE) AS alpha, abs(u - s) AS contrast, gradient FROM dark JOIN soft USING (image, y, x) JOIN edge USING (image, y, x)),
top AS (SELECT image, greatest(1e-4::DOUBLE, quantile_cont(contrast, 0.99)) AS qc, greatest(1e-4::DOUBLE, quantile_cont(gradient, 0.99)) AS qg FROM raw GROUP BY image),
ch AS (SELECT image, y, x, darkness, {_CLAMP.format("contrast / qc")} AS contrast, alpha, {_CLAMP.format("gradient / qg")} AS gradient FROM raw JOIN top USING (image))"""


def page_channels(spark, sf) -> DataFrame:
    return features.channels(cells(spark, sf).select("image", "y", "x", "u"), "u", REACH, SMOOTH, SIGMA)


@query(f"WITH {CHANNELS_SQL} SELECT image, y, x, round(darkness, 6) AS darkness, round(contrast, 6) AS contrast, round(alpha, 6) AS alpha, round(gradient, 6) AS gradient FROM ch")
def feature_channels(spark, sf):
    return page_channels(spark, sf).select("image", "y", "x", r6("darkness").alias("darkness"), r6("contrast").alias("contrast"), r6("alpha").alias("alpha"), r6("gradient").alias("gradient"))


_EVIDENCE = " + ".join(f"{w!r}::DOUBLE * {c}" for c, w in features.EVIDENCE.items())


@query(f"""WITH {CHANNELS_SQL}, e AS (SELECT image, y, x, {_CLAMP.format(_EVIDENCE)} AS e FROM ch)
SELECT image, gy::INT AS gy, gx::INT AS gx, round(0.35::DOUBLE * avg(e) + 0.65::DOUBLE * max(e), 6) AS reliability FROM z JOIN range({GRID}) r(gy) ON true JOIN range({GRID}) s(gx) ON true JOIN e USING (image)
WHERE y >= gy * height // {GRID} AND y < ((gy + 1) * height + {GRID - 1}) // {GRID} AND x >= gx * width // {GRID} AND x < ((gx + 1) * width + {GRID - 1}) // {GRID} GROUP BY ALL""")
def reliability_evidence(spark, sf):
    t = page_channels(spark, sf).select("image", "y", "x", features.evidence().alias("e"))
    t = features.pooled(t, sizes(cells(spark, sf)), "e", GRID)
    return t.select("image", "gy", "gx", r6("pooled").alias("reliability"))


_SCALE = f"least({SIDE * 0.78!r}::DOUBLE / greatest(cw, 1), {SIDE * 0.78!r}::DOUBLE / greatest(ch, 1))"


def _source(at: str, place: str, length: str, n: str) -> str:
    return f"least(greatest(({at} - {place} + 0.5::DOUBLE) * {length} / {n} - 0.5::DOUBLE, 0), {length} - 1)"


@query(f"""WITH {DARK_SQL}, lim AS (SELECT image, greatest(0.035::DOUBLE, quantile_cont(darkness, 0.95) * {SHARE!r}::DOUBLE) AS lim FROM dark GROUP BY image),
b AS (SELECT image, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM dark JOIN lim USING (image) WHERE darkness > lim GROUP BY image),
p0 AS (SELECT image, width, height, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(x1, width) AS x1, coalesce(y1, height) AS y1 FROM z LEFT JOIN b USING (image)),
p1 AS (SELECT *, greatest(4, floor(greatest(x1 - x0, y1 - y0) * 0.1::DOUBLE)::INT) AS pad FROM p0),
p2 AS (SELECT image, greatest(0, x0 - pad) AS cx, greatest(0, y0 - pad) AS cy, least(width, x1 + pad) - greatest(0, x0 - pad) AS cw, least(height, y1 + pad) - greatest(0, y0 - pad) AS ch FROM p1),
p3 AS (SELECT *, greatest(4, floor(cw * {_SCALE})::INT) AS w, greatest(4, floor(ch * {_SCALE})::INT) AS h FROM p2),
p4 AS (SELECT *, ({SIDE} - w) // 2 AS l, ({SIDE} - h) // 2 AS t FROM p3),
k0 AS (SELECT p4.*, y, x, x BETWEEN l AND l + w - 1 AND y BETWEEN t AND t + h - 1 AS inside FROM p4, range({SIDE}) a(y), range({SIDE}) b(x)),
k1 AS (SELECT *, {_source("x", "l", "cw", "w")} AS sx, {_source("y", "t", "ch", "h")} AS sy FROM k0 WHERE inside),
k2 AS (SELECT image, y, x, cx + least(floor(sx)::INT + i, cw - 1) AS ux, cy + least(floor(sy)::INT + j, ch - 1) AS uy, CASE i WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END * CASE j WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS k FROM k1, range(2) a(i), range(2) b(j))
SELECT k2.image, k2.y::INT AS y, k2.x::INT AS x, round(sum(c.u * k), 6) AS value FROM k2 JOIN c ON c.image = k2.image AND c.y = uy AND c.x = ux GROUP BY ALL UNION ALL SELECT image, y::INT, x::INT, 1.0::DOUBLE FROM k0 WHERE NOT inside""")
def fitted_canvas(spark, sf):
    c = cells(spark, sf).select("image", "y", "x", "u")
    size = sizes(c)
    box = features.ink_bounds(raster.relative_depth(c, "u", REACH, SMOOTH), size, "depth", SHARE)
    return features.fitted(c, features.crop_plan(box, size, SIDE), "u", SIDE).select("image", "y", "x", r6("u").alias("value"))


def _uniform(name: str, low: float, high: float) -> str:
    return f"({low!r}::DOUBLE + {high - low!r}::DOUBLE * (('0x' || substr(sha256(image::VARCHAR || ':{name}'), 1, 8))::BIGINT / {2.0**32!r}::DOUBLE))"


_OFF = lambda at, n: f"(({at} - {n} * {_uniform(f'{n} centre', 0.20, 0.80)}) / ({n} * {_uniform(f'{n} sigma', 0.12, 0.30)})) ** 2"


@query(f"WITH {DARK_SQL}, k AS (SELECT image, y, x, u, darkness, 1 - {_uniform('strength', 0.25, 0.70)} * exp(-0.5::DOUBLE * ({_OFF('x', 'width')} + {_OFF('y', 'height')})) AS k FROM dark JOIN z USING (image)) SELECT image, y, x, round({_CLAMP.format('1 - (1 - u) * k')}, 6) AS grey, round({_CLAMP.format('darkness * k')}, 6) AS darkness FROM k")
def faded_views(spark, sf):
    c = cells(spark, sf).select("image", "y", "x", "u")
    t = features.faded(raster.relative_depth(c, "u", REACH, SMOOTH), sizes(c), "u", ["depth"])
    return t.select("image", "y", "x", r6("u").alias("grey"), r6("depth").alias("darkness"))


INK = 0.57  # components of several sizes, so that some are kept
_NEAR = "SELECT DISTINCT image, y + a AS y, x + b AS x FROM kept, range(-1, 2) i(a), range(-1, 2) j(b)"


@query(f"""WITH RECURSIVE {CELLS_SQL}, {_components(f"u >= {INK}")},
{SHAPES_SQL}, kd AS (SELECT image, m, {KIND_SQL} AS kind FROM g), mark AS (SELECT image, y, x, kind FROM k JOIN kd USING (image, m)), kept AS (SELECT image, y, x FROM mark WHERE kind = 'keep'), grown AS ({_NEAR}),
mask AS (SELECT c.image, c.y, c.x, (grown.x IS NOT NULL)::INT AS on_ FROM c LEFT JOIN grown USING (image, y, x)),
soft AS (SELECT image, y, x, sum(on_ * w) / sum(w) AS s FROM (SELECT o.image, o.y, o.x, n.on_, exp(-0.5::DOUBLE * ((o.y - n.y) ** 2 + (o.x - n.x) ** 2) / 0.5625::DOUBLE) AS w FROM mask o JOIN mask n ON n.image = o.image AND n.y BETWEEN o.y - 3 AND o.y + 3 AND n.x BETWEEN o.x - 3 AND o.x + 3) GROUP BY ALL)
SELECT c.image, c.y, c.x, coalesce(kind, '-') AS kind, round(CASE WHEN u * s >= 0.035::DOUBLE THEN least(1.0::DOUBLE, u * s) ELSE 0 END, 6) AS clean FROM c JOIN soft USING (image, y, x) LEFT JOIN mark USING (image, y, x)""")
def cleaned_strokes(spark, sf):
    c = cells(spark, sf).select("image", "y", "x", "u")
    t = features.cleaned_alpha(c, sizes(c), "u", "u", INK, LIMITS)
    return t.select("image", "y", "x", F.coalesce("kind", F.lit("-")).alias("kind"), r6("clean").alias("clean"))


TOKENS, PARTS = 4, 3  # tokens a vector; a class is one of PARTS base parts and one of several modifiers


def tokens(vector, n: int):
    """The vector cut into n tokens of equal length."""
    width = F.floor(F.size(vector) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(vector, i * width + 1, width))


def memory(t: DataFrame, part: str) -> DataFrame:
    """(part, memory): the mean of each token over the vectors of a part; sums are partial, place by place."""
    long = t.select(part, F.posexplode("v").alias("place", "value"))
    return long.groupBy(part, "place").agg(F.avg("value").alias("m")).groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda s: s["m"]).alias(f"{part}_memory"))


def _mean(part: str) -> str:
    return f"{part}m AS (SELECT {part}, place, avg(value) AS m FROM l GROUP BY ALL)"


@query(f"""WITH {E_SQL}, l AS (SELECT vec_id, label % {PARTS} AS base, label // {PARTS} AS modifier, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS place FROM e),
w AS (SELECT len(any_value(v)) // {TOKENS} AS w FROM e), {_mean("base")}, {_mean("modifier")},
cls AS (SELECT DISTINCT label, label % {PARTS} AS base, label // {PARTS} AS modifier FROM embeddings),
pm AS (SELECT label, place // w AS j, place % w AS i, b.m + o.m AS p, b.m AS bm, o.m AS om FROM cls JOIN basem b USING (base) JOIN modifierm o USING (modifier, place), w WHERE place < w * {TOKENS}),
pn AS (SELECT label, j, sqrt(sum(p * p)) AS n, 1 / (1 + exp(-(sqrt(sum(bm * bm)) + sqrt(sum(om * om))))) AS there FROM pm GROUP BY ALL),
pr AS (SELECT label, j, i, p / greatest(n, 1e-12::DOUBLE) AS p, there FROM pm JOIN pn USING (label, j)),
tk AS (SELECT e.vec_id, label, place // w AS k, place % w AS i, value AS t FROM l JOIN e USING (vec_id), w WHERE place < w * {TOKENS}),
rl AS (SELECT vec_id, k, least(1.0::DOUBLE, 2 * sqrt(sum(t * t))) * 0.5::DOUBLE AS r FROM tk GROUP BY ALL),
att AS (SELECT vec_id, k, j, exp(sum(t * p) / sqrt(any_value(w))) AS a, any_value(there) AS there FROM tk JOIN pr USING (label, i), w GROUP BY ALL),
an AS (SELECT vec_id, k, j, a / sum(a) OVER (PARTITION BY vec_id, k) AS a, there FROM att),
pz AS (SELECT vec_id, k, sum(a * there) AS pz FROM an GROUP BY ALL),
mx AS (SELECT tk.vec_id, tk.k, tk.i, any_value((1 - (1 - r) * pz) * t + 0) + any_value((1 - r) * pz) * sum(a * p) AS x FROM tk JOIN rl USING (vec_id, k) JOIN pz USING (vec_id, k) JOIN an USING (vec_id, k) JOIN pr ON pr.label = tk.label AND pr.j = an.j AND pr.i = tk.i GROUP BY ALL)
SELECT vec_id, k::INT AS token, round((1 - r) * pz, 6) AS gate, round(r + (1 - r) * pz, 6) AS reliability, round(sum(x * (i + 1)) / sqrt(sum(x * x)), 6) AS moment FROM mx JOIN rl USING (vec_id, k) JOIN pz USING (vec_id, k) GROUP BY vec_id, k, r, pz""")
def completed_tokens(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % PARTS).alias("base"), F.expr(f"label div {PARTS}").alias("modifier"), V.doubles("embedding").alias("v"))
    classes = e.select("base", "modifier").distinct().join(memory(e, "base"), "base").join(memory(e, "modifier"), "modifier")
    pair = F.arrays_zip(tokens(F.col("base_memory"), TOKENS).alias("b"), tokens(F.col("modifier_memory"), TOKENS).alias("m"))
    both = lambda s: F.zip_with(s["b"], s["m"], lambda x, y: x + y)
    unit = lambda v: features.bound(F.greatest(V.norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))
    prior = classes.select("base", "modifier", F.transform(pair, lambda s: features.bound(both(s), unit)).alias("prior"), F.transform(pair, lambda s: V.sigmoid(V.norm(s["b"]) + V.norm(s["m"]))).alias("presence"))
    t = e.join(prior, ["base", "modifier"]).select("vec_id", tokens(F.col("v"), TOKENS).alias("_t"), "prior", "presence")
    t = t.select("vec_id", F.posexplode("_t").alias("token", "t"), "prior", "presence")
    own = F.least(F.lit(1.0), 2 * V.norm(F.col("t"))) * 0.5
    t = t.select("vec_id", "token", features.completed(F.col("t"), own, F.col("prior"), F.col("presence")).alias("c"))
    places = F.transform(F.sequence(F.lit(1), F.size("c.token")), lambda i: i.cast("double"))
    return t.select("vec_id", "token", r6("c.gate").alias("gate"), r6("c.reliability").alias("reliability"), F.round(V.dot(F.col("c.token"), places), 6).alias("moment"))


@query(f"{P_SQL}, n AS (SELECT truth, pred, count(*) AS n FROM p WHERE truth <> pred GROUP BY ALL), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, truth, pred) AS pair FROM n QUALIFY pair <= 20), s AS (SELECT pair, t.truth, t.pred, n, vec_id, row_number() OVER (PARTITION BY pair ORDER BY vec_id) AS s FROM p JOIN t ON p.truth = t.truth AND p.pred = t.pred) SELECT pair::INT AS pair, printf('P%02d-S%02d', pair, s) AS tile, truth, pred, n, vec_id, ((s - 1) % 4)::INT AS \"column\", ((s - 1) // 4)::INT AS \"row\" FROM s WHERE s <= 12")
def confusion_sheet_index(spark, sf):
    return metrics.confusion_sheets(pred(spark, sf), "vec_id").select("pair", "tile", "truth", "pred", "n", "vec_id", "column", "row")


_PATHS = "CASE doc_id % 6 WHEN 0 THEN 'Set\\Col_' || doc_id % 7 || '_P' || doc_id % 11 || '_aug3.PNG' WHEN 1 THEN 'set/diff_' || lower(source) || '_p3.v2.png' WHEN 2 THEN 'set/word_' || doc_id % 50 || '_seed12_aug_4_0012.png' WHEN 3 THEN 'glyph_xp' || doc_id % 13 || '.png' WHEN 4 THEN '.hidden_' || doc_id % 5 ELSE 'Plain_' || doc_id % 9 || '_' || lpad({0}, 6, '0') || '.tif' END"
_FAMILY, _TAIL = r"(col_\d+_p\d+|diff_[^_]*_p\d+|p\d+)", r"(_seed_?\d+|_aug_?\d+|_\d{3,})+$"


@query(rf"WITH s AS (SELECT doc_id, coalesce(lang, '') AS label, lower(regexp_replace(regexp_extract({_PATHS.format('doc_id::VARCHAR')}, '[^/\\]*$'), '(.)\.[^.]+$', '\1')) AS stem FROM documents) SELECT label || '::' || CASE WHEN regexp_extract(stem, '{_FAMILY}', 1) <> '' THEN regexp_extract(stem, '{_FAMILY}', 1) ELSE regexp_replace(stem, '{_TAIL}', '') END AS source_key, count(*) AS n, min(doc_id) AS first FROM s GROUP BY 1")
def legacy_source_keys(spark, sf):
    path = F.expr(_PATHS.format("cast(doc_id AS string)").replace("\\", "\\\\"))
    t = table(spark, sf, "documents").select("doc_id", T.legacy_source_key(F.coalesce("lang", F.lit("")), path).alias("source_key"))
    return t.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("""WITH r AS (SELECT coalesce(source, '') AS run, count(*) AS n, count(text) AS texts, count(DISTINCT lang) AS langs, max(doc_id) AS last FROM documents GROUP BY 1), a AS (SELECT max(langs) AS langs FROM r),
f AS (SELECT run, 'seed' AS field, CASE WHEN last % 3 = 0 AND last % 4 = 0 THEN 'missing' WHEN (last % 3 = 0 OR last % 5 <> 0) THEN 'match' ELSE 'mismatch' END AS status FROM r
UNION ALL SELECT run, 'dataset', CASE WHEN texts = n THEN 'match' ELSE 'mismatch' END FROM r
UNION ALL SELECT run, 'classes', CASE WHEN r.langs = a.langs THEN 'match' ELSE 'mismatch' END FROM r, a
UNION ALL SELECT run, 'declared', CASE WHEN last % 2 = 0 THEN 'absent' WHEN r.langs = a.langs THEN 'match' ELSE 'mismatch' END FROM r, a) SELECT * FROM f""")
def run_records(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("")).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.count_distinct("lang").alias("langs"), F.max("doc_id").alias("last"))
    last, digest = F.col("last"), lambda c: F.sha2(F.col(c).cast("string"), 256)
    runs = d.select("run", F.when(last % 3 != 0, F.when(last % 5 == 0, 17).otherwise(42)).alias("stored_seed"), F.when(last % 4 != 0, 42).alias("args_seed"), digest("texts").alias("stored_dataset"), F.lit(None).cast("string").alias("top_dataset"), digest("langs").alias("map_hash"), F.when(last % 2 != 0, digest("langs")).alias("declared_hash"))
    most = d.agg(F.max("langs").alias("langs"))
    expected = d.select("run", "n").crossJoin(F.broadcast(most)).select("run", F.lit(42).alias("seed"), digest("n").alias("dataset"), digest("langs").alias("classes"), digest("langs").alias("declared"))  # one row joined
    return governance.recorded(runs, expected, "run", {"seed": ["stored_seed", "args_seed"], "dataset": ["stored_dataset", "top_dataset"], "classes": ["map_hash"], "declared": ["declared_hash"]}, optional=("declared",))


@query("""WITH s AS (SELECT o_orderpriority AS p, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, median(o_totalprice) AS md FROM orders GROUP BY 1), b AS (SELECT row_number() OVER (ORDER BY m DESC, p) + 4 AS line, '| ' || p || ' | ' || format('{:,}', n) || ' | ' || printf('%.4f +/- %.4f', m, sd) || ' | ' || printf('%.4f', md) || ' |' AS text FROM s)
SELECT * FROM b UNION ALL SELECT * FROM (VALUES (1, '# Orders by priority'), (2, ''), (3, '| priority | rows | mean +/- sd | median |'), (4, '| --- | --- | --- | --- |'))""")
def comparison_report(spark, sf):
    t = metrics.describe(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    columns = {"priority": F.col("o_orderpriority"), "rows": metrics.thousands("n"), "mean +/- sd": metrics.spread("mean", "sd"), "median": F.format_string("%.4f", F.col("median"))}
    return metrics.markdown(t, "Orders by priority", columns, [F.desc("mean"), "o_orderpriority"])


GRID_SQL = "g AS (SELECT row_number() OVER (ORDER BY a, b) AS ord, a AS max_shots, b::DOUBLE AS min_margin FROM unnest([40, 48, 56, 64]) x(a), unnest([0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]) y(b))"


@query(f"""{ROUTE_SQL}, {GRID_SQL}, o AS (SELECT ord, max_shots, min_margin, avg((truth = CASE WHEN shots <= max_shots AND margin >= min_margin THEN ta ELSE da END)::INT) AS acc FROM z, g WHERE vec_id % 2 = 0 GROUP BY ALL),
best AS (SELECT * FROM o ORDER BY round(acc, 9) DESC, ord LIMIT 1), t AS (SELECT truth, ta, da, shots <= max_shots AND margin >= min_margin AS use, max_shots, min_margin, acc FROM z, best WHERE vec_id % 2 = 1)
SELECT truth, any_value(max_shots) AS max_shots, any_value(min_margin) AS min_margin, round(any_value(acc), 6) AS validation_accuracy, count(*) AS n, count(*) FILTER (truth = ta) AS transport_right, count(*) FILTER (truth = da) AS direct_right, count(*) FILTER (truth = CASE WHEN use THEN ta ELSE da END) AS routed_right, count(*) FILTER (use) AS routed FROM t GROUP BY truth""")
def evaluated_router(spark, sf):
    t = routed(spark, sf)
    chosen = similarity.best_router(t.filter("vec_id % 2 = 0"), [(a, b) for a in (40, 48, 56, 64) for b in (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)])
    out = similarity.evaluated(t.filter("vec_id % 2 = 1"), chosen)
    return out.withColumn("validation_accuracy", r6("validation_accuracy"))
