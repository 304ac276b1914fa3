"""Queries of manifests, splits, samplers, verification and grouped metrics, over analogues of the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import audit, governance, graph, manifest, metrics, ordered, similarity, split
from quern.plans.registry import B_SQL, C_SQL, E_SQL, P_SQL, R_SQL, S_SQL, SPLIT, codes, pred, query, r6, table
from quern.sources import manifests, publish

# Documents as a collection of files: the last of each four is a derivative of one of the three before it. Expressions of both engines.
IDS = {
    "estampage_id": "''", "inscription_id": "CASE WHEN doc_id % 3 = 0 THEN 'INS_' || source ELSE '' END", "page_id": "CASE WHEN doc_id % 3 = 1 THEN 'PAGE_' || lang || '_' || (n_chars % 40) ELSE '' END",
    "word_id": "CASE WHEN doc_id % 5 = 0 THEN 'WORD_' || (n_chars % 200) ELSE '' END", "original_crop_id": "'CROP_' || doc_id",
}
CLASS = "'C' || ((doc_id - doc_id % 4) % 28)"
PARENT = "(doc_id - 1 - (doc_id - 3) % 3)"
GROUP = "CASE WHEN inscription_id <> '' THEN 'INSCRIPTION::' || inscription_id WHEN page_id <> '' THEN 'PAGE::' || page_id WHEN word_id <> '' THEN 'WORD::' || word_id ELSE 'CROP::' || original_crop_id END"
C4_SQL = f"""o AS (SELECT doc_id, {CLASS} AS class_label, sha256(text) AS sha, {", ".join(f"coalesce({e}, '') AS {c}" for c, e in IDS.items())} FROM documents WHERE doc_id % 4 <> 3),
m AS (SELECT *, false AS is_augmented, '' AS parent FROM o UNION ALL SELECT d.doc_id, o.class_label, sha256(d.text), o.* EXCLUDE (doc_id, class_label, sha), true, o.original_crop_id FROM documents d JOIN o ON o.doc_id = {PARENT.replace("doc_id", "d.doc_id")} WHERE d.doc_id % 4 = 3), x AS (SELECT *, {GROUP} AS grp FROM m)"""
G_SQL = """gq AS (SELECT grp, class_label AS cls, count(*) AS n FROM x WHERE NOT is_augmented GROUP BY ALL), z AS (SELECT grp, sum(n)::BIGINT AS n, md5(grp) AS h FROM gq GROUP BY grp),
an AS (SELECT DISTINCT grp FROM (SELECT grp, row_number() OVER (PARTITION BY cls ORDER BY n DESC, grp) AS r FROM gq) WHERE r = 1),
t AS (SELECT greatest(1, round_even(0.15 * sum(n), 0))::BIGINT AS target FROM z),
q AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z ANTI JOIN an USING (grp)),
s3 AS (SELECT grp, CASE WHEN before < target THEN 'test' WHEN before < 2 * target THEN 'validation' ELSE 'train' END AS split FROM q, t UNION ALL SELECT grp, 'train' FROM an)"""


def canonical(spark, sf) -> DataFrame:
    code = codes(spark, sf).select(F.col("id").alias("doc_id"), F.col("code").alias("perceptual_hash"))
    name = lambda i: F.concat(F.lit("d"), F.expr(i).cast("string"), F.lit(".png"))
    files = table(spark, sf, "documents").join(code, "doc_id").select("doc_id", F.expr(CLASS).alias("class_label"), name("doc_id").alias("name"), F.sha2("text", 256).alias("file_sha256"), "perceptual_hash", *[F.expr(e).alias(c) for c, e in IDS.items()])
    files = graph.materialise(files, "files")
    derived = files.filter("doc_id % 4 = 3").drop(*IDS)
    made = derived.select("class_label", F.concat(F.lit("out\\x/"), "name").alias("output_path"), F.concat(F.lit("in/"), name(PARENT)).alias("source_path"), "doc_id")
    return manifest.canonical(files.filter("doc_id % 4 <> 3"), derived, manifest.provenance(made, "class_label", "output_path", "source_path", "doc_id"))


def by_group(m: DataFrame, group: str = "source_group") -> DataFrame:
    return m.filter(~F.col("is_augmented")).groupBy(F.col(group).alias("grp"), F.col("class_label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query(r"WITH r AS (SELECT page_id, page_id % 97 AS no, upper(regexp_extract(url, '://(?:m\.)?([a-z]+)', 1)) || ', ' || upper(regexp_extract(url, '/([a-z]{2})/', 1)) || ', l. ' || page_id AS ref FROM pages), k AS (SELECT 'WORD_' || lpad(no::VARCHAR, 4, '0') AS word_id, arg_max(ref, page_id) AS reference FROM r GROUP BY no), p AS (SELECT *, split_part(reference, ',', 1) AS n, trim(split_part(reference, ',', 2)) AS pg FROM k) SELECT word_id, reference, CASE WHEN starts_with(n, 'TH') THEN 'TH' ELSE '' END AS inscription_id, CASE WHEN starts_with(n, 'TH') AND pg <> '' THEN 'TH_' || pg ELSE '' END AS page_id FROM (SELECT word_id, reference, CASE WHEN starts_with(n, 'TH') AND substr(n, 3, 1) = '' THEN n ELSE '' END AS n, pg FROM p)")
def word_metadata_scan(spark, sf):
    host, lang = F.upper(F.regexp_extract("url", r"://(?:m\.)?([a-z]+)", 1)), F.upper(F.regexp_extract("url", r"/([a-z]{2})/", 1))
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 97).alias("no"), F.concat(host, F.lit(", "), lang, F.lit(", l. "), F.col("page_id").cast("string")).alias("ref"))
    return manifest.word_metadata(p, "no", "ref", "page_id", ["TH"])


@query(f"WITH {C4_SQL} SELECT doc_id, class_label, grp AS source_group, is_augmented, parent AS augmentation_parent_id, sha AS file_sha256 FROM x")
def canonical_manifest(spark, sf):
    return canonical(spark, sf).select("doc_id", "class_label", "source_group", "is_augmented", "augmentation_parent_id", "file_sha256")


@query(f"WITH {C4_SQL}, {G_SQL} SELECT grp, split FROM s3")
def group_safe_split(spark, sf):
    return split.group_split(by_group(canonical(spark, sf)))


@query(f"WITH {C4_SQL}, {G_SQL}, rows AS (SELECT x.*, split FROM x JOIN s3 USING (grp) WHERE NOT is_augmented), w AS (SELECT class_label FROM x WHERE NOT is_augmented GROUP BY class_label) SELECT 'crossing_groups' AS check, (SELECT count(*) FROM (SELECT grp FROM rows GROUP BY grp HAVING count(DISTINCT split) > 1)) AS bad UNION ALL SELECT 'classes_without_train', (SELECT count(*) FROM w ANTI JOIN (SELECT class_label FROM rows WHERE split = 'train') USING (class_label)) UNION ALL SELECT 'rows_without_split', (SELECT count(*) FROM x WHERE NOT is_augmented) - (SELECT count(*) FROM rows) UNION ALL SELECT 'share_of_test_under_15_percent', (SELECT (count(*) FILTER (split = 'test') < (SELECT target FROM t))::BIGINT FROM rows) UNION ALL SELECT 'share_of_validation_under_15_percent', (SELECT (count(*) FILTER (split = 'validation') < (SELECT target FROM t) - (SELECT max(n) FROM z))::BIGINT FROM rows)")
def group_safe_split_invariants(spark, sf):
    m = graph.materialise(canonical(spark, sf).filter(~F.col("is_augmented")), "originals")
    g = by_group(m)
    rows = graph.materialise(m.join(split.group_split(g).withColumnRenamed("grp", "source_group"), "source_group", "left"), "rows")
    target, most = F.greatest(F.lit(1), F.bround(0.15 * F.count(F.lit(1)))), g.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"))
    one = lambda name, t: t.select(F.lit(name).alias("check"), F.col("bad").cast("long").alias("bad"))
    crossing = rows.groupBy("source_group").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("bad"))
    absent = rows.groupBy("class_label").agg(F.count_if(F.col("split") == "train").alias("k")).agg(F.count_if(F.col("k") == 0).alias("bad"))
    shares = rows.agg((F.count_if(F.col("split") == "test") < target).alias("test"), F.count_if(F.col("split") == "validation").alias("v"), target.alias("t"), F.count_if(F.col("split").isNull()).alias("none")).crossJoin(F.broadcast(most))
    out = one("crossing_groups", crossing).union(one("classes_without_train", absent)).union(one("rows_without_split", shares.withColumn("bad", F.col("none"))))
    return out.union(one("share_of_test_under_15_percent", shares.withColumn("bad", F.col("test")))).union(one("share_of_validation_under_15_percent", shares.withColumn("bad", F.col("v") < F.col("t") - F.col("most"))))


D2_SQL = f"WITH {S_SQL}, {C4_SQL}, {G_SQL}, y AS (SELECT x.*, s.code, s3.split AS own FROM x JOIN s3 USING (grp) JOIN s USING (doc_id)), f AS (SELECT *, CASE WHEN NOT is_augmented THEN own WHEN own <> 'train' THEN 'excluded_parent_not_train' WHEN EXISTS (SELECT 1 FROM y h WHERE NOT h.is_augmented AND h.own <> 'train' AND (h.sha = y.sha OR hamming(h.code, y.code) <= 2)) THEN 'excluded_perceptual_collision' ELSE 'train' END AS split FROM y)"


def with_splits(spark, sf, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """The manifest with splits, of source groups or of their components, and the near pairs of its codes."""
    m = graph.materialise(canonical(spark, sf), "canonical")
    pairs = manifest.code_pairs(m, 2)
    if not merge:
        return manifest.apply_splits(m, split.group_split(by_group(m)), 2, pairs=pairs), pairs
    merged = graph.materialise(manifest.merged_groups(m.filter(~F.col("is_augmented")), 2, pairs), "merged")
    sizes = by_group(m.join(merged, "source_group"), "split_group_id")
    return manifest.apply_splits(m, split.group_split(sizes), 2, merged, pairs), pairs


@query(f"{D2_SQL} SELECT doc_id, grp AS split_group_id, split FROM f")
def applied_splits(spark, sf):
    return with_splits(spark, sf)[0].select("doc_id", "split_group_id", "split")


L_FIELDS = {"file_hashes": "sha", "augmentation_parents": "parent", "original_crop_ids": "original_crop_id", "word_ids": "word_id", "page_ids": "page_id", "inscription_ids": "inscription_id", "split_group_ids": "grp"}
L_SQL = " UNION ALL ".join(f"SELECT '{rule}' AS rule, (SELECT count(*) FROM (SELECT {c} FROM f WHERE split IN ('train', 'validation', 'test') AND {c} <> '' GROUP BY {c} HAVING count(DISTINCT split) > 1)) AS violations" for rule, c in L_FIELDS.items())


@query(f"{D2_SQL} SELECT *, violations = 0 AS ok FROM ({L_SQL} UNION ALL SELECT 'estampage_ids', 0 UNION ALL SELECT 'perceptual_hashes', (SELECT count(*) FROM f a JOIN f b ON a.doc_id < b.doc_id AND a.split <> b.split AND a.split IN ('train', 'validation', 'test') AND b.split IN ('train', 'validation', 'test') AND hamming(a.code, b.code) <= 2))")
def leakage_audit_rules(spark, sf):
    m, pairs = with_splits(spark, sf)
    return manifest.leakage(graph.materialise(m, "split"), 2, pairs)


# Source groups that share a file or near codes are merged before the split, so nothing leaks between its parts.
MERGE_SQL = f"""WITH RECURSIVE {S_SQL}, {C4_SQL}, xo AS (SELECT x.grp, x.sha, s.code FROM x JOIN s USING (doc_id) WHERE NOT is_augmented),
ge AS (SELECT DISTINCT a.grp AS a, b.grp AS b FROM xo a JOIN xo b ON a.grp <> b.grp AND (a.sha = b.sha OR hamming(a.code, b.code) <= 2)),
gr AS (SELECT DISTINCT grp AS g, grp AS m FROM xo UNION SELECT gr.g, ge.b FROM gr JOIN ge ON ge.a = gr.m),
gm AS (SELECT g AS source_group, 'SOURCE_COMPONENT::' || substr(sha256(string_agg(m, chr(10) ORDER BY m)), 1, 16) AS comp FROM gr GROUP BY g),
xm AS (SELECT x.* EXCLUDE (grp), comp AS grp FROM x JOIN gm ON gm.source_group = x.grp)"""
D2M_SQL = f"{MERGE_SQL}, {G_SQL.replace('FROM x ', 'FROM xm ')}, {D2_SQL[D2_SQL.index('y AS (') :].replace('x.*', 'xm.*').replace('FROM x ', 'FROM xm ')}"


@query(f"{MERGE_SQL} SELECT source_group, comp AS split_group_id FROM gm")
def merged_source_groups(spark, sf):
    return manifest.merged_groups(graph.materialise(canonical(spark, sf).filter(~F.col("is_augmented")), "originals"), 2)


@query(f"{D2M_SQL} SELECT doc_id, grp AS split_group_id, split FROM f")
def merged_group_splits(spark, sf):
    return with_splits(spark, sf, True)[0].select("doc_id", "split_group_id", "split")


@query(f"{D2M_SQL} SELECT *, violations = 0 AS ok FROM ({L_SQL} UNION ALL SELECT 'estampage_ids', 0 UNION ALL SELECT 'perceptual_hashes', (SELECT count(*) FROM f a JOIN f b ON a.doc_id < b.doc_id AND a.split <> b.split AND a.split IN ('train', 'validation', 'test') AND b.split IN ('train', 'validation', 'test') AND hamming(a.code, b.code) <= 2))")
def merged_split_audit(spark, sf):
    m, pairs = with_splits(spark, sf, True)
    return manifest.leakage(graph.materialise(m, "split"), 2, pairs)


@query(f"WITH {S_SQL}, {C4_SQL}, f AS (SELECT x.* EXCLUDE (estampage_id), 'EST_' || d.lang || '_' || (d.n_chars % 9) AS estampage_id, s.code, {SPLIT.replace('doc_id', 'x.doc_id')} AS split FROM x JOIN s USING (doc_id) JOIN documents d USING (doc_id)) SELECT *, violations = 0 AS ok FROM ({L_SQL} UNION ALL {L_SQL.split(' UNION ALL ')[0].replace('file_hashes', 'estampage_ids').replace('sha ', 'estampage_id ')} UNION ALL SELECT 'perceptual_hashes', (SELECT count(*) FROM f a JOIN f b ON a.doc_id < b.doc_id AND a.split <> b.split AND hamming(a.code, b.code) <= 2))")
def ungrouped_split_audit(spark, sf):
    m = canonical(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.expr("'EST_' || lang || '_' || (n_chars % 9)").alias("_estampage")), "doc_id")
    m = m.withColumns({"estampage_id": F.col("_estampage"), "split": F.expr(SPLIT), "split_group_id": F.col("source_group")}).drop("_estampage")
    return manifest.leakage(graph.materialise(m, "split"), 2)


@query(f"WITH {S_SQL}, p AS (SELECT s.*, {SPLIT} AS split FROM s) SELECT least(a.split, b.split) AS split_a, greatest(a.split, b.split) AS split_b, hamming(a.code, b.code)::INT AS distance, count(*) AS pairs FROM p a JOIN p b ON a.doc_id < b.doc_id AND a.split <> b.split AND hamming(a.code, b.code) <= 3 GROUP BY ALL")
def cross_split_near_pairs(spark, sf):
    m = codes(spark, sf).select(F.col("code").alias("perceptual_hash"), F.expr(SPLIT.replace("doc_id", "id")).alias("split"))
    p = manifest.cross_split_pairs(m, 3)
    return p.groupBy(F.least("first_split", "second_split").alias("split_a"), F.greatest("first_split", "second_split").alias("split_b"), "distance").agg(F.sum("pairs").alias("pairs"))


@query("WITH k AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5(lang || ':' || source), source) AS k, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, source FROM documents)), c AS (SELECT *, CASE WHEN n < 3 THEN greatest(1, n - 1) ELSE least(greatest(1, round_even(n * 0.7::DOUBLE, 0)), n - 2) END AS tr FROM k), v AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE least(greatest(1, round_even(n * 0.15::DOUBLE, 0)), n - tr - 1) END AS va FROM c) SELECT lang, source, CASE WHEN k <= tr THEN 'train' WHEN k <= tr + va THEN 'validation' ELSE 'test' END AS split FROM v")
def legacy_grouped_split(spark, sf):
    return split.legacy_split(table(spark, sf, "documents"), "lang", "source")


@query("SELECT page_id, row_number() OVER (ORDER BY md5(page_id::VARCHAR), page_id) <= floor(count(*) OVER () * 0.1::DOUBLE) AS held FROM pages")
def shuffled_path_split(spark, sf):
    return split.cut(table(spark, sf, "pages").select("page_id"), "page_id")


@query("WITH r AS (SELECT label, vec_id, vec_id // 3 AS parent FROM embeddings), d AS (SELECT * FROM (SELECT label, e, row_number() OVER (PARTITION BY e ORDER BY md5('2026:' || e || ':' || label), label) AS k FROM (SELECT DISTINCT label FROM r), range(1, 6) t(e)) WHERE k <= 3), o AS (SELECT e, r.* FROM d JOIN r USING (label)), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e, label, parent ORDER BY md5('2026:' || e || ':' || vec_id), vec_id) AS k FROM o) WHERE k = 1), f AS (SELECT * FROM (SELECT e, label, vec_id, row_number() OVER (PARTITION BY e, label ORDER BY md5('2026:' || e || ':' || parent), parent) AS k FROM one) WHERE k <= 5) SELECT e AS episode, label, vec_id, CASE WHEN k <= 3 THEN 'support' ELSE 'query' END AS role FROM f")
def episode_sampler(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.floor(F.col("vec_id") / 3).alias("parent"))
    return split.episodes(e, "label", "vec_id", "parent", 5, 3, 3, 2)


@query("SELECT p.page_id, c.n AS rows_of_place FROM pages p JOIN (SELECT lower(regexp_replace(url, '[?#].*$', '')) AS place, count(*) AS n FROM pages GROUP BY 1) c ON c.place = lower(regexp_replace(p.url, '[?#].*$', ''))")
def path_back_join(spark, sf):
    place = lambda: F.lower(F.regexp_replace("url", "[?#].*$", ""))
    p = table(spark, sf, "pages")
    known = p.groupBy(place().alias("place")).agg(F.count(F.lit(1)).alias("n"))
    found = p.select("page_id", place().alias("place")).join(known, "place", "left")
    return found.select("page_id", F.coalesce("n", F.raise_error(F.concat(F.lit("no row for "), "place")).cast("long")).alias("rows_of_place"))


# Metrics by group and bin.
FULL = "n, classes, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_precision, 6) AS macro_precision, round(macro_f1, 6) AS macro_f1, round(weighted_precision, 6) AS weighted_precision, round(weighted_f1, 6) AS weighted_f1, round(top3, 6) AS top3, round(top5, 6) AS top5"
FULL_SQL = """u2 AS (SELECT b, truth AS cls, (truth = pred)::INT AS tp, 0 AS fp, (truth <> pred)::INT AS fn FROM pz UNION ALL SELECT b, pred, 0, (truth <> pred)::INT, 0 FROM pz),
k2 AS (SELECT b, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp) + sum(fn) AS sup FROM u2 GROUP BY b, cls HAVING sum(tp) + sum(fn) > 0),
j2 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, tp / sup AS rec, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k2),
h2 AS (SELECT b, avg(list_contains(top[1:3], truth)::INT) AS top3, avg(list_contains(top[1:5], truth)::INT) AS top5 FROM pz GROUP BY b),
full2 AS (SELECT b, sum(sup)::BIGINT AS n, count(*) AS classes, sum(tp) / sum(sup) AS accuracy, avg(rec) AS balanced_accuracy, avg(prec) AS macro_precision, avg(f1) AS macro_f1, sum(prec * sup) / sum(sup) AS weighted_precision, sum(f1 * sup) / sum(sup) AS weighted_f1, any_value(top3) AS top3, any_value(top5) AS top5 FROM j2 JOIN h2 USING (b) GROUP BY b)"""
W_SQL = f"{P_SQL}, w AS (SELECT vec_id, list(cls ORDER BY rk) AS top FROM r WHERE rk <= 5 GROUP BY vec_id)"
SHOTS = "(SELECT label, count(*) % 12 AS shots FROM embeddings GROUP BY label)"
BINS = ["zero_shot", "one_shot", "2_4", "5_9", "10_plus"]


def rounded(t: DataFrame, key: str) -> DataFrame:
    return t.select(key, "n", "classes", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_precision", "macro_f1", "weighted_precision", "weighted_f1", "top3", "top5")])


def shots_of(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("truth")).agg((F.count(F.lit(1)) % 12).alias("shots"))


@query(f"{W_SQL}, pz AS (SELECT p.truth, p.pred, w.top, CASE WHEN vec_id % 4 = 0 THEN 'UNRESOLVED' ELSE 'g' || vec_id % 3 END AS b FROM p JOIN w USING (vec_id)), {FULL_SQL} SELECT b AS grp, {FULL} FROM full2")
def grouped_prediction_metrics(spark, sf):
    p = pred(spark, sf).withColumn("grp", F.when(F.col("vec_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("g"), (F.col("vec_id") % 3).cast("string"))))
    return rounded(metrics.full(p.withColumn("grp", F.coalesce(F.nullif("grp", F.lit("")), F.lit("UNRESOLVED"))), ["grp"]), "grp")


@query(f"{W_SQL}, s2 AS {SHOTS}, pz AS (SELECT p.truth, p.pred, w.top, CASE WHEN shots = 0 THEN 'zero_shot' WHEN shots = 1 THEN 'one_shot' WHEN shots <= 4 THEN '2_4' WHEN shots <= 9 THEN '5_9' ELSE '10_plus' END AS b FROM p JOIN w USING (vec_id) JOIN s2 ON s2.label = p.truth), {FULL_SQL} SELECT bins.b AS bin, coalesce(n, 0) AS n, coalesce(classes, 0) AS classes, coalesce(round(accuracy, 6), 0) AS accuracy, coalesce(round(macro_f1, 6), 0) AS macro_f1 FROM (SELECT unnest({BINS}) AS b) bins LEFT JOIN full2 USING (b)")
def shot_bin_metrics(spark, sf):
    p = pred(spark, sf).join(shots_of(spark, sf), "truth").withColumn("bin", T.frequency_bin_evaluation(F.col("shots")))
    t = metrics.by_bin(p, "bin", BINS)
    return t.select("bin", "n", "classes", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query(f"{W_SQL}, s2 AS {SHOTS} SELECT p.vec_id, p.truth, p.pred, p.truth = p.pred AS correct, array_to_string(top, '|') AS top5, list_contains(top[1:3], truth) AS in_top3, shots, CASE WHEN shots = 0 THEN 'zero_shot' WHEN shots = 1 THEN 'one_shot' WHEN shots <= 4 THEN '2_4' WHEN shots <= 9 THEN '5_9' ELSE '10_plus' END AS bin, 2026 AS seed FROM p JOIN w USING (vec_id) JOIN s2 ON s2.label = p.truth")
def prediction_package(spark, sf):
    return metrics.package(pred(spark, sf), shots_of(spark, sf)).select("vec_id", "truth", "pred", "correct", F.array_join(F.transform("top", lambda x: x.cast("string")), "|").alias("top5"), "in_top3", "shots", "bin", F.lit(2026).alias("seed"))


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT q.vec_id, e.label AS cls, round(min(pow(list_distance(q.v, e.v), 2)), 6) AS dist2 FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q, e GROUP BY q.vec_id, e.label")
def exemplar_min_per_class(spark, sf):
    e = table(spark, sf, "embeddings")
    t = similarity.exemplar_min(e.filter("vec_id % 50 = 0"), e, "vec_id", "label", "embedding")
    return t.select("vec_id", "cls", r6("dist2").alias("dist2"))


@query(f"WITH {E_SQL}, {C_SQL}, n8 AS (SELECT unnest(range(8)) AS t), qt AS (SELECT vec_id, t, v[t * 8 + 1:t * 8 + 8] AS x, sqrt(list_dot_product(v[t * 8 + 1:t * 8 + 8], v[t * 8 + 1:t * 8 + 8])) AS w FROM e, n8), pt AS (SELECT cls, t AS s, p[t * 8 + 1:t * 8 + 8] AS y, sqrt(list_dot_product(p[t * 8 + 1:t * 8 + 8], p[t * 8 + 1:t * 8 + 8])) AS u FROM c, n8), sim AS (SELECT vec_id, cls, t, s, w, u, list_dot_product(x, y) AS d FROM qt, pt), q1 AS (SELECT vec_id, cls, t, any_value(w) AS w, 0.08 * ln(sum(exp(d / 0.08))) AS m FROM sim GROUP BY vec_id, cls, t), p1 AS (SELECT vec_id, cls, s, any_value(u) AS u, 0.08 * ln(sum(exp(d / 0.08))) AS m FROM sim GROUP BY vec_id, cls, s), a AS (SELECT vec_id, cls, sum(m * w) / sum(w) AS m FROM q1 GROUP BY vec_id, cls), b AS (SELECT vec_id, cls, sum(m * u) / sum(u) AS m FROM p1 GROUP BY vec_id, cls) SELECT vec_id, cls, round((0.65 * 0.5 * (a.m + b.m) + 0.35 * list_dot_product(e.v, c.p)) / 0.12, 5) AS score FROM a JOIN b USING (vec_id, cls) JOIN e USING (vec_id) JOIN c USING (cls)")
def token_transport_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    t = similarity.token_transport(e, similarity.prototypes(e, "label", "embedding"), "embedding", 8)
    return t.select("vec_id", F.explode("scores").alias("s")).select("vec_id", F.col("s.cls").alias("cls"), F.round("s.score", 5).alias("score"))


@query(f"WITH {E_SQL}, {C_SQL}, u AS (SELECT cls, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p FROM c), s2 AS (SELECT label AS cls, (count(*) % 12)::DOUBLE AS n FROM embeddings GROUP BY label), l AS (SELECT vec_id, cls, -list_distance(e.v, c.p) / 0.15 AS da, -list_distance(e.v, u.p) / 0.15 AS db FROM e, c JOIN u USING (cls)), n2 AS (SELECT *, da - ln(sum(exp(da)) OVER (PARTITION BY vec_id)) AS la, db - ln(sum(exp(db)) OVER (PARTITION BY vec_id)) AS lb FROM l), f AS (SELECT vec_id, cls, CASE WHEN n <= 1 THEN greatest(1 / (1 + pow(n / 6, 1.5)), 0.9) WHEN n <= 4 THEN greatest(1 / (1 + pow(n / 6, 1.5)), 0.65) ELSE 1 / (1 + pow(n / 6, 1.5)) END AS w, la, lb FROM n2 JOIN s2 USING (cls)) SELECT vec_id, cls, round(w * lb + (1 - w) * la, 6) AS score FROM f")
def shot_fused_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    side = lambda unit: similarity.log_scores(e.select("vec_id", "embedding"), similarity.prototypes(e, "label", "embedding", unit), 0.15)
    n = shots_of(spark, sf).select(F.col("truth").alias("cls"), F.col("shots").cast("double").alias("n"))
    both = side(False).withColumnRenamed("logp", "direct").join(side(True).withColumnRenamed("logp", "transport"), ["vec_id", "cls"]).join(F.broadcast(n), "cls")  # one row a class
    w = V.shot_fusion_weight(F.col("n"))
    return both.select("vec_id", "cls", r6(w * F.col("transport") + (1 - w) * F.col("direct")).alias("score"))


@query("WITH m AS (SELECT o_orderpriority AS part, o_orderstatus AS metric, avg(o_totalprice) AS x FROM orders GROUP BY ALL), s AS (SELECT part, avg(x) AS strength FROM m GROUP BY part) SELECT part, round(strength, 4) AS strength, part = (SELECT part FROM s ORDER BY round(strength, 6) DESC, part LIMIT 1) AS strongest FROM s")
def component_strength(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("part"), F.col("o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("x"))
    t = metrics.strengths(m, "part", "x")
    return t.select("part", F.round("strength", 4).alias("strength"), "strongest")


@query("SELECT l_returnflag AS flag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def weighted_running_mean(spark, sf):
    t = metrics.weighted(table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", "l_extendedprice")
    return t.select(F.col("l_returnflag").alias("flag"), r6("mean").alias("mean"), F.round("total", 2).alias("total"))


# Verification of runs.
TEXTS = "CASE doc_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN ' FALSE' WHEN 2 THEN '1.0' WHEN 3 THEN '2.5' WHEN 4 THEN 'nan' WHEN 5 THEN '' WHEN 6 THEN 'x1' ELSE doc_id::STRING END"


@query(f"SELECT doc_id, coalesce(CASE lower(trim(t)) WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' END, 'none') AS as_truth, coalesce(x, -1) AS as_number, coalesce(CASE WHEN x = floor(x) THEN x::BIGINT END, -1) AS as_whole FROM (SELECT doc_id, t, CASE WHEN isfinite(try_cast(t AS DOUBLE)) THEN try_cast(t AS DOUBLE) END AS x FROM (SELECT doc_id, {TEXTS} AS t FROM documents))")
def strict_coercion(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(TEXTS.replace("::STRING", "").replace("ELSE doc_id", "ELSE cast(doc_id AS string)")).alias("t"))
    t = F.col("t")
    truth = governance.truth(t, False)
    return d.select("doc_id", F.when(truth, "yes").when(~truth, "no").otherwise("none").alias("as_truth"), F.coalesce(governance.finite(t, False), F.lit(-1.0)).alias("as_number"), F.coalesce(governance.whole(t, False), F.lit(-1).cast("long")).alias("as_whole"))


@query(f"{B_SQL} SELECT vec_id, 'rapt' AS model, truth AS target_index, pred AS prediction_label FROM p UNION ALL SELECT vec_id, 'resnet', truth, pred FROM pb")
def unified_predictions(spark, sf):
    a = pred(spark, sf).select("vec_id", F.col("truth").alias("true_class_index"), F.col("pred").alias("predicted_full_label"))
    b = pred(spark, sf, True).select("vec_id", F.col("truth").alias("class_index"), F.col("pred").alias("predicted_label"))
    return governance.unified(a, "rapt").unionByName(governance.unified(b, "resnet")).select("vec_id", "model", "target_index", "prediction_label")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id % 3 = 0 AND user_id % 2 = 0 GROUP BY event_type")
def nested_key_guard(spark, sf):
    inner = F.when(F.col("user_id") % 3 == 0, F.when(F.col("user_id") % 2 == 0, F.lit("Test_score")).otherwise(F.lit("test_access"))).otherwise(F.lit("score"))
    e = table(spark, sf, "events").select("event_type", F.concat(F.lit('{"note": "a \\"test\\": b", "list": [1, {"props": '), "props", F.lit(', "'), inner, F.lit('": "test"}]}')).alias("doc"))
    return governance.guarded(e, "doc").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


F_SQL = "h AS (SELECT {split} AS part, sha256(coalesce({line}, '')) AS h FROM documents), {name} AS (SELECT part, count(*) AS n, sha256(concat_ws(':', " + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4)) + ")) AS digest FROM h GROUP BY part)"


@query(f"WITH {F_SQL.format(split=SPLIT, line='text', name='a')}, {F_SQL.format(split=SPLIT, line='CASE WHEN doc_id % 100 = 14 THEN upper(text) ELSE text END', name='b').replace('h AS (', 'h1 AS (', 1).replace('FROM h ', 'FROM h1 ')} SELECT a.part, a.digest, CASE WHEN a.part = 'test' THEN 'deferred' WHEN a.digest = b.digest THEN 'match' ELSE 'mismatch' END AS status FROM a JOIN b USING (part)")
def frozen_split_check(spark, sf):
    d = table(spark, sf, "documents").select("text", "doc_id", F.expr(SPLIT).alias("part"))
    a = governance.frozen(d, "part", F.coalesce("text", F.lit("")))
    b = governance.frozen(d, "part", F.coalesce(F.when(F.col("doc_id") % 100 == 14, F.upper("text")).otherwise(F.col("text")), F.lit("")))
    return a.select("part", "digest").join(governance.verify_frozen(a, b, "part", ("test",)), "part")


@query("WITH a AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang), e AS (SELECT lang, count(*) AS n, 20 AS sources FROM documents WHERE text IS NOT NULL AND lang <> 'es' GROUP BY lang) SELECT lang, 'n' AS \"check\", coalesce(a.n = e.n, false) AS ok FROM a FULL JOIN e USING (lang) UNION ALL SELECT lang, 'sources', coalesce(a.sources = e.sources, false) FROM a FULL JOIN e USING (lang)")
def experiment_verification(spark, sf):
    d = table(spark, sf, "documents").filter("lang is not null")
    a = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))
    e = d.filter("text is not null and lang <> 'es'").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("sources", F.lit(20).cast("long"))
    return governance.verify_counts(a, e, "lang")


@query("SELECT o AS l_orderkey, col AS \"column\", n_values FROM (SELECT l_orderkey AS o, 'l_returnflag' AS col, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem GROUP BY 1) WHERE n_values > 1")
def provenance_consistency(spark, sf):
    return governance.inconsistent(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("WITH c AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) + 1 = count(*) AND arg_max(role, turn) = 'assistant') SELECT conv_id, part, count(*) AS n FROM (SELECT conv_id, CASE WHEN role = 'user' THEN 'asked' ELSE 'answered' END AS part FROM conversations SEMI JOIN c USING (conv_id)) GROUP BY ALL")
def phase_assembly(spark, sf):
    c = table(spark, sf, "conversations")
    whole = c.groupBy("conv_id").agg((F.max("turn") + 1 == F.count(F.lit(1))).alias("full"), F.max_by("role", "turn").alias("last")).filter("full and last = 'assistant'")
    t = governance.assemble({"asked": c.filter("role = 'user'"), "answered": c.filter("role <> 'user'")}, whole, "conv_id")
    return t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT lang, list_sort(list(DISTINCT source)) AS s FROM documents WHERE lang IS NOT NULL GROUP BY lang), j AS (SELECT lang, list_transform(s, lambda x, i: '"' || (i - 1) || '"') AS i, list_transform(s, lambda x: '"' || x || '"') AS s FROM k) SELECT lang, sha256('{' || array_to_string(list_transform(i, lambda x, n: x || ':' || s[n]), ',') || '}') AS compact, sha256('{' || array_to_string(list_transform(i, lambda x, n: x || ': ' || s[n]), ', ') || '}') AS spaced FROM j""")
def canonical_map_hashes(spark, sf):
    keys = table(spark, sf, "documents").filter("lang is not null").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))  # class names, not rows
    return keys.select("lang", F.sha2(governance.canonical_json(F.col("s")), 256).alias("compact"), F.sha2(governance.canonical_json(F.col("s"), False), 256).alias("spaced"))


@query("SELECT printf('%s: n=%d, %.4f +/- %.4f', o_orderpriority, count(*), avg(o_totalprice), stddev_samp(o_totalprice)) AS line FROM orders GROUP BY o_orderpriority")
def report_lines(spark, sf):
    t = metrics.describe(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return t.select(metrics.report_line("o_orderpriority").alias("line"))


@query("SELECT doc_id, ((r - 1) // 48 + 1)::INT AS sheet, ((r - 1) % 48 + 1) AS tile FROM (SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) AS r FROM documents)")
def paged_index(spark, sf):
    t = ordered.number(table(spark, sf, "documents").select("lang", "doc_id"), ["lang", "doc_id"], "r")
    return t.select("doc_id", (F.floor((F.col("r") - 1) / 48) + 1).cast("int").alias("sheet"), ((F.col("r") - 1) % 48 + 1).alias("tile"))


@query("SELECT vec_id, row_number() OVER (ORDER BY round_even(embedding[2]::DOUBLE / 0.05, 0), embedding[1], vec_id)::BIGINT AS idx FROM embeddings")
def reading_order_renumber(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("x"), F.bround(F.get("embedding", F.lit(1)).cast("double") / 0.05, 0).alias("line"))
    return ordered.number(e, ["line", "x", "vec_id"]).select("vec_id", "idx")


@query("SELECT source || ':' || lang AS label, row_number() OVER (ORDER BY source || ':' || lang)::BIGINT AS idx FROM (SELECT DISTINCT source, lang FROM documents)")
def label_dictionary(spark, sf):
    return ordered.number(table(spark, sf, "documents").select(F.concat_ws(":", "source", "lang").alias("label")).distinct(), ["label"])


@query("SELECT chk AS \"check\", bool_and(ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM (SELECT 'ids' AS chk, count(*) = 1 AS ok FROM events GROUP BY event_id UNION ALL SELECT 'props', json_valid(props) FROM events UNION ALL SELECT 'value', value >= 20 FROM events) GROUP BY 1")
def audit_rollup(spark, sf):
    e = table(spark, sf, "events")
    ids = e.groupBy("event_id").agg((F.count(F.lit(1)) == 1).alias("ok")).select(F.lit("ids").alias("check"), "ok", F.col("event_id").alias("detail"))
    rest = e.select(F.explode(F.array(F.struct(F.lit("props").alias("check"), F.json_object_keys("props").isNotNull().alias("ok")), F.struct(F.lit("value").alias("check"), (F.col("value") >= 20).alias("ok")))).alias("c"), "event_id").select("c.*", F.col("event_id").alias("detail"))
    return audit.roll_up(ids.unionByName(rest)).select("check", "ok", "failed")


def _tree_sql(parts: dict[str, tuple[str, str]]) -> str:
    """(part, n_rows, sha256) by the three-level hash of the lines of each part: SELECT of lines, and their order."""
    lines = " UNION ALL ".join(f"SELECT '{name}' AS part, row_number() OVER (ORDER BY {order}) - 1 AS i, line FROM ({rows})" for name, (rows, order) in parts.items())
    level = lambda k: f"l{k + 1} AS (SELECT part, i // 1024 AS i, sha256(string_agg(line, chr(10) ORDER BY i)) AS line FROM l{k} GROUP BY part, i // 1024)"
    return f"l0 AS ({lines}), {level(0)}, {level(1)} SELECT part, (SELECT count(*) FROM l0 WHERE l0.part = l2.part) AS n_rows, sha256(string_agg(line, chr(10) ORDER BY i)) AS sha256 FROM l2 GROUP BY part"


_LINES = "SELECT *, doc_id || chr(9) || lang || chr(9) || split || chr(9) || h AS line FROM e"
_PARTS = {"canonical": (_LINES, "split, doc_id")} | {f"{s}_manifest": (f"{_LINES} WHERE split = '{s}'", "split, doc_id") for s in ("train", "validation", "test")}
_PARTS["class_distribution"] = ("SELECT lang, split, n, lang || chr(9) || split || chr(9) || n AS line FROM (SELECT lang, split, count(*) AS n FROM e GROUP BY ALL)", "lang, split")


@query(f"WITH e AS (SELECT doc_id, coalesce(lang, '') AS lang, {SPLIT} AS split, sha256(coalesce(text, '')) AS h FROM documents), {_tree_sql(_PARTS)}")
def published_experiment(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.expr(SPLIT).alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    rows = graph.materialise(rows, "experiment")
    spread = rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))
    audit_ = rows.groupBy("sha256").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("texts_in_two_splits"))
    return publish.publish_experiment(spark, f"{graph.shared_dir(spark)}/quern-published-{uuid.uuid4().hex}", rows, ["split", "doc_id"], {"class_distribution": spread}, {"leakage_audit": audit_})


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cached' ELSE 'written' END AS status, (SELECT count(DISTINCT doc_id) FROM documents) AS held FROM (SELECT DISTINCT doc_id FROM documents)")
def resumed_cache(spark, sf):
    docs, path = table(spark, sf, "documents").select("doc_id", "text"), f"{graph.shared_dir(spark)}/quern-cache-{uuid.uuid4().hex}"
    work = lambda rows: rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.length("text").alias("chars"))
    labelled = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    publish.append_missing(labelled, path, ["doc_id"], work)
    status = publish.append_missing(docs, path, ["doc_id"], work)
    held = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("held"))
    return status.crossJoin(F.broadcast(held))  # one row


@query(r"WITH k AS (SELECT page_id, replace(replace(url, '://', '\'), '/', '\') AS raw, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END || '\x/' || page_id % 50 AS path FROM pages) SELECT replace(path, '\', '/') AS path, max(page_id) AS page_id, arg_max(raw, page_id) AS raw FROM k GROUP BY 1")
def indexed_manifest(spark, sf):
    raw = F.replace(F.replace(F.col("url"), F.lit("://"), F.lit("\\")), F.lit("/"), F.lit("\\"))
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "a").otherwise("b"), F.lit("\\x/"), (F.col("page_id") % 50).cast("string"))
    return manifests.indexed(table(spark, sf, "pages").select(path.alias("path"), "page_id", raw.alias("raw")), "path", "page_id")


@query("SELECT doc_id, doc_id % 84 AS full_idx, doc_id % 84 // 3 AS base, doc_id % 84 % 3 AS modifier FROM documents")
def label_map_gather(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 84).alias("full_idx"))
    labels = docs.select("full_idx").distinct().select("full_idx", F.floor(F.col("full_idx") / 3).alias("base"), (F.col("full_idx") % 3).alias("modifier"))
    return manifests.with_labels(docs, labels, "full_idx").select("doc_id", "full_idx", "base", "modifier")
