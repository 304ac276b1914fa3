"""All registered queries and their SQL counterparts, over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import audit, dedup, geometry, graph, metrics, sequences, similarity, split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), 6)


# Predictions: nearest class mean over all embeddings (model A), nearest unit class mean (model B).
E_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
C_SQL = "c AS (SELECT cls, list(m ORDER BY pos) AS p FROM (SELECT cls, pos, avg(x) AS m FROM (SELECT label AS cls, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY cls, pos) GROUP BY cls)"
U_SQL = "u AS (SELECT cls, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p FROM c)"
R_SQL = "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cls) AS rk FROM (SELECT vec_id, label, cls, list_distance(v, p) AS dist FROM e, c))"
P_SQL = f"WITH {E_SQL}, {C_SQL}, {R_SQL}, p AS (SELECT vec_id, label AS truth, cls AS pred, dist FROM r WHERE rk = 1)"
B_SQL = f"{P_SQL}, {U_SQL}, rb AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cls) AS rk FROM (SELECT vec_id, label, cls, list_distance(v, p) AS dist FROM e, u)), pb AS (SELECT vec_id, label AS truth, cls AS pred FROM rb WHERE rk = 1)"
K_SQL = """t AS (SELECT cls, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (SELECT truth AS cls, (truth = pred)::INT AS tp, 0 AS fp, (truth <> pred)::INT AS fn FROM p UNION ALL SELECT pred, 0, (truth <> pred)::INT, 0 FROM p) GROUP BY cls),
k AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM t)"""


def pred(spark: SparkSession, sf: str, normalise: bool = False, k: int = 5) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return similarity.predictions(e, similarity.prototypes(e, "label", "embedding", normalise), "label", k=k)


@query(f"{P_SQL}, {K_SQL} SELECT cls, tp, fp, fn, support, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM k")
def per_class_prf(spark, sf):
    return metrics.class_table(pred(spark, sf)).select("cls", "tp", "fp", "fn", "support", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(f"{P_SQL}, {K_SQL} SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(rec) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1) FILTER (support > 0), 6) AS macro_f1, round(avg(f1), 6) AS macro_f1_all, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM k")
def macro_weighted_f1(spark, sf):
    return metrics.summary(pred(spark, sf)).select("n", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "macro_f1_all", "weighted_f1")])


@query(f"{P_SQL} SELECT round(avg((label = cls)::INT) FILTER (rk = 1), 6) AS top1, round(avg(h3), 6) AS top3, round(avg(h5), 6) AS top5 FROM (SELECT *, max((label = cls AND rk <= 3)::INT) OVER (PARTITION BY vec_id) AS h3, max((label = cls AND rk <= 5)::INT) OVER (PARTITION BY vec_id) AS h5 FROM r) WHERE rk = 1")
def topk_accuracy(spark, sf):
    p = pred(spark, sf)
    hit = lambda k: r6(F.avg(F.array_contains(F.slice("top", 1, k), F.col("truth")).cast("double")))
    return p.agg(hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"))


@query(f"{P_SQL} SELECT truth, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM p GROUP BY truth, pred")
def confusion_cells(spark, sf):
    cells = pred(spark, sf).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("truth"))))


@query(f"{P_SQL} SELECT truth, " + ", ".join(f"count(*) FILTER (pred = {i}) AS c{i}" for i in range(10)) + " FROM p GROUP BY truth")
def confusion_matrix(spark, sf):
    wide = pred(spark, sf).groupBy("truth").pivot("pred", list(range(10))).count().na.fill(0)
    return wide.withColumnsRenamed({str(i): f"c{i}" for i in range(10)})


@query(f"{P_SQL} SELECT truth, pred, n, round(mean_dist, 6) AS mean_dist FROM (SELECT truth, pred, count(*) AS n, min(vec_id) AS f, avg(dist) AS mean_dist FROM p WHERE truth <> pred GROUP BY ALL) ORDER BY n DESC, f LIMIT 20")
def top_confusion_pairs(spark, sf):
    t = pred(spark, sf).filter("truth <> pred").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("f"), F.avg("dist").alias("d"))
    return t.orderBy(F.desc("n"), "f").limit(20).select("truth", "pred", "n", r6("d").alias("mean_dist"))


@query(f"WITH {E_SQL}, {C_SQL} SELECT cls, len(p)::INT AS dims, round(sqrt(list_dot_product(p, p)), 6) AS length, round(p[1], 6) AS x0 FROM c")
def class_prototypes(spark, sf):
    t = similarity.prototypes(table(spark, sf, "embeddings"), "label", "embedding")
    return t.select("cls", F.size("proto").alias("dims"), r6(V.norm(F.col("proto"))).alias("length"), r6(F.get("proto", F.lit(0))).alias("x0"))


@query(f"WITH {E_SQL}, {C_SQL}, {R_SQL} SELECT vec_id, rk::INT AS rank, cls, round(dist, 6) AS dist FROM r WHERE rk <= 5")
def nearest_prototype_top5(spark, sf):
    e = table(spark, sf, "embeddings")
    t = similarity.ranked_classes(e, similarity.prototypes(e, "label", "embedding"), k=5)
    return t.select("vec_id", F.posexplode("ranked").alias("rank", "r")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("r.cls").alias("cls"), r6("r.dist").alias("dist"))


@query(f"{P_SQL}, q AS (SELECT quantile_cont(dist, 0.95) * 1.25 AS t FROM r WHERE rk = 1), m AS (SELECT a.vec_id, a.cls, a.dist, b.dist - a.dist AS margin FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.rk = 1 AND b.rk = 2) SELECT vec_id, CASE WHEN dist <= t AND margin >= 0.01 THEN cls::VARCHAR ELSE '_' END AS label, CASE WHEN dist <= t AND margin >= 0.01 THEN 'accepted' ELSE 'unknown_distance' END AS status FROM m, q")
def ocr_style_acceptance(spark, sf):
    p = pred(spark, sf)
    limit = metrics.quantile(p, [], "dist", 0.95).select((F.col("quantile") * 1.25).alias("t"))
    label = similarity.accept(F.col("dist"), F.col("margin"), F.col("pred").cast("string"), F.col("t"))
    return p.crossJoin(F.broadcast(limit)).select("vec_id", label.alias("label")).withColumn("status", F.when(F.col("label") == "_", "unknown_distance").otherwise("accepted"))


ROUTE_SQL = f"{B_SQL}, s AS (SELECT label AS cls, count(*) AS shots FROM embeddings GROUP BY label), m AS (SELECT a.vec_id, a.label AS truth, a.cls AS ta, b.dist - a.dist AS margin FROM rb a JOIN rb b ON a.vec_id = b.vec_id AND a.rk = 1 AND b.rk = 2), z AS (SELECT m.vec_id, m.truth, ta, margin, p.pred AS da, shots FROM m JOIN p USING (vec_id) JOIN s ON s.cls = ta)"


def routed(spark, sf):
    e = table(spark, sf, "embeddings")
    shots = e.groupBy(F.col("label").alias("ta")).agg(F.count(F.lit(1)).alias("shots"))
    b = pred(spark, sf, True).select("vec_id", "truth", F.col("pred").alias("ta"), "margin")
    return b.join(pred(spark, sf).select("vec_id", F.col("pred").alias("da")), "vec_id").join(F.broadcast(shots), "ta")


@query(f"{ROUTE_SQL} SELECT vec_id, CASE WHEN shots <= 50 AND margin >= 0.005 THEN ta ELSE da END AS label, shots <= 50 AND margin >= 0.005 AS use_transport FROM z")
def margin_router(spark, sf):
    t = routed(spark, sf)
    return t.select("vec_id", similarity.route(F.col("ta"), F.col("da"), F.col("shots"), F.col("margin"), 50, 0.005).alias("label"), ((F.col("shots") <= 50) & (F.col("margin") >= 0.005)).alias("use_transport"))


@query(f"{ROUTE_SQL}, g AS (SELECT row_number() OVER (ORDER BY a, b) AS ord, a AS max_shots, b AS min_margin FROM unnest([40, 48, 56, 64]) x(a), unnest([0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]) y(b)), o AS (SELECT ord, max_shots, min_margin, avg((truth = CASE WHEN shots <= max_shots AND margin >= min_margin THEN ta ELSE da END)::INT) AS acc, avg((shots <= max_shots AND margin >= min_margin)::INT) AS share FROM z, g GROUP BY ALL) SELECT max_shots, min_margin::DOUBLE AS min_margin, round(acc, 6) AS accuracy, round(share, 6) AS share, ord = (SELECT ord FROM o ORDER BY round(acc, 9) DESC, ord LIMIT 1) AS selected FROM o")
def router_grid_selection(spark, sf):
    grid = spark.sql("SELECT row_number() OVER (ORDER BY a, b) AS ord, a AS max_shots, cast(b AS double) AS min_margin FROM (SELECT explode(array(40, 48, 56, 64)) AS a) CROSS JOIN (SELECT explode(array(0.0D, 0.001D, 0.002D, 0.005D, 0.01D, 0.02D, 0.03D, 0.05D, 0.1D)) AS b)")
    use = (F.col("shots") <= F.col("max_shots")) & (F.col("margin") >= F.col("min_margin"))
    t = routed(spark, sf).crossJoin(F.broadcast(grid))
    t = t.groupBy("ord", "max_shots", "min_margin").agg(F.avg((F.col("truth") == F.when(use, F.col("ta")).otherwise(F.col("da"))).cast("int")).alias("acc"), F.avg(use.cast("int")).alias("share"))
    best = t.agg(F.max_by("ord", F.struct(F.round("acc", 9), -F.col("ord"))).alias("best"))
    return t.crossJoin(F.broadcast(best)).select("max_shots", "min_margin", r6("acc").alias("accuracy"), r6("share").alias("share"), (F.col("ord") == F.col("best")).alias("selected"))


@query(f"WITH {E_SQL}, {C_SQL}, {R_SQL}, x AS (SELECT vec_id, cls, exp(-dist / 0.15) AS w FROM r) SELECT vec_id, round(max(w) / sum(w), 6) AS confidence, round(-sum(w / t * ln(w / t)), 6) AS entropy FROM (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS t FROM x) GROUP BY vec_id")
def softmax_confidence(spark, sf):
    e = table(spark, sf, "embeddings")
    t = similarity.ranked_classes(e, similarity.prototypes(e, "label", "embedding"))
    t = t.select("vec_id", V.softmax(F.transform("ranked", lambda x: -x["dist"] / 0.15)).alias("p"))
    return t.select("vec_id", r6(F.array_max("p")).alias("confidence"), r6(-F.aggregate("p", F.lit(0.0), lambda s, x: s + x * F.ln(x))).alias("entropy"))


@query(f"{B_SQL} SELECT CASE WHEN p.pred = p.truth AND pb.pred = pb.truth THEN 'both_right' WHEN p.pred = p.truth THEN 'a_only' WHEN pb.pred = pb.truth THEN 'b_only' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM p JOIN pb USING (vec_id) GROUP BY 1")
def model_outcomes(spark, sf):
    a = pred(spark, sf).select("vec_id", (F.col("truth") == F.col("pred")).alias("a"))
    b = pred(spark, sf, True).select("vec_id", (F.col("truth") == F.col("pred")).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "both_right").when(F.col("a"), "a_only").when(F.col("b"), "b_only").otherwise("both_wrong")
    return a.join(b, "vec_id").groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{B_SQL} SELECT vec_id FROM p JOIN pb USING (vec_id) WHERE p.pred <> pb.pred")
def model_alignment_diff(spark, sf):
    return audit.misaligned(pred(spark, sf).select("vec_id", "pred"), pred(spark, sf, True).select("vec_id", "pred"), ["vec_id"], ["pred"])


@query(f"{P_SQL}, w AS (SELECT vec_id, list(cls ORDER BY rk) AS top, list(dist ORDER BY rk) AS ds FROM r WHERE rk <= 5 GROUP BY vec_id), x AS (SELECT p.vec_id, pred, top, ds FROM p JOIN w USING (vec_id)) SELECT rule, violations FROM (SELECT 'five_distinct' AS rule, count(*) FILTER (len(list_distinct(top)) <> 5) AS violations FROM x UNION ALL SELECT 'top1_is_pred', count(*) FILTER (top[1] <> pred) FROM x UNION ALL SELECT 'unique_id', count(*) - count(DISTINCT vec_id) FROM x UNION ALL SELECT 'truth_is_pred', count(*) FILTER (truth <> pred) FROM p)")
def prediction_validator(spark, sf):
    p = pred(spark, sf)
    n = F.count(F.lit(1)).over(Window.partitionBy("vec_id"))
    rules = {"five_distinct": F.size(F.array_distinct("top")) == 5, "top1_is_pred": F.get("top", F.lit(0)) == F.col("pred"), "unique_id": F.col("_n") == 1, "truth_is_pred": F.col("truth") == F.col("pred")}
    return audit.violations(p.withColumn("_n", n), rules)


@query(f"WITH {E_SQL} SELECT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, 65), lambda i: (v[i] > v[i % 64 + 1])::UBIGINT)), lambda a, b: ((a % 9223372036854775808) * 2 + b)::UBIGINT) AS code_u FROM e".replace("AS code_u", "::VARCHAR AS code"))
def embedding_diff_code(spark, sf):
    code = V.difference_code(V.doubles("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.when(code >= 0, code.cast("string")).otherwise((code.cast("decimal(20,0)") + F.expr("18446744073709551616BD")).cast("decimal(20,0)").cast("string")).alias("code"))


# Near-duplicate codes of documents.
S_SQL = r"""w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM documents),
b AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS h FROM w WHERE w <> ''),
g AS (SELECT doc_id, """ + ", ".join(f"(sum(CASE WHEN (h >> {63 - i}) & 1 = 1 THEN 1 ELSE -1 END) > 0)::INT AS b{i}" for i in range(64)) + """ FROM b GROUP BY doc_id),
s AS (SELECT d.doc_id, """ + " || ".join(f"coalesce(b{i}, 0)" for i in range(64)) + """ AS code FROM documents d LEFT JOIN g USING (doc_id)),
ham AS (SELECT DISTINCT x.code AS a, y.code AS b, hamming(x.code, y.code) AS dist FROM (SELECT DISTINCT code FROM s) x JOIN (SELECT DISTINCT code FROM s) y ON x.code < y.code AND hamming(x.code, y.code) <= 3)"""


def codes(spark, sf):
    return dedup.word_simhash(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH {S_SQL} SELECT dist::INT AS dist, count(*) AS pairs FROM ham GROUP BY dist")
def hamming_near_pairs(spark, sf):
    distinct = graph.materialise(codes(spark, sf).select("code").distinct(), "codes")
    return dedup.near_pairs(distinct, 3).groupBy("dist").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"WITH RECURSIVE {S_SQL}, l AS (SELECT a, b FROM ham UNION SELECT b, a FROM ham), r AS (SELECT DISTINCT code AS c, code AS m FROM s UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.c), k AS (SELECT s.doc_id, min(t.doc_id) AS m FROM s JOIN r ON s.code = r.c JOIN s t ON t.code = r.m GROUP BY s.doc_id) SELECT doc_id, m AS component FROM k")
def duplicate_components(spark, sf):
    c = graph.materialise(codes(spark, sf), "codes")
    classes = c.groupBy("code").agg(F.min("id").alias("least"))
    roots = graph.components(dedup.near_pairs(classes.select("code"), 3).select("a", "b"))
    whole = classes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = whole.groupBy("root").agg(F.min("least").alias("component"))
    return c.join(whole.join(least, "root").select("code", "component"), "code").select(F.col("id").alias("doc_id"), "component")


SPLIT = "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END"


@query(f"WITH {S_SQL}, p AS (SELECT s.*, {SPLIT} AS split FROM s) SELECT doc_id, EXISTS (SELECT 1 FROM p y WHERE y.split <> 'train' AND hamming(x.code, y.code) <= 2) AS excluded FROM p x WHERE split = 'train'")
def heldout_collision_flags(spark, sf):
    c = graph.materialise(codes(spark, sf).withColumn("split", F.expr(SPLIT.replace("doc_id", "id"))), "codes")
    train, held = c.filter("split = 'train'"), c.filter("split <> 'train'").select("code").distinct()
    distinct = c.select("code").distinct()
    pairs = dedup.near_pairs(distinct, 2)
    near = pairs.select("a", "b").union(pairs.select("b", "a")).union(distinct.select("code", "code"))
    bad = near.join(held.select(F.col("code").alias("b")), "b", "left_semi").select(F.col("a").alias("code")).distinct().withColumn("hit", F.lit(True))
    return train.join(bad, "code", "left").select(F.col("id").alias("doc_id"), F.coalesce("hit", F.lit(False)).alias("excluded"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS anchor, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("anchor"), F.count_distinct("source").alias("sources")).filter("n > 1")


@query("SELECT sha256(text) AS key, array_to_string(list_sort(list(DISTINCT source)), ',') AS splits FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def crossing_values_by_source(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), "source")
    return dedup.crossing(d, "h", "source").select("key", F.array_join("splits", ",").alias("splits"))


@query(f"WITH d AS (SELECT *, {SPLIT} AS split, sha256(text) AS h FROM documents) SELECT 'text' AS rule, count(*) AS violations FROM (SELECT h FROM d WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'source', count(*) FROM (SELECT source FROM d WHERE source <> '' GROUP BY source HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'unlabelled', count(*) FROM d ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'benchmark', count(*) FROM d SEMI JOIN benchmark b ON d.text = b.text")
def leakage_audit_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source", F.sha2("text", 256).alias("h"), F.expr(SPLIT).alias("split"))
    row = lambda rule, t: t.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    b = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("h"))
    return row("text", dedup.crossing(d, "h", "split")).union(row("source", dedup.crossing(d, "source", "split"))).union(row("unlabelled", d.join(table(spark, sf, "labels"), "doc_id", "left_anti"))).union(row("benchmark", d.join(b, "h", "left_semi")))


@query(f"WITH l0 AS (SELECT row_number() OVER (ORDER BY split, doc_id, line) - 1 AS i, line FROM (SELECT doc_id, split, split || chr(9) || doc_id || chr(9) || h AS line FROM (SELECT doc_id, {SPLIT} AS split, sha256(coalesce(text, '')) AS h FROM documents))), l1 AS (SELECT i // 1024 AS i, sha256(string_agg(line, chr(10) ORDER BY i)) AS line FROM l0 GROUP BY i // 1024), l2 AS (SELECT i // 1024 AS i, sha256(string_agg(line, chr(10) ORDER BY i)) AS line FROM l1 GROUP BY i // 1024) SELECT sha256(string_agg(line, chr(10) ORDER BY i)) AS dataset_sha256, (SELECT count(*) FROM documents) AS n_rows FROM l2")
def ordered_dataset_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(SPLIT).alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return dedup.content_hash(d, ["split", "doc_id"], F.concat("split", F.lit("\t"), F.col("doc_id").cast("string"), F.lit("\t"), "h"))


@query(f"WITH d AS (SELECT lang, source, {SPLIT} AS split FROM documents) SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, count(DISTINCT source) AS sources FROM d GROUP BY lang")
def split_class_distribution(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", F.expr(SPLIT).alias("split"))
    count = lambda s: F.count_if(F.col("split") == s).alias(s)
    return d.groupBy("lang").agg(count("train"), count("validation"), count("test"), F.count_distinct("source").alias("sources"))


@query(r"SELECT page_id, trim(regexp_replace(upper(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '[^A-Z0-9]+', '_', 'g'), '_') AS host_id, CASE WHEN regexp_extract(url, '/([a-z]{2})/', 1) <> '' THEN 'LANG::' || regexp_extract(url, '/([a-z]{2})/', 1) ELSE 'HOST::' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS grp, lpad(regexp_extract(url, '/(\d+)', 1), 6, '0') AS item FROM pages")
def identity_from_url(spark, sf):
    host, lang = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "/([a-z]{2})/", 1)
    g = T.strongest_group({"LANG": lang, "HOST": host})
    return table(spark, sf, "pages").select("page_id", T.normalized_id(host).alias("host_id"), F.concat_ws("::", g["level"], g["id"]).alias("grp"), F.lpad(F.regexp_extract("url", r"/(\d+)", 1), 6, "0").alias("item"))


@query("SELECT doc_id, name, value FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (value FOR name IN (quality, toxic))")
def wide_to_long_labels(spark, sf):
    return table(spark, sf, "labels").unpivot("doc_id", ["quality", "toxic"], "name", "value")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def joint_correctness_crosstab(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def grouped_metrics_sets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")
    t = d.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("quality")).alias("quality"), r6(F.avg("toxic")).alias("toxic"))
    return t.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n", "quality", "toxic")


@query("SELECT bin, count(*) AS customers, sum(n)::BIGINT AS orders, round(sum(f) / sum(n), 6) AS finished FROM (SELECT CASE WHEN n <= 0 THEN 'zero_shot' WHEN n = 1 THEN 'one_shot' WHEN n <= 4 THEN '2_4' WHEN n <= 9 THEN '5_9' ELSE '10_plus' END AS bin, n, f FROM (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)) GROUP BY bin")
def frequency_bin_metrics(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    c = table(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0)
    t = c.groupBy(T.frequency_bin_evaluation(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"), F.sum("f").alias("f"))
    return t.select("bin", "customers", "orders", F.round(F.try_divide("f", "orders"), 6).alias("finished"))


M_SQL = "m AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS ym, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS d FROM orders GROUP BY 1)"


def monthly(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return o.groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym")).agg((side("F") - side("O")).alias("d"))


@query(f"WITH {M_SQL} SELECT (ym // 100)::INT AS y, count(d) AS n, round(avg(d), 4) AS mean, round(coalesce(stddev_samp(d), 0), 4) AS sd, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, round(avg(d) / nullif(coalesce(stddev_samp(d), 0) / sqrt(count(d)), 0), 6) AS t, count(d) - 1 AS df FROM m GROUP BY 1")
def paired_difference_stats(spark, sf):
    t = metrics.paired(monthly(spark, sf).withColumn("y", F.floor(F.col("ym") / 100).cast("int")), ["y"], "d")
    return t.select("y", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "wins", "ties", "losses", F.round("t", 6).alias("t"), "df")


@query("SELECT o_orderpriority AS grp, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def descriptive_statistics(spark, sf):
    t = metrics.describe(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return t.select(F.col("o_orderpriority").alias("grp"), "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "median")], "min", "max")


@query(f"WITH {M_SQL}, v AS (SELECT list(d ORDER BY ym) AS v FROM m WHERE d IS NOT NULL), b AS (SELECT b, (SELECT avg(v[(((b * 7919 + j * 104729 + 2026) * 48271 % 2147483647) % len(v) + 1)::INT]) FROM range(1, len(v) + 1) t(j)) AS m FROM v, range(1, 1001) s(b)) SELECT round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM b")
def bootstrap_ci(spark, sf):
    t = metrics.bootstrap(monthly(spark, sf).filter("d is not null"), "d", "ym", 1000)
    return t.select(F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("SELECT s_suppkey, s_nationkey, rank() OVER w + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0::DOUBLE AS avg_rank FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)")
def descending_average_rank(spark, sf):
    return sequences.descending_average_rank(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", "s_nationkey", "avg_rank")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 10")
def stratified_sample_topk(spark, sf):
    return split.stratified(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 10)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_row_per_group(spark, sf):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("SELECT event_type, \"first\", \"last\", n FROM (SELECT event_type, min(h) AS \"first\", max(h) AS \"last\", count(*) AS n FROM (SELECT event_type, h, h - row_number() OVER (PARTITION BY event_type ORDER BY h) AS g FROM (SELECT DISTINCT event_type, floor(epoch(ts) / 3600)::BIGINT AS h FROM events)) GROUP BY event_type, g)")
def gaps_and_islands_events(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h"))
    return sequences.islands(e, ["event_type"], "h")


H_SQL = "h AS (SELECT event_type, floor(epoch(ts) / 86400)::BIGINT AS d, count(*) AS n FROM events GROUP BY ALL)"


def daily(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {H_SQL} SELECT event_type, d, n FROM (SELECT *, coalesce(lag(n) OVER w, -1) AS p, coalesce(lead(n) OVER w, -1) AS q FROM h WINDOW w AS (PARTITION BY event_type ORDER BY d)) WHERE n >= p AND n > q AND n >= 2")
def local_maxima_daily(spark, sf):
    return sequences.local_maxima(daily(spark, sf), ["event_type"], "d", "n", 2)


@query(f"WITH {H_SQL}, p AS (SELECT event_type, d, n FROM (SELECT *, coalesce(lag(n) OVER w, -1) AS p, coalesce(lead(n) OVER w, -1) AS q FROM h WINDOW w AS (PARTITION BY event_type ORDER BY d)) WHERE n >= p AND n > q AND n >= 2), k AS (SELECT event_type, list_reduce(list([d] ORDER BY n DESC, d), lambda a, b: CASE WHEN len(list_filter(a, lambda x: abs(x - b[1]) < 7)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM p GROUP BY event_type) SELECT p.* FROM p JOIN k USING (event_type) WHERE list_contains(kept, d)")
def nms_peaks(spark, sf):
    return sequences.suppress(sequences.local_maxima(daily(spark, sf), ["event_type"], "d", "n", 2), ["event_type"], "d", "n", 7)


@query(f"WITH {H_SQL} SELECT event_type, d, round(" + " + ".join(f"{w!r}::DOUBLE * coalesce({'lag' if k < 0 else 'lead'}(n, {abs(k)}) OVER w, 0)" for k, w in zip(range(-2, 3), sequences.hann(2), strict=True)) + ", 6) AS smoothed FROM h WINDOW w AS (PARTITION BY event_type ORDER BY d)")
def hann_smoothing(spark, sf):
    t = sequences.smooth(daily(spark, sf).withColumn("n", F.col("n").cast("double")), ["event_type"], "d", "n", 2)
    return t.select("event_type", "d", F.round("smoothed", 6).alias("smoothed"))


@query(f"WITH {H_SQL}, g AS (SELECT t.event_type, s.d FROM (SELECT event_type, min(d) AS a, max(d) AS b FROM h GROUP BY 1) t, range(a, b + 1) s(d)), f AS (SELECT g.event_type, g.d, CASE WHEN n >= 3 THEN n::DOUBLE END AS n, CASE WHEN n >= 3 THEN g.d END AS k FROM g LEFT JOIN h USING (event_type, d)), i AS (SELECT *, last_value(n IGNORE NULLS) OVER a AS v0, first_value(n IGNORE NULLS) OVER b AS v1, last_value(k IGNORE NULLS) OVER a AS k0, first_value(k IGNORE NULLS) OVER b AS k1 FROM f WINDOW a AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_type, d, round(coalesce(n, v0 + (v1 - v0) * (d - k0) / nullif(k1 - k0, 0), v0, v1), 6) AS filled FROM i")
def interpolate_fill(spark, sf):
    h = daily(spark, sf)
    days = h.groupBy("event_type").agg(F.min("d").alias("a"), F.max("d").alias("b")).select("event_type", F.explode(F.sequence("a", "b")).alias("d"))
    t = days.join(h, ["event_type", "d"], "left").withColumn("n", F.when(F.col("n") >= 3, F.col("n").cast("double")))
    return sequences.interpolate(t, ["event_type"], "d", "n").select("event_type", "d", F.round("filled", 6).alias("filled"))


@query(f"WITH {H_SQL} SELECT event_type, d, (d + lag(d) OVER w) / 2.0::DOUBLE AS low, (d + lead(d) OVER w) / 2.0::DOUBLE AS high FROM h WINDOW w AS (PARTITION BY event_type ORDER BY d)")
def midpoint_neighbours(spark, sf):
    w = Window.partitionBy("event_type").orderBy("d")
    return daily(spark, sf).select("event_type", "d", ((F.col("d") + F.lag("d").over(w)) / 2).alias("low"), ((F.col("d") + F.lead("d").over(w)) / 2).alias("high"))


@query(f"WITH {H_SQL} SELECT event_type, win, round(quantile_cont(n, 0.86), 6) AS p86, count(*) AS days FROM (SELECT event_type, floor(d / 48)::BIGINT - o AS win, n FROM h, (SELECT unnest([0, 1]) AS o)) GROUP BY ALL")
def sliding_window_percentile(spark, sf):
    t = daily(spark, sf).select("event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("o"), "d", "n")
    t = t.select("event_type", (F.floor(F.col("d") / 48) - F.col("o")).alias("win"), "n")
    return t.groupBy("event_type", "win").agg(F.round(F.percentile("n", F.lit(0.86)), 6).alias("p86"), F.count(F.lit(1)).alias("days"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 1 AND abs(a.p_retailprice - b.p_retailprice) <= 2.5")
def box_range_neighbours(spark, sf):
    return geometry.near_box_pairs(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice", 1, 2.5).select("a", "b")


@query("SELECT a, first(b ORDER BY c, b) AS main, round(min(c), 6) AS cost FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, abs(a.p_size - b.p_size) + 1.4 * abs(a.p_retailprice - b.p_retailprice) AS c FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 2 AND abs(a.p_retailprice - b.p_retailprice) <= 2) GROUP BY a")
def nearest_main_with_cutoff(spark, sf):
    t = geometry.nearest_after(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice", 2, 2.0, 1.4)
    return t.select("a", "main", F.round("cost", 6).alias("cost"))


@query("WITH n AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size = b.p_size AND abs(a.p_retailprice - b.p_retailprice) <= 1) SELECT x.a AS i, x.b AS j, y.b AS k FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN n z ON z.a = x.b AND z.b = y.b")
def spatial_hash_triples(spark, sf):
    return geometry.near_triples(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice", 0.5, 1.0)


@query("WITH RECURSIVE p AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE v > 0), r AS (SELECT vec_id, y, x, y * 8 + x AS m FROM p UNION SELECT q.vec_id, q.y, q.x, r.m FROM r JOIN p q ON q.vec_id = r.vec_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1), k AS (SELECT vec_id, y, x, min(m) AS m FROM r GROUP BY ALL) SELECT vec_id, count(*) AS area, min(x)::BIGINT AS x0, min(y)::BIGINT AS y0, max(x)::BIGINT AS x1, max(y)::BIGINT AS y1 FROM k GROUP BY vec_id, m")
def run_components(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id"), F.posexplode("embedding").alias("i", "v")).filter("v > 0")
    t = geometry.raster_components(e.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x")), "vec_id")
    return t.select("vec_id", "area", "x0", "y0", "x1", "y1")


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def text_assembly(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.sum(F.length("text")).alias("chars"))
    return t.select("conv_id", F.array_join(F.transform("r", lambda s: s["role"]), " ").alias("roles"), "chars")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_artifacts(spark, sf):
    return table(spark, sf, "documents").select("doc_id").distinct().join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT p_brand, p_type, round(quantile_cont(p_retailprice, 0.28), 4) AS low, round(quantile_cont(p_retailprice, 0.992), 4) AS high, round(median(p_size), 4) AS mid FROM part GROUP BY ALL")
def percentile_stretch(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.round(F.percentile("p_retailprice", F.lit(0.28)), 4).alias("low"), F.round(F.percentile("p_retailprice", F.lit(0.992)), 4).alias("high"), F.round(F.median("p_size"), 4).alias("mid"))


@query("SELECT s_suppkey, round(CASE WHEN n <= 1 THEN greatest(w, 0.9) WHEN n <= 4 THEN greatest(w, 0.65) ELSE w END, 6) AS weight FROM (SELECT s_suppkey, n, 1 / (1 + pow(n / 6.0, 1.5)) AS w FROM (SELECT s_suppkey, count(DISTINCT l_returnflag || l_linestatus)::DOUBLE AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1))")
def shot_fusion_weights(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.concat("l_returnflag", "l_linestatus")).alias("n"))
    t = table(spark, sf, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return t.select("s_suppkey", F.round(V.shot_fusion_weight(F.coalesce("n", F.lit(0)).cast("double")), 6).alias("weight"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS prefix FROM lineitem")
def prefix_sums(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.sum("l_quantity").over(w).alias("prefix"))
