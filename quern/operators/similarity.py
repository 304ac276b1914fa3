"""Prototypes, nearest classes, top-k, margins and routing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import dot, doubles, log_softmax, norm, squared_distance

#: Most classes whose prototypes go to every task in one row.
MAX_CLASSES = 20_000


def prototypes(vectors: DataFrame, label: str, vector: str, normalise: bool = False) -> DataFrame:
    """(cls, proto, n): mean vector of each class; partial sums by dimension before the shuffle."""
    long = vectors.filter(F.col(label).isNotNull()).select(F.col(label).alias("cls"), F.posexplode(doubles(vector)).alias("pos", "x"))
    means = long.groupBy("cls", "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    out = means.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("proto"), F.max("n").alias("n"))
    if normalise:
        out = out.withColumn("proto", F.transform("proto", lambda x: F.coalesce(F.try_divide(x, norm(F.col("proto"))), F.lit(0.0))))
    return out


def packed_classes(protos: DataFrame) -> DataFrame:
    """The prototypes as one row (_protos, by class) to send to every task, after a check of their number; more than MAX_CLASSES raise."""
    n = protos.count()
    if n > MAX_CLASSES:
        raise ValueError(f"{n} classes; at most {MAX_CLASSES} prototypes are sent to every task")
    return protos.agg(F.array_sort(F.collect_list(F.struct("cls", "proto"))).alias("_protos"))


def ranked_classes(vectors: DataFrame, protos: DataFrame, vector: str = "embedding", k: int | None = None) -> DataFrame:
    """`vectors` with `ranked`: array of (dist, cls), nearest first, ties to the smaller class; no shuffle of vectors.

    The prototypes travel as one row (`packed_classes`).
    """
    packed = packed_classes(protos)
    dist = lambda p: F.struct(F.sqrt(squared_distance(doubles(vector), p["proto"])).alias("dist"), p["cls"].alias("cls"))
    ranked = F.array_sort(F.transform("_protos", dist))
    return vectors.crossJoin(F.broadcast(packed)).withColumn("ranked", ranked if k is None else F.slice(ranked, 1, k)).drop("_protos")


def predictions(vectors: DataFrame, protos: DataFrame, label: str, vector: str = "embedding", k: int = 5) -> DataFrame:
    """`vectors` columns but the vector, and truth, pred, top (array of classes), dist, margin (second minus first)."""
    r = ranked_classes(vectors, protos, vector, k)
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return r.select(*[c for c in vectors.columns if c not in (vector, label)], F.col(label).alias("truth"), first["cls"].alias("pred"), F.transform("ranked", lambda x: x["cls"]).alias("top"), first["dist"].alias("dist"), (second["dist"] - first["dist"]).alias("margin"))


def route(transport: Column, direct: Column, shots: Column, margin: Column, max_shots: int, min_margin: float) -> Column:
    """Transport's answer where its class is rare enough and its margin wide enough, else the direct one."""
    return F.when((shots <= max_shots) & (margin >= min_margin), transport).otherwise(direct)


def accept(dist: Column, margin: Column, label: Column, threshold: Column, min_margin: float = 0.01) -> Column:
    """The label, or "_" when it is too far or too close to the next one."""
    return F.when((dist <= threshold) & (margin >= min_margin), label).otherwise(F.lit("_"))


def log_scores(vectors: DataFrame, protos: DataFrame, temperature: float, vector: str = "embedding") -> DataFrame:
    """`vectors` columns but the vector, cls and logp: log-probability of each class by distance over temperature."""
    ranked = ranked_classes(vectors, protos, vector)
    both = F.arrays_zip(F.transform("ranked", lambda x: x["cls"]).alias("cls"), log_softmax(F.transform("ranked", lambda x: -x["dist"] / temperature)).alias("logp"))
    return ranked.withColumn("_s", F.explode(both)).select(*[c for c in vectors.columns if c != vector], F.col("_s.cls").alias("cls"), F.col("_s.logp").alias("logp"))


def token_transport(vectors: DataFrame, protos: DataFrame, vector: str, tokens: int, match: float = 0.08, temperature: float = 0.12, local: float = 0.65) -> DataFrame:
    """`vectors` columns but the vector, and scores: array of (cls, score) by soft token matching in both directions.

    A vector is cut into `tokens` tokens, whose lengths say how reliable they are. Each token takes the soft maximum of its
    products with the other side's tokens; their reliable means in both directions, averaged, are the local part, and
    the product of the whole vectors is the rest.
    """
    packed = packed_classes(protos)
    cut_up = lambda v: F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda i: F.slice(v, i * (F.size(v) / tokens).cast("int") + 1, (F.size(v) / tokens).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    soft = lambda one, others: F.lit(match) * F.ln(total(F.transform(others, lambda o: F.exp(dot(one, o) / match))))

    def side(own: Column, others: Column) -> Column:
        return total(F.transform(own, lambda t: soft(t, others) * norm(t))) / F.greatest(total(F.transform(own, norm)), F.lit(1e-6))

    v = doubles(vector)
    score = lambda p: (F.lit(local) * 0.5 * (side(cut_up(v), cut_up(p["proto"])) + side(cut_up(p["proto"]), cut_up(v))) + F.lit(1 - local) * dot(v, p["proto"])) / temperature
    scores = F.transform("_protos", lambda p: F.struct(p["cls"].alias("cls"), score(p).alias("score")))
    return vectors.crossJoin(F.broadcast(packed)).select(*[c for c in vectors.columns if c != vector], scores.alias("scores"))


def exemplar_min(queries: DataFrame, rows: DataFrame, key: str, label: str, vector: str, block: int = 2048) -> DataFrame:
    """(key, cls, dist2): least squared distance of each query to any row of each class.

    Queries and rows are dealt into blocks by a hash; every pair of blocks is one group of bounded size, and its least
    distances per query and class are all that leaves it. Null and empty vectors take no part.
    """
    used = lambda df: df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
    nq, nr = (max(1, -(-used(df).count() // block)) for df in (queries, rows))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    q = used(queries).select(F.col(key).alias("k"), doubles(vector).alias("v"), deal(nq).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("j"))
    r = used(rows).select(F.col(label).alias("c"), doubles(vector).alias("v"), deal(nr).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"))
    kinds = {c: df.schema[n].dataType.simpleString() for c, df, n in (("k", queries, key), ("c", rows, label))}

    def least(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks().sort_by("c")
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        kind = b.column("c").combine_chunks().dictionary_encode()
        first = np.flatnonzero(np.diff(kind.indices.to_numpy(), prepend=-1)) if len(b) else np.zeros(0, np.int64)
        if not len(a) or not len(b):
            return pa.table({"k": a.column("k").slice(0, 0), "c": b.column("c").slice(0, 0), "d": pa.array([], pa.float64())})
        x, y = matrix(a), matrix(b)
        d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)
        d = np.minimum.reduceat(d, first, axis=1)
        return pa.table({"k": a.column("k").take(pa.array(np.repeat(np.arange(len(a)), len(first)))), "c": b.column("c").take(pa.array(np.tile(first, len(a)))), "d": pa.array(d.ravel())})

    got = q.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInArrow(least, f"k {kinds['k']}, c {kinds['c']}, d double")
    return got.groupBy(F.col("k").alias(key), F.col("c").alias("cls")).agg(F.min("d").alias("dist2"))


def best_router(validation: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """One row (max_shots, min_margin, validation_accuracy): of the candidates, the first with the highest accuracy on rows
    (truth, ta, da, shots, margin). Candidates are counted side by side in one pass, so the rows are not multiplied."""
    right = lambda a, b: (F.col("truth") == route(F.col("ta"), F.col("da"), F.col("shots"), F.col("margin"), a, b)).cast("int")
    t = validation.agg(*[F.avg(right(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(grid)])
    each = F.array(*[F.struct(F.lit(a).alias("max_shots"), F.lit(b).alias("min_margin"), F.col(f"c{i}").alias("validation_accuracy"), F.round(f"c{i}", 9).alias("_by")) for i, (a, b) in enumerate(grid)])
    better = lambda best, x: F.when(best["_by"].isNull() | (x["_by"] > best["_by"]), x).otherwise(best)
    return t.select(F.reduce(F.slice(each, 2, len(grid)), F.get(each, F.lit(0)), better).alias("_best")).select("_best.*").drop("_by")


def evaluated(test: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per true class of rows not used for the choice: rows, those right by transport, directly and as routed, and those routed."""
    t = test.crossJoin(F.broadcast(chosen))  # one row
    use = (F.col("shots") <= F.col("max_shots")) & (F.col("margin") >= F.col("min_margin"))
    label = F.when(use, F.col("ta")).otherwise(F.col("da"))
    return t.groupBy("truth", *chosen.columns).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("truth") == c).alias(n) for n, c in (("transport_right", F.col("ta")), ("direct_right", F.col("da")), ("routed_right", label))], F.count_if(use).alias("routed"))
