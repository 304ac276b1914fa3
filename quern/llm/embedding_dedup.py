"""Embedding near-duplicates with an inverted multi-index.

Vectors are cut into two halves; each half has its own codebook, so their product is a grid of cells. A vector lives in
its nearest cell and visits cells by multi-sequence traversal: in the order of a bound on how far a point must move to
fall into the cell, until the bound exceeds a radius. Candidates are verified by cosine in double precision.

The radius is calibrated to `target_recall` on pairs that a sample of query vectors has against all rows, where every
group of linked vectors weighs the same. With a target of 1 it is the exact one, the squared distance 2 - 2 * threshold
of a pair at the threshold, and no link is lost; on vectors without structure that visits nearly all cells.

Exact copies are counted first and travel as one vector. Cells are cut into blocks of at most `block` members times
`block` visitors; a block counts links and returns spanning edges, never pairs.

Sampling bounds (parameters): `sample` vectors train the codebooks, which have at most an eighth as many centroids each,
and `queries` vectors calibrate the radius. Raise them with the data: cells hold about 32 vectors up to
32 * (sample / 8) ** 2 vectors.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, link with
nothing. Vectors of different lengths never link. Ids are numbers. Repeated rows count as further vectors. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, hot_keys, join_hot, materialise, star_edges


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray
    radius2: float = 0.0

    def bounds(self, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid, and for each centroid the squared distance to the plane beyond which it is nearer."""
        d = (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)
        near = d.argmin(1)
        gap = np.sqrt(np.maximum(((book[near][:, None] - book[None]) ** 2).sum(2), 1e-30)) if len(book) <= 64 else np.sqrt(np.maximum(self._apart(book)[near], 1e-30))
        h = np.maximum(d - d[np.arange(len(x)), near][:, None], 0) / (2 * gap)
        h[np.arange(len(x)), near] = 0
        return near, h**2

    @staticmethod
    def _apart(book: np.ndarray) -> np.ndarray:
        n = (book**2).sum(1)
        return n[:, None] + n - 2 * book @ book.T

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        n1, h1 = self.bounds(x[:, :half], self.first)
        n2, h2 = self.bounds(x[:, half:], self.second)
        return n1, n2, h1, h2

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell of each vector, and the cells it visits by multi-sequence traversal, nearest first."""
        n1, n2, h1, h2 = self.own(x)
        k, out = len(self.second), []
        for r in range(len(x)):
            a, b = np.flatnonzero(h1[r] <= self.radius2), np.flatnonzero(h2[r] <= self.radius2)
            if len(a) == 1 and len(b) == 1:
                out.append([int(n1[r] * k + n2[r])])
                continue
            a, b = a[np.argsort(h1[r][a], kind="stable")], b[np.argsort(h2[r][b], kind="stable")]
            u, v = h1[r][a], h2[r][b]
            heap, seen, cells = [(0.0, 0, 0)], {(0, 0)}, []
            while heap:
                s, i, j = heapq.heappop(heap)
                if s > self.radius2:
                    break
                cells.append(int(a[i] * k + b[j]))
                for p, q in ((i + 1, j), (i, j + 1)):
                    if p < len(a) and q < len(b) and (p, q) not in seen:
                        seen.add((p, q))
                        heapq.heappush(heap, (u[p] + v[q], p, q))
            out.append(cells)
        return n1 * k + n2, out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book[n > 0] = total[n > 0] / n[n > 0][:, None]
    return np.unique(book, axis=0)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sampled(df: DataFrame, n: int, bound: int, salt: str) -> np.ndarray:
    part = df if n <= bound else df.filter(F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1_000_000_000)) < int(bound / n * 1_000_000_000))
    rows = part.select("v").toPandas()["v"]
    return unit(np.stack(rows.to_list())) if len(rows) else np.zeros((0, 0))


def exact_radius2(threshold: float) -> float:
    """No linked pair has a larger bound: within a half it is at most the squared distance of the two vectors there."""
    return 2 - 2 * threshold + 1e-9


def calibrate(distinct: DataFrame, books: Codebooks, q: np.ndarray, threshold: float, target: float) -> float:
    """Squared radius at which `target` of the linked pairs of the queries q against all rows are visited.

    A query with d pairs gives each the weight 1 / d^2, so a group weighs the same however many vectors it has, and
    the target is reached in each quarter of the allowed distance on its own. No linked pair lies beyond 2 - 2 * threshold.
    """
    edges = np.concatenate([[0.0], np.geomspace(1e-4, 1.0, 60), [np.inf]])
    limit = 2 - 2 * threshold
    sent = distinct.sparkSession.sparkContext.broadcast((books, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own_books, queries = sent.value
        _, _, h1, h2 = own_books.own(queries)
        total = np.zeros(len(queries) * 4 * len(edges))
        for batch in batches:
            x = unit(_matrix(batch.column(0)))
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                cosine = queries @ part.T
                i, j = np.nonzero(cosine >= threshold)
                n1, n2, _, _ = own_books.own(part)
                other = np.abs(queries[i] - part[j]).max(1) > 0  # not itself
                s = (h1[i, n1[j]] + h2[i, n2[j]])[other]
                band = np.clip((2 - 2 * cosine[i, j][other]) / max(limit, 1e-12) * 4, 0, 3).astype(np.int64)
                np.add.at(total, (i[other] * 4 + band) * len(edges) + np.searchsorted(edges, s), 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["bin", "n"])

    rows = distinct.select("v").mapInArrow(run, "bin long, n double").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    n = np.zeros((len(q), 4, len(edges)))
    for r in rows:
        n.flat[r["bin"]] = r["n"]
    d = np.maximum(n.sum((1, 2)), 1)
    weight = (n / d[:, None, None] ** 2).sum(0)
    ends = [edges[np.searchsorted(np.cumsum(w), target * w.sum())] for w in weight if w.sum() > 0]
    radius2 = min(max(ends, default=0.0), limit) * 1.1 + 1e-9
    if weight.sum() < 30 and len(q):  # too few groups: also neighbours at the threshold itself, in random directions
        rng = np.random.default_rng(11)
        x = q[: min(len(q), 512)]
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        y = threshold * x + np.sqrt(1 - threshold**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-30)
        _, _, h1, h2 = books.own(x)
        n1, n2, _, _ = books.own(y)
        r = np.arange(len(x))
        radius2 = max(radius2, float(np.quantile(h1[r, n1] + h2[r, n2], target)) * 1.1 + 1e-9)
    return float(min(radius2, exact_radius2(threshold)))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, target_recall: float = 0.99, sample: int = 20_000, queries: int = 1_024, block: int = 1_024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links (other vectors found with cosine >= threshold), component_id (smallest linked id), kept."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = materialise(vectors.select(F.col(id_col).alias("id"), F.when(good, v).alias("v")), "vectors")
    distinct = materialise(rows.filter("v is not null").groupBy("v").agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    sizes = distinct.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length
    partial = None
    for dim, n in sizes:
        own = distinct.filter(F.size("v") == dim)
        k = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(n / 32)))), 1, max(1, sample // 8)))
        x = _sampled(own, n, sample, "books")
        half = dim // 2
        books = Codebooks(kmeans(x[:, :half], k), kmeans(x[:, half:], k))
        books.radius2 = exact_radius2(threshold) if target_recall >= 1 else calibrate(own, books, _sampled(own, n, queries, "queries"), threshold, target_recall)
        got = _link(own, books, threshold, block, int(dim))
        partial = got if partial is None else partial.unionByName(got)
    if partial is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    partial = materialise(partial, "links")
    links = partial.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(partial.filter("root is not null and root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    labels = distinct.select("v", "rep", "n", "node").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labels.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = labels.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    linked = join_hot(rows.filter("v is not null"), labels, "v", hot_keys(distinct, "v"), ["id"]).select("id", "n_links", "component_id")
    alone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _link(distinct: DataFrame, books: Codebooks, threshold: float, block: int, dim: int) -> DataFrame:
    """(node, links, root): verified links of each vector by block, counting copies, and spanning edges."""
    spark = distinct.sparkSession
    sent = spark.sparkContext.broadcast(books)
    kind = distinct.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                own, cells = sent.value.visits(unit(_matrix(part.column(2))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(own), pa.array(cells, pa.list_(pa.int64()))], ["node", "n", "v", "own", "cells"])

    placed = materialise(distinct.select("node", "n", "v").mapInArrow(assign, f"node long, n long, v {kind}, own long, cells array<long>"), "placed")
    visits = placed.select("node", F.explode("cells").alias("cell"))
    stats = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("visitors")).join(placed.groupBy(F.col("own").alias("cell")).agg(F.count(F.lit(1)).alias("members")), "cell")
    stats = materialise(stats.select("cell", F.expr(f"cast(ceil(members / {block}) as int)").alias("mb"), F.expr(f"cast(ceil(visitors / {block}) as int)").alias("vb")), "cells")
    at = lambda n: F.pmod(F.col("node"), F.col(n)).cast("int")
    members = placed.withColumn("cell", F.col("own")).join(stats, "cell").select("cell", at("mb").alias("m"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("w"), F.lit(True).alias("member"), "node", "n", "v", "own", "cells")
    visitors = placed.withColumn("cell", F.explode("cells")).join(stats, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), at("vb").alias("w"), F.lit(False).alias("member"), "node", "n", "v", "own", F.lit(None).cast("array<long>").alias("cells"))

    def verify(table: pa.Table) -> pa.Table:
        member = table.column("member").combine_chunks().to_numpy(zero_copy_only=False)
        table = table.combine_chunks()
        m, w = table.filter(pa.array(member)), table.filter(pa.array(~member))
        if not len(m) or not len(w):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        get = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        x, y = unit(_matrix(m.column("v").combine_chunks())), unit(_matrix(w.column("v").combine_chunks()))
        cell = table.column("cell")[0].as_py()
        ids, jds, ni, nj, home = get(m, "node"), get(w, "node"), get(m, "n"), get(w, "n"), get(w, "own")
        near = (x @ y.T >= threshold) & (ids[:, None] != jds)
        # A pair whose members visit each other's cells is met twice: each side counts at its own visit.
        kinds, back = np.unique(home, return_inverse=True)
        col = m.column("cells").combine_chunks()
        flat, row = col.flatten().to_numpy(), np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
        k = np.searchsorted(kinds, flat)
        k[k == len(kinds)] = 0
        visits_home = np.zeros((len(ids), len(kinds)), bool)
        true = kinds[k] == flat
        visits_home[row[true], k[true]] = True
        once = near & ~visits_home[:, back]
        i, j = np.nonzero(near)
        # The edges of a block: one spanning forest.
        p, q = star_edges(ids[i], jds[j])
        node = np.concatenate([jds, ids, p])
        links = np.concatenate([ni @ near, once @ nj, np.zeros(len(p), np.int64)])
        root = np.concatenate([jds, ids, q])
        use = (links > 0) | (root != node)
        return pa.table({"node": pa.array(node[use]), "links": pa.array(links[use]), "root": pa.array(root[use])})

    del dim
    return members.unionByName(visitors).groupBy("cell", "m", "w").applyInArrow(verify, "node long, links long, root long")


def brute_force(rows: list[tuple[int, list[float] | None]], threshold: float = 0.9) -> dict[int, tuple[int, int]]:
    """Reference for tests: id to (n_links, component_id) by comparing all pairs."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {i: (0, i) for i, _ in rows}
    for dim in {len(v) for _, v in ok}:
        ids = np.array([i for i, v in ok if len(v) == dim])
        x = unit(np.stack([v for _, v in ok if len(v) == dim]))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        label = ids.copy()
        while True:
            new = np.minimum(label, np.where(near, label[None], np.iinfo(np.int64).max).min(1))
            if np.array_equal(new, label):
                break
            label = new
        out |= {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label, strict=True)}
    return out
