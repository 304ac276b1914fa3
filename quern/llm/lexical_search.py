"""Ranked lexical search by a dual-tree traversal.

Documents and items are sparse vectors over the items' terms: a document's coordinate is the saturated, length-normalised
frequency of a term, an item's the weight of each of its terms, so a score is a dot product of whole numbers. Items form a
tree; the documents of a task form trees too, a chunk at a time. Every node holds the coordinate maxima of what lies below
it, so the dot product of two nodes bounds the score of every item below the one with every document below the other. Both
trees are descended together; a pair of nodes goes as soon as its bound is below the weakest k-th score so far among the
node's items. Bounds are exact integers, and only smaller ones are pruned, so ties are kept. The k best of each task are
merged in two rounds.

The items' terms are broadcast: items are dealt by hash into blocks of about `block_bytes` of terms (at least one item each),
and every block makes a pass over the documents. Memory in a task is bounded by a chunk and a block's index. The documents'
number, length and term frequencies are counted over all of them.

Null texts and texts without a term are no documents for the counts and are never found; items without a term have no rows.
Very long texts are counted whole. Every row of items is an item, every row of documents a document: repeated ones are
ranked each. Equal scores rank by id, null ids first. An empty table on either side gives no rows. Columns other than ids
and texts, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, materialise, small_batches
from quern.llm.decontaminate import words_of

#: Documents (and entries of their vectors) in a chunk, documents in a leaf.
CHUNK, ENTRIES, LEAF = 8_192, 4_000_000, 32
BLOCK_BYTES = 4 << 20


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def coordinate(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n_terms * n_docs // all_terms))


class Rows:
    """Sparse vectors one behind the other; row i is [start[i], start[i + 1])."""

    def __init__(self, term: np.ndarray, value: np.ndarray, start: np.ndarray) -> None:
        self.term, self.value, self.start = term, value, start

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[:-1][rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(self.term[at], self.value[at], start)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Of each row with a vector over all terms."""
        total = np.concatenate([[0], np.cumsum(self.value * dense[self.term])])
        return total[self.start[1:]] - total[self.start[:-1]]

    def maxima(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms that occur, and the greatest value of each."""
        order = np.argsort(self.term, kind="stable")
        term = self.term[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        return term[first], np.maximum.reduceat(self.value[order], first) if len(first) else self.value[:0]


class Tree:
    """A hierarchy over rows, halved down to `leaf` rows. Node i covers order[low[i]:high[i]], its children are kids[i]
    (-1: none), and maxima has a row for each node."""

    def __init__(self, rows: Rows, terms: int, leaf: int) -> None:
        self.order = np.arange(len(rows))
        low, high, kids, term, value = [0], [len(rows)], [], [], []
        dense = np.zeros(terms, np.int64)
        at = 0
        while at < len(low):
            own = self.order[low[at] : high[at]]
            part = rows.take(own)
            top = part.maxima()
            term.append(top[0])
            value.append(top[1])
            if len(own) <= leaf:
                kids.append((-1, -1))
            else:
                side = self._sides(part, dense)
                self.order[low[at] : high[at]] = own[np.argsort(side, kind="stable")]
                middle = low[at] + (len(own) + 1) // 2
                kids.append((len(low), len(low) + 1))
                low += [low[at], middle]
                high += [middle, high[at]]
            at += 1
        self.low, self.high, self.kids = np.array(low), np.array(high), np.array(kids)
        size = [len(t) for t in term]
        self.maxima = Rows(np.concatenate(term), np.concatenate(value), np.concatenate([[0], np.cumsum(size)]))

    @staticmethod
    def _sides(part: Rows, dense: np.ndarray) -> np.ndarray:
        """How much nearer each row is to one of two unlike rows than to the other."""

        def likeness(i: int) -> np.ndarray:
            lo, hi = part.start[i], part.start[i + 1]
            dense[part.term[lo:hi]] = part.value[lo:hi]
            out = part.dot(dense) / (1.0 + norms)
            dense[part.term[lo:hi]] = 0
            return out

        norms = np.sqrt(np.diff(np.concatenate([[0.0], np.cumsum(part.value.astype(float) ** 2)])[part.start]))
        one = int(np.argmin(likeness(int(np.argmax(norms)))))
        first = likeness(one)
        return likeness(int(np.argmin(first))) - first


class Search:
    """The k best documents of each item over the chunks seen so far."""

    def __init__(self, items: Rows, terms: int, k: int) -> None:
        self.k, self.terms = k, terms
        self.tree = Tree(items, terms, 1)
        self.items = items.take(self.tree.order)  # in the tree's order, so a node's items stand together
        self.best: list[list[tuple]] = [[] for _ in range(len(items))]
        self.kth = np.zeros(len(items) + 1, np.int64)
        self.dense = np.zeros(terms, np.int64)

    def _bounds(self, docs: Tree, node: int, items: np.ndarray) -> np.ndarray:
        lo, hi = docs.maxima.start[node], docs.maxima.start[node + 1]
        term = docs.maxima.term[lo:hi]
        self.dense[term] = docs.maxima.value[lo:hi]
        out = self.tree.maxima.take(items).dot(self.dense)
        self.dense[term] = 0
        return out

    def _open(self, items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of item nodes, those with an item that may still gain."""
        edges = np.stack([self.tree.low[items], self.tree.high[items]], 1).ravel()
        weakest = np.minimum.reduceat(self.kth, edges)[::2]
        return (bounds > 0) & (bounds >= weakest)

    def add(self, ids: list, rows: Rows) -> None:
        """Search one more chunk of documents."""
        if not len(rows) or not len(self.items):
            return
        docs = Tree(rows, self.terms, LEAF)
        start = np.zeros(1, np.int64)
        todo = [(0, start, self._bounds(docs, 0, start))]
        while todo:
            node, items, bounds = todo.pop()
            items = items[self._open(items, bounds)]
            if not len(items):
                continue
            kids = self.tree.kids[items]
            single = items[kids[:, 0] < 0]
            deeper = np.concatenate([single, kids[kids[:, 0] >= 0].ravel()])
            if docs.kids[node][0] >= 0:
                below = [(int(c), deeper, self._bounds(docs, int(c), deeper)) for c in docs.kids[node]]
                todo += sorted(below, key=lambda x: float(x[2].sum()))  # the more promising half first
            elif len(single) < len(items):
                todo.append((node, deeper, self._bounds(docs, node, deeper)))
            else:
                self._score(ids, rows, docs.order[docs.low[node] : docs.high[node]], self.tree.low[single])

    def _score(self, ids: list, rows: Rows, which: np.ndarray, items: np.ndarray) -> None:
        """Exact scores of a leaf's documents for some items."""
        part = rows.take(which)
        dense = np.zeros((len(which), self.terms), np.int64)
        dense[np.repeat(np.arange(len(which)), np.diff(part.start)), part.term] = part.value
        for i in items.tolist():
            lo, hi = self.items.start[i], self.items.start[i + 1]
            scores = dense[:, self.items.term[lo:hi]] @ self.items.value[lo:hi]
            found = np.flatnonzero((scores > 0) & (scores >= self.kth[i]))
            if len(found):
                best = self.best[i] + [(-int(scores[f]), ids[which[f]] is not None, ids[which[f]]) for f in found]
                best.sort(key=lambda x: x[:2] if x[2] is None else x)
                self.best[i] = best[: self.k]
                if len(best) >= self.k:
                    self.kth[i] = -self.best[i][-1][0]


def _terms(items: DataFrame) -> DataFrame:
    """(row, terms, size) of items (row, text): distinct terms and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(words_of(t))) for t in batch.column(1).to_pylist()]
            size = [sum(map(len, t)) + 16 * len(t) for t in terms]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array(size, pa.int64())], ["row", "terms", "size"])

    return small_batches(items).mapInArrow(run, "row long, terms array<binary>, size long")


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs): number of terms with repeats, and those of the vocabulary with their frequencies, of each text with a term."""
    kind = docs.schema[0].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            rows, sizes, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if words:
                    counts = Counter(words)
                    own = sorted((number[w], counts[w]) for w in counts.keys() & number.keys())
                    rows.append(i)
                    sizes.append(len(words))
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["id", "n", "terms", "tfs"]
            )

    return small_batches(docs).mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def _pass(slim: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """(row, id, score) of the k best documents for each item of a block."""
    spark, kind = slim.sparkSession, slim.schema[0].dataType.simpleString()
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, terms in block for w in terms}))}
    found = materialise(vectors(slim, vocabulary), "vectors")
    n_docs, all_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's vocabulary
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    of = [np.array([vocabulary[w] for w in terms], np.int64) for _, terms in block]
    term = np.concatenate(of)
    items = spark.sparkContext.broadcast((Rows(term, weights[term], np.concatenate([[0], np.cumsum([len(t) for t in of])])), np.array([r for r, _ in block], np.int64)))
    size = len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = items.value
        best, type_ = Search(own, size, k), None
        ids, parts, entries = [], [], 0

        def add() -> None:
            if parts:
                lengths = np.concatenate([p[0] for p in parts])
                best.add(ids, Rows(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([[0], np.cumsum(lengths)])))

        for batch in batches:
            type_ = batch.schema.field(0).type
            n, terms, tfs = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            lengths = np.diff(terms.offsets.to_numpy())
            tf = tfs.flatten().to_numpy().astype(np.int64)
            value = coordinate(tf, np.repeat(n, lengths), n_docs, all_terms)
            ids += batch.column(0).to_pylist()
            parts.append((lengths, terms.flatten().to_numpy().astype(np.int64), value))
            entries += len(tf)
            if len(ids) >= CHUNK or entries >= ENTRIES:
                add()
                ids, parts, entries = [], [], 0
        add()
        if type_ is not None:
            out = [(names[best.tree.order[i]], x[2], -x[0]) for i, top in enumerate(best.best) for x in top]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], type_), pa.array([o[2] for o in out], pa.int64())], ["row", "id", "score"])

    return found.filter(F.size("terms") > 0).mapInArrow(search, f"row long, id {kind}, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents (doc_id, text) of each item (item_id, text), all with a score above 0."""
    spark = docs.sparkSession
    listed = materialise(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "items")
    terms = materialise(_terms(listed.select("row", "text")).filter(F.size("terms") > 0), "terms")
    blocks = -(-(terms.agg(F.sum("size")).first()[0] or 0) // block_bytes)
    slim = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], f"row long, id {slim.schema[0].dataType.simpleString()}, score long")
    for b in range(blocks):
        block = terms.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms").collect()
        if block:
            best = materialise(_pass(slim, [(r.row, [bytes(t) for t in r.terms]) for r in block], k), "best")
            found = best if b == 0 else found.unionByName(best)
    order = (F.col("score").desc(), F.col("id").asc_nulls_first())
    # Each task gives k rows an item at most: merged in 64 groups, then whole.
    salt, rank = fresh(found, "salt", "rank")
    near = found.withColumn(salt, F.pmod(F.xxhash64("id"), F.lit(64)))
    near = near.withColumn(rank, F.row_number().over(Window.partitionBy("row", salt).orderBy(*order))).filter(F.col(rank) <= k)
    top = near.withColumn(rank, F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col(rank) <= k)
    return top.join(listed.select("row", "item_id"), "row").select("item_id", F.col(rank).alias("rank"), F.col("id").alias("doc_id"), "score")


def brute_force(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """Reference for tests: item_id, rank, doc_id, score."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, all_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 10 + 90 * n * n_docs // all_terms
            score = sum(weight(n_docs, df[w]) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words_of(text)) if w in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out
