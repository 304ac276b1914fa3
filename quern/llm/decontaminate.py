"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams against every training window.

Words are maximal runs of [0-9a-z] and non-ASCII characters after A-Z is lower-cased. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window. Every occurrence of a
window in a document is verified word by word, and its words are hit.

Null texts have no words; null item ids are named "null"; repeated items count once; an empty benchmark
hits nothing; very long texts are scanned whole, and very long items indexed whole, in segments; repeated documents are
each scanned; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, small_batches

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_M = 0x9E3779B97F4A7C15 | 1
#: Words that are handled at a time inside a task.
_CHUNK = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _roll(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for i in range(n):
        h = h * np.uint64(_M) + ids[starts + i].astype(np.uint64)
    return h


class Index:
    """The windows of some benchmark text, by length, as sorted hashes that point into one array of word numbers."""

    def __init__(self, rows: list[tuple[str, str]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in rows})
        place = {name: i for i, name in enumerate(self.names)}
        parts = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in text.encode("utf-8", "surrogatepass").split()], np.int32) for _, text in rows]
        owner = np.array([place[name] for name, _ in rows], np.int32)
        size = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(size) - size
        self.tokens = np.concatenate([*parts, np.zeros(0, np.int32)])
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(size, window)).tolist():
            own = np.flatnonzero(np.minimum(size, window) == n)
            many = size[own] - n + 1
            starts = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            who = np.repeat(owner[own], many)
            h = _roll(self.tokens, starts, n)
            order = np.lexsort((who, _roll(self.tokens[::-1], len(self.tokens) - n - starts, n), h))
            h, starts, who = h[order], starts[order], who[order]
            new = np.ones(len(h), bool)  # equal windows stand together
            new[1:] = (self.tokens[starts[1:, None] + np.arange(n)] != self.tokens[starts[:-1, None] + np.arange(n)]).any(1)
            use = new.copy()
            use[1:] |= who[1:] != who[:-1]  # an item owns a window once
            group = np.cumsum(new)[use] - 1
            self.by_length.append((n, h[new], starts[new], np.searchsorted(group, np.arange(new.sum() + 1)), who[use]))

    def __getstate__(self) -> tuple:
        return b" ".join(self.words), self.names, self.tokens, self.by_length

    def __setstate__(self, state: tuple) -> None:
        words, self.names, self.tokens, self.by_length = state
        self.words = {w: i + 1 for i, w in enumerate(words.split())}

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mask of hit words, and positions and items of the verified windows; id 0 is in no window."""
        hit = np.zeros(len(ids) + 1, np.int64)
        at, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, hashes, places, owned, owners in self.by_length:
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            h = _roll(ids, starts, n)
            k = np.searchsorted(hashes, h)
            while len(starts):  # windows that share a hash stand side by side
                same = k < len(hashes)
                same[same] = hashes[k[same]] == h[same]
                starts, k, h = starts[same], k[same], h[same]
                true = (ids[starts[:, None] + np.arange(n)] == self.tokens[places[k][:, None] + np.arange(n)]).all(1)
                found, own = starts[true], k[true]
                np.add.at(hit, found, 1)
                np.add.at(hit, found + n, -1)
                many = owned[own + 1] - owned[own]
                at.append(np.repeat(found, many))
                who.append(owners[np.repeat(owned[own] - np.cumsum(many) + many, many) + np.arange(many.sum())])
                k = k + 1
        return np.cumsum(hit[:-1]) > 0, np.concatenate(at), np.concatenate(who)


def _scan(index, keep_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        get = ix.words.get
        for batch in batches:
            texts = batch.column(1)
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items", "spans", "clean")}
            lo = 0
            while lo < len(texts):
                docs, size, hi = [], 0, lo
                while hi < len(texts) and size < _CHUNK:
                    docs.append(words_of(texts[hi].as_py()))
                    size += len(docs[-1]) + 1
                    hi += 1
                lens = np.array([len(d) for d in docs])
                first = np.concatenate([[0], np.cumsum(lens + 1)])
                ids = np.zeros(first[-1], np.int64)
                flat = np.fromiter(map(get, chain.from_iterable(docs), repeat(0)), np.int64, int(lens.sum()))
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(docs)), lens)] = flat
                mask, at, who = ix.scan(ids)
                items: list[set[int]] = [set() for _ in docs]
                for i, j in zip((np.searchsorted(first, at, "right") - 1).tolist(), who.tolist(), strict=True):
                    items[i].add(j)
                count = np.add.reduceat(np.append(mask, False).astype(np.int64), first[:-1]) if len(docs) else []
                for i in range(len(docs)):
                    out["n_words"].append(int(lens[i]))
                    out["n_hit"].append(int(count[i]))
                    out["items"].append(sorted(ix.names[j] for j in items[i]))
                    spans = []
                    if keep_spans and count[i]:
                        m = np.diff(np.concatenate([[0], mask[first[i] : first[i] + lens[i]].astype(np.int8), [0]]))
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(m == 1), np.flatnonzero(m == -1), strict=True)]
                    out["spans"].append(spans)
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())),
                 pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return run


def segments(benchmark: DataFrame, window: int, most: int = 10_000) -> DataFrame:
    """(name, text, bytes): normalised words of the items, those of more than `most` words in stretches that overlap by a
    window less one word, so that the windows are the same; bytes is what a worker needs at most to hold the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, sizes = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for lo in range(0, max(len(words) - window + 1, min(1, len(words))), most):
                    own = words[lo : lo + most + window - 1]
                    names.append(name)
                    texts.append(b" ".join(own).decode("utf-8", "surrogatepass"))
                    sizes.append(200 * len(own) + len(texts[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["name", "text", "bytes"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text"))
    return materialise(small_batches(named).mapInArrow(run, "name string, text string, bytes long").distinct(), "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, part_bytes: int = 64 << 20, keep_spans: bool = False, segment: int = 10_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted names), spans of hit words (if asked for).

    The index of the benchmark's windows is broadcast if a worker holds it within `part_bytes` (about two bytes of text in
    64). A larger benchmark is cut by a hash of its items' segments into parts of about that size; every part is broadcast
    in a pass of its own and the passes' spans and items are united per document, so the result is the same.
    """
    spark = docs.sparkSession
    bench = segments(benchmark, window, segment)
    total = bench.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"

    def one(of: DataFrame, slim: DataFrame, spans: bool) -> DataFrame:
        index = spark.sparkContext.broadcast(Index([(r["name"], r["text"]) for r in of.select("name", "text").collect()], window))  # bounded by part_bytes
        return slim.mapInArrow(_scan(index, spans), schema)

    slim = small_batches(docs).select("doc_id", "text")
    if parts == 1:
        return one(bench, slim, keep_spans)
    rows = materialise(slim.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "rows")
    schema = schema.replace(f"doc_id {kind}", "doc_id long")
    found = None
    for p in range(parts):
        got = one(bench.filter(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == p), rows.select("_row", "text"), True)
        found = got if found is None else found.union(got)
    spans = F.aggregate(  # sorted spans, united
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<start: long, end: long>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    united = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("spans"))
    united = united.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))
    return rows.select("doc_id", "_row").join(united.withColumnRenamed("doc_id", "_row"), "_row").select("doc_id", "n_words", "n_hit", "items", "spans")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def brute_force(docs: list[tuple], bench: list[tuple], window: int = 13) -> dict:
    """Reference for tests: {doc_id: (n_words, n_hit, sorted items)} by comparing all windows."""
    out = {}
    for doc_id, text in docs:
        w = words_of(text)
        hit, items = set(), set()
        for item, t in bench:
            b = words_of(t)
            n = min(window, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    items.add("null" if item is None else str(item))
        out[doc_id] = (len(w), len(hit), sorted(items))
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
