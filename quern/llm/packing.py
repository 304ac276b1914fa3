"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids and an end id; only documents longer than a sequence are cut, their first piece taking
the remainder, so every other piece is full. A sequence's configuration says how many pieces of each length it
holds. The covering program (fewest sequences whose configurations hold every piece) is solved by multiplicative weights:
each length has a price, a knapsack dynamic program finds the dearest configuration, and prices of lengths it serves fall.
Prices over the value of the dearest configuration are a dual solution, so they also bound the number of sequences from below.

Prices proportional to the lengths come first: full configurations are tight there, and where they hold nearly all pieces the
bound of tokens / capacity is met. Otherwise prices are fitted, over at most CLASSES classes of lengths, and configurations of any
fill are taken by them: once as the averaged solution rounded down, once one after the other. What is left over goes by best
fit, longest first; of all these plans the one with the fewest sequences is used, so none is worse than best fit.

All of that sees the histogram only, at most `capacity` numbers however many rows there are. Pieces find their
place by their rank within their length, counted per partition and added up, so no length gathers in one task.

Null texts are empty (one piece: the end id); very long texts are encoded whole and cut into pieces; equal pieces are
interchangeable and placed in the order of their partitions; repeated rows are packed each; an empty table packs to
nothing. `pack` keeps other columns, but replaces columns named sequence_id and offset.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, small_batches

#: The split of the byte-level vocabulary: fixed values.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters two regular-expression libraries may differ; such texts go to the tokenizer itself.
_ODD = re.compile("[^\\x00-\\x1b -\\x7e\\xa1-\\u0377\\u0384-\\u0481\\u2010-\\u2027\\u2030-\\u205e\\u20ac]|<\\|")


class Encoder:
    """ids of texts by the tokenizer file. Its vocabulary and merges are read from the file; a merge's rank is the id of
    what it makes, so a faster merger gives equal ids wherever the split into words cannot differ."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # printable stand-ins of bytes in the vocabulary: a rule
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = self.tokenizer.token_to_id("<|endoftext|>")
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i != special}
        self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if _ODD.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (null unless keep_ids) and ids_crc32 of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = np.array([*encoder.encode(text.as_py() or ""), end_id], "<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k in range(len(edges) - 1):
                        own = ids[edges[k] : edges[k + 1]]
                        row.append(i)
                        piece.append(k)
                        start.append(edges[k])
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        kept.append(own if keep_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(kept, pa.list_(pa.int32())), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "ids_crc32"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids array<int>, ids_crc32 long")


def price_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int, bound: np.ndarray) -> np.ndarray:
    """Knapsack by dynamic programming: counts of each size within capacity that maximise the summed prices."""
    best = np.zeros(capacity + 1)
    take: list[tuple[int, int, int, np.ndarray]] = []
    for i in np.argsort(-sizes):
        left, step = int(min(bound[i], capacity // sizes[i])), 1
        while left > 0:  # binary splitting of the bound
            k = min(step, left)
            w = int(sizes[i]) * k
            if w > capacity:
                break
            with_it = best[: capacity + 1 - w] + prices[i] * k
            better = with_it > best[w:] + 1e-15
            take.append((int(i), k, w, better))
            np.copyto(best[w:], with_it, where=better)
            left, step = left - k, step * 2
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for i, k, w, better in reversed(take):
        if room >= w and better[room - w]:
            counts[i] += k
            room -= w
    return counts


def linear_program(need: dict[int, int], capacity: int, least: float = 1 / 32, among: tuple[int, ...] = (48, 192), eps: float = 0.3) -> Iterator[tuple[dict[int, int], int, dict[int, int]]]:
    """Configurations, the whole times each is used, and what is then left of each length.

    Prices start at the lengths (over capacity: a feasible dual, whose value is tokens / capacity) and fall by
    exp(-eps * served share). A knapsack gives each round's configuration, among `among` lengths, the half of them the least
    served and the others of chance, or else more, or else all.
    Only full ones are used, which are tight in the dual (gap 0), as often as no length is served over; rounds go on
    while there is one and more than `least` of the pieces are left.
    """
    sizes = np.array(sorted(need), np.int64)
    whole = np.array([need[s] for s in sizes.tolist()], np.int64)
    rest, rng = whole.copy(), np.random.default_rng(5)
    while rest.sum() > least * whole.sum():
        open_ = np.flatnonzero(rest)
        served = 1 - rest / whole
        order = open_[np.lexsort((rng.random(len(open_)), np.floor(served[open_] * 8)))]
        chance = rng.permutation(order)
        for own in (*(np.union1d(order[: k // 2], chance[: k // 2]) for k in among if k < len(order)), order):
            weight = np.exp(-eps * served[own]) * (1 + sizes[own] / capacity)  # long pieces first
            counts = price_configuration(sizes[own], sizes[own] * (1 + weight / (4 * capacity)), capacity, rest[own])
            full = counts @ sizes[own] == capacity  # the weights only choose among the fullest
            if full:
                break
        if not full:
            break
        used = counts > 0
        n = int((rest[own][used] // counts[used]).min())
        rest[own] -= counts * n
        yield {int(s): int(k) for s, k in zip(sizes[own][used], counts[used], strict=True)}, n, dict(zip(sizes[rest > 0].tolist(), rest[rest > 0].tolist(), strict=True))


#: Classes of lengths of the fitted prices, rounds of fitting and of taking, the gap at which fitting stops, the excess over the bound that is good enough.
CLASSES, ROUNDS, GAP, ENOUGH = 64, 600, 1 / 512, 1 / 1024


def classes(sizes: np.ndarray, counts: np.ndarray, k: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most k classes of neighbouring lengths with about equal tokens: smallest length and pieces of each, and the class of each length."""
    if len(sizes) <= k:
        return sizes, counts.astype(float), np.arange(len(sizes))
    mass = np.cumsum(counts * sizes)
    of = np.unique((mass - counts * sizes) * k // mass[-1], return_inverse=True)[1]
    return np.array([sizes[of == i].min() for i in range(of.max() + 1)]), np.bincount(of, weights=counts), of


def covering(sizes: np.ndarray, need: np.ndarray, capacity: int, eps: float = 0.25) -> tuple[float, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Multiplicative weights for the covering program: a lower bound, its dual prices, and configurations with the (fractional) times of a solution.

    A round uses the dearest configuration for eps of what it can serve at most; prices fall by exp(-eps * share of the need).
    The bound holds for longer pieces too: with the smallest lengths of classes it is a bound for all lengths.
    """
    most = np.minimum(need.astype(np.int64), capacity)
    prices, served, total = sizes / capacity, np.zeros(len(sizes)), 0.0
    bound, dual, used = 0.0, prices, {}
    for _ in range(ROUNDS):
        counts = price_configuration(sizes, prices, capacity, most)
        value = float(counts @ prices)
        if need @ prices / value > bound:
            bound, dual = float(need @ prices / value), prices / value
        on = counts > 0
        times = float((need[on] / counts[on]).min()) * eps
        used[counts.tobytes()] = used.get(counts.tobytes(), 0.0) + times
        served, total = served + counts * times, total + times
        prices = prices * np.exp(-eps * counts * times / need)
        least = (served / need).min()
        if least > 0 and total / least <= bound * (1 + GAP):
            break
    scale = max((served / need).min(), 1e-9)
    return bound, dual, [(np.frombuffer(c, np.int64), t / scale) for c, t in used.items()]


def _rounded(sizes: np.ndarray, need: np.ndarray, solution: list[tuple[np.ndarray, float]]) -> tuple[list, dict[int, int]]:
    """Configurations of a solution whole times, most used first, as far as pieces are left; and the pieces left."""
    rest, out = need.astype(np.int64), []
    for counts, times in sorted(solution, key=lambda x: -x[1]):
        on = counts > 0
        n = min(int(times), int((rest[on] // counts[on]).min()))
        if n:
            rest = rest - counts * n
            out.append(({int(s): int(k) for s, k in zip(sizes[on], counts[on], strict=True)}, n))
    return out, {int(s): int(k) for s, k in zip(sizes, rest, strict=True) if k}


def _taken(sizes: np.ndarray, need: np.ndarray, prices: np.ndarray, capacity: int, among: int = 128) -> tuple[list, dict[int, int]]:
    """Dear configurations one after the other, each as often as its pieces last; and the pieces left after ROUNDS. A round
    looks at the least served lengths and at others of chance; among equally dear configurations it takes the fullest."""
    rest, rng, out = need.astype(np.int64), np.random.default_rng(5), []
    for _ in range(ROUNDS):
        open_ = np.flatnonzero(rest)
        if not len(open_):
            break
        share = 1 - rest[open_] / need[open_]
        own = open_[np.lexsort((rng.random(len(open_)), np.floor(share * 8)))]
        if len(own) > among:
            own = np.union1d(own[: among // 2], rng.permutation(own)[: among // 2])
        worth = (prices[own] + sizes[own] / (1000 * capacity)) * (1 + 0.02 * np.exp(rest[own] / need[own] - 1))
        counts = price_configuration(sizes[own], worth, capacity, np.minimum(rest[own], capacity))
        on = counts > 0
        n = int((rest[own][on] // counts[on]).min())
        rest[own] -= counts * n
        out.append(({int(s): int(k) for s, k in zip(sizes[own][on], counts[on], strict=True)}, n))
    return out, {int(s): int(k) for s, k in zip(sizes, rest, strict=True) if k}


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """plan's answer, and a lower bound of the number of sequences that any plan needs."""
    whole = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    left = {s: n for s, n in histogram.items() if 0 < s < capacity and n > 0}
    count = lambda p: sum(n for _, n in p)
    best, bound = _tight(left, capacity), -(-sum(s * n for s, n in left.items()) // capacity)
    if left and count(best) > bound * (1 + ENOUGH):
        sizes = np.array(sorted(left), np.int64)
        need = np.array([left[s] for s in sizes.tolist()], np.int64)
        low, pieces, of = classes(sizes, need)
        fitted, prices, solution = covering(low, pieces, capacity)
        bound = max(bound, math.ceil(fitted - 1e-6))
        plans = [_taken(sizes, need, prices[of], capacity)]
        if len(low) == len(sizes):
            plans.append(_rounded(sizes, need, solution))
        best = min([best, *(out + _greedy(rest, capacity) for out, rest in plans)], key=count)
    return whole + best, count(whole) + bound


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences): holds every piece of the histogram once."""
    return solve(histogram, capacity)[0]


def _tight(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The plan of full configurations. Best fit is tried each time the pieces left over have halved; where the fewest sequences come out it takes over."""
    placed, end = [], _greedy(dict(left), capacity)
    best, at, tried, over = sum(n for _, n in end), 0, sum(left.values()), left
    count = lambda p: sum(n for _, n in p)
    for config, n, over in linear_program(left, capacity):
        placed.append((config, n))
        if 2 * sum(over.values()) <= tried:
            tried, last = sum(over.values()), _greedy(dict(over), capacity)
            if count(placed) + count(last) <= best:
                best, at, end = count(placed) + count(last), len(placed), last
    last = _greedy(dict(over), capacity)
    if count(placed) + count(last) <= best:
        at, end = len(placed), last
    return placed[:at] + end


def _greedy(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit on counts: the longest piece opens a sequence, the longest that still fits goes on; like sequences in one step."""
    out, sizes = [], sorted(left)
    while sizes:
        config: dict[int, int] = {}
        room, i = capacity, len(sizes)
        while i:
            i = bisect.bisect_right(sizes, room, 0, i)
            if not i:
                break
            s = sizes[i - 1]
            k = min(left[s], room // s)
            config[s] = k
            room -= k * s
            i -= 1
        n = min(left[s] // k for s, k in config.items())
        for s, k in config.items():
            left[s] -= k * n
            if not left[s]:
                sizes.remove(s)
        out.append((config, n))
    return out


def slots(planned: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, and the sequence and offset that the first rank of the stretch gets."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for config, n in planned:
        offset = 0
        for s in sorted(config, reverse=True):
            for _ in range(config[s]):
                rows.setdefault(s, []).append((used.get(s, 0), base, offset))
                used[s] = used.get(s, 0) + n
                offset += s
        base += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """All columns of `pieces` (with `length`, 1 to capacity), and sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = pieces.select(F.struct(*[f"`{c}`" for c in pieces.columns if c not in ("sequence_id", "offset")]).alias("row"), F.col("length").cast("long").alias("length"))
    kind = pieces.schema["row"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = pd.Series(batch.column(1).to_numpy(zero_copy_only=False))
            own = n.groupby(n).cumcount().to_numpy() + seen[n.to_numpy()]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part), pa.int32()), pa.array(own, pa.int64())], ["row", "length", "part", "rank"])

    ranked = materialise(pieces.mapInArrow(rank, f"row {kind}, length long, part int, rank long"), "pieces")
    counts = materialise(ranked.groupBy("length", "part").agg((F.max("rank") + 1).alias("n")), "counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    from pyspark.sql import Window

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, r: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        n, rank_ = length.to_numpy(), r.to_numpy()
        for s in np.unique(n):
            first, base, offset = table.value[int(s)]
            own = np.flatnonzero(n == s)
            k = np.searchsorted(first, rank_[own], "right") - 1
            seq[own], off[own] = base[k] + rank_[own] - first[k], offset[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    # The table of counts grows with the partitions, so it is merged, never broadcast; no key has more rows than a partition.
    out = ranked.join(before.hint("merge"), ["length", "part"]).select("row", place("length", F.col("rank") + F.col("before")).alias("place"))
    return out.select("row.*", "place.sequence_id", "place.offset")
