"""Substring dedup by recompression.

Documents are sequences of words. Rounds rename runs of equal symbols, then pairs of neighbours whose classes (a bit of
the symbol's name) are left and right. Names are 64-bit hashes of what they stand for, so they are global without a
dictionary, and equal substrings get equal symbols except near their ends. Every symbol carries the stretch of words
that fixes it; a symbol whose stretch lies inside a window is interior to that window.

1. Each window of `window` words picks, on the highest level that has any, the smallest name among its interior
   symbols. Equal windows pick equal names, so only windows whose symbol is shared can be repeats.
2. Exact copies of whole texts are set aside: all their windows start earlier, in the smallest id of the copies.
3. Windows of shared symbols are verified on 96-bit keys of their words; the first of each key is found.
4. Candidates that are not the first of their key are repeats; every word that one covers is removed.

Windows are judged on the input. Null texts have no words; documents shorter than a window keep all; very long texts are
read whole. Ids are numbers. Rows equal in id and text are one document and get equal results; different texts under one
id are ordered by a hash of the text. A null id sorts first. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, doc_keys, hot_keys, join_hot, materialise, public_id, small_batches

#: Bytes of text that a task handles at a time, and of the longest word that is hashed with the others.
_CHUNK, _LONG = 1 << 19, 64
_FAR = 1 << 40
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a number
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def tokens(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in data, the bytes of texts that follow each other at edges, and the first word of each text."""
    solid = ~_SPACE[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    opens[inner], closes[inner - 1] = solid[inner], solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, edges)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """n independent 64-bit hashes of each word, taken eight bytes at a time; of a very long one the halves of its XXH3."""
    size, mixers = end - start, (_A, _B)[:n]
    whole = np.zeros(len(data) // 8 + 2, "<u8")
    whole.view(np.uint8)[: len(data)] = data
    out = [_mix(size.astype(np.uint64) * m + _C) for m in mixers]
    for k in range(0, _LONG, 8):
        own = np.flatnonzero((size > k) & (size <= _LONG))
        if not len(own):
            break
        at = start[own] + k
        cell, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        x = (whole[cell] >> shift) | (whole[cell + 1] << np.uint64(1) << (np.uint64(63) - shift))
        x &= _KEEP[np.minimum(size[own] - k, 8)]
        for h, m in zip(out, mixers, strict=True):
            h[own] = _mix((h[own] ^ x) * m)
    for i in np.flatnonzero(size > _LONG).tolist():
        halves = np.frombuffer(xxhash.xxh3_128_digest(data[start[i] : end[i]]), "<u8")
        for h, half in zip(out, halves, strict=False):
            h[i] = half
    return out


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def levels(sym: np.ndarray, sep: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (name, lo, hi): the symbol is fixed by words lo to hi (exclusive). sep marks gaps between documents."""
    n = len(sym)
    lo, hi = np.arange(n), np.arange(n) + 1
    lo[sep], hi[sep] = -_FAR, _FAR
    out = [(sym[~sep], lo[~sep], hi[~sep])]
    for r in range(1, rounds + 1):
        if r == 1:
            # Runs of equal words. Where a run ends is known only from its neighbours.
            first = np.ones(len(sym), bool)
            first[1:] = (sym[1:] != sym[:-1]) | sep[1:] | sep[:-1]
            at = np.flatnonzero(first)
            length = np.diff(np.append(at, len(sym)))
            end = at + length - 1
            before, after = np.maximum(at - 1, 0), np.minimum(end + 1, len(sym) - 1)
            new_lo, new_hi, sep = lo[before], hi[after], sep[at]
            sym = np.where(length > 1, _mix(sym[at] * _A + length.astype(np.uint64)), sym[at])
            lo, hi = np.where(sep, -_FAR, new_lo), np.where(sep, _FAR, new_hi)
        # Pairs. The class of a symbol is a bit of its name, another in each round.
        right = (_mix(sym + np.uint64(r * int(_B) % 2**64)) & np.uint64(1)).astype(bool)
        opens = np.zeros(len(sym), bool)
        opens[:-1] = ~right[:-1] & right[1:] & ~sep[:-1] & ~sep[1:]
        closes = np.zeros(len(sym), bool)
        closes[1:] = opens[:-1]
        # A pair is fixed by its two symbols. Of the others, a left one needs its right neighbour, a right one its left.
        alone_left, alone_right = np.flatnonzero(~opens & ~right & ~sep), np.flatnonzero(~closes & right & ~sep)
        new_lo, new_hi = lo.copy(), hi.copy()
        new_hi[alone_left] = np.maximum(hi[alone_left], hi[np.minimum(alone_left + 1, len(sym) - 1)])
        new_lo[alone_right] = np.minimum(lo[alone_right], lo[np.maximum(alone_right - 1, 0)])
        pair = np.flatnonzero(opens)
        new_hi[pair] = hi[pair + 1]
        new_lo[pair] = np.minimum(lo[pair], lo[pair + 1])
        new_hi[pair] = np.maximum(hi[pair], hi[pair + 1])
        sym = sym.copy()
        sym[pair] = _mix(sym[pair] * _A + _mix(sym[pair + 1] + _C))
        keep = ~closes
        sym, lo, hi, sep = sym[keep], new_lo[keep], new_hi[keep], sep[keep]
        out.append((_mix(sym[~sep] + np.uint64(r * int(_C) % 2**64)), lo[~sep], hi[~sep]))
    return out


def anchors(sym: np.ndarray, sep: np.ndarray, valid: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, base, mask) of the symbols that windows pick: bit t of mask is the window that starts at base + t."""
    free = np.flatnonzero(valid)
    names, bases, masks = [], [], []
    for name, lo, hi in reversed(levels(sym, sep, rounds)):
        inside = hi - lo <= window  # of these, lo and hi rise with the position
        name, lo, hi = name[inside], lo[inside], hi[inside]
        if not len(name) or not len(free):
            continue
        a, b = np.searchsorted(lo, free, "left"), np.searchsorted(hi, free + window, "right")  # interior symbols a to b
        has = b > a
        at, a, b = free[has], a[has], b[has]
        free = free[~has]
        if not len(at):
            continue
        # Names are compared without their last bits, then by place: alike in equal windows, as their interior symbols are.
        places = np.uint64((1 << max(20, len(name).bit_length())) - 1)
        width = (b - a).astype(np.int32)
        log = np.frexp(width)[1] - 1
        least, best = (name & ~places) | np.arange(len(name), dtype=np.uint64), np.empty(len(at), np.uint64)
        for k in range(int(log.max()) + 1):  # minima of 2**k neighbours answer all ranges of up to twice that
            own = np.flatnonzero(log == k)
            best[own] = np.minimum(least[a[own]], least[b[own] - (1 << k)])
            least = np.minimum(least[: -(1 << k)], least[1 << k :]) if len(least) > 1 << k else least
        pick = (best & places).astype(np.int64)  # rises with the window
        run = np.flatnonzero(np.append(True, pick[1:] != pick[:-1]))
        own = pick[run]
        base = hi[own] - window
        names.append(name[own])
        bases.append(base)
        masks.append(np.bitwise_or.reduceat(np.int64(1) << (at - (hi[pick] - window)), run))
    return np.concatenate(names), np.concatenate(bases), np.concatenate(masks)


def _chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, bytes of the texts, and tokens of them) for stretches of a batch."""
    texts = pc.fill_null(batch.column(text_at), "").cast(pa.large_string())
    _, ends, content = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    content = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _CHUNK, "right")) - 1)
        data = content[ends[lo] : ends[hi]]
        yield lo, hi, data, *tokens(data, ends[lo : hi + 1] - ends[lo])
        lo = hi


def _pick(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, start, end, first in _chunks(batch, 2):
                n, k = len(start), hi - lo
                room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
                if not (room >= window).any():
                    continue
                place = np.arange(n) + np.repeat(np.arange(k), np.diff(first)) + 1  # a gap before each document
                sym, sep, valid = np.zeros(n + k + 1, np.uint64), np.ones(n + k + 1, bool), np.zeros(n + k + 1, bool)
                sym[place], sep[place] = hashes(data, start, end, 1)[0], False
                valid[place] = room >= window
                name, base, mask = anchors(sym, sep, valid, window, rounds)
                # the document of an anchor is that of its first window
                begin = base + np.log2(mask & -mask).astype(np.int64)
                doc = np.searchsorted(first + np.arange(k + 1), begin - 1, "right") - 1
                rows = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((base - 1 - doc - first[doc]).astype(np.int32)), pa.array(mask.astype(np.int32))],
                    ["name", "_id", "_h", "base", "mask"],
                )

    return run


def _values(lists: pa.ListArray, first: np.ndarray) -> np.ndarray:
    """All values of the lists (null: none), each plus the first word of its row's text."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], n)


def _starts(batch: pa.RecordBatch, lo: int, hi: int, first: np.ndarray, n: int) -> np.ndarray:
    """Whether a candidate window starts at each of the n words of rows lo to hi, by their bases and masks (columns 3 and 4)."""
    base = _values(batch.column(3).slice(lo, hi - lo), first)
    mask = batch.column(4).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
    bit = np.flatnonzero(np.unpackbits(mask.astype("<i4").view(np.uint8), bitorder="little"))
    out = np.zeros(n, bool)
    out[base[bit >> 5] + (bit & 31)] = True
    return out


def _keys(h: np.ndarray, m: np.uint64, window: int) -> np.ndarray:
    """For each window the sum of its words' hashes, each times a power of m; by windows of half the words."""
    out, size = h, 1
    for more in bin(window)[3:]:
        out = out[:-size] * np.uint64(pow(int(m), size, 1 << 64)) + out[size:]
        size *= 2
        if more == "1":
            out = out[:-1] * m + h[size:]
            size += 1
    return out


def _verify(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, start, end, first in _chunks(batch, 2):
                at = np.flatnonzero(_starts(batch, lo, hi, first, len(start)))
                doc = np.searchsorted(first, at, "right") - 1
                a, b = (_keys(h, m, window)[at] for h, m in zip(hashes(data, start, end), (_A, _B), strict=True))
                rows = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - first[doc]).astype(np.int32))], ["a", "b", "_id", "_h", "start"])

    return run


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.StringArray:
    """The words of each text that are not gone, joined by single spaces."""
    kept = np.flatnonzero(~gone)
    before = np.concatenate([[0], np.cumsum(~gone)])[first]  # kept words before each text
    more = np.ones(len(kept), bool)  # not the last kept word of its text: the byte behind it is white space and is taken too
    more[before[1:][np.diff(before) > 0] - 1] = False
    begin, stop = start[kept], end[kept] + more
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin] += 1
    edge[stop] -= 1
    spaced = data.copy()
    spaced[stop[more] - 1] = 32
    ends = np.concatenate([[0], np.cumsum(stop - begin)])[before]
    return pa.StringArray.from_buffers(len(before) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(spaced[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column(6).to_numpy(zero_copy_only=False)
            for lo, hi, data, start, end, first in _chunks(batch, 2):
                repeat, total = _starts(batch, lo, hi, first, len(start)), np.diff(first)
                repeat[_values(batch.column(5).slice(lo, hi - lo), first)] = False
                at = np.flatnonzero(repeat)
                edge = np.zeros(len(start) + 1, np.int32)
                edge[at] += 1
                edge[at + window] -= 1
                gone = (np.cumsum(edge[:-1]) > 0) | np.repeat(copy[lo:hi].astype(bool) & (total >= window), total)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), _joined(data, start, end, first, gone)], ["_id", "_h", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, rounds: int = 5, keys: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by single spaces) of every row; with `keys`, _id and _h of doc_keys too."""
    if not 2 <= window <= 31:
        raise ValueError("window must be 2 to 31 words")  # a window's place in its anchor's mask is one bit of an int
    keyed = doc_keys(small_batches(docs))
    picked = materialise(keyed.mapInArrow(_pick(window, rounds), "name long, _id long, _h long, base int, mask int"), "anchors")
    shared = materialise(picked.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    digest = keyed.filter("_text is not null").select(F.unhex(F.sha2("_text", 256)).alias("d"), "_id", "_h")
    groups = digest.groupBy("d").agg(F.min(F.struct("_id", "_h")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialise(groups, "groups")
    copies = materialise(join_hot(digest, groups.drop("n"), "d", hot_keys(groups, "d"), ["_id", "_h"]).filter(F.struct("_id", "_h") != F.col("m")).select("_id", "_h").distinct(), "copies")
    hot = F.broadcast(hot_keys(shared, "name"))  # anchors of hot symbols are known to be shared without meeting in a task
    near = picked.join(hot, "name", "left_anti").join(shared.drop("n"), "name").unionByName(picked.join(hot, "name", "left_semi"))
    near = near.groupBy("_id", "_h").agg(F.collect_list("base").alias("bases"), F.collect_list("mask").alias("masks"))
    near = materialise(near.join(copies, ["_id", "_h"], "left_anti"), "candidates")
    discard(picked, shared)
    keys = keyed.join(near, ["_id", "_h"]).select("_id", "_h", "_text", "bases", "masks").mapInArrow(_verify(window), "a long, b int, _id long, _h long, start int")
    span = keyed.agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.max(F.abs("_h")).alias("h")).first()
    far = near.agg(F.max(F.array_max("bases"))).first()[0] or 0  # no window of a candidate starts later than this + window
    narrow = span["lo"] is not None and span["h"] == 0 and span["hi"] - span["lo"] < 1 << 38 and far + window < 1 << 25
    if narrow:  # order of (id, start) in one number, which aggregates without sorting
        low = span["lo"]
        first = keys.groupBy("a", "b").agg(F.min((F.col("_id") - F.lit(low)) * F.lit(1 << 25) + F.col("start")).alias("m"))
        first = first.select((F.shiftrightunsigned("m", 25) + F.lit(low)).alias("_id"), F.lit(0).cast("long").alias("_h"), F.col("m").bitwiseAND(F.lit((1 << 25) - 1)).cast("int").alias("start"))
    else:
        first = keys.groupBy("a", "b").agg(F.min(F.struct("_id", "_h", "start")).alias("m")).select("m._id", "m._h", "m.start")
    firsts = materialise(first.groupBy("_id", "_h").agg(F.collect_list("start").alias("firsts")), "firsts")
    known = near.join(firsts, ["_id", "_h"], "left").withColumn("copy", F.lit(False))
    known = known.unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    whole = keyed.join(known, ["_id", "_h"], "left").select("_id", "_h", "_text", "bases", "masks", "firsts", F.coalesce("copy", F.lit(False)).alias("copy"))
    cut = whole.mapInArrow(_cut(window), "_id long, _h long, n_words long, n_removed long, kept_text string")
    return cut.select(*(["_id", "_h"] if keys else []), public_id(F.col("_id")).alias("doc_id"), "n_words", "n_removed", "kept_text")


def brute_force(docs: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """Reference for tests: id to (n_words, n_removed, kept text) from a dictionary of all windows."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        w = split(text)
        gone = set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), b" ".join(kept).decode())
    return out
