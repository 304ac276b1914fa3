"""Language identification with segmentation-marginalised unigrams over a fixed public vocabulary.

A word (run of letters, lower-cased, with the vocabulary's word mark in front) has, in a language, the probability
of all its segmentations into pieces: a forward pass sums them. Piece probabilities come from expectation
maximisation over the same lattice. A text's score is the posterior of the best language under equal priors.

The vocabulary is a file whose path is a parameter. Training reads labelled rows only: about `rows_per_language`
of each language (all if it has fewer), chosen by a hash of the id; this bound is the only sampling.

Null texts and texts without a letter give `und` with score 0. Null ids count as the text "". Words over 64 letters
are scored in stretches of 64. Repeated rows are each predicted; without labelled rows everything is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, small_batches

MARK = "▁"
_WORD = re.compile(r"[^\W\d_]{1,64}")
_FLOOR = 1e-7
#: Words whose scores a worker remembers before it starts anew, and characters scored at a time.
_CACHE, _CHUNK = 150_000, 500_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in stretches of at most 64."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # Number signs such as fractions are word characters to regular expressions, but no letters.
    return [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces that consist of lower-case letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p.removeprefix(MARK) and p.removeprefix(MARK).isalpha() and p == p.lower()})


class Lattice:
    """Pieces as a trie over character classes, walked by all words of a block at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        # The trie holds pieces of two characters and more; single characters have a table of their own, so that
        # scripts with thousands of signs do not widen the trie.
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.classes = np.zeros(0x110000, np.int16)  # 0: in no longer piece
        for i, c in enumerate(chars):
            self.classes[ord(c)] = i + 1
        self.single = np.full(0x110000, -1, np.int32)
        nodes: dict[str, int] = {"": 1}  # node 0 is dead
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.single[ord(p)] = i
            for n in range(1, len(p) + 1 if len(p) > 1 else 0):
                nodes.setdefault(p[:n], len(nodes) + 1)
        self.step = np.zeros((len(nodes) + 1, len(chars) + 1), np.int32)
        for prefix, node in nodes.items():
            if prefix:
                self.step[nodes[prefix[:-1]], self.classes[ord(prefix[-1])]] = node
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        for i, p in enumerate(pieces):
            if len(p) > 1:
                self.piece[nodes[p]] = i

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces): words (of one length) with a piece there, by start and then end; one-character spans come first."""
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        codes, single = self.classes[points], self.single[points]
        for i in range(n):
            rows, node = np.arange(len(words)), np.ones(len(words), np.int32)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                node = self.step[node, codes[rows, j - 1]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if j == i + 1:
                    own = np.flatnonzero(single[:, i] >= 0)
                    yield i, j, own, single[own, i]
                    continue
                ids = self.piece[node]
                hit = ids >= 0
                if hit.any():
                    yield i, j, rows[hit], ids[hit]
                if not len(rows):
                    break


def _blocks(words: list[str], most: int = 20_000) -> Iterator[list[int]]:
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for own in by.values():
        for lo in range(0, len(own), most):
            yield own[lo : lo + most]


def forward(lattice: Lattice, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word (rows) in each language (columns of probs), summed over all segmentations."""
    out = np.zeros((len(words), probs.shape[1]))
    single = np.maximum(probs, _FLOOR)
    for own in _blocks(words):
        block = [words[i] for i in own]
        n = len(block[0])
        alpha = np.zeros((n + 1, len(own), probs.shape[1]))
        alpha[0] = 1
        log, last = np.zeros(len(own)), 0
        for i, j, rows, ids in lattice.arcs(block):
            if i > last and i % 8 == 0:  # keep the numbers in range: all that is still used is divided alike
                top = alpha[i].max(1)
                log += np.log(top)
                alpha[i : i + lattice.longest + 1] /= top[:, None]
            last = i
            if j == i + 1:
                p = np.full((len(own), probs.shape[1]), _FLOOR)
                p[rows] = single[ids]
                alpha[j] += alpha[i] * p
            else:
                alpha[j, rows] += alpha[i, rows] * probs[ids]
        out[own] = np.log(np.maximum(alpha[n], 1e-300)) + log[:, None]
    return out


def expected(lattice: Lattice, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in `words`, that occur `counts` times, under one language's probabilities."""
    total = np.zeros(len(lattice.pieces))
    for own in _blocks(words):
        block = [words[i] for i in own]
        n, weight = len(block[0]), counts[own]
        arcs = []
        for i, j, rows, ids in lattice.arcs(block):
            p = np.maximum(probs[ids], _FLOOR) if j == i + 1 else probs[ids]
            arcs.append((i, j, rows, ids, p * 20.0 ** (j - i)))
        a, b = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
        a[0] = b[n] = 1
        floor = _FLOOR * 20.0
        for i, j, rows, _, p in arcs:  # by start: a[i] is complete
            if j == i + 1:
                whole = np.full(len(own), floor)
                whole[rows] = p
                a[j] += a[i] * whole
            else:
                a[j, rows] += a[i, rows] * p
        for i, j, rows, _, p in reversed(arcs):
            if j == i + 1:
                whole = np.full(len(own), floor)
                whole[rows] = p
                b[i] += b[j] * whole
            else:
                b[i, rows] += b[j, rows] * p
        scale = weight / np.maximum(a[n], 1e-300)
        for i, j, rows, ids, p in arcs:
            total += np.bincount(ids, a[i, rows] * p * b[j, rows] * scale[rows], len(total))
    return total


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray) -> None:
        self.languages, self.probs, self.lattice = languages, probs, Lattice(pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def __getstate__(self) -> tuple:
        return self.languages, self.lattice.pieces, self.probs

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        lang, score, lo = [], [], 0
        while lo < len(texts):
            docs, size, hi = [], 0, lo
            while hi < len(texts) and size < _CHUNK:
                docs.append(words_of(texts[hi]))
                size += len(texts[hi] or "")
                hi += 1
            if len(self.known) > _CACHE:
                self.known, self.scores = {}, self.scores[:0]
            new = [w for w in dict.fromkeys(chain.from_iterable(docs)) if w not in self.known]
            if new:
                self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
                self.scores = np.vstack([self.scores, forward(self.lattice, self.probs, [MARK + w for w in new])])
            lens = np.array([len(d) for d in docs])
            flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.int64, int(lens.sum()))
            sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.scores[flat], 0)])
            ends = np.cumsum(lens)
            for n, s in zip(lens, sums[ends] - sums[ends - lens], strict=True):
                if n == 0:
                    lang.append("und")
                    score.append(0.0)
                    continue
                k = int(s.argmax())
                lang.append(self.languages[k])
                score.append(float(1 / np.exp(np.minimum(s - s[k], 0)).sum()))
            lo = hi
        return lang, score


def train(docs: DataFrame, vocab_path: str, rows_per_language: int = 1500, rounds: int = 2) -> Model:
    """Fit piece probabilities on rows that are not held out and have a lang. Counting and the E-steps run on Spark;
    the driver sees one number for each language and piece."""
    spark = docs.sparkSession
    pieces = vocabulary(vocab_path)
    rows = small_batches(docs).select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}  # one row a language, as the model has a column for each
    languages = sorted(sizes)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = spark.createDataFrame([(k, min(1.0, rows_per_language / n)) for k, n in sizes.items()], "lang string, share double")
    share = F.broadcast(share) if len(sizes) <= 10_000 else share  # one row a language
    chosen = rows.withColumn("lang", F.col("lang").cast("string")).join(share, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word = [], []
            for t, g in zip(batch.column(0), batch.column(1), strict=True):
                w = words_of(t.as_py())
                word += w
                lang += [g.as_py()] * len(w)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string())], ["lang", "word"])

    counts = materialise(chosen.select("text", "lang").mapInArrow(split, "lang string, word string").groupBy("lang", "word").count(), "words")
    place = {p: i for i, p in enumerate(pieces)}
    probs = np.full((len(pieces), len(languages)), 1.0 / max(1, len(pieces)))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((languages, pieces, probs))

        def e_step(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            langs, own, p = model.value
            lattice = Lattice(own)
            held, rows = [], 0
            for pdf in chain(batches, [None]):  # small batches are scored together
                if pdf is not None:
                    held.append(pdf)
                    rows += len(pdf)
                if not held or (pdf is not None and rows < 40_000):
                    continue
                for g, part in pd.concat(held).groupby("lang"):
                    use = expected(lattice, p[:, langs.index(g)], [MARK + w for w in part["word"]], part["count"].to_numpy(float))
                    k = np.flatnonzero(use > 1e-9)
                    yield pd.DataFrame({"lang": g, "piece": [own[i] for i in k], "n": use[k]})
                held, rows = [], 0

        got = counts.mapInPandas(e_step, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        probs = np.full(probs.shape, 0.05)
        for r in got:
            probs[place[r["piece"]], languages.index(r["lang"])] += r["n"]
        probs /= probs.sum(0)
    return Model(languages, pieces, probs)


def predict(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """All columns of docs (without text unless keep_text), and lang_pred and score; clashing names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = small_batches(docs).drop("lang_pred", "score")
    names = [c for c in docs.columns if keep_text or c != "text"]
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                lang, score = sent.value.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if keep_text or i != at), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def brute_force(pieces: dict[str, float], word: str) -> float:
    """Reference for tests: probability of a word as the sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = pieces.get(word[:n], 0.0)
        p = max(p, _FLOOR) if n == 1 else p
        if p:
            total += p * brute_force(pieces, word[n:])
    return total
