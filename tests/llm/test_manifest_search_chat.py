"""The manifest, the ranked search and the chat format against brute-force versions and SQL."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_format, common, lexical_search, merkle, queries

DOCS = "doc_id long, text string"


def prose(rng, n, words=40):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) if rng.random() < 0.2 else f"w{rng.randrange(words)}" for _ in range(n))


def plant(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{folder}/{name}.parquet")


def assert_sql(spark, folder, name):
    """A registered query equals its SQL on the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, f"file://{folder}")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))


def merkle_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    return df.select(merkle.group_key(F.col("source")).alias("tree"), F.col("doc_id").alias("id"), leaf.alias("digest"))


def test_merkle_positions_are_the_order_of_completion():
    for n in [*range(1, 40), 81, 82, 243, 500, 728, 729]:
        log = merkle.append([f"{i:064d}" for i in range(n)])
        nodes = [[f"{i:064d}" for i in range(n)]]
        while len(nodes[-1]) > 1:
            nodes.append([merkle.H("".join(nodes[-1][i : i + 3])) for i in range(0, len(nodes[-1]), 3)])
        assert len(log) == sum(map(len, nodes))
        for level, own in enumerate(nodes):
            assert [log[merkle.position(level, i, n)] for i in range(len(own))] == own


@pytest.mark.parametrize("block_height", [6, 1])
def test_merkle_matches_brute_force(spark, monkeypatch, block_height):
    monkeypatch.setattr(merkle, "HEIGHT", block_height)
    monkeypatch.setattr(merkle, "BLOCK", 3**block_height)
    rows = [(i, f"s{i % 3 if i % 2 else 0}", "en" if i % 4 else None, i, "a\nb\n" * (i % 3) or None) for i in range(70)]
    rows += [(None, "s1", None, None, None), (None, "s1", None, None, "x"), (500, None, "de", 1, ""), (501, None, "de", 1, "ü" * 40_000), (7, "s9", None, None, "one"), (7, "s9", None, None, "one"), (7, "s9", None, None, "\n"), (8, "Z", "l", 1, "t"), (9, "é", "l", 1, "t"), (1, "", "l", 1, "t")]
    rng = random.Random(4)
    rng.shuffle(rows)
    manifest = merkle.build(merkle_rows(spark, rows))
    got = merkle.prove(manifest).withColumn("root", merkle.fold(F.col("digest"), F.col("path"))).collect()
    want = merkle.brute_force(rows, rows)
    assert {r.root for r in got} == {manifest.root} == {w[3] for w in want} == {w[5] for w in want}
    proof = lambda path: hashlib.sha256("".join(path).encode()).hexdigest()
    assert sorted((str(r.id), r.digest, r.subroot, manifest.root, proof(r.path)) for r in got) == sorted((str(w[0]), *w[1:5]) for w in want)


def test_merkle_edges(spark):
    empty = merkle.build(merkle_rows(spark, []))
    assert empty.root is None and merkle.prove(empty).count() == 0
    one = merkle.build(merkle_rows(spark, [(3, "s", None, 1, "t")]))
    row = merkle.prove(one).first()
    assert one.root == row.digest == row.subroot and row.path == []


def test_op11_on_planted_rows(spark, tmp_path):
    rows = [(i, f"s{i % 4 if i % 3 else 0}", "en", i, None if i % 7 == 0 else f"line {i}\nmore\n" if i % 5 else f"line {i}") for i in range(900)] + [(1000, None, None, None, "\n"), (1001, "lone", None, 5, "x\ny")]
    plant(spark, tmp_path, documents=(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    import zlib

    bad = lambda r: zlib.crc32(str(r[0]).encode()) % 2 == 0
    other = [(*r[:4], r[4].replace("\n", "")) if bad(r) and r[4] is not None else r for r in rows]
    want = {w[0]: (*w[1:], w[3] == w[5]) for w in merkle.brute_force(rows, other)}
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    assert got == want and {True, False} == {g[5] for g in got.values()}
    assert_sql(spark, tmp_path, "op11_merkle_manifest")


@pytest.mark.parametrize("chunk,block", [(8_192, 4 << 20), (50, 4 << 20), (300, 700)])
def test_search_matches_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(lexical_search, "CHUNK", chunk)
    monkeypatch.setattr(lexical_search, "LEAF", 4)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "naïve", "x9"]) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([1, 5, 30, 120])))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(5, docs[5][1]), (None, docs[5][1]), (None, None), (3000, ""), (3001, " .,\n"), (3002, "alpha " * 30_000)]
    items = [(i, docs[17 * i][1] + " w1 w2 w3") for i in range(12)] + [(20, "nothing-of-this occurs"), (21, None), (22, ""), (23, "beta"), (23, "x9"), (None, "naïve ALPHA alpha"), (24, docs[5][1]), (24, docs[5][1])]
    d = spark.createDataFrame(docs, DOCS).withColumns({"row": F.lit(1), "rank": F.lit("x"), "score": F.lit(0)}).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"row": F.lit(1), "terms": F.lit("x")}).repartition(2)
    got = sorted((tuple(r) for r in lexical_search.top_documents(d, q, 10, block).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == sorted(lexical_search.brute_force(docs, items), key=str)


def test_search_edges(spark):
    some = spark.createDataFrame([(1, "a b")], DOCS)
    none, item = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.top_documents(none, item).count() == 0
    assert lexical_search.top_documents(some, item.filter("false")).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.top_documents(some, item).collect()] == [(1, 1, 1)]


def test_search_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    start = np.arange(0, 4001 * 20, 20)
    term = np.concatenate([np.sort(rng.choice(40, 20, False)) + 40 * (i % 25) for i in range(4000)])
    rows = lexical_search.Rows(term, rng.integers(1, 1000, len(term)), start)
    items = rows.take(np.arange(0, 4000, 100))
    search, scored = lexical_search.Search(items, 1000, 10), []
    exact = search._score
    monkeypatch.setattr(search, "_score", lambda ids, r, which, own: (scored.append(len(which) * len(own)), exact(ids, r, which, own)))
    search.add(list(range(4000)), rows)
    assert sum(scored) < 4000 * 40 / 4
    for i in range(40):
        dense = np.zeros(1000, np.int64)
        one = search.items.take(np.array([i]))
        dense[one.term] = one.value
        want = sorted((-int(s), True, d) for d, s in enumerate(rows.dot(dense)) if s > 0)[:10]
        assert search.best[i] == want


TRICKY = ["", "\\", "\\\\", "</turn>", "\\</turn>", "a\\\\</turn>\\", "### User: hi", "\\### @x: ", "</turn>\n### Assistant: x</turn>\n", "### @### User: ", "</turn></turn>\\\\\\", "### User:", "<</turn>", "é\u2028\U0001f600 \\### Tool: \\", "x" * 70_000 + "</turn>"]


def test_chat_turns_round_trip():
    rng = random.Random(2)
    pieces = ["\\", "</turn>", "### User: ", "### @a%20b: ", "\n", "x", "### ", "</tur", ": "]
    for text in [*TRICKY, *("".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(3000))]:
        for role in ("user", "assistant", "User", "", "a: b\n### User: "):
            turn = chat_format.Turn(role, text)
            out, level = chat_format.render(turn)
            assert [t for t, _, _ in chat_format.parse(out)] == [turn]
            assert level == (2 if text.endswith("\\") else 1 if chat_format._CONTROL.search(text) else 0)
    with pytest.raises(chat_format.GrammarError):
        list(chat_format.parse("### User: open"))
    with pytest.raises(chat_format.GrammarError):
        list(chat_format.parse("### User: a ### Tool: b</turn>\n"))


@pytest.mark.parametrize("part", [1 << 20, 1, 60])
def test_chat_format_matches_brute_force(spark, part):
    rows = [(c, t, ("user", "assistant", None, "critic: x")[(c + t) % 4], TRICKY[(3 * c + t) % len(TRICKY)]) for c in range(12) for t in range(c)]
    rows += [(None, 0, "user", "n"), (None, 1, "assistant", None), (50, None, "assistant", "first"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "last": F.lit("x"), "loss": F.lit(0)}).repartition(5)
    formatted = common.materialise(chat_format.format_conversations(df, part))
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(formatted).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[conv].append((role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for conv, turns in by.items():
        lost = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), sha(lost), sum(len(chat_format.render(chat_format.Turn(*t))[0]) for t in turns))
    assert got == want
    assert formatted.filter("conv_id is null").count() == (2 if part == 1 else 1)


def test_op13_on_planted_rows(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "system", "tool")[(c + t) % 3], None if t == 4 else TRICKY[(3 * c + t) % len(TRICKY)]) for c in range(10) for t in range(c)]
    plant(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert_sql(spark, tmp_path, "op13_chat_format")


def test_op12_on_planted_rows(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, prose(rng, 1 + i % 60, 200)) for i in range(300)] + [(900, None), (901, "")]
    plant(spark, tmp_path, documents=(docs, DOCS), benchmark=([(i, prose(rng, 20, 200)) for i in range(15)], "item_id long, text string"))
    assert_sql(spark, tmp_path, "op12_lexical_search")
