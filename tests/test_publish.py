"""Staged publishing and resumable appends."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.sources import manifests, publish


def visible(folder):
    return sorted(p.name for p in Path(folder).iterdir())


def test_staged_is_all_or_nothing(spark, tmp_path):
    target = f"file://{tmp_path}/result"
    with pytest.raises(ZeroDivisionError), publish.staged(spark, target) as folder:
        spark.range(3).write.parquet(f"{folder}/part")
        assert visible(tmp_path)[0].startswith(".result.incomplete-")
        assert not publish.exists(spark, target)
        raise ZeroDivisionError
    assert visible(tmp_path) == []
    with publish.staged(spark, target) as folder:
        spark.range(3).write.parquet(f"{folder}/part")
    assert visible(tmp_path) == ["result"] and spark.read.parquet(f"{target}/part").count() == 3
    with pytest.raises(FileExistsError), publish.staged(spark, target):
        raise AssertionError("not reached")
    other = f"file://{tmp_path}/late"
    with pytest.raises(FileExistsError), publish.staged(spark, other) as folder:
        spark.range(1).write.parquet(other)
        spark.range(9).write.parquet(f"{folder}/part")
    assert spark.read.parquet(other).count() == 1 and visible(tmp_path) == ["late", "result"]


def test_experiment_and_its_summary(spark, tmp_path):
    rows = spark.createDataFrame([(3, "a,b", "train"), (1, 'say "x"', "test"), (2, "two\nlines", "train"), (4, "", "validation"), (5, None, "left_out")], "id long, text string, split string")
    classes = rows.groupBy("split").count()
    target = f"file://{tmp_path}/exp"
    got = {r.part: (r.n_rows, r.sha256) for r in publish.publish_experiment(spark, target, rows, ["id"], {"classes": classes}, {"audit": classes}).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"canonical": 5, "train_manifest": 2, "validation_manifest": 1, "test_manifest": 1, "classes": 4}
    summary = [json.loads(x) for p in Path(tmp_path, "exp/summary").glob("part-*.json") for x in p.read_text().splitlines()]
    assert {s["part"]: (s["n_rows"], s["sha256"]) for s in summary} == got
    again = {r.part: r.sha256 for r in publish.publish_experiment(spark, f"{target}2", rows.repartition(3), ["id"], {"classes": classes}, {}).collect()}
    assert again == {k: h for k, (_, h) in got.items()}
    changed = {r.part: r.sha256 for r in publish.publish_experiment(spark, f"{target}3", rows.withColumn("text", F.when(F.col("id") == 1, "y").otherwise(F.col("text"))), ["id"], {"classes": classes}, {}).collect()}
    assert {k for k in again if again[k] != changed[k]} == {"canonical", "test_manifest"}
    with pytest.raises(FileExistsError):
        publish.publish_experiment(spark, target, rows, ["id"], {}, {})
    bad = rows.withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        publish.publish_experiment(spark, f"{target}4", bad, ["id"], {}, {})
    assert visible(tmp_path) == ["exp", "exp2", "exp3"]


def test_append_goes_on_where_it_stopped(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    calls = []

    def work(rows):
        calls.append(rows.count())
        return rows.select("k", (F.col("v") * 2).alias("w"))

    todo = spark.createDataFrame([(i, i * 10) for i in range(20)] + [(7, 70)], "k long, v long")
    split = lambda rows: work(rows).repartition(8, "k")
    first = publish.append_missing(todo.filter("k < 8"), path, ["k"], split).collect()
    assert {r.status for r in first} == {"written"} and len(first) == 8
    # a run that died: one of its files never arrived, and its folder stayed behind
    gone = next(f for f in sorted(Path(tmp_path, "cache").glob("part-*.parquet")) if spark.read.parquet(f"file://{f}").count() == 1)
    lost = spark.read.parquet(f"file://{gone}").first().k
    Path(tmp_path, ".cache.incomplete-dead").mkdir()
    Path(tmp_path, ".cache.incomplete-dead/part-0.parquet").write_bytes(b"half")
    gone.unlink()
    second = {r.k: r.status for r in publish.append_missing(todo, path, ["k"], work).collect()}
    assert second == {i: "cached" if i < 8 and i != lost else "written" for i in range(20)} and calls == [8, 13]
    third = publish.append_missing(todo, path, ["k"], work).collect()
    assert {r.status for r in third} == {"cached"} and calls == [8, 13]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(i, i * 20) for i in range(20)]


def test_csv_fields_and_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "no")], "b string, a string, extra string")
    manifests.write_csv(df, f"file://{tmp_path}/out", fields=["a", "missing", "b"])
    text = next(Path(tmp_path, "out").glob("part-*.csv")).read_text().splitlines()
    assert text[0] == "a,missing,b" and manifests.read_csv(spark, f"file://{tmp_path}/out").collect() == [("x", "", "1")]
    Path(tmp_path, "bom.csv").write_text("﻿id,name\n1,é\n", encoding="utf-8")
    assert manifests.read_csv(spark, f"file://{tmp_path}/bom.csv").first().asDict() == {"id": "1", "name": "é"}


def test_one_claim_succeeds(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def attempt(i):
        try:
            publish.claim(spark, f"file://{tmp_path}/marker", f"run {i}")
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [i for i in pool.map(attempt, range(12)) if i is not None]
    assert len(won) == 1 and Path(tmp_path, "marker").read_text() == f"run {won[0]}"


def test_lookup_and_label_map(spark):
    rows = spark.createDataFrame([("a\\b/c", 1, "x"), ("a/b/c", 3, "y"), ("a/b\\c", 2, "z"), ("d", 1, "w")], "path string, n int, v string")
    assert sorted(map(tuple, manifests.indexed(rows, "path", "n").collect())) == [("a/b/c", 3, "y"), ("d", 1, "w")]
    labels = spark.createDataFrame([("x", 1), ("y", 2)], "v string, k int")
    assert {r.k for r in manifests.with_labels(rows.filter("v in ('x', 'y')"), labels, "v").collect()} == {1, 2}
    with pytest.raises(Exception, match="no label for z"):
        manifests.with_labels(rows, labels, "v").collect()
