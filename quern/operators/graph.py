"""Shared folder, materialised steps, and connected components by contraction."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a new local folder
    serves a local master (tests); on a cluster each executor would write to a disk of its own, so that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="quern-"))
        found = _own[0]
    return found.rstrip("/")


#: While this is on, Spark removes a query's shuffle files when the query ends instead of when the driver collects garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write are removed with its end, as the written table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote and that no later step reads, nor any frame still to be evaluated."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("quern-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace each batch of edges by a star around the smallest node of each of its components."""
    for pdf in batches:
        a, b = star_edges(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect the same nodes as the given edges."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            deeper = root[root]
            if np.array_equal(deeper, root):
                break
            root = deeper
        if np.array_equal(before, root):
            break
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected `edges` (a, b long); root is one node of the node's component.

    Contraction: in each round every node joins its neighbour with the smallest salted hash (or stays),
    edges are renamed and de-duplicated, until none is left. Salted hashes shrink long chains by a
    constant factor a round. Hot nodes only meet partial aggregates and joins that can be split.
    Self edges and repeated edges do no harm; nulls are ignored.
    """
    spark = edges.sparkSession
    now = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b"), "edges")
    steps = []
    while not now.isEmpty():
        salt = F.lit(len(steps) + 1)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("to"))).alias("m"))
        choice = choice.select("node", F.when(F.col("m.h") < F.xxhash64("node", salt), F.col("m.to")).otherwise(F.col("node")).alias("to"))
        choice = materialise(choice, "choice")
        steps.append(choice)
        renamed = now.join(choice.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a").join(choice.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        used, now = now, materialise(renamed.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().mapInPandas(_local_forest, "a long, b long"), "edges")
        discard(used)
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    found = steps[-1].select("node", F.col("to").alias("root"))
    for choice in reversed(steps[:-1]):
        up = found.select(F.col("node").alias("to"), F.col("root").alias("_r"))
        found = choice.join(up, "to", "left").select("node", F.coalesce("_r", "to").alias("root"))
        found = materialise(found, "roots")
    return found
