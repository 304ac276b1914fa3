"""Publishing whole results once, and appending to results step by step.

Paths are of any file system that Spark reaches; all files are handled through it, none by the driver's own disk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.dedup import content_hash
from quern.operators.graph import materialise
from quern.sources.manifests import write_json


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, as_path = _file_system(spark, path)
    return fs.exists(as_path(path))


def claim(spark: SparkSession, path: str, note: str = "") -> None:
    """Create a marker file that did not exist: of any number of claims of one path one succeeds, the others raise FileExistsError.

    Distributed file systems create exclusively. The local one, for a local master, only checks first, so there the operating
    system does it.
    """
    fs, as_path = _file_system(spark, path)
    if fs.getUri().getScheme() == "file":
        with open(as_path(path).toUri().getPath(), "x") as out:
            out.write(note)
        return
    try:
        out = fs.create(as_path(path), False)
    except Py4JJavaError as error:
        if fs.exists(as_path(path)):
            raise FileExistsError(f"already claimed: {path}") from error
        raise
    try:
        out.write(bytearray(note.encode()))
        out.hsync()
    finally:
        out.close()


@contextmanager
def staged(spark: SparkSession, target: str) -> Iterator[str]:
    """A folder beside the target to write into; it becomes the target with one rename, if the block ends well.

    Nothing is visible under the target before, and nothing is left of the folder after a failure. A target that exists,
    before or after the block, is never touched: that raises FileExistsError.
    """
    target = target.rstrip("/")
    fs, as_path = _file_system(spark, target)
    if fs.exists(as_path(target)):
        raise FileExistsError(f"already published: {target}")
    parent, name = target.rsplit("/", 1)
    folder = f"{parent}/.{name}.incomplete-{uuid.uuid4().hex}"
    fs.mkdirs(as_path(folder))
    try:
        yield folder
        if fs.exists(as_path(target)):
            raise FileExistsError(f"published meanwhile: {target}")
        if not fs.rename(as_path(folder), as_path(target)):
            raise OSError(f"cannot rename {folder} to {target}")
    finally:
        fs.delete(as_path(folder), True)


def _digest(spark: SparkSession, path: str, schema, order: list[str]) -> DataFrame:
    """Rows and content hash of a written CSV table, as it reads back: tab-joined lines in order, null and empty alike."""
    back = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in back.columns])
    return content_hash(back, order, line).select(F.col("n_rows"), F.col("dataset_sha256").alias("sha256"))


def publish_experiment(spark: SparkSession, target: str, rows: DataFrame, order: list[str], tables: dict[str, DataFrame], reports: dict[str, DataFrame], splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """(part, n_rows, sha256) of an experiment published as one folder.

    `canonical` holds all rows (with a column split), `<split>_manifest` those of each split, and every further table its own
    folder, all as CSV; reports are JSON; `summary` lists the rows and the hash of every CSV part, read back after it was
    written. Tables sort by all their columns.
    """
    parts = {"canonical": (rows, order)} | {f"{s}_manifest": (rows.filter(F.col("split") == s), order) for s in splits} | {k: (t, t.columns) for k, t in tables.items()}
    with staged(spark, target) as folder:
        digests = None
        for name, (table, by) in parts.items():
            table.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
            own = _digest(spark, f"{folder}/{name}", table.schema, by).select(F.lit(name).alias("part"), "n_rows", "sha256")
            digests = own if digests is None else digests.unionByName(own)
        for name, report in reports.items():
            write_json(report, f"{folder}/{name}")
        digests = materialise(digests, "digests")  # what it reads is about to move
        write_json(digests, f"{folder}/summary")
    return digests


def _append(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet table: written beside it, then moved in file by file, so that every file in it is whole and
    what a dead run left behind is no part of it."""
    spark = rows.sparkSession
    path = path.rstrip("/")
    fs, as_path = _file_system(spark, path)
    parent, name = path.rsplit("/", 1)
    folder = f"{parent}/.{name}.incomplete-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(folder)
        fs.mkdirs(as_path(path))
        for status in fs.listStatus(as_path(folder)):
            file = status.getPath()
            if file.getName().startswith("part-") and not fs.rename(file, as_path(f"{path}/{file.getName()}")):
                raise OSError(f"cannot move {file} into {path}")
    finally:
        fs.delete(as_path(folder), True)


def append_missing(todo: DataFrame, path: str, key: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The keys of `todo`, each once, with status: cached if the table at `path` holds them, else written.

    work(rows) turns the missing rows into rows for the table and keeps the key. Files that a lost run had finished are kept and
    their keys not done again; what it left unfinished is not seen. A key that comes twice is worked on once; null keys are never found, so always written.
    """
    spark = todo.sparkSession
    once = todo.dropDuplicates(key)
    if exists(spark, path):
        held = spark.read.parquet(path).select(*key).distinct().withColumn("status", F.lit("cached"))
        known = once.select(*key).join(held, key, "left").withColumn("status", F.coalesce("status", F.lit("written")))
    else:
        known = once.select(*key).withColumn("status", F.lit("written"))
    known = materialise(known, "status")  # before the table changes
    missing = known.filter("status = 'written'")
    if not missing.isEmpty():
        rows = once
        for k in key:
            rows = rows.withColumnRenamed(k, f"_{k}")
        same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in key]
        on = same[0]
        for c in same[1:]:
            on = on & c
        _append(work(rows.join(missing.drop("status"), on).drop(*[f"_{k}" for k in key])), path)
    return known
