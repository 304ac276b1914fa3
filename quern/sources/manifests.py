"""CSV and JSON manifests: all-string scans where absent is "", keep-last keys, contract checks, and sinks with a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import slashes


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, empty fields as "". A byte-order mark at the start of a file is no part of its first column."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path).na.fill("")


def keep_last(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by ordinal, as a dictionary filled in order would hold."""
    w = Window.partitionBy(*key).orderBy(F.desc(ordinal))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def indexed(df: DataFrame, path: str, ordinal: str) -> DataFrame:
    """The manifest with one row a path: separators as /, the last row by ordinal wins."""
    return keep_last(df.withColumn(path, slashes(F.col(path))), [path], ordinal)


def with_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """df with the columns of the label map `labels` (key once each); a key without a label raises."""
    held = labels.withColumn("_known", F.lit(True))
    t = df.join(held, key, "left")
    return t.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no label for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))).drop("_known")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")) -> DataFrame:
    """(path, name, label, length) of files under a folder of class folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split("path", "/")
    t = files.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("label"), "length")
    return t.filter(F.lower("name").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def checked(df: DataFrame, split: str, labels: DataFrame) -> DataFrame:
    """The manifest if every row has the split, a known label with its index, and a path of its own; else it raises."""
    known = df.join(labels.select(F.col("label").alias("class_label"), F.col("full_idx").cast("string").alias("_idx")), "class_label", "left")
    bad = known.agg(F.count_if(F.col("split") != split).alias("split"), F.count_if(F.col("_idx").isNull()).alias("label"), F.count_if(F.col("_idx") != F.col("class_index")).alias("index"), (F.count(F.lit(1)) - F.count_distinct("sample_path")).alias("path"), F.count_if(F.lit(True)).alias("rows")).first().asDict()
    rows = bad.pop("rows")
    if not rows or any(bad.values()):
        raise ValueError(f"manifest breaks its contract: {rows} rows, {bad}")
    return df


def write_csv(df: DataFrame, path: str, on_empty: str = "write", fields: list[str] | None = None) -> None:
    """on_empty: write (a header only), skip, or raise. fields: the columns to write, in order; others are dropped, absent ones empty."""
    if fields:
        df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in fields])
    if on_empty != "write" and df.isEmpty():
        if on_empty == "raise":
            raise ValueError("no rows to write")
        return
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, into a new folder only; numbers that JSON lacks raise."""
    checks = [F.assert_true(F.coalesce(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.lit(True)), f"{f.name} is no JSON number").alias(f.name) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if checks:
        df.select(*checks).write.format("noop").mode("overwrite").save()
    df.write.mode("errorifexists").json(path)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(image, height, width, y, row): the rows of the images under a path, each an array of grey values from 0 to 255.

    Colours are weighed to grey in whole numbers, opacity is ignored; a file that is no image raises. Images are cut into
    rows by Spark, so what follows handles a row at a time.
    """
    t = spark.read.format("image").load(path).select("image.*")
    bad = F.raise_error(F.concat(F.lit("not an image: "), "origin")).cast("int")
    t = t.withColumn("nChannels", F.when(F.col("nChannels") < 1, bad).otherwise(F.col("nChannels")))
    size = F.col("width") * F.col("nChannels")
    rows = t.select(F.col("origin").alias("image"), "height", "width", "nChannels", F.col("data").alias("_d"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.select("image", "height", "width", "nChannels", "y", F.hex(F.substring("_d", F.col("y") * size + 1, size)).alias("_hex"))
    byte = lambda x, k: F.conv(F.substring("_hex", (x * F.col("nChannels") + k) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    weighed = lambda x: F.shiftright(byte(x, 0) * 7471 + byte(x, 1) * 38470 + byte(x, 2) * 19595 + 32768, 16)  # noqa: E731  # fixed weights of blue, green, red
    grey = lambda x: F.when(F.col("nChannels") >= 3, weighed(x)).otherwise(byte(x, 0))
    return rows.select("image", "height", "width", "y", F.transform(F.sequence(F.lit(0), F.col("width") - 1), grey).alias("row"))


def raster_cells(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (image, y, x, value from 0 to 1) and sizes of `read_rasters`."""
    cells = rasters.select("image", "y", F.posexplode("row").alias("x", "_v")).select("image", "y", "x", (F.col("_v") / F.lit(255.0)).alias("value"))
    return cells, rasters.filter("y = 0").select("image", "height", "width")
