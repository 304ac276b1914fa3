"""The manifest of a collection: identities of originals, derivatives with their provenance, splits, and leakage rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import parse_reference, strongest_group
from quern.operators.dedup import near_pairs
from quern.operators.graph import components, materialise
from quern.operators.ordered import number_within

#: Identity columns, the strongest first, and what else a derivative takes from its original. Fixed values.
IDENTITY = {"ESTAMPAGE": "estampage_id", "INSCRIPTION": "inscription_id", "PAGE": "page_id", "WORD": "word_id", "CROP": "original_crop_id"}
ACTIVE = ("train", "validation", "test")
LEAKAGE_FIELDS = {"file_hashes": "file_sha256", "augmentation_parents": "augmentation_parent_id", "original_crop_ids": "original_crop_id", "word_ids": "word_id", "page_ids": "page_id", "inscription_ids": "inscription_id", "estampage_ids": "estampage_id", "split_group_ids": "split_group_id"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def word_metadata(rows: DataFrame, number: str, reference: str, ordinal: str, names: list[str]) -> DataFrame:
    """(word_id, reference, inscription_id, page_id) by word number; of repeated numbers the last row counts."""
    ref = F.trim(F.coalesce(F.col(reference), F.lit("")))
    last = rows.groupBy(F.format_string("WORD_%04d", F.col(number).cast("long")).alias("word_id")).agg(F.max_by(ref, F.col(ordinal)).alias("reference"))
    parsed = parse_reference(F.col("reference"), names)
    return last.select("word_id", "reference", parsed["inscription"].alias("inscription_id"), parsed["page"].alias("page_id"))


def provenance(rows: DataFrame, label: str, output: str, source: str, ordinal: str, *kept: str) -> DataFrame:
    """(class_label, name, parent_name, *kept): what each derived file was made of; of repeated outputs the last row counts."""
    value = F.struct(basename(F.col(source)).alias("parent_name"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kept])
    last = rows.groupBy(F.col(label).alias("class_label"), basename(F.col(output)).alias("name")).agg(F.max_by(value, F.col(ordinal)).alias("v"))
    return last.select("class_label", "name", "v.*")


def canonical(originals: DataFrame, derived: DataFrame, made_of: DataFrame) -> DataFrame:
    """Originals and derivatives as one manifest: a derivative inherits its original's identity.

    originals: class_label, name, file_sha256, perceptual_hash and the identity columns; derived: class_label, name and
    the two hashes; made_of as `provenance` gives it. A derivative without provenance or original raises.
    """
    own = originals.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in IDENTITY.values()})
    group = strongest_group({k: F.col(c) for k, c in IDENTITY.items()})
    own = own.withColumns({"is_augmented": F.lit(False), "augmentation_parent_id": F.lit(""), "source_group": F.concat_ws("::", group["level"], group["id"])})
    inherited = [*IDENTITY.values(), "source_group"]
    parents = own.select("class_label", F.col("name").alias("parent_name"), *inherited)
    rows = derived.join(made_of, ["class_label", "name"], "left").join(parents, ["class_label", "parent_name"], "left")
    known = F.when(F.col("source_group").isNull(), F.raise_error(F.concat(F.lit("no provenance or original: "), F.col("name"))).cast("string")).otherwise(F.col("source_group"))
    rows = rows.withColumns({"source_group": known, "is_augmented": F.lit(True), "augmentation_parent_id": F.col("original_crop_id")})
    return own.unionByName(rows.select(*own.columns))


def code_pairs(manifest: DataFrame, threshold: int) -> DataFrame:
    """(a, b, dist) of the manifest's different codes within `threshold` bits, written once for every step that needs them."""
    codes = materialise(manifest.select(F.col("perceptual_hash").alias("code")).filter("code is not null").distinct(), "codes")
    return materialise(near_pairs(codes, threshold), "pairs")


def _member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, line): a sha256 of the newline-joined lines of each root, from (root, line) in order; no line is held but its batch's."""
    root, state = None, None
    for batch in batches:
        done = []
        for r, line in zip(batch.column("root").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if r != root:
                if state is not None:
                    done.append((root, state.hexdigest()))
                root, state = r, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["root", "line"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([root], pa.int64()), pa.array([state.hexdigest()])], ["root", "line"])


def _tree_digests(rows: DataFrame, fan: int) -> DataFrame:
    level = number_within(rows, ["root"], ["line"], "i").select("root", "i", "line")
    most, depth = level.agg(F.max("i")).first()[0] or 1, 0
    while depth == 0 or most > 1:
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n"), 256)
        alone = F.lit(depth > 0) & (F.count(F.lit(1)) == 1)
        level = level.groupBy("root", F.expr(f"(i - 1) div {fan} + 1").alias("block")).agg(F.when(alone, F.min("line")).otherwise(joined).alias("line")).withColumnRenamed("block", "i")
        most, depth = -(-most // fan), depth + 1
    return level


def merged_groups(originals: DataFrame, threshold: int, pairs: DataFrame | None = None, fan: int | None = None) -> DataFrame:
    """(source_group, split_group_id): source groups that share a file, or hold codes within `threshold` bits, become one.

    Every file hash and every code links its groups to the first of them, and a pair of near codes links their two first groups,
    so links grow with the rows and not with the pairs. Null hashes and codes link nothing. The id of a component names its
    members whatever their order: the start of a sha256 of its sorted members, newline-joined. That is one sequence, which passes one
    task in order. With a `fan`, beyond as many members it is that of each `fan` of them, again joined by `fan` (a last digest
    alone goes up as it is), and so on until one is left.
    pairs: as `code_pairs` gives them, at `threshold`.
    """
    pairs = code_pairs(originals, threshold) if pairs is None else pairs
    rows = originals.select("source_group", "file_sha256", "perceptual_hash").filter("source_group is not null").distinct()
    groups = materialise(rows.select("source_group").distinct().withColumn("node", F.monotonically_increasing_id()), "groups")
    rows = materialise(rows.join(groups, "source_group").drop("source_group"), "members")
    first = {c: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("node").alias("hub")) for c in ("file_sha256", "perceptual_hash")}
    shared = [rows.join(hubs, c).select(F.col("node").alias("a"), F.col("hub").alias("b")) for c, hubs in first.items()]
    hub = lambda x: first["perceptual_hash"].select(F.col("perceptual_hash").alias(x), F.col("hub").alias(f"{x}_"))
    near = pairs.select("a", "b").join(hub("a"), "a").join(hub("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    edges = reduce(DataFrame.union, [*shared, near]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    whole = materialise(groups.join(components(edges), "node", "left").select(F.coalesce("root", "node").alias("root"), "source_group"), "merged")
    level = whole.select("root", F.col("source_group").alias("line"))
    if fan is None:
        level = level.repartition("root").sortWithinPartitions("root", "line").mapInArrow(_member_digests, "root long, line string")
    else:
        level = _tree_digests(level, fan)
    names = level.select("root", F.concat(F.lit("SOURCE_COMPONENT::"), F.substring("line", 1, 16)).alias("split_group_id"))
    return whole.join(names, "root").select("source_group", "split_group_id")


def apply_splits(manifest: DataFrame, assigned: DataFrame, threshold: int, merged: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """manifest with split and split_group_id. assigned: (grp, split) by source group, of which a derivative has its parent's.

    Derivatives of held-out originals, and those equal or within `threshold` bits of one, get a split that says so.
    merged: as `merged_groups` gives it; assigned is by its split_group_id then. pairs: as `code_pairs` gives them.
    """
    pairs = code_pairs(manifest, threshold) if pairs is None else pairs
    rows = manifest.withColumn("split_group_id", F.col("source_group")) if merged is None else manifest.join(merged, "source_group")
    rows = materialise(rows.join(assigned.select(F.col("grp").alias("split_group_id"), F.col("split").alias("_split")), "split_group_id"), "manifest")
    held = rows.filter(~F.col("is_augmented") & F.col("_split").isin("validation", "test"))
    own = held.select(F.col("perceptual_hash").alias("b")).filter("b is not null").distinct()
    bad = pairs.select("a", "b").union(pairs.select("b", "a")).join(own, "b", "left_semi").select("a").union(own).distinct()
    bad = bad.select(F.col("a").alias("perceptual_hash"), F.lit(True).alias("_near"))
    equal = held.select("file_sha256").filter("file_sha256 is not null").distinct()
    rows = rows.join(bad, "perceptual_hash", "left").join(equal.withColumn("_equal", F.lit(True)), "file_sha256", "left")
    split = F.when(~F.col("is_augmented"), F.col("_split")).when(F.col("_split") != "train", "excluded_parent_not_train").when(F.coalesce("_near", "_equal", F.lit(False)), "excluded_perceptual_collision").otherwise("train")
    return rows.select(*manifest.columns, "split_group_id", split.alias("split"))


def crossing_counts(manifest: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(rule, violations): non-empty values of each field that occur in more than one active split, in one aggregate."""
    long = manifest.filter(F.col("split").isin(*ACTIVE)).select("split", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("value")) for rule, c in fields.items()])).alias("f")).select("split", "f.*")
    per = long.filter("value <> ''").groupBy("rule", "value").agg((F.min("split") != F.max("split")).cast("long").alias("crosses"))
    found = per.groupBy("rule").agg(F.sum("crosses").alias("violations"))
    names = reduce(DataFrame.union, [manifest.sparkSession.range(1).select(F.lit(r).alias("rule")) for r in fields])
    return names.join(found, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).alias("violations"))


def cross_split_pairs(manifest: DataFrame, threshold: int, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, first_split, second_split, distance, pairs): classes of rows with near codes in different active splits.

    Rows of one code and split are counted, not paired one by one; `pairs` is how many pairs of rows a class pair stands for.
    pairs: as `code_pairs` gives them for these codes and perhaps more.
    """
    sizes = materialise(manifest.filter(F.col("split").isin(*ACTIVE) & F.col("perceptual_hash").isNotNull()).groupBy(F.col("perceptual_hash").alias("code"), "split").agg(F.count(F.lit(1)).alias("n")), "codes")
    codes = sizes.select("code").distinct()
    near = (near_pairs(codes, threshold) if pairs is None else pairs).union(codes.select("code", "code", F.lit(0)))
    x, y = sizes.select(F.col("code").alias("a"), F.col("split").alias("first_split"), F.col("n").alias("na")), sizes.select(F.col("code").alias("b"), F.col("split").alias("second_split"), F.col("n").alias("nb"))
    both = near.join(x, "a").join(y, "b").filter((F.col("first_split") != F.col("second_split")) & ((F.col("a") != F.col("b")) | (F.col("first_split") < F.col("second_split"))))
    return both.select("a", "b", "first_split", "second_split", F.col("dist").alias("distance"), (F.col("na") * F.col("nb")).alias("pairs"))


def leakage(manifest: DataFrame, threshold: int, pairs: DataFrame | None = None) -> DataFrame:
    """(rule, violations, ok) of the nine rules: eight fields whose values may not cross splits, and near codes."""
    near = cross_split_pairs(manifest, threshold, pairs).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("violations")).select(F.lit("perceptual_hashes").alias("rule"), "violations")
    return crossing_counts(manifest, LEAKAGE_FIELDS).unionByName(near).withColumn("ok", F.col("violations") == 0)
