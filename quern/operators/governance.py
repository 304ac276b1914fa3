"""Strict coercion, schema mapping, frozen tables, provenance and verification of runs, as checks over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two prediction schemas and the common one. Fixed values.
COLUMN_MAPS = {
    "rapt": {"true_class_index": "target_index", "true_full_label": "target_label", "predicted_full_label": "prediction_label", "true_base_label": "true_base", "true_modifier_label": "true_modifier", "predicted_base_from_full": "derived_base", "predicted_modifier_from_full": "derived_modifier", "training_original_sample_count": "count"},
    "resnet": {"class_index": "target_index", "class_label": "target_label", "predicted_label": "prediction_label", "predicted_base_from_character": "derived_base", "predicted_modifier_from_character": "derived_modifier", "training_original_count": "count"},
}


def _strict(text: Column, value: Column, what: str, strict: bool) -> Column:
    kind = {"number": "double", "whole number": "long", "truth value": "boolean"}[what]
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {what}: "), F.coalesce(text, F.lit("null")))).cast(kind)) if strict else value


def finite(text: Column, strict: bool = True) -> Column:
    """The text as a finite number; else it raises, or is null if not strict."""
    x = F.trim(text).try_cast("double")
    return _strict(text, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), "number", strict)


def whole(text: Column, strict: bool = True) -> Column:
    x = finite(text, False)
    return _strict(text, F.when(x == F.floor(x), x.cast("long")), "whole number", strict)


def truth(text: Column, strict: bool = True) -> Column:
    low = F.lower(F.trim(text))
    return _strict(text, F.when(low == "true", True).when(low == "false", False), "truth value", strict)


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def unified(predictions: DataFrame, model: str) -> DataFrame:
    """The columns of a model's predictions under their common names, and `model`."""
    return predictions.withColumnsRenamed(COLUMN_MAPS[model]).withColumn("model", F.lit(model))


def json_keys(text: Column) -> Column:
    """Every object key of a JSON text, at any depth: string tokens in turn, those before a colon, with their escapes resolved."""
    tokens = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"\s*:?)'), 1)
    keys = F.transform(F.filter(tokens, lambda t: t.endswith(":")), lambda t: F.regexp_replace(t, r"\s*:$", ""))
    return F.transform(keys, lambda t: F.coalesce(F.from_json(F.concat(F.lit('{"k":'), t, F.lit("}")), "k string")["k"], t))


def guarded(df: DataFrame, json_col: str, word: str = "test", allowed: tuple[str, ...] = ("test_access",)) -> DataFrame:
    """Rows whose JSON has, at any depth, a key that contains `word` and is not allowed; `keys` lists them."""
    found = F.filter(json_keys(F.col(json_col)), lambda k: F.lower(k).contains(word) & ~F.lower(k).isin(*allowed))
    return df.withColumn("keys", F.array_sort(F.array_distinct(found))).filter(F.size("keys") > 0)


def frozen(df: DataFrame, by: str, line: Column) -> DataFrame:
    """(by, n, digest): a digest of each part's lines whatever their order: sums of the four quarters of their sha256."""
    h = F.sha2(line, 256)
    quarters = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.select(F.col(by), *[q.alias(f"q{i}") for i, q in enumerate(quarters)]).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"q{i}").alias(f"q{i}") for i in range(4)])
    return sums.select(by, "n", F.sha2(F.concat_ws(":", *[F.col(f"q{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def verify_frozen(stored: DataFrame, actual: DataFrame, by: str, deferred: tuple[str, ...] = ()) -> DataFrame:
    """(by, status): match, mismatch, missing or extra; parts in `deferred` are not compared and say so."""
    both = stored.select(by, F.struct("n", "digest").alias("s")).join(actual.select(by, F.struct("n", "digest").alias("a")), by, "full")
    status = F.when(F.col(by).isin(*deferred), "deferred") if deferred else F.when(F.lit(False), "")
    return both.select(by, status.when(F.col("a").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s") == F.col("a"), "match").otherwise("mismatch").alias("status"))


def verify_counts(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, check, ok) for every column that both have beside the key; a key that one lacks fails all its checks."""
    names = [c for c in expected.columns if c != key and c in actual.columns]
    both = actual.select(key, *[F.col(c).alias(f"a_{c}") for c in names]).join(expected.select(key, *[F.col(c).alias(f"e_{c}") for c in names], F.lit(True).alias("_e")), key, "full")
    checks = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col("_e") & F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}")), F.lit(False)).alias("ok")) for c in names])
    return both.select(key, F.explode(checks).alias("c")).select(key, "c.*")


def inconsistent(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, n_values) where a group of rows that must share its provenance columns has more than one value (null counts)."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in columns])).alias("p")).select(*by, "p.*")
    return long.distinct().groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")


def assemble(parts: dict[str, DataFrame], complete: DataFrame, key: str) -> DataFrame:
    """Union of the parts with `part`, only of the keys that are complete."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(name)) for name, p in parts.items()])
    return rows.join(complete.select(key).distinct(), key, "left_semi")


def canonical_json(keys: Column, compact: bool = True) -> Column:
    """{"0": first key, ...} of a sorted array, with or without blanks after the separators: the two hash differently."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    quoted = F.transform(keys, lambda k, i: F.concat(F.lit('"'), i.cast("string"), F.lit(f'"{colon}'), F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2)))
    return F.concat(F.lit("{"), F.array_join(quoted, comma), F.lit("}"))


def recorded(runs: DataFrame, expected: DataFrame, key: str, fields: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, status) of every expected run: `match` if each place of `runs` that records the field agrees with it,
    `mismatch` if one does not, `missing` if none records it, `absent` if it may be left out.

    `fields` lists the places of each field, which `expected` has as a column. A run that is not there misses everything.
    """
    names = {c: f"_run_{c}" for places in fields.values() for c in places}
    t = expected.join(runs.select(key, *[F.col(c).cast("string").alias(n) for c, n in names.items()]), key, "left")

    def status(field: str) -> Column:
        found = F.array_compact(F.array(*[F.col(names[c]) for c in fields[field]]))
        none = F.lit("absent" if field in optional else "missing")
        return F.when(F.size(found) == 0, none).when(F.forall(found, lambda x: x.eqNullSafe(F.col(field).cast("string"))), "match").otherwise("mismatch")

    checks = F.array(*[F.struct(F.lit(f).alias("field"), status(f).alias("status")) for f in fields])
    return t.select(key, F.explode(checks).alias("_c")).select(key, "_c.*")
