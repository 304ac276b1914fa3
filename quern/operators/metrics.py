"""Classification metrics, descriptive and paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import ordered


def ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0) * a, F.lit(1.0) * b), F.lit(0.0))


def class_table(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, support, precision, recall, f1 of every class met as truth or prediction (support 0: prediction only).

    Rows are first counted by (truth, pred), so what is shuffled is the confusion cells.
    """
    by = by or []
    cells = pred.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"), F.lit(0).cast("long").alias("fp")), F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fp")))).alias("s")).select(*by, "s.*")
    t = sides.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    t = t.withColumn("support", F.col("tp") + F.col("fn")).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def summary(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, balanced_accuracy, macro_f1 (truth classes), macro_f1_all (every class met), weighted_f1."""
    t = class_table(pred, by)
    true = F.col("support") > 0
    return t.groupBy(*(by or [])).agg(
        F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(F.when(true, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(true, F.col("f1"))).alias("macro_f1"), F.avg("f1").alias("macro_f1_all"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def quantile(df: DataFrame, by: list[str], value: str, q: float, whole: int = 100_000, accuracy: int = 10_000) -> DataFrame:
    """(by, quantile): the exact, interpolated quantile of the values that are not null, without a group in one task.

    An approximate pass brackets it; a second pass counts what lies below the bracket and how often each value in it occurs.
    Only those, about 8 / accuracy of a group's rows and repeated values once, are put in order. Groups of up to `whole`
    rows have their whole range as the bracket. Empty groups have no row, or null if there is no `by`.
    """
    v = df.select(*by, F.col(value).alias("_v")).filter("_v is not null")
    edges = F.percentile_approx("_v", [max(0.0, q - 4 / accuracy), min(1.0, q + 4 / accuracy)], accuracy)
    bounds = v.groupBy(*by).agg(F.count("_v").alias("_n"), edges.alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    small = F.col("_n") <= whole
    bounds = bounds.select(*by, "_n", F.when(small | F.lit(q - 4 / accuracy <= 0), F.col("_min")).otherwise(F.col("_e")[0]).alias("_low"), F.when(small | F.lit(q + 4 / accuracy >= 1), F.col("_max")).otherwise(F.col("_e")[1]).alias("_high"))
    t = v.join(bounds, by) if by else v.crossJoin(F.broadcast(bounds))  # one row
    below = F.col("_v") < F.col("_low")
    place = F.when(below, F.lit(None)).otherwise(F.col("_v"))
    counts = t.filter(F.col("_v") <= F.col("_high")).groupBy(*by, place.alias("_v")).agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"))
    upto = F.sum("_k").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.asc_nulls_first("_v")))
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    at = (F.col("_n") - 1) * F.lit(q)
    found = counts.withColumns({"_upto": upto, "_at": at}).groupBy(*by).agg(first(F.floor("_at")).alias("_a"), first(F.ceil("_at")).alias("_b"), F.max(F.col("_at") - F.floor("_at")).alias("_f"))
    return found.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))


def describe(df: DataFrame, by: list[str], value: str, t_critical: float = 2.7764451051977987) -> DataFrame:
    """n, mean, sample sd (0 for one value), median, min, max, and a t interval where n is 5."""
    v = F.col(value)
    t = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    middle = quantile(df, by, value, 0.5).withColumnsRenamed({c: f"_{c}" for c in by}).withColumnRenamed("quantile", "median")
    t = t.join(middle, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").select(*by, "n", "mean", "sd", "median", "min", "max")
    half = F.lit(t_critical) * F.col("sd") / F.sqrt("n")
    return t.withColumn("ci_low", F.when(F.col("n") == 5, F.col("mean") - half)).withColumn("ci_high", F.when(F.col("n") == 5, F.col("mean") + half))


def paired(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """Mean, sd, se, t (null when se is 0), df, wins, ties and losses of paired differences."""
    d = F.col(difference)
    t = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))
    se = F.col("sd") / F.sqrt("n")
    return t.withColumn("se", se).withColumn("t", F.try_divide("mean", F.nullif(se, F.lit(0.0)))).withColumn("df", F.col("n") - 1)


def verdict(stats: DataFrame, wins: int = 4) -> DataFrame:
    """One row: advantage if every endpoint has a positive mean, enough wins and an interval above 0; mirrored for disadvantage."""
    up = F.bool_and((F.col("mean") > 0) & (F.col("wins") >= wins) & (F.col("ci_low") > 0))
    down = F.bool_and((F.col("mean") < 0) & (F.col("losses") >= wins) & (F.col("ci_high") < 0))
    return stats.agg(F.when(up, "advantage").when(down, "disadvantage").otherwise("uncertain").alias("verdict"))


def bootstrap(df: DataFrame, value: str, order: str, samples: int, seed: int = 2026, group: str | None = None) -> DataFrame:
    """Percentile interval of the mean per group from deterministic resamples: draw j of resample b takes the value whose
    ordinal is a multiplicative hash of (seed, b, j). For short columns such as seeds or months: they travel as arrays."""
    by = [group] if group else []
    packed = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"))
    draws = packed.select(*by, "v", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("b"))
    at = lambda j: F.pmod((F.col("b") * 7919 + j * 104729 + seed) * 48271 % 2147483647, F.size("v"))
    mean = F.aggregate(F.sequence(F.lit(1), F.size("v")), F.lit(0.0), lambda s, j: s + F.get("v", at(j.cast("long")).cast("int"))) / F.size("v")
    return draws.select(*by, mean.alias("m")).groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def full(pred: DataFrame, by: list[str]) -> DataFrame:
    """The metric set per group: n, classes (of the truth), accuracy, balanced_accuracy, macro and weighted precision and F1, top3, top5.

    pred: truth, pred, top (array of classes, best first) and the group columns, which must not be null.
    """
    t = class_table(pred, by).filter("support > 0")
    weigh = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    rates = t.groupBy(*by).agg(
        F.sum("support").alias("n"), F.count(F.lit(1)).alias("classes"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("f1").alias("macro_f1"), weigh("precision").alias("weighted_precision"), weigh("f1").alias("weighted_f1"),
    )
    hit = lambda k: F.avg(F.array_contains(F.slice("top", 1, k), F.col("truth")).cast("double")).alias(f"top{k}")
    return rates.join(pred.groupBy(*by).agg(hit(3), hit(5)), by)


def by_bin(pred: DataFrame, bin_col: str, bins: list[str]) -> DataFrame:
    """The metric set of every bin in `bins`; an empty one has 0 in all columns."""
    names = pred.sparkSession.createDataFrame([(b,) for b in bins], f"{bin_col} string")
    return names.join(full(pred, [bin_col]), bin_col, "left").na.fill(0)


def package(pred: DataFrame, shots: DataFrame) -> DataFrame:
    """One wide row per sample: prediction, top classes, correctness, training count and its bin. shots: (truth, shots)."""
    from quern.functions.text import frequency_bin_evaluation

    t = pred.join(shots, "truth", "left").withColumn("shots", F.coalesce("shots", F.lit(0)))
    return t.withColumns({"correct": F.col("truth") == F.col("pred"), "in_top3": F.array_contains(F.slice("top", 1, 3), F.col("truth")), "bin": frequency_bin_evaluation(F.col("shots"))})


def strengths(df: DataFrame, part: str, value: str) -> DataFrame:
    """(part, strength, strongest): mean over a part's metrics, and whether it is the largest (ties: the smallest name)."""
    t = df.groupBy(part).agg(F.avg(value).alias("strength"))
    best = t.agg(F.min_by(part, F.struct(-F.round("strength", 6), part)).alias("_best"))
    return t.crossJoin(F.broadcast(best)).select(part, "strength", (F.col(part) == F.col("_best")).alias("strongest"))  # one row


def weighted(df: DataFrame, by: list[str], value: str, weight: str, total: str) -> DataFrame:
    """Mean of value weighted by counts, and the sum of total; a total that is no number raises, a group without weight has mean null."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"), F.sum(F.col(total).cast("double")).alias("total"))


def report_line(name: str) -> Column:
    """A line of a report from the columns of `describe`."""
    return F.format_string("%s: n=%d, %.4f +/- %.4f", F.col(name), F.col("n"), F.col("mean"), F.col("sd"))


def thousands(name: str) -> Column:
    return F.format_number(F.col(name), 0)


def spread(mean: str, sd: str) -> Column:
    return F.format_string("%.4f +/- %.4f", F.col(mean), F.col(sd))


def markdown(df: DataFrame, title: str, columns: dict[str, Column], order: list) -> DataFrame:
    """(line, text) of a Markdown report: title, empty line, a table of the columns in the order given. Nulls are a dash,
    bars in texts are escaped."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    shown = [F.replace(F.coalesce(c.cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")) for c in columns.values()]
    body = ordered.number(df.withColumn("_text", row(shown)), order, "_n").select((F.col("_n") + 4).cast("int").alias("line"), F.col("_text").alias("text"))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return df.sparkSession.createDataFrame(list(enumerate(head, 1)), "line int, text string").unionByName(body)


def confusion_sheets(pred: DataFrame, key: str, pairs: int = 20, samples: int = 12, columns: int = 4) -> DataFrame:
    """One row a tile of the sheets of the most frequent confusions: pair (rank), tile (its name), column and row on the
    sheet, and the row of `pred`. Of each pair the rows with the smallest keys are shown; a pair's rows are cut to those
    before they are shuffled."""
    wrong = pred.filter("truth <> pred")
    top = wrong.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "truth", "pred").limit(pairs)
    ranked = top.withColumn("pair", F.row_number().over(Window.orderBy(F.desc("n"), "truth", "pred")))  # at most `pairs` rows
    t = wrong.join(F.broadcast(ranked), ["truth", "pred"])
    t = t.withColumn("_s", F.row_number().over(Window.partitionBy("pair").orderBy(key))).filter(F.col("_s") <= samples)
    at = F.col("_s") - 1
    return t.withColumns({"tile": F.format_string("P%02d-S%02d", F.col("pair"), F.col("_s")), "column": at % columns, "row": F.floor(at / columns).cast("int")}).drop("_s")
