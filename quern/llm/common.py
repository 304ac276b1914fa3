"""Helpers shared by the corpus operators: keys of documents; the shared folder and components come from the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import components, discard, materialise, shared_dir, star_edges

__all__ = ["NULL_ID", "components", "discard", "doc_keys", "fresh", "hot_keys", "join_hot", "materialise", "public_id", "shared_dir", "small_batches", "star_edges"]

#: Stands for a null id inside joins; sorts before all other ids.
NULL_ID = -(1 << 63)


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df itself; from now on the session sends at most `rows` rows in an Arrow batch, as whole texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def doc_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, _text): _id is never null; _h tells apart different texts under one id and is 0 if ids are unique.

    Rows equal in id and text are one document. Only the two named columns are read.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text_col).alias("_text"))
    repeated = not slim.groupBy("_id").count().filter("count > 1").select("_id").limit(1).isEmpty()
    h = F.coalesce(F.xxhash64("_text"), F.lit(0)) if repeated else F.lit(0).cast("long")
    return slim.select("_id", h.alias("_h"), "_text")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns of df in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if it has more than SALTS rows and over one HOT-th of all, so fewer than HOT keys are hot.
HOT, SALTS = 1_024, 64


def hot_keys(counts: DataFrame, key: str, count: str = "n") -> DataFrame:
    """The hot keys of `counts`, which hold each key once with its number of rows. counts are read twice: pass a written table."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.filter((F.col(count) > SALTS) & (F.col(count) * HOT > total)).select(key)


def join_hot(rows: DataFrame, labels: DataFrame, key: str, hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with labels, which hold each key once, so that no task meets all rows of a hot key.

    The hot keys, fewer than HOT, are broadcast. Their rows are dealt over SALTS tasks by a hash of the columns `spread`,
    and each task has a copy of the label. Null keys match nothing.
    """
    salt, heat = fresh(rows, "salt", "heat")
    hot = F.broadcast(hot.withColumn(heat, F.lit(True)))
    deal = F.when(F.col(heat), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col(heat), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn(salt, deal).drop(heat)
    right = labels.join(hot, key, "left").withColumn(salt, F.explode(copies)).drop(heat)
    return left.join(right, [key, salt], how).drop(salt)


def public_id(col) -> F.Column:
    """The id as given: null again where it was null."""
    return F.nullif(col, F.lit(NULL_ID))
