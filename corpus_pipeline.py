"""Five stages over `documents`: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and is the next stage's docs. All but the
last return the columns of documents, whatever else they are called. Part of the corpus operators: it lives and goes with
that subpackage.

Ids are numbers and may be null or repeated: rows are told apart by id and text, and rows equal in both are one document,
which the near-duplicate stage keeps once and the others treat alike. Null, empty and letterless texts go in the first
stage. Whole texts are read however long they are. An empty table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, language_id, packing, simhash_dedup, substring_dedup
from quern.llm.common import NULL_ID, discard, fresh, materialise
from quern.llm.queries import table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (null, or no letter) go, also if there was no language to learn."""
    model = language_id.train(docs, tokenizer_path("piece_bpe_32k.model"))
    if not model.languages:
        worded = F.udf(lambda text: len(language_id.words_of(text)) > 0, "boolean")
        return docs.filter(worded("text"))
    own = {c: fresh(docs, c)[0] for c in docs.columns if c.lower() in ("lang_pred", "score")}
    kept = language_id.predict(docs.withColumnsRenamed(own), model).filter("lang_pred <> 'und'")
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints the document with the smallest id stays (null ids last)."""
    return simhash_dedup.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows go; untouched texts stay as they are, and emptied documents go."""
    cut = substring_dedup.remove_repeats(docs, keys=True).filter("n_removed > 0").select("_id", "_h", "kept_text")
    i, h, kept = fresh(docs, "id", "h", "kept")
    cut = materialise(cut, "cut").toDF(i, h, kept)
    unique = cut.filter(F.col(h) != 0).isEmpty()  # the hash is 0 if ids are unique; else it tells texts apart, and equal rows are cut alike
    cut = cut if unique else cut.dropDuplicates([i, h])
    rows = docs.withColumns({i: F.coalesce("doc_id", F.lit(NULL_ID)), h: F.lit(0).cast("long") if unique else F.xxhash64("text")})
    rows = rows.join(cut, [i, h], "left").filter(F.col(kept).isNull() | (F.col(kept) != ""))
    rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long")))
    return rows.withColumn("text", F.coalesce(kept, "text")).select(*[f"`{c}`" for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    key = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("h"))  # ids may be null or repeated
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(found.filter(decontaminate.is_contaminated()).select("doc_id.id", "doc_id.h").distinct(), "contaminated")
    i, h = fresh(docs, "id", "h")
    return docs.withColumns({i: key["id"], h: key["h"]}).join(gone.toDF(i, h), [i, h], "left_anti").select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of at most 2048 tokens."""
    pieces = packing.pieces_of(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=False).drop("ids")
    return packing.pack(pieces)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: Language models, fingerprints and token ids are beyond SQL; tests hold run() against chained brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if written is not None:  # the stage's input, which nothing reads any more
            discard(written)
        written = docs
    return docs
