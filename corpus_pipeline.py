"""From raw documents to token ids: a pipeline of five stages.

Each stage is called as ``f(spark, docs, sf_dir)`` with what its predecessor kept, its
result is written as Parquet and read again. All but the last return the columns of
``documents``; the last returns each document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlake.llm import bpe, decontam, exact_dedup, langid, ngram_join
from partlake.llm.queries import tokenizer_path
from partlake.llm.rows import drop_keys, fresh
from partlake.llm.scratch import Scratch

#: Near copies share 4/5 of their five-word shingles.
SHINGLE, NUM, DEN = 5, 4, 5
#: Texts with a word, and so with shingles.
NOT_BLANK = "[^\\\\x20\\\\x09-\\\\x0D]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that can have a language; those without any letter go, whether or not profiles could be learned.

    Null and empty texts have no letter. Rows go by id and text, so null and repeated ids are
    judged row by row. Here and in the next three stages an empty table stays empty and columns
    of any name pass through.
    """
    profiles = langid.learn_profiles(docs)
    row = fresh(docs, "__row")
    keyed = docs.withColumn(row, F.xxhash64("text"))
    said = langid.predict_languages(keyed, profiles, keep=(row,))
    bad = said.where(~F.col("has_letters"))
    return drop_keys(keyed, bad, {"doc_id": "doc_id", row: row}, Scratch(spark, "language-id")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, keep the longest row, then the smallest id; null counts as empty, null ids come last."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, keep the row with the smallest id (nulls last), then the smallest text hash.

    Null, empty and blank texts have no shingles and stay. Of rows equal in id and text one
    stays. A clean row under the id of a near copy stays.
    """
    row = fresh(docs, "__row")
    keyed = docs.withColumn(row, F.xxhash64("text"))
    groups = ngram_join.jaccard_components(keyed, k=SHINGLE, num=NUM, den=DEN, row_col=row)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.id")) & F.col(row).eqNullSafe(F.col("first.row"))
    gone = groups.where(F.col("first").isNotNull() & ~is_first)
    left = drop_keys(keyed, gone, {"doc_id": "doc_id", row: row}, Scratch(spark, "near-copies"))
    kept = groups.where(F.col("first").isNotNull() & is_first).groupBy("doc_id", row)
    if kept.count().where("count > 1").limit(1).count():  # rows equal in id and text
        place = fresh(keyed, "__rn")
        again = F.row_number().over(Window.partitionBy("doc_id", row).orderBy("text"))
        blank = F.expr(f"NOT coalesce(text, '') RLIKE '{NOT_BLANK}'")
        left = left.withColumn(place, again).where((F.col(place) == 1) | blank)
    return left.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; null and repeated ids are judged row by row, null texts contain nothing."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ``ids``, number of tokens, and the hash of the bytes that they decode to, for every row; null counts as empty."""
    import public_tokenizers

    ranks, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip_column(docs, ranks, pattern)
    return decoded.select(
        "doc_id",
        F.expr("length(ids) DIV 4").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: Encoding by merge ranks has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        out = scratch.write(stage(spark, docs, sf_dir), name, keep=True)
        if last is not None:
            scratch.drop(last)
        docs = last = out
    return docs
