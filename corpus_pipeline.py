"""Cleaning a corpus in stages: each works on all rows that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
session's shared checkpoint folder and reads again as the next one's docs. All but the last return
the columns of documents; further columns of the input pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dup
from lumenframe.session import attach, checkpointed, release, shared_folder

#: Near copies: words of a shingle and Jaccard similarity of the shingle sets.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Documents whose language is less probable than this are rejected, like those without any letter.
LEAST_SCORE = 0.5


def packed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, rest): all other columns wait in one struct, so that no name of theirs can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(None).alias("none")])).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, some of them changed."""
    column = lambda c: changed[c] if c in changed else F.col(c) if c in ("doc_id", "text") else F.col("rest")[c]
    return rows.select(*[column(c).alias(c) for c in docs.columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, null texts and undecided ones go."""
    attach(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    marked = language_id.predict(packed(docs), model)
    return unpacked(marked.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows the text."""
    rows = packed(docs)
    kept = line_dedup.apply_bitmaps(rows, line_dedup.drop_bitmaps(rows))
    return unpacked(kept.select("doc_id", F.col("kept_text").alias("text"), "rest"), docs, n_chars=F.char_length("text").cast("long"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8), that of the smallest doc_id."""
    attach(spark)
    release(spark)
    rows = packed(docs).withColumn("r", F.xxhash64("text"))
    stays = near_dup.representatives(rows, NEAR_WORDS, NEAR_SIMILARITY).select(F.col("doc_id").alias("stay_id"), F.col("r").alias("stay_r"))
    stays = checkpointed(stays)
    release(spark)
    met = rows.join(stays, (F.col("r") == F.col("stay_r")) & F.col("doc_id").eqNullSafe(F.col("stay_id")), "left_semi")
    return unpacked(met.dropDuplicates(["doc_id", "r"]), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = packed(docs)
    found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(rows.select("*", *line_dedup.row_keys()).join(found.select("r1", "r2").distinct(), ["r1", "r2"], "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of what is left."""
    import public_tokenizers

    attach(spark)
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("near_dup", keep_one), ("decontaminate", drop_leaks), ("byte_bpe", encode)]

#: Language model, fingerprints and tokenizer have no SQL form: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
