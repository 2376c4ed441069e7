"""Corpus pipeline: classify, join near copies, cut passages, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it again as the next stage's docs.

1. The quality classifier is trained on ``labels``; documents it rejects go.
2. Of each group of documents that n-gram Jaccard links connect (five words, 0.8), the least doc_id stays.
3. Later occurrences of passages that documents share are cut out.
4. Sources are mixed to their target weights: a document comes once for each copy drawn.
5. Texts become SentencePiece ids with source byte offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import jaccard, mixing, passages, pieces, quality
from gristmill.llm.registry import tokenizer_file
from gristmill.llm.store import Scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_documents(docs, quality.train(docs, labels))
    return scored.filter(F.col("quality_score") >= quality.THRESHOLD).drop("quality_score")


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by doc_id and text; exact repeats of a row count as one. Rows without words all stay. Names that begin with ``_stage_`` are reserved."""
    id_ = lambda: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    groups = jaccard.grouped(docs).filter("root is not null").groupBy("root").agg(F.min(F.struct(id_().alias("_stage_id"), F.col("th").alias("_stage_text"))).alias("r"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    told = docs.filter(has_words).withColumn("_stage_id", id_()).withColumn("_stage_text", F.xxhash64("text"))
    kept = told.join(groups.select("r.*"), ["_stage_id", "_stage_text"]).dropDuplicates(["_stage_id", "_stage_text"])
    return kept.select(*docs.columns).unionByName(docs.filter(~has_words))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, tokenizer_file(), ["doc_id", "source"])


STAGES = [("quality_classifier", classify), ("jaccard_join", join_near_copies), ("substring_dedup", cut_passages), ("mix_sources", mix), ("sentencepiece", encode)]

#: Training, min-hashes and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
