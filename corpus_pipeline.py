"""A corpus pipeline of five stages over ``documents``: language, quality, lines, near-duplicates, packing.

Each stage takes what its predecessor kept, written as Parquet and read back.  All but the last return the columns of
``documents``; a stage's decisions show in them: rejected documents are gone, dropped lines are gone from ``text`` (and
``n_chars`` follows), of a near-duplicate group the document with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, language, lines, neighbours, packing, shingles, simhash


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) or with none that is likely go; a null ``lang`` takes the predicted one."""
    kernel = language.fit(common.table(spark, sf_dir, "documents"))
    sure = (F.col("lang_pred") != language.UND) & (F.col("lang_score") >= language.SURE)
    return language.identify(docs, kernel).filter(sure).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality go."""
    voter = neighbours.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return neighbours.classify(docs, voter).filter("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from every document."""
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    return kept.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more stays, the one with the smallest id.

    Operator 3's fingerprints and pivot tables give the closest candidates, minhashes and prefixes those too far apart for them.
    """
    return simhash.firsts(docs, shingles.groups(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models, fingerprints and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
