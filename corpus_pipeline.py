"""A cleaning pipeline over `documents`: each stage applies one operator of voxloom.llm to all that the stage before kept.

run(spark, sf_dir) gives the last stage's rows. Each stage's result is written as Parquet to the folder that all executors
share and read again, so a lost executor costs at most the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, decontam, quality, simhash, suffix_dedup
from voxloom.llm.common import new_path, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels of ids that occur here are learned from; a null text is judged as an
    empty one; all columns pass through, whatever their names."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_vx_score").where(F.col("_vx_score") >= quality.THRESHOLD).select(*(f"`{x}`" for x in docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, and one row of it.

    512-bit fingerprints of five-word shingles find candidates; two texts are of one group only through links with a Jaccard
    similarity of 0.8 or more between the shingle sets themselves.
    """
    return simhash.keep_one(spark, docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes, that occurred before, in an earlier document or earlier in the same one, are
    cut out of the text."""
    out = suffix_dedup.dedup_text(spark, docs, suffix_dedup.PASSAGE, keep="first", words=suffix_dedup.WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found: rows whose own text holds one go, other rows of the same id stay.

    Null, empty and short texts hold nothing and stay; all columns pass through.
    """
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.coalesce(F.col("text").cast("string"), F.lit("")))
    asked = docs.select(key.alias("doc_id"), "text")
    found = decontam.find_items(asked, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_vx_found")).distinct()
    found = stored(spark, found, "found")
    found = F.broadcast(found) if found.count() <= decontam.SKETCH_ROWS else found
    return docs.join(found, key == F.col("_vx_found"), "left_anti")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and input_ids, which replace columns of these names; a null text has no ids."""
    return bpe.with_ids(docs, *bpe.default_tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: A network, fingerprints and suffix arrays have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
