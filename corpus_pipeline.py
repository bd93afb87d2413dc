"""The corpus pipeline: raw documents to packed training sequences.

Every stage calls one operator of ``loomtext.llm``, takes (spark, docs, sf_dir)
and returns a DataFrame; ``run`` writes what a stage returns as Parquet and
reads it again as the next one's documents.  All but the last stage return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.llm import decontaminate, neardup, packing, pii, quality
from loomtext.llm._shared import Workspace, few

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ranker = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, ranker, "text", "lang", "source", "n_chars").where("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id, and of rows that share it the least text.

    Rows without an id are not compared and stay.
    """
    docs = docs.select(*COLUMNS)
    kept = neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"))
    one = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        one = one.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    # written, so that Spark knows its size when it chooses the join
    gone = Workspace(spark, "contaminated").save(found.select(F.col("doc_id").alias("gone_id")).distinct(), "ids")
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact_pii(docs.select(*COLUMNS), pii.learn(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences, by their real ids; near copies are gone, equal texts without an id conflict."""
    import public_tokenizers

    # written, so that the texts are tokenised once
    items = packing.sized_by_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(Workspace(spark, "packing").save(few(items, docs.count()), "sizes"))


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, weighted sampling and the random field are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.save(docs, f"stage-{i}")
    return docs
