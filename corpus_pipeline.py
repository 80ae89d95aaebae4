"""The corpus pipeline: toxic documents go, fuzzy repeats of lines go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, and what is left is encoded. Each stage reads what the one before it wrote.

Rows without an id pass the filters by near-duplicates; rows that share an id are judged together: if one is rejected, all are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_documents
from tessera.llm.common import new_folder, ready, stage, table
from tessera.llm.decontaminate import contaminated
from tessera.llm.line_dedup import if_small, line_dedup
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.toxicity import toxicity

#: Jaccard similarity of word shingles, in percent, from which documents count as near-duplicates.
NEAR_PERCENT = 80
#: The stages' models and signatures can't be said in SQL.
ORACLE_SQL = None


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of docs without those whose id is rejected; the ids are broadcast only if there are few of them."""
    ids = stage(rejected.select("doc_id").distinct(), "rejected")
    return docs.join(if_small(ids, ids.count(), 48), "doc_id", "left_anti").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return _without(docs, toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return line_dedup(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return _without(docs, near_duplicates(docs, percent=NEAR_PERCENT).where("not kept"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark"), keep_text=False).where("contaminated"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage), ("line dedup", line_stage), ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage), ("bpe encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, one in STAGES[:-1]:
        path = new_folder(spark, "pipeline")
        one(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
