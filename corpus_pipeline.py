"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's documents. All stages but
the last return the columns of documents. SQL can't express the stages. All stages take
null in any column, empty and very long texts, repeated rows, empty tables (an empty
result) and further columns, which pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm import bpe, mixing, pii, simhash, toxicity
from rasterflow.llm.common import documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon doesn't reject; labels come from ``sf_dir``. Null and empty texts have no evidence; repeated rows go or stay together."""
    lexicon = toxicity.learn_lexicon(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Null, empty and blank texts are one group; of repeated rows one stays."""
    return simhash.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows where a text changed. Null and empty texts stay as they are."""
    kept = docs.withColumn("_before", F.col("text"))
    new = pii.pseudonymise(kept)
    same = F.col("text").eqNullSafe(F.col("_before"))
    return new.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null texts count no words; null sources are one source."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of the ids and of what they decode to. Null and empty texts have no ids; repeated rows have a result each."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole of ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
