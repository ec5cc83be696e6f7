"""A corpus pipeline: toxicity filter, near-duplicate removal, PII masking, source mixing, packing.

Each stage works on everything that the stage before it kept; its result is written as Parquet to
the shared folder and read back as the next stage's documents, so a lost executor never costs more
than the stage under way. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import mixing, packing, pii, shingles, toxicity
from linkforge.runtime import cut, relieve


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's rejection threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    relieve(spark)  # the model has passed through the driver
    scored = toxicity.score(docs, model, "__linkforge_score")
    return scored.where(F.col("__linkforge_score") < toxicity.threshold(model)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, Jaccard 0.8), the one of the smallest id."""
    return shingles.without_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced by their kind."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests hold every stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
