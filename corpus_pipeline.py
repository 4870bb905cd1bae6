"""A corpus pipeline over ``documents``: quality, near-duplicates, decontamination, secrets, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row of its predecessor; all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, quality, secrets, simhash, tiling
from lodestone.llm.common import StageTables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies between their language's thresholds stay."""
    judged = quality.classify(docs, quality.trusted_ids(spark, sf_dir))
    return judged.filter("keep").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of pairs with a 5-word Jaccard similarity of 0.8 or more stays."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    found = tiling.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, and ``n_chars`` follows; no document goes."""
    found = secrets.find_secrets(docs)
    text = secrets.redacted(F.col("text"), F.col("secret_spans"))
    hit = F.size("secret_spans") > 0
    found = found.withColumn("n_chars", F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return found.withColumn("text", text).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, little-endian unsigned 32-bit."""
    encoded = bpe.encode(docs, bpe.share(spark, bpe.default_vocabulary()))
    return encoded.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("bpe", token_ids),
]

#: SQL cannot express near-duplicate components, tiling or the merges of a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tables = StageTables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
