"""A corpus from raw documents: filter, deduplicate, decontaminate, mix, shard.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  All but
the last return the columns of ``documents``; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontam, mixing, near_dup, quality, sharding
from panelspark.llm.common import column, fresh, table
from panelspark.llm.queries import MIX
from panelspark.session import scratch_path

# Weights as in the mixing query; one epoch, so that no document comes back twice after
# deduplication.
PIPELINE_MIX = mixing.Mix(MIX.domain, MIX.language, MIX.source, MIX.default, MIX.budget_percent, 1, MIX.seed)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits; null and empty texts go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dup.keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's token budget."""
    return mixing.mixed(docs, PIPELINE_MIX, mixing.domain_of(column("source")))


def shard_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    crc, size = fresh(docs, "text_crc32"), fresh(docs, "size")
    raw = F.encode(F.coalesce(column("text"), F.lit("")), "UTF-8")
    keyed = docs.withColumns({crc: F.crc32(raw), size: F.octet_length(raw)})
    return sharding.shard_rows(keyed, sharding.text_order("doc_id", crc, size)).drop(crc, size)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
    ("sharding", shard_output),
]

# Rolling hashes, MinHash and string tiling have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
