"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, jaccard, mixing, quality, sharding
from quern.llm.common import remove, shared_folder, table

SHARD_BYTES = 64 << 20
#: Key of the mix in the metadata of ``source``.
MIX = "mix"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order that holds the sources to their target weights.

    Files don't keep an order when they are read again, so the weights go with
    the column ``source`` as metadata; the order follows from them.
    """
    weights = mixing.source_weights(docs)
    decided = {MIX: json.dumps(list(weights.items()))}
    return mixing.mixed_order(docs, weights=weights).withColumn("source", F.col("source").alias("source", metadata=decided))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of about SHARD_BYTES.

    Shards of mixed documents are ranges of the mixed order, so each prefix of
    shards holds the weights; rows come in that order.  Documents that weren't
    mixed are sharded by their metadata.
    """
    decided = docs.schema["source"].metadata.get(MIX)
    if decided is None:
        return sharding.shard(docs, target_bytes=SHARD_BYTES)
    mixed = mixing.mix(docs, weights={s: w for s, w in json.loads(decided)})
    slot = sharding.number(F.col("slot"), max(sharding.COORDINATES - 1, docs.count()))
    placed = sharding.shard(mixed, target_bytes=SHARD_BYTES, dimensions={"slot": slot})
    return placed.orderBy("slot", "place").select(*docs.columns, "shard")


STAGES = [("quality", keep_good), ("near_duplicates", keep_distinct), ("decontaminate", keep_clean), ("mix", mix_sources), ("shard", shard)]

#: Perplexity, MinHash classes and the mixed order have no SQL: tests hold run() against brute
#: force, and mix and shard against the weights and the order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    What a stage wrote is deleted once the next one's output is written; the
    last written one stays, since the result is read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{i}-{name}")
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
