"""From raw documents to sharded training rows: five stages, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and is written as Parquet and read again before the next.
All but the last return the columns of ``documents``; the last adds the row's shard, whose slots
follow the mix: a shard read by slot gives its rows in the order of the mix.

Defined cases: null and empty texts fail the base test and go; rows of one id are rows of their own
until the near-duplicates, where they are one document; of equal texts the smallest id stays; a null
source is a source; a stratum or an empty table without labels has no rules; an empty table stays
empty through all stages; extra columns are kept, whatever their names, but for those that the last
stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.decontaminate import without_contaminated
from fathomline.llm.entry import SHARDS, table
from fathomline.llm.minhash import near_duplicates
from fathomline.llm.mixing import in_mixed_order, tempered, with_position
from fathomline.llm.quality import keep_good
from fathomline.llm.sharding import sharded
from fathomline.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the certified rules."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix: sources to weights by the square root of their rows."""
    return in_mixed_order(docs, tempered(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``size, text_crc32, law, shard, slot, grown_shard``; the mix, which the rows decide, is worked out again for the slots."""
    return sharded(with_position(docs, tempered(docs), "_mixed"), SHARDS, position_col="_mixed")


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: SQL expresses neither the certified cutoffs nor the seeded search; the tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
