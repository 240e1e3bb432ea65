"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, lines, perplexity, sharding, substrings, warc
from .decontaminate import contaminated
from .minhash import SQL as NEAR_SQL
from .minhash import near_duplicates
from .mixing import mix, tempered
from .quality import assess


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SHARDS = 40


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to weights by the square root of their rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, tempered(docs)).drop("text")


def op3_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.remove_repeated_passages(table(spark, sf_dir, "documents")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.digest(perplexity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spaced_seeds": op1_spaced_seeds,
        "op2_pfair_mix": op2_pfair_mix,
        "op3_jump_hash": op3_jump_hash,
        "op4_suffix_array": op4_suffix_array,
        "op5_quality_rules": op5_quality_rules,
        "op6_line_hashing": op6_line_hashing,
        "op7_minhash": op7_minhash,
        "op8_zip_warc": op8_zip_warc,
        "op9_cross_entropy": op9_cross_entropy,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jump_hash": sharding.sql(SHARDS), "op6_line_hashing": lines.SQL, "op7_minhash": NEAR_SQL, "op8_zip_warc": warc.SQL, "op9_cross_entropy": perplexity.SQL, "op10_license_scan": licenses.sql()}
