"""Corpus pipeline: quality, near-duplicates, decontamination, mixture, shards. Each stage is one of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import cut, lookup, scratch, table
from tidelane.llm.decontaminate import leaks
from tidelane.llm.interleave import shard_digest
from tidelane.llm.minhash import near_duplicates
from tidelane.llm.mixing import mixture
from tidelane.llm.quality import quality
from tidelane.llm.queries import DOMAINS, LANGUAGES


def rows_in(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """docs whose (doc_id, text) is among chosen's (doc_id, text_key), or left_anti: is not. Null ids are equal."""
    keys = chosen.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("id_")) & (F.xxhash64(docs["text"]) == F.col("key_"))
    return docs.join(keys, same, how).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the model learns from the labelled rows among them."""
    return quality(docs, table(spark, sf_dir, "labels"), threshold=0.3).where("predicted = 1").select(*docs.columns)


def own_ids(docs: DataFrame) -> DataFrame:
    """docs with node_: doc_id, or for an id with several texts a number from 2^62 on for each of them."""
    keys = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key")).distinct()
    several = keys.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    numbers = cut(keys.join(several, "doc_id").select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), (F.lit(2**62) + F.monotonically_increasing_id()).alias("number_")))
    if numbers.isEmpty():
        return docs.withColumn("node_", F.col("doc_id"))
    same = (docs["doc_id"] == F.col("id_")) & (F.xxhash64(docs["text"]) == F.col("key_"))
    return docs.join(lookup(numbers), same, "left").select(*docs.columns, F.coalesce("number_", "doc_id").alias("node_"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8, and one of equal rows.

    The one that stays has the least doc_id, but ids with several texts come after others: such rows are documents of
    their own, held against all others and each other by their text. Rows without doc_id are not held against others
    and stay.
    """
    again = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = own_ids(docs) if again else docs.withColumn("node_", F.col("doc_id"))
    groups = near_duplicates(rows.select(F.col("node_").alias("doc_id"), "text"), k=5, percent=80)
    gone = groups.where("not kept").select(F.col("doc_id").alias("gone_")).distinct()
    out = rows.join(gone, F.col("node_") == F.col("gone_"), "left_anti").select(*docs.columns)
    if not again:
        return out
    twice = out.groupBy("doc_id", F.xxhash64("text").alias("text_key")).count().where("count > 1 and doc_id is not null")
    if twice.isEmpty():
        return out
    return rows_in(out, twice, "left_anti").unionByName(rows_in(out, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return rows_in(docs, leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the largest mixture in which every domain has its weight and no token comes twice."""
    return rows_in(docs, mixture(docs, DOMAINS, LANGUAGES, share=None, max_epochs=1, seed="mix"), "left_semi")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of the same mixture."""
    return shard_digest(docs, 24, seed="shard")


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: No SQL: the classifier and the MinHash search have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
