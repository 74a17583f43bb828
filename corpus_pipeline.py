"""From raw documents to packed sequences: the stages, applied in order.

Each stage takes (spark, docs, sf_dir) and returns documents with their columns, the last
one the pieces of packed sequences. run() writes what a stage returns and reads it again
for the next one, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from tesserine.llm.common import materialize, table


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from all but their first document; every document stays."""
    return _sized(line_dedup.dedup_lines(docs).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Rows are told apart by id and text: of rows that repeat both one stays, where one id
    stands on several texts only those that are copies go, and a row without an id goes if
    it repeats another's text. Where two different rows meet in one 64-bit key, which a second
    hash shows, both stay.
    """
    # a null id takes the smallest number, so that its rows link like others
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.withColumn("__key", F.xxhash64(number, F.xxhash64("text"), F.crc32("text"))).withColumn("__also", F.xxhash64(F.lit("also"), number, "text"))
    groups = ngram_join.near_duplicates(keyed.select("__key", "text"), id_col="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    held = keyed.groupBy("__key").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"), (F.min("__also") == F.max("__also")).alias("alike"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("__key"))
    placed = materialize(held.join(groups, "__key").select("__key", "n", "alike", "component_id", order.alias("o")), "groups")
    first = placed.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.__key").alias("__key"))
    gone = materialize(placed.where("alike").join(first, "__key", "left_anti").select("__key"), "later-copies")
    again = materialize(placed.where("n > 1 and alike").select("__key"), "repeated-rows")
    kept = keyed.join(gone, "__key", "left_anti")
    once = kept.join(again, "__key", "left_anti").unionByName(kept.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return once.select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return _sized(secret_scan.mask_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, concatenated and cut to sequences of 4096."""
    return packing.pack(docs, window=4096, end_id=2, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-").lower())
    return docs
