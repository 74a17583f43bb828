"""The data set's tables as the engine's model: graph, domains and messages."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.graph import Graph
from tesserine.operators.postings import LAYOUT, PostingsIndex
from tesserine.operators.search import Lines
from tesserine.scratch import scratch_dir
from tesserine.sources.readers import lines_of, read_table

#: The moment that look-backs count from.
AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def document_lines(spark: SparkSession, root: str) -> DataFrame:
    """Documents as files of lines: file, file_idx, source, lang, line_no, line."""
    docs = read_table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("file_idx"), "source", "lang", "text")
    return lines_of(docs, "text")


def document_entries(spark: SparkSession, root: str) -> DataFrame:
    """file_idx, entry_idx (the line, from 0), text of the non-blank lines."""
    return document_lines(spark, root).where(F.trim("line") != "").select("file_idx", (F.col("line_no") - 1).alias("entry_idx"), F.col("line").alias("text"))


def _numbered(files: list[str]) -> list[int]:
    return [int(f) for f in files]


def domains(spark: SparkSession, root: str) -> dict[str, Lines]:
    """The searchable domains: documents, conversations, pages and benchmark items. Their files are numbered by the tables' ids."""

    def texts(table: str, key: str, text: str) -> Lines:
        rows = read_table(spark, root, table)

        def cut(df: DataFrame) -> DataFrame:
            return lines_of(df.select(F.col(key).cast("string").alias("file"), text), text)

        return Lines(cut(rows), lambda files: cut(rows.where(F.col(key).isin(_numbered(files)))))

    said = read_table(spark, root, "conversations")

    def turns(df: DataFrame) -> DataFrame:
        return df.select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).cast("int").alias("line_no"), F.col("text").alias("line"), "role")

    sessions = Lines(turns(said), lambda files: turns(said.where(F.col("conv_id").isin(_numbered(files)))))
    return {"documents": texts("documents", "doc_id", "text"), "sessions": sessions, "pages": texts("pages", "page_id", "html"), "benchmark": texts("benchmark", "item_id", "text")}


_TABLES = {"documents": "documents", "sessions": "conversations", "pages": "pages", "benchmark": "benchmark"}


def _fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: another one where the table has changed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    files = []
    while found.hasNext():
        s = found.next()
        files.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr([LAYOUT, *sorted(files)]).encode()).hexdigest()[:16]


def index(spark: SparkSession, root: str, domain: str) -> PostingsIndex:
    """The index of one domain. It is stored under its table's fingerprint and built where none is, so a changed table gets another one."""
    name = _TABLES[domain]
    held = PostingsIndex(spark, f"{scratch_dir(spark)}/indexes/{domain}-{_fingerprint(spark, f'{root}/{name}.parquet')}")
    if not held.store.version():
        lines = domains(spark, root)[domain].all
        number = F.col("file").cast("long")
        entries = lines.where(F.trim("line") != "").select(number.alias("file_idx"), (F.col("line_no") - 1).alias("entry_idx"), "line_no", F.col("line").alias("text"))
        files = lines.groupBy("file").agg(F.count("*").alias("size")).select("file", number.alias("file_idx"), F.lit(0).alias("modified"), "size", F.lit(False).alias("tombstoned"))
        try:
            held.create(entries, files)
        except RuntimeError:
            # another application was quicker with the same index
            if not held.store.version():
                raise
    return held


def graph(spark: SparkSession, root: str) -> Graph:
    """Regions, nations, customers and suppliers as entities; where they lie as relations.

    A customer's orders are its observations; it was created with its first order and
    updated with its last.
    """
    region, nation, customer, supplier, orders = (read_table(spark, root, t) for t in ("region", "nation", "customer", "supplier", "orders"))
    fixed = F.lit("1992-01-01 00:00:00").cast("timestamp")
    times = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"), F.count("*").alias("revision"))
    named = customer.join(times, F.col("c_custkey") == F.col("o_custkey"), "left")

    def plain(df: DataFrame, name: str, kind: str) -> DataFrame:
        return df.select(F.col(name).alias("name"), F.lit(kind).alias("entity_type"), fixed.alias("created_at"), fixed.alias("updated_at"), F.lit(0).cast("long").alias("revision"))

    people = named.select(F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("entity_type"), F.coalesce("created_at", fixed).alias("created_at"), F.coalesce("updated_at", fixed).alias("updated_at"), F.coalesce("revision", F.lit(0)).cast("long").alias("revision"))
    entities = plain(region, "r_name", "region").unionByName(plain(nation, "n_name", "nation")).unionByName(plain(supplier, "s_name", "supplier")).unionByName(people)
    content = F.concat_ws(" ", F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    observations = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("obs_id"), F.col("c_name").alias("name"), content.alias("content"), F.col("o_orderdate").alias("created_at"))

    def edge(df: DataFrame, src: str, key: str, kind: str, ends: DataFrame, end_key: str, end_name: str) -> DataFrame:
        return df.join(ends, F.col(key) == F.col(end_key)).select(F.col(src).alias("src"), F.col(end_name).alias("dst"), F.lit(kind).alias("relation_type"), fixed.alias("created_at"))

    relations = edge(customer, "c_name", "c_nationkey", "located_in", nation, "n_nationkey", "n_name").unionByName(edge(supplier, "s_name", "s_nationkey", "located_in", nation, "n_nationkey", "n_name")).unionByName(edge(nation, "n_name", "n_regionkey", "part_of", region, "r_regionkey", "r_name"))
    return Graph(entities, observations, relations)
