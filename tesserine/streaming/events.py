"""Streams: windows over event time with their late rows, tables and indexes that grow by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserine.functions.text import date_in_name
from tesserine.operators.postings import PostingsIndex
from tesserine.plans.snapshot import Append, SnapshotStore
from tesserine.sources import readers


def event_stream(spark: SparkSession, folder: str, schema: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Parquet files of a folder as a stream with a watermark."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, width: str, key: str, ts: str = "ts") -> DataFrame:
    """Counts and sums by window and key; works on a stream and on a table."""
    counted = events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts") -> DataFrame:
    counted = events.groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    counted = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_stream(stream: DataFrame, store: SnapshotStore, width: str, key: str, late: str, checkpoint: str, ts: str = "ts", name: str = "windows", buckets: int = 16) -> StreamingQuery:
    """Tumbling windows of a stream, kept in the store's table `name`, and what came too late for them in `name`_late.

    The watermark is the latest time of the batches before, less the late duration, as
    Spark's own aggregation has it, and a row is late once its window has ended by then. A
    late row isn't lost: it goes to the side table whole. Windows (start, end, key, n, total)
    are kept in buckets, of which a batch rewrites those it meets. Windows, late rows and
    watermark are one commit, so a batch that is run again changes nothing. Rows without a
    time belong to no window and go to the side table too.
    """
    delay = int(pd.Timedelta(late).total_seconds() * 1_000_000)

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if old is None else old.unionByName(new)
        return both.groupBy("start", "end", key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def take(batch: DataFrame, batch_id: int) -> None:
        marks = store.marks()
        if batch_id <= marks.get(name, -1):
            return
        done, seen = store.version(), marks.get(f"{name}_seen")
        in_time = F.lit(True) if seen is None else F.unix_micros(F.col("__w.end")) > seen - delay
        timed = batch.where(F.col(ts).isNotNull()).withColumn("__w", F.window(ts, width))
        counted = tumbling(timed.where(in_time).drop("__w"), width, key, ts)
        gone = timed.where(~in_time).drop("__w").unionByName(batch.where(F.col(ts).isNull()))
        latest = batch.agg(F.unix_micros(F.max(ts))).first()[0]
        told = {name: batch_id} | ({f"{name}_seen": max(latest, seen if seen is not None else latest)} if latest is not None else {})
        touched = store.touched(name, counted, ["start", key], buckets)
        store.commit({name: store.merged(name, counted, ["start", key], combine, touched, buckets), f"{name}_late": Append(gone)}, expected=done, marks=told)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, store: SnapshotStore, merge: Callable[[DataFrame | None, DataFrame], DataFrame], table: str, checkpoint: str, name: str = "stream", keys: list[str] | None = None, buckets: int = 64, mode: str = "append") -> StreamingQuery:
    """Merges each micro-batch into a snapshot table. The store remembers the last batch of each named
    stream, so a batch that was committed before is passed over and no other is, whatever the store held.

    With keys, the table is kept in buckets by them: merge gets the old rows of the buckets
    that the batch falls into, and only these are written again. Without, the whole table is.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= store.marks().get(name, -1):
            return
        done = store.version()
        if keys:
            store.merge(table, batch, keys, merge, buckets, expected=done, marks={name: batch_id})
        else:
            old = store.read(table) if store.has(table) else None
            store.commit({table: merge(old, batch)}, expected=done, marks={name: batch_id})

    return stream.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_FILE = "path string, modificationTime timestamp, length long, content binary"


def index_stream(spark: SparkSession, folder: str, index: PostingsIndex, checkpoint: str, glob: str = "*", files_per_batch: int = 1_000, name: str = "files") -> StreamingQuery:
    """Takes the files of JSON lines that are new in a folder into an index, so many a batch; the folder is watched by Spark's file source.

    Each batch is one commit of the index with the batch's number, so a batch that is run
    again changes nothing. What is written follows the batch: its postings and lines, and
    the manifest's buckets of its files. The delta isn't folded here; compact() is for later.
    """
    found = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def take(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= index.store.marks().get(name, -1):
            return
        last = F.element_at(F.split("path", "/"), -1)
        texts = batch.select(F.col("path").alias("file"), last.alias("name"), date_in_name(last).alias("date"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
        files = texts.where(F.col("text").isNotNull()).select("file", F.lit(0).cast("long").alias("file_idx"), "name", "date", "modified", "size", F.lit(False).alias("tombstoned"))
        entries = readers.jsonl_entries(readers.lines_of(texts.where(F.col("text").isNotNull()).select("file", "text"), "text")).select("file", "entry_idx", "line_no", "text")
        if not index.store.version():
            index.create(entries.limit(0).withColumn("file_idx", F.lit(0).cast("long")), files.limit(0))
        index.update(entries, files, defer_compact=True, complete=False, marks={name: batch_id})

    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
