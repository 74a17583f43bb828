"""Shared pieces of the training-data operators: tables, scratch tables, text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, by any path that Spark's readers understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, local mode takes a temporary
    folder of its own; elsewhere it is one in the warehouse, if that isn't on a machine's own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and warehouse.startswith(("file:", "/")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tesserine-checkpoints-") if local else f"{warehouse}/tesserine-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def ensure_checkpoints(spark: SparkSession) -> None:
    """Makes DataFrame.checkpoint() usable; it writes to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


@contextlib.contextmanager
def batches_of(spark: SparkSession, n_bytes: int | None) -> Iterator[None]:
    """What is run inside hands Python batches of about n_bytes, a row at least. Where the session names a size, or n_bytes is None, that stands."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if n_bytes is None or spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, f"{n_bytes}b")
    try:
        yield
    finally:
        spark.conf.unset(name)


def materialize(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: the lineage is cut
    and what follows may read it many times. The files go when the application ends.
    batch_bytes bounds the batches that Python gets on the way."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with batches_of(spark, batch_bytes):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(schema).parquet(path)


#: Keys that skew_join broadcasts at most.
HOT_KEYS = 4_000


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], n: int) -> DataFrame:
    """big joined with small, a row a key, where `held` says how many of big's n rows have the key.

    Keys with over n / HOT_KEYS rows, HOT_KEYS at most whatever the corpus, are broadcast, so
    that their rows stay where they are; the others meet by a shuffle, none of them large.
    `held` is dropped.
    """
    hot = F.col("held") > n / HOT_KEYS
    often = F.broadcast(small.where(hot).drop("held"))
    rest = big.join(F.broadcast(small.where(hot).select(*keys)), keys, "left_anti")
    return big.join(often, keys).unionByName(rest.join(small.where(~hot).drop("held"), keys))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one: extra columns never reach Python."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(df: DataFrame, rows: Callable[[list, list[str]], dict[str, list]], schema: str, slice_chars: int = 2_000_000) -> DataFrame:
    """mapInArrow over (doc_id, text), a bounded slice of texts at a time.

    rows(ids, texts) gives the output columns as lists. Slices end after slice_chars
    characters, so memory follows the longest text and not the batch's row count.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches, slice_chars):
            out = rows(ids, texts)
            yield record_batch(out, arrow)

    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], slice_chars: int = 2_000_000, text_col: int = 1) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where their texts reach slice_chars bytes, a single row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, held + slice_chars, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def sliced(batches: Iterable[pa.RecordBatch], slice_chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of bounded size out of Arrow batches with the columns doc_id and text."""
    for part in slices(batches, slice_chars):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow's schema for a plain list of columns such as 'doc_id long, ids array<int>'."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([pa.field(column.split()[0], kind(column.split()[1])) for column in ddl.split(", ")])


def record_batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
