"""Concatenate and cut: documents to fixed windows of tokens.

Pass one encodes every text once into a table in the shared folder: for each document
its packed ids, the number of its part (the task that wrote it) and the tokens before
it in that part. A prefix sum over the parts' totals, one row a part, gives each part's
global offset. Pass two reads the table, adds the offset and cuts at multiples of the
window; a document that crosses a window's end leaves a boundary record on either side.
Only the very last window can be short, so there is padding in one sequence at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.bpe import DEFAULT_VOCABULARY, load
from tesserine.llm.common import arrow_schema, id_text, materialize, record_batch, sliced

#: A table of the parts' offsets is broadcast up to so many rows (16 bytes each), else joined by a shuffle.
BROADCAST_PARTS = 500_000

_TOKENS = "doc_id long, part int, before long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_table(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The encoded documents, written once; part and before hold as written, however it is read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        part, before = TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(bpe.dtype.itemsize, "little")
        for ids, texts in sliced(batches):
            packed = [x.tobytes() + end for x in bpe.encode_batch(texts)]
            counts = np.array([len(p) // bpe.dtype.itemsize for p in packed], np.int64)
            ahead = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(ahead), pa.array(counts), pa.array(packed, pa.binary())], names=["doc_id", "part", "before", "doc_tokens", "ids"])

    return materialize(id_text(df, id_col, text_col).mapInArrow(run, _TOKENS), "tokens")


def part_offsets(tokens: DataFrame) -> DataFrame:
    """part, offset: tokens in all parts before it. One row a part goes to the window's task."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    running = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(running, F.lit(0)).alias("part_offset"))


def pack(df: DataFrame, window: int = 4096, end_id: int = 2, vocabulary: str = DEFAULT_VOCABULARY, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    start counts a document's ids before the piece and offset the window's ids before
    it. A null text counts as empty and still brings its end id, so every row has a
    piece; repeated rows are packed each on their own; no rows give no pieces; columns
    besides id and text are not read. A document of any length is cut as often as needed.
    """
    tokens = token_table(df, vocabulary, end_id, id_col, text_col)
    offsets = part_offsets(tokens)
    if tokens.select("part").distinct().count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").select("doc_id", "doc_tokens", (F.col("before") + F.col("part_offset")).alias("first"), "ids")
    columns = _PIECES + ", ids array<int>" * with_ids
    schema = arrow_schema(columns)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = load(vocabulary).dtype
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, total, first, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(packed, dtype).astype("<u4")
                start = 0
                while start < total:
                    place = first + start
                    length = min(window - place % window, total - start)
                    piece = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(piece.tobytes()), total, place // window, place % window)
                    for k, v in zip(out, row, strict=False):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(piece.astype(np.int32))
                    start += length
            yield record_batch(out, schema)

    return placed.mapInArrow(cut, columns)
