"""Ranked lexical search as a blocked sparse matrix product of items, terms and documents.

Documents are cut into blocks, each a sparse matrix of the items' terms by the block's
documents. Items times terms times such a block is formed row by row, each item's row by
merging the block's rows of its terms; the best of every block are reduced to the best of all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import arrow_schema, id_text, materialize, record_batch, slices

#: Items of a block and characters of their texts: a block's terms are broadcast, a few times this size.
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 8_000_000

#: Bytes of text whose documents form a block of the matrix, one document at least.
BLOCK_BYTES = 2_000_000

#: Ways that an item's candidates are dealt in before its best are taken.
SALTS = 64

_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Items:
    """A block of items: distinct terms, and for each item the numbers of its terms, each once."""

    ids: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    of_item: np.ndarray


def item_terms(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """item_id, term: the distinct terms of each item; rows of one id are one item, rows without an id are none."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0)))).alias("term")).distinct()


def _collected(pairs: DataFrame) -> Items:
    """One block's (item_id, term) rows, of bounded size, on the driver."""
    found = pairs.toArrow()
    coded = pc.dictionary_encode(found["term"].combine_chunks())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    ids, rows = np.unique(found["item_id"].to_numpy(), return_inverse=True)
    order = np.argsort(rows, kind="stable")
    return Items(ids, coded.dictionary, np.searchsorted(rows[order], np.arange(len(ids) + 1)), coded.indices.to_numpy()[order])


# --- blocks of the term-document matrix

MATRIX = "docs binary, lengths binary, starts binary, cells binary, times binary, has_id boolean"


def block_of(ids: np.ndarray, texts: pa.Array, terms: pa.Array) -> dict[str, np.ndarray]:
    """docs and lengths (terms with repeats) of the block's documents; by term starts, and there cells (documents) and times (occurrences)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), _OTHER)
    words = parts.flatten()
    owner = np.repeat(np.arange(len(ids)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    sound = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    lengths = np.bincount(owner[sound], minlength=len(ids)).astype(np.int64)
    met = pc.index_in(words, terms)
    known = pc.is_valid(met).to_numpy(zero_copy_only=False) & sound
    cells, times = np.unique(met.filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + owner[known], return_counts=True)
    term, doc = np.divmod(cells, len(ids)) if len(ids) else (cells, cells)
    return {"docs": ids, "lengths": lengths, "starts": np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int64), "cells": doc.astype(np.int32), "times": times.astype(np.int32)}


def matrix(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """The blocks of the term-document matrix, a row a block. Documents without an id count, in blocks of their own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(MATRIX)
        for part in slices(batches, BLOCK_BYTES):
            has = pc.is_valid(part.column(0))
            for named in (True, False):
                chosen = part.filter(has if named else pc.invert(has))
                if chosen.num_rows:
                    ids = chosen.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    made = block_of(ids, chosen.column(1), terms)
                    yield record_batch({k: [v.tobytes()] for k, v in made.items()} | {"has_id": [named]}, schema)

    return id_text(docs).mapInArrow(run, MATRIX)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    kinds = {"docs": np.int64, "lengths": np.int64, "starts": np.int64, "cells": np.int32, "times": np.int32}
    for batch in batches:
        for row in batch.to_pylist():
            yield {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}, row["has_id"]


_COUNTS = "term int, n long, total long"


def counts(blocks: DataFrame) -> DataFrame:
    """term, n: how many documents hold a term; term -1 has in n the documents with terms and in total all their terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(0, np.int64), 0, 0
        for block, _ in _blocks(batches):
            held = np.diff(block["starts"])
            df = held + df if len(df) else held
            n += int((block["lengths"] > 0).sum())
            total += int(block["lengths"].sum())
        some = np.flatnonzero(df)
        yield record_batch({"term": [-1, *some.tolist()], "n": [n, *df[some].tolist()], "total": [total, *[0] * len(some)]}, arrow_schema(_COUNTS))

    return blocks.mapInArrow(run, _COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# --- the product

_BEST = "item_id long, doc_id long, score long"


def impacts(block: dict[str, np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each cell of a block adds to a score, in whole numbers."""
    m = 100 - 50 + (50 * block["lengths"] * n_docs) // n_terms
    tf = block["times"].astype(np.int64)
    return np.repeat(weights, np.diff(block["starts"])) * ((1_000_000_000 * tf) // (1_000 * tf + 20 * m[block["cells"]]))


def best_of(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their documents, equal ones by document, highest first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least  # ties of the last stay until documents decide
        scores, docs = scores[kept], docs[kept]
    order = np.lexsort((docs, -scores))[:k]
    return scores[order], docs[order]


def product(block: dict[str, np.ndarray], items: Items, added: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item's number, scores, documents): for each item's row the block's rows of its terms are merged."""
    row = np.zeros(len(block["docs"]), np.int64)
    starts, cells = block["starts"], block["cells"]
    begin, stop = starts[:-1][items.of_item], starts[1:][items.of_item]
    held = np.flatnonzero(stop > begin)
    of = np.searchsorted(held, items.starts)
    for item in range(len(items.ids)):
        chosen = held[of[item] : of[item + 1]]
        if not len(chosen):
            continue
        row[:] = 0
        for a, b in zip(begin[chosen].tolist(), stop[chosen].tolist(), strict=True):
            row[cells[a:b]] += added[a:b]  # a term's documents are distinct
        hit = np.flatnonzero(row)
        if len(hit):
            yield item, *best_of(row[hit], block["docs"][hit], k)


def _search_block(blocks: DataFrame, items: Items, k: int) -> DataFrame:
    """The k best documents of each item out of the matrix's blocks."""
    weights = np.zeros(len(items.terms), np.int64)
    n_docs = n_terms = 0
    for r in counts(blocks).collect():  # a row a term of the block, bounded as the block is
        if r["term"] < 0:
            n_docs, n_terms = r["n"], r["total"]
        else:
            weights[r["term"]] = r["n"]
    weights = np.where(weights > 0, np.floor(1_000 * np.log((2 * n_docs + 2) / (2 * weights + 1))), 0).astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_BEST)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for block, named in _blocks(batches):
            if not named or not n_terms:
                continue
            for item, scores, docs in product(block, items, impacts(block, weights, n_docs, n_terms), k):
                if item in best:
                    scores, docs = best_of(np.concatenate([best[item][0], scores]), np.concatenate([best[item][1], docs]), k)
                best[item] = scores, docs
        for item, (scores, docs) in best.items():
            yield record_batch({"item_id": np.full(len(docs), items.ids[item]), "doc_id": docs, "score": scores}, schema)

    found = blocks.mapInArrow(run, _BEST)
    order = [F.desc("score"), "doc_id"]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents(doc_id, text) of each of items(item_id, text).

    Terms are maximal runs of letters, digits and other characters beyond ASCII, A-Z
    lower-cased, of the whole texts. The score adds up whole numbers over the item's terms,
    once each; only scores above 0 count, equal ones go by doc_id. Rows of one item_id are
    one item, rows that repeat a doc_id are documents of their own. Documents without an id
    count in the statistics and are not returned; null and empty texts have no terms; no
    rows on either side give none; extra columns are not read.

    Items go in blocks of bounded size, each of which is one pass over the documents: their
    texts are cut into words once a block and kept as a sparse matrix of the block's terms.
    """
    spark = docs.sparkSession
    pairs = materialize(item_terms(items), "item-terms")
    n, chars = pairs.agg(F.count_distinct("item_id"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    n_blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    parts = []
    for number in range(n_blocks):
        block = _collected(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number))
        if len(block.ids):
            parts.append(_search_block(materialize(matrix(docs, block.terms), "term-documents"), block, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
