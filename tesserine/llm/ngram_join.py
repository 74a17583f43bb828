"""N-gram Jaccard join of near-duplicate documents.

Words are cut at ASCII white space after lower-casing A-Z; a document's set holds its
distinct five-word shingles as 64-bit hashes. Copies of one word sequence become one
class first, so the join sees each different text once.

1. A table of hashed shingle counts (a fixed WIDTH, all documents) gives one total
   order, rare shingles first.
2. Of each class the rarest |x| - ceil(t |x|) + 1 shingles are its prefix. Two sets of
   similarity t share a shingle there, so prefix shingles held by one class only go.
3. Classes that share a prefix shingle are linked in rounds. Star rounds compare each
   class with the one before it by size and with the most central of its size band, so a
   group of g copies costs about 2 g comparisons. Linked classes become one component.
4. Last, every pair that still lies in two components and passes the length and the
   positional filter is compared. No pair between components is left out, so the
   components are exact; pairs inside one need no further look.

A pair is compared once: suffix filters bound the overlap, first from bucket counts of
128 bytes a set, then from a few halvings of the sorted sets; then the sets are intersected. Sets travel to the pairs by joins on
class ids, so no group is gathered in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import arrow_schema, id_text, materialize, record_batch, sliced
from tesserine.llm.components import connected_components

N = 5
#: 100 * intersection >= THRESHOLD * union
THRESHOLD = 75
#: Cells of the table of hashed counts; fixed, whatever the corpus.
WIDTH = 1 << 22
_BLOCK = 1 << 16
STAR_ROUNDS = 2
#: Buckets of a set's spread, a byte each.
SPREAD = 128
#: A list of ids is broadcast up to so many (8 bytes each); longer lists join by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of the batches in which texts and sets go to Python, and of the texts that are shingled together; a text at least.
BATCH_BYTES = 2_000_000
SLICE_BYTES = 1_000_000

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def normal_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Shingles:
    """Hashes of the word n-grams of a slice of texts, by one pass of prefix sums over all bytes."""

    def __init__(self, texts: list[str], n: int = N):
        words = [normal_words(t) for t in texts]
        joined = [b" ".join(w) for w in words]
        self.digests = [zlib.crc32(j) for j in joined]
        data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
        size = len(data)
        space = np.flatnonzero(data == 32)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        # a text without words still has the blank after it
        blanks = np.maximum(counts, 1)
        first = np.concatenate([[0], np.cumsum(blanks)[:-1]]) if len(blanks) else np.zeros(0, np.int64)
        word_end = space
        word_start = np.concatenate([[0], space[:-1] + 1])
        # sums up to each byte are needed at the words' edges only; of the arrays over all bytes two exist at a time
        terms = _powers(_BASE, size)
        terms *= _BYTE[data]
        np.cumsum(terms, out=terms)
        to_end = terms[word_end - 1]
        to_start = np.where(word_start > 0, terms[word_start - 1], np.uint64(0))
        # a word without letters ends where it starts, and before the first byte nothing is summed
        to_end[word_end == 0] = 0
        del terms
        back = _powers(_INVERSE, size)[word_start]

        def span(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Hashes from the start of the words a to the end of the words b."""
            return _mix((to_end[b] - to_start[a]) * back[a] + (word_end[b] - word_start[a]).astype(np.uint64))

        self.sets: list[np.ndarray] = []
        self.whole = np.zeros(len(texts), np.uint64)
        number = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        doc = np.repeat(np.arange(len(texts)), number)
        starts = np.repeat(first, number) + np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        ends = np.where(counts[doc] >= n, starts + n - 1, first[doc] + counts[doc] - 1)
        hashes = span(starts, ends) if len(doc) else np.zeros(0, np.uint64)
        if len(texts):
            self.whole = span(first, first + blanks - 1)
        at = 0
        for k in number.tolist():
            self.sets.append(np.unique(hashes[at : at + k]))
            at += k


def prefix_length(size: int, threshold: int = THRESHOLD) -> int:
    return size - -(-threshold * size // 100) + 1 if size else 0


def survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, class_key, spread) of every document, written once, and the order levels by cell.

    Counts of hashed shingles are summed cell by cell, a row a block of cells: at most
    WIDTH sums reach the driver, whatever the corpus. A level is a count's rounded
    logarithm, so that small differences don't reorder the shingles.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_SURVEY)
        cells = np.zeros(WIDTH, np.int32)
        for ids, texts in sliced(batches, SLICE_BYTES):
            made = Shingles(texts)
            if made.sets:
                hit, times = np.unique((np.concatenate(made.sets) & np.uint64(WIDTH - 1)).astype(np.int32), return_counts=True)
                cells[hit] += times.astype(np.int32)
            n = [len(s) for s in made.sets]
            keys = [f"{int(w):016x}{d:08x}{k}" for w, d, k in zip(made.whole, made.digests, n, strict=True)]
            yield record_batch({"doc_id": ids, "n_shingles": n, "class_key": keys, "spread": spreads(made.sets), "block": [None] * len(ids), "cells": [None] * len(ids)}, schema)
        full = [b for b in range(WIDTH // _BLOCK) if cells[b * _BLOCK : (b + 1) * _BLOCK].any()]
        packed = [zlib.compress(cells[b * _BLOCK : (b + 1) * _BLOCK].astype("<i8").tobytes(), 1) for b in full]
        yield record_batch({"doc_id": [None] * len(full), "n_shingles": [None] * len(full), "class_key": [None] * len(full), "spread": [None] * len(full), "block": full, "cells": packed}, schema)

    written = materialize(docs.mapInArrow(run, _SURVEY), "shingle-survey", BATCH_BYTES)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("block int, cells binary")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(zlib.decompress(packed), "<i8")
                sums[b] = sums[b] + cells if b in sums else cells
        yield record_batch({"block": list(sums), "cells": [zlib.compress(s.astype("<i8").tobytes(), 1) for s in sums.values()]}, schema)

    blocks = written.where("block is not null").select("block", "cells")
    summed = blocks.mapInArrow(add, "block int, cells binary").repartition(8, "block").mapInArrow(add, "block int, cells binary")
    cells = np.zeros(WIDTH, np.int64)
    for row in summed.collect():  # WIDTH / _BLOCK rows at most
        cells[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(row["cells"]), "<i8")
    levels = np.rint(2 * np.log2(np.maximum(cells, 1))).astype(np.uint8)
    return written.where("block is null").select("doc_id", "n_shingles", "class_key", "spread"), levels


_SURVEY = "doc_id long, n_shingles long, class_key string, spread binary, block int, cells binary"


def spreads(sets: list[np.ndarray]) -> list[bytes]:
    """For each set how many of its hashes fall into each of SPREAD buckets, 255 at most."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bucket = (np.concatenate(sets) >> np.uint64(40) & np.uint64(SPREAD - 1)).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    counts = np.bincount(np.repeat(np.arange(len(sets)), sizes) * SPREAD + bucket, minlength=len(sets) * SPREAD)
    flat = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return [flat[k * SPREAD : (k + 1) * SPREAD] for k in range(len(sets))]


def in_order(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of a set in the total order, rare ones first."""
    return hashes[np.lexsort((hashes, levels[(hashes & np.uint64(len(levels) - 1)).astype(np.int64)]))]


def prefixes(texts: DataFrame, levels: np.ndarray, threshold: int) -> DataFrame:
    """(h, doc_id, size, pos): the prefix shingles of each representative."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)  # WIDTH bytes, fixed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for ids, part in sliced(batches, SLICE_BYTES):
            sets = Shingles(part).sets
            taken = [in_order(s, table)[: prefix_length(len(s), threshold)] for s in sets]
            lengths = np.fromiter(map(len, taken), np.int64, len(taken))
            pos = np.concatenate([np.arange(k) for k in lengths]) if len(taken) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.concatenate(taken) if taken else np.zeros(0, np.uint64)).view(np.int64)),
                    pa.array(np.repeat(np.array(ids, np.int64), lengths)),
                    pa.array(np.repeat(np.fromiter(map(len, sets), np.int32, len(sets)), lengths)),
                    pa.array(pos.astype(np.int32)),
                ],
                names=["h", "doc_id", "size", "pos"],
            )

    return texts.mapInArrow(run, "h long, doc_id long, size int, pos int")


def required(size_a: int, size_b: int, threshold: int) -> int:
    """The least overlap that makes two sets of these sizes similar enough."""
    return -(-threshold * (size_a + size_b) // (100 + threshold))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """At most so many elements are shared by the sorted arrays, from halving both at a's median."""
    if depth == 0 or len(a) < 2 or len(b) < 2:
        return min(len(a), len(b))
    mid = len(a) // 2
    cut = int(np.searchsorted(b, a[mid]))
    return suffix_bound(a[:mid], b[:cut], depth - 1) + suffix_bound(a[mid:], b[cut:], depth - 1)


def similar(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether 100 * |a & b| >= threshold * |a | b| for sorted sets; empty sets are like nothing."""
    if not len(a) or not len(b):
        return False
    need = required(len(a), len(b), threshold)
    if min(len(a), len(b)) < need or suffix_bound(a, b) < need:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def plausible(pairs: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) pairs that the suffix filter on spreads leaves.

    Two sets differ at least by the sum of the differences of their bucket counts, so a
    pair whose spreads differ by more than a similar pair may is dropped unseen.
    """
    sides = [known.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("spread").alias(f"s_{k}")) for k in ("a", "b")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SPREAD).astype(np.int16) for k in (4, 5))
            most = n_a + n_b - 2 * -(-threshold * (n_a + n_b) // (100 + threshold))
            keep = np.abs(x - y).sum(1) <= most
            yield record_batch({"a": a[keep], "b": b[keep]}, arrow_schema("a long, b long"))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) pairs whose sets are similar enough. Sets reach their pairs by joins on the ids."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("of_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_a, kept_b = [], []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                if similar(x, y, threshold):
                    kept_a.append(batch.column(0)[k].as_py())
                    kept_b.append(batch.column(1)[k].as_py())
            yield record_batch({"a": kept_a, "b": kept_b}, arrow_schema("a long, b long"))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _may_match(a: str, b: str, threshold: int):
    """The length filter, and the positional one: what two sets can still share from a common shingle on.

    The first common shingle of a similar pair passes it, so a pair that fails at another
    shingle is met at its first one.
    """
    size_a, size_b = F.col(f"{a}_size"), F.col(f"{b}_size")
    at_most = 1 + F.least(size_a - F.col(f"{a}_pos") - 1, size_b - F.col(f"{b}_pos") - 1)
    fits = 100 * F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)
    return fits & (at_most * (100 + threshold) >= threshold * (size_a + size_b)) & (F.col(f"{a}_component") != F.col(f"{b}_component"))


_FIELDS = ("doc_id", "size", "pos", "component")


def _star_pairs(held: DataFrame, threshold: int) -> DataFrame:
    """Each class of a bucket against the one before it by size, and against one of its size band, where their components differ.

    The band's one is that in which fewest shingles are rarer than the shared one: of near
    copies it has fewest shingles of its own, so it is the likest to all others.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / threshold)))
    by_size = Window.partitionBy("h").orderBy("size", "doc_id")
    by_band = Window.partitionBy("h", "band").orderBy("pos", "size", "doc_id")
    own = [F.col(c).alias(f"y_{c}") for c in _FIELDS]
    seen = held.withColumn("band", band).select(*own, *[F.lag(c).over(by_size).alias(f"prev_{c}") for c in _FIELDS], *[F.first(c).over(by_band).alias(f"first_{c}") for c in _FIELDS])
    sides = [seen.select(*[f"y_{c}" for c in _FIELDS], *[F.col(f"{k}_{c}").alias(f"x_{c}") for c in _FIELDS]) for k in ("prev", "first")]
    both = sides[0].unionByName(sides[1]).where((F.col("x_doc_id") != F.col("y_doc_id")) & _may_match("x", "y", threshold))
    return both.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def _all_pairs(held: DataFrame, threshold: int) -> DataFrame:
    """Every pair of a bucket between two components that passes the length and the positional filter."""
    spread = Window.partitionBy("h")
    mixed = held.withColumn("lo", F.min("component").over(spread)).withColumn("hi", F.max("component").over(spread)).where("lo < hi")
    left, right = (mixed.select("h", *[F.col(c).alias(f"{k}_{c}") for c in _FIELDS]) for k in ("x", "y"))
    met = left.join(right, "h").where((F.col("x_doc_id") < F.col("y_doc_id")) & _may_match("x", "y", threshold))
    return met.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct()


def _by_ids(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Texts with, or without, the listed ids. A short list goes to the texts, so that these stay where they are."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def near_duplicates(df: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to, itself included.

    A null or blank text has no shingles and is linked with nothing; a row without an id
    links only with copies of its text and has no component_id of its own. Rows that repeat a
    doc_id count as documents of their own texts under one id, and each row is returned.
    Texts of fewer than five words have their whole sequence as one shingle. Extra
    columns are not read; an empty table gives no rows.
    """
    docs = id_text(df, id_col, text_col)
    listed, levels = survey(docs)
    has_words = listed.where("n_shingles > 0")
    reps = materialize(has_words.groupBy("class_key").agg(F.min("doc_id").alias("rep")), "class-representatives")
    others = has_words.join(reps, "class_key").where("doc_id != rep").select("doc_id").distinct()
    # an id that stands for one of its texts and repeats another's stays, for the sake of the first
    copies = materialize(others.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "copies")
    texts = _by_ids(docs.where("doc_id is not null"), copies, "left_anti")
    buckets = Window.partitionBy("h")
    shared = prefixes(texts, levels, threshold).withColumn("held", F.count("*").over(buckets)).where("held > 1").drop("held")
    shared = materialize(shared.dropDuplicates(["h", "doc_id"]), "shared-prefixes", BATCH_BYTES)
    known = materialize(listed.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "spread"), "spreads")

    components = texts.sparkSession.createDataFrame([], "node long, component long")
    held = shared.withColumn("component", F.col("doc_id"))
    for k in range(STAR_ROUNDS + 1):
        proposed = _star_pairs(held, threshold) if k < STAR_ROUNDS else _all_pairs(held, threshold)
        pairs = materialize(plausible(proposed, known, threshold), "pairs", BATCH_BYTES)
        ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        found = materialize(verify(pairs, _sets(_by_ids(texts, ends, "left_semi")), threshold), "links", BATCH_BYTES)
        if found.isEmpty():
            continue
        # what was linked before stands as its component's star, so each round adds few edges
        stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        components = materialize(connected_components(found.unionByName(stars)), "components")
        held = shared.join(components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    of_class = reps.join(components, reps["rep"] == components["node"], "left").select("class_key", F.coalesce("component", "rep").alias("component_id"))
    joined = listed.join(of_class, "class_key", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets(texts: DataFrame) -> DataFrame:
    """(doc_id, hashes): whole sets as packed sorted 64-bit hashes, a row a text; an id may repeat."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in sliced(batches, SLICE_BYTES):
            yield record_batch({"doc_id": ids, "hashes": [s.tobytes() for s in Shingles(part).sets]}, arrow_schema("doc_id long, hashes binary"))

    return texts.mapInArrow(run, "doc_id long, hashes binary")
