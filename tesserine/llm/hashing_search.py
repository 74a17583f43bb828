"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, turned by learned rotations (principal axes, then
alternating Procrustes steps, from different starts), a bit for each sign. A code is cut
into SUBSTRINGS substrings of about log2(block rows) bits, and an index holds a block's
rows by each substring's value. Within Hamming radius r, two codes agree up to
floor(r / SUBSTRINGS) bits in some substring, and in one of the first r % SUBSTRINGS + 1
if exactly so many; so a query probes the values that near its own in each substring and
is sure to retrieve every code within r. Every row retrieved is reranked by its original
vector in double precision.

The radius is learned: the least one at which probing retrieves KEEP of the true nearest
neighbours in a bounded sample (in a larger table neighbours are nearer, so there it
retrieves more). A query that retrieves too few rows widens it by itself, up to all codes.

Rows of one vector are one candidate list, cut exactly to the ids that can be among a
query's nearest; queries of one vector are asked once. Rows are dealt to blocks of
BLOCK_ROWS by a hash, each block is indexed once, and the queries go to the blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import arrow_schema, materialize, record_batch, skew_join

#: Rows that rotations and radius are fitted on at most, picked evenly by a hash of vec_id, and queries among them.
MAX_FIT_ROWS, MAX_FIT_QUERIES = 10_000, 256
PROCRUSTES_STEPS = 20
SUBSTRINGS = 48
BLOCK_ROWS = 32_768
#: Share of the sample's true neighbours that the learned radius retrieves.
KEEP = 0.96


def substring_bits(rows: int) -> int:
    """About log2 of a block's rows: so a value is held by a row or two."""
    return max(4, min(16, math.ceil(math.log2(max(2, rows)))))


class Codes:
    """The learned centre and rotations, and the codes they give: a number for each substring."""

    def __init__(self, sample: np.ndarray, bits: int, seed: int = 5):
        dim = sample.shape[1]
        self.bits = bits
        self.center = sample.mean(0) if len(sample) else np.zeros(dim)
        x = sample - self.center
        rng = np.random.Generator(np.random.PCG64(seed))
        basis = np.linalg.eigh(x.T @ x)[1].T[::-1]  # principal axes; a dim x dim matrix, whatever the sample's size
        self.rotations = []
        for _ in range(math.ceil(SUBSTRINGS * bits / dim)):
            r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            v = x @ basis.T
            for _ in range(PROCRUSTES_STEPS if len(x) else 0):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            self.rotations.append(basis.T @ r)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Substring values, [rows, SUBSTRINGS]."""
        signs = np.concatenate([(x - self.center) @ r > 0 for r in self.rotations], 1)[:, : SUBSTRINGS * self.bits]
        weights = (1 << np.arange(self.bits)).astype(np.int64)
        return (signs.reshape(len(x), SUBSTRINGS, self.bits) @ weights).astype(np.int32)


_FLIPS: dict[tuple[int, int], np.ndarray] = {}


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of so many bits with at most `most` of them set, fewest first."""
    most = min(most, bits)
    if (bits, most) not in _FLIPS:
        _FLIPS[bits, most] = np.array([sum(1 << b for b in chosen) for k in range(most + 1) for chosen in itertools.combinations(range(bits), k)], np.int32)
    return _FLIPS[bits, most]


def levels(radius: int) -> np.ndarray:
    """The flips that each substring is probed with at a radius; -1 for none."""
    return radius // SUBSTRINGS - (np.arange(SUBSTRINGS) > radius % SUBSTRINGS)


def n_probes(bits: int, radius: int) -> int:
    """Probes of one query in one block."""
    return sum(len(flips(bits, int(k))) for k in levels(radius) if k >= 0)


def met_at(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least radius at which probing for codes a retrieves codes b, for rows of substring values."""
    apart = np.bitwise_count((a ^ b).astype(np.uint32)).astype(np.int64)
    return (apart * SUBSTRINGS + np.arange(SUBSTRINGS)).min(1)


class MultiIndex:
    """A block's rows by the value of each substring of their codes."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.rows = np.argsort(values, axis=0, kind="stable").astype(np.int32).T.copy()
        self.ends = np.stack([np.concatenate([[0], np.cumsum(np.bincount(values[:, k], minlength=1 << bits))]) for k in range(SUBSTRINGS)]).astype(np.int32)
        self.probes = self.visited = self.asked = 0

    def retrieve(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows that probing finds, ascending: every row whose code lies within the radius, and others."""
        held = np.zeros(self.n, bool)
        for most in {int(k) for k in levels(radius) if k >= 0}:
            masks = flips(self.bits, most)
            chosen = np.flatnonzero(levels(radius) == most)
            probes = code[chosen][:, None] ^ masks[None, :]
            lo, hi = self.ends[chosen[:, None], probes].ravel(), self.ends[chosen[:, None], probes + 1].ravel()
            full = hi > lo
            table = np.repeat(chosen, len(masks))[full]
            lo, size = lo[full].astype(np.int64), (hi - lo)[full].astype(np.int64)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            held[self.rows[np.repeat(table, size), at]] = True
            self.probes += probes.size
            self.visited += len(at)
        return np.flatnonzero(held)


def search_block(index: MultiIndex, ids: np.ndarray, x: np.ndarray, q: np.ndarray, codes: np.ndarray, radius: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, distances) of its k best among the retrieved rows of a block."""
    out = []
    for vector, code in zip(q, codes, strict=True):
        index.asked += 1
        r = radius
        rows = index.retrieve(code, r)
        while len(rows) < min(k, index.n):
            r += SUBSTRINGS
            rows = index.retrieve(code, r)
        d = np.sqrt(((x[rows] - vector) ** 2).sum(1))
        if len(d) > 4 * k:
            near = d <= np.partition(d, k)[k]  # ties at the edge stay
            rows, d = rows[near], d[near]
        best = np.lexsort((ids[rows], d))[:k]
        out.append((ids[rows][best], d[best]))
    return out


def learned_radius(sample: np.ndarray, model: Codes, k: int) -> int:
    """The radius at which KEEP of the true neighbours of some of the sample's rows are retrieved."""
    if len(sample) < 2:
        return 0
    codes, radii = model.of(sample), []
    for j in np.unique(np.linspace(0, len(sample) - 1, min(MAX_FIT_QUERIES, len(sample))).astype(np.int64)):
        d = ((sample - sample[j]) ** 2).sum(1)
        d[j] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        radii.append(met_at(codes[[j]], codes[near]))
    return int(np.quantile(np.concatenate(radii), KEEP, method="higher"))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: a vector that is finite and not all zero, of the table's most frequent length."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.cast(kind).alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows if usual is None else rows.where(F.size("v") == usual["n"])


_FOUND = "q long, vec_id long, score double"


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`.

    Rows with a null, zero or unsound vector take no part, nor do rows without an id or
    with vectors of another length than most. Ties go to the smaller id. Rows that repeat
    id and vector count once; rows that repeat an id with another vector are candidates
    and queries each, and a query's own id is never among its results. Fewer candidates
    than k are all returned; an empty table gives no rows; extra columns are not read.
    """
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vector_col).dropDuplicates(["vec_id", "v"]), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # of equal vectors only the k + 1 smallest ids can be among the nearest of any query
    equal = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = materialize(rows.withColumn("nth", equal).where(F.col("nth") <= k + 1).drop("nth"), "candidates")
    n_kept = kept.count()
    asked = rows.where(F.col("vec_id") % every == 0)
    classes = materialize(asked.groupBy("v").agg(F.count("*").alias("held")).withColumn("q", F.xxhash64("v")), "query-vectors")

    picked = kept if n_kept <= MAX_FIT_ROWS else kept.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_FIT_ROWS / n_kept))
    sample = np.array([r["v"] for r in picked.select("v").limit(2 * MAX_FIT_ROWS).collect()], np.float64)
    blocks = math.ceil(n_kept / BLOCK_ROWS)
    bits = substring_bits(math.ceil(n_kept / blocks))
    codes = Codes(sample, bits)
    radius = learned_radius(sample, codes, k)
    model = spark.sparkContext.broadcast((codes, radius))  # a few square matrices of the dimension

    dealt = kept.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = classes.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("q").alias("vec_id"), "v")
    pairs = dealt.unionByName(asking).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (learned, r) = arrow_schema(_FOUND), model.value
        current, held, index = None, [], None
        ids = x = np.zeros(0)

        def vectors(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            whole = pa.Table.from_batches(parts)
            return whole["vec_id"].to_numpy(), whole["v"].combine_chunks().flatten().to_numpy().reshape(whole.num_rows, -1).astype(np.float64)

        for batch in batches:
            key = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]):
                if a == b:
                    continue
                if key[a] // 2 != current:
                    current, held, index = key[a] // 2, [], None
                if not key[a] % 2:
                    held.append(batch.slice(a, b - a))
                elif held or index:
                    if index is None:
                        ids, x = vectors(held)
                        index, held = MultiIndex(learned.of(x), learned.bits), []
                    q_ids, q = vectors([batch.slice(a, b - a)])
                    found = search_block(index, ids, x, q, learned.of(q), r, k + 1)
                    yield record_batch({"q": np.repeat(q_ids, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])}, schema)

    best = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    found = pairs.mapInArrow(run, _FOUND).withColumn("nth", best).where(F.col("nth") <= 2 * (k + 1)).drop("nth")
    found = materialize(found, "found")
    # queries of one vector share what was found; own ids go
    named = skew_join(asked.select(F.col("vec_id").alias("query_id"), "v"), classes, ["v"], asked.count()).select("query_id", "q")
    sizes = classes.select("q", "held")
    answers = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # 2 (k + 1) entries at most
    answered = skew_join(named, answers.join(sizes, "q"), ["q"], asked.count())
    others = answered.select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "e"))
    return others.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
