"""Vector search: top-k by cosine, the similarity join, and reranking by a blend."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.vectors import cosine, dot, unit
from tesserine.scratch import ensure_checkpoints


def embedding_text(name: Column, observations: Column) -> Column:
    """What is embedded for an entity: its name and its first four observations."""
    return F.concat(name, F.lit(". "), F.array_join(F.slice(observations, 1, 4), " "))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k ids most like the query, of those at or above the threshold."""
    sim = cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(id_col, sim.alias("s")).where(F.col("s") >= threshold).orderBy(F.desc("s"), id_col).limit(k).select(id_col, F.round("s", 3).alias("similarity"))


def search_text(vectors: DataFrame, query: str, embed: Callable[[list[str]], list[list[float]]], k: int = 10, threshold: float = 0.5) -> DataFrame:
    """name, similarity of the entities like a text, which the callable embeds as it did theirs; vectors(name, embedding)."""
    if not query.strip():
        raise ValueError("empty query")
    return top_k(vectors, embed([query])[0], k, threshold, "name", "embedding")


#: Vectors of a block, of which two lie in a Python worker at once.
BLOCK_VECTORS = 2_048
#: Rows of a block that are multiplied at once; what is like another in them is handed on before the next.
TILE_ROWS = 256
#: Parts that the blocks lie in: each two are a task, which holds the one's blocks. At least, and at most unless a part would hold more blocks than the third.
LEAST_PARTS, MOST_PARTS, PART_BLOCKS = 8, 64, 32
#: Cells that a vector of a sample may go to on average; more would cost disk for what they save in products.
MOST_COPIES = 4
#: Pivots at most, and the vectors that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 256, 4_096
#: Angles are taken to be off by no more than this.
SLACK = 1e-5


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (of length one), d: the vectors that can be like others. Null, empty and zero ones and those that hold a null can't."""
    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where((F.size("v") > 0) & ~F.exists("v", F.isnull))
    return v.select("id", unit(F.col("v")).alias("v"), F.size("v").alias("d")).where(F.exists("v", lambda x: x != 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of a sample, each the farthest from those before it."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


def reached(angles: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own pivot, the nearest, and which cells it goes to: its own, and later ones that may hold a vector within reach."""
    own = angles.argmin(1)
    near = (angles - angles[np.arange(len(angles)), own][:, None]) / 2 <= reach
    return own, near & (np.arange(angles.shape[1]) >= own[:, None])


def fitting_pivots(sample: np.ndarray, most: int, reach: float) -> np.ndarray:
    """As few pivots as compare hardly more of a sample's pairs than any number of them up to `most`: one where vectors have no structure to prune by."""
    chosen = choose_pivots(sample, most)
    angles = np.arccos(np.clip(sample @ chosen.T, -1, 1))
    compared = {1: len(sample) * (len(sample) - 1) // 2}
    for n in sorted({*(1 << k for k in range(len(chosen).bit_length())), len(chosen)}):
        own, goes = reached(angles[:, :n], reach)
        if goes.sum() > MOST_COPIES * len(sample):
            continue
        homes = np.bincount(own, minlength=n)
        compared[n] = int((homes * (homes - 1) // 2 + homes * (goes.sum(0) - homes)).sum())
    return chosen[: min(n for n, c in compared.items() if c <= 1.05 * min(compared.values()))]


def _pivots(v: DataFrame, count: int, reach: float) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, from a bounded sample by a hash of the ids."""
    few = v.select("d", "v", F.xxhash64("id").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()
    most = max(1, min(PIVOTS, math.isqrt(count)))
    return {d: fitting_pivots(np.array([r["v"] for r in few if r["d"] == d]), most, reach) for d in {r["d"] for r in few}}


def _cells(v: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """id, v, d, cell, home: each vector in the cell of its nearest pivot, home, and in every later cell that may hold a vector as near as the threshold.

    Let a vector's angle to its own pivot be r and to another pivot s. One of that pivot's
    cell is no nearer to the first pivot than to its own, so its angle to the vector is
    (s - r) / 2 at least. Where that exceeds the threshold's angle, the cell has nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                base = pivots.get(int(d), x[:1] * 0 + np.eye(1, x.shape[1]))
                own, goes = reached(np.arccos(np.clip(x @ base.T, -1, 1)), reach)
                rows, cells = np.nonzero(goes)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(cells.astype(np.int32)), pa.array(own[rows] == cells)], names=["id", "v", "d", "cell", "home"])

    kind = dict(v.dtypes)["id"]
    return v.mapInArrow(run, f"id {kind}, v array<double>, d int, cell int, home boolean")


def similar_pairs(vectors: DataFrame, threshold: float = 0.55, limit: int | None = 80, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Pairs a < b with a cosine at or above the threshold.

    Vectors lie in the cells of pivots. Within a cell all meet; another cell's vector is
    brought in only where the triangle inequality on angles leaves room for a match, so cells
    that can't reach each other are never multiplied, and no pair is missed. Cells are cut
    into blocks of a fixed size, a row each, and vectors brought in meet each of a cell's
    blocks; every two blocks are one matrix product. The blocks are written once and read by
    the tasks that multiply them, so no vector is copied or shuffled for each block that it
    meets. A null, empty or zero vector and one that holds a null is like nothing; vectors of
    different lengths aren't alike.
    """
    ensure_checkpoints(vectors.sparkSession)
    kind = dict(vectors.dtypes)[id_col]
    blocks = _blocks(*_placed(vectors, threshold, id_col, vector_col), kind)
    sides = [blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns]) for s in "lr"]
    # of two home blocks each is the left one in half of the tasks; no equality that Spark could shuffle by
    own = F.when(F.pmod(F.col("block_l") + F.col("block_r"), F.lit(2)) == 0, F.col("block_l") <= F.col("block_r")).otherwise(F.col("block_l") > F.col("block_r"))
    same = F.col("home_l") & (F.col("cell_l") - F.col("cell_r") == 0) & (F.col("d_l") - F.col("d_r") == 0)
    met = sides[0].crossJoin(sides[1].hint("shuffle_replicate_nl")).where(same & (~F.col("home_r") | own))

    def product(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                d, again = batch["d_l"][k].as_py(), batch["home_r"][k].as_py() and batch["block_l"][k] == batch["block_r"][k]
                ids = [batch[f"ids_{s}"][k].values for s in "lr"]
                x, y = (np.frombuffer(batch[f"v_{s}"][k].as_buffer(), np.float64).reshape(-1, d) for s in "lr")
                for at in range(0, len(x), TILE_ROWS):
                    s = x[at : at + TILE_ROWS] @ y.T
                    i, j = np.nonzero(np.triu(s >= threshold, 1 + at) if again else s >= threshold)
                    if not len(i):
                        continue
                    left, right = ids[0].take(pa.array(i + at)), ids[1].take(pa.array(j))
                    swap = pc.greater(left, right)
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, right, left), pc.if_else(swap, left, right), pa.array(s[i, j])], names=["a", "b", "s"])

    met = met.mapInArrow(product, f"a {kind}, b {kind}, s double").where("a < b")
    if limit is not None:
        met = met.orderBy(F.desc("s"), "a", "b").limit(limit)
    return met.select("a", "b", F.round("s", 3).alias("similarity"))


def _blocks(placed: DataFrame, sizes: DataFrame, kind: str) -> DataFrame:
    """d, cell, home, block, ids, v: blocks of vectors as matrices of doubles, those of a cell's own vectors and those of vectors brought in."""
    total = sizes.agg(F.sum(F.col("blocks") + F.col("guest_blocks"))).first()[0] or 0
    parts = max(1, min(total, LEAST_PARTS), min(math.ceil(total / LEAST_PARTS), MOST_PARTS), math.ceil(total / PART_BLOCKS))
    most = F.when(F.col("home"), F.col("blocks")).otherwise(F.greatest("guest_blocks", F.lit(1)))
    dealt = placed.join(F.broadcast(sizes), ["d", "cell"]).select("d", "cell", "home", F.pmod(F.xxhash64("id"), most).cast("int").alias("block"), "id", "v")

    def pack(group: pa.Table) -> pa.Table:
        v = group["v"].combine_chunks().flatten().to_numpy()
        ids = group["id"].combine_chunks()
        one = [group[c].slice(0, 1) for c in ("d", "cell", "home", "block")]
        return pa.table([*one, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v.tobytes()], pa.binary())], names=["d", "cell", "home", "block", "ids", "v"])

    keys = ["d", "cell", "home", "block"]
    return dealt.repartition(parts, *keys).groupBy(*keys).applyInArrow(pack, f"d int, cell int, home boolean, block int, ids array<{kind}>, v binary").checkpoint()


def _placed(vectors: DataFrame, threshold: float, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Vectors in their cells, and d, cell, blocks, guest_blocks of each cell: a row a cell, PIVOTS for each length of vectors at most."""
    v = usable_vectors(vectors, id_col, vector_col)
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    placed = _cells(v, _pivots(v, v.count(), reach), reach).checkpoint()
    held = placed.groupBy("d", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0")
    return placed, held.select("d", "cell", F.ceil(F.col("homes") / BLOCK_VECTORS).cast("int").alias("blocks"), F.ceil(F.col("guests") / BLOCK_VECTORS).cast("int").alias("guest_blocks"))


def pruning(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors, cells, compared, possible: the pairs that similar_pairs multiplies, and all that there are."""
    ensure_checkpoints(vectors.sparkSession)
    placed, _ = _placed(vectors, threshold, id_col, vector_col)
    cells = placed.groupBy("d", "cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    some = cells.groupBy("d").agg(F.sum("h").alias("n"), F.count("*").alias("cells"), F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("g")).cast("long").alias("compared"))
    total = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return some.agg(F.sum("n").alias("vectors"), F.sum("cells").alias("cells"), F.sum("compared").alias("compared"), F.sum(total).alias("possible"))


def unrelated(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs (a, b) without a relation in either direction."""
    known = relations.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    return pairs.join(known, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")


def pair_similarities(pairs: DataFrame, vectors: DataFrame, threshold: float = 0.55, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """pairs (a, b) with their similarity, null below the threshold and where an end has no vector: what similar_pairs has for them, without the other pairs."""
    v = usable_vectors(vectors, id_col, vector_col)
    ends = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    sides = [v.select(F.col("id").alias(k), F.col("v").alias(f"v_{k}"), F.col("d").alias(f"d_{k}")) for k in ("lo", "hi")]
    s = dot(F.col("v_lo"), F.col("v_hi"))
    found = ends.join(sides[0], "lo").join(sides[1], "hi").where("d_lo = d_hi").select("lo", "hi", s.alias("s")).where(F.col("s") >= threshold)
    found = found.groupBy("lo", "hi").agg(F.round(F.max("s"), 3).alias("similarity"))
    return pairs.join(found, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left").drop("lo", "hi")


def rerank(candidates: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """Candidates (a, b, shared) with score 0.6 * similarity + 0.4 * min(shared / 10, 1); unknown similarity is 0.

    Similarities are looked up in a table (a, b, similarity), or the candidates bring theirs along, and nothing is joined.
    """
    joined = candidates
    if similarities is not None:
        sims = similarities.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "similarity").groupBy("lo", "hi").agg(F.max("similarity").alias("similarity"))
        joined = candidates.join(sims, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left").drop("lo", "hi")
    sim = F.coalesce("similarity", F.lit(0.0))
    return joined.withColumn("similarity", sim).withColumn("score", 0.6 * sim + 0.4 * F.least(F.col("shared") / 10, F.lit(1.0)))


def lexical_similarity(shared: Column) -> Column:
    """What stands in for a similarity where there are no vectors."""
    return F.round(F.least(shared / 3, F.lit(1.0)), 3)
