"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text falls into paragraphs: it is cut after each line end and, so that a single long
line has paragraphs too, after each place where a hash of the last WINDOW bytes is
divisible by SPACING. The cuts follow the content, so an edit changes the paragraphs
around it only. A paragraph's digest holds its bytes and how many equal ones came
before it.

A sketch is a table of CELLS cells. Each digest is added to one cell in each of its four
quarters: to the cell's count and to its sum. Sketches subtract cell by cell; what both
have vanishes. A cell with one digest left gives it away, the digest is taken out of its
other cells, and so on until nothing is left: then the differing digests are known.

A fingerprint is a ladder of sketches by a hash of the digest: three quarters of the
digests lie in the first, three quarters of the rest in the second, and so on; the last
one holds all that is left, about TAIL digests, and more sketches are added until it can
be peeled by itself. Two fingerprints are compared from the top down, so each further
sketch that peels makes the known sample of digests four times larger, down to all of
them. The likeness is 1 - differing / all digests of both texts in that sample: exact
where the whole difference peels, always exact for equal texts, and else an estimate
whose standard error is at most sqrt(likeness (1 - likeness) / sample). It comes from
the two fingerprints alone. difference() has both texts at hand and recovers all
differing digests: where peeling fails it retries with a larger sketch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import arrow_schema, record_batch

WINDOW, SPACING = 8, 64
#: Cells of a sketch, in four quarters.
CELLS = 64
#: Digests of the last sketch, about, and sketches at most.
TAIL, MOST = 16, 24
#: Bytes of text in a range of documents, about.
RANGE_BYTES = 32_000_000
#: Ranges at most: larger tables have larger ones, through which their tasks stream.
MAX_RANGES = 20_000

_BASE = 0x9E3779B97F4A7C15
BYTE_HASHES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(20, n.bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, digest) of every paragraph of the texts, owners ascending."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASHES[data] * up[: len(data)], dtype=np.uint64)])
    ends = np.cumsum(sizes)
    window = mix((running[WINDOW:] - running[:-WINDOW]) * down[: max(0, len(running) - WINDOW)])
    cut = np.zeros(len(data) + 1, bool)
    cut[WINDOW:] = window % np.uint64(SPACING) == 0
    starts = ends - sizes
    for k in range(1, WINDOW):  # a window that begins before its text doesn't count
        cut[np.minimum(starts + k, len(data))] = False
    cut[1:] |= data == 10
    cut[ends] = True
    cut[0] = False
    stop = np.flatnonzero(cut)
    start = np.concatenate([[0], stop[:-1]])
    # a paragraph lies in the text that has bytes at its start, so empty texts own none
    owner = np.searchsorted(ends, start, side="right")
    content = mix((running[stop] - running[start]) * down[start] + (stop - start).astype(np.uint64))
    order = np.lexsort((content, owner))
    o, c = owner[order], content[order]
    fresh = np.concatenate([[True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])])
    at = np.arange(len(o))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return o, mix(c + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


CHECK_BITS, CHECK = np.uint64(24), np.uint64((1 << 24) - 1)


def keys_of(digest: np.ndarray) -> np.ndarray:
    """40 bits of each digest with a check of 24 bits."""
    short = digest >> CHECK_BITS
    return short << CHECK_BITS | (mix(short + np.uint64(0x5BD1E995)) & CHECK)


def is_key(key: np.ndarray) -> np.ndarray:
    return (mix((key >> CHECK_BITS) + np.uint64(0x5BD1E995)) & CHECK) == (key & CHECK)


def steps_of(key: np.ndarray) -> np.ndarray:
    """The sketch of the ladder that a digest belongs to: 0 for three quarters of all, 1 for three of the next four, ..."""
    h = mix(key ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1 << 62)
    return (np.bitwise_count((h & (~h + np.uint64(1))) - np.uint64(1)) // 2).astype(np.int64)


class Sketches:
    """Rows of sketches: counts and sums, [rows, cells]."""

    def __init__(self, rows: int, cells: int = CELLS):
        self.cells = cells
        self.count = np.zeros((rows, cells), np.int32)
        self.total = np.zeros((rows, cells), np.uint64)

    def place(self, key: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """The cell of each digest in quarter k."""
        quarter = self.cells // 4
        return k * quarter + (mix(key + np.uint64(0xA5A5) + np.asarray(k).astype(np.uint64)) % np.uint64(quarter)).astype(np.int64)

    def add(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> None:
        signed = np.broadcast_to(np.asarray(sign, np.int32), key.shape)
        amount = key * signed.astype(np.int64).astype(np.uint64)
        count, total = self.count.ravel(), self.total.ravel()
        for k in range(4):
            place = row * self.cells + self.place(key, k)
            np.add.at(count, place, signed)
            np.add.at(total, place, amount)

    def peel(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Takes out what can be told: (whether a row is empty then, rounds of (row, digest, sign)). Changes the sketches.

        No row gives more digests than it has cells; one that would, by a check that holds by
        chance, is given up.
        """
        taken, given = [], np.zeros(len(self.count), np.int64)
        live = np.arange(len(self.count))
        while True:
            at, place = np.nonzero(np.abs(self.count[live]) == 1)
            row = live[at]
            sign = self.count[row, place]
            key = self.total[row, place] * sign.astype(np.int64).astype(np.uint64)
            sure = is_key(key) & (self.place(key, place // (self.cells // 4)) == place)
            row, key, sign = row[sure], key[sure], sign[sure]
            if not len(row):
                return ~(self.count.any(1) | self.total.any(1)) & (given <= self.cells), taken
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            once = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
            row, key, sign = row[once], key[once], sign[once]
            self.add(row, key, -sign)
            taken.append((row, key, sign))
            given += np.bincount(row, minlength=len(given))
            live = np.unique(row)
            live = live[given[live] <= self.cells]


class Ladders:
    """Fingerprints of n texts: sizes[n, steps] and sketches in rows n * steps; heights says how many steps each has."""

    def __init__(self, heights: np.ndarray, sizes: np.ndarray, rows: Sketches):
        self.heights, self.sizes, self.rows = heights, sizes, rows

    @property
    def steps(self) -> int:
        return self.sizes.shape[1]


def _tails(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Whether the last sketches, of the given digests, can be peeled by themselves."""
    tail = Sketches(n)
    tail.add(row, key)
    return tail.peel()[0]


def ladders(owner: np.ndarray, digest: np.ndarray, n: int) -> Ladders:
    """The fingerprints of n texts from the digests of their paragraphs."""
    key = keys_of(digest)
    step, held = steps_of(key), np.bincount(owner, minlength=n)
    heights = 1 + np.ceil(np.log(np.maximum(held, TAIL) / TAIL) / np.log(4) - 1e-9).astype(np.int64)
    for _ in range(MOST):
        last = step >= heights[owner] - 1
        bad = ~_tails(owner[last], key[last], n) & (heights < MOST)
        if not bad.any():
            break
        heights[bad] += 1
    steps = int(heights.max(initial=1))
    row = owner * steps + np.minimum(step, heights[owner] - 1)
    rows = Sketches(n * steps)
    rows.add(row, key)
    return Ladders(heights, np.bincount(row, minlength=n * steps).reshape(n, steps), rows)


def encode(found: Ladders) -> list[str]:
    """Fingerprints as texts; equal texts have equal ones. A cell keeps its count modulo 256."""
    out, steps = [], found.steps
    for k, height in enumerate(found.heights.tolist()):
        at = slice(k * steps, k * steps + height)
        packed = found.sizes[k, :height].astype("<u4").tobytes() + found.rows.count[at].astype(np.uint8).tobytes() + found.rows.total[at].astype("<u8").tobytes()
        out.append(base64.b64encode(packed).decode())
    return out


_BYTES = 4 + CELLS + 8 * CELLS


def decode(fingerprints: list[str]) -> Ladders:
    """What encode() wrote, the counts modulo 256."""
    packed = [base64.b64decode(f) for f in fingerprints]
    heights = np.array([len(p) // _BYTES for p in packed], np.int64)
    steps = int(heights.max(initial=1))
    sizes, rows = np.zeros((len(packed), steps), np.int64), Sketches(len(packed) * steps)
    for k, (p, h) in enumerate(zip(packed, heights.tolist(), strict=True)):
        at = slice(k * steps, k * steps + h)
        sizes[k, :h] = np.frombuffer(p, "<u4", h)
        rows.count[at] = np.frombuffer(p, np.uint8, h * CELLS, 4 * h).reshape(h, CELLS)
        rows.total[at] = np.frombuffer(p, "<u8", h * CELLS, (4 + CELLS) * h).reshape(h, CELLS)
    return Ladders(heights, sizes, rows)


def _extended(found: Ladders, steps: int) -> Ladders:
    """The same fingerprints with so many steps: what the last sketches hold is peeled and dealt to the steps it belongs to."""
    n, last = len(found.heights), Sketches(len(found.heights))
    ends = np.arange(n) * found.steps + found.heights - 1
    last.count, last.total = _signed(found.rows.count[ends]), found.rows.total[ends].copy()
    _, taken = last.peel()
    row = np.concatenate([t[0] for t in taken]) if taken else np.zeros(0, np.int64)
    key = np.concatenate([t[1] for t in taken]) if taken else np.zeros(0, np.uint64)
    rows, sizes = Sketches(n * steps), np.zeros((n, steps), np.int64)
    inner = np.arange(found.steps)[None, :] < found.heights[:, None] - 1
    r, s = np.nonzero(inner)
    rows.count[r * steps + s], rows.total[r * steps + s] = found.rows.count[r * found.steps + s], found.rows.total[r * found.steps + s]
    sizes[r, s] = found.sizes[r, s]
    at = row * steps + np.minimum(steps_of(key), steps - 1)
    rows.add(at, key)
    sizes += np.bincount(at, minlength=n * steps).reshape(n, steps)
    return Ladders(np.full(n, steps), sizes, rows)


def _signed(count: np.ndarray) -> np.ndarray:
    """Counts modulo 256 as the numbers from -128 to 127."""
    return count.astype(np.int8).astype(np.int32)


def compare(a: Ladders, b: Ladders, left: np.ndarray, right: np.ndarray, extra: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(likeness, sample) for pairs of fingerprints: left of a, right of b. sample counts the digests it rests on; 0 where no step peels."""
    steps = max(a.steps, b.steps) + extra
    x, y = _extended(a, steps), _extended(b, steps)
    pairs, at = len(left), np.arange(steps)
    rows_x, rows_y = (left[:, None] * steps + at).ravel(), (right[:, None] * steps + at).ravel()
    diff = Sketches(0)
    diff.count, diff.total = _signed(x.rows.count[rows_x] - y.rows.count[rows_y]), x.rows.total[rows_x] - y.rows.total[rows_y]
    done, taken = diff.peel()
    found = np.zeros(pairs * steps, np.int64)
    for row, _, _ in taken:
        found += np.bincount(row, minlength=pairs * steps)

    def from_top(v: np.ndarray, f: np.ufunc) -> np.ndarray:
        return f.accumulate(v.reshape(pairs, steps)[:, ::-1], axis=1)[:, ::-1]

    known = from_top(done, np.logical_and)
    lowest = np.where(known.any(1), steps - known.sum(1), steps - 1)
    differing, held = from_top(found, np.add)[np.arange(pairs), lowest], from_top(x.sizes[left] + y.sizes[right], np.add)[np.arange(pairs), lowest]
    held = np.where(known.any(1), held, 0)
    near = np.where(held > 0, 1 - differing / np.maximum(held, 1), (lowest == 0) & known.any(1))
    return near, held


def likeness(a: str, b: str) -> float:
    """How alike two texts are, from their fingerprints alone."""
    return float(compare(decode([a]), decode([b]), np.zeros(1, np.int64), np.zeros(1, np.int64))[0][0])


def difference(a: str, b: str) -> tuple[set[int], set[int]]:
    """The paragraph digests (of 40 bits) that only text a has, and that only text b has, by peeling larger and larger sketches."""
    x, y = (keys_of(digests([t.encode("utf-8", "surrogatepass")])[1]) for t in (a, b))
    cells = CELLS
    while True:
        diff = Sketches(1, cells)
        diff.add(np.zeros(len(x), np.int64), x)
        diff.add(np.zeros(len(y), np.int64), y, -1)
        done, taken = diff.peel()
        if done[0]:
            keys = [(int(k >> CHECK_BITS), int(s)) for _, key, sign in taken for k, s in zip(key, sign, strict=True)]
            return {k for k, s in keys if s > 0}, {k for k, s in keys if s < 0}
        cells *= 2


# --- over a table


def with_following(docs: DataFrame) -> DataFrame:
    """(bucket, look, doc_id, text): documents in ranges of doc_id, each range with its successor.

    Quantiles of doc_id cut the table into ranges of about RANGE_BYTES, as many at least as
    there are shuffle partitions and MAX_RANGES at most, a task each; the first document of each range also goes,
    marked look = 1, to the range before it, and the very first one to the last range. Only
    the ranges' first ids reach the driver, a bounded number. So texts are shuffled once and no order over
    all rows is needed. Rows that repeat one id lie in one range.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    key = F.coalesce(F.col("doc_id"), F.lit(least))
    ids = docs.select(key.alias("key"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    cuts = sorted(set(ids.approxQuantile("key", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    # a range is led by its cut; the first range by the smallest id there is
    bounds = np.array([int(c) for c in cuts], np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = ids.groupBy(range_of("key").alias("bucket")).agg(F.min("key").alias("first")).collect()  # a row a range
    led = sorted((r["bucket"], r["first"]) for r in firsts)
    before = {first: led[k - 1][0] for k, (_, first) in enumerate(led)}  # the first range's successor role wraps round

    @F.pandas_udf("array<int>")
    def places_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, keys.to_numpy(np.int64), side="right")
        return pd.Series([[2 * int(b), 2 * before[k] + 1] if k in before else [2 * int(b)] for b, k in zip(at, keys.tolist(), strict=True)])

    placed = docs.select("doc_id", "text", key.alias("key"), F.explode(places_of(key)).alias("place"))
    spread = placed.select(F.floor(F.col("place") / 2).cast("int").alias("bucket"), (F.col("place") % 2).alias("look"), "key", "doc_id", "text").repartitionById(n, "bucket")
    return spread.sortWithinPartitions("bucket", "look", "key", "text").select("bucket", "look", "doc_id", "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sample_edited long, sample_next long"


def _compare(ids: list, texts: list[str]) -> dict[str, list]:
    """Results for all texts but the last, each with the one after it."""
    n = len(ids)
    edited = []
    for k in range(n):
        half = len(texts[k]) // 2
        edited.append((texts[k][: len(texts[k]) - half] + texts[k + 1][:half]).encode("utf-8", "surrogatepass"))
    own = encode(ladders(*digests([t.encode("utf-8", "surrogatepass") for t in texts]), n + 1))
    new = encode(ladders(*digests(edited), n))
    a, b, at = decode(own), decode(new), np.arange(n)
    near_edited, sample_edited = compare(a, b, at, at)
    near_next, sample_next = compare(a, a, at, at + 1)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": own[:n],
        "edited_fingerprint": new,
        "near_edited": near_edited.tolist(),
        "near_next": near_next.tolist(),
        "sample_edited": sample_edited.tolist(),
        "sample_next": sample_next.tolist(),
    }


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 1_500_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, sample_edited, sample_next.

    near_* is what likeness() gives for the two fingerprints, sample_* the number of digests
    of both texts that it rests on, all of them where the whole difference peels. A null text counts as empty; two empty texts are wholly alike. Null ids come first.
    Rows that repeat an id are documents of their own, in the order of their texts; a
    table of one row is its own successor; extra columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_OUT)
        bucket, ended, held = None, False, 0
        ids: list = []
        texts: list[str] = []
        for batch in batches:
            for b, look, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != bucket:
                    bucket, ended, held = b, False, 0
                    ids, texts = [], []
                if ended:
                    continue
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 64
                ended = look == 1
                if len(ids) > 1 and (ended or held >= slice_chars):
                    yield record_batch(_compare(ids[:-1], texts), schema)
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])

    return with_following(docs).mapInArrow(run, _OUT)
