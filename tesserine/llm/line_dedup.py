"""Line dedup: runs of equal lines, and passages of over 50 words, are deleted, all but their first occurrence.

**Lines.** A run is a stretch of whole lines, blank ones apart; two are equal if their lines
have the same words. Runs of `line_words` words and more are found by winnowing over line hashes:

1. From each line on, the fewest lines that have so many words are a window. It selects the
   line with the smallest hash, the leftmost of equals, as its fingerprint. Equal windows
   select equal lines, so runs with an equal window are sure to share a fingerprint.
2. Selected positions are joined by fingerprint; those found at one place only are dropped.
   A position carries the windows that selected it: the extension of a match both ways.
3. Of equal windows the first by (doc_id, text, word) stays; later ones are deleted unless
   they overlap their own first in the same text.

Passages are looked for first; lines that lost words to one don't count, so the lines of
copies are not gone through again.

**Passages.** A repeated passage may begin and end anywhere in its lines, and copies may be wrapped
otherwise. So a text counts as all the lines of LINE words that it can be wrapped to, one
from each of its words on, and white space between words doesn't matter.

1. Winnowing: every window of SPAN such lines, WINDOW words in all, selects the line with
   the smallest hash, the leftmost of equals, as its fingerprint. Equal windows select
   equal lines, so a passage of WINDOW words is sure to share a fingerprint. Only selected
   positions are written, each with its reach: the windows that selected it, which lie
   around it without a gap, and a hash of all words in them.
2. Positions are joined by fingerprint; those found at one place only are dropped.
3. Matches are extended both ways. Positions whose whole reach is alike match up to its
   ends, and the match goes on at the fingerprints before and after. Where the reaches of
   one fingerprint differ, the match is extended from the line word by word: the windows
   of the reach are compared one by one, for one place of each kind of reach.
4. Of equal windows the first by (doc_id, text, word) stays; later ones are deleted unless
   they overlap their own first in the same text. So the first run always stays whole.

Places meet in grouped minima, never as pairs, and hot fingerprints meet their minima by
a broadcast of bounded size (see skew_join).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import materialize, skew_join, slices
from tesserine.llm.fingerprints import BYTE_HASHES, mix, powers

LINE, SPAN = 20, 32
#: Words of a window: the shortest passage that is found.
WINDOW = LINE + SPAN - 1
#: Words of the shortest run of whole lines that is found.
LINE_WORDS = 6
#: A list of documents is broadcast up to so many rows and positions (8 bytes each); longer ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_POSITIONS = 200_000, 1_000_000
SLICE = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOW, _HIGH = np.uint64(0xFFFFFF), np.uint64(24)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words: the text of each, its number within it, running sums of their hashes, and which begin a line."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    start, stop = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    up, down = powers(len(data) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASHES[data] * up[: len(data)], dtype=np.uint64)])
    words = mix((running[stop] - running[start]) * down[start] + (stop - start).astype(np.uint64))
    first = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))]).astype(np.int64)
    held = np.diff(first)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    begin = np.concatenate([[0], np.searchsorted(start, np.flatnonzero(data == 10))])
    begin = begin[(np.diff(begin, prepend=-1) != 0) & (begin < len(start))]
    return np.repeat(np.arange(len(raw)), held), np.arange(len(start)) - np.repeat(first[:-1], held), sums, begin


def _content(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start] + (stop - start).astype(np.uint64))


def winnow(texts: list[str]) -> dict[str, np.ndarray]:
    """The selected positions: doc (index), fp, reach (a hash of its words), lo (first word of the reach) and n (windows)."""
    doc, number, sums, _ = _hashed(texts)
    at = np.flatnonzero(doc[: max(0, len(doc) - WINDOW + 1)] == doc[WINDOW - 1 :]) if len(doc) >= WINDOW else np.zeros(0, np.int64)
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("doc", "fp", "reach", "lo", "n")}
    place = np.arange(len(doc) - LINE + 1)
    lines = _content(sums, place, place + LINE)
    least = (lines >> _HIGH << _HIGH) | (place.astype(np.uint64) & _LOW)
    for k in range(SPAN.bit_length() - 1):
        least = np.minimum(least[: -(1 << k)], least[1 << k :])
    pos = at + ((((least[at] & _LOW).astype(np.int64)) - at) & 0xFFFFFF)
    edge = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (doc[at[1:]] != doc[at[:-1]])]))
    lo, n = at[edge], np.diff(np.concatenate([edge, [len(at)]]))
    reach = _content(sums, lo, lo + n + WINDOW - 1)
    return {"doc": doc[lo], "fp": lines[pos[edge]].view(np.int64), "reach": reach.view(np.int64), "lo": number[lo], "n": n}


def _selected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, SLICE):
        found = winnow(part.column(1).to_pylist())
        at = pa.array(found["doc"])
        columns = [pa.array(found["fp"]), pa.array(found["reach"]), part.column(0).take(at), part.column(2).take(at), pa.array(found["lo"].astype(np.int32)), pa.array(found["n"].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["fp", "reach", "doc_id", "text_key", "lo", "n"])


def winnow_lines(texts: list[str], line_words: int) -> dict[str, np.ndarray]:
    """Of each window: doc (index), content (its hash), lo and hi (words), the line pos that it selects and that line's hash fp."""
    doc, number, sums, start = _hashed(texts)
    stop = np.append(start[1:], len(doc))[: len(start)]
    lines = _content(sums, start, stop)
    line_sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines * powers(len(lines) + 1)[0][: len(lines)], dtype=np.uint64)])
    last = np.searchsorted(stop, start + line_words)
    at = np.flatnonzero(last < len(start))
    at = at[doc[start[at]] == doc[start[last[at]]]]
    last = last[at]
    pos, least = at.copy(), lines[at]
    for k in range(1, int((last - at).max(initial=0)) + 1):  # a window has line_words lines at most
        there = np.minimum(at + k, last)
        less = lines[there] < least
        pos[less], least[less] = there[less], lines[there[less]]
    lo = number[start[at]]
    return {"doc": doc[start[at]], "fp": least.view(np.int64), "pos": pos, "content": _content(line_sums, at, last + 1).view(np.int64), "lo": lo, "hi": lo + stop[last] - start[at]}


_LISTS = {"fp": np.int64, "pos": np.int32, "content": np.int64, "lo": np.int32, "hi": np.int32}
_LINES = "doc_id long, text_key long, fp array<long>, pos array<int>, content array<long>, lo array<int>, hi array<int>"
_POSITIONS = "fp long, doc_id long, text_key long, content array<long>, lo array<int>, hi array<int>"


def _listed(offsets: np.ndarray, found: dict[str, np.ndarray], names: Iterable[str]) -> list[pa.Array]:
    ends = pa.array(offsets.astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(found[k].astype(_LISTS[k]))) for k in names]


def _selected_lines(line_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            found = winnow_lines(part.column(1).to_pylist(), line_words)
            held = np.bincount(found["doc"], minlength=part.num_rows)
            lists = _listed(np.concatenate([[0], np.cumsum(held)]), found, _LISTS)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["doc_id", "text_key", *_LISTS]).filter(pa.array(held > 0))

    return run


def _positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The selected positions, each with the windows that selected it; windows that a deleted stretch (r_lo, r_hi) touches are left out."""
    for part in batches:
        if not part.num_rows:
            continue

        def column(name: str) -> tuple[np.ndarray, np.ndarray]:
            lists = part.column(name)  # noqa: B023
            held = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return np.repeat(np.arange(part.num_rows), held), lists.flatten().to_numpy(zero_copy_only=False)  # noqa: B023

        row = column("fp")[0]
        found = {k: column(k)[1] for k in _LISTS}
        of, lo = column("r_lo")
        # one number for row and word; stretches of a row are sorted, so joined ones are known by where they end
        begin, end = (of << 32) + lo, np.maximum.accumulate((of << 32) + column("r_hi")[1])
        if len(begin):
            k = np.searchsorted(begin, (row << 32) + found["hi"]) - 1
            whole = (k < 0) | (end[k] <= (row << 32) + found["lo"])
            row, found = row[whole], {name: x[whole] for name, x in found.items()}
        edge = np.flatnonzero((np.diff(found["pos"], prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        at = pa.array(row[edge])
        lists = _listed(np.append(edge, len(row)), found, ("content", "lo", "hi"))
        yield pa.RecordBatch.from_arrays([pa.array(found["fp"][edge]), part.column(0).take(at), part.column(1).take(at), *lists], names=["fp", "doc_id", "text_key", "content", "lo", "hi"])


def repeated_lines(docs: DataFrame, line_words: int = LINE_WORDS, deleted: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, lo, hi: stretches of words that are runs of whole lines and stand earlier too.

    Lines that stretches of `deleted` (doc_id, text_key, r: sorted lo and hi) touch don't count, neither as first nor as later ones.
    """
    place = F.struct("doc_id", "text_key", "lo")
    lines = docs.select("doc_id", "text", "text_key").mapInArrow(_selected_lines(line_words), _LINES)
    nothing = F.array().cast("array<int>")
    if deleted is None:
        lines = lines.withColumns({"r_lo": nothing, "r_hi": nothing})
    else:
        gone = deleted.select("doc_id", "text_key", F.col("r.lo").alias("r_lo"), F.col("r.hi").alias("r_hi"))
        lines = lines.join(gone, ["doc_id", "text_key"], "left")
    found = materialize(lines.mapInArrow(_positions, _POSITIONS), "line-positions")
    shared = materialize(found.groupBy("fp").agg(F.count("*").alias("held")).where("held > 1"), "shared-lines")
    kept = skew_join(found, shared, ["fp"], found.count())
    windows = kept.select("doc_id", "text_key", F.explode(F.arrays_zip("content", "lo", "hi")).alias("w"))
    windows = materialize(windows.select("doc_id", "text_key", "w.content", "w.lo", "w.hi"), "line-windows")
    firsts = materialize(windows.groupBy("content").agg(F.count("*").alias("held"), F.min(place).alias("first")).where("held > 1"), "first-lines")
    later = skew_join(windows, firsts, ["content"], windows.count()).where((place != F.col("first")) & ~_overlaps(width=F.col("hi") - F.col("lo")))
    return later.select("doc_id", "text_key", "lo", "hi")


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, doc_id, text_key, lo of every window in the reaches (los, ns) of each text."""
    for part in slices(batches, SLICE):
        doc, _, sums, _ = _hashed(part.column(1).to_pylist())
        first = np.searchsorted(doc, np.arange(part.num_rows))
        los, ns = part.column(3), part.column(4)
        owner = np.repeat(np.arange(part.num_rows), [len(x) for x in los])
        n = ns.flatten().to_numpy().astype(np.int64)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lo = np.repeat(los.flatten().to_numpy().astype(np.int64), n) + step
        owner = np.repeat(owner, n)
        start = lo + first[owner]
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays([pa.array(_content(sums, start, start + WINDOW).view(np.int64)), part.column(0).take(at), part.column(2).take(at), pa.array(lo.astype(np.int32))], names=["run", "doc_id", "text_key", "lo"])


def _overlaps(first: str = "first", width: Column | int = WINDOW) -> Column:
    """Whether a place lies in the same text as its first one and less than a window behind it."""
    return F.col(f"{first}.doc_id").eqNullSafe(F.col("doc_id")) & F.col(f"{first}.text_key").eqNullSafe(F.col("text_key")) & (F.col("lo") - F.col(f"{first}.lo") < width)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lo, hi: stretches of WINDOW words and more, of (doc_id, text, text_key), that stand earlier too."""
    place = F.struct("doc_id", "text_key", "lo")
    found = materialize(docs.mapInArrow(_selected, "fp long, reach long, doc_id long, text_key long, lo int, n int"), "line-fingerprints")
    shared = found.groupBy("fp").agg(F.count("*").alias("held"), F.min("reach").alias("c"), F.max("reach").alias("d")).where("held > 1").select("fp", "held", F.expr("c != d").alias("several"))
    kept = materialize(skew_join(found, materialize(shared, "shared-fingerprints"), ["fp"], found.count()), "shared-positions")
    n_kept = kept.count()
    kinds = materialize(kept.groupBy("fp", "reach").agg(F.count("*").alias("held"), F.min(place).alias("first"), F.min("n").alias("n"), F.first("several").alias("several")), "reaches")
    alike = skew_join(kept.drop("several", "n"), kinds.where("held > 1"), ["fp", "reach"], n_kept).where(place != F.col("first"))
    alike = materialize(alike.select("doc_id", "text_key", "lo", "n", "several", _overlaps().alias("overlaps")), "later-positions")
    whole = alike.where("not overlaps").select("doc_id", "text_key", "lo", (F.col("lo") + F.col("n") + WINDOW - 1).alias("hi"))
    # one place of each kind of reach, and those that overlap it, are extended window by window
    differing = kinds.where("several").select("first.*", "n").unionByName(alike.where("overlaps and several").select("doc_id", "text_key", "lo", "n"))
    differing = materialize(differing.groupBy("doc_id", "text_key").agg(F.collect_list("lo").alias("los"), F.collect_list("n").alias("ns")), "differing-reaches")
    rows, positions = differing.agg(F.count("*"), F.coalesce(F.sum(F.size("los")), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and positions <= BROADCAST_POSITIONS
    texts = docs.join(F.broadcast(differing) if few else differing, ["doc_id", "text_key"]).select("doc_id", "text", "text_key", "los", "ns")
    runs = materialize(texts.mapInArrow(_windows, "run long, doc_id long, text_key long, lo int"), "windows")
    firsts = materialize(runs.groupBy("run").agg(F.count("*").alias("held"), F.min(place).alias("first")).where("held > 1"), "first-windows")
    single = skew_join(runs, firsts, ["run"], runs.count()).where((place != F.col("first")) & ~_overlaps()).select("doc_id", "text_key", "lo", (F.col("lo") + WINDOW).alias("hi"))
    return whole.unionByName(single)


def _ranges(found: DataFrame) -> DataFrame:
    """doc_id, text_key, r: the stretches of each text, sorted."""
    return found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("r"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int | None = None) -> DataFrame:
    """df with text_col rid of repeated runs, and n_lines, n_removed, n_words_cut beside its columns.

    Passages of WINDOW words and more go wherever they begin and end, whole lines where a run
    of them has line_words words or more (None: only passages go; what is left of near copies
    is then still alike, which a search for near duplicates after this needs). n_removed counts lines that went whole, n_words_cut words that went from lines that
    stay. A null text stays null and has no lines. A text that is wholly a later repeat
    becomes empty; the row stays. Equal lines that stand in no run of line_words words are
    never touched, however often they occur. Rows that repeat both id and text
    count once and are treated alike; rows that repeat an id with another text are documents
    of their own, ordered by a hash of the text; rows without an id come first
    and those of one text count as one. All columns of df are kept, and their names may
    clash with none but the three added ones.
    """
    keyed = df.withColumn("__key", F.xxhash64(F.col(text_col)))
    docs = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("__key").alias("text_key"))
    null_id = F.lit(-(1 << 63))  # a null id joins with nothing, so it takes the smallest number
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", null_id))
    ranges = _ranges(repeated_passages(docs))
    if line_words is not None:
        ranges = materialize(ranges, "passages")
        lines = repeated_lines(docs, line_words, ranges)
        ranges = _ranges(ranges.select("doc_id", "text_key", F.inline("r")).unionByName(lines))
    gone = ranges.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key"), F.col("r.lo").alias("word_start"), F.col("r.hi").alias("word_stop"))
    joined = keyed.join(gone, (F.coalesce(F.col(id_col).cast("long"), null_id) == F.col("__id")) & (F.col("__key") == F.col("__text_key")), "left")
    at = df.columns.index(text_col)
    parts = joined.select(*(keyed[c] for c in df.columns), *(gone[c] for c in ("word_start", "word_stop")))
    names = [*df.columns, "n_lines", "n_removed", "n_words_cut"]
    width = len(df.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col=at):
            done = _cleaned(part.column(at), part.column(width), part.column(width + 1))
            yield pa.RecordBatch.from_arrays([*(part.column(k) if k != at else done[0] for k in range(width)), *done[1:]], names=names)

    schema = df.select(*df.columns, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_words_cut")).schema
    return parts.mapInArrow(run, schema)


def _cleaned(texts: pa.Array, word_start: pa.Array, word_stop: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """The texts without their repeats, their lines, how many of them went whole and how many words went from the others."""
    n_lines = pc.if_else(texts.is_valid(), pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
    removed, n_cut = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    changed = pc.and_(texts.is_valid(), word_start.is_valid())
    at = np.flatnonzero(changed.to_numpy(zero_copy_only=False))
    if len(at):
        raw = texts.take(pa.array(at)).cast(pa.binary()).to_pylist()
        starts, stops = (x.take(pa.array(at)) for x in (word_start, word_stop))
        owner = np.repeat(np.arange(len(at)), starts.value_lengths().to_numpy(zero_copy_only=False))
        shorter, removed[at], n_cut[at] = _without(raw, owner, starts.flatten().to_numpy(), stops.flatten().to_numpy())
        texts = pc.replace_with_mask(texts, changed, shorter.cast(texts.type))
    return texts, n_lines, pa.array(removed), pa.array(n_cut)


def _without(raw: list[bytes], owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without the words lo to hi of the text owner; by text the lines that went whole and the words that went from others.

    A blank line goes with the repeat that it lies in. White space goes with the word before
    it; a line whose last words went loses the white space at its end.
    """
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    text_end = np.cumsum([len(r) + 1 for r in raw])
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    start, stop = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    first = np.concatenate([[0], np.searchsorted(start, text_end)])
    steps = np.bincount(first[owner] + lo, minlength=len(start) + 1) - np.bincount(first[owner] + hi, minlength=len(start) + 1)
    dead = np.cumsum(steps[:-1]) > 0
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    text = np.searchsorted(text_end, line_start, side="right")
    word = np.concatenate([[0], np.searchsorted(start, line_end)])
    gone_words = np.concatenate([[0], np.cumsum(dead)])
    n, n_dead = np.diff(word), np.diff(gone_words[word])
    here, around = word[:-1], np.concatenate([[False], dead, [False]])
    between = (here > first[text]) & (here < first[text + 1]) & around[here] & around[here + 1]
    gone = np.where(n > 0, n_dead == n, between)
    cut = ~gone & (n_dead > 0)
    # stretches of bytes that go, counted up where they begin and down where they end
    depth = np.zeros(len(data) + 1, np.int8)
    depth[line_start[gone]] += 1
    depth[line_end[gone] + 1] -= 1
    line = np.repeat(np.arange(len(n)), n)
    piece_end = np.minimum(np.append(start[1:], len(data))[: len(start)], line_end[line])
    pieces = dead & cut[line]
    depth[start[pieces]] += 1
    depth[piece_end[pieces]] -= 1
    alive = np.flatnonzero(~dead)
    ending = np.flatnonzero(cut)
    ending = ending[dead[word[ending + 1] - 1]]
    depth[stop[alive[np.searchsorted(alive, word[ending + 1]) - 1]]] += 1
    depth[line_end[ending]] -= 1
    # the last line that stays has no line end behind it
    stays = np.flatnonzero(~gone)
    last = stays[np.append(text[stays][1:] != text[stays][:-1], True)] if len(stays) else stays
    depth[line_end[last]] += 1
    depth[line_end[last] + 1] -= 1
    kept = np.cumsum(depth[:-1], dtype=np.int8) == 0
    ends = np.concatenate([[0], np.cumsum(kept)[text_end - 1]]).astype(np.int32)
    shorter = pa.Array.from_buffers(pa.string(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(data[kept])])
    count = lambda of, weights=None: np.bincount(of, weights, len(raw)).astype(np.int64)
    return shorter, count(text[gone]), count(text[cut], n_dead[cut])
