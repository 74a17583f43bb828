"""BPE encoding and decoding with segment trees over adjacent pair ranks.

Every distinct word is a row of a batch. A row's leaves hold, for each symbol, the
key (rank, position) of the pair that starts there; inner nodes hold the minimum of
their children, so the root names the leftmost pair of the lowest rank. A merge is
three point updates (the pair itself, its left neighbour, the vanished right symbol),
each of which touches one leaf-to-root path: O(log n) for a merge and O(n log n) for
a word, until no mergeable pair remains. NumPy carries the step for all rows at once,
and the last few rows, or a single very long word, go through the same steps one by one.

Texts are cut at white space first; a piece's ids don't depend on its neighbours, so a
bounded cache by piece holds for all of a worker's tasks. Where only ids are asked for,
plain texts of a batch are cut to words together, by the kinds of their bytes, each
distinct word is looked up once, and an index array puts the ids in the texts' order.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesserine.llm.common import id_text, map_texts

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Entries that a worker keeps at most; on reaching it the cache starts anew.
CACHE_ENTRIES = 400_000
#: Cells of a batch of segment trees at most, for bounded memory.
BATCH_CELLS = 1 << 21
NONE = np.int64(1) << 60
#: So many live rows or fewer are finished one by one: a step over arrays costs more than they do.
FEW_ROWS = 12

#: White space as Unicode's White_Space has it; str.split() also cuts at the four below.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_SPLIT_ODD = re.compile("[\x1c-\x1f]")
#: Fixed value: the vocabulary file's own cutting rule.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Of each Latin-1 letter by that rule: blank, letter, number or another sign.
_BLANK, _LETTER, _NUMBER, _SIGN = range(4)
_KINDS = np.array([_BLANK if not _PIECES.findall(c) else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _SIGN for c in map(chr, range(256))], np.uint8)
#: Words that a batch is cut to hold so many bytes at most, for bounded memory; a longer text is a batch of its own.
CUT_BYTES = 2_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(plain, plain, strict=True))
    spare = 256
    for b in range(256):
        if b not in letters:
            letters[b] = spare
            spare += 1
    return [chr(letters[b]) for b in range(256)]


def is_plain(text: str) -> bool:
    """Whether lower() alone normalises the text: Latin-1 letters only and no special strings."""
    if "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cut_words(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a lower-cased Latin-1 text, and where its words start and stop by _PIECES."""
    data = np.frombuffer(plain, np.uint8)
    kind = _KINDS[data]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    edge = kind != before
    # an ending such as 's is a word where its sign begins a match, and what follows it begins another
    quote = np.flatnonzero((data == 39) & edge)
    ahead = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = ahead[quote + 1], ahead[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begin = edge | (kind == _NUMBER)
    begin[quote[short | long] + 1] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    begin[after[after < len(data)]] = True
    begin &= kind != _BLANK
    start = np.flatnonzero(begin)
    # a word stops where the next one or white space begins
    edges = np.flatnonzero(begin | (edge & (kind == _BLANK)))
    stop = np.append(edges, len(data))[np.searchsorted(edges, start) + 1]
    return data, start, stop


class PairRanks:
    """Rank and merged id of symbol pairs, looked up for arrays of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.by_rank = np.concatenate([made, [-1]]).astype(np.int32)
        self.made: list[int] = made.tolist()
        key = left << 20 | right
        rank = np.arange(len(key))
        # of a pair listed twice the later listing holds
        key, rank = key[::-1], rank[::-1]
        self.keys, first = np.unique(key, return_index=True)
        self.ranks = rank[first]
        #: The same by a pair's packed key, for single look-ups.
        self.table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or -1 where the pair doesn't merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


class SegmentTrees:
    """One tree for each row of symbols; width is a power of two."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks):
        n, w = symbols.shape
        self.w, self.pairs, self.symbols = w, pairs, symbols
        cols = np.arange(w, dtype=np.int32)
        self.after = np.broadcast_to(cols + 1, (n, w)).copy()
        self.before = np.broadcast_to(cols - 1, (n, w)).copy()
        self.lengths = lengths
        self.tree = np.full((n, 2 * w), NONE, np.int64)
        rows, at = np.nonzero(cols[None, :] < (lengths - 1)[:, None])
        self._set(rows, at.astype(np.int64), at.astype(np.int64) + 1)
        for level in range(int(w).bit_length() - 2, -1, -1):
            lo, hi = 1 << level, 2 << level
            self.tree[:, lo:hi] = np.minimum(self.tree[:, 2 * lo : 2 * hi : 2], self.tree[:, 2 * lo + 1 : 2 * hi : 2])

    def _set(self, rows: np.ndarray, at: np.ndarray, right: np.ndarray) -> None:
        rank = self.pairs.of(self.symbols[rows, at], self.symbols[rows, right])
        self.tree[rows, self.w + at] = np.where(rank >= 0, rank * self.w + at, NONE)

    def _lift(self, rows: np.ndarray, at: np.ndarray) -> None:
        cells, base, node = self.tree.reshape(-1), rows * (2 * self.w), (self.w + at) >> 1
        while node.size and node[0] >= 1:
            below = base + 2 * node
            cells[base + node] = np.minimum(cells.take(below), cells.take(below + 1))
            node = node >> 1

    def merge_all(self) -> None:
        tree, w = self.tree, self.w
        live = np.flatnonzero(tree[:, 1] < NONE)
        while live.size > FEW_ROWS:
            root = tree[live, 1]
            at = root % w
            made = self.pairs.by_rank[root // w]
            gone = self.after[live, at].astype(np.int64)
            following = self.after[live, gone].astype(np.int64)
            self.symbols[live, at] = made
            self.symbols[live, gone] = -1
            self.after[live, at] = following
            tree[live, w + gone] = NONE
            tree[live, w + at] = NONE
            more = following < self.lengths[live]
            self.before[live[more], following[more]] = at[more]
            self._set(live[more], at[more], following[more])
            ahead = self.before[live, at].astype(np.int64)
            some = ahead >= 0
            self._set(live[some], ahead[some], at[some])
            self._lift(live, gone)
            self._lift(live, at)
            self._lift(live[some], ahead[some])
            live = live[tree[live, 1] < NONE]
        for row in live.tolist():
            self._finish(row)

    def _finish(self, row: int) -> None:
        """The same steps for one row, without arrays: for the last few live rows and for very long words."""
        w, none, table, made = self.w, int(NONE), self.pairs.table, self.pairs.made
        tree, symbols, after, before = (x[row].tolist() for x in (self.tree, self.symbols, self.after, self.before))
        length = int(self.lengths[row])

        def put(at: int, right: int) -> None:
            rank = table.get(symbols[at] << 20 | symbols[right], -1) if right < length else -1
            node = w + at
            tree[node] = rank * w + at if rank >= 0 else none
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return  # nothing above changes
                tree[node] = least
                node >>= 1

        while (root := tree[1]) < none:
            at = root % w
            gone = after[at]
            following = after[gone]
            symbols[at], symbols[gone], after[at] = made[root // w], -1, following
            if following < length:
                before[following] = at
            put(gone, length)
            put(at, following)
            if before[at] >= 0:
                put(before[at], at)
        self.symbols[row] = symbols


class Bpe:
    """Encodes as the tokenizers library does with the same file, special strings included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = PairRanks(self.vocab, merges)
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([self.vocab[x] for x in letters], np.int32)
        self.last = np.array([self.vocab[x + end] for x in letters], np.int32)
        self.names = dict(zip(self.vocab.values(), self.vocab, strict=True))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.names.update({i: s for s, i in self.special.items()})
        self.dtype = np.dtype("<u2") if max(self.names) < 1 << 16 else np.dtype("<u4")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = Tokenizer.from_file(path)
        self._byte_of = {c: b for b, c in enumerate(letters)}
        #: Packed ids by lower-cased plain piece or word, and by raw piece.
        self.pieces: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        #: Packed ids by lower-cased plain word, in Latin-1.
        self.words: dict[bytes, bytes] = {}

    # --- words
    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, a word being the bytes of one pre-token."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for w in np.unique(widths[lengths > 0]):
            chosen = np.flatnonzero((widths == w) & (lengths > 0))
            step = max(1, BATCH_CELLS // int(w))
            for lo in range(0, len(chosen), step):
                self._merge_batch(words, chosen[lo : lo + step], lengths, int(w), out)
        return out

    def _merge_batch(self, words: list[bytes], chosen: np.ndarray, lengths: np.ndarray, w: int, out: list[bytes]) -> None:
        n = lengths[chosen]
        flat = np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8)
        symbols = np.full((len(chosen), w), -1, np.int32)
        inside = np.arange(w)[None, :] < n[:, None]
        symbols[inside] = self.inner[flat]
        ends = np.cumsum(n) - 1
        symbols[np.arange(len(chosen)), n - 1] = self.last[flat[ends]]
        trees = SegmentTrees(symbols, n, self.pairs)
        trees.merge_all()
        kept = symbols >= 0
        packed = symbols[kept].astype(self.dtype).tobytes()
        stops = np.cumsum(kept.sum(1)) * self.dtype.itemsize
        start = 0
        for i, stop in zip(chosen.tolist(), stops.tolist(), strict=True):
            out[i] = packed[start:stop]
            start = stop

    # --- pieces between white space
    def _cut(self, piece: str) -> list[str | int]:
        """A raw piece's pre-tokens as words, or ids of special strings, the library's own rules applied."""
        parts: list[str | int] = []
        for part in self._special.split(piece) if self._special else [piece]:
            if part in self.special:
                parts.append(self.special[part])
            elif part:
                clean = self._library.normalizer.normalize_str(part)
                parts += [clean[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(clean)]
        return parts

    def learn(self, plain: set[str], raw: set[str]) -> None:
        """Puts the packed ids of unseen pieces into the cache; plain ones are lower-cased already."""
        known = self.pieces
        whole = [p for p in plain if p.isalpha()]
        cuts: dict[str, list] = {p: _PIECES.findall(p) for p in plain.difference(whole)}
        marked = {p: self._cut(p) for p in raw}
        fresh = set(whole)
        for cut in cuts.values():
            fresh.update(cut)
        for cut in marked.values():
            fresh.update([w for w in cut if isinstance(w, str)])
        words = [w for w in fresh if w not in known]
        got = dict(zip(words, self.merge_words([w.encode() for w in words]), strict=True))
        known.update(got)
        get, size = known.__getitem__, self.dtype.itemsize
        for p, cut in cuts.items():
            known[p] = b"".join(map(get, cut))
        for p, cut in marked.items():
            self.raw[p] = b"".join([get(w) if isinstance(w, str) else w.to_bytes(size, "little") for w in cut])

    @staticmethod
    def split(text: str) -> list[str]:
        """The pieces of a text between white space."""
        return text.split() if not _SPLIT_ODD.search(text) else [p for p in _SPACES.split(text) if p]

    def packed(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the packed ids of each of its pieces."""
        split: list[list[str]] = []
        seen: tuple[set[str], set[str]] = (set(), set())
        flags = [is_plain(t) for t in texts]
        for text, plain in zip(texts, flags, strict=True):
            split.append(self.split(text.lower() if plain else text))
            seen[not plain].update(split[-1])
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the lists are long
        try:
            fresh = {p for p in seen[0] if p not in self.pieces}, {p for p in seen[1] if p not in self.raw}
            if len(self.pieces) + len(fresh[0]) > CACHE_ENTRIES or len(self.raw) > CACHE_ENTRIES // 4:
                self.pieces.clear()
                self.raw.clear()
                fresh = seen
            if fresh[0] or fresh[1]:
                self.learn(*fresh)
            get, get_raw = self.pieces.__getitem__, self.raw.__getitem__
            return [list(map(get if plain else get_raw, s)) for s, plain in zip(split, flags, strict=True)]
        finally:
            if collecting:
                gc.enable()

    def _known_words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of distinct plain words, out of the cache; unseen ones are put there."""
        got = list(map(self.words.get, words))
        fresh = [k for k, ids in enumerate(got) if ids is None]
        if fresh:
            unseen = [words[k] for k in fresh]
            merged = self.merge_words([w if w.isascii() else w.decode("latin-1").encode() for w in unseen])
            if len(self.words) + len(fresh) > CACHE_ENTRIES:
                self.words.clear()
            self.words.update(zip(unseen, merged, strict=True))
            for k, ids in zip(fresh, merged, strict=True):
                got[k] = ids
        return got

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of some plain texts."""
        data, start, stop = cut_words("\n".join([*texts, ""]).lower().encode("latin-1"))
        held = stop - start
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(held, dtype=np.int32)])
        flat = data[_KINDS[data] != _BLANK]
        coded = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
        offsets, letters = (np.frombuffer(x, t) if x else np.zeros(0, t) for x, t in zip(coded.dictionary.buffers()[1:], (np.int32, np.uint8), strict=True))
        letters, bounds = letters.tobytes(), offsets[: len(coded.dictionary) + 1].tolist()
        known = self._known_words([letters[a:b] for a, b in itertools.pairwise(bounds)])
        pool = np.frombuffer(b"".join(known), self.dtype)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        word = coded.indices.to_numpy()
        n = sizes[word]
        last = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        at = np.arange(last[-1])
        at += np.repeat((np.cumsum(sizes) - sizes)[word] - last[:-1], n)
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return np.split(pool[at], last[first[1:-1]])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids."""
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        plain = np.array([is_plain(t) for t in texts], bool)
        chosen, held = np.flatnonzero(plain).tolist(), 0
        block: list[int] = []
        for k in [*chosen, None]:
            if block and (k is None or held + len(texts[k]) > CUT_BYTES):
                for i, ids in zip(block, self._encode_plain([texts[i] for i in block]), strict=True):
                    out[i] = ids
                block, held = [], 0
            if k is not None:
                block.append(k)
                held += len(texts[k]) + 1
        others = np.flatnonzero(~plain).tolist()
        for i, pieces in zip(others, self.packed([texts[i] for i in others]), strict=True):
            out[i] = np.frombuffer(b"".join(pieces), self.dtype)
        return out

    def decode(self, ids) -> str:
        """As the library decodes with a file that names no decoder: token strings joined by blanks."""
        return " ".join([self.names[i] for i in map(int, ids) if i in self.names])

    @functools.cached_property
    def decimals(self) -> pa.Array:
        """By id its decimal digits and a blank."""
        return pa.array([b"%d " % i for i in range(max(self.names) + 1)], pa.large_binary())

    @functools.cached_property
    def tokens(self) -> pa.Array:
        """By id what decode() has for it and a blank; nothing for an id without a name."""
        return pa.array([f"{self.names[i]} ".encode() if i in self.names else b"" for i in range(max(self.names) + 1)], pa.large_binary())

    def restore(self, ids) -> str:
        """The normalised words that the ids stand for, white space as single blanks at word ends."""
        text = "".join(self.names[int(i)] for i in ids)
        spaced = text.replace("</w>", " ")
        return bytes(self._byte_of.get(c, 32) if c != " " else 32 for c in spaced).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(name: str = DEFAULT_VOCABULARY) -> Bpe:
    """One encoder for each worker process."""
    return Bpe(vocabulary_path(name))


def encode(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every whole text.

    A null text counts as empty and gives no ids and the empty decoded text; repeated
    rows give repeated results; columns besides id and text are not read.
    """

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        bpe = load(vocabulary)
        got = bpe.encode_batch(texts)
        return {"doc_id": ids, "ids": [g.astype(np.int32) for g in got], "decoded": [bpe.decode(g) for g in got]}

    return map_texts(id_text(df, id_col, text_col), rows, "doc_id long, ids array<int>, decoded string")


def joined(ids: list[np.ndarray], names: pa.Array) -> Iterator[memoryview]:
    """For each list of ids their names, one behind the other, without the last blank; about CUT_BYTES ids at a time."""
    at = 0
    ends = np.cumsum([0, *map(len, ids)])
    while at < len(ids):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CUT_BYTES, side="right")) - 1)
        taken = names.take(pa.array(np.concatenate(ids[at:stop])))
        offsets, letters = (np.frombuffer(x, t) if x else np.zeros(1, t) for x, t in zip(taken.buffers()[1:], (np.int64, np.uint8), strict=True))
        bounds = offsets[ends[at : stop + 1] - ends[at]].tolist()
        for a, b in itertools.pairwise(bounds):
            yield letters[a : max(a, b - 1)].data
        at = stop


def encode_digests(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode()'s outputs as digests, made
    where the ids are, so that they needn't leave the worker."""

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        bpe = load(vocabulary)
        got = bpe.encode_batch(texts)
        of_ids, of_text = ([hashlib.sha256(x).hexdigest() for x in joined(got, names)] for names in (bpe.decimals, bpe.tokens))
        return {"doc_id": ids, "n_tokens": list(map(len, got)), "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_texts(id_text(df, id_col, text_col), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
