"""Token counts at every prefix, by dynamic programming.

The last token of a prefix's encoding tells the rest: before it stands the encoding of a
shorter prefix. So count[i] = count[i - |t|] + 1 for the one token t that ends at i and
may follow the last token at i - |t|. A token may follow another if no merge joins a part
at the end of the one with a part at the start of the other before these parts are
absorbed. White space always ends a token, so the counts of a text are those of its
pieces, one after another, and a piece's are computed once and kept.

The operator stores how the exact count changes with each character, one signed byte
each (a token spans 32 letters at most). What a prefix costs is then a sum, and what fits
a budget a search in running sums; no text is encoded again.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.bpe import _PIECES, DEFAULT_VOCABULARY, Bpe, byte_letters, is_plain, load
from tesserine.llm.common import id_text, map_texts

CACHE_PIECES = 400_000


class PrefixCounter:
    """Counts of all prefixes of a piece, a stretch of text without white space."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.letters = byte_letters()
        end = next((k for k in bpe.vocab if k.startswith(self.letters[97]) and len(k) > 1 and bpe.vocab[k] == int(bpe.last[97])), self.letters[97])
        self.end = end[1:]
        merged = set(bpe.pairs.made) | set(bpe.inner.tolist()) | set(bpe.last.tolist())
        size = len(self.end)
        self.last = {k[: len(k) - size]: i for k, i in bpe.vocab.items() if i in merged and self.end and k.endswith(self.end)}
        self.inner = {k: i for k, i in bpe.vocab.items() if i in merged and not (self.end and k.endswith(self.end))}
        if not self.end:
            self.last = self.inner
        #: Both by their letters: the token inside a word and the one that ends it, -1 for none.
        self.tokens = {k: (self.inner.get(k, -1), self.last.get(k, -1)) for k in {*self.last, *self.inner}}
        self.longest = max(map(len, self.tokens))
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for key, rank in bpe.pairs.table.items():
            made = bpe.pairs.made[rank]
            if rank < self.rank.get(made, 1 << 40):
                self.rank[made], self.parts[made] = rank, (key >> 20, key & 0xFFFFF)
        self._spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._follows: dict[int, bool] = {}
        #: Changes of the count by piece (raw ones behind a line end) and by word; on filling up the older half goes.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self._before: tuple[str, list[int], list[int], list[int]] = ("", [-1], [0], [0])

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at its end (side 1) or start (side 0), each with the rank of the merge that absorbs it."""
        found = self._spines[side].get(token)
        if found is None:
            found, part, until = [], token, 1 << 40
            while True:
                found.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.rank[part], self.parts[part][side]
            self._spines[side][token] = found
        return found

    def follows(self, pair: int) -> bool:
        """Whether the encoding of both tokens' letters is a, b, for the pair a << 20 | b."""
        table, fits = self.bpe.pairs.table, True
        for x, x_until in self._spine(pair >> 20, 1):
            for y, y_until in self._spine(pair & 0xFFFFF, 0):
                rank = table.get(x << 20 | y)
                # of equal pairs the leftmost merges first
                if rank is not None and rank < x_until and rank <= y_until:
                    fits = False
        if len(self._follows) > 4 * CACHE_PIECES:
            self._follows.clear()
        self._follows[pair] = fits
        return fits

    def counts(self, letters: str) -> list[int]:
        """Token counts of letters[:i] for i from 0, each prefix a word of its own.

        What the letters share with those asked for before is taken from there, so words in
        order are cheap.
        """
        n, table, longest, known = len(letters), self.tokens.get, self.longest, self._follows
        done, tokens, counts, out = self._before
        k, most = 0, min(n, len(done))
        while k < most and letters[k] == done[k]:
            k += 1
        rest = [-1] * (n - k)
        tokens, counts, out = tokens[: k + 1] + rest, counts[: k + 1] + rest, out[: k + 1] + rest
        for i in range(k + 1, n + 1):
            inside = ends = True  # still wanted
            for start in range(i - longest if i > longest else 0, i):
                both = table(letters[start:i])
                if both is None:
                    continue
                token, last = both
                if not start:
                    if inside and token >= 0:
                        tokens[i], counts[i], inside = token, 1, False
                    if ends and last >= 0:
                        out[i], ends = 1, False
                else:
                    before = tokens[start] << 20
                    if inside and token >= 0:
                        fits = known.get(before | token)
                        if self.follows(before | token) if fits is None else fits:
                            tokens[i], counts[i], inside = token, counts[start] + 1, False
                    if ends and last >= 0:
                        fits = known.get(before | last)
                        if self.follows(before | last) if fits is None else fits:
                            out[i], ends = counts[start] + 1, False
                if not (inside or ends):
                    break
            if inside or ends:
                raise ValueError("a letter without a token")
        self._before = (letters, tokens, counts, out)
        return out

    def _letters(self, raw: bytes) -> str:
        return "".join([self.letters[b] for b in raw])

    def _word(self, word: str) -> bytes:
        """Changes of the count with each character of one pretoken."""
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.counts(self._letters(raw))
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction; cut short it is a quote and a letter
            whole, quote = counts[-1], self.counts(self._letters(b"'"))[1]
            counts = [0, quote, *([quote + self.counts(self._letters(raw[1:2]))[1]] if len(word) == 3 else []), whole]
        elif len(raw) != len(word):
            ends = [0]
            for c in word:
                ends.append(ends[-1] + len(c.encode("utf-8", "surrogatepass")))
            counts = [counts[k] for k in ends]
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.words]
        if len(self.words) + len(fresh) > CACHE_PIECES:
            self.words.clear()
            fresh = list(words)
        for word in sorted(fresh):
            self.words[word] = self._word(word)

    def _normal(self, pretokens: list[str]) -> list[int]:
        """Counts of every prefix of normalised text, cut to pretokens."""
        self.learn(set(pretokens))
        return running(b"".join([self.words[w] for w in pretokens])).tolist()

    def _odd(self, piece: str) -> list[int]:
        """Counts of every prefix of a raw piece, the library's own rules applied."""
        library, bpe = self.bpe._library, self.bpe
        out, before = [0], ""
        for part in bpe._special.split(piece) if bpe._special else [piece]:
            base = out[-1 - len(before)]
            if part in bpe.special:  # cut short it is text behind the text before it
                # the count before it, and one more, once it is whole
                inside = self._odd_text(before + part, library)
                out += [base + k for k in inside[len(before) + 1 : -1]] + [out[-1] + 1]
                before = ""
            elif part:
                out += [base + k for k in self._odd_text(part, library)[1:]]
                before = part
        return out

    def _odd_text(self, part: str, library) -> list[int]:
        """Counts of a part without special strings that count as such."""
        clean = library.normalizer.normalize_str(part)
        each = [library.normalizer.normalize_str(c) for c in part]
        if unicodedata.is_normalized("NFC", part) and "".join(each) == clean and "" not in each:
            counts = self._normal([clean[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(clean)])
            at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            return [counts[k] for k in at]
        # composing characters change what stands before them: each prefix on its own
        return [sum(self._normal([c[a:b]])[-1] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(c)) if (c := library.normalizer.normalize_str(part[:i])) else 0 for i in range(len(part) + 1)]

    def _known(self, pieces: set[str]) -> None:
        """Puts the changes of all pieces, raw ones behind a line end, into the cache."""
        known, older = self.known, self.older
        fresh = []
        for p in pieces:
            if p not in known:
                found = older.get(p)
                if found is None:
                    fresh.append(p)
                else:
                    known[p] = found
        if len(known) + len(fresh) > CACHE_PIECES:
            kept = {p: known[p] for p in pieces if p in known}
            self.older, self.known = known, kept
            known = kept
        cuts = {p: _PIECES.findall(p) for p in fresh if p[0] != "\n"}
        self.learn({w for cut in cuts.values() for w in cut})
        words = self.words
        for p, cut in cuts.items():
            known[p] = b"".join([words[w] for w in cut])
        for p in fresh:
            if p[0] == "\n":
                known[p] = np.diff(np.array(self._odd(p[1:]), np.int64)).astype(np.int8).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Changes of the count with each character of each text."""
        plain = [is_plain(t) for t in texts]
        low = [t.lower() if k else t for t, k in zip(texts, plain, strict=True)]
        pieces = [self.bpe.split(t) if k else ["\n" + p for p in self.bpe.split(t)] for t, k in zip(low, plain, strict=True)]
        self._known({p for found in pieces for p in found})
        known, out = self.known, []
        for text, is_low, found in zip(low, plain, pieces, strict=True):
            steps = [known[p] for p in found]
            whole = b"\0".join(steps)
            if len(whole) != len(text):  # else single blanks between the words and none around them
                held, at = bytearray(len(text)), 0
                for p, step in zip(found, steps, strict=True):
                    at = text.index(p if is_low else p[1:], at)
                    held[at : at + len(step)] = step
                    at += len(step)
                whole = bytes(held)
            out.append(whole)
        return out

    def text(self, text: str) -> bytes:
        return self.texts([text])[0]


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str = DEFAULT_VOCABULARY) -> PrefixCounter:
    """One counter for each worker process."""
    return PrefixCounter(load(vocabulary))


def running(steps: bytes) -> np.ndarray:
    """Token count of every prefix, from the empty one to the whole text, out of what is stored."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def count_prefix(steps: bytes, n_chars: int) -> int:
    """Tokens of text[:n_chars], from what is stored."""
    return int(np.frombuffer(steps, np.int8)[:n_chars].sum(dtype=np.int64))


def chars_within(steps: bytes, budget: int) -> int:
    """The longest prefix whose tokens fit the budget, in characters, from what is stored."""
    fits = np.flatnonzero(running(steps) <= budget)
    return int(fits[-1]) if len(fits) else 0


def token_counts(df: DataFrame, limit: int = 2048, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_within_limit, steps.

    steps stores the count at every prefix as changes, a byte a character; the count of
    the whole text is their sum, and chars_within_limit the longest prefix of at most
    limit tokens. A null text counts as empty: no bytes, no tokens. Repeated rows give
    repeated results; columns besides id and text are not read. A very long word costs
    time in proportion to its length; only one with characters that compose with those
    before them (not in normal form C) costs its square.
    """

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        steps = counter(vocabulary).texts(texts)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [count_prefix(s, len(s)) for s in steps], "chars_within_limit": [chars_within(s, limit) for s in steps], "steps": steps}

    counted = map_texts(id_text(df, id_col, text_col), rows, "doc_id long, n_bytes long, n_tokens long, chars_within_limit long, steps binary")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(df: DataFrame, budget: int, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text cut to the longest prefix of at most `budget` tokens, n_tokens of it."""

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        steps = counter(vocabulary).texts(texts)
        ends = [chars_within(s, budget) for s in steps]
        return {"doc_id": ids, "text": [t[:e] for t, e in zip(texts, ends, strict=True)], "n_tokens": [count_prefix(s, e) for s, e in zip(steps, ends, strict=True)]}

    return map_texts(id_text(df, id_col, text_col), rows, "doc_id long, text string, n_tokens long")
