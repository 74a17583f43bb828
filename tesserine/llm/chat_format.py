r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn after turn, as <turn>role<body>text</turn> and a
line end; the spans of its turns are sorted by construction. The rendering is encoded
once with character offsets, and each token is matched to the turn span that holds it by
binary search: tokens inside an assistant's text make up the loss mask. The three
control strings are tokens of their own, so no token reaches over a span's edge.

Control strings inside a text are escaped: a backslash becomes two, and a control
string's "<" gets a backslash after it, so that "</turn>" reads "<\/turn>". A reader
drops each backslash and keeps what follows it; the escape loses nothing.

Rows of a conversation are read in order as a stream sorted by turn and are rendered in
blocks of at most BLOCK_TURNS turns or BLOCK_CHARS characters, so that memory doesn't
follow the longest conversation; a block ends between turns, which is a token edge.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.bpe import vocabulary_path
from tesserine.llm.common import arrow_schema, record_batch

TURN, BODY, END = "<turn>", "<body>", "</turn>"
VOCABULARY = "byte_bpe_50k.json"
BLOCK_TURNS, BLOCK_CHARS = 256, 1_000_000
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"<(?=/?turn>|body>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_RENDERED = re.compile(r"<turn>(.*?)<body>(.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@functools.lru_cache(maxsize=2)
def tokenizer(name: str):
    """The vocabulary with the control strings added as tokens; its own special strings are plain text."""
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(vocabulary_path(name))
    made.add_tokens([AddedToken(s, normalized=False) for s in (TURN, BODY, END)])
    made.encode_special_tokens = True
    return made


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of (role, text) turns, and the start and end of each turn's text in it."""
    parts: list[str] = []
    starts, ends, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{TURN}{escape(role)}{BODY}", escape(text), f"{END}\n"
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        at = ends[-1] + len(tail)
        parts += [head, body, tail]
    return "".join(parts), np.array(starts, np.int64), np.array(ends, np.int64)


def loss_mask(offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Whether each token lies in a trained turn's text: its start is searched in the sorted spans."""
    if not len(starts) or not len(offsets):
        return np.zeros(len(offsets), bool)
    turn = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    held = np.maximum(turn, 0)
    return (turn >= 0) & (offsets[:, 1] <= ends[held]) & (offsets[:, 0] < ends[held]) & trained[held]


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """What the mask covers in the formatted text, as runs of adjoining tokens."""
    runs: list[list[int]] = []
    for a, b in offsets[mask].tolist():
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return [formatted[a:b] for a, b in runs]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering, unescaped."""
    return [(unescape(role), unescape(text)) for role, text in _RENDERED.findall(formatted)]


def _encode(turns: list[tuple[str, str]], vocabulary: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    formatted, starts, ends = render(turns)
    encoded = tokenizer(vocabulary).encode(formatted, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    trained = np.array([role == LOSS_ROLE for role, _ in turns], bool)
    return formatted, np.array(encoded.ids, np.int32), offsets, loss_mask(offsets, starts, ends, trained)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]], bool]]:
    """(conversation, turns, whether its last block) out of batches sorted by conversation and turn."""
    current: int | None = None
    turns: list[tuple[str, str]] = []
    held, begun = 0, False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if begun and conv != current:
                yield current, turns, True
                turns, held = [], 0
            elif turns and (len(turns) >= BLOCK_TURNS or held >= BLOCK_CHARS):
                yield current, turns, False
                turns, held = [], 0
            current, begun = conv, True
            turns.append((role, text))
            held += len(text)
    if begun:
        yield current, turns, True


def _sorted_turns(df: DataFrame) -> DataFrame:
    empty = F.lit("")
    plain = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.col("turn").cast("long").alias("turn"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


FORMATTED = "conv_id long, block int, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def format_conversations(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, block, formatted, ids, starts, ends, mask of every conversation.

    starts and ends are the tokens' character offsets in the block's formatted text. A
    null text or role counts as empty, rows without a conv_id form one conversation of
    their own, equal turns are ordered by role and text, repeated rows stay, extra
    columns are not read and no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FORMATTED)
        number = 0
        for conv, turns, last in _blocks(batches):
            formatted, ids, offsets, mask = _encode(turns, vocabulary)
            yield record_batch({"conv_id": [conv], "block": [number], "formatted": [formatted], "ids": [ids], "starts": [offsets[:, 0].astype(np.int32)], "ends": [offsets[:, 1].astype(np.int32)], "mask": [mask]}, schema)
            number = 0 if last else number + 1

    return _sorted_turns(df).mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a conversation, read from the formatted output: the turns parsed out of
    the rendering and the text found under the token mask, both unescaped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(DIGESTS)
        out: dict[str, list] = {f.name: [] for f in schema}
        n = loss = chars = tokens = trained = 0
        all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
        for conv, turns, last in _blocks(batches):
            formatted, ids, offsets, mask = _encode(turns, vocabulary)
            for role, text in parse(formatted):
                n += 1
                all_turns.update(f"{role}\n{text}\n".encode())
            for run_text in masked_text(formatted, offsets, mask):
                text = unescape(run_text)
                loss += len(text)
                all_loss.update(text.encode())
            chars += len(formatted)
            tokens += len(ids)
            trained += int(mask.sum())
            if last:
                for k, v in zip(out, (conv, n, all_turns.hexdigest(), loss, all_loss.hexdigest(), chars, tokens, trained), strict=True):
                    out[k].append(v)
                n = loss = chars = tokens = trained = 0
                all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
                if len(out["conv_id"]) >= 5000:
                    yield record_batch(out, schema)
                    out = {f.name: [] for f in schema}
        if out["conv_id"]:
            yield record_batch(out, schema)

    return _sorted_turns(df).mapInArrow(run, DIGESTS)
