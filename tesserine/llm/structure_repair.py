"""Conversation structure repair: error-correcting Earley parsing of role sequences.

A weighted grammar of roles has productions that delete, rerole and insert turns. The
chart's items keep the minimum (cost, audit), and the completed chart yields the repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import arrow_schema, materialize, record_batch

#: Sequences of an optional system turn and then pairs of user and assistant, or nothing.
RULES = [
    ("whole", ("none",)), ("whole", ("pairs",)),
    ("none", ()), ("none", ("none", "gone")),
    ("opened", ("none", "system")), ("opened", ("opened", "gone")),
    ("asked", ("none", "user")), ("asked", ("opened", "user")), ("asked", ("pairs", "user")), ("asked", ("asked", "gone")),
    ("pairs", ("asked", "assistant")), ("pairs", ("pairs", "gone")),
]
#: What stands for a symbol: keep a turn of this initial, rerole any, insert one, or delete one; with its cost and edit.
KEEPS = {"system": "s", "user": "u", "assistant": "a"}
REROLES, INSERTS = {"user", "assistant"}, {"user", "assistant"}
COSTS = {"K": 0, "R": 2, "I": 2, "D": 3}
TRUNCATED = 1
#: Edits as single characters that also name the role; compared by their initials alone.
CODES = {("K", None): "K", ("D", None): "D", ("R", "user"): "R", ("R", "assistant"): "r", ("I", "user"): "I", ("I", "assistant"): "i"}
ROLE_OF = {"R": "user", "r": "assistant", "I": "user", "i": "assistant"}

_SHIFT = 0x100  # characters from here on stand for the paths that lead to a column


class Chart:
    """Columns of the Earley chart, each built once for all conversations that come to it.

    The grammar is left-linear: what isn't a single symbol begins where the conversation
    begins, so a column has a bounded number of items. An item's value is (cost, audit,
    code). Costs count from the column's cheapest item, and what an audit has up to the
    column's last turn is one character, ordered as the audits are: no such audit begins
    another one, as both end with the edit of the same turn. A column is thus one of few,
    and so is each step from column to column.
    """

    def __init__(self) -> None:
        self._columns: list[dict] = []
        self._numbers: dict[frozenset, int] = {}
        self._steps: dict[tuple[int, tuple[str, bool, bool]], tuple[int, int, list[tuple[int, str]]]] = {}
        first: dict = {}
        for k, (_, right) in enumerate(RULES):
            first[k, 0] = (0, chr(_SHIFT), "")
        self.first = self._number(self._close(first))

    def _number(self, column: dict) -> int:
        key = frozenset(column.items())
        if key not in self._numbers:
            self._numbers[key] = len(self._columns)
            self._columns.append(column)
        return self._numbers[key]

    def _close(self, column: dict) -> dict:
        """Completes what can be completed, insertions among it, until no item (rule, dot) gets better."""
        column = dict(column)

        def better(item: tuple[int, int], value: tuple[int, str, str]) -> bool:
            if item in column and column[item] <= value:
                return False
            column[item] = value
            return True

        grown = True
        while grown:
            grown = False
            for (rule, dot), (cost, audit, code) in list(column.items()):
                left, right = RULES[rule]
                if dot == len(right):
                    # completed: what waited for it at the start of the conversation moves on
                    for k, (_, other) in enumerate(RULES):
                        if other and other[0] == left:
                            grown |= better((k, 1), (cost, audit, code))
                elif right[dot] in INSERTS:
                    grown |= better((rule, dot + 1), (cost + COSTS["I"], audit + "I", code + CODES["I", right[dot]]))
        return column

    def _scan(self, column: dict, token: tuple[str, bool, bool]) -> dict:
        """The items that advance over a turn: keep, rerole and delete productions."""
        initial, must_go, truncated = token
        out: dict = {}
        for (rule, dot), (cost, audit, code) in column.items():
            right = RULES[rule][1]
            if dot == len(right):
                continue
            symbol = right[dot]
            edits = []
            if symbol == "gone":
                edits.append((COSTS["D"], "D", CODES["D", None]))
            elif not must_go:
                if KEEPS.get(symbol) == initial:
                    edits.append((COSTS["K"] + TRUNCATED * truncated, "K", CODES["K", None]))
                if symbol in REROLES:
                    edits.append((COSTS["R"] + TRUNCATED * truncated, "R", CODES["R", symbol]))
            for more, edit, as_code in edits:
                value = (cost + more, audit + edit, code + as_code)
                if (rule, dot + 1) not in out or value < out[rule, dot + 1]:
                    out[rule, dot + 1] = value
        return out

    def step(self, at: int, token: tuple[str, bool, bool]) -> tuple[int, int, list[tuple[int, str]]]:
        """The next column, what all of its costs have grown by, and for each of its paths the one it continues and how."""
        if (at, token) not in self._steps:
            column = self._close(self._scan(self._columns[at], token))
            least = min(cost for cost, _, _ in column.values())
            ends = {}
            for item, (cost, audit, code) in column.items():
                held = len(audit.rstrip("I"))
                tail = len(audit) - held
                ends[item] = (audit[:held], code[: len(code) - tail] if tail else code, tail)
            paths = sorted({(audit, code) for audit, code, _ in ends.values()})
            rank = {p: k for k, p in enumerate(paths)}
            reached = {item: (column[item][0] - least, chr(_SHIFT + rank[a, c]) + "I" * tail, column[item][2][len(c) :]) for item, (a, c, tail) in ends.items()}
            self._steps[at, token] = (self._number(reached), least, [(ord(a[0]) - _SHIFT, c) for a, c in paths])
        return self._steps[at, token]

    def end(self, at: int) -> tuple[int, int, str]:
        """Cost beyond the column's, path and last insertions of the cheapest whole conversation."""
        cost, audit, code = min(v for (rule, dot), v in self._columns[at].items() if RULES[rule][0] == "whole" and dot == 1)
        return cost, ord(audit[0]) - _SHIFT, code


#: Edits of a path are gathered into one text after so many turns.
FOLD_TURNS = 4_096


def cheapest(tokens: Iterable[tuple[str, bool, bool]], chart: Chart) -> tuple[int, list[str]]:
    """Cost and coded edits, in pieces, of the repair of (initial, must be deleted, truncated) turns.

    A path is (earlier pieces, last edits), shared by the paths that branch from it: memory
    is a few bytes a turn, whatever the number of turns.
    """
    at, cost = chart.first, 0
    paths: list[tuple] = [(None, "")]
    for k, token in enumerate(tokens):
        at, more, moves = chart.step(at, token)
        cost += more
        paths = [(paths[old][0], paths[old][1] + code) for old, code in moves]
        if k % FOLD_TURNS == FOLD_TURNS - 1:
            kept: dict[tuple, tuple] = {}
            paths = [(kept.setdefault((id(before), code), (before, code)), "") for before, code in paths]
    more, last, code = chart.end(at)
    before, edits = paths[last]
    pieces = [edits + code]
    while before is not None:
        before, piece = before
        pieces.append(piece)
    return cost + more, pieces[::-1]


# --- turns as a table

SPACES = " \t\n\x0b\x0c\r"


def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of `conv_id:turn` modulo 20; nulls count as one space there, and in role and text.

    0 drops the turn, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it,
    4 makes it the user's; others stay. conv_id and turn stay null where they were.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    held = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("again")).drop("again")


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, n, turn, role, text, fault, illegal, skipped of turns(conv_id, turn, role, text), written to the shared folder.

    n counts each conversation's turns from 1, by turn, nulls first, equal ones by role and
    text. fault is the first of blank, duplicate (role and text seen earlier) and truncated,
    else null. illegal marks a turn whose initial may not follow that of the turn before;
    skipped is how many numbers lie between its turn and the one before. All windows share
    one shuffle by conversation and spill to disk.
    """
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    dealt = plain.withColumn("digest", F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256)).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.left("role", F.lit(1))
    pair = F.concat(F.lag(initial).over(order), initial)
    before = F.lag("turn").over(order)
    numbered = dealt.select(
        "conv_id", F.row_number().over(order).alias("n"), "turn", "role", "text", "digest", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        F.greatest(F.coalesce(F.try_subtract(F.col("turn"), before) - 1, F.lit(0)), F.lit(0)).cast("long").alias("skipped"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("n")) > 1
    said = F.rtrim("text", F.lit(SPACES))
    fault = F.when(said == "", "blank").when(seen, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    return materialize(numbered.withColumn("fault", fault).drop("digest"), "marked-turns")


_EDITS = "conv_id long, n long, edits string"


def plan(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, n, edits of marked turns: the coded edits up to and with turn n; one more row has what follows the last turn."""
    token = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col("n").cast("long").alias("n"), F.left("role", F.lit(1)).alias("i"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("go"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"))
    ordered = token.repartition("conv_id").sortWithinPartitions("conv_id", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, chart = arrow_schema(_EDITS), Chart()
        rows = ((c, (i, go, cut)) for b in batches for c, i, go, cut in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True))
        for conv, tokens in _grouped(rows):
            _, pieces = cheapest(tokens, chart)
            at, held = 0, ""
            out: dict[str, list] = {"conv_id": [], "n": [], "edits": []}
            for piece in pieces:
                for code in piece:
                    held += code
                    if code not in "Ii":
                        at += 1
                        out["conv_id"].append(conv), out["n"].append(at), out["edits"].append(held)
                        held = ""
                if len(out["n"]) >= FOLD_TURNS:
                    yield record_batch(out, schema)
                    out = {"conv_id": [], "n": [], "edits": []}
            if held:
                out["conv_id"].append(conv), out["n"].append(at + 1), out["edits"].append(held)
            yield record_batch(out, schema)

    return ordered.mapInArrow(run, _EDITS)


def _grouped(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(key, its values, one by one) of rows sorted by key."""
    rows = iter(rows)
    following = next(rows, None)
    while following is not None:
        key = following[0]

        def values(first: tuple) -> Iterator:
            nonlocal following
            following = first
            while following is not None and following[0] == key:
                yield following[1]
                following = next(rows, None)

        yield key, values(following)


REPAIRED = "conv_id long, edit string, role string, text string, cost long"


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, edit, role, text, cost of marked turns: every edit, deleted turns among them, in order.

    The rows of a conversation stand one after another in one partition. edit is K, R, D or
    I; what isn't D is the repaired conversation. A conversation without an id is one of its
    own. A very long conversation streams through one task in order: memory is bounded, its
    time is not spread.
    """
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("n").cast("long").alias("n"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), "role", "text", (F.col("fault") == "truncated").alias("cut"))
    edits = plan(turns).select("conv_id", "n", F.lit(0).alias("kind"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("cut"))
    ordered = said.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", "n", "kind").select("conv_id", "edits", "role", "text", "cut")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(REPAIRED)
        pending = ""
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}

            def put(conv: int | None, code: str, role: str, text: str, cut: bool) -> None:
                edit = code.upper()
                for name, value in zip(out, (conv, edit, ROLE_OF.get(code, role), text, COSTS[edit] + TRUNCATED * (cut and edit in "KR")), strict=True):  # noqa: B023
                    out[name].append(value)  # noqa: B023

            for conv, edits, role, text, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edits is None:
                    put(conv, pending, role, text, bool(cut))
                    continue
                last = edits[-1] if edits[-1] not in "Ii" else ""
                for code in edits[: len(edits) - len(last)]:
                    put(conv, code, "", "", False)
                pending = last
            yield record_batch(out, schema)

    return ordered.mapInArrow(run, REPAIRED)


DIGESTS = "conv_id long, cost long, audit string, repaired_sha256 string"


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, cost, audit, repaired_sha256 of repair()'s rows: the edits' initials and the digest of the repaired `role:text` lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(DIGESTS)
        rows = ((r[0], r[1:]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: dict[str, list] = {f.name: [] for f in schema}
        for conv, edits in _grouped(rows):
            digest, cost, audit, between = hashlib.sha256(), 0, [], b""
            for edit, role, text, more in edits:
                audit.append(edit)
                cost += more
                if edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            for name, value in zip(out, (conv, cost, "".join(audit), digest.hexdigest()), strict=True):
                out[name].append(value)
            if len(out["cost"]) >= 5_000:
                yield record_batch(out, schema)
                out = {f.name: [] for f in schema}
        yield record_batch(out, schema)

    return repaired.mapInArrow(run, DIGESTS)


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for every conv_id of conversations: gaps, blank, duplicate, truncated, illegal of turns, and the cost, audit and digest of their repair.

    A conversation without turns has zeros, an empty audit and the empty text's digest. No
    rows give no rows; extra columns are not read.
    """
    rows = marked(turns)
    zero = F.lit(0).cast("long")
    counts = {"gaps": F.try_sum("skipped")} | {k: F.count_if(F.col("fault") == k) for k in ("blank", "duplicate", "truncated")} | {"illegal": F.count_if("illegal")}
    counted = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(*[v.cast("long").alias(k) for k, v in counts.items()])
    done = digests(repair(rows))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = every.unionByName(counted, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
    empty = F.lit(hashlib.sha256().hexdigest())
    found = parts.groupBy("conv_id").agg(*[F.coalesce(F.max(k), zero).alias(k) for k in [*counts, "cost"]], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))
    return found
