"""Keyed state over streams: each session's current turn and its gates, each hook's throttle and growth."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATES = "conv_id long, last_user long, denied boolean, closed boolean"
_SESSION = "last_user long, heavy array<long>, searched array<long>, earlier boolean"


class Turns:
    """What a session's state keeps: the user's last turn, the uses after it, and whether there were any before.

    Messages may come in any order and more than once; the state is that of all seen so
    far. Only uses after the user's last turn are kept, so it grows with the current turn.
    """

    def __init__(self, last_user: int | None = None, heavy: Iterable[int] = (), searched: Iterable[int] = (), earlier: bool = False):
        self.last_user, self.heavy, self.searched, self.earlier = last_user, set(heavy), set(searched), earlier

    def take(self, turn: int, by_user: bool, heavy: bool, searched: bool) -> None:
        if by_user:
            if self.last_user is None or turn > self.last_user:
                self.last_user = turn
                self.earlier = self.earlier or any(t < turn for t in self.heavy | self.searched)
                self.heavy, self.searched = ({t for t in s if t > turn} for s in (self.heavy, self.searched))
        elif heavy or searched:
            if self.last_user is not None and turn < self.last_user:
                self.earlier = True
            else:
                self.heavy |= {turn} if heavy else set()
                self.searched |= {turn} if searched else set()

    def denied(self) -> bool:
        """Whether the current turn uses something heavy before any search, with nothing used in earlier turns."""
        if self.last_user is None or self.earlier or not self.heavy:
            return False
        return not self.searched or min(self.searched) > min(self.heavy)

    def row(self) -> tuple:
        return self.last_user, sorted(self.heavy), sorted(self.searched), self.earlier


def session_gates(messages: DataFrame, heavy: Column, searched: Column, idle: str | None = None, ts: str = "ts") -> DataFrame:
    """conv_id, last_user, denied, closed of a stream of messages (conv_id, turn, role): a row for each session that a batch touches.

    The last row of a session says the same as predicates.first_turn_gate of all its
    messages. With idle, a duration such as `2 hours`, sessions that have been without
    messages for so long by the stream's watermark on ts are closed by a timer: one more row
    with closed, and their state goes. Use it where a session isn't taken up again.
    """
    used = F.col("role") == "assistant"
    at = (F.unix_micros(ts) / 1000).cast("long") if idle else F.lit(0).cast("long")
    marked = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role") == "user", F.lit(False)).alias("by_user"), F.coalesce(heavy & used, F.lit(False)).alias("heavy"),
        F.coalesce(searched & used, F.lit(False)).alias("searched"), at.alias("at"), *([F.col(ts)] if idle else []),
    ).where("turn is not null and conv_id is not null")
    pause = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns = Turns(*state.get) if state.exists else Turns()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"conv_id": [key[0]], "last_user": pd.array([turns.last_user], dtype="Int64"), "denied": [turns.denied()], "closed": [True]})
            return
        latest = 0
        for batch in batches:
            for turn, by_user, was_heavy, was_search, seen in zip(*(batch[c].tolist() for c in ("turn", "by_user", "heavy", "searched", "at")), strict=True):
                turns.take(turn, by_user, was_heavy, was_search)
                latest = max(latest, seen)
        state.update(turns.row())
        if pause:
            state.setTimeoutTimestamp(max(latest + pause, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"conv_id": [key[0]], "last_user": pd.array([turns.last_user], dtype="Int64"), "denied": [turns.denied()], "closed": [False]})

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return marked.groupBy("conv_id").applyInPandasWithState(run, GATES, _SESSION, "update", timeout)


HOOKS = "hook string, ts timestamp, growth long, decision string"
_HOOK = "last timestamp, n_entities long, n_observations long"


def hook_gates(calls: DataFrame, pause_seconds: float, least: int) -> DataFrame:
    """hook, ts, growth, decision of a stream of calls (hook, ts, n_entities, n_observations): a row a call.

    A call less than the pause after the last look is `throttled` and changes nothing. Any
    other is a look: the counts are kept, and it is `run` if both have grown by so much
    together since the look before, else `idle`. Counts that fall count as no growth. Within
    a batch calls go by time; batches must come in the order of time.
    """
    plain = calls.select("hook", "ts", F.col("n_entities").cast("long").alias("n_entities"), F.col("n_observations").cast("long").alias("n_observations")).where("hook is not null and ts is not null")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, entities, observations = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "n_entities", "n_observations"], kind="stable")
        out: dict[str, list] = {"hook": [], "ts": [], "growth": [], "decision": []}
        for ts, e, o in zip(rows["ts"], rows["n_entities"].tolist(), rows["n_observations"].tolist(), strict=True):
            growth, decision = 0, "throttled"
            if last is None or (ts - pd.Timestamp(last)).total_seconds() >= pause_seconds:
                growth = max(e - entities, 0) + max(o - observations, 0)
                decision = "run" if growth >= least else "idle"
                last, entities, observations = ts.to_pydatetime(), e, o
            for name, value in zip(out, (key[0], ts, growth, decision), strict=True):
                out[name].append(value)
        state.update((last, entities, observations))
        yield pd.DataFrame(out)

    return plain.groupBy("hook").applyInPandasWithState(run, HOOKS, _HOOK, "append", GroupStateTimeout.NoTimeout)
