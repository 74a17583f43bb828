"""Predicates over session logs, a row a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _since_user(messages: DataFrame) -> DataFrame:
    whole = Window.partitionBy("conv_id")
    return messages.withColumn("last_user", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(whole))


def first_turn_gate(messages: DataFrame, heavy: Column, searched: Column) -> DataFrame:
    """Conversations whose current turn uses something heavy before any search, with nothing used in earlier turns."""
    marked = _since_user(messages).withColumn("heavy", heavy & (F.col("role") == "assistant")).withColumn("searched", searched & (F.col("role") == "assistant"))
    now = F.col("turn") > F.col("last_user")
    first_heavy, first_search = F.min(F.when(now & F.col("heavy"), F.col("turn"))), F.min(F.when(now & F.col("searched"), F.col("turn")))
    earlier = F.coalesce(F.bool_or((F.col("turn") < F.col("last_user")) & (F.col("heavy") | F.col("searched"))), F.lit(False))
    out = marked.groupBy("conv_id").agg(first_heavy.alias("first_heavy"), first_search.alias("first_search"), earlier.alias("earlier"))
    denied = F.col("first_heavy").isNotNull() & ~F.col("earlier") & (F.col("first_search").isNull() | (F.col("first_search") > F.col("first_heavy")))
    return out.select("conv_id", denied.alias("denied"))


def turn_lacks(messages: DataFrame, work: Column, record: Column) -> DataFrame:
    """Conversations whose current turn does work but keeps no record of it."""
    now = _since_user(messages).where(F.col("turn") > F.coalesce("last_user", F.lit(-1)))
    return now.groupBy("conv_id").agg(F.bool_or(work).alias("worked"), F.bool_or(record).alias("recorded")).select("conv_id", (F.col("worked") & ~F.col("recorded")).alias("lacking"))


def top_level(path: Column) -> Column:
    """Whether a session's path has no part named agents."""
    return ~F.array_contains(F.split(path, "/"), "agents")


def tool_marker(arguments: Column, marker: str) -> Column:
    """Whether a tool call's arguments hold a marker in a string, also in JSON that stands in strings of JSON.

    Each level of nesting doubles the escapes before a quote, so texts are unescaped level by
    level, three deep, and looked at on each.
    """
    held, text = F.contains(arguments, F.lit(marker)), arguments
    for _ in range(3):
        text = F.regexp_replace(F.regexp_replace(text, r'\\(["/])', "$1"), r"\\\\", r"\\")
        held = held | F.contains(text, F.lit(marker))
    return held


def planner_gate(messages: DataFrame, plans: Column, searched: Column, path_col: str = "path") -> DataFrame:
    """conv_id, denied: top-level sessions that call a planner in their current turn without a search before it in that turn."""
    now = _since_user(messages).where(F.col("turn") > F.coalesce("last_user", F.lit(-1)))
    said = F.col("role") == "assistant"
    first_plan, first_search = F.min(F.when(said & plans, F.col("turn"))), F.min(F.when(said & searched, F.col("turn")))
    out = now.groupBy("conv_id").agg(first_plan.alias("p"), first_search.alias("s"), F.max(path_col).alias("path"))
    return out.select("conv_id", (top_level(F.col("path")) & F.col("p").isNotNull() & (F.col("s").isNull() | (F.col("s") >= F.col("p")))).alias("denied"))


def report_missing(messages: DataFrame, delegated: Column, reported: Column, path_col: str = "path") -> DataFrame:
    """conv_id, denied: top-level sessions whose current turn hands work on but writes no report of it."""
    now = _since_user(messages).where(F.col("turn") > F.coalesce("last_user", F.lit(-1)))
    out = now.groupBy("conv_id").agg(F.coalesce(F.bool_or(delegated), F.lit(False)).alias("d"), F.coalesce(F.bool_or(reported), F.lit(False)).alias("r"), F.max(path_col).alias("path"))
    return out.select("conv_id", (top_level(F.col("path")) & F.col("d") & ~F.col("r")).alias("denied"))
