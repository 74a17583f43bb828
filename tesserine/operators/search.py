"""Search across domains: index or scan, filters, caps for each file, context lines, merge."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import index_tokens, pattern, words
from tesserine.operators import postings as idx
from tesserine.operators.ranking import first_n

#: Columns of a domain's lines: file, line_no, line and, where known, date, role, speaker.
BASE = ["file", "line_no", "line"]


@dataclass(frozen=True)
class Lines:
    """A domain's lines, and how those of a few files are read alone: of(files) reads no other file's text."""

    all: DataFrame
    of: Callable[[list[str]], DataFrame]


#: Shown hits whose files are named to the reader; more of them are joined with all lines.
NAMED_FILES = 1_000


def in_dates(df: DataFrame, date_from: str | None, date_to: str | None) -> DataFrame:
    """Rows within the dates, both ends included; a row without a date passes."""
    d = F.col("date")
    keep = F.lit(True)
    if date_from:
        keep = keep & (d >= F.lit(date_from))
    if date_to:
        keep = keep & (d <= F.lit(date_to))
    return df.where(d.isNull() | (d == "?") | keep)


def scan(lines: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Lines that match a pattern or hold a literal."""
    return lines.where(F.col("line").rlike(pattern(query, regex, case_sensitive)))


def by_words(lines: DataFrame, query: str, any_word: bool = True) -> DataFrame:
    """Lines that hold the query's words, from their own tokens."""
    tokens = index_tokens(query)
    if not tokens:
        return lines.limit(0)
    wanted = F.array(*[F.lit(t) for t in tokens])
    held = F.array_intersect(words(F.col("line")), wanted)
    return lines.where(F.size(held) >= (1 if any_word else len(tokens)))


def by_index(lines: DataFrame, postings: DataFrame, query: str, any_word: bool = True) -> DataFrame:
    """Lines that the index finds; lines carry file_idx and entry_idx."""
    hits = idx.search(postings, index_tokens(query), "or" if any_word else "and")
    return lines.join(hits, ["file_idx", "entry_idx"], "left_semi")


def with_role(df: DataFrame, role: str | None) -> DataFrame:
    """Lines of a role; a line without one is the user's."""
    return df if role is None else df.where(F.lower(F.coalesce("role", F.lit("user"))) == role.lower())


def with_speaker(df: DataFrame, speaker: str | None, exact: bool = False) -> DataFrame:
    if speaker is None:
        return df
    name = F.lower("speaker")
    return df.where(name == speaker.lower() if exact else F.contains(name, F.lit(speaker.lower())))


def with_context(hits: DataFrame, lines: DataFrame, k: int = 2) -> DataFrame:
    """before and after: up to k lines around each hit.

    Each hit asks for its neighbours by line number, so only those lines are joined and
    no file is ordered as a whole.
    """
    asked = hits.select("file", "line_no", F.explode(F.sequence(F.col("line_no") - k, F.col("line_no") + k)).alias("near")).where("near != line_no")
    beside = lines.select("file", F.col("line_no").alias("near"), F.col("line").alias("text"))
    found = asked.join(beside, ["file", "near"]).groupBy("file", "line_no").agg(F.sort_array(F.collect_list(F.struct("near", "text"))).alias("around"))
    joined = hits.join(found, ["file", "line_no"], "left")
    around = F.coalesce("around", F.array().cast("array<struct<near:int,text:string>>"))
    return joined.withColumn("before", F.transform(F.filter(around, lambda x: x["near"] < F.col("line_no")), lambda x: x["text"])).withColumn("after", F.transform(F.filter(around, lambda x: x["near"] > F.col("line_no")), lambda x: x["text"])).drop("around")


def newest_first(df: DataFrame, limit: int) -> DataFrame:
    """By date downwards, unknown dates first, then by line; ties by file."""
    return df.orderBy(F.coalesce("date", F.lit("?")).desc(), "line_no", "domain", "file").limit(limit)


_SHOWN = pa.schema([("domain", pa.string()), ("file", pa.string()), ("date", pa.string()), ("line_no", pa.int32())])


def shown(top: DataFrame | list[tuple], lines: Lines | DataFrame, k: int) -> DataFrame:
    """top (domain, file, date, line_no) with their line and up to k lines before and after.

    Of a list, only the files named in it are read, each once, and the lines wanted go to
    them; a table meets all lines.
    """
    everything = lines.all if isinstance(lines, Lines) else lines
    few = isinstance(top, list)
    if few:
        files = sorted({r[1] for r in top})
        text = lines.of(files) if isinstance(lines, Lines) else everything.where(F.col("file").isin(files))
        top = everything.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(_SHOWN.names, r, strict=True)) for r in top], _SHOWN))
    else:
        text = everything.join(top.select("file").distinct(), "file", "left_semi")
    said = text.select("file", F.col("line_no").cast("int").alias("near"), F.col("line").alias("text"))
    if not k:
        none = F.array().cast("array<string>")
        met = said.join(F.broadcast(top) if few else top, (said["file"] == top["file"]) & (F.col("near") == F.col("line_no")))
        return met.select("domain", top["file"], "date", "line_no", F.col("text").alias("line"), none.alias("before"), none.alias("after"))
    asked = top.select("domain", "file", "date", "line_no", F.explode(F.sequence(F.col("line_no") - k, F.col("line_no") + k)).alias("near"))
    met = said.join(F.broadcast(asked) if few else asked, ["file", "near"])
    hit = F.col("near") == F.col("line_no")
    beside = F.sort_array(F.collect_list(F.when(~hit, F.struct("near", "text"))))
    found = met.groupBy("domain", "file", "date", "line_no").agg(F.max(F.when(hit, F.col("text"))).alias("line"), F.count_if(hit).alias("own"), beside.alias("around")).where("own > 0")
    before = F.transform(F.filter("around", lambda x: x["near"] < F.col("line_no")), lambda x: x["text"])
    after = F.transform(F.filter("around", lambda x: x["near"] > F.col("line_no")), lambda x: x["text"])
    return found.select("domain", "file", "date", "line_no", "line", before.alias("before"), after.alias("after"))


def search(
    domains: dict[str, DataFrame | Lines], query: str, domain: str = "all", max_results: int = 20, date_from: str | None = None, date_to: str | None = None, regex: bool = False, context_lines: int = 2, case_sensitive: bool = False,
    max_matches_per_file: int = 5, role: str | None = None, speaker: str | None = None, any_word: bool = True, indexes: dict[str, idx.PostingsIndex] | None = None, by_word: bool = False,
) -> DataFrame:
    """Matches of a query over domains' lines: domain, file, date, line_no, line, before, after.

    Where a domain has an index, words are looked up in it, and only the files of what is
    shown are read. Without one, and for patterns and cased queries, lines are scanned for
    the query as it stands, whatever its case; by_word looks for its words there too.
    """
    if not query.strip():
        raise ValueError("empty query")
    if domain != "all" and domain not in domains:
        raise ValueError(f"unknown domain {domain!r}")
    chosen = domains if domain == "all" else {domain: domains[domain]}
    every = {name: d.all if isinstance(d, Lines) else d for name, d in chosen.items()}
    for name, value in (("role", role), ("speaker", speaker)):
        if value is not None and not any(name in d.columns for d in every.values()):
            raise ValueError(f"no searched domain has {name}")
    tops, parts = {}, []
    for name, lines in every.items():
        full = lines if "date" in lines.columns else lines.withColumn("date", F.lit("?"))
        by_line = ("role" in full.columns and role is not None) or ("speaker" in full.columns and speaker is not None)
        if indexes and name in indexes and not (regex or case_sensitive or by_line):
            # entries of a file have the order of its lines, and dates are the file's, so the cap comes first
            hits = indexes[name].search(index_tokens(query), "or" if any_word else "and", max_matches_per_file)
            hits = indexes[name].with_lines(in_dates(hits if "date" in hits.columns else hits.withColumn("date", F.lit("?")), date_from, date_to))
        else:
            hits = by_words(full, query, any_word) if by_word and not (regex or case_sensitive) else scan(full, query, regex, case_sensitive)
            hits = in_dates(hits, date_from, date_to)
            if "role" in full.columns:
                hits = with_role(hits, role)
            if "speaker" in full.columns:
                hits = with_speaker(hits, speaker)
            hits = first_n(hits, ["file"], ["line_no"], max_matches_per_file)
            if not context_lines:
                # the scan has the lines already
                none = F.array().cast("array<string>")
                parts.append(newest_first(hits.withColumn("domain", F.lit(name)), max_results).select("domain", "file", "date", F.col("line_no").cast("int").alias("line_no"), "line", none.alias("before"), none.alias("after")))
                continue
        tops[name] = newest_first(hits.withColumn("domain", F.lit(name)), max_results).select("domain", "file", "date", F.col("line_no").cast("int").alias("line_no"))
    if tops and max_results <= NAMED_FILES:
        # where the hits of all domains are, in one job; then only their lines are read
        rows = [tuple(r) for r in newest_first(functools.reduce(DataFrame.unionByName, tops.values()), max_results).collect()]
        parts += [shown(own, chosen[name], context_lines) for name in tops if (own := [r for r in rows if r[0] == name]) or not parts]
    else:
        parts += [shown(top, chosen[name], context_lines) for name, top in tops.items()]
    return newest_first(functools.reduce(DataFrame.unionByName, parts), max_results)


#: Lines of a bin of the join by ranges of lines.
BIN = 64


def turn_of_line(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """The transcript turn that holds each hit's line, by its line range line_start to line_end.

    Hits (file, line_no) and turns meet in one ordered pass over each file: a turn is put
    in the place of its first line, the last turn before a hit is carried along, and it holds
    the hit if it ends no earlier. Turns of a file don't overlap. The pass is made within
    ranges of lines, so that a long file is many tasks; a turn that reaches into further
    ranges is put at the first line of each of them. A hit gives one row or none.
    """
    shared = [c for c in hits.columns if c in turns.columns and c not in ("file", "line_no")]
    if shared:
        raise ValueError(f"hits and turns both have {shared}")
    width = BIN * 1_024
    turn = F.struct(*[F.col(c) for c in turns.columns])
    bins = F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.greatest("line_end", "line_start") / width))).alias("bin")
    placed = turns.select("file", bins, turn.alias("turn")).select("file", "bin", F.greatest(F.col("turn.line_start").cast("long"), F.col("bin") * width).alias("at"), F.lit(0).alias("kind"), "turn", F.lit(None).cast(hits.schema.simpleString()).alias("hit"))
    asked = hits.select("file", F.floor(F.col("line_no") / width).alias("bin"), F.col("line_no").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(turns.schema.simpleString()).alias("turn"), F.struct(*[F.col(c) for c in hits.columns]).alias("hit"))
    order = Window.partitionBy("file", "bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.unionByName(asked).withColumn("turn", F.last("turn", ignorenulls=True).over(order))
    found = carried.where((F.col("kind") == 1) & (F.col("turn.line_end") >= F.col("at")))
    return found.select("file", *[F.col(f"hit.{c}") for c in hits.columns if c != "file"], *[F.col(f"turn.{c}") for c in turns.columns if c != "file"])


def list_domain(lines: DataFrame, limit: int = 50, turns: DataFrame | None = None) -> DataFrame:
    """Files of a domain with their counts, newest first; with turns(file, speaker) also how many they have and who takes part."""
    named = lines if "date" in lines.columns else lines.withColumn("date", F.lit("?"))
    listed = named.groupBy("file").agg(F.max("date").alias("date"), F.count("*").alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_entries"))
    if turns is not None:
        who = turns.groupBy("file", "speaker").agg(F.count("*").alias("n")).groupBy("file").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("speaker")).alias("participants"))
        listed = listed.join(who, "file", "left").withColumn("n_turns", F.coalesce("n_turns", F.lit(0)))
    return listed.orderBy(F.coalesce("date", F.lit("?")).desc(), "file").limit(limit)


def current_turn(messages: DataFrame) -> DataFrame:
    """Messages after the last one of the user, in each conversation."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return messages.withColumn("last_user", last).where(F.col("turn") > F.coalesce("last_user", F.lit(-1)))
