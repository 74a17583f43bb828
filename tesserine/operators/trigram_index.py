"""Trigram postings: names like a name, and lines that may match a pattern, found without reading the others."""

from __future__ import annotations

import math
import re
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import pattern, trigram_similarity, trigrams
from tesserine.operators.search import Lines
from tesserine.plans.snapshot import SnapshotStore

#: Files named to the reader of single files; more candidates than that are joined with all lines.
NAMED_FILES = 10_000


def grams_of(text: str) -> set[str]:
    """The trigrams of a lower-cased text."""
    low = text.lower()
    return {low[k : k + 3] for k in range(len(low) - 2)}


# --- names


def name_postings(names: DataFrame, name_col: str = "name") -> DataFrame:
    """gram, name, n: each distinct trigram of each name, lower-cased, and how many the name has. A name under three characters stands under the gram ''."""
    held = names.select(F.col(name_col).alias("name")).where("name is not null").distinct().withColumn("g", trigrams(F.lower("name")))
    return held.select("name", F.size("g").alias("n"), F.explode(F.when(F.size("g") > 0, F.col("g")).otherwise(F.array(F.lit("")))).alias("gram")).select("gram", "name", "n")


def similar_names(postings: DataFrame, query: str, threshold: float = 0.3) -> DataFrame:
    """name, similarity of the names that are like the query by trigrams, at or above the threshold.

    Two sets with a Jaccard similarity of t or more share t / (1 + t) of their sizes'
    sum, and neither is larger than the other by more than a factor of 1 / t. So only postings
    of the query's own trigrams are read, names of other lengths go at once, and of the rest
    only those that share enough are compared in full. Names and queries under three
    characters are like what contains them, which no trigram shows: they are compared directly.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    wanted = sorted(grams_of(query))
    similarity = trigram_similarity(F.col("name"), F.lit(query))
    if len(query) < 3:
        return postings.select("name").distinct().withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    size = len(wanted)
    fit = postings.where(F.col("gram").isin(wanted) & F.col("n").between(math.ceil(threshold * size - 1e-9), math.floor(size / threshold + 1e-9)))
    enough = F.ceil(F.lit(threshold / (1 + threshold)) * (F.first("n") + size) - 1e-9)
    alike = fit.groupBy("name").agg(F.count("*").alias("shared"), enough.alias("enough")).where("shared >= enough").select("name")
    short = postings.where("gram = ''").select("name")
    return alike.unionByName(short).withColumn("similarity", similarity).where(F.col("similarity") >= threshold)


# --- patterns


def required_grams(query: str, regex: bool = True) -> set[str]:
    """Trigrams that stand in every text that matches, lower-cased; none if nothing is certain.

    Of a pattern, runs of literal characters that every match holds are taken: those outside
    of alternatives, optional parts and look-arounds. Characters that have other forms in
    another case than their lower one, such as the long s, end a run.
    """
    if not regex:
        return set().union(*(grams_of(run) for run in _plain_runs(query)))
    if "\\0" in query:  # octal numbers, which Java and Python read differently
        return set()
    try:
        parsed = rp.parse(query)
    except (re.error, OverflowError, RecursionError):  # a pattern that only Java knows
        return set()
    runs: list[str] = []

    def walk(items, run: list[str]) -> list[str]:
        """Appends finished runs; the run that is still open is returned."""
        for op, arg in items:
            if op is rc.LITERAL:
                run.append(chr(arg))
            elif op is rc.SUBPATTERN and not arg[1] and not arg[2]:
                run = walk(arg[3], run)
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and arg[0] >= 1:
                low, high, inner = arg
                run = walk(inner, run)
                if (low, high) != (1, 1):
                    # more may follow, so what comes next isn't next to what came first
                    runs.append("".join(run))
                    run = []
            elif op is rc.AT:
                continue
            else:
                runs.append("".join(run))
                run = []
        return run

    runs.append("".join(walk(parsed, [])))
    return set().union(*(grams_of(piece) for run in runs for piece in _plain_runs(run)))


def _plain_runs(text: str) -> list[str]:
    """The parts of a text whose characters have one lower and one upper form of one character."""
    out, run = [], []
    for c in text:
        if c.isascii() and c not in "kKsSiI" or not c.isascii() and c == c.lower() == c.upper():
            run.append(c)
        else:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)]


class TrigramIndex:
    """Which trigrams stand in which files, in a folder: postings (gram, file) in the order of grams."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = SnapshotStore(spark, root)

    def create(self, lines: DataFrame) -> int:
        """Indexes lines(file, line)."""
        # a look-ahead at every place: one pass over a line, however long it is
        every = F.regexp_extract_all(F.lower("line"), F.lit("(?s)(?=(.{3}))"), F.lit(1))
        grams = lines.select("file", F.explode(F.array_distinct(every)).alias("gram")).distinct()
        files = lines.select("file").distinct()
        return self.store.commit({"grams": grams.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file"), "files": files})

    def candidates(self, query: str, regex: bool = True) -> DataFrame | None:
        """The files that hold every trigram that a match must have; None if a match may stand anywhere."""
        wanted = sorted(required_grams(query, regex))
        if not wanted:
            return None
        held = self.store.read("grams").where(F.col("gram").isin(wanted))
        return held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file")

    def scan(self, lines: Lines, query: str, regex: bool = True, case_sensitive: bool = False) -> DataFrame:
        """The lines that match, as a scan of all lines gives them; only candidate files are read."""
        hit = F.col("line").rlike(pattern(query, regex, case_sensitive))
        found = self.candidates(query, regex)
        if found is None:
            return lines.all.where(hit)
        first = [r["file"] for r in found.limit(NAMED_FILES + 1).collect()]
        if len(first) > NAMED_FILES:
            return lines.all.join(found, "file", "left_semi").where(hit)
        return lines.of(first).where(hit)
