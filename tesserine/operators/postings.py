"""The full-text index: postings (token, file_idx, entry_idx) as a table.

Base and delta make up the index: a delta row adds or deletes a posting, and the last
operation on a posting holds. Compaction folds the delta into a new base. Beside them lies
a directory of lines, which says on which line of its file an entry stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserine.functions.text import words
from tesserine.plans.snapshot import Append, Buckets, Empty, SnapshotStore

KEY = ["token", "file_idx", "entry_idx"]
COMPACT_SHARE = 0.25

#: Entries of a row of the directory of lines.
CHUNK = 4_096

#: What an index's tables look like; stored ones of another layout aren't opened again.
LAYOUT = 3


def build(entries: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct postings of (file_idx, entry_idx, text) entries.

    A token repeats within its entry only, so repeats go before the shuffle-free explode.
    """
    tokens = F.array_distinct(words(F.col(text_col)))
    return entries.select(F.explode(tokens).alias("token"), "file_idx", "entry_idx").select(*KEY)


def search(postings: DataFrame, tokens: list[str], mode: str = "and", per_file: int | None = None) -> DataFrame:
    """(file_idx, entry_idx) that hold all tokens, or any. No tokens find nothing; no limit is applied but, where asked for, the first so many of each file."""
    distinct = sorted(set(tokens))
    if mode not in ("and", "or"):
        raise ValueError("mode is and, or")
    found = postings.where(F.col("token").isin(distinct) if distinct else F.lit(False))
    first = Window.partitionBy("file_idx").orderBy("entry_idx")
    if mode == "or" or len(distinct) < 2:
        held = found.select("file_idx", "entry_idx")
        # ranks of equal entries are equal, so each task cuts its postings before the one shuffle
        held = held if per_file is None else held.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= per_file).drop("r")
        return held.distinct()
    both = found.groupBy("file_idx", "entry_idx").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(distinct)).select("file_idx", "entry_idx")
    return both if per_file is None else both.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_file).drop("r")


def index_stats(postings: DataFrame) -> DataFrame:
    """Distinct tokens, postings and the largest document frequency."""
    by_token = postings.groupBy("token").agg(F.count("*").alias("df"))
    return by_token.agg(F.count("*").alias("n_tokens"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df"))


def diff_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Each file's status against the manifest: unchanged, changed, new or removed."""
    now = listed.select("file", F.col("modified").alias("now_modified"), F.col("size").alias("now_size"))
    live = files.where(~F.col("tombstoned")).select("file", "file_idx", "modified", "size")
    status = (
        F.when(F.col("now_size").isNull(), "removed")
        .when(F.col("file_idx").isNull(), "new")
        .when((F.col("now_modified") != F.col("modified")) | (F.col("now_size") != F.col("size")), "changed")
        .otherwise("unchanged")
    )
    return now.join(live, "file", "full_outer").withColumn("status", status)


def diff_postings(old: DataFrame, new: DataFrame, seq: int) -> DataFrame:
    """Delta rows that lead from old postings to new ones: DEL for what went, ADD for what came.

    Both go through one aggregation, which needs no shuffle where both lie dealt out by file.
    """
    both = old.select(*KEY, F.lit(0).alias("side")).unionByName(new.select(*KEY, F.lit(1).alias("side")))
    one = both.groupBy(*KEY).agg(F.min("side").alias("first"), F.max("side").alias("last")).where("first = last")
    return one.select(*KEY, F.when(F.col("last") == 1, "ADD").otherwise("DEL").alias("op"), F.lit(seq).cast("long").alias("seq"))


#: What a posting of the base counts as beside the operations on it, 2 * seq and 1 for ADD: an ADD before all others.
_HELD = 1 - (1 << 62)


def _operations(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of KEY with `at`, an odd number for ADD: the largest of a posting is the last operation on it."""
    made = delta.select(*KEY, (F.col("seq") * 2 + (F.col("op") == "ADD").cast("long")).alias("at"))
    return base.select(*KEY, F.lit(_HELD).alias("at")).unionByName(made)


def _last_holds(operations: DataFrame) -> DataFrame:
    return operations.groupBy(*KEY).agg(F.max("at").alias("at")).where(F.col("at").bitwiseAND(1) == 1).select(*KEY)


def layered(base: DataFrame, delta: DataFrame) -> DataFrame:
    """What base and delta say together; of several operations on a posting the last one holds."""
    return _last_holds(_operations(base, delta))


def counts_by_file(postings: DataFrame) -> DataFrame:
    """file_idx, n, n_tokens: postings and distinct tokens of each file; no shuffle where postings lie dealt out by file."""
    return postings.groupBy("file_idx").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_tokens"))


def directory(entries: DataFrame, seq: int) -> DataFrame:
    """file_idx, chunk, entries, lines, seq: where the entries stand, CHUNK of them to a row at most.

    entries has file_idx, entry_idx and, where lines without an entry lie between them,
    line_no; else an entry's line is the one after its number.
    """
    line = F.col("line_no") if "line_no" in entries.columns else F.col("entry_idx") + 1
    placed = entries.select("file_idx", F.floor(F.col("entry_idx") / CHUNK).cast("int").alias("chunk"), F.struct(F.col("entry_idx").cast("int").alias("entry_idx"), line.cast("int").alias("line_no")).alias("e"))
    rows = placed.groupBy("file_idx", "chunk").agg(F.sort_array(F.collect_set("e")).alias("e"))
    return rows.select("file_idx", "chunk", F.col("e.entry_idx").alias("entries"), F.col("e.line_no").alias("lines"), F.lit(seq).cast("long").alias("seq"))


def in_order(postings: DataFrame) -> DataFrame:
    """Postings as they are stored: ranges of the whole key, so that files hold few tokens each and a frequent token lies in many."""
    return postings.repartitionByRange(*KEY).sortWithinPartitions(*KEY)


#: What the manifest is kept in buckets by, and how many.
FILES, FILE_BUCKETS = ("file",), 16


class PostingsIndex:
    """An index in a folder: base, delta, lines and manifest as snapshots behind one pointer file.

    The manifest names for each file the version that its lines were last written at, so
    older rows of the directory need no deleting. An update adds its rows to delta and
    lines and rewrites the manifest's buckets of files that changed.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark = spark
        self.store = SnapshotStore(spark, root, version)

    def create(self, entries: DataFrame, files: DataFrame) -> int:
        seq = self.store.version() + 1
        base = in_order(build(entries))
        known = files.withColumn("lines_seq", F.lit(seq).cast("long"))
        buckets = Buckets(known, FILES, tuple(range(FILE_BUCKETS)), FILE_BUCKETS)
        return self.store.commit({"base": base, "files": buckets, "lines": directory(entries, seq), "delta": Empty(self._delta_schema(base))})

    @staticmethod
    def _delta_schema(base: DataFrame) -> StructType:
        return base.selectExpr(*KEY, "cast(null as string) op", "cast(null as bigint) seq").schema

    def postings(self, by_file: bool = False) -> DataFrame:
        """All postings. With by_file they lie dealt out by file_idx, so that joins and groups by file, its tokens or entries shuffle no more."""
        base = self.store.read("base")
        if self.store.is_empty("delta"):
            return base.repartition("file_idx") if by_file else base
        # one shuffle for both, by the file: a filter on tokens still reaches the scans
        return _last_holds(_operations(base, self.store.read("delta")).repartition("file_idx"))

    def live_files(self) -> DataFrame:
        return self.store.read("files").where(~F.col("tombstoned"))

    def search(self, tokens: list[str], mode: str = "and", per_file: int | None = None) -> DataFrame:
        """Hits, of each file the first so many where asked for, with their file's name and date; tombstoned files are left out."""
        live = self.live_files()
        return search(self.postings(), tokens, mode, per_file).join(live, "file_idx")

    def with_lines(self, hits: DataFrame) -> DataFrame:
        """Hits of search() with line_no, the line of its file that each entry stands on."""
        lines = self.store.read("lines").select("file_idx", F.col("seq").alias("lines_seq"), "chunk", "entries", "lines")
        placed = hits.withColumn("chunk", F.floor(F.col("entry_idx") / CHUNK).cast("int")).join(lines, ["file_idx", "lines_seq", "chunk"])
        at = F.array_position("entries", F.col("entry_idx").cast("int"))
        return placed.withColumn("line_no", F.get("lines", (at - 1).cast("int"))).drop("chunk", "entries", "lines")

    def update(self, entries: DataFrame, files: DataFrame, defer_compact: bool = False, complete: bool = True, marks: dict[str, int] | None = None) -> dict[str, int | bool]:
        """Takes over files (file, file_idx, modified, size) and their entries; says what was done.

        entries has at least those of changed and new files. Removed files are tombstoned
        and keep their number; new ones are numbered after all that there ever were. Unless
        complete, files that aren't named are left alone. A delta over COMPACT_SHARE of the
        base is folded, unless defer_compact leaves that for later. marks go with the commit.
        """
        from tesserine.operators.ranking import numbered

        known = self.store.read("files")
        seq = self.store.version() + 1
        met = known if complete else known.join(files.select("file"), "file", "left_semi")
        status = diff_files(files, met).select("file", F.coalesce("file_idx", F.lit(-1)).alias("file_idx"), "status")
        counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        done: dict[str, int | bool] = {n: counts.get(s, 0) for n, s in (("unchanged", "unchanged"), ("updated", "changed"), ("added", "new"), ("removed", "removed"))}
        if done["updated"] or done["added"] or done["removed"]:
            last = known.agg(F.max("file_idx")).first()[0]
            next_idx = 0 if last is None else last + 1
            fresh = files.join(status.where("status = 'new'").select("file"), "file", "left_semi")
            named = numbered(fresh.drop("file_idx"), ["file"], "file_idx").withColumn("file_idx", F.col("file_idx") + next_idx)
            moved = status.where("status != 'unchanged'").select("file", "file_idx", "status")
            numbers = moved.where("status = 'changed'").select("file", "file_idx", F.lit(False).alias("fresh")).unionByName(named.select("file", "file_idx", F.lit(True).alias("fresh")))
            numbers = numbers.withColumn("file_idx", F.col("file_idx").cast("long"))

            def manifest(old: DataFrame | None, changed: DataFrame) -> DataFrame:
                """The manifest's rows of the buckets that changed files fall into."""
                now = files.select("file", F.col("modified").alias("m"), F.col("size").alias("z"))
                kept = old.join(changed.where("status != 'new'").select("file", "status"), "file", "left").join(now, "file", "left")
                gone, over = F.coalesce(F.col("status") == "removed", F.lit(False)), F.coalesce(F.col("status") == "changed", F.lit(False))
                kept = kept.withColumn("tombstoned", F.col("tombstoned") | gone).withColumn("modified", F.when(over, F.col("m")).otherwise(F.col("modified"))).withColumn("size", F.when(over, F.col("z")).otherwise(F.col("size")))
                kept = kept.withColumn("lines_seq", F.when(over, F.lit(seq).cast("long")).otherwise(F.col("lines_seq"))).drop("m", "z", "status")
                return kept.unionByName(named.withColumn("tombstoned", F.lit(False)).withColumn("lines_seq", F.lit(seq).cast("long")), allowMissingColumns=True).select(old.columns)

            buckets = self.store.touched("files", moved, list(FILES), FILE_BUCKETS)
            old = self.postings(by_file=True).join(moved.where("status != 'new'").select("file_idx"), "file_idx", "left_semi").select(*KEY)
            mine = entries.drop("file_idx").join(numbers, "file")
            # a new file has no older postings; texts of others are dealt out by file before they are cut to tokens, which are far more rows
            come = build(mine.where("fresh")).select(*KEY, F.lit("ADD").alias("op"), F.lit(seq).cast("long").alias("seq"))
            delta = diff_postings(old, build(mine.where("not fresh").repartition("file_idx")), seq).unionByName(come)
            self.store.commit({"files": self.store.merged("files", moved, list(FILES), manifest, buckets, FILE_BUCKETS), "delta": Append(delta), "lines": Append(directory(mine, seq)), "base": None}, marks=marks)
        elif marks:
            self.store.commit({}, marks=marks)
        done["total_slots"] = self.store.read("files").count()
        done["needs_compact"] = self.needs_compact()
        if done["needs_compact"] and not defer_compact:
            self.compact()
        return done

    def needs_compact(self) -> bool:
        return not self.store.is_empty("delta") and self.store.read("delta").count() > COMPACT_SHARE * self.store.read("base").count()

    def compact(self) -> int:
        """Folds the delta into the base in the one shuffle that puts it in order; nothing changes if there is none."""
        if self.store.is_empty("delta") or self.store.read("delta").isEmpty():
            return self.store.version()
        live = self.live_files().select("file_idx", F.col("lines_seq").alias("seq"))
        lines = self.store.read("lines")
        base = _last_holds(_operations(self.store.read("base"), self.store.read("delta")).repartitionByRange(*KEY)).sortWithinPartitions(*KEY)
        return self.store.commit({"base": base, "files": None, "lines": lines.join(live, ["file_idx", "seq"], "left_semi").select(lines.columns), "delta": Empty(self.store.read("delta").schema)})


def build_domains(spark: SparkSession, root: str, domains: dict[str, tuple[DataFrame, DataFrame]]) -> dict[str, PostingsIndex]:
    """An index below root for each domain's (entries, files)."""
    made = {name: PostingsIndex(spark, f"{root}/{name}") for name in domains}
    for name, (entries, files) in domains.items():
        made[name].create(entries, files)
    return made


def update_domains(spark: SparkSession, root: str, domains: dict[str, tuple[DataFrame, DataFrame]], defer_compact: bool = False) -> dict[str, dict[str, int | bool]]:
    """Brings each domain's index up to date, or builds it where there is none; what was done, by domain."""
    done = {}
    for name, (entries, files) in domains.items():
        index = PostingsIndex(spark, f"{root}/{name}")
        if index.store.version():
            done[name] = index.update(entries, files, defer_compact)
        else:
            index.create(entries, files)
            n = files.count()
            done[name] = {"unchanged": 0, "updated": 0, "added": n, "removed": 0, "total_slots": n, "needs_compact": False}
    return done
