"""Sources: files of text lines, JSON lines, transcripts, logs and histories."""

from __future__ import annotations

import io
import re
import tomllib
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.functions.text import date_in_name, pattern
from tesserine.operators.ranking import numbered
from tesserine.sources.formats import extractor_names


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of a data set; timestamps without a zone are read as UTC."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """file, name, size, modified, content of each file below root, symbolic links left to the file system."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def read_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """file, name, line_no, line: the lines of text files, numbered from 1. Undecodable files give none."""
    files = read_files(spark, root, glob).withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return lines_of(files.where(F.col("text").isNotNull()).select("file", "name", "modified", "text"), "text")


def lines_of(df: DataFrame, text_col: str) -> DataFrame:
    """A row a line for a text column, with line_no (from 1) and line."""
    parts = F.split(F.col(text_col), r"\r\n|\n|\r", -1)
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(parts).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def jsonl_entries(lines: DataFrame, key: str = "file") -> DataFrame:
    """Entries of JSON lines: the content of each non-blank line, the line itself where it has none.

    entry_idx counts non-blank lines from 0 in their file; line_no stays the true line.
    """
    kept = lines.where(F.trim("line") != "")
    text = F.coalesce(F.nullif(F.get_json_object("line", "$.content"), F.lit("")), F.col("line"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    return kept.withColumn("text", text).withColumn("entry_idx", number)


def manifest(files: DataFrame) -> DataFrame:
    """File slots: file_idx by the order of path parts, date from the name, size and time."""
    slots = files.select("file", "name", date_in_name(F.col("name")).alias("date"), "modified", "size", F.lit(False).alias("tombstoned"), F.split("file", "/").alias("parts"))
    return numbered(slots, ["parts"], "file_idx").drop("parts")


def log_lines(lines: DataFrame, query: str, level: str | None = None, regex: bool = False, case_sensitive: bool = False, limit: int = 30, line_col: str = "line") -> DataFrame:
    """Log lines that match, the level being their fourth word; cut to 400 characters, newest first."""
    hit = F.col(line_col).rlike(pattern(query, regex, case_sensitive))
    if level:
        hit = hit & (F.lower(F.get(F.split(F.trim(line_col), r"\s+"), 3)) == level.lower())
    return lines.where(hit).withColumn(line_col, F.substring(line_col, 1, 400)).orderBy(F.desc("line_no")).limit(limit)


def history_lines(lines: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, limit: int = 30) -> DataFrame:
    """Commands that match, quotes around them dropped; cut to 300 characters, newest first."""
    command = F.regexp_replace(F.trim("line"), r"^[\"']+|[\"']+$", "")
    return lines.withColumn("line", command).where(F.col("line").rlike(pattern(query, regex, case_sensitive))).withColumn("line", F.substring("line", 1, 300)).orderBy(F.desc("line_no")).limit(limit)


# --- transcripts

TURN_LINE = r"^(.+?)\s+\((\d{2}:\d{2}:\d{2})\)\s*$"


def transcript_turns(lines: DataFrame, key: str) -> DataFrame:
    """Turns of transcripts from (key, line_no, line): turn_no, speaker, stamp, text, line_start, line_end.

    The header ends at the first line of equals signs; a turn is a speaker's line and
    what follows it up to the next one.
    """
    in_file = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("body", F.max(F.when(F.col("line").startswith("==="), 1).otherwise(0)).over(in_file)).where((F.col("body") == 1) & ~F.col("line").startswith("==="))
    is_turn = F.col("line").rlike(TURN_LINE)
    numbered = marked.withColumn("head", is_turn).withColumn("turn_no", F.sum(is_turn.cast("int")).over(in_file)).where("turn_no > 0")
    said = F.when(~F.col("head"), F.struct("line_no", "line"))
    grouped = numbered.groupBy(key, "turn_no").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("first"), F.sort_array(F.collect_list(said)).alias("said"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))
    text = F.regexp_replace(F.array_join(F.col("said.line"), "\n"), r"^\s+|\s+$", "")
    return grouped.select(key, "turn_no", F.regexp_extract("first", TURN_LINE, 1).alias("speaker"), F.regexp_extract("first", TURN_LINE, 2).alias("stamp"), text.alias("text"), "line_start", "line_end")


_PARAGRAPH = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}p"
_RUN_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"
_DOCX_TURN = re.compile(r"^(\d{1,2}:\d{2}(?::\d{2})?)\s+([^:]+):\s*(.*)$")


def docx_text(content: bytes) -> str | None:
    """The paragraphs of a Word file as transcript text; None for a broken file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines: list[str] = []
    for paragraph in root.iter(_PARAGRAPH):
        text = "".join(t.text or "" for t in paragraph.iter(_RUN_TEXT)).strip()
        if turn := _DOCX_TURN.match(text):
            stamp = turn[1] if turn[1].count(":") == 2 else f"{turn[1]}:00"
            stamp = stamp.zfill(8)
            lines += [f"{turn[2].strip()} ({stamp})", turn[3]]
        elif text:
            lines.append(text)
    return "===\n" + "\n".join(lines)


def read_docx(spark: SparkSession, root: str) -> DataFrame:
    """file, name, modified, text of Word transcripts; broken files are left out."""

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [docx_text(c) for c in batch["content"]]
            yield batch.dropna(subset=["text"])[["file", "name", "modified", "text"]]

    return read_files(spark, root, "*.docx").select("file", "name", "modified", "content").mapInPandas(parse, "file string, name string, modified timestamp, text string")


# --- domains

FILTERS = {"role", "speaker"}


@dataclass(frozen=True)
class Domain:
    """A searchable domain and the roles its columns play."""

    name: str
    dir: str
    pattern: str = "*"
    kind: str = "files"
    extensions: tuple[str, ...] = ()
    extractor: str = "jsonl"
    label: str = ""
    filters: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.name or not self.dir:
            raise ValueError("a domain needs a name and a folder")
        if self.kind not in ("files", "dirs"):
            raise ValueError(f"domain {self.name}: kind {self.kind!r} is neither files nor dirs")
        if self.extractor not in extractor_names():
            raise ValueError(f"domain {self.name}: unknown extractor {self.extractor!r}")
        if unknown := set(self.filters) - FILTERS:
            raise ValueError(f"domain {self.name}: unknown filters {sorted(unknown)}")


def load_domains(toml_text: str) -> dict[str, Domain]:
    """Domains of a TOML file; what isn't valid is refused."""
    tables = tomllib.loads(toml_text).get("domains")
    if not isinstance(tables, dict) or not tables:
        raise ValueError("no [domains] table")
    known = set(Domain.__dataclass_fields__) - {"name"}
    out = {}
    for name, values in tables.items():
        if unknown := set(values) - known:
            raise ValueError(f"domain {name}: unknown keys {sorted(unknown)}")
        if "dir" not in values:
            raise ValueError(f"domain {name}: no folder")
        out[name] = Domain(name, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    return out


def list_files(spark: SparkSession, domain: Domain) -> DataFrame:
    """A domain's files or folders, newest first."""
    files = read_files(spark, domain.dir, domain.pattern if domain.kind == "files" else "*").drop("content")
    if domain.extensions:
        files = files.where(F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1)).isin(list(domain.extensions)))
    if domain.kind == "dirs":
        folder = F.element_at(F.split("file", "/"), -2)
        files = files.groupBy(folder.alias("name")).agg(F.max("modified").alias("modified"), F.sum("size").alias("size"), F.count("*").alias("files"))
    return files.orderBy(F.desc("modified"), "name")


def resolve_id(files: DataFrame, wanted: str, id_col: str = "name", by_end: bool = True) -> DataFrame:
    """The file an id names: itself, else the first that begins with it or, if asked, ends with it. Paths out of the folder are refused."""
    if not wanted or ".." in wanted or wanted.startswith("/") or "\\" in wanted:
        raise ValueError("not a file id")
    rank = F.when(F.col(id_col) == wanted, 0).when(F.col(id_col).startswith(wanted), 1).when(F.col(id_col).endswith(wanted) & F.lit(by_end), 2)
    return files.withColumn("rank", rank).where("rank is not null").orderBy("rank", id_col).limit(1).drop("rank")


def newest_messages(messages: DataFrame, n: int, role: str | None = None, filter_first: bool = False) -> DataFrame:
    """A session's newest n messages; the role is looked at after the cut, unless filter_first."""
    wanted: Column = F.lower("role") == role.lower() if role else F.lit(True)
    base = messages.where(wanted) if filter_first else messages
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return base.withColumn("nth", number).where(F.col("nth") <= n).where(wanted)


def newest_entries(lines: DataFrame, most: int = 50, key: str = "file") -> DataFrame:
    """The last `most` non-blank lines of each file, newest first: key, nth, line, raw (the line where it is no JSON)."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("line_no")))
    kept = lines.where(F.trim("line") != "").withColumn("nth", number).where(F.col("nth") <= most)
    return kept.select(key, "nth", F.trim("line").alias("line"), F.when(F.try_parse_json("line").isNull(), F.trim("line")).alias("raw"))


def read_turns(turns: DataFrame, speaker: str | None = None, most: int = 50, key: str = "file") -> DataFrame:
    """The first turns of each transcript, those of one speaker if named; the speaker counts before the cut."""
    said = turns if speaker is None else turns.where(F.lower("speaker") == speaker.lower())
    number = F.row_number().over(Window.partitionBy(key).orderBy("turn_no"))
    return said.withColumn("nth", number).where(F.col("nth") <= most).drop("nth")


def read_entries(spark: SparkSession, domain: Domain, wanted: str, most: int = 50, role: str | None = None, speaker: str | None = None) -> DataFrame:
    """Entries of the file of a domain that an id names: turns of a transcript, newest messages of a session, else newest lines.

    An unknown id gives no rows.
    """
    files = read_files(spark, domain.dir, domain.pattern if domain.kind == "files" else "*").drop("content")
    name = F.col("name") if domain.kind == "files" else F.element_at(F.split("file", "/"), -2)
    # folders are also known by how their names end, files are not
    target = resolve_id(files.withColumn("id", name), wanted, "id", by_end=domain.kind == "dirs").select("file")
    lines = read_lines(spark, domain.dir, domain.pattern if domain.kind == "files" else "*").join(target, "file", "left_semi")
    if domain.extractor == "text":
        return read_turns(transcript_turns(lines, "file"), speaker, most)
    if "role" in domain.filters:
        said = lines.where(F.trim("line") != "").select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), "line", F.get_json_object("line", "$.role").alias("role"))
        return newest_messages(said, most, role)
    return newest_entries(lines, most)
