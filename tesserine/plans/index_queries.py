"""Registered queries of the index over files of JSON lines, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import search, semantic, trigram_index
from tesserine.operators.postings import PostingsIndex
from tesserine.plans import adapters
from tesserine.plans.registry import query
from tesserine.scratch import scratch_dir
from tesserine.sources import formats, readers
from tesserine.sources.readers import read_table

_BLANK = "turn % 5 = 4 OR turn % 7 = 1"


def session_files(spark: SparkSession, root: str) -> search.Lines:
    """Conversations as files of JSON lines: a third of the lines without JSON, some of them blank."""
    said = read_table(spark, root, "conversations")
    line = F.when(F.expr(_BLANK), "  ").when(F.col("turn") % 3 == 0, F.to_json(F.struct("role", F.col("text").alias("content")))).otherwise(F.col("text"))

    def written(df: DataFrame) -> DataFrame:
        return df.select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).cast("int").alias("line_no"), line.alias("line"))

    return search.Lines(written(said), lambda files: written(said.where(F.col("conv_id").isin([int(f) for f in files]))))


def session_index(spark: SparkSession, root: str) -> PostingsIndex:
    """The index of session_files, its entries numbered by the reader of JSON lines, which passes over blank ones."""
    entries = readers.jsonl_entries(session_files(spark, root).all)
    files = entries.groupBy("file").agg(F.count("*").alias("size")).select("file", F.col("file").cast("long").alias("file_idx"), F.lit(0).alias("modified"), "size", F.lit(False).alias("tombstoned"))
    index = PostingsIndex(spark, f"{scratch_dir(spark)}/session-index-{uuid.uuid4().hex}")
    index.create(entries.select(F.col("file").cast("long").alias("file_idx"), "entry_idx", "line_no", "text"), files)
    return index


_SESSION_LINES = rf"""said AS (
    SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS INTEGER) AS line_no, CASE WHEN {_BLANK} THEN '' ELSE text END AS text,
        CASE WHEN {_BLANK} THEN '  ' WHEN turn % 3 = 0 THEN CAST(to_json({{'role': role, 'content': text}}) AS VARCHAR) ELSE text END AS line
    FROM conversations),
hits AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS n FROM said
    WHERE list_has_any(list_transform(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_\-]+'), lambda t: lower(t)), ['the', 'que', 'und']))"""


@query(
    f"""WITH {_SESSION_LINES}
    SELECT h.file, h.line_no, length(h.line) AS n_chars,
        (SELECT count(*) FROM said c WHERE c.file = h.file AND c.line_no BETWEEN h.line_no - 2 AND h.line_no - 1) AS n_before,
        coalesce((SELECT string_agg(left(c.line, 12), '|' ORDER BY c.line_no) FROM said c WHERE c.file = h.file AND c.line_no BETWEEN h.line_no + 1 AND h.line_no + 2), '') AS after
    FROM hits h WHERE n <= 3 ORDER BY line_no, file LIMIT 300"""
)
def search_entries_index(spark: SparkSession, root: str) -> DataFrame:
    """Words looked up in an index of JSON lines with blanks between them: each hit with its true line and what stands around it."""
    found = search.search({"sessions": session_files(spark, root)}, "the que und", max_results=300, max_matches_per_file=3, context_lines=2, indexes={"sessions": session_index(spark, root)})
    after = F.array_join(F.transform("after", lambda x: F.left(x, F.lit(12))), "|")
    return found.select("file", "line_no", F.length("line").cast("long").alias("n_chars"), F.size("before").cast("long").alias("n_before"), after.alias("after"))


@query(
    """WITH names AS (SELECT DISTINCT p_name AS name FROM part),
    g AS (SELECT name, list_distinct(list_transform(range(1, length(name) - 1), lambda i: substring(lower(name), CAST(i AS INTEGER), 3))) AS t FROM names),
    q AS (SELECT list_distinct(list_transform(range(1, 9), lambda i: substring('small ring', CAST(i AS INTEGER), 3))) AS t)
    SELECT name, round(s, 3) AS similarity FROM (SELECT name, CASE WHEN name = 'small ring' THEN 1.0 ELSE len(list_intersect(g.t, q.t)) / len(list_distinct(list_concat(g.t, q.t))) END AS s FROM g, q) WHERE s >= 0.4"""
)
def similar_names_index(spark: SparkSession, root: str) -> DataFrame:
    """Names like a name, from trigram postings: no other name is compared."""
    names = read_table(spark, root, "part").select(F.col("p_name").alias("name"))
    found = trigram_index.similar_names(trigram_index.name_postings(names), "small ring", 0.4)
    return found.select("name", F.round("similarity", 3).alias("similarity"))


@query(
    r"""SELECT CAST(doc_id AS VARCHAR) AS file, line_no FROM (
        SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents))
    WHERE regexp_matches(line, '(?i)licen[cs]ed? (?:un|ab).*[a-z]{3}')"""
)
def search_regex_index(spark: SparkSession, root: str) -> DataFrame:
    """Lines that match a pattern, looked for in the documents that hold all trigrams a match must have."""
    lines = adapters.domains(spark, root)["documents"]
    index = trigram_index.TrigramIndex(spark, f"{scratch_dir(spark)}/trigrams-{uuid.uuid4().hex}")
    index.create(lines.all)
    return index.scan(lines, "licen[cs]ed? (?:un|ab).*[a-z]{3}").select("file", "line_no")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 3) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.45")
def near_vector_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of vectors by a high threshold, where cells that can't reach each other are left out."""
    return semantic.similar_pairs(read_table(spark, root, "embeddings"), 0.45, None)


@query(
    f"""WITH said AS (SELECT conv_id % 8 AS part, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS line_no, conv_id, turn, CASE WHEN {_BLANK} THEN NULL ELSE text END AS text FROM conversations)
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY conv_id, turn) - 1 AS entry_idx, line_no, length(text) AS n_chars FROM said WHERE text IS NOT NULL"""
)
def entries_format(spark: SparkSession, root: str) -> DataFrame:
    """Conversations written out as files of JSON lines and read back through the format of the extractor."""
    said = read_table(spark, root, "conversations").withColumn("part", F.pmod("conv_id", F.lit(8)))
    line = F.when(F.expr(_BLANK), "").otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    folder = f"{scratch_dir(spark)}/entries-{uuid.uuid4().hex}"
    said.select("part", "conv_id", "turn", line.alias("value")).repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(folder)
    read = formats.entries(spark, folder, "jsonl", "*.txt")
    return read.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "entry_idx", "line_no", F.length("text").cast("long").alias("n_chars"))
