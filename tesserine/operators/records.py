"""Session records: digests, summaries, message snippets; and a time limit for scans."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import message_snippet
from tesserine.operators.graph import Graph, capped_observations, neighbours
from tesserine.operators.semantic import embedding_text
from tesserine.plans.snapshot import SnapshotStore

DIGEST_ROWS = 500
SUMMARY = "goal string, outcome string, status string, tags array<string>, key_decisions array<string>, files_touched array<string>, topic string, key_points array<string>, decisions array<string>, action_items array<struct<who:string,what:string>>"
MESSAGE = "role string, content string, tool_calls array<struct<function:struct<name:string,arguments:string>>>"


def digest_newest(log: DataFrame, limit: int = 50, kept: int = DIGEST_ROWS, ts: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest rows of a bounded log: of the last `kept` ones, `limit` at most; those of one time by the ties' columns."""
    return log.orderBy(F.desc(ts), *ties).limit(min(limit, kept))


def append_digest(log: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines."""
    log.write.mode("append").json(path)


def summaries(files: DataFrame, json_col: str = "json") -> DataFrame:
    """Summary files as columns; what a file lacks is null, and a broken file is null throughout."""
    return files.withColumn("s", F.from_json(json_col, SUMMARY)).select(*[c for c in files.columns if c != json_col], "s.*")


def snippets(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """role and snippet of messages that are JSON lines; other lines count as the user's words. Content in parts is their texts, a blank between."""
    parsed = lines.withColumn("m", F.from_json(line_col, MESSAGE))
    names = F.transform("m.tool_calls", lambda c: c["function"]["name"])
    sound = F.col(line_col).startswith("{") & F.col("m").isNotNull()
    parts = F.try_variant_get(F.try_parse_json(line_col), "$.content", "array<struct<text:string>>")
    content = F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), " "), F.col("m.content"))
    text = F.when(sound, message_snippet(content, names, F.lit(None).cast("string"))).otherwise(F.substring(line_col, 1, 300))
    return parsed.select(*lines.columns, F.when(sound, F.lower("m.role")).otherwise("user").alias("role"), text.alias("snippet"))


def capped_histogram(df: DataFrame, col: str, most: int = 20) -> DataFrame:
    """The most frequent values of a column, and in one more row how many values and rows are left."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), col).limit(most)
    rest = counts.join(top.select(col), col, "left_anti").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 0")
    return top.select(F.col(col).cast("string").alias("value"), "n").unionByName(rest.select(F.concat(F.lit("…and "), F.col("k").cast("string"), F.lit(" more")).alias("value"), "n"))


def entity_summary(g: Graph, name: str, most_observations: int = 50, most_relations: int = 50, width: int = 120) -> DataFrame:
    """One entity with its first observations, cut to a width, and its relations in both directions."""
    one = g.entities.where(F.col("name") == name)
    observations = capped_observations(g, one, most_observations).select("name", F.transform("observations", lambda o: F.when(F.length(o) > width, F.concat(F.substring(o, 1, width), F.lit("…"))).otherwise(o)).alias("observations"))
    edges = neighbours(g, name).orderBy("direction", "other", "relation_type").limit(most_relations).agg(F.sort_array(F.collect_list(F.struct("direction", "other", "relation_type"))).alias("relations"))
    return one.join(observations, "name", "left").join(edges, F.lit(True))


def embed_entities(g: Graph, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """name, embedding of every entity by a callable on batches of texts; what the vector index is rebuilt from."""
    texts = g.entities.select("name").join(capped_observations(g, g.entities, 4), "name", "left").select("name", embedding_text(F.col("name"), F.coalesce("observations", F.array().cast("array<string>"))).alias("text"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "embedding": embed(batch["text"].tolist())})

    return texts.mapInPandas(run, "name string, embedding array<float>")


def store_vectors(spark: SparkSession, root: str, vectors: DataFrame) -> int:
    """Stores name, embedding as the next version of a vector index; readers see the old or the new one whole."""
    return SnapshotStore(spark, root).commit({"vectors": vectors.select("name", "embedding")})


def load_vectors(spark: SparkSession, root: str) -> DataFrame:
    """name, embedding as last stored."""
    return SnapshotStore(spark, root).read("vectors")


def should_run(now: float, last: float | None, pause: float, grown: int, least: int) -> bool:
    """Whether a maintenance run is due: enough time since the last one, and enough growth."""
    return (last is None or now - last >= pause) and grown >= least


def within(spark: SparkSession, action: Callable[[], object], seconds: float) -> object:
    """An action's result; its jobs are cancelled after so many seconds, which raises."""
    group = f"limited-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "limited", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def validate_in_batches(pairs: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], size: int = 20) -> DataFrame:
    """Candidate pairs judged in batches; a batch that fails is passed over, the others count."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                try:
                    yield judge(batch.iloc[at : at + size])[["a", "b", "relation_type", "confidence"]]
                except Exception:  # noqa: BLE001  a judge may be any service
                    continue

    kind = dict(pairs.dtypes)["a"]
    return pairs.mapInPandas(run, f"a {kind}, b {kind}, relation_type string, confidence double")


def level_of(line: Column) -> Column:
    """A log line's level, its fourth word."""
    return F.upper(F.get(F.split(F.trim(line), r"\s+"), 3))
