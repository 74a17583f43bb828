"""Registered queries over streams: tables replayed in batches, with a restart between them, beside SQL over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.operators.postings import PostingsIndex
from tesserine.plans.registry import query
from tesserine.plans.snapshot import SnapshotStore
from tesserine.scratch import scratch_dir
from tesserine.sources.readers import read_table
from tesserine.streaming import events as ev
from tesserine.streaming import state


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Replay:
    """A table written out in batches, each of which becomes one micro-batch of a stream."""

    def __init__(self, df: DataFrame, batch: Column, name: str) -> None:
        self.spark, self.folder, self.schema = df.sparkSession, _folder(df.sparkSession, name), df.schema
        self.rows = df.withColumn("__batch", batch)
        self.batches = sorted(r[0] for r in self.rows.select("__batch").distinct().collect())

    def write(self, batch: int) -> None:
        self.rows.where(F.col("__batch") == batch).drop("__batch").write.mode("append").parquet(f"{self.folder}/batch={batch}")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(self.folder)

    def run(self, start) -> None:
        """Writes a batch and runs the stream until it has taken it: each batch after the first is a restart from the checkpoint."""
        for batch in self.batches:
            self.write(batch)
            start(self.stream()).awaitTermination()


_LAST = "l AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_user FROM conversations)"


@query(
    f"""WITH {_LAST}, m AS (SELECT *, role = 'assistant' AND contains(text, 'ent') AS h, role = 'assistant' AND contains(text, 'que') AS s FROM l),
    g AS (SELECT conv_id, max(last_user) AS last_user, min(CASE WHEN turn > last_user AND h THEN turn END) AS fh, min(CASE WHEN turn > last_user AND s THEN turn END) AS fs, coalesce(bool_or(turn < last_user AND (h OR s)), false) AS e FROM m GROUP BY conv_id)
    SELECT conv_id, last_user, fh IS NOT NULL AND NOT e AND (fs IS NULL OR fs > fh) AS denied FROM g"""
)
def session_gates_stream(spark: SparkSession, root: str) -> DataFrame:
    """The gate of every session, kept as state while its messages come in four batches and out of order."""
    said = read_table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    store, checkpoint = SnapshotStore(spark, _folder(spark, "gates")), _folder(spark, "gates-checkpoint")

    def latest(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else old.join(new.select("conv_id"), "conv_id", "left_anti").unionByName(new)

    def start(stream: DataFrame):
        gates = state.session_gates(stream, F.contains("text", F.lit("ent")), F.contains("text", F.lit("que"))).drop("closed")
        return ev.ingest(gates, store, latest, "gates", checkpoint, keys=["conv_id"], buckets=16, mode="update")

    Replay(said, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)), "messages").run(start)
    return store.read("gates")


_TILE = "CAST(floor(epoch(ts) / 432000) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END"


@query(
    f"""WITH e AS (SELECT *, {_TILE} AS b, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS w FROM events),
    seen AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM e GROUP BY b),
    m AS (SELECT e.*, coalesce(w <= mark, false) AS late FROM e JOIN seen USING (b))
    SELECT strftime(w - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS start, event_type, count(*) FILTER (WHERE NOT late) AS n_in_time, count(*) FILTER (WHERE late) AS n_late, round(sum(value), 4) AS total FROM m GROUP BY ALL"""
)
def event_windows_stream(spark: SparkSession, root: str) -> DataFrame:
    """Hourly windows of a stream with a watermark of a day and, beside them, the rows that came too late: together all rows."""
    events = read_table(spark, root, "events").select("event_id", "ts", "event_type", "value")
    store, checkpoint = SnapshotStore(spark, _folder(spark, "windows")), _folder(spark, "windows-checkpoint")
    tile = F.floor(F.unix_micros("ts") / 432_000_000_000) + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    Replay(events, tile, "events").run(lambda stream: ev.window_stream(stream, store, "1 hour", "event_type", "1 day", checkpoint))
    in_time = store.read("windows").select("start", "event_type", F.col("n").alias("n_in_time"), F.lit(0).cast("long").alias("n_late"), "total")
    late = ev.tumbling(store.read("windows_late"), "1 hour", "event_type").select("start", "event_type", F.lit(0).cast("long").alias("n_in_time"), F.col("n").alias("n_late"), "total")
    both = in_time.unionByName(late).groupBy("start", "event_type").agg(F.sum("n_in_time").alias("n_in_time"), F.sum("n_late").alias("n_late"), F.round(F.sum("total"), 4).alias("total"))
    return both.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query(
    """WITH RECURSIVE calls AS (
        SELECT event_type AS hook, ts, row_number() OVER w AS k, row_number() OVER w AS e, CAST(sum(user_id % 3) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS o FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    gate AS (
        SELECT hook, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS TIMESTAMP) AS last, CAST(0 AS BIGINT) AS le, CAST(0 AS BIGINT) AS lo, CAST(0 AS BIGINT) AS growth, '' AS decision FROM (SELECT DISTINCT hook FROM calls)
        UNION ALL
        SELECT hook, k, ts, CASE WHEN looks THEN ts ELSE last END, CASE WHEN looks THEN e ELSE le END, CASE WHEN looks THEN o ELSE lo END, CASE WHEN looks THEN g ELSE 0 END, CASE WHEN NOT looks THEN 'throttled' WHEN g >= 4 THEN 'run' ELSE 'idle' END
        FROM (SELECT c.hook, c.k, CAST(c.ts AS TIMESTAMP) AS ts, g.last, c.e, c.o, g.le, g.lo, g.last IS NULL OR epoch(c.ts) - epoch(g.last) >= 21600 AS looks, greatest(c.e - g.le, 0) + greatest(c.o - g.lo, 0) AS g FROM gate g JOIN calls c ON c.hook = g.hook AND c.k = g.k + 1))
    SELECT hook, decision, count(*) AS n, CAST(sum(growth) AS BIGINT) AS growth, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM gate WHERE k > 0 GROUP BY hook, decision"""
)
def hook_gates_stream(spark: SparkSession, root: str) -> DataFrame:
    """What each hook's calls come to under a pause of six hours and a growth of four, its state kept from batch to batch."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    grown = F.sum(F.col("user_id") % 3).over(order.rowsBetween(Window.unboundedPreceding, 0))
    calls = read_table(spark, root, "events").select(F.col("event_type").alias("hook"), "ts", F.row_number().over(order).cast("long").alias("n_entities"), grown.cast("long").alias("n_observations"))
    store, checkpoint = SnapshotStore(spark, _folder(spark, "hooks")), _folder(spark, "hooks-checkpoint")

    def added(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else old.unionByName(new)

    tile = F.floor(F.unix_micros("ts") / 864_000_000_000)
    Replay(calls, tile, "calls").run(lambda stream: ev.ingest(state.hook_gates(stream, 21_600, 4), store, added, "decisions", checkpoint, keys=["hook", "ts"], buckets=16))
    decided = store.read("decisions").groupBy("hook", "decision").agg(F.count("*").alias("n"), F.sum("growth").alias("growth"), F.min("ts").alias("first"))
    return decided.withColumn("first", F.date_format("first", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def bucket_upserts_stream(spark: SparkSession, root: str) -> DataFrame:
    """Totals by customer, merged from a stream of orders: each batch rewrites the buckets of its customers only."""
    orders = read_table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    store, checkpoint = SnapshotStore(spark, _folder(spark, "totals")), _folder(spark, "totals-checkpoint")

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        fresh = new.select("o_custkey", F.lit(1).cast("long").alias("n"), F.col("o_totalprice").cast("double").alias("total"), F.col("o_orderkey").alias("last"))
        both = fresh if old is None else old.unionByName(fresh)
        return both.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))

    Replay(orders, F.pmod("o_orderkey", F.lit(3)), "orders").run(lambda stream: ev.ingest(stream, store, combine, "totals", checkpoint, keys=["o_custkey"], buckets=32))
    return store.read("totals").withColumn("total", F.round("total", 2))


@query(
    r"""WITH said AS (SELECT conv_id % 12 AS part, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 12 ORDER BY conv_id, turn) AS line_no, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text FROM conversations)
    SELECT CAST(part AS BIGINT) AS part, CAST(line_no AS INTEGER) AS line_no FROM said WHERE list_has_any(list_transform(regexp_split_to_array(text, '[^\p{L}\p{N}_\-]+'), lambda t: lower(t)), ['the', 'que', 'und'])"""
)
def index_files_stream(spark: SparkSession, root: str) -> DataFrame:
    """Files of JSON lines, with blank ones, come into a folder in three batches and into an index by a stream; then words are looked up."""
    said = read_table(spark, root, "conversations").withColumn("part", F.pmod("conv_id", F.lit(12)))
    line = F.when(F.col("turn") % 5 == 4, "").otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    folder, checkpoint = _folder(spark, "log-files"), _folder(spark, "log-checkpoint")
    index = PostingsIndex(spark, _folder(spark, "log-index"))
    for batch in range(3):
        written = said.where(F.col("part") % 3 == batch).select("part", "conv_id", "turn", line.alias("value")).repartition("part").sortWithinPartitions("part", "conv_id", "turn")
        written.select("part", "value").write.mode("append").partitionBy("part").text(folder)
        ev.index_stream(spark, folder, index, checkpoint, glob="*.txt").awaitTermination()
    hits = index.with_lines(index.search(["the", "que", "und"], "or"))
    return hits.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line_no")
