"""Registered queries of judged candidates and of maintenance runs, beside their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import maintenance
from tesserine.operators.graph import TRIPLE, Graph
from tesserine.operators.runs import GraphStore, RunStore
from tesserine.plans import adapters
from tesserine.plans.registry import query
from tesserine.scratch import scratch_dir
from tesserine.sources.readers import read_table

_KINDS = "Plan implementation Refactor design-decision BUG fix bugfix finding test Code-Change file change milestone".split()
_LIST = f"string_split('{' '.join(_KINDS)}', ' ')"
_JUDGED = f"""e AS (SELECT p_partkey AS k, lower({_LIST}[p_partkey % 13 + 1]) AS x, lower({_LIST}[(p_partkey // 13) % 13 + 1]) AS y, p_partkey % 5 AS shared FROM part),
    r AS (SELECT *, round(least(shared / 3, 1.0), 3) AS s FROM e),
    d AS (
        SELECT r.*, CASE WHEN s < 0.45 THEN 'weak' WHEN t IS NOT NULL THEN 'rule' WHEN k % 3 <> 0 THEN 'batch' WHEN k % 6 = 0 THEN 'single' ELSE 'none' END AS how,
            CASE WHEN s < 0.45 THEN NULL WHEN t IS NOT NULL THEN t WHEN k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'uses' ELSE 'references' END WHEN k % 6 = 0 THEN 'depends_on' END AS kind
        FROM r LEFT JOIN (VALUES ('plan','implementation','implements'),('plan','refactor','implements'),('design-decision','implementation','implements'),('bug','fix','fixes'),('bug','bugfix','fixes'),('finding','fix','fixes'),
            ('test','code-change','tests'),('test','implementation','tests'),('implementation','test','tested_by'),('file','test','contains'),('change','implementation','implements'),('milestone','plan','contains')) m(p, q, t) ON p = x AND q = y)"""


def _judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Names two thirds of the pairs, half of them without a type."""
    k = batch["a"].str.slice(1).astype("int64")
    named = batch[k % 3 != 0]
    kinds = ["uses" if n % 2 == 0 else None for n in k[k % 3 != 0]]
    return pd.DataFrame({"a": named["a"], "b": named["b"], "relation_type": kinds})


def _single(a: str, b: str) -> str | None:
    return "it uses it, or rather Depends_on it" if int(a[1:]) % 6 == 0 else "no idea"


def _judged(spark: SparkSession, root: str, health: Observation | None = None) -> DataFrame:
    """Pairs of every two types, in any case, named by rules, by a judge that leaves a third out, and one by one."""
    kinds = F.array(*map(F.lit, _KINDS))
    parts = read_table(spark, root, "part").select(F.col("p_partkey").alias("k"), F.element_at(kinds, (F.col("p_partkey") % 13 + 1).cast("int")).alias("x"), F.element_at(kinds, (F.floor(F.col("p_partkey") / 13) % 13 + 1).cast("int")).alias("y"))
    name = F.col("k").cast("string")
    ends = [parts.select(F.concat(F.lit(end), name).alias("name"), F.col(end).alias("entity_type")) for end in ("x", "y")]
    none = spark.createDataFrame([], "obs_id long, name string, content string, created_at timestamp")
    g = Graph(ends[0].unionByName(ends[1]), none, spark.createDataFrame([], "src string, dst string, relation_type string, created_at timestamp"))
    pairs = parts.select(F.concat(F.lit("x"), name).alias("a"), F.concat(F.lit("y"), name).alias("b"), (F.col("k") % 5).alias("shared"))
    return maintenance.validate(g, maintenance.rank(pairs), judge=_judge, single=_single, health=health)


@query(f"WITH {_JUDGED} SELECT 'x' || k AS src, 'y' || k AS dst, kind AS relation_type, s AS confidence FROM d WHERE kind IS NOT NULL")
def validator_judged(spark: SparkSession, root: str) -> DataFrame:
    return _judged(spark, root)


@query(
    f"""WITH {_JUDGED} SELECT count(*) AS candidates_in, count(*) FILTER (WHERE how = 'weak') AS weak, count(*) FILTER (WHERE how = 'rule') AS named_by_rules,
        CAST(ceil(count(*) FILTER (WHERE how IN ('batch', 'single', 'none')) / 20) AS BIGINT) AS batch_calls_attempted, CAST(ceil(count(*) FILTER (WHERE how IN ('batch', 'single', 'none')) / 20) AS BIGINT) AS batch_calls_succeeded,
        count(*) FILTER (WHERE how = 'batch') AS named_by_batch, count(*) FILTER (WHERE how IN ('single', 'none')) AS single_pair_fallbacks, count(*) FILTER (WHERE how = 'none') AS single_pair_returns_none FROM d"""
)
def validator_counters(spark: SparkSession, root: str) -> DataFrame:
    """What the validator counted while its result was written."""
    health = Observation("validator")
    _judged(spark, root, health).write.format("noop").mode("overwrite").save()
    counted = health.get
    return spark.createDataFrame([tuple(counted.values())], ", ".join(f"{k} long" for k in counted))


_TYPES = sorted(maintenance.ALLOWED)
_TYPE_LIST = f"string_split('{' '.join(_TYPES)}', ' ')"


@query(
    f"""WITH r AS (SELECT o_orderkey, {_TYPE_LIST}[o_orderkey % 12 + 1] AS x, {_TYPE_LIST}[(o_orderkey // 12) % 12 + 1] AS y FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN length(x) > length(y) OR length(x) = length(y) AND x <= y THEN x ELSE y END AS kind FROM r"""
)
def reply_types(spark: SparkSession, root: str) -> DataFrame:
    """The relation type in replies that name two of them, or none as a word of its own."""
    kinds = F.array(*map(F.lit, _TYPES))
    x, y = F.element_at(kinds, (F.col("o_orderkey") % 12 + 1).cast("int")), F.element_at(kinds, (F.floor(F.col("o_orderkey") / 12) % 12 + 1).cast("int"))
    reply = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("no_"), x, F.lit("_here"))).otherwise(F.concat(F.lit("The relation is "), F.upper(x), F.lit(", or "), y, F.lit(".")))
    return read_table(spark, root, "orders").select("o_orderkey", maintenance.parse_relation_type(reply).alias("kind"))


# The words left out, in full, so that the SQL stands on its own.
_STOP = """'the','a','an','and','or','but','of','to','in','on','for','with','is','are','was','were','be','been','it','this','that','from','by','at','as','its','his','her','their','we','you','they','not','no',
    'has','have','had','do','does','did','will','would','can','could','should','into','via','through','using','used','use','more','most'"""
_FIRST = "head AS (SELECT c_name AS name, concat_ws(' ', o_orderpriority, o_orderstatus, CAST(o_orderkey AS VARCHAR)) AS content, row_number() OVER (PARTITION BY c_name ORDER BY o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)"
_WORDS = f"(SELECT name, unnest(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9_-]*')) AS token FROM {{source}}) WHERE length(token) > 2 AND token NOT IN ({_STOP})"
_NAMES = "names AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer)"


@query(
    f"""WITH {_FIRST}, {_NAMES}, t AS (SELECT DISTINCT name, token FROM {_WORDS.format(source="(SELECT * FROM head WHERE n <= 3)")}),
    placed AS (SELECT name, (row_number() OVER (ORDER BY name) - 1) // 150 AS chunk FROM names),
    w AS (SELECT * FROM t UNION SELECT name, token FROM {_WORDS.format(source="(SELECT name, name AS content FROM names)")}),
    k AS (SELECT w.*, chunk FROM w JOIN placed USING (name)),
    p AS (SELECT x.chunk, x.name AS a, y.name AS b, count(*) AS shared FROM k x JOIN k y ON x.chunk = y.chunk AND x.token = y.token AND x.name < y.name GROUP BY ALL HAVING count(*) >= 2)
    SELECT chunk, a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY shared DESC, a, b) AS r FROM p
        WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_name = a AND n_name = b) OR (c_name = b AND n_name = a))
          AND NOT EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (s_name = a AND n_name = b) OR (s_name = b AND n_name = a))
          AND NOT EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE (n_name = a AND r_name = b) OR (n_name = b AND r_name = a))) WHERE r <= 25"""
)
def chunk_suggestions(spark: SparkSession, root: str) -> DataFrame:
    """The best pairs of every chunk of entities, by the words of names and first observations."""
    return maintenance.chunk_candidates(adapters.graph(spark, root)).select("chunk", "a", "b", "shared")


@query(
    f"""WITH {_FIRST}, k AS (SELECT DISTINCT name, token FROM {_WORDS.format(source="(SELECT * FROM head WHERE n <= 3)")}),
    p AS (SELECT x.name AS a, y.name AS b, count(*) AS shared FROM k x JOIN k y ON x.token = y.token AND x.name < y.name GROUP BY ALL HAVING count(*) >= 2)
    SELECT a AS src, b AS dst, 'related_to' AS relation_type FROM p ORDER BY shared DESC, a, b LIMIT 80"""
)
def run_replay(spark: SparkSession, root: str) -> DataFrame:
    """The relations that a run adds when its last stages are run again after the live graph has lost half of its entities."""
    folder = f"{scratch_dir(spark)}/runs-{uuid.uuid4().hex}"
    graphs = GraphStore(spark, f"{folder}/graph")
    g = adapters.graph(spark, root)
    graphs.commit(g)
    runs = RunStore(spark, f"{folder}/runs", graphs)
    run = runs.create("first")

    def all_related(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["a", "b"]].assign(relation_type="related_to")

    runs.run(run, judge=lambda batch: all_related(batch.iloc[:0]), now=adapters.as_of())
    live = graphs.read()
    graphs.commit(Graph(live.entities.where(F.pmod(F.xxhash64("name"), F.lit(2)) == 0), live.observations, live.relations.limit(0)))
    graphs.store.expire(keep=1, grace=0)
    planned = runs.run(run, from_stage="validate", judge=all_related, now=adapters.as_of())
    return planned.relations.join(g.relations.select(TRIPLE), TRIPLE, "left_anti").select(TRIPLE)
