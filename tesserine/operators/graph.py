"""The knowledge graph: entities, observations and relations as tables; reads and guarded changes.

entities(name, entity_type, created_at, updated_at, revision)
observations(obs_id, name, content, created_at)
relations(src, dst, relation_type, created_at)
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.text import contains_ci, query_tokens, trigram_similarity
from tesserine.operators.ranking import first_n
from tesserine.scratch import ensure_checkpoints

TRIPLE = ["src", "dst", "relation_type"]


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    observations: DataFrame
    relations: DataFrame


# --- counts


def counts(g: Graph) -> DataFrame:
    """Entities, relations, observations and the density 2R/E, in one row."""
    parts = [g.entities.agg(F.count("*").alias("n_entities")), g.relations.agg(F.count("*").alias("n_relations")), g.observations.agg(F.count("*").alias("n_observations"))]
    # three one-row aggregates side by side
    whole = functools.reduce(lambda a, b: a.join(b, F.lit(True)), parts)
    return whole.withColumn("density", F.when(F.col("n_entities") > 0, 2.0 * F.col("n_relations") / F.col("n_entities")).otherwise(0.0))


def histogram(df: DataFrame, col: str) -> DataFrame:
    """Values of a column by how often they occur, then by name."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def span(entities: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The oldest and newest entity, and how many were updated in the last hours."""
    recent = F.col("updated_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))
    return entities.agg(F.min_by("name", F.struct("created_at", "name")).alias("oldest"), F.max_by("name", F.struct("created_at", "name")).alias("newest"), F.count_if(recent).alias("active"))


# --- reads


def capped_observations(g: Graph, names: DataFrame, most: int) -> DataFrame:
    """name, observations: the first ones of each named entity, in the order they came."""
    kept = first_n(g.observations.join(names.select("name"), "name", "left_semi"), ["name"], ["obs_id"], most)
    listed = kept.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("obs_id", "content"))).alias("o"))
    return listed.select("name", F.col("o.content").alias("observations"))


def scored_nodes(g: Graph, query: str) -> DataFrame:
    """Entities that hold every token in name, type or an observation, with their score.

    A token scores 10 in the name, 5 in the type and 1 in any observation.
    """
    tokens = query_tokens(query)
    if not tokens:
        return g.entities.limit(0).select("name", "entity_type", F.lit(0).alias("score"))
    in_obs = g.observations.groupBy("name").agg(*[F.max(contains_ci(F.col("content"), t)).alias(f"o{k}") for k, t in enumerate(tokens)])
    joined = g.entities.join(in_obs, "name", "left")
    score: Column = F.lit(0)
    held: Column = F.lit(True)
    for k, t in enumerate(tokens):
        name, kind, obs = contains_ci(F.col("name"), t), contains_ci(F.col("entity_type"), t), F.coalesce(F.col(f"o{k}"), F.lit(False))
        score = score + F.when(name, 10).otherwise(0) + F.when(kind, 5).otherwise(0) + F.when(obs, 1).otherwise(0)
        held = held & (name | kind | obs)
    return joined.where(held).select("name", "entity_type", score.alias("score"))


def search_nodes(g: Graph, query: str, limit: int = 20, most_observations: int = 5) -> DataFrame:
    top = scored_nodes(g, query).orderBy(F.desc("score"), "name").limit(limit)
    return top.join(capped_observations(g, top, most_observations), "name", "left")


def relations_of(g: Graph, found: DataFrame) -> DataFrame:
    """The relations that touch an entity found."""
    return incident(g, found).select(TRIPLE)


def with_neighbours(found: DataFrame, vectors: DataFrame, query_vector: list[float], limit: int = 10, threshold: float = 0.5) -> DataFrame:
    """name, similarity of entities like a query's vector that are not among those found; vectors(name, embedding)."""
    from tesserine.operators.semantic import top_k

    return top_k(vectors.join(found.select("name"), "name", "left_anti"), query_vector, limit, threshold, "name", "embedding")


def incident(g: Graph, names: DataFrame) -> DataFrame:
    """Relations that touch a named entity at either end, once each."""
    out = g.relations.join(names.select(F.col("name").alias("src")), "src", "left_semi")
    into = g.relations.join(names.select(F.col("name").alias("dst")), "dst", "left_semi")
    return out.select(g.relations.columns).unionByName(into.select(g.relations.columns)).dropDuplicates(TRIPLE)


def neighbours(g: Graph, name: str) -> DataFrame:
    """Relations of one entity with their direction."""
    out = g.relations.where(F.col("src") == name).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation_type")
    into = g.relations.where(F.col("dst") == name).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "relation_type")
    return out.unionByName(into)


def open_nodes(g: Graph, names: list[str], most_observations: int = 50) -> DataFrame:
    """Named entities in the order asked for; unknown names are skipped."""
    asked = g.entities.sparkSession.createDataFrame(list(enumerate(names)), "pos int, name string")
    found = asked.join(g.entities, "name")
    return found.join(capped_observations(g, found, most_observations), "name", "left").orderBy("pos")


def read_graph(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Entities with all their observations by name, and the relations."""
    listed = g.observations.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("obs_id", "content"))).alias("o")).select("name", F.col("o.content").alias("observations"))
    return g.entities.join(listed, "name", "left").orderBy("name"), g.relations


def similar_names(entities: DataFrame, name: str, threshold: float = 0.3, limit: int = 20) -> DataFrame:
    """Entities with names like the given one, by trigrams."""
    sim = trigram_similarity(F.col("name"), F.lit(name))
    return entities.select("name", F.round(sim, 3).alias("similarity"), sim.alias("s")).where(F.col("s") >= min(max(threshold, 0.0), 1.0)).orderBy(F.desc("s"), "name").limit(limit).drop("s")


def recent(g: Graph, as_of: Column, hours: int = 24, limit: int = 20, most_observations: int = 5, most_relations: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of the last hours, newest first; only observations made since then."""
    cutoff = as_of - F.make_dt_interval(hours=F.lit(min(hours, 720)))
    top = g.entities.where(F.col("updated_at") >= cutoff).orderBy(F.desc("updated_at"), "name").limit(limit)
    fresh = replace(g, observations=g.observations.where(F.col("created_at") >= cutoff))
    edges = g.relations.where(F.col("created_at") >= cutoff).orderBy(F.desc("created_at"), *TRIPLE).limit(most_relations)
    return top.join(capped_observations(fresh, top, most_observations), "name", "left"), edges


def traverse(g: Graph, start: str, depth: int = 2) -> DataFrame:
    """name, hop of entities within depth undirected steps (1 to 3) of the start; dangling ends are left out.

    """
    return _reached(g, start, min(max(depth, 1), 3)).join(g.entities.select("name"), "name", "left_semi").orderBy("hop", "name")


def _reached(g: Graph, start: str, steps: int) -> DataFrame:
    """name, hop of all names within so many steps of the start, whether entities or not.

    Only the last hop's names meet the edges, at either end, and what is repeated goes after
    that. Each hop is checkpointed, so that no hop computes the ones before it again.
    """
    spark = g.entities.sparkSession
    ensure_checkpoints(spark)
    reached = spark.createDataFrame([(start, 0)], "name string, hop int")
    for hop in range(1, steps + 1):
        last = reached.where(F.col("hop") == hop - 1).select("name")
        out = g.relations.join(last.select(F.col("name").alias("src")), "src").select(F.col("dst").alias("name"))
        into = g.relations.join(last.select(F.col("name").alias("dst")), "dst").select(F.col("src").alias("name"))
        ahead = out.unionByName(into).distinct().join(reached, "name", "left_anti")
        reached = reached.unionByName(ahead.withColumn("hop", F.lit(hop))).checkpoint()
    return reached


def traverse_edges(g: Graph, start: str, depth: int = 2) -> DataFrame:
    """src, dst, relation_type, once each: the relations that touch an entity less than depth steps away, dangling ends included."""
    return incident(g, _reached(g, start, min(max(depth, 1), 3) - 1)).select(TRIPLE)


def capped_graph(g: Graph, most: int = 800) -> Graph:
    """The most recently updated entities and what lies among them."""
    kept = g.entities.orderBy(F.desc("updated_at"), "name").limit(most)
    names = kept.select("name")
    edges = g.relations.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return Graph(kept, g.observations.join(names, "name", "left_semi"), edges)


# --- changes: each takes the graph and a batch, and gives the new graph and what was refused


def create_entities(g: Graph, batch: DataFrame, now: Column) -> tuple[Graph, DataFrame]:
    """batch(pos, name, entity_type, observations). The first of a name wins; names that exist are refused."""
    first = first_n(batch, ["name"], ["pos"], 1)
    new = first.join(g.entities.select("name"), "name", "left_anti")
    refused = batch.join(new.select("pos"), "pos", "left_anti").select("pos", "name")
    rows = new.select("name", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), now.alias("created_at"), now.alias("updated_at"), F.lit(0).cast("long").alias("revision"))
    obs = new.select("name", F.posexplode(F.array_distinct("observations")).alias("k", "content"), "pos").where("content is not null")
    obs = obs.select((F.col("pos").cast("long") * 1_000_000 + F.col("k") + _next_id(g)).alias("obs_id"), "name", "content", now.alias("created_at"))
    return replace(g, entities=g.entities.unionByName(rows), observations=g.observations.unionByName(obs)), refused


def _next_id(g: Graph) -> Column:
    last = g.observations.agg(F.max("obs_id")).first()[0]
    return F.lit((last or 0) + 1).cast("long")


def create_relations(g: Graph, batch: DataFrame, now: Column) -> tuple[Graph, DataFrame]:
    """batch(pos, src, dst, relation_type). Incomplete or repeated triples are refused; ends may dangle."""
    whole = batch.where("src is not null and dst is not null and relation_type is not null and src != '' and dst != '' and relation_type != ''")
    new = first_n(whole, TRIPLE, ["pos"], 1).join(g.relations.select(TRIPLE), TRIPLE, "left_anti")
    refused = batch.join(new.select("pos"), "pos", "left_anti").select("pos", *TRIPLE)
    return replace(g, relations=g.relations.unionByName(new.select(*TRIPLE, now.alias("created_at")))), refused


def _folded(batch: DataFrame, g: Graph) -> DataFrame:
    """Batch items by entity in order, with the entity's revision and which of the batch's contents it has: one row an entity."""
    asked = batch.select("name", F.explode("contents").alias("content")).distinct()
    held = asked.join(g.observations.select("name", "content"), ["name", "content"], "left_semi").groupBy("name").agg(F.collect_list("content").alias("held"))
    items = batch.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "contents", "expected_rev"))).alias("items"))
    return items.join(g.entities.select("name", "revision"), "name", "left").join(held, "name", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))


def add_observations(g: Graph, batch: DataFrame, now: Column) -> tuple[Graph, DataFrame]:
    """batch(pos, name, contents, expected_rev). Items of an entity apply in order.

    An item that adds nothing new is no change, whatever revision it expects. One that
    expects another revision is a conflict and is skipped. Each applied item raises the
    revision by one. The outcome of every item is returned: applied, unchanged, conflict
    or missing.
    """
    start = F.struct(F.col("revision").alias("rev"), F.col("held").alias("held"), F.array().cast("array<struct<pos:int,status:string,added:array<string>>>").alias("log"))

    def step(acc: Column, item: Column) -> Column:
        fresh = F.array_except(F.array_distinct(item["contents"]), acc["held"])
        clash = item["expected_rev"].isNotNull() & (item["expected_rev"] != acc["rev"])
        status = F.when(acc["rev"].isNull(), "missing").when(F.size(fresh) == 0, "unchanged").when(clash, "conflict").otherwise("applied")
        added = F.when(status == "applied", fresh).otherwise(F.array().cast("array<string>"))
        entry = F.struct(item["pos"].cast("int").alias("pos"), status.alias("status"), added.alias("added"))
        return F.struct(F.when(status == "applied", acc["rev"] + 1).otherwise(acc["rev"]).alias("rev"), F.concat(acc["held"], added).alias("held"), F.concat(acc["log"], F.array(entry)).alias("log"))

    done = _folded(batch, g).select("name", F.aggregate("items", start, step).alias("r"))
    log = done.select("name", F.col("r.rev").alias("rev"), F.explode("r.log").alias("e")).select("name", "rev", "e.pos", "e.status", "e.added")
    touched = log.where("status = 'applied'").groupBy("name").agg(F.max("rev").alias("rev"))
    entities = g.entities.join(touched, "name", "left").withColumn("revision", F.coalesce("rev", "revision")).withColumn("updated_at", F.when(F.col("rev").isNotNull(), now).otherwise(F.col("updated_at"))).drop("rev")
    added = log.where("status = 'applied'").select("pos", "name", F.posexplode("added").alias("k", "content"))
    rows = added.select((F.col("pos").cast("long") * 1_000_000 + F.col("k") + _next_id(g)).alias("obs_id"), "name", "content", now.alias("created_at"))
    return replace(g, entities=entities.select(g.entities.columns), observations=g.observations.unionByName(rows)), log.select("pos", "name", "status")


def delete_observations(g: Graph, batch: DataFrame) -> tuple[Graph, DataFrame]:
    """batch(pos, name, contents, expected_rev). Exact contents go; the revision rises even if none did."""
    start = F.struct(F.col("revision").alias("rev"), F.array().cast("array<struct<pos:int,status:string,gone:array<string>>>").alias("log"))

    def step(acc: Column, item: Column) -> Column:
        clash = item["expected_rev"].isNotNull() & (item["expected_rev"] != acc["rev"])
        status = F.when(acc["rev"].isNull(), "missing").when(clash, "conflict").otherwise("applied")
        entry = F.struct(item["pos"].cast("int").alias("pos"), status.alias("status"), F.when(status == "applied", item["contents"]).otherwise(F.array().cast("array<string>")).alias("gone"))
        return F.struct(F.when(status == "applied", acc["rev"] + 1).otherwise(acc["rev"]).alias("rev"), F.concat(acc["log"], F.array(entry)).alias("log"))

    done = _folded(batch, g).select("name", F.aggregate("items", start, step).alias("r"))
    log = done.select("name", F.col("r.rev").alias("rev"), F.explode("r.log").alias("e")).select("name", "rev", "e.pos", "e.status", "e.gone")
    touched = log.where("status = 'applied'").groupBy("name").agg(F.max("rev").alias("rev"))
    entities = g.entities.join(touched, "name", "left").withColumn("revision", F.coalesce("rev", "revision")).select(g.entities.columns)
    gone = log.where("status = 'applied'").select("name", F.explode("gone").alias("content")).distinct()
    return replace(g, entities=entities, observations=g.observations.join(gone, ["name", "content"], "left_anti").select(g.observations.columns)), log.select("pos", "name", "status")


def delete_entities(g: Graph, batch: DataFrame) -> tuple[Graph, DataFrame]:
    """batch(name, expected_rev). Entities go with their observations and relations; others' revisions clash."""
    known = batch.join(g.entities.select("name", "revision"), "name")
    clash = F.col("expected_rev").isNotNull() & (F.col("expected_rev") != F.col("revision"))
    gone = known.where(~clash).select("name").distinct()
    left = g.relations.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti")
    return Graph(g.entities.join(gone, "name", "left_anti"), g.observations.join(gone, "name", "left_anti"), left.select(g.relations.columns)), known.where(clash).select("name")


def delete_relations(g: Graph, batch: DataFrame) -> Graph:
    """batch(src, dst, relation_type). Without a type all relations of the pair go."""
    typed = batch.where("relation_type is not null").select(TRIPLE)
    untyped = batch.where("relation_type is null").select("src", "dst")
    return replace(g, relations=g.relations.join(typed, TRIPLE, "left_anti").join(untyped, ["src", "dst"], "left_anti").select(g.relations.columns))


def migrated(observations: DataFrame) -> DataFrame:
    """Observations without repeats: of equal ones of an entity the smallest id stays."""
    return first_n(observations, ["name", "content"], ["obs_id"], 1)
