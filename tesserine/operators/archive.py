"""The archiver: old observations leave the graph for JSON lines, written before the graph changes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.graph import Graph


def split_by_age(observations: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(live, old): old is strictly before the cutoff; without a time an observation stays."""
    old = F.coalesce(F.col("created_at") < as_of - F.make_dt_interval(days=F.lit(days)), F.lit(False))
    return observations.where(~old), observations.where(old)


def archive(g: Graph, as_of: Column, path: str, days: int = 90, apply: bool = False) -> tuple[Graph, DataFrame]:
    """The graph without old observations and what was archived. A dry run changes nothing.

    Each touched entity's revision rises once; entities and relations stay.
    """
    live, old = split_by_age(g.observations, as_of, days)
    if not apply:
        return g, old
    old.select(F.col("name").alias("entity"), "content", F.col("created_at")).write.mode("error").json(path)
    touched = old.select("name").distinct().withColumn("bump", F.lit(1))
    entities = g.entities.join(touched, "name", "left").withColumn("revision", F.col("revision") + F.coalesce("bump", F.lit(0)))
    return replace(g, entities=entities.select(g.entities.columns), observations=live), old
