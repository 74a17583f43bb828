"""The graph as versions, and maintenance runs that keep the version they began with."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.archive import archive
from tesserine.operators.graph import TRIPLE, Graph
from tesserine.operators.maintenance import STAGES, Judge, Single, reconcile, run_stages
from tesserine.operators.records import embed_entities, store_vectors
from tesserine.plans.snapshot import SnapshotStore


class GraphStore:
    """Entities, observations and relations of a graph, committed together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = SnapshotStore(spark, root)

    def version(self) -> int:
        return self.store.version()

    def read(self, version: int | None = None) -> Graph:
        """The graph as it is, or as of a version."""
        held = self.store if version is None else self.store.at(version)
        return Graph(held.read("entities"), held.read("observations"), held.read("relations"))

    def commit(self, g: Graph, expected: int | None = None) -> int:
        return self.store.commit({"entities": g.entities, "observations": g.observations, "relations": g.relations}, expected)


def rebase(observed: Graph, planned: Graph, live: Graph) -> tuple[Graph, DataFrame]:
    """live with what leads from observed to planned, and part, action, n of all rows: rows that others changed meanwhile stay as they are."""

    def moved(o: DataFrame, p: DataFrame, v: DataFrame, keys: list[str], part: str) -> tuple[DataFrame, DataFrame]:
        rest = [c for c in v.columns if c not in keys]
        packed = [df.select(*keys, F.struct(*rest).alias("row")) for df in (o, p, v)]
        actions = reconcile(*packed, keys, "row")
        written = actions.where("action in ('insert', 'update')").select(*keys, *[F.col(f"p.{c}").alias(c) for c in rest])
        kept = v.join(actions.where("action in ('update', 'delete')").select(keys), keys, "left_anti")
        return kept.unionByName(written.select(v.columns)), actions.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "action", "n")

    entities, e = moved(observed.entities, planned.entities, live.entities, ["name"], "entities")
    observations, o = moved(observed.observations, planned.observations, live.observations, ["obs_id"], "observations")
    relations, r = moved(observed.relations, planned.relations, live.relations, TRIPLE, "relations")
    return Graph(entities, observations, relations), e.unionByName(o).unionByName(r)


class RunStore:
    """Maintenance runs below a folder. A run pins the graph's version, so it can be run again on its own graph whatever becomes of the live one."""

    def __init__(self, spark: SparkSession, root: str, graphs: GraphStore):
        self.spark, self.root, self.graphs = spark, root.rstrip("/"), graphs
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def folder(self, run_id: str) -> str:
        return f"{self.root}/{run_id}"

    def runs(self) -> list[str]:
        """The runs, newest names first."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        return sorted((r for r in found if self._fs.exists(self._path(f"{self.folder(r)}/RUN.json"))), reverse=True)

    def new_id(self, now: datetime.datetime | None = None) -> str:
        """A run's name out of the time, with -2, -3 and so on if there are such runs already."""
        base = (now or datetime.datetime.now(datetime.UTC)).strftime("%Y%m%dT%H%M%SZ")
        names = [base, *(f"{base}-{k}" for k in range(2, 10_000))]
        return next(n for n in names if not self._fs.exists(self._path(self.folder(n))))

    def create(self, run_id: str | None = None, **noted) -> str:
        """A new run on the graph as it is now; what is noted goes into its record. A run of that name is refused."""
        run_id = run_id or self.new_id()
        if self._fs.exists(self._path(self.folder(run_id))):
            raise ValueError(f"there is a run {run_id!r}")
        version = self.graphs.store.pin(f"run-{run_id}")
        self._fs.mkdirs(self._path(self.folder(run_id)))
        self._record(run_id, {"run_id": run_id, "version": version, "stages": [], "applied": None} | noted)
        return run_id

    def record(self, run_id: str) -> dict:
        path = self._path(f"{self.folder(run_id)}/RUN.json")
        if not self._fs.exists(path):
            raise ValueError(f"no run {run_id!r}")
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _record(self, run_id: str, record: dict) -> None:
        self.graphs.store._write(self._path(f"{self.folder(run_id)}/RUN.json"), json.dumps(record, sort_keys=True))

    def run(
        self, run_id: str, from_stage: str = "discover", mapping: DataFrame | None = None, rules: DataFrame | None = None, similarities: DataFrame | None = None, now: Column | None = None, judge: Judge | None = None,
        single: Single | None = None, health: Observation | None = None,
    ) -> Graph:
        """The run's stages on its own graph from a stage on; those before it must have run and are read back. Nothing of the live graph is read or changed."""
        record = self.record(run_id)
        if from_stage not in STAGES:
            raise ValueError(f"no stage {from_stage!r}")
        if missing := [s for s in STAGES[: STAGES.index(from_stage)] if s not in record["stages"]]:
            raise ValueError(f"run {run_id!r} has no {missing[0]}")
        planned = run_stages(self.spark, self.graphs.read(record["version"]), self.folder(run_id), mapping, rules, similarities, from_stage, now, judge, single, health)
        self._record(run_id, record | {"stages": STAGES})
        return planned

    def apply(self, run_id: str, planned: Graph) -> dict[str, int]:
        """Commits what a run has planned. If the live graph has moved on, its changes stay; how many rows came to what, by part and action."""
        record = self.record(run_id)
        live = self.graphs.version()
        done, counts = rebase(self.graphs.read(record["version"]), planned, self.graphs.read(live))
        actions = {f"{r['part']}.{r['action']}": r["n"] for r in counts.collect()}
        self._record(run_id, record | {"applied": self.graphs.commit(done, expected=live)})
        return actions

    def remove(self, run_id: str) -> None:
        """Forgets a run; its version is kept no longer than others are."""
        self.record(run_id)
        self.graphs.store.unpin(f"run-{run_id}")
        self._fs.delete(self._path(self.folder(run_id)), True)


def archive_graph(
    graphs: GraphStore, now: Column, path: str, days: int = 90, apply: bool = False, embed: Callable[[list[str]], list[list[float]]] | None = None, vectors: str | None = None, backup: str = "archive-backup",
) -> dict[str, int | bool | None]:
    """Moves observations older than so many days out of the stored graph into JSON lines; without apply it only counts.

    The archive is written first, then the graph's version is pinned as a backup, then the
    graph without them is committed as a whole, and last the vectors are made anew, if a
    callable that embeds and a folder for them are given.
    """
    if days < 0:
        raise ValueError("days must not be negative")
    version = graphs.version()
    g = graphs.read(version)
    total = g.observations.count()
    done, old = archive(g, now, path, days, apply=False)
    found = old.count()
    summary: dict[str, int | bool | None] = {"archived": found, "total_before": total, "backup_version": None, "deleted": 0, "index_rebuilt": False}
    if not found or not apply:
        return summary
    done, _ = archive(g, now, path, days, apply=True)
    summary["backup_version"] = graphs.store.pin(backup, version)
    graphs.commit(done, expected=version)
    summary["deleted"] = total - graphs.read().observations.count()
    if embed is not None and vectors is not None:
        store_vectors(graphs.spark, vectors, embed_entities(graphs.read(), embed))
        summary["index_rebuilt"] = True
    return summary
