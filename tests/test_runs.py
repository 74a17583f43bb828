"""Judged candidates with their counters, runs on kept versions of the graph, archives and command lines."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tesserine.operators import maintenance, runs
from tesserine.operators.graph import Graph

T0 = datetime.datetime(2024, 1, 1)
ENTITIES, OBS, RELS = "name string, entity_type string, created_at timestamp, updated_at timestamp, revision long", "obs_id long, name string, content string, created_at timestamp", "src string, dst string, relation_type string, created_at timestamp"


def graph_of(spark, names, obs=(), rels=()):
    entities = spark.createDataFrame([(n, t, T0, T0, 0) for n, t in names], ENTITIES)
    return Graph(entities, spark.createDataFrame([(*o, T0) for o in obs], OBS), spark.createDataFrame([(*r, T0) for r in rels], RELS))


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame([(f"x{k:03}", f"y{k:03}", k % 4, 0.5 + k / 1000, 0.5 + k / 1000) for k in range(95)], "a string, b string, shared long, similarity double, score double")


def judged(pairs, **more):
    return {r["a"]: (r["relation_type"], r["by"]) for r in maintenance.judge_pairs(pairs, **more).collect()}


def test_what_a_batch_leaves_out_is_asked_once_more(spark, pairs, tmp_path):
    log = str(tmp_path / "asked")

    def judge(batch):
        n = batch["a"].str.slice(1).astype(int)
        said = batch[n % 3 != 0]
        extra = pd.DataFrame({"a": ["zz", *batch["a"][:1]], "b": ["zz", *batch["b"][:1]]})  # an unknown pair, and one named twice
        return pd.concat([said[["a", "b"]].assign(relation_type=["invented" if k % 11 == 0 else "uses" for k in n[n % 3 != 0]]), extra.assign(relation_type="causes")])

    def single(a, b):
        with open(log, "a") as f:
            f.write(a + "\n")
        return "They are: part_of" if int(a[1:]) % 2 else None

    got = judged(pairs, judge=judge, single=single, size=20)
    first = {f"x{k:03}" for k in (94, 74, 54, 34, 14)}  # the first of each batch, best score first
    for k in range(95):
        name = f"x{k:03}"
        if k % 3 and k % 11:
            assert got[name] == ("uses", "batch")
        elif name in first:
            assert got[name] == ("causes", "batch")
        else:
            assert got[name] == (("part_of", "single") if k % 2 else (None, "none"))
    asked = open(log).read().split()
    assert len(asked) == len(set(asked)) == sum(by != "batch" for _, by in got.values())  # each at most once


def test_a_judge_that_raises_loses_no_pair(pairs):
    def broken(batch):
        raise RuntimeError("no service")

    assert set(judged(pairs, judge=broken, single=lambda a, b: "fixes it").values()) == {("fixes", "single")}
    assert set(judged(pairs, judge=broken).values()) == {(None, "none")}
    assert judged(pairs.limit(0), judge=broken) == {}


def test_types_match_in_any_case_and_counters_count_on_the_way(spark):
    g = graph_of(spark, [("a", "Bug"), ("b", "FIX"), ("c", None), ("d", ""), ("e", "plan")], [(1, "c", "mentions D here")])
    ranked = spark.createDataFrame([("a", "b", 3, 0.9, 0.9), ("c", "d", 3, 0.1, 0.1), ("a", "e", 3, 0.6, 0.6), ("b", "e", 1, 0.2, 0.2)], "a string, b string, shared long, similarity double, score double")
    health = Observation("h")
    out = maintenance.validate(g, ranked, judge=lambda batch: batch[["a", "b"]].assign(relation_type="uses"), health=health)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "b", "fixes", 0.9), ("a", "e", "uses", 0.6), ("c", "d", "references", 0.1)]
    assert health.get == {"candidates_in": 4, "weak": 1, "named_by_rules": 2, "batch_calls_attempted": 1, "batch_calls_succeeded": 1, "named_by_batch": 1, "single_pair_fallbacks": 0, "single_pair_returns_none": 0}
    alone = Observation("alone")
    assert maintenance.validate(g, ranked, health=alone).count() == 2 and alone.get["candidates_in"] == 4


@pytest.mark.parametrize(("reply", "kind"), [("a uses b or depends_on b", "depends_on"), ("USES", "uses"), ("misuses", None), ("uses causes", "causes"), ("contains causes implements", "implements"), ("references; implements", "implements"), (None, None), ("", None)])
def test_the_longest_type_of_a_reply(spark, reply, kind):
    assert maintenance.allowed_type(reply) == kind
    assert spark.createDataFrame([(reply,)], "r string").select(maintenance.parse_relation_type(F.col("r")).alias("k")).first()["k"] == kind


def test_pairs_of_a_chunk_only(spark):
    g = graph_of(spark, [(f"n{k:02}", "t") for k in range(12)], [(k, f"n{k:02}", f"alpha beta gamma{k % 4}") for k in range(12)])
    got = maintenance.chunk_candidates(g, 6, most=4).collect()
    assert {r["chunk"] for r in got} == {0, 1} and all(int(r["a"][1:]) // 6 == int(r["b"][1:]) // 6 == r["chunk"] for r in got)
    assert [r["shared"] for r in got if r["chunk"] == 0] == [3, 3, 2, 2]
    assert maintenance.chunk_candidates(g, 6, most=100).count() == 30


# --- runs


@pytest.fixture()
def graphs(spark, tmp_path):
    store = runs.GraphStore(spark, str(tmp_path / "graph"))
    store.commit(graph_of(spark, [("alpha", "concept"), ("beta", "concept"), ("gamma", "concept")], [(1, "alpha", "shared words here"), (2, "beta", "shared words too"), (3, "gamma", "other")], [("gamma", "alpha", "uses")]))
    return store


def related(kind):
    return lambda batch: batch[["a", "b"]].assign(relation_type=kind)


def triples(g):
    return sorted((r["src"], r["dst"], r["relation_type"]) for r in g.relations.collect())


def test_a_run_is_replayed_on_its_own_graph(spark, graphs, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"), graphs)
    run = store.create("r1", note="first")
    first = triples(store.run(run, judge=related("causes"), now=F.lit(T0)))
    assert first == [("alpha", "beta", "causes"), ("gamma", "alpha", "uses")] and store.record(run)["note"] == "first"
    graphs.commit(graph_of(spark, [("omega", "concept")]))
    graphs.store.expire(keep=1, grace=0)
    assert triples(store.run(run, from_stage="validate", judge=related("contains"), now=F.lit(T0))) == [("alpha", "beta", "contains"), ("gamma", "alpha", "uses")]
    assert triples(store.run(run, from_stage="apply", now=F.lit(T0))) == [("alpha", "beta", "contains"), ("gamma", "alpha", "uses")]
    assert triples(graphs.read()) == []  # the live graph is as it was
    other = store.create()
    assert store.runs() == sorted([other, "r1"], reverse=True)
    for wrong in (lambda: store.create("r1"), lambda: store.run("none"), lambda: store.run(other, from_stage="rank"), lambda: store.run(run, from_stage="publish")):
        with pytest.raises(ValueError):
            wrong()
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    assert store.create(store.new_id(at)) == "20240506T070809Z" and store.new_id(at) == "20240506T070809Z-2"
    version = store.record(run)["version"]
    store.remove(run)
    graphs.store.expire(keep=1, grace=0)
    assert version not in graphs.store.versions()


def test_what_others_changed_meanwhile_stays(spark, graphs, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"), graphs)
    run = store.create("r")
    planned = store.run(run, judge=related("causes"), now=F.lit(T0))
    live = graphs.read()
    extra = graph_of(spark, [("delta", "new")], [(9, "delta", "late")], [("delta", "alpha", "uses")])
    graphs.commit(Graph(live.entities.where("name != 'beta'").unionByName(extra.entities), live.observations.unionByName(extra.observations), live.relations.unionByName(extra.relations)))
    counts = store.apply(run, planned)
    assert counts["relations.insert"] == 1 and store.record(run)["applied"] == graphs.version()
    assert triples(graphs.read()) == [("alpha", "beta", "causes"), ("delta", "alpha", "uses"), ("gamma", "alpha", "uses")]
    assert sorted(r["name"] for r in graphs.read().entities.collect()) == ["alpha", "delta", "gamma"]


def test_archives_of_a_stored_graph(spark, graphs, tmp_path):
    now = F.lit(T0 + datetime.timedelta(days=100))
    path = str(tmp_path / "archive")
    assert runs.archive_graph(graphs, now, path) == {"archived": 3, "total_before": 3, "backup_version": None, "deleted": 0, "index_rebuilt": False}
    done = runs.archive_graph(graphs, now, path, apply=True, embed=lambda texts: [[float(len(t)), 1.0] for t in texts], vectors=str(tmp_path / "v"))
    assert done == {"archived": 3, "total_before": 3, "backup_version": 1, "deleted": 3, "index_rebuilt": True}
    assert graphs.read().observations.count() == 0 and spark.read.json(path).count() == 3
    graphs.store.expire(keep=1, grace=0)
    assert graphs.read(1).observations.count() == 3  # the backup
    assert {r["revision"] for r in graphs.read().entities.collect()} == {1}
    assert runs.archive_graph(graphs, now, path + "2", apply=True)["archived"] == 0
    with pytest.raises(ValueError):
        runs.archive_graph(graphs, now, path, days=-1)
