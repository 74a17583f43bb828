"""Pairs of owners by shared tokens, whole and the best of them, against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tesserine.operators import maintenance
from tesserine.operators.graph import Graph


def frame(spark, held):
    return spark.createDataFrame([(n, t) for n, ts in held.items() for t in sorted(ts)], "name string, token string").repartition(3)


def ranked(held, least=2, known=frozenset()):
    pairs = [(-len(held[a] & held[b]), a, b) for a, b in itertools.combinations(sorted(held), 2) if len(held[a] & held[b]) >= least and (a, b) not in known]
    return [(a, b, -n) for n, a, b in sorted(pairs)]


def owners(seed, kinds, copies):
    """Owners with tokens of their own beside lists that many have, and near copies of these."""
    rnd = random.Random(seed)
    lists = [{f"t{min(rnd.randrange(40), rnd.randrange(80))}" for _ in range(rnd.randrange(1, 14))} for _ in range(kinds)]
    held = {}
    for k in range(kinds * copies):
        base = set(lists[rnd.randrange(kinds)])
        held[f"n{rnd.randrange(10**6):06d}{k}"] = base - {rnd.choice(sorted(base))} | {f"own{k}"} if rnd.random() < 0.3 else base | {f"own{k}"}
    return held


@pytest.mark.parametrize(("seed", "kinds", "copies", "many"), [(1, 60, 1, 0), (2, 25, 5, 3), (4, 1, 90, 2_000)])
def test_best_pairs_equal_the_first_of_all(spark, monkeypatch, seed, kinds, copies, many):
    monkeypatch.setattr(maintenance, "MANY_CLASSES", many)
    held = owners(seed, kinds, copies)
    df, want = frame(spark, held), ranked(held)
    for most in (7, 80):
        assert [tuple(r)[:3] for r in maintenance.best_shared(df, most).collect()] == want[:most], most


def test_best_pairs_without_related_ones(spark):
    held = owners(5, 4, 12)
    want = ranked(held)
    gone = want[:90] + want[95:100]
    known = spark.createDataFrame([(b, a) if k % 2 else (a, b) for k, (a, b, _) in enumerate(gone)], "src string, dst string")
    got = [tuple(r)[:3] for r in maintenance.best_shared(frame(spark, held), 10, relations=known).collect()]
    assert got == [p for p in want if p not in gone][:10]
    everything = spark.createDataFrame([(a, b) for a, b, _ in want], "src string, dst string")
    assert maintenance.best_shared(frame(spark, held), 10, relations=everything).count() == 0


def test_candidates_of_many_alike_entities(spark):
    """4,000 entities that share their words: 8 million pairs, of which 80 are wanted. Their own words, which nobody shares, make no lists of their own."""
    rows = spark.range(4_000).select(F.format_string("e%04d", "id").alias("name"), F.concat(F.lit("common words here "), F.col("id").cast("string")).alias("content"), F.col("id").alias("obs_id"))
    none = spark.createDataFrame([], "src string, dst string, relation_type string, created_at timestamp")
    g = Graph(rows.select("name", F.lit("plan").alias("entity_type")), rows, none.unionByName(spark.createDataFrame([("e0001", "e0000", "uses", None)], none.schema)))
    found = maintenance.discover(g)["candidates"].collect()
    assert [(r["a"], r["b"], r["shared"]) for r in found] == [("e0000", f"e{k:04d}", 3) for k in range(2, 82)]
    assert found[0]["signals"] == ["common", "words", "here"]


def test_shared_tokens_over_chunks_of_a_class(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "CHUNK_MEMBERS", 7)
    monkeypatch.setattr(maintenance, "TASK_PAIRS", 500)
    held = owners(6, 3, 30)
    made = maintenance.shared_tokens(frame(spark, held), least=3, joined="+")
    got = made.collect()
    assert sorted((r["a"], r["b"], r["shared"]) for r in got) == sorted(ranked(held, 3))
    for r in got:
        assert r["signals"] == "+".join(sorted(held[r["a"]] & held[r["b"]], key=lambda t: (-len(t), t))[:4])
    assert made.rdd.getNumPartitions() > 4
