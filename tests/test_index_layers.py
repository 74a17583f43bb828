"""Differences and layers of postings without shuffles of postings, against sets."""

import random

from pyspark.sql import functions as F

from tesserine.operators import postings

SHAPE = "token string, file_idx long, entry_idx int"


def keys(df):
    return sorted((r["token"], r["file_idx"], r["entry_idx"]) for r in df.collect())


def some(rnd, n):
    return {(rnd.choice("abcdef"), rnd.randrange(9), rnd.randrange(4)) for _ in range(n)}


def test_layers_equal_sets(spark):
    rnd = random.Random(5)
    old, new = some(rnd, 60), some(rnd, 60)
    o, n = (spark.createDataFrame(sorted(x), SHAPE).repartition(3) for x in (old, new))
    delta = postings.diff_postings(o, n, 4)
    assert {(r["op"], r["token"], r["file_idx"], r["entry_idx"]) for r in delta.collect()} == {("DEL", *k) for k in old - new} | {("ADD", *k) for k in new - old}
    assert keys(postings.layered(o, delta)) == sorted(new)
    undo = delta.withColumn("op", F.when(F.col("op") == "ADD", "DEL").otherwise("ADD")).withColumn("seq", F.lit(7).cast("long"))
    assert keys(postings.layered(o, undo.unionByName(delta))) == sorted(old)
    assert keys(postings.layered(o, delta.limit(0))) == sorted(old)


def test_postings_dealt_out_by_file_are_not_shuffled(spark):
    rows = [(k, e, f"word{k % 7} word{e} Same same other-{k}") for k in range(40) for e in range(3)]
    entries = spark.createDataFrame(rows, "file_idx long, entry_idx int, text string")
    old, new = (postings.build(df.repartition("file_idx")) for df in (entries.where("file_idx % 3 = 0").withColumn("text", F.lit("old words")), entries))
    held = postings.counts_by_file(postings.layered(old, postings.diff_postings(old, new, 1)))
    assert {tuple(r) for r in held.collect()} == {tuple(r) for r in postings.build(entries).groupBy("file_idx").agg(F.count("*"), F.count_distinct("token")).collect()}
    plan = held._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if " Exchange " in line]
    assert moved and all("hashpartitioning(file_idx" in line and "REPARTITION_BY_COL" in line for line in moved)


def test_new_changed_and_removed_files_folded(spark, tmp_path):
    def tables(texts, modified):
        files = spark.createDataFrame([(f, 0, modified.get(f, 0), len(t)) for f, t in texts.items()], "file string, file_idx long, modified int, size long")
        lines = spark.createDataFrame([(f, 0, e, x) for f, t in texts.items() for e, x in enumerate(t.split("\n"))], "file string, file_idx long, entry_idx int, text string")
        return lines, files

    first = {"a": "one two\nthree", "b": "two two four", "c": "gone words"}
    index = postings.PostingsIndex(spark, str(tmp_path / "index"))
    lines, files = tables(first, {})
    number = F.when(F.col("file") == "a", 0).when(F.col("file") == "b", 1).otherwise(2).cast("long")
    index.create(lines.withColumn("file_idx", number), files.withColumn("file_idx", number).withColumn("tombstoned", F.lit(False)))
    second = {"a": "one two\nthree", "b": "two five\nsix", "d": "new words\nnew lines"}
    done = index.update(*tables(second, {"b": 1}), defer_compact=True)
    assert (done["unchanged"], done["updated"], done["added"], done["removed"]) == (1, 1, 1, 1)
    want = sorted((t, f, e) for f, text in ((0, second["a"]), (1, second["b"]), (3, second["d"])) for e, x in enumerate(text.split("\n")) for t in set(x.split()))
    assert keys(index.postings()) == want == keys(index.postings(by_file=True))
    index.compact()
    assert index.store.is_empty("delta") and keys(index.store.read("base")) == want == keys(index.postings(by_file=True))
    assert {tuple(r) for r in postings.counts_by_file(index.postings(by_file=True)).collect()} == {(0, 3, 3), (1, 3, 3), (3, 4, 3)}
