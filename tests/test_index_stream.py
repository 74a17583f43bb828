"""True lines of the index, line ranges, keyed state, late rows, bucketed tables and kept versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tesserine.operators import postings, predicates, search
from tesserine.plans.snapshot import Append, Buckets, SnapshotStore, bucket_of
from tesserine.sources import readers
from tesserine.streaming import events as ev
from tesserine.streaming import state

LINES = "file string, line_no int, line string"


def as_lines(spark, files):
    return spark.createDataFrame([(f, k, t) for f, texts in files.items() for k, t in enumerate(texts, 1)], LINES)


def manifest_of(spark, files, modified=1):
    return spark.createDataFrame([(f, k, modified, len(t), False) for k, (f, t) in enumerate(sorted(files.items()))], "file string, file_idx long, modified int, size int, tombstoned boolean")


def numbered_entries(spark, files):
    return readers.jsonl_entries(as_lines(spark, files)).select("file", "entry_idx", "line_no", "text")


FILES = {"a": ["first", "", "needle here", "   ", "", '{"content": "more needle"}', "last"], "b": ["", "", "needle"], "c": ["nothing"]}


@pytest.fixture()
def index(spark, tmp_path):
    made = postings.PostingsIndex(spark, str(tmp_path / "i"))
    files = manifest_of(spark, FILES)
    made.create(numbered_entries(spark, FILES).join(files.select("file", "file_idx"), "file"), files)
    return made


def found(result):
    return sorted((r["file"], r["line_no"], r["line"], r["before"], r["after"]) for r in result.collect())


def test_hits_have_their_true_lines(spark, index):
    asked = []
    lines = as_lines(spark, FILES)

    def of(files):
        asked.append(files)
        return lines.where(F.col("file").isin(files))

    for k in (0, 1, 2):
        mine = search.search({"d": search.Lines(lines, of)}, "needle", indexes={"d": index}, context_lines=k)
        scanned = search.search({"d": lines}, "needle", context_lines=k)
        assert found(mine) == found(scanned)
    assert [r[:2] for r in found(mine)] == [("a", 3), ("a", 6), ("b", 3)]
    assert asked == [["a", "b"]] * 3  # no other file is read
    assert found(search.search({"d": search.Lines(lines, of)}, "needle", indexes={"d": index}, max_results=5_000)) == found(search.search({"d": lines}, "needle"))
    assert search.search({"d": lines}, "nowhere", indexes={"d": index}).count() == 0


def test_only_shown_files_pass_the_split(spark, index, tmp_path):
    texts = spark.createDataFrame([(f, "\n".join(t)) for f, t in FILES.items()], "file string, text string")
    texts.write.parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    lines = search.Lines(readers.lines_of(stored, "text"), lambda files: readers.lines_of(stored.where(F.col("file").isin(files)), "text"))
    plan = search.search({"d": lines}, "needle", indexes={"d": index})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") + plan.count("Generate posexplode") == 2  # lines and the list of lines asked for
    assert "file" in plan and " IN (a,b)" in plan


def test_lines_follow_changes_of_their_file(spark, index):
    moved = dict(FILES, a=["", *FILES["a"]], d=["", "needle too"])
    del moved["b"]
    index.update(numbered_entries(spark, moved), manifest_of(spark, moved, 1).withColumn("modified", F.when(F.col("file") == "a", 2).otherwise(1)), defer_compact=True)
    delta = index.store.read("delta")
    assert delta.join(index.live_files().where("file = 'a'"), "file_idx").count() == 0  # the same entries: lines move, postings stay
    want = [("a", 4), ("a", 7), ("d", 2)]
    for _ in range(2):
        assert sorted((r["file"], r["line_no"]) for r in index.with_lines(index.search(["needle"])).collect()) == want
        index.compact()
    assert index.store.read("lines").count() == 3


def test_partial_updates_leave_other_files_alone(spark, index):
    some = {"e": ["needle e"], "c": ["nothing", "needle c"]}
    done = index.update(numbered_entries(spark, some), manifest_of(spark, some, 3), defer_compact=True, complete=False, marks={"s": 4})
    assert (done["added"], done["updated"], done["removed"], done["total_slots"]) == (1, 1, 0, 4) and index.store.marks() == {"s": 4}
    assert {r["file"] for r in index.search(["needle"]).collect()} == {"a", "b", "c", "e"}


def test_a_frequent_token_lies_in_many_ranges(spark):
    many = spark.range(20_000).select(F.lit("the").alias("token"), "id", F.lit(0).alias("entry_idx")).withColumnRenamed("id", "file_idx")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    sizes = [r["count"] for r in postings.in_order(many.select(*postings.KEY)).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 15_000


# --- line ranges


def test_turns_of_lines_in_a_long_file(spark, monkeypatch):
    monkeypatch.setattr(search, "BIN", 1)  # ranges of 1,024 lines, crossed by long turns
    starts = [10]
    rnd = random.Random(2)
    while len(starts) < 100_000:
        starts.append(starts[-1] + rnd.choice([1, 2, 3]) + (5_000 if len(starts) % 9_000 == 0 else 0))
    turns = spark.createDataFrame([("f", k, a, b - 1 - (k % 7 == 0 and b - a > 1)) for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False))], "file string, turn_no long, line_start int, line_end int").repartition(4)
    hits = spark.range(1, starts[-1], 3).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line_no"), F.lit("x").alias("line"))
    got = search.turn_of_line(hits, turns)
    assert got.columns == ["file", "line_no", "line", "turn_no", "line_start", "line_end"]
    import bisect

    ends = [b - 1 - (k % 7 == 0 and b - a > 1) for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
    want = set()
    for n in range(1, starts[-1], 3):
        k = bisect.bisect_right(starts, n) - 1
        if 0 <= k < len(ends) and n <= ends[k]:
            want.add((n, k))
    assert {(r["line_no"], r["turn_no"]) for r in got.select("line_no", "turn_no").collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_turns_of_lines_edges(spark):
    turns = spark.createDataFrame([("f", 1, 5, 5), ("f", 2, 6, 400_000), ("g", 1, 1, 2)], "file string, turn_no int, line_start int, line_end int")
    hits = spark.createDataFrame([("f", 4), ("f", 5), ("f", 5), ("f", 399_999), ("f", 400_001), ("h", 1), ("g", 2)], "file string, line_no int")
    assert sorted((r["file"], r["line_no"], r["turn_no"]) for r in search.turn_of_line(hits, turns).collect()) == [("f", 5, 1), ("f", 5, 1), ("f", 399_999, 2), ("g", 2, 1)]
    with pytest.raises(ValueError):
        search.turn_of_line(hits.withColumn("turn_no", F.lit(1)), turns)


# --- keyed state

MESSAGES = "conv_id long, turn long, role string, text string, ts timestamp"
T0 = datetime.datetime(2024, 1, 1)


def parts(spark, rows, schema, folder, sizes):
    at = 0
    for k, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{k}")
        at += n
        yield spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def uses():
    return F.contains("text", F.lit("h")), F.contains("text", F.lit("s"))


def latest(old, new):
    return new if old is None else old.join(new.select("conv_id"), "conv_id", "left_anti").unionByName(new)


def test_gates_from_batches_in_any_order(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", None]), rnd.choice(["h", "s", "", "hs"]), T0) for c in range(40) for t in range(rnd.randrange(9))]
    rnd.shuffle(rows)
    rows += rows[:10]  # repeated messages change nothing
    store = SnapshotStore(spark, str(tmp_path / "store"))
    n = len(rows)
    for stream in parts(spark, rows, MESSAGES, str(tmp_path / "in"), [n // 3, n // 3, n - 2 * (n // 3)]):
        gates = state.session_gates(stream, *uses())
        ev.ingest(gates, store, latest, "gates", str(tmp_path / "c"), keys=["conv_id"], buckets=4, mode="update").awaitTermination()
    want = {r["conv_id"]: r["denied"] for r in predicates.first_turn_gate(spark.createDataFrame(rows, MESSAGES).distinct(), *uses()).collect()}
    assert {r["conv_id"]: r["denied"] for r in store.read("gates").collect()} == want


def test_turns_take_messages_in_any_order():
    for seed in range(300):
        rnd = random.Random(seed)
        messages = [(t, rnd.random() < 0.4, rnd.random() < 0.4, rnd.random() < 0.3) for t in range(rnd.randrange(7))]
        users = [t for t, u, _, _ in messages if u]
        last = max(users, default=None)
        heavy, found_ = ([t for t, u, *used in messages if not u and used[k]] for k in (0, 1))
        earlier = last is not None and any(t < last for t in heavy + found_)
        h, s = ([t for t in x if last is not None and t > last] for x in (heavy, found_))
        want = bool(last is not None and not earlier and h and (not s or min(s) > min(h)))
        turns = state.Turns()
        for m in rnd.sample(messages, len(messages)):
            turns = state.Turns(*turns.row())
            turns.take(*m)
        assert turns.denied() == want, (seed, messages)


def test_idle_sessions_are_closed_by_a_timer(spark, tmp_path):
    hour = datetime.timedelta(hours=1)
    rows = [(1, 0, "user", "", T0), (1, 1, "assistant", "h", T0), (2, 0, "user", "", T0 + 9 * hour), (2, 1, "assistant", "s", T0 + 10 * hour), (2, 2, "user", "", T0 + 20 * hour)]
    out = []
    for stream in parts(spark, rows, MESSAGES, str(tmp_path / "in"), [2, 2, 1]):
        gates = state.session_gates(stream.withWatermark("ts", "1 minute"), *uses(), idle="3 hours")
        query = gates.writeStream.outputMode("update").foreachBatch(lambda df, k: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert (1, 0, True, True) in out and [r[3] for r in out if r[0] == 1] == [False, True]
    assert (2, 2, False, False) in out


def test_hooks_pause_and_wait_for_growth(spark, tmp_path):
    rnd = random.Random(4)
    rows, at, counts = [], T0, {"a": [0, 0], "b": [0, 0]}
    for _ in range(90):
        at += datetime.timedelta(minutes=rnd.randrange(1, 40))
        hook = rnd.choice("ab")
        counts[hook][0] += rnd.choice([0, 1, 2, -1])
        counts[hook][1] += rnd.choice([0, 0, 3])
        rows.append((hook, at, *counts[hook]))
    store = SnapshotStore(spark, str(tmp_path / "s"))
    schema = "hook string, ts timestamp, n_entities long, n_observations long"
    for stream in parts(spark, rows, schema, str(tmp_path / "in"), [30, 30, 30]):
        ev.ingest(state.hook_gates(stream, 3_600, 4), store, lambda old, new: new if old is None else old.unionByName(new), "d", str(tmp_path / "c"), keys=["hook"], buckets=2).awaitTermination()
    held, want = {}, []
    for hook, ts, e, o in rows:
        last, le, lo = held.get(hook, (None, 0, 0))
        if last and (ts - last).total_seconds() < 3_600:
            want.append((hook, ts, 0, "throttled"))
            continue
        growth = max(e - le, 0) + max(o - lo, 0)
        held[hook] = ts, e, o
        want.append((hook, ts, growth, "run" if growth >= 4 else "idle"))
    assert sorted(tuple(r) for r in store.read("d").collect()) == sorted(want)
    assert {d for *_, d in want} == {"run", "idle", "throttled"}


# --- late rows

EVENTS = "ts timestamp, event_type string, value double"


def test_windows_and_late_rows_are_all_rows(spark, tmp_path):
    rnd = random.Random(6)
    minute = datetime.timedelta(minutes=1)
    rows = []
    for batch in range(4):
        rows += [(T0 + minute * (batch * 300 + rnd.randrange(300) - (800 if rnd.random() < 0.2 else 0)), rnd.choice("xy"), 1.0) for _ in range(50)]
    rows[7] = (None, "x", 1.0)
    store = SnapshotStore(spark, str(tmp_path / "s"))
    own = []
    for k, stream in enumerate(parts(spark, rows, EVENTS, str(tmp_path / "in"), [50] * 4)):
        ev.window_stream(stream, store, "1 hour", "event_type", "2 hours", str(tmp_path / "c"), buckets=4).awaitTermination()
        # Spark's own aggregation over the same batches gives the same windows once they have closed
        marked = stream.where("ts is not null").withWatermark("ts", "2 hours")
        query = ev.tumbling(marked, "1 hour", "event_type").writeStream.foreachBatch(lambda df, _: own.extend((r["start"], r["event_type"], r["n"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "own")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert k < 2 or store.read("windows_late").count() > 0
    windows = {(r["start"], r["event_type"]): r["n"] for r in store.read("windows").collect()}
    late = store.read("windows_late")
    assert sum(windows.values()) + late.count() == len(rows) and late.where("ts is null").count() == 1
    assert own and all(windows[s, k] == n for s, k, n in own)
    before = store.version()
    ev.window_stream(spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), store, "1 hour", "event_type", "2 hours", str(tmp_path / "c")).awaitTermination()
    assert store.version() == before


# --- tables in buckets, kept versions


def folder_bytes(root):
    return {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in root.iterdir() if p.is_dir()}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "t"))

    def upsert(old, new):
        return new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new)

    whole = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store.merge("t", whole, ["k"], upsert, buckets=32)
    first = set(folder_bytes(tmp_path / "t"))
    store.merge("t", whole.where("k in (3, 4)").withColumn("v", F.lit("new")).unionByName(spark.createDataFrame([(-1, "come")], "k long, v string")), ["k"], upsert, buckets=32)
    sizes = folder_bytes(tmp_path / "t")
    assert sum(sizes[n] for n in first) > 8 * sum(sizes[n] for n in set(sizes) - first)
    rows = {r["k"]: r["v"] for r in store.read("t").collect()}
    assert len(rows) == 20_001 and (rows[3], rows[4], rows[-1]) == ("new", "new", "come") and rows[5] == whole.where("k = 5").first()["v"]
    store.merge("t", whole.where("k = 3").limit(1), ["k"], lambda old, new: old.join(new.select("k"), "k", "left_anti"), buckets=32)
    assert store.read("t").count() == 20_000 and store.at(2).read("t").count() == 20_001
    with pytest.raises(ValueError):
        store.merge("t", whole.limit(1), ["k"], upsert, buckets=8)
    with pytest.raises(ValueError):
        store.commit({"t": Buckets(whole, ("k",), (1,), 32)})
    assert whole.select(bucket_of(("k",), 32).alias("b")).distinct().count() == 32


def test_versions_are_kept_pinned_and_removed(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "t"))
    for n in range(1, 6):
        store.commit({"t": spark.range(n), "log": Append(spark.range(1))})
    assert store.versions() == [1, 2, 3, 4, 5] and store.read("log").count() == 5
    store.pin("run", 2)
    gone = store.expire(keep=1, grace=0)
    assert store.versions() == [2, 5] and len([g for g in gone if g.startswith("t-")]) == 3
    assert store.at(2).read("t").count() == 2 and store.at(2).read("log").count() == 2 and store.read("log").count() == 5
    for wrong in (lambda: store.at(3).read("t"), lambda: store.at(2).commit({"t": spark.range(1)}), lambda: store.pin("x", 4)):
        with pytest.raises(ValueError):
            wrong()
    store.unpin("run")
    store.expire(keep=1, grace=0)
    assert store.versions() == [5] and store.pins() == {}
    assert store.expire(keep=1, grace=600) == []


def test_an_index_grows_by_a_stream_of_files(spark, tmp_path):
    folder, index = tmp_path / "logs", postings.PostingsIndex(spark, str(tmp_path / "i"))
    folder.mkdir()
    for batch in range(3):
        for k in range(3):
            (folder / f"log-2024-01-0{batch + 1}-{k}.jsonl").write_text('\n{"content": "needle %d"}\n\nneedle\n' % batch)
        (folder / f"broken{batch}.jsonl").write_bytes(b"\xff\xfe needle")
        ev.index_stream(spark, str(folder), index, str(tmp_path / "c"), files_per_batch=2).awaitTermination()
    hits = index.with_lines(index.search(["needle"])).collect()
    assert sorted((r["name"], r["line_no"], r["date"]) for r in hits) == sorted((f"log-2024-01-0{b + 1}-{k}.jsonl", n, f"2024-01-0{b + 1}") for b in range(3) for k in range(3) for n in (2, 4))
    version = index.store.version()
    ev.index_stream(spark, str(folder), index, str(tmp_path / "c")).awaitTermination()
    assert index.store.version() == version
