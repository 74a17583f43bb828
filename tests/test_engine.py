"""Operators on small fixtures: text, readers, index, graph, maintenance, archive, streams."""

import datetime as dt
import io
import random
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.functions import text as tx
from tesserine.operators import archive, graph, maintenance, postings, predicates, ranking, records, search, semantic
from tesserine.plans.snapshot import SnapshotStore
from tesserine.sources import readers
from tesserine.streaming import events

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-02-01").cast("timestamp")


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


# --- text


def test_words_keep_hyphens_and_lengths(spark):
    assert column(spark, [("Foo-bar, b é_x! " + "y" * 101,)], "t string", tx.words(F.col("t"))) == [["foo-bar", "é_x"]]


def test_graph_tokens_drop_stopwords_and_repeats(spark):
    assert column(spark, [("The plan-1 and the PLAN-1 of ab xyz",)], "t string", tx.graph_tokens(F.col("t"))) == [["plan-1", "xyz"]]


def test_trigram_similarity_branches(spark):
    pairs = [("abc", "ABC"), ("", "abc"), ("ab", "xaby"), ("ab", "xyz"), ("abcd", "bcde")]
    got = column(spark, pairs, "a string, b string", tx.trigram_similarity(F.col("a"), F.col("b")))
    assert got == pytest.approx([1.0, 0.0, 0.8, 0.0, 1 / 3])


def test_contains_knows_no_wildcards(spark):
    rows = [("task is 100% done",), ("task is 100 complete",), ("foo_bar",), ("fooXbar",)]
    assert column(spark, rows, "t string", tx.contains_ci(F.col("t"), "100%")) == [True, False, False, False]
    assert column(spark, rows, "t string", tx.contains_ci(F.col("t"), "O_B")) == [False, False, True, False]


@pytest.mark.parametrize("bad", ["(a+)+b", "(a*)*", "(a|b)*c", "(a|aa)+", "a**", "a+*b", "x*?"])
def test_dangerous_patterns_are_refused(bad):
    with pytest.raises(ValueError):
        tx.pattern(bad, True, False)


@pytest.mark.parametrize("pattern", [r"\w+\s+\w+", r"[a-z]+\d+", "(ab+c)+", "(?:foo)+", r"\d+ *\d+"])
def test_harmless_patterns_are_let_through(pattern):
    assert tx.regex_danger(pattern) is None


@given(st.text(max_size=30))
def test_literals_are_quoted(query):
    assert tx.pattern(query, False, True).startswith("\\Q")


def test_names_dates_and_json(spark):
    assert column(spark, [("2024-03-15.jsonl",), ("x",)], "n string", tx.date_in_name(F.col("n"))) == ["2024-03-15", "?"]
    assert column(spark, [('```json\n{"a": {"b": 1}}\n```',), ("none",)], "n string", tx.json_object(F.col("n"))) == ['{"a": {"b": 1}}', None]
    assert column(spark, [("it depends_on that",), ("no",)], "n string", maintenance.parse_relation_type(F.col("n"))) == ["depends_on", None]
    assert column(spark, [("abcdef",), ("abc",)], "n string", tx.clipped(F.col("n"), 3)) == ["abc…", "abc"]


# --- readers


def test_jsonl_entries(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_text('{"content": "alpha apple"}\n\nnot json\n{"content": ""}\n')
    (tmp_path / "sub" / "2024-03-15.jsonl").write_text('{"content": "iota"}')
    (tmp_path / "bad.jsonl").write_bytes(b"\xff\xfe\xff")
    lines = readers.read_lines(spark, str(tmp_path), "*.jsonl")
    got = {(r["name"], r["entry_idx"], r["line_no"]): r["text"] for r in readers.jsonl_entries(lines).collect()}
    assert got == {("a.jsonl", 0, 1): "alpha apple", ("a.jsonl", 1, 3): "not json", ("a.jsonl", 2, 4): '{"content": ""}', ("2024-03-15.jsonl", 0, 1): "iota"}
    slots = {r["name"]: (r["file_idx"], r["date"]) for r in readers.manifest(readers.read_files(spark, str(tmp_path), "*.jsonl")).collect()}
    assert slots["a.jsonl"] == (0, "?") and slots["2024-03-15.jsonl"] == (2, "2024-03-15")


def test_transcripts_and_docx(spark, tmp_path):
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("00:05 Ann: hello", "more", "01:02:03 Bob: bye"))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    (tmp_path / "m.docx").write_bytes(held.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    text = readers.read_docx(spark, str(tmp_path)).collect()
    assert [r["name"] for r in text] == ["m.docx"]
    turns = readers.transcript_turns(readers.lines_of(spark.createDataFrame([("m", text[0]["text"])], "file string, text string"), "text"), "file").orderBy("turn_no").collect()
    assert [(r["speaker"], r["stamp"], r["text"]) for r in turns] == [("Ann", "00:05:00", "hello\nmore"), ("Bob", "01:02:03", "bye")]
    hits = spark.createDataFrame([("m", turns[0]["line_end"])], "file string, line_no int")
    lines = readers.transcript_turns(readers.lines_of(spark.createDataFrame([("m", text[0]["text"])], "file string, text string"), "text"), "file")
    assert [r["speaker"] for r in search.turn_of_line(hits, lines).collect()] == ["Ann"]


def test_domain_files_are_checked():
    good = '[domains.a]\ndir = "/x"\nfilters = ["role"]\n'
    assert readers.load_domains(good)["a"].filters == ("role",)
    for bad in ("", "[domains.a]\n", '[domains.a]\ndir="/x"\nkind="odd"\n', '[domains.a]\ndir="/x"\nfilters=["colour"]\n', '[domains.a]\ndir="/x"\nwhat=1\n'):
        with pytest.raises(ValueError):
            readers.load_domains(bad)


def test_ids_logs_and_history(spark):
    files = spark.createDataFrame([("abc.txt",), ("abd.txt",)], "name string")
    assert readers.resolve_id(files, "abd").first()["name"] == "abd.txt"
    for bad in ("", "../x", "/etc"):
        with pytest.raises(ValueError):
            readers.resolve_id(files, bad)
    lines = spark.createDataFrame([(1, "d t h ERROR x"), (2, "d t h info x"), (3, "short x")], "line_no int, line string")
    assert [r["line_no"] for r in readers.log_lines(lines, "x", level="error").collect()] == [1]
    assert [r["line"] for r in readers.history_lines(spark.createDataFrame([(1, '"ls -l"'), (2, "cd")], "line_no int, line string"), "ls").collect()] == ["ls -l"]


# --- numbers, index


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    assert [r["n"] for r in ranking.numbered(df, ["k"]).orderBy("k").collect()] == list(range(1000))
    # ties, a hot key and the same numbers at each use of the result
    hot = spark.range(600).selectExpr("if(id % 3 = 0, 7, id) as k", "id")
    numbers = ranking.numbered(hot, ["k"])
    rows = numbers.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(600)) and [r["k"] for r in rows] == sorted(r["k"] for r in rows)
    assert numbers.join(numbers, ["id", "n"]).count() == 600
    assert ranking.numbered(hot.limit(0), ["k"]).count() == 0


def entries_of(spark, files):
    return spark.createDataFrame([(f, k, t) for f, texts in files.items() for k, t in enumerate(texts)], "file string, entry_idx int, text string")


def files_of(spark, files, times=None):
    return spark.createDataFrame([(f, k, (times or {}).get(f, 1), sum(map(len, t)), False) for k, (f, t) in enumerate(sorted(files.items()))], "file string, file_idx long, modified int, size int, tombstoned boolean")


def held(postings_df, files_df):
    return {(r["token"], r["file"], r["entry_idx"]) for r in postings_df.join(files_df.where("not tombstoned"), "file_idx").collect()}


def test_update_equals_build_and_compaction_changes_nothing(spark, tmp_path):
    old = {"a": ["alpha apple banana"], "b": ["bravo banana cherry"], "c": ["old words"]}
    new = {"a": ["alpha banana", "fresh line"], "b": ["bravo banana cherry"], "d": ["delta alpha"]}
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    index.create(entries_of(spark, old).join(files_of(spark, old).select("file", "file_idx"), "file"), files_of(spark, old))
    assert index.update(entries_of(spark, old), files_of(spark, old)) == {"unchanged": 3, "updated": 0, "added": 0, "removed": 0, "total_slots": 3, "needs_compact": False}
    done = index.update(entries_of(spark, new), files_of(spark, new, {"a": 2}), defer_compact=True)
    assert done == {"unchanged": 1, "updated": 1, "added": 1, "removed": 1, "total_slots": 4, "needs_compact": True}
    fresh = postings.build(entries_of(spark, new).join(files_of(spark, new).select("file", "file_idx"), "file"))
    want = held(fresh, files_of(spark, new))
    assert held(index.postings(), index.store.read("files")) == want
    index.compact()
    version = index.compact()
    assert index.compact() == version
    assert held(index.postings(), index.store.read("files")) == want
    assert {r["file"] for r in index.search(["alpha"]).collect()} == {"a", "d"}
    assert index.search(["old"]).count() == 0


def test_a_new_file_never_takes_another_ones_number(spark, tmp_path):
    old, new = {"a": ["alpha"]}, {"a": ["alpha"], "b": ["bravo"]}
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    index.create(entries_of(spark, old).join(files_of(spark, old).select("file", "file_idx"), "file"), files_of(spark, old))
    index.update(entries_of(spark, new), files_of(spark, new))
    assert [r["file"] for r in index.search(["bravo"]).collect()] == ["b"]
    back = {"a": ["alpha"]}
    index.update(entries_of(spark, back), files_of(spark, back))
    index.update(entries_of(spark, new), files_of(spark, new))
    assert [r["file"] for r in index.search(["bravo"]).collect()] == ["b"] and index.store.read("files").count() == 3


def test_domains_are_built_then_updated(spark, tmp_path):
    old, new = {"a": ["alpha"], "b": ["bravo"]}, {"a": ["alpha"], "b": ["bravo"], "c": ["alpha c1"]}
    numbered = entries_of(spark, old).join(files_of(spark, old).select("file", "file_idx"), "file")
    first = postings.update_domains(spark, str(tmp_path), {"notes": (numbered, files_of(spark, old))})
    assert first["notes"]["added"] == 2
    assert postings.update_domains(spark, str(tmp_path), {"notes": (entries_of(spark, new), files_of(spark, new))})["notes"]["added"] == 1
    index = postings.PostingsIndex(spark, str(tmp_path / "notes"))
    lines = entries_of(spark, new).select("file", (F.col("entry_idx") + 1).alias("line_no"), F.col("text").alias("line"))
    for query, any_word in (("alpha", True), ("alpha c1", False), ("nothing", True), ("Bravo c1", True)):
        plain, indexed = (sorted((r["file"], r["line_no"]) for r in search.search({"notes": lines}, query, any_word=any_word, indexes=x, by_word=True).collect()) for x in (None, {"notes": index}))
        assert plain == indexed


def test_and_or_and_empty_queries(spark):
    built = postings.build(spark.createDataFrame([(0, 0, "x y1 zz"), (1, 0, "y1 zz"), (1, 1, "zz")], "file_idx long, entry_idx int, text string"))
    assert postings.search(built, ["y1", "zz"]).count() == 2
    assert postings.search(built, ["y1", "nope"]).count() == 0
    assert postings.search(built, ["y1", "nope"], "or").count() == 2
    assert postings.search(built, []).count() == 0
    with pytest.raises(ValueError):
        postings.search(built, ["a"], "xor")


def test_last_operation_holds(spark):
    base = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "token string, file_idx long, entry_idx int")
    delta = spark.createDataFrame([("a", 0, 0, "DEL", 1), ("a", 0, 0, "ADD", 2), ("b", 0, 0, "DEL", 3), ("c", 0, 0, "ADD", 1)], "token string, file_idx long, entry_idx int, op string, seq long")
    assert sorted(r["token"] for r in postings.layered(base, delta).collect()) == ["a", "c"]


def test_snapshots_refuse_stale_commits(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.commit({"t": spark.range(3)})
    pinned = store.read("t")
    store.commit({"t": spark.range(5)}, expected=1)
    assert pinned.count() == 3 and store.read("t").count() == 5
    with pytest.raises(RuntimeError):
        store.commit({"t": spark.range(1)}, expected=1)


def test_search_over_domains(spark):
    lines = spark.createDataFrame([("f", 1, "one cat"), ("f", 2, "two"), ("f", 3, "cat cat")], "file string, line_no int, line string")
    talk = spark.createDataFrame([("s", 1, "cat", "user"), ("s", 2, "cat", "assistant"), ("s", 3, "cat", None)], "file string, line_no int, line string, role string")
    got = search.search({"docs": lines, "talk": talk}, "cat", context_lines=1).collect()
    assert len(got) == 5
    first = next(r for r in got if r["domain"] == "docs" and r["line_no"] == 1)
    assert first["before"] == [] and first["after"] == ["two"]
    assert {r["line_no"] for r in search.search({"talk": talk}, "cat", role="user").collect()} == {1, 3}
    for wrong in ({"query": " "}, {"query": "x", "domain": "no"}, {"query": "x", "speaker": "a"}):
        with pytest.raises(ValueError):
            search.search({"docs": lines}, **wrong)


# --- graph


@pytest.fixture()
def g(spark):
    entities = spark.createDataFrame([(n, t, T0, T0, 0) for n, t in (("alpha", "concept"), ("beta", "person"), ("gamma", "concept"), ("delta", "project"))], "name string, entity_type string, created_at timestamp, updated_at timestamp, revision long")
    obs = spark.createDataFrame([(1, "alpha", "first", T0), (2, "alpha", "second beta", T0), (3, "beta", "solo", T0)], "obs_id long, name string, content string, created_at timestamp")
    rels = spark.createDataFrame([("alpha", "beta", "relates_to", T0), ("delta", "alpha", "depends_on", T0)], "src string, dst string, relation_type string, created_at timestamp")
    return graph.Graph(entities, obs, rels)


def revision(g, name):
    return g.entities.where(F.col("name") == name).first()["revision"]


def test_create_entities(spark, g):
    batch = spark.createDataFrame([(0, "alpha", "x", ["a"]), (1, "new", None, ["o", "o", "p"]), (2, "new", "y", [])], "pos int, name string, entity_type string, observations array<string>")
    made, refused = graph.create_entities(g, batch, now())
    assert {r["pos"] for r in refused.collect()} == {0, 2}
    assert made.entities.where("name = 'new'").first()["entity_type"] == "unknown"
    assert sorted(r["content"] for r in made.observations.where("name = 'new'").collect()) == ["o", "p"]


def test_create_and_delete_relations(spark, g):
    batch = spark.createDataFrame([(0, "alpha", "beta", "relates_to"), (1, "a", "b", "t"), (2, "a", "b", "t"), (3, None, "b", "t")], "pos int, src string, dst string, relation_type string")
    made, refused = graph.create_relations(g, batch, now())
    assert {r["pos"] for r in refused.collect()} == {0, 2, 3} and made.relations.count() == 3
    left = graph.delete_relations(made, spark.createDataFrame([("a", "b", None), ("alpha", "beta", "other")], "src string, dst string, relation_type string"))
    assert left.relations.count() == 2


def test_guarded_observations(spark, g):
    schema = "pos int, name string, contents array<string>, expected_rev long"
    batch = spark.createDataFrame([(0, "beta", ["x"], 0), (1, "beta", ["y"], 0), (2, "beta", ["x"], 0), (3, "beta", ["y"], 1), (4, "none", ["z"], None)], schema)
    done, log = graph.add_observations(g, batch, now())
    assert {r["pos"]: r["status"] for r in log.collect()} == {0: "applied", 1: "conflict", 2: "unchanged", 3: "applied", 4: "missing"}
    assert revision(done, "beta") == 2 and revision(done, "alpha") == 0
    gone, log = graph.delete_observations(done, spark.createDataFrame([(0, "beta", ["x", "nope"], 2), (1, "beta", ["y"], 2)], schema))
    assert {r["pos"]: r["status"] for r in log.collect()} == {0: "applied", 1: "conflict"}
    assert sorted(r["content"] for r in gone.observations.where("name = 'beta'").collect()) == ["solo", "y"] and revision(gone, "beta") == 3


def test_delete_entities(spark, g):
    done, clashes = graph.delete_entities(g, spark.createDataFrame([("alpha", 0), ("beta", 5), ("nobody", None)], "name string, expected_rev long"))
    assert [r["name"] for r in clashes.collect()] == ["beta"]
    assert done.entities.count() == 3 and done.observations.count() == 1 and done.relations.count() == 0


def test_reads(spark, g):
    assert [r["name"] for r in graph.open_nodes(g, ["beta", "none", "alpha"]).collect()] == ["beta", "alpha"]
    assert [(r["name"], r["score"]) for r in graph.search_nodes(g, "beta").orderBy("name").collect()] == [("alpha", 1), ("beta", 10)]
    near, far = ({r["name"] for r in graph.traverse(g, "beta", k).collect()} for k in (1, 2))
    assert near == {"alpha", "beta"} and far == {"alpha", "beta", "delta"}
    edges = [{(r["src"], r["dst"]) for r in graph.traverse_edges(g, "beta", k).collect()} for k in (1, 2)]
    assert edges == [{("alpha", "beta")}, {("alpha", "beta"), ("delta", "alpha")}]
    assert graph.read_graph(g)[0].count() == 4
    assert graph.capped_graph(g, 2).relations.count() == 1
    assert graph.migrated(g.observations.unionByName(g.observations)).count() == 3


# --- maintenance, archive, predicates


def test_stages(spark, g, tmp_path):
    obs = spark.createDataFrame([(1, "alpha", "shared words here", T0), (2, "gamma", "shared words too", T0), (3, "delta", "nothing", T0)], "obs_id long, name string, content string, created_at timestamp")
    small = graph.Graph(g.entities, obs, g.relations)
    mapping = spark.createDataFrame([("concept", "idea")], "from_type string, to_type string")
    rules = spark.createDataFrame([("concept", "concept", "extends")], "from_type string, to_type string, relation_type string")
    run = str(tmp_path / "runs" / "2")
    first = maintenance.run_stages(spark, small, run, mapping, rules, now=F.lit(T0)).relations.collect()
    added = [(r["src"], r["dst"], r["relation_type"]) for r in spark.read.parquet(f"{run}/04_apply").collect()]
    assert added == [("alpha", "gamma", "extends")] and len(first) == small.relations.count() + 1
    for stage in ("validate", "apply"):
        assert sorted(maintenance.run_stages(spark, small, run, mapping, rules, from_stage=stage, now=F.lit(T0)).relations.collect()) == sorted(first)
    with pytest.raises(ValueError):
        maintenance.run_stages(spark, small, run, from_stage="publish")
    (tmp_path / "runs" / "1").mkdir()
    assert maintenance.list_runs(spark, str(tmp_path / "runs")) == ["2", "1"] and maintenance.list_runs(spark, str(tmp_path / "none")) == []
    short = maintenance.shortlist(maintenance.discover(small, mapping))
    assert [tuple(r) for r in short["candidates"].collect()] == [("alpha", "gamma", 2)] and short["merges"].columns == ["keep", "remove"]
    assert [r["signals"] for r in maintenance.chunk_candidates(small, 150).collect()] == [["shared", "words"]] and maintenance.chunk_candidates(small, 1).count() == 0
    assert maintenance.plan_warnings({"renames": mapping}) == ["renames lacks ['name']"]
    none = maintenance.validate(small, maintenance.rank(maintenance.discover(small, mapping)["candidates"]), rules.limit(0), lambda df: df.select("a", "b", F.lit("invented").alias("relation_type"), F.lit(1.0).alias("confidence")))
    assert none.count() == 0


def test_merges(spark, g):
    plan = spark.createDataFrame([(0, "alpha", "beta"), (1, "beta", "delta"), (2, "alpha", "delta")], "pos int, keep string, remove string")
    targets = maintenance.merge_targets(spark, plan)
    assert {(r["remove"], r["keep"]) for r in targets.collect()} == {("beta", "alpha"), ("delta", "alpha")}
    done = maintenance.apply_merges(g, targets)
    assert {r["name"] for r in done.entities.collect()} == {"alpha", "gamma"} and done.relations.count() == 0 and done.observations.count() == 3


def test_loops_that_merges_make_go(spark, g):
    rels = [("alpha", "alpha", "old"), ("alpha", "beta", "uses"), ("gamma", "gamma", "old"), ("delta", "delta", "old")]
    loops = graph.Graph(g.entities, g.observations, spark.createDataFrame([(*r, T0) for r in rels], g.relations.schema))

    def left(keep, remove):
        targets = spark.createDataFrame([(remove, keep)], "remove string, keep string")
        return sorted(tuple(r)[:3] for r in maintenance.apply_merges(loops, targets).relations.collect())

    assert left("alpha", "beta") == [("delta", "delta", "old"), ("gamma", "gamma", "old")]
    assert left("alpha", "gamma") == [("alpha", "beta", "uses"), ("delta", "delta", "old")]


def test_plans(spark, g):
    plan = {
        "renames": spark.createDataFrame([(0, "gamma", "idea"), (1, "gamma", "thought"), (2, "", "x"), (3, "alpha", "")], "pos int, name string, to_type string"),
        "merges": spark.createDataFrame([(0, "nobody", "beta"), (1, "delta", "beta"), (2, "alpha", "nobody")], "pos int, keep string, remove string"),
        "entities": spark.createDataFrame([(0, "beta", None, ["again"]), (1, "beta", "late", ["x"]), (2, "alpha", "place", ["y"]), (3, "", "z", ["z"])], "pos int, name string, entity_type string, observations array<string>"),
        "relations": spark.createDataFrame([("beta", "gamma", "uses"), ("beta", "gamma", "uses"), ("beta", "nobody", "uses"), ("alpha", "beta", ""), ("delta", "alpha", "depends_on")], "src string, dst string, relation_type string"),
        "archive_observations": g.observations,
    }
    done = maintenance.apply_plan(g, plan, now())
    assert sorted((r["name"], r["entity_type"]) for r in done.entities.collect()) == [("alpha", "concept"), ("beta", "summary"), ("delta", "project"), ("gamma", "thought")]
    assert sorted(tuple(r)[:3] for r in done.relations.collect()) == [("alpha", "delta", "relates_to"), ("beta", "gamma", "uses"), ("delta", "alpha", "depends_on")]
    assert sorted((r["name"], r["content"]) for r in done.observations.collect()) == [("alpha", "first"), ("alpha", "second beta"), ("beta", "again"), ("delta", "solo")]
    same = maintenance.apply_plan(g, {}, now())
    assert same.entities.count() == 4 and same.relations.count() == 2


def fold_by_hand(plan):
    gone = {}
    for _, keep, remove in sorted(plan):
        if keep != remove and keep not in gone and remove not in gone:
            gone[remove] = keep

    def last(name):
        while name in gone:
            name = gone[name]
        return name

    return {(r, last(r)) for r in gone}


def test_pairs_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0]), (5, []), (6, None), (7, [1.0, None]), (8, [0.0, 0.0]), (9, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in semantic.similar_pairs(vectors).collect()] == [(1, 2, 1.0), (3, 4, 1.0)]
    assert semantic.similar_pairs(vectors.limit(0)).count() == 0


def test_duplicate_merges_are_what_all_pairs_give(spark):
    names = ["Alpha One", "alpha-one", "ALPHA_ONE", "beta", "Beta", "abc", "ABC", "lone name", None]
    entities = spark.createDataFrame([(n,) for n in names], "name string")
    stars = sorted(tuple(r) for r in maintenance.duplicate_merges(entities).collect())
    pairs = sorted(tuple(r) for r in maintenance.duplicate_names(entities).collect())
    assert stars == [("ALPHA_ONE", "Alpha One"), ("ALPHA_ONE", "alpha-one"), ("Beta", "beta")] and len(pairs) == 4
    assert fold_by_hand([(k, *p) for k, p in enumerate(stars)]) == fold_by_hand([(k, *p) for k, p in enumerate(pairs)])
    assert maintenance.duplicate_merges(entities.limit(0)).count() == 0


def test_merges_of_long_plans(spark):
    schema = "pos int, keep string, remove string"
    plan = [(k, f"k{k}", f"r{k}") for k in range(12_000)]
    got = maintenance.merge_targets(spark, spark.createDataFrame(plan, schema))
    assert {(r["remove"], r["keep"]) for r in got.collect()} == fold_by_hand(plan)
    chain = [(-k, f"n{k}", f"n{k + 1}") for k in range(40)] + [(k, f"m{k}", f"m{k + 1}") for k in range(8)]
    rnd = random.Random(4)
    for plan in (chain, [(k, f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for k in range(120)]):
        df = spark.createDataFrame(plan, schema)
        for fold_rows in (0, 30, 1000):
            got = [(r["remove"], r["keep"]) for r in maintenance.merge_targets(spark, df, fold_rows).collect()]
            assert len(got) == len(set(got)) and set(got) == fold_by_hand(plan)
    odd = spark.createDataFrame([(0, None, "a"), (1, "b", ""), (2, "c", "c"), (3, "b", "a")], schema)
    assert [tuple(r) for r in maintenance.merge_targets(spark, odd).collect()] == [("a", "b")]


def test_archive(spark, g, tmp_path):
    old = spark.createDataFrame([(9, "beta", "ancient", dt.datetime(2023, 1, 1)), (10, "beta", "at the edge", dt.datetime(2023, 11, 3))], g.observations.schema)
    full = graph.Graph(g.entities, g.observations.unionByName(old), g.relations)
    same, found = archive.archive(full, now(), str(tmp_path / "a"), 90)
    assert same is full and [r["content"] for r in found.collect()] == ["ancient"]
    done, _ = archive.archive(full, now(), str(tmp_path / "a"), 90, apply=True)
    assert spark.read.json(str(tmp_path / "a")).first()["entity"] == "beta"
    assert done.observations.count() == 4 and revision(done, "beta") == 1


def test_session_predicates(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "heavy"), (1, 0, "user", "q"), (1, 1, "assistant", "search"), (1, 2, "assistant", "heavy")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = predicates.first_turn_gate(talk, F.col("text") == "heavy", F.col("text") == "search")
    assert {r["conv_id"]: r["denied"] for r in got.collect()} == {0: True, 1: False}
    assert column(spark, [("a/agents/b",), ("a/b",)], "p string", predicates.top_level(F.col("p"))) == [False, True]
    assert column(spark, [('{"x": "{\\"stage\\": \\"report:\\"}"}',)], "p string", predicates.tool_marker(F.col("p"), '"stage": "report:"')) == [True]


# --- streams


def test_a_stream_into_a_used_store_loses_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "t"))
    for k in range(3):
        store.commit({"other": spark.range(k + 1)})
    for name in ("one", "two"):
        spark.range(5).selectExpr("id", "timestamp_seconds(id * 3600) as ts").write.parquet(str(tmp_path / name))
        stream = events.event_stream(spark, str(tmp_path / name), "id long, ts timestamp")
        events.ingest(stream, store, lambda old, new: new if old is None else old.unionByName(new), "events", str(tmp_path / f"cp-{name}"), name).awaitTermination(60)
    assert store.read("events").count() == 10 and store.read("other").count() == 3 and set(store.marks()) == {"one", "two"}


def test_commits_exclude_each_other(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "t"))
    store.commit({"a": spark.range(1)})
    claim = store._claim(2)
    with pytest.raises(RuntimeError):
        store.commit({"a": spark.range(2)})
    store._fs.delete(claim, False)
    assert store.commit({"a": spark.range(2)}) == 2 and store.read("a").count() == 2
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("C")] == ["CURRENT"]


def test_stream_into_snapshots(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(5).selectExpr("id", "timestamp_seconds(id * 3600) as ts", "cast(id as double) as value").write.parquet(str(folder))
    store = SnapshotStore(spark, str(tmp_path / "t"))
    stream = events.event_stream(spark, str(folder), "id long, ts timestamp, value double")
    run = events.ingest(stream, store, lambda old, new: new if old is None else old.unionByName(new), "events", str(tmp_path / "cp"))
    run.awaitTermination(60)
    assert store.read("events").count() == 5
    counted = events.tumbling(store.read("events"), "2 hours", "value")
    assert counted.agg(F.sum("n")).first()[0] == 5


# --- records


def test_summaries_and_digests(spark, tmp_path):
    rows = [("a", '{"goal": "g", "tags": ["x"], "action_items": [{"who": "w", "what": "t"}]}'), ("b", "broken")]
    got = {r["id"]: r for r in records.summaries(spark.createDataFrame(rows, "id string, json string")).collect()}
    assert got["a"]["tags"] == ["x"] and got["a"]["action_items"][0]["who"] == "w" and got["b"]["goal"] is None
    log = spark.createDataFrame([(k, f"s{k}") for k in range(5)], "ts long, system string")
    records.append_digest(log, str(tmp_path / "log"))
    records.append_digest(log, str(tmp_path / "log"))
    assert [r["ts"] for r in records.digest_newest(spark.read.json(str(tmp_path / "log")), 3).collect()] == [4, 4, 3]


def test_entity_summary_and_embedding(spark, g):
    one = records.entity_summary(g, "alpha", width=4).first()
    assert one["observations"] == ["firs…", "seco…"] and len(one["relations"]) == 2
    got = {r["name"]: r["embedding"] for r in records.embed_entities(g, lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got["beta"] == [float(len("beta. solo"))] and len(got) == 4


def test_batches_limits_and_gates(spark):
    def judge(batch):
        if (batch["a"] == 3).any():
            raise RuntimeError("no answer")
        return batch.assign(relation_type="uses", confidence=1.0)

    pairs = spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long").coalesce(1)
    assert sorted(r["a"] for r in records.validate_in_batches(pairs, judge, 2).collect()) == [0, 1, 4, 5]
    assert records.should_run(100, None, 60, 5, 5) and not records.should_run(100, 90, 60, 5, 5) and not records.should_run(100, 0, 60, 1, 5)
    assert records.within(spark, lambda: spark.range(10).count(), 30) == 10


def test_similar_pairs_over_several_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(semantic, "BLOCK_VECTORS", 40)
    x = np.random.default_rng(1).standard_normal((150, 6))
    x[7] = 0
    df = spark.createDataFrame([(int(k), [float(v) for v in x[k]]) for k in range(150)] + [(900, None)], "vec_id long, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if u[a] @ u[b] >= 0.5}
    assert {(r["a"], r["b"]) for r in semantic.similar_pairs(df, 0.5, None).collect()} == want
    assert semantic.similar_pairs(df.limit(0), 0.5).count() == 0


def test_shared_tokens_equal_all_pairs(spark):
    import itertools
    import random

    rnd = random.Random(2)
    held = {f"n{k}": {f"t{min(rnd.randrange(12), rnd.randrange(30))}" for _ in range(rnd.randrange(8))} for k in range(40)}
    df = spark.createDataFrame([(n, t) for n, ts in held.items() for t in ts], "name string, token string")
    for least in (1, 2, 3):
        want = {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(sorted(held), 2) if len(held[a] & held[b]) >= least}
        got = {(r["a"], r["b"]): (r["shared"], set(r["signals"])) for r in maintenance.shared_tokens(df, least=least).collect()}
        assert {k: v[0] for k, v in got.items()} == want and all(v[1] <= held[a] & held[b] for (a, b), v in got.items())


def test_gates_over_nested_arguments(spark):
    rows = [(1, 0, "user", "q", "logs/1", "{}"), (1, 1, "assistant", "plan", "logs/1", '{"x": "{\\"y\\": \\"{\\\\\\"stage\\\\\\": \\\\\\"report:\\\\\\"}\\"}"}'), (2, 0, "user", "q", "logs/agents/2", "{}"), (2, 1, "assistant", "plan", "logs/agents/2", "{}"), (3, 0, "user", "q", "logs/3", "{}"), (3, 1, "assistant", "plan", "logs/3", "{}")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, arguments string")
    plans, searched = F.col("text") == "plan", F.col("text") == "search"
    assert {r["conv_id"]: r["denied"] for r in predicates.planner_gate(said, plans, searched).collect()} == {1: True, 2: False, 3: True}
    marker = predicates.tool_marker(F.col("arguments"), '"stage": "report:"')
    assert {r["conv_id"]: r["denied"] for r in predicates.report_missing(said, plans, marker).collect()} == {1: False, 2: False, 3: True}


def test_entries_of_a_file_by_its_id(spark, tmp_path):
    (tmp_path / "2024-01-02.jsonl").write_text('{"a": 1}\n\nno json\n')
    (tmp_path / "talk.txt").write_text("Meeting: m\n===\nAnn (00:00:01)\nhello\nBob (00:00:02)\nbye\n")
    logs, talks = readers.Domain("logs", str(tmp_path), "*.jsonl"), readers.Domain("talks", str(tmp_path), "*.txt", extractor="text")
    assert [(r["nth"], r["raw"]) for r in readers.read_entries(spark, logs, "2024").orderBy("nth").collect()] == [(1, "no json"), (2, None)]
    assert [r["text"] for r in readers.read_entries(spark, talks, "talk.txt", speaker="bob").collect()] == ["bye"]
    assert readers.read_entries(spark, logs, "unknown").count() == 0


def test_validator_counters(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long")
    row = maintenance.validator_health(pairs, pairs.where("a < 2"), pairs.where("a >= 2"), pairs.where("a in (2, 3)"), pairs.where("a = 4")).first()
    assert row.asDict() == {"candidates_in": 6, "named_by_rules": 2, "batch_asked": 4, "batch_answered": 2, "single_asked": 2, "single_none": 1}


def test_vectors_are_stored_and_searched_by_text(spark, g, tmp_path):
    def embed(texts):
        return [[1.0, 0.0] if "first" in t else [0.6, 0.8] if "solo" in t else [0.0, 1.0] for t in texts]

    root = str(tmp_path / "vectors")
    assert records.store_vectors(spark, root, records.embed_entities(g, embed)) == 1
    assert records.store_vectors(spark, root, records.embed_entities(g, embed).where("name != 'delta'")) == 2
    held = records.load_vectors(spark, root)
    assert held.count() == 3
    assert [tuple(r) for r in semantic.search_text(held, "the first", embed, threshold=0.5).collect()] == [("alpha", 1.0), ("beta", 0.6)]
    assert semantic.search_text(held.limit(0), "the first", embed).count() == 0
    with pytest.raises(ValueError):
        semantic.search_text(held, " ", embed)


def test_content_in_parts(spark):
    lines = ['{"role": "User", "content": [{"type": "text", "text": "one"}, {"type": "image"}, {"text": "two"}]}', '{"role": "assistant", "content": "[plain]"}', '{"role": "user", "content": []}', "words", None]
    got = records.snippets(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["role"], r["snippet"]) for r in got][:2] == [("user", "one two"), ("assistant", "[plain]")]
    assert got[3]["snippet"] == "words" and got[4]["snippet"] is None
