"""Similarity joins and trigram searches that leave out what can't match, against all pairs and all lines."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions.text import trigram_similarity
from tesserine.operators import search, semantic, trigram_index
from tesserine.sources import readers


def vectors_of(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def all_pairs(x, threshold):
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    s = u @ u.T
    return {(a, b) for a, b in zip(*np.nonzero(np.triu(s >= threshold, 1)), strict=True)}


@pytest.mark.parametrize(("threshold", "spread"), [(0.95, 0.1), (0.9, 0.4), (0.5, 1.0), (-0.2, 1.0)])
def test_pairs_in_cells_equal_all_pairs(spark, monkeypatch, threshold, spread):
    monkeypatch.setattr(semantic, "BLOCK_VECTORS", 50)
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((12, 16))
    x = centers[rng.integers(0, 12, 700)] + spread * rng.standard_normal((700, 16))
    x[:200] = centers[0] + 0.05 * rng.standard_normal((200, 16))  # a hot cell
    df = vectors_of(spark, x)
    got = {(r["a"], r["b"]) for r in semantic.similar_pairs(df, threshold, None).collect()}
    assert got == all_pairs(x, threshold)
    shares = semantic.pruning(df, threshold).first()
    assert shares["possible"] == 700 * 699 // 2 and shares["vectors"] == 700
    if spread == 0.1:
        assert shares["compared"] < 0.25 * shares["possible"] and shares["cells"] > 3


def test_pivots_are_apart():
    x = np.eye(6)
    assert len(semantic.choose_pivots(np.repeat(x, 3, 0), 10)) == 6
    assert len(semantic.choose_pivots(np.ones((5, 2)) / 2**0.5, 4)) == 1


# --- names


def test_similar_names_equal_a_comparison_with_all(spark):
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choices("abcD ", k=rnd.randrange(0, 9))) for _ in range(400)} | {"ab", "Abc", "abcabcabc", "é", "ÉÉÉ", "xyz"})
    frame = spark.createDataFrame([(n,) for n in [*names, "abc", "abc"]] + [(None,)], "name string")
    postings = trigram_index.name_postings(frame).cache()
    for query, threshold in itertools.product(["abc", "ab", "", "abcD abcD", "ééé", "aaaaaa", "D ab"], [0.3, 0.62, 1.0]):
        want = {(r["name"], r["s"]) for r in frame.where("name is not null").distinct().withColumn("s", trigram_similarity(F.col("name"), F.lit(query))).where(F.col("s") >= threshold).collect()}
        assert {(r["name"], r["similarity"]) for r in trigram_index.similar_names(postings, query, threshold).collect()} == want, (query, threshold)
    with pytest.raises(ValueError):
        trigram_index.similar_names(postings, "abc", 0)


# --- patterns


@pytest.mark.parametrize(
    ("pattern", "wanted"),
    [
        ("hello", {"ell", "llo", "hel"}), ("a|hello", set()), ("(?:hello)?world", {"wor", "orl", "rld"}), ("ab+cd", set()), ("abcd*xyz", {"abc", "xyz"}), ("(abc)+", {"abc"}), ("(abc){2}def", {"abc", "def"}), ("[abc]lmn", {"lmn"}),
        ("^lmn$", {"lmn"}), ("(?=abc)", set()), ("(?<name>abc)d", {"abc", "bcd"}), ("abc.def", {"abc", "def"}), ("ab.cd", set()), (r"\Qabc\E", set()), (r"abc\0101def", set()), ("ab\u0345c", set()), ("a€b", {"a€b"}), ("mask", set()), ("(?i:abc)", {"abc"}), ("", set()), ("100% more", {"100", "00%", "0% ", "% m", " mo", "mor", "ore"}),
    ],
)
def test_trigrams_that_a_pattern_needs(pattern, wanted):
    got = trigram_index.required_grams(pattern)
    assert got == wanted or (pattern in ("(?<name>abc)d", "(?i:abc)") and got <= wanted)


@pytest.fixture()
def logs(spark, tmp_path):
    rnd = random.Random(9)
    words = ["alert", "order", "open", "Cache", "abcabc", "xyz", "été", "100%", "Kelvin", "ſharp", "mask"]
    files = {f"f{k:02}": [" ".join(rnd.choices(words, k=rnd.randrange(5))) for _ in range(6)] for k in range(40)}
    texts = spark.createDataFrame([(f, "\n".join(t)) for f, t in files.items()], "file string, text string")
    asked = []

    def of(names):
        asked.append(sorted(names))
        return readers.lines_of(texts.where(F.col("file").isin(names)), "text")

    lines = search.Lines(readers.lines_of(texts, "text"), of)
    index = trigram_index.TrigramIndex(spark, str(tmp_path / "g"))
    index.create(lines.all)
    return files, lines, index, asked


@pytest.mark.parametrize(("query", "regex", "cased"), [("ALERT", False, False), ("alert", False, True), ("ale+rt o", True, False), ("(abc){2}", True, False), ("x|y", True, False), ("cache.*xyz", True, False), ("100%", False, False), ("MASK", False, False), ("sharp", False, False), ("nowhere at all", False, False), ("é", True, False)])
def test_pattern_searches_equal_scans(spark, logs, query, regex, cased):
    files, lines, index, asked = logs
    got = sorted((r["file"], r["line_no"]) for r in index.scan(lines, query, regex, cased).collect())
    assert got == sorted((r["file"], r["line_no"]) for r in search.scan(lines.all, query, regex, cased).collect())
    if asked:
        held = trigram_index.required_grams(query, regex)
        assert asked == [sorted(f for f, t in files.items() if all(any(g in line.lower() for line in t) for g in held))]
    assert bool(asked) == bool(trigram_index.required_grams(query, regex))


def test_no_match_lacks_a_required_trigram():
    rnd = random.Random(1)
    pieces = ["abc", "d", "(?:ef|gh)", "ij?", "k+", "[lm]n", ".", "opq*", "(rst)", "(uv){1,2}", "w", "^", "xyz", "A"]
    for _ in range(3_000):
        pattern = "".join(rnd.choices(pieces, k=rnd.randrange(1, 5)))
        text = "".join(rnd.choices(["abc", "d", "ef", "gh", "i", "j", "k", "ln", "mn", "q", "op", "rst", "uv", "w", "xyz", "a", "ABC"], k=8))
        if re.search(pattern, text, re.IGNORECASE):
            assert all(g in text.lower() for g in trigram_index.required_grams(pattern)), (pattern, text)


def test_no_vector_is_copied_for_each_block_that_it_meets(spark, monkeypatch):
    """Blocks are read by the tasks that multiply them: whatever a join is planned as, no exchange stands behind the blocks."""
    monkeypatch.setattr(semantic, "BLOCK_VECTORS", 40)
    x = np.random.default_rng(3).standard_normal((500, 8))
    df = vectors_of(spark, x)
    made = semantic.similar_pairs(df, 0.6, None)
    assert {(r["a"], r["b"]) for r in made.collect()} == all_pairs(x, 0.6)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_pivots_copy_few_vectors():
    x = np.random.default_rng(4).standard_normal((400, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for reach in (0.05, 0.5, 1.2):
        chosen = semantic.fitting_pivots(x, 64, reach)
        _, goes = semantic.reached(np.arccos(np.clip(x @ chosen.T, -1, 1)), reach)
        assert goes.sum() <= semantic.MOST_COPIES * len(x)


def test_candidates_bring_their_similarities_along(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    pairs = spark.createDataFrame([(2, 1, 5), (2, 3, 20), (1, 3, 1), (3, 4, 0), (4, 5, 2), (1, 6, 1), (1, 9, 10), (2, 2, 3)], "a long, b long, shared long")
    looked_up = semantic.rerank(pairs, semantic.similar_pairs(vectors, 0.5, None))
    own = semantic.rerank(semantic.pair_similarities(pairs, vectors, 0.5))
    assert {tuple(r) for r in own.select(looked_up.columns).collect()} == {tuple(r) for r in looked_up.collect()}
    assert own.where("a = 2 and b = 1").first()["similarity"] == 0.8 and own.count() == 8
