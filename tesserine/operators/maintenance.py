"""Graph maintenance: discover, rank, validate, apply. Each stage maps tables to tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import graph_tokens, normalised_name
from tesserine.operators.graph import TRIPLE, Graph, create_entities
from tesserine.operators.ranking import first_n, numbered
from tesserine.operators.semantic import lexical_similarity, rerank, unrelated
from tesserine.scratch import ensure_checkpoints

MIN_SHARED, MAX_CANDIDATES, WEAK = 2, 80, 0.45

#: Merges that one task folds in order; more are settled by rounds of joins first.
FOLD_ROWS = 50_000

# Relation types that may be named, what pairs of types suggest, and the one spelling of each entity type.
ALLOWED = "implements part_of related_to tested_by fixes depends_on uses references causes verified_by contains supersedes".split()
TYPE_RULES = [
    ("plan", "implementation", "implements"), ("plan", "refactor", "implements"), ("design-decision", "implementation", "implements"), ("bug", "fix", "fixes"), ("bug", "bugfix", "fixes"), ("finding", "fix", "fixes"),
    ("test", "code-change", "tests"), ("test", "implementation", "tests"), ("implementation", "test", "tested_by"), ("file", "test", "contains"), ("change", "implementation", "implements"), ("milestone", "plan", "contains"),
]
CANONICAL_TYPES = {
    "Change": "change", "Task": "task", "Fix": "fix", "File": "file", "Feature": "feature", "DesignDecision": "design-decision", "CodeChange": "code-change", "Implementation": "implementation", "TestSuite": "test", "TestResult": "test-result",
    "Code": "code", "Project": "project", "Session": "change", "Module": "module", "Fact": "finding", "Lesson": "finding", "Server": "service", "Convention": "config", "Milestone": "plan", "Assessment": "finding", "Recommendation": "finding",
    "KnownIssue": "bug", "RefactorTask": "task", "Performance_problem": "bug", "NetworkConfig": "config", "NetworkingConfig": "config", "NetworkInterface": "infrastructure", "System_config": "config", "SystemConfig": "config",
    "Infrastructure": "infrastructure", "Repository": "project", "Artifact": "file", "Configuration": "config", "System": "infrastructure", "Peer": "infrastructure",
}


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPE_RULES, "from_type string, to_type string, relation_type string")


def default_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CANONICAL_TYPES.items()), "from_type string, to_type string")


def entity_tokens(g: Graph, most: int = 3) -> DataFrame:
    """name, token of the first observations of each entity."""
    kept = first_n(g.observations, ["name"], ["obs_id"], most)
    return kept.select("name", F.explode(graph_tokens(F.col("content"))).alias("token")).distinct()


#: Owners of one class that are paired with others in one go, and pairs that a task makes of them.
CHUNK_MEMBERS, TASK_PAIRS = 1_000, 4_000_000
#: Tokens that so many classes have at most show where a best pair's count may lie, and classes beyond which that is looked for.
FEW_CLASSES, MANY_CLASSES = 8, 2_000


def _token_lists(tokens: DataFrame, key: str, least: int, within: list[str]) -> DataFrame:
    """within, key, t: each owner's tokens that another owner has as well, most frequent first, of owners that have as many as least."""
    owned = tokens.select(*within, key, "token").distinct()
    held = owned.groupBy(*within, "token").agg(F.count("*").alias("n")).where("n > 1")
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token")))
    lists = owned.join(held, [*within, "token"]).groupBy(*within, key).agg(order.alias("t")).where(F.size("t") >= least)
    return lists.select(*within, key, F.col("t.token").alias("t"))


def _class_pairs(classes: DataFrame, least: int, within: list[str]) -> DataFrame:
    """within, ra, rb, t of each two classes (rep, t) with ra < rb that share as many tokens t as least.

    Of the tokens that two lists share, the rarest is none of the least - 1 most frequent ones
    of either, so classes meet by an equi join on each one's other tokens only; then the whole
    lists are compared.
    """
    rare = classes.select(*within, "rep", F.explode(F.slice("t", least, 1_000_000_000)).alias("token"))
    left, right = (rare.withColumnRenamed("rep", r) for r in ("ra", "rb"))
    met = left.join(right, [*within, "token"]).where("ra < rb").select(*within, "ra", "rb").distinct()
    return _shared(met, classes, within).where(F.size("t") >= least)


def _shared(met: DataFrame, classes: DataFrame, within: list[str]) -> DataFrame:
    sides = [classes.select(*within, F.col("rep").alias(r), F.col("t").alias(f"t_{r}")) for r in ("ra", "rb")]
    return met.join(sides[0], [*within, "ra"]).join(sides[1], [*within, "rb"]).select(*within, "ra", "rb", F.array_intersect("t_ra", "t_rb").alias("t"))


def _signals(t: Column) -> Column:
    """The four longest tokens."""
    longest = F.array_sort(F.transform(t, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("token"))))
    return F.transform(F.slice(longest, 1, 4), lambda x: x["token"])


def shared_tokens(tokens: DataFrame, key: str = "name", least: int = MIN_SHARED, within: list[str] | None = None, joined: str | None = None) -> DataFrame:
    """a, b, shared, signals of pairs a < b that share at least so many tokens; with within, of pairs that are alike in these columns; with joined, signals as one text.

    A token that one owner has is shared with nobody; owners that are alike in all others are
    one class. Classes are compared, each two once, and their members are paired in chunks of
    a bounded size, dealt out to tasks by how many pairs there are, so what is moved grows
    with the square of the chunks; only the rows that are returned grow with that of the owners.
    """
    ensure_checkpoints(tokens.sparkSession)
    w = within or []
    lists = _token_lists(tokens, key, least, w).checkpoint()
    classes = lists.groupBy(*w, "t").agg(F.min(key).alias("rep"), F.count("*").alias("m"))
    pairs = _class_pairs(classes, least, w).unionByName(classes.where("m > 1").select(*w, F.col("rep").alias("ra"), F.col("rep").alias("rb"), "t"))
    signals = _signals(F.col("t"))
    pairs = pairs.select(*w, "ra", "rb", F.size("t").cast("long").alias("shared"), (signals if joined is None else F.array_join(signals, joined)).alias("signals")).checkpoint()
    sizes = [classes.select(*w, F.col("rep").alias(f"r{s}"), F.col("m").cast("double").alias(f"m{s}")) for s in "ab"]
    made = pairs.join(sizes[0], [*w, "ra"]).join(sizes[1], [*w, "rb"]).agg(F.sum(F.col("ma") * F.col("mb"))).first()[0]
    tasks = max(1, min(100_000, math.ceil((made or 0) / TASK_PAIRS)))
    placed = lists.join(classes, [*w, "t"]).select(*w, "rep", key, F.pmod(F.xxhash64(key), F.ceil(F.col("m") / CHUNK_MEMBERS)).alias("c"))
    chunks_of = placed.groupBy(*w, "rep", "c").agg(F.collect_list(key).alias("k"))
    sides = [chunks_of.select(*w, F.col("rep").alias(f"r{s}"), F.col("c").alias(f"c{s}"), F.col("k").alias(f"k{s}")) for s in "ab"]
    met = pairs.join(sides[0], [*w, "ra"]).join(sides[1], [*w, "rb"]).where("ra < rb or ca <= cb").repartition(tasks, *w, "ra", "ca", "rb", "cb")
    both = met.withColumn("x", F.explode("ka")).withColumn("y", F.explode("kb")).where("ra < rb or ca < cb or x < y")
    return both.select(*w, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "signals")


def best_shared(tokens: DataFrame, most: int = MAX_CANDIDATES, key: str = "name", least: int = MIN_SHARED, relations: DataFrame | None = None) -> DataFrame:
    """The first `most` pairs of shared_tokens by shared, the largest first, a and b, without those that have a relation (src, dst), if relations are given.

    Pairs are looked for without regard to relations; where too few are left, more are taken.
    """
    ensure_checkpoints(tokens.sparkSession)
    lists = _token_lists(tokens, key, least, []).checkpoint()
    order, want = [F.desc("shared"), "a", "b"], most
    while True:
        top = _best(lists, want, key, least)
        if relations is None:
            return top.orderBy(*order).limit(most)
        top = top.checkpoint()
        left = unrelated(top, relations).checkpoint()
        if left.count() >= most or top.count() < want:
            return left.orderBy(*order).limit(most)
        want *= 4


def _best(lists: DataFrame, want: int, key: str, least: int) -> DataFrame:
    """a, b, shared, signals of the best so many pairs of owners (key, t).

    Of a class's members only the first want + 1 can be in them, and of two classes' members
    the i-th and the j-th only where i * j pairs before them leave room. A count that so many
    pairs are known to reach bounds the join: the shorter lists take no part, and of the
    others all but the rarest tokens are left out. Pairs of one class bound it, and those that
    share a token of few classes; then what the join has found bounds what is paired.
    """
    ranked = first_n(lists, ["t"], [key], want + 1)
    classes = ranked.groupBy("t").agg(F.sort_array(F.collect_list(key)).alias("k")).select("t", "k", F.col("k")[0].alias("rep"), F.size("k").cast("long").alias("m")).checkpoint()
    alike = F.least(F.col("m") * (F.col("m") - 1) / 2, F.lit(float(want)))
    inside = {r["n"]: r["pairs"] for r in classes.groupBy(F.size("t").alias("n")).agg(F.sum(alike).alias("pairs")).collect()}
    bound = max(least, _reached(inside, want))
    if classes.where(F.size("t") >= bound).count() > MANY_CLASSES:
        sides = classes.where(F.size("t") > bound)
        tokens = sides.select("rep", F.explode("t").alias("token"))
        few = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(2, FEW_CLASSES)), "token")
        met = few.select("token", F.col("rep").alias("ra")).join(few.select("token", F.col("rep").alias("rb")), "token").where("ra < rb").select("ra", "rb").distinct()
        found = _shared(met, sides, []).groupBy(F.size("t").alias("n")).agg(F.count("*").cast("double").alias("pairs"))
        between = {r["n"]: r["pairs"] for r in found.collect()}
        bound = max(bound, _reached({n: inside.get(n, 0) + between.get(n, 0) for n in {*inside, *between}}, want))
    able = classes.where(F.size("t") >= bound)
    own = able.where("m > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), "t")
    pairs = _class_pairs(able, bound, []).unionByName(own)
    sides = [able.select(F.col("rep").alias(f"r{s}"), F.col("k").alias(f"k{s}"), F.col("m").alias(f"m{s}")) for s in "ab"]
    held = pairs.join(sides[0], "ra").join(sides[1], "rb").withColumn("shared", F.size("t").cast("long")).checkpoint()
    weight = F.when(F.col("ra") == F.col("rb"), F.col("ma") * (F.col("ma") - 1) / 2).otherwise(F.col("ma") * F.col("mb"))
    counted = {r["shared"]: r["pairs"] for r in held.groupBy("shared").agg(F.sum(F.least(weight, F.lit(float(want)))).alias("pairs")).collect()}
    held = held.where(F.col("shared") >= _reached(counted, want))
    same, i = F.col("ra") == F.col("rb"), F.col("i") + 1
    first = F.when(same, i + 1).otherwise(F.lit(1))
    last = F.floor(F.when(same, want / i + (i + 1) / 2).otherwise(want / i)).cast("int")
    near = held.select("ra", "rb", "t", "shared", "kb", F.posexplode("ka").alias("i", "x"))
    met = near.withColumn("y", F.explode(F.slice("kb", first, F.greatest(last - first + 1, F.lit(0)))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", _signals(F.col("t")).alias("signals")).orderBy(F.desc("shared"), "a", "b").limit(want)


def _reached(pairs: dict[int, float], want: int) -> int:
    """The largest count that so many pairs reach, of {count: pairs}; 0 if all together are fewer."""
    total = 0.0
    for n in sorted(pairs, reverse=True):
        total += pairs[n]
        if total >= want:
            return n
    return 0


def duplicate_names(entities: DataFrame) -> DataFrame:
    """a, b with a < b whose names are alike once normalised to more than three letters."""
    named = entities.select("name", normalised_name(F.col("name")).alias("norm")).where(F.length("norm") > 3)
    left, right = named.select(F.col("name").alias("a"), "norm"), named.select(F.col("name").alias("b"), "norm")
    return left.join(right, "norm").where("a < b").select("a", "b")


def duplicate_merges(entities: DataFrame) -> DataFrame:
    """a, b: each name b whose normalised form a smaller name has, with the smallest such name a.

    These are the pairs of duplicate_names that a plan in the order of names takes, a row a
    name that goes instead of all pairs of a group.
    """
    named = entities.select("name", normalised_name(F.col("name")).alias("norm")).where(F.length("norm") > 3)
    first = named.groupBy("norm").agg(F.min("name").alias("a"))
    return named.join(first, "norm").where("a < name").select("a", F.col("name").alias("b"))


def type_renames(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """name, from_type, to_type where the mapping (from_type, to_type) asks for another type."""
    return entities.select("name", F.col("entity_type").alias("from_type")).join(mapping, "from_type").where("from_type != to_type").select("name", "from_type", "to_type")


def discover(g: Graph, mapping: DataFrame | None = None) -> dict[str, DataFrame]:
    """renames, merges and candidate relations; types go by the default mapping unless another is given."""
    mapping = default_mapping(g.entities.sparkSession) if mapping is None else mapping
    candidates = best_shared(entity_tokens(g), relations=g.relations)
    return {"renames": type_renames(g.entities, mapping), "merges": duplicate_merges(g.entities), "candidates": candidates}


def chunks(entities: DataFrame, size: int = 150) -> DataFrame:
    """name, chunk: consecutive entities in the order of their names, size to a chunk."""
    return numbered(entities.select("name"), ["name"]).select("name", F.floor(F.col("n") / size).cast("long").alias("chunk"))


def chunk_edges(g: Graph, size: int = 150) -> DataFrame:
    """src, dst, relation_type, chunk: the relations with both ends in one chunk."""
    placed = chunks(g.entities, size)
    ends = g.relations.join(placed.select(F.col("name").alias("src"), "chunk"), "src")
    return ends.join(placed.select(F.col("name").alias("dst"), "chunk"), ["dst", "chunk"]).select(*TRIPLE, "chunk")


#: Pairs that a model is asked about in one chunk.
CHUNK_CANDIDATES = 25


def chunk_candidates(g: Graph, size: int = 150, least: int = MIN_SHARED, most: int = CHUNK_CANDIDATES) -> DataFrame:
    """chunk, a, b, shared, signals of pairs within one chunk, the best of each: what a model is asked about, chunk by chunk.

    Tokens are those of the name and of the first three observations. Only owners of one
    chunk meet, so a token makes at most size * size / 2 pairs in it.
    """
    placed = chunks(g.entities, size)
    named = g.entities.select("name", F.explode(graph_tokens(F.col("name"))).alias("token"))
    tokens = entity_tokens(g).unionByName(named).distinct().join(placed, "name")
    pairs = unrelated(shared_tokens(tokens, least=least, within=["chunk"]), g.relations)
    return first_n(pairs, ["chunk"], [F.desc("shared"), "a", "b"], most).select("chunk", "a", "b", "shared", "signals")


def shortlist(found: dict[str, DataFrame], most: int = MAX_CANDIDATES, least: int = MIN_SHARED) -> dict[str, DataFrame]:
    """What is certain, merges and renames, and what needs a judge: the `most` best candidates that share enough."""
    merges = found["merges"].select(F.col("a").alias("keep"), F.col("b").alias("remove"))
    renames = found["renames"].select("name", "to_type")
    needed = found["candidates"].where(F.col("shared") >= least).orderBy(F.desc("shared"), "a", "b").limit(most).select("a", "b", "shared")
    return {"merges": merges, "renames": renames, "candidates": needed}


def rank(candidates: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """Candidates with similarity and score, best first; the lexical stand-in without vectors."""
    if similarities is None:
        ranked = candidates.withColumn("similarity", lexical_similarity(F.col("shared"))).withColumn("score", F.col("similarity"))
    else:
        ranked = rerank(candidates, similarities)
    return ranked.orderBy(F.desc("score"), "a", "b")


def mentions(g: Graph, pairs: DataFrame) -> DataFrame:
    """pairs with name_in_obs: an observation of one end holds the other end's name."""
    both = pairs.select("a", "b", F.col("a").alias("holder"), F.col("b").alias("held")).unionByName(pairs.select("a", "b", F.col("b").alias("holder"), F.col("a").alias("held")))
    found = both.join(g.observations.select(F.col("name").alias("holder"), "content"), "holder", "left").groupBy("a", "b").agg(F.max(F.coalesce(F.contains(F.lower("content"), F.lower("held")), F.lit(False))).alias("name_in_obs"))
    return pairs.join(found, ["a", "b"], "left")


Judge = Callable[[pd.DataFrame], pd.DataFrame]
Single = Callable[[str, str], str | None]


def judge_pairs(pairs: DataFrame, judge: Judge, single: Single | None = None, size: int = 20) -> DataFrame:
    """a, b, similarity, relation_type, by, opens, answered of pairs (a, b, shared, similarity, score) that a judge names.

    Pairs go in batches of a size, best scores first, each a call of judge(frame), which
    returns a, b and relation_type of those it can name; a call that raises names none. Of a
    pair's names the first counts, one without a type is `references`, and a type outside
    the allowed ones is no name. Each pair that its batch left out is asked about once more
    by single(a, b), whose reply is searched for an allowed type. by is batch, single or
    none; opens marks one row a batch, and answered says whether its call came back.
    """
    numbered_pairs = numbered(pairs.select("a", "b", "shared", "similarity", "score"), [F.desc("score"), "a", "b"]).withColumn("batch", F.floor(F.col("n") / size))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n", ignore_index=True)
        named: dict[tuple, str] = {}
        try:
            said = judge(frame[["a", "b", "shared", "similarity", "score"]].copy())
            came = said is not None
        except Exception:  # noqa: BLE001  a judge may be any service
            said, came = None, False
        known = set(zip(frame["a"], frame["b"], strict=True))
        if came:
            for a, b, kind in zip(said["a"], said["b"], said["relation_type"], strict=True):
                kind = "references" if pd.isna(kind) else kind
                if (a, b) in known and kind in ALLOWED:
                    named.setdefault((a, b), kind)
        kinds, by = [], []
        for pair in zip(frame["a"], frame["b"], strict=True):
            kind, how = named.get(pair), "batch"
            if kind is None:
                kind = allowed_type(single(*pair)) if single else None
                how = "single" if kind else "none"
            kinds.append(kind), by.append(how)
        return pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": frame["similarity"], "relation_type": kinds, "by": by, "opens": frame.index == 0, "answered": came})

    kinds = dict(pairs.dtypes)
    return numbered_pairs.groupBy("batch").applyInPandas(run, f"a {kinds['a']}, b {kinds['b']}, similarity double, relation_type string, by string, opens boolean, answered boolean")


def allowed_type(reply: str | None) -> str | None:
    """The longest allowed relation type that stands in a reply as a word; of equally long ones the first by name."""
    found = {t for t in ALLOWED if re.search(rf"\b{t}\b", (reply or "").lower())}
    return min(found, key=lambda t: (-len(t), t), default=None)


def health_counters() -> list[Column]:
    """What validate counts while it runs, over all candidates: a Column a counter."""
    by = F.col("by")
    counted = {
        "candidates_in": F.count(F.lit(1)), "weak": F.count_if(by == "weak"), "named_by_rules": F.count_if(by.isin("rule", "mention")), "batch_calls_attempted": F.count_if("opens"),
        "batch_calls_succeeded": F.count_if(F.col("opens") & F.col("answered")), "named_by_batch": F.count_if(by == "batch"), "single_pair_fallbacks": F.count_if(by.isin("single", "none")), "single_pair_returns_none": F.count_if(by == "none"),
    }
    return [v.alias(k) for k, v in counted.items()]


def validate(
    g: Graph, ranked: DataFrame, rules: DataFrame | None = None, validator: Callable[[DataFrame], DataFrame] | None = None, judge: Judge | None = None, single: Single | None = None, size: int = 20, health: Observation | None = None,
) -> DataFrame:
    """src, dst, relation_type, confidence of the candidates that a rule, a mention, the validator or the judge names.

    Weak candidates without a mention go. Rules by type, whatever its case, come first, the
    default ones unless others are given, then mentions, which make references. What is left
    goes to the validator as a frame, which may name allowed types only, or to judge_pairs.
    confidence is the rounded similarity. health, if given, has health_counters() of the
    run once an action has used the result, counted on the way and not by jobs of their own.
    """
    rules = default_rules(g.entities.sparkSession) if rules is None else rules
    ruled_types = rules.select(F.lower("from_type").alias("a_type"), F.lower("to_type").alias("b_type"), "relation_type")
    types = g.entities.select("name", F.lower(F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("unknown"))).alias("type"))
    typed = mentions(g, ranked).join(types.select(F.col("name").alias("a"), F.col("type").alias("a_type")), "a", "left").join(types.select(F.col("name").alias("b"), F.col("type").alias("b_type")), "b", "left")
    by = F.when((F.col("similarity") < WEAK) & ~F.col("name_in_obs"), "weak").when(F.col("relation_type").isNotNull(), "rule").when(F.col("name_in_obs"), "mention")
    marked = typed.join(ruled_types, ["a_type", "b_type"], "left").withColumn("by", by)
    kind = F.when(F.col("by") == "rule", F.col("relation_type")).when(F.col("by") == "mention", "references")
    no = F.lit(False)
    if judge is not None or validator is not None:
        ensure_checkpoints(g.entities.sparkSession)
        marked = marked.checkpoint()
    shape = ["a", "b", "similarity", "relation_type", "by", "opens", "answered"]
    decided = marked.where("by is not null") if judge is not None or validator is not None else marked.withColumn("by", F.coalesce("by", F.lit("none")))
    out = decided.select("a", "b", "similarity", kind.alias("relation_type"), "by", no.alias("opens"), no.alias("answered"))
    asked = marked.where("by is null").select("a", "b", "shared", "similarity", "score")
    if judge is not None:
        out = out.unionByName(judge_pairs(asked, judge, single, size).select(shape))
    elif validator is not None:
        said = validator(asked).where(F.col("relation_type").isin(ALLOWED))
        out = out.unionByName(said.select("a", "b", F.col("confidence").alias("similarity"), "relation_type", F.lit("batch").alias("by"), no.alias("opens"), no.alias("answered")))
    if health is not None:
        out = out.observe(health, *health_counters())
    confidence = F.when(F.col("by") == "batch", F.col("similarity")).otherwise(F.round("similarity", 3)) if judge is None else F.round("similarity", 3)
    return out.where("relation_type is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation_type", confidence.alias("confidence"))


def validator_health(candidates: DataFrame, named: DataFrame, asked: DataFrame, answered: DataFrame, again: DataFrame) -> DataFrame:
    """One row of counters over frames of a run that is past: candidates that came in, were named without the validator, were asked of it in batches, answered, and asked again one by one without an answer."""
    parts = [("candidates_in", candidates), ("named_by_rules", named), ("batch_asked", asked), ("batch_answered", answered), ("single_asked", asked.join(answered.select("a", "b"), ["a", "b"], "left_anti"))]
    counted = [df.agg(F.count("*").alias(name)) for name, df in parts]
    counted.append(parts[-1][1].join(again.select("a", "b"), ["a", "b"], "left_anti").agg(F.count("*").alias("single_none")))
    return reduce(lambda x, y: x.join(y, F.lit(True)), counted)


def parse_relation_type(reply: Column) -> Column:
    """The longest allowed type that stands in a reply as a word, wherever it stands; of equally long ones the first by name."""
    names = "|".join(sorted(ALLOWED, key=lambda t: (-len(t), t)))
    found = F.regexp_extract_all(F.lower(reply), F.lit(rf"\b({names})\b"), F.lit(1))
    return F.array_min(F.transform(found, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))["t"]


# --- apply


def merge_targets(spark: SparkSession, merges: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """remove, keep: a plan (pos, keep, remove) settled in order; merges of what has gone are skipped.

    Rows with an empty name or twice the same one are no merges; equal pos go by the names.
    A merge is taken once no earlier open one removes either of its names; later ones that
    name what it removes are skipped. Rounds of that run as joins until at most fold_rows
    are open, and these one task folds in order. Chains of keep are then followed by
    pointer jumping. No plan is cut and none passes through the driver.
    """
    ensure_checkpoints(spark)
    taken: list[DataFrame] = []
    left = merges.select("pos", "keep", "remove").where("keep != '' and remove != '' and keep != remove").distinct().checkpoint()
    at = F.struct("pos", "keep", "remove")
    while left.count() > fold_rows:
        first = left.groupBy("remove").agg(F.min(at).alias("first"))
        ends = first.select(F.col("remove").alias("keep"), F.col("first").alias("first_keep"))
        ready = (F.col("first") == at) & F.coalesce(F.col("first_keep") > at, F.lit(True))
        marked = left.join(first, "remove").join(ends, "keep", "left").select("pos", "keep", "remove", ready.alias("ready")).checkpoint()
        taken.append(marked.where("ready").select("remove", "keep"))
        gone = marked.where("ready").select("remove", at.alias("gone"))
        rest = marked.where("not ready").select("pos", "keep", "remove").join(gone, "remove", "left").join(gone.select(F.col("remove").alias("keep"), F.col("gone").alias("gone_keep")), "keep", "left")
        left = rest.where(F.coalesce(F.col("gone") > at, F.lit(True)) & F.coalesce(F.col("gone_keep") > at, F.lit(True))).select("pos", "keep", "remove").checkpoint()
    taken.append(left.repartition(1).sortWithinPartitions("pos", "keep", "remove").select("remove", "keep").mapInArrow(_fold, _TARGETS))
    targets = reduce(DataFrame.unionByName, taken).checkpoint()
    while not targets.join(targets.select(F.col("remove").alias("keep")), "keep", "left_semi").isEmpty():
        ahead = targets.select(F.col("remove").alias("keep"), F.col("keep").alias("further"))
        targets = targets.join(ahead, "keep", "left").select("remove", F.coalesce("further", "keep").alias("keep")).checkpoint()
    return targets


_TARGETS = "remove string, keep string"


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merges that are taken out of (remove, keep) in the order of the plan."""
    gone: dict[str, str] = {}
    for batch in batches:
        for remove, keep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if keep not in gone and remove not in gone:
                gone[remove] = keep
    yield pa.RecordBatch.from_arrays([pa.array(gone.keys(), pa.string()), pa.array(gone.values(), pa.string())], names=["remove", "keep"])


def apply_renames(g: Graph, renames: DataFrame) -> Graph:
    """renames(name, to_type). Of several for one name the last one by pos holds, without pos the largest type; empty ones are skipped."""
    order = F.col("pos") if "pos" in renames.columns else F.col("to_type")
    last = renames.where("name != '' and to_type != ''").groupBy("name").agg(F.max(F.struct(order.alias("o"), "to_type"))["to_type"].alias("to_type"))
    joined = g.entities.join(last, "name", "left").withColumn("entity_type", F.coalesce("to_type", "entity_type"))
    return replace(g, entities=joined.select(g.entities.columns))


def apply_merges(g: Graph, targets: DataFrame) -> Graph:
    """targets(remove, keep): observations move without repeats, relations are rewired.

    An entity that a rewired relation leads back to itself loses its loops, older ones included;
    the loops of other entities stay.
    """
    names = g.entities.select(F.col("name").alias("keep"))
    sound = targets.join(names, "keep", "left_semi").join(g.entities.select(F.col("name").alias("remove")), "remove", "left_semi")

    def moved(df: DataFrame, col: str) -> DataFrame:
        return df.join(sound.withColumnRenamed("remove", col), col, "left").withColumn(f"{col}_was", F.col(col)).withColumn(col, F.coalesce("keep", col)).drop("keep")

    observations = first_n(moved(g.observations, "name").withColumn("own", (F.col("name") != F.col("name_was")).cast("int")), ["name", "content"], ["own", "obs_id"], 1).select(g.observations.columns)
    wired = moved(moved(g.relations, "src"), "dst")
    loops = wired.where("src = dst")
    arisen = loops.where("src_was != src or dst_was != dst").select("src").distinct()
    sound_ones = wired.where("src != dst").unionByName(loops.join(arisen, "src", "left_anti"))
    relations = sound_ones.groupBy(TRIPLE).agg(F.min("created_at").alias("created_at"))
    return Graph(g.entities.join(sound.select(F.col("remove").alias("name")), "name", "left_anti"), observations, relations.select(g.relations.columns))


def new_relations(g: Graph, new: DataFrame, now: Column) -> DataFrame:
    """The relations of new(src, dst, relation_type) whose ends both exist and that the graph lacks, once each."""
    names = g.entities.select("name")
    fit = new.select(TRIPLE).where("src != '' and dst != '' and relation_type != ''").distinct().join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").join(g.relations.select(TRIPLE), TRIPLE, "left_anti")
    return fit.select(*TRIPLE, now.alias("created_at"))


def apply_relations(g: Graph, new: DataFrame, now: Column) -> Graph:
    """new(src, dst, relation_type): added where both ends exist and the triple doesn't."""
    return replace(g, relations=g.relations.unionByName(new_relations(g, new, now)))


def apply_plan(g: Graph, plan: dict[str, DataFrame], now: Column) -> Graph:
    """A plan's parts in this order: renames(name, to_type), merges(pos, keep, remove), entities(pos, name, entity_type, observations), relations(src, dst, relation_type).

    Parts may be missing, and others are ignored. Merges count only where both names exist, so
    one with an unknown name stands in no other's way. Entities without a type are summaries;
    names that exist by then are left as they are. Relations may name the added entities.
    """
    if "renames" in plan:
        g = apply_renames(g, plan["renames"])
    if "merges" in plan:
        names = g.entities.select("name")
        known = plan["merges"].join(names.withColumnRenamed("name", "keep"), "keep", "left_semi").join(names.withColumnRenamed("name", "remove"), "remove", "left_semi")
        g = apply_merges(g, merge_targets(g.entities.sparkSession, known))
    if "entities" in plan:
        named = plan["entities"].where("name != ''").withColumn("entity_type", F.coalesce("entity_type", F.lit("summary")))
        g, _ = create_entities(g, named, now)
    if "relations" in plan:
        g = apply_relations(g, plan["relations"], now)
    return g


def reconcile(observed: DataFrame, planned: DataFrame, live: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Three states of a table by key: what to do with each row. Rows that others changed meanwhile stay.

    action is insert, update, delete, keep or conflict.
    """
    o, p, v = (df.select(*keys, F.col(value).alias(n), F.lit(True).alias(f"in_{n}")) for df, n in ((observed, "o"), (planned, "p"), (live, "v")))
    joined = o.join(p, keys, "full_outer").join(v, keys, "full_outer").fillna(False, ["in_o", "in_p", "in_v"])
    moved = (F.col("in_o") != F.col("in_v")) | ~F.col("o").eqNullSafe(F.col("v"))
    changed = (F.col("in_o") != F.col("in_p")) | ~F.col("o").eqNullSafe(F.col("p"))
    action = F.when(~changed, "keep").when(moved & ((F.col("in_p") != F.col("in_v")) | ~F.col("p").eqNullSafe(F.col("v"))), "conflict").when(~F.col("in_p"), F.when(F.col("in_v"), "delete").otherwise("keep")).when(F.col("in_v"), F.when(F.col("p").eqNullSafe(F.col("v")), "keep").otherwise("update")).otherwise("insert")
    return joined.select(*keys, action.alias("action"), "p")


def plan_warnings(plan: dict[str, DataFrame]) -> list[str]:
    """What a plan lacks; none of it stops an application."""
    need = {"renames": {"name", "to_type"}, "merges": {"pos", "keep", "remove"}, "relations": set(TRIPLE)}
    return [f"{part} lacks {sorted(cols - set(plan[part].columns))}" for part, cols in need.items() if part in plan and cols - set(plan[part].columns)]


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """max(dE, 0) + max(dO, 0) between two one-row counts, for gates on growth."""
    b = before.select(F.col("n_entities").alias("e0"), F.col("n_observations").alias("o0"))
    return b.join(after, F.lit(True)).select((F.greatest(F.col("n_entities") - F.col("e0"), F.lit(0)) + F.greatest(F.col("n_observations") - F.col("o0"), F.lit(0))).alias("growth"))


STAGES = ["discover", "rank", "validate", "apply"]


def run_stages(
    spark: SparkSession, g: Graph, run_dir: str, mapping: DataFrame | None = None, rules: DataFrame | None = None, similarities: DataFrame | None = None, from_stage: str = "discover", now: Column | None = None,
    judge: Judge | None = None, single: Single | None = None, health: Observation | None = None,
) -> Graph:
    """The stages, each written below run_dir; those before from_stage are read back. The graph with the whole plan applied is returned.

    discover writes candidates, and beside them renames and merges. apply writes the relations
    that are added; the tables of the graph are the caller's to store.
    """
    if from_stage not in STAGES:
        raise ValueError(f"no stage {from_stage!r}")
    skip = STAGES.index(from_stage)

    def stage(name: str, made: Callable[[], DataFrame], part: str = "") -> DataFrame:
        k = STAGES.index(name)
        path = f"{run_dir}/{k + 1:02d}_{name}{part}"
        if k >= skip:
            made().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    new = discover(g, mapping) if skip == 0 else {}
    found = stage("discover", lambda: new["candidates"])
    renames = stage("discover", lambda: new["renames"], "_renames")
    merges = stage("discover", lambda: new["merges"], "_merges")
    ranked = stage("rank", lambda: rank(found, similarities))
    named = stage("validate", lambda: validate(g, ranked, rules, judge=judge, single=single, health=health))
    when = F.current_timestamp() if now is None else now
    certain = apply_plan(g, {"renames": renames, "merges": merges.select(F.lit(0).alias("pos"), F.col("a").alias("keep"), F.col("b").alias("remove"))}, when)
    fit = stage("apply", lambda: new_relations(certain, named, when))
    return replace(certain, relations=certain.relations.unionByName(fit.select(certain.relations.columns)))


def list_runs(spark: SparkSession, root: str) -> list[str]:
    """The runs below a folder, newest names first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True) if fs.exists(path) else []
