"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns a clause's words into symbols with weights: INSULT, THREAT,
TARGET, NEGATION, REPORT, QUOTE or OTHER. Five more transducers are composed with it,
each a small automaton that reads a symbol and passes it on, its weight changed. Two read
from the clause's end: a threat is aimed at a target shortly after it, and what is quoted
before a word of saying is reported. Three read from its start: a negation shortly before
an insult weakens it; reported or quoted speech weakens what it reports, across a colon
too; a target nearby strengthens it; a threat counts only with a target. The sum of
what comes out is the clause's weight, in log-odds, and the clauses of a text combine as
independent evidence. Words outside a matched clause don't count.

The lexicon's weights are learned from labelled rows: log-odds of a word, or of a stem
that inflected words begin with, in toxic against other texts. Fixed words start with a
prior, which labels can overrule. Only rows outside the held-out fold are ever read.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import id_text, map_texts, materialize, slices

#: Labelled rows that the lexicon is fitted on at most, picked evenly by a hash of doc_id.
MAX_TRAINING_ROWS = 12_000
#: Learned entries at most, a bound on the model as MAX_TRAINING_ROWS is on the rows: the most surprising are taken.
MAX_LEXICON = 4_000
#: Lengths of stems, in letters.
STEMS = range(3, 9)
MIN_TOXIC_ROWS = 3
FOLDS = 5

# Words of each class.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile vermin filth"
THREATS = "kill murder destroy strangle stab"
TARGETS = "you your yours he him his she her they them their we us du dich dir ihr euch sie tu toi te vous tú ti vosotros usted yourself yourselves himself herself themselves everyone"
NEGATIONS = "not no never neither nor isn't aren't wasn't weren't don't nicht kein keine nie ne pas jamais nunca tampoco"
REPORTS = "said says say wrote writes told claimed called reported quoted sagte schrieb nannte dit disait écrit dijo decía escribió"

PRIOR = 3.0
#: Pseudo-rows that stand behind a prior, and behind a learned weight.
PRIOR_ROWS, SMOOTH = 4.0, 0.5
CLAUSE_END = re.compile(r"[.!?;\n]")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")


@dataclass(frozen=True)
class Model:
    """A learned lexicon and the curve from evidence to probability."""

    items: tuple[tuple[str, float], ...]
    slope: float
    offset: float

    def score(self, text: str) -> float:
        logit = self.slope * grammar(self.items).evidence(text) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(logit, 30.0))))


# --- learning


def in_fold(id_col: str = "doc_id"):
    """Whether a row belongs to the held-out fold."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of at most about `most` labelled rows outside the held-out fold.

    A document whose labels differ teaches nothing; labels that repeat count once. The
    chosen ids, a bounded list, go to the texts, which stay where they are.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~in_fold()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return docs.join(F.broadcast(usable), "doc_id").select("text", "toxic")


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic rows, rows: 'stem' for longer words that begin so, 'word$' for whole words."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    long_enough = F.filter(words, lambda w: F.length(w) > STEMS.start)
    stems = F.flatten(F.transform(long_enough, lambda w: F.transform(F.sequence(F.lit(STEMS.start), F.least(F.length(w) - 1, F.lit(STEMS.stop - 1))), lambda k: w.substr(F.lit(1), k))))
    whole = F.transform(F.filter(words, lambda w: F.length(w).between(STEMS.start, 40)), lambda w: F.concat(w, F.lit("$")))
    exploded = rows.select("toxic", F.explode(F.array_distinct(F.concat(stems, whole))).alias("feature"))
    return exploded.groupBy("feature").agg(F.sum("toxic").alias("toxic_rows"), F.count("*").alias("rows"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights by feature, the fixed words' included, from (text, toxic); bounded by MAX_LEXICON.

    A learned feature has to stand out beyond what chance gives among so many features.
    Of stems that begin one another the most surprising is taken; ordinary words that
    begin with a stem are taken as exceptions, with their own weight.
    """
    fixed = [f"{w}$" for w in f"{INSULTS} {THREATS}".split()]
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = totals["n"] or 0, totals["t"] or 0
    if not toxic or toxic == n:
        return dict.fromkeys(fixed, PRIOR)
    rate, clean = toxic / n, n - toxic
    counts = materialize(feature_counts(rows).where("toxic_rows >= 1 or rows >= 4"), "toxicity-features")
    share = F.col("toxic_rows") / F.col("rows")
    # log-likelihood ratio of the feature's toxic share against the overall rate
    surprise = F.when(F.col("toxic_rows") > 0, F.col("toxic_rows") * F.log(share / rate)).otherwise(0.0) + F.when(share < 1, (F.col("rows") - F.col("toxic_rows")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    strong = (F.col("toxic_rows") >= MIN_TOXIC_ROWS) & (share >= max(0.5, 2 * rate)) & (surprise >= 6 + 0.5 * math.log(n))
    kept = counts.where(strong | F.col("feature").isin(fixed)).withColumn("surprise", surprise).orderBy(F.desc("surprise"), F.desc(F.length("feature")), "feature").limit(MAX_LEXICON).collect()

    def weight(t: float, c: float) -> float:
        return math.log((t + SMOOTH) / (toxic + 1)) - math.log((c + SMOOTH) / (clean + 1))

    found = {r["feature"]: (r["toxic_rows"], r["rows"] - r["toxic_rows"]) for r in kept}
    weights: dict[str, float] = {}
    for feature in fixed:
        t, c = found.pop(feature, (0, 0))
        weights[feature] = (PRIOR * PRIOR_ROWS + weight(t, c) * (t + c)) / (PRIOR_ROWS + t + c)
    stems: set[str] = set()
    longer: set[str] = set()
    for feature in found:  # the most surprising first
        bare = feature.rstrip("$")
        parts = {bare[:k] for k in range(STEMS.start, len(bare) + (feature != bare))}
        if feature == bare and feature not in longer and not parts & stems:
            stems.add(feature)
            longer |= parts
        elif feature == bare or parts & stems:
            continue
        weights[feature] = weight(*found[feature])
    if stems:
        listed = rows.sparkSession.createDataFrame([(s,) for s in stems], "stem string")  # MAX_LEXICON rows at most
        starts = F.transform(F.sequence(F.lit(STEMS.start), F.least(F.length("feature") - 1, F.lit(STEMS.stop - 1))), lambda k: F.col("feature").substr(F.lit(1), k))
        ordinary = counts.where(F.col("feature").endswith("$") & (F.col("rows") >= 4) & (share < 0.5))
        begins = ordinary.withColumn("stem", F.explode(starts)).join(F.broadcast(listed), "stem").dropDuplicates(["feature"])
        for r in begins.orderBy(F.desc("rows"), "feature").limit(MAX_LEXICON).collect():
            weights.setdefault(r["feature"], min(1.0, weight(r["toxic_rows"], r["rows"] - r["toxic_rows"])))
    return weights


def fit_curve(evidence: list[float], toxic: list[int]) -> tuple[float, float]:
    """Slope and offset that turn evidence into log-odds, by Newton steps with a weak prior."""
    x, y = np.array(evidence, float), np.array(toxic, float)
    slope, offset = 1.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else -2.0
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([slope, offset])
    center, strength = beta.copy(), np.array([1.0, 0.1])

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(strength * (beta - center) ** 2))

    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - strength * (beta - center)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(strength), grad)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
    return max(0.05, float(beta[0])), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    """The lexicon and the curve, from labelled rows outside the held-out fold."""
    rows = materialize(training_rows(docs, labels, most), "toxicity-training")
    items = tuple(sorted(learn_lexicon(rows).items()))
    scored = map_texts(rows.select(F.col("toxic").cast("long").alias("doc_id"), "text"), lambda ids, texts: {"toxic": ids, "evidence": [grammar(items).evidence(t) for t in texts]}, "toxic long, evidence double")
    pairs = scored.collect()  # at most about `most` rows of two numbers
    return Model(items, *fit_curve([r["evidence"] for r in pairs], [r["toxic"] for r in pairs]))


# --- the grammar

Step = Callable[[tuple, str, float], tuple[tuple, str, float]]


def negation(state: tuple, symbol: str, weight: float) -> tuple[tuple, str, float]:
    """An insult or threat within three words after a negation keeps a quarter of its weight."""
    left = state[0] if state else 0
    if symbol == "NEGATION":
        return (3,), symbol, weight
    if symbol in ("INSULT", "THREAT") and left:
        weight *= 0.25
    return (max(0, left - 1),), symbol, weight


def reported(state: tuple, symbol: str, weight: float) -> tuple[tuple, str, float]:
    """After a word of saying, and inside quotation marks more so, weight is reported and not meant."""
    said, quoted = state or (False, False)
    if symbol == "REPORT":
        said = True
    elif symbol == "QUOTE":
        quoted = not quoted
    elif symbol in ("INSULT", "THREAT") and said:
        weight *= 0.4 if quoted else 0.6
    return (said, quoted), symbol, weight


def targeted(state: tuple, symbol: str, weight: float) -> tuple[tuple, str, float]:
    """A target within four words before strengthens an insult and makes a threat one."""
    left = state[0] if state else 0
    if symbol == "TARGET":
        return (4,), symbol, weight
    if symbol == "THREAT":
        return (max(0, left - 1),), "INSULT" if left else "OTHER", weight if left else 0.0
    if symbol == "INSULT" and left and weight > 0:
        weight += 0.7
    return (max(0, left - 1),), symbol, weight


def aimed(state: tuple, symbol: str, weight: float) -> tuple[tuple, str, float]:
    """Read from the end: a threat with a target within three words after it is aimed and counts."""
    left = state[0] if state else 0
    if symbol == "TARGET":
        return (3,), symbol, weight
    if symbol == "THREAT" and left:
        symbol = "INSULT"
    return (max(0, left - 1),), symbol, weight


def attributed(state: tuple, symbol: str, weight: float) -> tuple[tuple, str, float]:
    """Read from the end: a quotation that ends within four words before a word of saying is reported."""
    left, quoted = state or (0, False)
    if symbol == "REPORT":
        left = 5
    elif symbol == "QUOTE":
        quoted = not quoted and left > 0
    elif symbol in ("INSULT", "THREAT") and quoted:
        weight *= 0.4
    return (max(0, left - 1), quoted), symbol, weight


def compose(*steps: Step) -> Callable[[list[tuple[str, float]]], list[tuple[str, float]]]:
    """One transducer that passes a sequence of symbols through all steps."""

    def run(symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
        states: list[tuple] = [()] * len(steps)
        out = []
        for symbol, weight in symbols:
            for k, step in enumerate(steps):
                states[k], symbol, weight = step(states[k], symbol, weight)
            out.append((symbol, weight))
        return out

    return run


class Grammar:
    """The lexicon transducer and its composition with the others."""

    def __init__(self, weights: dict[str, float]):
        self.whole = {f[:-1]: w for f, w in weights.items() if f.endswith("$")}
        self.stems = {f: w for f, w in weights.items() if not f.endswith("$")}
        self.classes = dict.fromkeys(TARGETS.split(), "TARGET") | dict.fromkeys(NEGATIONS.split(), "NEGATION") | dict.fromkeys(REPORTS.split(), "REPORT")
        self.threats = set(THREATS.split())
        self.from_end, self.from_start = compose(aimed, attributed), compose(negation, reported, targeted)
        self.finder = ahocorasick.Automaton()
        for lexeme in {*self.whole, *self.stems}:
            self.finder.add_word(lexeme, len(lexeme))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        if word in self.threats:
            return "THREAT", self.whole[word]
        weight = self.whole.get(word)
        if weight is None:
            weight = max((self.stems[word[:k]] for k in STEMS if word[:k] in self.stems), default=None)
        if weight is not None:
            return "INSULT", weight
        return self.classes.get(word, "QUOTE" if word in "\"“”«»" else "OTHER"), 0.0

    def clauses(self, text: str) -> list[tuple[int, int]]:
        """Spans of the clauses that hold a lexeme at a word's start."""
        spans: list[tuple[int, int]] = []
        for last, length in self.finder.iter(text):
            start = last - length + 1
            if spans and start < spans[-1][1] or start and text[start - 1].isalnum():
                continue
            low = spans[-1][1] if spans else 0
            before = max(text.rfind(c, low, start) for c in ".!?;\n")
            after = CLAUSE_END.search(text, last)
            spans.append((max(low, before + 1), after.end() if after else len(text)))
        return spans

    def run(self, symbols: list[tuple[str, float]]) -> float:
        """The weight that a clause has after passing all transducers."""
        return sum(weight for symbol, weight in self.from_start(self.from_end(symbols[::-1])[::-1]) if symbol == "INSULT")

    def evidence(self, text: str) -> float:
        """The sum of the matched clauses' weights, bounded."""
        text = text.lower()
        total = 0.0
        for a, b in self.clauses(text):
            total += self.run([self.symbol(w) for w in WORD.findall(text[a:b])])
        return max(-10.0, min(total, 40.0))


@functools.lru_cache(maxsize=2)
def grammar(items: tuple[tuple[str, float], ...]) -> Grammar:
    return Grammar(dict(items))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of df.

    The lexicon is learned from df's own texts with labels' rows outside the held-out
    fold. A null or empty text has no evidence and the score that goes with it. Without
    labels the fixed words hold. A null doc_id is never labelled and not held out;
    repeated rows repeat their result; extra columns are not read.
    """
    docs = id_text(df, id_col, text_col)
    model = learn(docs, labels, most)
    scored = map_texts(docs, lambda ids, texts: {"doc_id": ids, "score": [model.score(t) for t in texts]}, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that score as toxic; columns as they were. A row with a null text stays."""
    model = learn(id_text(df, id_col, text_col), labels)
    text_at = df.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col=text_at):
            mask = [t is None or model.score(t) < 0.5 for t in part.column(text_at).to_pylist()]
            yield part.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(keep, df.schema)
