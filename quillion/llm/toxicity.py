"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps each word of a clause to a class: insult, harm verb, target, negator, reporting verb, modal,
quotation mark or other. Four further transducers read that string of classes and keep, in their states, whether the
scope of a negator is open, whether the clause reports someone's speech or stands in quotation marks, whether a target
is near, and whether a modal precedes (so that a harm verb is a threat). ``compose`` builds their product once; running
it over a clause emits, for every insult or threat, the pattern it stands in. A pattern's weight is that of its kind
(insult or threat, aimed at a target or not) times the weights of the arcs that it went through: ``NEGATED`` and
``REPORTED`` words count little. A clause's score is the sum over its patterns of weight times the damped sum of lexical
weights; a document's is the logistic function of a bias and its clauses' scores, and of nothing else.

Weights are learned from labelled rows outside the held-out fold. A lexical arc (a word, or a stem of four to six
letters) weighs its shrunken log odds ratio, from one half of a bounded sample; it is a harm verb if it follows a modal
in half of its toxic contexts, and an insult otherwise. Words of the other classes are never learned as either. The
weights of the four kinds and the bias are a ridge-regularised logistic regression towards prior values, from the other
half. How many arcs are learned is bounded by the sample alone, as each takes six toxic contexts.

Defined results: null and empty texts, and texts without a matched clause, score as the bias alone (above 0, below
0.5 unless most labelled rows are toxic); without labelled rows the seed words and prior weights are used; of several
labels for one id or one text, the largest counts; repeated rows score alike; very long texts are scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import store
from quillion.llm.words import give_back

#: Labelled rows that a fit reads at most, in expectation.
SAMPLE_ROWS = 16_000
STEMS = (4, 5, 6)

OTHER, INSULT, HARM, TARGET, NEGATOR, REPORT, MODAL, QUOTE = range(8)

SEED_INSULTS = "idiot moron stupid loser clown scum trash pathetic worthless disgusting imbécile crétin débile dummkopf trottel idiota imbécil estúpido".split()
CLASS_WORDS = {
    HARM: "kill hurt destroy beat burn crush stab shoot tuer frapper détruire brûler töten schlagen verbrennen zerstören matar golpear destruir quemar".split(),
    TARGET: "you your yours he she they them him her people everyone tu toi vous ton votre ils elles lui du dich dir ihr euch sie er tú ti usted ustedes ellos ellas él ella".split(),
    NEGATOR: "not no never neither nor without hardly isn aren wasn don doesn didn ne pas jamais sans aucun nicht kein keine nie niemals ohne nunca jamás sin tampoco".split(),
    REPORT: "said says wrote writes claimed claims quoted quotes reported reportedly called allegedly dit disait écrit affirme sagte sagt schrieb behauptet dijo dice escribió afirma".split(),
    MODAL: "will shall going gonna must should want vais va veux dois werde wird will muss voy va quiero debo".split(),
}
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD_OR_QUOTE = re.compile(r"\w+|[\"“”«»„]")
WORD = re.compile(r"\w+")


# --- the grammar -----------------------------------------------------------------------------------------------------


def _negation(state: int, symbol: int) -> int:
    """Words that the scope of the last negator still covers."""
    return 3 if symbol == NEGATOR else max(0, state - 1)


def _report(state: int, symbol: int) -> int:
    """0: own voice; 1: after a reporting verb; 2: inside quotation marks."""
    if symbol == QUOTE:
        return 1 if state == 2 else 2
    return 1 if symbol == REPORT and state == 0 else state


def _target(state: int, symbol: int) -> int:
    """Words for which the last target is near."""
    return 5 if symbol == TARGET else max(0, state - 1)


def _modal(state: int, symbol: int) -> int:
    return 3 if symbol == MODAL else max(0, state - 1)


TRANSDUCERS = ((_negation, 4), (_report, 3), (_target, 6), (_modal, 4))
PATTERNS = 16


def compose(transducers=TRANSDUCERS) -> tuple[list, list]:
    """The product of the transducers: next state and output by [state * 8 + symbol]; state 0 is the start, output -1 is none.

    Outputs 0 to 7 are insults, 8 to 15 threats; bit 0 is negated, bit 1 reported, bit 2 aimed at a target.
    """
    states = list(product(*(range(n) for _, n in transducers)))
    number = {s: i for i, s in enumerate(states)}
    step, out = [], []
    for s in states:
        for symbol in range(8):
            step.append(number[tuple(f(x, symbol) for (f, _), x in zip(transducers, s, strict=True))])
            marks = (s[0] > 0) + 2 * (s[1] > 0) + 4 * (s[2] > 0)
            out.append(marks if symbol == INSULT else 8 + marks if symbol == HARM and s[3] > 0 else -1)
    return step, out


STEP, OUT = compose()
#: What is left of a match in the scope of a negator, and in reported speech.
NEGATED, REPORTED = 0.1, 0.3
#: Kinds of patterns: insult, aimed insult, threat, aimed threat. The kind and the arcs' weight of each pattern.
KIND = np.array([2 * (p >= 8) + (p & 4 > 0) for p in range(PATTERNS)])
ARCS = np.array([(NEGATED if p & 1 else 1.0) * (REPORTED if p & 2 else 1.0) for p in range(PATTERNS)])
#: Before any label is seen: the weights of the kinds.
PRIOR = np.array([1.0, 1.3, 1.5, 2.0])


@dataclass(frozen=True)
class Grammar:
    words: dict = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, 2.0))  # insult word -> weight
    stems: dict = field(default_factory=dict)  # prefix of insults -> weight
    harm: dict = field(default_factory=dict)  # learned harm verb -> weight
    kinds: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -2.0

    def __post_init__(self):
        learned = {w: (INSULT, x) for w, x in self.words.items()} | {w: (HARM, x) for w, x in self.harm.items()}
        object.__setattr__(self, "lexical", learned | {w: (c, 1.0) for c, ws in CLASS_WORDS.items() for w in ws})
        object.__setattr__(self, "matching", frozenset(w for w, (c, _) in self.lexical.items() if c in (INSULT, HARM)))
        object.__setattr__(self, "patterns", self.kinds[KIND] * ARCS)

    def _lookup(self, word: str) -> tuple[int, float]:
        if found := self.lexical.get(word):
            return found
        for n in reversed(STEMS):
            if len(word) >= n and (x := self.stems.get(word[:n])):
                return INSULT, x
        return (QUOTE, 1.0) if word in '"“”«»„' else (OTHER, 0.0)

    def matches(self, text: str | None) -> list[tuple[int, int, float]]:
        """(clause number, pattern, lexical weight) of every insult and threat of the text."""
        if not text:
            return []
        low = text.lower()
        distinct = set(WORD.findall(low))
        stems, hit = self.stems, not distinct.isdisjoint(self.matching)
        if not hit and stems:
            hit = any(not stems.keys().isdisjoint({w[:n] for w in distinct}) for n in STEMS)
        if not hit:
            return []
        found = []
        for number, clause in enumerate(CLAUSE.split(low)):
            state = 0
            for word in WORD_OR_QUOTE.findall(clause):
                symbol, weight = self._lookup(word)
                if (pattern := OUT[state * 8 + symbol]) >= 0:
                    found.append((number, pattern, weight))
                state = STEP[state * 8 + symbol]
        return found

    def sums(self, text: str | None) -> dict[int, np.ndarray]:
        """clause number -> the damped sum of lexical weights in each pattern, of the matched clauses."""
        totals: dict[int, np.ndarray] = {}
        for number, pattern, weight in self.matches(text):
            totals.setdefault(number, np.zeros(PATTERNS))[pattern] += weight
        return {number: np.log1p(x) for number, x in totals.items()}

    def features(self, text: str | None) -> np.ndarray:
        """What each kind adds to the clauses' scores at weight 1."""
        return np.bincount(KIND, ARCS * sum(self.sums(text).values(), np.zeros(PATTERNS)), 4)

    def clauses(self, text: str | None) -> list[tuple[int, float]]:
        """(clause number, score) of the matched clauses."""
        return [(number, float(x @ self.patterns)) for number, x in self.sums(text).items()]

    def score(self, text: str | None) -> float:
        total = self.bias + sum(s for _, s in self.clauses(text))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


# --- learning --------------------------------------------------------------------------------------------------------


def contexts(text: str | None) -> list[str]:
    """Distinct "word before, word after, entry" of a text, where an entry is a word or a stem behind a circumflex."""
    words = WORD.findall(text.lower()) if text else []
    found = set()
    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
        found.add(f"{before} {after} {word}")
        found.update(f"{before} {after} ^{word[:n]}" for n in STEMS if len(word) > n)
    return sorted(found)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of the kinds and bias: logistic regression drawn towards the prior weights, by Newton's method."""
    if not len(y) or not 0 < y.sum() < len(y):
        return PRIOR.copy(), -2.0
    share = (y.sum() + 1) / (len(y) + 2)
    prior = np.concatenate([PRIOR, [np.log(share / (1 - share))]])
    pull = np.concatenate([np.full(len(PRIOR), ridge), [1e-3]])
    full, w = np.hstack([x, np.ones((len(x), 1))]), prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -35, 35)))
        gradient = full.T @ (p - y) + pull * (w - prior)
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar whose weights come from about ``sample_rows`` labelled rows at most; held-out rows are never read.

    A word counts once for each pair of neighbours, not for each document, so that exact and near copies of one toxic
    text do not make its rare words look toxic.
    """
    rows = store.labelled_sample(docs, labels, label, sample_rows).groupBy("text").agg(F.max("label").alias("label"))
    rows = store.materialise(rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "toxic-sample")
    spark = docs.sparkSession

    def run(batches):
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 32):  # a text has some thousand contexts
                made = [(c, y) for t, y in zip(texts[i : i + 32], labels[i : i + 32], strict=True) for c in contexts(t)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.string()), pa.array([y for _, y in made], pa.int32())], names=["context", "label"])
        give_back()

    each = rows.where("half = 0").select("text", "label").mapInArrow(run, "context string, label int").groupBy("context").agg(F.max("label").alias("a"), F.min("label").alias("b"))
    modal = F.substring_index("context", " ", 1).isin(CLASS_WORDS[MODAL]).cast("int")
    seen = each.groupBy(F.substring_index("context", " ", -1).alias("entry")).agg(F.sum("a").alias("a"), F.sum(1 - F.col("b")).alias("b"), F.sum(F.col("a") * modal).alias("after_modal"))
    seen = store.materialise(seen, "toxic-entries")
    total = seen.where("entry not like '^%'").agg(F.sum("a"), F.sum("b")).first()
    toxic, clean = float(total[0] or 0), float(total[1] or 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    weight = F.log(a / (toxic + 1)) - F.log(b / (clean + 1))
    seen = seen.withColumn("weight", weight).withColumn("z", F.col("weight") / F.sqrt(1 / a + 1 / b)).withColumn("harm", F.col("after_modal") * 2 >= F.col("a"))
    known = [w for ws in CLASS_WORDS.values() for w in ws]
    seeds = F.col("entry").isin(SEED_INSULTS)
    kept = seen.where(((F.col("a") >= 6) & (F.col("weight") >= 2.5) & (F.col("z") >= 3.1) & ~F.col("entry").isin(known)) | seeds).select("entry", "weight", "harm", seeds.alias("seed")).collect()
    words, stems, harm = dict.fromkeys(SEED_INSULTS, 2.0), {}, {}
    for r in sorted(kept):
        if r["entry"][0] == "^":
            into = {} if r["harm"] else stems  # stems are of insults only
        else:
            into = harm if r["harm"] and not r["seed"] else words
        into[r["entry"].lstrip("^")] = float(np.clip(r["weight"], 0, 6))
    shared = spark.sparkContext.broadcast(Grammar(words, stems, harm))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shared.value.features(t).tolist())

    second = rows.where("half = 1").select("label", features("text").alias("x")).toPandas()  # four numbers a row of the bounded sample
    x = np.array(second["x"].tolist()).reshape(-1, len(PRIOR))
    order = np.lexsort((*x.T, second["label"]))  # so that sums don't depend on the order of arrival
    return Grammar(words, stems, harm, *calibrate(x[order], second["label"].to_numpy(float)[order]))


def scorer(spark: SparkSession, grammar: Grammar):
    """A column function text -> score. The grammar's size is bounded by that of the sample it was learned from."""
    shared = spark.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        g = shared.value
        return pd.Series([g.score(t if isinstance(t, str) else None) for t in text], dtype="float64")

    return score


def clause_scorer(spark: SparkSession, grammar: Grammar):
    """A column function text -> array of (clause, score), for explaining a decision."""
    shared = spark.sparkContext.broadcast(grammar)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("clause", T.IntegerType()), T.StructField("score", T.DoubleType())])))
    def of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"clause": c, "score": s} for c, s in shared.value.clauses(t if isinstance(t, str) else None)])

    return of
