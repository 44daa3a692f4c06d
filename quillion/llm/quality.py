"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Features are the word unigrams and bigrams of the whole text (a word is a run of letters and digits, or a run of other
marks), hashed into ``2**bits`` coordinates; all bigrams that end in a word equal to one of the two words before it share
one coordinate, so that repetition counts whatever is repeated; a coordinate's value is its count over the square root of the number of
n-grams. Training runs FTRL-Proximal (per-coordinate rates, L1 and L2; the bias is one more coordinate, without L1, that
starts at the log odds of the labels) over a bounded sample of labelled rows; scoring is a sparse dot product, one pass
over the documents without a shuffle.

Defined results: null and empty texts score as the bias alone; repeated rows score alike; of several labels for one id
the largest counts; very long texts are scored whole; no labels at all (or one class only) give the share of
label 1 smoothed by one row of each kind, for every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm import store
from quillion.llm.words import TOKEN, batches_of, hashed, mix

#: Labelled rows, and characters of their texts, that a fit reads at most, in expectation; the driver holds them.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 100_000_000


def ngrams(texts: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of every n-gram of the texts, and where each text's run of them starts (one more entry than texts)."""
    tokens = [TOKEN.findall(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = hashed([w for ws in tokens for w in ws])
    if not len(flat):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(sizes)
    mask = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        one = (mix(flat) & mask).astype(np.int64)
        pair = flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]
        echo = flat[:-1] == flat[1:]
        echo[1:] |= flat[:-2] == flat[2:]
        two = (mix(np.where(echo, np.uint64(1), pair)) & mask).astype(np.int64)
    # the bigram that starts at a text's last word crosses into the next text
    doc = np.repeat(np.arange(len(texts)), sizes)
    within = doc[:-1] == doc[1:]
    owner = np.concatenate([doc, doc[:-1][within]])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    assert len(ends) == len(texts)
    return np.concatenate([one, two[within]])[order], np.concatenate([[0], np.cumsum(counts)])


@dataclass(frozen=True)
class Model:
    bits: int
    weights: np.ndarray  # float32, 2**bits
    bias: float

    def score(self, texts: list) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in batches_of(texts):
            index, starts = ngrams(texts[a:b], self.bits)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
            n = np.maximum(np.diff(starts), 1)
            out[a:b] = self.bias + (sums[starts[1:]] - sums[starts[:-1]]) / np.sqrt(n)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def train(texts: list, labels: list, bits: int = 20, epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.05, l2: float = 1e-3) -> Model:
    """FTRL-Proximal, one example at a time, in an order fixed by the example's place."""
    size = 1 << bits
    y = np.asarray(labels, dtype=np.float64)
    base = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(base / (1 - base)))
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    bias = start
    if len(y) and 0 < y.sum() < len(y):
        examples = []
        for a, b in batches_of(texts):
            index, starts = ngrams(texts[a:b], bits)
            for i in range(b - a):
                at, count = np.unique(index[starts[i] : starts[i + 1]], return_counts=True)
                examples.append((at.astype(np.int32), (count / np.sqrt(max(count.sum(), 1))).astype(np.float32)))
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(examples)):
                at, x = examples[i]
                zi, ni = z[at], n[at]
                w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
                p = 1 / (1 + np.exp(-np.clip(bias + float(w @ x), -35, 35)))
                g = (p - y[i]) * x
                z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
                n[at] = ni + g * g
                gb = float(p - y[i])
                zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * (bias - start)
                nb += gb * gb
                bias = start - zb / ((beta + np.sqrt(nb)) / alpha + l2)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(bits, w.astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    """A model of ``labels[label]`` from about ``sample_rows`` labelled rows at most; held-out rows are never read."""
    rows = store.materialise(store.labelled_sample(docs, labels, label, sample_rows), "quality-sample")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > SAMPLE_CHARS:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_CHARS / chars))
    rows = rows.toPandas().sort_values(["doc_id", "text"], kind="stable")
    return train(rows["text"].tolist(), rows["label"].tolist(), **options)


def scorer(spark: SparkSession, model: Model):
    """A column function text -> score. The broadcast model has a fixed size, 4 bytes for each of 2**bits coordinates."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.where(text.notna(), None).tolist()))

    return score


def score_documents(docs: DataFrame, model: Model, text: Column | str = "text") -> DataFrame:
    """docs with a ``quality_score`` column (or that name behind underscores where docs has it)."""
    return docs.withColumn(store.free_name(docs, "quality_score"), scorer(docs.sparkSession, model)(text))
