"""Toxicity scores by a counterfactually regularised logistic classifier.

Features are the distinct words of a text and their first four to seven bytes, hashed; the ``FEATURES`` with the largest χ²
against the label are kept, besides all identity terms. Of every labelled text that names a group a counterfactual is made by
swapping the identity terms, and squared score changes between the two are part of the loss: a neutral mention of a group then
cannot carry weight of its own.

The classifier is fitted on at most ``SAMPLE`` labelled rows (the lowest hashes of doc_id), a documented bound; only their
features, indices into the kept ones, reach the driver. Scores come from whole texts; nothing but the text is read for them.

Null, blank and empty texts score what the bias says. Rows without a label, or with a null one, are not learned from; of
repeated labels of one id the larger counts. Without labels of both kinds every score is the smoothed share of label 1.
Repeated rows get a row each. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from guidescape.llm.text import as_long, id_remainder, word_hashes
from guidescape.runtime import checkpointed, importable

SAMPLE = 20_000
FEATURES = 4096
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
FAIRNESS = 1.0
RIDGE = 1e-4
STEPS = 300

# Pairs of identity terms that are swapped for each other.
SWAPS = {
    "women": "men",
    "woman": "man",
    "female": "male",
    "gay": "straight",
    "black": "white",
    "muslim": "christian",
    "muslims": "christians",
    "jewish": "catholic",
    "immigrants": "citizens",
    "asian": "european",
    "disabled": "healthy",
    "old": "young",
}
PARTNER = SWAPS | {b: a for a, b in SWAPS.items()}
_TERM = re.compile(r"\b(" + "|".join(PARTNER) + r")\b", re.IGNORECASE)


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 4) == 2


def features(text: str | None) -> np.ndarray:
    return as_long(word_hashes(text, PREFIXES))


def counterfactual(text: str | None) -> str | None:
    """The text with its identity terms swapped; None if it has none."""
    swapped, found = _TERM.subn(lambda m: PARTNER[m[0].lower()], text or "")
    return swapped if found else None


@dataclass
class Classifier:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.low = np.zeros(1 << 16, bool)
        self.low[self.keys & 0xFFFF] = True

    def places(self, text: str | None) -> np.ndarray:
        """Distinct kept features of a text, as places in ``keys``."""
        found = features(text)
        found = found[self.low[found & 0xFFFF]]
        if not len(self.keys) or not len(found):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return np.unique(at[self.keys[at] == found])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[self.places(text)].sum()))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the rows the classifier may learn from, ``sample`` at most."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most SAMPLE rows of two numbers: the broadcast is bounded whatever the number of labels.
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic")


def _select(rows: DataFrame, n: int) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                found = [np.unique(features(text)) for text in part["text"]]
                toxic = np.repeat(part["toxic"].to_numpy(), [len(x) for x in found])
                keys, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
                hits = np.bincount(at, toxic, minlength=len(keys)).astype(np.int64)
                yield pd.DataFrame({"key": keys, "hits": hits, "times": times})

    counts = rows.mapInPandas(count, "key long, hits long, times long")
    counts = counts.groupBy("key").agg(F.sum("hits").alias("hits"), F.sum("times").alias("times")).where("times >= 3")
    share = rows.agg(F.avg("toxic").alias("p")).first()["p"] or 0.0
    surplus = F.col("hits") - F.col("times") * F.lit(share)
    best = counts.orderBy(F.desc(surplus * surplus / F.col("times")), "key").limit(n).select("key").toPandas()["key"]
    named = np.concatenate([features(term) for term in PARTNER])
    return np.unique(np.concatenate([best.to_numpy(np.int64), named]))


def _ragged(parts) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.asarray(p, np.int64) for p in parts]
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate([*parts, np.empty(0, np.int64)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES, fairness: float = FAIRNESS):
    importable(docs.sparkSession)
    rows = checkpointed(labelled(docs, labels, sample))
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        prior = (kinds.get(1, 0) + 0.01) / (sum(kinds.values()) + 1)
        return Classifier(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    shape = Classifier(_select(rows, n_features), np.empty(0), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(shape)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, swapped = [], []
            for text in pdf["text"]:
                held.append(sent.value.places(text))
                other = counterfactual(text)
                swapped.append(None if other is None else sent.value.places(other))
            yield pd.DataFrame({"toxic": pdf["toxic"], "held": held, "swapped": swapped})

    data = rows.mapInPandas(encode, "toxic int, held array<int>, swapped array<int>").toPandas()
    return descend(shape.keys, data, fairness)


def descend(keys: np.ndarray, data: pd.DataFrame, fairness: float) -> Classifier:
    """Full-batch Adam on the mean log-loss + ridge + fairness · mean squared change of the score's logit under swaps."""
    y, d = data["toxic"].to_numpy(float), len(keys)
    row, col = _ragged(data["held"])
    pairs = data[data["swapped"].notna()]
    if len(pairs):
        (r1, c1), (r2, c2) = _ragged(pairs["held"]), _ragged(pairs["swapped"])
        pr, pc, sign = np.concatenate([r1, r2]), np.concatenate([c1, c2]), np.repeat([1.0, -1.0], [len(c1), len(c2)])
    w, first, second = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(y.mean() / (1 - y.mean()))
    for step in range(1, STEPS + 1):
        logit = w[d] + np.bincount(row, w[col], minlength=len(y))
        error = (1 / (1 + np.exp(-logit)) - y) / len(y)
        grad = np.append(np.bincount(col, error[row], minlength=d), error.sum())
        grad[:d] += RIDGE * w[:d]
        if len(pairs):
            change = np.bincount(pr, sign * w[pc], minlength=len(pairs))
            grad[:d] += 2 * fairness / len(pairs) * np.bincount(pc, sign * change[pr], minlength=d)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Classifier(keys, w[:d], float(w[d]))


def scorer(spark, model: Classifier):
    """A column function: score of a text, 0 to 1."""
    sent = importable(spark).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(text) for text in texts], dtype=float)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
