"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, whatever its label. With
the class prior p, the risk of calling unlabelled text harmless is corrected for the toxic share it
holds: p R+(positives) + max(0, R-(unlabelled) - p R-(positives)). Where the second part falls below
zero the step goes the other way, which keeps it from being fitted away. Several linear classifiers
over word presence are trained, each on its own part of the unlabelled text; their log-odds are
averaged.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import sample_keys, sample_rows, texts_in, with_columns

_WORD = re.compile(r"[^\W\d_]+")
_BUCKETS = (1 << 22) - 1


def word_ids(text: str) -> set[int]:
    """Hashed ids of the distinct words of a text, lower-cased."""
    crc = zlib.crc32
    return {crc(w.encode("utf-8", "surrogatepass")) & _BUCKETS for w in set(_WORD.findall(text.lower()))}


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4


class PUClassifier:
    """Linear log-odds over presence features, fitted by full-batch Adam on the non-negative risk (logistic loss)."""

    def __init__(self, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-4) -> None:
        self.prior, self.steps, self.rate, self.l2 = prior, steps, rate, l2
        self.weights, self.bias = np.zeros(0), 0.0

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> PUClassifier:
        prior, n = self.prior, positive.shape[1]
        theta = np.zeros(n + 1)
        theta[n] = np.log(prior / (1 - prior))
        m, v = np.zeros(n + 1), np.zeros(n + 1)
        for step in range(1, self.steps + 1):
            fp = positive @ theta[:n] + theta[n]
            fu = unlabelled @ theta[:n] + theta[n]
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            # d/df of log(1 + exp(-f)) is s - 1, of log(1 + exp(f)) it is s
            if rest >= 0:
                gp, gu = prior * (sp - 1 - sp) / len(fp), su / len(fu)
            else:
                gp, gu = prior * sp / len(fp), -su / len(fu)
            g = np.append(gp @ positive + gu @ unlabelled + self.l2 * theta[:n], gp.sum() + gu.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.bias = theta[:n], float(theta[n])
        return self


class ToxicityModel:
    """Weights by hashed word id."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        get = self.weights.get
        odds = self.bias + sum(get(i, 0.0) for i in word_ids(text))
        return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, words: int = 1500, classifiers: int = 3
) -> ToxicityModel:
    """Fit on lists of word ids. Without positives or unlabelled text the model is the prior alone."""
    prior = min(max(prior, 1e-3), 0.5)
    base = ToxicityModel({}, float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return base
    ids, where = np.unique(np.concatenate(positive + unlabelled), return_inverse=True)
    n_pos = sum(map(len, positive))
    in_p = np.bincount(where[:n_pos], minlength=len(ids))
    in_u = np.bincount(where[n_pos:], minlength=len(ids))
    p, u = (in_p + 0.5) / (len(positive) + 1), (in_u + 0.5) / (len(unlabelled) + 1)
    both = (in_p + in_u) / (len(positive) + len(unlabelled))
    telling = (p - u) / np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-9)
    telling[in_p + in_u < 5] = 0
    chosen = np.argsort(-np.abs(telling), kind="stable")[:words]
    chosen = np.sort(ids[chosen[np.abs(telling[chosen]) > 2]])
    if not len(chosen):
        return base

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen)), np.float32)
        for i, row in enumerate(rows):
            at = np.searchsorted(chosen, row)
            at[at == len(chosen)] = 0
            out[i, at[chosen[at] == row]] = 1
        return out

    positives, weights, bias = matrix(positive), np.zeros(len(chosen)), 0.0
    parts = min(classifiers, len(unlabelled))
    for i in range(parts):
        held = PUClassifier(prior).fit(positives, matrix(unlabelled[i::parts]))
        weights += held.weights / parts
        bias += held.bias / parts
    return ToxicityModel(dict(zip(chosen.tolist(), weights.tolist())), bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    positives: int = 3000,
    unlabelled: int = 9000,
) -> ToxicityModel:
    """Fit on rows whose fold is not 2: at most ``positives`` toxic and ``unlabelled`` other documents.

    Both are chosen by the hashes of id and text; distinct rows count, so an id that very many rows share
    is bounded too. The class prior is the toxic share of the labelled rows of those folds. Only the
    toxic label of those rows is read. Documents without an id are left out; without any toxic one
    every document gets the same score.
    """
    known = labels.where(fold(F.col(doc_id)) != 2).where(F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    ids = sample_keys(known.where("toxic = 1"), doc_id, positives)
    free = docs.where(fold(F.col(doc_id)) != 2).select(doc_id, text)
    toxic = sample_rows(free.join(F.broadcast(ids), doc_id, "left_semi"), doc_id, text, positives)
    others = sample_rows(free, doc_id, text, unlabelled)
    chosen = toxic.withColumn("_toxic", F.lit(True)).unionByName(others.withColumn("_toxic", F.lit(False)))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([np.array(sorted(word_ids(t)), "<i4").tobytes() for t in texts_in(batch, text)], pa.binary())]

    rows = with_columns(chosen, [T.StructField("_words", T.BinaryType())], make, [doc_id, "_toxic"]).collect()
    rows.sort(key=lambda r: (r["_toxic"], r[doc_id], r["_words"]))
    words = {flag: [np.frombuffer(r["_words"], "<i4").astype(np.int64) for r in rows if r["_toxic"] is flag] for flag in (True, False)}
    return train(words[True], words[False], prior if prior is not None else 0.1)


def scored(df: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score of each whole text, 0 to 1. Null and empty texts get the score of no words."""
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make(batch: pa.RecordBatch) -> Iterator[pa.Array]:
        held = pickle.loads(shipped.value)
        yield pa.array([held.score(t) for t in texts_in(batch, text)], pa.float64())

    return with_columns(df, [T.StructField(into, T.DoubleType())], make, keep)
