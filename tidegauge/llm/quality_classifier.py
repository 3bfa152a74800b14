"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

A text's words are cut where letters meet other characters, so that marks glued to words count as words. Unigrams and
bigrams are hashed into ``2 ** bits`` places; a word that follows itself has a place of its own. A text is the vector of
its counts, scaled to length one, and its score is a sparse dot product with the weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable

TOKEN = re.compile(r"[^\W_]+|[\W_]")
#: Words whose hashes a worker remembers at most.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Settings:
    """``train_texts``: the bound on labelled texts learnt from, taken in the order of a hash of the id."""

    bits: int = 18
    train_texts: int = 6000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    threshold: float = 0.7


class _Words(dict):
    """From a word (bytes without blanks) to the hashes of its tokens, four bytes each."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh32_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        found = TOKEN.findall(word.decode("utf-8", "replace"))
        if len(found) > 64:  # one word without blanks: its tokens count, but it isn't kept in memory
            return np.array([xxh32_intdigest(x) for x in found], np.uint32).tobytes()
        self[word] = out = np.array([xxh32_intdigest(x) for x in found], np.uint32).tobytes()
        return out


def features(text: str | None, bits: int, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the text's vector; nothing for texts without words."""
    h = np.frombuffer(b"".join(map(words.__getitem__, (text or "").encode("utf-8", "replace").split())), np.uint32)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0)
    mask = np.uint32((1 << bits) - 1)
    same = h[1:] == h[:-1]
    pairs = (h[:-1] * np.uint32(0x9E3779B1) + (h[1:] ^ (h[1:] >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
    pairs[same] = 1
    at, count = np.unique(np.concatenate((h & mask, pairs)), return_counts=True)
    return at.astype(np.int64), count / np.sqrt((count.astype(float) ** 2).sum())


class FollowTheRegularisedLeader:
    """Per-coordinate FTRL-proximal for logistic loss; the bias is not regularised."""

    def __init__(self, settings: Settings):
        self.s, n = settings, 1 << settings.bits
        self.z, self.n, self.bias = np.zeros(n), np.zeros(n), [0.0, 0.0]

    def weights(self, at=slice(None)) -> np.ndarray:
        z, s = self.z[at], self.s
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def intercept(self) -> float:
        return -self.bias[0] * self.s.alpha / (self.s.beta + self.bias[1] ** 0.5)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w @ value + self.intercept(), -35, 35))) - label
        g = error * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g
        b = self.intercept()
        self.bias = [self.bias[0] + error - ((self.bias[1] + error**2) ** 0.5 - self.bias[1] ** 0.5) / self.s.alpha * b, self.bias[1] + error**2]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    settings: Settings

    def score(self, text: str | None, words: _Words) -> float:
        at, value = features(text, self.settings.bits, words)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ value + self.intercept, -35, 35))))


def train(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", settings: Settings = Settings()) -> Model:
    """Learns from at most ``settings.train_texts`` labelled rows that are not held out. Null labels and ids are not
    learnt from; an id labelled twice counts with its highest label, one with several texts with the least. Without labels every score is 0.5."""
    known = labels.filter(learnable(F.col(id_col)) & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(settings.train_texts)  # a top-k: few rows reach the driver
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # one text an id, so the bound holds

    def apply(texts: pd.Series) -> pd.DataFrame:
        words, out = _Words(), []
        for text in texts:
            at, value = features(text, settings.bits, words)
            out.append((at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["at", "value"])

    rows = rows.select("id", "label", F.xxhash64("id", "text").alias("h"), F.pandas_udf(apply, "at binary, value binary")("text").alias("r"))
    found = sorted(((r["h"], r["id"], r["label"], bytes(r["at"]), bytes(r["value"])) for r in rows.select("id", "label", "h", "r.*").toLocalIterator()), key=lambda x: x[:2])
    model = FollowTheRegularisedLeader(settings)
    for _ in range(settings.epochs):
        for _, _, label, at, value in found:
            model.learn(np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(value, np.float32).astype(float), int(label > 0))
    return Model(model.weights().astype(np.float32), model.intercept(), settings)


def score_column(text: Column, model: Model, spark) -> Column:
    """The score of a text column; null and word-less texts get the score of the intercept alone."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** bits weights, whatever the input

    def apply(texts: pd.Series) -> pd.Series:
        own, words = shared.value, _Words()
        return pd.Series([own.score(x, words) for x in texts], dtype=float)

    return F.pandas_udf(apply, "double")(text)


def classify_quality(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` and ``predicted`` (1 from ``settings.threshold`` on).

    Defined cases: null text as empty text (the intercept's score); repeated rows give a row each; no labels give 0.5
    everywhere; an empty table gives an empty table; null ids are not held out and never learnt from.
    """
    model = train(df, labels, text_col, id_col, label_col, settings)
    scored = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(F.col(text_col), model, df.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
