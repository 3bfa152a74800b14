"""Vectors and topics of texts: hashed term frequencies, and latent Dirichlet allocation from Spark's own library."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import once


def hashed_embedding(df: DataFrame, text: str, width: int = 256, out: str = "embedding") -> DataFrame:
    """Counts of the lower-case words between blanks, hashed by MD5 to ``width`` places, as an array of length one;
    zeros for texts without words."""

    def apply(texts: pd.Series) -> pd.Series:
        rows, places = [], {}
        for t in texts:
            v = np.zeros(width)
            for w in re.split(r"[ \t\n\f\r]+", (t or "").lower()):
                if w:
                    if w not in places:
                        if len(places) >= 200_000:
                            places.clear()
                        places[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width
                    v[places[w]] += 1
            rows.append((v / (np.sqrt((v * v).sum()) or 1.0)).tolist())
        return pd.Series(rows, dtype=object)

    return df.withColumn(out, F.pandas_udf(apply, "array<double>")(F.col(text)))


def topics(df: DataFrame, text: str, k: int = 5, vocabulary: int = 2000, least: float = 0.0, seed: int = 42, iterations: int = 10) -> DataFrame:
    """``topic_probabilities``, and the ``topic`` with the largest one if that reaches ``least``."""
    stages = [RegexTokenizer(inputCol="__t", outputCol="__w", pattern=r"\s+"), CountVectorizer(inputCol="__w", outputCol="features", vocabSize=vocabulary), LDA(k=k, maxIter=iterations, seed=seed)]
    d = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    d = once(d)  # every iteration reads it
    p = vector_to_array("topicDistribution")
    out = Pipeline(stages=stages).fit(d).transform(d).withColumn("topic_probabilities", p)
    best = F.array_max("topic_probabilities")
    return out.withColumn("topic", F.when(best >= least, F.array_position("topic_probabilities", best) - 1)).drop("__t", "__w", "features", "topicDistribution")
