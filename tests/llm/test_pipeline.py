"""The pipeline against a plain version of each of its stages."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import packing, quality_classifier, secret_scan, simhash_dedup
from tidegauge.llm.common import DOCUMENT_COLUMNS
from tidegauge.llm.queries import tokenizer_path

from .test_text_operators import shingle_set


def rows(df):
    return sorted(map(tuple, df.select(*DOCUMENT_COLUMNS).collect()), key=lambda r: (r[0], r[1] or ""))


def test_stages(spark, data, tmp_path):
    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < 4:
            assert out.columns == DOCUMENT_COLUMNS and [k for _, k in out.dtypes] == [k for _, k in docs.dtypes]
        out.write.parquet(str(tmp_path / str(i)))
        docs = kept[i] = spark.read.parquet(str(tmp_path / str(i)))
    first = spark.read.parquet(f"{data}/documents.parquet")
    # classifier
    model = quality_classifier.train(first, spark.read.parquet(f"{data}/labels.parquet"))
    words = quality_classifier._Words()
    want = [r for r in rows(first) if model.score(r[1], words) >= 0.7]
    assert rows(kept[0]) == want
    # near duplicates: groups of the links between texts whose sets of five words have a similarity of 0.8
    ids = [r[0] for r in want]
    of = simhash_dedup.Similarity()
    sets = {r[0]: shingle_set(r[1], of.shingle_words) for r in want}
    likeness = lambda a, b: 1.0 if sets[a] == sets[b] else len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    lowest = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if lowest[i] != lowest[j] and likeness(i, j) >= of.least:
                low, high = sorted((lowest[i], lowest[j]))
                lowest = {k: low if v == high else v for k, v in lowest.items()}
    size, want = len(want), [r for r in want if lowest[r[0]] == r[0]]
    assert rows(kept[1]) == want and len(want) < size
    left = [r[0] for r in want]
    assert all(likeness(a, b) < of.least for i, a in enumerate(left) for b in left[:i])
    gone = [i for i in ids if i not in set(left)]
    assert all(max(likeness(a, b) for b in ids if b != a) >= of.least for a in gone)
    # secrets
    b = secret_scan.Battery()
    masked = [secret_scan.redact(r[1], secret_scan.all_spans(r[1], b, secret_scan.candidate_pattern(b))[1], "[SECRET]") for r in want]
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(want, masked)]
    assert rows(kept[2]) == want and not any(secret_scan.base_spans(t) for t in masked)
    # mixture: every document, none changed, small sources at most twice
    n = Counter(rows(kept[3]))
    assert set(n) == set(want) and max(n.values()) <= 3
    # packing
    t = packing.ChunkTokenizer(tokenizer_path())
    pieces = kept[4].toPandas()
    starts = Counter(pieces[pieces["start"] == 0]["doc_id"])
    assert starts == Counter(r[0] for r in n.elements())
    crcs = {r[0]: zlib.crc32(np.concatenate([np.frombuffer(t.encode(r[1]), "<u4"), [np.uint32(1)]]).astype("<u4")[:l].tobytes()) for r in want for l in pieces[(pieces["doc_id"] == r[0]) & (pieces["start"] == 0)]["length"][:1]}
    assert all(crcs[d] == c for d, c in pieces[pieces["start"] == 0][["doc_id", "ids_crc32"]].values)


def test_run_equals_its_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "secret scans", "source mixing", "packing"]
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and out.filter("length > 2048 OR offset + length > 2048").count() == 0


def test_awkward_documents(spark, data):
    df = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "x", "en", "a", 1), (2, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    for base in (df, df.limit(0)):
        docs = base
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        docs.collect()


@pytest.mark.parametrize("name", ["secret scans", "source mixing"])
def test_no_document_is_lost(spark, data, name):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, data)
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
