"""Orders over whole tables, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ordering
from tidegauge.sources import readers, shared


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    return [(str(k) if k else None, None if v > 90 else float(v) / 4, float(rng.integers(0, 5)), float(rng.integers(0, 5)), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 800), rng.integers(0, 100, 800)))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, a double, b double, i long").repartition(5)


def test_quantiles(frame, rows):
    qs = [0.0, 0.1, 0.5, 2 / 3, 1.0]
    got = {r["k"]: r["q"] for r in ordering.exact_quantiles(frame, "v", ["k"], qs).collect()}
    for k in {r[0] for r in rows}:
        assert np.allclose(got[k], np.quantile([r[1] for r in rows if r[0] == k and r[1] is not None], qs))
    assert np.allclose(ordering.exact_quantiles(frame, "v", [], qs).first()["q"], np.quantile([r[1] for r in rows if r[1] is not None], qs))
    assert ordering.exact_quantiles(frame.filter("i < 0"), "v", ["k"], qs).count() == 0


def test_ranks(frame, rows):
    got = {r["i"]: r["rank"] for r in ordering.average_ranks(frame, "v", ["k"], "rank").collect()}
    for k in {r[0] for r in rows}:
        own = [(r[1], r[4]) for r in rows if r[0] == k and r[1] is not None]
        for v, i in own:
            assert got[i] == sum(x < v for x, _ in own) + (sum(x == v for x, _ in own) + 1) / 2
    assert len(got) == sum(r[1] is not None for r in rows)


def test_codes(frame, rows):
    values = sorted({r[1] for r in rows if r[1] is not None})
    assert {r["v"]: r["c"] for r in ordering.codes(frame, "v", "c").collect()} == {v: i for i, v in enumerate(values)}


@pytest.mark.parametrize("scores", [["v", "a"], ["v", "a", "b"]])
def test_pareto(frame, rows, scores):
    points = {tuple(r[{"v": 1, "a": 2, "b": 3}[s]] for s in scores) for r in rows}
    points = {p for p in points if None not in p}
    want = {p for p in points if not any(q != p and all(x >= y for x, y in zip(q, p)) for q in points)}
    got = [tuple(r) for r in ordering.pareto(frame, scores).collect()]
    assert set(got) == want and len(got) == len(want)
    assert ordering.pareto(frame.filter("i < 0"), scores).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session)


def test_the_cache_sees_rewritten_files(spark, tmp_path):
    path, cache = str(tmp_path / "t"), readers.PersistentCache(spark, str(tmp_path / "cache"))
    read = lambda: spark.read.parquet(path).agg(F.sum("id").alias("s"))
    spark.range(5).write.parquet(path)
    assert cache.get_or_compute(read()).first()["s"] == 10
    spark.range(6).write.mode("overwrite").parquet(path)
    assert cache.get_or_compute(read()).first()["s"] == 15
    many = [F.lit(i).alias(f"c{i}") for i in range(60)]
    a, b = (spark.range(1).select(*many[:-1], F.lit(x).alias("z")) for x in (1, 2))
    assert [cache.get_or_compute(x).first()["z"] for x in (a, b, a)] == [1, 2, 1]
