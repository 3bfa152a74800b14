"""Operators on drifting coefficients, learnt gates, identities and explanation plans, against plain versions."""

import numpy as np
import pytest

from tidegauge.functions.blake3 import blake3_column, blake3_hex, merkle_node
from tidegauge.operators import models, regimes, rolling, sequential
from tidegauge.plans import graph
from tidegauge.plans.explain import ExplainError, explanation_plan


#: Fixed: published test values of the hash, over bytes that count from 0 to 250 again and again.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
}


def test_blake3(spark):
    for n, want in VECTORS.items():
        assert blake3_hex(bytes(i % 251 for i in range(n))) == want
    assert blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string").withColumn("h", blake3_column("t"))
    rows = df.withColumn("n", merkle_node("h", "h")).collect()
    assert [r["h"] for r in rows] == [blake3_hex(b"abc"), None, VECTORS[0]]
    assert rows[0]["n"] == blake3_hex(bytes.fromhex(rows[0]["h"]) * 2) and rows[1]["n"] is None


def test_drifting_residuals_follow_the_coefficient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    beta = np.linspace(0.5, 2.0, 600)
    y = beta * x[:, 0] - x[:, 1] + rng.normal(0, 0.05, 600)
    x[17, 0] = np.nan
    got = sequential.kalman_residual(y, x, 1e-3, 2.5e-3)
    assert np.isnan(got[17]) and np.isfinite(np.delete(got, 17)).all() and np.std(got[100:]) < 0.2 < np.std(y)
    with pytest.raises(ValueError):
        sequential.kalman_residual(y, x, 0.0)


def test_industry_score(spark):
    rows = [(f"a{i}", t, f"s{i % 2}" if i < 4 else None, float(i * t)) for i in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, "instrument string, date int, sector string, r double")
    got = {(r["instrument"], r["date"]): r["industry_score"] for r in rolling.industry_score(df, "r", "sector", "instrument", "date", 3).collect()}
    value = {(a, t): sum(r for b, u, _, r in rows if b == a and t - 3 < u <= t) if t >= 2 else None for a, t, _, _ in rows}
    for a, t, s, _ in rows:
        own = [value[b, t] for b, u, z, _ in rows if u == t and z == s]
        every = [value[b, t] for b, u, _, _ in rows if u == t]
        assert got[a, t] == (None if t < 2 else pytest.approx(np.mean(own) - np.mean(every)))


def test_the_graph_has_the_new_operators(spark):
    rows = [(f"a{i}", t, "x", 100.0 + i + t * (i + 1)) for i in range(3) for t in range(30)]
    df = spark.createDataFrame(rows, "instrument string, date int, sector string, close double")
    plan = graph.Plan(["instrument"], ["date"]).then("returns").then("momentum.industry_score", window=5).then("momentum.residual_kf", y="returns", factors=["close"])
    out = graph.compile_plan(df, plan).toPandas()
    assert out["industry_score"].notna().sum() == 3 * 25 and out["residual_kf"].notna().sum() == 3 * 29


def test_a_graph_reads_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0)], "instrument string, date int, close double")
    spark.createDataFrame([("a", 2, 7.5)], "instrument string, date int, extra double").write.option("header", True).csv(str(tmp_path / "x.csv"))
    plan = graph.Plan(["instrument"], ["date"]).then("data.load_csv", path=str(tmp_path / "x.csv"), columns=["extra"])
    assert [(r["date"], r["extra"]) for r in graph.compile_plan(df, plan).orderBy("date").collect()] == [(1, None), (2, 7.5)]


def test_expanding_quantiles():
    x = np.array([3.0, np.nan, 1.0, 2.0, 2.0, 9.0])
    got = regimes.expanding_quantiles(x, [1 / 3, 0.5])
    for i in range(len(x)):
        known = x[: i + 1][~np.isnan(x[: i + 1])]
        assert np.allclose(got[i], np.quantile(known, [1 / 3, 0.5]))


def test_learnt_gate(spark):
    rng = np.random.default_rng(0)
    rows = [(t, "train" if t < 300 else "test", float(x), "h1" if t % 2 else "h2", "up" if x > 0 else "down") for t, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "date int, split string, x double, regime string, best string")
    got = models.reptile_gate(df, ["x"], "best", "regime", meta_epochs=60, inner_rate=0.5, outer_rate=0.5).toPandas()
    assert (got[got["split"] == "test"]["selected_candidate_id"] == got[got["split"] == "test"]["best"]).mean() > 0.9
    assert got["probabilities"].map(sum).between(0.999, 1.001).all()
    none = models.reptile_gate(df.withColumn("best", df["best"].cast("string")).filter("split = 'test'"), ["x"], "best", "regime").toPandas()
    assert none["selected_candidate_id"].isna().all()


def test_explanation_plans():
    got = explanation_plan({"model": "m1", "device": "gpu", "target": "y", "explainers": [{"name": "SHAP", "params": {"background_size": 20, "depth": 3}}, {"name": "lime", "params": {"kmeans_k": 7}}]})
    assert got["ops"] == [{"op": "explain.shap", "depth": 3, "model_ref": "m1", "device": "gpu", "background": {"strategy": "random", "k": 20}}, {"op": "explain.lime", "model_ref": "m1", "device": "gpu", "background": {"strategy": "kmeans", "k": 7}}]
    assert got["target"] == "y" and explanation_plan({})["ops"] == []
    assert explanation_plan({"ops": [{"name": "pdp", "model_ref": "own", "background": 5}], "model_ref": "m"})["ops"] == [{"op": "explain.pdp", "model_ref": "own", "background": {"strategy": "random", "k": 5}}]
    with pytest.raises(ExplainError):
        explanation_plan({"ops": [{"depth": 1}]})


@pytest.mark.parametrize("layers", [1, 2])
def test_gradients_of_recurrent_layers(layers):
    rng = np.random.default_rng(layers)
    net, x, y = models.LstmRegressor(units=3, num_layers=layers, seed=layers), rng.normal(size=(4, 5, 2)), rng.normal(size=4)
    net.start(2)
    loss = lambda: ((net.output(x) - y) ** 2).mean() / 2
    for p, g in zip(net.params, net.gradients(x, y)):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(5)]:
            was = p[at]
            p[at] = was + 1e-6
            up = loss()
            p[at] = was - 1e-6
            down = loss()
            p[at] = was
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_networks_learn_from_all_parts(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 6, 1))
    rows = [(v.tolist(), float(v[:, 0].sum()), float(v[0, 0]), float(v[1, 0])) for v in x]
    df = spark.createDataFrame(rows, "seq array<array<double>>, total double, a double, b double").repartition(3)
    net = models.LstmRegressor(units=8, epochs=12, rate=0.01).fit(df, ["seq"], "total")
    got = net.transform(df).toPandas()
    assert np.corrcoef(got["prediction"], got["total"])[0, 1] > 0.9
    mlp = models.MlpRegressor(hidden=(32, 16), epochs=25)
    mlp.batch = 16
    mlp.fit(df.withColumn("y", df["a"] * 2 - df["b"]), ["a", "b"], "y")
    got = mlp.transform(df).toPandas()
    assert np.corrcoef(got["prediction"], got["a"] * 2 - got["b"])[0, 1] > 0.9
    assert models.MlpRegressor(epochs=2).fit(df.filter("a > 99"), ["a", "b"], "total").params
