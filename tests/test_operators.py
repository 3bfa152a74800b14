import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalars as X
from tidegauge.operators import cleaning as K
from tidegauge.operators import columns as C
from tidegauge.operators import filters as Q
from tidegauge.operators import indicators as I
from tidegauge.operators import joins as J
from tidegauge.operators import ledger as L
from tidegauge.operators import models as M
from tidegauge.operators import panel as P
from tidegauge.operators import rolling as R
from tidegauge.operators import sequential as S
from tidegauge.operators import splits as T
from tidegauge.operators import stats as Z
from tidegauge.operators import strategies as G
from tidegauge.plans import graph
from tidegauge.sources import readers


def walk(n=120, seed=1):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    return pd.DataFrame({"instrument": "a", "date": [date(2020, 1, 1) + timedelta(days=i) for i in range(n)], "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": r.integers(1, 100, n).astype(float)})


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(pd.concat([walk(), walk(seed=2).assign(instrument="b")]))


def test_adjustment_of_a_split(spark):
    bars = spark.createDataFrame([("A", "2020-01-01", 100.0), ("A", "2020-01-02", 55.0)], "symbol string, d string, p double").select("symbol", F.to_date("d").alias("date"), *[F.col("p").alias(c) for c in ("open", "high", "low", "close")], F.lit(10.0).alias("volume"))
    ev = lambda f: spark.createDataFrame([("A", "2020-01-02", f)], "symbol string, d string, factor double").select("symbol", F.to_date("d").alias("event_date"), "factor")
    first = P.adjust_prices(bars, ev(0.5), ev(0.98)).orderBy("date").first()
    assert (first["split_factor"], first["dividend_factor"]) == (0.5, 0.98)
    assert first["adjustment_factor"] == pytest.approx(0.49) and first["adj_open"] == pytest.approx(49.0) and first["open"] == 100.0


def test_no_series_bleeds_into_another(panel):
    w = R.series(["instrument"], ["date"])
    rows = panel.select("instrument", "date", R.pct_change("close", w).alias("r"), R.rolling_mean("close", w, 20).alias("m")).filter("r IS NULL").collect()
    assert len(rows) == 2 and all(r["m"] is None for r in rows)
    with pytest.raises(ValueError):
        R.series([], ["date"])


def test_past_does_not_change_with_the_future(panel):
    early = panel.filter("date < DATE '2020-03-15'")
    a, b = (I.indicator_panel(x, ["instrument"], ["date"]).filter("date < DATE '2020-03-15'").toPandas().sort_values(["instrument", "date"], ignore_index=True) for x in (panel, early))
    assert np.allclose(a[I.ALL].astype(float), b[I.ALL].astype(float), equal_nan=True)
    assert len(I.ALL) == 31


def test_ema_carries_gaps_and_rsi_bounds():
    assert list(S.ema(np.array([np.nan, 1.0, np.nan, 2.0]), 3))[1:] == [1.0, 1.0, 1.5]
    r = S.wilder_rsi(walk()["close"].to_numpy())
    assert np.isnan(r[0]) and np.nanmin(r) >= 0 and np.nanmax(r) <= 100
    assert S.wilder_rsi(np.arange(10.0))[-1] == pytest.approx(100)


def test_pairs_positions_and_turnover():
    z = np.array([0, 2.5, 2.0, 0.4, -2.1, -2.2, -1.0])
    assert list(S.pairs_position(z, np.ones(7, bool))) == [0, -1, -1, 0, 1, 1, 1]
    assert list(S.pairs_position(z, np.zeros(7, bool))) == [0] * 7
    assert np.abs(np.diff(S.turnover_clamp(np.array([1, -1, 1.0, np.nan]), 0.5), prepend=0)).max() <= 0.5


def test_bocpd_sees_a_break():
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, 100), np.random.default_rng(1).normal(8, 1, 50)])
    out = S.bocpd(x)
    assert out["run_length"][99] > 50 and out["run_length"][110] < 20


def slow_bocpd(x, hazard, longest, prior):
    m0, k0, a0, b0 = prior

    def predictive(v, m, k, a, b):
        s2 = b * (k + 1) / (a * k)
        return math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * a * math.pi * s2) - (a + 0.5) * math.log1p((v - m) ** 2 / (2 * a * s2))

    runs, logp, out = [prior], [0.0], []
    for v in x:
        logp = [predictive(v, *prior) + math.log(hazard) + np.logaddexp.reduce(logp), *(p + predictive(v, *r) + math.log(1 - hazard) for p, r in zip(logp, runs))]
        runs = [(m + (v - m) / (k + 1), k + 1, a + 0.5, b + (v - m) ** 2 * k / (k + 1) / 2) for m, k, a, b in [prior, *runs]]
        if len(logp) > longest:
            tail = runs[longest - 1 :]
            n, total = sum(2 * (a - a0) for _, _, a, _ in tail), sum(k * m - k0 * m0 for m, k, _, _ in tail)
            squares = sum(2 * (b - b0) - k0 * m0**2 + k * m**2 for m, k, _, b in tail)
            mean = (k0 * m0 + total) / (k0 + n)
            runs = [*runs[: longest - 1], (mean, k0 + n, a0 + n / 2, b0 + (squares + k0 * m0**2 - (k0 + n) * mean**2) / 2)]
            logp = [*logp[: longest - 1], np.logaddexp.reduce(logp[longest - 1 :])]
        logp = list(np.array(logp) - np.logaddexp.reduce(logp))
        out.append((math.exp(logp[0]), sum(i * math.exp(p) for i, p in enumerate(logp)), sum(map(math.exp, logp[:6]))))
    return np.array(out)


@pytest.mark.parametrize("longest", [30, 512])
def test_bocpd_keeps_the_mass_of_long_runs(longest):
    x = np.random.default_rng(0).normal(0, 0.02, 150)
    got = S.bocpd(x, longest=longest)
    assert np.allclose(np.column_stack([got[c] for c in ("change_probability", "run_length", "transition_probability")]), slow_bocpd(x, 1 / 100, longest, (0.0, 1.0, 1.0, 1.0)), atol=1e-8)
    assert got["change_probability"][1:].max() < 0.05 and got["run_length"][-1] > 0.9 * min(longest - 1, 150)


def test_residual_of_many_factors_matches_closed_form(spark):
    p = walk(60).assign(x=np.random.default_rng(3).normal(size=60), y2=np.random.default_rng(4).normal(size=60))
    w = R.series(["instrument"], ["date"])
    got = spark.createDataFrame(p).select("date", R.residual_ols("close", ["x", "y2"], w, 20).alias("r")).orderBy("date").toPandas()["r"].astype(float)
    assert np.allclose(got, S.residual_ols_many(p["close"].to_numpy(), p[["x", "y2"]].to_numpy(), 20), equal_nan=True, atol=1e-6)


def test_contracts_and_gates(spark, panel):
    with pytest.raises(Q.QualityError):
        Q.FrameContract({"nope": None}).check(panel)
    with pytest.raises(Q.QualityError):
        Q.unique_grain(panel, ["instrument"])
    with pytest.raises(Q.QualityError):
        Q.validate_frame(panel.withColumn("close", -F.col("close")))
    with pytest.raises(Q.QualityError):
        Q.forbid_columns(panel, ["volume"])
    assert Q.validate_frame(panel, ohlcv=True) == [] and Q.validate_ohlcv(panel) == []
    assert Q.forbidden_features(["forward_return", "rsi"]) == ["forward_return"]
    kinds = Q.classify_columns(panel.withColumn("k", F.lit(1)).withColumn("e", F.lit(None).cast("double")), ["instrument", "date"], [], ["close"])
    assert kinds["k"] == "constant" and kinds["e"] == "low_coverage" and kinds["open"] == "eligible" and kinds["close"] == "target"
    same = Q.ks_drift(panel, panel, ["close"]).first()
    assert same["statistic"] == 0 and not same["drift"]
    assert Q.ks_drift(panel, panel.withColumn("close", F.col("close") + 1000), ["close"]).first()["drift"]


def test_columns(spark):
    df = spark.createDataFrame([(1, -1, 3.0), (2, 70000, float("nan"))], "a int, b int, c double")
    assert [r["b"] for r in C.cast_numeric(df, ["b"], "uint16").orderBy("a").collect()] == [None, None]
    assert C.nan_to_null(df).filter("c IS NULL").count() == 1
    with pytest.raises(ValueError):
        C.rename_columns(df, {"zz": "y"})
    assert C.infer_ticker_column(df.withColumnRenamed("a", "Ticker")) == "Ticker"
    assert C.select_feature_columns(spark.createDataFrame([(1, 2, 3)], "cand_b int, state_a int, other int")) == ["cand_b", "state_a"]


def test_cast_numeric_widens(spark):
    kinds = lambda values, kind, of: C.cast_numeric(spark.createDataFrame([(v,) for v in values], f"a {of}"), ["a"], kind, widen=True)
    for values, kind, of, want in [
        ([-(2**15), None, 2**15 - 1], "int16", "bigint", "smallint"), ([-(2**15) - 1, 0], "int16", "bigint", "int"), ([0, 2**15], "int16", "bigint", "int"), ([2**31, None], "int16", "bigint", "bigint"),
        ([-5, 70000], "uint16", "bigint", "int"), ([2**31], "uint16", "bigint", "bigint"), ([-1, 2**32], "uint32", "bigint", "bigint"), ([None], "int16", "bigint", "smallint"), ([], "int32", "bigint", "int"),
        ([1e30, 1.5], "int16", "double", "double"), ([2.0**63], "int64", "double", "double"), ([7, 8], "int64", "int", "bigint"),
    ]:
        got = kinds(values, kind, of)
        assert got.dtypes == [("a", want)], (values, kind)
        assert sorted((r["a"] for r in got.collect()), key=str) == sorted(values, key=str)
    assert math.isnan(kinds([float("nan")], "int16", "double").first()["a"])
    cut = kinds([32767.9, -32768.9], "int16", "double")
    assert cut.dtypes == [("a", "smallint")] and sorted(r["a"] for r in cut.collect()) == [-32768, 32767]
    assert kinds(["12"], "int16", "string").first()["a"] == 12  # texts are cast as without it
    two = C.cast_numeric(spark.createDataFrame([(1, 40000)], "a bigint, b bigint"), ["a", "b"], "int16", widen=True)
    assert two.dtypes == [("a", "smallint"), ("b", "int")] and tuple(two.first()) == (1, 40000)
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        C.cast_numeric(spark.createDataFrame([(40000,)], "a bigint"), ["a"], "int16").collect()


def test_as_of_policies(spark):
    rows = [("A", "2020-01-01", "2020-01-05", 1.0), ("A", "2020-01-03", "2020-01-04", None), ("A", "2020-01-09", "2020-01-20", 9.0), ("B", "2019-01-01", "2019-01-01", 5.0)]
    store = spark.createDataFrame(rows, "symbol string, v string, k string, close double").select("symbol", F.to_date("v").alias("valid_time"), F.to_date("k").alias("knowledge_time"), "close")
    got = {r["symbol"]: r["close"] for r in J.as_of(store, "2020-01-10", ["close"]).collect()}
    assert got == {"A": 1.0, "B": None}  # walks back over the null; too old is unknown
    assert {r["symbol"]: r["close"] for r in J.as_of(store, "2020-01-10", ["close"], {"close": J.FieldPolicy(forward=False)}).collect()}["A"] is None
    with pytest.raises(Exception, match="missing"):
        J.as_of(store, "2020-01-10", ["close"], {"default": J.FieldPolicy(fail_on_missing=True)}).collect()
    assert J.policy_for("px.close", {"px.*": J.FieldPolicy(7), "default": J.FieldPolicy(1)}).ttl_days == 7
    with pytest.raises(KeyError):
        J.join_sources(store, {}, [{"source": "x"}])


@pytest.mark.parametrize("method", ["forward_fill", "backward_fill", "interpolate", "median", "kalman"])
def test_imputation_is_idempotent(panel, method):
    g = panel.withColumn("close", F.when(F.dayofmonth("date") % 4 != 0, F.col("close")))
    a = K.impute(g, "close", ["instrument"], ["date"], method)
    b = K.impute(a, "close", ["instrument"], ["date"], method)
    x, y = (d.orderBy("instrument", "date").toPandas()["close"].astype(float) for d in (a, b))
    assert np.allclose(x, y, equal_nan=True) and x.notna().sum() > g.filter("close IS NOT NULL").count()


def test_isolation_forest_finds_the_odd_one():
    x = np.random.default_rng(0).normal(size=(300, 2))
    x[7] = [30, -30]
    assert K.IsolationForest().fit(x).score(x).argmax() == 7


def test_anomalies_share(panel):
    kept = K.drop_anomalies(panel, ["close", "volume"], ["instrument"]).count()
    assert 0.85 * 240 <= kept < 240


def test_splits_never_leak(panel):
    wf = T.walk_forward(panel, "date", ["instrument"], 3, 30, 60, 5)
    by = {(r["fold"], r["role"]): r for r in wf.groupBy("fold", "role").agg(F.min("date").alias("a"), F.max("date").alias("z"), F.count("*").alias("n")).collect()}
    for f in range(3):
        assert by[f, "train"]["z"] <= by[f, "test"]["a"] - timedelta(days=5) and by[f, "test"]["n"] == 30
    pk = T.purged_kfold(panel, "date", ["instrument"], 4, 5, 3)
    assert pk.filter("role = 'test'").count() == 240
    assert pk.groupBy("fold", "pos").count().filter("count > 1").count() == 0
    assert T.cpcv(panel, "date", ["instrument"], 4, 2).select("fold").distinct().count() == math.comb(4, 2) == T.n_combinations(4, 2)
    with pytest.raises(ValueError):
        T.walk_forward(panel, "date", ["instrument"])
    folds = T.walk_forward_calendar(datetime(2020, 1, 1), datetime(2020, 12, 31), 4, timedelta(days=2))
    assert len(folds) == 3 and all(f["test_start"] - f["train_end"] == timedelta(days=2) for f in folds)
    assert '"fold": 0' in T.manifest(wf, "date")


def test_distributions_against_published_values():
    assert X.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert X.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert Z.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and Z.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert Z.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert Z.gamma_upper(2, 0.5) == pytest.approx(math.exp(-0.5) * 1.5)


def test_series_tests_know_a_random_walk():
    r = np.random.default_rng(5)
    noise, path = r.normal(size=400), np.cumsum(r.normal(size=400))
    assert Z.adf(noise)["p_value"] < 0.01 < 0.1 < Z.adf(path)["p_value"]
    assert Z.kpss(noise)["p_value"] == pytest.approx(0.1) and Z.kpss(path + 0.2 * np.arange(400))["p_value"] < 0.05
    assert Z.ljung_box_test(noise)["p_value"] > 0.01 > Z.ljung_box_test(path)["p_value"]
    y = np.concatenate([[0.0], noise[:-1]]) + 0.1 * r.normal(size=400)
    assert Z.granger(y, noise)["p_value"] < 1e-6
    assert Z.johansen(np.column_stack([path, path + noise]))["rank"] >= 1


def test_run_tests_reports_errors(spark, panel):
    Z.register_test("broken", 1, lambda x: 1 / 0)
    rows = {(r["instrument"], r["test"]): r for r in Z.run_tests(panel, ["adf", "broken"], ["close"], ["instrument"], ["date"]).collect()}
    assert rows["a", "adf"]["error"] is None and "division" in rows["a", "broken"]["error"]


def test_deflated_sharpe_and_track_record():
    one, many = Z.deflated_sharpe(2.0, 500, 0.0, 0.0), Z.deflated_sharpe(2.0, 500, 0.0, 0.0, n_trials=100)
    assert one["gate_result"] == "PASS" and many["p_value"] > one["p_value"]
    assert Z.min_track_record(2.0, 5000, 0.0, 0.0)["gate_result"] == "PASS" and Z.min_track_record(-1.0, 100, 0, 0)["gate_result"] == "WARN"
    assert X.tuning_deflated_sharpe(0.2, 1, 500) > X.tuning_deflated_sharpe(0.2, 50, 500)


def test_average_cost_ignores_sells():
    assert list(S.average_cost(np.array([10, -5, 10.0, -15]), np.array([1, 9, 2.0, 9]))) == pytest.approx([1, 1, 5 / 3, 0])
    assert L.compare_metrics({"a": 1.0}, {"a": 1.0, "b": 2.0}, 1e-9) == {"a": True, "b": False}


def test_rsi_signal_rule_for_unknown_rows(spark):
    df = spark.createDataFrame([("a", None), ("a", 20.0), ("b", 80.0)], "k string, rsi double")
    got = [tuple(r) for r in df.select("k", G.rsi_signal("rsi", keys=["k"]).alias("s")).orderBy("k", "s").collect()]
    assert got == [("a", 0.0), ("a", 0.0), ("b", -1.0)]


def test_champion_and_search():
    assert G.champion_challenger(lambda p: p["x"], {"x": 1.0}, {"x": 1.02})["promoted"]
    assert not G.champion_challenger(lambda p: p["x"], {"x": 1.0}, {"x": 1.005})["promoted"]
    for engine in ("grid", "random", "bayes"):
        assert M.tune(lambda p: -((p["a"] - 3) ** 2), {"a": list(range(6)), "b": [0]}, engine, budget=6, seed=1)["best_params"]["a"] == 3
    assert M.halving_brackets(27, 1, 27) == [(27, 1), (9, 3), (3, 9), (1, 27)]
    assert X.expected_improvement(1.0, 0.0, 0.0) == 0.0


def test_mlp_learns_a_line():
    x = np.random.default_rng(0).normal(size=(500, 2))
    m = M.MlpRegressor(epochs=60).fit_arrays(x, x[:, 0] * 2 - x[:, 1])
    assert np.corrcoef(m.predict(x), x[:, 0] * 2 - x[:, 1])[0, 1] > 0.98


def test_closed_form_regressions(spark):
    r = np.random.default_rng(0)
    p = pd.DataFrame(r.normal(size=(400, 2)), columns=["a", "b"])
    p["y"] = 1 + 2 * p["a"] - p["b"] + r.normal(0, 0.1, 400)
    df = spark.createDataFrame(p)
    for family in ("bayesian_ridge", "quantile"):
        beta, b0 = M.closed_form(df, ["a", "b"], "y", family)
        assert np.allclose(beta, [2, -1], atol=0.05) and b0 == pytest.approx(1, abs=0.05)
    with pytest.raises(ValueError):
        M.regressor("unknown")


def test_plans(panel):
    plan = graph.Plan(["instrument"], ["date"]).then("returns").then("technical.MACD_line_signal").then("technical.RSI").then("technical.OBV").then("sequence.lags", columns=["returns"], n=2)
    out = graph.compile_plan(panel, plan)
    assert {"returns", "macd", "rsi", "obv", "returns_lag2"} <= set(out.columns) and out.count() == 240
    for bad in (plan.then("returns"), plan.then("nope"), plan.then("sma", wrong=1), plan.then("stats.half_life", column="missing")):
        with pytest.raises(graph.PlanError):
            graph.compile_plan(panel, bad)
    graph.register_expression("twice", lambda a: a * 2)
    assert panel.select(graph.expression(["twice", ["lit", 2]]).alias("x")).first()["x"] == 4
    assert graph.run_cleaning(panel, [("missing", {"column": "close", "keys": ["instrument"], "order": ["date"]})]).count() == 240


@pytest.mark.parametrize("suffix,write", [("csv", "csv"), ("csv.gz", "csv"), ("jsonl", "json"), ("jsonl.gz", "json"), ("parquet", "parquet")])
@pytest.mark.parametrize("rows", [3, 0])
def test_io_matrix(spark, tmp_path, suffix, write, rows):
    p = pd.DataFrame({"timestamp": [f"2020-01-0{i + 1}" for i in range(rows)], "price": list(range(rows))})
    path = str(tmp_path / f"x.{suffix}")
    if write == "csv":
        p.to_csv(path, index=False)
    elif write == "json":
        p.to_json(path, orient="records", lines=True)
    else:
        p.astype({"timestamp": str, "price": "int64"}).to_parquet(path)
    schema = "timestamp string, price long"
    assert readers.read_path(spark, path, None if rows and write != "parquet" else schema).count() == rows
    if rows:
        got = readers.file_source(spark, path, "S", "2020-01-01", "2020-01-02")
        assert got.count() == 2 and {"symbol", "valid_time", "knowledge_time"} <= set(got.columns)


def test_unknown_suffix_and_failing_sources(spark):
    with pytest.raises(readers.SourceError, match="unsupported"):
        readers.read_path(spark, "x.abc")
    with pytest.raises(readers.SourceError):
        readers.failover([lambda: spark.read.parquet("/nowhere")])
    with pytest.raises(readers.SourceError):
        readers.unite_fetched({"a": ValueError()})


def test_sinks_and_cache(spark, panel, tmp_path):
    m = readers.write_panel(panel, str(tmp_path / "p"), ["instrument"])
    assert m["rows"] == 240
    again = readers.write_panel(panel.orderBy(F.desc("close")), str(tmp_path / "q"), ["instrument"])
    assert again["hash"] == m["hash"]
    cache = readers.PersistentCache(spark, str(tmp_path / "cache"))
    assert cache.get_or_compute(panel).count() == cache.get_or_compute(panel).count() == 240
    cache.save("k", panel)
    assert cache.exists("k")
    cache.invalidate("k")
    assert not cache.exists("k")
    readers.write_manifest(spark, m, str(tmp_path / "m"))


def test_generated_data_repeats(spark):
    a, b = readers.generate_ohlcv(spark, 20).collect(), readers.generate_ohlcv(spark, 20).collect()
    assert a == b and all(r["low"] <= r["open"] <= r["high"] for r in a)


def test_hashes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    h = X.frame_hash(df).first()
    assert h == X.frame_hash(df.select("y", "x").orderBy(F.desc("x"))).first()
    assert h != X.frame_hash(df.withColumn("x", F.col("x") + 1)).first()
    assert X.derive_seed(b"k", "a", "b") == X.derive_seed(b"k", "a", "b") != X.derive_seed(b"k", "a", "c")


def test_laplace_noise_has_its_scale(spark):
    r = spark.range(20000).select((X.laplace_noise(F.lit(0.0), 2.0, 7)).alias("x")).agg(F.avg(F.abs("x")).alias("m")).first()["m"]
    assert r == pytest.approx(0.5, rel=0.05)


def test_regimes_and_change_states_of_every_series(spark, monkeypatch):
    from tidegauge.queries import QUERIES, research

    rng = np.random.default_rng(7)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(60)]
    series = {k: [None, *map(float, rng.normal(0, 0.03, 29)), *map(float, rng.normal(0, 5, 30))] for k in (2, 7, 25)}
    df = spark.createDataFrame([(k, d, v) for k, vs in series.items() for d, v in zip(days, vs)], "instrument long, date date, r double")
    monkeypatch.setattr(research, "_returns", lambda spark, d: df)
    want, states = set(), {}
    for k, vs in series.items():
        vols = []
        for i in range(1, 60):
            near = vs[max(1, i - 19) : i + 1]
            trend = sum(math.log1p(max(v, -0.9)) for v in near)
            vols.append(math.log(max(math.sqrt(252 / 20 * sum(v * v for v in near)), 1e-12)))
            low, high = np.quantile(vols, [1 / 3, 2 / 3])
            vol = "lo" if vols[-1] <= low else "med" if vols[-1] <= high else "hi"
            kind = "high_vol" if vol == "hi" else "bear" if trend < -0.01 else "bull" if trend > 0.01 else "sideways"
            want.add((k, days[i], "hi" if trend > 0.01 else "lo" if trend < -0.01 else "flat", vol, kind))
        change = slow_bocpd(vs[1:], 1 / 100, 512, (0.0, 1.0, 1.0, 1.0))
        states |= {(k, days[0]): "stable"} | {(k, d): "changepoint" if c >= 0.5 else "transition" if t >= 0.25 else "stable" for d, (c, _, t) in zip(days[1:], change)}
    assert {tuple(r) for r in QUERIES["regime_classes"](spark, "").collect()} == want
    assert {(r[0], r[1]): r[2] for r in QUERIES["change_states"](spark, "").collect()} == states


def test_bootstrap_query_draws_as_many_as_the_reference(spark, monkeypatch):
    from tidegauge.queries import QUERIES, research

    monkeypatch.setattr(research, "_returns", lambda spark, d: None)
    monkeypatch.setattr(research.Z, "bootstrap_sharpe", lambda df, x, order, keys, n: n)
    assert QUERIES["bootstrap_sharpe"](spark, "") == 10_000
