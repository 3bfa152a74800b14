"""Queries of selection, cleaning, scalars, splits, statistics, portfolios, strategies, ledger, plans, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import cleaning as K
from ..operators import indicators as I
from ..operators import ledger as L
from ..operators import models as M
from ..operators import panel as P
from ..operators import portfolio as V
from ..operators import regimes as H
from ..operators import rolling as R
from ..operators import selection as S
from ..operators import splits as T
from ..operators import stats as Z
from ..operators import strategies as G
from ..plans import graph
from ..sources import readers
from ..sources.adapters import bars, predictions, table
from ..sources.shared import once
from .base import BARS, PREDICTIONS, query
from .relational import TIE, _six

KEYS, ORDER = ["instrument"], ["date"]
W = "(PARTITION BY instrument ORDER BY date)"


# selection ----------------------------------------------------------------------------------------------------------

TOP = PREDICTIONS + """, topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, fold_id, split, model_id ORDER BY prediction DESC, instrument) AS nth FROM predictions WHERE prediction IS NOT NULL) WHERE nth <= 5),
own AS (SELECT date, fold_id, split, model_id AS candidate_id, instrument, least(0.1::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY date, fold_id, split, model_id)) AS target_weight FROM topk),
pool AS (SELECT DISTINCT date, fold_id, split, instrument FROM topk), positions AS (SELECT * FROM own UNION ALL SELECT date, fold_id, split, 'equal_blend', instrument, least(0.1::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY date, fold_id, split)) FROM pool)"""


def _positions(spark, d):
    return S.positions_from_predictions(predictions(spark, d), 5)


def _book(spark, d):
    """Positions, and the returns that follow, of one panel."""
    p = predictions(spark, d)
    return once(S.positions_from_predictions(p, 5)), p.filter("model_id = 'momentum'").select("date", "instrument", "forward_return")


@query("positions_from_predictions", f"WITH {TOP} SELECT date, fold_id, split, candidate_id, instrument, round(target_weight, 9) AS target_weight FROM positions")
def positions_from_predictions(spark, d):
    return _positions(spark, d).select("date", "fold_id", "split", "candidate_id", "instrument", F.round("target_weight", 9).alias("target_weight"))


@query("positions_from_intents", f"""WITH {PREDICTIONS}, i AS (SELECT date, instrument, prediction AS score, CASE WHEN prediction > 0.5 THEN 'long' WHEN prediction < -0.5 THEN 'short' ELSE 'flat' END AS direction FROM predictions WHERE model_id = 'momentum'),
t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(score) DESC, instrument) AS n FROM i WHERE direction <> 'flat')
SELECT date, 's' AS candidate_id, instrument, round(CASE WHEN direction = 'short' THEN -1 ELSE 1 END * least(0.1::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY date)), 9) AS target_weight, 'fold_0' AS fold_id, 'test' AS split FROM t WHERE n <= 5""")
def positions_from_intents(spark, d):
    i = G.threshold_intents(predictions(spark, d).filter("model_id = 'momentum'"), "s", "bars", 0.5)
    p = S.positions_from_intents(i, "fold_0", "test", 5)
    return p.select("date", "candidate_id", "instrument", F.round("target_weight", 9).alias("target_weight"), "fold_id", "split")


@query("dedupe_by_flags", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'R', l_tax > 0.05, l_partkey, l_quantity) AS n FROM lineitem) WHERE n = 1")
def dedupe_by_flags(spark, d):
    x = table(spark, d, "lineitem").withColumns({"returned": F.col("l_returnflag") == "R", "taxed": F.col("l_tax") > 0.05})
    return S.dedupe_by_flags(x, ["l_orderkey", "l_linenumber"], ["returned", "taxed"], ["l_partkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("fullest_row", "SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY (CASE WHEN value IS NULL THEN 0 ELSE 1 END + CASE WHEN props IS NULL THEN 0 ELSE 1 END) DESC, event_id) AS n FROM events) WHERE n = 1")
def fullest_row(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return S.fullest_row(e, ["user_id", "day"], ["value", "props"], ["event_id"]).select("user_id", "day", "event_id")


@query("hash_samples", "SELECT o_orderkey FROM orders ORDER BY sha256('42|' || o_orderkey), o_orderkey LIMIT 100")
def hash_samples(spark, d):
    """A seeded sample of 100 rows (a sampling operator)."""
    return S.sample_rows(table(spark, d, "orders").select("o_orderkey"), 100, 42, ["o_orderkey"])


@query("stratified_keys", "WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7|' || o_orderpriority || '|' || o_orderkey), o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c, count(*) OVER () AS t FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE n <= greatest(1, floor(200 * c / t))")
def stratified_keys(spark, d):
    return S.stratified_keys(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], 200, 7)


@query("routed_positions", f"""WITH {TOP}, k AS (SELECT date, CASE WHEN day(date) % 2 = 0 THEN 'momentum' ELSE 'reversal' END AS candidate_id FROM (SELECT DISTINCT date FROM positions)) SELECT date, candidate_id, instrument, round(target_weight, 9) AS target_weight FROM positions JOIN k USING (date, candidate_id)""")
def routed_positions(spark, d):
    p = _positions(spark, d)
    k = p.select("date").distinct().withColumn("selected_candidate_id", F.when(F.dayofmonth("date") % 2 == 0, "momentum").otherwise("reversal"))
    return S.routed_positions(k, p).select("date", "candidate_id", "instrument", F.round("target_weight", 9).alias("target_weight"))


@query("weighted_positions", f"""WITH {TOP}, s(candidate_id, share) AS (VALUES ('momentum', 0.75::DOUBLE), ('volume', 0.25::DOUBLE)) SELECT date, instrument, round(sum(share * target_weight), 9) AS target_weight FROM positions JOIN s USING (candidate_id) GROUP BY 1, 2""")
def weighted_positions(spark, d):
    p = _positions(spark, d)
    k = p.select("date").distinct().withColumn("model_weights_json", F.lit('{"momentum": 3.0, "volume": 1.0, "reversal": -1.0}'))
    return S.weighted_positions(k, p).select("date", "instrument", F.round("target_weight", 9).alias("target_weight"))


@query("rank_predictions", f"WITH {PREDICTIONS} SELECT model_id, instrument, date, dense_rank() OVER (PARTITION BY model_id, fold_id, date ORDER BY prediction DESC) AS prediction_rank FROM predictions")
def rank_predictions(spark, d):
    return M.rank_predictions(predictions(spark, d).withColumn("interval", F.lit("1d"))).select("model_id", "instrument", "date", "prediction_rank")


# cleaning -----------------------------------------------------------------------------------------------------------

GAPS = BARS + ", gaps AS (SELECT instrument, date, CASE WHEN volume < 20 THEN NULL ELSE close END AS x FROM bars)"


def _gaps(spark, d):
    return bars(spark, d).select("instrument", "date", F.when(F.col("volume") >= 20, F.col("close")).alias("x"))


def _frame(a, b):
    return f"(PARTITION BY instrument ORDER BY date ROWS BETWEEN {a} AND {b})"


@query("impute", f"""WITH {GAPS}, i AS (SELECT *, row_number() OVER {W} AS n, last_value(x IGNORE NULLS) OVER {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS a, first_value(x IGNORE NULLS) OVER {_frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')} AS z FROM gaps),
j AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS ia, first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER {_frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')} AS iz FROM i)
SELECT instrument, date, round(a + 1.3e-9, 6) AS ffill, round(coalesce(a, z) + 1.3e-9, 6) AS fbfill, round(z + 1.3e-9, 6) AS bfill, round(CASE WHEN x IS NOT NULL THEN x WHEN iz > ia THEN a + (z - a) * (n - ia) / (iz - ia) END + 1.3e-9, 6) AS linear, round(coalesce(x, median(x) OVER (PARTITION BY instrument)) + 1.3e-9, 6) AS median FROM j""")
def impute(spark, d):
    g = _gaps(spark, d).withColumns({c: F.col("x") for c in ("ffill", "fbfill", "bfill", "linear", "median")})
    g = K.impute(K.impute(K.impute(g, "ffill", KEYS, ORDER), "fbfill", KEYS, ORDER, backward=True), "bfill", KEYS, ORDER, "backward_fill")
    g = K.impute(K.impute(g, "linear", KEYS, ORDER, "interpolate"), "median", KEYS, ORDER, "median")
    return _six(g, "instrument", "date", **{c: c for c in ("ffill", "fbfill", "bfill", "linear", "median")})


@query("impute_kalman")
def impute_kalman(spark, d):
    return _six(K.impute(_gaps(spark, d), "x", KEYS, ORDER, "kalman"), "instrument", "date", x="x")


@query("outliers", f"""WITH {BARS}, m AS (SELECT instrument, median(close) AS m, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS z FROM bars GROUP BY 1), k AS (SELECT instrument, median(abs(close - m)) AS mad FROM bars JOIN m USING (instrument) GROUP BY 1),
b AS (SELECT instrument, date, CASE WHEN coalesce(0.6745 * abs(close - m) / nullif(mad, 0) > 1.5, false) THEN NULL ELSE close END AS x, CASE WHEN close < a - 0.2 * (z - a) OR close > z + 0.2 * (z - a) THEN NULL ELSE close END AS y FROM bars JOIN m USING (instrument) JOIN k USING (instrument))
SELECT instrument, date, round(last_value(x IGNORE NULLS) OVER {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} + 1.3e-9, 6) AS by_mad, round(last_value(y IGNORE NULLS) OVER {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} + 1.3e-9, 6) AS by_iqr FROM b""")
def outliers(spark, d):
    b = bars(spark, d).select("instrument", "date", F.col("close").alias("by_mad"), F.col("close").alias("by_iqr"))
    b = K.outliers(K.outliers(b, "by_mad", KEYS, ORDER, threshold=1.5), "by_iqr", KEYS, ORDER, "iqr", factor=0.2)
    return _six(b, "instrument", "date", by_mad="by_mad", by_iqr="by_iqr")


@query("denoise", f"""WITH RECURSIVE {BARS}, n AS (SELECT instrument, date, close, row_number() OVER {W} AS i FROM bars), e AS (SELECT instrument, i, date, close AS v FROM n WHERE i = 1 UNION ALL SELECT n.instrument, n.i, n.date, n.close / 3 + e.v * 2 / 3 FROM e JOIN n ON n.instrument = e.instrument AND n.i = e.i + 1),
m AS (SELECT instrument, min(close) AS a, max(close) AS z FROM bars GROUP BY 1) SELECT e.instrument, e.date, round(v + 1.3e-9, 5) AS ewm, round((close - a) / (z - a) + 1.3e-9, 5) AS minmax FROM e JOIN n USING (instrument, i) JOIN m USING (instrument)""")
def denoise(spark, d):
    b = bars(spark, d).select("instrument", "date", F.col("close").alias("ewm"), F.col("close").alias("minmax"))
    b = K.denoise(K.denoise(b, "ewm", KEYS, ORDER), "minmax", KEYS, ORDER, "minmax")
    return b.select("instrument", "date", F.round(F.col("ewm") + F.lit(TIE), 5).alias("ewm"), F.round(F.col("minmax") + F.lit(TIE), 5).alias("minmax"))


@query("scaling_steps", f"""WITH {BARS}, q AS (SELECT instrument, avg(close) AS m, stddev_pop(close) AS s, min(close) AS a, max(close) AS z, median(close) AS d, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM bars GROUP BY 1)
SELECT instrument, date, round((close - m) / s + 1.3e-9, 6) AS zscore, round((close - a) / (z - a) + 1.3e-9, 6) AS minmax, round((close - d) / (q3 - q1) + 1.3e-9, 6) AS robust, round(least(greatest(close, 1000), 2000) + 1.3e-9, 6) AS clip, round(least(greatest(close, lo), hi) + 1.3e-9, 6) AS winsorize FROM bars JOIN q USING (instrument)""")
def scaling_steps(spark, d):
    names = ("zscore", "minmax", "robust", "winsorize")
    b = bars(spark, d).select("instrument", "date", *[F.col("close").alias(c) for c in (*names, "clip")])
    for c in names:
        b = K.scale(b, c, KEYS, c)
    b = K.scale(b, "clip", KEYS, "clip", 1000.0, 2000.0)
    return _six(b, "instrument", "date", **{c: c for c in (*names, "clip")})


@query("robust_indicator_scales", f"""WITH {PREDICTIONS}, q AS (SELECT median(prediction) AS m, quantile_cont(prediction, 0.25) AS a, quantile_cont(prediction, 0.75) AS z FROM predictions WHERE model_id = 'momentum' AND split = 'train')
SELECT instrument, date, round((least(greatest(prediction, m - 3 * (z - a)), m + 3 * (z - a)) - m) / greatest(z - a, 1e-6) + 1.3e-9, 6) AS prediction FROM predictions, q WHERE model_id = 'momentum'""")
def robust_indicator_scales(spark, d):
    p = predictions(spark, d).filter("model_id = 'momentum'")
    return _six(K.apply_robust_scales(p, K.fit_robust_scales(p, ["prediction"]), ["prediction"]), "instrument", "date", prediction="prediction")


@query("feature_encoder", f"""WITH {PREDICTIONS}, x AS (SELECT instrument, date, split, CASE WHEN abs(prediction) < 1 THEN prediction END AS f FROM predictions WHERE model_id = 'momentum'), m AS (SELECT median(f) AS med FROM x WHERE split = 'train'), s AS (SELECT avg(coalesce(f, med)) AS m, stddev_pop(coalesce(f, med)) AS sd FROM x, m WHERE split = 'train')
SELECT instrument, date, round((coalesce(f, med) - m) / sd + 1.3e-9, 6) AS f FROM x, m, s""")
def feature_encoder(spark, d):
    p = predictions(spark, d).filter("model_id = 'momentum'").select("instrument", "date", "split", F.when(F.abs("prediction") < 1, F.col("prediction")).alias("f"))
    return _six(K.encode(p, K.fit_encoder(p.filter("split = 'train'"), ["f"])), "instrument", "date", f="f")


@query("provider_columns", "SELECT o_orderkey, coalesce(c_acctbal, -1) AS c_acctbal FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey)")
def provider_columns(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return K.join_provider(table(spark, d, "orders"), c, ["o_custkey"], ["c_acctbal"], -1.0).select("o_orderkey", "c_acctbal")


@query("anomaly_filter")
def anomaly_filter(spark, d):
    return K.drop_anomalies(bars(spark, d).select("instrument", "date", "close", "volume"), ["close", "volume"], KEYS)


# scalars ------------------------------------------------------------------------------------------------------------


@query("text_scalars", """SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii_chars, length(regexp_replace(text, '(?s).', '*', 'g')) AS masked_chars, sha256('salt' || doc_id) AS anon_sha, md5('salt' || doc_id) AS anon_md5,
len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w = 'the')) * 1.0 - len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w = 'idiot')) * 2.0 AS sentiment FROM documents""".replace("* 1.0", "* 1.0::DOUBLE").replace("* 2.0", "* 2.0::DOUBLE"))
def text_scalars(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.length(X.clean_ascii("text")).alias("ascii_chars"), F.length(X.mask("text")).alias("masked_chars"), X.salted_hash("doc_id", "salt").alias("anon_sha"), X.salted_hash("doc_id", "salt", "md5").alias("anon_md5"), X.lexicon_sentiment("text", {"the": 1.0, "idiot": -2.0}).alias("sentiment"))


@query("time_scalars", """SELECT event_id, isodow(ts) AS day_of_week, strftime(ts, '%m-%d') = '01-01' AND year(ts) = 2024 AS is_holiday_us, month(ts) AS month, quarter(ts) AS quarter, date_trunc('month', ts)::DATE AS month_start, hour(ts) BETWEEN 9 AND 15 AS hour_in_session, floor(epoch(ts))::BIGINT // 3600 * 3600 AS bucket FROM events""")
def time_scalars(spark, d):
    e = table(spark, d, "events")
    c, f = X.calendar_columns("ts", {"US": ["2024-01-01"]}), X.calendar_features("ts")
    return e.select("event_id", c["day_of_week"].alias("day_of_week"), c["is_holiday_us"].alias("is_holiday_us"), f["month"].alias("month"), f["quarter"].alias("quarter"), f["month_start"].alias("month_start"), f["hour_in_session"].alias("hour_in_session"), F.unix_timestamp(R.time_bucket("ts", 3600)).alias("bucket"))


@query("market_hours", """WITH z AS (SELECT event_id, ts, ts - CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS t FROM events), m AS (SELECT *, hour(t) * 60 + minute(t) AS minute, isodow(t) AS dow FROM z)
SELECT event_id, dow < 6 AND minute >= 570 AND minute < 960 AS is_open, CAST(CAST(t AS DATE) + CASE WHEN minute < 570 AND dow < 6 THEN 0 WHEN dow = 5 THEN 3 WHEN dow = 6 THEN 2 ELSE 1 END AS TIMESTAMP) + INTERVAL 570 MINUTE AS next_open, ts + CASE WHEN ts >= TIMESTAMP '2024-03-10 02:00:00' AND ts < TIMESTAMP '2024-11-03 02:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS instant FROM m""")
def market_hours(spark, d):
    return table(spark, d, "events").select("event_id", X.market_open("ts").alias("is_open"), X.next_open("ts").alias("next_open"), X.attach_zone("ts", "America/New_York").alias("instant"))


@query("trading_dates", "SELECT date FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY))::DATE AS date) WHERE isodow(date) < 6")
def trading_dates(spark, d):
    return X.trading_dates(spark, "2024-01-01", "2024-12-31")


@query("json_weights", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE round(1 / (1 + exp(least(greatest(event_id % 7 / 2.0, -20), 20)) + exp(-0.5::DOUBLE)) + 1.3e-9, 6) END AS abstain, round(CASE WHEN event_type = 'click' THEN 0.5 WHEN event_type = 'view' THEN 0.75 ELSE 1.0 END * greatest(0.1, 1 - 0.25 * least(event_id % 10 / 8.0, 1)) + 1.3e-9, 6) AS exposure,
round(CASE WHEN event_id % 5 + 0.5 > 2 THEN (event_id % 5) * 2 / (event_id % 5 + 0.5) ELSE event_id % 5 END + 1.3e-9, 6) AS weight_a FROM events""".replace("/ 2.0", "/ 2.0::DOUBLE").replace("/ 8.0", "/ 8.0::DOUBLE").replace("+ 0.5)", "+ 0.5::DOUBLE)"))
def json_weights(spark, d):
    e = table(spark, d, "events")
    deltas = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(-1.0), F.lit(0.0))).otherwise(F.array((F.col("event_id") % 7) / F.lit(2.0), F.lit(-0.5)))
    deltas = F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") % 7 == 0), F.array(F.lit(0.0), F.lit(-0.5))).otherwise(deltas)
    abstain = X.abstain_probability(deltas, hurdle=-0.1)
    abstain = F.when(F.col("event_id") % 3 == 0, X.abstain_probability(F.array(F.lit(-1.0)), hurdle=0.0)).otherwise(abstain)
    vol = F.when(F.col("event_type") == "click", "high").when(F.col("event_type") == "view", "mid").otherwise("low")
    weights = X.normalize_weights(F.create_map(F.lit("a"), (F.col("event_id") % 5).cast("double"), F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(-1.0), F.lit("cash"), F.lit(9.0)), 2.0)
    return _six(e, "event_id", abstain=abstain, exposure=X.exposure_scale(vol, (F.col("event_id") % 10) / F.lit(8.0)), weight_a=weights["a"])


@query("frame_hash")
def frame_hash(spark, d):
    return X.frame_hash(table(spark, d, "lineitem"))


@query("canonical_json", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS h FROM customer""")
def canonical_json(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.canonical_json_hash(["c_name", "c_custkey", "c_mktsegment"]).alias("h"))


@query("minhash")
def minhash(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.minhash(F.array_distinct(F.split("text", " ")), 32).alias("m"))
    return t.select("doc_id", F.sha2(F.array_join(F.transform("m", lambda x: x.cast("string")), ","), 256).alias("signature"), X.minhash_likeness("m", "m").alias("self"))


@query("vector_sketch")
def vector_sketch(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", X.vector_sketch("embedding", 64).alias("s"))
    return e.select("vec_id", F.hex(F.col("s")[0]).alias("lo"), F.hex(F.col("s")[1]).alias("hi"), X.hamming("s", "s").alias("self"))


@query("rolling_boundaries")
def rolling_boundaries(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(X.rolling_boundaries("text")).alias("n_chunks"), F.array_join(F.transform(X.rolling_boundaries("text"), lambda x: x.cast("string")), ",").alias("ends"))


@query("date_chunks", "SELECT count(DISTINCT floor(epoch(ts))::BIGINT // 432000) AS n_chunks, count(*) AS n FROM events")
def date_chunks(spark, d):
    return X.chunk_windows(table(spark, d, "events"), "ts", "5D").agg(F.countDistinct("chunk").alias("n_chunks"), F.count("*").alias("n"))


@query("date_codes", f"WITH {BARS} SELECT instrument, date, dense_rank() OVER (ORDER BY date) - 1 AS date_code FROM bars")
def date_codes(spark, d):
    return X.date_codes(bars(spark, d).select("instrument", "date"))


# splits -------------------------------------------------------------------------------------------------------------

POS = BARS + ", p AS (SELECT instrument, date, row_number() OVER (ORDER BY date, instrument) - 1 AS pos, count(*) OVER () AS n FROM bars)"
FOLD_AGG = "SELECT fold, role, count(*) AS n, min(date) AS start, max(date) AS \"end\", sum(pos)::BIGINT AS pos_sum FROM f GROUP BY 1, 2"


def _fold_agg(df):
    return df.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"), F.sum("pos").cast("long").alias("pos_sum"))


def _panel(spark, d):
    return bars(spark, d).select("instrument", "date")


@query("split_walk_forward", f"""WITH {POS}, b AS (SELECT fold, n - (5 - fold) * 252 AS s FROM (SELECT DISTINCT n FROM p), (SELECT unnest(range(5)) AS fold)), c AS (SELECT fold, s, date AS d FROM b JOIN p ON pos = s),
f AS (SELECT fold, 'train' AS role, date, pos FROM p, c WHERE pos < s AND date <= d - 5 UNION ALL SELECT fold, 'test', date, pos FROM p, c WHERE pos >= s AND pos < s + 252) {FOLD_AGG}""")
def split_walk_forward(spark, d):
    return _fold_agg(T.walk_forward(_panel(spark, d), "date", ["instrument"]))


@query("split_purged_kfold", f"""WITH {POS}, b AS (SELECT fold, fold * (n // 5) AS a, CASE WHEN fold < 4 THEN (fold + 1) * (n // 5) ELSE n END AS z FROM (SELECT DISTINCT n FROM p), (SELECT unnest(range(5)) AS fold)), c AS (SELECT fold, a, z, x.date AS da, y.date AS dz FROM b JOIN p x ON x.pos = a JOIN p y ON y.pos = z - 1),
f AS (SELECT fold, 'train' AS role, date, pos FROM p, c WHERE (pos < a OR pos >= z) AND (date < da - 5 OR date > dz + 3) UNION ALL SELECT fold, 'test', date, pos FROM p, c WHERE pos >= a AND pos < z) {FOLD_AGG}""")
def split_purged_kfold(spark, d):
    return _fold_agg(T.purged_kfold(_panel(spark, d), "date", ["instrument"]))


@query("split_cpcv", f"""WITH {POS}, g AS (SELECT g, (n * g) // 4 AS a, (n * (g + 1)) // 4 AS z FROM (SELECT DISTINCT n FROM p), (SELECT unnest(range(4)) AS g)), k AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS fold, x.g AS g1, y.g AS g2 FROM g x JOIN g y ON x.g < y.g), m AS (SELECT pos, date, g, a, z FROM p JOIN g ON pos >= a AND pos < z),
f AS (SELECT fold, 'train' AS role, date, pos FROM m, k WHERE g <> g1 AND g <> g2 UNION ALL SELECT fold, 'test', date, pos FROM m, k WHERE (g = g1 OR g = g2) AND pos >= a + CASE WHEN g > 0 AND g - 1 <> g1 AND g - 1 <> g2 THEN 20 ELSE 0 END AND pos < z - CASE WHEN g < 3 AND g + 1 <> g1 AND g + 1 <> g2 THEN 10 ELSE 0 END) {FOLD_AGG}""")
def split_cpcv(spark, d):
    return _fold_agg(T.cpcv(_panel(spark, d), "date", ["instrument"], 4, 2, 10, 20))


@query("split_forward_variants", f"""WITH {POS}, f AS (SELECT k AS fold, 'train' AS role, date, pos FROM p, (SELECT unnest(range(4)) AS k) WHERE pos < k * (n // 4) - 50 UNION ALL SELECT k, 'test', date, pos FROM p, (SELECT unnest(range(4)) AS k) WHERE pos >= k * (n // 4) AND pos < (k + 1) * (n // 4)) {FOLD_AGG}""")
def split_forward_variants(spark, d):
    return _fold_agg(T.purged_forward(_panel(spark, d), "date", ["instrument"], 4, 50))


@query("split_forward_cpcv", f"""WITH {POS}, k AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS fold, x, y FROM (SELECT unnest(range(4)) AS x), (SELECT unnest(range(4)) AS y) WHERE x < y),
f AS (SELECT fold, 'train' AS role, date, pos FROM p, k WHERE pos < x * (n // 4) - 50 UNION ALL SELECT fold, 'test', date, pos FROM p, k WHERE (pos // (n // 4)) IN (x, y)) {FOLD_AGG}""")
def split_forward_cpcv(spark, d):
    return _fold_agg(T.forward_cpcv(_panel(spark, d), "date", ["instrument"], 4, 2, 50))


@query("split_walk_forward_dates", f"WITH {BARS}, c AS (SELECT count(DISTINCT date) AS n FROM bars), s AS (SELECT n, greatest(1, n // 4) AS size FROM c) SELECT 'fold_' || i AS fold, size * (i + 1) - 2 AS train_end, size * (i + 1) AS test_start, least(size * (i + 2), n) AS test_end FROM s, (SELECT unnest(range(3)) AS i)")
def split_walk_forward_dates(spark, d):
    return T.walk_forward_dates(_panel(spark, d), "date", 3, 2)


@query("split_regimes", f"WITH {BARS} SELECT instrument, date, CASE WHEN date < DATE '1994-01-01' THEN 'a' ELSE 'b' END AS regime FROM bars WHERE date >= DATE '1992-01-01' AND date < DATE '1996-01-01'")
def split_regimes(spark, d):
    return T.regime_splits(_panel(spark, d), "date", [("a", "1992-01-01", "1994-01-01"), ("b", "1993-01-01", "1996-01-01")])


@query("project_regime", "SELECT * FROM (VALUES (0, 'bull'), (1, 'bear'), (2, 'unknown')) t(fold, regime)")
def project_regime(spark, d):
    to = lambda df: df.withColumns({c: F.to_timestamp(c) for c in ("start", "end")})
    folds = to(spark.createDataFrame([(0, "2020-01-01", "2020-04-01"), (1, "2020-04-01", "2020-07-01"), (2, "2021-01-01", "2021-02-01")], "fold int, start string, end string"))
    return T.project_regime(folds, to(spark.createDataFrame([("bull", "2020-01-01", "2020-03-15"), ("bear", "2020-03-15", "2020-06-15"), ("bull", "2020-06-15", "2020-07-01")], "regime string, start string, end string")))


@query("backtest_split", "SELECT o_orderkey, floor(count(*) OVER () * 0.7)::BIGINT AS bt_split_idx FROM orders")
def backtest_split(spark, d):
    return T.backtest_split(table(spark, d, "orders").select("o_orderkey"))


# panel --------------------------------------------------------------------------------------------------------------

BASE = BARS + f""", raw AS (SELECT instrument, date, close AS raw_close, volume AS raw_volume, close AS adj_close, high AS adj_high, low AS adj_low, close / lag(close) OVER {W} - 1 AS r, lead(close) OVER {W} / close - 1 AS fwd, close * volume AS dv FROM bars)"""


def _base(spark, d):
    b = bars(spark, d)
    return b.select("instrument", "date", F.col("close").alias("raw_close"), F.col("volume").alias("raw_volume"), F.col("close").alias("adj_close"), F.col("high").alias("adj_high"), F.col("low").alias("adj_low"))


@query("base_panel", f"""WITH {BASE}, l AS (SELECT *, CASE WHEN adj_close > 1e-6 AND abs(fwd) <= 1 AND abs(r) <= 1 THEN fwd END AS f, median(dv) OVER {_frame('20 PRECEDING', '1 PRECEDING')} AS m FROM raw)
SELECT instrument, date, round(f + 1.3e-9, 6) AS forward_return_horizon, round(m + 1.3e-9, 4) AS rolling_20d_median_dollar_volume, CASE WHEN raw_close <= 5 THEN 'sub_5' WHEN raw_close <= 20 THEN '5_to_20' WHEN raw_close <= 100 THEN '20_to_100' ELSE '100_plus' END AS price_bucket,
CASE WHEN dv <= 1000000 THEN 'lt_1m' WHEN dv <= 5000000 THEN '1m_to_5m' WHEN dv <= 25000000 THEN '5m_to_25m' ELSE '25m_plus' END AS liquidity_bucket FROM l WHERE f IS NOT NULL""")
def base_panel(spark, d):
    b = P.base_panel(_base(spark, d))
    return b.select("instrument", "date", F.round(F.col("forward_return_horizon") + F.lit(TIE), 6).alias("forward_return_horizon"), F.round(F.col("rolling_20d_median_dollar_volume") + F.lit(TIE), 4).alias("rolling_20d_median_dollar_volume"), "price_bucket", "liquidity_bucket")


def _past(n):
    return _frame(f"{n} PRECEDING", "1 PRECEDING")


@query("regimes_and_signals", f"""WITH {BASE}, s AS (SELECT *, lag(adj_close, 1) OVER {W} / lag(adj_close, 6) OVER {W} - 1 AS m5, lag(adj_close, 1) OVER {W} / lag(adj_close, 21) OVER {W} - 1 AS m20, CASE WHEN count(r) OVER {_past(20)} >= 5 THEN stddev_samp(r) OVER {_past(20)} END AS v20, CASE WHEN count(r) OVER {_past(60)} >= 20 THEN stddev_samp(r) OVER {_past(60)} END AS v60,
  -CASE WHEN count(adj_close) OVER {_past(10)} >= 3 THEN avg((adj_high - adj_low) / adj_close) OVER {_past(10)} END AS rc, lag(raw_volume) OVER {W} / CASE WHEN count(raw_volume) OVER {_past(20)} >= 5 THEN avg(raw_volume) OVER {_past(20)} END - 1 AS vp, lag(adj_close) OVER {W} / CASE WHEN count(adj_close) OVER {_past(60)} >= 5 THEN max(adj_close) OVER {_past(60)} END - 1 AS dd FROM raw),
t AS (SELECT *, CASE WHEN count(v20) OVER {_frame('UNBOUNDED PRECEDING', '1 PRECEDING')} >= 20 THEN median(v20) OVER {_frame('UNBOUNDED PRECEDING', '1 PRECEDING')} END AS med FROM s)
SELECT instrument, date, round(m5 + 1.3e-9, 5) AS momentum_5d, round(m20 + 1.3e-9, 5) AS momentum_20d, round(v20 + 1.3e-9, 5) AS realized_volatility_20d, round(m20 / nullif(v20, 0) + 1.3e-9, 5) AS trend_strength, round(v20 / nullif(v60, 0) - 1 + 1.3e-9, 5) AS volatility_breakout, round(rc + 1.3e-9, 5) AS range_compression, round(vp + 1.3e-9, 5) AS volume_proxy, round(dd + 1.3e-9, 5) AS drawdown_60d,
  CASE WHEN coalesce(m20 > 0, false) THEN 'trend_bull' ELSE 'trend_bear' END || '__' || CASE WHEN coalesce(v20 > med, false) THEN 'vol_high' ELSE 'vol_low' END AS regime_id FROM t""")
def regimes_and_signals(spark, d):
    b = _base(spark, d).withColumn("adjusted_return_1d", R.pct_change("adj_close", R.series(KEYS, ORDER)))
    names = ["momentum_5d", "momentum_20d", "realized_volatility_20d", "trend_strength", "volatility_breakout", "range_compression", "volume_proxy", "drawdown_60d"]
    return P.regimes_and_signals(b).select("instrument", "date", *[F.round(F.col(c) + F.lit(TIE), 5).alias(c) for c in names], "regime_id")


ADJ = BARS + """, sp AS (SELECT DISTINCT instrument, date AS e FROM ticks WHERE volume = 50), dv AS (SELECT DISTINCT instrument, date AS e FROM ticks WHERE volume = 1),
a AS (SELECT instrument, date, close, volume, power(0.5::DOUBLE, (SELECT count(*) FROM sp WHERE sp.instrument = b.instrument AND e > b.date)) AS sf, power(0.98::DOUBLE, (SELECT count(*) FROM dv WHERE dv.instrument = b.instrument AND e > b.date)) AS df FROM bars b)"""


@query("adjusted_ohlcv", f"""WITH {ADJ} SELECT instrument, date, round(ln(sf * df) + 1.3e-9, 6) AS log_factor, round(ln(close * sf * df) + 1.3e-9, 6) AS log_adj_close, round(ln(volume / sf) + 1.3e-9, 6) AS log_adj_volume, EXISTS (SELECT 1 FROM sp WHERE sp.instrument = a.instrument AND e = a.date) OR EXISTS (SELECT 1 FROM dv WHERE dv.instrument = a.instrument AND e = a.date) AS corporate_action_flag FROM a""")
def adjusted_ohlcv(spark, d):
    from ..sources.adapters import ticks

    t = ticks(spark, d)
    ev = lambda v, f: t.filter(F.col("volume") == v).select("instrument", F.col("date").alias("event_date")).distinct().withColumn("factor", F.lit(f))
    b = P.adjust_prices(bars(spark, d).drop("dollar_volume"), ev(50, 0.5), ev(1, 0.98), "instrument")
    return _six(b, "instrument", "date", "corporate_action_flag", log_factor=F.log("adjustment_factor"), log_adj_close=F.log("adj_close"), log_adj_volume=F.log("adj_volume"))


@query("indicators_windowed", f"""WITH {BARS}, x AS (SELECT *, (high + low + close) / 3 AS tp, close * volume AS dv, coalesce(sign(close - lag(close) OVER {W}), 0) * volume AS sv FROM bars),
y AS (SELECT *, sign(tp - lag(tp) OVER {W}) * tp * volume AS flow, sum(sv) OVER {W} AS obv, CASE WHEN count(*) OVER {_frame('13 PRECEDING', 'CURRENT ROW')} >= 14 THEN 100 * (close - min(low) OVER {_frame('13 PRECEDING', 'CURRENT ROW')}) / nullif(max(high) OVER {_frame('13 PRECEDING', 'CURRENT ROW')} - min(low) OVER {_frame('13 PRECEDING', 'CURRENT ROW')}, 0) END AS k, list(tp) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} AS tps, avg(tp) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} AS mtp FROM x),
z AS (SELECT *, CASE WHEN count(k) OVER {_frame('2 PRECEDING', 'CURRENT ROW')} >= 3 THEN avg(k) OVER {_frame('2 PRECEDING', 'CURRENT ROW')} END AS sk FROM y)
SELECT instrument, date, round(100 * (close / lag(close, 5) OVER {W} - 1) + 1.3e-9, 5) AS roc_5, round(sk + 1.3e-9, 5) AS stoch_k_14_3, round(CASE WHEN count(sk) OVER {_frame('2 PRECEDING', 'CURRENT ROW')} >= 3 THEN avg(sk) OVER {_frame('2 PRECEDING', 'CURRENT ROW')} END + 1.3e-9, 5) AS stoch_d_14_3, round(k - 100 + 1.3e-9, 5) AS williams_r_14,
  round(CASE WHEN len(tps) >= 20 THEN (tp - mtp) / nullif(0.015 * list_avg(list_transform(tps, lambda v: abs(v - mtp))), 0) END + 1.3e-9, 5) AS cci_20, round(obv - lag(obv, 20) OVER {W} + 1.3e-9, 5) AS obv_change_20,
  round(CASE WHEN count(flow) OVER {_frame('13 PRECEDING', 'CURRENT ROW')} >= 14 THEN 100 - 100 / (1 + sum(CASE WHEN flow > 0 THEN flow ELSE 0 END) OVER {_frame('13 PRECEDING', 'CURRENT ROW')} / nullif(sum(CASE WHEN flow < 0 THEN -flow ELSE 0 END) OVER {_frame('13 PRECEDING', 'CURRENT ROW')}, 0)) END + 1.3e-9, 5) AS mfi_14,
  round(CASE WHEN count(*) OVER {_frame('9 PRECEDING', 'CURRENT ROW')} >= 3 THEN avg((high - low) / close) OVER {_frame('9 PRECEDING', 'CURRENT ROW')} END + 1.3e-9, 5) AS range_ratio_10, round(CASE WHEN count(*) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} >= 5 THEN volume / avg(volume) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} - 1 END + 1.3e-9, 5) AS volume_ratio_20 FROM z""")
def indicators_windowed(spark, d):
    names = ["roc_5", "stoch_k_14_3", "stoch_d_14_3", "williams_r_14", "cci_20", "obv_change_20", "mfi_14", "range_ratio_10", "volume_ratio_20"]
    b = I.windowed(bars(spark, d), KEYS, ORDER)
    return b.select("instrument", "date", *[F.round(F.col(c) + F.lit(TIE), 5).alias(c) for c in names])


@query("indicator_panel")
def indicator_panel(spark, d):
    p = I.indicator_panel(bars(spark, d), KEYS, ORDER)
    return p.select("instrument", "date", *[F.round(c, 5).alias(c) for c in I.ALL])


# statistics ---------------------------------------------------------------------------------------------------------


def _returns(spark, d):
    return bars(spark, d).select("instrument", "date", R.log_return("close", R.series(KEYS, ORDER)).alias("r"))


RET = BARS + f", rets AS (SELECT instrument, date, ln(close / lag(close) OVER {W}) AS r FROM bars)"


@query("return_moments", f"""WITH {RET}, m AS (SELECT instrument, avg(r) AS m, count(r) AS n, stddev_samp(r) AS sd FROM rets GROUP BY 1), c AS (SELECT instrument, avg(power(r - m, 2)) AS m2, avg(power(r - m, 3)) AS m3, avg(power(r - m, 4)) AS m4 FROM rets JOIN m USING (instrument) WHERE r IS NOT NULL GROUP BY 1)
SELECT instrument, n, round(m + 1.3e-9, 6) AS mean, round(sd + 1.3e-9, 6) AS std, round(m3 / power(m2, 1.5) + 1.3e-9, 6) AS skew, round(m4 / (m2 * m2) - 3 + 1.3e-9, 6) AS kurtosis, round(m / sd * sqrt(252) + 1.3e-9, 6) AS sharpe FROM m JOIN c USING (instrument)""")
def return_moments(spark, d):
    return _six(Z.moments(_returns(spark, d), "r", KEYS), "instrument", "n", **{c: c for c in ("mean", "std", "skew", "kurtosis", "sharpe")})


@query("validity_report")
def validity_report(spark, d):
    return Z.validity(_returns(spark, d), "r", KEYS, n_trials=10)


@query("bootstrap_sharpe")
def bootstrap_sharpe(spark, d):
    return Z.bootstrap_sharpe(_returns(spark, d), "r", "date", KEYS, 10_000)


SURFACE = PREDICTIONS + """, o AS (SELECT model_id, fold_id, sign(prediction) * greatest(least(forward_return, 0.5), -0.5) AS r FROM predictions), s AS (SELECT model_id, fold_id, count(r)::DOUBLE AS n, sum(r) AS s, sum(r * r) AS q FROM o GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER w - n AS rn, sum(s) OVER w - s AS rs, sum(q) OVER w - q AS rq FROM s WINDOW w AS (PARTITION BY model_id)),
surface AS (SELECT fold_id AS path, model_id AS trial, rs / rn / sqrt(greatest(0, (rq - rs * rs / rn) / (rn - 1))) * sqrt(252) AS is_score, s / n / sqrt(greatest(0, (q - s * s / n) / (n - 1))) * sqrt(252) AS oos_score FROM t)"""


def _surface(spark, d):
    o = predictions(spark, d).select("model_id", F.col("fold_id").alias("fold"), (F.signum("prediction") * F.greatest(F.least("forward_return", F.lit(0.5)), F.lit(-0.5))).alias("net_return"))
    return Z.walk_forward_surface(o)


@query("walk_forward_surface", f"WITH {SURFACE} SELECT path, trial, round(is_score + 1.3e-9, 6) AS is_score, round(oos_score + 1.3e-9, 6) AS oos_score FROM surface")
def walk_forward_surface(spark, d):
    return _six(_surface(spark, d), "path", "trial", is_score="is_score", oos_score="oos_score")


@query("overfitting", f"""WITH {SURFACE}, k AS (SELECT *, rank() OVER (PARTITION BY path ORDER BY oos_score) + (count(*) OVER (PARTITION BY path, oos_score) - 1) / 2 AS rk, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY is_score DESC, trial) AS best FROM surface) SELECT count(*) AS n_paths, round(avg(CASE WHEN rk / (n + 1) < 0.5 THEN 1.0 ELSE 0.0 END) + 1.3e-9, 6) AS pbo, round(avg(rk / (n + 1)) + 1.3e-9, 6) AS mean_rank FROM k WHERE best = 1""")
def overfitting(spark, d):
    return _six(Z.overfitting(_surface(spark, d)), "n_paths", pbo="pbo", mean_rank="mean_rank")


@query("crisis_report", f"""WITH {RET} SELECT CASE WHEN date BETWEEN DATE '1994-01-01' AND DATE '1994-06-30' THEN 'crunch' ELSE 'outside' END AS "window", count(r) AS n, round(avg(r) + 1.3e-9, 6) AS mean, round(avg(r) / stddev_samp(r) * sqrt(252) + 1.3e-9, 6) AS sharpe FROM rets GROUP BY 1""")
def crisis_report(spark, d):
    return _six(Z.crisis_report(_returns(spark, d), [("crunch", "1994-01-01", "1994-06-30")], "r"), "window", "n", mean="mean", sharpe="sharpe")


@query("harvey_t", f"WITH {RET} SELECT instrument, round(avg(r) / stddev_samp(r) * sqrt(252) * sqrt(count(r) / 252.0) + 1.3e-9, 6) AS t_stat FROM rets GROUP BY 1")
def harvey_t(spark, d):
    m = Z.moments(_returns(spark, d), "r", KEYS)
    return _six(m, "instrument", t_stat=Z.harvey_t(F.col("sharpe"), F.col("n")))


@query("ljung_box", f"""WITH {RET}, e AS (SELECT instrument, date, r - avg(r) OVER (PARTITION BY instrument) AS e, row_number() OVER {W} AS i FROM rets WHERE r IS NOT NULL), v AS (SELECT instrument, count(*)::DOUBLE AS n, sum(e * e) AS v FROM e GROUP BY 1),
c AS (SELECT a.instrument, k, sum(a.e * b.e) AS c FROM e a JOIN (SELECT unnest(range(1, 11)) AS k) ON true JOIN e b ON b.instrument = a.instrument AND b.i = a.i - k GROUP BY 1, 2) SELECT instrument, n::BIGINT AS n, round(n * (n + 2) * sum(power(c / v, 2) / (n - k)) + 1.3e-9, 5) AS q_stat FROM c JOIN v USING (instrument) GROUP BY instrument, n""")
def ljung_box(spark, d):
    return Z.ljung_box(_returns(spark, d), "r", KEYS, ORDER).select("instrument", "n", F.round(F.col("q_stat") + F.lit(TIE), 5).alias("q_stat"))


@query("series_tests")
def series_tests(spark, d):
    b = bars(spark, d).select("instrument", "date", F.log("close").alias("x"), F.log("volume").alias("y"))
    return Z.run_tests(b, ["adf", "kpss", "ljung_box", "granger", "johansen"], ["x", "y"], KEYS, ORDER)


@query("mean_shift", f"""WITH {RET}, i AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS i FROM rets), z AS (SELECT instrument, """ + ", ".join(f"abs(avg(r) FILTER (i <= {n}) - avg(r) FILTER (i > {n})) / nullif(stddev_samp(r) FILTER (i > {n}) / sqrt(count(r) FILTER (i <= {n})), 0) AS z{n}" for n in (20, 60, 200)) + """ FROM i GROUP BY 1) SELECT instrument, round(z20 + 1.3e-9, 6) AS z_short, round(z60 + 1.3e-9, 6) AS z_medium, round(z200 + 1.3e-9, 6) AS z_long, coalesce(z20 > 2.5, false) OR coalesce(z60 > 2.5, false) OR coalesce(z200 > 3.75, false) AS drift FROM z""")
def mean_shift(spark, d):
    return _six(Z.mean_shift(_returns(spark, d), "r", KEYS, ORDER), "instrument", "drift", **{f"z_{k}": f"z_{k}" for k in ("short", "medium", "long")})


@query("embedding_coherence", """WITH u AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u, vec_id FROM embeddings), p AS (SELECT a.label = b.label AS same, list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id),
m AS (SELECT avg(c) FILTER (same) AS w, avg(c) FILTER (NOT same) AS x FROM p) SELECT round(w + 1.3e-9, 6) AS within_cosine, round(x + 1.3e-9, 6) AS cross_cosine, round(w / x + 1.3e-9, 4) AS coherence_ratio FROM m""")
def embedding_coherence(spark, d):
    e = Z.embedding_coherence(table(spark, d, "embeddings"), "embedding", "label", "vec_id")
    return e.select(F.round(F.col("within_cosine") + F.lit(TIE), 6).alias("within_cosine"), F.round(F.col("cross_cosine") + F.lit(TIE), 6).alias("cross_cosine"), F.round(F.col("coherence_ratio") + F.lit(TIE), 4).alias("coherence_ratio"))


# portfolio and routing ------------------------------------------------------------------------------------------------

PATHS = TOP + """, days AS (SELECT date, row_number() OVER (ORDER BY date) AS code FROM (SELECT DISTINCT date FROM positions)), rr AS (SELECT date, instrument, forward_return FROM predictions WHERE model_id = 'momentum'),
grid AS (SELECT candidate_id, instrument, date, code FROM (SELECT DISTINCT candidate_id, instrument FROM positions), days), w0 AS (SELECT g.*, coalesce(p.target_weight, 0) AS w, coalesce(r.forward_return, 0) AS f FROM grid g LEFT JOIN positions p USING (candidate_id, instrument, date) LEFT JOIN rr r USING (date, instrument)),
w1 AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY candidate_id, instrument ORDER BY code), 0) AS pw FROM w0), dd AS (SELECT candidate_id, date, code, sum(w * f) AS g, sum(abs(w - pw)) AS t, sum(abs(w)) AS a FROM w1 GROUP BY 1, 2, 3),
net AS (SELECT *, CASE WHEN a > 0 THEN g ELSE 0 END - t * 5e-4 AS net FROM dd), cum AS (SELECT *, sum(ln(1 + greatest(net, -0.99))) OVER (PARTITION BY candidate_id ORDER BY code) AS c FROM net), pk AS (SELECT *, max(c) OVER (PARTITION BY candidate_id ORDER BY code) - c AS drawdown FROM cum),
lab AS (SELECT candidate_id, date, code, g, t, net, drawdown, net - 0.5 * net * net - 0.1 * t - 0.2 * greatest(0, drawdown - coalesce(lag(drawdown) OVER (PARTITION BY candidate_id ORDER BY code), 0)) AS u FROM pk)"""
COSTS = V.Costs(lambda_turnover=0.1, eta_drawdown=0.2)


@query("weight_path", f"WITH {PATHS} SELECT candidate_id, date, round(g + 1.3e-9, 6) AS gross_return, round(net + 1.3e-9, 6) AS net_return, round(t + 1.3e-9, 6) AS turnover, round(drawdown + 1.3e-9, 6) AS drawdown, round(u + 1.3e-9, 6) AS net_utility FROM lab")
def weight_path(spark, d):
    p, forward = _book(spark, d)
    return _six(V.weight_path(p, forward, p.select("date").distinct(), COSTS), "candidate_id", "date", **{c: c for c in ("gross_return", "net_return", "turnover", "drawdown", "net_utility")})


@query("portfolio_labels", f"WITH {PATHS}, a AS (SELECT candidate_id, date, u FROM lab UNION ALL SELECT 'cash', date, 0 FROM days), b AS (SELECT date, u AS b FROM lab WHERE candidate_id = 'equal_blend') SELECT candidate_id, date, round(u - b + 1.3e-9, 6) AS delta FROM a JOIN b USING (date)")
def portfolio_labels(spark, d):
    return _six(V.portfolio_labels(*_book(spark, d), COSTS), "candidate_id", "date", delta="delta_utility_vs_default")


@query("candidate_economics", f"""WITH {PATHS}, e AS (SELECT *, max(c) OVER (PARTITION BY candidate_id ORDER BY code) AS m FROM cum) SELECT candidate_id AS model_id, round(arg_max(c, date) + 1.3e-9, 6) AS cum_log, round(avg(net) / stddev_pop(net) * sqrt(252) + 1.3e-9, 6) AS sharpe, round(100 * max(1 - exp(c - greatest(m, 0))) + 1.3e-9, 6) AS max_drawdown_pct, round(avg(t) + 1.3e-9, 6) AS mean_turnover, count(*) AS n_days,
round(avg(net) / stddev_pop(net) * sqrt(252) - (SELECT avg(net) / stddev_pop(net) * sqrt(252) FROM cum WHERE candidate_id = 'equal_blend') + 1.3e-9, 6) AS delta_sharpe FROM e GROUP BY 1""")
def candidate_economics(spark, d):
    out = V.simulate_candidates(*_book(spark, d))
    return _six(V.viability(out, "equal_blend"), "model_id", "n_days", **{c: c for c in ("cum_log", "sharpe", "max_drawdown_pct", "mean_turnover", "delta_sharpe")})


@query("cost_sensitivity", f"WITH {PATHS}, x AS (SELECT candidate_id AS model_id, year(date) AS fold, b AS bps, g - t * b / 1e4 AS r FROM net, (VALUES (0.0::DOUBLE), (10.0::DOUBLE)) v(b)) SELECT model_id, fold, bps, round(sum(r) + 1.3e-9, 6) AS net, round(avg(r) / stddev_pop(r) * sqrt(252) + 1.3e-9, 6) AS sharpe FROM x GROUP BY 1, 2, 3")
def cost_sensitivity(spark, d):
    out = V.simulate_candidates(*_book(spark, d))
    folds = out.select("date").distinct().withColumn("fold", F.year("date").cast("long"))
    return _six(V.cost_sensitivity(out, folds, [0.0, 10.0]), "model_id", "fold", "bps", net="net", sharpe="sharpe")


def _labels(spark, d):
    """Labels of the candidates with the split of their dates."""
    positions, forward = _book(spark, d)
    return once(V.portfolio_labels(positions, forward, COSTS).join(positions.select("date", "split").distinct(), "date"))


LABELS = PATHS + ", labels AS (SELECT candidate_id, date, split, u FROM (SELECT candidate_id, date, u FROM lab UNION ALL SELECT 'cash', date, 0 FROM days) JOIN (SELECT DISTINCT date, split FROM predictions) USING (date))"


@query("gate_validation_weights", f"WITH {LABELS}, m AS (SELECT candidate_id, exp(avg(u)) AS e FROM labels WHERE split = 'train' GROUP BY 1), x AS (SELECT candidate_id, exp(e - (SELECT max(e) FROM m)) AS x FROM m) SELECT candidate_id, round(x / (SELECT sum(x) FROM x) + 1.3e-9, 6) AS weight FROM x")
def gate_validation_weights(spark, d):
    return _six(V.validation_weights(_labels(spark, d)), "candidate_id", weight="weight")


@query("gate_regime_lookup", f"WITH {LABELS}, r AS (SELECT DISTINCT date, CASE WHEN month(date) <= 6 THEN 'h1' ELSE 'h2' END AS regime FROM labels), m AS (SELECT regime, candidate_id, round(avg(u), 12) AS u FROM labels JOIN r USING (date) WHERE split = 'train' GROUP BY 1, 2), b AS (SELECT regime, arg_min(candidate_id, row(-u, candidate_id)) AS best FROM m GROUP BY 1) SELECT date, coalesce(best, 'equal_blend') AS selected_candidate_id FROM r LEFT JOIN b USING (regime)")
def gate_regime_lookup(spark, d):
    x = _labels(spark, d)
    regimes = x.select("date").distinct().withColumn("regime", F.when(F.month("date") <= 6, "h1").otherwise("h2"))
    return V.regime_lookup(x, regimes, "equal_blend")


@query("gate_recent_winner", f"WITH {LABELS}, w AS (SELECT candidate_id, date, round(avg(u) OVER (PARTITION BY candidate_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 10) AS c FROM labels) SELECT date, coalesce(arg_min(candidate_id, row(-c, candidate_id)) FILTER (c IS NOT NULL), 'equal_blend') AS selected_candidate_id FROM w GROUP BY 1")
def gate_recent_winner(spark, d):
    x = V.policy_state(_labels(spark, d)).withColumn("recent", F.round("cand_mean_utility_20", 10))
    return V.recent_winner(x, "recent", "equal_blend")


@query("gate_oracle_diagnostic", f"WITH {LABELS} SELECT date, arg_min(candidate_id, row(-round(u, 10), candidate_id)) AS selected_candidate_id, true AS uses_future FROM labels GROUP BY 1")
def gate_oracle_diagnostic(spark, d):
    return V.oracle_diagnostic(_labels(spark, d).withColumn("net_utility", F.round("net_utility", 10)))


@query("gate_equal_weight", f"WITH {TOP} SELECT date, 'equal_weight_blend' AS gate_id, count(DISTINCT candidate_id) AS n FROM positions GROUP BY 1")
def gate_equal_weight(spark, d):
    e = V.equal_weight_decisions(_positions(spark, d))
    return e.select("date", "gate_id", F.size(F.map_keys(X.parse_weights("model_weights_json"))).cast("long").alias("n"))


@query("ridge_router")
def ridge_router(spark, d):
    """A ridge per candidate on its recent utility, then routing with inertia."""
    x = V.policy_state(V.policy_state(_labels(spark, d), days=20), days=5).filter("candidate_id NOT IN ('equal_blend', 'cash')")
    f = ["cand_mean_utility_20", "cand_mean_utility_5"]
    return V.route(V.predict_deltas(x, V.train_ridge_selector(x, f), f).dropna(subset=["predicted_delta_utility"]), V.Router(0.01, 0.0, 1e-4))


@query("softmax_allocation", f"""WITH RECURSIVE {LABELS}, v AS (SELECT candidate_id, date, CASE WHEN candidate_id = 'equal_blend' THEN 0 ELSE u - max(u) FILTER (candidate_id = 'equal_blend') OVER (PARTITION BY date) END AS v FROM labels), x AS (SELECT *, exp(v - max(v) OVER (PARTITION BY date)) AS e FROM v),
s AS (SELECT candidate_id, date, e / sum(e) OVER (PARTITION BY date) AS s, row_number() OVER (PARTITION BY candidate_id ORDER BY date) AS i FROM x), m AS (SELECT candidate_id, date, i, s AS a FROM s WHERE i = 1 UNION ALL SELECT s.candidate_id, s.date, s.i, 0.8::DOUBLE * m.a + 0.2::DOUBLE * s.s FROM m JOIN s ON s.candidate_id = m.candidate_id AND s.i = m.i + 1)
SELECT date, candidate_id, round(a / sum(a) OVER (PARTITION BY date) + 1.3e-9, 6) AS allocation FROM m""")
def softmax_allocation(spark, d):
    x = _labels(spark, d).select("date", "candidate_id", F.col("delta_utility_vs_default").alias("predicted_delta_utility"))
    return _six(V.softmax_allocation(x), "date", "candidate_id", allocation="allocation")


@query("regime_classes", f"""WITH {RET}, x AS (SELECT instrument, date, sum(ln(1 + greatest(r, -0.9))) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} AS trend, ln(greatest(sqrt(252.0 / 20 * sum(r * r) OVER {_frame('19 PRECEDING', 'CURRENT ROW')}), 1e-12)) AS rv FROM rets WHERE r IS NOT NULL),
q AS (SELECT *, quantile_cont(rv, 1.0 / 3) OVER {W} AS a, quantile_cont(rv, 2.0 / 3) OVER {W} AS z FROM x) SELECT instrument, date, CASE WHEN trend > 0.01 THEN 'hi' WHEN trend < -0.01 THEN 'lo' ELSE 'flat' END AS trend, CASE WHEN rv <= a THEN 'lo' WHEN rv <= z THEN 'med' ELSE 'hi' END AS vol,
CASE WHEN rv > z THEN 'high_vol' WHEN trend < -0.01 THEN 'bear' WHEN trend > 0.01 THEN 'bull' ELSE 'sideways' END AS regime FROM q""".replace("1.0 / 3", "1.0::DOUBLE / 3").replace("2.0 / 3", "2.0::DOUBLE / 3"))
def regime_classes(spark, d):
    """Trend by summed log returns, volatility by expanding terciles, and the class of both, for every series."""
    w = R.series(KEYS, ORDER)
    r = _returns(spark, d).filter("r IS NOT NULL").withColumn("r9", F.greatest("r", F.lit(-0.9)))
    x = r.select("instrument", "date", H.trend_regime("r9", w).alias("trend"), H.annual_log_volatility("r", w).alias("rv"))
    x = H.volatility_regimes(x, "rv", KEYS, ORDER)
    return x.select("instrument", "date", "trend", "vol", H.regime_class("trend", "vol").alias("regime"))


@query("change_states")
def change_states(spark, d):
    from ..operators.sequential import bocpd, scan

    r = scan(_returns(spark, d).withColumnRenamed("r", "x"), KEYS, ORDER, ["change_probability", "transition_probability"], lambda p: bocpd(p["x"].to_numpy(float)))
    return r.select("instrument", "date", H.change_state("change_probability", "transition_probability").alias("state"))


@query("metric_parity", "SELECT o_orderstatus, 0.0::DOUBLE AS delta_total, true AS within FROM orders GROUP BY 1")
def metric_parity(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return V.parity(o, o, ["o_orderstatus"], {"total": 1e-6})


# strategies -----------------------------------------------------------------------------------------------------------


@query("threshold_intents", f"WITH {PREDICTIONS} SELECT 'x:' || date || ':' || instrument AS intent_id, date, instrument, CASE WHEN prediction > 0.2 THEN 'long' WHEN prediction < -0.2 THEN 'short' ELSE 'flat' END AS direction, prediction AS score, prediction IS NOT NULL AS eligible FROM predictions WHERE model_id = 'reversal'")
def threshold_intents(spark, d):
    return G.threshold_intents(predictions(spark, d).filter("model_id = 'reversal'"), "x", "bars", 0.2).select("intent_id", "date", "instrument", "direction", "score", "eligible")


@query("production_intents", f"WITH {PREDICTIONS}, t AS (SELECT *, row_number() OVER (PARTITION BY date, fold_id, split ORDER BY prediction DESC, instrument) AS n FROM predictions WHERE model_id = 'momentum' AND prediction IS NOT NULL) SELECT date, instrument, 'long' AS direction, abs(prediction) AS score, fold_id, split FROM t WHERE n <= 3 AND prediction <> 0")
def production_intents(spark, d):
    return G.production_intents(predictions(spark, d).filter("model_id = 'momentum'"), "p", "bars", 3).select("date", "instrument", "direction", "score", "fold_id", "split")


@query("signals", f"""WITH {BARS}, z AS (SELECT instrument, date, close, CASE WHEN count(*) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} >= 20 THEN avg(close) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} END AS m, CASE WHEN count(*) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} >= 20 THEN stddev_pop(close) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} END AS s,
CASE WHEN count(*) OVER {_frame('4 PRECEDING', 'CURRENT ROW')} >= 5 THEN avg(close) OVER {_frame('4 PRECEDING', 'CURRENT ROW')} END AS f FROM bars), g AS (SELECT instrument, date, coalesce(CASE WHEN s > 0 THEN -least(greatest((close - m) / (s * 2), -1), 1) END, 0) AS boll, coalesce(-tanh((close - m) / nullif(s, 0) / 2), 0) AS mr, CASE WHEN f > m THEN 1.0 ELSE -1.0 END AS xo FROM z)
SELECT instrument, date, round(boll + 1.3e-9, 6) AS bollinger, round(mr + 1.3e-9, 6) AS mean_reversion, round(xo + 1.3e-9, 6) AS crossover, round(least(greatest((boll + mr + 2 * xo) / 4, -1), 1) + 1.3e-9, 6) AS weighted, round(sign(sign(boll) + sign(mr) + sign(xo)) + 1.3e-9, 6) AS majority FROM g""")
def signals(spark, d):
    w = R.series(KEYS, ORDER)
    b = bars(spark, d).select("instrument", "date", "close", R.rolling_mean("close", w, 5).alias("fast"))
    b = b.withColumns({k: v for k, v in G.zscore_columns("close", KEYS, ORDER).items()})
    b = b.withColumns({"bollinger": G.bollinger_signal("close", "mid", "std"), "mean_reversion": G.mean_reversion_signal("z"), "crossover": G.crossover_signal("fast", "mid")})
    s = ["bollinger", "mean_reversion", "crossover"]
    return _six(b, "instrument", "date", **{c: c for c in s}, weighted=G.ensemble(s, [1.0, 1.0, 2.0]), majority=G.ensemble(s, method="majority"))


@query("adaptive_ensemble", f"""WITH {RET}, b AS (SELECT * FROM bars JOIN rets USING (instrument, date)), z AS (SELECT instrument, date, r, close, CASE WHEN count(*) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} >= 20 THEN avg(close) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} END AS m, CASE WHEN count(*) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} >= 20 THEN stddev_pop(close) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} END AS s FROM b),
g AS (SELECT instrument, date, r, coalesce(-tanh((close - m) / nullif(s, 0) / 2), 0) AS a, CASE WHEN (close - m) / nullif(s * 2, 0) > 0.8 THEN 1.0 WHEN (close - m) / nullif(s * 2, 0) < -0.8 THEN -1.0 ELSE 0.0 END AS b FROM z),
h AS (SELECT *, CASE WHEN sign(lag(a) OVER {W}) = sign(r) THEN 1.0 WHEN sign(lag(a) OVER {W}) <> sign(r) THEN 0.0 END AS ha, CASE WHEN sign(lag(b) OVER {W}) = sign(r) THEN 1.0 WHEN sign(lag(b) OVER {W}) <> sign(r) THEN 0.0 END AS hb FROM g),
w AS (SELECT *, coalesce(avg(ha) OVER {_frame('50 PRECEDING', '1 PRECEDING')}, 0.5) AS wa, coalesce(avg(hb) OVER {_frame('50 PRECEDING', '1 PRECEDING')}, 0.5) AS wb FROM h)
SELECT instrument, date, round(CASE WHEN wa + wb > 0 THEN least(greatest((wa * a + wb * b) / (wa + wb), -1), 1) ELSE 0 END + 1.3e-9, 6) AS signal FROM w""")
def adaptive_ensemble(spark, d):
    w = R.series(KEYS, ORDER)
    b = bars(spark, d).select("instrument", "date", "close", R.log_return("close", w).alias("ret"))
    b = b.withColumns(G.zscore_columns("close", KEYS, ORDER)).withColumns({"a": G.mean_reversion_signal("z"), "b": G.bollinger_signal("close", "mid", "std", mode="breakout")})
    return _six(G.adaptive_ensemble(b, ["a", "b"], "ret", KEYS, ORDER), "instrument", "date", signal="signal")


@query("rsi_macd_strategies", f"""WITH RECURSIVE {BARS}, n AS (SELECT instrument, date, close, close - lag(close) OVER {W} AS d, row_number() OVER {W} AS i FROM bars),
e AS (SELECT instrument, date, i, close AS f, close AS s, 0.0::DOUBLE AS g, NULL::DOUBLE AS up, NULL::DOUBLE AS down FROM n WHERE i = 1
  UNION ALL SELECT n.instrument, n.date, n.i, e.f + 2.0::DOUBLE / 13 * (n.close - e.f), e.s + 2.0::DOUBLE / 27 * (n.close - e.s), 0.2::DOUBLE * ((e.f + 2.0::DOUBLE / 13 * (n.close - e.f)) - (e.s + 2.0::DOUBLE / 27 * (n.close - e.s))) + 0.8::DOUBLE * e.g,
    CASE WHEN e.up IS NULL THEN greatest(n.d, 0) ELSE e.up + (greatest(n.d, 0) - e.up) / 14 END, CASE WHEN e.down IS NULL THEN greatest(-n.d, 0) ELSE e.down + (greatest(-n.d, 0) - e.down) / 14 END FROM e JOIN n ON n.instrument = e.instrument AND n.i = e.i + 1),
x AS (SELECT *, 100 - 100 / (1 + up / (down + 1e-12)) AS rsi FROM e)
SELECT instrument, date, round(CASE WHEN rsi IS NULL THEN 0 WHEN rsi <= 30 THEN 1 WHEN rsi >= 70 THEN -1 ELSE (50 - rsi) / 20 END + 1.3e-9, 6) AS rsi_signal, round(sign(round(f - s - g, 9)) + 1.3e-9, 6) AS macd_signal FROM x""")
def rsi_macd_strategies(spark, d):
    from ..operators import sequential as Q

    names = ["rsi", "macd", "macd_signal", "macd_hist"]
    b = Q.scan(bars(spark, d).select("instrument", "date", "close"), KEYS, ORDER, names, lambda p: {"rsi": Q.wilder_rsi(p["close"].to_numpy(float)), **{k: Q.macd(p["close"].to_numpy(float))[k] for k in names[1:]}})
    return _six(b, "instrument", "date", rsi_signal=G.rsi_signal("rsi", linear=True), macd_signal=G.macd_signal("macd_hist", "macd", "macd_signal", False))


@query("blend_and_backtest", f"""WITH {TOP}, b AS (SELECT date, instrument, sum(target_weight * CASE WHEN candidate_id = 'momentum' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS w FROM own WHERE candidate_id IN ('momentum', 'volume') GROUP BY 1, 2), c AS (SELECT date, instrument, CASE WHEN sum(abs(w)) OVER (PARTITION BY date) > 1 THEN w / sum(abs(w)) OVER (PARTITION BY date) ELSE w END AS w FROM b),
j AS (SELECT p.date, p.instrument, p.close / lag(p.close) OVER x - 1 AS r, lag(coalesce(c.w, 0)) OVER x AS lw, abs(coalesce(c.w, 0) - lag(coalesce(c.w, 0)) OVER x) AS t FROM (SELECT CAST(instrument AS VARCHAR) AS instrument, date, close FROM bars) p LEFT JOIN c USING (date, instrument) WINDOW x AS (PARTITION BY p.instrument ORDER BY p.date))
SELECT date, round(sum(coalesce(lw * r, 0)) + 1.3e-9, 6) AS gross, round(sum(coalesce(t, 0)) + 1.3e-9, 6) AS turnover, round(sum(coalesce(lw * r, 0)) - sum(coalesce(t, 0)) * 5e-4 + 1.3e-9, 6) AS ret FROM j GROUP BY 1""")
def blend_and_backtest(spark, d):
    p = _positions(spark, d).select(F.col("candidate_id").alias("strategy_id"), "date", "instrument", F.col("target_weight").alias("signal"))
    prices = bars(spark, d).select(F.col("instrument").cast("string").alias("instrument"), "date", "close")
    return _six(G.backtest(G.blend(p, {"momentum": 0.6, "volume": 0.4}), prices, cost_bps=5.0), "date", gross="gross", turnover="turnover", ret="ret")


@query("momentum_variants", f"""WITH {RET}, f AS (SELECT instrument, date, sum(r) OVER {_frame('64 PRECEDING', '5 PRECEDING')} AS s, count(r) OVER {_frame('64 PRECEDING', '5 PRECEDING')} AS n FROM rets),
m AS (SELECT *, CASE WHEN n >= 60 THEN round(s, 12) END AS m FROM f), k AS (SELECT *, CASE WHEN m IS NOT NULL AND count(m) OVER (PARTITION BY date) >= 2 THEN (rank() OVER (PARTITION BY date ORDER BY m NULLS LAST) + (count(*) OVER (PARTITION BY date, m) - 1) / 2) / count(m) OVER (PARTITION BY date) END AS k FROM m),
x AS (SELECT instrument, date, sign(round(s, 12)) AS own, coalesce(2 * k - 1, 0) AS rank FROM k) SELECT instrument, date, round(coalesce(own, 0) + 1.3e-9, 6) AS tsmom, round(rank + 1.3e-9, 6) AS xsec, round(CASE WHEN sign(rank) = own THEN rank ELSE 0 END + 1.3e-9, 6) AS dual FROM x""")
def momentum_variants(spark, d):
    b = bars(spark, d).select("instrument", "date", "close")
    for v in ("tsmom", "xsec", "dual"):
        b = G.momentum(b, v, "close", KEYS, ORDER, 60, 5, v)
    return _six(b, "instrument", "date", tsmom="tsmom", xsec="xsec", dual="dual")


# ledger -------------------------------------------------------------------------------------------------------------

FILLS = "fills AS (SELECT l_suppkey AS account, l_partkey % 20 AS symbol, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS qty, round(l_extendedprice / l_quantity + 1.3e-9, 2) AS price FROM lineitem)"


def _fills(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").alias("account"), (F.col("l_partkey") % 20).alias("symbol"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"), F.round(F.col("l_extendedprice") / F.col("l_quantity") + F.lit(TIE), 2).alias("price"))


@query("ledger_positions", f"WITH {FILLS}, s AS (SELECT *, CASE WHEN side = 'BUY' THEN qty ELSE -qty END AS q FROM fills) SELECT account, symbol, sum(q) AS held, round(1000000 - sum(q * price) + 1.3e-9, 2) AS cash_flow FROM s GROUP BY 1, 2")
def ledger_positions(spark, d):
    f = L.identity_fills(_fills(spark, d))
    held = L.signed(f).groupBy("account", "symbol").agg(F.sum("signed_qty").alias("held"))
    c = L.cash(f.withColumn("account", F.struct("account", "symbol")), "account", 1_000_000.0)
    return held.join(c.select("account.account", "account.symbol", F.round(F.col("cash") + F.lit(TIE), 2).alias("cash_flow")), ["account", "symbol"])


@query("ledger_equity", """WITH RECURSIVE f AS (SELECT l_suppkey AS account, l_partkey % 20 AS symbol, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, round(l_extendedprice / l_quantity + 1.3e-9, 2) AS price, row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS o FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY o) AS i FROM f),
p AS (SELECT account, symbol, i, q AS held, CASE WHEN q > 0 THEN price ELSE 0.0 END AS avg FROM n WHERE i = 1 UNION ALL SELECT n.account, n.symbol, n.i, p.held + n.q, CASE WHEN abs(p.held + n.q) < 1e-12 THEN 0.0 WHEN n.q > 0 THEN (p.avg * p.held + n.q * n.price) / (p.held + n.q) ELSE p.avg END FROM p JOIN n ON n.account = p.account AND n.symbol = p.symbol AND n.i = p.i + 1),
l AS (SELECT account, symbol, arg_max(held, i) AS held, arg_max(avg, i) AS avg FROM p GROUP BY 1, 2), m AS (SELECT symbol, arg_max(price, o) AS market FROM f WHERE symbol < 10 GROUP BY 1), c AS (SELECT account, -sum(q * price) AS cash FROM f GROUP BY 1)
SELECT c.account, round(any_value(cash) + sum(held * coalesce(market, avg)), 2) AS equity FROM c JOIN l USING (account) LEFT JOIN m USING (symbol) GROUP BY 1""")
def ledger_equity(spark, d):
    f = _fills(spark, d).withColumns({"k1": F.col("seq.l_orderkey"), "k2": F.col("seq.l_linenumber"), "k3": F.col("seq.l_partkey"), "k4": F.col("seq.l_quantity"), "k5": F.col("seq.l_extendedprice")}).drop("seq")
    order = ["k1", "k2", "k3", "k4", "k5"]
    p = L.last_positions(L.positions(f, "account", "symbol", order), "account", "symbol", order)
    market = f.filter("symbol < 10").groupBy("symbol").agg(F.max_by("price", F.struct(*order)).alias("market"))
    return L.mark_to_market(p, market, L.cash(f, "account"), "account", "symbol").select("account", F.round("equity", 2).alias("equity"))


@query("fees_and_reconciliation", f"WITH {FILLS}, a AS (SELECT account, symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS held FROM fills GROUP BY 1, 2), b AS (SELECT account, symbol, held + CASE WHEN symbol = 3 THEN 1 ELSE 0 END AS held FROM a WHERE symbol <> 5), f AS (SELECT account, sum(qty * price) / 1e4 AS fee FROM fills GROUP BY 1) SELECT account, symbol, coalesce(a.held, 0) - coalesce(b.held, 0) AS difference, round(fee + 1.3e-9, 4) AS fee FROM a FULL JOIN b USING (account, symbol) JOIN f USING (account) WHERE abs(coalesce(a.held, 0) - coalesce(b.held, 0)) > 1e-6")
def fees_and_reconciliation(spark, d):
    f = _fills(spark, d)
    a = L.signed(f).groupBy("account", "symbol").agg(F.sum("signed_qty").alias("held"))
    b = a.filter("symbol <> 5").withColumn("held", F.col("held") + F.when(F.col("symbol") == 3, 1).otherwise(0))
    return L.reconcile(a, b, ["account", "symbol"]).join(L.flat_fees(f, 1.0, ["account"]), "account").select("account", "symbol", "difference", F.round(F.col("fee") + F.lit(TIE), 4).alias("fee"))


@query("cost_stress", f"WITH {PREDICTIONS}, p AS (SELECT * FROM predictions WHERE model_id = 'momentum') SELECT instrument, date, round(forward_return - abs(sign(prediction) - coalesce(lag(sign(prediction)) OVER (PARTITION BY instrument ORDER BY date), 0)) * 10 / 1e4 + 1.3e-9, 6) AS stressed FROM p")
def cost_stress(spark, d):
    p = predictions(spark, d).filter("model_id = 'momentum'").withColumn("pos", F.signum("prediction"))
    return _six(L.stress_costs(p, "forward_return", "pos", KEYS, ORDER, 10.0), "instrument", "date", stressed="stressed")


@query("fill_window", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-02' OR ts > TIMESTAMP '2024-01-20'")
def fill_window(spark, d):
    return L.outside_window(table(spark, d, "events"), "ts", "2024-01-02 00:00:00", "2024-01-20 00:00:00").select("event_id")


# plans, models, sources, sinks ------------------------------------------------------------------------------------------


@query("feature_plan", f"""WITH RECURSIVE {BARS}, n AS (SELECT *, row_number() OVER {W} AS i FROM bars), e AS (SELECT instrument, i, date, close AS v FROM n WHERE i = 1 UNION ALL SELECT n.instrument, n.i, n.date, (2.0::DOUBLE / 11) * n.close + (1 - 2.0::DOUBLE / 11) * e.v FROM e JOIN n ON n.instrument = e.instrument AND n.i = e.i + 1),
x AS (SELECT instrument, date, close / lag(close) OVER {W} - 1 AS returns, CASE WHEN count(close) OVER {_frame('4 PRECEDING', 'CURRENT ROW')} >= 5 THEN avg(close) OVER {_frame('4 PRECEDING', 'CURRENT ROW')} END AS sma_5, close, high, low FROM bars)
SELECT instrument, date, round(returns + 1.3e-9, 5) AS returns, round(sma_5 + 1.3e-9, 5) AS sma_5, round(v + 1.3e-9, 5) AS ema_10, round((high - low) / close * 100 + 1.3e-9, 5) AS range_pct, round(CASE WHEN count(returns) OVER {_frame('9 PRECEDING', 'CURRENT ROW')} >= 10 THEN stddev_pop(returns) OVER {_frame('9 PRECEDING', 'CURRENT ROW')} END + 1.3e-9, 5) AS returns_std10 FROM x JOIN e USING (instrument, date)""")
def feature_plan(spark, d):
    """Steps given by name, out of order; the compiler finds the levels."""
    plan = graph.Plan(KEYS, ORDER).then("stats.rolling_std", column="returns", window=10).then("returns").then("sma", window=5).then("technical.EMA", span=10)
    plan = plan.then("expr", tree=["mul", ["div", ["sub", ["col", "high"], ["col", "low"]], ["col", "close"]], 100.0], out="range_pct", needs=["high", "low", "close"])
    out = graph.compile_plan(bars(spark, d), plan)
    return out.select("instrument", "date", *[F.round(F.col(c) + F.lit(TIE), 5).alias(c) for c in ("returns", "sma_5", "ema_10", "range_pct", "returns_std10")])


@query("model_matrix")
def model_matrix(spark, d):
    wide = A.wide_predictions(predictions(spark, d).withColumn("y", F.greatest(F.least("forward_return", F.lit(1.0)), F.lit(-1.0))), ["date", "instrument", "y"], models=["momentum", "reversal", "volume"])
    panel = X.date_codes(wide)
    return M.train_matrix(panel, ["momentum", "reversal", "volume"], "y", ["ridge", "elastic_net", "pls", "bayesian_ridge"], T.walk_forward_dates(panel, "date", 2, 1)).select("model_id", "fold_id", "instrument", "date", F.round("prediction", 6).alias("prediction"), "prediction_rank")


@query("tree_gate")
def tree_gate(spark, d):
    labels = _labels(spark, d)
    x = V.policy_state(V.policy_state(labels, days=20), days=5)
    best = V.oracle_diagnostic(labels).select("date", F.col("selected_candidate_id").alias("best"))
    wide = x.groupBy("date", "split").pivot("candidate_id", ["momentum", "reversal", "volume"]).agg(F.first("cand_mean_utility_20")).join(best, "date").na.fill(0.0)
    return M.gate(wide, ["momentum", "reversal", "volume"], "best", "tree").select("date", "selected_candidate_id")


@query("generated_ohlcv")
def generated_ohlcv(spark, d):
    return readers.generate_ohlcv(spark)


@query("synthetic_panel")
def synthetic_panel(spark, d):
    return readers.synthetic_panel(spark, n_tickers=10, n_days=60)


@query("composite_source", "SELECT o_custkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def composite_source(spark, d):
    a = lambda: table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    b = lambda: table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), "c_name")
    return readers.composite([a, lambda: spark.read.parquet(f"{d}/no_such_table.parquet"), b])


@query("failover_source", "SELECT r_regionkey, r_name FROM region")
def failover_source(spark, d):
    return readers.failover([lambda: spark.read.parquet(f"{d}/no_such_table.parquet"), lambda: table(spark, d, "region")])


@query("unite_fetched", "SELECT n_nationkey AS k, 'nation' AS ticker FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region")
def unite_fetched(spark, d):
    return readers.unite_fetched({"nation": table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "broken": ValueError("no"), "region": table(spark, d, "region").select(F.col("r_regionkey").alias("k"))})


@query("hashed_embedding", """WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\f\\r]+')) AS w FROM benchmark), c AS (SELECT item_id, ('0x' || substring(md5(w), 1, 8))::BIGINT % 128 AS place, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT item_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) + 1.3e-9, 6) AS value FROM c""")
def hashed_embedding(spark, d):
    from ..functions.text_models import hashed_embedding as embed

    e = embed(table(spark, d, "benchmark"), "text", 128)
    return _six(e.select("item_id", F.posexplode("embedding").alias("place", "v")).filter("v > 0").withColumn("place", F.col("place").cast("long")), "item_id", "place", value="v")


@query("topics")
def topics(spark, d):
    from ..functions.text_models import topics as find

    return find(table(spark, d, "benchmark"), "text", 3).select("item_id", "topic")


@query("pooled_rank_correlation", f"""WITH {PREDICTIONS}, k AS (SELECT model_id, split, rank() OVER (PARTITION BY model_id, split ORDER BY prediction) + (count(*) OVER (PARTITION BY model_id, split, prediction) - 1) / 2 AS a, rank() OVER (PARTITION BY model_id, split ORDER BY forward_return) + (count(*) OVER (PARTITION BY model_id, split, forward_return) - 1) / 2 AS b FROM predictions WHERE prediction IS NOT NULL) SELECT model_id, split, count(*) AS n, round(corr(a, b) + 1.3e-9, 6) AS rank_corr FROM k GROUP BY 1, 2""")
def pooled_rank_correlation(spark, d):
    return _six(A.pooled_rank_correlation(predictions(spark, d), "prediction", "forward_return", ["model_id", "split"]), "model_id", "split", "n", rank_corr="rank_corr")


@query("per_date_diversity", f"""WITH {PREDICTIONS}, r AS (SELECT *, rank() OVER (PARTITION BY date, model_id ORDER BY prediction) + (count(*) OVER (PARTITION BY date, model_id, prediction) - 1) / 2 AS r, row_number() OVER (PARTITION BY date, model_id ORDER BY prediction DESC, instrument) <= 5 AS t FROM predictions),
p AS (SELECT a.date, a.model_id AS m1, b.model_id AS m2, count(*) AS n, var_pop(a.prediction) AS va, var_pop(b.prediction) AS vb, covar_pop(a.prediction, b.prediction) AS c, var_pop(a.r) AS ra, var_pop(b.r) AS rb, covar_pop(a.r, b.r) AS rc, count(*) FILTER (a.t AND b.t) AS o, count(*) FILTER (a.t OR b.t) AS u FROM r a JOIN r b ON a.date = b.date AND a.instrument = b.instrument AND a.model_id < b.model_id GROUP BY 1, 2, 3)
SELECT date, round(avg(CASE WHEN n >= 3 AND va > 0 AND vb > 0 THEN c / sqrt(va * vb) ELSE 0 END) + 1.3e-9, 6) AS mean_corr, round(avg(CASE WHEN n >= 3 AND ra > 0 AND rb > 0 THEN rc / sqrt(ra * rb) ELSE 0 END) + 1.3e-9, 6) AS mean_rank_corr, round(avg(o / u) + 1.3e-9, 6) AS mean_overlap FROM p GROUP BY 1""")
def per_date_diversity(spark, d):
    return _six(A.per_date_diversity(predictions(spark, d), 5), "date", mean_corr="mean_corr", mean_rank_corr="mean_rank_corr", mean_overlap="mean_overlap")


@query("anonymizers", "SELECT c_custkey, regexp_replace(c_name, '(?s).', '#', 'g') AS c_name, sha256('s' || c_mktsegment) AS c_mktsegment FROM customer")
def anonymizers(spark, d):
    from ..plans.registry import anonymize

    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return anonymize(anonymize(c, ["c_name"], "masking", mark="#"), ["c_mktsegment"], "salted", salt="s")
