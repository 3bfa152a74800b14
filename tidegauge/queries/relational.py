"""Queries of projections, filters, joins, set operations and aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import columns as C
from ..operators import filters as Q
from ..operators import joins as J
from ..operators import rolling as R
from ..sources.adapters import bars, bitemporal, predictions, table, ticks
from .base import BARS, PREDICTIONS, query

TIE = 1.3e-9
BITEMPORAL = """shipped AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS shipped, sum(l_quantity) AS volume FROM lineitem GROUP BY 1),
facts AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS valid_time, greatest(CAST(o_orderdate AS DATE), shipped) AS knowledge_time, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS close, volume, o_orderkey FROM orders JOIN shipped ON o_orderkey = l_orderkey),
bitemporal AS (SELECT * EXCLUDE (o_orderkey, nth) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, valid_time, knowledge_time ORDER BY o_orderkey) AS nth FROM facts) WHERE nth = 1)"""


def _six(df, *keep, **cols):
    return df.select(*keep, *[F.round(F.col(c) + F.lit(TIE) if isinstance(c, str) else c + F.lit(TIE), 6).alias(n) for n, c in cols.items()])


# projections --------------------------------------------------------------------------------------------------------


@query("rename_and_cast", "SELECT o_orderkey AS order_id, CAST(o_totalprice AS BIGINT) AS price_int, CAST(o_custkey AS SMALLINT) AS cust_int16, CAST(o_totalprice AS FLOAT)::DOUBLE AS price_f32, CAST(o_custkey AS INTEGER) AS cust_u16 FROM orders WHERE o_totalprice::BIGINT <> 0".replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)").replace("o_totalprice::BIGINT <> 0", "true"))
def rename_and_cast(spark, d):
    """Customers beyond int16 or uint16, for which the SQL's strict SMALLINT has no result, keep their number in the
    next type that holds all of them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    o = C.cast_columns(C.rename_columns(o, {"o_orderkey": "order_id"}).withColumn("price_int", F.col("o_totalprice")), {"price_int": "bigint"})
    o = C.cast_numeric(o.withColumn("cust_int16", F.col("o_custkey")).withColumn("cust_u16", F.col("o_custkey")).withColumn("price_f32", F.col("o_totalprice")), ["cust_int16"], "int16", widen=True)
    o = C.cast_numeric(C.cast_numeric(o, ["cust_u16"], "uint16", widen=True), ["price_f32"], "float32")
    return o.select("order_id", "price_int", "cust_int16", F.col("price_f32").cast("double").alias("price_f32"), "cust_u16")


@query("promote_categorical", "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_code FROM orders")
def promote_categorical(spark, d):
    return C.promote_categorical(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("normalize_keys", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_custkey AS VARCHAR) AS instrument, CASE WHEN o_orderpriority IN ('1-URGENT') THEN '1h' ELSE '1d' END AS interval, o_orderkey FROM orders")
def normalize_keys(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("instrument"), F.when(F.col("o_orderpriority") == "1-URGENT", "1h").when(F.col("o_orderpriority") == "2-HIGH", " Daily ").alias("interval"), "o_orderkey")
    return C.normalize_keys(o).select("date", "instrument", "interval", "o_orderkey")


@query("market_column_names", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders")
def market_column_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"), F.col("o_totalprice").alias("Close"))
    return C.ensure_datetime(C.normalize_market_columns(o), "timestamp").select("o_orderkey", F.to_date("timestamp").alias("day"), "price")


@query("column_transforms", """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / sd + 1.3e-9, 6) AS norm, round(log10(greatest(o_totalprice, 1e-12)) + 1.3e-9, 6) AS log10, round((o_totalprice - a) / (z - a) + 1.3e-9, 6) AS scaled, round(o_totalprice / greatest(o_custkey - 700, 1e-12) / 1e12 + 1.3e-9, 6) AS ratio, o_totalprice::FLOAT::DOUBLE AS narrow FROM orders, s""")
def column_transforms(spark, d):
    o = table(spark, d, "orders").withColumn("divisor", (F.col("o_custkey") - 700).cast("double"))
    o = C.minmax_scale(C.log_transform(C.normalize(o, "o_totalprice"), "o_totalprice"), "o_totalprice").withColumn("ratio", C.safe_div("o_totalprice", "divisor") / 1e12)
    o = C.narrow_float32(o.withColumn("narrow", F.col("o_totalprice")), ["narrow"]).withColumn("narrow", F.col("narrow").cast("double"))
    return _six(o, "o_orderkey", "narrow", norm="o_totalprice_norm", log10="o_totalprice_log", scaled="o_totalprice_scaled", ratio="ratio")


# filters ------------------------------------------------------------------------------------------------------------


@query("regulatory_filter", f"WITH {BARS} SELECT instrument, date, volume FROM bars WHERE instrument NOT IN (1, 2, 3) AND volume >= 40")
def regulatory_filter(spark, d):
    return Q.regulatory_filter(bars(spark, d), [1, 2, 3], 40, "instrument").select("instrument", "date", "volume")


@query("price_volume_hygiene", f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY date) - 1 AS ret, lead(close) OVER (PARTITION BY instrument ORDER BY date) / close - 1 AS fwd FROM bars)
SELECT instrument, date, round(CASE WHEN close > 1e-6 AND close / open BETWEEN 0.01 AND 100 AND abs(fwd) <= 1 AND abs(ret) <= 1 THEN fwd END + 1.3e-9, 6) AS label FROM r WHERE open > 0 AND volume > 0 AND close > 0 AND instrument NOT IN (7)""")
def price_volume_hygiene(spark, d):
    w = R.series(["instrument"], ["date"])
    b = bars(spark, d).select("*", R.pct_change("close", w).alias("ret"), R.forward_return("close", w, 1).alias("fwd"))
    b = Q.exclude_instruments(b, [7]).filter(Q.valid_price_volume("open", "volume", "close"))
    return _six(b, "instrument", "date", label=Q.hygiene_label("fwd", "close", "open", "ret"))


@query("frame_validation", "SELECT count(*) AS n_rows, 0 AS n_problems, 0 AS n_schema_problems FROM orders")
def frame_validation(spark, d):
    """Gates raise on the driver; a clean frame passes through them."""
    o = table(spark, d, "orders")
    contract = Q.FrameContract(required={"o_orderkey": "bigint", "o_totalprice": "double"}, unknown_ok=True)
    problems = Q.validate_frame(o.withColumnRenamed("o_totalprice", "close"))
    Q.forbid_columns(Q.unique_grain(contract.check(o), ["o_orderkey"]), ["ssn"])
    return o.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(problems)).alias("n_problems"), F.lit(len(contract.problems(o))).alias("n_schema_problems"))


@query("ks_drift", """WITH v AS (SELECT l_quantity AS x, l_returnflag = 'A' AS a FROM lineitem WHERE l_returnflag IN ('A', 'N')), c AS (SELECT x, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM v GROUP BY x),
g AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS gap FROM c) SELECT 'l_quantity' AS "column", round(max(gap) + 1.3e-9, 6) AS statistic FROM g""")
def ks_drift(spark, d):
    x = table(spark, d, "lineitem")
    return _six(Q.ks_drift(x.filter("l_returnflag = 'A'"), x.filter("l_returnflag = 'N'"), ["l_quantity"]), "column", statistic="statistic")


@query("grain_report", "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def grain_report(spark, d):
    return Q.grain_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_sample", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) ORDER BY 1, 2, 3, 4 LIMIT 500""")
def duplicate_sample(spark, d):
    return Q.duplicate_sample(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query("leakage_report", """WITH t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01'), e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '1996-02-01')
SELECT (SELECT count(*) FROM t SEMI JOIN e USING (o_custkey)) AS shared_keys, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate < DATE '1996-01-01') AS train_end, (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate >= DATE '1996-02-01') AS test_start, true AS ordered, true AS gap_kept,
(SELECT count(*) = 0 FROM t SEMI JOIN e USING (o_custkey)) AS clean""")
def leakage_report(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return Q.leakage_report(o.filter("day < DATE '1996-01-01'"), o.filter("day >= DATE '1996-02-01'"), "day", ["o_custkey"], 5, 3)


# joins --------------------------------------------------------------------------------------------------------------


@query("join_sources", """SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def join_sources(spark, d):
    t = lambda n: table(spark, d, n)
    sources = {
        "customer": t("customer").withColumnRenamed("c_custkey", "o_custkey"), "nation": t("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "region": t("region").withColumnRenamed("r_regionkey", "n_regionkey"),
        "solvent": t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "returned": t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")),
    }
    steps = [{"source": s, "on": [k], "how": h} for s, k, h in (("customer", "o_custkey", "inner"), ("nation", "c_nationkey", "left"), ("region", "n_regionkey", "left"), ("solvent", "o_custkey", "semi"), ("returned", "o_orderkey", "anti"))]
    return J.join_sources(t("orders"), sources, steps).select("o_orderkey", "c_name", "n_name", "r_name")


@query("left_join_first", """SELECT o_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN (SELECT * FROM (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) AS n FROM lineitem) WHERE n = 1) ON o_orderkey = l_orderkey""")
def left_join_first(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.left_join_first(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], ["l_partkey", "l_quantity"])


@query("merge_sources", """WITH c AS (SELECT o_custkey AS key, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1), u AS (SELECT c_custkey AS key, 1 AS n, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000)
SELECT c.key, c.n, round(c.total + 1.3e-9, 2) AS total, u.n AS accounts_n, u.balance, CASE WHEN u.key IS NULL THEN 'orders' ELSE 'orders,accounts' END AS provenance FROM c LEFT JOIN u USING (key)""")
def merge_sources(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") + F.lit(TIE), 2).alias("total"))
    b = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.lit(1).alias("n"), F.col("c_acctbal").alias("balance"))
    return J.merge_sources({"orders": a, "accounts": b}, ["key"])


@query("collision_delta", "SELECT count(*) AS n_shared, round(max(abs(o_totalprice - l)) + 1.3e-9, 4) AS max_delta FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS l FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def collision_delta(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    return J.collision_delta(o, x, "v", ["o_orderkey"]).select("n_shared", F.round(F.col("max_delta") + F.lit(TIE), 4).alias("max_delta"))


@query("pit_as_of", f"""WITH {BITEMPORAL}, v AS (SELECT * FROM bitemporal WHERE valid_time <= DATE '1996-06-30' AND knowledge_time <= DATE '1996-06-30'),
a AS (SELECT symbol, arg_max(row(volume, knowledge_time), row(valid_time, knowledge_time)) AS l, max(row(valid_time, knowledge_time)) AS anchor FROM v GROUP BY symbol),
k AS (SELECT symbol, arg_max(row(close, knowledge_time), row(valid_time, knowledge_time)) AS c FROM v WHERE close IS NOT NULL GROUP BY symbol)
SELECT symbol, struct_extract_at(anchor, 1) AS valid_time, DATE '1996-06-30' AS knowledge_time, CASE WHEN DATE '1996-06-30' - struct_extract_at(c, 2) <= 180 THEN struct_extract_at(c, 1) END AS close,
CASE WHEN DATE '1996-06-30' - struct_extract_at(l, 2) <= 30 THEN struct_extract_at(l, 1) END AS volume FROM a LEFT JOIN k USING (symbol)""")
def pit_as_of(spark, d):
    """Bitemporal as-of: close walks back to the last known value within 180 days, volume only within its own row."""
    policies = {"close": J.FieldPolicy(ttl_days=180), "default": J.FieldPolicy(forward=False)}
    return J.as_of(bitemporal(spark, d), "1996-06-30", ["close", "volume"], policies)


@query("pit_as_of_join", """WITH e AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS t, o_orderkey FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS rt, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN t - rt <= 365 THEN rt END AS rt_matched, CASE WHEN t - rt <= 365 THEN price END AS price FROM e ASOF LEFT JOIN r ON e.k = r.k AND e.t >= r.rt""")
def pit_as_of_join(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    left = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("day").alias("t"), "o_orderkey")
    right = o.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k"), F.col("day").alias("rt")).agg(F.max("o_totalprice").alias("price"))
    return J.as_of_join(left, right, ["k"], "t", "rt", ["price"], 365).select("o_orderkey", "rt_matched", "price")


@query("pit_as_of_wide", f"""WITH {BITEMPORAL}, days AS (SELECT DISTINCT date_trunc('month', valid_time)::DATE AS date FROM bitemporal), g AS (SELECT date, s FROM days, (VALUES (1), (2), (4)) v(s)),
x AS (SELECT g.date, s, arg_max(row(close, knowledge_time), row(valid_time, knowledge_time, close)) AS m FROM g LEFT JOIN bitemporal b ON b.symbol = g.s AND b.close IS NOT NULL AND valid_time <= g.date AND knowledge_time <= g.date GROUP BY ALL),
y AS (SELECT date, s, CASE WHEN date - struct_extract_at(m, 2) <= 90 THEN struct_extract_at(m, 1) END AS v FROM x)
SELECT date, max(v) FILTER (s = 1) AS "1_close", max(v) FILTER (s = 2) AS "2_close", max(v) FILTER (s = 4) AS "4_close" FROM y GROUP BY date""")
def pit_as_of_wide(spark, d):
    facts = bitemporal(spark, d)
    days = facts.select(F.to_date(F.date_trunc("month", "valid_time")).alias("date")).distinct()
    return J.as_of_wide(facts, days, [1, 2, 4], "close", 90)


@query("universe_members", """WITH e AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'delist' ELSE 'list' END AS event FROM orders),
l AS (SELECT symbol, event, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, event = 'delist' DESC) AS n FROM e WHERE date <= DATE '1997-01-01') SELECT symbol FROM l WHERE n = 1 AND event = 'list'""")
def universe_members(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "delist").otherwise("list").alias("event"))
    return J.members_as_of(e, "1997-01-01")


def _actions(spark, d):
    return ticks(spark, d).filter("volume = 50").groupBy("instrument", F.col("date").alias("event_date")).agg(F.lit(0.5).alias("factor"))


ACTIONS = BARS + ", actions AS (SELECT DISTINCT instrument, date AS event_date, 0.5 AS factor FROM ticks WHERE volume = 50)"


@query("future_action_factor", f"""WITH {ACTIONS} SELECT instrument, date, close, count(event_date) AS n_later, power(0.5::DOUBLE, count(event_date)) AS cumulative_factor FROM bars LEFT JOIN actions USING (instrument) WHERE false GROUP BY ALL
UNION ALL SELECT b.instrument, b.date, b.close, 0, power(0.5::DOUBLE, (SELECT count(*) FROM actions a WHERE a.instrument = b.instrument AND a.event_date > b.date)) FROM bars b""".replace("count(event_date) AS n_later, ", "").replace("b.close, 0, ", "b.close, "))
def future_action_factor(spark, d):
    return J.future_action_factor(bars(spark, d).select("instrument", "date", "close"), _actions(spark, d), symbol="instrument")


@query("corporate_action_joins", f"""WITH {ACTIONS} SELECT b.instrument, b.date, a.factor IS NOT NULL AS split_day, a.factor AS split_factor FROM bars b LEFT JOIN actions a ON a.instrument = b.instrument AND a.event_date = b.date""".replace("a.factor AS split_factor", "a.factor::DOUBLE AS split_factor"))
def corporate_action_joins(spark, d):
    a = _actions(spark, d)
    b = J.same_day_flag(bars(spark, d).select("instrument", "date"), a, "split_day", "instrument")
    return J.left_join_actions(b, a, "split_", "event_date", ["factor"], "instrument")


@query("residuals_and_policy_splits", f"""WITH {PREDICTIONS} SELECT model_id, instrument, date, round(prediction - forward_return + 1.3e-9, 6) AS residual, CASE WHEN fold_id = 'fold_2' THEN 'test' ELSE 'train' END AS split FROM predictions""")
def residuals_and_policy_splits(spark, d):
    p = predictions(spark, d).withColumn("split", F.lit("test"))
    panel = p.filter("model_id = 'momentum'").select("instrument", "date", "forward_return")
    r = J.residuals(J.policy_splits(p.drop("forward_return")), panel, "forward_return", ["instrument", "date"])
    return _six(r, "model_id", "instrument", "date", "split", residual="residual")


@query("range_membership", f"""WITH {BARS} SELECT instrument, date, CASE WHEN date < DATE '1995-01-01' THEN 'early' ELSE 'late' END AS regime FROM bars WHERE date >= DATE '1993-01-01' AND date < DATE '1997-01-01'""")
def range_membership(spark, d):
    ranges = spark.createDataFrame([("early", "1993-01-01", "1995-01-01"), ("late", "1995-01-01", "1997-01-01")], "regime string, s string, e string").select("regime", F.to_date("s").alias("start"), F.to_date("e").alias("end"))
    return J.in_ranges(bars(spark, d).select("instrument", "date"), "date", ranges).select("instrument", "date", "regime")


@query("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT o_custkey FROM orders)""")
def set_operations(spark, d):
    a, b = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    parts = {"union": a.unionByName(b), "intersect": a.intersect(b), "except_all": a.exceptAll(b), "distinct": a.distinct()}
    out = None
    for k, v in parts.items():
        row = v.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# aggregations -------------------------------------------------------------------------------------------------------


@query("resample_events", "SELECT user_id, time_bucket(INTERVAL 1 day, ts) AS ts, arg_min(value, event_id_ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id_ts) AS close, sum(1)::BIGINT AS volume FROM (SELECT *, row(ts, event_id) AS event_id_ts FROM events) WHERE value IS NOT NULL GROUP BY ALL")
def resample_events(spark, d):
    e = table(spark, d, "events").filter("value IS NOT NULL").select("user_id", "ts", "event_id", *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("volume"))
    return A.resample(e, "1 day", ["user_id"], tie="event_id")


SIGNAL = BARS + """, sig AS (SELECT instrument, date, close / lag(close) OVER w - 1 AS raw, CASE WHEN volume > lag(volume) OVER w THEN 1 ELSE -1 END AS signal FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date)),
perf AS (SELECT *, lag(signal) OVER (PARTITION BY instrument ORDER BY date) * greatest(least(raw, 0.5), -0.5) / 10 AS ret, lag(signal) OVER (PARTITION BY instrument ORDER BY date) AS prev FROM sig)"""


def _signals(spark, d):
    w = R.series(["instrument"], ["date"])
    b = bars(spark, d).select("instrument", "date", R.pct_change("close", w).alias("raw"), F.when(F.col("volume") > F.lag("volume").over(w), 1).otherwise(-1).alias("signal"))
    return b.withColumn("ret", F.lag("signal").over(w) * F.greatest(F.least("raw", F.lit(0.5)), F.lit(-0.5)) / 10)


@query("performance_metrics", f"""WITH {SIGNAL}, n AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY instrument ORDER BY date)) AS nav FROM perf), t AS (SELECT *, greatest(1, max(nav) OVER (PARTITION BY instrument ORDER BY date)) AS top FROM n)
SELECT instrument, count(ret) AS n, round(arg_max(nav, date) - 1 + 1.3e-9, 6) AS total_return, round(avg(ret) / stddev_samp(ret) * sqrt(252) + 1.3e-9, 6) AS sharpe, round(min(nav / top - 1) + 1.3e-9, 6) AS max_drawdown_fraction,
  round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) + 1.3e-9, 6) AS win_rate, count(CASE WHEN prev <> signal THEN 1 END) AS n_flips,
  round((power(greatest(arg_max(nav, date), 0), 252.0 / count(ret)) - 1) / abs(min(nav / top - 1)) + 1.3e-9, 6) AS calmar FROM t GROUP BY instrument""")
def performance_metrics(spark, d):
    s = _signals(spark, d)
    p = A.performance(s, "ret", "date", ["instrument"], "signal").join(A.calmar(s, "ret", "date", ["instrument"]), "instrument")
    return _six(p, "instrument", "n", "n_flips", **{c: c for c in ("total_return", "sharpe", "max_drawdown_fraction", "win_rate", "calmar")})


@query("utility_summary", f"""WITH {SIGNAL}, c AS (SELECT *, sum(ret) OVER (PARTITION BY instrument ORDER BY date) AS cum, row_number() OVER (PARTITION BY instrument ORDER BY ret DESC NULLS LAST, date) AS nth FROM perf), t AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY instrument ORDER BY date)) AS top FROM c)
SELECT instrument, count(ret) AS n, round(sum(ret) + 1.3e-9, 6) AS sum_utility, round(avg(ret) + 1.3e-9, 6) AS mean_utility, round(avg(ret) / stddev_samp(ret) * sqrt(252) + 1.3e-9, 6) AS sharpe, round(max(top - cum) + 1.3e-9, 6) AS max_drawdown_log,
  round(sum(CASE WHEN nth <= 5 THEN greatest(ret, 0) END) / sum(CASE WHEN ret > 0 THEN ret END) + 1.3e-9, 6) AS top_share FROM t GROUP BY instrument""")
def utility_summary(spark, d):
    u = A.summarize_utility(_signals(spark, d), "ret", "date", ["instrument"])
    return _six(u, "instrument", "n", **{c: c for c in ("sum_utility", "mean_utility", "sharpe", "max_drawdown_log", "top_share")})


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice) + 1.3e-9, 2) AS total, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
def grouping_sets(spark, d):
    s = A.sum_by_labels(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return s.select("o_orderstatus", "o_orderpriority", F.round(F.col("total") + F.lit(TIE), 2).alias("total"), "level")


@query("top_share", "WITH s AS (SELECT o_orderstatus, o_custkey, abs(sum(o_totalprice)) AS s FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY s DESC, o_custkey) AS n FROM s) SELECT o_orderstatus, round(sum(CASE WHEN n <= 10 THEN s END) / sum(s) + 1.3e-9, 6) AS top_share FROM r GROUP BY 1")
def top_share(spark, d):
    return _six(A.top_share(table(spark, d, "orders"), "o_custkey", "o_totalprice", 10, ["o_orderstatus"]), "o_orderstatus", top_share="top_share")


@query("information_coefficients", f"""WITH {PREDICTIONS}, k AS (SELECT *, rank() OVER (PARTITION BY model_id, date ORDER BY prediction) + (count(*) OVER (PARTITION BY model_id, date, prediction) - 1) / 2 AS a, rank() OVER (PARTITION BY model_id, date ORDER BY forward_return) + (count(*) OVER (PARTITION BY model_id, date, forward_return) - 1) / 2 AS b FROM predictions WHERE prediction IS NOT NULL AND forward_return IS NOT NULL),
i AS (SELECT model_id, date, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM k GROUP BY 1, 2) SELECT model_id, round(avg(c / sqrt(va * vb)) + 1.3e-9, 6) AS mean_ic, count(*) AS n_dates FROM i WHERE n >= 3 AND va > 0 AND vb > 0 GROUP BY 1""")
def information_coefficients(spark, d):
    return _six(A.information_coefficients(predictions(spark, d), "prediction", "forward_return", ["model_id"]), "model_id", "n_dates", mean_ic="mean_ic")


@query("indicator_diagnostics", f"""WITH {PREDICTIONS}, x AS (SELECT model_id AS indicator, split, prediction AS x, forward_return AS y FROM predictions), s AS (SELECT indicator, corr(CASE WHEN split = 'train' THEN x END, y) AS fit, corr(x, y) AS c, avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END) AS hit,
  avg(CASE WHEN split = 'train' THEN sign(x) * y END) AS uf, avg(CASE WHEN split = 'test' THEN sign(x) * y END) AS ut FROM x WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
SELECT indicator, CASE WHEN fit < 0 THEN -1 ELSE 1 END AS orientation, round(CASE WHEN fit < 0 THEN -c ELSE c END + 1.3e-9, 6) AS ic, round(CASE WHEN fit < 0 THEN 1 - hit ELSE hit END + 1.3e-9, 6) AS hit_rate, round(CASE WHEN fit < 0 THEN -uf ELSE uf END + 1.3e-9, 6) AS train_utility, round(CASE WHEN fit < 0 THEN -ut ELSE ut END + 1.3e-9, 6) AS test_utility FROM s""")
def indicator_diagnostics(spark, d):
    wide = A.wide_predictions(predictions(spark, d), ["date", "instrument", "split", "forward_return"], models=["momentum", "reversal", "volume"])
    out = A.indicator_diagnostics(wide, ["momentum", "reversal", "volume"], "forward_return")
    return _six(out, "indicator", "orientation", ic="ic", hit_rate="hit_rate", train_utility="train_utility", test_utility="test_utility")


@query("model_diversity", f"""WITH {PREDICTIONS}, t AS (SELECT model_id, date, instrument FROM (SELECT *, row_number() OVER (PARTITION BY model_id, date ORDER BY prediction DESC, instrument) AS n FROM predictions) WHERE n <= 5), s AS (SELECT model_id, date, list(instrument) AS s FROM t GROUP BY ALL),
o AS (SELECT a.model_id AS model_a, b.model_id AS model_b, avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))) AS overlap FROM s a JOIN s b ON a.date = b.date AND a.model_id < b.model_id GROUP BY ALL),
c AS (SELECT a.model_id AS model_a, b.model_id AS model_b, count(*) AS n, corr(a.prediction, b.prediction) AS corr FROM predictions a JOIN predictions b ON a.date = b.date AND a.instrument = b.instrument AND a.model_id < b.model_id GROUP BY ALL)
SELECT model_a, model_b, n, round(corr + 1.3e-9, 6) AS corr, round(overlap + 1.3e-9, 6) AS overlap FROM c JOIN o USING (model_a, model_b)""")
def model_diversity(spark, d):
    p = predictions(spark, d)
    out = A.model_pairs(p, ["date", "instrument"]).join(A.top_k_overlap(p, 5), ["model_a", "model_b"])
    return _six(out, "model_a", "model_b", "n", corr="corr", overlap="overlap")


@query("wide_predictions", f"""WITH {PREDICTIONS} SELECT date, instrument, max(prediction) FILTER (model_id = 'momentum') AS momentum, max(prediction) FILTER (model_id = 'reversal') AS reversal, max(prediction) FILTER (model_id = 'volume') AS volume FROM predictions GROUP BY 1, 2""")
def wide_predictions(spark, d):
    return A.wide_predictions(predictions(spark, d), ["date", "instrument"], models=["momentum", "reversal", "volume"])


@query("regime_by_target", f"""WITH {PREDICTIONS}, m AS (SELECT date, avg(forward_return) AS m FROM predictions WHERE model_id = 'momentum' GROUP BY 1) SELECT date, round(m + 1.3e-9, 6) AS mean_target, CASE WHEN m <= -1e-4 THEN 'down' WHEN m <= 1e-4 THEN 'flat' WHEN m > 1e-4 THEN 'up' END AS regime FROM m""")
def regime_by_target(spark, d):
    return _six(A.regime_by_target(predictions(spark, d).filter("model_id = 'momentum'"), "forward_return"), "date", "regime", mean_target="mean_target")


@query("cross_section_state", f"""WITH {BARS}, r AS (SELECT instrument, date, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date)), l AS (SELECT date, lag(r) OVER (PARTITION BY instrument ORDER BY date) AS r FROM r)
SELECT date, round(median(r) + 1.3e-9, 6) AS median_return, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) + 1.3e-9, 6) AS breadth, round(stddev_pop(r) + 1.3e-9, 6) AS dispersion, count(*) AS n FROM l WHERE r IS NOT NULL GROUP BY date""")
def cross_section_state(spark, d):
    b = bars(spark, d).select("instrument", "date", R.log_return("close", R.series(["instrument"], ["date"])).alias("r"))
    return _six(A.cross_section_state(b, "r"), "date", "n", median_return="median_return", breadth="breadth", dispersion="dispersion")


@query("quantile_summary", "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}) + 1.3e-9, 6) AS {k}" for k, q in A.QUANTILES.items()) + ", min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice) + 1.3e-9, 6) AS mean, round(stddev_pop(l_extendedprice) + 1.3e-9, 6) AS std FROM lineitem GROUP BY 1")
def quantile_summary(spark, d):
    return _six(A.quantile_summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), "l_returnflag", "n", "min", "max", **{k: k for k in (*A.QUANTILES, "mean", "std")})


@query("prediction_sanity", f"""WITH {PREDICTIONS} SELECT model_id, fold_id, count(prediction) AS n, round(avg(prediction) + 1.3e-9, 6) AS mean, round(stddev_pop(prediction) + 1.3e-9, 6) AS std, count(CASE WHEN abs(prediction) > 1 THEN 1 END) AS n_extreme, round(covar_pop(prediction, forward_return) / var_pop(prediction) + 1.3e-9, 6) AS calibration_slope, stddev_pop(prediction) > 1 AS implausible FROM predictions GROUP BY 1, 2""")
def prediction_sanity(spark, d):
    return _six(A.prediction_sanity(predictions(spark, d), "forward_return", ["model_id", "fold_id"]), "model_id", "fold_id", "n", "n_extreme", "implausible", mean="mean", std="std", calibration_slope="calibration_slope")


@query("fold_audits", f"""WITH {PREDICTIONS}, t AS (SELECT min(forward_return) AS lo, max(forward_return) AS hi FROM predictions WHERE split = 'train'), o AS (SELECT model_id, fold_id, avg(CASE WHEN prediction < lo OR prediction > hi THEN 1.0 ELSE 0.0 END) AS share_outside FROM predictions, t WHERE split = 'test' GROUP BY 1, 2),
f AS (SELECT fold_id, count(*) AS n, min(forward_return) AS min, max(forward_return) AS max, median(forward_return) AS median, count(CASE WHEN abs(forward_return) > 0.5 THEN 1 END) AS n_over_0_5, count(CASE WHEN abs(forward_return) > 1 THEN 1 END) AS n_over_1_0 FROM predictions GROUP BY 1)
SELECT f.fold_id, f.n, round(min + 1.3e-9, 6) AS min, round(max + 1.3e-9, 6) AS max, round(median + 1.3e-9, 6) AS median, n_over_0_5, n_over_1_0, model_id, round(share_outside + 1.3e-9, 6) AS share_outside FROM f LEFT JOIN o USING (fold_id)""")
def fold_audits(spark, d):
    p = predictions(spark, d)
    out = A.fold_target_audit(p, "forward_return").join(A.train_range_audit(p, "forward_return").drop("n"), "fold_id", "left")
    return _six(out, "fold_id", "n", "n_over_0_5", "n_over_1_0", "model_id", min="min", max="max", median="median", share_outside="share_outside")


@query("source_coverage", "SELECT 'orders' AS source, count(*) AS n_rows, 5 AS n_features FROM orders UNION ALL SELECT 'events', count(*), 5 FROM events")
def source_coverage(spark, d):
    return A.source_coverage({"orders": table(spark, d, "orders"), "events": table(spark, d, "events")}, ["o_orderkey", "event_id"])


@query("turnover_ratio", f"""WITH {PREDICTIONS}, p AS (SELECT date, abs(prediction - coalesce(lag(prediction) OVER (PARTITION BY instrument ORDER BY date), 0)) AS m, abs(prediction) AS g FROM predictions WHERE model_id = 'momentum'), s AS (SELECT date, sum(m) AS m, sum(g) AS g FROM p GROUP BY 1) SELECT round(avg(m / nullif(g, 0)) + 1.3e-9, 6) AS turnover_ratio FROM s""")
def turnover_ratio(spark, d):
    return _six(A.turnover_ratio(predictions(spark, d).filter("model_id = 'momentum'"), "prediction", ["instrument"]), turnover_ratio="turnover_ratio")


@query("pareto_front", "SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice >= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice > p.p_retailprice))")
def pareto_front(spark, d):
    return A.pareto_front(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey")
