"""Feature plans: a registry of operators by name, and a compiler from a list of steps to one lazy DataFrame.

A step names an operator and its parameters. The compiler checks names, parameters and outputs, orders steps by what they
need and provide, groups steps that are window expressions of one specification into one projection, and leaves
everything else to the optimizer.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators import rolling as R
from ..operators import sequential as S
from ..operators.rolling import series


class PlanError(ValueError):
    pass


# expressions --------------------------------------------------------------------------------------------------------

EXPRESSIONS: dict[str, Callable[..., Column]] = {}


def register_expression(name: str, builder: Callable[..., Column]) -> None:
    EXPRESSIONS[name] = builder


for _name, _f in {
    "col": F.col, "lit": F.lit, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide, "neg": F.negate, "pow": F.pow,
}.items():
    register_expression(_name, _f)


def expression(tree) -> Column:
    """A nested list ``[name, *arguments]`` as a column; what is no list is a literal argument."""
    if not isinstance(tree, (list, tuple)):
        return tree if isinstance(tree, Column) else F.lit(tree)
    name, *args = tree
    if name not in EXPRESSIONS:
        raise PlanError(f"no expression {name}")
    return EXPRESSIONS[name](*[a if name in ("col", "lit") else expression(a) for a in args])


# operators ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Op:
    """``columns`` ops give column expressions over the plan's window; ``scan`` ops give arrays in a pass over each
    series; ``frame`` ops take and give a DataFrame."""

    name: str
    kind: str
    build: Callable
    requires: Callable[[dict], list[str]]
    provides: Callable[[dict], list[str]]


OPS: dict[str, Op] = {}
ALIASES: dict[str, str] = {}


def register(op: Op) -> None:
    OPS[op.name] = op


def register_alias(alias: str, target: str) -> None:
    ALIASES[alias] = target


def resolve(name: str) -> Op:
    name = ALIASES.get(name, name)
    if name not in OPS:
        raise PlanError(f"no operator {name}")
    return OPS[name]


def feature_op(name: str, kind: str = "columns", requires=lambda p: [p.get("column", "close")], provides=None):
    """Decorator that registers a builder; its keyword parameters are the operator's."""

    def add(f):
        register(Op(name, kind, f, requires, provides or (lambda p: [p.get("out", name.split(".")[-1])])))
        return f

    return add


_named = lambda stem, key="window": lambda p: [p.get("out") or f"{p.get('column', 'close')}_{stem}{p.get(key, 20)}"]


@feature_op("feature.returns")
def _returns(w: WindowSpec, column="close", out="returns", periods=1):
    return {out: R.pct_change(column, w, periods)}


@feature_op("feature.sma", provides=lambda p: [p.get("out") or f"sma_{p.get('window', 20)}"])
def _sma(w, column="close", window=20, out=None):
    return {out or f"sma_{window}": R.rolling_mean(column, w, window)}


@feature_op("stats.rolling_std", provides=_named("std"))
def _std(w, column="close", window=20, min_samples=None, ddof=0, out=None):
    return {out or f"{column}_std{window}": R.rolling_std(column, w, window, min_samples, ddof)}


@feature_op("scaling.zscore_roll", provides=_named("z"))
def _z(w, column="close", window=20, min_samples=None, ddof=0, out=None):
    return {out or f"{column}_z{window}": R.rolling_zscore(column, w, window, min_samples, ddof)}


@feature_op("technical.Bollinger", provides=lambda p: [f"{p.get('prefix', 'bb')}_{k}" for k in ("mid", "std", "upper", "lower")])
def _bollinger(w, column="close", window=20, num_std=2.0, prefix="bb"):
    return {f"{prefix}_{k}": v for k, v in R.bollinger(column, w, window, num_std).items()}


@feature_op("sequence.lags", requires=lambda p: p["columns"], provides=lambda p: [f"{c}_lag{i}" for c in p["columns"] for i in range(1, p["n"] + 1)])
def _lags(w, columns, n):
    return R.lags(columns, n, w)


@feature_op("pairs.beta", requires=lambda p: [p["a"], p["b"]], provides=lambda p: [p.get("out") or f"beta_{p['a']}_{p['b']}"])
def _beta(w, a, b, window=60, out=None):
    return {out or f"beta_{a}_{b}": R.pairs_beta(a, b, w, window)}


@feature_op("pairs.spread", requires=lambda p: [p["a"], p["b"], p["beta"]], provides=lambda p: [p.get("out") or f"spread_{p['a']}_{p['b']}"])
def _spread(w, a, b, beta, out=None):
    return {out or f"spread_{a}_{b}": R.pairs_spread(a, b, beta)}


@feature_op("momentum.vol_scale", requires=lambda p: [p["signal"], p["vol"]])
def _vol(w, signal, vol, target_vol=0.15, max_leverage=2.0, out="vol_scale"):
    return {out: R.vol_scale(signal, vol, target_vol, max_leverage)}


@feature_op("momentum.residual_ols", requires=lambda p: [p["y"], *p["factors"]])
def _residual(w, y, factors, window=60, out="residual_ols"):
    return {out: R.residual_ols(y, factors, w, window)}


@feature_op("momentum.residual_kf", "scan", requires=lambda p: [p["y"], *p["factors"]], provides=lambda p: [p.get("out", "residual_kf")])
def _residual_kf(p, y, factors, process_noise=1e-4, obs_noise=1e-2, out="residual_kf"):
    return {out: S.kalman_residual(p[y].to_numpy(float), p[list(factors)].to_numpy(float), process_noise, obs_noise)}


@feature_op("momentum.industry_score", "frame", requires=lambda p: [p.get("column", "returns"), p.get("sector", "sector")], provides=lambda p: [p.get("out", "industry_score")])
def _industry(df, keys, order, column="returns", sector="sector", window=63, out="industry_score"):
    return R.industry_score(df, column, sector, keys[0], order[0], window, out)


@feature_op("data.load_csv", "frame", requires=lambda p: [], provides=lambda p: list(p.get("columns", [])))
def _load_csv(df, keys, order, path, columns=()):
    """Joins the columns of a csv file by keys and order; the frame's rows stay."""
    from ..sources.readers import read_path

    return df.join(read_path(df.sparkSession, path).select(*keys, *order, *columns).dropDuplicates([*keys, *order]), [*keys, *order], "left")


@feature_op("expr", requires=lambda p: p.get("needs", []), provides=lambda p: [p["out"]])
def _expr(w, tree, out, needs=()):
    return {out: expression(tree)}


@feature_op("technical.EMA", "scan", provides=lambda p: [p.get("out") or f"ema_{p.get('span', 20)}"])
def _ema(p, column="close", span=20, out=None):
    return {out or f"ema_{span}": S.ema(p[column].to_numpy(float), span)}


@feature_op("technical.RSI", "scan", provides=lambda p: [p.get("out", "rsi")])
def _rsi(p, column="close", window=14, out="rsi"):
    return {out: S.wilder_rsi(p[column].to_numpy(float), window)}


@feature_op("technical.MACD_line_signal", "scan", provides=lambda p: ["ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist"])
def _macd(p, column="close", fast=12, slow=26, signal=9):
    return S.macd(p[column].to_numpy(float), fast, slow, signal)


@feature_op("technical.ATR", "scan", requires=lambda p: ["high", "low", "close"], provides=lambda p: [p.get("out") or f"atr_{p.get('window', 14)}"])
def _atr(p, window=14, out=None):
    return {out or f"atr_{window}": S.wilder_atr(*(p[c].to_numpy(float) for c in ("high", "low", "close")), window)}


@feature_op("technical.OBV", "frame", requires=lambda p: ["close", "volume"], provides=lambda p: [p.get("out", "obv")])
def _obv(df, keys, order, out="obv"):
    return R.obv(df, keys, order, out=out)


@feature_op("technical.VWAP", "frame", requires=lambda p: [p["session"], "close", "volume"], provides=lambda p: [p.get("out", "vwap")])
def _vwap(df, keys, order, session, out="vwap"):
    return R.session_vwap(df, keys, order, session, out=out)


@feature_op("feature.rsi", "frame", provides=lambda p: [p.get("out", "rsi_simple")])
def _rsi_simple(df, keys, order, column="close", window=14, out="rsi_simple"):
    return R.rsi_simple(df, column, keys, order, window, out)


@feature_op("stats.half_life", "frame", requires=lambda p: [p["column"]], provides=lambda p: [p.get("out", "half_life")])
def _half_life(df, keys, order, column, window=60, out="half_life"):
    return R.half_life(df, column, keys, order, window, out)


@feature_op("scaling.robust", "frame", requires=lambda p: p["columns"], provides=lambda p: [f"{c}_robust" for c in p["columns"]])
def _robust(df, keys, order, columns):
    return R.robust_scale(df, columns, keys)


for _a, _t in {"sma": "feature.sma", "returns": "feature.returns", "technical.SMA": "feature.sma", "technical.rsi": "technical.RSI", "technical.macd": "technical.MACD_line_signal", "technical.atr": "technical.ATR", "technical.vwap": "technical.VWAP", "technical.bollinger_bands": "technical.Bollinger", "zscore": "scaling.zscore_roll"}.items():
    register_alias(_a, _t)


@dataclass(frozen=True)
class Plan:
    """Steps (name, parameters) over series given by keys and order."""

    keys: list[str]
    order: list[str]
    steps: list[tuple[str, dict]] = field(default_factory=list)

    def then(self, name: str, **params) -> Plan:
        return Plan(self.keys, self.order, [*self.steps, (name, params)])


def _checked(plan: Plan) -> list[tuple[Op, dict]]:
    out, seen = [], set()
    for name, params in plan.steps:
        op = resolve(name)
        known = set(inspect.signature(op.build).parameters)
        if bad := set(params) - known:
            raise PlanError(f"{op.name} has no parameters {sorted(bad)}")
        for c in op.provides(params):
            if c in seen:
                raise PlanError(f"column {c} is made twice")
            seen.add(c)
        out.append((op, params))
    return out


def levels(plan: Plan, columns: list[str]) -> list[list[tuple[Op, dict]]]:
    """Steps by level: each needs only columns of the frame and of earlier levels."""
    todo, have, out = _checked(plan), set(columns), []
    while todo:
        now = [s for s in todo if all(c in have for c in s[0].requires(s[1]))]
        if not now:
            raise PlanError(f"columns that nothing provides: {sorted({c for o, p in todo for c in o.requires(p)} - have)}")
        out.append(now)
        have |= {c for o, p in now for c in o.provides(p)}
        todo = [s for s in todo if s not in now]
    return out


def compile_plan(df: DataFrame, plan: Plan) -> DataFrame:
    """One projection and one pass over the series for each level, however many steps it has."""
    w = series(plan.keys, plan.order)
    for level in levels(plan, df.columns):
        columns: dict[str, Column] = {}
        scans = [(o, p) for o, p in level if o.kind == "scan"]
        for o, p in level:
            if o.kind == "columns":
                columns |= o.build(w, **p)
        df = df.withColumns(columns) if columns else df
        for o, p in level:
            if o.kind == "frame":
                df = o.build(df, plan.keys, plan.order, **p)
        if scans:

            def kernel(pdf, scans=scans):
                found = {}
                for o, p in scans:
                    found |= o.build(pdf, **p)
                return found

            df = S.scan(df, plan.keys, plan.order, [c for o, p in scans for c in o.provides(p)], kernel)
    return df


# versioned cleaning steps ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CleaningStep:
    step_type: str
    version: str
    apply: Callable[..., DataFrame]
    deterministic: bool = True
    stateful: bool = False


STEPS: dict[str, CleaningStep] = {}


def register_cleaning_step(step: CleaningStep) -> None:
    if step.step_type in STEPS and STEPS[step.step_type].version == step.version:
        raise PlanError(f"{step.step_type} {step.version} is registered already")
    STEPS[step.step_type] = step


def run_cleaning(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    for name, params in steps:
        if name not in STEPS:
            raise PlanError(f"no cleaning step {name}")
        df = STEPS[name].apply(df, **params)
    return df


def _register_defaults() -> None:
    from ..operators import cleaning as K

    for name, f in {"missing": K.impute, "outliers": K.outliers, "denoise": K.denoise, "anomaly": K.drop_anomalies, "scale": K.scale}.items():
        STEPS.setdefault(name, CleaningStep(name, "1", f))


_register_defaults()
