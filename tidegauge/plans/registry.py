"""Named components: anonymisers, backtest engines, cost models, steps from other packages."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import ledger, strategies


class Registry:
    """Names to components; a name is taken once. ``load`` adds what installed packages offer under a group."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str, component=None):
        def add(c):
            if name in self.known:
                raise ValueError(f"{self.kind} {name} is registered already")
            self.known[name] = c
            return c

        return add(component) if component is not None else add

    def get(self, name: str):
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name}; there are {sorted(self.known)}")
        return self.known[name]

    def load(self, group: str) -> int:
        found = entry_points(group=group)
        for e in found:
            self.register(e.name, e.load())
        return len(found)


ANONYMIZERS, ENGINES, COSTS, FILLS = (Registry(k) for k in ("anonymizer", "engine", "cost model", "fill model"))
ANONYMIZERS.register("masking", lambda c, mark="*": X.mask(c, mark))
ANONYMIZERS.register("hashing", X.hash_hex)
ANONYMIZERS.register("salted", X.salted_hash)
ANONYMIZERS.register("laplace", X.laplace_noise)
ENGINES.register("vectorized.weights", strategies.backtest)
COSTS.register("flat_0bps", lambda fills, keys: ledger.flat_fees(fills, 0.0, keys))
COSTS.register("flat_1bps", lambda fills, keys: ledger.flat_fees(fills, 1.0, keys))
FILLS.register("identity", ledger.identity_fills)


def anonymize(df: DataFrame, columns: list[str], kind: str, governed: bool = False, **params) -> DataFrame:
    """Replaces columns; noise is refused in governed runs, which must repeat."""
    if governed and kind == "laplace":
        raise ValueError("noise cannot be reproduced in a governed run")
    f: Callable[..., Column] = ANONYMIZERS.get(kind)
    return df.withColumns({c: f(F.col(c), **params) for c in columns})
