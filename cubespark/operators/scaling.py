"""Scale parameters and their use: one aggregate, then column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.functions import normalized, standardized, unnormalized, unstandardized

_FORWARD = {"normalize": normalized, "standardize": standardized}
_BACK = {"normalize": unnormalized, "standardize": unstandardized}


def scale_params(df: DataFrame, variables: list[str], method: str) -> dict[str, tuple[float, float]]:
    """(min, max) or (mean, std) of each variable, all in one pass."""
    pair = {"normalize": (F.min, F.max), "standardize": (F.avg, F.stddev_pop)}[method]
    row = df.agg(*[f(v).alias(f"{v}_{k}") for v in variables for k, f in enumerate(pair)]).first()
    return {v: (row[f"{v}_0"], row[f"{v}_1"]) for v in variables}


def scale(df: DataFrame, params: dict[str, tuple[float, float]], method: str) -> DataFrame:
    """Variables with parameters scaled; a method that is neither leaves all as it is."""
    f = _FORWARD.get(method)
    return df.withColumns({v: f(F.col(v), F.lit(a), F.lit(b)) for v, (a, b) in params.items() if v in df.columns}) if f and params else df


def unscale(df: DataFrame, params: dict[str, tuple[float, float]], method: str) -> DataFrame:
    f = _BACK.get(method)
    return df.withColumns({v: f(F.col(v), F.lit(a), F.lit(b)) for v, (a, b) in params.items() if v in df.columns}) if f and params else df
