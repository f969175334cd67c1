"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and keys only, so it survives retries and repartitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def missing_to_null(value: Column) -> Column:
    """NaN is the missing marker of arrays; here it is NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def normalized(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); unchanged where high equals low."""
    return F.when(high == low, x).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def standardized(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; only centred where std is 0."""
    return F.when(std == 0, x - mean).otherwise((x - mean) / F.nullif(std, F.lit(0.0)))


def unnormalized(x: Column, low: Column, high: Column) -> Column:
    return x * (high - low) + low


def unstandardized(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean


def percent(ratio: Column) -> Column:
    """Whole percent, cut off as shown in reports."""
    return F.floor(ratio * 100 + 1e-9).cast("int")
