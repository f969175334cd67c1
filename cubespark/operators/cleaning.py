"""Masks applied, missing values dropped and filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.functions import uniform


def filter_points(df: DataFrame, variables: list[str], mask: str = "filter_mask", strict_mask: bool = False) -> DataFrame:
    """Point samples without a missing variable; the mask itself counts only if strict_mask."""
    kept = df.na.drop(subset=variables)
    return kept.where(F.col(mask)) if strict_mask else kept


def mask_cells(df: DataFrame, variables: list[str], mask: str = "filter_mask") -> DataFrame:
    """Values outside the mask become missing."""
    return df.withColumns({v: F.when(F.col(mask), F.col(v)) for v in variables})


def drop_unmasked_samples(df: DataFrame, keys: list[str], mask: str = "filter_mask") -> DataFrame:
    """Samples whose cells all lie in the mask."""
    return df.withColumn("_all", F.bool_and(F.coalesce(F.col(mask), F.lit(False))).over(Window.partitionBy(*keys))).where("_all").drop("_all")


def apply_filter(df: DataFrame, variables: list[str], keys: list[str] | None = None, mask: str = "filter_mask", drop_sample: bool = False) -> DataFrame:
    """A mask applied to points (no keys), to whole samples, or to cells; nothing happens without the mask column."""
    if mask not in df.columns:
        return df
    if keys is None:
        return filter_points(df, variables, mask)
    return drop_unmasked_samples(df, keys, mask) if drop_sample else mask_cells(df, variables, mask)


def sample_validity(variables: list[str], mode: str, mask: str | None) -> Column:
    """An aggregate over a sample's cells: is the sample kept?"""
    if not variables:
        return F.lit(True)
    out = None
    for v in variables:
        x = F.col(v)
        if mode == "if_all_nan":
            ok = F.count(x) > 0
        elif mode == "masked" and mask:
            m = F.coalesce(F.col(mask), F.lit(False))
            ok = F.bool_or(m) & (F.count(x) > 0) & F.bool_and(x.isNotNull() | ~m)
        elif mode in ("auto", "masked"):
            ok = F.count(x) == F.count(F.lit(1))
        else:
            raise ValueError(f"no mode {mode}")
        out = ok if out is None else out & ok
    return out


def drop_missing(df: DataFrame, keys: list[str], variables: list[str], mode: str = "auto", mask: str | None = None) -> DataFrame:
    """Samples that pass: auto has no missing value, if_all_nan no variable that is all missing, masked all values in the
    mask (and some). Validity is counted per sample before any array is built."""
    if not variables:
        return df
    valid = df.groupBy(*keys).agg(sample_validity(variables, mode, mask).alias("_ok")).where("_ok").select(*keys)
    return df.join(valid, keys, "left_semi")


def fill_missing(df: DataFrame, variables: list[str], method: str | None, scope: list[str] | None = None, sample: list[str] | None = None, const: float | None = None, seed: int = 0, cell: Column | None = None) -> DataFrame:
    """mean: of the scope (a chunk); sample_mean: of the sample, none left where all are missing; noise: uniform between
    the scope's extremes, from a hash of the cell; constant: const. Another method leaves all as it is."""
    if method == "constant":
        if const is None:
            raise ValueError("constant needs a value")
        return df.withColumns({v: F.coalesce(v, F.lit(float(const))) for v in variables})
    over = Window.partitionBy(*(scope or []))
    if method == "mean":
        return df.withColumns({v: F.coalesce(F.col(v), F.avg(v).over(over)) for v in variables})
    if method == "sample_mean":
        return df if not sample else df.withColumns({v: F.coalesce(F.col(v), F.avg(v).over(Window.partitionBy(*sample))) for v in variables})
    if method == "noise":
        low, high = (lambda v: F.min(v).over(over)), (lambda v: F.max(v).over(over))
        return df.withColumns({v: F.coalesce(F.col(v), low(v) + (high(v) - low(v)) * uniform(seed, F.lit(v), cell)) for v in variables})
    return df
